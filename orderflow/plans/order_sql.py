"""SQL equivalents of the order queries, for checking results elsewhere."""

from __future__ import annotations

from orderflow.plans.order_queries import AS_OF, EVENTS_AS_OF, MONTH
from orderflow.operators.reports import grid_start

ORDERS = """
wo_orders AS (
  SELECT o_orderkey AS order_id, c_name AS client, o_orderdate AS received,
         o_orderdate + INTERVAL 30 DAY AS due, o_orderpriority AS priority
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""

ARTICLES = """
wo_articles AS (
  SELECT l_orderkey AS order_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
           l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_returnflag,
           l_linestatus) - 1 AS idx,
         'P' || l_partkey AS code, l_quantity AS qty, l_partkey AS part_key,
         l_returnflag <> 'N' AS piega, l_linestatus = 'O' AS saldatura
  FROM lineitem),
needs AS (
  SELECT order_id, idx, 'LASER' AS phase, 0 AS seq FROM wo_articles
  UNION ALL SELECT order_id, idx, 'PIEGA', 1 FROM wo_articles WHERE piega
  UNION ALL SELECT order_id, idx, 'SALDATURA', CASE WHEN piega THEN 2 ELSE 1 END
    FROM wo_articles WHERE saldatura),
totals AS (
  SELECT order_id, count(*) AS n_articles, sum(qty) AS total_quantity
  FROM wo_articles GROUP BY order_id),
seeds AS (
  SELECT n.order_id, n.phase, t.n_articles, count(*) AS n_required, min(n.seq) AS seq
  FROM needs n JOIN totals t ON t.order_id = n.order_id
  GROUP BY n.order_id, n.phase, t.n_articles)"""

EVENTS = """
raw_events AS (
  SELECT event_id, user_id, event_type, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
wo_events AS (
  SELECT event_id, user_id * 10 + k // 10 AS order_id,
         CASE k % 3 WHEN 0 THEN 'LASER' WHEN 1 THEN 'PIEGA' ELSE 'SALDATURA' END AS phase,
         CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete_partial'
           ELSE 'complete' END AS action,
         CASE WHEN event_type = 'click' THEN k % 5 END AS idx,
         'op' || (k % 7) AS operator, ts,
         CASE WHEN k % 4 <> 3 THEN 'nota ' || k END AS note
  FROM raw_events)"""


def _fold(mode: str) -> str:
    counted = "WHERE required" if mode == "contract" else ""
    target = "n_required" if mode == "contract" else "n_articles"
    return f"""
done AS (
  SELECT e.order_id, e.phase, e.idx, min(e.ts) AS done_at,
         EXISTS (SELECT 1 FROM needs n WHERE n.order_id = e.order_id AND n.idx = e.idx
                 AND n.phase = e.phase) AS required
  FROM wo_events e
  JOIN wo_articles a ON a.order_id = e.order_id AND a.idx = e.idx
  JOIN seeds s ON s.order_id = e.order_id AND s.phase = e.phase
  WHERE e.action = 'complete_partial' GROUP BY e.order_id, e.phase, e.idx),
marks AS (
  SELECT order_id, phase, min(ts) FILTER (action = 'start') AS started_at,
         min(ts) FILTER (action = 'complete') AS complete_ts,
         arg_min(operator, ts) FILTER (action = 'start') AS operator,
         min(struct_pack(ts := ts, id := event_id, note := note)) FILTER (action = 'complete') AS complete,
         max(struct_pack(ts := ts, id := event_id, note := note)) FILTER (action = 'complete_partial') AS partial
  FROM wo_events GROUP BY order_id, phase),
parts AS (
  SELECT order_id, phase, count(*) AS n_done, max(done_at) AS last_done
  FROM done {counted} GROUP BY order_id, phase),
steps AS (
  SELECT s.order_id, s.phase, s.n_articles, s.n_required,
         coalesce(p.n_done, 0) AS n_done, m.started_at, m.operator,
         least(m.complete_ts, CASE WHEN p.n_done = s.{target} THEN p.last_done END)
           AS ended_at, m.complete, m.partial
  FROM seeds s
  LEFT JOIN marks m ON m.order_id = s.order_id AND m.phase = s.phase
  LEFT JOIN parts p ON p.order_id = s.order_id AND p.phase = s.phase)"""


def _states(mode: str) -> str:
    over = "OR x.ended_at IS NOT NULL" if mode == "contract" else ""
    return f"""
article_phase AS (
  SELECT n.order_id, n.idx, n.phase, n.seq,
         (d.order_id IS NOT NULL {over}) AS finished
  FROM needs n
  LEFT JOIN done d ON d.order_id = n.order_id AND d.idx = n.idx AND d.phase = n.phase
  LEFT JOIN steps x ON x.order_id = n.order_id AND x.phase = n.phase),
extra AS (
  SELECT order_id, idx, phase FROM article_phase WHERE finished
  UNION SELECT order_id, idx, phase FROM done),
marked AS (
  SELECT e.order_id, e.idx, string_agg(e.phase, ' ' ORDER BY n.seq NULLS LAST, s.seq, e.phase) AS completed_phases
  FROM extra e JOIN seeds s ON s.order_id = e.order_id AND s.phase = e.phase
  LEFT JOIN needs n ON n.order_id = e.order_id AND n.idx = e.idx AND n.phase = e.phase
  GROUP BY e.order_id, e.idx),
nexts AS (
  SELECT order_id, idx, arg_min(phase, seq) AS next_phase
  FROM article_phase WHERE NOT finished GROUP BY order_id, idx),
states AS (
  SELECT a.order_id, a.idx, a.code, a.qty, coalesce(m.completed_phases, '') AS completed_phases,
         n.next_phase
  FROM wo_articles a
  LEFT JOIN marked m ON m.order_id = a.order_id AND m.idx = a.idx
  LEFT JOIN nexts n ON n.order_id = a.order_id AND n.idx = a.idx)"""


PROGRESS = """
progress AS (
  SELECT order_id, count(*) AS n_steps, count(ended_at) AS n_completed,
         count(started_at) AS n_started, max(ended_at) AS last_end,
         min(started_at) AS first_start,
         coalesce(string_agg(phase, ' ' ORDER BY phase) FILTER (ended_at IS NOT NULL), '')
           AS completed_phases
  FROM steps GROUP BY order_id),
status AS (
  SELECT o.*, CASE WHEN p.n_completed = p.n_steps THEN 'SPEDITO' ELSE 'RICEVUTO' END AS status
  FROM wo_orders o LEFT JOIN progress p ON p.order_id = o.order_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def time(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f')"


def seconds(start: str, end: str) -> str:
    return (
        f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 1000000.0 + 0.5) AS BIGINT)"
    )


def duration(s: str) -> str:
    return (
        f"CASE WHEN {s} < 60 THEN {s} || 's' "
        f"WHEN {s} < 3600 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' "
        f"WHEN {s} IS NOT NULL THEN ({s} // 3600) || 'h ' || (({s} % 3600) // 60) || 'm' END"
    )


FOLD = _with(ORDERS, ARTICLES, EVENTS, _fold("contract"), PROGRESS)
FOLD_CODE = _with(ORDERS, ARTICLES, EVENTS, _fold("code"), PROGRESS)
STATES = _with(ORDERS, ARTICLES, EVENTS, _fold("contract"), PROGRESS, _states("contract"))
STATES_CODE = _with(ORDERS, ARTICLES, EVENTS, _fold("code"), PROGRESS, _states("code"))

_STEPS = f"""
SELECT order_id, phase, n_articles, n_required, n_done,
       {time('started_at')} AS started_at, operator, {time('ended_at')} AS ended_at,
       CASE WHEN ended_at IS NOT NULL THEN 'completed'
            WHEN started_at IS NOT NULL THEN 'in-progress' ELSE 'pending' END AS state
FROM steps"""

_NEXT = """
SELECT order_id, idx, completed_phases, coalesce(next_phase, 'DONE') AS next_phase,
       next_phase IS NULL AS is_done
FROM states"""


def _queue(phase: str, code: bool = False) -> str:
    opened = (
        f"AND s.order_id IN (SELECT order_id FROM steps WHERE phase = '{phase}' "
        "AND ended_at IS NULL)"
        if code
        else ""
    )
    return f"""
SELECT o.order_id, o.client, {day('o.due')} AS due, count(*) AS n_articles,
       sum(s.qty) AS pieces
FROM states s JOIN wo_orders o ON o.order_id = s.order_id
WHERE s.next_phase = '{phase}' {opened}
GROUP BY o.order_id, o.client, o.due"""


_GRID_FIRST = grid_start(MONTH).isoformat()
_GRID = f"""
grid AS (
  SELECT i AS cell, DATE '{_GRID_FIRST}' + CAST(i AS INTEGER) AS day
  FROM range(42) t(i))"""

SQL = {
    "order_summary": FOLD
    + f"""
SELECT o.order_id, o.client, {day('o.due')} AS due,
       coalesce(t.n_articles, 0) AS n_articles,
       coalesce(t.total_quantity, 0.0) AS total_quantity,
       coalesce(p.n_steps, 0) AS n_steps, coalesce(p.n_completed, 0) AS n_completed
FROM wo_orders o LEFT JOIN totals t ON t.order_id = o.order_id
LEFT JOIN progress p ON p.order_id = o.order_id""",
    "orders_by_client": _with(ORDERS)
    + f"""
SELECT order_id, client, {day('due')} AS due FROM wo_orders
WHERE client = 'Customer#000000007'""",
    "orders_containing": _with(ORDERS)
    + f"""
SELECT order_id, client, {day('due')} AS due FROM wo_orders
WHERE contains(lower(client), 'customer#00000001')""",
    "order_lookup": _with(ORDERS)
    + """
SELECT order_id, substring(client, 1, 12) AS label, priority FROM wo_orders
WHERE order_id = 42""",
    "order_total_quantity": _with(ARTICLES)
    + "\nSELECT order_id, n_articles, total_quantity FROM totals",
    "seed_steps": _with(ARTICLES)
    + "\nSELECT order_id, phase, n_articles, n_required FROM seeds",
    "step_fold": FOLD + _STEPS,
    "step_fold_code": FOLD_CODE + _STEPS,
    "step_notes": FOLD
    + """,
noted AS (
  SELECT order_id, phase,
         CASE WHEN complete.ts <= ended_at AND (partial IS NULL OR complete > partial) THEN complete.note
              ELSE partial.note END AS note
  FROM steps)
SELECT order_id, phase, note FROM noted WHERE note IS NOT NULL""",
    "article_phase_order": _with(ARTICLES, EVENTS)
    + """,
own_needs AS (
  SELECT order_id, idx, unnest(l) AS phase, generate_subscripts(l, 1) AS seq
  FROM (SELECT order_id, idx, CASE WHEN idx % 2 = 0 THEN ['SALDATURA', 'PULIZIA', 'LASER']
                                   ELSE ['SALDATURA', 'LASER'] END AS l FROM wo_articles)),
own_events AS (
  SELECT order_id, CASE phase WHEN 'LASER' THEN 'SALDATURA' WHEN 'PIEGA' THEN 'PULIZIA' ELSE 'LASER' END AS phase,
         action, idx, ts FROM wo_events),
own_seeds AS (
  SELECT order_id, phase, count(*) AS n_required, min(seq) AS seq FROM own_needs GROUP BY order_id, phase),
own_done AS (
  SELECT e.order_id, e.phase, e.idx, min(e.ts) AS done_at,
         bool_or(n.phase IS NOT NULL) AS required
  FROM own_events e JOIN wo_articles a ON a.order_id = e.order_id AND a.idx = e.idx
  JOIN own_seeds s ON s.order_id = e.order_id AND s.phase = e.phase
  LEFT JOIN own_needs n ON n.order_id = e.order_id AND n.idx = e.idx AND n.phase = e.phase
  WHERE e.action = 'complete_partial' GROUP BY ALL),
own_ended AS (
  SELECT order_id, phase FROM own_events WHERE action = 'complete'
  UNION SELECT d.order_id, d.phase FROM own_done d JOIN own_seeds s ON s.order_id = d.order_id AND s.phase = d.phase
  WHERE d.required GROUP BY d.order_id, d.phase, s.n_required HAVING count(*) = s.n_required),
own_finished AS (
  SELECT order_id, idx, phase FROM own_done
  UNION SELECT n.order_id, n.idx, n.phase FROM own_needs n JOIN own_ended e ON e.order_id = n.order_id AND e.phase = n.phase),
own_lists AS (
  SELECT f.order_id, f.idx, string_agg(f.phase, ' ' ORDER BY n.seq NULLS LAST, s.seq, f.phase) AS completed_phases
  FROM own_finished f JOIN own_seeds s ON s.order_id = f.order_id AND s.phase = f.phase
  LEFT JOIN own_needs n ON n.order_id = f.order_id AND n.idx = f.idx AND n.phase = f.phase
  GROUP BY f.order_id, f.idx),
own_next AS (
  SELECT n.order_id, n.idx, arg_min(n.phase, n.seq) AS next_phase FROM own_needs n
  LEFT JOIN own_finished f ON f.order_id = n.order_id AND f.idx = n.idx AND f.phase = n.phase
  WHERE f.phase IS NULL GROUP BY ALL)
SELECT l.order_id, l.idx, l.completed_phases, coalesce(n.next_phase, 'DONE') AS next_phase
FROM own_lists l LEFT JOIN own_next n ON n.order_id = l.order_id AND n.idx = l.idx""",
    "partial_completion": FOLD
    + f"""
SELECT order_id, phase, idx, {time('done_at')} AS done_at, required FROM done""",
    "phase_rejects": FOLD
    + """,
ranked AS (
  SELECT e.*, s.n_articles, s.ended_at,
         row_number() OVER (PARTITION BY e.order_id, e.phase, e.action ORDER BY e.ts, e.event_id)
           AS nth
  FROM wo_events e LEFT JOIN steps s ON s.order_id = e.order_id AND s.phase = e.phase),
judged AS (
  SELECT event_id, order_id, phase, action, idx,
         CASE WHEN n_articles IS NULL THEN 'unknown_step'
              WHEN action = 'start' AND nth > 1 THEN 'already_started'
              WHEN action = 'complete' AND (nth > 1 OR ts > ended_at) THEN 'already_completed'
              WHEN action = 'complete_partial' AND idx >= n_articles
                THEN 'index_out_of_range' END AS reason
  FROM ranked)
SELECT event_id, order_id, phase, action, idx, reason FROM judged WHERE reason IS NOT NULL""",
    "events_without_order": _with(EVENTS)
    + """
SELECT event_id, order_id, phase, action FROM wo_events e
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = e.order_id)""",
    "article_next_phase_contract": STATES + _NEXT,
    "article_next_phase_code": STATES_CODE + _NEXT,
    "phase_badges": STATES
    + """
SELECT p.order_id, p.idx, CAST(p.seq AS BIGINT) AS seq, p.phase,
       CASE WHEN p.finished THEN 'completed' WHEN p.phase = n.next_phase THEN 'next'
            ELSE 'pending' END AS badge
FROM article_phase p LEFT JOIN nexts n ON n.order_id = p.order_id AND n.idx = p.idx""",
    "station_queue_laser": STATES + _queue("LASER"),
    "station_queue_piega": STATES + _queue("PIEGA"),
    "station_queue_saldatura": STATES + _queue("SALDATURA"),
    "station_queue_piega_code": STATES_CODE + _queue("PIEGA", code=True),
    "station_articles": STATES
    + """
SELECT order_id,
       string_agg(idx || ':' || code, ' ' ORDER BY idx) AS articles, sum(qty) AS pieces
FROM states WHERE next_phase = 'PIEGA' GROUP BY order_id""",
    "station_summary": STATES
    + """
SELECT next_phase AS phase, count(DISTINCT order_id) AS n_orders,
       count(*) AS n_articles, sum(qty) AS pieces
FROM states WHERE next_phase IS NOT NULL GROUP BY next_phase""",
    "remaining_articles": FOLD
    + """
SELECT a.order_id, a.idx, a.code, a.qty FROM wo_articles a
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.order_id = a.order_id AND d.idx = a.idx
                  AND d.phase = 'PIEGA')""",
    "open_orders": FOLD
    + f"""
SELECT o.order_id, {day('o.due')} AS due FROM wo_orders o
WHERE o.order_id IN (SELECT order_id FROM steps WHERE phase = 'SALDATURA'
                     AND ended_at IS NULL)""",
    "order_progress": FOLD
    + """
SELECT order_id, n_steps, n_completed, n_completed = n_steps AS all_completed,
       n_completed * 100 // n_steps AS percent,
       CASE WHEN n_completed = n_steps THEN 'SPEDITO' ELSE 'RICEVUTO' END AS status,
       completed_phases
FROM progress""",
    "completion_notifications": FOLD
    + f"""
SELECT order_id, {time('last_end')} AS created_at, 'Ordine completato' AS message,
       false AS viewed, {seconds('first_start', 'last_end')} AS seconds
FROM progress WHERE n_completed = n_steps""",
    "phase_duration": FOLD
    + f""",
timed AS (
  SELECT order_id, phase, {seconds('started_at', 'ended_at')} AS seconds FROM steps
  WHERE started_at IS NOT NULL AND ended_at IS NOT NULL)
SELECT order_id, phase, seconds, {duration('seconds')} AS duration FROM timed""",
    "active_elapsed": FOLD
    + f""",
running AS (
  SELECT order_id, phase, {seconds('started_at', f"TIMESTAMP '{EVENTS_AS_OF}'")} AS seconds
  FROM steps WHERE started_at IS NOT NULL AND ended_at IS NULL)
SELECT order_id, phase, seconds,
       lpad(CAST(seconds // 60 AS VARCHAR), greatest(2, length(CAST(seconds // 60 AS VARCHAR)))::INT, '0')
         || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') AS clock
FROM running""",
    "step_history": FOLD
    + f"""
SELECT e.event_id, e.order_id, e.phase, e.action, e.operator, {time('e.ts')} AS ts,
       CASE WHEN s.ended_at < e.ts THEN 'completed' WHEN s.started_at < e.ts THEN 'in-progress'
            ELSE 'pending' END AS state_before
FROM wo_events e JOIN steps s ON s.order_id = e.order_id AND s.phase = e.phase""",
    "phase_performance": FOLD
    + f""",
timed AS (
  SELECT phase, operator, {seconds('started_at', 'ended_at')} AS seconds FROM steps
  WHERE started_at IS NOT NULL AND ended_at IS NOT NULL)
SELECT phase, operator, count(*) AS n_steps, round(avg(seconds), 3) AS avg_seconds
FROM timed GROUP BY phase, operator""",
    "archive_stats": FOLD
    + """
SELECT count(*) AS n_orders, coalesce(sum(t.total_quantity), 0.0) AS pieces,
       CAST(coalesce(sum(t.n_articles), 0) AS BIGINT) AS n_articles
FROM status s LEFT JOIN totals t ON t.order_id = s.order_id WHERE s.status = 'SPEDITO'""",
    "archive_report": FOLD
    + f""",
timed AS (
  SELECT order_id, phase, {seconds('started_at', 'ended_at')} AS seconds FROM steps
  WHERE started_at IS NOT NULL AND ended_at IS NOT NULL)
SELECT s.order_id, s.client, day(s.due) || '/' || month(s.due) || '/' || year(s.due) AS due_day,
       coalesce(t.total_quantity, 0.0) AS total_quantity,
       coalesce(t.n_articles, 0) AS n_articles,
       coalesce({duration('p.seconds')}, '-') AS piega_time,
       coalesce({duration('w.seconds')}, '-') AS saldatura_time
FROM status s LEFT JOIN totals t ON t.order_id = s.order_id
LEFT JOIN timed p ON p.order_id = s.order_id AND p.phase = 'PIEGA'
LEFT JOIN timed w ON w.order_id = s.order_id AND w.phase = 'SALDATURA'
WHERE s.status = 'SPEDITO'""",
    "calendar_month": FOLD
    + f""",{_GRID}
SELECT {day('g.day')} AS day, g.cell, strftime(g.day, '%Y-%m') <> '{MONTH}' AS other_month,
       g.day = DATE '{AS_OF}' AS is_today, count(s.order_id) AS n_orders
FROM grid g LEFT JOIN status s ON CAST(s.due AS DATE) = g.day AND s.status <> 'SPEDITO'
GROUP BY g.day, g.cell""",
    "calendar_entries": FOLD
    + f""",{_GRID}
SELECT {day('g.day')} AS day, g.cell, s.order_id, substring(s.client, 1, 12) AS label,
       strftime(g.day, '%Y-%m') <> '{MONTH}' AS other_month
FROM grid g JOIN status s ON CAST(s.due AS DATE) = g.day WHERE s.status <> 'SPEDITO'""",
    "order_urgency": _with(ORDERS)
    + f"""
SELECT order_id, CAST(date_diff('day', DATE '{AS_OF}', CAST(due AS DATE)) AS BIGINT) AS days_left,
       date_diff('day', DATE '{AS_OF}', CAST(due AS DATE)) <= 3 AS urgent
FROM wo_orders""",
    "kanban_board": FOLD
    + """,
boards AS (
  SELECT CASE WHEN p.n_steps IS NULL THEN 'blocked'
              WHEN p.n_completed = p.n_steps THEN 'completed'
              WHEN p.n_completed * 3 >= p.n_steps * 2 THEN 'almost_done'
              WHEN p.n_completed > 0 OR p.n_started > 0 THEN 'in_progress'
              ELSE 'not_started' END AS board
  FROM wo_orders o LEFT JOIN progress p ON p.order_id = o.order_id)
SELECT board, count(*) AS n_orders FROM boards GROUP BY board""",
    "remaining_minutes": FOLD
    + f""",
spent AS (
  SELECT order_id, sum(greatest((epoch_us(coalesce(ended_at, TIMESTAMP '{EVENTS_AS_OF}'))
           - epoch_us(started_at)) / 6e7, 0.0)) AS spent
  FROM steps WHERE started_at IS NOT NULL GROUP BY order_id)
SELECT o.order_id, round(greatest(20000 - coalesce(s.spent, 0.0), 0.0), 2) AS remaining_minutes
FROM wo_orders o LEFT JOIN spent s ON s.order_id = o.order_id""",
    "cutting_plan": _with(ORDERS, ARTICLES)
    + """
SELECT p_size / 10.0 AS thickness,
       row_number() OVER (PARTITION BY p_size ORDER BY o.due, a.order_id, a.idx) - 1 AS sequence,
       a.order_id, a.idx, a.qty
FROM wo_articles a JOIN wo_orders o ON o.order_id = a.order_id
JOIN part ON p_partkey = a.part_key""",
    "cutting_plan_by_code": _with(ORDERS, ARTICLES)
    + """,
prefixes AS (SELECT 'P' || p_partkey AS prefix, p_size / 10.0 AS thickness FROM part WHERE p_partkey < 200),
codes AS (
  SELECT code, arg_max(thickness, length(prefix)) AS thickness
  FROM (SELECT DISTINCT code FROM wo_articles) JOIN prefixes ON starts_with(code, prefix) GROUP BY code)
SELECT c.thickness,
       row_number() OVER (PARTITION BY c.thickness ORDER BY o.due, a.order_id, a.idx) - 1 AS sequence,
       a.order_id, a.idx, a.code, a.qty
FROM wo_articles a JOIN wo_orders o ON o.order_id = a.order_id JOIN codes c ON c.code = a.code""",
    "first_steps": _with(EVENTS)
    + """
SELECT order_id, phase, event_id AS step_id, operator FROM wo_events WHERE action = 'start'
QUALIFY row_number() OVER (PARTITION BY order_id, phase ORDER BY event_id) = 1""",
    "first_items": _with(ARTICLES)
    + """
SELECT order_id, idx, code, qty FROM wo_articles
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY qty DESC, idx) <= 2""",
    "orders_json_rejects": _with(ORDERS)
    + """
SELECT order_id AS request, CASE WHEN order_id % 3 = 0 THEN 'malformed JSON'
         WHEN order_id % 7 = 0 THEN 'empty request' ELSE 'accepted' END AS reason
FROM wo_orders""",
    "orders_appended": FOLD
    + """
SELECT order_id, client, status, CASE WHEN order_id % 2 = 0 THEN 'a' ELSE 'b' END AS batch FROM status""",
    "article_update": _with(ARTICLES)
    + """
SELECT order_id, count(*) AS n_articles, sum(qty) AS total_quantity
FROM (SELECT order_id, idx,
             CASE WHEN order_id % 2 = 1 AND many THEN qty * 2 ELSE qty END AS qty
      FROM (SELECT order_id, idx, qty, count(*) OVER (PARTITION BY order_id) > 1 AS many
            FROM wo_articles)
      WHERE order_id % 2 = 0 OR NOT many OR idx > 0)
GROUP BY order_id""",
    "seed_order_steps": _with(ORDERS)
    + """,
lists AS (
  SELECT order_id, CASE WHEN order_id % 2 = 0 THEN ['SALDATURA', 'PULIZIA', 'LASER']
                        ELSE ['VERNICIATURA', 'LASER'] END AS l FROM wo_orders)
SELECT order_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS seq, unnest(l) AS phase
FROM lists""",
    "phase_order": _with(ORDERS)
    + """
SELECT order_id, CAST(CASE WHEN order_id % 2 = 0 THEN 66 ELSE 100 END AS BIGINT) AS percent,
       CASE WHEN order_id % 2 = 0 THEN 'SALDATURA PULIZIA' ELSE 'VERNICIATURA LASER' END
         AS completed_phases
FROM wo_orders""",
    "article_update_rejects": _with(ARTICLES)
    + """
SELECT -order_id - 1 AS order_id, code, qty, 'unknown order' AS reason
FROM wo_articles WHERE idx = 0 AND order_id % 3 = 0""",
    "order_documents": FOLD
    + """,
lists AS (
  SELECT order_id,
         string_agg(idx || ':' || code, ' ' ORDER BY idx) AS articles
  FROM wo_articles GROUP BY order_id),
marks2 AS (
  SELECT order_id, string_agg(phase || CASE WHEN ended_at IS NULL THEN ':-' ELSE ':x' END,
                              ' ' ORDER BY phase) AS steps
  FROM steps GROUP BY order_id)
SELECT s.order_id, s.client, s.status,
       coalesce(l.articles, '') AS articles, coalesce(m.steps, '') AS steps
FROM status s LEFT JOIN lists l ON l.order_id = s.order_id
LEFT JOIN marks2 m ON m.order_id = s.order_id""",
    "order_details": STATES
    + """,
lists AS (
  SELECT order_id,
         string_agg(idx || ':' || code || ':' || replace(completed_phases, ' ', '+') || ':'
                    || coalesce(next_phase, 'DONE'), ' ' ORDER BY idx) AS articles
  FROM states GROUP BY order_id),
noted AS (
  SELECT order_id, string_agg(phase || coalesce(':' || CASE WHEN complete.ts <= ended_at
             AND (partial IS NULL OR complete > partial) THEN complete.note ELSE partial.note END, ''),
           ' ' ORDER BY phase) AS notes
  FROM steps GROUP BY order_id)
SELECT o.order_id, o.client, coalesce(l.articles, '') AS articles,
       coalesce(p.n_steps, 0) AS n_steps, coalesce(x.notes, '') AS notes
FROM wo_orders o LEFT JOIN lists l ON l.order_id = o.order_id
LEFT JOIN progress p ON p.order_id = o.order_id
LEFT JOIN noted x ON x.order_id = o.order_id""",
    "orders_json": _with(ORDERS, ARTICLES)
    + f"""
SELECT o.order_id, o.client, {day('o.due')} AS due, coalesce(t.n_articles, 0) AS n_articles,
       coalesce(t.total_quantity, 0.0) AS total_quantity,
       'LASER PIEGA SALDATURA' AS required_phases, '' AS note
FROM wo_orders o LEFT JOIN totals t ON t.order_id = o.order_id""",
    "article_phases_inherited": _with(ARTICLES)
    + """,
own AS (
  SELECT order_id, string_agg(phase, ' ' ORDER BY phase) AS phases FROM seeds GROUP BY order_id)
SELECT a.order_id, a.idx,
       CASE WHEN a.piega AND a.saldatura THEN 'LASER PIEGA SALDATURA'
            WHEN a.piega THEN 'LASER PIEGA' WHEN a.saldatura THEN 'LASER SALDATURA'
            ELSE own.phases END AS required_phases
FROM wo_articles a JOIN own ON own.order_id = a.order_id""",
    "duplicate_orders": _with(ORDERS)
    + """,
numbered AS (
  SELECT order_id, client, strftime(received, '%Y%m') AS order_no,
         row_number() OVER w AS nth, first_value(order_id) OVER w AS first_order_id
  FROM wo_orders
  WINDOW w AS (PARTITION BY client, strftime(received, '%Y%m') ORDER BY received, order_id))
SELECT order_id, client, order_no, first_order_id FROM numbered WHERE nth > 1""",
}
SQL["batch_report"] = (
    SQL["phase_rejects"].rsplit("\nSELECT event_id", 1)[0]
    + """
SELECT reason AS name, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason
UNION ALL
SELECT CASE WHEN ended_at IS NOT NULL THEN 'completed' WHEN started_at IS NOT NULL THEN 'in-progress'
            ELSE 'pending' END AS name, count(*) AS n FROM steps GROUP BY 1"""
)
