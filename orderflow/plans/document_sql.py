"""SQL equivalents of the document queries, for checking results elsewhere."""

from __future__ import annotations

from orderflow.plans.order_sql import ARTICLES, ORDERS, day
from orderflow.plans.rendering import LAYOUTS


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _pad(value: str, width: int) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"lpad({text}, greatest({width}, length({text}))::INT, '0')"


LINES = """
doc_lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

STRIPPED = """
stripped AS (
  SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line
  FROM doc_lines)"""

_LAYOUT = """
CASE WHEN contains(u, 'DIVISIONE CUCINE')
       OR (contains(u, 'N. 300') AND contains(u, 'ORDINE FORNITORE')) THEN 'DIVISIONE'
     WHEN contains(u, 'B&B ITALIA') AND contains(u, 'ORDINE ACQUISTO') THEN 'PO_BEBITALIA'
     WHEN regexp_matches(text, 'A\\s*[0-9]{3,}') AND contains(u, 'DECA')
       AND contains(text, 'Spett.le') THEN 'OAFA'
     WHEN contains(u, 'ORDINE FORNITORE') AND contains(u, 'AZA INTERNATIONAL')
       THEN 'FOR_ORDINE_AZA'
     WHEN contains(u, 'ORDINE FORNITORE') THEN 'FOR_ORDINE'
     WHEN contains(u, 'ABIEFFE') OR (contains(u, 'ORDINE')
       AND (contains(u, 'LS') OR contains(u, 'L.S'))) THEN 'ORDINE_LS'
     ELSE 'GENERIC' END"""

LAYOUT = f"""
layouts AS (
  SELECT doc_id, text, {_LAYOUT} AS layout FROM (SELECT *, upper(text) AS u FROM documents))"""

PROFILE = """
profile AS (
  SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, layout,
         contains(upper(text), 'DECA') AS has_deca,
         contains(upper(text), 'ORDINE FORNITORE') AS has_order,
         contains(upper(text), 'DIVISIONE CUCINE') AS has_division,
         contains(upper(text), 'B&B ITALIA') AS has_bebitalia,
         contains(upper(text), 'AZA INTERNATIONAL') AS has_aza,
         CAST(len(list_distinct(regexp_extract_all(text, '[A-Z]{2,}[0-9]+[A-Z0-9-]*'))) AS BIGINT)
           AS codes,
         CAST(len(regexp_extract_all(text, '[0-9]+[.,][0-9]+')) AS BIGINT) AS quantities
  FROM layouts)"""

RENDERED = f"""
art AS (
  SELECT a.*, p_name AS name, idx AS n, order_id % 8 AS turn,
         CAST(order_id AS VARCHAR) AS doc_id, {_pad('part_key', 8)} AS p8
  FROM wo_articles a LEFT JOIN part ON p_partkey = part_key),
docs AS (
  SELECT o.order_id, o.received, o.due, o.order_id % 8 AS turn,
         coalesce(p.n_art, 0) AS n_art,
         CAST(o.order_id AS VARCHAR) AS doc_id
  FROM wo_orders o
  LEFT JOIN (SELECT order_id, count(*) AS n_art FROM art GROUP BY order_id) p
    ON p.order_id = o.order_id)"""


def _items(layout: str, source: str = "art") -> str:
    """Items the layout must give back for the articles of ``source``."""
    if layout == "DIVISIONE":
        return f"""
SELECT doc_id, 'DIVISIONE' AS layout, n AS pos, 'AVAR' || {_pad('part_key', 10)} AS code,
       upper(name) AS name, qty FROM {source}"""
    if layout == "PO_BEBITALIA":
        return f"""
SELECT doc_id, 'PO_BEBITALIA' AS layout,
       row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, 'S' || p8 AS code,
       upper(name) AS name, qty
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part_key ORDER BY n) AS nth
      FROM {source}) WHERE nth = 1"""
    if layout == "FOR_ORDINE_AZA":
        return f"""
SELECT doc_id, 'FOR_ORDINE_AZA' AS layout, n AS pos, 'ZA' || p8 AS code,
       '7,16 ' || upper(name) AS name, qty FROM {source}"""
    if layout == "FOR_ORDINE":
        return f"""
SELECT doc_id, 'FOR_ORDINE' AS layout,
       row_number() OVER (PARTITION BY doc_id ORDER BY odd, n) - 1 AS pos, 'CF' || p8 AS code,
       CASE WHEN odd = 0 THEN upper(name) ELSE name END AS name,
       CASE WHEN odd = 0 THEN qty ELSE n + 1.0 END AS qty
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part_key ORDER BY odd, n) AS nth
      FROM (SELECT *, idx % 2 AS odd FROM {source})) WHERE odd = 0 OR nth = 1"""
    if layout == "OAFA":
        return f"""
SELECT doc_id, 'OAFA' AS layout, n AS pos, '25CC' || p8 AS code, upper(name) || ' S235JR' AS name, qty
FROM {source}"""
    if layout == "ORDINE_LS":
        return f"""
SELECT doc_id, 'ORDINE_LS' AS layout, n AS pos,
       CASE order_id % 4 WHEN 0 THEN 'TF' WHEN 1 THEN '3LAM.' WHEN 2 THEN 'SR5-' ELSE 'HG' END
         || p8 AS code,
       CASE order_id % 4 WHEN 1 THEN '3LAM.' || p8 WHEN 3 THEN upper(name) ELSE name END AS name,
       CASE WHEN order_id % 4 = 3 THEN 1.0 ELSE qty END AS qty
FROM {source}"""
    return f"""
SELECT doc_id, 'GENERIC' AS layout, n AS pos, 'GX' || p8 AS code, name, qty FROM {source}"""


MIXED = """
mixed_items AS (
""" + "\nUNION ALL".join(
    _items(name, f"(SELECT * FROM art WHERE turn = {i})") for i, name in enumerate(LAYOUTS)
) + f"""),
mixed_totals AS (
  SELECT doc_id, count(*) AS n_items, sum(qty) AS pieces FROM mixed_items GROUP BY doc_id),
headers AS (
  SELECT doc_id, order_id, turn, n_art,
    CASE turn WHEN 0 THEN 'DIVISIONE' WHEN 1 THEN 'PO_BEBITALIA' WHEN 2 THEN 'FOR_ORDINE_AZA'
      WHEN 3 THEN 'FOR_ORDINE' WHEN 4 THEN 'OAFA' WHEN 5 THEN 'ORDINE_LS' WHEN 6 THEN 'GENERIC'
      ELSE CASE WHEN order_id % 16 = 15 THEN 'GENERIC' END END AS layout,
    CASE turn WHEN 0 THEN 'DIVISIONE CUCINE' WHEN 1 THEN 'B&B ITALIA S.p.A.'
      WHEN 2 THEN 'AZA INTERNATIONAL S.R.L.' WHEN 3 THEN 'Metalli Uniti S.r.l.'
      WHEN 4 THEN 'DECA S.r.l.' WHEN 5 THEN 'Abieffe Trading S.r.l'
      WHEN 6 THEN 'Ferramenta Bianchi snc'
      ELSE CASE WHEN order_id % 16 = 15 THEN 'senza dati' END END AS client,
    CASE turn WHEN 0 THEN '300' || lpad(CAST(order_id % 1000000 AS VARCHAR), 6, '0')
      WHEN 1 THEN {_pad('order_id', 11)} || '-1' WHEN 4 THEN 'A' || {_pad('order_id', 10)}
      WHEN 7 THEN NULL ELSE CAST(order_id AS VARCHAR) END AS order_no,
    CASE WHEN turn = 7 OR (turn IN (3, 4) AND n_art = 0) THEN NULL
      WHEN turn = 1 AND n_art = 0 THEN {day('received')}
      WHEN turn = 4 THEN '20' || strftime(due, '%y-%m-%d') ELSE {day('due')} END AS due,
    CASE WHEN turn IN (6, 7) THEN NULL ELSE {day('received')} END AS received,
    CASE WHEN order_id % 16 = 7 THEN 'No text extracted from PDF' END AS error,
    '/orders/' || CASE turn WHEN 0 THEN 'DIVISIONE' WHEN 1 THEN 'PO_BEBITALIA'
      WHEN 2 THEN 'FOR_ORDINE_AZA' WHEN 3 THEN 'FOR_ORDINE' WHEN 4 THEN 'OAFA'
      WHEN 5 THEN 'ORDINE_LS' WHEN 6 THEN 'GENERIC' ELSE 'NOTE' END
      || '_' || {_pad('order_id', 7)} || '.pdf' AS path
  FROM docs),
batch AS (
  SELECT h.*, coalesce(t.n_items, 0) AS n_items, coalesce(t.pieces, 0.0) AS pieces,
         h.order_no IS NOT NULL AND coalesce(t.n_items, 0) > 0 AS ok
  FROM headers h LEFT JOIN mixed_totals t ON t.doc_id = h.doc_id)"""

RENDER = _with(ORDERS, ARTICLES, RENDERED)
BATCH = _with(ORDERS, ARTICLES, RENDERED, MIXED)

_COUNTS = """
count(*) AS documents, count(*) FILTER (ok) AS n_accept,
       count(*) FILTER (client IS NOT NULL AND ok) AS n_strict,
       count(*) FILTER (error IS NULL AND n_items > 0) AS n_lenient,
       count(*) FILTER (order_no IS NOT NULL) AS n_number,
       CAST(sum(n_items) AS BIGINT) AS items, sum(pieces) AS pieces,
       count(*) FILTER (NOT ok) AS n_errors"""


def _known_client() -> str:
    keys = ["0000173", "0000205", "0000445", "0000537"]
    test = " OR ".join(f"contains(path, '{k}')" for k in keys)
    return f"CASE WHEN {test} THEN 'Sozzi Arredamenti S.p.A.' END"


_ORDINARY = "length(line) > 20 AND NOT regexp_matches(line, '^(The|Der|La|El) ')"

SQL = {
    "doc_lines": _with(LINES) + "\nSELECT doc_id, line_no, line FROM doc_lines",
    "doc_head": """
SELECT doc_id, substring(text, 1, 500) AS head,
       substring(text, 1, CASE WHEN strpos(text, 'License') > 0
         THEN least(strpos(text, 'License') - 1, 1000)
         WHEN strpos(text, 'the') > 0 THEN least(strpos(text, 'the') - 1, 1000)
         ELSE 1000 END) AS before_mark,
       array_to_string(list_slice(string_split(text, chr(10)), 1, 30), '/') AS head_lines
FROM documents""",
    "first_documents": BATCH + "\nSELECT path, doc_id FROM headers ORDER BY path LIMIT 8",
    "doc_layout": _with(LAYOUT) + "\nSELECT doc_id, layout FROM layouts",
    "doc_first_line": _with(LINES, STRIPPED)
    + f""",
marked AS (
  SELECT *, {_ORDINARY} AS ordinary,
         lag(line) OVER w AS previous, lead(line) OVER w AS following
  FROM stripped WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
firsts AS (
  SELECT doc_id, min(line_no) FILTER (ordinary) AS at,
         arg_min(line, line_no) FILTER (ordinary) AS first_line,
         arg_min(previous, line_no) FILTER (ordinary AND previous IS NOT NULL) AS previous,
         arg_min(following, line_no) FILTER (ordinary AND following IS NOT NULL) AS following
  FROM marked GROUP BY doc_id),
near AS (
  SELECT f.doc_id, arg_min(s.line, s.line_no) AS near
  FROM firsts f JOIN stripped s ON s.doc_id = f.doc_id AND s.line_no > f.at
    AND s.line_no <= f.at + 4 AND contains(s.line, 'an') GROUP BY f.doc_id)
SELECT f.doc_id, f.first_line, f.previous, f.following, n.near
FROM firsts f LEFT JOIN near n ON n.doc_id = f.doc_id""",
    "client_by_path": """
SELECT p.page_id, arg_min(c.c_name, c.c_custkey) AS client
FROM pages p LEFT JOIN customer c ON contains(p.url, '/' || c.c_custkey) GROUP BY p.page_id""",
    "layout_by_rules": """
WITH u AS (SELECT doc_id, upper(text) AS t FROM documents)
SELECT doc_id, 'terms' AS rule_set,
       CASE WHEN contains(t, 'MIT') AND contains(t, 'LICENSE') THEN 'MIT'
            WHEN contains(t, 'APACHE') AND (contains(t, 'LICENSE') OR contains(t, 'VERSION')) THEN 'APACHE'
            WHEN contains(t, 'GENERAL PUBLIC') OR contains(t, 'GPL') THEN 'GPL' ELSE 'OTHER' END AS layout FROM u
UNION ALL
SELECT * FROM (
  SELECT doc_id, 'contact' AS rule_set,
         CASE WHEN contains(t, '@') AND (contains(t, '.COM') OR contains(t, '.ORG')) THEN 'MAIL'
              WHEN contains(t, '+') THEN 'PHONE'
              WHEN contains(t, 'THE') AND contains(t, 'ING') THEN 'LETTER' END AS layout FROM u) WHERE layout IS NOT NULL""",
    "layout_registered": _with(LAYOUT)
    + """
SELECT CASE WHEN l.layout = 'GENERIC' AND contains(upper(d.text), 'LICENSE') THEN 'LICENZA' ELSE l.layout END AS layout,
       count(*) AS documents
FROM layouts l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""",
    "doc_profile": _with(LAYOUT, PROFILE) + "\nSELECT * FROM profile",
    "doc_profile_summary": _with(LAYOUT, PROFILE)
    + """
SELECT layout, count(*) AS documents, CAST(sum(chars) AS BIGINT) AS chars,
       CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(codes) AS BIGINT) AS codes,
       CAST(sum(quantities) AS BIGINT) AS quantities
FROM profile GROUP BY layout""",
    "doc_line_marks": BATCH
    + """
SELECT doc_id, turn = 4 AS has_deca, turn IN (2, 3, 4) AS has_order, turn = 0 AS has_division,
       turn = 1 AS has_bebitalia, turn = 2 AS has_aza FROM headers""",
    "block_segments": _with(LINES, STRIPPED)
    + """,
numbered AS (
  SELECT doc_id, line_no, line,
         sum(CASE WHEN regexp_matches(line, '^[A-E]') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY line_no) AS b
  FROM stripped),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, b ORDER BY line_no) AS k
  FROM numbered WHERE b > 0)
SELECT doc_id, CAST(b - 1 AS BIGINT) AS block_no, min(line_no) AS start, count(*) AS n_lines,
       arg_min(line, line_no) FILTER (regexp_matches(line, '[0-9]')) AS digit_line,
       CAST(coalesce(sum(length(line)) FILTER (k > 2), 0)
         + greatest(count(*) FILTER (k > 2) - 1, 0) AS BIGINT) AS tail_chars
FROM placed GROUP BY doc_id, b""",
    "doc_islands": _with(LINES)
    + """,
members AS (
  SELECT doc_id, line_no, line,
         line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g
  FROM doc_lines WHERE contains(line, ',')),
runs AS (
  SELECT doc_id, g, count(*) AS n_lines, arg_min(line, line_no) AS first_line,
         min(line_no) AS start
  FROM members GROUP BY doc_id, g HAVING count(*) >= 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS island,
       n_lines, first_line FROM runs""",
    "doc_until": _with(LINES)
    + """
SELECT d.doc_id, coalesce(min(line_no) FILTER (regexp_matches(line, '[Ll]icense|[0-9]')),
                          count(*)) AS n_lines
FROM doc_lines d GROUP BY d.doc_id""",
    "doc_code_segments": """
SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS segment, unnest(w) AS word
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]{2,}') AS w FROM documents)""",
    "page_texts": """
SELECT conv_id AS doc_id,
       coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text
FROM conversations GROUP BY conv_id""",
    "html_titles": """
SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''),
                         nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '')) AS title
FROM pages""",
    "extract_headers": BATCH
    + """
SELECT doc_id, layout, client, order_no, due, received, error FROM headers""",
    "extract_mixed_items": BATCH
    + "\nSELECT doc_id, layout, pos, code, name, qty FROM mixed_items",
    "extract_totals": BATCH
    + """
SELECT doc_id, n_items, pieces AS total_quantity, due IS NULL AS due_missing,
       layout IS NOT NULL AND n_items < CASE WHEN layout IN ('OAFA', 'GENERIC') THEN 5 ELSE 1 END
         AS needs_tables
FROM batch""",
    "rendered_layout": BATCH
    + """
SELECT coalesce(layout, 'GENERIC') AS layout, count(*) AS documents FROM headers GROUP BY 1""",
    "ingest_report": BATCH
    + f""",
counted AS (SELECT {_COUNTS} FROM batch)
SELECT *, n_accept * 100 // documents AS pct_accept, n_strict * 100 // documents AS pct_strict,
       n_lenient * 100 // documents AS pct_lenient, n_number * 100 // documents AS pct_number
FROM counted""",
    "ingest_by_layout": BATCH
    + f""",
counted AS (SELECT layout, {_COUNTS} FROM batch GROUP BY layout)
SELECT layout, documents, n_accept, n_errors, items, pieces,
       n_accept * 100 // documents AS pct_accept FROM counted""",
    "ingest_rejects": BATCH
    + """
SELECT path, coalesce(error, 'Dati insufficienti per creare ordine') AS error
FROM batch WHERE NOT ok""",
    "ingest_orders": BATCH
    + """
SELECT doc_id AS order_id, client, coalesce(due, '2000-01-01') AS due, n_items AS n_articles,
       pieces AS total_quantity, 'Estratto da: ' || path AS note
FROM batch WHERE ok""",
    "ingest_new_paths": BATCH
    + "\nSELECT doc_id, path FROM headers WHERE order_id % 2 = 1",
    "ingest_times": _with(LAYOUT)
    + """
SELECT layout, count(*) AS documents, round(sum(length(text)) / 1000.0, 3) AS total_seconds,
       round(avg(length(text)) / 1000.0, 6) AS mean_seconds,
       max(length(text)) / 1000.0 AS max_seconds
FROM layouts GROUP BY layout""",
    "client_dictionary": BATCH
    + f"\nSELECT doc_id, {_known_client()} AS client FROM headers",
    "reconcile": BATCH
    + """,
expected AS (
  SELECT CAST(o.order_id AS VARCHAR) AS doc_id, coalesce(t.n_articles, 0) AS articles,
         CAST(coalesce(t.total_quantity, 0) AS BIGINT) AS quantity
  FROM wo_orders o LEFT JOIN totals t ON t.order_id = o.order_id),
compared AS (
  SELECT coalesce(e.doc_id, b.doc_id) AS doc_id,
         concat_ws('; ',
           CASE WHEN b.doc_id IS NULL THEN 'document missing' END,
           CASE WHEN e.doc_id IS NULL THEN 'document unexpected' END,
           CASE WHEN e.articles <> b.n_items
             THEN 'articles: ' || e.articles || ' != ' || b.n_items END,
           CASE WHEN e.quantity <> CAST(b.pieces AS BIGINT)
             THEN 'quantity: ' || e.quantity || ' != ' || CAST(b.pieces AS BIGINT) END)
           AS mismatches
  FROM expected e FULL JOIN batch b ON b.doc_id = e.doc_id)
SELECT doc_id, mismatches, mismatches = '' AS passed FROM compared""",
    "item_rejects": RENDER
    + """
SELECT doc_id, 'CF' || p8 AS code,
       CASE WHEN n % 2 = 0 THEN replace(upper(name), 'WIDGET', 'prodotto') ELSE replace(name, 'widget', 'prodotto') END AS name,
       CASE WHEN n % 2 = 1 THEN n + 1.0 WHEN qty = 50 THEN 0.0 ELSE qty END AS qty,
       CASE WHEN n % 2 = 0 AND qty = 50 THEN 'quantity' ELSE 'heading' END AS reason
FROM art WHERE contains(name, 'widget') OR (n % 2 = 0 AND qty = 50)""",
    "markdown_items": RENDER
    + """
SELECT doc_id, n AS pos, 'MT' || p8 AS code, name,
       CAST(CAST(qty AS BIGINT) AS VARCHAR) || ',50' AS qty_raw, qty + 0.5 AS qty FROM art""",
    "markdown_cells_count": RENDER
    + """,
table_rows AS (
  SELECT doc_id, unnest(range(0, n_art + 3)) AS row_no FROM docs),
counted AS (
  SELECT row_no, count(*) AS cells FROM table_rows GROUP BY row_no)
SELECT row_no, c.col_no, cells FROM counted, (SELECT unnest([0, 1, 2])::BIGINT AS col_no) c""",
    "table_fallback": RENDER
    + """
SELECT d.doc_id, 'DIVISIONE' AS layout, d.n_art AS n_items,
       coalesce(sum(a.qty + 0.5), 0.0) AS total_quantity
FROM docs d LEFT JOIN art a ON a.doc_id = d.doc_id GROUP BY d.doc_id, d.n_art""",
}
SQL |= {
    key: RENDER + _items(layout)
    for key, layout in {
        "extract_divisione_items": "DIVISIONE",
        "extract_bebitalia_items": "PO_BEBITALIA",
        "extract_aza_items": "FOR_ORDINE_AZA",
        "extract_for_ordine_items": "FOR_ORDINE",
        "extract_oafa_items": "OAFA",
        "extract_ls_items": "ORDINE_LS",
        "extract_generic_items": "GENERIC",
    }.items()
}
