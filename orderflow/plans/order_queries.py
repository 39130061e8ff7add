"""Catalogue queries over work orders, articles and phase events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.dates import clock_text, iso_day, iso_time, seconds_between
from orderflow.operators import orders as O
from orderflow.operators import phases as P
from orderflow.operators import reports as R
from orderflow.operators import routing as Q
from orderflow.operators.matching import longest_prefix
from orderflow.schemas import COMPLETE_PARTIAL, START
from orderflow.session import checkpoint_dir
from orderflow.sources.corpus import write_orders_batch, write_report
from orderflow.sources import workorders as W

MONTH, AS_OF = "1998-06", "1998-06-15"
EVENTS_AS_OF = "2024-02-01"


class State:
    """Folded state shared by the queries of one call.

    Steps need the articles of orders with partial completions only; ``whole``
    is for queries that look at all articles, so these are numbered once.
    """

    def __init__(self, spark: SparkSession, folder: str, mode: str = "contract", whole: bool = False):
        self.spark, self.folder, self.mode = spark, folder, mode
        touched = None if whole else W.work_events(spark, folder).where(F.col("action") == COMPLETE_PARTIAL)
        self.articles = W.work_articles(spark, folder, only=touched)
        self.lines = W.work_lines(spark, folder)
        self.events = W.work_events(spark, folder)
        self.seeds = P.seed_steps(self.lines)
        self.marked = P.completions(self.events, self.articles)
        self.steps = P.fold_steps(self.seeds, self.events, self.marked, mode)

    @property
    def done(self) -> DataFrame:
        return P.known_completions(self.marked, self.seeds)

    @property
    def states(self) -> DataFrame:
        return Q.article_states(self.articles, self.done, self.steps, self.mode)

    def orders(self, client: bool = True) -> DataFrame:
        return W.work_orders(self.spark, self.folder, client)

    @property
    def orders_with_status(self) -> DataFrame:
        return P.order_status(self.orders(), self.steps)

    @property
    def totals(self) -> DataFrame:
        return O.article_totals(self.lines)


def order_summary(spark, folder):
    s = State(spark, folder)
    return O.order_summary(s.orders(), s.lines, s.steps).select(
        "order_id",
        "client",
        iso_day(F.col("due")).alias("due"),
        "n_articles",
        "total_quantity",
        "n_steps",
        "n_completed",
    )


def _listed_orders(spark, folder) -> DataFrame:
    """Orders with phase lists of their own, in an order and with names of their own."""
    return W.work_orders(spark, folder, client=False).withColumn(
        "required_phases",
        F.when(F.col("order_id") % 2 == 0, F.split(F.lit("SALDATURA PULIZIA LASER"), " "))
        .otherwise(F.split(F.lit("VERNICIATURA LASER"), " ")),
    )


def seed_order_steps(spark, folder):
    return P.seed_order_steps(_listed_orders(spark, folder)).withColumn(
        "seq", F.col("seq").cast("long")
    )


def phase_order(spark, folder):
    """Completed phases of orders whose first two steps have ended, in step order."""
    orders = _listed_orders(spark, folder)
    steps = P.seed_order_steps(orders).join(orders.select("order_id", "received"), "order_id")
    ended = steps.withColumn("ended_at", F.when(F.col("seq") < 2, F.col("received")))
    return P.order_progress(ended).select(
        "order_id", "percent", F.array_join("completed_phases", " ").alias("completed_phases")
    )


def orders_by_client(spark, folder):
    return O.filter_orders(W.work_orders(spark, folder), client="Customer#000000007").select(
        "order_id", "client", iso_day(F.col("due")).alias("due")
    )


def orders_containing(spark, folder):
    return O.filter_orders(W.work_orders(spark, folder), contains="CUSTOMER#00000001").select(
        "order_id", "client", iso_day(F.col("due")).alias("due")
    )


def order_lookup(spark, folder):
    return O.order_by_id(W.work_orders(spark, folder), 42).select(
        "order_id", F.substring(F.col("client"), 1, 12).alias("label"), "priority"
    )


def order_total_quantity(spark, folder):
    return O.article_totals(W.work_lines(spark, folder))


def seed_steps(spark, folder):
    return P.seed_steps(W.work_lines(spark, folder)).select(
        "order_id", "phase", "n_articles", "n_required"
    )


def _steps(steps: DataFrame) -> DataFrame:
    return steps.select(
        "order_id",
        "phase",
        "n_articles",
        "n_required",
        "n_done",
        iso_time(F.col("started_at")).alias("started_at"),
        "operator",
        iso_time(F.col("ended_at")).alias("ended_at"),
        "state",
    )


def step_fold(spark, folder):
    return _steps(State(spark, folder).steps)


def step_fold_code(spark, folder):
    return _steps(State(spark, folder, "code").steps)


def step_notes(spark, folder):
    """Steps that were ever written a note, with the one that stays."""
    return State(spark, folder).steps.where(F.col("note").isNotNull()).select("order_id", "phase", "note")


def article_phase_order(spark, folder):
    """Articles of lists whose phases are not in alphabetical order, events in these phases."""
    phases = ["SALDATURA", "PULIZIA", "LASER"]
    lists = F.when(F.col("idx") % 2 == 0, F.array(*[F.lit(p) for p in phases])).otherwise(
        F.array(F.lit("SALDATURA"), F.lit("LASER"))
    )
    articles = W.work_articles(spark, folder).withColumn("required_phases", lists)
    events = W.phase_events(W.table(spark, folder, "events"), phases)
    steps, done, _ = P.fold_phase_events(events, articles)
    return Q.article_states(articles, done, steps).where(F.size("completed_phases") > 0).select(
        "order_id", "idx", F.array_join("completed_phases", " ").alias("completed_phases"), F.coalesce("next_phase", F.lit("DONE")).alias("next_phase")
    )


def partial_completion(spark, folder):
    return State(spark, folder).done.select(
        "order_id", "phase", "idx", iso_time(F.col("done_at")).alias("done_at"), "required"
    )


def phase_rejects(spark, folder):
    s = State(spark, folder)
    return P.phase_rejects(s.events, s.steps).withColumn(
        "idx", F.col("idx").cast("long")
    )


def events_without_order(spark, folder):
    orders = W.work_lines(spark, folder).select("order_id").distinct()
    return O.missing_orders(W.work_events(spark, folder), orders).select(
        "event_id", "order_id", "phase", "action"
    )


def _next_phase(s: State) -> DataFrame:
    return s.states.select(
        "order_id",
        "idx",
        F.array_join("completed_phases", " ").alias("completed_phases"),
        F.coalesce("next_phase", F.lit("DONE")).alias("next_phase"),
        "is_done",
    )


def article_next_phase_contract(spark, folder):
    return _next_phase(State(spark, folder, whole=True))


def article_next_phase_code(spark, folder):
    return _next_phase(State(spark, folder, "code", whole=True))


def phase_badges(spark, folder):
    return Q.phase_badges(State(spark, folder, whole=True).states).withColumn(
        "seq", F.col("seq").cast("long")
    )


def _queue(s: State, phase: str) -> DataFrame:
    return Q.station_queue(s.orders(), s.states, s.steps, phase, s.mode).withColumn(
        "due", iso_day(F.col("due"))
    )


def station_queue_laser(spark, folder):
    return _queue(State(spark, folder, whole=True), "LASER")


def station_queue_piega(spark, folder):
    return _queue(State(spark, folder, whole=True), "PIEGA")


def station_queue_saldatura(spark, folder):
    return _queue(State(spark, folder, whole=True), "SALDATURA")


def station_queue_piega_code(spark, folder):
    return _queue(State(spark, folder, "code", whole=True), "PIEGA")


def station_articles(spark, folder):
    """Waiting articles of one station as a list per order."""
    s = State(spark, folder, whole=True)
    waiting = Q.waiting_articles(s.states, s.steps, "PIEGA")
    lists = O.nested_articles(waiting, ["code", "qty"])
    return lists.select(
        "order_id",
        F.array_join(
            F.transform("articles", lambda a: F.concat_ws(":", a["idx"], a["code"])), " "
        ).alias("articles"),
        F.aggregate("articles", F.lit(0.0), lambda t, a: t + a["qty"]).alias("pieces"),
    )


def station_summary(spark, folder):
    return Q.station_summary(State(spark, folder, whole=True).states)


def remaining_articles(spark, folder):
    s = State(spark, folder, whole=True)
    return Q.remaining_articles(s.articles, s.done, "PIEGA").select(
        "order_id", "idx", "code", "qty"
    )


def open_orders(spark, folder):
    s = State(spark, folder)
    opened = Q.open_orders(s.steps, "SALDATURA")
    return s.orders(client=False).join(opened, "order_id", "left_semi").select(
        "order_id", iso_day(F.col("due")).alias("due")
    )


def order_progress(spark, folder):
    return P.order_progress(State(spark, folder).steps).select(
        "order_id",
        "n_steps",
        "n_completed",
        "all_completed",
        "percent",
        "status",
        F.array_join("completed_phases", " ").alias("completed_phases"),
    )


def completion_notifications(spark, folder):
    return P.completion_notifications(State(spark, folder).steps).withColumn(
        "created_at", iso_time(F.col("created_at"))
    )


def phase_duration(spark, folder):
    return P.phase_durations(State(spark, folder).steps).select(
        "order_id", "phase", "seconds", "duration"
    )


def active_elapsed(spark, folder):
    running = State(spark, folder).steps.where(F.col("state") == "in-progress")
    seconds = seconds_between(F.col("started_at"), F.to_timestamp(F.lit(EVENTS_AS_OF)))
    return running.select(
        "order_id", "phase", seconds.alias("seconds"), clock_text(seconds).alias("clock")
    )


def step_history(spark, folder):
    s = State(spark, folder)
    return P.step_history(s.events, s.steps).withColumn("ts", iso_time(F.col("ts")))


def phase_performance(spark, folder):
    return R.phase_performance(State(spark, folder).steps).withColumn(
        "avg_seconds", F.round("avg_seconds", 3)
    )


def archive_stats(spark, folder):
    s = State(spark, folder)
    shipped = O.filter_orders(
        P.order_status(s.orders(client=False), s.steps), status="SPEDITO"
    )
    return R.order_statistics(shipped, s.totals)


def archive_report(spark, folder):
    s = State(spark, folder)
    return R.archive_report(s.orders_with_status, s.totals, s.steps)


def calendar_month(spark, folder):
    s = State(spark, folder)
    orders = P.order_status(s.orders(client=False), s.steps)
    return R.calendar_month(orders, MONTH, AS_OF).withColumn("day", iso_day(F.col("day")))


def calendar_entries(spark, folder):
    s = State(spark, folder)
    return R.calendar_entries(s.orders_with_status, MONTH, AS_OF).select(
        iso_day(F.col("day")).alias("day"), "cell", "order_id", "label", "other_month"
    )


def order_urgency(spark, folder):
    return R.urgency(W.work_orders(spark, folder, client=False), AS_OF).select(
        "order_id", "days_left", "urgent"
    )


def kanban_board(spark, folder):
    s = State(spark, folder)
    return R.kanban_board(s.orders(client=False), s.steps)


def remaining_minutes(spark, folder):
    s = State(spark, folder)
    orders = s.orders(client=False).withColumn("estimate_minutes", F.lit(20_000))
    return R.remaining_minutes(orders, s.steps, EVENTS_AS_OF).select(
        "order_id", F.round("remaining_minutes", 2).alias("remaining_minutes")
    )


def cutting_plan(spark, folder):
    articles = W.work_articles(spark, folder, names=True).withColumn(
        "thickness", F.col("size") / F.lit(10.0)
    )
    orders = W.work_orders(spark, folder, client=False).select("order_id", "due")
    plan = R.cutting_plan(articles.join(orders, "order_id"))
    return plan.select("thickness", "sequence", "order_id", "idx", "qty")


def cutting_plan_by_code(spark, folder):
    """Cutting plan with thicknesses by code prefix: sizes of the first two hundred parts."""
    mapping = W.table(spark, folder, "part").where(F.col("p_partkey") < 200).select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("prefix"),
        (F.col("p_size") / F.lit(10.0)).alias("thickness"),
    )
    articles = longest_prefix(W.work_articles(spark, folder), mapping, value="thickness")
    orders = W.work_orders(spark, folder, client=False).select("order_id", "due")
    plan = R.cutting_plan(articles.where(F.col("thickness").isNotNull()).join(orders, "order_id"))
    return plan.select("thickness", "sequence", "order_id", "idx", "code", "qty")


def first_steps(spark, folder):
    """Of repeated starts of a phase, the step of the lowest id."""
    starts = W.work_events(spark, folder).where(F.col("action") == START)
    return O.first_steps(starts.select("order_id", "phase", F.col("event_id").alias("step_id"), "operator"))


def first_items(spark, folder):
    """The two articles of each order with most pieces."""
    largest = [F.desc("qty"), F.col("idx")]
    return O.first_rows(W.work_articles(spark, folder), ["order_id"], largest, 2).select("order_id", "idx", "code", "qty")


def _requests(spark, folder) -> DataFrame:
    lists = O.nested_articles(W.work_articles(spark, folder), ["code", "qty", "required_phases"])
    requests = W.work_orders(spark, folder).join(lists, "order_id", "left").select(
        F.col("order_id").cast("string").alias("order_id"), F.col("client").alias("cliente"), "articles"
    )
    return requests.select(F.col("order_id").cast("long").alias("request"), F.to_json(F.struct("*")).alias("json"))


def orders_json_rejects(spark, folder):
    """Requests of which some were cut short or lost their text: these are rejects, the others orders."""
    short = F.expr("substring(json, 1, length(json) - 3)")
    spoilt = F.when(F.col("request") % 3 == 0, short).when(F.col("request") % 7 == 0, F.lit("  ")).otherwise(F.col("json"))
    orders, rejects = O.split_orders_json(_requests(spark, folder).withColumn("json", spoilt))
    good = orders.select(F.col("order_id").cast("long").alias("request"), F.lit("accepted").alias("reason"))
    return good.unionByName(rejects.select("request", "reason"))


def _written_down(df: DataFrame, path: str) -> DataFrame:
    """What several writes take from is computed one time, to the shared folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def orders_appended(spark, folder):
    """Orders written in two batches, the first of them twice, and read back."""
    base = f"{checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    path = f"{base}/batches"
    orders = _written_down(State(spark, folder).orders_with_status.select("order_id", "client", "status"), f"{base}/orders")
    for batch, half in (("a", 0), ("a", 0), ("b", 1)):
        write_orders_batch(orders.where(F.col("order_id") % 2 == half), path, batch)
    return spark.read.parquet(path).select("order_id", "client", "status", "batch")


def batch_report(spark, folder):
    """Steps and rejects of a batch as JSON, written twice and read back, by reason."""
    base = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    path = f"{base}/report"
    s = State(spark, folder)
    steps = _written_down(s.steps, f"{base}/steps")
    rejects = _written_down(P.phase_rejects(s.events, steps), f"{base}/rejects")
    for _ in range(2):
        write_report(_steps(steps), rejects, path, "1", compression="gzip")
    results, errors = (spark.read.json(f"{path}/{k}") for k in ("results", "errors"))
    done = results.groupBy(F.col("state").alias("name")).agg(F.count("*").alias("n"))
    return done.unionByName(errors.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")))


def article_update(spark, folder):
    """Orders with an odd key get new lists twice; the later version stays."""
    articles = W.work_articles(spark, folder).select("order_id", "idx", "code", "qty")
    changed = articles.where(F.col("order_id") % 2 == 1)
    versions = changed.withColumn("version", F.lit(1)).unionByName(
        changed.where(F.col("idx") > 0).select(
            "order_id",
            (F.col("idx") - 1).alias("idx"),
            F.concat(F.col("code"), F.lit("-B")).alias("code"),
            (F.col("qty") * 2).alias("qty"),
            F.lit(2).alias("version"),
        )
    )
    return O.article_totals(O.update_articles(articles, versions))


def article_update_rejects(spark, folder):
    """Updates that name an order which does not exist: keys of suppliers' parts."""
    orders = W.work_orders(spark, folder, client=False)
    updates = W.work_articles(spark, folder).where(F.col("idx") == 0).select(
        F.when(F.col("order_id") % 3 == 0, -F.col("order_id") - 1).otherwise(F.col("order_id")).alias("order_id"),
        "idx", "code", "qty", F.lit(1).alias("version"),
    )
    return O.known_updates(updates, orders)[1].select("order_id", "code", "qty", "reason")


def order_documents(spark, folder):
    s = State(spark, folder, whole=True)
    docs = O.order_documents(
        s.orders_with_status.select("order_id", "client", "status"),
        s.articles.select("order_id", "idx", "code", "qty"),
        s.steps,
    )
    return docs.select(
        "order_id",
        "client",
        "status",
        F.array_join(
            F.transform("articles", lambda a: F.concat_ws(":", a["idx"], a["code"])), " "
        ).alias("articles"),
        F.array_join(
            F.transform(
                "steps",
                lambda x: F.concat_ws(
                    ":", x["phase"], F.when(x["ended_at"].isNotNull(), "x").otherwise("-")
                ),
            ),
            " ",
        ).alias("steps"),
    )


def order_details(spark, folder):
    """Nested documents whose articles carry their state."""
    s = State(spark, folder, whole=True)
    docs = O.order_documents(
        s.orders().select("order_id", "client", "estimate_minutes"), s.states, s.steps
    )
    state = lambda a: F.concat_ws(
        ":",
        a["idx"],
        a["code"],
        F.array_join(a["completed_phases"], "+"),
        F.coalesce(a["next_phase"], F.lit("DONE")),
    )
    return docs.select(
        "order_id",
        "client",
        F.array_join(F.transform("articles", state), " ").alias("articles"),
        F.size("steps").cast("long").alias("n_steps"),
        F.array_join(
            F.transform("steps", lambda x: F.concat_ws(":", x["phase"], x["note"])), " "
        ).alias("notes"),
    )


def orders_json(spark, folder):
    """Orders written as JSON requests and read back with defaults."""
    articles = W.work_articles(spark, folder)
    lists = O.nested_articles(articles, ["code", "qty", "required_phases"])
    requests = W.work_orders(spark, folder).join(lists, "order_id", "left").select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("client").alias("cliente"),
        F.date_format("due", "yyyy-MM-dd'T'HH:mm:ss").alias("data_consegna"),
        "articles",
    )
    text = requests.select(F.to_json(F.struct("*")).alias("json"))
    back = O.orders_from_json(text)
    return back.select(
        F.col("order_id").cast("long").alias("order_id"),
        "client",
        iso_day(F.col("due")).alias("due"),
        F.size("articles").cast("long").alias("n_articles"),
        "total_quantity",
        F.array_join("required_phases", " ").alias("required_phases"),
        "note",
    )


def article_phases_inherited(spark, folder):
    """Articles that name no bending or welding inherit their order's phases."""
    articles = W.work_articles(spark, folder)
    bare = articles.withColumn(
        "required_phases",
        F.when(F.size("required_phases") > 1, F.col("required_phases")),
    )
    orders = P.seed_steps(W.work_lines(spark, folder)).groupBy("order_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "phase"))), lambda x: x["phase"]
        ).alias("required_phases")
    )
    return Q.inherit_phases(bare, orders).select(
        "order_id", "idx", F.array_join("required_phases", " ").alias("required_phases")
    )


def duplicate_orders(spark, folder):
    orders = W.work_orders(spark, folder).withColumn(
        "order_no", F.date_format("received", "yyyyMM")
    )
    return O.duplicate_orders(orders)


def entry_queue(spark, folder):
    return station_queue_laser(spark, folder).orderBy("due", "order_id")


QUERIES = {
    f.__name__: f
    for f in (
        order_summary, orders_by_client, orders_containing, order_lookup,
        order_total_quantity, seed_steps, seed_order_steps, phase_order, step_fold, step_fold_code, step_notes, article_phase_order,
        partial_completion, phase_rejects, events_without_order,
        article_next_phase_contract, article_next_phase_code, phase_badges,
        station_queue_laser, station_queue_piega, station_queue_saldatura,
        station_queue_piega_code, station_articles, station_summary,
        remaining_articles, open_orders, order_progress,
        completion_notifications, phase_duration, active_elapsed, step_history,
        phase_performance, archive_stats, archive_report, calendar_month,
        calendar_entries, order_urgency, kanban_board, remaining_minutes,
        cutting_plan, cutting_plan_by_code, first_steps, first_items, orders_json_rejects, orders_appended,
        batch_report, article_update, article_update_rejects, order_documents, order_details, orders_json,
        article_phases_inherited, duplicate_orders,
    )
}
