"""Orders and articles: ingest defaults, updates, filters, nested views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions.text import contains_any, strip
from orderflow.schemas import DEFAULT_PHASES, ORDER_REQUEST, RECEIVED

UNKNOWN_ORDER = "unknown order"
MALFORMED, EMPTY_REQUEST = "malformed JSON", "empty request"

_NO_ARTICLES = "array<struct<name:string,code:string,qty:double,required_phases:array<string>>>"


def phase_list(raw: Column) -> Column:
    """Required phases from a JSON list or from words parted by white space."""
    text = strip(raw)
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(words)


def default_phases(phases: Column) -> Column:
    """The default list where none, or an empty one, is given."""
    default = F.array(*[F.lit(p) for p in DEFAULT_PHASES])
    return F.when(F.size(phases) > 0, phases).otherwise(default)


def total_quantity(articles: Column) -> Column:
    return F.aggregate(
        articles, F.lit(0.0), lambda total, a: total + F.coalesce(a["qty"], F.lit(0.0))
    )


def orders_from_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """Typed orders from request documents, one JSON text per row.

    Missing keys take their defaults; an empty list counts as missing.
    """
    parsed = raw.select(F.from_json(column, ORDER_REQUEST).alias("o")).select("o.*")
    articles = F.transform(
        "articles",
        lambda a: F.struct(
            F.coalesce(a["name"], F.lit("N/A")).alias("name"),
            F.coalesce(a["code"], F.lit("")).alias("code"),
            F.coalesce(a["qty"].try_cast("double"), F.lit(0.0)).alias("qty"),
            F.coalesce(
                phase_list(a["required_phases"]), F.array().cast("array<string>")
            ).alias("required_phases"),
        ),
    )
    typed = parsed.select(
        "order_id",
        F.col("cliente").alias("client"),
        F.try_to_timestamp("data_consegna").alias("due"),
        F.coalesce(articles, F.array().cast(_NO_ARTICLES)).alias("articles"),
        default_phases(F.col("required_phases")).alias("required_phases"),
        F.coalesce("preventivo_minuti", F.lit(0)).alias("estimate_minutes"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.lit(RECEIVED).alias("status"),
    )
    return typed.withColumn("total_quantity", total_quantity(F.col("articles")))


def split_orders_json(raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Orders of well-formed requests, and the other texts with a reason.

    Texts are parsed once, permissively, and what does not parse is kept as it
    came. Blank and missing texts are rejects too. All columns of ``raw`` stay
    with the rejects.
    """
    kept = T.StructType([*ORDER_REQUEST.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.withColumn("_o", F.from_json(column, kept, options))
    reason = F.when(F.coalesce(F.trim(column), F.lit("")) == "", EMPTY_REQUEST).when(
        F.col("_o").isNull() | F.col("_o._corrupt").isNotNull(), MALFORMED
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(column)
    return orders_from_json(good, column), judged.where(F.col("reason").isNotNull()).drop("_o")


def orders_to_json(orders: DataFrame, column: str = "json") -> DataFrame:
    return orders.select("order_id", F.to_json(F.struct("*")).alias(column))


def valid_form_articles(articles: Column, phases: Column) -> Column:
    """Articles of an order form: named, with a positive whole quantity.

    Codes default to ``N/A``; the phases chosen for the order go to each article.
    """
    typed = F.transform(
        articles,
        lambda a: F.struct(
            a["name"].alias("name"),
            F.coalesce(F.nullif(a["code"], F.lit("")), F.lit("N/A")).alias("code"),
            F.nullif(F.regexp_extract(a["qty"], r"^\s*(-?\d+)", 1), F.lit(""))
            .try_cast("double")
            .alias("qty"),
            default_phases(phases).alias("required_phases"),
        ),
    )
    return F.filter(typed, lambda a: (F.length(a["name"]) > 0) & (a["qty"] > 0))


def explode_articles(orders: DataFrame) -> DataFrame:
    """One row per article; the list position is its key within the order."""
    return orders.select("order_id", F.posexplode("articles").alias("idx", "a")).select(
        "order_id", F.col("idx").cast("long").alias("idx"), "a.*"
    )


def article_totals(articles: DataFrame) -> DataFrame:
    return articles.groupBy("order_id").agg(
        F.count("*").alias("n_articles"),
        F.sum(F.coalesce("qty", F.lit(0.0))).alias("total_quantity"),
    )


def update_articles(articles: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the whole article list of every order named in ``updates``.

    ``updates`` holds article rows with a ``version``; the highest version of an
    order wins. The version to keep is one small row per order, so both joins
    stay splittable however long a single list is.
    """
    latest = updates.groupBy("order_id").agg(F.max("version").alias("version"))
    fresh = updates.join(latest, ["order_id", "version"], "left_semi").drop("version")
    kept = articles.join(latest.select("order_id"), "order_id", "left_anti")
    return kept.unionByName(fresh)


def known_updates(updates: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates of orders that exist, and the others with a reason."""
    known = updates.join(orders.select("order_id"), "order_id", "left_semi")
    return known, missing_orders(updates, orders).withColumn("reason", F.lit(UNKNOWN_ORDER))


def missing_orders(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows that name an order which does not exist."""
    return rows.join(orders.select("order_id"), "order_id", "left_anti")


def filter_orders(
    orders: DataFrame,
    client: str | None = None,
    contains: str | None = None,
    status: str | None = None,
    not_status: str | None = None,
) -> DataFrame:
    """Optional filters; an absent or empty argument filters nothing."""
    if client:
        orders = orders.where(F.col("client") == client)
    if contains:
        orders = orders.where(contains_any(F.lower("client"), [contains.lower()]))
    if status:
        orders = orders.where(F.col("status") == status)
    if not_status:
        orders = orders.where(F.col("status") != not_status)
    return orders


def order_by_id(orders: DataFrame, order_id) -> DataFrame:
    return orders.where(F.col("order_id") == F.lit(order_id))


def nested_steps(steps: DataFrame) -> DataFrame:
    """Steps as one list per order; an order has at most one step per phase."""
    fields = ["phase", "started_at", "ended_at", "operator", *(["note"] if "note" in steps.columns else [])]
    return steps.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("steps")
    )


def nested_articles(
    articles: DataFrame, fields: list[str], page_size: int | None = None
) -> DataFrame:
    """Articles of each order as one list in order.

    With ``page_size`` the lists are cut into pages of that many entries, with
    a column ``page``, for readers that cannot take a long order as one row.
    """
    keys = ["order_id"]
    if page_size:
        keys.append(F.floor(F.col("idx") / page_size).cast("long").alias("page"))
    entries = F.collect_list(F.struct("idx", *fields))
    return articles.groupBy(*keys).agg(F.array_sort(entries).alias("articles"))


def order_documents(
    orders: DataFrame, articles: DataFrame, steps: DataFrame
) -> DataFrame:
    """Orders as nested documents with articles and steps (empty lists if none)."""
    fields = [c for c in articles.columns if c not in ("order_id", "idx")]
    lists = nested_articles(articles, fields)
    joined = orders.join(nested_steps(steps), "order_id", "left").join(
        lists, "order_id", "left"
    )
    return joined.select(
        *[c for c in orders.columns],
        F.coalesce("articles", F.array()).alias("articles"),
        F.coalesce("steps", F.array()).alias("steps"),
    )


def order_summary(orders: DataFrame, articles: DataFrame, steps: DataFrame) -> DataFrame:
    """One line per order: totals, step counts and status inputs."""
    step_counts = steps.groupBy("order_id").agg(
        F.count("*").alias("n_steps"), F.count("ended_at").alias("n_completed")
    )
    return (
        orders.join(article_totals(articles), "order_id", "left")
        .join(step_counts, "order_id", "left")
        .fillna(0, ["n_articles", "n_steps", "n_completed"])
        .fillna(0.0, ["total_quantity"])
    )


def duplicate_orders(orders: DataFrame) -> DataFrame:
    """Orders that repeat an earlier (client, order number).

    The earliest row of each pair is found by an aggregation, so one client
    with very many orders needs no sorted window.
    """
    first = orders.groupBy("client", "order_no").agg(
        F.min(F.struct("received", "order_id")).alias("first"), F.count("*").alias("n")
    )
    return (
        orders.join(first.where(F.col("n") > 1), ["client", "order_no"])
        .where(F.struct("received", "order_id") > F.col("first"))
        .select(
            "order_id", "client", "order_no", F.col("first.order_id").alias("first_order_id")
        )
    )


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group; every task keeps n of a group before they meet."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def first_steps(steps: DataFrame) -> DataFrame:
    """First row per (order, phase) where a log holds several: lowest step id."""
    return first_rows(steps, ["order_id", "phase"], ["step_id"])
