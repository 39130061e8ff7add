"""From document texts to structured orders, in one pass without a shuffle.

A document is one row and every rule is a column expression on it, so the
whole extraction is a projection: it scales with the number of input splits,
and neither a frequent layout nor a long document creates a hot task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import first_non_empty, strip
from orderflow.operators.extractors.common import company_name, item, no_items
from orderflow.operators.layout import DEFAULT_LAYOUTS, Layout, classify_layout
from orderflow.operators.mdtable import table_items
from orderflow.operators.orders import total_quantity

NO_TEXT = "No text extracted from PDF"
HEADER_FIELDS = ("client", "order_no", "due", "received")


def _by_layout(layouts: Sequence[Layout], value) -> Column:
    chosen = F.lit(None)
    for layout in reversed(layouts):
        chosen = F.when(F.col("layout") == layout.name, value(layout)).otherwise(chosen)
    return chosen


def _named(items: Column) -> Column:
    """An empty name becomes the code, a missing code ``N/A``."""
    return F.transform(
        items,
        lambda x: item(
            x["code"],
            F.coalesce(
                F.when(F.length(strip(x["name"])) > 0, x["name"]), x["code"], F.lit("N/A")
            ),
            x["qty"],
        ),
    )


def _once(df: DataFrame, kept: Sequence[str], fields: Sequence[Column]) -> DataFrame:
    """Compute the fields one time per row.

    Filters and projections on top of a plain projection are merged into it,
    which would run the extraction again for every mention of a field. A
    generated one-row struct is a boundary they do not cross.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))


def extract(
    docs: DataFrame,
    layouts: Sequence[Layout] = DEFAULT_LAYOUTS,
    path: str | None = "path",
    table_text: str | None = None,
    headers: bool | Sequence[str] = True,
    items: bool = True,
) -> DataFrame:
    """Layout, header fields and items of every document.

    Documents come as (doc_id, text) with optional path and optional table
    text; the latter is read only where a layout found too few items itself.
    Switch off ``headers`` or ``items`` where only the other part is wanted, or
    name the header fields that are: each one takes searches of the whole text.
    """
    named = (HEADER_FIELDS if headers else ()) if isinstance(headers, bool) else tuple(headers)
    fields = _fields(tuple(layouts), path, table_text, named, items, _gateway())
    kept = [c for c in docs.columns if c not in ("text", table_text)]
    found = _once(classify_layout(docs, layouts), kept, fields)
    if "due" in named:
        found = found.withColumn("due_missing", F.col("due").isNull())
    if items:
        least = _by_layout(layouts, lambda layout: F.lit(layout.min_items))
        found = found.select(
            "*",
            F.size("items").cast("long").alias("n_items"),
            total_quantity(F.col("items")).alias("total_quantity"),
            F.coalesce(F.size("items") < least, F.lit(False)).alias("needs_tables"),
        )
    return found


def _gateway() -> int:
    """Identity of the running JVM connection that column objects belong to."""
    return id(SparkContext._gateway)


@functools.lru_cache(maxsize=32)
def _fields(
    layouts: tuple[Layout, ...],
    path: str | None,
    table_text: str | None,
    headers: tuple[str, ...],
    items: bool,
    gateway: int,
) -> tuple[Column, ...]:
    """Columns of the extraction. They name their inputs, not a DataFrame, so
    one set serves every corpus; building it takes thousands of JVM calls."""
    text = F.col("text")
    where = F.col(path) if path else F.lit(None).cast("string")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    fields = [
        F.when(~empty, F.col("layout")).alias("layout"),
        F.when(empty, F.lit(NO_TEXT)).alias("error"),
    ]
    if headers:
        by_name = {layout.name: layout.header(text, where) for layout in layouts}
        if table_text:
            for layout in layouts:
                if layout.client_from_tables:
                    found = by_name[layout.name]
                    found["client"] = F.coalesce(
                        found["client"], company_name(F.col(table_text))
                    )
        fields += [
            _by_layout(layouts, lambda x, f=f: by_name[x.name][f]).alias(f)
            for f in headers
        ]
    if items:
        fields.append(_named(_found_items(layouts, table_text)).alias("items"))
    return tuple(fields)


def _found_items(layouts: Sequence[Layout], table_text: str | None) -> Column:
    found = _by_layout(layouts, lambda layout: layout.items(F.col("text")))
    if not table_text:
        return F.coalesce(found, no_items())
    from_tables = F.transform(
        table_items(F.col(table_text)), lambda x: item(x["code"], x["name"], x["qty"])
    )
    readers = [layout.name for layout in layouts if layout.reads_tables]
    usable = F.col("layout").isin(readers) & F.col(table_text).isNotNull()
    return F.coalesce(
        first_non_empty(found, F.when(usable, from_tables)), no_items()
    )


def extract_headers(docs: DataFrame, **options) -> DataFrame:
    return extract(docs, items=False, **options)


def extract_items(docs: DataFrame, **options) -> DataFrame:
    """Items as rows: (doc_id, layout, pos, code, name, qty)."""
    return items_as_rows(extract(docs, headers=False, **options))


def items_as_rows(extracted: DataFrame) -> DataFrame:
    return extracted.select(
        "doc_id", "layout", F.posexplode("items").alias("pos", "i")
    ).select("doc_id", "layout", F.col("pos").cast("long").alias("pos"), "i.*")


def item_rejects(docs: DataFrame, layouts: Sequence[Layout] = DEFAULT_LAYOUTS) -> DataFrame:
    """Items that a layout found and refused: (doc_id, layout, code, name, qty, reason).

    A side output of the extraction, by the same patterns: what a layout accepts
    and what is given here are together all it found, but for repeated codes.
    """
    known = [layout for layout in layouts if layout.rejects]
    found = F.lit(None)
    for layout in reversed(known):
        found = F.when(F.col("layout") == layout.name, layout.rejects(F.col("text"))).otherwise(found)
    marked = classify_layout(docs, layouts).where(F.col("layout").isin([x.name for x in known]))
    return marked.select("doc_id", "layout", F.inline(found))
