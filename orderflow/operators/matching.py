"""Joins on substrings and prefixes by equal keys: no nested loop, whatever the tables' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the grams by which keys are looked up first.
GRAM = 3
#: Longer keys are compared by digest, so that no row is longer.
LONG = 64
#: So many first grams of keys are broadcast at most.
FIRSTS = 50_000


def _grams(text: Column, size: int) -> Column:
    """All grams of a text of one size with their places, at least one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.transform(places, lambda i: F.struct(i.alias("_at"), F.substring(text, i, size).alias("_gram")))


def _named(keys: DataFrame, key: str) -> DataFrame:
    """Keys or pieces with the two columns by which they are equal."""
    name = F.when(F.length(key) > LONG, F.sha2(F.col(key).cast("binary"), 256)).otherwise(F.col(key))
    return keys.withColumns({"_size": F.length(key), "_name": name})


def _meeting(texts: DataFrame, keys: DataFrame, gram: int) -> DataFrame:
    """The pieces of texts (_id, _text) that meet a key of ``keys`` (_key, unique) by equality, with that row of keys.

    A key can only start where its first gram does and only has its own length. So
    grams meet the distinct first grams, which bring the lengths of their keys,
    and the pieces of these lengths meet the keys as wholes: however many keys
    share a gram, a place of a text makes as many rows as there are lengths.
    Both joins have a unique other side, so a frequent gram is split. A piece that
    a text holds twice is there twice.
    """
    first = F.substring("_key", 1, gram)
    firsts = keys.groupBy(first.alias("_gram")).agg(F.collect_set(F.length("_key")).alias("_sizes"))
    # A count and at most ``gram`` numbers.
    known = keys.agg(F.count_distinct(first).alias("n"), F.sort_array(F.collect_set(F.length(first))).alias("sizes")).first()
    held = texts.select("_id", F.inline(F.flatten(F.array(*[_grams(F.col("_text"), n) for n in known["sizes"] or [gram]]))))
    # Spark takes the grams to be as small as the texts they come from, and would broadcast these.
    firsts = F.broadcast(firsts) if known["n"] <= FIRSTS else firsts.hint("merge")
    places = held.join(firsts, "_gram").select("_id", "_at", F.explode("_sizes").alias("_long"))
    fits = F.col("_at") + F.col("_long") - 1 <= F.length("_text")
    pieces = places.join(texts, "_id").where(fits).select("_id", F.substring("_text", F.col("_at"), F.col("_long")).alias("_piece"))
    return _named(pieces, "_piece").drop("_piece").join(_named(keys, "_key"), ["_size", "_name"])


def _texts(texts: DataFrame, id: str, text: str) -> DataFrame:
    return texts.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") > 0)


def containing(texts: DataFrame, keys: DataFrame, id: str = "doc_id", text: str = "text", key: str = "key", gram: int = GRAM) -> DataFrame:
    """(id, key) of every key that occurs in a text, each pair once.

    Texts meet keys by equality of whole keys, see ``_meeting``. Null and empty
    texts hold nothing; null and empty keys occur nowhere. Ids must be unique.
    """
    names = keys.select(F.col(key).alias("_key")).where(F.length("_key") > 0).distinct()
    met = _meeting(_texts(texts, id, text), names, gram)
    return met.select(F.col("_id").alias(id), F.col("_key").alias(key)).distinct()


def first_contained(
    texts: DataFrame, dictionary: DataFrame, id: str = "doc_id", text: str = "text",
    key: str = "key", value: str = "value", rank: str = "rank",
) -> DataFrame:
    """Every text's id with the value of the first key (by rank) that it holds, NULL if none.

    Entries without a value, as placeholders are, are passed over.
    """
    entries = dictionary.where(F.col(value).isNotNull() & (F.col(value) != "") & (F.length(key) > 0))
    entries = entries.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(rank).alias("rank"), F.col(value).alias("value"))).alias("_entry"))
    best = _meeting(_texts(texts, id, text), entries, GRAM).groupBy(F.col("_id").alias(id)).agg(F.min("_entry").alias("_entry"))
    return texts.select(id).join(best.select(id, F.col("_entry.value").alias(value)), id, "left")


def longest_prefix(rows: DataFrame, mapping: DataFrame, code: str = "code", prefix: str = "prefix", value: str = "value") -> DataFrame:
    """Rows with the value of the longest prefix of their code in the mapping, NULL if none.

    Each distinct code is looked up once, by all its prefixes; codes are short, so
    these are few. Of equal prefixes the least value counts.
    """
    known = mapping.where(F.length(prefix) > 0).groupBy(F.col(prefix).alias("_prefix")).agg(F.min(value).alias(value))
    codes = rows.select(F.col(code).alias("_code")).where(F.length(code) > 0).distinct()
    tries = codes.select(
        "_code",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("_code")), lambda n: F.substring("_code", F.lit(1), n))).alias("_prefix"),
    )
    best = tries.join(known, "_prefix").groupBy("_code").agg(F.max_by(value, F.length("_prefix")).alias(value))
    return rows.join(best, rows[code] == F.col("_code"), "left").drop("_code")


def first_by_rules(docs: DataFrame, rules: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule_set, layout): the first rule of each set, by priority, that holds for a text.

    ``rules`` has a row for each word: rule_set, layout, priority, kind and word.
    A rule holds if the upper-cased text has all its ``all`` words and, if it has
    ``any`` words, one of these. A rule whose word is NULL always holds; a set
    without such a rule leaves the texts to which none applies out.

    Rule tables are small and texts may be long, so the words become one list in
    the plan and each text is searched where it is; only the words found are rows,
    and these meet the rules by equality.
    """
    words = rules.where(F.col("word").isNotNull())
    names = F.array(*[F.lit(r["word"]) for r in words.select("word").distinct().collect()]).cast("array<string>")
    upper = docs.select(id, F.upper(text).alias("_upper"))
    pairs = upper.select(id, F.explode(F.filter(names, lambda w: F.contains("_upper", w))).alias("word"))
    rule = ["rule_set", "priority", "layout"]
    needs = words.groupBy(*rule).agg(F.count_if(F.col("kind") == "all").alias("_all"), F.count_if(F.col("kind") == "any").alias("_any"))
    held = (
        pairs.join(words, "word")
        .groupBy(id, *rule)
        .agg(F.count_if(F.col("kind") == "all").alias("_has_all"), F.count_if(F.col("kind") == "any").alias("_has_any"))
        .join(needs, rule)
        .where((F.col("_has_all") == F.col("_all")) & ((F.col("_any") == 0) | (F.col("_has_any") > 0)))
    )
    found = held.groupBy(id, "rule_set").agg(F.min(F.struct("priority", "layout")).alias("_found"))
    # One row of an array for all sets: their number does not grow with the texts.
    sets = rules.groupBy("rule_set").agg(F.min(F.when(F.col("word").isNull(), F.struct("priority", "layout"))).alias("_always"))
    always = [(r["rule_set"], r["_always"]) for r in sets.collect()]
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("rule_set"),
            F.lit(None if rest is None else rest["priority"]).cast("int").alias("p"),
            F.lit(None if rest is None else rest["layout"]).cast("string").alias("l"),
        )
        for name, rest in sorted(always, key=lambda x: x[0])
    ])
    every = docs.select(id, F.inline(entries))
    chosen = F.least(F.col("_found"), F.when(F.col("p").isNotNull(), F.struct(F.col("p").alias("priority"), F.col("l").alias("layout"))))
    return every.join(found, [id, "rule_set"], "left").select(id, "rule_set", chosen["layout"].alias("layout")).where(F.col("layout").isNotNull())
