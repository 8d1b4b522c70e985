"""Benchmark decontamination by template windows, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm import exchange

TOKEN = r"[\p{L}\p{N}]+"
#: Units that become a placeholder after a number; fixed values.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "mi", "miles", "meters", "metres", "mg", "g", "kg", "lb", "lbs", "oz", "ml", "l", "liters", "litres",
    "ms", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "mph", "kmh", "hz", "khz", "mhz", "ghz",
    "w", "kw", "mw", "v", "kb", "mb", "gb", "tb", "percent", "dollars", "euros", "pounds", "usd", "eur", "gbp",
)
NUMBER, NAME, UNIT = "0", "N", "U"


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def template(text: Column) -> Column:
    """The tokens with typed placeholders, one for each of tokens(): digits become 0 (a word of
    digits alone is then the placeholder), a capitalised word N, and a unit after a number U."""
    numbers = F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", NUMBER)
    names = F.regexp_replace(numbers, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})[\p{L}\p{N}]*", NAME)
    units = F.regexp_replace(names, r"(?<=(?<![\p{L}\p{N}])0[ \x{a0}]{1,2})(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", UNIT)
    return F.regexp_extract_all(units, F.lit(TOKEN), F.lit(0))


def with_window_hashes(df: DataFrame, template_tokens: str, sizes: list[int]) -> DataFrame:
    """A row (at, hash) for each place and size, with the hash of so many tokens from there on."""
    df = df.withColumn("_n", F.size(template_tokens)).withColumn("_size", F.explode(F.array(*map(F.lit, sizes))))
    # Outer, as Spark else tests the size of the sequence, and so tokenises, before it explodes.
    df = df.filter("_n >= _size").withColumn("at", F.explode_outer(F.sequence(F.lit(0), F.col("_n") - F.col("_size"))))
    return df.withColumn("hash", F.xxhash64(F.slice(template_tokens, F.col("at") + 1, F.col("_size")))).drop("_n", "_size", template_tokens)


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(text_col, F.lit(1), id_col).alias("_k2")]


def _is_slot(t: Column) -> Column:
    return t.isin(NUMBER, NAME, UNIT)


def benchmark_windows(items: DataFrame, doublings: int = 3, literals: int = 5, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, start, whole, n, template, raw, items): the distinct windows that hold at least
    `literals` words that are not placeholders, with the ids of their items; of an item without
    such a window its whole template, of n tokens. whole is the hash of all n tokens and hash that
    of the first `start` of them, the largest power of two, so documents are hashed at few sizes."""
    size = 2**doublings
    rows = items.select(F.col(id_col).alias("item"), template(F.col(text_col)).alias("t"), tokens(F.col(text_col)).alias("r")).filter("size(t) > 0")
    part = lambda i: F.struct(F.slice("t", i + 1, size).alias("template"), F.slice("r", i + 1, size).alias("raw"))
    rows = rows.withColumn("w", F.when(F.size("t") >= size, F.transform(F.sequence(F.lit(0), F.size("t") - size), part)).otherwise(F.array().cast("array<struct<template:array<string>,raw:array<string>>>")))
    rows = rows.withColumn("w", F.filter("w", lambda w: F.size(F.filter(w["template"], lambda t: ~_is_slot(t))) >= literals))
    rows = rows.withColumn("w", F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.struct(F.col("t").alias("template"), F.col("r").alias("raw")))))
    rows = rows.select("item", F.explode("w").alias("w")).select("item", "w.*").withColumn("n", F.size("template"))
    rows = rows.withColumn("start", F.expr("shiftleft(1, length(bin(n)) - 1)"))
    rows = rows.select("item", F.xxhash64(F.slice("template", F.lit(1), F.col("start"))).alias("hash"), "start", F.xxhash64("template").alias("whole"), "n", "template", "raw")
    return rows.groupBy("hash", "start", "whole", "n", "template", "raw").agg(F.array_sort(F.collect_set("item")).alias("items"))


def consistent(template_tokens: Column, raw: Column, found: Column) -> Column:
    """Whether words agree where the template has words, and slots one to one where it has slots.
    A template of slots only says nothing of its own, so its words have to agree too."""
    all_three = F.arrays_zip(template_tokens.alias("t"), raw.alias("r"), found.alias("f"))
    words = F.forall(all_three, lambda x: _is_slot(x["t"]) | (x["r"] == x["f"]))
    slots = F.filter(all_three, lambda x: _is_slot(x["t"]))
    pairs = F.size(F.array_distinct(slots))
    ours = F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["t"], x["r"]))))
    theirs = F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["t"], x["f"]))))
    some = F.exists(template_tokens, lambda t: ~_is_slot(t))
    return words & (pairs == ours) & (pairs == theirs) & (some | (raw == found))


def leaks(docs: DataFrame, items: DataFrame, doublings: int = 3, literals: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k1, _k2, n_windows, items): the rows of docs, known by two hashes, that hold a window of
    2 ** doublings tokens of an item, or the whole of an item without one, with the same words and
    slots that correspond one to one."""
    known = exchange.written(benchmark_windows(items, doublings, literals))
    sizes = sorted(r.start for r in known.select("start").distinct().collect()) or [2**doublings]
    parsed = docs.select(*_key(id_col, text_col), template(F.col(text_col)).alias("_t"))
    rows = with_window_hashes(parsed, "_t", sizes)
    # As many rows as places come in, few go on: those with the start of a window, and its lengths.
    lengths = known.groupBy("hash").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    hits = exchange.written(rows.join(exchange.small(lengths), "hash").select("_k1", "_k2", "at", F.explode("lengths").alias("n")).distinct())
    # Texts of the rows with hits, each once; then the hits, which are narrow, of each.
    rows = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")).join(exchange.small(hits.select("_k1", "_k2").distinct()), ["_k1", "_k2"], "left_semi")
    parsed = exchange.written(rows.select("_k1", "_k2", tokens(F.col("text")).alias("_r"), template(F.col("text")).alias("_t")).dropDuplicates(["_k1", "_k2"]))
    found = parsed.join(hits, ["_k1", "_k2"]).select("_k1", "_k2", "_r", "_t", F.struct("at", "n").alias("h")).filter("h.at + h.n <= size(_t)")
    found = found.select("_k1", "_k2", "h.at", "h.n", *(F.slice(c, F.col("h.at") + 1, F.col("h.n")).alias(name) for c, name in (("_r", "found"), ("_t", "as"))))
    found = found.withColumn("whole", F.xxhash64("as"))
    same = found.join(exchange.small(known, 200_000), ["whole", "n"]).filter((F.col("as") == F.col("template")) & consistent(F.col("template"), F.col("raw"), F.col("found")))
    return same.groupBy("_k1", "_k2").agg(F.count_distinct("at", "n").alias("n_windows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _keyed(docs: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, _k1, _k2): docs as a struct, so that no name of theirs meets one of these."""
    return docs.select(F.struct(*columns).alias("row"), *_key(id_col, text_col))


def contaminated(docs: DataFrame, items: DataFrame, doublings: int = 3, literals: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs of the rows that leaks() finds, with n_windows and items.

    Null or empty text, or an item without tokens: never found. An item with fewer tokens than a
    window, or too few words beside its placeholders, has no window and is found by the whole of
    its template. Equal rows are found together; rows with equal ids and different texts are
    different rows. Columns of docs named n_windows and items are replaced. No docs or no items:
    none. Windows of the benchmark and rows that are found are broadcast only if they are counted
    to be few.
    """
    own = [c for c in docs.columns if c not in ("n_windows", "items")]
    found = exchange.small(exchange.written(leaks(docs, items, doublings, literals, id_col, text_col)))
    return _keyed(docs, own, id_col, text_col).join(found, ["_k1", "_k2"]).select(*(F.col("row")[c].alias(c) for c in own), "n_windows", "items")


def decontaminate(docs: DataFrame, items: DataFrame, doublings: int = 3, literals: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that contaminated() returns; the columns stay as they are."""
    found = exchange.small(exchange.written(leaks(docs, items, doublings, literals, id_col, text_col).select("_k1", "_k2")))
    kept = _keyed(docs, docs.columns, id_col, text_col).join(found, ["_k1", "_k2"], "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
