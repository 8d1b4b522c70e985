"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm import blocks, components, exchange

#: Hash values of a signature that a band has, and that one step of the verification compares.
BAND = 5
STEP = 20
#: Nodes with an element of differences, beside those of one component, that are compared in pairs;
#: where there are more, they get a pivot of their own.
GROUP = 200
#: How often they do, before one after the other is compared with all the rest.
LEVELS = 2
#: Shingles that all hash functions take at once; their values have the same room each time, which stays in the cache.
PART = 1024
_ROOM: dict[int, np.ndarray] = {}
_NONE = np.zeros(0, np.uint64)


def n_bands(threshold: float, miss: float) -> int:
    """Bands with which a pair at the threshold shares none with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**BAND))


def shingle_sets(column: pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles (A-Z lower-cased); with fewer words, of all."""
    data, offsets = blocks.text_bytes(column)
    for a, b in blocks.slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        found = blocks.Words(part, at, lower=True)
        starts, hashes = found.windows(words)
        cuts = np.searchsorted(found.doc[starts], np.arange(b - a + 1)).tolist()
        for i in range(b - a):
            if cuts[i] < cuts[i + 1]:
                yield _distinct(hashes[cuts[i] : cuts[i + 1]])
            elif found.per_doc[i]:
                lo, hi = found.first[i], found.first[i + 1]
                sums = blocks.prefix(found.hash[lo:hi], blocks._SEQ)
                yield blocks.spans(sums, np.zeros(1, np.int64), np.array([hi - lo]), blocks._SEQ)
            else:
                yield _NONE


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct ones of some hashes; by sorting, as np.unique() is slower on few."""
    ordered = np.sort(hashes)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.random.default_rng(7).integers(0, 2**64, (2, n), dtype=np.uint64)
    return both[0] | np.uint64(1), both[1]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least of each of n hash functions over the shingles, 32 bits each."""
    a, b = (x[:, None] for x in _multipliers(n))
    room = _ROOM[n] = _ROOM[n] if n in _ROOM else np.empty(n * PART, np.uint64)
    out = np.full(n, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), PART):
        part = shingles[i : i + PART]
        products = room[: n * len(part)].reshape(n, -1)
        np.multiply(part, a, out=products)
        np.add(products, b, out=products)
        np.minimum(out, products.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _print(shingles: np.ndarray) -> bytes | None:
    """Equal for equal sets: the sum and the exclusive or of the hashes."""
    return np.array([shingles.sum(), np.bitwise_xor.reduce(blocks.mix(shingles))]).tobytes() if len(shingles) else None


def _sketches(batches: Iterator[pa.RecordBatch], words: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for s in shingle_sets(batch["text"], words):
            sizes.append(len(s))
            prints.append(_print(s))
            signatures.append(signature(s, n).tobytes() if len(s) else None)
        yield pa.record_batch([batch["id"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n_shingles", "print", "signature"])


def least_matches(threshold: float, miss: float, n: int) -> list[int]:
    """After STEP, 2 * STEP, ... n compared values: the fewest matches with which the posterior
    probability (uniform prior) of a similarity of at least the threshold is not below `miss`."""
    out = []
    for seen in [*range(STEP, n, STEP), n]:
        below, m = 0.0, -1
        while True:  # P(J >= t | m of seen match) = P(Binomial(seen + 1, t) <= m)
            m += 1
            below += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
            if below >= miss or m == seen:
                break
        out.append(m)
    return out


def _probable(batches: Iterator[pa.RecordBatch], bounds: list[int]) -> Iterator[pa.RecordBatch]:
    """The pairs of signatures, and whether no step of the verification prunes them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        live, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for i, bound in enumerate(bounds):
            part = slice(i * STEP, (i + 1) * STEP)
            matches[live] += (left[live, part] == right[live, part]).sum(axis=1)
            live = live[matches[live] >= bound]
        probable = np.zeros(batch.num_rows, bool)
        probable[live] = True
        yield pa.record_batch([batch["a"], batch["b"], pa.array(probable)], ["a", "b", "probable"])


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each pair (a, b) with its exact verdict and in which elements the set of b differs from that of a."""
    for batch in batches:
        linked, sizes, n_pivot, n_diff, diff = [], [], [], [], []
        for x, y, probable in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), batch["probable"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            added, gone = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
            both = len(y) - len(added)
            linked.append(probable and 100 * both >= percent * (len(x) + len(added)))
            sizes.append(len(y))
            n_pivot.append(len(x))
            n_diff.append(len(added) + len(gone))
            diff.append(np.concatenate([added, gone]).view(np.int64))
        columns = [batch["a"], batch["b"], pa.array(linked, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(n_pivot, pa.int32()), pa.array(n_diff, pa.int32()), pa.array(diff, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["a", "b", "linked", "n", "n_pivot", "n_diff", "diff"])


_COMPARED = "a binary, b binary, linked boolean, n int, n_pivot int, n_diff int, diff array<bigint>"


def _differences(star: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b, component, n, n_diff, at, e, others), written: the nodes b of the stars a that hold
    several components, a row for each early element e of their differences from a, with its place
    `at` and how many such rows of (a, e) are not of its most frequent component. Elements stand
    in the order of how many nodes of the star differ in them; only those that two components
    have are returned, and of each node only the places at which a common element can be the first
    (see _may_be_linked)."""
    named = star.join(label.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    named = named.join(label.select(F.col("node").alias("a"), F.col("component").alias("of_pivot")), "a", "left").withColumn("with_pivot", F.col("component") == F.coalesce("of_pivot", "a"))
    both = [F.min("component").alias("x"), F.max("component").alias("y")]
    open_stars = named.groupBy("a").agg(*both).filter("x <> y").select("a")
    rows = exchange.written(named.join(open_stars, "a", "left_semi").select("a", "b", "component", "with_pivot", "n_pivot", "n", "n_diff", F.explode_outer("diff").alias("e")).filter("e is not null"))
    shared = rows.join(rows.groupBy("a", "e").agg(F.count("*").alias("often"), *both).filter("x <> y").select("a", "e", "often"), ["a", "e"])
    own = Window.partitionBy("a", "b")
    place = F.row_number().over(own.orderBy("often", "e")) - 1 + F.col("n_diff") - F.count("*").over(own)
    # Of a pair in two components one at least is not linked with the pivot, so its difference is large.
    near = 2 * (100 + percent) * F.col("at") <= (100 + percent) * F.col("n_diff") + (100 - percent) * (F.col("n") - F.col("n_pivot"))
    last = F.when(F.col("with_pivot"), near).otherwise(percent * F.col("at") <= (100 - percent) * F.col("n"))
    early = exchange.written(shared.withColumn("at", place).filter(last).select("a", "b", "component", "n", "n_diff", "at", "e"))
    exchange.drop(rows)
    by_component = early.groupBy("a", "e", "component").agg(F.count("*").alias("k"))
    sizes = by_component.groupBy("a", "e").agg((F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
    out = exchange.written(early.join(sizes, ["a", "e"]))
    exchange.drop(early)
    return out


def _may_be_linked(x: str, y: str, percent: int) -> Column:
    """Whether two nodes of a star with early elements in common can be linked, by their differences from its pivot.

    Let D be the difference of a node's set from the pivot's. Two nodes x and y are linked only if
    D(x) and D(y) differ in at most (1 - t) / (1 + t) * (|x| + |y|) elements, so at least c of them
    are common. If not both are linked with the pivot, c > 0, and in any fixed order of elements
    the least common one is among the first |D| - c + 1 of both. So joining on those elements
    finds every such pair.
    """
    v = lambda side, c: F.col(f"{side}.{c}")
    common = F.ceil((v(x, "n_diff") + v(y, "n_diff") - (100 - percent) / (100 + percent) * (v(x, "n") + v(y, "n"))) / 2 - 1e-6)
    early = (v(x, "at") <= v(x, "n_diff") - common) & (v(y, "at") <= v(y, "n_diff") - common)
    return early & (100 * F.least(v(x, "n"), v(y, "n")) >= percent * F.greatest(v(x, "n"), v(y, "n"))) & (v(x, "component") != v(y, "component"))


def _pairs_of_small(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the groups (star, element) of few rows."""
    some = rows.filter(F.col("others") <= GROUP)
    met = some.alias("x").join(some.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.b") < F.col("y.b")) & _may_be_linked("x", "y", percent))
    return met.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()


def _pairs_with_pivot(rows: DataFrame, score: DataFrame, percent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of the groups of many rows: pairs (a, b) of the group's node of most company with each other
    node (given percent: with those it may be linked with), and the groups without that node."""
    rest = rows.filter(F.col("others") > GROUP).drop("others").join(score.withColumnRenamed("print", "b"), "b", "left")
    top = rest.groupBy("a", "e").agg(F.max(F.struct("score", "b", "component", "n", "n_diff", "at")).alias("top")).select("a", "e", "top.*").drop("score")
    met = rest.alias("y").join(top.alias("x"), (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.b") != F.col("y.b")))
    pairs = (met if percent is None else met.filter(_may_be_linked("x", "y", percent))).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()
    return pairs, met.select("y.a", "y.b", "y.component", "y.n", "y.n_diff", "y.at", "y.e")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Texts with equal sets are one node (partial aggregation, so copies never meet in one task).
    Nodes meet in bands of their MinHash signatures; the number of bands is such that a pair at
    the threshold is missed with probability `miss` at most. Every node of a band is compared
    with the band's pivot, the node that meets most others over all bands and so is the one in
    the middle of a group of copies; that is linear. Nodes that are still in different components
    are compared if their differences from the pivot have an early element in common, which any
    linked pair has (see _may_be_linked); where many nodes have an element, they get a pivot of
    their own and are looked at again, so the pairs within a band are never made. Pairs are
    compared STEP hash values at a time and dropped when the posterior probability of the
    similarity falls below `miss`; the rest is confirmed on the whole sets (64-bit hashes).

    Returns doc_id, n_shingles, component_id (least id of the component), kept (doc_id is it),
    one row for each row of docs. Null or empty text, or no word: no shingles, no link. Null id:
    larger than every id; a component of such rows alone has a null id and keeps them. Rows with
    equal ids and different texts are two documents. Other columns are ignored.
    """
    t = percent / 100
    bands = n_bands(t, miss)
    n = bands * BAND
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(exchange.NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = exchange.written(
        texts.mapInArrow(lambda it: _sketches(it, words, n), "id long, n_shingles long, print binary, signature binary")
    )
    nodes = exchange.written(sketches.filter("print is not null").dropDuplicates(["print"]))
    owner = sketches.filter("print is not null").groupBy("print").agg(F.min("id").alias("least"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * (4 * BAND) + 1, F.lit(4 * BAND))))
    rows = nodes.select(F.explode(pieces).alias("band"), "print")
    full = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = exchange.written(rows.join(full, "band"))
    score = exchange.written(met.groupBy("print").agg(F.sum("n").alias("score")))
    pivots = met.join(score, "print").groupBy("band").agg(F.max(F.struct("score", "print")).alias("p")).select("band", F.col("p.print").alias("pivot"))
    first_pairs = exchange.written(met.join(pivots, "band").filter("print != pivot").select(F.col("pivot").alias("a"), F.col("print").alias("b")).distinct())

    # The shingle sets of the nodes that meet others. Rows with equal ids differ in their texts:
    # the set that belongs to a node has its print.
    wanted = exchange.written(score.select("print").join(nodes.select("print", "id"), "print"))
    found = texts.join(exchange.small(wanted.select("id").distinct()), "id", "left_semi")
    sets = found.mapInArrow(lambda it: _with_print(it, words), "print binary, shingles binary")
    sets = exchange.written(sets.join(exchange.small(wanted.select("print")), "print", "left_semi").dropDuplicates(["print"]))
    bounds = least_matches(t, miss, n)

    def compared(pairs: DataFrame, only_probable: bool) -> DataFrame:
        """Pairs after the verification on signatures, confirmed on the sets."""
        for x in "ab":
            pairs = pairs.join(nodes.select(F.col("print").alias(x), F.col("signature").alias(f"sig_{x}")), x)
        pairs = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(lambda it: _probable(it, bounds), "a binary, b binary, probable boolean")
        pairs = live = exchange.written(pairs.filter("probable") if only_probable else pairs)
        for x in "ba":
            pairs = pairs.join(sets.select(F.col("print").alias(x), F.col("shingles").alias(f"set_{x}")), x)
        out = exchange.written(pairs.select("a", "b", "probable", "set_a", "set_b").mapInArrow(lambda it: _compared(it, percent), _COMPARED))
        exchange.drop(live)
        return out

    def labelled(more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links so far and their components."""
        now = exchange.written(more.filter("linked").select("a", "b") if links is None else links.unionByName(more.filter("linked").select("a", "b")))
        return now, exchange.written(components.connected_components(now))

    links = None
    star = compared(first_pairs, False)
    links, label = labelled(star)
    for level in range(LEVELS + 1):
        rows = _differences(star, label, percent)
        exchange.drop(star)
        more = compared(_pairs_of_small(rows, percent), True)
        links, label = labelled(more)
        rows, rest = exchange.written(rows.filter(F.col("others") > GROUP)), rows
        exchange.drop(rest, more)
        if rows.isEmpty():
            break
        if level < LEVELS:
            star = compared(_pairs_with_pivot(rows, score)[0], False)
            links, label = labelled(star)
    while not rows.isEmpty():
        pairs, rest = _pairs_with_pivot(rows, score, percent)
        more, before = compared(pairs, True), rows
        links, label = labelled(more)
        rows = exchange.written(rest.withColumn("others", F.lit(GROUP + 1)))
        exchange.drop(more, before)
    exchange.drop(nodes, met, score, first_pairs, wanted, sets)
    least = label.withColumnRenamed("node", "print").join(owner, "print")
    whole = least.groupBy("component").agg(F.min("least").alias("component_id"))
    known = owner.join(label.withColumnRenamed("node", "print"), "print", "left").join(whole, "component", "left")
    known = known.select("print", F.coalesce("component_id", "least").alias("component_id"))
    out = sketches.select("id", "n_shingles", "print").join(known, "print", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    real = lambda c: F.when(F.col(c) != exchange.NO_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def _with_print(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch["text"], words))
        prints = [_print(s) for s in sets]
        yield pa.record_batch([pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["print", "shingles"])
