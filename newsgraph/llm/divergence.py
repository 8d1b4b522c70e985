"""How far the sources of a language diverge in their words: hash-consed segment trees over term ids."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm import exchange

SCALE = 1_000_000_000
#: Terms of a block on average (the range of ids under one set of trees), and groups of a tile.
TERMS, TILE = 4096, 128
#: Distinct counts that a task holds, and node pairs that are priced at once.
HELD, PRICED = 400_000, 1 << 20
_FOLD = bytes(32 if x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x + 32 if x < 0x5B else x for x in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), d (documents) as far as a task has counted them."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    names = ["lang", "source", "term", "n", "d"]

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            for at in range(0, len(n), 50_000):
                terms = list(n)[at : at + 50_000]
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms), pa.array([n[t] for t in terms]), pa.array([d[t] for t in terms])]
                yield pa.record_batch(columns, names)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = text.translate(_FOLD).split()
            n, d = held[lang, source]
            n.update(terms)
            d.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from given()
    yield from given()


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, source, term, n, total, first): occurrences in the group and in the language of the terms
    that at least `least` documents of the language have; first marks one row of each term."""
    binary = docs.select(F.col("lang").cast("binary").alias("lang"), F.col("source").cast("binary").alias("source"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    counted = binary.mapInArrow(_counted, "lang binary, source binary, term binary, n long, d long")
    counted = counted.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "d")
    # One exchange for the sums of the groups, the sums of the languages and the choice.
    cells = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    marked = cells.withColumns({"total": F.sum("n").over(term), "d": F.sum("d").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("long")})
    return marked.filter(F.col("d") >= least).drop("d")


def share(n: Column | str, size: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + 2) / (size + 2 * terms)), exactly."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    return F.call_function("div", (whole(n) + 2) * SCALE, whole(size) + whole(terms) * 2) + 1


def penalty(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Trees:
    """Segment trees over the terms of a block, a tree for each group, with equal subtrees consed.

    counts has a row for each group; -1 stands where there is no term. A node of a level is known by its
    two children, so subtrees of equal counts are one node, wherever and in whichever tree they
    are: all that a group never uses is one node a level.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        padded = np.full((counts.shape[0], width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        #: The distinct counts: leaves are known by their place here.
        self.leaves, ids = np.unique(padded, return_inverse=True)
        ids, n = ids.reshape(padded.shape), len(self.leaves)
        #: From the leaves up: left and right child of every node.
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            pairs, above = np.unique(ids[:, ::2] * n + ids[:, 1::2], return_inverse=True)
            self.children.append((pairs // n, pairs % n))
            ids, n = above.reshape(ids.shape[0], -1), len(pairs)
        self.roots = ids[:, 0]

    def prices(self, i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each pair of trees (i, j) the sum of the penalties over all terms. sizes: the divisor of each group.

        Both trees of a pair are walked at once, level by level; node pairs that a walk meets
        several times are one with a number, so each is opened, and in the end priced, once.
        """
        pair, a, b, times = np.arange(len(i)), self.roots[i], self.roots[j], np.ones(len(i), np.int64)
        for left, right in reversed(self.children):
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            n = int(max(a.max(), b.max())) + 1
            key, at = np.unique((pair * n + a) * n + b, return_inverse=True)
            met = np.zeros(len(key), np.int64)
            np.add.at(met, at, times)
            pair, a, b, times = key // (n * n), key // n % n, key % n, met
        real = self.leaves[a] >= 0  # both are where there is no term
        pair, a, b, times = pair[real], a[real], b[real], times[real]
        p, q = (_shares(self.leaves[x], sizes[k[pair]]) for x, k in ((a, i), (b, j)))
        out = np.zeros(len(i), np.int64)
        np.add.at(out, pair, (p - q) * (p - q) // (p + q) * times)
        return out


def _shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    if len(n) and n.max() >= 2**63 // SCALE - 2:  # beyond 64 bits
        return np.array([1 + SCALE * (int(x) + 2) // int(y) for x, y in zip(n, size, strict=True)], np.int64)
    return 1 + SCALE * (n + 2) // size


def _divergences(cells: pa.Table, groups: pa.Table, tile: int) -> pa.Table:
    """(lang, i, j, value) of the pairs of groups i < j of a tile over the terms of a block."""
    names = ["lang", "i", "j", "value"]
    if not groups.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())], names)
    gid = groups["gid"].to_numpy()
    order = np.argsort(gid)
    gid, sizes = gid[order], groups["size"].to_numpy()[order]
    # Terms in order of how often they occur: what is rare is 0 or 1 in long stretches. Terms of the
    # block that only other tiles have are 0 at the end.
    counts = np.zeros((len(gid), groups["block_terms"][0].as_py()), np.int64)
    if cells.num_rows:
        terms = pa.array(cells["term"].to_pylist()).dictionary_encode()
        code = terms.indices.to_numpy()
        total = np.zeros(len(terms.dictionary), np.int64)
        total[code] = cells["total"].to_numpy()
        place = np.empty(len(total), np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(total))
        counts[np.searchsorted(gid, cells["gid"].to_numpy()), place[code]] = cells["n"].to_numpy()
    trees = Trees(counts)
    one, other = groups["lo"][0].as_py(), groups["hi"][0].as_py()
    left, right = (np.flatnonzero(gid // tile == x) for x in (one, other))
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    i, j = i[i < j], j[i < j]
    some = max(1, PRICED // counts.shape[1])
    values = [trees.prices(i[k : k + some], j[k : k + some], sizes) for k in range(0, len(i), some)]
    lang = groups["lang"][0].as_py()
    return pa.table([pa.array([lang] * len(i), pa.string()), pa.array(gid[i]), pa.array(gid[j]), pa.array(np.concatenate([np.zeros(0, np.int64), *values]))], names)


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, block: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the (lang, source) groups apart.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; those in `least`
    documents of a language are kept. Part pair: the divergence from every other source of the
    language, over all kept terms. Part term: the `top` terms that a group has more of than its
    language. Counts are summed before they are moved. The kept terms of a language are dealt to
    blocks of about `block`, in each of which every group has a segment tree (see Trees); pairs of a
    block come in tiles of `tile` groups a side, and their sums are added up. So no task holds more
    than the terms of a block for 2 * tile groups; the result has a row for each pair of sources,
    as it must.

    Null lang, source and text count as ''. Repeated rows are documents of their own. A group
    without terms counts 0 of each; a language without kept terms has pairs of value 0. An empty
    table gives none. Ids and other columns are ignored.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    cells = exchange.written(kept_terms(docs, least))
    langs = exchange.written(cells.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_size")))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    groups = exchange.written(groups.withColumn("gid", place.cast("long")).withColumn("tile", F.floor(F.col("gid") / tile)))
    known = cells.join(exchange.small(groups.drop("tile")), ["lang", "source"])

    p, q = share("n", "size", "terms"), share("total", "lang_size", "terms")
    terms = known.withColumns({"p": p, "q": q}).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), penalty(F.col("p"), F.col("q")).alias("value"))

    blocks = F.ceil(F.col("terms") / block)
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    opposite = lambda df: df.join(exchange.small(tiles), "lang").withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns({"lo": F.least("_t", "tile"), "hi": F.greatest("_t", "tile")})
    known = known.withColumns({"block": F.pmod(F.xxhash64("term"), blocks), "tile": F.floor(F.col("gid") / tile)})
    filled = known.groupBy("lang", "block").agg(F.sum("first").alias("block_terms"))
    asked = opposite(groups).join(filled, "lang")
    asked = asked.select(F.col("lang").alias("lang"), "lo", "hi", F.col("block").alias("block"), F.col("gid").alias("gid"), (F.col("size") + 2 * F.col("terms")).alias("size"), "block_terms")
    keys = ["lang", "lo", "hi", "block"]
    dealt = opposite(known)
    parts = dealt.select(*keys, "gid", "term", "n", "total").groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda x, y: _divergences(x, y, tile), "lang string, i long, j long, value long")
    priced = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = priced.unionByName(priced.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    x = groups.select("lang", "source", F.col("gid").alias("i"))
    y = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("j"))
    pairs = x.join(y, "lang").filter("i <> j").join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
