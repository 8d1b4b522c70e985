"""Ranked lexical search: exact inner products over sparse ball trees of documents."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from newsgraph.llm import exchange

#: Bytes of the items that are searched for in one pass, and words of those that share a tree.
PASS, WORDS = 16 << 20, 8192
#: Documents or their terms with which a tree is full, documents of a leaf, and groups of terms with a radius each.
DOCS, ENTRIES, LEAF, RADII = 8192, 2_000_000, 32, 16
_FOLD = bytes(32 if x <= 0x2F or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, only A-Z in lower case."""
    raw = text.encode() if isinstance(text, str) else text
    return (raw or b"").translate(_FOLD).split()


def _vectors(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """id, n (all terms of the text), terms (numbers of those known) and tf of each."""
    for batch in batches:
        sizes, terms, often = [], [], []
        for text in batch["text"]:
            words = terms_of(text.as_py())
            found = Counter(words)
            number = {known[w]: k for w, k in found.items() if w in known} if len(found) < len(known) else {v: found[w] for w, v in known.items() if w in found}
            sizes.append(len(words))
            terms.append(list(number))
            often.append(list(number.values()))
        yield pa.record_batch([batch["id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], ["id", "n", "terms", "tf"])


class BallTree:
    """Sparse vectors under balls: a node has the mean of its vectors and, for each of RADII groups of
    terms, the largest distance of a vector from the mean in the dimensions of the group.

    The parts of a node are those nearer to one of two vectors that are far apart. The groups follow
    the documents: a term belongs to the subtree of RADII that holds most of it, so terms of one
    language or subject share a radius that is small where they do not occur.
    """

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int):
        self.n_terms = n_terms
        weight = value.astype(np.float64)
        n = len(at) - 1
        order = np.arange(n)
        nodes, todo = [], [(0, n, -1)]
        while todo:  # lo, hi, parent; parents before their children
            lo, hi, parent = todo.pop()
            me = len(nodes)
            nodes.append([lo, hi, parent, -1, -1])
            if parent >= 0:
                nodes[parent][3 if nodes[parent][3] < 0 else 4] = me
            if hi - lo > LEAF:
                nearer, cut = self._parts(at, term, weight, order[lo:hi])
                order[lo:hi] = order[lo:hi][nearer]
                todo += [(lo, lo + cut, me), (lo + cut, hi, me)]
        self.nodes = np.array(nodes)
        self.order = order
        sizes = np.diff(at)[order]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.repeat(at[:-1][order] - self.at[:-1], sizes) + np.arange(self.at[-1])
        self.term, self.value, weight = term[pick], value[pick], weight[pick]
        self.doc = np.repeat(np.arange(n), sizes)
        self._means(weight)
        self._radii(weight)

    @staticmethod
    def _parts(at: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, int]:
        """Places of the docs in order of how much nearer they are to one far vector than to another,
        and how many are nearer to the first one (an eighth at least, seven at most)."""
        sizes = np.diff(at)[docs]
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pick = np.repeat(at[:-1][docs] - start, sizes) + np.arange(sizes.sum())
        t, w = term[pick], weight[pick]
        norm = np.add.reduceat(w * w, start)
        dense = np.zeros(int(t.max()) + 1)

        def to(k: int) -> np.ndarray:
            """Squared distances from the k-th of the docs."""
            dense[:] = 0
            dense[t[start[k] : start[k] + sizes[k]]] = w[start[k] : start[k] + sizes[k]]
            return norm + norm[k] - 2 * np.add.reduceat(w * dense[t], start)

        one = int(to(0).argmax())
        from_one = to(one)
        nearer = from_one - to(int(from_one.argmax()))
        n = len(docs)
        return np.argsort(nearer, kind="stable"), min(max(int((nearer < 0).sum()), -(-n // 8)), n - -(-n // 8))

    def _means(self, weight: np.ndarray) -> None:
        m = len(self.nodes)
        self.mean = np.zeros((m, self.n_terms))
        for k in range(m - 1, -1, -1):  # sums, from the leaves up
            lo, hi, _, left, right = self.nodes[k]
            if left < 0:
                a, b = self.at[lo], self.at[hi]
                np.add.at(self.mean[k], self.term[a:b], weight[a:b])
            else:
                self.mean[k] = self.mean[left] + self.mean[right]
        count = (self.nodes[:, 1] - self.nodes[:, 0])[:, None]
        top = [k for k in range(m) if self._depth(k) == RADII.bit_length() - 1] or [0]
        self.group = self.mean[top].argmax(axis=0)
        self.mean /= count

    def _depth(self, k: int) -> int:
        d = 0
        while self.nodes[k, 2] >= 0:
            k, d = self.nodes[k, 2], d + 1
        return d

    def _radii(self, weight: np.ndarray) -> None:
        n = len(self.order)
        group = self.group[self.term]
        norm = np.bincount(self.doc * RADII + group, weight * weight, n * RADII).reshape(n, RADII)
        self.radius = np.zeros((len(self.nodes), RADII))
        for k, (lo, hi, *_) in enumerate(self.nodes):
            a, b = self.at[lo], self.at[hi]
            c = self.mean[k]
            own = np.bincount(self.group, c * c, RADII)
            with_mean = np.bincount((self.doc[a:b] - lo) * RADII + group[a:b], weight[a:b] * c[self.term[a:b]], (hi - lo) * RADII).reshape(-1, RADII)
            square = norm[lo:hi] + own - 2 * with_mean
            # What the difference of large numbers may have lost is added.
            self.radius[k] = np.sqrt((np.maximum(square, 0) + 1e-11 * (norm[lo:hi] + own)).max(axis=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(node, query): no inner product below a node is larger; rounded up."""
        asked = np.stack([np.sqrt(np.bincount(self.group, q * q, RADII)) for q in queries.astype(np.float64)], axis=1)
        return (self.mean @ queries.T.astype(np.float64) + self.radius @ asked) * (1 + 1e-9) + 1

    def search(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Put the k best (score, -id) into the heap `best`; the best bound is opened first, and what
        cannot reach the k-th is left. Scores are whole numbers. Returns how many leaves were read."""
        heap, read = [(-bound[0], 0)], 0
        while heap:
            below, node = heapq.heappop(heap)
            if len(best) >= k and -below < best[0][0]:
                break
            lo, hi, _, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (max(below, -bound[child]), int(child)))
                continue
            read += 1
            a, b = self.at[lo], self.at[hi]
            scores = np.add.reduceat(query[self.term[a:b]] * self.value[a:b], self.at[lo:hi] - a)
            for i in np.flatnonzero(scores > 0).tolist():
                hit = int(scores[i]), -int(ids[lo + i])
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
        return read


@dataclass
class Asked:
    """Items that share trees: their places, the terms that any has (numbers, rising), repeats of each."""

    items: list[int]
    terms: np.ndarray
    queries: np.ndarray


def _asked(items: list[list[int]]) -> list[Asked]:
    """Items of WORDS terms together (or one), those with none left out."""
    out, now, size = [], [], 0
    for i, terms in enumerate([*items, []]):
        if now and (i == len(items) or size + len(terms) > WORDS):
            used = np.unique(np.concatenate([items[k] for k in now]))
            queries = np.zeros((len(now), len(used)), np.int64)
            for row, k in enumerate(now):
                np.add.at(queries[row], np.searchsorted(used, items[k]), 1)
            out.append(Asked(now, used, queries))
            now, size = [], 0
        if terms:
            now, size = [*now, i], size + len(terms)
    return out


def _found(batches: Iterator[pa.RecordBatch], asked: list[Asked], weights: np.ndarray, k: int, full: int) -> Iterator[pa.RecordBatch]:
    """item (its place), id, score: the k best of the task's rows for each item."""
    best: dict[int, list[tuple[int, int]]] = {i: [] for a in asked for i in a.items}

    def searched(ids: np.ndarray, m: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at))))
        for group in asked:
            place = np.searchsorted(group.terms, term)
            place[place == len(group.terms)] = 0
            mine = (group.terms[place] == term) & (value > 0)
            left = np.add.reduceat(mine, at[:-1], dtype=np.int64) * (np.diff(at) > 0)
            some = np.flatnonzero(left)
            if not len(some):
                continue
            tree = BallTree(np.concatenate([[0], np.cumsum(left[some])]), place[mine], value[mine], len(group.terms))
            bound, named = tree.bounds(group.queries), ids[some][tree.order]
            for row, item in enumerate(group.items):
                tree.search(group.queries[row], bound[:, row], named, best[item], k)

    held: list[tuple[np.ndarray, ...]] = []
    docs = entries = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
            held.append((batch["id"].to_numpy(), batch["m"].to_numpy(), sizes, batch["terms"].flatten().to_numpy(zero_copy_only=False), batch["tf"].flatten().to_numpy(zero_copy_only=False)))
            docs, entries = docs + batch.num_rows, entries + int(sizes.sum())
        if held and (batch is None or docs >= full or entries >= ENTRIES):
            ids, m, sizes, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(ids):
                searched(ids, m, np.concatenate([[0], np.cumsum(sizes)]), term, tf)
            held, docs, entries = [], 0, 0
    for item, hits in best.items():
        if hits:
            yield pa.record_batch([pa.array([item] * len(hits), pa.int32()), pa.array([-i for _, i in hits], pa.int64()), pa.array([s for s, _ in hits], pa.int64())], ["item", "id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", full: int = DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item.

    The items are a stated set that meets all documents in blocks of PASS bytes of item text; the
    terms of a block, and how many documents have each, go to the driver and the tasks. A pass
    turns the documents into sparse vectors of the block's terms; each task puts its vectors under
    ball trees (of `full` documents or somewhat more), searches them for every item with what it has found so far as the limit, and
    returns k hits an item; the best of these are ranked.

    Null and empty texts have no terms: such a document is never found and does not count, such an item
    finds nothing. A null document id ranks after all others of its score. Repeated documents and
    repeated items are rows of their own. Other columns are ignored. An empty table gives none.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    passes = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(exchange.NO_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for i in range(passes):
        block = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").collect()
        found = _pass(rows, block, k, full)
        if found is not None:
            names = spark.createDataFrame([(n, x.item_id) for n, x in enumerate(block)], f"item int, item_id {kind}")
            w = Window.partitionBy("item").orderBy(F.desc("score"), "id")
            best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            real = F.when(F.col("id") != exchange.NO_ID, F.col("id"))
            out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", real.alias("doc_id"), "score"))
    return out


def _pass(rows: DataFrame, block: list[Row], k: int, full: int) -> DataFrame | None:
    """(item, id, score) of the hits of each task for the items of a block."""
    words = [terms_of(x.text) for x in block]
    known = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    if not known:
        return None
    vectors = exchange.written(rows.mapInArrow(lambda it: _vectors(it, known), "id long, n long, terms array<int>, tf array<long>"))
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not sums.terms:
        return None
    n_docs, all_terms = int(sums.docs), int(sums.terms)
    weights = np.zeros(len(known), np.int64)
    for x in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        weights[x.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x.df + 1)))
    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    m = F.call_function("div", F.col("n").cast("decimal(19,0)") * whole(75 * n_docs), whole(all_terms)) + 25
    asked = _asked([[known[w] for w in x] for x in words])
    return vectors.filter(F.size("terms") > 0).select("id", m.alias("m"), "terms", "tf").mapInArrow(lambda it: _found(it, asked, weights, k, full), "item int, id long, score long")
