"""Near duplicates by SimHash: fingerprints linked through Gray-order hierarchical indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm import components, exchange

U64 = np.uint64
BITS = 64
SEED = 42
#: Bits that a bucket may leave open, so that it has 2 ** OPEN codes at most.
OPEN = 13
#: Children of a node.
FAN = 8
#: Codes that one index holds at least, where there are as many, and queries that go down at once.
BLOCK, SLICE = 1 << 15, 1 << 11


def fingerprint(words: list[bytes], size: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word windows; 0 without words."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        texts = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in texts), U64)
        sums += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (null as the largest), code (the 64 bits as a signed number) of every row.

    Words are what stands between the bytes 0x20 and 0x09-0x0D, A-Z in lower case; a text of fewer
    words than `size` is one window. Null and empty texts, and those without words, have code 0.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint((x or b"").lower().split(), size) for x in (s.as_py() for s in batch["text"])), U64, batch.num_rows)
            yield pa.record_batch([batch["id"], pa.array(codes.view(np.int64))], ["id", "code"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(exchange.NO_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(code, "id long, code long")


def masks(most: int) -> list[list[int]]:
    """Levels of masks for pairs of at most `most` differing bits: of most + 1 parts of the open bits,
    one at least agrees in such a pair, so the mask of one of them, and of a part of what that
    leaves open, and so on, has the same bits of both. Ends when at most OPEN bits are open."""
    levels: list[list[int]] = []
    now = [0]
    while True:
        out = []
        for fixed in now:
            left = [i for i in range(BITS) if not fixed >> i & 1]
            cuts = [len(left) * j // (most + 1) for j in range(most + 2)]
            out += [fixed | sum(1 << i for i in left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        levels.append(out)
        if all(BITS - m.bit_count() <= OPEN for m in out):
            return levels
        now = out


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, where neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class GrayIndex:
    """Codes in order of bucket and Gray rank under nodes of FAN children, up to a root a bucket.

    A node has a mask, the bits in which all its codes agree, and their pattern there. The mask of
    a child contains that of its parent, so the differences of a query from a node are those from
    its parent and those in the bits that the child's mask adds.
    """

    def __init__(self, codes: np.ndarray, new_bucket: np.ndarray):
        self.codes = codes
        pattern, mask, begins = codes, np.full(len(codes), ~U64(0)), new_bucket
        until = np.arange(1, len(codes) + 1)
        self.bucket = np.cumsum(new_bucket) - 1
        #: From the leaves up: pattern, mask, end of the codes below, first child, end of the children.
        self.levels = [(pattern, mask, until, None, None)]
        while not begins.all():
            first = np.flatnonzero(begins)
            place = np.arange(len(begins)) - first[np.cumsum(begins) - 1]
            at = np.flatnonzero(place % FAN == 0)
            owner = np.cumsum(place % FAN == 0) - 1
            differ = np.bitwise_or.reduceat((pattern ^ pattern[at][owner]) | ~mask, at)
            end = np.append(at[1:], len(pattern))
            pattern, mask, until, begins = pattern[at] & ~differ, ~differ, until[end - 1], begins[at]
            self.levels.append((pattern, mask, until, at, end))

    def near(self, lo: int, hi: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (a, b), a < b, a in [lo, hi), of codes of one bucket that differ in at most `most` bits."""
        q = np.arange(lo, hi)
        node, seen, fixed = self.bucket[lo:hi], np.zeros(hi - lo, np.uint8), np.zeros(hi - lo, U64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask, until, first, end = self.levels[depth]
            seen = seen + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node] & ~fixed)
            live = (seen <= most) & (until[node] > q + 1)
            q, node, seen = q[live], node[live], seen[live]
            if depth:
                fixed, n = mask[node], end[node] - first[node]
                below = np.repeat(first[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else node
                q, seen, fixed, node = np.repeat(q, n), np.repeat(seen, n), np.repeat(fixed, n), below
        return q, node


def _forest(index: GrayIndex, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, root) of the codes that are linked with another one of their bucket, but for the roots."""
    n = len(index.codes)
    label = np.arange(n)
    for lo in range(0, n, SLICE):
        a, b = index.near(lo, min(n, lo + SLICE), most)
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _links(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join what is linked in each bucket. Rows come in order of path, key and Gray rank."""

    def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole buckets, `block` rows or more together, the last ones fewer."""
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch[c].to_numpy().astype(np.int64) for c in ("path", "key", "code")]))
            size += batch.num_rows
            if size >= block:
                rows = np.concatenate(held, axis=1)
                new = (np.diff(rows[:2], axis=1) != 0).any(axis=0)
                cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
                if cut:
                    yield rows[2, :cut], np.concatenate([[True], new[: cut - 1]])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            rows = np.concatenate(held, axis=1)
            yield rows[2], np.concatenate([[True], (np.diff(rows[:2], axis=1) != 0).any(axis=0)])

    for codes, new in whole():
        alone = new & np.append(new[1:], True)
        codes, new = codes[~alone], new[~alone]
        if len(codes):
            at, root = _forest(GrayIndex(codes.view(U64), new), most)
            yield pa.record_batch([pa.array(codes[at]), pa.array(codes[root])], ["a", "b"])


def code_links(codes: DataFrame, most: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct codes whose components are those of all pairs that differ in at
    most `most` bits. codes: one column code, distinct.

    Codes are dealt to buckets that share the bits of a mask (see masks), and each bucket is
    searched through its Gray-order index. Buckets of more than 2 ** OPEN codes are dealt anew by
    the masks of the next level; at the last one, no bucket can be larger. So a task holds a bounded
    number of codes at a time and no pair is lost, however many codes are alike.
    """
    levels, out = masks(most), None
    rows = codes.select("code", F.lit(0).alias("path"))
    for depth, level in enumerate(levels):
        table = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in level))
        dealt = rows.select("code", F.explode(F.array(*(F.col("path") * (most + 1) + j for j in range(most + 1)))).alias("path"))
        dealt = dealt.withColumn("key", F.col("code").bitwiseAND(F.element_at(table, F.col("path") + 1)))
        crowded = None
        if depth + 1 < len(levels):
            crowded = exchange.written(dealt.groupBy("path", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1 << OPEN).select("path", "key"))
            crowded = None if crowded.isEmpty() else exchange.small(crowded)
        few = dealt if crowded is None else dealt.join(crowded, ["path", "key"], "left_anti")
        ordered = few.withColumn("rank", gray_rank(F.col("code"))).repartition("path", "key").sortWithinPartitions("path", "key", "rank")
        found = ordered.select("path", "key", "code").mapInArrow(lambda it: _links(it, most, block), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if crowded is None:
            break
        rows = dealt.join(crowded, ["path", "key"], "left_semi").select("code", "path")
    return out


def simhash_duplicates(docs: DataFrame, size: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose fingerprints differ in at most `most` bits.

    Rows of one fingerprint are one node (partial aggregation), so copies never meet in one task;
    nodes are linked by code_links(). Returns doc_id, fingerprint (16 hex digits), component_id (least
    id of the component), one row for each row of docs. Null or empty text, or no word: fingerprint
    zero, linked like any other. Null id: larger than every id; a component of such rows alone has a
    null id. Rows of equal ids are rows of their own. Other columns are ignored. Empty table: none.
    """
    prints = exchange.written(fingerprints(docs, size, id_col, text_col))
    nodes = exchange.written(prints.groupBy("code").agg(F.min("id").alias("least")))
    links = exchange.written(code_links(nodes.select("code"), most).distinct())
    label = exchange.written(components.connected_components(links))
    exchange.drop(links)
    named = nodes.join(label.withColumnRenamed("node", "code"), "code", "left")
    least = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component", "left").select("code", F.coalesce("component_id", "least").alias("component_id"))
    real = lambda c: F.when(F.col(c) != exchange.NO_ID, F.col(c))
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return prints.join(named, "code").select(real("id").alias("doc_id"), digits.alias("fingerprint"), real("component_id").alias("component_id"))
