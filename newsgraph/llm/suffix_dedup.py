"""Removal of byte strings that an earlier document already has: a run-length index.

Documents meet at shared anchors: the byte strings of ANCHOR bytes whose hash is smallest within
some window (so equal windows hold equal anchors at equal places). The surroundings of each
anchor that two documents share go to one bucket, which builds a run-compressed Burrows-Wheeler
transform of their distinct texts, streams every text through it and marks long matches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsgraph.llm import blocks, exchange

ANCHOR = 16
#: Bytes that one index of a bucket holds, for memory; anchors with more surroundings get a larger one.
INDEXED = 1 << 20
NO_OWNER = 2**63
_ASK = "chunk int, bucket int, keys binary, flags binary"
_PIECES = "chunk int, bucket int, cuts binary, docs binary, piece binary"
_ANSWER = "chunk int, bucket int, kind int, bits binary, masks binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[:-step], out[step:]), have + step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, document row and hash of the anchors of all windows, and two hashes for each: of
    the anchor with half of what a window has besides it, on the left and on the right (0 where
    the document ends). A window that two documents share gives them one of the two in common.
    """
    found: list[tuple] = []
    width, half = window - ANCHOR + 1, (window - ANCHOR + 1) // 2
    for a, b in blocks.slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) < window:
            continue
        sums = blocks.byte_sums(part)
        h = blocks.byte_spans(sums, np.arange(len(part) - ANCHOR + 1), ANCHOR)
        order = (h >> blocks.U64(33)).astype(np.int32) + np.int32(1)
        least = _slide(order, width, np.minimum)  # of the window that begins at each position
        room = np.zeros(len(part) + 1, np.int8)
        size = np.diff(at)
        room[at[:-1][size >= window]] += 1
        room[(at[1:] - window + 1)[size >= window]] -= 1
        # A position is an anchor if it is the least of a window that has it; 0 stands for no window.
        pad = np.zeros(width - 1, np.int32)
        most = _slide(np.concatenate([pad, least * np.cumsum(room[: len(least)], dtype=np.int8), pad]), width, np.maximum)
        spot = np.flatnonzero(most[: len(order)] == order)
        row = np.searchsorted(at, spot, "right") - 1
        left = spot - half >= at[row]
        right = spot + ANCHOR + half <= at[row + 1]
        sides = np.zeros((len(spot), 2), np.uint64)
        sides[left, 0] = blocks.byte_spans(sums, spot[left] - half, ANCHOR + half)
        sides[right, 1] = blocks.byte_spans(sums, spot[right], ANCHOR + half)
        found.append((spot + offsets[a], row + a, blocks.mix(h[spot]), sides))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, each with an owner (its document).

    Suffixes end with their text; equal suffixes stand in the order of the texts. Kept are the
    runs (byte, first row, rank of the first row among rows of that byte) and, for each group of
    rows with equal first `depth` bytes (which may span runs), the least owner of the group.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray, depth: int):
        n, sizes = len(data), np.diff(np.append(starts, len(data)))
        left = np.repeat(starts + sizes, sizes) - np.arange(n)  # bytes from here to the end of the text
        rank, rows, same = _suffixes(data, left, depth)
        # The empty suffixes of all texts come first; 256: the text begins here, no byte is before.
        m = len(starts)
        begins, data = np.zeros(n, bool), data.astype(np.int16)
        begins[starts] = True
        before = np.concatenate([data[starts + sizes - 1], np.where(begins[rows], 256, data[rows - 1])])
        new = np.ones(m + n, bool)
        np.not_equal(before[1:], before[:-1], out=new[1:])
        self.run = np.flatnonzero(new)
        byte, size = before[self.run], np.diff(np.append(self.run, m + n))
        # The rows that begin with a byte stand in the order of the rows which that byte is before.
        by_byte = np.argsort(byte, kind="stable")
        self.to = np.empty(len(self.run), np.int64)
        self.to[by_byte] = m + np.cumsum(size[by_byte]) - size[by_byte]
        # Samples: the groups of rows with the same first `depth` bytes.
        new[: m + 1] = True
        new[m + 1 :] = ~same
        self.group = np.flatnonzero(new)
        self.owner = np.minimum.reduceat(np.concatenate([owners, np.repeat(owners, sizes)[rows]]), self.group)

    def step(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that are longer by the byte before."""
        run = np.searchsorted(self.run, row, "right") - 1
        return self.to[run] + row - self.run[run]

    def least_owner(self, row: np.ndarray) -> np.ndarray:
        """The least document that has the first `depth` bytes of each row's suffix."""
        return self.owner[np.searchsorted(self.group, row, "right") - 1]


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and the order of the keys."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.zeros(len(key), np.int64)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:], casting="unsafe")
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out, order


def _suffixes(data: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the suffixes, their order (equal ones by place), and for each but the first of
    that order whether its first `depth` bytes are those of the one before.

    A suffix ends `left` bytes on. The first sort takes as many bytes as fit a key, each later one
    joins the ranks of two or three places.
    """
    n = len(data)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, len(used) + 1)  # 0: past the end
    each = max(1, int(len(used)).bit_length())
    h = min(62 // each, depth - 1)
    wide, key = np.concatenate([symbol[data], np.zeros(h, np.int64)]), np.zeros(n, np.int64)
    for t in range(h):
        key = (key << each) | np.where(left > t, wide[t : t + n], 0)

    def at(rank: np.ndarray, shift: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: n - shift] = rank[shift:] + 1
        return np.where(left > shift, out, 0)

    rank, rows = _rank(key)
    pair = None
    while True:
        ways = 3 if (n + 2) ** 3 < 2**62 else 2
        if pair is None and ways * h >= depth:  # overlapping places make exactly the first bytes
            shifts = [min(h * i, depth - h) for i in range(1, ways)]
            pair = [rank, *(at(rank, x) for x in shifts)]
        if h >= left.max(initial=0):
            break
        key = rank + 1
        for i in range(1, ways):
            key = key * (n + 2) + (at(rank, h * i) if h * i < n else 0)
        rank, rows = _rank(key)
        h *= ways
    same = np.ones(max(0, n - 1), bool)
    for x in pair or [rank]:
        ordered = x[rows]
        same &= ordered[1:] == ordered[:-1]
    return rank, rows, same


def long_matches(data: np.ndarray, starts: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For each text, a bit for each of its windows (bit i: the one that begins at byte i) that
    an earlier owner has. Streams all texts through the index, one byte a step, from the end."""
    index = RunLengthIndex(data, starts, owners, window)
    sizes = np.diff(np.append(starts, len(data)))
    masks = np.zeros(len(starts), np.uint64)
    row, live = np.arange(len(starts)), np.arange(len(starts))  # the empty suffixes
    done = np.zeros(len(starts), np.int64)  # bytes streamed of each text
    while len(live):
        full = live[done[live] >= window]
        earlier = full[index.least_owner(row[full]) < owners[full]]
        masks[earlier] |= np.uint64(1) << (sizes[earlier] - done[earlier]).astype(np.uint64)
        live = live[done[live] < sizes[live]]
        row[live] = index.step(row[live])
        done[live] += 1
    return masks


class _Chunk:
    """One chunk in id order, with its anchors."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.table = table.sort_by([("key", "ascending"), ("text", "ascending")])
        self.data, self.offsets = blocks.text_bytes(self.table["text"])
        self.key = self.table["key"].to_numpy()
        self.window, self.buckets = window, buckets
        self.at, self.doc, self.hash, sides = anchors(self.data, self.offsets, window)
        self.side = np.flatnonzero(sides.ravel())  # places of the keys: twice the anchor, 1 more for its right
        self.keys = blocks.Keys(sides.ravel()[self.side], buckets)

    def _table(self, schema: str, rows: list[tuple]) -> pa.Table:
        names = [x.split()[0] for x in schema.split(", ")]
        chunk = self.table["chunk"][0].as_py() if self.table.num_rows else 0
        columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
        return pa.table([pa.array([chunk] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.large_binary()).cast(pa.binary()) for c in columns[1:])], names)

    def ask(self) -> pa.Table:
        doc = self.key[self.doc[self.side // 2]]
        several = (self.keys.first(doc) != self.keys.last(doc)).astype(np.uint8)
        keys = self.keys.keys.astype(np.uint32)
        return self._table(_ASK, [(b, keys[s].tobytes(), several[s].tobytes()) for b, s in self.keys.parts()])

    def pieces(self, answers: dict[int, tuple]) -> None:
        """The distinct surroundings of shared anchors, in the order of bucket and text."""
        shared, some = np.zeros(len(self.keys.keys), bool), np.zeros(len(self.at), bool)
        for b, s in self.keys.parts():
            shared[s] = blocks.unbits(answers[b][0], s.stop - s.start)
        some[self.side[self.keys.spread(shared)] // 2] = True
        some = np.flatnonzero(some)
        self.spot, self.row = self.at[some], self.doc[some]
        self.left = np.minimum(self.window - ANCHOR, self.spot - self.offsets[self.row])
        self.right = np.minimum(self.window, self.offsets[self.row + 1] - self.spot)
        whole = np.zeros(len(some), np.uint64)
        for a, b in blocks.slices(self.offsets):
            lo, hi = np.searchsorted(self.row, [a, b])
            if lo < hi:
                sums = blocks.byte_sums(self.data[self.offsets[a] : self.offsets[b]])
                begin = self.spot[lo:hi] - self.left[lo:hi] - self.offsets[a]
                whole[lo:hi] = blocks.byte_spans(sums, begin, self.left[lo:hi] + self.right[lo:hi])
        # The bucket is that of the anchor, so all surroundings of an anchor meet.
        key = self.hash[some]
        self.found = blocks.Keys(blocks.mix(whole ^ blocks.mix(key + self.left.astype(np.uint64))), self.buckets, blocks.ranges(key, self.buckets))

    def ask_pieces(self, answers: dict[int, tuple]) -> pa.Table:
        self.pieces(answers)
        found = self.found
        spot, left, right = (found.first(x) for x in (self.spot, self.left, self.right))
        docs, rows = found.first(self.key[self.row]), []
        for b, s in found.parts():
            size = left[s] + right[s]
            begin = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(spot[s] - left[s] - begin, size)
            cuts = np.column_stack([left[s], right[s]]).astype(np.uint8)
            rows.append((b, cuts.tobytes(), docs[s].tobytes(), self.data[at].tobytes()))
        return self._table(_PIECES, rows)

    def finish(self, answers: dict[int, tuple], matches: dict[int, tuple], texts: bool) -> pa.Table:
        self.pieces(answers)
        found = self.found
        earlier, masks = np.zeros(len(found.keys), bool), np.zeros(len(found.keys), np.uint64)
        for b, s in found.parts():
            earlier[s] = blocks.unbits(matches[b][0], s.stop - s.start)
            masks[s] = np.frombuffer(matches[b][1], np.uint64)
        doc = self.key[self.row]
        every = found.spread(earlier) | (doc > found.spread(found.first(doc)))
        mask, first = found.spread(masks), self.spot - self.left
        begins = []
        for i in range(self.window - ANCHOR + 1):
            hit = (every | ((mask >> np.uint64(i)) & np.uint64(1)).astype(bool)) & (i + self.window <= self.left + self.right)
            begins.append(first[hit] + i)
        gone = blocks.cover(np.concatenate(begins), self.window, len(self.data))
        return self.result(gone, texts)

    def result(self, gone: np.ndarray, texts: bool) -> pa.Table:
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        begin = self.offsets[:-1][np.diff(self.offsets) > 0]
        edge[begin] = gone[begin]
        removed, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge))
        n_removed, n_spans = (x[self.offsets[1:]] - x[self.offsets[:-1]] for x in (removed, runs))
        kept, digests = [], []
        for i, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            left = (self.data[a:b][~gone[a:b]] if n_removed[i] else self.data[a:b]).tobytes()
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left if texts else None)
        columns = [self.table["id"], np.diff(self.offsets), n_removed, n_spans, pa.chunked_array([pa.array([x], pa.binary()) for x in kept], pa.binary()) if texts and len(self.data) >= 2**31 else pa.array(kept, pa.binary()), digests]
        return pa.table(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def _answer(table: pa.Table, kind: int, flags: list[bytes], masks: list[bytes]) -> pa.Table:
    n = len(flags)
    return pa.table([table["chunk"], table["bucket"], pa.array([kind] * n, pa.int32()), pa.array(flags, pa.binary()), pa.array(masks, pa.binary())], ["chunk", "bucket", "kind", "bits", "masks"])


def shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: which anchors occur in two documents or more."""
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    several = np.concatenate([np.frombuffer(x, np.uint8) for x in table["flags"].to_pylist()])
    found, key = np.unique(np.concatenate(keys), return_inverse=True)
    shared = (np.bincount(key, 1 + several, len(found)) >= 2)[key]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
    flags = [blocks.bits(shared[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return _answer(table, 0, flags, [b""] * len(flags))


def match_pieces(table: pa.Table, window: int) -> pa.Table:
    """Of one bucket: whether an earlier document has a whole piece, and else its windows that one has."""
    cuts = [np.frombuffer(x, np.uint8).reshape(-1, 2).astype(np.int64) for x in table["cuts"].to_pylist()]
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()])
    data = np.concatenate([np.frombuffer(x, np.uint8) for x in table["piece"].to_pylist()])
    sizes = np.concatenate(cuts).sum(axis=1)
    ends = np.cumsum(sizes)
    # Equal pieces of several chunks become one text, owned by the least document.
    text, left = data.tobytes(), np.concatenate(cuts)[:, 0].tolist()
    pieces = [(n, text[e - size : e]) for n, e, size in zip(left, ends.tolist(), sizes.tolist(), strict=True)]
    least: dict[tuple[int, bytes], int] = {}
    for x, d in zip(pieces, docs.tolist(), strict=True):
        if d < least.get(x, NO_OWNER):
            least[x] = d
    # What an anchor has but one surrounding for is one run: its windows are in the same documents.
    masks_of = dict.fromkeys(least, 0)
    several = Counter(x[left : left + ANCHOR] for left, x in least)
    for part in _parts([(left, x) for left, x in least if several[x[left : left + ANCHOR]] > 1]):
        part.sort(key=least.__getitem__)
        one = np.frombuffer(b"".join(x for _, x in part), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(x) for _, x in part])])[:-1]
        found = long_matches(one, starts, np.array([least[x] for x in part], np.int64), window)
        masks_of.update(zip(part, found.tolist(), strict=True))
    lengths = np.concatenate([[0], np.cumsum([len(x) for x in cuts])])
    earlier = np.array([least[x] for x in pieces], np.int64) < docs
    masks = np.array([masks_of[x] for x in pieces], np.uint64)
    pairs = list(zip(lengths[:-1], lengths[1:], strict=True))
    return _answer(table, 1, [blocks.bits(earlier[a:b]) for a, b in pairs], [masks[a:b].tobytes() for a, b in pairs])


def _parts(pieces: list[tuple[int, bytes]]) -> list[list[tuple[int, bytes]]]:
    """The pieces in parts of about INDEXED bytes; those of one anchor stay together."""
    n = 1 + sum(len(x) for _, x in pieces) // INDEXED
    parts: list[list] = [[] for _ in range(n)]
    for left, x in pieces:
        parts[zlib.crc32(x[left : left + ANCHOR]) % n].append((left, x))
    return [x for x in parts if x]


def _by_kind(table: pa.Table) -> tuple[dict[int, tuple], dict[int, tuple]]:
    out: tuple[dict, dict] = ({}, {})
    for b, kind, flags, masks in zip(*(table[c].to_pylist() for c in ("bucket", "kind", "bits", "masks")), strict=True):
        out[kind][b] = (flags, masks)
    return out


def remove_repeated_bytes(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that a smaller id also has (20 to 79 bytes).

    Strings are those of the input, within one document; anchors are compared by 64-bit hashes
    and the windows around them byte by byte, in the run-length index of their bucket. A bucket
    holds each distinct surrounding once, however many documents have it. Returns doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes; null without
    `texts`) and kept_sha256, one row for each row of docs.

    Null or empty text: no bytes. Null id: larger than every id; rows with equal ids are one
    document here and never remove bytes of each other. Other columns are ignored.
    """
    if not ANCHOR < window < 64 + ANCHOR:
        raise ValueError("window must be of 17 to 79 bytes")
    n_chunks, n = exchange.sizes(docs, text_col)
    chunked = exchange.chunks(docs, n_chunks, id_col, text_col)

    def ask(table: pa.Table) -> pa.Table:
        return _Chunk(table, window, n).ask()

    def ask_pieces(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _Chunk(table, window, n).ask_pieces(_by_kind(answers)[0])

    def match(table: pa.Table) -> pa.Table:
        return match_pieces(table, window)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _Chunk(table, window, n).finish(*_by_kind(answers), texts)

    shared = exchange.by_bucket(chunked.groupBy("chunk").applyInArrow(ask, _ASK), shared_anchors, _ANSWER)
    matches = exchange.by_bucket(exchange.with_answers(chunked, shared, ask_pieces, _PIECES), match, _ANSWER)
    return exchange.with_answers(chunked, shared.unionByName(matches), finish, _OUT)
