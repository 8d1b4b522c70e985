"""Removal of word sequences that an earlier document already has: fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsgraph.llm import blocks, exchange

_ASK = "chunk int, bucket int, keys binary, flags binary"
_PIECES = "chunk int, bucket int, cuts binary, docs binary, piece binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


class _Chunk:
    """One chunk in id order, with the blocks that it indexes and the windows that it probes."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.table = table.sort_by([("key", "ascending"), ("text", "ascending")])
        self.data, self.offsets = blocks.text_bytes(self.table["text"])
        self.key = self.table["key"].to_numpy()
        self.words = blocks.Words(self.data, self.offsets)
        self.window, self.block, self.buckets = window, window // 2, buckets
        self.at, hashes = self.words.windows(self.block)
        self.probe_hash, self.probes = hashes, blocks.Keys(hashes, buckets)

    def ask(self) -> pa.Table:
        doc = self.key[self.words.doc[self.at]]
        keys = self.probes.keys.astype(np.uint32)
        several = self.probes.first(doc) != self.probes.last(doc)
        inside = self.at - self.words.first[self.words.doc[self.at]]
        reference = self.probes.any(inside % self.block == 0)
        flags = (several + 2 * reference).astype(np.uint8)
        return _rows(_ASK, [(b, keys[s].tobytes(), flags[s].tobytes()) for b, s in self.probes.parts()], self.table)

    def pieces(self, answers: dict[int, bytes]) -> None:
        """Every hit, a block that some document indexes and another one has, with the words around it
        that a window with the block can have; and which of these pieces are equal."""
        hit = np.zeros(len(self.probes.keys), bool)
        for b, s in self.probes.parts():
            hit[s] = blocks.unbits(answers[b], s.stop - s.start)
        some = np.flatnonzero(self.probes.spread(hit))
        spot, reach = self.at[some], self.window - self.block
        row = self.words.doc[spot]
        left = np.minimum(reach, spot - self.words.first[row])
        right = np.minimum(reach, self.words.first[row + 1] - spot - self.block)
        full = left + right >= reach
        self.spot, self.row, self.left, self.right = spot[full], row[full], left[full], right[full]
        whole = np.empty(len(self.spot), np.uint64)
        for a in range(0, len(self.spot), blocks.SLICE):  # in parts, for memory
            part = slice(a, a + blocks.SLICE)
            begin, end = self.spot[part] - self.left[part], self.spot[part] + self.block + self.right[part]
            sums = blocks.prefix(self.words.hash[begin[0] : end.max()], blocks._SEQ)
            whole[part] = blocks.spans(sums, begin - begin[0], end - begin[0], blocks._SEQ)
        # The bucket is that of the block, so all surroundings of a block meet.
        key = self.probe_hash[some][full]
        self.found = blocks.Keys(blocks.mix(whole ^ self.left.astype(np.uint64)), self.buckets, blocks.ranges(key, self.buckets))

    def ask_pieces(self, answers: dict[int, bytes]) -> pa.Table:
        self.pieces(answers)
        found, rows = self.found, []
        spot, left, right, docs = (found.first(x) for x in (self.spot, self.left, self.right, self.key[self.row]))
        for b, s in found.parts():
            size = left[s] + self.block + right[s]
            word = np.arange(size.sum()) + np.repeat(spot[s] - left[s] - np.cumsum(size) + size, size)
            cuts = np.column_stack([left[s], right[s]]).astype(np.uint8)
            rows.append((b, cuts.tobytes(), docs[s].tobytes(), self._spelled(word)))
        return _rows(_PIECES, rows, self.table)

    def _spelled(self, word: np.ndarray) -> bytes:
        """The bytes of these words, a space after each."""
        start, size = self.words.start[word], self.words.end[word] - self.words.start[word] + 1
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(start - end + size, size)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[end - 1] = 32
        return out.tobytes()

    def removed(self, answers: dict[int, bytes], matches: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """The words that a window with an earlier document covers."""
        self.pieces(answers)
        found, reach = self.found, self.window - self.block
        earlier, masks = np.zeros(len(found.keys), bool), np.zeros(len(found.keys), np.uint64)
        for b, s in found.parts():
            earlier[s] = blocks.unbits(matches[b][0], s.stop - s.start)
            masks[s] = np.frombuffer(matches[b][1], np.uint64)
        doc = self.key[self.row]
        every = found.spread(earlier) | (doc > found.spread(found.first(doc)))
        mask, begins = found.spread(masks), []
        for a in range(reach + 1):  # words before the block
            hit = (every | ((mask >> np.uint64(a)) & np.uint64(1)).astype(bool)) & (self.left >= a) & (self.right >= reach - a)
            begins.append(self.spot[hit] - a)
        return blocks.cover(np.concatenate(begins), self.window, len(self.words.hash))

    def result(self, gone: np.ndarray, texts: bool) -> pa.Table:
        first, n_gone = self.words.first, np.concatenate([[0], np.cumsum(gone)])
        n_removed = n_gone[first[1:]] - n_gone[first[:-1]]
        kept = []
        for i in range(len(self.key)):
            words = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()
            if n_removed[i]:
                words = [w for w, x in zip(words, gone[first[i] : first[i + 1]].tolist(), strict=True) if not x]
            kept.append(b" ".join(words))
        columns = [self.table["id"], self.words.per_doc, n_removed, pa.array([x.decode() if texts else None for x in kept], pa.string()), [hashlib.sha256(x).hexdigest() for x in kept]]
        return pa.table(columns, ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _rows(schema: str, rows: list[tuple], table: pa.Table) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    chunk = table["chunk"][0].as_py() if table.num_rows else 0
    columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
    return pa.table([pa.array([chunk] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _answers(table: pa.Table, flags: np.ndarray, masks: np.ndarray | None, cuts: np.ndarray) -> pa.Table:
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    raw = [blocks.bits(flags[a:b]) for a, b in pairs]
    more = [b"" if masks is None else masks[a:b].tobytes() for a, b in pairs]
    kind = pa.array([int(masks is not None)] * len(raw), pa.int32())
    return pa.table([table["chunk"], table["bucket"], kind, pa.array(raw, pa.binary()), pa.array(more, pa.binary())], ["chunk", "bucket", "kind", "bits", "masks"])


def shared_blocks(table: pa.Table) -> pa.Table:
    """Of one bucket: which keys are of an indexed block and occur in two documents or more."""
    keys, cuts = _joined(table["keys"], np.uint32)
    flags, _ = _joined(table["flags"], np.uint8)
    found, key = np.unique(keys, return_inverse=True)
    docs = np.bincount(key, 1 + (flags & 1), len(found))
    indexed = np.bincount(key, flags >> 1, len(found)) > 0
    return _answers(table, ((docs >= 2) & indexed)[key], None, cuts)


def _ranks(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Ranks of the rows by the first part, by the first two and so on: rows are equal as far as ranks are."""
    rank = None
    for part in parts:
        rank = np.unique(part if rank is None else rank * np.int64(1 + part.max(initial=0)) + part, return_inverse=True)[1]
        yield rank.astype(np.int32)


def _last(ranks: Iterator[np.ndarray]) -> np.ndarray:
    return deque(ranks, maxlen=1)[0]


def extended(words: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, docs: np.ndarray, block: int, reach: int) -> np.ndarray:
    """For each piece the windows around its block that a piece of an earlier document has too.

    words holds the word ids of all pieces, first where each piece begins; a piece is left words,
    a block and right words. Equal blocks are extended word by word in both directions, all at
    once: pieces that agree in the block and its next i words share the rank i on the right, and
    likewise on the left, so the maximal repeats of a piece with others are where ranks stop
    being shared. Bit a of a mask: with a words on the left and reach - a on the right, together
    a window, an earlier document agrees.
    """

    def at(k: int) -> np.ndarray:
        """1 + the word k places after the block's first one, 0 beyond the piece."""
        inside = (k >= -left) & (k < block + right)
        return np.where(inside, words[np.where(inside, first + left + k, 0)] + np.int32(1), np.int32(0))

    same = _last(_ranks(at(k) for k in range(block)))
    rights = list(_ranks(chain([same], (at(block + k) for k in range(reach)))))
    lefts = list(_ranks(chain([same], (at(-1 - k) for k in range(reach)))))
    masks = np.zeros(len(first), np.uint64)
    for a in range(reach + 1):
        whole = np.flatnonzero((left >= a) & (right >= reach - a))
        if len(whole):
            _, group = np.unique(lefts[a][whole] * np.int64(1 + rights[reach - a].max()) + rights[reach - a][whole], return_inverse=True)
            least = np.full(group.max() + 1, exchange.NO_ID)
            np.minimum.at(least, group, docs[whole])
            masks[whole[least[group] < docs[whole]]] |= np.uint64(1) << np.uint64(a)
    return masks


def match_pieces(table: pa.Table, block: int, reach: int) -> pa.Table:
    """Of one bucket: whether an earlier document has a whole piece, and else its windows that one has."""
    cuts, until = _joined(table["cuts"], np.uint8)
    left, right = cuts.reshape(-1, 2).astype(np.int64).T
    docs, _ = _joined(table["docs"], np.int64)
    data, _ = _joined(table["piece"], np.uint8)
    # Ids of whole words: each with the space after it.
    ends = np.flatnonzero(data == 32) + 1
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
    del data, ends, offsets
    size = left + block + right
    first = np.cumsum(size) - size
    masks = extended(words, first, left, right, docs, block, reach)
    # Equal pieces of several chunks: all windows of one are in the least document that has it.
    whole = _last(_ranks(chain([left, right], (np.where(k < size, words[np.where(k < size, first + k, 0)], 0) for k in range(block + 2 * reach)))))
    least = np.full(whole.max(initial=-1) + 1, exchange.NO_ID)
    np.minimum.at(least, whole, docs)
    return _answers(table, least[whole] < docs, masks, until // 2)


def _by_kind(table: pa.Table) -> tuple[dict[int, bytes], dict[int, tuple[bytes, bytes]]]:
    out: tuple[dict, dict] = ({}, {})
    for b, kind, raw, masks in zip(*(table[c].to_pylist() for c in ("bucket", "kind", "bits", "masks")), strict=True):
        out[kind][b] = (raw, masks) if kind else raw
    return out


def remove_repeated_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that a smaller id also has (2 to 126 words).

    Each document indexes its non-overlapping blocks of window // 2 words, so that any window
    holds a whole block of each document that has it. All rolling windows of that length probe
    the index by a hash. The words around each hit go to the bucket of the block, once for each
    distinct surrounding in a chunk, where equal blocks are extended word by word on both sides to
    the maximal exact repeats (see extended); words are compared as they are. Returns doc_id, n_words, n_removed, kept_text (kept
    words joined by a space; null without `texts`) and kept_sha256, one row for each row of docs.

    Null or empty text: no words. Null id: larger than every id; rows with equal ids are one
    document here and never remove words of each other. Other columns are ignored.
    """
    if not 2 <= window <= 126:
        raise ValueError("window must be of 2 to 126 words")
    n_chunks, n = exchange.sizes(docs, text_col)
    chunked = exchange.chunks(docs, n_chunks, id_col, text_col)
    answer, block = "chunk int, bucket int, kind int, bits binary, masks binary", window // 2

    def ask(table: pa.Table) -> pa.Table:
        return _Chunk(table, window, n).ask()

    def ask_pieces(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _Chunk(table, window, n).ask_pieces(_by_kind(answers)[0])

    def match(table: pa.Table) -> pa.Table:
        return match_pieces(table, block, window - block)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, n)
        return chunk.result(chunk.removed(*_by_kind(answers)), texts)

    hits = exchange.by_bucket(chunked.groupBy("chunk").applyInArrow(ask, _ASK), shared_blocks, answer)
    repeats = exchange.by_bucket(exchange.with_answers(chunked, hits, ask_pieces, _PIECES), match, answer)
    return exchange.with_answers(chunked, hits.unionByName(repeats), finish, _OUT)
