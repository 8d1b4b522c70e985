"""Quality rules: line labelling by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm import blocks, exchange

SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "bias", "short", "long", "symbols", "some symbols", "upper", "mostly upper", "digits", "no final stop", "final symbol",
    "repeated words", "few distinct words", "repeated line", "first line", "last line", "long words", "shouts", "bars",
)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
CONTENT, BOILERPLATE = 0, 1


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the lines of a text that hold a word: a row of features and the length in bytes of each,
    and how many equal an earlier line."""
    seen: set[bytes] = set()
    rows, sizes, repeated = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeated += again
        n, size = len(words), sum(map(len, words))
        symbols = size - len(b"".join(words).translate(None, SYMBOLS))
        letters = len(line.translate(None, b" \t\r\x0b\x0c0123456789.,;:!?'\"()-" + SYMBOLS)) or 1
        upper = letters - len(line.translate(None, b" \t\r\x0b\x0c0123456789.,;:!?'\"()-ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SYMBOLS))
        digits = size - len(b"".join(words).translate(None, b"0123456789"))
        adjacent = sum(map(bytes.__eq__, words, words[1:]))
        distinct = len(set(words))
        rows.append((
            1, n < 4, n > 40, min(1, 4 * symbols / size), symbols > 2, min(1, upper / letters), 2 * upper > letters, min(1, 2 * digits / size), line[-1:] not in b".!?", line[-1:] in SYMBOLS,
            min(1, 2 * adjacent / n), n >= 10 and 3 * distinct < n, again, not sizes, 0, size > 15 * n, 4 * line.count(b"!!") > n, 4 * words.count(b"|") > n,
        ))
        sizes.append(len(line))
    out = np.array(rows, np.float64).reshape(len(rows), len(FEATURES))
    if rows:
        out[-1, FEATURES.index("last line")] = 1
    return out, np.array(sizes, np.int64), repeated


class LineModel:
    """Weights of a two-label linear chain: a score of each label by feature, and of each step."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def labels(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence, by Viterbi decoding."""
        scores = (features @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        back, a, b = [], 0.0, 0.0
        for i, (x, y) in enumerate(scores):
            if not i:
                a, b = x, y
                continue
            from_a, from_b = a + s00 >= b + s10, a + s01 > b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + s00 if from_a else b + s10), y + (a + s01 if from_b else b + s11)
        out = np.zeros(len(scores), np.int8)
        if len(scores):
            out[-1] = b > a
            for i in range(len(scores) - 2, -1, -1):
                out[i] = back[i][out[i + 1]]
        return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> LineModel:
    """Maximum conditional likelihood by gradient ascent with momentum, all sequences at once.

    Sequences are (features, labels). Places stand one after another, and at each place the longer
    sequences first, so that a step of the recursions works on one stretch of rows.
    """
    order = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
    sizes = np.array([len(y) for _, y in order])
    alive = [int((sizes > t).sum()) for t in range(sizes[0])]  # sequences that reach each place
    at = np.concatenate([[0], np.cumsum(alive)])
    k = order[0][0].shape[1]
    x, y = np.empty((at[-1], k)), np.empty(at[-1], np.int64)
    for i, (f, labels) in enumerate(order):
        x[at[: len(labels)] + i], y[at[: len(labels)] + i] = f, labels
    here = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    hot, last = np.eye(2)[y], at[sizes - 1] + np.arange(len(order))
    seen_emit, seen_step = x.T @ hot, np.zeros((2, 2))
    for t in range(1, len(here)):
        seen_step += hot[here[t - 1]][: alive[t]].T @ hot[here[t]]
    emit, step, v_emit, v_step = np.zeros((k, 2)), np.zeros((2, 2)), np.zeros((k, 2)), np.zeros((2, 2))
    for _ in range(rounds):
        score, ahead, behind = x @ emit, np.empty((len(x), 2)), np.zeros((len(x), 2))
        ahead[here[0]] = score[here[0]]
        for t in range(1, len(here)):
            before = ahead[here[t - 1]][: alive[t]]
            ahead[here[t]] = score[here[t]] + np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
        total = np.logaddexp(ahead[last, 0], ahead[last, 1])
        pairs = np.zeros((2, 2))
        for t in range(len(here) - 1, 0, -1):
            after = score[here[t]] + behind[here[t]]
            spot = slice(at[t - 1], at[t - 1] + alive[t])
            behind[spot] = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
            pairs += np.exp(ahead[spot][:, :, None] + step + (after - total[: alive[t], None])[:, None, :]).sum(axis=0)
        each = np.exp(ahead + behind - np.concatenate([total[:n] for n in alive])[:, None])
        g_emit = (seen_emit - x.T @ each) / len(x) - ridge * emit
        g_step = (seen_step - pairs) / max(1, len(x) - len(order)) - ridge * step
        v_emit, v_step = 0.9 * v_emit + rate * g_emit, 0.9 * v_step + rate * g_step
        emit, step = emit + v_emit, step + v_step
    return LineModel(emit, step)


def common_lines(docs: DataFrame, of: DataFrame, least: int = 3, text_col: str = "text") -> DataFrame:
    """(line): hashes, of those in `of`, of the lines that stand in the texts of docs after `least`
    different lines at least: what many pages carry, not what copies of one text repeat."""
    lines = F.concat(F.array(F.lit("")), F.split(text_col, "\n"))
    pairs = docs.select(F.explode_outer(F.arrays_zip(F.slice(lines, 2, F.size(lines) - 1).alias("line"), lines.alias("before"))).alias("p"))
    pairs = pairs.select(F.xxhash64("p.line").alias("line"), F.xxhash64("p.before").alias("before"))
    return pairs.join(exchange.small(of), "line", "left_semi").distinct().groupBy("line").count().filter(F.col("count") >= least).select("line")


def training_sequences(texts: list[tuple[str, int, set[int]]], size: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) from whole texts: (text, quality, places of lines that many texts carry).

    Lines of good texts are content and those of bad ones boilerplate, as are lines that many
    texts carry. In addition each bad text is set into a good one, between two of its lines, so
    that labels change within a sequence. Sequences are cut into parts of `size` lines.
    """
    good, bad = ([(t.split("\n"), common) for t, q, common in texts if q == kind] for kind in (1, 0))
    labelled = [[(x, BOILERPLATE if i in common else CONTENT) for i, x in enumerate(lines)] for lines, common in good]
    junk = [[(x, BOILERPLATE) for x in lines] for lines, _ in bad]
    for i, lines in enumerate(junk):
        host = labelled[i % len(labelled)] if labelled else []
        cut = (7 * i) % (len(host) + 1)
        labelled.append(host[:cut] + lines + host[cut:])
    out = []
    for rows in labelled + junk:
        rows = [r for r in rows if r[0].encode().split()]
        features, _, _ = line_features("\n".join(x for x, _ in rows).encode())
        labels = np.array([y for _, y in rows], np.int64)
        out += [(features[i : i + size], labels[i : i + size]) for i in range(0, len(labels), size)]
    return out


def train_line_model(docs: DataFrame, labels: DataFrame, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> LineModel | None:
    """Fit the chain on the whole texts of at most `sample` labelled documents of each quality, by
    hash of the id. Which of their lines many texts carry is counted over all documents. None if
    one of the two kinds is missing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null and doc_id is not null")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").distinct()
    chosen = [marks.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    some = exchange.written(rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").withColumn("lines", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))))
    common = exchange.written(common_lines(rows, some.select(F.explode("lines").alias("line")).distinct(), text_col="text"))
    carried = some.select("doc_id", "text", F.posexplode("lines").alias("at", "line")).join(exchange.small(common), "line").groupBy("doc_id", "text").agg(F.collect_set("at").alias("common"))
    found = some.join(carried, ["doc_id", "text"], "left").select("doc_id", "text", "quality", "common").toLocalIterator()
    texts = sorted((r.doc_id, r.text, r.quality, tuple(r.common or ())) for r in found)
    exchange.drop(some, common)
    kinds = {q for _, _, q, _ in texts}
    sequences = training_sequences([(t, q, set(c)) for _, t, q, c in texts])
    return fit(sequences) if len(kinds) == 2 and {int(v) for _, y in sequences for v in y} == {CONTENT, BOILERPLATE} else None


def _judged(batches: Iterator[pa.RecordBatch], model: LineModel | None, share: float, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = blocks.text_bytes(batch[text_col])
        columns: list[list] = [[] for _ in range(6)]
        shares: list[float | None] = []
        for a, b in blocks.slices(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words = blocks.Words(part, at)
            lead = (part & 0xC0) != 0x80  # the first byte of each code point
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (blocks.IS_WORD[part] & lead, _IS_SYMBOL[part])]
            chars, symbols = (x[at[1:]] - x[at[:-1]] for x in sums)
            starts, hashes = words.windows(8)
            doc = words.doc[starts]
            # Twice or more in the text: equal neighbours in the order of document and hash.
            order = np.lexsort((hashes, doc))
            equal = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = np.zeros(len(starts), bool)
            twice[order[1:][equal]] = twice[order[:-1][equal]] = True
            covered = np.concatenate([[0], np.cumsum(blocks.cover(starts[twice], 8, len(words.doc)))])
            again = covered[words.first[1:]] - covered[words.first[:-1]]
            text = part.tobytes()
            for i in range(b - a):
                features, sizes, repeated = line_features(text[at[i] : at[i + 1]])
                n = int(words.per_doc[i])
                failed = n < 20 or 100 * int(again[i]) > 30 * n
                content = 1.0
                if len(sizes) and model is not None:
                    content = float(sizes[model.labels(features) == CONTENT].sum() / sizes.sum())
                shares.append(content)
                for column, value in zip(columns, (n, int(chars[i]), int(symbols[i]), repeated, int(again[i]), failed), strict=True):
                    column.append(value)
        kept = [not f and s >= share for f, s in zip(columns[5], shares, strict=True)]
        made = [*columns, shares, kept]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(made, kinds, strict=True))], [*batch.schema.names, *names])


def judge_quality(docs: DataFrame, model: LineModel | None, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep a document if it passes the base rules and the chain labels enough of it content.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share
    (bytes of lines with a word that are labelled content) and kept to the columns of docs;
    columns of docs with these names are replaced. Base rules: at least 20 words, and at most
    30 % of them in 8-word windows that the text holds twice or more. Null or empty text: no
    words, fails. Without a model the base rules alone decide. No shuffle; one pass.
    """
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    base = docs.drop(*(x.split()[0] for x in made.split(", ")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), made])
    return base.mapInArrow(lambda it: _judged(it, model, share, id_col, text_col), schema)
