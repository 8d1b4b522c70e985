"""Source divergence, SimHash groups and ranked search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from newsgraph.llm import divergence, lexical, queries, simhash

DOC = "doc_id long, text string, lang string, source string, value string, item string, rank string, score string, code string, n string"
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "v", "i", "r", "s", "c", "n") for r in rows], DOC)


def words(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null and empty texts, null ids, languages and sources, repeated rows, ties, a very long text, other scripts."""
    r = random.Random(5)
    some = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "é", "ß", "日本", "Ab1c", "a_b"]
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, None), (4, "One two", "de", "b"), (4, "One two", "de", "b"), (None, "One two", None, "b"), (None, None, None, None)]
    rows += [(100 + i, words(r, r.randint(1, 40), some), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "", None])) for i in range(120)]
    long = words(r, 70_000, some)
    return [*rows, (900, long, "en", "a"), (901, long + " more", "fr", "a"), (902, "alone", "xx", "y"), (903, "alone", "xx", "z")]


def divergences(rows, least, top):
    docs = [(lang or "", source or "", LETTERS.findall(lower(text))) for _, text, lang, source in rows]
    df, total, own = Counter(), Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        total.update((lang, t) for t in terms)
        own[lang, source].update(terms)
    out = []
    for lang in {x[0] for x in docs}:
        kept = [t for g, t in df if g == lang and df[lang, t] >= least]
        p = lambda count, size, v=len(kept): 1 + 10**9 * (count + 2) // (size + 2 * v)
        sizes = {s: sum(own[lang, s][t] for t in kept) for g, s in own if g == lang}
        whole = sum(total[lang, t] for t in kept)
        for s in sizes:
            pairs = [(-sum((p(own[lang, s][t], sizes[s]) - p(own[lang, o][t], sizes[o])) ** 2 // (p(own[lang, s][t], sizes[s]) + p(own[lang, o][t], sizes[o])) for t in kept), o) for o in sizes if o != s]
            terms = []
            for t in kept:
                x, y = p(own[lang, s][t], sizes[s]), p(total[lang, t], whole)
                if own[lang, s][t] and x > y:
                    terms.append((-((x - y) ** 2 // (x + y)), t))
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(sorted(found, key=lambda z: (z[0], z[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_divergence_equals_brute_force(spark, odd, least):
    got = sorted(map(tuple, divergence.source_divergence(frame(spark, odd), least).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == divergences(odd, least, 10)


def test_divergence_in_many_blocks_and_tiles(spark, odd):
    got = sorted(map(tuple, divergence.source_divergence(frame(spark, odd), 2, 3, block=8, tile=2).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == divergences(odd, 2, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0


def test_equal_subtrees_are_one_node_and_sums_are_exact():
    counts = np.zeros((3, 1000), np.int64)
    counts[0, :5] = 7
    trees = divergence.Trees(counts)
    assert trees.roots[1] == trees.roots[2] != trees.roots[0]
    assert all(len(left) <= 6 for left, _ in trees.children)
    huge = np.array([[10**10, 3], [5, 10**12]])
    (got,) = divergence.Trees(huge).prices(np.array([0]), np.array([1]), np.array([10**11, 10**13]))
    p = [[1 + 10**9 * (int(c) + 2) // d for c in row] for row, d in zip(huge, (10**11, 10**13), strict=True)]
    assert got == sum((a - b) ** 2 // (a + b) for a, b in zip(*p, strict=True))


def code_of(text):
    w = WORD.findall(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(codes, most=2):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for a in codes:
        for b in codes:
            if a < b and (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {c: find(c) for c in codes}


def test_simhash_equals_brute_force(spark, odd):
    r = random.Random(8)
    base = words(r, 300, [f"x{i}" for i in range(400)]).split()
    near = [(2000 + i, " ".join(w if r.random() > 0.004 else "other" for w in base), "en", "a") for i in range(60)]
    rows = odd + near
    codes = {i: code_of(t) for i, (_, t, _, _) in enumerate(rows)}
    groups = grouped(set(codes.values()))
    least = {}
    for i, c in codes.items():
        key = rows[i][0] if rows[i][0] is not None else float("inf")
        least[groups[c]] = min(least.get(groups[c], float("inf")), key)
    want = sorted(((rows[i][0], f"{c:016x}", least[groups[c]]) for i, c in codes.items()), key=repr)
    got = sorted(map(tuple, simhash.simhash_duplicates(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want and 1 < len({x[2] for x in want if x[0] and x[0] >= 2000}) < 60


def test_simhash_edges(spark):
    assert simhash.simhash_duplicates(frame(spark, [])).count() == 0
    (row,) = simhash.simhash_duplicates(frame(spark, [(None, None, None, None)])).collect()
    assert tuple(row) == (None, "0" * 16, None)


@pytest.mark.parametrize("open_bits", [13, 7, 4])
def test_links_of_crowded_buckets(spark, monkeypatch, open_bits):
    """Codes that fill a cube of nine bits, and others; with small buckets, levels are used to the last."""
    monkeypatch.setattr(simhash, "OPEN", open_bits)
    r = random.Random(open_bits)
    center, places = r.getrandbits(64), r.sample(range(64), 9)
    cube = {center ^ sum(1 << places[b] for b in range(9) if i >> b & 1) for i in r.sample(range(512), 300)}
    codes = sorted(cube | {r.getrandbits(64) for _ in range(300)} | {center ^ (1 << i) ^ (1 << j) ^ (1 << k) for i, j, k in ([r.randrange(64) for _ in range(3)] for _ in range(100))})
    table = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.code_links(table, block=64).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in links:
        root[find(a)] = find(b)
    want = grouped(codes)
    assert len({(find(c), want[c]) for c in codes}) == len({find(c) for c in codes}) == len(set(want.values()))


def test_hashes_in_sql():
    from newsgraph.llm.sql_hash import xxh64

    con = duckdb.connect()
    r = random.Random(2)
    texts = ["", *("".join(r.choice("ab é日") for _ in range(n)) for n in range(1, 90))]
    con.execute("create table u (g varchar)")
    con.executemany("insert into u values (?)", [(t,) for t in texts])
    assert dict(con.execute(f"with {xxh64('u')} select g, h from hashed").fetchall()) == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


def test_masks_leave_few_bits_open_and_one_agrees():
    levels = simhash.masks(2)
    assert all(64 - m.bit_count() <= simhash.OPEN for m in levels[-1])
    r = random.Random(1)
    for _ in range(200):
        d = sum(1 << b for b in r.sample(range(64), 2))
        paths = [0]
        for level in levels:
            paths = [p * 3 + j for p in paths for j in range(3) if not d & level[p * 3 + j]]
            assert paths


def test_whole_groups_are_pruned():
    r = np.random.default_rng(3)
    codes = np.sort(r.integers(0, 2**63, 4096).astype(np.uint64))
    index = simhash.GrayIndex(codes, np.arange(4096) == 0)
    a, b = index.near(0, 4096, 20)
    want = {(i, j) for i in range(0, 4096, 97) for j in range(i + 1, 4096) if int(codes[i] ^ codes[j]).bit_count() <= 20}
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i % 97 == 0} == want


def ranked(docs, items, k=10):
    texts = [(i, Counter(TERMS.findall(lower(t)))) for i, t, _, _ in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, size = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        hits = []
        for i, c, n in texts:
            m = 25 + (75 * n * n_docs) // size
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in Counter(TERMS.findall(lower(text))).items() if c[t])
            if score > 0:
                hits.append((-score, i if i is not None else float("inf")))
        out += [(item, rank, i if i != float("inf") else None, -s) for rank, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **given):
    rows = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, lexical.ranked_search(frame(spark, docs), rows, **given).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, odd, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "PASS", 400)
        monkeypatch.setattr(lexical, "WORDS", 20)
    r = random.Random(4)
    vocabulary = sorted({w for _, t, _, _ in odd[:100] for w in (t or "").split()})
    items = [(i, words(r, r.randint(1, 25), vocabulary)) for i in range(25)] + [(50, None), (51, ""), (52, "--- ?"), (53, "nowhere"), (54, "One one TWO"), (55, "É é ß"), (7, words(r, 5, vocabulary))]
    assert searched(spark, odd, items, full=30 if small else 8192) == ranked(odd, items)


def test_search_edges(spark, odd):
    assert searched(spark, [], [(1, "one")]) == searched(spark, odd, []) == searched(spark, [(1, None, "en", "a")], [(1, "one")]) == []


def test_bounds_hold_and_prune():
    """No vector below a node has a larger product than the node's bound; most leaves are left unread."""
    r = np.random.default_rng(6)
    subject = r.integers(0, 8, 4000)
    entries = [np.unique(s * 50 + r.integers(0, 50, 12)) for s in subject]
    at = np.concatenate([[0], np.cumsum([len(x) for x in entries])])
    term = np.concatenate(entries)
    value = r.integers(1, 10**9, len(term))
    tree = lexical.BallTree(at, term, value, 400)
    asked = np.zeros((8, 400), np.int64)
    for q in range(8):
        asked[q, q * 50 + r.integers(0, 50, 10)] = 1
    bound = tree.bounds(asked)
    dense = np.zeros((4000, 400), np.int64)
    dense[np.repeat(np.arange(4000), np.diff(at)), term] = value
    scores = dense[tree.order] @ asked.T
    for node, (lo, hi, *_) in enumerate(tree.nodes):
        assert (scores[lo:hi].max(axis=0) <= bound[node]).all()
    for q in range(8):
        best = []
        read = tree.search(asked[q], bound[:, q], tree.order, best, 10)
        assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in zip(tree.order.tolist(), scores[:, q], strict=True)), reverse=True)[:10]
        assert read < (tree.nodes[:, 3] < 0).sum() / 2


def test_queries_cover_their_tables(spark, sf):
    docs = queries.table(spark, sf, "documents").count()
    assert queries.op12_simhash_duplicates(spark, sf).count() == docs
