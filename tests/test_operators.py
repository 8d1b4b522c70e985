"""Properties of operators on small literal frames."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsgraph import catalog  # noqa: F401
from newsgraph.functions.references import unescape
from newsgraph.operators import clusters, entities, intel, normalize, read, score, search, tables
from newsgraph.registry import ORACLE, QUERIES, Tables
from newsgraph.sources import feeds
from newsgraph.streaming import jobs


def test_insert_new_is_idempotent(spark):
    target = spark.createDataFrame([], "slug string, source_url_hash string, published_at long")
    batch = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3), ("c", None, 4), ("d", None, 5)], target.schema)
    once = tables.insert_new(batch, target)
    assert sorted(r.slug for r in once.collect()) == ["a", "c", "d"]
    assert sorted(map(tuple, tables.insert_new(batch, once).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_write_once_keeps_and_overwrites(spark):
    old = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0)], "id int, made string, price double")
    new = spark.createDataFrame([(1, "y", None), (2, "z", 5.0), (3, "w", 6.0)], old.schema)
    got = {r.id: (r.made, r.price) for r in tables.upsert_write_once(old, new, "id", ["made"], ["price"]).collect()}
    assert got == {1: ("x", 1.0), 2: ("z", 5.0), 3: ("w", 6.0)}


def test_broken_feed_items_cost_only_themselves(spark):
    raw = "<rss><item><title>A</title><link>u</link></item><item><title>B<link></item><item><title>C &amp; D</title><category>x</category></item><item><title>cut"
    got = feeds.read_feed_entries(spark.createDataFrame([("s", raw), ("t", None), ("u", "no feed")], "source_name string, raw_content string")).collect()
    assert {r.title for r in got} >= {"A", "C & D"}


def test_entries_of_odd_texts_equal_sql(spark, tmp_path):
    texts = [None, "", "  ", "\u00a0\u3000", "\n", "a\u00a0", " b\u2009 ", "&lt;", "&amp;lt;", "&&amp;&", "AT&T;", "&#65;", "x" * 493 + "&lt;" + "y" * 9, "x" * 490 + "  \u00a0  y"]
    spark.createDataFrame([(10 * i + k, t) for k in range(4) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["N1_normalize_entries"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE["N1_normalize_entries"]).fetchall())
    entries = spark.createDataFrame([("\u3000a&nbsp;", " http://x ", None), ("&#160;", "http://x", "1"), ("b", "\u00a0", "2")], "title string, link string, id string")
    assert [(r.title, r.guid) for r in normalize.normalize_entries(entries).collect()] == [("a", "http://x")]


def test_excerpt(spark):
    texts = ["A whole sentence that is long enough to stay when the rest is cut away here. And a rest without", "Short rest", "Done."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.clean_excerpt(F.col("t"))).collect()]
    assert got == [texts[0][:76], "Short rest…", "Done."]


def test_spans_join_neighbours_and_split_sentences(spark):
    text = "Red Fox met Red.Fox"
    tokens = [(0, "B-actor", 0.9, 0, 3), (1, "I-actor", 0.8, 4, 7), (2, "O", 0.9, 8, 11), (3, "B-actor", 0.9, 12, 15), (4, "B-actor", 0.9, 16, 19)]
    frame = spark.createDataFrame([("s", i, i, label, p, a, b) for i, label, p, a, b in tokens], "slug string, idx int, word_id int, label string, score double, start int, end int")
    got = {(r.name, r.mentions) for r in entities.assemble_spans(frame, spark.createDataFrame([("s", text)], "slug string, text string")).collect()}
    assert got == {("Red Fox", 1), ("Red", 1), ("Fox", 1)}


def test_short_names_need_their_capitals(spark):
    docs = spark.createDataFrame([("1", "the APT came"), ("2", "an apt name"), ("3", "aptly")], "slug string, text string")
    names = spark.createDataFrame([("APT", "apt", False)], "name string, normalized_key string, is_alias boolean")
    assert [r.slug for r in entities.match_gazetteer(docs, names).collect()] == ["1"]


def test_assignment_equals_one_by_one(spark):
    rnd = random.Random(5)
    n = 40
    edges = {(a, b): rnd.randint(1, 5) / 10 for a in range(n) for b in range(a + 1, min(n, a + 6)) if rnd.random() < 0.4}
    seedable = [rnd.random() < 0.8 for _ in range(n)]
    cluster: dict[int, str | None] = {}
    seeds: list[int] = []
    for b in range(n):
        best = max(((edges[a, b], -a) for a in seeds if (a, b) in edges), default=None)
        cluster[b] = f"{-best[1]:02d}" if best else f"{b:02d}" if seedable[b] else None
        if not best and seedable[b]:
            seeds.append(b)
    rows = spark.createDataFrame([(f"{i:02d}", f"2024-01-01 00:{i:02d}:00", seedable[i]) for i in range(n)], "slug string, p string, may_seed boolean")
    rows = rows.select("slug", F.col("p").cast("timestamp").alias("published_at"), "may_seed").repartition(3, "may_seed")
    links = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", s) for (a, b), s in edges.items()], "earlier string, later string, score double")
    assert {int(r.slug): r.cluster for r in clusters.assign(rows, links).collect()} == cluster


def test_assignment_of_a_long_chain(spark):
    """A chain of 260 articles on one key, each less than 3 days after the one before, and a second key."""
    n, gap = 260, 25
    names = [f"{i * 7919 % 1000:03d}" for i in range(n)]
    keys = [["k"] + (["m", "m2"] if i % 3 == 0 else []) for i in range(n)]
    pairs = {(a, b): len(set(keys[a]) & set(keys[b])) for b in range(n) for a in range(max(0, b - 2), b) if (b - a) * gap < 72}
    want, seeds = {}, set()
    for b in range(n):
        best = max(((pairs[a, b], -a) for a in seeds if (a, b) in pairs), default=None)
        want[names[b]] = names[-best[1]] if best else names[b]
        if not best:
            seeds.add(b)
    rows = spark.createDataFrame([(names[i], i * gap) for i in range(n)], "slug string, h int")
    rows = rows.select("slug", F.expr("timestampadd(HOUR, h, timestamp'2024-01-01 00:00:00')").alias("published_at"), F.lit(True).alias("may_seed"))
    keyed = spark.createDataFrame([(names[i], k) for i in range(n) for k in keys[i]], "slug string, key string")
    assert {r.slug: r.cluster for r in clusters.assign_by_key(rows, keyed, 3).collect()} == want
    links = spark.createDataFrame([(names[a], names[b], float(s)) for (a, b), s in pairs.items()], "earlier string, later string, score double")
    assert {r.slug: r.cluster for r in clusters.assign(rows, links).collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    roots = {r.id: r.root for r in clusters.connected(edges).collect()}
    assert set(roots.values()) == {0, 100} and len(roots) == 53


def test_components_without_rounds(spark, monkeypatch):
    """Few links need no rounds; many are linked within their partitions first, whatever is held at once."""
    edges = [(i, i + 1) for i in range(0, 900)] + [(2000, 2000), (3001, 3000)]
    random.Random(1).shuffle(edges)
    want = {i: 0 for i in range(901)} | {2000: 2000, 3000: 3000, 3001: 3000}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.id: r.root for r in clusters.connected(frame, rounds=0).collect()} == want
    assert {r.id: r.root for r in clusters.connected(frame, few=0).collect()} == want
    assert {r.id: r.root for r in clusters.connected(frame.coalesce(1), rounds=2, few=0).collect()} == want
    names = frame.select(*(F.concat(F.lit("a"), c).alias(c) for c in "ab"))
    assert {r.id: r.root for r in clusters.connected(names).collect()} == {f"a{i}": min(f"a{j}" for j in want if want[j] == root) for i, root in want.items()}
    monkeypatch.setattr(clusters, "FEW", 50)
    parts = pa.table({"a": [x for x, _ in edges], "b": [y for _, y in edges]}).to_batches(7)
    assert {x: y for batch in clusters._forest(iter(parts)) for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)} == want


def test_nearest_over_many_blocks(spark):
    """Blocks follow the counts, with equal vectors that tie; sub-blocks hold fewer rows than ties."""
    rnd = np.random.default_rng(2)
    vectors = rnd.integers(-2, 3, (130, 3)).astype(float) + 0.5
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    want = {q: [int(i) for i in np.lexsort((np.arange(130), -cos[q])) if i != q][:4] for q in range(0, 130, 3)}
    ids = np.arange(130, dtype=np.int64)
    query, found, _ = score._nearest_of_block(ids[::3], unit[::3], ids, unit, 4, queries=7, rows=5)
    assert {q: found[query == q].tolist() for q in want} == want
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
    got: dict[int, list[int]] = {}
    for r in sorted(score.nearest(rows.filter("id % 3 = 0"), rows, 4, block=6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append(r.id)
    assert got == want


def test_calibration_points(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.70, 0.75, 0.785, 0.82, 1.0)], "c double").select(F.round(score.calibrated(F.col("c")), 6)).collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_retry_and_roundup(spark):
    rows = [(1, 0, "2024-01-24 23:59:00", "failed"), (2, 1, "2024-01-24 23:30:00", None), (3, 1, "2024-01-24 22:00:00", "empty"), (4, 3, "2023-01-01 00:00:00", "failed"), (5, 0, "2023-01-01 00:00:00", "ok")]
    frame = spark.createDataFrame(rows, "slug int, tries int, t string, body_quality string").withColumn("tried_at", F.col("t").cast("timestamp"))
    assert sorted(r.slug for r in read.retry_eligible(frame, read.AS_OF).collect()) == [1, 3]
    got = spark.createDataFrame([("The Weekly Recap",), ("A flaw",)], "t string").select(read.is_roundup(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_retry_without_a_last_try(spark):
    frame = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 3, None), (4, None, None)], "slug int, tries int, tried_at timestamp").withColumn("body_quality", F.lit("failed"))
    assert sorted(r.slug for r in read.retry_eligible(frame, read.AS_OF).collect()) == [1, 2, 4]


def test_titles_of_roundups(spark):
    titles = {
        "Patch Tuesday, May": True, "WEEKLY UPDATE 400": True, "⚡ Weekly Recap: more": True, "This Week in Security": True, "[Webinar] How to": True, "SANS Stormcast": True, "CVE landscape of 2025": True,
        "Weekly report of a breach": False, "A newsletter was hacked": False, "Top 10 of flaws": False, "A bulletin on a flaw": False, "webinar software has a flaw": False,
    }
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", read.is_roundup(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == titles


def test_kinds_of_articles_and_clusters(spark):
    rows = [
        ("CISA Adds Three Known Exploited Vulnerabilities", "x", "cisa_advisory", "kev_catalog"), ("politics and graphics", "x", "cisa_advisory", "ics_advisory"), ("a", "Microsoft MSRC", None, "product_advisory"),
        ("a", "NCSC UK", None, "threat_advisory"), ("a", "x", "cisa_news", "threat_advisory"), ("An advisory on scada", "kev feed", None, "news"), (None, None, None, "news"),
    ]
    frame = spark.createDataFrame(rows, "title string, source string, normalizer string, want string")
    assert all(r.got == r.want for r in frame.select("want", read.content_type(F.col("title"), F.col("source"), F.col("normalizer")).alias("got")).collect())
    rows = [("ics_advisory", 2, ["actor"], "advisory"), ("threat_advisory", 1, ["campaign"], "cve_incident"), ("news", 0, ["malware", "actor"], "campaign"), ("news", 0, ["campaign"], "campaign"), (None, 0, None, "research")]
    frame = spark.createDataFrame(rows, "c string, n int, types array<string>, want string")
    assert all(r.got == r.want for r in frame.select("want", read.cluster_type(F.col("c"), F.col("n"), F.col("types")).alias("got")).collect())


def test_signatures(spark):
    rows = [("1", "cve", "c2", 5), ("1", "cve", "c1", 1), ("1", "cve", "c2", 0), ("2", "cve", "c1", 0), ("2", "vuln_alias", "v", 1), ("3", "campaign", "p", 0), ("4", "actor", "a", 0), ("4", "actor", "b", 1)]
    got = {r.slug: r for r in clusters.event_signature(spark.createDataFrame(rows, "slug string, type string, normalized_key string, place int")).collect()}
    assert got["1"].cve_ids == ["c2", "c1"] and [got[k].confidence for k in "1234"] == ["high", "high", "medium", "low"] and got["4"].primary_actors == ["a", "b"]


def test_pairs_without_common_entities(spark):
    """A cluster founded on a vendor alone is scored 0; one without entities counts only at embed 1."""
    left = spark.createDataFrame([("s", "v", "vendor"), ("s", "c", "cve")], "slug string, normalized_key string, type string")
    right = spark.createDataFrame([(1, "v", "vendor"), (2, "c", "cve")], "id int, normalized_key string, type string")
    pairs = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 1.0), ("s", 3, 1.0), ("s", 4, 0.9)], "slug string, id int, embed double")
    got = {r.id: round(r.score, 6) for r in score.pair_scores(pairs, left, right, spark.createDataFrame([], "normalized_key string, idf double")).collect()}
    assert got == {1: 0.0, 2: 0.45, 3: 0.35, 4: 0.0}


def test_catalogue_names(spark):
    raw = '{"objects": [{"type": "tool", "name": "ftp"}, {"type": "tool", "name": "Tool"}, {"type": "intrusion-set", "name": "APT29", "aliases": ["APT29", " Cozy Bear ", "Tool"], "external_references": [{"source_name": "mitre-attack", "external_id": "G0016"}]}, {"type": "malware", "name": "Old", "revoked": true}, {"type": "malware", "name": "New", "aliases": ["a"], "x_mitre_aliases": ["b"]}]}'
    got = {r.name: (r.type, r.external_id, r.aliases) for r in entities.load_attack(spark.createDataFrame([(raw,)], "value string")).collect()}
    assert got == {"Tool": ("tool", None, None), "APT29": ("actor", "G0016", ["Cozy Bear"]), "New": ("malware", None, ["b"])}
    item = lambda v: f'{{"cveID": "CVE-2024-1", "vendorProject": "{v}", "dateAdded": "2024-01-01"}}'
    names = {"Acme Corporation": "Acme Corporation", "Acme, Inc": "Acme,", "Acme Limited": "Acme", "Acme Inc. (EU)": "Acme", " D-Link ": "D-Link", "Foo Co.": "Foo", "Foo Co": "Foo Co"}
    raw = f'{{"vulnerabilities": [{", ".join(map(item, [*names, "X"]))}]}}'
    assert sorted(r.vendor for r in entities.load_kev(spark.createDataFrame([(raw,)], "value string")).collect()) == sorted(names.values())


def test_feeds_of_three_forms(spark):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>A &amp;amp; B</title><link rel='self' href='s'/><link href='u'/><id>i</id><updated>2024</updated><category term='x'/></entry><entry><title>broken</entry></feed>"
    rdf = "<rdf:RDF><item rdf:about='u2'><title>R</title><link>u2</link><dc:date>2023</dc:date></item></rdf:RDF>"
    got = {r.title: r for r in feeds.read_feed_entries(spark.createDataFrame([("a", atom), ("r", rdf)], "source_name string, raw_content string")).collect()}
    assert (got["A &amp; B"].link, got["A &amp; B"].guid, got["A &amp; B"].published, got["A &amp; B"].tags) == ("u", "i", "2024", ["x"]) and (got["R"].link, got["R"].published) == ("u2", "2023")


def test_references(spark):
    texts = ["a &amp;lt; b", "&#8217;&#x1F600;&Eacute;", "R&D &bogus; & &#0; &#xD800;", "&amp", None, "&apos;&nbsp;x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(unescape(F.col("t"))).collect()]
    assert got == ["a &lt; b", "’😀É", "R&D &bogus; & � �", "&amp", None, "'\xa0x"]


def test_fuzzy_terms_equal_all_pairs(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.choice((1, 2, 3, 4, 6, 7, 25, 30)))) for _ in range(250)]
    words += [w[:-2] + rnd.choice("xy") for w in words[:80]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        return row[-1]

    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {(q, w) for q in set(words[::5]) for w in set(words) if abs(len(q) - len(w)) <= 2 and distance(q, w) <= allowed(q)}
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "term string")
    assert {(r.query, r.term) for r in search.fuzzy_terms(frame(words), frame(words[::5])).collect()} == want


def test_short_words_meet_by_what_their_query_allows(spark):
    """Words that have two characters in common are not compared where one edit is allowed, nor any where none is."""
    words = ["".join(w) for n in (1, 2, 4) for w in itertools.product("abcde", repeat=n)]
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    pairs = search.fuzzy_pairs(frame, frame).select("query", "term").distinct()
    sizes = {r.n: r["count"] for r in pairs.groupBy(F.length("query").alias("n")).count().collect()}
    assert (sizes[1], sizes[2]) == (5, 25)
    # Four letters of five: a query meets what has three of its own in order, not all that has two.
    assert sizes[4] < 625 * 80


@pytest.mark.parametrize("name", ["K2_pair_score", "W2_best_candidate", "K5_build", "K6_update"])
def test_texts_are_not_read_for_each_part(spark, sf, name):
    """What is left to do after the tables in the shared folder reads no texts."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan


def test_spans_are_dealt_by_the_number_of_tokens(spark, monkeypatch):
    """More tokens make more tasks, not larger ones; the spans are the same."""
    rows = [(f"s{i}", j, j, "B-tool" if j % 3 else "O", 0.9, 4 * j, 4 * j + 3) for i in range(40) for j in range(10)]
    frame = spark.createDataFrame(rows, "slug string, idx int, word_id int, label string, score double, start long, end long")
    texts = spark.createDataFrame([(f"s{i}", "abc " * 10) for i in range(40)], "slug string, text string")
    whole = sorted(map(tuple, entities.assemble_spans(frame, texts).collect()))
    monkeypatch.setattr(entities, "TOKENS", 30)
    dealt = entities.assemble_spans(frame, texts)
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 40
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(slug#\d+L?, 14\), REPARTITION_BY_NUM", plan)


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    schema = "slug long, category string"
    target = spark.createDataFrame([(1, "old")], schema)
    land = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sorted(map(tuple, jobs.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), target, f"file://{tmp_path}/job").collect()))
    land([(1, "new"), (2, "a"), (2, "a")])
    assert run() == [(1, "old"), (2, "a")]
    land([(2, "b"), (3, "c")])
    assert run() == [(1, "old"), (2, "a"), (3, "c")] == run()


def test_rebuild_skips_steps(spark, sf):
    t = Tables(spark, sf)
    assert list(intel.rebuilt(t, ("entities", "clusters"))) == ["vectors", "epss"]
    whole, part = intel.rebuilt(t)["clusters"].collect(), intel.rebuilt(t, ("entities", "vectors", "epss"))["clusters"].collect()
    assert {(r.cluster, r.article_count) for r in whole} == {(r.cluster, r.article_count) for r in part} and whole
    assert any(r.entity_count for r in whole) and any(r.centroid for r in whole) and all(r.entity_count is r.centroid is r.max_epss is None for r in part)
    with pytest.raises(ValueError, match="no such steps"):
        intel.rebuilt(t, ("all",))


def test_entities_read_the_texts_once(spark, sf):
    """What follows the three sets of entities reads their table and not the texts again."""
    from newsgraph.registry import QUERIES

    plan = QUERIES["N13_entities"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan
