"""Bucket tables, normalisers, JSON shapes, merges and ingest on small frames."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import documents, events, intel, normalizers, tables, upserts
from newsgraph.streaming import ingest

DAY0 = datetime(2024, 1, 1)


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "id long, v string")
    table = upserts.create_table(rows, "id", 16, f"file://{tmp_path}/t")
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/t").rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([(3, "new"), (500, "more"), (None, "none")], "id long, v string")
    touched = table.upsert(batch, lambda old, new: tables.upsert_overwrite(new, old, "id"))
    after = files()
    assert 0 < len(touched) <= 3
    same = {p for p in before if not any(f"bucket={b}/" in str(p) for b in touched)}
    assert same and all(after.get(p) == before[p] for p in same) and set(after) != set(before)
    got = {r.id: r.v for r in table.read(spark).collect()}
    assert got == {i: f"v{i}" for i in range(200)} | {3: "new", 500: "more", None: "none"}
    assert table.upsert(batch.limit(0), lambda old, new: new) == [] and files() == after


def test_a_failing_merge_leaves_the_table_as_it_was(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    table = upserts.create_table(rows, "id", 4, f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="bad batch"):
        table.upsert(rows, lambda old, new: old.unionByName(new.withColumn("v", F.raise_error(F.lit("bad batch")).cast("string"))))
    assert sorted(map(tuple, table.read(spark).select("id", "v").collect())) == [(1, "a"), (2, "b")]


def test_topics_keep_the_order_of_aliases_and_the_last_vector(spark):
    old = spark.createDataFrame([("C1", ["s0"], ["b"], [9.0], datetime(2024, 1, 5)), ("C3", ["z"], [], None, DAY0)], "cve_id string, slugs array<string>, aliases array<string>, embedding array<double>, updated_at timestamp")
    found = spark.createDataFrame([("C1", "s2", datetime(2024, 1, 3), ["c", "b"], [2.0]), ("C1", "s1", datetime(2024, 1, 2), ["a"], [1.0]), ("C1", "s3", datetime(2024, 1, 4), None, None), ("C2", "s1", DAY0, None, None)], "cve_id string, slug string, published_at timestamp, aliases array<string>, embedding array<double>")
    got = {r.cve_id: (r.slugs, r.aliases, r.embedding, r.updated_at) for r in upserts.merge_cve_topics(old, found).collect()}
    assert got == {"C1": (["s0", "s1", "s2", "s3"], ["b", "a", "c"], [2.0], datetime(2024, 1, 5)), "C2": (["s1"], [], None, DAY0), "C3": (["z"], [], None, DAY0)}


def test_normalisers_by_source(spark):
    entries = [("adv", "A &amp; B", "https://x/advisories/icsa-24-001-01", "1", "<p>CVE-2024-1234 CVSS:3.1/AV:N/AC:L</p>"), ("news", "N", "http://n", "", "<p>never read</p>"), ("odd", "O", "http://o", None, "text"), ("none", "X", "http://x", None, None), ("adv", "", "http://gone", None, "x")]
    frame = spark.createDataFrame([(*e, "me", ["t"], None) for e in entries], "source_name string, title string, link string, id string, description string, author string, tags array<string>, published string")
    sources = spark.createDataFrame([("adv", "cisa_advisory"), ("news", "cisa_news"), ("odd", "no such")], "source_name string, normalizer string")
    for c, v in (("severity", "low"), ("type", "t"), ("category", "c"), ("credibility_weight", 1.5)):
        sources = sources.withColumn(c, F.lit(v))
    got = {r.source_name: r for r in normalizers.normalize_by_source(frame, sources).collect()}
    assert set(got) == {"adv", "news", "odd", "none"}
    a, n, o = got["adv"], got["news"], got["odd"]
    assert (a.title, a.author, a.cve_ids, a.cvss_vector, a.tags, a.normalizer) == ("A & B", "CISA", ["CVE-2024-1234"], "CVSS:3.1/AV:N/AC:L", [], "cisa_advisory") and a.advisory_id.lower() == "icsa-24-001-01"
    assert (n.author, n.desc, n.content_html, n.guid, n.normalizer) == ("CISA", None, None, "http://n", "cisa_news")
    assert (o.author, o.content_html, o.tags, o.cve_ids, o.normalizer, o.severity) == ("me", "text", ["t"], None, "generic", "low")
    assert (got["none"].normalizer, got["none"].severity) == ("generic", None)


def test_a_new_normaliser_can_be_registered(spark):
    before = dict(normalizers._NORMALIZERS)
    try:
        normalizers.register("mine")(lambda rows: normalizers.cisa_news(rows).withColumn("author", F.lit("me")))
        frame = spark.createDataFrame([("s", "T", "http://l", "", "d", "x", ["t"], None)], "source_name string, title string, link string, id string, description string, author string, tags array<string>, published string")
        sources = spark.createDataFrame([("s", "mine", "low", "t", "c", 1.0)], "source_name string, normalizer string, severity string, type string, category string, credibility_weight double")
        assert [r.author for r in normalizers.normalize_by_source(frame, sources).collect()] == ["me"]
    finally:
        normalizers._NORMALIZERS.clear()
        normalizers._NORMALIZERS.update(before)


def test_json_of_wrong_shape(spark):
    rows = spark.createDataFrame([(1, '{"cveID": 7, "dateAdded": "soon"}'), (2, "[1, 2]"), (3, '{"cveID": "C", '), (4, None), (5, "")], "id int, value string")
    got = {r.id: (r.cve_id, r.added, r.malformed) for r in documents.json_fields(rows, "kev").collect()}
    assert got == {1: ("7", None, False), 2: (None, None, False), 3: (None, None, True), 4: (None, None, False), 5: (None, None, True)}


def test_three_clusters_become_one_through_the_middle(spark):
    """Unions in the survivor's order, vectors weighted by sizes, a signature of all, chains followed."""
    at = lambda d: datetime(2024, 1, d)
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e"), (3, "c")], "cluster_id long, slug string")
    articles = spark.createDataFrame([(s, f"T{s}", f"src{s}", at(i + 1), "x", "news", float(i), 1.0, [f"cve-{s}"] if s in "ad" else []) for i, s in enumerate("abcde")], "slug string, title string, source_name string, published_at timestamp, category string, content_type string, cvss_score double, credibility_weight double, cve_ids array<string>")
    mentions = spark.createDataFrame([("a", "actor", "k1", 0), ("d", "vuln_alias", "v1", 0), ("e", "actor", "k1", 0), ("e", "vendor", "w", 1)], "slug string, type string, normalized_key string, place int")
    vectors = spark.createDataFrame([(s, [float(i), 1.0]) for i, s in enumerate("abcd")], "slug string, vector array<double>")
    built = events.build_clusters(members, articles, mentions, vectors)
    gone = built.filter("cluster_id = 2").withColumns({"cluster_id": F.lit(9).cast("long"), "merged_into": F.lit(2).cast("long"), "state": F.lit("resolved")})
    moved = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, survivor long")
    got = {r.cluster_id: r for r in events.absorb(built.unionByName(gone), moved).collect()}
    one = got[1]
    assert (one.article_ids, one.article_count, one.state, one.cve_ids, one.entity_keys) == (["a", "b", "c", "d", "e"], 5, "confirmed", ["CVE-A", "CVE-D"], ["k1", "v1", "w"])
    assert one.centroid == [round((1.0 * 3 + 3.0 * 1 + 2.0 * 2) / 6, 6), 1.0] and one.label == "Ta" and one.latest_at == at(5) and one.merged_into is None
    # What the signature holds are the entities of type cve; the aliases of all say more than the survivor's own did.
    assert (one.event_signature.vuln_aliases, one.event_signature.primary_actors, one.event_signature.confidence) == (["v1"], ["k1"], "medium")
    assert [(got[i].state, got[i].merged_into) for i in (2, 3, 9)] == [("resolved", 1)] * 3
    assert built.filter("cluster_id = 1").first().event_signature.confidence == "low"


def test_a_batch_that_fails_between_tables_is_repaired(spark, tmp_path):
    schema = "slug string, source_url_hash string, title string, body string, published_at timestamp, source_name string, cve_ids array<string>, cvss_score double"
    rows = lambda *names: spark.createDataFrame([(s, f"h{s}", s, f"about CWE-79 {s}", DAY0, "src", ["CVE-2024-1000"], None) for s in names], schema)
    gazetteer = spark.createDataFrame([("Nobody", "nobody", False)], "name string, normalized_key string, is_alias boolean")
    kev = spark.createDataFrame([("CVE-2024-1000", "Acme")], "cve_id string, vendor string")
    topics = spark.createDataFrame([("CVE-2024-1000", 9.5)], "cve_id string, cvss double")
    folder = f"file://{tmp_path}/t"
    run = lambda batch, n, **given: ingest.write_batch(batch, n, folder, gazetteer, kev, topics, **given)
    count = lambda: [ingest.committed(spark, folder, x).count() for x in ingest.TABLES]
    run(rows("a"), 0)
    assert count() == [1, 3, 1]

    def fail(table):
        raise RuntimeError(table)

    with pytest.raises(RuntimeError, match="articles"):
        run(rows("a", "b"), 1, written_one=fail)
    assert count() == [1, 3, 1] and ingest.commits(spark, folder) == [0]  # nothing of it is seen
    run(rows("a", "b"), 1)
    run(rows("a", "b"), 1)  # a batch that comes again changes nothing
    assert count() == [2, 6, 2] and ingest.commits(spark, folder) == [0, 1]
    assert {(r.slug, r.cvss_score, r.severity) for r in ingest.committed(spark, folder, "articles").collect()} == {("a", 9.5, "critical"), ("b", 9.5, "critical")}
    assert {r.normalized_key for r in ingest.committed(spark, folder, "mentions").collect()} == {"cve-2024-1000", "cwe-79", "acme"}


def test_a_migration_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "id long, v string")
    whole, first = intel.migrate(rows, "id", f"file://{tmp_path}/m", 4)
    assert first == [0, 1, 2, 3] and sorted(map(tuple, whole.collect())) == [(i, f"v{i}") for i in range(100)]
    Path(f"{tmp_path}/m/2/_SUCCESS").unlink()  # the third batch did not end
    again, second = intel.migrate(rows, "id", f"file://{tmp_path}/m", 4)
    assert second == [2] and again.count() == 100 and intel.migrate(rows, "id", f"file://{tmp_path}/m", 4)[1] == []
