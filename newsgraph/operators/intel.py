"""CVE topics, their sources and exports of what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.operators.clusters import assign_by_key, route
from newsgraph.operators.entities import by_priority, kev_entities, match_gazetteer
from newsgraph.operators.normalize import PATTERNS, extract_ids, normalized_key, url_hash
from newsgraph.operators.normalizers import normalize_by_source
from newsgraph.operators.read import at, feed_order, filter_clusters, is_roundup, with_top_article
from newsgraph.operators.score import mean_vector
from newsgraph.operators.tables import first_by, insert_new, merge_sources, replay_stats, upsert_overwrite, upsert_write_once
from newsgraph.plans.exchange import shared_folder, small, written
from newsgraph.registry import Tables, query
from newsgraph.sources.feeds import read_feed_entries


def cve_keys(articles: DataFrame) -> DataFrame:
    return articles.select("slug", "published_at", F.explode(F.transform("cve_ids", F.upper)).alias("cve_id")).distinct()


def stub_cve_topics(topics: DataFrame, articles: DataFrame, more_than: int = 5) -> DataFrame:
    """New cve_ids of articles that list more than so many, which have no topic yet."""
    many = articles.filter(F.size("cve_ids") > more_than).select(F.explode(F.transform("cve_ids", F.upper)).alias("cve_id")).distinct()
    return many.join(topics, "cve_id", "left_anti")


@query("A10_stubs", "with k as (select distinct upper(unnest(cve_ids)) as cve_id from articles) select cve_id from k where cve_id not in (select cve_id from topics where cvss > 9.5)")
def _(t: Tables) -> DataFrame:
    return stub_cve_topics(t.topics.filter("cvss > 9.5").select("cve_id"), t.articles, 1)


def refresh_epss(topics: DataFrame, epss: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics with the new score where there is one, and the ids that have none."""
    out = topics.join(epss.select("cve_id", F.col("epss").alias("_new")), "cve_id", "left").withColumn("epss", F.coalesce("_new", "epss")).drop("_new")
    return out, topics.select("cve_id").join(epss, "cve_id", "left_anti")


@query("A12_refresh_epss", "select cve_id, case when cvss > 9.7 then 0.5 else epss end as epss, cvss <= 9.7 as missed from topics")
def _(t: Tables) -> DataFrame:
    fresh, missed = refresh_epss(t.topics, t.topics.filter("cvss > 9.7").select("cve_id", F.lit(0.5).alias("epss")))
    return fresh.join(missed.withColumn("m", F.lit(True)), "cve_id", "left").select("cve_id", "epss", F.coalesce("m", F.lit(False)).alias("missed"))


def seed_epss(fresh: DataFrame, topics: DataFrame, epss: DataFrame) -> DataFrame:
    """Only ids without a topic, with their score of birth if there is one."""
    return fresh.join(topics, "cve_id", "left_anti").join(epss, "cve_id", "left")


@query("A11_seed_epss", "with k as (select distinct upper(unnest(cve_ids)) as cve_id from articles) select cve_id, case when cvss > 9 then epss end as epss from k left join topics using (cve_id) where coalesce(cvss, 0) <= 9.7")
def _(t: Tables) -> DataFrame:
    keys = cve_keys(t.articles).select("cve_id").distinct()
    return seed_epss(keys, t.topics.filter("cvss > 9.7"), t.topics.filter("cvss > 9").select("cve_id", "epss"))


@query("A14_kev_flags", "select cve_id, case when cvss > 9.8 then date '2023-05-05' when cvss > 9.5 then date '2024-01-01' end as kev_added_at, cvss > 9.5 as cisa_kev from topics")
def _(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    topics = t.topics.select("cve_id", F.when(F.col("cvss") > 9.8, day("2023-05-05")).alias("kev_added_at"), F.lit(False).alias("cisa_kev"), "cvss")
    kev = topics.filter("cvss > 9.5").select("cve_id", day("2024-01-01").alias("kev_added_at"), F.lit(True).alias("cisa_kev"))
    return upsert_write_once(topics.drop("cvss"), kev, "cve_id", ["kev_added_at"], ["cisa_kev"])


def load_ransomware(raw: DataFrame, column: str = "value") -> DataFrame:
    """(normalized_key, name, aliases, active) of groups; the last of a key wins, an alias is not the name."""
    rows = raw.select(F.posexplode(F.from_json(column, "array<struct<name: string, aliases: array<string>, status: string>>")).alias("at", "x")).select("at", "x.*")
    keyed = rows.filter("trim(name) <> ''").withColumn("normalized_key", normalized_key(F.col("name")))
    last = keyed.groupBy("normalized_key").agg(F.max_by(F.struct("name", "aliases", "status"), "at").alias("x")).select("normalized_key", "x.*")
    other = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) != F.lower("name"))
    return last.select("normalized_key", "name", other.alias("aliases"), F.coalesce(F.lower("status") == "active", F.lit(False)).alias("active"))


@query("A16_ransomware", "select lower(replace(p_brand, '#', '-')) as normalized_key, arg_max(p_size % 2 = 0, p_partkey) as active from part group by 1")
def _(t: Tables) -> DataFrame:
    item = F.struct("p_partkey", F.col("p_brand").alias("name"), F.array("p_brand", F.lit("x")).alias("aliases"), F.when(F.col("p_size") % 2 == 0, "Active").otherwise("gone").alias("status"))
    raw = t.part.groupBy("p_brand").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value"))
    return load_ransomware(raw).select("normalized_key", "active")


def enrich_topics(topics: DataFrame, nvd: DataFrame) -> DataFrame:
    """Topics without nvd_last_modified, with what the landed lookup says about each."""
    backlog = topics.filter(F.col("nvd_last_modified").isNull()).drop("cvss").join(nvd, "cve_id", "left")
    status = (
        F.when(~F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,7}$"), "Invalid").when(F.lower("vuln_status") == "rejected", "Rejected").when(F.lower("vuln_status") == "reserved", "Reserved")
        .when(F.col("cvss").isNull(), "Pending NVD").otherwise("Enriched")
    )
    return backlog.select("cve_id", "cvss", status.alias("status"))


@query(
    "A19_enrich",
    "select cve_id, case when m < 3 then cvss end as cvss, case when m = 0 then 'Rejected' when m = 1 then 'Reserved' when m = 3 then 'Pending NVD' else 'Enriched' end as status from (select *, right(cve_id, 1)::int % 4 as m from topics) z where right(cve_id, 1) <> '9'",
)
def _(t: Tables) -> DataFrame:
    m = F.right("cve_id", F.lit(1)).cast("int") % 4
    topics = t.topics.withColumn("nvd_last_modified", F.when(F.right("cve_id", F.lit(1)) == "9", "2024"))
    nvd = t.topics.filter(m < 3).select("cve_id", "cvss", F.when(m == 0, "Rejected").when(m == 1, "Reserved").otherwise("Analyzed").alias("vuln_status"))
    return enrich_topics(topics, nvd)


#: Kinds of entities that are exported, and their names in STIX.
STIX = {"cve": "vulnerability", "actor": "threat-actor", "malware": "malware", "tool": "tool"}


def export_stix(entities: DataFrame, as_of: str, since: Column | None = None, until: Column | None = None, most: int = 500) -> DataFrame:
    """(id, object): STIX 2.1 objects of the entities last seen, at most so many of all kinds, of which
    four are exported: CVEs with their reference, actors of unknown type, malware families, tools.
    Of a period: last seen after its begin and first seen before its end. Null names go."""
    kind = F.create_map(*(F.lit(x) for pair in STIX.items() for x in pair))[F.col("type")]
    rows = entities if since is None else entities.filter(F.col("last_seen") >= since)
    rows = rows if until is None else rows.filter(F.col("first_seen") <= until)
    rows = rows.orderBy(F.desc("last_seen"), "normalized_key").limit(most).withColumn("kind", kind).filter("kind is not null and name is not null")
    digits = F.sha2(F.concat_ws("|", "kind", "normalized_key"), 256)
    ident = F.concat("kind", F.lit("--"), F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    given = F.lit(as_of)
    extra = [
        F.when(F.col("type") == "cve", F.array(F.struct(F.lit("cve").alias("source_name"), F.col("name").alias("external_id")))).alias("external_references"),
        F.when(F.col("type") == "actor", F.array(F.lit("unknown"))).alias("threat_actor_types"),
        F.when(F.col("type") == "malware", F.lit(True)).alias("is_family"),
    ]
    whole = F.struct(F.col("kind").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), given.alias("created"), given.alias("modified"), "name", *extra)
    return rows.select(ident.alias("id"), F.to_json(whole).alias("object"))


@query(
    "A23_stix",
    """with s as (select normalized_key, min(type) as type, min(name) as name, min(published_at) as first_seen, max(published_at) as last_seen from mentions group by 1),
    t as (select * from s where last_seen >= timestamp '2024-01-10' and first_seen <= timestamp '2024-01-20' order by last_seen desc, normalized_key limit 500),
    k as (select *, case type when 'cve' then 'vulnerability' when 'actor' then 'threat-actor' else type end as kind from t where type in ('cve', 'actor', 'malware', 'tool')),
    i as (select *, sha256(kind || '|' || normalized_key) as d from k), j as (select *, kind || '--' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] as id from i)
    select id, '{"type":"' || kind || '","spec_version":"2.1","id":"' || id || '","created":"2024-01-25T00:00:00Z","modified":"2024-01-25T00:00:00Z","name":' || to_json(name) ||
      case type when 'cve' then ',"external_references":[{"source_name":"cve","external_id":' || to_json(name) || '}]' when 'actor' then ',"threat_actor_types":["unknown"]' when 'malware' then ',"is_family":true' else '' end || '}' as object from j""",
)
def _(t: Tables) -> DataFrame:
    seen = t.mentions.groupBy("normalized_key").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    return export_stix(seen, "2024-01-25T00:00:00Z", at("2024-01-10"), at("2024-01-20"))


@query("A25_backup", "select id, state, category from clusters")
def _(t: Tables) -> DataFrame:
    """Clusters written as line-JSON and read back with their schema."""
    rows = t.clusters.select("id", "state", "category")
    path = written(rows.limit(0)).inputFiles()[0].rsplit("/", 1)[0] + "-backup"
    rows.write.json(path)
    return t.spark.read.schema(rows.schema).json(path)


def migrate(source: DataFrame, key: str, folder: str, batches: int = 8) -> tuple[DataFrame, list[int]]:
    """A table moved to another one that is keyed by slug, in batches by a hash of the key, and the batches
    that this run has moved. A batch is a folder that is complete once its writer has ended; what a run
    before has completed is left alone, so one that broke off goes on where it ended."""
    spark = source.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda i: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}/_SUCCESS"))
    rows = source.withColumnRenamed(key, "slug")
    moved = [i for i in range(batches) if not done(i)]
    for i in moved:
        rows.filter(F.pmod(F.xxhash64("slug"), F.lit(batches)) == i).write.mode("overwrite").parquet(f"{folder}/{i}")
    return spark.read.schema(rows.schema).parquet(*(f"{folder}/{i}" for i in range(batches))), moved


@query("A26_migrate", "select p_partkey as slug, p_name, p_size from part")
def _(t: Tables) -> DataFrame:
    return migrate(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey", shared_folder(t.spark))[0]


@query("A29_copy_fields", "select cve_id, coalesce(case when cvss > 9.7 then 1.0 end, cvss) as cvss from topics")
def _(t: Tables) -> DataFrame:
    """CVE fields of entities go to topics that lack them; names that are no CVE do not."""
    entities = t.topics.select(F.col("cve_id").alias("name"), "cvss").unionByName(t.topics.select(F.concat(F.lit("x"), "cve_id").alias("name"), "cvss"))
    fields = entities.filter(F.upper("name").rlike(r"^CVE-\d{4}-\d{4,7}$")).select(F.upper("name").alias("cve_id"), F.col("cvss").cast("double").alias("cvss"))
    return upsert_write_once(t.topics.select("cve_id", F.when(F.col("cvss") > 9.7, F.lit(1.0)).alias("cvss")), fields, "cve_id", ["cvss"], [])


@query("C6_entities_with_cvss", "with k as (select distinct upper(unnest(cve_ids)) as cve_id from articles) select cve_id, cvss from k left join topics using (cve_id)")
def _(t: Tables) -> DataFrame:
    return t.articles.select(F.explode("cve_ids").alias("name")).select(F.upper("name").alias("cve_id")).distinct().join(t.topics.select("cve_id", "cvss"), "cve_id", "left")


@query(
    "S5_home_feed",
    """with c as (select cluster_id as id, arg_min(slug, struct_pack(p := place, s := slug)) as slug, count(*) as n from members group by 1)
    select id, slug from c join clusters using (id) join part on p_partkey = slug where p_size < 40 and category = '1-URGENT' and id in (select cluster_id from members join part on p_partkey = slug where p_size > 20) order by n desc, latest_at desc, id limit 30""",
)
def _(t: Tables) -> DataFrame:
    """One plan: clusters of a category with a member on the topic and a top article of an allowed
    type, filtered before the page is cut."""
    topic = t.members.join(t.part.filter("p_size > 20").select(F.col("p_partkey").alias("slug")), "slug", "left_semi").select(F.col("cluster_id").alias("id"))
    counts = t.members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("article_count"))
    kept = filter_clusters(t.clusters, "1-URGENT").join(topic, "id", "left_semi").join(counts, "id")
    top = with_top_article(kept, t.members, t.part.filter("p_size < 40").select(F.col("p_partkey").alias("slug")))
    return feed_order(top, "coverage").limit(30).select("id", "slug")


#: Characters of text below which a body is a teaser, or partial.
TEASER, PARTIAL = 100, 1500


def replay(snapshots: DataFrame, sources: DataFrame, target: DataFrame, mode: str = "insert") -> tuple[DataFrame, DataFrame]:
    """The target with the articles of archived feeds, written, and the seven counts of replay_stats() by source.

    Entries go through the normaliser of their source. insert: what has a slug and an address that are
    new is added, the rest is skipped; overwrite: what has a slug that is there replaces it, and
    nothing is skipped. Of entries with one slug the first by address is written. An entry without a
    title or a link is an error; feeds of sources that are not known are not replayed. target: slug,
    source_url_hash, source_name, title, body.
    """
    if mode not in ("insert", "overwrite"):
        raise ValueError(f"no such mode: {mode}")
    known = snapshots.join(small(sources.select("source_name")), "source_name", "left_semi")
    entries = read_feed_entries(known).withColumnRenamed("guid", "id").withColumn("author", F.lit(None).cast("string"))
    text = F.coalesce("content_html", F.lit(""))
    ready = normalize_by_source(entries, sources).withColumns({"source_url_hash": url_hash(F.col("source_url")), "body": text, "cve_ids": F.coalesce("cve_ids", F.array().cast("array<string>"))})
    ready = written(ready.select("slug", "source_url_hash", "source_name", "title", "body", "cve_ids"))
    rows = ready.select(*target.columns)
    if mode == "insert":
        after = written(insert_new(rows, target, "source_url_hash"))
        fresh = after.join(target.select("slug"), "slug", "left_anti").select("slug", "source_url_hash", F.lit(True).alias("new"))
        # Of rows that are alike one is written.
        first = F.row_number().over(Window.partitionBy("slug", "source_url_hash").orderBy("title")) == 1
        marked = ready.withColumn("first", first).join(fresh, ["slug", "source_url_hash"], "left").withColumn("wrote", F.coalesce("new", F.lit(False)) & F.col("first"))
    else:
        after = written(upsert_overwrite(first_by(rows, "slug", F.col("source_url_hash"), F.col("title")), target, "slug"))
        marked = ready.withColumn("wrote", F.lit(True))
    quality = F.when(F.length("body") < TEASER, "teaser").when(F.length("body") < PARTIAL, "partial").otherwise("ok")
    parsed = marked.select("source_name", F.lit(True).alias("parsed"), quality.alias("body_quality"), (quality == "teaser").alias("is_teaser"), "cve_ids", "wrote")
    counts = replay_stats(parsed).drop("errors", "entries")
    all_of = entries.groupBy("source_name").agg(F.count("*").alias("entries")).join(parsed.groupBy("source_name").agg(F.count("*").alias("good")), "source_name", "left")
    stats = all_of.withColumn("errors", F.col("entries") - F.coalesce("good", F.lit(0))).drop("good").join(counts, "source_name", "left").na.fill(0)
    return after, stats.select("source_name", "entries", "upserted", "skipped", "errors", "teasers", "thin_bodies", "articles_with_cves")


_REPLAY = """select 'src' || (page_id % 20) as source_name, count(*) as entries, {up} as upserted, count(*) filter (page_id % 7 <> 6) - {up} as skipped, count(*) filter (page_id % 7 = 6) as errors, count(*) filter (page_id % 7 <> 6 and page_id % 4 = 0) as teasers,
    count(*) filter (page_id % 7 <> 6 and page_id % 4 < 2) as thin_bodies, count(*) filter (page_id % 7 <> 6 and page_id % 20 in (1, 2)) as articles_with_cves from pages where page_id % 20 <> 5 group by 1"""


def _replayed(t: Tables, mode: str) -> tuple[DataFrame, DataFrame]:
    """A third of the entries is there already; some have no title; one source is unknown."""
    k = F.col("page_id")
    title = F.when(k % 7 == 6, "").otherwise(F.concat(F.lit("Page "), k))
    body = F.concat(F.lit("CVE-2024-1234 "), F.repeat(F.lit("x"), F.when(k % 4 == 0, 20).when(k % 4 == 1, 200).otherwise(2000)))
    raw = F.concat(F.lit("<rss><item><title>"), title, F.lit("</title><link>http://x/"), k, F.lit("</link><description>"), body, F.lit("</description></item></rss>"))
    snapshots = t.pages.select("page_id", F.concat(F.lit("src"), k % 20).alias("source_name"), raw.alias("raw_content"))
    names = snapshots.select("source_name").distinct().filter("source_name <> 'src5'")
    kind = F.when(F.col("source_name").isin("src1", "src2"), "cisa_advisory").otherwise("generic")
    sources = names.select("source_name", kind.alias("normalizer"), F.lit("low").alias("severity"), F.lit("news").alias("type"), F.lit("x").alias("category"), F.lit(1.0).alias("credibility_weight"))
    empty = t.pages.limit(0).select(*(F.lit("").alias(c) for c in ("slug", "source_url_hash", "source_name", "title", "body")))
    target, _ = replay(snapshots.filter("page_id % 3 = 0"), sources, empty)
    return replay(snapshots, sources, target.withColumn("body", F.lit("old")), mode)


@query("A4_replay", _REPLAY.format(up="count(*) filter (page_id % 3 > 0 and page_id % 7 <> 6)"))
def _(t: Tables) -> DataFrame:
    return _replayed(t, "insert")[1]


@query("A4_overwrite", _REPLAY.format(up="count(*) filter (page_id % 7 <> 6)"))
def _(t: Tables) -> DataFrame:
    return _replayed(t, "overwrite")[1]


@query("A4_replayed", "select m as mode, count(*) as n, count(*) filter (m = 'insert' and page_id % 3 = 0) as old from pages, (values ('insert'), ('overwrite')) v(m) where page_id % 20 <> 5 and page_id % 7 <> 6 group by 1")
def _(t: Tables) -> DataFrame:
    """How many articles there are after each way, and how many still have the old body."""
    one, two = (_replayed(t, m)[0].withColumn("mode", F.lit(m)) for m in ("insert", "overwrite"))
    return one.unionByName(two).groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("body") == "old").alias("old"))


def extract_entities(articles: DataFrame, gazetteer: DataFrame, kev: DataFrame) -> DataFrame:
    """(slug, normalized_key, rank, sources) from title, body and CVEs of articles.

    Ids of CVEs, weaknesses and techniques come first, then the catalogue's vendors of the CVEs,
    then names of the gazetteer (an alias under the key that it stands for); of keys where one
    begins the other the earlier set counts. sources: all sets that have the key.
    """
    text = F.concat_ws(" ", "title", "body", F.array_join("cve_ids", " "))
    docs = articles.select("slug", text.alias("text"))
    ids = F.flatten(F.array(*(extract_ids(F.col("text"), PATTERNS[kind]) for kind in ("cve", "cwe", "technique"))))
    rows = [
        docs.select("slug", F.explode(F.array_distinct(F.transform(ids, lambda x: F.lower(x)))).alias("normalized_key")),
        kev_entities(articles, kev).select("slug", "normalized_key"),
        match_gazetteer(docs, gazetteer).select("slug", "normalized_key").distinct(),
    ]
    ranked = [d.withColumn("rank", F.lit(i)) for i, d in enumerate(rows)]
    # Written, as the sets are read several times and the texts are to be read once for each.
    found = written(ranked[0].unionByName(ranked[1]).unionByName(ranked[2]))
    sourced = [found.filter(F.col("rank") == i).select("slug", "normalized_key", F.array(F.lit(name)).alias("sources")) for i, name in enumerate(("ids", "catalogue", "names"))]
    sources = merge_sources(merge_sources(sourced[0], sourced[1]), sourced[2])
    return by_priority(found).join(sources, ["slug", "normalized_key"])


@query(
    "N13_entities",
    r"""with a as (select slug, cve_ids, case when doc_id % 4 = 0 then body || ' CWE-79 (T1059.001), cwe-22 CVE-2024-77777' else body end as body, title from articles),
    x as (select slug, cve_ids, concat_ws(' ', title, body, array_to_string(cve_ids, ' ')) as text from a),
    i as (select slug, lower(unnest(regexp_extract_all(text, 'CVE-\d{4}-\d{4,}') || regexp_extract_all(text, '(?i)\bCWE-\d+\b') || regexp_extract_all(text, '\bT1[0-6]\d{2}(?:\.\d{3})?\b'))) as k from x),
    v as (select distinct slug, lower(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g'), '-')) as k from (select slug, upper(unnest(cve_ids)) as c from a) join part on c = 'CVE-2024-' || (1000 + cast(floor(p_partkey / 40) as int)) where p_size < 3),
    g as (select distinct array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')[1:2], ' ') as name from benchmark),
    n as (select distinct slug, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as k from x, g where contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), ' ') || ' ', ' ' || lower(name) || ' ')),
    u as (select slug, k, 0 as rank, 'ids' as s from i union all select slug, k, 1, 'catalogue' from v union all select slug, k, 2, 'names' from n),
    d as (select slug, k, min(rank) as rank, string_agg(distinct s, ',' order by s) as sources from u group by 1, 2)
    select slug, k as normalized_key, rank, sources from d where not exists (select 1 from d e where e.slug = d.slug and e.rank < d.rank and starts_with(e.k, d.k || '-'))""",
)
def _(t: Tables) -> DataFrame:
    rows = t.articles.withColumn("body", F.when(F.col("doc_id") % 4 == 0, F.concat("body", F.lit(" CWE-79 (T1059.001), cwe-22 CVE-2024-77777"))).otherwise(F.col("body")))
    kev = t.part.filter("p_size < 3").select(F.concat(F.lit("CVE-2024-"), 1000 + F.floor(F.col("p_partkey") / 40)).alias("cve_id"), F.col("p_brand").alias("vendor"))
    name = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), 1, 2), " ")
    gazetteer = t.benchmark.select(name.alias("name")).distinct().select("name", normalized_key(F.col("name")).alias("normalized_key"), F.lit(True).alias("is_alias"))
    return extract_entities(rows, gazetteer, kev).withColumn("sources", F.array_join("sources", ","))


STEPS = ("entities", "vectors", "epss", "clusters")


def rebuild(articles: DataFrame, gazetteer: DataFrame, kev: DataFrame, embeddings: DataFrame, epss: DataFrame, skip: tuple[str, ...] = (), days: int = 2) -> dict[str, DataFrame]:
    """The steps of a full rebuild in order, by name, but for those to skip; what a skipped step would
    have given is null in the clusters.

    entities: extract_entities(); vectors: (slug, embedding); epss: (cve_id, epss); clusters: the
    articles that take the full route placed by their CVEs in order of publication, with counts,
    entities, mean vector and largest EPSS of the members. An unknown step is an error.
    """
    if unknown := set(skip) - set(STEPS):
        raise ValueError(f"no such steps: {sorted(unknown)}")
    out: dict[str, DataFrame] = {}
    if "entities" not in skip:
        out["entities"] = written(extract_entities(articles, gazetteer, kev))
    if "vectors" not in skip:
        out["vectors"] = embeddings.select(F.concat(F.lit("a"), "vec_id").alias("slug"), "embedding")
    if "epss" not in skip:
        out["epss"] = epss.groupBy("cve_id").agg(F.max("epss").alias("epss"))
    if "clusters" not in skip:
        full = articles.filter(route(F.col("content_type"), is_roundup(F.col("title"))) == "full")
        keyed = cve_keys(full).select("slug", F.col("cve_id").alias("key")).distinct()
        placed = written(assign_by_key(full.select("slug", "published_at", F.lit(True).alias("may_seed")), keyed, days).filter("cluster is not null"))
        found = placed.join(articles, "slug").groupBy("cluster").agg(F.count("*").alias("article_count"), F.count_distinct("source_name").alias("source_count"), F.max("published_at").alias("latest_at"))
        none = placed.limit(0).select("cluster")
        named = placed.join(out["entities"], "slug").groupBy("cluster").agg(F.count_distinct("normalized_key").alias("entity_count")) if "entities" in out else none.withColumn("entity_count", F.lit(0).cast("long"))
        vectors = mean_vector(placed.join(out["vectors"], "slug"), "cluster").select("cluster", "centroid") if "vectors" in out else none.withColumn("centroid", F.array().cast("array<double>"))
        scored = placed.join(keyed, "slug").join(out["epss"], F.col("key") == F.col("cve_id")).groupBy("cluster").agg(F.max("epss").alias("max_epss")) if "epss" in out else none.withColumn("max_epss", F.lit(0.0))
        out["clusters"] = found.join(named, "cluster", "left").join(vectors, "cluster", "left").join(scored, "cluster", "left")
    return out


def rebuilt(t: Tables, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    kev = t.part.filter("p_size < 3").select(F.concat(F.lit("CVE-2024-"), 1000 + F.floor(F.col("p_partkey") / 40)).alias("cve_id"), F.col("p_brand").alias("vendor"))
    name = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), 1, 2), " ")
    gazetteer = t.benchmark.select(name.alias("name")).distinct().select("name", normalized_key(F.col("name")).alias("normalized_key"), F.lit(True).alias("is_alias"))
    return rebuild(t.articles, gazetteer, kev, t.embeddings, t.topics.select("cve_id", F.col("epss").cast("double").alias("epss")), skip)


@query("K13_rebuild")
def _(t: Tables) -> DataFrame:
    """Clusters of a full rebuild; their assignment is checked one by one in the tests."""
    return rebuilt(t)["clusters"].withColumn("centroid", F.size("centroid"))
