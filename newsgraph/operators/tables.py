"""Archives, upserts, loads and exports of tables (A), set operations (U) and joins that write.

Upserts return the new version of the target. A caller writes it to a new place; reading and
overwriting one path in a job is not safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.plans.exchange import shared_folder
from newsgraph.registry import Tables, query

PRIORITY = ("attack", "ransomware", "kev", "manual")


def archive_snapshots(new: DataFrame, archive: DataFrame) -> DataFrame:
    """The archive with each payload that it lacks, once, known by its SHA-256."""
    hashed = new.withColumn("content_hash", F.sha2("raw_content", 256))
    first = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*new.columns), F.struct("fetched_at", "source_name")).alias("x")).select("content_hash", "x.*")
    return archive.unionByName(first.join(archive, "content_hash", "left_anti"))


@query("A2_archive", "select sha256(text) as content_hash, count(*) > 0 as present from documents group by 1")
def _(t: Tables) -> DataFrame:
    new = t.documents.select(F.col("source").alias("source_name"), F.col("text").alias("raw_content"), F.col("doc_id").alias("fetched_at"))
    half = archive_snapshots(new.filter("fetched_at % 2 = 0"), new.limit(0).withColumn("content_hash", F.lit("")))
    return archive_snapshots(new, half).select("content_hash", F.lit(True).alias("present"))


def scan_snapshots(archive: DataFrame, source: str | None = None, content_hash: str | None = None) -> DataFrame:
    out = archive if source is None else archive.filter(F.col("source_name") == source)
    return (out if content_hash is None else out.filter(F.col("content_hash") == content_hash)).orderBy("fetched_at")


@query("A3_scan", "select doc_id as fetched_at, sha256(text) as content_hash from documents where source = 'src8'")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("source_name"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("fetched_at"))
    return scan_snapshots(rows, "src8").select("fetched_at", "content_hash")


def first_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    named = F.struct(*rows.columns)
    some = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(named, F.struct(*order)).alias("_x")).select("_x.*")
    return some.unionByName(rows.filter(F.col(key).isNull()))


def insert_new(batch: DataFrame, target: DataFrame, order: str = "published_at") -> DataFrame:
    """Target with the rows of the batch whose slug and whose source_url_hash are both new."""
    once = batch
    for key in ("slug", "source_url_hash"):
        once = first_by(once, key, F.col(order), F.col("slug"))
        once = once.join(target.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return target.unionByName(once.select(*target.columns))


@query(
    "A5_insert_new",
    """with r as (select 'p' || page_id as slug, left(sha256(regexp_replace(url, '[?#].*$', '')), 16) as source_url_hash, page_id as published_at from pages),
    old as (select * from r where published_at % 3 = 0), o as (select * from old qualify row_number() over (partition by source_url_hash order by published_at, slug) = 1),
    n as (select * from r qualify row_number() over (partition by source_url_hash order by published_at, slug) = 1)
    select * from o union all select * from n where slug not in (select slug from o) and source_url_hash not in (select source_url_hash from o)""",
)
def _(t: Tables) -> DataFrame:
    url_hash = F.substring(F.sha2(F.regexp_replace("url", "[?#].*$", ""), 256), 1, 16)
    rows = t.pages.select(F.concat(F.lit("p"), "page_id").alias("slug"), url_hash.alias("source_url_hash"), F.col("page_id").alias("published_at"))
    old = insert_new(rows.filter("published_at % 3 = 0"), rows.limit(0))
    return insert_new(rows, old)


def upsert_overwrite(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return target.join(batch, key, "left_anti").unionByName(batch.select(*target.columns))


def upsert_write_once(target: DataFrame, batch: DataFrame, key: str, immutable: list[str], mutable: list[str]) -> DataFrame:
    """Immutable fields keep what they have; mutable ones take what the batch gives."""
    t, b = target.alias("t"), batch.alias("b")
    joined = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    both = lambda c, x, y: F.coalesce(F.col(f"{x}.{c}"), F.col(f"{y}.{c}")).alias(c)
    return joined.select(both(key, "t", "b"), *(both(c, "t", "b") for c in immutable), *(both(c, "b", "t") for c in mutable))


@query(
    "A7_write_once",
    """select coalesce(a.p_partkey, b.p_partkey) as id, coalesce(a.p_brand, b.p_type) as made, coalesce(b.p_retailprice, a.p_size) as price
    from (select * from part where p_size < 30) a full join (select * from part where p_size > 20) b using (p_partkey)""",
)
def _(t: Tables) -> DataFrame:
    old = t.part.filter("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("made"), F.col("p_size").cast("double").alias("price"))
    new = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("made"), F.col("p_retailprice").alias("price"))
    return upsert_write_once(old, new, "id", ["made"], ["price"])


def merge_gazetteer(target: DataFrame, batch: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Per key the row of the best source; of equals, that of the batch. last_synced always moves on."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    best = both.groupBy("normalized_key").agg(F.max_by(F.struct(*target.columns), F.struct(rank, "_new", "display_name")).alias("x"), F.max("last_synced").alias("synced"))
    return best.select("x.*", "synced").withColumn("last_synced", F.col("synced")).drop("synced")


@query(
    "A17_merge_gazetteer",
    """with r as (select p_brand as normalized_key, p_name as display_name, ['attack', 'ransomware', 'kev', 'manual'][1 + p_size % 4] as source, p_partkey as last_synced, p_size % 4 as rank, case when p_size > 25 then 1 else 0 end as new from part),
    o as (select *, 0 as n from r where new = 0), x as (select * from r)
    select normalized_key, arg_max(display_name, struct_pack(a := rank, b := new, c := display_name)) as display_name, arg_max(source, struct_pack(a := rank, b := new, c := display_name)) as source, max(last_synced) as last_synced from x group by 1""",
)
def _(t: Tables) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, PRIORITY)), F.col("p_size") % 4 + 1)
    rows = t.part.select(F.col("p_brand").alias("normalized_key"), F.col("p_name").alias("display_name"), source.alias("source"), F.col("p_partkey").alias("last_synced"), "p_size")
    return merge_gazetteer(rows.filter("p_size <= 25").drop("p_size"), rows.filter("p_size > 25").drop("p_size"))


def export_csv(articles: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as strings, lists joined by a semicolon: write with option header."""
    kinds = dict(articles.dtypes)
    return articles.select(*((F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in columns))


@query("A21_csv", "select slug, array_to_string(raw_tags, ';') as raw_tags, array_to_string(cve_ids, ';') as cve_ids from articles")
def _(t: Tables) -> DataFrame:
    return export_csv(t.articles, ["slug", "raw_tags", "cve_ids"])


@query("A22_json", "select slug, title from articles order by published_at desc, slug limit 1000")
def _(t: Tables) -> DataFrame:
    return export_json(t.articles.select("slug", "title", "published_at")).select("slug", "title")


def export_json(articles: DataFrame, most: int = 1000) -> DataFrame:
    return articles.orderBy(F.desc("published_at"), "slug").limit(most)


def _escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _element(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.coalesce(_escaped(c), F.lit("")), F.lit(f"</{name}>"))


def _rfc_2822(c: Column) -> Column:
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def export_rss(articles: DataFrame) -> DataFrame:
    """One escaped <item> for each article (slug, title, source_url, desc, published_at, author,
    raw_tags), a <category> for each tag; what is null is empty."""
    guid = F.concat(F.lit('<guid isPermaLink="false">'), _escaped(F.col("slug")), F.lit("</guid>"))
    tags = F.array_join(F.transform(F.coalesce("raw_tags", F.array().cast("array<string>")), lambda x: _element("category", x)), "")
    parts = [_element("title", F.col("title")), _element("link", F.col("source_url")), guid, _element("description", F.col("desc")), _element("pubDate", _rfc_2822(F.col("published_at"))), _element("author", F.col("author")), tags]
    return articles.select("slug", F.concat(F.lit("<item>"), *parts, F.lit("</item>")).alias("item"))


def rss_channel(articles: DataFrame, title: str, link: str, as_of: Column, most: int = 20) -> DataFrame:
    """One row, the RSS 2.0 document of the newest articles (ties by slug)."""
    newest = articles.orderBy(F.desc("published_at"), "slug").limit(most)
    items = export_rss(newest).join(newest.select("slug", "published_at"), "slug").agg(F.collect_list(F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "slug", "item")).alias("items"))
    body = F.array_join(F.transform(F.array_sort("items"), lambda x: x["item"]), "")
    head = [F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), _element("title", F.lit(title)), _element("link", F.lit(link)), _element("language", F.lit("en")), _element("lastBuildDate", _rfc_2822(as_of))]
    return items.select(F.concat(*head, body, F.lit("</channel></rss>")).alias("document"))


_SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RSS_ITEM = (
    "'<item><title>' || " + _SAFE.format("title") + " || '</title><link>http://x/' || slug || '?a=1&amp;b</link><guid isPermaLink=\"false\">' || slug || '</guid><description>' || " + _SAFE.format("left(body, 40)")
    + " || '</description><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><author></author>' || coalesce(array_to_string(list_transform(raw_tags, lambda x: '<category>' || " + _SAFE.format("x") + " || '</category>'), ''), '') || '</item>'"
)


def _exported(t: Tables) -> DataFrame:
    return t.articles.select("slug", "title", F.concat(F.lit("http://x/"), "slug", F.lit("?a=1&b")).alias("source_url"), F.left("body", F.lit(40)).alias("desc"), "published_at", F.lit(None).cast("string").alias("author"), "raw_tags")


@query("A24_rss", f"select slug, {_RSS_ITEM} as item from articles")
def _(t: Tables) -> DataFrame:
    return export_rss(_exported(t))


@query(
    "A24_channel",
    f"""with n as (select * from articles order by published_at desc, slug limit 20)
    select '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>News &amp; more</title><link>http://x</link><language>en</language><lastBuildDate>Thu, 25 Jan 2024 00:00:00 GMT</lastBuildDate>' || string_agg({_RSS_ITEM}, '' order by published_at desc, slug) || '</channel></rss>' as document from n""",
)
def _(t: Tables) -> DataFrame:
    return rss_channel(_exported(t), "News & more", "http://x", F.lit("2024-01-25").cast("timestamp"))


def with_month(articles: DataFrame) -> DataFrame:
    """pub_month for partitionBy; rows without a date go to `default`."""
    return articles.withColumn("pub_month", F.coalesce(F.date_format("published_at", "yyyy-MM"), F.lit("default")))


def write_months(articles: DataFrame, folder: str) -> None:
    """One folder for each month; months that the rows have are replaced, others stay."""
    with_month(articles).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pub_month").parquet(folder)


@query("A27_months", "select slug, strftime(published_at, '%Y-%m') as pub_month from posts where published_at >= timestamp '2024-01-10' union all select -1 - slug, 'default' from posts where slug % 9 = 0")
def _(t: Tables) -> DataFrame:
    """A table written twice, the second time only some months of it, and two months read back."""
    dated = t.posts.select("slug", "published_at")
    undated = dated.filter("slug % 9 = 0").select((-1 - F.col("slug")).alias("slug"), F.lit(None).cast("timestamp").alias("published_at"))
    folder = shared_folder(t.spark)
    write_months(dated.unionByName(undated).unionByName(dated.withColumn("published_at", F.col("published_at") - F.expr("interval 300 days"))), folder)
    write_months(dated.filter("published_at >= timestamp'2024-01-10'"), folder)
    return t.spark.read.parquet(folder).filter(F.col("pub_month").isin("2024-01", "default")).select("slug", "pub_month")


def purge_source(articles: DataFrame, members: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Articles of other sources, and the ids of clusters whose only member goes."""
    gone = articles.filter(F.col("source_name") == source).select("slug")
    alone = members.groupBy("cluster_id").agg(F.count("*").alias("n"), F.first("slug").alias("slug")).filter("n = 1")
    return articles.filter(~F.col("source_name").eqNullSafe(source)), alone.join(gone, "slug", "left_semi").select("cluster_id")


@query("A28_purge", "with m as (select conv_id as c, count(*) as n, min('a' || (conv_id % 1000)) as slug from conversations group by 1) select c as cluster_id from m where n = 2 and slug in (select slug from articles where source_name = 'src4')")
def _(t: Tables) -> DataFrame:
    slug = F.concat(F.lit("a"), F.col("conv_id") % 1000)
    members = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("conv_id").alias("cluster_id"), slug.alias("slug"))
    return purge_source(t.articles.select("slug", "source_name"), members, "src4")[1]


def log_run(log: DataFrame, row: DataFrame) -> DataFrame:
    """The log with the row, unless its day is already `sent`."""
    sent = log.filter("status = 'sent'").select("period_date")
    return upsert_overwrite(row.join(sent, "period_date", "left_anti"), log, "period_date")


@query(
    "A30_run_log",
    "select o_orderdate::date as period_date, case when min(o_orderstatus) = 'F' then 'sent' else 'failed' end as status from orders group by 1",
)
def _(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("period_date")).agg(F.min("o_orderstatus").alias("x"))
    log = days.select("period_date", F.when(F.col("x") == "F", "sent").otherwise("pending").alias("status"))
    return log_run(log, days.select("period_date", F.lit("failed").alias("status")))


# --- C: joins that enrich ------------------------------------------------------------------------


def severity(cvss: Column) -> Column:
    return F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").when(cvss > 0, "low")


@query("N14_severity", "select p_partkey as id, case when p_size / 5.0 >= 9 then 'critical' when p_size / 5.0 >= 7 then 'high' when p_size / 5.0 >= 4 then 'medium' when p_size > 0 then 'low' end as severity from part")
def _(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), severity(F.col("p_size") / 5.0).alias("severity"))


def enrich_cve(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Fill cvss_score, where null, with the greatest of the article's CVEs (in any case of letters)."""
    keys = articles.select("slug", F.explode(F.transform("cve_ids", F.upper)).alias("cve_id")).distinct()
    best = keys.join(topics, "cve_id").groupBy("slug").agg(F.max("cvss").alias("_cvss"))
    out = articles.join(best, "slug", "left").withColumn("cvss_score", F.coalesce("cvss_score", "_cvss")).drop("_cvss")
    return out.withColumn("severity", severity(F.col("cvss_score")))


_ENRICHED = """with k as (select distinct slug, upper(unnest(cve_ids)) as cve_id from articles), b as (select slug, max(cvss) as best from k join topics using (cve_id) group by 1),
    e as (select slug, coalesce(cvss_score, best) as cvss_score from articles left join b using (slug))
    select slug, cvss_score, case when cvss_score >= 9 then 'critical' when cvss_score >= 7 then 'high' when cvss_score >= 4 then 'medium' when cvss_score > 0 then 'low' end as severity from e"""


@query("C4_enrich_cve", _ENRICHED)
def _(t: Tables) -> DataFrame:
    return enrich_cve(t.articles, t.topics).select("slug", "cvss_score", "severity")


@query("C5_backfill_cve", _ENRICHED.replace("from e", "from e where slug in (select slug from articles where cvss_score is null and len(cve_ids) > 0)"))
def _(t: Tables) -> DataFrame:
    from newsgraph.operators.read import backlog

    return enrich_cve(backlog(t.articles, "score"), t.topics).select("slug", "cvss_score", "severity")


@query("C12_with_source", "select slug, s_nationkey as nation from articles join supplier on s_suppkey = 1 + cast(substr(source_name, 4) as int)")
def _(t: Tables) -> DataFrame:
    sources = t.supplier.select(F.concat(F.lit("src"), F.col("s_suppkey") - 1).alias("source_name"), F.col("s_nationkey").alias("nation"))
    return t.articles.join(sources, "source_name").select("slug", "nation")


@query("C13_unclustered", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("C14_mentions_for", "select slug, normalized_key from mentions where slug in (select slug from articles where content_type = 'kev_catalog')")
def _(t: Tables) -> DataFrame:
    return t.mentions.join(t.articles.filter("content_type = 'kev_catalog'"), "slug", "left_semi").select("slug", "normalized_key")


@query(
    "C16_mark_kev",
    "with k as (select distinct upper(unnest(cve_ids)) as c from articles where content_type = 'kev_catalog') select slug, list_has_any(list_transform(cve_ids, lambda x: upper(x)), (select list(c) from k)) as cisa_kev from articles",
)
def _(t: Tables) -> DataFrame:
    return mark_kev(t.articles.select("slug", "cve_ids"), t.articles.filter("content_type = 'kev_catalog'"))


def mark_kev(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(slug, cisa_kev): whether a row shares a CVE with an article of the catalogue."""
    known = catalog.select(F.explode(F.transform("cve_ids", F.upper)).alias("cve")).distinct()
    hit = rows.select("slug", F.explode(F.transform("cve_ids", F.upper)).alias("cve")).join(known, "cve", "left_semi").select("slug").distinct()
    return rows.select("slug").join(hit.withColumn("hit", F.lit(True)), "slug", "left").select("slug", F.coalesce("hit", F.lit(False)).alias("cisa_kev"))


@query("C17_mark_advisory", "select source_name as cluster_id, bool_or(content_type = 'ics_advisory') as advisory from articles group by 1")
def _(t: Tables) -> DataFrame:
    owners = t.articles.filter("content_type = 'ics_advisory'").select(F.col("source_name").alias("cluster_id"), F.lit(True).alias("hit")).distinct()
    clusters = t.articles.select(F.col("source_name").alias("cluster_id")).distinct()
    return clusters.join(owners, "cluster_id", "left").select("cluster_id", F.coalesce("hit", F.lit(False)).alias("advisory"))


def set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either set with side both, a_only or b_only."""
    out = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full_outer")
    return out.withColumn("side", F.when(F.col("_a").isNull(), "b_only").when(F.col("_b").isNull(), "a_only").otherwise("both")).drop("_a", "_b")


_DIFF = "select doc_id, case when a.quality is null then 'b_only' when b.toxic is null then 'a_only' else 'both' end as side from (select * from labels where quality = 1) a full join (select * from labels where toxic = 0) b using (doc_id)"


def ner_diff(a: DataFrame, b: DataFrame, keys: list[str], seen: int = 500) -> DataFrame:
    """Rows of either set of entities with side (both, a_only, b_only) and zone: new-input for what only b
    has, at an offset of `seen` or more, which a never saw; else shared, so too without an offset.
    Of a key that b has several times the first place counts. a: keys; b: keys, char_offset."""
    places = b.groupBy(*keys).agg(F.min("char_offset").alias("_at"))
    zone = F.when((F.col("side") == "b_only") & (F.col("_at") >= seen), "new-input").otherwise("shared")
    return set_diff(a, b, keys).join(places, keys, "left").withColumn("zone", zone).drop("_at")


@query("C18_ner_diff", _DIFF.replace("as side from", "as side, case when a.quality is null and doc_id % 7 > 0 and doc_id * 13 % 1000 >= 500 then 'new-input' else 'shared' end as zone from"))
def _(t: Tables) -> DataFrame:
    place = F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") * 13 % 1000).alias("char_offset")
    return ner_diff(t.labels.filter("quality = 1"), t.labels.filter("toxic = 0").select("doc_id", place), ["doc_id"])


@query("U6_difference", "select doc_id from labels where quality = 1 and toxic <> 0")
def _(t: Tables) -> DataFrame:
    return t.labels.filter("quality = 1").select("doc_id").subtract(t.labels.filter("toxic = 0").select("doc_id"))


@query("C19_coverage_gap", "select slug from articles where len(cve_ids) > 0 and not list_has_any(list_transform(cve_ids, lambda x: upper(x)), (select list(cve_id) from topics where cvss > 9.5))")
def _(t: Tables) -> DataFrame:
    return cve_coverage_gap(t.articles, t.topics.filter("cvss > 9.5").select("cve_id"))


def cve_coverage_gap(articles: DataFrame, known: DataFrame) -> DataFrame:
    keys = articles.select("slug", F.explode(F.transform("cve_ids", F.upper)).alias("cve_id"))
    return keys.select("slug").distinct().join(keys.join(known, "cve_id", "left_semi"), "slug", "left_anti")


@query(
    "C24_raise_cvss",
    "with n as (select l_orderkey as id, max(p_size / 5.0) as best from lineitem join part on p_partkey = l_partkey where p_size > 40 group by 1) select id, greatest(score, best) as max_cvss from clusters join n using (id)",
)
def _(t: Tables) -> DataFrame:
    fresh = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("slug"), (F.col("p_size") / 5.0).alias("cvss"))
    best = t.members.join(fresh, "slug").groupBy(F.col("cluster_id").alias("id")).agg(F.max("cvss").alias("best"))
    return t.clusters.join(best, "id").select("id", F.greatest("score", "best").alias("max_cvss"))


# --- U: set operations ---------------------------------------------------------------------------


@query("U1_union_first", "with u as (select l_suppkey as id, 0 as rank from lineitem union all select s_suppkey, 1 from supplier) select id, min(rank) as rank from u group by 1")
def _(t: Tables) -> DataFrame:
    return union_first([t.lineitem.select(F.col("l_suppkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id"))], "id")


def union_first(sets: list[DataFrame], key: str) -> DataFrame:
    """Each id with the rank of the first set that has it."""
    ranked = [s.withColumn("rank", F.lit(i)) for i, s in enumerate(sets)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s)
    return out.groupBy(key).agg(F.min("rank").alias("rank"))


@query(
    "U2_merge_sources",
    "with u as (select slug, normalized_key, 'text' as s from mentions where type = 'actor' union all select slug, normalized_key, 'tag' from mentions where length(normalized_key) > 2) select slug, normalized_key, array_to_string(list_sort(list(distinct s)), ',') as sources from u group by 1, 2",
)
def _(t: Tables) -> DataFrame:
    tagged = t.mentions.filter("length(normalized_key) > 2").withColumn("sources", F.array(F.lit("tag")))
    merged = merge_sources(t.mentions.filter("type = 'actor'").withColumn("sources", F.array(F.lit("text"))), tagged)
    return merged.select("slug", "normalized_key", F.array_join("sources", ",").alias("sources"))


def merge_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).select("slug", "normalized_key", F.explode("sources").alias("source")).distinct()
    return both.groupBy("slug", "normalized_key").agg(F.array_sort(F.collect_list("source")).alias("sources"))


@query("U4_cve_union", "select slug, array_to_string(cve_ids[1:1] || case when upper(cve_ids[2]) <> upper(cve_ids[1]) then cve_ids[2:2] else []::varchar[] end, ',') as cves from articles")
def _(t: Tables) -> DataFrame:
    first, rest = F.slice("cve_ids", 1, 1), F.slice("cve_ids", 2, 1)
    return t.articles.select("slug", F.array_join(cve_union(first, rest), ",").alias("cves"))


def cve_union(first: Column, second: Column) -> Column:
    """Case-insensitive union that keeps the letters of the first list."""
    upper = F.transform(first, F.upper)
    return F.concat(first, F.filter(second, lambda c: ~F.array_contains(upper, F.upper(c))))


@query("U5_ordered_union", "select o_orderkey as id, case when o_custkey % 7 = o_orderkey % 7 then (o_custkey % 7)::varchar else (o_custkey % 7)::varchar || ',' || (o_orderkey % 7)::varchar end as ids from orders")
def _(t: Tables) -> DataFrame:
    a, b = F.array(F.col("o_custkey") % 7), F.array(F.col("o_orderkey") % 7)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(F.array_distinct(F.concat(a, b)).cast("array<string>"), ",").alias("ids"))


# --- D: roll-ups of members and mentions ---------------------------------------------------------


@query(
    "D15_cluster_maxima",
    "select l_orderkey as id, max(p_size) / 5.0 as max_cvss, coalesce(max(case when p_size > 20 then p_retailprice end), 0.0) as max_epss from lineitem join part on p_partkey = l_partkey group by 1",
)
def _(t: Tables) -> DataFrame:
    facts = t.part.select(F.col("p_partkey").alias("slug"), (F.col("p_size") / 5.0).alias("cvss"), F.when(F.col("p_size") > 20, F.col("p_retailprice")).alias("epss"))
    return cluster_maxima(t.members.join(facts, "slug"))


def cluster_maxima(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("cluster_id").alias("id")).agg(F.max("cvss").alias("max_cvss"), F.coalesce(F.max("epss"), F.lit(0.0)).alias("max_epss"))


@query("D16_source_count", "select l_orderkey as id, count(distinct l_suppkey) as n from lineitem group by 1")
def _(t: Tables) -> DataFrame:
    named = F.when(F.trim(F.col("source_name").cast("string")) != "", F.col("source_name"))
    return t.members.groupBy(F.col("cluster_id").alias("id")).agg(F.count_distinct(named).alias("n"))


_ROLLUP = "select normalized_key, count(distinct slug) as article_count, min(published_at) as first_seen, max(published_at) as last_seen, sha256(string_agg(distinct slug, ',' order by slug)) as slugs from mentions group by 1"


def entity_rollup(mentions: DataFrame) -> DataFrame:
    """Per key: its articles, their number, first and last seen by publication."""
    return mentions.groupBy("normalized_key").agg(
        F.count_distinct("slug").alias("article_count"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.array_sort(F.collect_set("slug")).alias("slugs")
    )


@query("D17_entity_rollup", _ROLLUP)
def _(t: Tables) -> DataFrame:
    return entity_rollup(t.mentions).withColumn("slugs", F.sha2(F.array_join("slugs", ","), 256))


def replay_stats(entries: DataFrame) -> DataFrame:
    """Seven counts for each source of parsed entries (source_name, parsed, is_teaser, body_quality,
    cve_ids, wrote): an entry that did not parse is an error, one that parsed and was there is skipped."""
    parsed, wrote = F.coalesce("parsed", F.lit(False)), F.coalesce("wrote", F.lit(False))
    return entries.groupBy("source_name").agg(
        F.count("*").alias("entries"), F.count_if(parsed & wrote).alias("upserted"), F.count_if(parsed & ~wrote).alias("skipped"), F.count_if(~parsed).alias("errors"), F.count_if(parsed & F.col("is_teaser")).alias("teasers"),
        F.count_if(parsed & F.col("body_quality").isin("teaser", "partial")).alias("thin_bodies"), F.count_if(parsed & (F.size("cve_ids") > 0)).alias("articles_with_cves"),
    )


@query(
    "D21_replay_stats",
    """with f as (select sha256(body) as h, min(doc_id) as doc_id from articles where doc_id % 11 > 0 group by 1), e as (select *, doc_id % 11 > 0 as parsed, doc_id in (select doc_id from f) as wrote, case doc_id % 4 when 0 then 'teaser' when 1 then 'partial' else 'ok' end as q from articles)
    select source_name, count(*) as entries, count(*) filter (parsed and wrote) as upserted, count(*) filter (parsed and not wrote) as skipped, count(*) filter (not parsed) as errors, count(*) filter (parsed and length(body) < 500) as teasers,
    count(*) filter (parsed and q <> 'ok') as thin_bodies, count(*) filter (parsed and len(cve_ids) > 0) as articles_with_cves from e group by 1""",
)
def _(t: Tables) -> DataFrame:
    """Of equal bodies that parse the first one is written."""
    rows = t.articles.withColumn("parsed", F.col("doc_id") % 11 > 0).withColumn("h", F.sha2("body", 256))
    first = rows.filter("parsed").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("wrote"))
    k = F.col("doc_id") % 4
    entries = rows.join(first, "doc_id", "left").withColumn("is_teaser", F.length("body") < 500)
    return replay_stats(entries.withColumn("body_quality", F.when(k == 0, "teaser").when(k == 1, "partial").otherwise("ok")))


@query("D22_type_counts", "select type as value, count(*) as \"count\" from mentions group by 1 order by 2 desc limit 10")
def _(t: Tables) -> DataFrame:
    from newsgraph.operators.read import facet

    return facet(t.mentions, "type", 10)


@query(
    "D24_source_labels",
    """with n as (select source_name, raw_tags from articles where published_at >= timestamp '2024-02-15' - interval 30 day qualify row_number() over (partition by source_name order by published_at desc, slug) <= 5), e as (select source_name, trim(unnest(raw_tags)) as tag from n)
    select source_name, string_agg(distinct tag, ',' order by tag) as labels from e where tag <> '' group by 1""",
)
def _(t: Tables) -> DataFrame:
    return source_labels(t.articles, F.lit("2024-02-15").cast("timestamp")).withColumn("labels", F.array_join("labels", ","))


def source_labels(snapshots: DataFrame, as_of: Column, days: int = 30, newest: int = 5) -> DataFrame:
    """(source_name, labels): distinct labels that are not empty of each source's newest snapshots of the last days."""
    w = Window.partitionBy("source_name").orderBy(F.desc("published_at"), "slug")
    recent = snapshots.filter(F.col("published_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    rows = recent.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest)
    labels = rows.select("source_name", F.explode("raw_tags").alias("tag")).withColumn("tag", F.trim("tag")).filter("tag <> ''")
    return labels.groupBy("source_name").agg(F.array_sort(F.collect_set("tag")).alias("labels"))


@query("D25_fill_decisions", "select p_partkey as label, coalesce(p_size > 10, true) as ingest, case when p_size % 2 = 0 then p_size / 10.0 else 0 end as modifier from (select p_partkey, case when p_size % 2 = 0 then p_size end as p_size from part)")
def _(t: Tables) -> DataFrame:
    decisions = t.part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("label"), (F.col("p_size") > 10).alias("ingest"), (F.col("p_size") / 10.0).alias("modifier"))
    return fill_decisions(t.part.select(F.col("p_partkey").alias("label")), decisions)


def fill_decisions(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    return labels.join(decisions, "label", "left").select("label", F.coalesce("ingest", F.lit(True)).alias("ingest"), F.coalesce("modifier", F.lit(0.0)).alias("modifier"))
