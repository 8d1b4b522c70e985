"""Filters, facets, digests, rankings and pages over articles and clusters (B, D, W, S, C1-C3, C20-C23)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.registry import Tables, query

AS_OF = "2024-01-25 00:00:00"
#: Phrases of titles that sum up many events; fixed values.
ROUNDUP = (
    "patch tuesday",
    "monthly roundup",
    "cve landscape",
    "roundup",
    "weekly digest",
    "weekly update",
    "weekly recap",
    "this week in security",
    "month in review",
    "look what you made us patch",
    "stormcast",
    "[virtual event]",
    "[webinar]",
    "[conference]",
    "[workshop]",
)


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- B: projections and predicates ---------------------------------------------------------------


#: Columns of an article in a list, and what its detail view has besides.
LIST = {
    "slug": "string", "raw_tags": "array<string>", "normalized_topics": "array<string>", "title": "string", "desc": "string", "summary": "string", "keywords": "array<string>", "published_at": "timestamp",
    "severity": "string", "type": "string", "category": "string", "author": "string", "source_name": "string", "source_url": "string", "image_url": "string", "cvss_score": "double", "cve_ids": "array<string>",
    "body_quality": "string", "body_source": "string", "is_teaser": "boolean",
}
DETAIL = LIST | {"content_html": "string", "content_source": "string", "raw_metadata": "map<string,string>"}
_GIVEN = {"is_teaser": False, "type": "news"}


def project_list(articles: DataFrame) -> DataFrame:
    """The 20 columns of a list; what the table lacks is null (is_teaser: false, type: news)."""
    return conform(articles, LIST, _GIVEN)


def project_detail(articles: DataFrame) -> DataFrame:
    return conform(articles, DETAIL, _GIVEN)


_LIST = "slug, array_to_string(raw_tags, ',') as tags, title, published_at, 'news' as type, category, source_name, cvss_score::double as cvss_score, array_to_string(cve_ids, ',') as cves, body_quality, false as is_teaser, null::varchar as severity"


def _joined(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("slug", F.array_join("raw_tags", ",").alias("tags"), "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "type", "category", "source_name", "cvss_score", F.array_join("cve_ids", ",").alias("cves"), "body_quality", "is_teaser", "severity", *more)


@query("B1_list_projection", f"select {_LIST} from articles")
def _(t: Tables) -> DataFrame:
    return _joined(project_list(t.articles))


@query("B1_detail_projection", f"select {_LIST}, sha256(body) as content from articles where doc_id % 20 = 0")
def _(t: Tables) -> DataFrame:
    """Details of the articles asked for."""
    asked = t.articles.filter("doc_id % 20 = 0").withColumn("content_html", F.col("body"))
    return _joined(project_detail(asked).withColumn("content", F.sha2("content_html", 256)), "content")


def filter_articles(
    articles: DataFrame,
    equal: dict | None = None,
    tag: str | None = None,
    topics: tuple[str, ...] = (),
    min_cvss: float | None = None,
    since: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """All given conditions hold; any of `topics` is enough. Nulls fail a condition."""
    tests = [F.col(k) == v for k, v in (equal or {}).items()]
    tests += [F.array_contains("raw_tags", tag)] if tag else []
    tests += [F.arrays_overlap("raw_tags", F.array(*map(F.lit, topics)))] if topics else []
    tests += [F.col("cvss_score") >= min_cvss] if min_cvss is not None else []
    tests += [F.col("published_at") >= since] if since is not None else []
    tests += [F.col("published_at") <= until] if until is not None else []
    for test in tests:
        articles = articles.filter(test)
    return articles


@query(
    "B2_filter",
    "select slug, cvss_score from articles where category = 'en' and list_has_any(raw_tags, ['the', 'of', 'la']) and cvss_score >= 4 and published_at between '2024-01-03' and '2024-01-20'",
)
def _(t: Tables) -> DataFrame:
    kept = filter_articles(t.articles, {"category": "en"}, topics=("the", "of", "la"), min_cvss=4.0, since=at("2024-01-03"), until=at("2024-01-20"))
    return kept.select("slug", "cvss_score")


def filter_clusters(clusters: DataFrame, category: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Clusters of a category, made within a period, that are not known to be roundups or advisories."""
    out = clusters if category is None else clusters.filter(F.col("category") == category)
    out = out if since is None else out.filter(F.col("created_at") >= since)
    out = out if until is None else out.filter(F.col("created_at") <= until)
    for flag in {"is_roundup", "is_advisory"} & set(clusters.columns):
        out = out.filter(~F.coalesce(F.col(flag), F.lit(False)))
    return out


@query("B3_filter_clusters", "select id, state from clusters where category = '1-URGENT' and created_at between '1995-01-01' and '1996-06-01' and id % 7 <> 0")
def _(t: Tables) -> DataFrame:
    flagged = t.clusters.withColumn("is_roundup", F.when(F.col("id") % 7 == 0, True))
    return filter_clusters(flagged, "1-URGENT", at("1995-01-01"), at("1996-06-01")).select("id", "state")


WINDOWS = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}


def since(rows: DataFrame, as_of: str, window: str, topic: str | None = None) -> DataFrame:
    """Rows of the look-back; with a topic, 24h widens to 7d; `all` keeps all."""
    if window == "all":
        return rows
    span = WINDOWS["7d" if window == "24h" and topic else window]
    return rows.filter((F.col("published_at") >= at(as_of) - F.expr(f"interval {span}")) & (F.col("published_at") <= at(as_of)))


@query("B4_since", "select slug from posts where category = 'click' and published_at between timestamp '2024-01-18' and timestamp '2024-01-25'")
def _(t: Tables) -> DataFrame:
    return since(t.posts.filter("category = 'click'"), AS_OF, "24h", topic="click").select("slug")


def conform(df: DataFrame, schema: dict[str, str], defaults: dict | None = None) -> DataFrame:
    """Exactly the columns of the schema: unknown ones go, values are cast or null, nulls get defaults."""
    given = defaults or {}
    made = []
    for name, kind in schema.items():
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        made.append((F.coalesce(value, F.lit(given[name]).cast(kind)) if name in given else value).alias(name))
    return df.select(*made)


@query("B5_conform", "select slug, coalesce(cast(cvss_score as double), 0.0) as cvss_score, try_cast(category as integer) as category, 'news' as type from articles")
def _(t: Tables) -> DataFrame:
    return conform(t.articles, {"slug": "string", "cvss_score": "double", "category": "int", "type": "string"}, {"cvss_score": 0.0, "type": "news"})


BACKLOG = {
    "score": lambda: (F.size("cve_ids") > 0) & F.col("cvss_score").isNull(),
    "body": lambda: F.col("body_quality").isNull() | F.col("body_quality").isin("failed", "empty"),
    "vector": lambda: F.col("embedding").isNull(),
    "nvd": lambda: F.col("nvd_last_modified").isNull(),
}


def backlog(articles: DataFrame, kind: str) -> DataFrame:
    return articles.filter(BACKLOG[kind]())


@query(
    "B6_backlog",
    "select slug, 'score' as kind from articles where len(cve_ids) > 0 and cvss_score is null union all select slug, 'body' from articles where body_quality is null or body_quality in ('failed', 'empty') union all select slug, 'vector' from articles where doc_id not in (select vec_id from embeddings) union all select cve_id, 'nvd' from topics where right(cve_id, 1) = '9'",
)
def _(t: Tables) -> DataFrame:
    vectors = t.articles.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    topics = t.topics.select(F.col("cve_id").alias("slug"), F.when(F.right("cve_id", F.lit(1)) != "9", "2024").alias("nvd_last_modified"))
    parts = [backlog(d, kind).select("slug", F.lit(kind).alias("kind")) for kind, d in (("score", t.articles), ("body", t.articles), ("vector", vectors), ("nvd", topics))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def retry_eligible(rows: DataFrame, as_of: str) -> DataFrame:
    """Failed, empty or missing bodies: at once without a try or with an unknown last one, 1 hour after
    one try, 24 after two, then never."""
    wait = F.when(F.col("tries") == 1, F.expr("interval 1 hour")).when(F.col("tries") == 2, F.expr("interval 24 hours"))
    tries = F.coalesce("tries", F.lit(0))
    due = (tries == 0) | ((tries < 3) & F.coalesce(F.col("tried_at") + wait <= at(as_of), F.lit(True)))
    return rows.filter(BACKLOG["body"]() & due)


@query(
    "B7_retry",
    """with r as (select slug, case when slug % 11 > 0 then published_at end as tried_at, case when slug % 13 > 0 then slug % 4 end as tries, case slug % 3 when 0 then 'ok' when 1 then 'failed' end as q from posts)
    select slug from r where coalesce(q, 'failed') = 'failed' and (coalesce(tries, 0) = 0 or (tries < 3 and tried_at is null) or (tries = 1 and tried_at + interval 1 hour <= timestamp '2024-01-25') or (tries = 2 and tried_at + interval 24 hour <= timestamp '2024-01-25'))""",
)
def _(t: Tables) -> DataFrame:
    q = F.when(F.col("slug") % 3 == 0, "ok").when(F.col("slug") % 3 == 1, "failed")
    rows = t.posts.select("slug", F.when(F.col("slug") % 11 > 0, F.col("published_at")).alias("tried_at"), F.when(F.col("slug") % 13 > 0, F.col("slug") % 4).alias("tries"), q.alias("body_quality"))
    return retry_eligible(rows, AS_OF).select("slug")


def entity_prefix(entities: DataFrame, prefix: str, name_col: str = "name") -> DataFrame:
    return entities.filter(F.lower(name_col).startswith(prefix.lower()))


@query("B8_prefix", "select c_custkey as id, c_name as name from customer where lower(c_name) like 'customer#00000000%' or lower(c_name) like 'customer_1%'")
def _(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return entity_prefix(names, "CUSTOMER#00000000").unionByName(entity_prefix(names, "customer_1")).distinct()


@query("B9_sponsored", "select s_suppkey as id from supplier where not lower(s_name) like 'supplier#00000001%'")
def _(t: Tables) -> DataFrame:
    return drop_sponsored(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("author")), "supplier#00000001").select("id")


def drop_sponsored(entries: DataFrame, prefix: str = "sponsored") -> DataFrame:
    return entries.filter(~F.coalesce(F.lower("author").startswith(prefix), F.lit(False)))


def apply_category_rules(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries (slug, source_name, labels, weight) without a blocked label, weight plus its modifiers.

    Repeated labels add again, labels without a rule are neutral, null or empty labels keep all.
    """
    labels = entries.select("slug", "source_name", F.explode("labels").alias("label"))
    met = labels.join(rules, ["source_name", "label"])
    sums = met.groupBy("slug").agg(F.bool_and("ingest").alias("ingest"), F.sum("modifier").alias("added"))
    out = entries.join(sums, "slug", "left").filter(F.coalesce("ingest", F.lit(True)))
    return out.withColumn("weight", F.col("weight") + F.coalesce("added", F.lit(0.0))).drop("ingest", "added")


@query(
    "B10_category_rules",
    """with rules as (select distinct source_name, unnest(raw_tags) as label from articles where doc_id % 10 = 1),
    r as (select source_name, label, length(label) <> 3 as ingest, length(label) / 8.0 as modifier from rules),
    e as (select slug, source_name, unnest(raw_tags) as label from articles),
    s as (select slug, bool_and(ingest) as ok, sum(modifier) as added from e join r using (source_name, label) group by slug)
    select slug, credibility_weight + coalesce(added, 0) as weight from articles left join s using (slug) where coalesce(ok, true)""",
)
def _(t: Tables) -> DataFrame:
    rules = t.articles.filter("doc_id % 10 = 1").select("source_name", F.explode("raw_tags").alias("label")).distinct()
    rules = rules.withColumn("ingest", F.length("label") != 3).withColumn("modifier", F.length("label") / 8.0)
    entries = t.articles.select("slug", "source_name", F.col("raw_tags").alias("labels"), F.col("credibility_weight").cast("double").alias("weight"))
    return apply_category_rules(entries, rules).select("slug", "weight")


def is_roundup(title: Column, phrases: tuple[str, ...] = ROUNDUP) -> Column:
    """Whether the title contains one of the phrases, in either case; null for null."""
    # One pattern, as the title would be worked out anew for each phrase.
    return F.lower(title).rlike("|".join(map(re.escape, phrases)) or "(?!)")


_PHRASES = ", ".join(f"'{x}'" for x in ROUNDUP)


@query("B11_roundup", f"select slug, len(list_filter([{_PHRASES}], lambda p: contains(lower(concat_ws(' ', title, upper([{_PHRASES}][doc_id % 40 + 1]))), p))) > 0 as is_roundup from articles")
def _(t: Tables) -> DataFrame:
    """Titles of which some end in one of the phrases, in capitals."""
    phrase = F.upper(F.try_element_at(F.array(*map(F.lit, ROUNDUP)), (F.col("doc_id") % 40 + 1).cast("int")))
    return t.articles.select("slug", is_roundup(F.concat_ws(" ", "title", phrase)).alias("is_roundup"))


def refine(rows: DataFrame, severities: tuple[str, ...], states: tuple[str, ...]) -> DataFrame:
    return rows.filter(F.col("severity").isin(*severities) & F.col("state").isin(*states))


@query("B12_refine", "select id from clusters where category in ('1-URGENT', '2-HIGH') and state in ('new', 'confirmed')")
def _(t: Tables) -> DataFrame:
    return refine(t.clusters.withColumnRenamed("category", "severity"), ("1-URGENT", "2-HIGH"), ("new", "confirmed")).select("id")


#: Sources of product advisories and of threat advisories; fixed values.
PRODUCT_SOURCES = ("Cisco Security Advisories", "Microsoft MSRC")
THREAT_SOURCES = ("NCSC UK",)
_ADDED = r"(?i)adds\s+(?:\d+|one|two|three)\s+known\s+exploited"


def content_type(title: Column, source: Column, normalizer: Column) -> Column:
    """By the title of a catalogue update, whatever the source; else by normaliser and source."""
    is_in = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    return (
        F.when(F.coalesce(title, F.lit("")).rlike(_ADDED), "kev_catalog")
        .when(is_in(normalizer, "cisa_advisory"), "ics_advisory")
        .when(is_in(source, *PRODUCT_SOURCES), "product_advisory")
        .when(is_in(normalizer, "cisa_news") | is_in(source, *THREAT_SOURCES), "threat_advisory")
        .otherwise("news")
    )


@query(
    "B13_content_type",
    """select slug, case when doc_id % 6 = 1 or doc_id % 6 = 2 then 'kev_catalog' when category = 'de' then 'ics_advisory' when source_name in ('src3', 'src5') then 'product_advisory'
    when category = 'fr' or source_name = 'src4' then 'threat_advisory' else 'news' end as content_type from articles""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    title = F.concat("title", F.when(k == 1, " CISA Adds Two Known Exploited Vulnerabilities").when(k == 2, " adds 12 known  exploited").when(k == 3, " adds known exploited").otherwise(""))
    source = F.when(F.col("source_name") == "src3", PRODUCT_SOURCES[0]).when(F.col("source_name") == "src5", PRODUCT_SOURCES[1]).when(F.col("source_name") == "src4", THREAT_SOURCES[0]).otherwise(F.col("source_name"))
    normalizer = F.when(F.col("category") == "de", "cisa_advisory").when(F.col("category") == "fr", "cisa_news")
    return t.articles.select("slug", content_type(title, source, normalizer).alias("content_type"))


def cluster_type(content: Column, n_cves: Column, types: Column) -> Column:
    """Set once, when a cluster is made: by the kind of its article, its CVEs, and its entities' types."""
    named = F.exists(F.coalesce(types, F.array().cast("array<string>")), lambda x: x.isin("actor", "campaign"))
    return F.when(F.coalesce(content.isin("ics_advisory", "product_advisory"), F.lit(False)), "advisory").when(n_cves > 0, "cve_incident").when(named, "campaign").otherwise("research")


@query(
    "B14_cluster_type",
    """with k as (select slug, list(distinct type) as types from mentions group by 1)
    select slug, case when content_type in ('ics_advisory', 'product_advisory') then 'advisory' when len(cve_ids) > 0 then 'cve_incident' when list_has_any(types, ['actor', 'campaign']) then 'campaign' else 'research' end as cluster_type from articles left join k using (slug)""",
)
def _(t: Tables) -> DataFrame:
    types = t.mentions.groupBy("slug").agg(F.collect_set("type").alias("types"))
    return t.articles.join(types, "slug", "left").select("slug", cluster_type(F.col("content_type"), F.size("cve_ids"), F.col("types")).alias("cluster_type"))


@query("B15_lookup", "select id, score, state from clusters where id = 7")
def _(t: Tables) -> DataFrame:
    return t.clusters.filter(F.col("id") == 7).select("id", "score", "state")


def update_source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """A run that worked clears the failures of its source, one that failed adds one."""
    out = sources.join(runs, "id", "left")
    failures = F.when(F.col("worked"), F.lit(0)).when(~F.col("worked"), F.col("failures") + 1).otherwise(F.col("failures"))
    return out.withColumn("failures", failures).withColumn("successes", F.col("successes") + F.when(F.col("worked"), 1).otherwise(0)).drop("worked")


@query(
    "B16_source_health",
    """select s_suppkey as id, case when s_suppkey % 3 = 0 then 0 when s_suppkey % 3 = 1 then s_nationkey + 1 else s_nationkey end as failures,
    (case when s_suppkey % 3 = 0 then 1 else 0 end) as successes from supplier where s_acctbal > 0""",
)
def _(t: Tables) -> DataFrame:
    sources = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("failures"), F.lit(0).alias("successes"))
    runs = t.supplier.filter("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3 == 0).alias("worked"))
    return update_source_health(sources, runs).select("id", "failures", "successes")


# --- D: aggregations -----------------------------------------------------------------------------


def facet(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value; nulls do not count."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count().orderBy(F.desc("count"), "value").limit(n)


@query("D1_facet", "select p_type as value, count(*) as \"count\" from part group by 1 order by 2 desc, 1 limit 10")
def _(t: Tables) -> DataFrame:
    return facet(t.part, "p_type", 10)


def facets(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """facet() of several columns in one pass: (facet, value, count)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    counts = rows.select(F.expr(f"stack({len(columns)}, {pairs}) as (facet, value)")).filter("value is not null").groupBy("facet", "value").count()
    w = Window.partitionBy("facet").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


@query(
    "D2_facets",
    """with f as (select 'source_name' as facet, source_name as value from articles union all select 'category', category from articles union all select 'content_type', content_type from articles),
    g as (select facet, value, count(*) as n from f group by 1, 2)
    select facet, value, n as "count" from g qualify row_number() over (partition by facet order by n desc, value) <= 5""",
)
def _(t: Tables) -> DataFrame:
    return facets(t.articles, ["source_name", "category", "content_type"], 5)


def top_per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def digest(rows: DataFrame, since: Column, until: Column, newest: int = 5) -> DataFrame:
    """Per category of a period: total of all, count of the category, and its newest rows."""
    inside = rows.filter((F.col("published_at") >= since) & (F.col("published_at") < until))
    counts = inside.groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = top_per_group(inside, "category", newest, F.desc("published_at"), F.asc("slug"))
    return top.join(counts, "category").crossJoin(F.broadcast(total)).select("category", "total", "n", "rank", "slug", "published_at")


_DIGEST = """with i as (select * from posts where published_at >= timestamp '{0}' and published_at < timestamp '{1}')
    select category, (select count(*) from i) as total, count(*) over (partition by category) as n,
    row_number() over (partition by category order by published_at desc, slug) as rank, slug, published_at from i qualify rank <= 5"""


@query("D3_digest", _DIGEST.format("2024-01-08", "2024-01-15"))
def _(t: Tables) -> DataFrame:
    return digest(t.posts, at("2024-01-08"), at("2024-01-15"))


def top_values(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return facet(rows.select(F.explode(column).alias("value")), "value", n)


@query("D4_top_values", "select value, count(*) as \"count\" from (select unnest(raw_tags) as value from articles) group by 1 order by 2 desc, 1 limit 10")
def _(t: Tables) -> DataFrame:
    return top_values(t.articles, "raw_tags")


def daily_digest(rows: DataFrame, day: str) -> DataFrame:
    return digest(rows, at(day), at(day) + F.expr("interval 1 day"))


def weekly_digest(rows: DataFrame, day: str) -> DataFrame:
    """The ISO week (Monday to Sunday) of a day."""
    monday = F.date_trunc("week", at(day))
    return digest(rows, monday, monday + F.expr("interval 7 days"))


@query("D5_weekly_digest", _DIGEST.format("2024-01-15", "2024-01-22"))
def _(t: Tables) -> DataFrame:
    return weekly_digest(t.posts, "2024-01-18")


@query("D5_daily_digest", _DIGEST.format("2024-01-18", "2024-01-19"))
def _(t: Tables) -> DataFrame:
    return daily_digest(t.posts, "2024-01-18")


def trending(rows: DataFrame, as_of: str, hours: int, n: int = 20, newest: int = 5) -> DataFrame:
    """(facet, value, count) of the last hours: the n most frequent tags and sources, and under
    `article` the newest rows in order (count: their place)."""
    recent = rows.filter((F.col("published_at") >= at(as_of) - F.expr(f"interval {hours} hours")) & (F.col("published_at") <= at(as_of)))
    tags = facet(recent.select(F.explode(F.array_distinct("raw_tags")).alias("value")), "value", n).select(F.lit("tag").alias("facet"), "value", "count")
    sources = facet(recent, "source_name", n).select(F.lit("source_name").alias("facet"), F.col("value").cast("string").alias("value"), "count")
    top = recent.orderBy(F.desc("published_at"), "slug").limit(newest).select("slug", "published_at")
    place = F.row_number().over(Window.orderBy(F.desc("published_at"), "slug")).cast("long")
    return tags.unionByName(sources).unionByName(top.select(F.lit("article").alias("facet"), F.col("slug").cast("string").alias("value"), place.alias("count")))


@query(
    "D6_trending",
    """with i as (select * from articles where published_at between timestamp '2024-01-18' and timestamp '2024-01-25'),
    g as (select 'tag' as facet, value, count(*) as n from (select unnest(list_distinct(raw_tags)) as value from i) x group by 2 union all select 'source_name', source_name, count(*) from i group by 2)
    select facet, value, n as "count" from g qualify row_number() over (partition by facet order by n desc, value) <= 20
    union all select 'article', slug, row_number() over (order by published_at desc, slug) from (select * from i order by published_at desc, slug limit 5) z""",
)
def _(t: Tables) -> DataFrame:
    return trending(t.articles, AS_OF, 168)


def distinct_count(rows: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Exact by a two-step aggregation, or approximate (HyperLogLog++) in one."""
    return rows.agg((F.count_distinct(column) if exact else F.approx_count_distinct(column)).alias("n"))


@query("D7_distinct", "select count(distinct source_name) as n from posts")
def _(t: Tables) -> DataFrame:
    return distinct_count(t.posts, "source_name")


def coverage(articles: DataFrame) -> DataFrame:
    """Per source: rows, and whole percent without a body, with a good body and with a score."""
    share = lambda c: F.floor(100 * F.count_if(c) / F.count("*"))
    return articles.groupBy("source_name").agg(
        F.count("*").alias("n"),
        share(F.col("body_quality").isNull()).alias("no_body"),
        share(F.col("body_quality") == "ok").alias("good_body"),
        share(F.col("cvss_score").isNotNull()).alias("scored"),
    )


@query(
    "D8_coverage",
    """select source_name, count(*) as n, floor(100 * count(*) filter (body_quality is null) / count(*))::bigint as no_body, floor(100 * count(*) filter (body_quality = 'ok') / count(*))::bigint as good_body,
    floor(100 * count(*) filter (cvss_score is not null) / count(*))::bigint as scored from articles group by 1""",
)
def _(t: Tables) -> DataFrame:
    return coverage(t.articles)


def length_profile(rows: DataFrame, text_col: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90), at_least: tuple[int, ...] = (500, 1500)) -> DataFrame:
    """Nearest-rank percentiles of the length and the counts from each bound on: (kind, bound, value).

    Ranks are found on the histogram of lengths, which has a row for each distinct length.
    """
    counts = rows.groupBy(F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("length")).count()
    total = counts.agg(F.sum("count").alias("n"))
    running = counts.withColumn("upto", F.sum("count").over(Window.orderBy("length"))).crossJoin(F.broadcast(total))
    wanted = running.select("length", "upto", "count", "n", F.explode(F.array(*map(F.lit, percents))).alias("bound"))
    rank = F.least(F.floor(F.col("bound") * F.col("n") / 100), F.col("n") - 1)
    ranks = wanted.filter((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("count"))).select(F.lit("percentile").alias("kind"), "bound", F.col("length").cast("long").alias("value"))
    shares = counts.select("length", "count", F.explode(F.array(*map(F.lit, at_least))).alias("bound")).groupBy("bound")
    return ranks.unionByName(shares.agg(F.sum(F.when(F.col("length") >= F.col("bound"), F.col("count")).otherwise(0)).alias("value")).withColumn("kind", F.lit("at_least")))


@query(
    "D9_length_profile",
    """with l as (select length(body) as n from articles), r as (select n, row_number() over (order by n) - 1 as i, count(*) over () as total from l),
    b as (select unnest([10, 25, 50, 75, 90]) as bound)
    select 'percentile' as kind, bound, n::bigint as value from r, b where i = least(floor(bound * total / 100.0), total - 1)
    union all select 'at_least', x, (select count(*) from l where n >= x) from (values (500), (1500)) v(x)""",
)
def _(t: Tables) -> DataFrame:
    return length_profile(t.articles, "body")


def source_breakdown(articles: DataFrame, n: int = 25) -> DataFrame:
    """Of the n biggest sources: rows by body_quality, and how many bodies are teasers (under 500)."""
    sizes = facet(articles, "source_name", n).select(F.col("value").alias("source_name"))
    inside = articles.join(F.broadcast(sizes), "source_name", "left_semi")
    return inside.groupBy("source_name", "body_quality").agg(F.count("*").alias("n"), F.count_if(F.length("body") < 500).alias("teasers"))


@query(
    "D10_source_breakdown",
    """with s as (select source_name from articles group by 1 order by count(*) desc, 1 limit 25)
    select source_name, body_quality, count(*) as n, count(*) filter (length(body) < 500) as teasers from articles where source_name in (select source_name from s) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return source_breakdown(t.articles)


@query("D11_verdict_matrix", "select quality, toxic, count(*) filter (doc_id % 2 = 0) as agree, count(*) filter (doc_id % 2 = 1) as disagree from labels group by 1, 2")
def _(t: Tables) -> DataFrame:
    verdict = F.when(F.col("doc_id") % 2 == 0, "agree").otherwise("disagree")
    return verdict_matrix(t.labels.withColumn("verdict", verdict), ["quality", "toxic"])


def verdict_matrix(judgments: DataFrame, by: list[str], verdicts: tuple[str, ...] = ("agree", "disagree")) -> DataFrame:
    return judgments.groupBy(*by).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in verdicts))


@query("D12_pending", "select doc_id % 50 as value, count(*) as \"count\" from labels where toxic = 0 group by 1 order by 2 desc, 1 limit 200")
def _(t: Tables) -> DataFrame:
    return facet(t.labels.filter("toxic = 0").select((F.col("doc_id") % 50).alias("slug")), "slug", 200)


def eval_summary(diff: DataFrame, limits: dict[str, float] | None = None, limit: float = 0.10) -> DataFrame:
    """Per type: counts of both, a_only, b_only; the share of a that b misses; PASS up to the limit."""
    by_type = F.lit(limit)
    for kind, x in (limits or {"campaign": 0.20}).items():
        by_type = F.when(F.col("type") == kind, x).otherwise(by_type)
    sums = diff.groupBy("type").agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("both", "a_only", "b_only")))
    rate = F.when(F.col("both") + F.col("a_only") > 0, F.col("a_only") / (F.col("both") + F.col("a_only"))).otherwise(0.0)
    return sums.withColumn("miss_rate", rate).withColumn("verdict", F.when(F.col("miss_rate") <= by_type, "PASS").otherwise("FAIL"))


@query(
    "D13_eval_summary",
    '''with d as (select case quality when 1 then 'campaign' else 'actor' end as type, case when doc_id % 6 = 0 then 'a_only' when doc_id % 7 = 0 then 'b_only' else 'both' end as side from labels),
    s as (select type, count(*) filter (side = 'both') as "both", count(*) filter (side = 'a_only') as a_only, count(*) filter (side = 'b_only') as b_only from d group by 1)
    select *, a_only / ("both" + a_only) as miss_rate, case when a_only / ("both" + a_only) <= case type when 'campaign' then 0.2 else 0.1 end then 'PASS' else 'FAIL' end as verdict from s''',
)
def _(t: Tables) -> DataFrame:
    side = F.when(F.col("doc_id") % 6 == 0, "a_only").when(F.col("doc_id") % 7 == 0, "b_only").otherwise("both")
    return eval_summary(t.labels.select(F.when(F.col("quality") == 1, "campaign").otherwise("actor").alias("type"), side.alias("side")))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page with the total of all rows on each of its rows."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("D26_page", "select slug, cvss_score, (select count(*) from articles where category = 'en') as total from articles where category = 'en' order by cvss_score desc nulls last, slug limit 20 offset 40")
def _(t: Tables) -> DataFrame:
    return page(t.articles.filter("category = 'en'").select("slug", "cvss_score"), [F.desc_nulls_last("cvss_score"), F.asc("slug")], 20, 40)


def launch_check(articles: DataFrame, as_of: str) -> DataFrame:
    """Share of good bodies in the last 7 days (at least half) and of each of the 5 sources of
    highest credibility (at least 0.8): (name, share, passed)."""
    good = F.try_divide(F.count_if(F.col("body_quality") == "ok"), F.count("*")).alias("share")
    week = articles.filter(F.col("published_at").between(at(as_of) - F.expr("interval 7 days"), at(as_of))).agg(good).select(F.lit("last 7 days").alias("name"), "share", F.lit(0.5).alias("least"))
    best = articles.groupBy("source_name").agg(F.max("credibility_weight").alias("w")).orderBy(F.desc("w"), "source_name").limit(5)
    top = articles.join(F.broadcast(best), "source_name", "left_semi").groupBy(F.col("source_name").alias("name")).agg(good).withColumn("least", F.lit(0.8))
    return week.unionByName(top).select("name", "share", (F.col("share") >= F.col("least")).alias("passed"))


@query(
    "D27_launch_check",
    """with best as (select source_name from articles group by 1 order by max(credibility_weight) desc, 1 limit 5)
    select 'last 7 days' as name, count(*) filter (body_quality = 'ok') / nullif(count(*), 0) as share, share >= 0.5 as passed from articles where published_at between timestamp '2024-01-18' and timestamp '2024-01-25'
    union all select source_name, count(*) filter (body_quality = 'ok') / nullif(count(*), 0) as s, s >= 0.8 from articles where source_name in (select source_name from best) group by 1""",
)
def _(t: Tables) -> DataFrame:
    return launch_check(t.articles, AS_OF)


@query("D14_idf", "select normalized_key, greatest(0.01, ln(greatest((select count(distinct slug) from mentions), 1) / greatest(count(distinct slug), 1))) as idf from mentions group by 1")
def _(t: Tables) -> DataFrame:
    return idf(t.mentions)


def idf(mentions: DataFrame, floor: float = 0.01) -> DataFrame:
    """(normalized_key, idf) with idf = max(floor, ln(articles / articles with the key))."""
    pairs = mentions.select("slug", "normalized_key").distinct()
    total = pairs.agg(F.count_distinct("slug").alias("n"))
    counts = pairs.groupBy("normalized_key").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(total)).select("normalized_key", F.greatest(F.lit(floor), F.log(F.greatest("n", F.lit(1)) / F.greatest("df", F.lit(1)))).alias("idf"))


# --- W, S: windows and orders --------------------------------------------------------------------


@query("W1_top_per_group", "select category, slug, row_number() over (partition by category order by published_at desc, slug) as rank from posts qualify rank <= 5")
def _(t: Tables) -> DataFrame:
    return top_per_group(t.posts, "category", 5, F.desc("published_at"), F.asc("slug")).select("category", "slug", "rank")


@query("W4_survivor", "select owner, id from clusters qualify row_number() over (partition by owner order by score desc, id) = 1")
def _(t: Tables) -> DataFrame:
    return top_per_group(t.clusters, "owner", 1, F.desc("score"), F.asc("id")).select("owner", "id")


def timeline(members: DataFrame) -> DataFrame:
    """Per cluster its first row of each slug, in order of time."""
    first = members.groupBy("cluster_id", "slug").agg(F.min(F.struct("added_at", "place")).alias("x"))
    return first.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("x.added_at", "x.place", "slug"))), lambda r: r["slug"]).alias("slugs"))


@query(
    "W5_timeline",
    """with f as (select cluster_id, slug, min(struct_pack(a := added_at, p := place)) as x from members group by 1, 2)
    select cluster_id, list_aggregate(list_transform(list_sort(list(struct_pack(a := x.a, p := x.p, s := slug))), lambda r: r.s::varchar), 'string_agg', ',') as slugs from f group by 1""",
)
def _(t: Tables) -> DataFrame:
    return timeline(t.members).select("cluster_id", F.array_join(F.col("slugs").cast("array<string>"), ",").alias("slugs"))


ORDERS = {
    "newest": lambda: [F.desc("published_at"), F.asc("slug")],
    "oldest": lambda: [F.asc("published_at"), F.asc("slug")],
    "cvss": lambda: [F.desc_nulls_last("cvss_score"), F.desc("published_at"), F.asc("slug")],
    "relevance": lambda: [F.desc("relevance"), F.asc("slug")],
}


@query("S1_orders", "select slug from (select slug from articles order by cvss_score desc nulls last, published_at desc, slug limit 50)")
def _(t: Tables) -> DataFrame:
    return t.articles.orderBy(*ORDERS["cvss"]()).limit(50).select("slug")


@query(
    "S1_relevance",
    """with h as (select slug, len(list_filter(raw_tags, lambda x: x in ('the', 'of', 'la', 'der'))) as relevance from articles)
    select slug, relevance from h where relevance > 0 order by relevance desc, slug limit 50""",
)
def _(t: Tables) -> DataFrame:
    hits = t.articles.select("slug", F.size(F.filter("raw_tags", lambda x: x.isin("the", "of", "la", "der"))).cast("long").alias("relevance"))
    return hits.filter("relevance > 0").orderBy(*ORDERS["relevance"]()).limit(50)


FEED = {
    "latest": ["latest_at"], "score": ["score", "latest_at"], "coverage": ["article_count", "latest_at"],
    "severity": ["max_cvss", "latest_at"], "trending": ["article_count", "updated_at"],
}


def feed_order(clusters: DataFrame, kind: str) -> DataFrame:
    return clusters.orderBy(*(F.desc_nulls_last(c) for c in FEED[kind]), F.asc("id"))


def _counted(t: Tables) -> DataFrame:
    counts = t.members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("article_count"))
    cvss = F.when(F.col("id") % 4 > 0, F.col("id") % 97 / 10.0)
    return t.clusters.join(counts, "id").select("id", "score", "latest_at", F.col("created_at").alias("updated_at"), "article_count", cvss.alias("max_cvss"))


_FEED = "select '{kind}' as kind, id, place from (select id, row_number() over (order by {by}, id) as place from c) z where place <= 40"
_FEED_SQL = {"latest": "latest_at desc", "score": "score desc, latest_at desc", "coverage": "n desc, latest_at desc", "severity": "max_cvss desc nulls last, latest_at desc", "trending": "n desc, created_at desc"}


@query(
    "S2_feed",
    "with c as (select id, score, latest_at, created_at, n, case when id % 4 > 0 then id % 97 / 10.0 end as max_cvss from clusters join (select cluster_id as id, count(*) as n from members group by 1) using (id)) "
    + " union all ".join(_FEED.format(kind=k, by=v) for k, v in _FEED_SQL.items()),
)
def _(t: Tables) -> DataFrame:
    """The first 40 of each order, with their place."""
    parts = []
    for kind in FEED:
        top = feed_order(_counted(t), kind).limit(40)
        place = F.row_number().over(Window.orderBy(*(F.desc_nulls_last(c) for c in FEED[kind]), F.asc("id")))
        parts.append(top.select(F.lit(kind).alias("kind"), "id", place.cast("long").alias("place")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("S3_offset", "select id from clusters order by score desc, id limit 25 offset 100")
def _(t: Tables) -> DataFrame:
    return t.clusters.orderBy(F.desc("score"), "id").offset(100).limit(25).select("id")


def brief_selection(rows: DataFrame, as_of: str, n: int = 7) -> DataFrame:
    """The best of the last 24 hours that are not roundups."""
    recent = rows.filter(F.col("published_at").between(at(as_of) - F.expr("interval 24 hours"), at(as_of)) & ~F.coalesce("is_roundup", F.lit(False)))
    return recent.orderBy(F.desc("score"), "slug").limit(n)


@query("S4_brief", "select slug, score from posts where published_at between timestamp '2024-01-24' and timestamp '2024-01-25' and category <> 'view' order by score desc, slug limit 7")
def _(t: Tables) -> DataFrame:
    return brief_selection(t.posts.withColumn("is_roundup", F.when(F.col("category") == "view", True)), AS_OF).select("slug", "score")


# --- C: joins of the read side -------------------------------------------------------------------


@query("C1_cluster_articles", "select l_orderkey as cluster_id, p_partkey as slug, p_type as type from lineitem join part on l_partkey = p_partkey where p_size > 25")
def _(t: Tables) -> DataFrame:
    articles = t.part.select(F.col("p_partkey").alias("slug"), F.col("p_type").alias("type"), "p_size")
    return cluster_articles(t.members, articles, F.col("p_size") > 25).select("cluster_id", "slug", "type")


def cluster_articles(members: DataFrame, articles: DataFrame, test: Column | None = None) -> DataFrame:
    return members.join(articles if test is None else articles.filter(test), "slug")


@query("C2_clusters_by_topic", "select id from clusters where id in (select l_orderkey from lineitem join part on l_partkey = p_partkey where p_size = 7)")
def _(t: Tables) -> DataFrame:
    wanted = t.members.join(t.part.filter("p_size = 7").select(F.col("p_partkey").alias("slug")), "slug", "left_semi")
    return t.clusters.join(wanted.select(F.col("cluster_id").alias("id")), "id", "left_semi").select("id")


def with_top_article(clusters: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters with their first member; those whose first member is no article go."""
    first = members.groupBy("cluster_id").agg(F.min_by("slug", F.struct("place", "slug")).alias("slug"))
    return clusters.join(first, clusters["id"] == first["cluster_id"]).join(articles, "slug")


@query(
    "C3_top_article",
    "with f as (select cluster_id, arg_min(slug, struct_pack(p := place, s := slug)) as slug from members group by 1) select id, slug, p_type from clusters join f on id = cluster_id join part on slug = p_partkey where p_size < 40",
)
def _(t: Tables) -> DataFrame:
    articles = t.part.filter("p_size < 40").select(F.col("p_partkey").alias("slug"), "p_type")
    return with_top_article(t.clusters, t.members, articles).select("id", "slug", "p_type")


@query("C20_split", "select slug, count(*) as articles, count(distinct cluster_id) as clusters from members group by 1 having count(*) >= 2 and count(distinct cluster_id) > 1")
def _(t: Tables) -> DataFrame:
    return split_groups(t.members, "slug")


def split_groups(rows: DataFrame, key: str) -> DataFrame:
    out = rows.groupBy(key).agg(F.count("*").alias("articles"), F.count_distinct("cluster_id").alias("clusters"))
    return out.filter("articles >= 2 and clusters > 1")


@query(
    "C21_bookmarks",
    """select o_custkey as user_id, l_partkey as article_id, max(o_orderdate) as marked_at, count(*) over (partition by o_custkey) as total
    from orders join lineitem on o_orderkey = l_orderkey where o_custkey % 100 = 7 group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    marks = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("article_id")).agg(F.max("o_orderdate").alias("marked_at"))
    return bookmarked(marks, F.col("user_id") % 100 == 7)


def bookmarked(bookmarks: DataFrame, users: Column) -> DataFrame:
    return bookmarks.filter(users).withColumn("total", F.count("*").over(Window.partitionBy("user_id")))


def repair_counts(clusters: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters whose stored article_count differs from their existing members: id, stored, found."""
    found = members.join(articles, "slug", "left_semi").groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("found"))
    out = clusters.join(found, "id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.filter(~F.col("article_count").eqNullSafe(F.col("found"))).select("id", F.col("article_count").alias("stored"), "found")


@query(
    "C22_repair_counts",
    "with f as (select cluster_id as id, count(*) as n from members where slug in (select p_partkey from part where p_size > 10) group by 1) select id, 3::bigint as stored, coalesce(n, 0) as found from clusters left join f using (id) where coalesce(n, 0) <> 3",
)
def _(t: Tables) -> DataFrame:
    articles = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("slug"))
    return repair_counts(t.clusters.withColumn("article_count", F.lit(3).cast("long")), t.members, articles)


@query("C23_entity_articles", "select m.slug, a.title from mentions m join articles a using (slug) where normalized_key = 'the' order by a.published_at desc, m.slug limit 50")
def _(t: Tables) -> DataFrame:
    return entity_articles(t.mentions, t.articles, "the").limit(50).select("slug", "title")


def entity_articles(mentions: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    return mentions.filter(F.col("normalized_key") == key).select("slug").join(articles, "slug").orderBy(F.desc("published_at"), "slug")
