"""How the given tables play the parts of articles, clusters, mentions and so on, in Spark and SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

_ARTICLES = """
    select 'a' || doc_id as slug, doc_id, {left}(split_part(text, '{nl}', 1), 500) as title, text as body, source as source_name, lang as category,
           {at} as published_at,
           case when doc_id % 5 = 0 then null else (doc_id * 13 % 101) / 10.0 end as cvss_score,
           case when doc_id % 3 = 0 then array('CVE-2024-' || (1000 + cast(floor(doc_id / 40) as int)), 'cve-2024-' || (100000 + cast(floor(doc_id / 15) as int))) else {empty} end as cve_ids,
           {tags} as raw_tags,
           0.8 + 0.25 * (cast(substr(source, 4) as int) % 4) as credibility_weight,
           case doc_id % 4 when 0 then 'ok' when 1 then 'weak' when 2 then 'empty' else null end as body_quality,
           case doc_id % 7 when 0 then 'kev_catalog' when 1 then 'ics_advisory' when 2 then 'product_advisory' else 'news' end as content_type
    from documents
"""
_CLUSTERS = """
    select o_orderkey as id, o_totalprice / 5000.0 as score, o_orderdate as latest_at, {created} as created_at, o_custkey as owner,
           case o_orderstatus when 'F' then 'confirmed' when 'O' then 'developing' else 'new' end as state, o_orderpriority as category
    from orders
"""
_MEMBERS = "select l_orderkey as cluster_id, l_partkey as slug, l_suppkey as source_name, l_linenumber as place, l_shipdate as added_at from lineitem"
_TOPICS = "select 'CVE-2024-' || (1000 + cast(floor(p_partkey / 40) as int)) as cve_id, max(p_size) / 5.0 as cvss, max(p_retailprice) / 3000.0 as epss from part group by 1"
#: Names of tags by their first letter, then CVEs, in the order of their places: all eight types.
_MENTIONS = """
    select slug, name, {key} as normalized_key, case when {first} in ('a', 'e', 'i', 'o', 'u') then 'actor' when {first} in ('c', 's') then 'campaign' when {first} in ('v', 'w') then 'vuln_alias'
        when {first} in ('m', 'n') then 'vendor' when {first} = 'p' then 'product' when {first} = 't' then 'tool' else 'malware' end as type, source_name, published_at, place
    from (select slug, source_name, published_at, {explode} from articles) x where {key} <> ''
    union all
    select slug, upper(name), lower(name), 'cve', source_name, published_at, 100 + place from (select slug, source_name, published_at, {cves} from articles) y
"""
_SPARK = {
    "left": "left", "nl": "\\n", "at": "timestampadd(MINUTE, cast(doc_id * 37 % 43200 as int), timestamp'2024-01-01 00:00:00')", "empty": "cast(array() as array<string>)",
    "tags": "slice(split(lower(split_part(text, '\\n', 1)), ' '), 1, 3)", "key": "trim(both '-' from regexp_replace(lower(name), '[^a-z0-9]+', '-'))", "first": "left(name, 1)", "explode": "posexplode(raw_tags) as (place, name)", "cves": "posexplode(cve_ids) as (place, name)",
    "created": "timestampadd(DAY, -cast(o_orderkey % 9 as int), o_orderdate)",
}
_DUCK = {
    "left": "left", "nl": "' || chr(10) || '", "at": "timestamp '2024-01-01 00:00:00' + to_minutes(doc_id * 37 % 43200)", "empty": "[]::varchar[]",
    "tags": "string_split(lower(split_part(text, chr(10), 1)), ' ')[1:3]", "key": "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')", "first": "left(name, 1)", "explode": "unnest(raw_tags) as name, generate_subscripts(raw_tags, 1) - 1 as place", "cves": "unnest(cve_ids) as name, generate_subscripts(cve_ids, 1) - 1 as place",
    "created": "o_orderdate - to_days((o_orderkey % 9)::int)",
}
_SQL = {"articles": _ARTICLES, "clusters": _CLUSTERS, "members": _MEMBERS, "topics": _TOPICS, "mentions": _MENTIONS}
_NEEDS = {"articles": ["documents"], "clusters": ["orders"], "members": ["lineitem"], "topics": ["part"], "mentions": ["articles"]}


def _role(name: str):
    def build(t):
        for need in _NEEDS[name]:
            getattr(t, need).createOrReplaceTempView(need)
        return t.spark.sql(_SQL[name].format(**_SPARK))

    return build


ROLES = {name: _role(name) for name in _SQL}
#: Events as articles: published_at, category, source, score.
ROLES["posts"] = lambda t: t.events.select(
    F.col("event_id").alias("slug"), F.col("ts").cast("timestamp").alias("published_at"), F.col("event_type").alias("category"), F.col("user_id").alias("source_name"), F.col("value").alias("score"), "props"
)


def _vectors(t):
    """Vectors of articles: seven in a row have a vector in common, to which many add half of one of their own."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    docs = t.documents.select("doc_id").join(e.withColumnRenamed("vec_id", "of"), F.floor(F.col("doc_id") / 7) == F.col("of")).join(e.select(F.col("vec_id").alias("doc_id"), F.col("v").alias("own")), "doc_id", "left")
    return docs.select(F.concat(F.lit("a"), "doc_id").alias("slug"), F.when(F.col("own").isNull(), F.col("v")).otherwise(F.zip_with("v", "own", lambda x, y: x + y / 2)).alias("vector"))


ROLES["vectors"] = _vectors
_DUCK_SQL = {k: v.format(**_DUCK).replace("array(", "list_value(") for k, v in _SQL.items()} | {
    "vectors": "select 'a' || d.doc_id as slug, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double + coalesce(b.embedding[i]::double / 2, 0)) as vector from documents d join embeddings a on a.vec_id = d.doc_id // 7 left join embeddings b on b.vec_id = d.doc_id",
    "posts": "select event_id as slug, ts::timestamp as published_at, event_type as category, user_id as source_name, value as score, props from events"
}


def with_roles(sql: str) -> str:
    """DuckDB SQL with the roles it names as leading common table expressions."""
    used = {k for k in _DUCK_SQL if re.search(rf"\b{k}\b", sql)}
    used |= {"articles"} if "mentions" in used else set()
    parts = [f"{k} as ({_DUCK_SQL[k]})" for k in _DUCK_SQL if k in used]
    if not parts:
        return sql
    body = sql.strip()
    again = re.match("(?i)with (recursive )?", body)
    return f"with {again and again[1] or ''}{', '.join(parts)}" + (", " + body[again.end() :] if again else " " + body)
