"""Whole rows of clusters: built from members, updated, merged, shown, rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.operators.assignment import Profiles, assign_clusters, described, profile_scores, routed, scored_keys
from newsgraph.operators.clusters import SIGNATURE, connected, event_signature
from newsgraph.operators.intel import extract_entities
from newsgraph.operators.normalize import normalized_key
from newsgraph.operators.read import at, cluster_type, idf
from newsgraph.operators.score import MERGE, importance, lifecycle, mean_vector
from newsgraph.operators.tables import mark_kev
from newsgraph.plans.exchange import written
from newsgraph.registry import Tables, query

#: Lists of an event signature and the type of the entities in each.
LISTS = {"cve_ids": "cve"} | SIGNATURE


def _none() -> Column:
    return F.array().cast("array<string>")


def signature_of(lists: dict[str, Column], otherwise: Column) -> Column:
    """An event signature of these lists, with its confidence; `otherwise` if they say nothing."""
    n = lambda c: F.size(lists[c])
    sure = F.when((n("cve_ids") >= 2) | ((n("cve_ids") > 0) & (n("vuln_aliases") > 0)), "high").when((n("cve_ids") > 0) | (n("vuln_aliases") > 0) | (n("campaign_names") > 0), "medium").otherwise(otherwise)
    return F.struct(*(c.alias(name) for name, c in lists.items()), sure.alias("confidence"))


def _ordered(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """(key, name): the distinct values of a key in the order in which they come first."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))


def build_clusters(members: DataFrame, articles: DataFrame, mentions: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each cluster with all that its members say.

    members: cluster_id, slug; articles: slug, title, source_name, published_at, category, content_type,
    cvss_score, credibility_weight, cve_ids; mentions: slug, type, normalized_key, place; vectors: slug,
    vector. The member first by (published_at, slug) founds the cluster: label, category, kind,
    founding entities and seed CVEs are its own and stay. Lists are distinct, in the order in which
    members bring them; timeline and slugs are in order of publication. Unknown scores and vectors are
    null. A slug that a cluster has twice counts once. The parts are grouped by cluster one by one,
    so what is shuffled to a cluster is its members and entities, never their product.
    """
    known = articles.select("slug", "title", "source_name", "published_at", "category", "content_type", "cvss_score", "credibility_weight", "cve_ids")
    rows = written(members.select("cluster_id", "slug").distinct().join(known, "slug").withColumn("order", F.struct("published_at", "slug")))
    entry = F.struct("published_at", "slug", "source_name", "title")
    facts = rows.groupBy("cluster_id").agg(
        F.min_by(F.struct("slug", "title", "category", "content_type", "cve_ids"), "order").alias("seed"), F.count("*").alias("article_count"),
        F.count_distinct(F.nullif("source_name", F.lit(""))).alias("source_count"), F.min("published_at").alias("earliest_at"), F.max("published_at").alias("latest_at"),
        F.max("cvss_score").alias("max_cvss"), F.max("credibility_weight").alias("max_credibility_weight"), F.array_sort(F.collect_list(entry)).alias("timeline"),
    )
    cves = rows.select("cluster_id", "order", F.posexplode(F.transform("cve_ids", F.upper)).alias("pos", "cve")).withColumn("o", F.struct("order", "pos"))
    cves = _ordered(cves, "cluster_id", "cve", "o", "cve_ids")
    named = rows.select("cluster_id", "slug", "order").join(mentions.select("slug", "type", "normalized_key", "place"), "slug").withColumn("place", F.struct("order", "place"))
    keys = _ordered(named, "cluster_id", "normalized_key", "place", "entity_keys")
    signature = event_signature(named.select(F.col("cluster_id").alias("slug"), "type", "normalized_key", "place"))
    signature = signature.select(F.col("slug").alias("cluster_id"), F.struct(*LISTS, "confidence").alias("event_signature"))
    founders = facts.select("cluster_id", F.col("seed.slug").alias("slug"))
    founding = founders.join(mentions.select("slug", "type", "normalized_key", "place"), "slug").groupBy("cluster_id", "type", "normalized_key").agg(F.min("place").alias("place"))
    founding = founding.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "type", "normalized_key"))), lambda x: F.struct(x["type"].alias("type"), x["normalized_key"].alias("normalized_key"))).alias("founding"))
    centroids = mean_vector(rows.select("cluster_id", "slug").join(vectors.select("slug", "vector"), "slug"), "cluster_id", "vector").select("cluster_id", "centroid")
    out = facts
    for part in (cves, keys, signature, founding, centroids):
        out = out.join(part, "cluster_id", "left")
    empty = signature_of({name: _none() for name in LISTS}, F.lit("low"))
    seed = lambda c: F.col(f"seed.{c}")
    types = F.transform("founding", lambda x: x["type"])
    n = F.col("article_count")
    return out.select(
        "cluster_id", seed("title").alias("label"), F.when(n == 1, "new").otherwise(lifecycle(n, F.lit("new"))).alias("state"),
        cluster_type(seed("content_type"), F.size(F.coalesce(seed("cve_ids"), _none())), types).alias("cluster_type"), (seed("content_type") == "ics_advisory").alias("is_advisory"),
        F.array(seed("category")).alias("categories"), "article_count", "source_count", "earliest_at", "latest_at", "max_cvss", "max_credibility_weight",
        F.transform("timeline", lambda x: x["slug"]).alias("article_ids"), "timeline", F.coalesce("cve_ids", _none()).alias("cve_ids"), F.transform(F.coalesce(seed("cve_ids"), _none()), F.upper).alias("seed_cve_ids"),
        F.coalesce("entity_keys", _none()).alias("entity_keys"), F.coalesce("founding", F.array().cast("array<struct<type:string,normalized_key:string>>")).alias("founding"),
        F.coalesce("event_signature", empty).alias("event_signature"), "centroid", F.lit(None).cast("bigint").alias("merged_into"),
    )


def update_clusters(clusters: DataFrame, members: DataFrame, articles: DataFrame, mentions: DataFrame, vectors: DataFrame, touched: DataFrame) -> DataFrame:
    """The table with the touched clusters (cluster_id) built anew from all their members, the others as they are."""
    touched = touched.select("cluster_id").distinct()
    fresh = build_clusters(members.join(touched, "cluster_id", "left_semi"), articles, mentions, vectors)
    return clusters.join(touched, "cluster_id", "left_anti").unionByName(fresh)


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("cluster_id", "id")


def signature_entities(clusters: DataFrame) -> DataFrame:
    """(id, type, normalized_key) of what the signatures hold; CVEs in lower case, as mentions have them."""

    def typed(name: str, kind: str) -> Column:
        return F.transform(f"event_signature.{name}", lambda x: F.struct(F.lit(kind).alias("type"), F.lower(x).alias("normalized_key")))

    lists = [typed(*x) for x in LISTS.items()]
    return clusters.select(F.col("cluster_id").alias("id"), F.explode(F.flatten(F.array(*lists))).alias("x")).select("id", "x.*").distinct()


def detect_merges(clusters: DataFrame, weights: DataFrame, as_of: Column, hours: float, least: float = MERGE) -> DataFrame:
    """(id, survivor) of clusters that are to be one, chains followed; the largest survives, then the least id.

    clusters: rows of build_clusters() and updated_at. Those of the last `hours` that are not resolved are
    compared with all that are not resolved and share a CVE, an alias or a campaign with them: K2 of
    the signature of the one and the founding of the other, with their centroids; where both are
    recent the better of the two counts. They are scored in blocks (profile_scores), as common keys
    make pairs with the square of the clusters; only pairs that score enough are moved, and of
    these those count that share such a key.
    """
    live = clusters.filter("state <> 'resolved'").withColumn("profile", F.col("cluster_id").cast("long"))
    recent = live.filter(F.col("updated_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    entities, weights = written(signature_entities(live)), written(weights)
    vectors = live.filter("centroid is not null").select("profile", F.col("centroid").alias("vector"))
    told = lambda types: described(Profiles(None, types, scored_keys(types, "profile"), vectors), weights)
    mine, theirs = told(entities.withColumnRenamed("id", "profile")), told(live.select("profile", F.explode("founding").alias("x")).select("profile", "x.*"))
    asking = recent.select("profile", as_of.alias("until"), F.lit(None).cast("double").alias("sure"))
    stored = live.select("profile", as_of.alias("since"), F.lit(False).alias("steady"), F.lit(None).cast("string").alias("first"))
    near = profile_scores(asking, stored, mine, least, theirs).filter("a <> b").select(F.col("a").alias("slug"), F.col("b").alias("id"))
    keys = entities.filter(F.col("type").isin("cve", "vuln_alias", "campaign"))
    scored = near.join(keys.withColumnRenamed("id", "slug"), "slug").join(keys, ["id", "type", "normalized_key"], "left_semi").select("slug", "id")
    roots = connected(scored.select(F.least("slug", "id").alias("a"), F.greatest("slug", "id").alias("b")).distinct())
    sizes = live.select(F.col("cluster_id").alias("id"), "article_count")
    best = roots.join(sizes, "id").groupBy("root").agg(F.max_by("id", F.struct("article_count", -F.col("id"))).alias("survivor"))
    return roots.join(best, "root").select("id", "survivor")


def absorb(clusters: DataFrame, moved: DataFrame) -> DataFrame:
    """The table after the merges (id, survivor): any number of clusters become one in one aggregate.

    The survivor gets the members, CVEs, entities and timeline of all (its own first, then by id),
    the mean of their centroids by their sizes (those without do not count), the signature of their
    lists, and the state of its new size; what its founding was stays. The others are resolved and
    say what they went into; clusters that went into one of them before say so too. The result has
    the columns of the input, updated_at if it is there included, as it was.
    """
    links = moved.select(F.col("id").alias("cluster_id"), "survivor").distinct()
    rows = written(clusters.join(links, "cluster_id", "left").withColumn("survivor", F.coalesce("survivor", "cluster_id")))
    groups = rows.join(links.select("survivor").distinct(), "survivor", "left_semi")
    groups = groups.withColumn("rank", F.struct((F.col("cluster_id") != F.col("survivor")).alias("o"), F.col("cluster_id").alias("i")))
    kept_lists = {"cve_ids": F.col("cve_ids"), "entity_keys": F.col("entity_keys")} | {f"s_{n}": F.col(f"event_signature.{n}") for n in LISTS}
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("x")))), lambda r: r["x"])))
    lists = groups.groupBy("survivor").agg(*(union(c).alias(name) for name, c in kept_lists.items()), F.min_by("event_signature.confidence", "rank").alias("sure"), F.max("latest_at").alias("latest_at"), F.min("earliest_at").alias("earliest_at"))
    entries = groups.select("survivor", "rank", F.posexplode("timeline").alias("pos", "entry"))
    once = entries.groupBy("survivor", "entry.slug").agg(F.min_by("entry", F.struct("rank", "pos")).alias("entry"), F.min(F.struct("rank", "pos")).alias("o"))
    lines = once.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "entry"))), lambda r: r["entry"]).alias("timeline"))
    parts = groups.filter("centroid is not null").select("survivor", "article_count", F.posexplode("centroid").alias("i", "x"))
    means = parts.groupBy("survivor", "i").agg((F.sum(F.col("x") * F.col("article_count")) / F.sum("article_count")).alias("m"))
    centroids = means.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("centroid"))
    fresh = lists.join(lines, "survivor").join(centroids, "survivor", "left").withColumnRenamed("survivor", "cluster_id")
    signature = signature_of({n: F.col(f"s_{n}") for n in LISTS}, F.col("sure"))
    fresh = fresh.withColumn("event_signature", signature).withColumn("article_ids", F.transform("timeline", lambda e: e["slug"]))
    changed = ["cve_ids", "entity_keys", "latest_at", "earliest_at", "timeline", "centroid", "event_signature", "article_ids"]
    base = rows.filter("cluster_id = survivor").drop("survivor")
    n = F.size("article_ids").cast("long")
    survivors = base.drop(*changed).join(fresh.select("cluster_id", *changed), "cluster_id").withColumn("article_count", n).withColumn("state", lifecycle(n, F.col("state")))
    same = base.join(fresh.select("cluster_id"), "cluster_id", "left_anti")
    gone = rows.filter("cluster_id <> survivor").withColumn("merged_into", F.col("survivor").cast(dict(clusters.dtypes)["merged_into"])).withColumn("state", F.lit("resolved")).drop("survivor")
    out = survivors.select(*clusters.columns).unionByName(same.select(*clusters.columns)).unionByName(gone.select(*clusters.columns))
    again = links.select(F.col("cluster_id").alias("merged_into"), F.col("survivor").alias("_to"))
    return out.join(again, "merged_into", "left").withColumn("merged_into", F.coalesce("_to", "merged_into")).select(*clusters.columns)


def cluster_detail(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(cluster_id, label, state, article_count, articles, keywords, timeline, earliest_at, latest_at): clusters
    with those of their articles that are still there, newest first, all keywords of these, and the time
    that they span. article_count is what is there; the timeline is kept as it was."""
    links = clusters.select("cluster_id", F.explode("article_ids").alias("slug"))
    rows = links.join(articles.select("slug", "title", "source_name", "published_at", "keywords"), "slug")
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("published_at", "slug", "title", "source_name"))))
    shown = rows.groupBy("cluster_id").agg(F.count("*").alias("article_count"), newest.alias("articles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"), F.min("published_at").alias("earliest_at"), F.max("published_at").alias("latest_at"))
    out = clusters.select("cluster_id", "label", "state", "timeline").join(shown, "cluster_id", "left")
    return out.withColumn("article_count", F.coalesce("article_count", F.lit(0)))


# --- queries over the given tables: five articles in a row are a cluster ---------------------------


def _of_five() -> Column:
    return F.floor(F.col("doc_id") / 5).alias("cluster_id")


def _articles(t: Tables) -> DataFrame:
    return t.articles.withColumn("credibility_weight", F.col("credibility_weight").cast("double")).withColumn("cvss_score", F.col("cvss_score").cast("double"))


def _once(t: Tables) -> Tables:
    return t.once("doc_id", "title", "category", "content_type", "cvss_score", "credibility_weight")


def _built(t: Tables) -> DataFrame:
    t = _once(t)
    return build_clusters(t.articles.select(_of_five(), "slug"), _articles(t), t.mentions, t.vectors)


def _probe(c: str) -> Column:
    return F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b), 2)


def _flat(df: DataFrame) -> DataFrame:
    """Lists as texts, the centroid as a number, for comparison with SQL."""
    text = lambda c: F.array_join(c, ",").alias(c.rsplit(".", 1)[-1])
    return df.select(
        "cluster_id", F.sha2("label", 256).alias("label"), "state", "cluster_type", "is_advisory", F.col("categories")[0].alias("category"), "article_count", "source_count", "earliest_at", "latest_at", F.round("max_cvss", 3).alias("max_cvss"), F.round("max_credibility_weight", 3).alias("max_credibility_weight"),
        text("article_ids"), text("cve_ids"), text("seed_cve_ids"), text("entity_keys"), F.array_join(F.transform("founding", lambda x: F.concat(x["type"], F.lit(":"), x["normalized_key"])), ",").alias("founding"),
        *(F.array_join(f"event_signature.{n}", ",").alias(f"sig_{n}") for n in LISTS), F.col("event_signature.confidence").alias("confidence"),
        F.array_join(F.transform("timeline", lambda e: F.concat(e["slug"], F.lit("@"), e["source_name"])), ",").alias("timeline"), _probe("centroid").alias("probe"),
    )


def _list(table: str, key: str, value: str, order: str, where: str = "true") -> str:
    return f"(select {key} as k, string_agg({value}, ',' order by o) as v from (select {key}, {value}, min({order}) as o from {table} where {where} group by 1, 2) z group by 1)"


_BUILD_SQL = (
    """with w as (select *, doc_id // 5 as c from articles), r as (select *, row_number() over (order by published_at, slug) as o from w),
    m as (select r.c, r.o, n.* from r join (select slug as s, type, normalized_key, place from mentions) n on n.s = r.slug),
    u as (select c, o, upper(unnest(cve_ids)) as cve, generate_subscripts(cve_ids, 1) as p from r), f as (select * from r qualify row_number() over (partition by c order by o) = 1),
    g as (select c, count(*) as n, count(distinct nullif(source_name, '')) as sources, min(published_at) as earliest_at, max(published_at) as latest_at, max(cvss_score) as cvss, max(credibility_weight) as cred,
      string_agg(slug, ',' order by o) as ids, string_agg(slug || '@' || source_name, ',' order by o) as line from r group by 1),
    fm as (select c, string_agg(type || ':' || normalized_key, ',' order by place, type, normalized_key) as founding, bool_or(type in ('actor', 'campaign')) as named from (select f.c, x.type, x.normalized_key, min(x.place) as place from f join mentions x using (slug) group by 1, 2, 3) y group by 1),
    x as (select c, i, round(avg(v), 6) as v from (select c, unnest(vector) as v, generate_subscripts(vector, 1) as i from r join vectors using (slug)) z group by 1, 2), ce as (select c, round(sum(v * i), 2) as probe from x group by 1),
    """
    + ", ".join(f"s_{name} as {_list('m', 'c', 'normalized_key', 'o * 1000 + place', f"type = '{kind}'")}" for name, kind in LISTS.items())
    + ", k as "
    + _list("m", "c", "normalized_key", "o * 1000 + place")
    + ", cv as "
    + _list("u", "c", "cve", "o * 1000 + p")
    + """, b as (select f.c as cluster_id, sha256(f.title) as label, case when n >= 3 then 'confirmed' when n = 2 then 'developing' else 'new' end as state,
      case when f.content_type in ('ics_advisory', 'product_advisory') then 'advisory' when len(f.cve_ids) > 0 then 'cve_incident' when named then 'campaign' else 'research' end as cluster_type, f.content_type = 'ics_advisory' as is_advisory, f.category, n as article_count, sources as source_count,
      earliest_at, latest_at, round(cvss, 3) as max_cvss, round(cred, 3) as max_credibility_weight, ids as article_ids, coalesce(cv.v, '') as cve_ids, coalesce(array_to_string(list_transform(f.cve_ids, lambda x: upper(x)), ','), '') as seed_cve_ids, coalesce(k.v, '') as entity_keys, coalesce(founding, '') as founding, """
    + ", ".join(f"coalesce(s_{n}.v, '') as sig_{n}" for n in LISTS)
    + """, line as timeline, probe from f join g using (c) left join fm using (c) left join ce using (c) left join k on k.k = f.c left join cv on cv.k = f.c """
    + " ".join(f"left join s_{n} on s_{n}.k = f.c" for n in LISTS)
    + """) select *, case when contains(sig_cve_ids, ',') or (sig_cve_ids <> '' and sig_vuln_aliases <> '') then 'high' when sig_cve_ids <> '' or sig_vuln_aliases <> '' or sig_campaign_names <> '' then 'medium' else 'low' end as confidence from b"""
)


@query("K5_build", _BUILD_SQL)
def _(t: Tables) -> DataFrame:
    return _flat(_built(t))


@query("K6_update", _BUILD_SQL)
def _(t: Tables) -> DataFrame:
    """Clusters of some of their members, of which those that got more are built anew."""
    t = _once(t)
    some = t.articles.filter("doc_id % 3 > 0 or doc_id % 10 < 5").select(_of_five(), "slug")
    old = build_clusters(some, _articles(t), t.mentions, t.vectors)
    late = t.articles.filter("doc_id % 3 = 0 and doc_id % 10 >= 5").select(_of_five())
    return _flat(update_clusters(old, t.articles.select(_of_five(), "slug"), _articles(t), t.mentions, t.vectors, late))


def _aliased(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Mentions, with an alias for the larger CVE of each article that has some, and clusters of five of these with their state and last update."""
    alias = t.articles.filter("doc_id % 3 = 0").select("slug", F.lit("x").alias("name"), F.concat(F.lit("alias-"), F.floor(F.col("doc_id") / 40)).alias("normalized_key"), F.lit("vuln_alias").alias("type"), "source_name", "published_at", F.lit(200).alias("place"))
    mentions = t.mentions.unionByName(alias)
    built = build_clusters(t.articles.select(_of_five(), "slug"), _articles(t), mentions, t.vectors)
    rows = built.withColumn("state", F.when(F.col("cluster_id") % 7 == 5, "resolved").otherwise(F.col("state"))).withColumn("updated_at", F.col("latest_at"))
    return mentions, written(rows)


_MERGES_SQL = """with recursive ms as (select slug, normalized_key, type from mentions union all select slug, 'alias-' || (doc_id // 40), 'vuln_alias' from articles where doc_id % 3 = 0),
    r as (select *, doc_id // 5 as c from articles), f as (select * from r qualify row_number() over (partition by c order by published_at, slug) = 1),
    live as (select c, count(*) as n, max(published_at) as updated_at from r where c % 7 <> 5 group by 1), recent as (select c from live where updated_at >= timestamp '2024-01-28' - interval 240 hour),
    kind as (select *, case when type = 'cve' then 'cve' when type = 'vuln_alias' then 'alias' when type in ('actor', 'campaign') then 'actor' else 'other' end as kind from ms),
    nn as (select count(distinct slug) as n from ms), wt as (select normalized_key, greatest(0.01, ln(n / count(distinct slug))) as w from ms, nn group by normalized_key, n),
    sig as (select distinct c, type, kind, normalized_key, w from kind join r using (slug) join live using (c) join wt using (normalized_key) where type in ('cve', 'vuln_alias', 'campaign', 'product', 'actor')),
    fo as (select distinct c, kind, normalized_key, w from kind join f using (slug) join live using (c) join wt using (normalized_key) where type not in ('vendor', 'cwe')), anyf as (select distinct c from ms join f using (slug)),
    p as (select distinct x.c as a, y.c as b from sig x join sig y using (type, normalized_key) where x.type in ('cve', 'vuln_alias', 'campaign') and x.c <> y.c and x.c in (select c from recent)),
    sx as (select distinct c, kind, normalized_key, w from sig), tx as (select c, sum(w) filter (kind = 'actor') as act, sum(w) filter (kind = 'other') as oth from sx group by 1), ty as (select c, sum(w) filter (kind = 'actor') as act, sum(w) filter (kind = 'other') as oth from fo group by 1),
    sh as (select a, b, bool_or(x.kind = 'cve') as cve, bool_or(x.kind = 'alias') as ali, sum(x.w) filter (x.kind = 'actor') as act, sum(x.w) filter (x.kind = 'other') as oth from p join sx x on x.c = a join fo y on y.c = b and y.kind = x.kind and y.normalized_key = x.normalized_key group by 1, 2),
    cd as (select c, i, round(avg(v), 6) as v from (select c, unnest(vector) as v, generate_subscripts(vector, 1) as i from r join vectors using (slug)) z group by 1, 2), ce as (select c, list(v order by i) as v from cd group by 1),
    s as (select p.a, p.b, least(1, greatest(0, (round(greatest(coalesce(list_cosine_similarity(x.v, y.v), 0), 0), 9) - 0.75) / 0.07)) as e, p.b in (select c from anyf) as founded,
      case when sh.cve then 0.10 else 0 end + case when sh.ali then 0.15 else 0 end + 0.22 * coalesce(sh.act / nullif(coalesce(tx.act, 0) + coalesce(ty.act, 0) - sh.act, 0), 0) + 0.18 * coalesce(sh.oth / nullif(coalesce(tx.oth, 0) + coalesce(ty.oth, 0) - sh.oth, 0), 0) as entity
      from p left join sh using (a, b) left join tx on tx.c = a left join ty on ty.c = b left join ce x on x.c = p.a left join ce y on y.c = p.b),
    g as (select a, b from s where round(case when founded and entity = 0 then 0 when founded then entity + 0.35 * e when e >= 1 then 0.35 else 0 end, 9) >= 0.55), e as (select a, b from g union select b, a from g),
    q as (select a as id, a as root from e union select e.b, q.root from q join e on e.a = q.id), co as (select id, min(root) as root from q group by 1),
    mg as (select id, first_value(id) over (partition by root order by n desc, id) as survivor from co join live on live.c = co.id)"""


@query("K10_merges", _MERGES_SQL + " select id, survivor from mg")
def _(t: Tables) -> DataFrame:
    mentions, clusters = _aliased(t)
    return detect_merges(clusters, idf(mentions), at("2024-01-28"), 240)


@query(
    "K11_absorb",
    _MERGES_SQL
    + """, o as (select r.c, case when r.c % 7 = 5 then 'resolved' end as was, r.slug, r.published_at, upper(r.cve_ids[1]) as c1, r.cve_ids from r),
    l as (select distinct c, coalesce(survivor, c) as s from o left join mg on id = c),
    a as (select l.s as c, count(*) as n, max(published_at) as latest_at, md5(string_agg(slug, ',' order by slug)) as slugs, max(was) as was from o join l using (c) group by 1),
    k as (select l.s as c, md5(string_agg(distinct normalized_key, ',' order by normalized_key)) as keys from ms join r using (slug) join l using (c) group by 1),
    cw as (select l.s as c, i, sum(v * n) / sum(n) as v from cd join (select c, count(*) as n from r group by 1) z using (c) join l using (c) where l.s in (select survivor from mg) group by 1, 2),
    pr as (select c, round(sum(round(v, 6) * i), 1) as probe from cw group by 1)
    select a.c as cluster_id, coalesce(was, case when a.n >= 3 then 'confirmed' when a.n = 2 then 'developing' else 'new' end) as state, null::bigint as merged_into, a.n as article_count, latest_at, slugs, coalesce(keys, md5('')) as keys, probe from a left join k using (c) left join pr using (c)
    union all select c, 'resolved', s, z.n, z.latest_at, null, null, null from l join (select c, count(*) as n, max(published_at) as latest_at from r group by 1) z using (c) where s <> c""",
)
def _(t: Tables) -> DataFrame:
    """Clusters after the merges that K10 finds."""
    mentions, clusters = _aliased(t)
    moved = written(detect_merges(clusters, idf(mentions), at("2024-01-28"), 240))
    out = absorb(clusters, moved).join(moved.select(F.col("survivor").alias("cluster_id"), F.lit(True).alias("grown")).distinct(), "cluster_id", "left")
    digest = lambda c: F.when(F.col("merged_into").isNull(), F.md5(F.array_join(F.array_sort(c), ",")))
    return out.select("cluster_id", "state", "merged_into", "article_count", "latest_at", digest("article_ids").alias("slugs"), digest("entity_keys").alias("keys"), F.when(F.col("grown"), F.round(_whole("centroid"), 1)).alias("probe"))


def _whole(c: str) -> Column:
    return F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)


@query(
    "K14_detail",
    """with r as (select *, doc_id // 5 as c from articles), k as (select c, string_agg(distinct tag, ',' order by tag) as keywords from (select c, unnest(raw_tags) as tag from r where doc_id % 11 <> 3) z group by 1),
    a as (select c, count(*) as n, string_agg(slug || ':' || source_name, ',' order by published_at desc, slug desc) as articles, min(published_at) as earliest_at, max(published_at) as latest_at from r where doc_id % 11 <> 3 group by 1),
    l as (select c, string_agg(slug, ',' order by published_at, slug) as timeline, count(*) as m, arg_min(title, struct_pack(p := published_at, s := slug)) as label from r group by 1)
    select c as cluster_id, sha256(label) as label, case when m >= 3 then 'confirmed' when m = 2 then 'developing' else 'new' end as state, coalesce(n, 0) as article_count, coalesce(articles, '') as articles, coalesce(keywords, '') as keywords, timeline, earliest_at, latest_at from l left join a using (c) left join k using (c)""",
)
def _(t: Tables) -> DataFrame:
    """Clusters of which some articles are gone."""
    there = t.articles.filter("doc_id % 11 <> 3").withColumn("keywords", F.col("raw_tags"))
    out = cluster_detail(_built(t), there)
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit("")).alias(c)
    return out.select("cluster_id", F.sha2("label", 256).alias("label"), "state", "article_count", text("articles", lambda x: F.concat(x["slug"], F.lit(":"), x["source_name"])), text("keywords", lambda x: x), text("timeline", lambda x: x["slug"]), "earliest_at", "latest_at")


# --- full rebuild ------------------------------------------------------------------------------------

STEPS = ("entities", "vectors", "epss", "clusters", "marks", "scores")


def typed_entities(articles: DataFrame, gazetteer: DataFrame, kev: DataFrame) -> DataFrame:
    """(slug, type, normalized_key, place) of extract_entities(): ids by their form, vendors of the catalogue, and
    names by the type that the gazetteer (name, normalized_key, is_alias, type) gives them."""
    found = extract_entities(articles, gazetteer, kev)
    types = gazetteer.groupBy("normalized_key").agg(F.min("type").alias("_type"))
    key = F.col("normalized_key")
    kind = F.when(F.col("rank") == 1, "vendor").when(F.col("rank") == 2, F.coalesce("_type", F.lit("tool"))).when(key.startswith("cve-"), "cve").when(key.startswith("cwe-"), "cwe").otherwise("ttp")
    return found.join(types, "normalized_key", "left").select("slug", kind.alias("type"), "normalized_key", F.col("rank").alias("place"))


def rebuild_all(articles: DataFrame, gazetteer: DataFrame, kev: DataFrame, chunks: DataFrame, epss: DataFrame, as_of: str, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables of a full rebuild by name, each step from what the steps before it gave, but for those to skip.

    entities (N13), vectors (D23: chunks pooled by article), epss (A12: the largest of a CVE), clusters (K4
    and K5: articles that may be in clusters placed one after the other, rows of all their members),
    marks (C16, C17: cisa_kev, is_advisory), scores (K9: score, confidence, top_factors at `as_of`). The
    CVEs of an article always count as its entities. Without a step its columns are null; without
    clusters there are no marks and scores. An unknown step is an error. articles also has
    content_type, title, body and what build_clusters() reads; chunks: slug, embedding.
    """
    if unknown := set(skip) - set(STEPS):
        raise ValueError(f"no such steps: {sorted(unknown)}")
    out: dict[str, DataFrame] = {}
    own = articles.select("slug", F.lit("cve").alias("type"), F.explode(F.array_distinct(F.transform("cve_ids", F.lower))).alias("normalized_key"), F.lit(0).alias("place"))
    entities = own
    if "entities" not in skip:
        out["entities"] = written(typed_entities(articles, gazetteer, kev))
        entities = written(own.unionByName(out["entities"]).groupBy("slug", "type", "normalized_key").agg(F.min("place").alias("place")))
    vectors = chunks.limit(0).select("slug", F.col("embedding").cast("array<double>").alias("vector"))
    if "vectors" not in skip:
        vectors = out["vectors"] = written(mean_vector(chunks, "slug").filter("centroid is not null").select("slug", F.col("centroid").alias("vector")))
    if "epss" not in skip:
        out["epss"] = written(epss.groupBy(F.upper("cve_id").alias("cve_id")).agg(F.max("epss").alias("epss")))
    if "clusters" in skip:
        return out
    placed = written(assign_clusters(routed(articles), entities, vectors, idf(entities)).filter("cluster is not null"))
    members = placed.select(F.col("cluster").alias("cluster_id"), "slug")
    rows = written(build_clusters(members, articles, entities, vectors).withColumn("merged_into", F.lit(None).cast("string")))
    if "marks" not in skip:
        marks = mark_kev(rows.select(F.col("cluster_id").alias("slug"), "cve_ids"), articles.filter("content_type = 'kev_catalog'")).withColumnRenamed("slug", "cluster_id")
        ics = members.join(articles.filter("content_type = 'ics_advisory'").select("slug"), "slug", "left_semi").select("cluster_id", F.lit(True).alias("_ics")).distinct()
        rows = rows.join(marks, "cluster_id").join(ics, "cluster_id", "left").withColumn("is_advisory", F.col("is_advisory") | F.coalesce("_ics", F.lit(False))).drop("_ics")
    else:
        rows = rows.withColumns({"cisa_kev": F.lit(None).cast("boolean"), "is_advisory": F.lit(None).cast("boolean")})
    if "epss" in out:
        likely = rows.select("cluster_id", F.explode("cve_ids").alias("cve_id")).join(out["epss"], "cve_id").groupBy("cluster_id").agg(F.max("epss").alias("max_epss"))
        rows = rows.join(likely, "cluster_id", "left")
    else:
        rows = rows.withColumn("max_epss", F.lit(None).cast("double"))
    if "scores" not in skip:
        ready = rows.withColumns({"cve_count": F.size("cve_ids"), "entity_count": F.size("entity_keys"), "credibility": F.col("max_credibility_weight")})
        rows = importance(ready, as_of).drop("cve_count", "entity_count", "credibility")
    out["clusters"] = rows
    return out


def rebuilt_all(t: Tables, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The rebuild of the given tables: names of the gazetteer are the first words of benchmark items."""
    kev = t.part.filter("p_size < 3").select(F.concat(F.lit("CVE-2024-"), 1000 + F.floor(F.col("p_partkey") / 40)).alias("cve_id"), F.col("p_brand").alias("vendor"))
    name = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), 1, 2), " ")
    kinds = F.when(F.length("name") % 3 == 0, "actor").when(F.length("name") % 3 == 1, "product").otherwise("malware")
    gazetteer = t.benchmark.select(name.alias("name")).distinct().select("name", normalized_key(F.col("name")).alias("normalized_key"), F.lit(False).alias("is_alias"), kinds.alias("type"))
    chunks = t.vectors.select("slug", F.explode(F.array(F.col("vector"), F.transform("vector", lambda x: x * 3), F.lit(None))).alias("embedding"))
    return rebuild_all(_articles(t), gazetteer, kev, chunks, t.topics.select("cve_id", F.col("epss").cast("double").alias("epss")), "2024-01-30", skip)


@query("K13_rebuild_all")
def _(t: Tables) -> DataFrame:
    """Clusters of a full rebuild; the tests take its steps one by one."""
    out = rebuilt_all(t)["clusters"]
    return out.select("cluster_id", "state", "article_count", "source_count", "latest_at", "max_cvss", "max_epss", "cisa_kev", "is_advisory", "score", "confidence", F.array_join("article_ids", ",").alias("article_ids"))
