"""Grouping articles about one event: candidates, routes, components, signatures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import timedelta
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.operators.windows import interval_pairs
from newsgraph.plans.exchange import written
from newsgraph.registry import Tables, query

BACK, AHEAD = 30, 14
#: Links that one task takes at once.
FEW = 200_000


def candidates_structured(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(slug, id) that share a key while the cluster is active from 30 days before to 14 after.

    articles: slug, key, published_at; clusters: id, key, latest_at, state. They meet by key and time
    bucket, common keys in parts (see interval_pairs), so pairs outside the window are hardly made.
    """
    live = clusters.filter("state <> 'resolved'").select("id", "key", "latest_at")
    return interval_pairs(articles.select("slug", "key", "published_at"), live, ["key"], "published_at", "latest_at", "id", BACK, AHEAD).select("slug", "id").distinct()


@query(
    "C10_candidates",
    """with a as (select slug, unnest(raw_tags) as key, published_at from articles where content_type = 'news'), c as (select source_name as id, published_at as latest_at, unnest(raw_tags) as key from articles where content_type = 'kev_catalog')
    select distinct slug, id from a join c using (key) where latest_at between published_at - interval 30 day and published_at + interval 14 day""",
)
def _(t: Tables) -> DataFrame:
    rows = t.articles.select("slug", "source_name", "content_type", "published_at", F.explode("raw_tags").alias("key"))
    clusters = rows.filter("content_type = 'kev_catalog'").select(F.col("source_name").alias("id"), "key", F.col("published_at").alias("latest_at"), F.lit("new").alias("state"))
    return candidates_structured(rows.filter("content_type = 'news'").select("slug", "key", "published_at"), clusters)


def merge_pairs(keys: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) of cluster ids that share a key, once. keys: id, key."""
    keys = keys.distinct()
    return keys.join(keys.select(F.col("id").alias("b"), "key"), "key").filter("id < b").select(F.col("id").alias("a"), "b").distinct()


@query("C15_merge_pairs", "with k as (select distinct source_name as id, upper(unnest(cve_ids)) as key from articles where content_type = 'ics_advisory') select distinct x.id as a, y.id as b from k x join k y using (key) where x.id < y.id")
def _(t: Tables) -> DataFrame:
    keys = t.articles.filter("content_type = 'ics_advisory'").select(F.col("source_name").alias("id"), F.explode(F.transform("cve_ids", F.upper)).alias("key"))
    return merge_pairs(keys)


def route(content_type: Column, roundup: Column) -> Column:
    return F.when(content_type == "kev_catalog", "annotate").when(roundup, "topics").when(content_type == "product_advisory", "join").otherwise("full")


@query("K1_routing", "select slug, case when content_type = 'kev_catalog' then 'annotate' when category = 'fr' then 'topics' when content_type = 'product_advisory' then 'join' else 'full' end as route from articles")
def _(t: Tables) -> DataFrame:
    return t.articles.select("slug", route(F.col("content_type"), F.col("category") == "fr").alias("route"))


def _linked(edges: pa.Table) -> pa.Table:
    """(a, b) of every node a of the edges and the least node b that they link it with."""
    ids = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    ids = ids.take(pc.sort_indices(ids))
    up = list(range(len(ids)))
    for x, y in zip(*(pc.index_in(edges[c], ids).to_pylist() for c in "ab"), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for x, above in enumerate(up):  # what is above is smaller, so it has its root already
        up[x] = up[above]
    return pa.table([ids, ids.take(pa.array(up, pa.int64()))], ["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_linked() of a partition's edges; what is held is a row for each node and as many edges."""
    parts, n, least = [], 0, FEW
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= 2 * least:
            parts = _linked(pa.Table.from_batches(parts)).to_batches()
            n = sum(x.num_rows for x in parts)
            least = max(FEW, n)
    if n:
        yield from _linked(pa.Table.from_batches(parts)).to_batches(10_000)


def connected(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(id, root) of the nodes of edges (a, b): least label of neighbours, then of the label's
    label, until nothing changes; each round is written, as lineage would grow.

    Before that each partition links its nodes with the least one they reach in it, so chains are short; where
    that leaves `few` rows at most, they are linked in one task, without rounds.
    """
    edges = edges.select("a", "b")
    edges = written(edges.mapInArrow(_forest, edges.schema))
    if edges.count() <= few:
        return written(edges.coalesce(1).mapInArrow(_forest, edges.schema)).select(F.col("a").alias("id"), F.col("b").alias("root"))
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    for _ in range(rounds):
        seen = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        nearer = now.join(seen, "id").select("id", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jumped = nearer.join(now.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root"), "old")
        now = written(jumped)
        if now.filter("root <> old").isEmpty():
            return now.select("id", "root")
        now = now.select("id", "root")
    raise RuntimeError(f"no components after {rounds} rounds")


def dedup_by_key(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, survivor): clusters that share keys, in chains too, become the largest of them (ties: least id).

    Members of a key are linked to its least cluster, so a common key costs a link for each.
    """
    least = keys.groupBy("key").agg(F.min("id").alias("b"))
    roots = connected(keys.join(least, "key").filter("id <> b").select(F.col("id").alias("a"), "b").distinct())
    best = roots.join(sizes, "id").groupBy("root").agg(F.max_by("id", F.struct("n", F.struct(-F.col("id")))).alias("survivor"))
    return roots.join(best, "root").select("id", "survivor")


_COMPONENTS = """with recursive k as (select distinct cast(floor(doc_id / 5) as bigint) as id, upper(unnest(cve_ids)) as key from articles), e as (select distinct x.id as a, y.id as b from k x join k y using (key) where x.id <> y.id),
    r as (select a as id, a as root from e union select e.b, r.root from r join e on e.a = r.id), c as (select id, min(root) as root from r group by 1), s as (select cast(floor(doc_id / 5) as bigint) as id, count(*) as n from articles group by 1),
    b as (select id, root, first_value(id) over (partition by root order by n desc, id) as survivor from c join s using (id)) select id, survivor from b"""


def _fives(t: Tables) -> DataFrame:
    """Articles as members of clusters of five."""
    return t.articles.withColumn("cluster_id", F.floor(F.col("doc_id") / 5))


def _survivors(t: Tables) -> DataFrame:
    """Clusters that share CVEs, in chains too."""
    keys = _fives(t).select(F.col("cluster_id").alias("id"), F.explode(F.transform("cve_ids", F.upper)).alias("key")).distinct()
    return dedup_by_key(keys, _fives(t).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n")))


@query("K12_dedup", _COMPONENTS)
def _(t: Tables) -> DataFrame:
    return _survivors(t)


def _with_root(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows in order of publication within the components of links (a, b), whatever their diameter:
    labels only fall, so the rounds end by themselves."""
    roots = connected(links.filter("a <> b").distinct(), rounds=1_000_000).withColumnRenamed("id", "slug")
    rows = rows.join(roots, "slug", "left").withColumn("root", F.coalesce("root", "slug"))
    return rows.repartition("root").sortWithinPartitions("root", "published_at", "slug")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _placed(decisions: Iterator[tuple[str, str | None]]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(decisions, 10_000)):
        yield pa.record_batch([pa.array([x[i] for x in part], pa.string()) for i in (0, 1)], ["slug", "cluster"])


def assign(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, cluster) in order of publication, as if one article came after the other.

    edges: earlier, later, score of article pairs that may share a cluster. An article joins its
    best-scoring neighbour that is a seed (ties: the earlier one), else it becomes a seed, or
    stays out if `may_seed` is false. One pass over each component of the edges in order, that
    holds the seeds of the component only.
    """
    links = edges.join(articles.select(F.col("slug").alias("earlier"), F.col("published_at").alias("eo")), "earlier")
    rows = articles.select("slug", "published_at", "may_seed").join(links.withColumnRenamed("later", "slug"), "slug", "left")
    rows = _with_root(rows, edges.select(F.col("earlier").alias("a"), F.col("later").alias("b")))

    def decide(rows: Iterator[dict]) -> Iterator[tuple[str, str | None]]:
        root, seeds = None, set()
        for (at, slug), given in groupby(rows, key=lambda r: (r["root"], r["slug"])):
            if at != root:
                root, seeds = at, set()
            best, may_seed = None, False
            for r in given:
                may_seed = r["may_seed"]
                if r["earlier"] in seeds and (best is None or (-r["score"], r["eo"], r["earlier"]) < best):
                    best = -r["score"], r["eo"], r["earlier"]
            if best is None and may_seed:
                seeds.add(slug)
            yield slug, best[2] if best else slug if may_seed else None

    return rows.select("root", "slug", "may_seed", "earlier", "score", "eo").mapInArrow(lambda it: _placed(decide(_rows(it))), "slug string, cluster string")


def assign_by_key(articles: DataFrame, keyed: DataFrame, days: int) -> DataFrame:
    """assign() for articles that share keys and are less than so many days apart, scored by the
    number of shared keys, without making the pairs: an article meets the recent seeds of its keys.

    keyed: slug, key. The pass holds the seeds of the last days for each key of a component.
    """
    keys = keyed.groupBy("slug").agg(F.collect_list("key").alias("keys"))
    least = keyed.groupBy("key").agg(F.min("slug").alias("b"))
    links = keyed.join(least, "key").select(F.col("slug").alias("a"), "b")
    rows = _with_root(articles.select("slug", "published_at", "may_seed").join(keys, "slug", "left"), links)
    window = timedelta(days=days)

    def decide(rows: Iterator[dict]) -> Iterator[tuple[str, str | None]]:
        root, recent = None, {}
        for r in rows:
            if r["root"] != root:
                root, recent = r["root"], {}
            slug, now, shared = r["slug"], r["published_at"], Counter()
            for key in r["keys"] or ():
                recent[key] = [x for x in recent.get(key, ()) if now - x[0] < window]
                shared.update(x for x in recent[key] if x[0] < now)
            best = min(((-n, *seed) for seed, n in shared.items()), default=None)
            if best is None and r["may_seed"]:
                for key in r["keys"] or ():
                    recent[key].append((now, slug))
            yield slug, best[2] if best else slug if r["may_seed"] else None

    return rows.select("root", "slug", "published_at", "may_seed", "keys").mapInArrow(lambda it: _placed(decide(_rows(it))), "slug string, cluster string")


#: Columns of an event signature and the type of their keys.
SIGNATURE = {"vuln_aliases": "vuln_alias", "campaign_names": "campaign", "affected_products": "product", "primary_actors": "actor"}


def event_signature(mentions: DataFrame) -> DataFrame:
    """Per slug the distinct keys of CVEs, aliases, campaigns, products and actors in the order in
    which they are mentioned, and the confidence: high with two CVEs or a CVE and an alias, medium
    with a CVE, an alias or a campaign, else low. mentions: slug, type, normalized_key, place."""
    first = mentions.groupBy("slug", "type", "normalized_key").agg(F.min("place").alias("place"))
    keys = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("place", "normalized_key")))), lambda x: x["normalized_key"])
    out = first.groupBy("slug").agg(keys("cve").alias("cve_ids"), *(keys(kind).alias(name) for name, kind in SIGNATURE.items()))
    n_cves, n_aliases = F.size("cve_ids"), F.size("vuln_aliases")
    confidence = F.when((n_cves >= 2) | ((n_cves > 0) & (n_aliases > 0)), "high").when((n_cves > 0) | (n_aliases > 0) | (F.size("campaign_names") > 0), "medium").otherwise("low")
    return out.withColumn("confidence", confidence)


_KEYS = {"cve_ids": "cve"} | SIGNATURE


@query(
    "D20_signature",
    "with f as (select slug, type, normalized_key, min(place) as place from mentions group by 1, 2, 3), s as (select slug, "
    + ", ".join(f"coalesce(string_agg(normalized_key, ',' order by place, normalized_key) filter (type = '{kind}'), '') as {name}, count(*) filter (type = '{kind}') as n_{kind}" for name, kind in _KEYS.items())
    + f" from f group by 1) select slug, {', '.join(_KEYS)}, case when n_cve >= 2 or (n_cve > 0 and n_vuln_alias > 0) then 'high' when n_cve > 0 or n_vuln_alias > 0 or n_campaign > 0 then 'medium' else 'low' end as confidence from s",
)
def _(t: Tables) -> DataFrame:
    out = event_signature(t.mentions)
    return out.select("slug", *(F.array_join(c, ",").alias(c) for c in _KEYS), "confidence")
