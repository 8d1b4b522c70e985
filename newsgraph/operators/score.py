"""Vectors, pair scores and importance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.operators.read import at
from newsgraph.operators.windows import interval_join
from newsgraph.plans.exchange import written
from newsgraph.registry import Tables, query

ASSIGN, MERGE = 0.31, 0.55


def mean_vector(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, centroid, n): the mean by dimension, rounded to 6 digits as sums differ by order. Null
    vectors do not count; keys with none have a null centroid."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("centroid"), F.max("n").alias("n"))
    return rows.select(key).distinct().join(whole, key, "left")


_CENTROID = "with p as (select {k} as k, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), m as (select k, i, avg(x) as m, count(*) as n from p group by 1, 2) select k as {n}, round(sum(round(m, 6) * i), 3) as probe, max(n) as n from m group by 1"


def _probe(c: Column) -> Column:
    return F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b), 3)


@query("D18_centroid", _CENTROID.format(k="label", n="label"))
def _(t: Tables) -> DataFrame:
    return mean_vector(t.embeddings, "label").select("label", _probe(F.col("centroid")).alias("probe"), "n")


@query("D23_pool", _CENTROID.format(k="vec_id // 7", n="article"))
def _(t: Tables) -> DataFrame:
    chunks = t.embeddings.withColumn("article", F.floor(F.col("vec_id") / 7))
    return mean_vector(chunks, "article").select("article", _probe(F.col("centroid")).alias("probe"), "n")


def merge_centroid(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Mean of two centroids weighted by their sizes; one alone passes through."""
    both = F.zip_with(a, b, lambda x, y: F.round((x * n + y * m) / (n + m), 6))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


@query(
    "D19_merge_centroid",
    "with x as (select a.vec_id, a.embedding as p, b.embedding as q from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1 and b.vec_id % 3 > 0), y as (select vec_id, q is null as one, unnest(p)::double as x, unnest(coalesce(q, p))::double as y from x) select vec_id, round(sum(case when one then x else round((x * 2 + y * 3) / 5, 6) end), 3) as probe from y group by 1",
)
def _(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("p"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")).filter("(vec_id + 1) % 3 > 0")
    merged = merge_centroid(F.col("p"), F.lit(2), F.col("q"), F.lit(3))
    return e.join(other, "vec_id", "left").select("vec_id", F.round(F.aggregate(merged, F.lit(0.0), lambda a, b: a + b), 3).alias("probe"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine floored at 0; 0 where a vector is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norm > 0, F.greatest(dot(a, b) / norm, F.lit(0.0))), F.lit(0.0))


def calibrated(cos: Column, low: float = 0.75, high: float = 0.82) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - low) / (high - low)))


@query(
    "K3_calibrated",
    "select a.vec_id, round(greatest(0, least(1, (greatest(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0) - 0.75) / 0.07)), 4) as embed from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def _(t: Tables) -> DataFrame:
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(calibrated(cosine(F.col("embedding"), F.col("other"))), 4).alias("embed"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, read from the Arrow buffer."""
    flat = pa.concat_arrays([x.flatten() for x in vectors.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    if vectors.null_count or len(flat) % len(vectors) or len(set(pc.list_value_length(vectors).to_pylist())) > 1:
        raise ValueError("vectors need to be of one length and not null")
    out = flat.reshape(len(vectors), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _nearest_of_block(qid: np.ndarray, a: np.ndarray, rid: np.ndarray, b: np.ndarray, k: int, queries: int = 256, rows: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, cosine of the k best rows of each query, ties by id: a running top k over
    sub-blocks, so that a matrix has queries times rows values at most."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(qid), queries):
        asked = qid[i : i + queries]
        best = [(np.empty(0, np.int64), np.empty(0))] * len(asked)
        for j in range(0, len(rid), rows):
            ids = rid[j : j + rows]
            cos = np.round(a[i : i + queries] @ b[j : j + rows].T, 9)
            cos[asked[:, None] == ids[None, :]] = -2
            n = min(k, len(ids))
            least = np.partition(cos, len(ids) - n, axis=1)[:, len(ids) - n]
            for q, cut in enumerate(least):
                at = np.flatnonzero(cos[q] >= max(cut, -1))  # with all that tie at the cut
                id_, c = np.concatenate([best[q][0], ids[at]]), np.concatenate([best[q][1], cos[q, at]])
                order = np.lexsort((id_, -c))[:k]
                best[q] = id_[order], c[order]
        out += [(np.full(len(id_), query), id_, c) for query, (id_, c) in zip(asked, best, strict=True)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, block: int = 16_384) -> DataFrame:
    """(query, id, cosine, rank): the k nearest rows of each query, exactly.

    A stated set of queries meets all rows in blocks: each block of rows scores a block of
    queries by matrix products of sub-blocks and keeps its k best, so what moves is k rows for each
    query and block; the best of those are ranked. Rows and queries are counted, so that a block
    has about `block` of them at most. queries and rows: id, vector.
    """
    nq, nr = (max(16, -(-df.count() // block)) for df in (queries, rows))
    part = lambda n, c: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(c)
    asked = queries.select("id", "vector", part(nq, "qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    stored = rows.select("id", "vector", part(nr, "rb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if left.num_rows and right.num_rows:
            found = _nearest_of_block(left["id"].to_numpy(), _matrix(left["vector"]), right["id"].to_numpy(), _matrix(right["vector"]), k)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "id", "cosine"])

    pairs = asked.groupBy("qb", "rb").cogroup(stored.groupBy("qb", "rb")).applyInArrow(score, "query long, id long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_KNN = """with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), p as (select q.vec_id as query, r.vec_id as id, round(list_cosine_similarity(q.e, r.embedding::double[]), 9) as cosine from q join embeddings r on r.vec_id <> q.vec_id)
    select query, id, row_number() over (partition by query order by cosine desc, id) as rank from p qualify rank <= {k}"""


@query("C11_nearest", _KNN.format(k=10))
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows.filter("id % 20 = 0"), rows).select("query", "id", "rank")


@query("W3_knn_rank", _KNN.format(k=3))
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows.filter("id % 20 = 0"), rows, 3).select("query", "id", "rank")


def pair_score(cve: Column, alias: Column, actor: Column, other: Column, embed: Column, founded: Column) -> Column:
    """What a pair scores: shared CVE and alias (booleans), the Jaccards of actors and of others, the
    calibrated cosine, and whether the right side has entities at all."""
    entity = F.when(cve, 0.10).otherwise(0.0) + F.when(alias, 0.15).otherwise(0.0) + 0.22 * actor + 0.18 * other
    return F.when(founded & (entity == 0), 0.0).when(founded, entity + 0.35 * embed).otherwise(F.when(embed >= 1, 0.35).otherwise(0.0))


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, idf: DataFrame) -> DataFrame:
    """(slug, id, score) of candidate pairs (slug, id, embed).

    left: slug, normalized_key, type; right: id, normalized_key, type (the founding entities);
    idf: normalized_key, idf (1.0 if unknown). 0.10 for a shared CVE, 0.15 for a shared
    vulnerability alias, 0.22 and 0.18 times the IDF-weighted Jaccard of actors and campaigns and
    of the others (no vendors, no CWEs), 0.35 times embed. Without entities in common the score
    is 0, unless the right has none at all, vendors and CWEs included: then embed counts only if
    it is 1.
    """
    kind = F.when(F.col("type") == "cve", "cve").when(F.col("type") == "vuln_alias", "alias").when(F.col("type").isin("actor", "campaign"), "actor").otherwise("other")
    weigh = lambda d: d.filter(~F.col("type").isin("vendor", "cwe")).withColumn("kind", kind).drop("type").distinct().join(idf, "normalized_key", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    # Each is read twice below, and what it is made from may be far larger.
    pairs, a, b = written(pairs), written(weigh(left)), written(weigh(right))
    totals = lambda d, key, name: d.groupBy(key).pivot("kind", ["cve", "alias", "actor", "other"]).agg(F.sum("idf")).select(key, *(F.coalesce(c, F.lit(0.0)).alias(f"{name}_{c}") for c in ("cve", "alias", "actor", "other")))
    shared = pairs.select("slug", "id").join(a, "slug").join(b.select("id", "normalized_key", "kind"), ["id", "normalized_key", "kind"])
    sums = shared.groupBy("slug", "id").pivot("kind", ["cve", "alias", "actor", "other"]).agg(F.sum("idf"))
    out = pairs.join(sums, ["slug", "id"], "left").join(totals(a, "slug", "a"), "slug", "left").join(totals(b, "id", "b"), "id", "left").na.fill(0.0)

    def jaccard(c: str) -> Column:
        union = F.col(f"a_{c}") + F.col(f"b_{c}") - F.col(c)
        return F.when(union > 0, F.col(c) / union).otherwise(0.0)

    out = out.join(right.select("id").distinct().withColumn("founded", F.lit(True)), "id", "left")
    founded = F.coalesce("founded", F.lit(False))
    score = pair_score(F.col("cve") > 0, F.col("alias") > 0, jaccard("actor"), jaccard("other"), F.col("embed"), founded)
    return out.select("slug", "id", score.alias("score"))


_PAIRS = """with m as (select distinct slug, normalized_key, case when type = 'cve' then 'cve' when type = 'vuln_alias' then 'alias' when type in ('actor', 'campaign') then 'actor' else 'other' end as kind from mentions where type <> 'vendor'),
    c as (select distinct slug, normalized_key, published_at from mentions where type = 'cve'), p as (select distinct a.slug, b.slug as id from c a join c b using (normalized_key) where a.slug < b.slug and b.published_at between a.published_at - interval 30 day and a.published_at + interval 14 day
      union select 'a' || doc_id, 'a' || (doc_id + 1) from documents where doc_id + 1 in (select doc_id from documents)),
    n as (select normalized_key, greatest(0.01, ln((select count(distinct slug) from mentions) / count(distinct slug))) as idf from mentions group by 1),
    w as (select slug, normalized_key, kind, idf from m join n using (normalized_key)), t as (select slug, sum(case kind when 'actor' then idf else 0 end) as x, sum(case kind when 'other' then idf else 0 end) as y from w group by 1),
    s as (select p.slug, p.id, max(a.kind = 'cve') as c, max(a.kind = 'alias') as v, sum(case a.kind when 'actor' then a.idf else 0 end) as x, sum(case a.kind when 'other' then a.idf else 0 end) as y from p join w a on a.slug = p.slug join w b on b.slug = p.id and b.normalized_key = a.normalized_key and a.kind = b.kind group by 1, 2),
    e as (select p.slug, p.id, (length(p.slug) + length(p.id) + ascii(right(p.id, 1))) % 3 / 2.0 as embed, p.id in (select slug from mentions) as founded,
      case when s.c then 0.10 else 0 end + case when s.v then 0.15 else 0 end
      + 0.22 * case when coalesce(a.x, 0) + coalesce(b.x, 0) - coalesce(s.x, 0) > 0 then coalesce(s.x, 0) / (coalesce(a.x, 0) + coalesce(b.x, 0) - coalesce(s.x, 0)) else 0 end
      + 0.18 * case when coalesce(a.y, 0) + coalesce(b.y, 0) - coalesce(s.y, 0) > 0 then coalesce(s.y, 0) / (coalesce(a.y, 0) + coalesce(b.y, 0) - coalesce(s.y, 0)) else 0 end as entity
      from p left join s using (slug, id) left join t a on a.slug = p.slug left join t b on b.slug = p.id)
    select slug, id, round(case when founded and entity = 0 then 0 when founded then entity + 0.35 * embed when embed >= 1 then 0.35 else 0 end, 5) as score from e"""


def _mention_pairs(t: Tables) -> DataFrame:
    """Articles that share a CVE within the window of candidates, and neighbours that may have nothing in common."""
    m = t.mentions.filter("type = 'cve'").select("slug", "normalized_key", F.col("published_at").alias("at")).distinct()
    other = m.select(F.col("slug").alias("id"), "normalized_key", F.col("at").alias("latest"))
    docs = t.documents.select("doc_id")
    near = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.concat(F.lit("a"), "doc_id").alias("slug"), F.concat(F.lit("a"), F.col("doc_id") + 1).alias("id"))
    pairs = interval_join(m, other, ["normalized_key"], "at", "latest").filter("slug < id").select("slug", "id").unionByName(near).distinct()
    return pairs.withColumn("embed", (F.length("slug") + F.length("id") + F.ascii(F.right("id", F.lit(1)))) % 3 / 2.0)


@query("K2_pair_score", _PAIRS)
def _(t: Tables) -> DataFrame:
    from newsgraph.operators.read import idf

    t = t.once()
    left = t.mentions.select("slug", "normalized_key", "type")
    return pair_scores(_mention_pairs(t), left, left.withColumnRenamed("slug", "id"), idf(t.mentions)).select("slug", "id", F.round("score", 5).alias("score"))


def best_candidate(scored: DataFrame, least: float = ASSIGN) -> DataFrame:
    """The best scored candidate of each slug that reaches the threshold; ties by id."""
    w = Window.partitionBy("slug").orderBy(F.desc("score"), "id")
    return scored.filter(F.col("score") >= least).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


@query("W2_best_candidate", f"select slug, id from ({_PAIRS.replace('with m as', 'with m as', 1)}) z where score >= 0.31 qualify row_number() over (partition by slug order by score desc, id) = 1")
def _(t: Tables) -> DataFrame:
    from newsgraph.operators.read import idf

    t = t.once()
    left = t.mentions.select("slug", "normalized_key", "type")
    scored = pair_scores(_mention_pairs(t), left, left.withColumnRenamed("slug", "id"), idf(t.mentions)).withColumn("score", F.round("score", 5))
    return best_candidate(scored).select("slug", "id")


def lifecycle(n: Column, state: Column) -> Column:
    """Three articles confirm; two make a new cluster developing; resolved stays."""
    return F.when(state == "resolved", state).when(n >= 3, "confirmed").when((n == 2) & (state == "new"), "developing").otherwise(state)


@query("K7_lifecycle", "select conv_id as id, case when count(*) >= 3 then 'confirmed' when count(*) = 2 then 'developing' else 'new' end as state from conversations group by 1")
def _(t: Tables) -> DataFrame:
    return t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).select("id", lifecycle(F.col("n"), F.lit("new")).alias("state"))


def importance(clusters: DataFrame, as_of: str) -> DataFrame:
    """score (0-100), confidence and factors (five best by points, ties by name) of each cluster.

    clusters: article_count, source_count, max_cvss, cve_count, entity_count, state, latest_at,
    credibility, cisa_kev, max_epss.
    """
    c = F.col
    hours = (F.unix_micros(at(as_of)) - F.unix_micros(F.col("latest_at").cast("timestamp"))) / 3.6e9
    seen = F.coalesce(F.nullif("source_count", F.lit(0)), "article_count")
    parts = {
        "cvss": F.least(F.coalesce("max_cvss", F.lit(0.0)), F.lit(10.0)) / 10 * 30,
        "coverage": F.least(seen, F.lit(10)) / 10 * 25,
        "recency": F.when(hours < 6, 20.0).when(hours < 12, 16.0).when(hours < 24, 12.0).when(hours < 48, 8.0).when(hours < 168, 4.0).otherwise(0.0),
        "entities": F.when(c("cve_count") > 0, F.least("cve_count", F.lit(5)) / 5 * 15).otherwise(F.least("entity_count", F.lit(5)).cast("double")),
        "state": F.when(c("state") == "confirmed", 10.0).when(c("state") == "developing", 6.0).when(c("state") == "resolved", 0.0).otherwise(2.0),
        "credibility": F.when(c("credibility") >= 1.5, 15.0).when(c("credibility") >= 1.2, 10.0).when(c("credibility") >= 1.0, 5.0).otherwise(0.0),
        "kev": F.when(c("cisa_kev"), 20.0).otherwise(0.0),
        "epss": F.when(c("max_epss") > 0, F.least("max_epss", F.lit(1.0)) * 15).otherwise(0.0),
    }
    rounded = {k: F.round(v.cast("double"), 1) for k, v in parts.items()}
    total = rounded["cvss"]
    for k in list(rounded)[1:]:
        total = total + rounded[k]
    factors = F.array(*(F.struct((-v).alias("order"), F.lit(k).alias("name"), v.alias("points")) for k, v in rounded.items()))
    several = (c("source_count") >= 2) | (c("article_count") >= 2)
    scored, named = c("max_cvss").isNotNull(), (c("entity_count") > 0) | (c("cve_count") > 0)
    confidence = F.when(scored & several & named, "high").when(several | (scored & named), "medium").otherwise("low")
    best = F.transform(F.slice(F.array_sort(F.filter(factors, lambda x: x["points"] > 0)), 1, 5), lambda x: F.struct(x["name"], x["points"]))
    return clusters.withColumns({"score": F.least(F.lit(100.0), F.round(total, 1)), "confidence": confidence, "top_factors": best})


_IMPORTANCE = """with m as (select l_orderkey as id, count(*) as n, count(distinct l_suppkey) as s from lineitem group by 1),
    c as (select o_orderkey as id, n, s, case when o_orderkey % 4 > 0 then (o_orderkey % 100) / 10.0 end as cvss, o_orderkey % 7 as cves, o_orderkey % 3 as ents, case o_orderstatus when 'F' then 'confirmed' when 'O' then 'developing' else 'new' end as state,
      epoch(timestamp '1998-08-01' - o_orderdate) / 3600.0 as h, 0.8 + (o_orderkey % 4) * 0.25 as w, o_orderkey % 11 = 0 as kev, (o_orderkey % 13) / 10.0 as epss from orders join m on id = o_orderkey)
    select id, least(100, round(round(least(coalesce(cvss, 0), 10) / 10 * 30, 1) + round(least(s, 10) / 10 * 25, 1) + (case when h < 6 then 20 when h < 12 then 16 when h < 24 then 12 when h < 48 then 8 when h < 168 then 4 else 0 end)
      + round(case when cves > 0 then least(cves, 5) / 5 * 15 else least(ents, 5) end, 1) + (case state when 'confirmed' then 10 when 'developing' then 6 else 2 end) + (case when w >= 1.5 then 15 when w >= 1.2 then 10 when w >= 1.0 then 5 else 0 end)
      + (case when kev then 20 else 0 end) + round(case when epss > 0 then least(epss, 1) * 15 else 0 end, 1), 1))::double as score,
      case when cvss is not null and (s >= 2 or n >= 2) and (cves > 0 or ents > 0) then 'high' when s >= 2 or n >= 2 or (cvss is not null and (cves > 0 or ents > 0)) then 'medium' else 'low' end as confidence from c"""


def _score_input(t: Tables) -> DataFrame:
    m = t.members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("article_count"), F.count_distinct("source_name").alias("source_count"))
    return t.clusters.drop("score").join(m, "id").select(
        "id", "article_count", "source_count", F.when(F.col("id") % 4 > 0, (F.col("id") % 100) / 10.0).alias("max_cvss"), (F.col("id") % 7).alias("cve_count"), (F.col("id") % 3).alias("entity_count"),
        "state", "latest_at", (0.8 + (F.col("id") % 4) * 0.25).alias("credibility"), (F.col("id") % 11 == 0).alias("cisa_kev"), ((F.col("id") % 13) / 10.0).alias("max_epss"),
    )


@query("K8_importance", _IMPORTANCE)
def _(t: Tables) -> DataFrame:
    return importance(_score_input(t), "1998-08-01").select("id", "score", "confidence")


@query("K9_rescore", _IMPORTANCE.replace("from orders join m", "from (select * from orders where o_orderkey in (select l_orderkey from lineitem where l_shipdate >= '1997-01-01')) orders join m"))
def _(t: Tables) -> DataFrame:
    touched = t.members.filter("added_at >= '1997-01-01'").select(F.col("cluster_id").alias("id"))
    return importance(_score_input(t).join(touched, "id", "left_semi"), "1998-08-01").select("id", "score", "confidence")


_FACTORS = """with m as (select l_orderkey as id, count(*) as n, count(distinct l_suppkey) as s from lineitem group by 1),
    c as (select o_orderkey as id, s, case when o_orderkey % 4 > 0 then (o_orderkey % 100) / 10.0 end as cvss, o_orderkey % 7 as cves, o_orderkey % 3 as ents, o_orderstatus as state, epoch(timestamp '1998-08-01' - o_orderdate) / 3600.0 as h, 0.8 + (o_orderkey % 4) * 0.25 as w, o_orderkey % 11 = 0 as kev, (o_orderkey % 13) / 10.0 as epss from orders join m on id = o_orderkey),
    f as (select id, 'cvss' as name, round(least(coalesce(cvss, 0), 10) / 10 * 30, 1) as points from c union all select id, 'coverage', round(least(s, 10) / 10 * 25, 1) from c
      union all select id, 'recency', case when h < 6 then 20 when h < 12 then 16 when h < 24 then 12 when h < 48 then 8 when h < 168 then 4 else 0 end from c union all select id, 'entities', round(case when cves > 0 then least(cves, 5) / 5 * 15 else least(ents, 5) end, 1) from c
      union all select id, 'state', case state when 'F' then 10 when 'O' then 6 else 2 end from c union all select id, 'credibility', case when w >= 1.5 then 15 when w >= 1.2 then 10 when w >= 1.0 then 5 else 0 end from c
      union all select id, 'kev', case when kev then 20 else 0 end from c union all select id, 'epss', round(case when epss > 0 then least(epss, 1) * 15 else 0 end, 1) from c)
    select id, row_number() over (partition by id order by points desc, name)::int - 1 as place, name, points::double as points from f where points > 0 qualify row_number() over (partition by id order by points desc, name) <= 5"""


@query("W6_factors", _FACTORS)
def _(t: Tables) -> DataFrame:
    out = importance(_score_input(t), "1998-08-01")
    return out.select("id", F.posexplode("top_factors").alias("place", "f")).select("id", "place", "f.name", "f.points")
