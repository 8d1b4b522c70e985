"""Tables in hash buckets of their key: an upsert reads and writes the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.operators.tables import _ROLLUP, entity_rollup, upsert_overwrite
from newsgraph.plans.exchange import drop, shared_folder, written
from newsgraph.registry import Tables, query

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class BucketTable:
    """A parquet table whose rows lie in `n` folders by a hash of the key."""

    path: str
    key: str
    n: int
    schema: str

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self, spark, buckets: list[int] | None = None) -> DataFrame:
        rows = spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def upsert(self, batch: DataFrame, merge: Merge) -> list[int]:
        """Merge a batch into the buckets of its keys and return their numbers, n at most. merge takes the old
        rows of these buckets and the batch. What it gives is written aside first, so a batch that
        fails while it is merged leaves the table as it was; running it again is safe if merge is."""
        rows = written(batch)
        touched = sorted(r.bucket for r in rows.select(self._bucket().alias("bucket")).distinct().collect())
        if touched:
            old = self.read(batch.sparkSession, touched).drop("bucket")
            merged = written(merge(old, rows).withColumn("bucket", self._bucket()))
            self._write(merged)
            drop(merged)
        drop(rows)
        return touched


def create_table(rows: DataFrame, key: str, n: int = 64, path: str | None = None) -> BucketTable:
    """A new table of the rows, in a new shared folder if no path is given. Rows without a key go to one bucket."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    table = BucketTable(path or shared_folder(rows.sparkSession), key, n, schema)
    empty = rows.limit(0).withColumn("bucket", F.lit(0))
    empty.drop("bucket").write.mode("overwrite").parquet(table.path)  # so that an empty table can be read
    table._write(rows.withColumn("bucket", table._bucket()))
    return table


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roll-ups (normalized_key, article_count, first_seen, last_seen, slugs) of both: slugs united and counted anew."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.normalized_key") == F.col("b.normalized_key"), "full_outer")
    none = F.array().cast("array<string>")
    slugs = F.array_sort(F.array_union(F.coalesce("a.slugs", none), F.coalesce("b.slugs", none)))
    return both.select(F.coalesce("a.normalized_key", "b.normalized_key").alias("normalized_key"), F.size(slugs).cast("long").alias("article_count"), F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), slugs.alias("slugs"))


def cve_mentions(articles: DataFrame, mentions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cve_id, slug, published_at, aliases, embedding): the CVEs of articles with the articles' aliases and vector."""
    aliases = mentions.filter("type = 'vuln_alias'").groupBy("slug", "normalized_key").agg(F.min("place").alias("place"))
    aliases = aliases.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "normalized_key"))), lambda x: x["normalized_key"]).alias("aliases"))
    keys = articles.select("slug", "published_at", F.explode(F.array_distinct(F.transform("cve_ids", F.upper))).alias("cve_id"))
    return keys.join(aliases, "slug", "left").join(vectors.select("slug", F.col("vector").alias("embedding")), "slug", "left")


def merge_cve_topics(old: DataFrame, found: DataFrame) -> DataFrame:
    """Topics (cve_id, slugs, aliases, embedding, updated_at) with what cve_mentions() found: slugs united, new
    aliases after those there, in order of publication, the vector of the last article that has one,
    the later time. Each list is distinct."""
    at = F.struct("published_at", "slug")
    none = F.array().cast("array<string>")
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.coalesce("aliases", none).alias("aliases")))), lambda x: x["aliases"]))
    new = found.groupBy("cve_id").agg(F.collect_set("slug").alias("slugs"), lists.alias("aliases"), F.max_by("embedding", F.when(F.col("embedding").isNotNull(), at)).alias("embedding"), F.max("published_at").alias("updated_at"))
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.cve_id") == F.col("b.cve_id"), "full_outer")
    union = lambda c: F.array_union(F.coalesce(f"a.{c}", none), F.coalesce(f"b.{c}", none))
    return both.select(F.coalesce("a.cve_id", "b.cve_id").alias("cve_id"), F.array_sort(union("slugs")).alias("slugs"), union("aliases").alias("aliases"), F.coalesce("b.embedding", "a.embedding").alias("embedding"), F.greatest("a.updated_at", "b.updated_at").alias("updated_at"))


@query("A6_upsert", "select p_partkey as id, case when p_size > 30 then p_retailprice * 2 else p_retailprice end as price from part")
def _(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), "p_size")
    table = create_table(rows.drop("p_size"), "id")
    table.upsert(rows.filter("p_size > 30").select("id", (F.col("price") * 2).alias("price")), lambda old, new: upsert_overwrite(new, old, "id"))
    return table.read(t.spark).drop("bucket")


@query("A8_merge_entities", _ROLLUP)
def _(t: Tables) -> DataFrame:
    """The roll-up of some mentions, into which that of the others is merged."""
    early = F.pmod(F.xxhash64("slug"), F.lit(3)) > 0
    table = create_table(entity_rollup(t.mentions.filter(early)).select("normalized_key", "article_count", "first_seen", "last_seen", "slugs"), "normalized_key")
    table.upsert(entity_rollup(t.mentions.filter(~early)), merge_rollups)
    return table.read(t.spark).drop("bucket").withColumn("slugs", F.sha2(F.array_join("slugs", ","), 256))


@query(
    "A9_cve_topics",
    """with k as (select distinct slug, published_at, upper(unnest(cve_ids)) as cve_id from articles), a as (select cve_id, string_agg(distinct normalized_key, ',' order by normalized_key) as aliases from k join (select slug, normalized_key from mentions where type = 'vuln_alias') z using (slug) group by 1),
    e as (select cve_id, arg_max(vector, struct_pack(p := published_at, s := slug)) as v from k join vectors using (slug) group by 1), p as (select cve_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 3) as probe from e)
    select cve_id, count(distinct slug) as n, coalesce(any_value(aliases), '') as aliases, any_value(probe) as probe, max(published_at) as updated_at from k left join a using (cve_id) left join p using (cve_id) group by 1""",
)
def _(t: Tables) -> DataFrame:
    """Topics of some articles, into which all are merged."""
    found = cve_mentions(t.articles, t.mentions, t.vectors)
    empty = found.limit(0).select("cve_id", F.array("slug").alias("slugs"), "aliases", "embedding", F.col("published_at").alias("updated_at"))
    table = create_table(merge_cve_topics(empty, found.filter("slug like '%1'")), "cve_id")
    table.upsert(found, merge_cve_topics)
    probe = F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b), 3)
    return table.read(t.spark).select("cve_id", F.size("slugs").cast("long").alias("n"), F.array_join(F.array_sort("aliases"), ",").alias("aliases"), probe.alias("probe"), "updated_at")
