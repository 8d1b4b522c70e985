"""Structured Streaming twins of the ingest and the digests.

The queries run a stream over landed files to its end and return what its sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.plans.exchange import shared_folder, small, written
from newsgraph.registry import Tables, query

LATE = "2 days"


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the landed parquet files of a table, which is one file or a folder of them."""
    path = f"{folder}/{name}.parquet"
    # As a pattern, since a stream takes no single file by its plain path.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def posts(t: Tables) -> DataFrame:
    rows = landed(t.spark, t.sf_dir, "events")
    return rows.select(F.col("event_id").alias("slug"), F.col("ts").cast("timestamp").alias("published_at"), F.col("event_type").alias("category"), F.col("user_id").alias("source_name"))


def run_to_end(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Everything the stream puts out; with a key (update mode) the last row of each."""
    spark = stream.sparkSession
    parts: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        parts.append(written(batch.withColumn("_batch", F.lit(number))))

    checkpoint = written(spark.range(1)).inputFiles()[0].rsplit("/", 1)[0] + "-stream"
    job = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if key:
        out = out.groupBy(*key).agg(F.max_by(F.struct(*(c for c in out.columns if c not in {*key, "_batch"})), "_batch").alias("x")).select(*key, "x.*")
    return out.drop("_batch")


@query("Z1_stream_ingest", "select slug, source_name from posts")
def _(t: Tables) -> DataFrame:
    """Every post lands twice and comes out once."""
    stream = posts(t).unionByName(posts(t)).withWatermark("published_at", LATE).dropDuplicatesWithinWatermark(["slug"])
    return run_to_end(stream, "append").select("slug", "source_name")


_DAYS = "select date_trunc('day', published_at) as day, category, count(*) as n from posts group by 1, 2"


@query("Z3_tumbling", _DAYS)
def _(t: Tables) -> DataFrame:
    counts = posts(t).withWatermark("published_at", LATE).groupBy(F.window("published_at", "1 day").alias("w"), "category").agg(F.count("*").alias("n"))
    out = run_to_end(counts.select(F.col("w.start").alias("day"), "category", "n"), "update", ["day", "category"])
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("Z4_sliding", "with h as (select date_trunc('hour', published_at) as h, category from posts) select h - to_hours(i::int) as start, category, count(*) as n from h, range(24) r(i) group by 1, 2")
def _(t: Tables) -> DataFrame:
    counts = posts(t).withWatermark("published_at", LATE).groupBy(F.window("published_at", "24 hours", "1 hour").alias("w"), "category").agg(F.count("*").alias("n"))
    out = run_to_end(counts.select(F.col("w.start").alias("start"), "category", "n"), "update", ["start", "category"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("Z6_seen", "select source_name, min(published_at) as first_seen, max(published_at) as last_seen, count(*) as n from posts group by 1")
def _(t: Tables) -> DataFrame:
    seen = posts(t).groupBy("source_name").agg(F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.count("*").alias("n"))
    out = run_to_end(seen, "update", ["source_name"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("Z7_interval", "with c as (select event_type as category, min(ts) + interval 20 day as latest_at from events group by 1) select slug, category from posts join c using (category) where latest_at between published_at - interval 3 day and published_at + interval 2 day")
def _(t: Tables) -> DataFrame:
    clusters = t.posts.groupBy("category").agg((F.min("published_at") + F.expr("interval 20 days")).alias("latest_at"))
    near = F.col("latest_at").between(F.col("published_at") - F.expr("interval 3 days"), F.col("published_at") + F.expr("interval 2 days"))
    return run_to_end(posts(t).join(small(clusters), "category").filter(near).select("slug", "category"), "append")


def upsert_stream(stream: DataFrame, target: DataFrame, folder: str | None = None) -> DataFrame:
    """The target after all micro-batches: each inserts what neither it nor an earlier one has.

    A batch is written below `folder` under the number that the checkpoint there knows it by, so
    one that runs again replaces itself, and a job that starts again with the folder goes on where
    the last one ended. The target is never written anew.
    """
    spark, folder = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    inserted = lambda paths: spark.read.schema(target.schema).parquet(*paths)
    target.limit(0).write.mode("overwrite").parquet(f"{folder}/rows/none")

    def insert(batch: DataFrame, number: int) -> None:
        before = inserted([f"{folder}/rows/none", *(f"{folder}/rows/{i}" for i in range(number))])
        fresh = batch.dropDuplicates(["slug"]).join(target.select("slug").unionByName(before.select("slug")), "slug", "left_anti")
        fresh.select(*target.columns).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    job = stream.writeStream.foreachBatch(insert).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return target.unionByName(inserted([f"{folder}/rows/*"]))


@query("Z2_upsert_stream", "select event_id as slug, case when event_id % 2 = 0 then 'old' else event_type end as category from events")
def _(t: Tables) -> DataFrame:
    target = t.posts.filter("slug % 2 = 0").select("slug", F.lit("old").alias("category"))
    return upsert_stream(posts(t).select("slug", "category"), target)
