"""Micro-batches that write several tables at once, with one commit marker each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.operators.intel import extract_entities
from newsgraph.operators.normalize import normalized_key
from newsgraph.operators.tables import enrich_cve, insert_new
from newsgraph.plans.exchange import drop, shared_folder, written
from newsgraph.registry import Tables, query
from newsgraph.streaming.jobs import landed

TABLES = ("articles", "mentions", "topics")
ARTICLES = "slug string, source_url_hash string, title string, body string, published_at timestamp, source_name string, cve_ids array<string>, cvss_score double, severity string"
MENTIONS = "slug string, normalized_key string, rank int, sources array<string>"
TOPICS = "cve_id string, slug string, published_at timestamp"
SCHEMAS = dict(zip(TABLES, (ARTICLES, MENTIONS, TOPICS), strict=True))


def _files(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are there as a whole."""
    files, path = _files(spark, f"{folder}/commits")
    return sorted(int(x.getPath().getName()) for x in files.listStatus(path)) if files.exists(path) else []


def committed(spark: SparkSession, folder: str, table: str, before: int | None = None) -> DataFrame:
    """The rows of a table from the batches that have been committed (those before a number, if given)."""
    numbers = [n for n in commits(spark, folder) if before is None or n < before]
    paths = [f"{folder}/{table}/{n}" for n in numbers]
    return spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])


def write_batch(batch: DataFrame, number: int, folder: str, gazetteer: DataFrame, kev: DataFrame, topics: DataFrame, written_one: Callable[[str], None] = lambda table: None) -> None:
    """Insert the articles of a batch that are new (A5), with scores from the topics (C4), their entities
    (N13) and their links to CVE topics (A9), each table in a folder of the batch's number. The marker is
    made last: a batch that fails on the way is not read by anybody, and writes all its tables
    anew when it runs again; one that is committed is left alone."""
    spark = batch.sparkSession
    if number in commits(spark, folder):
        return
    before = committed(spark, folder, "articles", number)
    rows = batch.select(*(F.col(c) for c in before.columns if c != "severity"), F.lit(None).cast("string").alias("severity"))
    fresh = written(insert_new(rows, before.select(*rows.columns)).join(before.select("slug"), "slug", "left_anti"))
    parts = {
        "articles": enrich_cve(fresh.drop("severity"), topics).select(*before.columns),
        "mentions": extract_entities(fresh, gazetteer, kev).select("slug", "normalized_key", "rank", "sources"),
        "topics": fresh.select(F.explode(F.array_distinct(F.transform("cve_ids", F.upper))).alias("cve_id"), "slug", "published_at"),
    }
    for table, part in parts.items():
        part.write.mode("overwrite").parquet(f"{folder}/{table}/{number}")
        written_one(table)
    files, marker = _files(spark, f"{folder}/commits/{number}")
    files.create(marker, True).close()
    drop(fresh)


def ingest_stream(stream: DataFrame, gazetteer: DataFrame, kev: DataFrame, topics: DataFrame, folder: str | None = None) -> str:
    """Run a stream of articles to its end, batch by batch (write_batch), and return the folder of the tables. A job
    that starts again with its folder goes on after the last batch that ended."""
    spark, folder = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    job = stream.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, folder, gazetteer, kev, topics)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return folder


@query(
    "Z2_ingest",
    r"""with r as (select *, 'd' || lang || '-' || doc_id % 700 as s from documents), u as (select * from r qualify row_number() over (partition by s order by doc_id) = 1), d as (select * from u qualify row_number() over (partition by left(sha256(text), 16) order by doc_id) = 1),
    a as (select s as slug, doc_id, source, 'CVE-2024-' || (1000 + doc_id % 60) as cve from d), c as (select cve_id, cvss from topics),
    m as (select count(*) as n from (select slug, lower(cve) as k from a) z)
    select slug, source as source_name, case when doc_id % 2 = 0 then 5.0 else cvss end as cvss_score, case when doc_id % 2 = 0 then 'medium' when cvss >= 9 then 'critical' when cvss >= 7 then 'high' when cvss >= 4 then 'medium' when cvss > 0 then 'low' end as severity, lower(cve) as ids, cve as topic from a left join c on cve_id = cve""",
)
def _(t: Tables) -> DataFrame:
    """Documents as they land, some under one slug, some with one text: articles with their entities of ids and their topics."""
    rows = landed(t.spark, t.sf_dir, "documents")
    key = F.concat(F.lit("d"), "lang", F.lit("-"), F.col("doc_id") % 700)
    at = F.timestamp_seconds(F.col("doc_id"))
    cve = F.concat(F.lit("CVE-2024-"), 1000 + F.col("doc_id") % 60)
    stream = rows.select(key.alias("slug"), F.substring(F.sha2("text", 256), 1, 16).alias("source_url_hash"), F.lit("t").alias("title"), F.lit("b").alias("body"), at.alias("published_at"), F.col("source").alias("source_name"), F.array(cve).alias("cve_ids"), F.when(F.col("doc_id") % 2 == 0, F.lit(5.0)).alias("cvss_score"))
    name = F.lit("nobody at all")
    gazetteer = t.benchmark.limit(1).select(name.alias("name"), normalized_key(name).alias("normalized_key"), F.lit(False).alias("is_alias"))
    kev = t.part.limit(0).select(F.col("p_brand").alias("cve_id"), F.col("p_brand").alias("vendor"))
    folder = ingest_stream(stream, gazetteer, kev, t.topics.select("cve_id", F.col("cvss").cast("double").alias("cvss")))
    articles, mentions, topics = (committed(t.spark, folder, x) for x in TABLES)
    ids = mentions.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("normalized_key")), ",").alias("ids"))
    return articles.join(ids, "slug", "left").join(topics.select("slug", F.col("cve_id").alias("topic")), "slug", "left").select("slug", "source_name", "cvss_score", "severity", "ids", "topic")
