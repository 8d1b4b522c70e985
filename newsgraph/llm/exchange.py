"""Documents in chunks that ask buckets about their keys: the traffic of both substring operators.

Documents are dealt to chunks by a hash of id and text. A chunk sends every bucket one row with its
distinct keys, packed; a bucket answers each chunk with one row. So a passage that a third of all
documents share costs a chunk one key, however many of its documents hold it, and Spark moves
few, large rows. Chunk and bucket numbers follow the bytes of text (sizes()), so a task holds as
much whatever the size of the input. The text is shuffled once: every use of the
chunks below has the same exchange, which Spark reuses.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null id counts as: larger than every other.
NO_ID = 2**63 - 1
#: Bytes of text of a chunk.
CHUNK = 32 << 20
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many chunks (of CHUNK bytes of text at most on average) and buckets (half as many, as they
    hold keys) to use; at least two chunks and a bucket for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = partitions(docs)
    return max(2 * n, -(-total // CHUNK)), max(n, -(-total // (2 * CHUNK)))


def chunks(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk, id (null as given), key (id, null as NO_ID), text of every document."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(
        F.pmod(F.xxhash64(key, F.col(text_col)), F.lit(n)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("id"),
        key.alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def by_bucket(messages: DataFrame, answer, schema: str) -> DataFrame:
    return messages.groupBy("bucket").applyInArrow(answer, schema)


def with_answers(chunked: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, schema)


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder below spark.checkpoint.dir, which driver and executors share. Where that and the
    checkpoint folder of the context are unset, a temporary one, if the master is local; on a
    cluster that is an error, as no other machine would see it."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
        top = spark.sparkContext.getCheckpointDir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and there for any executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows; else as it is, for
    a shuffled join. For narrow rows only: df should be cheap to compute again, or written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
