"""Where queries over the given tables and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables by name, and the roles they play (see newsgraph.testdata)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from newsgraph import testdata

        role = testdata.ROLES.get(name)
        return role(self) if role else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, *columns: str) -> Tables:
        """These tables, for a query that reads articles or mentions in many places: both are made from the
        texts once, the articles of these columns and of what mentions are made of."""
        from newsgraph.plans.exchange import written

        held = Tables(self.spark, self.sf_dir)
        held.articles = written(self.articles.select(*dict.fromkeys(("slug", "source_name", "published_at", "raw_tags", "cve_ids", *columns))))
        held.mentions = written(held.mentions)
        return held


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query; `sql` may use the roles of newsgraph.testdata."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            from newsgraph import testdata

            ORACLE[name] = testdata.with_roles(sql)
        return f

    return register
