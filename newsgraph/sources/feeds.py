"""Feeds in their three forms: RSS and RDF items, Atom entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "title string, link string, guid string, description string, pubDate string, date string, category array<string>"
_LINK = "array<struct<_href: string, _rel: string>>"
_ENTRY = f"title string, link {_LINK}, id string, summary string, content string, published string, updated string, category array<struct<_term: string>>"


def _plain(xml: Column) -> Column:
    """Without name prefixes of elements and attributes of text elements, which the schemas do not name."""
    return F.regexp_replace(F.regexp_replace(xml, r"<(/?)\w+:(\w)", "<$1$2"), r"(?i)<(title|summary|content|guid|description|item)\s[^>]*>", "<$1>")


def read_feed_entries(snapshots: DataFrame) -> DataFrame:
    """One row (source_name, title, link, guid, description, published, tags) for each <item> of RSS or
    RDF and each <entry> of Atom that parses; a broken one or a cut feed costs only itself.

    The link of an entry is its alternate one. Null content: no rows.
    """
    raw = F.regexp_extract_all("raw_content", F.lit(r"(?s)(<(item|entry)[ >].*?</\2>)"), F.lit(1))
    items = snapshots.select("source_name", F.explode(raw).alias("raw")).withColumn("raw", _plain(F.col("raw")))
    parsed = items.select("source_name", F.col("raw").startswith("<entry").alias("atom"), F.from_xml("raw", _ITEM, {"mode": "PERMISSIVE"}).alias("i"), F.from_xml("raw", _ENTRY, {"mode": "PERMISSIVE"}).alias("e"))
    links = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    of = lambda entry, item: F.when(F.col("atom"), entry).otherwise(item)
    out = parsed.select(
        "source_name",
        of(F.col("e.title"), F.col("i.title")).alias("title"),
        of(F.get(links, F.lit(0))["_href"], F.col("i.link")).alias("link"),
        of(F.col("e.id"), F.col("i.guid")).alias("guid"),
        of(F.coalesce("e.content", "e.summary"), F.col("i.description")).alias("description"),
        of(F.coalesce("e.published", "e.updated"), F.coalesce("i.pubDate", "i.date")).alias("published"),
        of(F.transform("e.category", lambda x: x["_term"]), F.col("i.category")).alias("tags"),
    )
    return out.filter("title is not null or link is not null")
