"""A registry of normalisers, chosen by source, over one set of entries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.operators.normalize import PATTERNS, advisory_id, clean_excerpt, cvss_vector, extract_ids, normalize_entries, strip_markup
from newsgraph.plans.exchange import small
from newsgraph.registry import Tables, query

Normalizer = Callable[[DataFrame], DataFrame]
_NORMALIZERS: dict[str, Normalizer] = {}
#: What every normaliser returns.
COLUMNS = ("slug", "guid", "source_name", "title", "author", "desc", "content_html", "tags", "source_url", "published", "severity", "type", "category", "credibility_weight", "cve_ids", "cvss_vector", "advisory_id", "normalizer")
GENERIC = "generic"


def register(*names: str) -> Callable[[Normalizer], Normalizer]:
    """Make a function from entries to COLUMNS the normaliser of these names; the last one of a name counts."""

    def add(f: Normalizer) -> Normalizer:
        _NORMALIZERS.update(dict.fromkeys(names, f))
        return f

    return add


def flagged(extract_cves: bool = False, extract_cvss: bool = False, author: str | None = None) -> Normalizer:
    """The usual normaliser: text without markup as excerpt; ids of the text where the flags say so."""

    def run(entries: DataFrame) -> DataFrame:
        text = F.coalesce("description", F.lit(""))
        cves = extract_ids(text, PATTERNS["cve"]) if extract_cves else F.lit(None).cast("array<string>")
        vector = cvss_vector(text) if extract_cvss else F.lit(None).cast("string")
        advisory = advisory_id(F.col("source_url")) if extract_cvss else F.lit(None).cast("string")
        excerpt = F.nullif(clean_excerpt(F.left(strip_markup(text), F.lit(2000))), F.lit(""))
        return entries.withColumns({
            "author": F.lit(author).cast("string") if author else F.col("author"), "desc": excerpt, "content_html": F.nullif("description", F.lit("")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")) if not author else F.array().cast("array<string>"), "cve_ids": F.when(F.size(cves) > 0, cves), "cvss_vector": vector, "advisory_id": advisory,
        })

    return run


register(GENERIC, "thn", "bleepingcomputer", "securityweek", "krebs")(flagged())
register("cisa_advisory")(flagged(extract_cves=True, extract_cvss=True, author="CISA"))


@register("cisa_news")
def cisa_news(entries: DataFrame) -> DataFrame:
    """Titles and links only: the feed has no text."""
    none = lambda kind: F.lit(None).cast(kind)
    return entries.withColumns({"author": F.lit("CISA"), "desc": none("string"), "content_html": none("string"), "tags": F.array().cast("array<string>"), "cve_ids": none("array<string>"), "cvss_vector": none("string"), "advisory_id": none("string")})


def normalize_by_source(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries as articles (COLUMNS), each by the normaliser of its source, in one plan.

    entries: source_name, title, link, id, author, description, tags, published; sources: source_name,
    normalizer, severity, type, category, credibility_weight, one row each. Rows without a title or a link go.
    A name that is not registered, a null one and an unknown source fall back to the generic normaliser
    (the column says which one it was). Names of one function share a branch of the union, so the
    entries are read once for each function, not for each source.
    """
    rows = normalize_entries(entries.join(small(sources), "source_name", "left"))
    name = F.when(F.col("normalizer").isin(*_NORMALIZERS), F.col("normalizer")).otherwise(GENERIC)
    rows = rows.withColumn("normalizer", name)
    named: dict[Normalizer, list[str]] = {}
    for n, f in _NORMALIZERS.items():
        named.setdefault(f, []).append(n)
    parts = [f(rows.filter(F.col("normalizer").isin(*names))).select(*COLUMNS) for f, names in named.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "N1_registry",
    """with s as (select *, cast(substr(source, 4) as int) as k from documents), n as (select *, case k when 0 then 'cisa_advisory' when 1 then 'cisa_advisory' when 2 then 'cisa_news' when 3 then 'krebs' else 'generic' end as normalizer from s where trim(lang) <> '' and doc_id % 10 <> 3)
    select doc_id::varchar as guid, normalizer, case when k < 3 then 'CISA' end as author, case when k < 19 then 'low' end as severity, case when k = 2 then null when doc_id % 4 = 0 then null else 'Fixed CVE-2024-1 &' || ' CVE-2024-12345 (CVSS:3.1/AV:N/AC:L) in ' || lang || '.' end as "desc",
      case when k < 2 and doc_id % 4 > 0 then 'CVE-2024-12345' end as cves, case when k < 2 and doc_id % 4 > 0 then 'CVSS:3.1/AV:N/AC:L' end as cvss_vector, case when k < 3 then '' else lang end as tags from n""",
)
def _(t: Tables) -> DataFrame:
    """Documents as entries of sources with seven normalisers, one of them not registered, one null, one source unknown."""
    text = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("<p>Fixed CVE-2024-1 & <b>CVE-2024-12345</b> (CVSS:3.1/AV:N/AC:L) in "), "lang", F.lit(".</p>"))).otherwise(F.lit(""))
    link = F.when(F.col("doc_id") % 10 != 3, F.concat(F.lit("http://x/"), "doc_id"))
    entries = t.documents.select(F.col("source").alias("source_name"), F.col("lang").alias("title"), link.alias("link"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("author"), text.alias("description"), F.array("lang").alias("tags"), F.lit(None).cast("string").alias("published"))
    k = F.substring("source_name", 4, 9).cast("int")
    names = F.when(k < 2, "cisa_advisory").when(k == 2, "cisa_news").when(k == 3, "krebs").when(k == 4, "nowhere").when(k > 5, "generic")
    sources = entries.select("source_name").distinct().filter(k < 19).select("source_name", names.alias("normalizer"), F.lit("low").alias("severity"), F.lit("news").alias("type"), F.lit("x").alias("category"), F.lit(1.0).alias("credibility_weight"))
    out = normalize_by_source(entries, sources)
    return out.select("guid", "normalizer", "author", "severity", "desc", F.array_join("cve_ids", ",").alias("cves"), "cvss_vector", F.array_join("tags", ",").alias("tags"))
