"""Fields of JSON documents of several shapes, by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.registry import Tables, query

#: Paths and types of the fields that jobs read, by shape.
SHAPES: dict[str, dict[str, tuple[str, str]]] = {
    "kev": {"cve_id": ("$.cveID", "string"), "vendor": ("$.vendorProject", "string"), "added": ("$.dateAdded", "date"), "ransomware": ("$.knownRansomwareCampaignUse", "string")},
    "stix": {"id": ("$.id", "string"), "name": ("$.name", "string"), "revoked": ("$.revoked", "boolean"), "alias": ("$.aliases[0]", "string"), "external_id": ("$.external_references[0].external_id", "string")},
    "nvd": {"cve_id": ("$.cve.id", "string"), "score": ("$.cve.metrics.cvssMetricV31[0].cvssData.baseScore", "double"), "modified": ("$.cve.lastModified", "string"), "cwe": ("$.cve.weaknesses[0].description[0].value", "string")},
    "preferences": {"topics": ("$.topics", "array<string>"), "per_page": ("$.layout.per_page", "int"), "theme": ("$.theme", "string")},
}


def json_fields(rows: DataFrame, shape: str, column: str = "value") -> DataFrame:
    """rows with the fields of the shape in place of the JSON text, and malformed: whether it is none.

    The text is parsed once, to a VARIANT. A path that leads nowhere, and a value that does not
    have the type, is null, as are all fields of null or malformed text; null text is not malformed.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(column))
    fields = {name: F.try_variant_get("_v", path, kind) for name, (path, kind) in SHAPES[shape].items()}
    return parsed.withColumns(fields).withColumn("malformed", F.col("_v").isNull() & F.col(column).isNotNull()).drop("_v", column)


def malformed_counts(rows: DataFrame, by: str) -> DataFrame:
    """(by, documents, malformed) of json_fields()."""
    return rows.groupBy(by).agg(F.count("*").alias("documents"), F.count_if("malformed").alias("malformed"))


def _texts(t: Tables, shape) -> DataFrame:
    """Rows of part with a document; every ninth is cut, every eleventh is null."""
    key = F.col("p_partkey")
    text = F.to_json(shape, {"ignoreNullFields": "true"})
    return t.part.select(key.alias("key"), F.when(key % 11 == 0, None).when(key % 9 == 0, F.left(text, F.length(text) - 1)).otherwise(text).alias("value"))


_HOLES = "case when p_partkey % 11 = 0 or p_partkey % 9 = 0 then null else {} end as {}"
_BAD = "p_partkey % 9 = 0 and p_partkey % 11 <> 0 as malformed"


def _sql(**fields: str) -> str:
    return f"select p_partkey as key, {', '.join(_HOLES.format(v, k) for k, v in fields.items())}, {_BAD} from part"


@query("N20_kev", _sql(cve_id="'CVE-2024-' || p_partkey", vendor="p_brand", added="case when p_size % 5 > 0 then date '2024-01-01' + p_size::int end", ransomware="case when p_size % 2 = 0 then 'Known' end"))
def _(t: Tables) -> DataFrame:
    day = F.when(F.col("p_size") % 5 > 0, F.date_add(F.lit("2024-01-01"), F.col("p_size").cast("int")).cast("string")).otherwise("soon")
    return json_fields(_texts(t, F.struct(F.concat(F.lit("CVE-2024-"), "p_partkey").alias("cveID"), F.col("p_brand").alias("vendorProject"), day.alias("dateAdded"), F.when(F.col("p_size") % 2 == 0, "Known").alias("knownRansomwareCampaignUse"))), "kev")


@query("N20_stix", _sql(id="'malware--' || p_partkey", name="p_name", revoked="p_size > 30", alias="case when p_size % 3 > 0 then p_brand end", external_id="case when p_size % 2 = 0 then 'S' || p_size end"))
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    aliases = F.when(size % 3 > 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    references = F.when(size % 2 == 0, F.array(F.struct(F.concat(F.lit("S"), "p_size").alias("external_id"), F.lit("x").alias("source_name"))))
    return json_fields(_texts(t, F.struct(F.concat(F.lit("malware--"), "p_partkey").alias("id"), F.col("p_name").alias("name"), (size > 30).alias("revoked"), aliases.alias("aliases"), references.alias("external_references"))), "stix")


@query("N20_nvd", _sql(cve_id="'CVE-2024-' || p_partkey", score="case when p_size % 4 > 0 then p_size / 5.0 end", modified="'2024-02-0' || (p_size % 9 + 1)", cwe="case when p_size % 3 > 0 then 'CWE-' || p_size end"))
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    metrics = F.when(size % 4 > 0, F.struct(F.array(F.struct(F.struct((size / 5.0).alias("baseScore")).alias("cvssData"))).alias("cvssMetricV31")))
    weak = F.when(size % 3 > 0, F.array(F.struct(F.array(F.struct(F.concat(F.lit("CWE-"), "p_size").alias("value"))).alias("description"))))
    cve = F.struct(F.concat(F.lit("CVE-2024-"), "p_partkey").alias("id"), metrics.alias("metrics"), F.concat(F.lit("2024-02-0"), size % 9 + 1).alias("lastModified"), weak.alias("weaknesses"))
    return json_fields(_texts(t, F.struct(cve.alias("cve"))), "nvd")


@query("N20_preferences", _sql(topics="case when p_size % 4 > 0 then p_brand || ',' || p_type end", per_page="case when p_size % 3 > 0 then p_size end", theme="case when p_size > 25 then 'dark' end"))
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    layout = F.struct(F.when(size % 3 > 0, size.cast("string")).otherwise("many").alias("per_page"))
    out = json_fields(_texts(t, F.struct(F.when(size % 4 > 0, F.array("p_brand", "p_type")).alias("topics"), layout.alias("layout"), F.when(size > 25, "dark").alias("theme"))), "preferences")
    return out.withColumn("topics", F.array_join("topics", ","))


@query("N20_malformed", "select p_partkey % 7 as shelf, count(*) as documents, count(*) filter (p_partkey % 9 = 0 and p_partkey % 11 <> 0) as malformed from part group by 1")
def _(t: Tables) -> DataFrame:
    return malformed_counts(json_fields(_texts(t, F.struct(F.col("p_name").alias("cveID"))), "kev").withColumn("shelf", F.col("key") % 7), "shelf")
