"""Entities: gazetteer matches, aliases, spans from token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.operators.normalize import normalized_key
from newsgraph.plans.exchange import small, written
from newsgraph.registry import Tables, query

WORD = r"(?U)\w+"


def match_gazetteer(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(slug, normalized_key, name): names that stand in the text as whole words.

    Texts are cut into words; names meet them by an equi-join on n-grams of words in lower case,
    of as many words as the names have. A name of 3 characters or fewer must agree in its
    capitals, an alias never needs to. gazetteer: name, normalized_key, is_alias.
    """
    words = F.regexp_extract_all("name", F.lit(WORD), F.lit(0))
    names = gazetteer.withColumn("n", F.size(words)).withColumn("gram", F.lower(F.array_join(words, " "))).filter("n > 0")
    sizes = names.agg(F.array_sort(F.collect_set("n")).alias("sizes"))
    tokens = docs.select("slug", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    grams = tokens.crossJoin(F.broadcast(sizes)).select("slug", "w", F.explode("sizes").alias("n")).filter(F.size("w") >= F.col("n"))
    placed = grams.select("slug", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("found"))
    # The few names go to the grams, so the grams of all texts are never shuffled.
    hits = placed.withColumn("gram", F.lower("found")).join(small(names), ["n", "gram"])
    exact = F.col("is_alias") | (F.length("name") > 3) | (F.col("found") == F.col("name"))
    return hits.filter(exact).select("slug", "normalized_key", "name").distinct()


@query(
    "C8_gazetteer",
    r"""with g as (select distinct array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')[1:2], ' ') as name from benchmark)
    select slug, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as normalized_key, name from articles, g
    where contains(' ' || array_to_string(regexp_extract_all(lower(body), '[\p{L}\p{M}\p{N}_]+'), ' ') || ' ', ' ' || lower(name) || ' ')""",
)
def _(t: Tables) -> DataFrame:
    name = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, 2), " ")
    gazetteer = t.benchmark.select(name.alias("name")).distinct().select("name", normalized_key(F.col("name")).alias("normalized_key"), F.lit(True).alias("is_alias"))
    return match_gazetteer(t.articles.select("slug", F.col("body").alias("text")), gazetteer)


def resolve_aliases(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions under their canonical key; of mentions that meet, the one mentioned most, then the
    earlier one. mentions: slug, normalized_key, mentions, place; aliases: alias, canonical."""
    mapped = mentions.join(aliases, F.col("normalized_key") == F.col("alias"), "left")
    mapped = mapped.withColumn("normalized_key", F.coalesce("canonical", "normalized_key")).select(*mentions.columns)
    w = Window.partitionBy("slug", "normalized_key").orderBy(F.desc("mentions"), "place")
    return mapped.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


@query(
    "C9_resolve_aliases",
    """with m as (select slug, normalized_key, length(name) as mentions, name as place from mentions), r as (select slug, case when normalized_key in ('of', 'la', 'der') then 'the' else normalized_key end as normalized_key, mentions, place from m)
    select slug, normalized_key, mentions, place from r qualify row_number() over (partition by slug, normalized_key order by mentions desc, place) = 1""",
)
def _(t: Tables) -> DataFrame:
    aliases = t.mentions.select(F.col("normalized_key").alias("alias")).filter(F.col("alias").isin("of", "la", "der")).distinct().withColumn("canonical", F.lit("the"))
    return resolve_aliases(t.mentions.select("slug", "normalized_key", F.length("name").alias("mentions"), F.col("name").alias("place")), aliases)


def harvest_aliases(names: DataFrame, least: int = 4) -> DataFrame:
    """(normalized_key, display_name): plausible names of a cache, the least spelling of each key."""
    plausible = (F.length("name") >= least) & F.col("name").rlike("[A-Za-z]{3}")
    keyed = names.filter(plausible).withColumn("normalized_key", normalized_key(F.col("name"))).filter("normalized_key <> ''")
    return keyed.groupBy("normalized_key").agg(F.min("name").alias("display_name"))


@query(
    "A20_harvest",
    "with n as (select unnest(string_split(text, ' ')) as name from benchmark) select trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as normalized_key, min(name) as display_name from n where length(name) >= 4 and regexp_matches(name, '[A-Za-z]{3}') group by 1",
)
def _(t: Tables) -> DataFrame:
    return harvest_aliases(t.benchmark.select(F.explode(F.split("text", " ")).alias("name")))


def by_priority(sets: DataFrame) -> DataFrame:
    """Of (slug, normalized_key, rank): keys that neither equal an earlier set's key of the slug nor
    are a prefix of one up to a hyphen. Earlier keys offer their hyphen prefixes, so it is an
    equi-join; a prefix of a prefix is a prefix, so dropped keys need not be told apart."""
    parts = F.split("normalized_key", "-")
    offered = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    taken = sets.select("slug", F.col("rank").alias("earlier"), F.explode(offered).alias("normalized_key")).groupBy("slug", "normalized_key").agg(F.min("earlier").alias("earlier"))
    out = sets.join(taken, ["slug", "normalized_key"])
    return out.filter(F.col("rank") <= F.col("earlier")).groupBy("slug", "normalized_key").agg(F.min("rank").alias("rank"))


@query(
    "U3_priority",
    """with s as (select slug, normalized_key || '-' || left(source_name, 3) as k, 0 as rank from mentions where type = 'actor' union all select slug, normalized_key, 1 from mentions where length(normalized_key) > 1),
    d as (select slug, k, min(rank) as rank from s group by 1, 2)
    select slug, k as normalized_key, rank from d where not exists (select 1 from d e where e.slug = d.slug and e.rank < d.rank and (e.k = d.k or starts_with(e.k, d.k || '-')))""",
)
def _(t: Tables) -> DataFrame:
    first = t.mentions.filter("type = 'actor'").select("slug", F.concat("normalized_key", F.lit("-"), F.left("source_name", F.lit(3))).alias("normalized_key"), F.lit(0).alias("rank"))
    return by_priority(first.unionByName(t.mentions.filter("length(normalized_key) > 1").select("slug", "normalized_key", F.lit(1).alias("rank"))))


#: Tokens of a task of assemble_spans(), which sorts and groups them several times at once.
TOKENS = 250_000


def assemble_spans(tokens: DataFrame, texts: DataFrame, limits: dict[str, float] | None = None, limit: float = 0.5) -> DataFrame:
    """Entities from a token table (slug, idx, word_id, label, score, start, end): words by their
    best subword, runs of B-/I- labels of a type, runs over the type's mean score, neighbours of a
    type at most a character apart joined unless a sentence ends between; mentions counted. All steps
    are by slug, so one deal of the counted tokens serves them all and bounds what a task holds; give
    tokens that are cheap to read."""
    parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens.count() // TOKENS))
    tokens = tokens.repartition(parts, "slug")
    words = tokens.groupBy("slug", "word_id").agg(
        F.max_by("label", F.struct("score", -F.col("idx"))).alias("label"), F.max("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    by_word = Window.partitionBy("slug").orderBy("word_id")
    tagged = words.withColumn("type", F.nullif(F.regexp_extract("label", "^[BI]-(.*)$", 1), F.lit("")))
    fresh = F.col("label").startswith("B-") | ~F.col("type").eqNullSafe(F.lag("type").over(by_word)) | (F.lag("word_id").over(by_word) != F.col("word_id") - 1)
    runs = tagged.withColumn("new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_word)).filter("type is not null")
    spans = runs.groupBy("slug", "run", "type").agg(F.avg("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
    least = F.lit(limit)
    for kind, x in (limits or {"campaign": 0.75}).items():
        least = F.when(F.col("type") == kind, x).otherwise(least)
    good = spans.filter(F.col("score") >= least).join(texts, "slug")
    near = Window.partitionBy("slug", "type").orderBy("start")
    before = F.lag("end").over(near)
    gap = F.substring(F.col("text"), (before + 1).cast("int"), (F.col("start") - before).cast("int"))
    apart = F.coalesce((F.col("start") - before > 1) | gap.rlike("[.!?]"), F.lit(True))
    joined = good.withColumn("group", F.sum(apart.cast("int")).over(near)).groupBy("slug", "type", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.first("text").alias("text"))
    named = joined.withColumn("name", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return named.withColumn("normalized_key", normalized_key(F.col("name"))).groupBy("slug", "type", "normalized_key").agg(F.count("*").alias("mentions"), F.max("score").alias("score"), F.min("name").alias("name"))


@query(
    "N11_spans",
    r"""with w as (select slug, title, string_split(title, ' ') as ws from articles), k as (select slug, title, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from w),
    s as (select *, coalesce(sum(length(w) + 1) over (partition by slug order by i rows between unbounded preceding and 1 preceding), 0)::bigint as st, regexp_matches(w, '^\p{Lu}') as first from k),
    t as (select *, st + length(w) as en, 0.4::double + (length(w) % 6)::double / 10 as score, case when first then 'actor' when regexp_matches(w, '^[aeiou]') then 'malware' end as type from s),
    n as (select *, case when first or type is distinct from lag(type) over (partition by slug order by i) then 1 else 0 end as new from t), r as (select *, sum(new) over (partition by slug order by i) as run from n),
    p as (select slug, title, run, type, avg(score) as score, min(st) as st, max(en) as en from r where type is not null group by all having avg(score) >= 0.5), b as (select *, lag(en) over (partition by slug, type order by st) as before from p),
    g as (select *, sum(case when before is null or st - before > 1 or regexp_matches(substring(title, before + 1, st - before), '[.!?]') then 1 else 0 end) over (partition by slug, type order by st) as grp from b),
    j as (select slug, title, type, grp, min(st) as st, max(en) as en, avg(score) as score from g group by all), m as (select *, substring(title, st + 1, en - st) as name from j)
    select slug, type, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as normalized_key, count(*) as mentions, max(score) as score, min(name) as name from m group by 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    """Token table derived from the articles: capitalised words in a row are one name."""
    texts = written(t.articles.select("slug", F.col("title").alias("text")))
    words = texts.withColumn("ws", F.split("text", " ")).select("slug", "ws", F.posexplode("ws").alias("word_id", "w"))
    label = F.when(F.col("w").rlike(r"^\p{Lu}"), "B-actor").when(F.col("w").rlike("^[aeiou]"), "I-malware").otherwise("O")
    start = F.when(F.col("word_id") == 0, 0).otherwise(F.length(F.array_join(F.slice("ws", 1, F.col("word_id")), " ")) + 1).cast("long")
    tokens = words.select("slug", F.col("word_id").alias("idx"), "word_id", label.alias("label"), (0.4 + F.length("w") % 6 / 10).alias("score"), start.alias("start"), (start + F.length("w")).alias("end"))
    return assemble_spans(written(tokens), texts)


# --- loads of landed JSON (A13-A18) --------------------------------------------------------------

#: Suffixes of firms and names of tools that are plain words; fixed values.
LEGAL = r"(?i)\s+(corp\.?|inc\.?|ltd\.?|llc\.?|gmbh|co\.|limited|incorporated)\s*$"
STOP_NAMES = ("at", "net", "ftp", "cmd")


def load_kev(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the catalogue (JSON text in a column) with dates and vendors without a parenthesis and
    a legal suffix at the end; rows without a CVE or a vendor of two letters, or with a bad date, go."""
    item = "cveID string, vendorProject string, product string, dateAdded string, dueDate string, knownRansomwareCampaignUse string"
    rows = raw.select(F.explode(F.from_json(column, f"vulnerabilities array<struct<{item.replace(' string', ': string')}>>")["vulnerabilities"]).alias("x")).select("x.*")
    vendor = F.trim(F.regexp_replace(F.regexp_replace(F.trim("vendorProject"), r"\s*\(.*?\)\s*$", ""), LEGAL, ""))
    day = lambda c: F.expr(f"try_to_date({c}, 'yyyy-MM-dd')")
    out = rows.select(F.upper("cveID").alias("cve_id"), vendor.alias("vendor"), "product", day("dateAdded").alias("date_added"), day("dueDate").alias("due_date"), (F.col("knownRansomwareCampaignUse") == "Known").alias("ransomware"))
    return out.filter("cve_id is not null and date_added is not null and length(vendor) >= 2")


@query(
    "A13_kev",
    "select 'CVE-2023-' || (1000 + p_partkey) as cve_id, p_brand as vendor, p_name as product, date '2024-01-01' + (p_size::int) as date_added, p_size % 2 = 0 as ransomware from part where p_partkey % 5 <> 0",
)
def _(t: Tables) -> DataFrame:
    item = F.struct(
        F.concat(F.lit("cve-2023-"), 1000 + F.col("p_partkey")).alias("cveID"),
        F.concat("p_brand", F.element_at(F.array(*map(F.lit, (" Inc.", " Limited", " Incorporated", " (a firm)", " Corp", " GmbH (EU)", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("vendorProject"),
        F.col("p_name").alias("product"),
        F.when(F.col("p_partkey") % 5 == 0, "soon").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("string")).alias("dateAdded"),
        F.when(F.col("p_size") % 2 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"),
    )
    raw = t.part.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("vulnerabilities"))).alias("value"))
    return load_kev(raw).select("cve_id", "vendor", "product", "date_added", "ransomware")


def load_attack(raw: DataFrame, stop: tuple[str, ...] = STOP_NAMES, column: str = "value") -> DataFrame:
    """(normalized_key, name, type, external_id, aliases) of a STIX bundle: without revoked, deprecated
    and stop names. Groups and campaigns have their aliases in one field, in which their own name is
    none; others in the first of two fields that has any. An alias that is a name is none."""
    kinds = {"intrusion-set": "actor", "malware": "malware", "tool": "tool", "campaign": "campaign"}
    item = "type: string, name: string, aliases: array<string>, x_mitre_aliases: array<string>, revoked: boolean, x_mitre_deprecated: boolean, external_references: array<struct<source_name: string, external_id: string>>"
    rows = raw.select(F.explode(F.from_json(column, f"objects array<struct<{item}>>")["objects"]).alias("x")).select("x.*")
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("type")]
    live = ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)) & ~F.lower("name").isin(*stop)
    none = F.array().cast("array<string>")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    own = F.filter(F.coalesce("aliases", none), lambda a: F.trim(a) != F.trim("name"))
    aliases = F.when(F.col("type").isin("intrusion-set", "campaign"), own).otherwise(F.coalesce(some("x_mitre_aliases"), some("aliases"), none))
    refs = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    names = rows.withColumn("kind", kind).filter(live & F.col("kind").isNotNull() & (F.trim("name") != "")).select(
        normalized_key(F.trim("name")).alias("normalized_key"), F.trim("name").alias("name"), F.col("kind").alias("type"), F.get(refs, F.lit(0))["external_id"].alias("external_id"),
        F.filter(F.array_distinct(F.transform(aliases, lambda a: F.trim(a))), lambda a: a != "").alias("aliases"),
    )
    alias = names.select("normalized_key", F.explode("aliases").alias("alias")).withColumn("alias_key", normalized_key(F.col("alias")))
    alias = alias.join(names.select(F.col("normalized_key").alias("alias_key")).distinct(), "alias_key", "left_anti")
    kept = alias.groupBy("normalized_key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return names.drop("aliases").join(kept, "normalized_key", "left")


@query(
    "A15_attack",
    "select trim(regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '-', 'g'), '-') as normalized_key, case when p_size % 2 = 0 then 'actor' else 'malware' end as type, 'G' || p_partkey as external_id, case when p_size % 2 = 0 or p_size % 3 > 0 then 'alias ' || p_partkey else 'x' || p_partkey end as aliases from part where p_size % 7 <> 0",
)
def _(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), "p_partkey")
    item = F.struct(F.when(F.col("p_size") % 2 == 0, "intrusion-set").otherwise("malware").alias("type"), name.alias("name"), F.array(name, F.concat(F.lit("alias "), "p_partkey")).alias("aliases"), F.when(F.col("p_size") % 3 == 0, F.array(F.concat(F.lit(" x"), "p_partkey"))).otherwise(F.array().cast("array<string>")).alias("x_mitre_aliases"), F.array(F.struct(F.lit("other").alias("source_name"), F.lit("y").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("G"), "p_partkey").alias("external_id"))).alias("external_references"), (F.col("p_size") % 7 == 0).alias("revoked"))
    raw = t.part.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("objects"))).alias("value"))
    return load_attack(raw).select("normalized_key", "type", "external_id", F.array_join("aliases", ",").alias("aliases"))


NVD = """id string, vulnStatus string, lastModified string, cisaExploitAdd string,
    metrics struct<cvssMetricV31: array<struct<type: string, cvssData: struct<baseScore: double>>>, cvssMetricV40: array<struct<type: string, cvssData: struct<baseScore: double>>>, cvssMetricV2: array<struct<type: string, cvssData: struct<baseScore: double>>>>,
    weaknesses array<struct<description: array<struct<value: string>>>>"""


def load_nvd(raw: DataFrame, column: str = "value") -> DataFrame:
    """(cve_id, cvss, cwes, kev): score by version 3.1, 4.0, 2.0, primary entries first."""
    rows = raw.select(F.from_json(column, NVD).alias("x")).select("x.*")

    def score(version: str):
        entries = F.col(f"metrics.cvssMetric{version}")
        primary = F.filter(entries, lambda m: m["type"] == "Primary")
        return F.coalesce(F.get(primary, F.lit(0)), F.get(entries, F.lit(0)))["cvssData"]["baseScore"]

    cwes = F.array_distinct(F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))))
    kev = F.col("cisaExploitAdd").isNotNull()
    return rows.select(F.upper("id").alias("cve_id"), F.coalesce(score("V31"), score("V40"), score("V2")).alias("cvss"), F.filter(cwes, lambda c: c.startswith("CWE-")).alias("cwes"), kev.alias("kev"))


@query("A18_nvd", "select 'CVE-2022-' || p_partkey as cve_id, case when p_size % 2 = 0 then p_size / 5.0 else p_size / 10.0 end as cvss, 'CWE-' || p_size as cwes, p_size % 3 = 0 as kev from part")
def _(t: Tables) -> DataFrame:
    entry = lambda kind, x: F.struct(F.lit(kind).alias("type"), F.struct(x.alias("baseScore")).alias("cvssData"))
    even = F.col("p_size") % 2 == 0
    metrics = F.struct(F.when(even, F.array(entry("Secondary", F.lit(1.0)), entry("Primary", F.col("p_size") / 5.0))).alias("cvssMetricV31"), F.array(entry("Secondary", F.col("p_size") / 10.0)).alias("cvssMetricV40"))
    cwe = F.concat(F.lit("CWE-"), "p_size")
    weak = F.array(F.struct(F.array(F.struct(cwe.alias("value")), F.struct(F.lit("NVD-CWE-noinfo").alias("value")), F.struct(cwe.alias("value"))).alias("description")))
    raw = t.part.select(F.to_json(F.struct(F.concat(F.lit("cve-2022-"), "p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "2024-01-01").alias("cisaExploitAdd"), metrics.alias("metrics"), weak.alias("weaknesses"))).alias("value"))
    return load_nvd(raw).withColumn("cwes", F.array_join("cwes", ","))


@query("C7_kev_entities", "with k as (select distinct slug, upper(unnest(cve_ids)) as cve_id from articles), v as (select 'CVE-2024-' || (1000 + cast(floor(p_partkey / 40) as int)) as cve_id, p_brand as vendor from part where p_size < 3) select distinct slug, lower(trim(regexp_replace(vendor, '[^A-Za-z0-9]+', '-', 'g'), '-')) as normalized_key from k join v using (cve_id)")
def _(t: Tables) -> DataFrame:
    kev = t.part.filter("p_size < 3").select(F.concat(F.lit("CVE-2024-"), 1000 + F.floor(F.col("p_partkey") / 40)).alias("cve_id"), F.col("p_brand").alias("vendor"))
    return kev_entities(t.articles, kev)


def kev_entities(articles: DataFrame, kev: DataFrame) -> DataFrame:
    keys = articles.select("slug", F.explode(F.transform("cve_ids", F.upper)).alias("cve_id"))
    return keys.join(kev, "cve_id").select("slug", normalized_key(F.col("vendor")).alias("normalized_key")).distinct()
