"""The queries opN_<name> of this package and the SQL that some of them can be checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.llm import decontaminate, divergence, exchange, html_text, lexical, minhash, mixing, quality, secrets, simhash, substring_dedup, suffix_dedup, url_filter, warc
from newsgraph.llm.sql_hash import xxh64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted once; the sums, the classes and the draw read a narrow table.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("n"), F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix_sources(exchange.written(docs), size_col="n")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_line_model(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs.select("doc_id", "text"), model).drop("text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("n_windows").cast("long").alias("n_windows"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    labels = exchange.written(url_filter.labels_from_text(html_text.extract_main_text(pages)))
    model = url_filter.fit(labels)
    exchange.drop(labels)
    return url_filter.filter_urls(pages.drop("html"), model)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_simhash_duplicates": op12_simhash_duplicates,
    "op13_ranked_search": op13_ranked_search,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Fixed values, written out here and not taken from the operator: the contract's patterns with the
#: least length of what they find, then those that the method adds.
_SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "(AKIA[A-Z0-9]+)", 20),
    ("hex", "([0-9a-f]+)", 24),
    ("private_key", "(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1),
    ("github", "(gh[pousr]_[A-Za-z0-9]{36,})", 40),
    ("google", "(AIza[0-9A-Za-z_-]{35})", 39),
    ("slack", "(xox[abprs]-[A-Za-z0-9-]{10,})", 15),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 38),
)


def _found_by(rules: tuple[tuple[str, str, int], ...]) -> str:
    """(doc_id, place, kind, s, e) of the matches of every rule that are long enough: the text is cut
    before each match by marks of the private area, and lengths are summed."""
    cut, value, end = (f"chr({0xE000 + i})" for i in range(3))
    one = """select doc_id, {place} as place, '{kind}' as kind, s, s + m as e from (select *, sum(m + rest) over (partition by doc_id order by j) - m - rest as s from (
        select doc_id, j, case when j = 1 then 0 else length(split_part(p, {value}, 1)) end as m, case when j = 1 then '' else split_part(split_part(p, {value}, 2), {end}, 1) end as v,
          case when j = 1 then length(p) else length(p) - length(split_part(p, {value}, 1)) - length(split_part(split_part(p, {value}, 2), {end}, 1)) - 2 end as rest
        from (select doc_id, unnest(x) as p, generate_subscripts(x, 1) as j from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '({pattern})', {cut} || '\\1' || {value} || '\\2' || {end}, 'g'), {cut}) as x from documents)))) where j > 1 and length(v) >= {least}"""
    return " union all ".join(one.format(place=i, kind=kind, pattern=pattern.replace("'", "''"), least=least, cut=cut, value=value, end=end) for i, (kind, pattern, least) in enumerate(rules))


ORACLE: dict[str, str] = {
    "op3_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
        p as (select doc_id, j, substring(x, 2000 * j + 1, 2098) as y from (select doc_id, x, unnest(range((len(x) // 2 + 999) // 1000)) as j from d)),
        w as (select doc_id, unnest(list_transform(range(least(1000, len(y) // 2 - 49)), lambda i: md5(substring(y, 2 * i + 1, 100)))) as h, unnest(range(least(1000, len(y) // 2 - 49))) + 1000 * j as i from p where len(y) >= 100),
        m as (select h, min(doc_id) as least from w group by h),
        g as (select distinct doc_id, unnest(range(i, i + 50)) as k from w join m using (h) where least < doc_id),
        n as (select doc_id, count(*) as n, count(*) filter (k - 1 <> before or before is null) as spans from (select *, lag(k) over (partition by doc_id order by k) as before from g) group by doc_id),
        b as (select p.doc_id, unnest(range(least(1000, len(y) // 2))) + 1000 * j as k, unnest(list_transform(range(least(1000, len(y) // 2)), lambda i: substring(y, 2 * i + 1, 2))) as b from p join n using (doc_id)),
        kept as (select doc_id, string_agg(b, '' order by k) as y from b anti join g using (doc_id, k) group by doc_id)
        select doc_id, len(x) // 2 as n_bytes, coalesce(n.n, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(case when n.n is null then x else coalesce(y, '') end)) as kept_sha256
        from d left join n using (doc_id) left join kept using (doc_id)""",
    "op4_near_duplicates": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end) as g from d),
        n as (select doc_id, count(*) as n from s group by 1), h as (select doc_id, md5(g) as g from s),
        c as (select x.doc_id as a, y.doc_id as b, count(*) as c from h x join h y using (g) where x.doc_id < y.doc_id group by 1, 2),
        l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l), r as (select doc_id, doc_id as root from d union select e.b, r.root from r join e on e.a = r.doc_id),
        k as (select doc_id, min(root) as component_id from r group by 1)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from d join k using (doc_id) left join n using (doc_id)""",
    "op7_secret_scan": f"""
        with f as ({_found_by(_SECRETS)}),
        g as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h,
          string_agg(kind || ':' || s || ':' || e, ',' order by s, place) filter (place < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans from f group by doc_id)
        select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join g using (doc_id)""",
    "op9_substring_dedup": f"""
        with d as (select doc_id, {WORDS} as w from documents),
        x as (select doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) as h, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
        m as (select h, min(doc_id) as least from x group by h),
        g as (select distinct doc_id, unnest(range(i, i + 50)) as k from x join m using (h) where least < doc_id), n as (select doc_id, count(*) as n from g group by doc_id),
        t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
        kept as (select doc_id, string_agg(word, ' ' order by k) as y from t anti join g using (doc_id, k) group by doc_id)
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(y, '')) as kept_sha256 from d left join n using (doc_id) left join kept using (doc_id)""",
    "op6_warc": """
        with p as (select page_id, encode(coalesce(html, '')) b from pages),
        q as (select page_id, octet_length(b) n, sha1(b) d from p),
        h as (select d, n, max(page_id) head from q where n >= 1000 group by d, n having count(*) > 1)
        select page_id, n::bigint as payload_bytes, d as payload_digest,
               case when head is not null and head <> page_id then 'revisit' else 'response' end as record_type,
               case when head <> page_id then head end as refers_to
        from q left join h using (d, n)""",
    "op11_source_divergence": f"""
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w, row_number() over () as doc from documents),
        t as (select lang, source, doc, unnest(w) as term from d), k as (select lang, term, count(*)::hugeint as total from t group by 1, 2 having count(distinct doc) >= 10),
        g as (select distinct lang, source from d), l as (select lang, count(*)::hugeint as v, sum(total)::hugeint as nl from k group by 1),
        c as (select lang, source, term, count(*)::hugeint as n from t join k using (lang, term) group by 1, 2, 3), s as (select lang, source, sum(n)::hugeint as ns from c group by 1, 2),
        x as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (coalesce(ns, 0) + 2 * v) as p, 1 + (1000000000 * (total + 2)) // (nl + 2 * v) as q
          from g join k using (lang) join l using (lang) left join s using (lang, source) left join c using (lang, source, term)),
        f as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from x join x y using (lang, term) where x.source <> y.source group by 1, 2, 3),
        a as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value from g join g h on h.lang = g.lang and h.source <> g.source left join f on f.lang = g.lang and f.source = g.source and f.item = h.source
          union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from x where n > 0 and p > q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from a)
        select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10""",
    "op12_simhash_duplicates": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as g from d),
        u as (select distinct g from s), {xxh64("u")},
        k as (select doc_id, h, count(*) as n from s join hashed using (g) group by 1, 2), c as (select doc_id, bit, 2 * sum(case when (h >> bit) & 1 = 1 then n else 0 end) > sum(n) as one from k, (select unnest(range(64))::ubigint as bit) z group by 1, 2),
        f as (select doc_id, coalesce(sum(case when one then (1::hugeint << bit::int) else 0 end), 0)::ubigint as code from d left join c using (doc_id) group by 1), n as (select code, min(doc_id) as least from f group by 1),
        e as (select x.code as a, y.code as b from n x join n y on x.code <> y.code and bit_count(xor(x.code, y.code)) <= 2), r as (select code, code as root from n union select e.b, r.root from r join e on e.a = r.code),
        m as (select r.code, min(n.least) as component_id from r join n on n.code = r.root group by 1)
        select doc_id, lower(lpad(hex(code), 16, '0')) as fingerprint, component_id from f join m using (code)""",
    "op13_ranked_search": r"""
        with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        a as (select item_id, term, count(*) as k from q group by 1, 2), l as (select doc_id, count(*) as n from t group by 1), s as (select count(*) as nn, sum(n)::bigint as ll from l),
        c as (select doc_id, term, count(*) as tf from t where term in (select term from q) group by 1, 2), f as (select term, count(*) as df from c group by 1),
        v as (select doc_id, term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) as value from c join f using (term) join l using (doc_id), s),
        h as (select item_id, doc_id, sum(k * value)::bigint as score from a join v using (term) group by 1, 2)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from h where score > 0 qualify rank <= 10""",
}
