"""Secret scans: trigram queries from regular expressions, an inverted index, verified candidates.

All work on rows is done by built-in expressions. Only the rules, a fixed list, are analysed on
the driver.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm import exchange


@dataclass(frozen=True)
class Rule:
    """A pattern (common to Java and Python) with a group 1 whose length must reach `least`."""

    kind: str
    pattern: str
    least: int = 1
    base: bool = False


#: Fixed values. The lengths of `access` and `hex` can stand in the pattern: a match takes a
#: maximal run, of which no shorter tail can pass.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    Rule("access", r"(AKIA[A-Z0-9]{16,})", 20, True),
    Rule("hex", r"([0-9a-f]{24,})", 24, True),
    Rule("private_key", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)"),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})"),
    Rule("google", r"(AIza[0-9A-Za-z_-]{35})"),
    Rule("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
)

#: A query: alternatives, each a set of lower-case trigrams that must all occur. An alternative
#: without trigrams stands for every text.
Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])
_MOST = 64


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3].lower() for i in range(len(text) - 2))


def _and(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MOST else a


def trigram_query(pattern: str) -> Query:
    """The trigrams without which the pattern cannot match: literals that any match contains."""

    def walk(items) -> Query:
        """A sequence: runs of literals, cut where anything else may stand."""
        query, run = _ANY, ""
        for op, arg in items:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg)
                continue
            inner = None
            if op is sre.SUBPATTERN:
                inner = arg[3]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                inner = arg[2]
            if op is sre.SUBPATTERN and all(o is sre.LITERAL and a < 128 for o, a in inner):
                run += "".join(chr(a) for _, a in inner)  # a group of literals does not end the run
                continue
            query, run = _and(query, frozenset([_grams(run)])), ""
            if inner is not None:
                query = _and(query, walk(inner))
            elif op is sre.BRANCH:
                query = _and(query, frozenset().union(*(walk(x) for x in arg[1])))
        return _and(query, frozenset([_grams(run)]))

    found = walk(parser.parse(pattern))
    return _ANY if frozenset() in found else found


_OPEN, _CLOSE, _VALUE = "\ue000", "\ue001", "\ue002"


def _key(text_col: str, id_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(text_col, F.lit(1), id_col).alias("_k2")]


def trigram_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (gram, _k1, _k2) of the trigrams that the rules ask for; a row is known by two hashes."""
    low = docs.select(*_key(text_col, id_col), F.lower(text_col).alias("_low"))
    found = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("_k1", "_k2", F.explode(found).alias("gram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k1, _k2, kinds): the rules whose trigram query a row fulfils, by intersection of postings."""
    asked = [(r.kind, i, g, len(part)) for r in rules for i, part in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for g in part]
    if not asked:
        return docs.limit(0).select(*_key(text_col, id_col), F.array().cast("array<string>").alias("kinds"))
    postings = trigram_index(docs, sorted({g for _, _, g, _ in asked}), id_col, text_col)
    # The queries are part of the plan: a literal array of what each trigram is asked for.
    uses = F.create_map(*(x for gram in sorted({g for _, _, g, _ in asked}) for x in (F.lit(gram), F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("part"), F.lit(n).alias("size")) for k, i, g, n in asked if g == gram)))))
    hits = postings.select("_k1", "_k2", F.explode(uses[F.col("gram")]).alias("use"))
    both = hits.groupBy("_k1", "_k2", "use").count().filter(F.col("count") == F.col("use.size"))
    return both.groupBy("_k1", "_k2").agg(F.collect_set("use.kind").alias("kinds"))


def _with_kinds(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(row, kinds): docs as a struct, so that no name of theirs meets one of these, and the rules to
    verify on each row, those without mandatory trigrams always.

    Texts stay where they are if the rows with candidates are counted to be few; else both sides
    are shuffled by the key.
    """
    always = [r.kind for r in rules if trigram_query(r.pattern) == _ANY]
    found = exchange.small(exchange.written(candidates(docs, rules, id_col, text_col)), 200_000)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *_key(text_col, id_col))
    kinds = F.concat(F.coalesce("kinds", F.array().cast("array<string>")), F.array(*map(F.lit, always)).cast("array<string>"))
    return keyed.join(found, ["_k1", "_k2"], "left").select("row", kinds.alias("kinds"))


def _pieces(text: Column, rule: Rule) -> Column:
    """The text cut before each match; a piece is match, _VALUE, value, _CLOSE and what follows."""
    plain = F.translate(text, _OPEN + _CLOSE + _VALUE, "\ufffd" * 3)  # no rule matches these
    return F.split(F.regexp_replace(plain, rule.pattern, f"{_OPEN}$0{_VALUE}$1{_CLOSE}"), _OPEN, -1)


def _piece(p: Column) -> tuple[Column, Column, Column]:
    """Match, value and rest of a piece."""
    body = F.substring_index(p, _CLOSE, 1)
    match = F.substring_index(body, _VALUE, 1)
    size = F.length(p)
    value = F.substring(body, F.length(match) + 2, size)
    return match, value, F.substring(p, F.length(body) + 2, size)


def _found(pieces: Column, rule: Rule, order: int) -> Column:
    """Spans (start, place of the rule, kind, end) in code points of the matches that pass."""
    cuts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: _cut(p, rule))
    start = F.struct(F.length(pieces[0]).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>").alias("out"))

    def step(acc: Column, cut: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), (acc["at"] + cut["size"]).alias("end"))
        return F.struct((acc["at"] + cut["size"] + cut["rest"]).alias("at"), F.when(cut["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cuts, start, step, lambda acc: acc["out"])


def _cut(p: Column, rule: Rule) -> Column:
    match, value, rest = _piece(p)
    return F.struct(F.length(match).cast("long").alias("size"), (F.length(value) >= rule.least).alias("ok"), F.length(rest).cast("long").alias("rest"))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(row, found): docs as a struct and the spans of all rules in each text."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    names = [f"pieces{i}" for i in range(len(rules))]
    pieces = [F.when(F.array_contains("kinds", r.kind), _pieces(text, r)).otherwise(F.array(F.lit(""))).alias(n) for n, r in zip(names, rules, strict=True)]
    out = _with_kinds(docs, rules, id_col, text_col).select("row", *pieces)
    spans = [_found(F.col(n), r, i) for i, (n, r) in enumerate(zip(names, rules, strict=True))]
    return out.select("row", F.sort_array(F.concat(*spans)).alias("found"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add found, the spans of all rules in order of start and rule, to the columns of docs.

    Trigram queries pick the rules to run on each row; matches of a rule are leftmost and do not
    overlap, and count if their value is long enough. Spans are in code points, end exclusive.
    Null or empty text: none. Rows that are equal in id and text share one posting and are each
    returned; rows with equal ids and different texts are different rows. A column of docs named
    found is replaced; all others stay as they are, whatever their names. Empty table: none.
    """
    own = [c for c in docs.columns if c != "found"]
    return _scanned(docs.select(*own), rules, id_col, text_col).select(*(F.col("row")[c].alias(c) for c in own), "found")


def span_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, a count n_<kind> of each base rule, base_sha256 and spans as text."""
    out = scan_secrets(docs.select(id_col, text_col), rules, id_col, text_col)
    base = [r.kind for r in rules if r.base]
    counts = [F.array_size(F.filter(F.transform("found", lambda s: s["kind"]), lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in base]
    of_base = F.filter("found", lambda s: s["kind"].isin(base))
    return out.select(id_col, *counts, F.sha2(F.encode(span_text(of_base), "utf-8"), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<redacted>", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of scan_secrets() replaced by `mark` (spans that overlap by one); all rows
    and columns stay. Null text stays null."""
    text = F.col("row")[text_col]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(since: Column, until: Column) -> Column:
        return F.substring(text, (since + 1).cast("int"), (until - since).cast("int"))

    def step(acc: Column, span: Column) -> Column:
        new = F.concat(acc["out"], F.array(cut(acc["at"], span["start"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("found", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], F.length(text).cast("long"))))
    clean = F.when(F.size("found") > 0, whole).otherwise(text)
    return _scanned(docs, rules, id_col, text_col).select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
