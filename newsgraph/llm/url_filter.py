"""URL filters: rules by host and path, and a character language-model ratio for the rest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm import quality

#: Symbols of the models: 1-26 letters, 27 any digit, 28 '.', 29 '/', 30 '-', 31 anything else, 0 before the start.
SYMBOLS = 32
#: Characters of a context at most, so a model has at most SYMBOLS ** (ORDER + 1) counts (8 MB).
ORDER = 3
_CODE = np.full(0x80, 31, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = 27
_CODE[[ord("."), ord("/"), ord("-")]] = 28, 29, 30

#: Rules of the query (host suffix, path prefix, verdict); fixed values.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' without :// or for null."""
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without :// or for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, rule (host then path of the longest rule that fits, or null) and rule_verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of equal
    length that fit, the first in code point order counts. The rules are a fixed list, matched in
    one expression.
    """
    out = urls.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def codes(url: str | None) -> np.ndarray:
    """Symbols of a URL without its scheme, with ORDER symbols 0 before them."""
    text = (url or "").split("://", 1)[-1]
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(ORDER, np.int64), _CODE[np.minimum(at, 0x7F)]])


def grams(url: str | None) -> np.ndarray:
    """The number of each character with the ORDER before it."""
    c = codes(url)
    out = np.zeros(len(c) - ORDER, np.int64)
    for i in range(ORDER + 1):
        out = out * SYMBOLS + c[i : len(c) - ORDER + i]
    return out


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log p(symbol | up to ORDER symbols before), interpolated over the orders (Witten and Bell)."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(SYMBOLS ** (ORDER - order), *[SYMBOLS] * order, SYMBOLS).sum(axis=0).reshape(-1, SYMBOLS)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1))
        p = np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(p).ravel()


class UrlModel:
    """log p_rejected - log p_accepted of each character in its context, and a threshold; lost,
    recall and precision are those of the threshold on URLs of hosts that were not counted."""

    def __init__(self, ratio: np.ndarray, threshold: float = 0.0, lost: float | None = None, recall: float | None = None, precision: float | None = None):
        self.ratio, self.threshold = ratio, threshold
        self.lost, self.recall, self.precision = lost, recall, precision

    def score(self, url: str | None) -> float:
        """The difference per character; 0 for no URL."""
        g = grams(url)
        return float(self.ratio[g].mean()) if len(g) else 0.0

    def scores(self, url: Column) -> Column:
        return _scores([self.ratio], url, F.lit(0))


def _scores(ratios: list[np.ndarray], url: Column, which: Column) -> Column:
    """The score of each URL by one of the models."""

    @F.pandas_udf("double")
    def scored(urls: pd.Series, which: pd.Series) -> pd.Series:
        models = [UrlModel(x) for x in ratios]
        return pd.Series([models[k].score(u) for u, k in zip(urls, which, strict=True)], dtype="float64")

    return scored(url, which)


def _ratio(counts: np.ndarray) -> np.ndarray:
    """The differences from the counts of both kinds (accepted, rejected)."""
    accepted, rejected = (_log_probabilities(x) for x in counts)
    return (rejected - accepted).astype(np.float32)


def fit(labelled: DataFrame, url_col: str = "url", rejected_col: str = "rejected", most_lost: float = 0.01, folds: int = 5) -> UrlModel | None:
    """Count every labelled URL; calibrate the threshold on all of them, each by a model without its fold.

    Counts are made where the URLs are: distinct (fold, label, gram) with partial aggregation, of
    which there are at most 2 * folds * SYMBOLS ** (ORDER + 1) however many URLs there are. Folds
    are of whole hosts, so a URL is scored by a model that has not counted its host. The threshold
    is the least score (on a grid of 0.01, not below 0) above which are at most `most_lost` of the
    accepted URLs; as all of them are scored, 100 URLs are enough for a loss of 0.01. Null URL or
    label: not counted. Repeated URLs count as often as they occur. None without URLs of both kinds.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(rejected_col).cast("boolean").alias("rejected")).filter("url is not null and rejected is not null")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(host(F.col("url"))), F.lit(folds)).cast("int"))

    @F.pandas_udf("array<int>")
    def all_grams(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: grams(u).astype(np.int32))

    counted = rows.select("fold", "rejected", F.explode(all_grams("url")).alias("gram")).groupBy("fold", "rejected", "gram").count().toPandas()
    if counted["rejected"].nunique() < 2:
        return None
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    kind, gram, n = counted["rejected"].to_numpy().astype(int), counted["gram"].to_numpy(), counted["count"].to_numpy()
    np.add.at(counts, (kind, gram), n)
    ratios = []
    for k in range(folds):
        own = (counted["fold"] == k).to_numpy()
        rest = counts.copy()
        np.subtract.at(rest, (kind[own], gram[own]), n[own])
        ratios.append(_ratio(rest))
    cell = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.ceil(_scores(ratios, F.col("url"), F.col("fold")) * 100)))
    held = rows.groupBy("rejected", cell.alias("cell")).count().toPandas()
    totals = {k: held.loc[held["rejected"] == k, "count"].sum() for k in (True, False)}

    def above(limit: int, rejected: bool) -> int:
        return int(held.loc[(held["rejected"] == rejected) & (held["cell"] > limit), "count"].sum())

    # Above the greatest score there is none.
    limit = next(c for c in range(0, 1001) if above(c, False) <= most_lost * totals[False])
    lost, caught = above(limit, False), above(limit, True)
    return UrlModel(_ratio(counts), limit / 100, lost / totals[False], caught / totals[True], caught / (caught + lost) if caught + lost else None)


def labels_from_text(pages: DataFrame, url_col: str = "url", text_col: str = "text", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(url, rejected) from the text of the pages, which says nothing of the words in a URL.

    Rejected: the text fails the base quality rules (under 20 words, or over 30 % of them in
    repeated windows), or one in 20 of its characters is a symbol. Accepted: 50 words or more and
    at most one symbol in 100 characters. Pages in between, and URLs that a rule decides, are not
    labels and train neither model. Null text: no words; null URL: no label.
    """
    judged = quality.judge_quality(with_rules(pages.select(F.col(url_col).alias("url"), F.col(text_col).alias("text"))), None, id_col="url")
    open_to_both = judged.filter("url is not null and rule is null")
    bad = F.col("base_failed") | (20 * F.col("n_symbols") >= F.col("word_chars"))
    good = (F.col("n_words") >= 50) & (100 * F.col("n_symbols") <= F.col("word_chars"))
    return open_to_both.select("url", F.when(bad, True).when(good, False).alias("rejected")).filter("rejected is not null")


def filter_urls(urls: DataFrame, model: UrlModel | None, rules: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """Judge every URL: add host, path, rule, score and verdict (allow or block).

    The longest rule that fits decides; where none does, the model blocks scores above its
    threshold and allows the rest. Null or empty URL: empty host and path, score 0, allow. Every
    character of a long URL counts; equal URLs get equal verdicts, each in its row. Columns of urls
    with these names are replaced. One pass, no shuffle.
    """
    ruled = with_rules(urls.drop("host", "path", "rule", "score", "verdict"), rules, url_col)
    score, limit = (F.lit(0.0), 0.0) if model is None else (model.scores(F.col(url_col)), model.threshold)
    scored = ruled.withColumn("score", score)
    own = F.when(F.col("score") > limit + math.ulp(1.0), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")
