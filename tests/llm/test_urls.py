"""The URL filter: rules against SQL, and the model on hosts that share one alphabet."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from newsgraph.llm import queries, url_filter

# Literals of the contract, not those of the operator.
RULES_SQL = r"""
    with u as (select page_id, coalesce(url, '') as url from read_parquet('{0}')),
    h as (select page_id, url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
          regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from u),
    r(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
    select page_id, host, path, arg_max(r.h || r.p, length(r.h || r.p)) as rule, arg_max(v, length(r.h || r.p)) as verdict
    from h left join r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p) group by page_id, host, path"""


def test_rules_equal_sql(spark, sf):
    pages = f"{sf}/pages.parquet"
    want = {r[0]: r[1:] for r in duckdb.sql(RULES_SQL.format(pages)).fetchall()}
    got = {r.page_id: r for r in queries.op10_url_filter(spark, sf).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(got[i].verdict == w[3] for i, w in want.items() if w[2])
    assert sum(r.rule is not None for r in got.values()) > 10


# The contract's list, word for word.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_verdicts_of_the_contract(spark):
    """Each rule decides as its word in the contract says, on its host and on a subdomain."""
    want = {rule: word for word, rule in (x.split() for x in CONTRACT.split(", "))}
    urls = [f"http://{sub}{rule}1" for sub in ("", "a.") for rule in want]
    got = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), None).collect()
    assert sorted((r.rule, r.verdict) for r in got) == sorted(2 * list(want.items()))


def _made(r: random.Random, n_hosts: int, each: int) -> list[tuple[str, bool]]:
    """Hosts of two vocabularies of syllables over the same letters, with the same ends and paths."""
    kinds = {True: ["lor", "tana", "resi", "nolat", "erit", "sal"], False: ["rol", "anat", "iser", "talon", "tire", "las"]}
    out = []
    for k in range(n_hosts):
        bad = k % 4 == 0
        part = lambda: "".join(r.choice(kinds[bad]) for _ in range(3))  # noqa: B023, E731
        name = f"{part()}-{part()}.{r.choice(['com', 'net', 'info'])}"
        out += [(f"http://{name}/{part()}/{r.randrange(1000)}", bad) for _ in range(each)]
    return out


@pytest.mark.parametrize("n_hosts", [84, 400])
def test_model_on_hosts_of_one_alphabet(spark, n_hosts):
    """Of 250 accepted URLs as of 1200: recall of at least 0.9 on other hosts, at a loss of 0.01."""
    rows = _made(random.Random(n_hosts), n_hosts, 4)
    model = url_filter.fit(spark.createDataFrame(rows, "url string, rejected boolean").repartition(3))
    assert model.lost <= 0.01 and model.recall >= 0.9 and model.precision > 0.9
    fresh = spark.createDataFrame(_made(random.Random(1), 300, 2), "url string, bad boolean")
    out = url_filter.filter_urls(fresh, model, rules=()).groupBy("bad").agg(F.avg((F.col("verdict") == "block").cast("int")).alias("b"))
    got = {x.bad: x.b for x in out.collect()}
    assert got[True] >= 0.9 and got[False] <= 0.03


def test_model_without_signal_loses_no_more_than_stated(spark):
    r = random.Random(4)
    rows = [(u, r.random() < 0.2) for u, _ in _made(r, 200, 4)]
    model = url_filter.fit(spark.createDataFrame(rows, "url string, rejected boolean"))
    assert model.lost <= 0.01 and 0 <= model.recall < 0.3


def test_long_and_repeated_urls(spark):
    model = url_filter.fit(spark.createDataFrame(_made(random.Random(2), 80, 3), "url string, rejected boolean"))
    long = "http://lortana.com/" + "resinolat" * 30_000
    frame = spark.createDataFrame([(1, long), (2, long), (3, "http://rol.com/"), (3, "http://rol.com/"), (4, None)], "page_id int, url string")
    got = [(r.page_id, len(r.path), r.verdict) for r in url_filter.filter_urls(frame, model).orderBy("page_id").collect()]
    assert got == [(1, 270_001, "block"), (2, 270_001, "block"), (3, 1, "allow"), (3, 1, "allow"), (4, 0, "allow")]
    assert model.score(long) > model.threshold
