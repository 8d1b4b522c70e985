"""XXH64 of texts in DuckDB SQL, for the SQL twin of the SimHash groups."""

from __future__ import annotations

#: The five primes of XXH64; fixed values.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = 2**64


def _mul(a: object, b: object) -> str:
    return f"((({a})::uhugeint * ({b})::uhugeint) % {_ALL}::uhugeint)::ubigint"


def _add(a: object, b: object) -> str:
    return f"((({a})::uhugeint + ({b})::uhugeint) % {_ALL}::uhugeint)::ubigint"


def _xor(a: object, b: object) -> str:
    return f"xor(({a})::ubigint, ({b})::ubigint)"


def _turn(x: str, r: int) -> str:
    """x with its bits turned left by r places; x is computed once."""
    return f"list_transform([{x}], lambda z: (((z::uhugeint * {2**r}::uhugeint) % {_ALL}::uhugeint)::ubigint + (z >> {64 - r})))[1]"


def _round(acc: str, lane: str) -> str:
    return _mul(_turn(_add(acc, _mul(lane, P2)), 31), P1)


def _merged(h: str, v: str) -> str:
    return _add(_mul(_xor(h, _round("0", v)), P1), P4)


def _lane(start: str, n: int) -> str:
    """The number of n bytes from `start` on, the least first."""
    return "(" + " + ".join(f"(b[{start} + {k + 1}])::uhugeint * {256**k}::uhugeint" for k in range(n)) + ")::ubigint"


def _fold(first: str, lanes: str, step: str) -> str:
    return f"list_reduce(list_prepend({first}, {lanes}), lambda acc, l: {step})"


def xxh64(texts: str, seed: int = 42) -> str:
    """Common table expressions that end in hashed(g, h): XXH64 of the UTF-8 of column g of a table."""
    starts = [(seed + P1 + P2) % _ALL, (seed + P2) % _ALL, seed, (seed - P1) % _ALL]
    stripes = [_fold(f"{s}::ubigint", f"list_transform(range((n // 32)::bigint), lambda i: {_lane(f'32 * i + {8 * k}', 8)})", _round("acc", "l")) for k, s in enumerate(starts)]
    joined = _add(_add(_turn("v1", 1), _turn("v2", 7)), _add(_turn("v3", 12), _turn("v4", 18)))
    merges = ", ".join(f"h{k} as (select * exclude (q), case when n < 32 then q else {_merged('q', f'v{k}')} end as q from h{k - 1})" for k in (1, 2, 3, 4))
    eights = _fold("r", f"list_transform(range(((n % 32) // 8)::bigint), lambda i: {_lane('(32 * (n // 32))::bigint + 8 * i', 8)})", _add(_mul(_turn(_xor("acc", _round("0", "l")), 27), P1), P4))
    four = _add(_mul(_turn(_xor("r", _mul(_lane("(8 * (n // 8))::bigint", 4), P1)), 23), P2), P3)
    rest = _fold("r", "b[(4 * (n // 4))::bigint + 1:]", _mul(_turn(_xor("acc", _mul("l", P5)), 11), P1))
    return f"""hx as (select g, hex(encode(g)) as x from {texts}), bt as (select g, (len(x) // 2)::ubigint as n, list_transform(range(len(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::ubigint) as b from hx),
        st as (select *, {", ".join(f"{v} as v{k}" for k, v in enumerate(stripes, 1))} from bt), h0 as (select *, case when n < 32 then {(seed + P5) % _ALL}::ubigint else {joined} end as q from st), {merges},
        t0 as (select g, n, b, {_add("q", "n")} as r from h4), t1 as (select g, n, b, {eights} as r from t0), t2 as (select g, n, b, case when n % 8 >= 4 then {four} else r end as r from t1), t3 as (select g, {rest} as r from t2),
        a1 as (select g, {_mul(_xor("r", "r >> 33"), P2)} as r from t3), a2 as (select g, {_mul(_xor("r", "r >> 29"), P3)} as r from a1), hashed as (select g, {_xor("r", "r >> 32")} as h from a2)"""
