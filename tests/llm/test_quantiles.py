"""Quantile summaries: weights and bounds that always hold, ranks within their error, reports against plain counts."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import queries, quantiles

SF = "/root/testdata/sf0.01"


def weight(s):
    return sum(n << h for h, n in enumerate(s.counts))


@pytest.mark.parametrize("n,chunk", [(10, 3), (300, 300), (5_000, 64), (200_000, 10_000)])
def test_weight_size_and_rank(n, chunk):
    rng = np.random.default_rng(n)
    x = np.floor(rng.lognormal(5, 2, n)).astype(np.int64)
    s = quantiles.Summary(7)
    for part in np.array_split(x, -(-n // chunk)):
        s.insert(np.sort(part), np.ones(len(part), np.int64))
    assert weight(s) == n and min(10, len(np.unique(x))) <= sum(s.counts) <= min(n, 1000)
    assert set(s.written()[0].tolist()) <= set(x.tolist())
    targets = [math.ceil(i * n / 16) for i in range(1, 16)]
    got = s.answers(targets)
    assert got == sorted(got)
    for t, a in zip(targets, got, strict=True):
        assert max(0, (x < a).sum() + 1 - t, t - (x <= a).sum()) <= 0.015 * n
    if n <= quantiles.K:
        assert got == np.sort(x)[np.array(targets) - 1].tolist()


def test_spread_of_errors():
    """The standard deviation of a rank over many coins, for values and for values that stand for many rows."""
    n, x = 20_000, np.arange(20_000)
    times = np.where(x % 50 == 0, 1000, 1)
    for weights in (np.ones(n, np.int64), times):
        total, errors = int(weights.sum()), []
        ends = np.cumsum(weights)
        for seed in range(60):
            s = quantiles.Summary(seed)
            for low in range(0, n, 1000):
                s.insert(x[low : low + 1000], weights[low : low + 1000])
            assert weight(s) == total
            (a,) = s.answers([total // 2])
            errors.append((ends[a] - total // 2) / total)
        assert np.std(errors) < 0.005 and abs(np.mean(errors)) < 0.004


def test_merges():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 10**6, 100_000)
    whole = quantiles.Summary(1)
    for i, part in enumerate(np.array_split(x, 70)):
        one = quantiles.Summary(100 + i)
        one.insert(np.sort(part), np.ones(len(part), np.int64))
        items, sizes = one.written()
        whole.merge(quantiles.Summary(0, items, sizes))
    assert weight(whole) == len(x) and sum(whole.counts) <= 1000
    for t, a in zip([25_000, 50_000, 75_000], whole.answers([25_000, 50_000, 75_000]), strict=True):
        assert abs((x <= a).sum() - t) < 0.015 * len(x)


def test_capacities_fit():
    assert all(sum(quantiles.capacity(n)) <= 1000 for n in range(1, 63))


def plain(clicks, lines, items):
    """All values of every summary, row by row."""
    values, seen = defaultdict(list), set()
    for r in sorted(clicks, key=lambda r: (r.arrived_at is not None, r.arrived_at)):
        if r.click_id in seen:
            continue
        seen.add(r.click_id)
        if r.client_id is not None and r.value is not None and math.isfinite(r.value):
            b = zlib.crc32(str(r.click_id).encode()) % 4
            values["value", str(r.client_id), b].append(math.floor(100 * r.value + 0.5) + 1000 * b)
    of = {r.item_id: r for r in items}
    for r in lines:
        item = of.get(r.item_id)
        if item and item.brand is not None and item.price is not None:
            b = zlib.crc32(("" if r.vendor_id is None else str(r.vendor_id)).encode()) % 4
            values["price", item.brand, b].append(math.floor(100 * item.price + 0.5) + 1000 * b)
    for (stream, grp, b), x in list(values.items()):
        values[stream, grp, -1] += x
    return {k: np.sort(x) for k, x in values.items() if len(x) >= 20}


def holds(got, values):
    assert {(r.stream, r.grp, r.batch) for r in got} == set(values) and len(got) == 3 * len(values)
    for r in got:
        x = values[r.stream, r.grp, r.batch]
        t = -(-r.i * len(x) // 4)
        below, upto = (x < r.answer).sum(), (x <= r.answer).sum()
        error = max(0, below + 1 - t, t - upto)
        assert (r.n, r.target, r.exact_x, r.n_below, r.n_upto, r.rank_error) == (len(x), t, x[t - 1], below, upto, error)
        assert r.within is True and 1000 * error <= 20 * len(x)
        assert min(10, len(np.unique(x))) <= r.points <= min(len(x), 1000) and x[0] <= r.answer <= x[-1]


def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("clicks", "sale_lines", "items")]


def test_query(spark):
    got = queries.queries()["op13_quantiles"](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    assert kinds["batch"] == kinds["i"] == "int" and kinds["within"] == "boolean"
    assert {kinds[c] for c in ("n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error")} == {"bigint"}
    rows = got.collect()
    holds(rows, plain(*[t.collect() for t in tables(spark)]))
    assert any(r.points < r.n for r in rows)


def test_many_lots(spark):
    """Small lots and a small fan-in: several rounds of merges give the same weights and ranks within the bound."""
    counts = quantiles.count_values(quantiles.shop_rows(*tables(spark))).cache()
    out = quantiles.summarise(counts, lot_values=20, fan_in=3)
    totals = {tuple(r)[:3]: r[3] for r in counts.groupBy(*quantiles.KEY).sum("n").collect()}
    found = {(r.stream, r.grp, r.batch): quantiles.Summary(0, r["items"], r["sizes"]) for r in out.collect()}
    assert {k: weight(s) for k, s in found.items()} == totals
    report = quantiles.report(counts, out).collect()
    holds(report, {k: v for k, v in plain(*[t.collect() for t in tables(spark)]).items() if k[2] >= 0})
    counts.unpersist()


def test_odd_input(spark):
    schema = "stream string, grp string, batch int, money double, times long"
    assert quantiles.audit(spark.createDataFrame([], schema)).collect() == []
    rows = [("s", "a", 0, float(i % 5), 1) for i in range(30)] + [("s", "a", 1, m, 1) for m in (None, float("nan"), float("inf"), -float("inf"), 1e300, -1e300)]
    rows += [("s", None, 0, 1.0, 1)] * 25 + [("s", "few", 0, 1.0, 1)] * 19 + [("s", "", 2, 7.25, 2)] * 10 + [("s", "hot", 3, 2.5, 10**12)]
    got = quantiles.audit(spark.createDataFrame(rows, schema)).collect()
    n = {(r.grp, r.batch): r.n for r in got}
    assert n == {("a", 0): 30, ("a", -1): 32, ("", 2): 20, ("", -1): 20, ("hot", 3): 10**12, ("hot", -1): 10**12}
    assert all(r.within for r in got)
    assert {(r.answer, r.exact_x) for r in got if r.grp == "hot"} == {(3250, 3250)} and {r.answer for r in got if r.grp == ""} == {2725}
