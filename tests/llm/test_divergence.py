"""The source audit against the SQL of its query, on odd tables and with small blocks."""

import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string"


def agrees(spark, rows, **options):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"text": "string", "lang": "string", "source": "string"})
    con = duckdb.connect()
    con.register("documents", documents)
    sql = queries.OP12_SQL
    if "least_docs" in options:
        sql = sql.replace("count(*) >= 10", f"count(*) >= {options['least_docs']}")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"select {', '.join(names)} from ({sql}) z").fetchall()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    assert got.columns == names and [f.dataType.simpleString() for f in got.schema][4:] == ["bigint", "int"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def corpus(n, seed, sources):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60)] + ["Ünï", "Ä", "über", "日本", "Ω"]
    text = lambda: " ".join(rnd.choice(words[: rnd.randint(1, 65)]) + rnd.choice(["", ",", "7x", "\n", " z"]) for _ in range(rnd.randint(0, 40)))
    rows = [(i, text().upper() if i % 7 == 0 else text(), rnd.choice(["en", "de", None]), rnd.choice(sources)) for i in range(n)]
    return rows + [(n, None, "en", "empty"), (n + 1, "", "xx", "one"), (n + 2, "rare", "yy", "a"), (n + 3, "other", "yy", "b"), (n + 3, "other", "yy", "b")]


@pytest.mark.parametrize("least", [1, 10])
def test_against_sql(spark, least):
    want = agrees(spark, corpus(160, 3, ["s1", "s2", "s3", "S", "ä", None, ""]), least_docs=least)
    assert {x[0] for x in want} >= {"en", "de", "", "yy"} and any(x[2] == "term" for x in want)
    assert [x[4] for x in want if x[0] == "yy" and x[2] == "pair"] == [0, 0] or least == 1


def test_many_sources_in_small_blocks(spark, monkeypatch):
    """Blocks of two sources a side, few held and few pairs at once: sums stay the same."""
    rows = corpus(200, 4, [f"s{i}" for i in range(9)])
    whole = [row for row in agrees(spark, rows, least_docs=2) if row[2] == "pair"]
    assert len(whole) > 100
    # The task's own function, over postings made here.
    postings = [("en", t, a, 10 + (t * 7 + a * 3) % 50, 5) for t in range(40) for a in range(t % 9 + 1)]
    import pyarrow as pa

    names = ["lang", "term", "place", "p", "zero"]
    table = pa.table([pa.array([str(x[i]) for x in postings]) if i < 2 else pa.array([x[i] for x in postings], pa.int64()) for i in range(5)], names=names)
    order = table.sort_by([("lang", "ascending"), ("term", "ascending")])

    def sums(size):
        out = {}
        for batch in divergence._both(iter(order.to_batches(max_chunksize=size))):
            for lang, a, b, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out[lang, a, b] = out.get((lang, a, b), 0) + value
        return {k: v for k, v in out.items() if v}

    plain = {}
    for i, x in enumerate(postings):
        for y in postings[i + 1 :]:
            if x[1] == y[1]:
                f = lambda p, q: (p - q) ** 2 // (p + q)
                plain["en", x[2], y[2]] = plain.get(("en", x[2], y[2]), 0) + f(x[3], y[3]) - f(x[3], 5) - f(5, y[3]) + f(5, 5)
    plain = {k: v for k, v in plain.items() if v}
    assert sums(1000) == plain
    for name, value in (("SIDE", 2), ("BLOCKS", 3), ("PAIRS", 4)):
        monkeypatch.setattr(divergence, name, value)
    assert sums(3) == plain == sums(1000)


def test_pairs_of_runs():
    starts = np.array([0, 3, 4, 8])
    got = [(int(a), int(b)) for x, y in divergence._meetings(starts, 9) for a, b in zip(x, y, strict=True)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]


def test_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).collect() == []
    rows = [(None, "same Word " * 50_000, None, None), (None, "same word " * 3, "", "b"), (1, None, "", "b")]
    agrees(spark, rows, least_docs=1)
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = divergence.audit(frame, least_docs=1).collect()
    for name in ("term", "n", "docs", "p", "q", "place", "zero", "value", "item", "part", "a", "b", "total"):
        frame = frame.withColumn(name, frame["text"])
    assert sorted(divergence.audit(frame, least_docs=1).collect()) == sorted(plain)


def test_pairs_cost_little_more_than_their_arithmetic():
    """Finding a pair's block and adding it up took over thirty times the arithmetic itself."""
    import pyarrow as pa

    terms, sources = 4000, 20
    place = np.tile(np.arange(sources), terms)
    p = np.random.default_rng(5).integers(1, 10**7, len(place))
    names = [f"t{i:05d}" for i in range(terms)]
    rows = pa.table({"lang": ["en"] * len(place), "term": np.repeat(names, sources), "place": place, "p": p, "zero": place + 100})
    left, right = (np.concatenate(x) for x in zip(*divergence._meetings(np.arange(0, len(place), sources), len(place)), strict=True))

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    plain = min(seconds(lambda: [divergence._np_f(p[left], p[right]) for _ in range(4)]) for _ in range(3))
    whole = min(seconds(lambda: list(divergence._both(iter(rows.to_batches(max_chunksize=10_000))))) for _ in range(3))
    assert whole < 12 * plain, (whole, plain)


def test_many_blocks_in_a_batch(monkeypatch):
    """Pairs of several languages and blocks at once, the last block of a side not full."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "SIDE", 3)
    rnd = random.Random(6)
    rows = [(lang, t, place, rnd.randint(1, 10**6), place + 7) for lang in ("de", "en") for t in "abcd" for place in rnd.sample(range(11), rnd.randint(1, 11))]
    table = pa.table({n: [x[i] for x in rows] for i, n in enumerate(("lang", "term", "place", "p", "zero"))})
    got, want = {}, {}
    for batch in divergence._both(iter(table.to_batches(max_chunksize=30))):
        for lang, a, b, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[lang, a, b] = got.get((lang, a, b), 0) + value
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[:2] == y[:2]:
                key = (x[0], min(x[2], y[2]), max(x[2], y[2]))
                want[key] = want.get(key, 0) + f(x[3], y[3]) - f(x[3], y[4]) - f(x[4], y[3]) + f(x[4], y[4])
    assert got == {k: v for k, v in want.items() if v}


def test_groups_are_counted_one_after_the_other(spark):
    plan = divergence.index(spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow.*\n\s*\+- Sort \[lang#\d+ ASC NULLS FIRST, source#\d+ ASC NULLS FIRST\], false", plan), plan
