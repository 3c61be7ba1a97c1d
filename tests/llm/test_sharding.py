"""Shuffles into shards: exact sizes, every row once, and the laws that the draws must follow."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def test_draws_follow_the_law():
    rng = np.random.default_rng(5)
    totals, take = np.array([7, 0, 20, 3, 11]), 17
    drawn = np.array([sharding.split(rng, totals, take) for _ in range(20_000)])
    assert (drawn.sum(1) == take).all() and (drawn <= totals).all()
    # Mean and covariance of draws without replacement.
    n, share = totals.sum(), totals / totals.sum()
    law = take * (n - take) / (n - 1) * (np.diag(share) - np.outer(share, share))
    assert np.abs(drawn.mean(0) - take * share).max() < 0.05
    assert np.abs(np.cov(drawn.T) - law).max() < 0.1


def test_inversion_agrees_with_the_library():
    rng = np.random.default_rng(6)
    for good, bad, take in ((50, 70, 40), (3, 400, 5), (1, 0, 1), (0, 9, 4), (9, 0, 4), (1000, 1000, 1999)):
        own = np.array([sharding._large_draw(rng, good, bad, take) for _ in range(6000)])
        other = rng.hypergeometric(good, bad, take, 6000)
        assert own.min() >= max(0, take - bad) and own.max() <= min(good, take)
        spread = max(other.std(), 0.05)
        assert abs(own.mean() - other.mean()) < 0.1 * spread and abs(own.std() - other.std()) < 0.1 * spread


def test_populations_beyond_the_library():
    rng = np.random.default_rng(7)
    totals = np.full(24, 5 * 10**9)
    drawn = sharding.split(rng, totals, 24 * 10**9)
    assert drawn.sum() == 24 * 10**9 and (np.abs(drawn - 10**9) < 8 * (10**9 * 0.8) ** 0.5).all()


@pytest.mark.parametrize("parts", [[5], [3, 0, 9, 1], [100, 40, 7, 33, 21, 8, 64]])
def test_matrix_lines_add_up(parts):
    _, _, cells = sharding.cells_of(sum(parts), 4, 9)
    matrix = sharding.Matrix(3, np.array(parts), cells)
    lines = [matrix.line(p) for p in range(len(parts))]
    assert [int(x.sum()) for x in lines] == parts and (sum(lines) == cells).all() and all((x >= 0).all() for x in lines)
    # Lines do not depend on which were asked for before.
    assert all((sharding.Matrix(3, np.array(parts), cells).line(p) == lines[p]).all() for p in reversed(range(len(parts))))


def test_cells():
    owners, firsts, sizes = sharding.cells_of(101, 4, 8)
    assert sizes.sum() == 101 and sizes.max() <= 8
    for shard, size in enumerate(sharding.even(101, 4)):
        here = owners == shard
        assert sizes[here].sum() == size and (firsts[here] == np.cumsum(sizes[here]) - sizes[here]).all()
    assert sharding.cells_of(2, 4, 8)[2].tolist() == [1, 1, 0, 0]


def whole(got, n, shards):
    assert len(got) == n
    sizes = [len([r for r in got if r.shard == s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_query(spark):
    got = queries.queries()["op11_sharding"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole(got, len(docs), 24)
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    again = queries.queries()["op11_sharding"](spark, SF).collect()
    assert sorted(again) == sorted(got)


def test_small_parts_and_cells_are_uniform(spark):
    """One row's place over many seeds: each shard and slot equally often; parts and cells far smaller than the input."""
    frame = spark.range(0, 30, 1, 3).toDF("doc_id")
    seen = np.zeros((3, 10))
    for seed in range(12):
        got = sharding.deal(frame, 3, seed=seed, part_rows=4, cell_rows=3).select("row.doc_id", "shard", "slot").collect()
        whole(got, 30, 3)
        for r in got:
            if r.doc_id < 10:
                seen[r.shard, r.slot] += 1
    # 120 placements over 30 places: 4 each.
    assert ((seen - 4) ** 2 / 4).sum() < 60


def test_odd_input(spark):
    rows = [(None, None, "a"), (None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "é" * 200_000, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    names = ["row", "shard", "slot", "cell", "_at", "_of", "_block", "_place", "_part", "_first", "_in"]
    for n in names:
        odd = odd.withColumn(n, odd["`odd.name`"])
    got = sharding.digest(odd, 3).collect()
    whole(got, 5, 3)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got)[:4] == [(0, 8, 0), (0, 8, 0), (1, 8, 0), (1, 8, 0)]
    assert max(r["size"] for r in got) == 400_008
    back = sharding.deal(odd, 2).select("row.*")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, odd.collect()))
    assert sharding.digest(odd.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    frame = spark.range(0, 50, 1, 4).withColumn("text", F.lit("t"))
    sharding.write(frame, str(tmp_path / "out"), 4, cell_rows=5)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole(got.collect(), 50, 4)
    assert sorted(r.id for r in got.collect()) == list(range(50))
