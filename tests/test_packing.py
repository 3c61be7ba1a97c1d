import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, ordering, packing, stats


def model(sizes, limit, pool_size):
    """Windows of example numbers in the order they leave, by the plain rules."""
    pool, out = [], []
    for i, n in enumerate(sizes):
        home = next((w for w in pool if sum(sizes[k] for k in w) + n <= limit), None)
        if home is None:
            if len(pool) == pool_size:
                fullest = max(pool, key=lambda w: sum(sizes[k] for k in w))
                out.append(fullest)
                pool.remove(fullest)
            home = []
            pool.append(home)
        home.append(i)
    return out + pool


def as_windows(placed):
    out = {}
    for i, w, s, _ in placed:
        out.setdefault(w, {})[s] = i
    return [[members[s] for s in sorted(members)] for _, members in sorted(out.items())]


def test_goldens():
    # The published cases of the packing rules.
    assert as_windows(packing.fold(enumerate([6, 5, 2]), 8)) == [[0, 2], [1]]
    assert as_windows(packing.fold(enumerate([3, 4, 4]), 6, 2)) == [[1], [0], [2]]
    with pytest.raises(ValueError):
        list(packing.fold([(0, 9)], 8))
    with pytest.raises(ValueError):
        packing.Packer(8, 0)


def test_against_the_model():
    rnd = random.Random(4)
    for _ in range(200):
        limit, pool = rnd.randint(3, 30), rnd.randint(1, 5)
        sizes = [rnd.randint(1, limit) for _ in range(rnd.randint(0, 60))]
        assert as_windows(packing.fold(enumerate(sizes), limit, pool)) == model(sizes, limit, pool)


def examples(spark, sizes, spans=None):
    rows = [(i, n, [10 * (i + 1) + k for k in range(1, n + 1)], spans[i] if spans else [(0, n)]) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "id long, unpadded_length int, input_ids array<int>, spans array<struct<start:int,end:int>>")


def test_assembled_window(spark):
    df = examples(spark, [3, 4], [[(1, 3)], [(2, 4)]])
    row = packing.assemble(packing.plan(df, 10, id_col="id", order=["id"]), df, 10, id_col="id").first()
    assert row.input_tokens == [11, 12, 13, 21, 22, 23, 24, 0, 0, 0]
    assert row.segment_ids == [1, 1, 1, 2, 2, 2, 2, 0, 0, 0] and row.positions == [0, 1, 2, 0, 1, 2, 3, 0, 0, 0]
    assert row.input_mask == [False, True, True, False, False, True, True, False, False, False]


def test_first_token_of_a_segment_is_not_supervised(spark):
    df = examples(spark, [2, 2])
    row = packing.assemble(packing.plan(df, 8, id_col="id", order=["id"]), df, 8, id_col="id").first()
    assert row.input_mask == [False, True, False, True, *[False] * 4]


def test_ranges_give_the_sequence_of_one():
    """Ranges packed from the pools before them, put together, are one fold over all sizes."""
    rnd = random.Random(11)
    for _ in range(150):
        limit, pool, width = rnd.randint(3, 40), rnd.randint(1, 6), rnd.randint(1, 25)
        sizes = [rnd.randint(1, limit) for _ in range(rnd.randint(1, 90))]
        parts = [sizes[i : i + width] for i in range(0, len(sizes), width)]
        walks, entry = [], []
        for k, part in enumerate(parts):
            packer, placed = packing._walk(part, limit, pool, entry, k == len(parts) - 1)
            walks.append(packing.Walk.of(packer, entry, placed))
            entry = packer.room
        got = []
        for k, (part, facts) in enumerate(zip(parts, packing.chain(walks), strict=True)):
            got += [(k * width + i, *rest) for i, *rest in packing._placements(part, limit, pool, facts, k == len(parts) - 1)]
        assert sorted(got) == sorted(packing.fold(enumerate(sizes), limit, pool))


def test_parallel_plan_is_exact(spark):
    """Any number of ranges: soon equal pools (large sizes) and pools that never meet (small ones)."""
    rnd = random.Random(12)
    for sizes in ([rnd.randint(1, 64) for _ in range(300)], [rnd.randint(1, 3) for _ in range(300)], [5]):
        df = examples(spark, sizes)
        want = sorted(packing.fold(enumerate(sizes), 64, 8))
        for width in (1000, 97, 40):
            got = packing.plan(df, 64, id_col="id", order=["id"], range_rows=width).collect()
            assert sorted((r.id, r.window_id, r.segment, r.offset) for r in got) == want
            assert all(r.length == sizes[r.id] for r in got)


def test_plan_and_shards(spark):
    rnd = random.Random(9)
    sizes = [rnd.randint(1, 40) for _ in range(200)]
    df = examples(spark, sizes)
    got = packing.plan(df, 64, id_col="id", order=["id"]).collect()
    placed = [(r.id, r.window_id, r.segment, r.offset) for r in got]
    assert as_windows(placed) == model(sizes, 64, 8)
    sharded = packing.plan(df, 64, id_col="id", order=["id"], shards=3).collect()
    assert sorted(r.id for r in sharded) == list(range(200))
    windows = sorted({r.window_id for r in sharded})
    assert windows == list(range(len(windows)))
    assert max(sum(r.length for r in sharded if r.window_id == w) for w in windows) <= 64
    fill = stats.fill(packing.plan(df, 64, id_col="id", order=["id"]), 64).first()
    assert fill.examples == 200 and fill.tokens == sum(sizes)


def test_batches(spark):
    df = examples(spark, [8, 8, 8])
    windows = packing.assemble(packing.plan(df, 8, id_col="id", order=["id"]), df, 8, id_col="id")
    got = packing.batches(windows, 2).orderBy("window_id").collect()
    assert [(r.window_id, r.batch_id) for r in got] == [(0, 0), (1, 0)]


def test_orders(spark):
    df = spark.range(1000).toDF("id")
    train, held = ordering.split(df, 0.1, "id", eval_cap=16)
    assert (train.count(), held.count()) == (900, 16)
    assert not set(r.id for r in train.collect()) & set(r.id for r in held.collect())
    assert ordering.split(df, 0.0, "id")[1] is None
    assert ordering.first_n(df, 0, "id").count() == 0 and ordering.first_n(df, None, "id").count() == 1000
    small = ordering.split(spark.range(13).toDF("id"), 4 / 13, "id", eval_cap=64)
    assert small[1].count() == 4
    places = [r.position for r in ordering.numbered(ordering.shuffled(df, "id"), ["order_key", "id"]).collect()]
    assert sorted(places) == list(range(1000))
    again = [r.id for r in ordering.shuffled(df.repartition(7), "id").orderBy("order_key", "id").collect()]
    assert again == [r.id for r in ordering.shuffled(df, "id").orderBy("order_key", "id").collect()] != sorted(again)
    assert ordering.numbered(df.limit(0), ["id"]).count() == 0
    assert ordering.batched(df, 300, ["id"]).groupBy("batch_id").count().orderBy("batch_id").collect()[-1] == (2, 300)


def test_large_first_n_and_split(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("id"), F.lit("x").alias("y")).repartition(5)
    assert sorted(r.id for r in ordering.first_n(df, 345, "id").collect()) == list(range(345))
    assert ordering.first_n(df, 5000, "id").count() == 2000
    plan = ordering.first_n(df, 345, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")
    train, held = ordering.split(df, 0.25, "id", 3, 100)
    assert (train.count(), held.count()) == (1500, 100) and train.columns == held.columns == ["id", "y"]
    least = sorted(range(2000), key=lambda i: (int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:8], 16), i))
    assert {r.id for r in held.collect()} == set(least[:100]) and {r.id for r in train.collect()} == set(least[500:])
    odd = spark.createDataFrame([(None,), (3,), (1,)], "id long")
    assert [r.id for r in ordering.first_n(odd.union(spark.range(10, 30).toDF("id")), 11, "id").orderBy("id").collect()][:3] == [None, 1, 3]


def test_reader(spark):
    df = examples(spark, [8] * 7)
    windows = packing.batches(packing.assemble(packing.plan(df, 8, id_col="id", order=["id"]), df, 8, id_col="id"), 3)
    reader = packing.BatchReader(windows)
    first, again = list(reader), list(reader)
    assert len(first) == 2 and first[0]["input_tokens"].shape == (3, 8) and first[1]["input_mask"].dtype == bool
    assert all((x[f] == y[f]).all() for x, y in zip(first, again, strict=True) for f in packing.FIELDS)
    assert first[0]["input_tokens"][:, 0].tolist() == [11, 21, 31]


def test_unpacked_inputs(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 0], [False, True, True, False, False]), ([5, 6], [False, False])], "input_tokens array<int>, input_mask array<boolean>")
    got = geometry.model_inputs(df).select("last_target", "positions").collect()
    assert [(r.last_target, r.positions) for r in got] == [(2, [0, 1, 2, 2, 2]), (-1, [0, 0])]


def test_geometry(spark):
    df = spark.createDataFrame([([5, 6, 7, 0], [False, True, True, False], [1, 1, 2, 0]), ([5, 6, 0, 0], [False] * 4, [1, 1, 0, 0])], "t array<int>, m array<boolean>, s array<int>")
    got = df.select(geometry.next_tokens("t").alias("n"), geometry.last_target("m").alias("l"), geometry.supervised_targets("m").alias("c"), geometry.attends("s", F.lit(1), F.lit(0)).alias("a"), geometry.attends("s", F.lit(2), F.lit(1)).alias("b")).collect()
    assert [r.l for r in got] == [2, -1] and [r.c for r in got] == [2, 0] and got[0].n == [6, 7, 0]
    assert got[0].a and not got[0].b


def test_positions_of_many_rows(spark):
    n = 600_000
    df = spark.range(n).select(F.xxhash64("id").alias("k")).repartition(23)
    got = ordering.numbered(df, ["k"])
    w = got.selectExpr("count(*) n", "count(distinct position) d", "min(position) a", "max(position) b").first()
    assert (w.n, w.d, w.a, w.b) == (n, n, 0, n - 1)
    later = got.select("k", (F.col("position") + 1).alias("position"))
    assert got.withColumnRenamed("k", "next").join(later, "position").where("next <= k").count() == 0


def test_batches_of_rows_with_equal_keys(spark):
    df = spark.createDataFrame([(i // 3 if i < 9 else None, f"r{i}") for i in range(11)], "k int, v string").repartition(3)
    got = ordering.batched(df, 2, ["k"]).collect()
    assert sorted(r.position for r in got) == list(range(10)) and len({r.v for r in got}) == 10
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == [None, None, 0, 0, 0, 1, 1, 1, 2, 2]


def test_ranks_read_side_by_side(spark, tmp_path):
    """All ranks in turn give one reader's sequence, on every pass and from any batch on."""
    rnd = random.Random(6)
    df = examples(spark, [rnd.randint(1, 16) for _ in range(120)])
    batched = packing.batches(packing.assemble(packing.plan(df, 16, id_col="id", order=["id"]), df, 16, id_col="id"), 3)
    whole = [{f: v.tolist() for f, v in b.items()} for b in packing.BatchReader(batched)]
    for ranks in (1, 3):
        path = str(tmp_path / f"r{ranks}")
        packing.write_ranks(batched, path, ranks, file_batches=4)
        for rank in range(ranks):
            for start in (0, 1, 4, 5, 100):
                reader = packing.RankReader(path, rank, start)
                want = whole[rank::ranks][start:]
                for _ in range(2):
                    got = list(reader)
                    assert len(reader) == len(got) and [{f: v.tolist() for f, v in b.items()} for b in got] == want
        assert got == [] or got[0]["input_mask"].dtype == bool
    packing.write_ranks(batched.limit(0), str(tmp_path / "none"), 2)
    assert list(packing.RankReader(str(tmp_path / "none"), 1)) == []


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation_without_a_sort(spark, n):
    df = spark.range(n).select("id", ordering.permuted(F.col("id"), n, 5).alias("x"), ordering.permuted(F.col("id"), n, 6).alias("y"))
    df = df.withColumn("back", ordering.permuted(F.col("x"), n, 5, back=True))
    got = df.collect()
    assert sorted(r.x for r in got) == sorted(r.y for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    if n == 1000:
        assert sum(r.x == r.id for r in got) < 10 and sum(r.x == r.y for r in got) < 10
        # Neighbours go apart: a third of the range on average.
        x = [r.x for r in sorted(got)]
        assert 280 < sum(abs(a - b) for a, b in zip(x, x[1:], strict=False)) / 999 < 390
