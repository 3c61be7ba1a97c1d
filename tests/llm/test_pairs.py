"""Near-duplicates, repeated bytes and benchmark items against all pairs."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, near_dup, repeats, sketch
from tessera.llm import bytescan as b


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.05 else w for w in words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "é ß"), (906, rows[3][1])]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components(spark, k, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "WIDE_BLOCK", 16)
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("bucket", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.label(df, k=k, percent=percent).collect()}
    assert got == brute.near_dups(rows, k, percent)


def test_keep_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.keep(df).collect()) == [1, 3, 3]
    assert near_dup.label(df.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(1)
    t = 4096
    for share in (0.2, 0.5, 0.85):
        common = rnd.integers(0, 2**63, int(300 * share), dtype=np.uint64)
        one, two = (np.concatenate([common, rnd.integers(0, 2**63, 300 - len(common), dtype=np.uint64)]) for _ in range(2))
        values = sketch.sketches(np.concatenate([one, two]), np.array([0, 300, 600]), t)
        want = len(common) / (600 - len(common))
        assert abs((values[0] == values[1]).mean() - want) < 0.04
    assert not (sketch.sketches(one[:1], np.array([0, 1]), 64) == ~np.uint64(0)).any()


def test_banding_reaches_its_recall():
    for s in (0.5, 0.8, 0.85, 0.95):
        plan = sketch.banding(s)
        assert 1 - (1 - s**plan.rows) ** plan.bands >= sketch.RECALL


def test_blocks_of_links():
    rnd = random.Random(2)
    base = [rnd.getrandbits(60) for _ in range(40)]
    sets = [np.array(sorted(set(rnd.sample(base, 36) + [rnd.getrandbits(60) for _ in range(rnd.randint(0, 4))])), dtype=np.uint64) for _ in range(40)]
    labels = np.arange(40) % 30
    got = {tuple(p) for p in near_dup._links(np.arange(20), np.arange(20, 40), sets, labels, 85)}
    want = set()
    for i in range(20):
        for j in range(20, 40):
            same = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if labels[i] != labels[j] and 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same):
                want.add((i, j))
    assert got == want and want


def byte_corpus(seed):
    rnd = random.Random(seed)
    text = lambda n, al="abcdefgh ": "".join(rnd.choice(al) for _ in range(n))
    shared = [text(n) for n in (399, 400, 401, 650, 1200)]
    rows = [(i, text(rnd.randint(0, 600)) + rnd.choice(shared)[rnd.randint(0, 3) :] + text(rnd.randint(0, 300))) for i in range(40)]
    near = text(2500)
    for i in range(50, 58):
        cut = rnd.randrange(2400)
        rows.append((i, near[:cut] + "Z" + near[cut + 1 :]))
    return rows + [(100, None), (101, ""), (102, "x" * 399), (103, "x" * 400), (104, "y" * 1000), (105, "abc" * 300), (106, "é" * 300), (107, "é" * 199 + "qq"), (108, rows[0][1]), (109, near[300:1100])]


def test_repeats(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_STARTS", 700)
    rows = byte_corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"mark": F.lit("clash"), "core": F.lit(1)})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(repeats.remove(df)).collect()}
    assert got == brute.repeats(rows)


def test_repeated_passages(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_STARTS", 50)
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice("a b c dd ee é 日本 x-y".split()) for _ in range(n))
    shared = [text(n) for n in (50, 51, 52, 60, 130)]
    rows = [(i, f"{text(rnd.randint(1, 80))}{rnd.choice(' ' + chr(9) + chr(10))}{rnd.choice(shared)}\n{text(rnd.randint(1, 80))}") for i in range(60)]
    rows += [(70, None), (71, ""), (72, text(50)), (73, "z " * 120), (74, f"{shared[1]} {text(9)} {shared[4]}"), (75, rows[0][1]), (76, " ".join(shared[4].split()[3:99]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.digest(repeats.remove(df)).collect()
    assert {r.doc_id: r.n_passages for r in got} == brute.passages(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(rows)


def test_repeats_in_a_text_of_several_scan_blocks(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(2_300_000))
    rows = [(1, long[:1_200_000] + long[500:1000] + long[1_200_000:]), (2, long[2_100_000:2_100_450]), (3, "plain")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.digest(repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: (500 + 500 + 450, 3), 2: (450, 1), 3: (0, 0)}


def test_hot_keys_are_matched_like_others(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    rows = spark.createDataFrame([(i % 7 if i < 300 else 1, i) for i in range(900)], "k int, i int")
    counts = rows.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 42")
    for how in ("inner", "left_semi"):
        got = repeats._with_keys(rows, counts, {"k": "key"}, how)
        assert got.columns == ["k", "i"] and got.count() == 643 + 5 * 43


def test_repeats_of_equal_rows(spark):
    text = "".join(random.Random(1).choice("abc ") for _ in range(500))
    df = spark.createDataFrame([(1, text), (1, text), (None, "short")], "doc_id long, text string")
    got = repeats.digest(repeats.remove(df)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(5, 0), (500, 500), (500, 500)]
    assert repeats.remove(df.limit(0)).count() == 0


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1]))
        row = new
    return min(row)


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(200):
        p, t = ([rnd.randint(0, 3) for _ in range(rnd.randint(a, 80))] for a in (1, 0))
        assert decontam.distance(np.array(p), np.array(t)) == plain_distance(p, t)


def test_decontamination(spark):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "eo", "ui", "on", "ar", "il")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 50))).capitalize() + ".") for i in range(20)] + [(90, None), (91, ""), (92, "a b")]
    filler = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows, held, edited = [], set(), set()
    for i in range(60):
        text = filler(80)
        if i % 3:
            item, said = items[i % 20]
            w = said.split()
            if i % 3 == 2:
                for _ in range(max(1, len(w) // 10)):
                    w[rnd.randrange(len(w))] = "changed"
                edited.add((i, item))
            else:
                held.add((i, item))
            text += " " + " ".join(w).upper() + "!! " + filler(60)
        rows.append((i, text))
    rows += [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find(df, bench).collect()}
    assert held <= set(got) and all(got[k] == 0 for k in held)
    assert len(edited & set(got)) >= 0.95 * len(edited) and set(got) <= held | edited
    kept = {r.doc_id for r in decontam.keep(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.find(df.limit(0), bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0


def test_decontamination_against_a_search_of_all_places(spark):
    rnd = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, draw(rnd.choice([5, 9, 12, 15, 22]))) for i in range(12)]
    rows = []
    for i in range(90):
        w = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, decontam.max_edits(len(w)) + 1)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice([[], draw(1)])
        rows.append((i, draw(rnd.randint(0, 25)) + w + draw(rnd.randint(0, 25))))
    want = {(i, k): plain_distance(item, text) for i, text in rows for k, item in items if plain_distance(item, text) <= decontam.max_edits(len(item))}
    frame = lambda r, name: spark.createDataFrame([(i, " ".join(w)) for i, w in r], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find(frame(rows, "doc_id"), frame(items, "item_id")).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(want) > 60 and len(got) >= decontam.RECALL * len(want) - 1


def test_walks_follow_the_target():
    sizes = sorted({decontam.class_of(n) for n in range(decontam.Q, 2 * decontam.PIECE)})
    found = {s: decontam.walks(s) for s in sizes}
    assert all(1 <= n < decontam._MOST_WALKS for n in found.values()) and max(found.values()) > 4


def test_rows_without_an_id_are_decontaminated(spark, monkeypatch):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "red orange yellow green blue indigo violet black white grey")]
    rows = [(None, f"so {items[0][1]} it goes", "x"), (None, "nothing of the kind", "y"), (7, f"and {items[1][1]}", "z"), (8, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.BLOCK_ITEMS, 1):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", size)
        assert {r.doc_id for r in decontam.find(df, bench).collect()} == {None, 7}
        kept = decontam.keep(df, bench)
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[3]], key=repr)
    assert decontam.keep(df, bench.limit(0)).count() == 4


def test_a_benchmark_of_any_size_gives_what_one_block_gives(spark, monkeypatch):
    """Joins and the block agree: items that share pieces, long ones across segments, repeated rows and items, edits, odd rows."""
    rnd = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    template = draw(9)
    items = [template + draw(rnd.choice([3, 12, 30])) for _ in range(30)] + [draw(rnd.choice([5, 8, 40, 300])) for _ in range(30)]
    rows = []
    for i in range(120):
        w = list(rnd.choice(items))
        for _ in range(rnd.randint(0, decontam.max_edits(len(w)) + 1)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice([[], draw(1)])
        rows.append((i, " ".join(draw(rnd.randint(0, 60)) + w + draw(rnd.randint(0, 60)))))
    # One row that holds every item, over several segments; one that holds a piece thousands of times.
    rows += [(200, " ".join(" ".join(w + draw(20)) for w in items)), (201, " ".join(template * 700))]
    rows += [rows[0], (None, rows[1][1]), (300, None), (301, ""), (302, "one")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"held": F.lit("clash"), "row": F.lit(1)}).repartition(5)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(77, " ".join(items[0])), (90, None), (91, "a b")], "item_id short, text string")
    found = lambda: sorted(map(tuple, decontam.find(df, bench).collect()), key=repr)
    one, left = found(), sorted(map(tuple, decontam.keep(df, bench).collect()), key=repr)
    schema = decontam.find(df, bench).schema
    monkeypatch.setattr(decontam, "SEGMENT", 64)
    monkeypatch.setattr(decontam, "_LOT", 1000)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    assert decontam._block(bench, "item_id", "text") is None
    assert found() == one and len(one) > 150 and {i for d, i, *_ in one if d == 200} == {*range(60), 77}
    kept = decontam.keep(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == left
    assert [(f.name, f.dataType) for f in decontam.find(df, bench).schema] == [(f.name, f.dataType) for f in schema]
    assert decontam.find(df.limit(0), bench).count() == 0 and decontam.keep(df.limit(0), bench).count() == 0
    few = bench.where("item_id > 89")
    assert decontam.find(df, few).count() == 0 and decontam.keep(df, few).count() == len(rows)


@pytest.mark.parametrize("n", [10, 15, 20, 30, 50, 80, 150, 300])
@pytest.mark.parametrize("even", [False, True])
def test_recall_at_the_most_edits(n, even):
    rng = np.random.default_rng([n, even])
    words, count = rng.integers(1, 1 << 62, 3000).astype(np.uint64), 200 if n > 15 else 500
    items = [rng.choice(words, n) for _ in range(count)]
    e, texts = decontam.max_edits(n), []
    for item in items:
        w = item.tolist()
        # Anywhere, or one in each share of the item, so that every piece has as many edits as it can.
        for i in sorted((int(k * n / e + rng.integers(0, n // e)) for k in range(e)) if even else rng.choice(n, e, replace=False), reverse=True):
            kind = rng.choice(["replace", "delete", "insert"])
            w[i : i + (kind != "insert")] = [] if kind == "delete" else [int(rng.integers(1, 1 << 62))]
        texts += [rng.choice(words, 40), np.array(w, dtype=np.uint64), rng.choice(words, 40)]
    first = np.concatenate([[0], np.cumsum([sum(map(len, texts[i : i + 3])) for i in range(0, len(texts), 3)])])
    got = {(r, i) for r, i, _ in decontam.Items(list(range(count)), items).prepare().search(np.concatenate(texts), first)}
    assert sum((i, i) in got for i in range(count)) >= decontam.RECALL * count


def test_hashes_do_not_depend_on_place():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 123, 5000).astype(np.uint8)
    data[4000:4100] = data[100:200]
    h = b.hashes(data, np.array([100, 4000, 4001]), np.array([200, 4100, 4100]))
    assert h[0] == h[1] != h[2]
    assert b._long_hash(data) == b.hashes(data, np.array([0]), np.array([5000]))[0]
