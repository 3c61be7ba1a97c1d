"""Operators in DataFrame functions only."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, pii

DOCS = "doc_id long, text string, source string"


def docs(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind).repartition(3)


PARTS = [
    "1", "2", "0", "9", "25", ".", "-", " ", "(", ")", "+", "@", "a", "Z", "é", "😀", "_", "%", "4111 1111 1111 1111", "1.2.3.4", "a@b.c",
    "+1 (555) 123-4567", "DE89370400440532013000", "\n", "ssn 123-45-6789", "000", "255", "call 030 1234567",
]


def test_pii_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))), "s") for i in range(600)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "1" * 5000, "s"), (903, "a" * 50000, "s"), (904, "1 " * 3000, "s"), (905, "a@b.c_d@e.f a@b@c.d", "s"), (1, rows[1][1], "s")]
    got = pii.digest(pii.find(docs(spark, rows).withColumn("spans", F.lit(1)).withColumn("_text", F.lit("x")))).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = brute.pii(texts[r.doc_id])
        assert all(r[k] == want[k] for k in want if k != "base"), texts[r.doc_id]
        assert set(filter(None, want["base"].split(","))) <= set(r.spans.split(","))


def test_pii_cards_of_parted_digits(spark):
    texts = [" ".join("4111111111111111"), "-".join("4111111111111111"), " ".join("0" * 12), "no card: 1 2 3", "x " + "- ".join("4111111111111111")]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs(spark, rows))).collect()}
    assert [got[i].n_card for i in range(5)] == [1, 1, 1, 0, 0]
    for i, t, _ in rows:
        want = brute.pii(t)
        assert all(got[i][k] == want[k] for k in want if k != "base"), t


def test_pii_more_kinds(spark):
    rows = [(1, "IBAN DE89370400440532013000, wrong DE89370400440532013001", "s"), (2, "ssn 123-45-6789 and part 987-65-4321", "s"), (3, "call 030 1234567 now", "s"), (4, "order 030 1234567 now", "s")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(docs(spark, rows))).collect()}
    assert "iban:5:27" in got[1] and "iban:35" not in got[1]
    assert got[2] == "ssn:4:15" and "tel" in got[3] and "tel" not in got[4]


def test_redaction(spark):
    df = docs(spark, [(1, "write é a@b.co or 1.2.3.4!", "s"), (2, None, "s"), (3, "clean", "s")])
    got = {r.doc_id: r.text for r in pii.redact(df, pii.find(df)).collect()}
    assert got == {1: "write é [EMAIL] or [IP]!", 2: None, 3: "clean"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.digest(pii.find(none)).count() == 0
    assert mixing.mix(none).count() == 0
    assert line_dedup.remove_repeats(none).count() == 0


def fill(sizes: dict, repeats: int = 3) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > repeats * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "Z", "é", "c", None, "tiny", "none"]
    rows = [(i, " ".join(["w"] * rnd.randint(0, 400)), rnd.choices(names[:6], [30, 5, 2, 1, 1, 1])[0]) for i in range(600)]
    rows += [(700, "only three words", "tiny"), (701, None, "none"), (702, "x", None), (702, "x", None)]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix(df, shard_words=4000).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = fill(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 + 0.02 * want[s], s
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(5), shard_words=4000).collect())


def test_sainte_lague_seats(spark):
    rnd = random.Random(5)
    groups = {g: [rnd.randint(0, 1000) for _ in range(rnd.randint(1, 12))] for g in range(8)}
    seats = {g: rnd.randint(0, 60) if sum(v) else 0 for g, v in groups.items()}
    rows = [(g, k, v, seats[g]) for g, vs in groups.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g long, k long, v long, s long")
    got = {(r.g, r.k): r.seats for r in mixing.sainte_lague(df, ["g"], "k", "v", "s").collect()}
    for g, vs in groups.items():
        best = sorted(((-v / (2 * n - 1), k, n) for k, v in enumerate(vs) if v for n in range(1, seats[g] + 1)))[: seats[g]]
        for k in range(len(vs)):
            assert got[g, k] == sum(x[1] == k for x in best)


def line_corpus(seed):
    rnd = random.Random(seed)
    shared = [[f"line {j} {k} of passage" for k in range(6)] for j in range(5)]
    out = []
    for i in range(150):
        lines = [f"own {i} {k}" for k in range(rnd.randint(0, 5))]
        for p in rnd.sample(shared, rnd.randint(0, 3)):
            at = rnd.randint(0, len(lines))
            lines[at:at] = p
        out.append((i, "\n".join(lines)))
    return out + [(200, None), (201, ""), (202, "\n\n"), (203, "a\n\nb"), (204, out[7][1]), (205, out[7][1]), (206, "one line")]


def test_line_dedup(spark):
    rows = line_corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("_key", F.lit("clash"))
    want = brute.line_dedup(rows)
    kept = line_dedup.remove_repeats(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect()} == want
    every = {r.doc_id: r.text for r in line_dedup.remove_repeats(df, drop_empty=False).collect()}
    assert every == {i: want.get(i, "") for i, _ in rows}


def test_line_runs(spark):
    rows = line_corpus(4) + [(300, "q\nq\nq"), (301, "r\nr\nr\nr"), (302, "s\n\nt"), (303, "own\ns\n\nt\nend"), (304, "s\nt"), (305, "s\n\nt")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("_key", F.lit("clash"))
    want = brute.line_dedup(rows, drop_empty=False)
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(df, drop_empty=False).collect()}
    assert got == want
    assert (want[300], want[301], want[303], want[304], want[305]) == ("q\nq\nq", "r\nr", "own\nend", "s\nt", "")
    kept = {r.doc_id for r in line_dedup.remove_repeats(df).collect()}
    assert {i for i, _ in rows} - kept == {i for i, t in rows if t and "\n" in t and not want[i]}


def test_short_passages_inside_unlike_texts_go(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(999)) for _ in range(n))
    passages = [[text(20) for _ in range(k)] for k in (2, 3, 4, 6, 10) for _ in range(10)]
    rows = []
    for i, p in enumerate(passages * 3):
        rows.append((i, "\n".join([*(text(15) for _ in range(rnd.randint(1, 6))), *p, *(text(15) for _ in range(rnd.randint(1, 6)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.remove_repeats(df).collect()}
    for i, text in rows:
        p = passages[i % len(passages)]
        assert got[i] == (text.split("\n") if i < len(passages) else [x for x in text.split("\n") if x not in p])


def test_line_dedup_repeated_rows(spark):
    rows = [(1, "a b\nc d\ne f"), (1, "a b\nc d\ne f"), (None, "x\ny"), (2, "z")]
    got = sorted(map(repr, line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(got) == 4
