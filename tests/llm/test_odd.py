"""Odd input: clashing columns, empty tables, very long texts, repeated rows, null ids."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import bytescan as b
from tessera.llm import decontam, line_dedup, near_dup, pii, quality, repeats, scratch, toxicity

SF = "/root/testdata/sf0.001"
# Names that the operators use inside.
NAMES = (
    "_key _k _i _later _gone _text _held _id _spans _kept _lines _done _n _h _s _salt _parts _hot _hash _hashes _starts _first row rep mark "
    "core outer bucket size least u v node root n fp1 fp2 bands spans passages score held part label x odd.name _kind _size"
).split()


def corpus(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice("all good things come in small rounds of red wine".split()) + str(rnd.randint(0, 30)) for _ in range(n))
    shared, near = f"{text(9)}\n{text(9)}\n{text(8)}", text(40)
    rows = [(i, f"{text(30)}\n{shared}\n{text(20)}" if i % 3 else text(50)) for i in range(30)]
    rows += [(100, near), (101, near + " more"), (102, near), (103, f"write to a.b{103}@example.org or 192.168.0.{7}"), (104, None), (105, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in NAMES])
    return plain, more


def extra_is_unchanged(frame):
    rows = frame.collect()
    assert frame.columns == ["doc_id", "text", *NAMES]
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in NAMES)
    return {r.doc_id: r.text for r in rows}


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_clashing_columns(spark):
    plain, more = corpus(spark)
    bench = spark.createDataFrame([(1, plain.where("doc_id = 100").first().text)], "item_id long, text string")
    model = quality.Model(None, 0.5)
    for operator in (
        line_dedup.remove_repeats,
        lambda d: line_dedup.remove_repeats(d, drop_empty=False),
        near_dup.keep,
        lambda d: decontam.keep(d, bench),
        lambda d: pii.redact(d, pii.find(d)),
        lambda d: quality.keep(d, model),
    ):
        got = extra_is_unchanged(operator(more))
        assert got == texts(operator(plain)) and got
    for operator in (near_dup.label, lambda d: decontam.find(d, bench), lambda d: repeats.digest(repeats.remove(d)), lambda d: pii.digest(pii.find(d))):
        assert sorted(operator(more).collect()) == sorted(operator(plain).collect())


def test_empty_tables_in_every_stage(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "mix" or out.columns == none.columns)


def long_text(seed, words=700_000):
    rnd = np.random.default_rng(seed)
    return " ".join(np.array([f"w{i:x}" for i in range(4000)])[rnd.integers(0, 4000, words)])


def test_very_long_texts(spark):
    one = long_text(1)
    assert len(one) > 2 * b.CHUNK_BYTES // 2 and len(one) > b.SEGMENT_BYTES
    item = "a benchmark item that stands at the very end of a text of several scan blocks"
    lines = "a line that comes again\nand the next line of it\nand one more"
    rows = [(1, f"{one} {item}"), (2, one[:3_000_000] + one[3_000_200:]), (3, f"{one[:2_500_000]}\n{lines}"), (4, f"short\n{lines}"), (5, "you idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r.doc_id, r.distance) for r in decontam.find(df, bench).collect()] == [(1, 0)]
    assert [r.doc_id for r in near_dup.label(df, k=3, percent=85).where("component_id <> doc_id").collect()] == [2]
    left = texts(line_dedup.remove_repeats(df))
    assert left[4] == "short" and left[3] == rows[2][1] and left[1] == rows[0][1]
    data, at = b.column(pa.array([t for _, t in rows]))
    net = quality.fit(*(np.random.default_rng(k).random((50, len(quality.FEATURES))) for k in (1, 2)), 0.5, steps=5)
    for module, model in ((quality, quality.Model(net, 0.5)), (toxicity, toxicity.Model(toxicity.NO_LEXICON, None, (np.zeros(1), np.array([0.4]))))):
        got = {r.doc_id: r.score for r in module.score(df, model).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(list(model.score(data, at)))
    # Features of a long text are those of its parts, put together.
    half = f"{one} {one}"
    for f in (quality.features, lambda d, a: toxicity.features(d, a, toxicity.NO_LEXICON)):
        raw = np.frombuffer(half.encode(), dtype=np.uint8)
        assert np.isfinite(f(raw, np.array([0, len(raw)]))).all()


def test_many_spans_in_one_text(spark):
    n = 3000
    text = " ".join(f"u{i}@x.org 10.0.{i % 256}.{i % 200}" for i in range(n)) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    row = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_email, row.n_ip, row.n_secret, row.n_spans) == (n, n, 1, 2 * n + 1)
    last = row.spans.rsplit(",", 1)[1]
    kind, start, end = last.split(":")
    assert kind == "secret" and text[int(start) : int(end)] == "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_secrets_need_context_and_variety(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    said = [f"api_key: {key}", f"commit {key}", f"see {key}", "token = " + "a" * 40, "password is Zx81kdLQ0pQ7vbN2mT5y", f"secret {key[:15]}", f"token {key}{key}{key}{key}"]
    rows = [(i, t) for i, t in enumerate(said)]
    got = {r.doc_id: r.n_secret for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[i] for i in range(len(said))] == [1, 0, 0, 0, 1, 0, 0]


def test_repeated_rows_and_items(spark):
    item = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"so {item} it is")] * 3 + [(2, "no")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (6, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(df, bench).collect()) == [(1, 5)] * 6 + [(1, 6)] * 3
    rows = near_dup.label(spark.createDataFrame([(1, "a b c d e f")] * 3 + [(4, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (4, 1)} and len(rows) == 4


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(ValueError):
        near_dup.label(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_scratch_tables_are_freed(spark):
    before = scratch.tables()
    one, two = scratch.saved(spark.range(3), "one"), scratch.saved(spark.range(4), "two")
    scratch.free(one)
    assert scratch.tables() - before == {two.scratch_path} and two.count() == 4
    scratch.clean(keep=before)
    assert scratch.tables() == before


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(9,0)"])
def test_ids_of_other_types(spark, kind):
    """Learning, scoring and searching take ids of any type that numbers can have."""
    rows = [(i, f"you stupid fool {i}" if i % 3 == 0 else f"a calm day by the sea {i} with words enough to tell", i % 3 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad boolean").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = df.select("doc_id", F.col("bad").cast("int").alias("toxic"), (~F.col("bad")).cast("int").alias("quality"))
    for part in (toxicity, quality):
        got = part.score(df.select("doc_id", "text"), part.learn(df, labels))
        assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType and got.count() == 90
    bench = spark.createDataFrame([(7, rows[7][1])], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    found = decontam.find(df, bench).collect()
    assert {int(r.doc_id) for r in found} >= {7} and {int(r.item_id) for r in found} == {7}


def test_rows_without_ids_are_dealt_apart(spark):
    """Of one source and no ids, rows of different texts fall into many shards, and the mix comes near its target."""
    from tessera.llm import mixing

    df = spark.createDataFrame([(None, f"some words {i} " * 40, "s") for i in range(200)] + [(1, "other words " * 900, "t")], "doc_id long, text string, source string")
    got = mixing.mix(df, shard_words=2000).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "st"}
    target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in "st")
    assert len({r.taken for r in got if r.doc_id is None}) > 1
