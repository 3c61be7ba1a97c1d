"""Classifiers, word rules and URL rules."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fertility, labelled, quality, toxicity, trees, url_filter


def labelled_corpus(seed, n=900):
    rnd = random.Random(seed)
    words = [a + b for a in "bcdfghklmnprst" for b in ("a", "eo", "ui", "on", "ar", "il")]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        good, toxic = rnd.random() < 0.85, rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "zorgle", "you moron"]))
        text = " ".join(w) if good else " ".join(x + rnd.choice(["###", "$$$", "!!"]) for x in w)
        docs.append((i, text))
        if i % 4:
            labels.append((i, int(good), int(toxic)))
    return docs + [(2000, None), (2001, ""), (2001, "")], labels + [(5000, 1, 1), labels[0]]


@pytest.mark.parametrize("module, label, parts, which, threshold", [(toxicity, "toxic", 3, 1, 0.7), (quality, "quality", 5, 0, 0.3)])
def test_held_out_accuracy(spark, module, label, parts, which, threshold):
    docs, labels = labelled_corpus(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = module.score(d, module.learn(d, lab)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    assert all(r.held_out == (labelled.bucket(r.doc_id, parts) == which) for r in got)
    truth = {i: (q if label == "quality" else t) for i, q, t in labels}
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95
    assert module.score(d.limit(0), module.Model(*([None, 0.5] if module is quality else [toxicity.NO_LEXICON, None, (np.zeros(1), np.array([0.5]))]))).count() == 0


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.learn(d, none)).collect()} == {0.5}
    assert {r.score for r in quality.score(d, quality.learn(d, none)).collect()} == {0.5}


def test_labels_of_the_held_out_part_are_not_seen(spark):
    docs, labels = labelled_corpus(4, 200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for label, parts, which in (("toxic", 3, 1), ("quality", 5, 0)):
        seen = labelled.training_sample(d, lab, label, parts, which).collect()
        assert seen and all(labelled.bucket(r.doc_id, parts) != which for r in seen)
        assert labelled.training_sample(d, lab, label, parts, which, rows=10).count() <= 10


def test_prior_estimate():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        p = rnd.normal(3, 1, 2000)
        u = np.where(rnd.random(4000) < share, rnd.normal(3, 1, 4000), rnd.normal(-3, 1, 4000))
        assert abs(quality.estimate_prior(p, u) - share) < 0.05


def test_slopes_of_the_non_negative_risk():
    rnd = np.random.default_rng(4)
    for shift, prior in ((0, 0.4), (-3, 0.9), (2, 0.2), (0, None)):
        f, is_p = rnd.normal(shift, 1, 30), np.arange(30) < 10
        if prior is not None:
            f[is_p] += 3 * (shift < 0) * 2

        def lowered(f, is_p=is_p, prior=prior):
            if prior is None:
                return np.log1p(np.exp(-f[is_p])).mean() + np.log1p(np.exp(f[~is_p])).mean()
            plus = prior * sum(np.log1p(np.exp(-x)) for x in f[is_p]) / 10
            minus = sum(np.log1p(np.exp(x)) for x in f[~is_p]) / 20 - prior * sum(np.log1p(np.exp(x)) for x in f[is_p]) / 10
            return plus + minus if minus >= 0 else -minus

        got = quality.slopes(f, is_p, prior)
        for i in range(30):
            step = np.zeros(30)
            step[i] = 1e-6
            assert np.isclose(got[i], (lowered(f + step) - lowered(f - step)) / 2e-6, atol=1e-6)
    assert quality.risk(np.array([5.0, -5.0]), np.array([True, False]), 0.9)[1] < 0


def test_unlabelled_rows_come_from_all_documents(spark):
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(7, "again"), (None, "x")], "doc_id long, text string"))
    got = labelled.unlabelled_sample(d, 5, 0).collect()
    assert {r.doc_id for r in got} == {i for i in range(300) if labelled.bucket(i, 5)} and len(got) == len({r.doc_id for r in got})
    assert labelled.unlabelled_sample(d, 5, 0, rows=20).count() == 20
    held = d.select("doc_id", (labelled.part("doc_id", 5) == 0).alias("h")).collect()
    assert all(r.h == (labelled.bucket(r.doc_id, 5) == 0) for r in held)


def plain_tree_sum(model, row):
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - (2**model.depth - 1)]
    return total


def test_trees_against_plain_walks():
    rnd = np.random.default_rng(6)
    x = rnd.random((400, 5)).round(2)
    y = (x[:, 1] + x[:, 2] > 1).astype(float)
    model = trees.fit(x, y, trees=8, depth=2)
    assert np.allclose(model.raw(x), [plain_tree_sum(model, r) for r in x])
    # The first cut is the best of all cuts by the Newton gain.
    g, h = y - y.mean(), np.full(400, y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(gain(x[:, j] <= c) + gain(x[:, j] > c) for j in range(5) for c in np.unique(x[:, j]))
    j, c = model.feature[0, 0], model.threshold[0, 0]
    assert gain(x[:, j] <= c) + gain(x[:, j] > c) >= 0.98 * best
    # Isotonic fit: no other non-decreasing step function through its blocks is nearer.
    score, label = rnd.random(60), (rnd.random(60) < 0.5).astype(float)
    order = np.argsort(score)
    means = [min(max(np.mean(label[order][i:k]) for i in range(0, j + 1)) for k in range(j + 1, 61)) for j in range(60)]
    knots = trees.isotonic(score, label)
    pooled = np.unique(np.round(means, 9))
    assert len(pooled) == len(knots[0])


def test_toxicity_features_against_plain_counts():
    texts = ["You IDIOT! you moron?", "a fine day, and no more.", "stup1d id1ot!", ""]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = dict(zip(toxicity.FEATURES, toxicity.features(data, at, toxicity.NO_LEXICON).T, strict=True))
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", t.lower())
        assert got["insults"][i] == sum(w in toxicity.INSULTS for w in words)
        assert got["second_share"][i] == pytest.approx(100 * sum(w in toxicity.SECOND_PERSON for w in words) / max(1, len(words)))
        letters = max(1, len(re.findall("[A-Za-z]", t)))
        assert got["capitals"][i] == pytest.approx(len(re.findall("[A-Z]", t)) / letters)
        assert got["bangs"][i] == pytest.approx(t.count("!") / max(1, len(t))) and got["asks"][i] == pytest.approx(t.count("?") / max(1, len(t)))
        assert got["words_log"][i] == pytest.approx(np.log1p(len(words)))
    assert got["near_second"].tolist() == [2, 0, 0, 0] and got["spelt"][2] == 2


def test_trees_and_calibration():
    rnd = np.random.default_rng(2)
    x = rnd.random((3000, 4))
    p = np.where((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3), 0.9, 0.1)
    y = (rnd.random(3000) < p).astype(float)
    model = trees.fit(x[:2000], y[:2000])
    got = trees.calibrated(model.raw(x[2000:]), trees.isotonic(model.raw(x[:2000]), y[:2000]))
    assert np.mean((got > 0.5) == (p[2000:] > 0.5)) > 0.93
    knots = trees.isotonic(rnd.random(500), (rnd.random(500) < 0.5).astype(float))
    assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) > 0).all()


def test_word_rules(spark):
    rnd = random.Random(8)
    words = ["the", "of", "an", "é", "long#word", "x|y", "日本", " ", "a b"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t", "\r\n", "\x0b", "\n\n"]) for _ in range(rnd.randint(0, 150))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "\n\n \n"), (903, "w " * 60), (903, "w " * 60), (904, "y" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("kept", F.lit("clash"))
    got = fertility.rules(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = brute.word_rules(texts[r.doc_id])
        assert all(r[k] == v for k, v in want.items()), r.doc_id
        assert not (r.base_failed and r.kept)
    assert fertility.rules(df.limit(0)).count() == 0


def test_fertility_of_scripts():
    model = fertility.Words(open(fertility.VOCABULARY, "rb").read())
    from tessera.llm import bytescan as b
    import pyarrow as pa

    texts = ["The house by the river was old and quiet in the morning light", "日本語の文章です これは短い例です", "Привет мир это короткий пример текста", "", None]
    ((_, _, data, at),) = b.chunks(pa.array(texts))
    m = fertility.measure(data, at, model)
    assert [list(fertility.BANDS)[k] for k in m["script"]] == ["latin", "cjk", "cyrillic", "other", "other"]
    assert m["byte_share"][0] == 0 and m["chars_per_token"][0] > 3 > m["chars_per_token"][1]
    for i, t in enumerate(texts[:3]):
        ids = model.pieces.encode(t)
        assert m["n_tokens"][i] == len(ids)
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        assert np.isclose(m["entropy_share"][i], -(share * np.log2(share)).sum() / np.log2(len(ids)))


def test_byte_level_vocabulary():
    words = fertility.vocabulary(fertility.VOCABULARIES[1], open(fertility.VOCABULARIES[1], "rb").read())
    said = [b"the", "日本語".encode(), b"x" * 50_000, "é".encode()]
    ids, first = words.tokens(said)
    assert [words.pieces.decode_bytes(ids[i:j].tolist()) for i, j in zip(first, first[1:], strict=False)] == said
    assert words.tokens([])[0].shape == (0,) and words.is_byte.sum() == 256


def test_bands_of_all_documents(spark, monkeypatch):
    rnd = random.Random(9)
    plain = "the house by old river was quiet in light of morning and people came to see what it had been".split()
    junk = ["".join(rnd.choices("etaoinshr", k=6)) for _ in range(99)]
    rows = [(i, " ".join(rnd.choices(plain, k=rnd.randint(60, 200))), "en" if i % 3 else None) for i in range(600)]
    rows += [(1000 + i, " ".join(rnd.choices(junk, k=150)), "en") for i in range(12)] + [(2000, "word " * 10, "en"), (2001, None, "en"), (2002, " ".join(rnd.choices(junk, k=150)), "rare")]
    # Kinds too small for bands of their own: of its script's size, of its script's sizes by threes, of nothing.
    rows += [(3000 + i, " ".join(rnd.choices(plain, k=90)), "few") for i in range(20)] + [(3100 + i, " ".join(rnd.choices(plain, k=300)), "few") for i in range(5)]
    rows += [(3200 + i, " ".join(rnd.choices(junk, k=300)), "few") for i in range(2)] + [(3300, " ".join(rnd.choices(plain, k=3000)), "few"), (3301, "слово дом река " * 30, "few")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in fertility.rules(df).collect()}
    assert not any(got[k].kept for k in (2000, 2001, 2002, 3200, 3201, *range(1000, 1012))) and all(got[k].kept for k in range(3000, 3020))
    # The same verdicts from sorted values.
    names = [m + n for n in ("", "_2") for m in ("chars_per_token", "byte_share", "entropy_share")]
    least = fertility.LEAST_DOCS
    monkeypatch.setattr(fertility, "LEAST_DOCS", 10**9)
    others_ok = {r.doc_id: r.kept for r in fertility.rules(df).collect()}
    kinds = {}
    for i, _, lang in rows:
        script, size = f"script {got[i].script}", int(np.log2(max(1, got[i].n_words)))
        kinds[i] = [(lang or script, size), (script, size), (script, "by threes", size // 3)]
    for i, r in got.items():
        peers = next((p for level in range(3) if len(p := [got[k] for k in got if kinds[k][level] == kinds[i][level] and others_ok[k]]) >= least), [])
        want = others_ok[i]
        for n in names if peers else ():
            bins = sorted(int(np.floor(p[n] / fertility.STEP + 0.5)) for p in peers)
            q1, q2, q3 = (bins[int(np.ceil(len(bins) * q)) - 1] for q in (0.25, 0.5, 0.75))
            reach = max((q3 - q1) / 1.349, 1) * fertility.SPREADS
            want &= (q2 - reach) * fertility.STEP <= r[n] <= (q2 + reach) * fertility.STEP
        assert r.kept == want, i


def as_pattern(p):
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|[^*]", p)) + r"\Z")


def test_automaton():
    rnd = random.Random(5)
    for _ in range(150):
        patterns = [p for p in ("".join(rnd.choice(["a", "b", "/", "*", "**", ".", "é"]) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12))) if p.strip("*")] or ["a"]
        forms = ["".join(rnd.choice("ab/.cé") for _ in range(rnd.randint(0, 14))) for _ in range(30)]
        got = url_filter.Automaton(patterns).run(forms)
        assert got.tolist() == [[bool(as_pattern(p).match(f)) for p in patterns] for f in forms]


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for r in rules:
        verdict, text = r.split()
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, verdict))
    return host, path, max(fits) if fits else None


def test_url_rules(spark):
    rules = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]
    rnd = random.Random(1)
    hosts = ["x.net", "net", "A.Example.NET", "example.com", "notexample.com", "b.org", "org", "x.net:80", "", "é.org"]
    urls = [f"{s}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/a', '/de/b', '/fr/', '/fr', '/x/y.net/en/'])}{rnd.choice(['', '?q=/en/', '#://x'])}" for s in ("http", "https") for _ in range(150)]
    urls += [None, "", "x.net/en/", "://", "http:///net/", "http://" + "a" * 5000 + ".net/" + "b" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3).withColumn("host", F.lit("clash"))
    for r in url_filter.judge(df, rules).collect():
        host, path, best = plain_verdict(urls[r.page_id], rules)
        assert (r.host, r.path) == (host, path), urls[r.page_id]
        assert r.rule == (best[1] if best else None) and r.verdict in ("allow", "block")
        assert best is None or r.verdict == best[2]
    assert url_filter.judge(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.rule("forbid net/")
