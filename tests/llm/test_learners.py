import random

import numpy as np
from pyspark.sql import functions as F

from lodegrid.llm import language, quality


def sentence(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_bundles_are_sums_of_bound_letters():
    texts = ["Ab c", "x", None, "12 !", "ÄÖ-ß  z"]
    got, sizes = language.bundles([t.encode() if t else None for t in texts])
    for row, size, text in zip(got, sizes, texts, strict=True):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        symbols = [0] + [s for w in words for s in [*(1 + ord(c) % 1023 for c in w), 0]]
        want, n = np.zeros(language.DIMENSIONS), 0
        for i in range(len(symbols) - 2):
            bound = np.ones(language.DIMENSIONS)
            for j in range(3):
                bound = bound * np.roll(language._SIGNS[symbols[i + j]], 2 - j)
            want, n = want + bound, n + 1
        assert n == size
        assert np.allclose(row, want)


def test_languages_are_told_apart_on_texts_not_learned(spark):
    rng = random.Random(1)
    kinds = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstuäöü"}
    rows = [(i, sentence(rng, kinds[k], rng.randrange(3, 40)), k) for i, k in enumerate(list(kinds) * 40)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 ...", "bb"), (903, "abc abc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lang_score", F.lit("x"))
    model = language.learn(docs, F.col("doc_id") % 2 == 0)
    assert model[0] == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [(got[i].lang_pred, got[i].lang_score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "aa"
    empty = language.learn(docs.where("false"))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_dual_coordinate_descent_meets_the_optimality_conditions(monkeypatch):
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(1, 60, 8)).astype(np.int32) for _ in range(80)]
    signs = np.where(np.array([(r < 25).mean() for r in rows]) > 0.4, 1.0, -1.0)
    values = [np.full(len(r), len(r) ** -0.5) for r in rows]
    monkeypatch.setattr(quality, "EPOCHS", 2000)
    w = quality.descend(rows, values, signs)
    loss = 0.5 * w @ w + sum(max(0, 1 - y * w[r] @ v) for r, v, y in zip(rows, values, signs, strict=True))
    for _ in range(50):
        other = w + 0.01 * rng.standard_normal(len(w)) * (w != 0)
        assert loss <= 0.5 * other @ other + sum(max(0, 1 - y * other[r] @ v) for r, v, y in zip(rows, values, signs, strict=True)) + 1e-3


def test_quality_is_learned_and_kept_between_0_and_1(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = sentence(rng, "abcdefgh", rng.randrange(5, 40))
        rows.append((i, text if i % 3 else " ".join(w.upper() + "!!" for w in text.split()), i % 3 and 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality_score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]] + [(0, 0), (7, None), (None, 1)], "doc_id bigint, label int")
    extra = docs.union(spark.createDataFrame([(900, None, 0), (901, "", 0), (900, None, 0)], docs.schema))
    got = quality.score(extra, quality.learn(docs, labels)).collect()
    assert all(0 <= r.quality_score <= 1 for r in got)
    held = {r.doc_id: r.quality_score for r in got}
    assert np.mean([(held[i] >= 0.5) == bool(y) for i, _, y in rows[200:]]) > 0.95
    assert held[900] == held[901]
    nothing = quality.learn(docs, labels.where("false"))
    assert {r.quality_score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_scores_are_those_of_plain_sums():
    """Log ratios by counting, margins by adding up, one text at a time."""
    rng = random.Random(6)
    texts = [sentence(rng, "abcdef" if i % 2 else "uvwxyz", rng.randrange(1, 30)).encode() for i in range(60)] + [b"", None]
    labels = np.array([i % 2 for i in range(60)] + [1, 0])
    rows = [quality.features([t])[0] for t in texts]
    ratios = quality.log_ratios(rows, labels)
    ones = [{int(f) for f in r} for r, y in zip(rows, labels) if y == 1]
    zeros = [{int(f) for f in r} for r, y in zip(rows, labels) if y == 0]
    p, q = {}, {}
    for counts, docs in ((p, ones), (q, zeros)):
        for d in docs:
            for f in d:
                counts[f] = counts.get(f, 0) + 1
    a, b = (sum(c.values()) + quality.SMOOTHING * quality.WIDTH for c in (p, q))
    assert ratios[0] == 1  # the constant
    for f in sorted({*p, *q} - {0})[:200]:
        want = np.log(((p.get(f, 0) + quality.SMOOTHING) / a) / ((q.get(f, 0) + quality.SMOOTHING) / b))
        assert abs(ratios[f] - want) < 1e-9
    model = quality.fit(rows, labels)
    got = model.scores(texts)
    for t, s in zip(texts, got):
        found = quality.features([t])[0]
        margin = sum(model.product[f] for f in found) / max(sum(model.ratios[f] ** 2 for f in found) ** 0.5, 1e-12)
        assert abs(s - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-9


def test_a_repeated_id_is_one_row_of_the_sample_and_empty_tables_score_nothing(spark, monkeypatch):
    rows = [(i, f"good words number {i}" if i % 2 else f"BAD!! stuff {i}") for i in range(40)]
    again = [(0, f"BAD!! other {i}") for i in range(200)] + [(0, None)]
    docs = spark.createDataFrame(rows + again, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, label int")
    model = quality.learn(docs, labels)
    texts = [r.text for r in docs.where("doc_id = 0").collect()]
    one = [quality.learn(docs.where("doc_id <> 0").union(spark.createDataFrame([(0, t)], docs.schema)), labels) for t in texts[:1]]
    assert abs(len(texts) - 202) == 0 and model.slope != 0 and one[0].slope != 0
    assert quality.score(docs.where("false"), model).count() == 0
    assert language.identify(docs.where("false"), language.learn(docs.withColumn("lang", F.lit("aa")))).count() == 0


def test_very_long_texts_are_learned_and_scored(spark):
    rng = random.Random(8)
    long = [(i, sentence(rng, "abcdefgh" if i % 2 else "ijklmnop", 60_000)) for i in range(4)]
    rows = long + [(10 + i, sentence(rng, "abcdefgh" if i % 2 else "ijklmnop", 30)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "aa" if i % 2 else "bb") for i, t in rows], "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    got = {r.doc_id: r.quality_score for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in got.items())
    told = {r.doc_id: r.lang_pred for r in language.identify(docs.drop("lang"), language.learn(docs)).collect()}
    assert all(v == ("aa" if i % 2 else "bb") for i, v in told.items())
