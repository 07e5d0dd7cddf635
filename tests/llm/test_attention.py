import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegrid.llm import attention as at
from lodegrid.llm.bpe import Vocabulary

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def subwords():
    return at.Subwords(Vocabulary(PATH, at.RANKS))


def test_words_are_cut_greedily(subwords):
    names = {}
    for first in range(256):
        stack = [(int(subwords.first[first]), bytes([first]))]
        while stack:
            node, name = stack.pop()
            names[node] = name
            stack += [(int(c), name + bytes([b])) for b, c in enumerate(subwords.next[node]) if c >= 0]
    known = set(names.values())
    texts = ["The thing, étrange!", "", None, "x" * 50 + " Überraschung 中文"]
    words, ids, counts = subwords.cut([t.encode() if t else None for t in texts])
    assert len(ids) == counts.sum()
    at_end = np.cumsum(counts)
    for text, a, b in zip(texts, at_end - counts, at_end, strict=True):
        want = []
        for word in (text or "").translate({c: c + 32 for c in range(65, 91)}).split():
            data, i = word.encode(), 0
            while i < len(data):
                j = i + 1
                while j < len(data) and data[i:j + 1] in known:
                    j += 1
                want.append((data[i:j], j == len(data)))
                i = j
        assert [(names[i // 2], bool(i % 2)) for i in ids[a:b - 1]] == want
        assert ids[b - 1] == at.END


def test_every_id_is_scored_once_from_what_precedes_it():
    rng = np.random.default_rng(1)
    counts = np.array([1, 5, 24, 25, 60, 100])
    ids = rng.integers(0, at.END, counts.sum())
    model = at.Model()
    whole = model.log10(ids, counts)
    inputs, first, row, column = at.windows(ids, counts)
    assert len(set(zip(row.tolist(), column.tolist(), strict=True))) == len(ids)
    # A later id changes nothing before it, and texts do not see each other.
    for place in (0, 7, 29, 90, len(ids) - 1):
        changed = ids.copy()
        changed[place] = (changed[place] + 1) % at.END
        assert np.allclose(model.log10(changed, counts)[:place], whole[:place], atol=1e-5)
    alone = np.concatenate([model.log10(ids[a:b], np.array([b - a])) for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True)])
    assert np.allclose(alone, whole, atol=1e-4)


def test_probabilities_sum_to_one():
    model = at.Model()
    model.set_biases(np.array([1, 5, 5, at.END]))
    h = np.repeat(np.random.default_rng(0).standard_normal((1, at.WIDTH)).astype(np.float32), at.END + 1, axis=0)
    assert abs(np.exp(model._log(h, np.arange(at.END + 1)).astype(float)).sum() - 1) < 1e-3


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    counts = np.array([30, 3])
    ids = rng.integers(0, at.END + 1, counts.sum())
    model = at.Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    args = (*at.windows(ids, counts), ids)
    g = model.gradients(*args)
    loss = lambda: -model.log10(ids, counts).sum() * np.log(10) / len(ids)
    for name, v in model.p.items():
        direction = rng.standard_normal(v.shape)
        step = 1e-5
        model.p[name] = v + step * direction
        up = loss()
        model.p[name] = v - step * direction
        down = loss()
        model.p[name] = v
        assert abs((up - down) / (2 * step) - (g[name] * direction).sum()) < 1e-4 * max(1, abs((g[name] * direction).sum())), name


def test_training_lowers_the_loss(subwords):
    texts = [b"the cat sat on the mat and the dog sat on the log"] * 400
    _, ids, counts = subwords.cut(texts)
    model, trained = at.Model(), at.Model()
    trained.train(ids, counts)
    assert trained.log10(ids, counts).mean() > model.log10(ids, counts).mean() + 0.5


def test_what_only_late_documents_hold_is_learned(spark, subwords, monkeypatch):
    """More documents than any sample of fixed size, over several tasks: the last 300 of 3,000 by hash of their id have words of their own."""
    monkeypatch.setattr(at, "FAN", 2)
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"))) > 2700
    text = F.when(late, "quick zebra vexes jumpy wolf").otherwise("the cat sat on the mat")
    docs = spark.range(3000).toDF("doc_id").select("doc_id", text.cast("binary").alias("text")).repartition(7)
    model = at.train(docs, subwords, F.lit(True))
    _, ids, counts = subwords.cut([b"quick zebra vexes jumpy wolf"])
    assert model.log10(ids, counts).mean() > at.Model().log10(ids, counts).mean() + 0.5


def test_counts_and_base_scores_match_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(at, "BLOCK", 200)
    texts = ["The cat sat on the mat", "a dog sat", None, "", "the cat", "new words here"] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(1))
    got = at.log_scores(docs, PATH, F.col("doc_id") % 3 != 0).collect()
    assert len(got) == len(rows)
    counts = {}
    for i, t in rows:
        if i is not None and i % 3 != 0:
            for w in [*(t or "").lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        text = {i: t for i, t in rows}[r.doc_id]
        tokens = [*(text or "").lower().split(), None]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert abs(r.base_score - base) < 1e-9
        assert r.score < 0


@pytest.mark.parametrize("once", [0, 3])
def test_probabilities_of_words_sum_to_one_at_most(subwords, once):
    """At the start of a text: the learned words, and all that is left to the model as the mass of new ones."""
    words = [f"{a}{b}" for a in ("gold", "quartz", "river", "old") for b in ("", "s", "mine", "field")]
    counts = np.array([5 + i if i >= once else 1 for i in range(len(words))] + [9])
    hashes = np.concatenate([at.T.words_of([" ".join(words).encode()], at.T.BLANK_SEPARATED).hashes(), [at.END_WORD]])
    order = np.argsort(hashes)
    net = at.Model()
    _, ids, per = subwords.cut([" ".join(words).encode()] * 300)
    net.train(ids, per)
    n = int(counts.sum())
    each = [w.encode() for w in words] + [b""]
    per_doc, c, _, score = at.token_scores(subwords, net, each, hashes[order], counts[order], n, len(counts), once)
    first = np.cumsum(per_doc) - per_doc
    assert (c[first] == counts).all()
    learned = (10.0 ** score[first]).sum()
    u = once / n
    spelled = 2 * (learned - (1 - u) / 2)  # the model's own mass on them
    new = at.token_scores(subwords, net, [b"zyx"], hashes[order], counts[order], n, len(counts), once)[3][0]
    bare = at.token_scores(subwords, net, [b"zyx"], hashes[:0], counts[:0], 0, 0, 0)[3][0]
    assert abs(new - bare - np.log10((1 + u) / 2)) < 1e-9
    total = learned + (1 + u) / 2 * (1 - spelled)
    assert 0 < spelled < 1 and total <= 1 + 1e-6 and abs(total - (1 - u * spelled / 2)) < 1e-6


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = at.log_scores(docs, PATH, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert at.log_scores(docs.where("false"), PATH, F.lit(True)).count() == 0
