import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodegrid.llm import attention as at
from lodegrid.llm import text as T
from lodegrid.llm.bpe import Vocabulary

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def subwords():
    return at.Subwords(Vocabulary(PATH, at.RANKS))


def test_one_pass_counts_words_and_the_subwords_of_each_word_once(spark, subwords, monkeypatch):
    """Learning texts are read once for both counts; every chunk cuts a word once, however often it comes."""
    monkeypatch.setattr(T, "CHUNK", 40)
    texts = ["The Cat sat, the cat sat", None, "", "  ", "x" * 300 + " étrange x" + "x" * 299, "the the the"] * 4
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text"))
    got = {(r.subword, r.word): r.n for r in at.counts(docs.repartition(3), subwords).collect()}
    data = [t.encode() if t else None for t in texts]
    ids = np.bincount(subwords.cut(data)[1], minlength=at.END + 1)
    hashes, n = np.unique(np.concatenate([T.words_of(data, T.BLANK_SEPARATED).hashes(), np.full(len(texts), at.END_WORD)]), return_counts=True)
    want = {(True, int(i)): int(ids[i]) for i in np.flatnonzero(ids)}
    want |= {(False, int(h)): int(k) for h, k in zip(hashes.view(np.int64), n, strict=True)}
    assert got == want


def test_repeated_words_are_cut_once(subwords):
    words = T.words_of([b"river gold river", None, b"gold gold river quartz"], T.BLANK_SEPARATED)
    cut = []
    original = at.Subwords.spelled
    at.Subwords.spelled = lambda self, w, which: (cut.append(len(which)), original(self, w, which))[1]
    try:
        tokens, ids, size = subwords.tokens(words, words.hashes())
    finally:
        at.Subwords.spelled = original
    assert cut == [3] and len(tokens) == len(size) == 10 and size.sum() == len(ids)
    ends = np.cumsum(size)
    pieces = [ids[a:b].tolist() for a, b in zip(ends - size, ends, strict=True)]
    assert pieces[0] == pieces[2] == pieces[7] and pieces[1] == pieces[5] == pieces[6]
    assert [p for p in pieces if p == [at.END]] == [[at.END]] * 3


@pytest.mark.parametrize("size", [1, 300, 30_000])
def test_probabilities_of_far_outputs_are_finite_and_sum_to_one(size):
    model = at.Model()
    model.set_biases(np.array([1, 5, 5, at.END]))
    h = size * np.random.default_rng(0).standard_normal((1, at.WIDTH)).astype(np.float32)
    logs = model._log(np.repeat(h, at.END + 1, axis=0), np.arange(at.END + 1))
    assert np.isfinite(logs).all() and abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3
    # All logits far below the range of exp in single precision.
    for name in [k for k in model.p if k.startswith("step")]:
        model.p[name][:, -1] -= 500
    assert np.allclose(model._log(np.repeat(h, at.END + 1, axis=0), np.arange(at.END + 1)), logs, atol=1e-2 * size)
