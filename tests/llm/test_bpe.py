import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodegrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_hash_is_perfect_and_minimal(vocabulary):
    n = len(vocabulary.tokens)
    assert sorted(vocabulary.slots.tolist()) == list(range(n))
    hashes = bpe.T.span_hashes(vocabulary.blob, vocabulary.starts, vocabulary.ends)
    assert vocabulary.find(hashes).tolist() == list(range(n))


def test_ids_are_those_of_the_library(vocabulary, library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "'", "s", "ll", "re", "d", "don", "é", "1", "٣", "!", "%", "中", "😀", "　", "'s", "\r\n", "\x1c", "\x85", "²", "Haus"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", "a" * 2000, " " * 300, "x" + " " * 9, "<|endoftext|>", "'", "'l", "''s", " 's"]
    codec = bpe.Codec(vocabulary)
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(t), t
    assert codec.decode(ids, counts) == [t.encode() for t in texts]


def test_rows_in_and_out(spark, library):
    rows = [(1, "Hello there", "x"), (2, None, None), (None, "", "y"), (1, "Hello there", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.encode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.text, list(r.token_ids), r.n_tokens) for r in got if r.text is not None) == sorted(
        (d or 0, t, library.encode_ordinary(t), len(library.encode_ordinary(t))) for d, t, _ in rows if t is not None)
    assert [list(r.token_ids) for r in got if r.text is None] == [[]]
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0
    assert bpe.round_trip(docs, PATH).count() == 4
