import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegrid.llm import text as T

SOME = st.lists(st.one_of(st.none(), st.text(alphabet="aB cZ9\t\n-é中 😀", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(SOME)
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((T.BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), (T.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = T.words_of([t.encode() if t is not None else None for t in texts], table)
        got = [[] for _ in texts]
        for a, b, d in zip(words.starts, words.ends, words.doc, strict=True):
            got[d].append(words.blob[a:b].decode())
        want = [re.findall(pattern, (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
        assert got == want
        assert words.per_doc.tolist() == [len(w) for w in want]


def test_equal_spans_have_equal_hashes_wherever_they_are():
    long = b"x" * 300
    blob = b"abc abcd abc " + long + b" " + long + b" " + long[:-1] + b"y"
    ends = np.flatnonzero(np.frombuffer(blob + b" ", np.uint8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = T.span_hashes(blob, starts, ends)
    assert h[0] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 4


def test_chunks_cover_everything_once():
    texts = [b"x" * n for n in (10, 0, 300, 5, 5)] + [None]
    pieces = list(T.chunks(texts, 20))
    assert [i for a, b in pieces for i in range(a, b)] == list(range(6))
    assert list(T.chunks([])) == []
