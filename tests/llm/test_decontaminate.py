import hashlib
import random
import re

import pytest

from lodegrid.llm import decontaminate as dc

DOCS, BENCH = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, bench):
    out = {}
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            n = min(10, len(b))
            for k in range(len(b) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == b[k:k + n]:
                        hit.update(range(i, i + n))
                        items.add(str(item))
        out[doc_id] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = random.Random(2)
    pool = [f"Wort{i}" for i in range(30)] + ["é", "中文", "x9"]
    bench = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(12)] + [(90, None), (91, "..."), (3, "Alone!")]
    docs = [(i, ", ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"before {t.upper() if t else ''}; after") for i, (_, t) in enumerate(bench)]
    docs += [(200, None), (201, ""), (202, "-- --")]
    return docs, bench


@pytest.mark.parametrize("block", [dc.BLOCK, 40])
def test_every_window_of_every_item_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)  # a small block makes several passes
    docs, bench = cases()
    got = dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(docs, bench)


def test_documents_or_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Kept (start). {item.upper()}! Kept end.", "a", 1), (2, "nothing here", None, 2), (3, None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, n_hit int")
    bench = spark.createDataFrame([(7, item)], BENCH)
    assert sorted(r.doc_id for r in dc.decontaminate(docs, bench).collect()) == [2, 3]
    got = dc.decontaminate(docs, bench, remove="spans")
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Kept (start). ! Kept end.", 2: "nothing here", 3: None}
    assert dc.decontaminate(docs, bench.where("false")).count() == 3
    assert dc.decontaminate(docs.where("false"), bench).count() == 0
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, remove="all")


def test_one_window_in_all_items_and_repeated_documents(spark):
    window = "a b c d e f g h i j"
    bench = [(i, f"{window} k{i}") for i in range(300)]
    docs = [(i % 4, f"x {window} y") for i in range(40)] + [(9, f"{window} k7")]
    known, held = dc.numbered(spark.createDataFrame(bench, BENCH))
    assert known.count() == 301 and held.count() == 600
    got = dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    assert len(got) == 41 and {r.n_items for r in got} == {300}
    assert {(r.doc_id, r.n_words, r.n_hit) for r in got} == {(i, 12, 10) for i in range(4)} | {(9, 11, 11)}
    assert len({r.items_sha256 for r in got}) == 1


def test_spans_of_several_blocks_are_removed_together(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 2)
    words = [f"w{i}" for i in range(14)]
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after")], DOCS)
    bench = spark.createDataFrame([(1, " ".join(words))], BENCH)
    assert [r.text for r in dc.decontaminate(docs, bench, remove="spans").collect()] == ["before  after"]
    assert dc.decontaminate(docs, bench).collect() == []
