import base64
import importlib.util
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline
from lodegrid.llm import queries as q

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(columns)
    return sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_agree_with_their_sql(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    want = duck.execute(q.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))


def test_token_ids_are_those_of_the_library(spark, sf):
    path = public_tokenizers.path(q.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text for r in q.table(spark, sf, "documents").collect()}
    import hashlib

    for r in q.op8_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def _other(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def learned_from(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def plain_languages(docs, langs):
    """Documents whose language is told, one bundle at a time: sums of unit bundles, largest cosine, soft share."""
    from lodegrid.llm import language
    bundles = {i: language.bundles([t.encode() if t else None])[0][0].astype(float) for i, t in docs.items()}
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    names = sorted({langs[i] for i in docs if langs[i] and docs[i] is not None and learned_from(i)})
    prototypes = np.array([unit(sum(unit(bundles[i]) for i in docs if langs[i] == n and docs[i] is not None and learned_from(i))) for n in names])
    kept = set()
    for i, v in bundles.items():
        cosines = prototypes @ unit(v)
        if v.any() and 1 / np.exp(language.SHARPNESS * (cosines - cosines.max())).sum() >= corpus_pipeline.LEAST_LANGUAGE:
            kept.add(i)
    return kept


def plain_quality(docs, marks):
    """Documents that a model fitted on all labelled ones, in the order of the fit, holds for good."""
    from lodegrid.llm import quality
    rows = [(i, marks[i], quality.features([docs[i].encode() if docs[i] else None])[0]) for i in docs if marks.get(i) is not None and learned_from(i)]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    rows = [rows[k] for k in np.random.default_rng(5).permutation(len(rows))]
    model = quality.fit([r[2] for r in rows], np.array([r[1] for r in rows]))
    return {i for i, t in docs.items() if model.scores([t.encode() if t else None])[0] >= corpus_pipeline.LEAST_QUALITY}


def test_pipeline_stages_match_plain_versions(spark, sf, tmp_path):
    docs = q.table(spark, sf, "documents")
    columns, seen, benchmark = docs.columns, {}, [(r.item_id, r.text) for r in q.table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in out.collect()})
        if name != "encoding":
            assert out.columns == columns
        docs = out
    before, after = seen["language"]
    langs = {r.doc_id: r.lang for r in q.table(spark, sf, "documents").collect()}
    assert set(after) == plain_languages(before, langs) and len(after) > 0.9 * len(before)
    before, after = seen["quality"]
    marks = {r.doc_id: r.quality for r in q.table(spark, sf, "labels").collect()}
    assert set(after) == plain_quality(before, marks) and 0.7 * len(before) < len(after) < len(before)
    before, after = seen["near_duplicates"]
    _, roots = _other("test_neardup").brute(list(before.items()))
    assert set(after) == set(roots.values())
    before, after = seen["decontamination"]
    hits = _other("test_decontaminate").brute(list(before.items()), benchmark)
    assert set(after) == {k for k, h in hits.items() if not h[4]}
    before, after = seen["encoding"]
    assert set(after) == set(before)
    assert all(r.n_tokens == len(r.token_ids) for r in after.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == set(after)
