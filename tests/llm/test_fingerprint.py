import random

from pyspark.sql import functions as F

from lodegrid.llm import fingerprint as fp


def test_next_document_in_ascending_order(spark):
    ids = random.Random(5).sample(range(-50, 100000), 300)
    docs = spark.createDataFrame([(i, f"t{i}", 1) for i in ids], "doc_id bigint, text string, next_text int").drop("next_text")
    order = sorted(ids)
    got = {r.doc_id: r.next_text for r in fp.with_next(docs, ["text"]).collect()}
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert [r.next_text for r in fp.with_next(docs.limit(1), ["text"]).collect()] == [docs.limit(1).first().text]
    assert fp.with_next(docs.where("false"), ["text"]).count() == 0


def test_digests_and_likeness(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(900)}é" for _ in range(n)) for n in (0, 1, 4, 5, 9, 40, 300, 2500)] + [None]
    rows = list(enumerate(texts)) + [(50, texts[6]), (51, texts[6].upper())]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(got)
    import hashlib

    plain = {i: t or "" for i, t in rows}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        n = len(plain[a])
        edited = plain[a][:n - n // 4] + plain[b][:n // 4]
        assert got[a].n_chars == n
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
    assert got[6].fingerprint == got[50].fingerprint == got[51].fingerprint
    assert got[50].near_next == 1.0
    assert got[0].fingerprint == got[8].fingerprint == ""
    for i in (5, 6, 7):
        assert got[i].near_edited > 0.4 > got[i].near_next
    assert len(got[7].fingerprint) < 16 * 2500 / 4


def test_containment_of_a_part_and_merging(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20000)]
    part, rest = " ".join(words[3000:3600]), " ".join(words[3590:])
    df = spark.createDataFrame([(" ".join(words), part, rest)], "a string, b string, c string").select(
        *[fp.sketch(F.col(c)).alias(c) for c in "abc"]).select(
        fp.containment(F.col("b"), F.col("a")).alias("b_in_a"), fp.containment(F.col("a"), F.col("b")).alias("a_in_b"),
        fp.likeness(F.col("a"), F.col("a")).alias("same"),
        fp.containment(fp.merged(F.col("b"), F.col("c")), F.col("a")).alias("merged"))
    r = df.first()
    assert r.b_in_a == 1 and r.same == 1 and 0.015 < r.a_in_b < 0.045 and r.merged == 1


def full_set(text):
    """All shingle hashes of a text: words hashed on from one another, as signed 64-bit numbers."""
    import xxhash
    words = [w for w in __import__("re").split(r"[ \t\n\x0B\f\r]+", text.lower()) if w]
    out = set()
    for i in range(max(1, len(words) - fp.SHINGLE + 1) if words else 0):
        h = 42
        for w in words[i:i + fp.SHINGLE]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def test_sketches_are_the_low_part_of_full_sets_and_likeness_is_close(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    texts = [" ".join(base[:n]) for n in (1, 4, 6, 30, 200, 3000)]
    texts += [" ".join(base[:2400] + [f"x{i}" for i in range(600)]), " ".join(base[1500:]), " ".join(base[5:25]), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fp.sketch(F.col("t")).alias("k"))
    kept = {r.i: r.k for r in df.collect()}
    sets = [full_set(t) for t in texts]
    for i, full in enumerate(sets):
        low = sorted(full)
        assert kept[i] == [h for n, h in enumerate(low) if h < fp._CUT or n < fp.AT_LEAST]
    two = df.toDF("i", "a").crossJoin(df.toDF("j", "b"))
    for r in two.select("i", "j", fp.likeness(F.col("a"), F.col("b")).alias("l"), fp.containment(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = sets[r.i], sets[r.j]
        if len(a) <= fp.AT_LEAST and len(b) <= fp.AT_LEAST and a | b:
            assert abs(r.l - len(a & b) / len(a | b)) < 1e-12
        elif a and b:
            assert abs(r.l - len(a & b) / len(a | b)) < 0.12
            assert r.c is None and len(a) < fp.AT_LEAST or len(a) < fp.AT_LEAST or abs(r.c - len(a & b) / len(a)) < 0.2


def test_repeated_rows_have_one_fingerprint(spark):
    rows = [(1, "same text over and over again")] * 3 + [(2, "another text that is here"), (None, "same text over and over again")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id in (1, None)}) == 1
