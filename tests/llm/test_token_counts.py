from lodegrid.llm import token_counts as tc

DOCS = "doc_id bigint, text string, source string, lang string, tokens int"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


def test_batches_add_up_and_repeat_harmlessly(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 0), (2, "d, e", "s", "en", 0), (3, None, None, "fr", 0), (3, None, None, "fr", 0)], DOCS)
    store = tc.Rollup.fresh(spark)
    assert totals(store) == {}
    assert store.apply("one", tc.changes(docs, "insert", "words-1"))
    first = {("s", "en", "words-1"): (2, 5), (None, "fr", "words-1"): (1, 0)}
    assert totals(store) == first
    assert not store.apply("one", tc.changes(docs, "insert", "words-1"))
    assert totals(store) == first
    store.apply("two", tc.changes(docs.where("doc_id = 2"), "revise", "marks-1"))
    assert totals(store) == {("s", "en", "words-1"): (1, 3), (None, "fr", "words-1"): (1, 0), ("s", "en", "marks-1"): (1, 3)}
    gone = tc.changes(docs.where("doc_id <> 1").withColumn("doc_id", docs.doc_id), "delete")
    store.apply("three", gone.union(tc.changes(spark.createDataFrame([(77, "x", "s", "en", 0)], DOCS), "delete")))
    assert totals(store) == {("s", "en", "words-1"): (1, 3)}
    store.apply("four", tc.changes(docs.where("false"), "insert", "words-1"))
    store.apply("five", tc.changes(docs.where("doc_id = 2"), "insert", "words-1"))
    assert totals(store) == {("s", "en", "words-1"): (2, 5)}


def test_a_batch_that_was_lost_half_way_is_applied_again(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 0)], DOCS)
    store = tc.Rollup.fresh(spark)
    tc.changes(docs, "insert", "words-1").write.parquet(store._batch("one", "records"))  # no marker: not committed
    assert totals(store) == {}
    assert store.apply("one", tc.changes(docs, "insert", "words-1"))
    assert totals(store) == {("s", "en", "words-1"): (1, 3)}


def test_the_last_change_of_a_document_in_a_batch_holds(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 0)], DOCS)
    store = tc.Rollup.fresh(spark)
    store.apply("one", tc.changes(docs, "insert", "words-1", 1).union(tc.changes(docs, "delete", seq=2)).union(tc.changes(docs, "insert", "marks-1", 3)))
    assert totals(store) == {("s", "en", "marks-1"): (1, 3)}


def test_many_small_batches_read_back_only_their_buckets(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'a b' AS text", "'s' AS source", "'en' AS lang", "0 AS tokens")
    store = tc.Rollup.fresh(spark)
    store.apply("all of them", tc.changes(docs, "insert", "words-1"))
    for i in range(3):
        store.apply(f"n/{i}", tc.changes(docs.where(f"doc_id = {i}"), "delete"))
    assert store.committed() == ["all of them", "n/0", "n/1", "n/2"]
    assert totals(store) == {("s", "en", "words-1"): (297, 594)}
    plan = store._current(["all of them"], "n/2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1]
