"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder of Parquet files. A batch of changes (inserts, deletes, revised counts) is turned into signed
records: a delete takes away what its document last added, a revision takes that away and adds the new count. The
records are summed per (source, lang, tokenizer) into the batch's delta, and totals are the sum of the deltas of
committed batches. Records lie in ``BUCKETS`` buckets of documents; a commit reads back the buckets that its own
documents fall in, and of those only records of its documents go on to be merged, so what is shuffled is what
the batch holds and not what the store holds.

A batch writes its records and its delta under its own name and commits by writing its marker last, whose name holds its
place among the commits. Applying a
committed batch again does nothing; a batch that was lost half-way is simply applied again and overwrites its own
leftovers. Readers see committed batches only. One writer at a time is assumed.

Hot sources are no hot tasks: changes meet the store by document, and totals are summed in every task before the
shuffle.

Defined results: a null text has no tokens and still counts as a document; null source and lang are groups of their
own; deleting or revising an unknown document adds nothing or just the new count; of several changes of a document
in one batch the last one (by ``seq``, ties by the record itself) holds; documents without id are told apart by
nothing and count as one; an empty batch commits an empty delta; extra columns are ignored.
"""
from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.session import scratch_path

KEYS = ["source", "lang", "tokenizer"]
BUCKETS = 32
_RECORD = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, place bigint"
_DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

#: Tokenizer versions: the number of matches of a pattern that reads alike in every regular expression engine.
PATTERNS = {"words-1": r"[^ \t\n\x0B\f\r]+", "marks-1": r"\p{L}+|\p{N}+|[^ \t\n\x0B\f\r\p{L}\p{N}]+"}


def counted(version: str) -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(PATTERNS[version])).cast("bigint")


class Rollup:
    """A store of token counts in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def fresh(cls, spark: SparkSession) -> Rollup:
        return cls(spark, scratch_path(spark, "token-counts"))

    def _batch(self, batch: str, part: str) -> str:
        # Records of all batches are one table, parted by batch and bucket.
        name = quote(batch, safe="")
        return f"{self.path}/records/batch={name}" if part == "records" else f"{self.path}/{name}/{part}"

    def committed(self) -> list[str]:
        """Names of committed batches in the order of their commits."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "/*/committed-*/_SUCCESS")) or []
        markers = [f.getPath().getParent() for f in found]
        return [name for _, name in sorted((int(m.getName().split("-")[1]), unquote(m.getParent().getName())) for m in markers)]

    def _current(self, batches: list[str], batch: str) -> DataFrame:
        """Latest record of each document of ``batch`` in earlier batches; deleted documents have a null tokenizer."""
        touched = self._records([batch]).select(F.col("doc_id").alias("_doc"), "bucket")
        buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # ``BUCKETS`` at most
        rows = self._records(batches).where(F.col("bucket").isin(buckets))
        rows = rows.join(touched.select("_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(k) for k in [*KEYS, "tokens"]]), "place").alias("old"))

    def _records(self, batches: list[str]) -> DataFrame:
        rows = self.spark.read.schema(f"{_RECORD}, batch string, bucket int").parquet(f"{self.path}/records")
        return rows.where(F.col("batch").isin(batches)).drop("batch")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (doc_id, op, source, lang, tokenizer, tokens, seq); op is insert, revise or delete.

        Returns False, and does nothing, where the batch is already committed.
        """
        done = self.committed()
        if batch in done:
            return False
        last = F.max_by(F.struct("op", *KEYS, "tokens"), F.struct("seq", "op", *KEYS, "tokens"))
        new = changes.groupBy("doc_id").agg(last.alias("new"))
        here = F.col("new.op") != "delete"
        fields = [F.when(here, F.col(f"new.{k}")).alias(k) for k in [*KEYS, "tokens"]]
        records = new.select("doc_id", *fields, F.lit(len(done)).cast("bigint").alias("place"))
        records = records.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        records.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._batch(batch, "records"))
        added = self._records([batch]).where("tokenizer IS NOT NULL").select(*KEYS, F.lit(1).alias("sign"), "tokens")
        signed = added
        if done:
            taken = self._current(done, batch).where("old.tokenizer IS NOT NULL")
            signed = added.union(taken.select(*[f"old.{k}" for k in KEYS], F.lit(-1), "old.tokens"))
        delta = signed.groupBy(*KEYS).agg(
            F.sum("sign").cast("bigint").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(self._batch(batch, "delta"))
        mark = self.spark.range(1).toDF("committed")
        mark.coalesce(1).write.mode("overwrite").parquet(self._batch(batch, f"committed-{len(done)}"))
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of committed batches; groups that are empty again are left out."""
        paths = [self._batch(b, "delta") for b in self.committed()]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


def changes(docs: DataFrame, op: str, version: str | None = None, seq: int = 0) -> DataFrame:
    """Changes of all rows of ``docs``, counted with a tokenizer version (none for deletes)."""
    tokens = counted(version) if version else F.lit(None).cast("bigint")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(op).alias("op"), "source", "lang",
        F.lit(version).cast("string").alias("tokenizer"), tokens.alias("tokens"), F.lit(seq).alias("seq"))
