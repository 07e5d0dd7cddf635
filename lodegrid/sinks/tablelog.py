"""A table of keyed rows that changes by whole commits: a log of manifests over data files that are never changed.

A commit writes its data to a new folder and then one manifest, a single small file whose rename is the switch: before
it readers see the version before, after it the whole new one, data and meta alike. A job lost between any two writes
leaves files that no manifest names. Changes are delta files, merged when read; after ``MOST_DELTAS`` of them the parts
that they touch are compacted, so a read never meets more. A manifest names the current file of every part, the
deltas since then and the meta rows, so only the newest one is needed.

Reading and committing use Spark's readers and writers only. One writer at a time is assumed.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.operators.records import latest_version

MOST_DELTAS = 8
#: Parts of a table that is not parted by a column of its own.
PARTS = 16
#: Versions whose files ``vacuum`` leaves, for readers that are still at work.
KEPT_VERSIONS = 2
_ENTRY = "version bigint, kind string, name string, value string"


@dataclass
class Manifest:
    """What a version is made of: the file of each part, deltas in order, meta rows, and how rows are keyed."""

    version: int = 0
    base: dict[str, str] = field(default_factory=dict)
    deltas: dict[str, list[str]] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)
    about: dict[str, str] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        out = [("base", part, file) for part, file in self.base.items()]
        out += [("delta", file, json.dumps(parts)) for file, parts in self.deltas.items()]
        out += [("meta", k, v) for k, v in self.meta.items()] + [("about", k, v) for k, v in self.about.items()]
        return [(self.version, *r) for r in out or [("about", "", "")]]

    def files(self) -> set[str]:
        return {*self.base.values(), *self.deltas}


class TableLog:
    """``keys`` name a row; of rows of one key the newest by ``order`` stays, and of equally new ones the one committed last.

    ``part`` is one of the keys; without it rows are dealt by a hash of their keys. Parts are the unit of compaction.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] = (), order: list[str] = (), part: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.keys, self.order, self.part = list(keys), list(order), part

    # --- manifests ------------------------------------------------------------------------------
    def manifests(self, last: int = 1) -> list[Manifest]:
        """The newest versions, newest first; none before the first commit."""
        log = self.spark.read.schema(_ENTRY)
        try:
            entries = log.json(f"{self.path}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        # A manifest is as long as the table has parts, deltas and meta rows.
        newest = [r[0] for r in entries.select("version").distinct().orderBy(F.desc("version")).limit(last).collect()]
        found = {v: Manifest(v) for v in newest}
        for r in entries.where(F.col("version").isin(newest)).collect() if newest else []:
            m = found[r["version"]]
            if r["kind"] == "delta":
                m.deltas[r["name"]] = json.loads(r["value"])
            elif r["name"]:
                getattr(m, r["kind"])[r["name"]] = r["value"]
        for m in found.values():
            m.deltas = dict(sorted(m.deltas.items()))
        return [found[v] for v in newest]

    def current(self) -> Manifest:
        return next(iter(self.manifests()), Manifest())

    def _commit(self, manifest: Manifest) -> None:
        self.spark.createDataFrame(manifest.rows(), _ENTRY).coalesce(1).write.mode("append").json(f"{self.path}/log")

    # --- data -----------------------------------------------------------------------------------
    def _parted(self, rows: DataFrame) -> DataFrame:
        part = F.col(self.part).cast("string") if self.part else F.pmod(F.xxhash64(*(self.keys or rows.columns)), F.lit(PARTS)).cast("string")
        return rows.select(*self.schema.names).withColumn("_part", F.coalesce(F.concat(F.lit("p"), part), F.lit("n")))

    def _write(self, rows: DataFrame, version: int) -> tuple[str, list[str]]:
        """A new file, named so that names sort by version, and the parts in it."""
        file = f"v{version:012d}-{uuid.uuid4().hex}"
        rows.write.partitionBy("_part").parquet(f"{self.path}/data/{file}")
        parts = sorted(r[0] for r in self._read(file).select("_part").distinct().collect())
        return file, parts

    def _read(self, file: str) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_part", T.StringType())])
        return self.spark.read.schema(stored).parquet(f"{self.path}/data/{file}")

    def _merged(self, manifest: Manifest, parts: list[str] | None = None) -> DataFrame:
        """Rows of a version, of some parts only if wanted, with their part."""
        files: dict[str, list[str]] = {}
        for part, file in manifest.base.items():
            if parts is None or part in parts:
                files.setdefault(file, []).append(part)
        pieces = [(0, self._read(f).where(F.col("_part").isin(p))) for f, p in files.items()]
        for i, (file, held) in enumerate(manifest.deltas.items(), 1):
            if parts is None or set(held) & set(parts):
                delta = self._read(file)
                pieces.append((i, delta if parts is None else delta.where(F.col("_part").isin(parts))))
        if not pieces:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_part", T.StringType())]))
        every = pieces[0][1].withColumn("_at", F.lit(pieces[0][0]))
        for i, piece in pieces[1:]:
            every = every.unionByName(piece.withColumn("_at", F.lit(i)))
        if any(i for i, _ in pieces):
            every = latest_version(every, [*self.keys, "_part"], [*self.order, "_at"])
        return every.drop("_at").select(*self.schema.names, "_part")

    # --- what users call ------------------------------------------------------------------------
    def read(self, parts: list[str | None] | None = None) -> DataFrame:
        """Rows of the newest version, of some parts only if wanted. Empty before the first commit."""
        # Stored names begin with a letter, as a folder's name can be neither empty nor missing.
        named = None if parts is None else ["n" if p is None else f"p{p}" for p in parts]
        return self._merged(self.current(), named).select(*self.schema.names)

    def meta(self) -> DataFrame:
        """key, value rows committed with the newest version."""
        return self.spark.createDataFrame(sorted(self.current().meta.items()), "key string, value string")

    def publish(self, rows: DataFrame, meta: dict[str, object]) -> None:
        """The whole table and its meta rows, in one switch."""
        now = self.current()
        file, parts = self._write(self._parted(rows), now.version + 1)
        self._commit(Manifest(now.version + 1, dict.fromkeys(parts, file), {}, {k: str(v) for k, v in meta.items()}, now.about))

    def merge(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Rows laid over the table by key. A ``batch`` (source, number) that has been committed before does nothing."""
        now = self.current()
        if batch and int(now.about.get(batch[0], -1)) >= batch[1]:
            return
        file, parts = self._write(self._parted(latest_version(rows, self.keys, self.order)), now.version + 1)
        about = {**now.about, batch[0]: str(batch[1])} if batch else now.about
        deltas = {**now.deltas, file: parts} if parts else now.deltas
        self._commit(Manifest(now.version + 1, now.base, deltas, now.meta, about))
        if len(deltas) > MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Parts that deltas touch become files of their own; the others stay as they are."""
        now = self.current()
        touched = sorted({p for parts in now.deltas.values() for p in parts})
        if not touched:
            return
        file, parts = self._write(self._merged(now, touched), now.version + 1)
        self._commit(Manifest(now.version + 1, {**now.base, **dict.fromkeys(parts, file)}, {}, now.meta, now.about))

    def vacuum(self) -> int:
        """Data files that none of the last ``KEPT_VERSIONS`` manifests name go, left-overs of lost jobs too; how many.

        Manifests before those go as well. Spark has no call that deletes, so this one asks the file system itself and
        needs a classic session.
        """
        kept = self.manifests(KEPT_VERSIONS)
        named = {f for m in kept for f in m.files()}
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        store = at(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        gone = 0
        for status in store.globStatus(at(f"{self.path}/data/*")) or []:
            if status.getPath().getName() not in named:
                store.delete(status.getPath(), True)
                gone += 1
        # Whole files of the log hold one version each; those of older versions are not read any more.
        oldest = min((m.version for m in kept), default=0)
        old = self.spark.read.schema(_ENTRY).json(f"{self.path}/log").where(F.col("version") < oldest).select(F.col("_metadata.file_path")).distinct()
        for r in old.collect():
            store.delete(at(r[0]), False)
        return gone
