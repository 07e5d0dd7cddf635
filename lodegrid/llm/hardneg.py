"""Hard negatives by an inverted multi-index.

Vectors are held as integers, floor(256 x), and a row's score is its inner product with the anchor. A vector is cut into
two halves, each with a codebook of its own; the two codes of a vector name its cell. For an anchor, the half-score of
a code is at most the anchor's half times the centroid plus its length times the code's radius, so the sum for two codes
bounds every score in the cell. A heap over the two sorted lists of half-scores visits cells in the order of that sum
(multi-sequence). A search stops when what is left cannot change its answer:

- positives: the next bound is below the worst of the best ``POSITIVES`` rows of the anchor's label found so far;
- negatives: for each positive, the next bound is below the window's floor or below the worst of the best ``NEGATIVES``
  rows of other labels inside the window.

So results are exact, and equal to comparing every anchor with every row.

How it is spread: cells are dealt to shards of a bounded number of rows, in one order of cells; a cell with more is
split by a hash of the row. Anchors are dealt to blocks of about ``BLOCK``, and each block meets the shards that its
anchors can need. A first bound on an anchor's answer comes from the sample on which the codebooks were fitted (its
rows are rows of the table), and cells below it are not sent for. Where vectors fill the space evenly no bound cuts
anything off, and every anchor is compared with every row, block by block; this is the case of the given tables.

Bounded: the sample (``SAMPLE`` rows, for codebooks and first bounds only; every row is indexed), ``CODES`` centroids per
half, the table of cells (``CODES`` squared), rows of a shard, anchors of a block, positives and negatives of an anchor.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part. Rows that are
equal in id, label and vector count once; different rows of one id are rows of their own, but never positives or
negatives of their own id. A shorter vector is continued with zeros. Ties go to the smaller id. Scores beyond 64 bits are
held to the largest or smallest 64-bit integer. An anchor without positives, or a positive without negatives in its window, gives no row.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.operators.ranking import best_per_key
from lodegrid.session import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these shares of the positive's, in hundredths.
WINDOW = (50, 95)
CODES = 16
SAMPLE = 8_192
SHARD = (2_048, 65_536)
SHARDS = 64
BLOCK = 8_192
_FIRST_ROWS = 256
_LARGEST = (1 << 63) - 1


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q: the rows that take part, once each."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), q.alias("q")).distinct()


def _matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of integers, continued with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which no inner product is rounded or overflows: doubles, 64-bit integers or Python's own."""
    top = int(np.abs(rows.astype(object)).max(initial=0)) * int(np.abs(anchors.astype(object)).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object
    return rows.astype(kind), anchors.astype(kind)


def _whole(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(s), -_LARGEST - 1), _LARGEST) for s in scores], np.int64)
    return scores.astype(np.int64)


class Codebooks:
    """Centroids of the two halves, fitted by k-means on a sample, in the sample's order."""

    def __init__(self, sample: np.ndarray, dim: int, codes: int = CODES, rounds: int = 12):
        self.dim, self.cut = dim, dim // 2
        self.centroids = [self._fit(half, codes, rounds) for half in self.halves(sample.astype(np.float64))]

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, :self.cut], rows[:, self.cut:]

    @staticmethod
    def _fit(half: np.ndarray, codes: int, rounds: int) -> np.ndarray:
        found = np.unique(half, axis=0)
        found = found[np.linspace(0, len(found) - 1, min(codes, len(found))).astype(int)].copy() if len(found) else np.zeros((1, half.shape[1]))
        for _ in range(rounds):
            code = Codebooks.nearest(half, found)
            for k in np.unique(code):
                found[k] = half[code == k].mean(axis=0)
        return found

    @staticmethod
    def nearest(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return ((centroids ** 2).sum(axis=1) - 2 * half @ centroids.T).argmin(axis=1) if len(half) else np.zeros(0, int)

    def codes(self, rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes and distances to the centroid of both halves."""
        halves = self.halves(rows.astype(np.float64))
        found = [self.nearest(h, c) for h, c in zip(halves, self.centroids)]
        return found, [np.sqrt(((h - c[k]) ** 2).sum(axis=1)) for h, c, k in zip(halves, self.centroids, found)]

    def bounds(self, anchors: np.ndarray, radii: list[np.ndarray]) -> list[np.ndarray]:
        """Largest half-score of every code for every anchor, with room for rounding."""
        out = []
        for h, c, r in zip(self.halves(anchors.astype(np.float64)), self.centroids, radii):
            length = np.sqrt((h ** 2).sum(axis=1))[:, None]
            out.append((h @ c.T + length * r) + 1e-9 * (1 + length * (r + np.sqrt((c ** 2).sum(axis=1)))))
        return out


class Cells:
    """Rows of a shard in the order of their cells."""

    def __init__(self, books: Codebooks, q: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        codes, away = books.codes(q)
        cell = codes[0] * len(books.centroids[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.q, self.ids, self.labels = q[order], ids[order], labels[order]
        names, starts = np.unique(cell[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        self.at = {divmod(int(n), len(books.centroids[1])): (int(a), int(b)) for n, a, b in zip(names, starts, ends)}
        self.used = [np.unique(k) for k in codes]
        self.radii = [np.array([d[k == c].max() if (k == c).any() else 0.0 for c in range(len(table))]) for k, d, table in zip(codes, away, books.centroids)]

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows of cells in falling order of their bound, some cells at a time, each time with the bound of all that is left."""
        one, two = (u[np.argsort(-h[u], kind="stable")] for u, h in zip(self.used, (first, second)))
        heap, want, rows, size = [(-(first[one[0]] + second[two[0]]), 0, 0)], _FIRST_ROWS, [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-(first[one[i]] + second[two[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(first[one[i + 1]] + second[two[0]]), i + 1, 0))
            if span := self.at.get((int(one[i]), int(two[j]))):
                rows.append(np.arange(*span))
                size += span[1] - span[0]
            if rows and (size >= want or not heap):
                yield np.concatenate(rows), -heap[0][0] if heap else -np.inf
                want, rows, size = 2 * want, [], 0


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:keep]
    return scores[order], ids[order]


def positives_in(cells: Cells, q: np.ndarray, anchor: np.ndarray, vec_id: int, label: int, halves: tuple, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the best rows of the anchor's label. ``floor``: a score that enough rows are known to reach."""
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, left in cells.visit(*halves):
        rows = rows[(cells.labels[rows] == label) & (cells.ids[rows] != vec_id)]
        scores, ids = _best(np.concatenate([scores, _whole(q[rows] @ anchor)]), np.concatenate([ids, cells.ids[rows]]), POSITIVES)
        if (len(scores) == POSITIVES and left < scores[-1]) or (floor is not None and left < floor):
            break
    return scores, ids


def limits(score: int) -> tuple[int, int]:
    """Lowest and highest score of a negative beside a positive of this score."""
    return -(-WINDOW[0] * score // 100), WINDOW[1] * score // 100


def negatives_in(cells: Cells, q: np.ndarray, anchor: np.ndarray, vec_id: int, label: int, halves: tuple, windows: list[tuple[int, int, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of the best rows of other labels in each window (lowest, highest, a score that enough rows reach)."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    for rows, left in cells.visit(*halves):
        rows = rows[(cells.labels[rows] != label) & (cells.ids[rows] != vec_id)]
        scores, ids, open_ = _whole(q[rows] @ anchor), cells.ids[rows], False
        for k, (low, high, floor) in enumerate(windows):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                found[k] = _best(np.concatenate([found[k][0], scores[inside]]), np.concatenate([found[k][1], ids[inside]]), NEGATIVES)
            certain = left < low or left < floor or (len(found[k][0]) == NEGATIVES and left < found[k][0][-1])
            open_ |= not certain and low <= high
        if not open_:
            break
    return found


class Index:
    """Codebooks, radii, the table of cells and the stored rows with their shard."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows = materialise(rows, "vectors")
        size = self.rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dim")).first()
        self.n, self.dim = size["n"], max(2, size["dim"])
        sample = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "q").limit(SAMPLE).toArrow()
        self.sample = (_matrix(sample.column("q"), self.dim), sample.column("vec_id").to_numpy(), sample.column("label").to_numpy())
        self.books = books = Codebooks(self.sample[0], self.dim)
        dim = self.dim

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (one, two), (near, far) = books.codes(_matrix(batch.column("q"), dim))
                added = [pa.array(x) for x in (one.astype(np.int32), two.astype(np.int32), near, far)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "one", "two", "near", "far"])

        schema = "vec_id bigint, label bigint, q array<bigint>, one int, two int, near double, far double"
        table = materialise(self.rows.mapInArrow(coded, schema), "coded")
        cells = table.groupBy("one", "two").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("far").alias("far")).orderBy("one", "two").collect()
        self.radii = [np.zeros(len(c)) for c in books.centroids]
        for r in cells:
            self.radii[0][r["one"]] = max(self.radii[0][r["one"]], r["near"])
            self.radii[1][r["two"]] = max(self.radii[1][r["two"]], r["far"])
        self.cells, self.shards = self._deal(cells)
        places = spark.createDataFrame(self.cells, "one int, two int, first int, pieces int")
        placed = table.join(F.broadcast(places), ["one", "two"])
        shard = (F.col("first") + F.pmod(F.xxhash64("vec_id", "q"), F.col("pieces"))).cast("int")
        self.table = placed.select("vec_id", "label", "q", shard.alias("shard"))

    def _deal(self, cells: list) -> tuple[list[tuple[int, int, int, int]], int]:
        """(one, two, first shard, shards) of each cell: small cells together, large ones split."""
        room = min(max(self.n // SHARDS, SHARD[0]), SHARD[1])
        out, shard, used = [], 0, 0
        for r in cells:
            pieces = -(-r["n"] // room)
            if used and used + r["n"] > room:
                shard, used = shard + 1, 0
            out.append((r["one"], r["two"], shard, pieces))
            used += r["n"]
            if pieces > 1:
                shard, used = shard + pieces, 0
        return out, shard + (used > 0)

    def search(self, anchors: DataFrame, what: str) -> DataFrame:
        """Answers of all shards to anchors (a, vec_id, label, q, and for negatives ids and scores of their positives)."""
        books, radii, dim, sample, cells = self.books, self.radii, self.dim, self.sample, np.array(self.cells).reshape(-1, 4)
        wanted = NEGATIVES if what == "negatives" else POSITIVES

        def floors_of(scores: np.ndarray, near: np.ndarray, windows: list[tuple[int, int]] | None) -> list[float]:
            """A score that enough rows of the sample reach, per window; minus infinity where there are too few."""
            chosen = [scores[near]] if windows is None else [scores[near & (scores >= low) & (scores <= high)] for low, high in windows]
            return [float(np.partition(s, -wanted)[-wanted]) if len(s) >= wanted else -np.inf for s in chosen]

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Anchors with their floors and the shards that they can need."""
            for batch in batches:
                q, ids, labels = _matrix(batch.column("q"), dim), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                rows, exact = _exact(sample[0], q)
                first, second = books.bounds(q, radii)
                scores_of = batch.column("scores").to_pylist() if what == "negatives" else [None] * len(q)
                floors, shards = [], []
                for i in range(len(q)):
                    scores, same = _whole(rows @ exact[i]), sample[2] == labels[i]
                    windows = [limits(s) for s in scores_of[i]] if what == "negatives" else None
                    near = (~same if what == "negatives" else same) & (sample[1] != ids[i])
                    floor = floors_of(scores, near, windows)
                    least = floor[0] if windows is None else min((max(f, low) for f, (low, high) in zip(floor, windows) if low <= high), default=np.inf)
                    reach = cells[first[i][cells[:, 0]] + second[i][cells[:, 1]] >= least]
                    floors.append(floor)
                    shards.append(sorted({int(s) for c in reach for s in range(c[2], c[2] + c[3])}))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.list_(pa.float64())), pa.array(shards, pa.list_(pa.int32()))],
                                                 [*batch.schema.names, "floors", "shards"])

        def answers(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if index.num_rows and asked.num_rows:
                whole = _matrix(index.column("q"), dim)
                inside = Cells(books, whole, index.column("vec_id").to_numpy(), index.column("label").to_numpy())
                anchors_ = _matrix(asked.column("q"), dim)
                q, exact = _exact(inside.q, anchors_)
                first, second = books.bounds(anchors_, inside.radii)
                floors = asked.column("floors").to_pylist()
                lists = asked.column("scores").to_pylist() if what == "negatives" else None
                names = zip(asked.column("a").to_pylist(), asked.column("vec_id").to_pylist(), asked.column("label").to_pylist())
                for i, (a, vec_id, label) in enumerate(names):
                    halves = (first[i], second[i])
                    if lists is None:
                        found = [positives_in(inside, q, exact[i], vec_id, label, halves, floors[i][0])]
                    else:
                        windows = [(*limits(s), f) for s, f in zip(lists[i], floors[i])]
                        found = negatives_in(inside, q, exact[i], vec_id, label, halves, windows)
                    for k, (scores, ids) in enumerate(found):
                        for column, more in zip(out, ([a] * len(ids), [k] * len(ids), ids.tolist(), scores.tolist())):
                            column.extend(more)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["a", "k", "found_id", "score"])

        blocks = max(1, -(-anchors.count() // BLOCK))
        more = ", scores array<bigint>" if what == "negatives" else ""
        schema = f"a bigint, vec_id bigint, label bigint, q array<bigint>{more}, floors array<double>, shards array<int>"
        asked = anchors.mapInArrow(routed, schema).withColumn("shard", F.explode("shards")).drop("shards")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
        index = self.table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
        found = met.applyInArrow(answers, "a bigint, k int, found_id bigint, score bigint")
        return best_per_key(found, ["a", "k"], [F.col("score").desc(), F.col("found_id")], wanted)


def mine(vectors: DataFrame, anchors: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` tells which rows ask.

    ``vectors`` has vec_id, label and embedding. The positives of an anchor are its best ``POSITIVES`` other rows of
    its label; for each, the best ``NEGATIVES`` rows of other labels whose score lies in the window are returned.
    """
    index = Index(prepared(vectors))
    asking = materialise(index.rows.where(anchors).withColumn("a", F.monotonically_increasing_id()).select("a", "vec_id", "label", "q"), "anchors")
    positives = materialise(index.search(asking, "positives").select("a", "place", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most POSITIVES per anchor, in the order of their place.
    listed = positives.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    second = materialise(asking.join(listed.select("a", F.col("p.positive_score").alias("scores")), "a"), "asked-again")
    negatives = index.search(second, "negatives").withColumn("_p", F.col("k") + 1)
    out = negatives.join(positives.withColumnRenamed("place", "_p"), ["a", "_p"]).join(asking.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))
