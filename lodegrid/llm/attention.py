"""Language-model scores: a causal self-attention model over subword ids, in numpy, with word counts of the corpus.

Subwords come from a public byte-level vocabulary: of its first ranks those whose beginnings are subwords too, so a word
is cut greedily by walking a trie, for all distinct words of a chunk at once. Every subword has two ids, inside a word and at
its end; one more id ends a text. The model has one layer of one head, of fixed size. It is trained by backpropagation on
every learning document, once, in ``ROUNDS`` rounds: documents are dealt to rounds by hash; in a round each task goes on
from the model of the round before over its own texts, a chunk at a time, and the models of the tasks are added up in
groups of ``FAN`` until one is left. What belongs to one id or branch is averaged over the tasks that saw it, by how
often they did, so that what only a few files hold is not thinned by the others. How tasks are cut changes the model a
little. The output is a softmax in as many steps as ``SIDES`` has, branch by branch down to the id, so a token costs a few
short rows and not the whole vocabulary.

Texts are scored in overlapping windows of ``WINDOW`` ids: each window scores the last ``STRIDE`` of them, with the ones
before as context only, so every id is scored once. Windows are batched; attention is masked to what came before.

A word that was learned has half the probability that the model's subwords give it and half its share among all learning
words, less u, the share of words seen once, the usual estimate of what is new. A word that was not has (1 + u) / 2 of
what the model gives it. With P the model's mass on learned words that adds up to 1 - uP / 2, so never to over 1.

Counts cover the whole corpus and never meet in one place. Documents are dealt by hash into blocks of about
``BLOCK`` bytes; a block asks for the counts of its distinct words by a join on the word, and gets them back
as rows beside its documents. A frequent word is one row per block on one side and one row on the other.

Defined results: a null or empty text is its end alone; repeated rows are scored each; rows without doc_id are scored
and not learned from; with nothing to learn from, all counts are 0 and the model is untrained; extra columns are ignored.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.llm import text as T
from lodegrid.llm.bpe import Vocabulary
from lodegrid.session import materialise

#: Rounds of training; models that are added up in one task, and how often before the last sum.
ROUNDS, FAN, LEVELS = 4, 32, 2
BLOCK = 16 << 20
RANKS, SUBWORDS = 6_000, 2_047
#: Branches at each step of the output; together at least as many leaves as ids.
SIDES = (8, 16, 32)
WIDTH, INNER, WINDOW, STRIDE = 16, 24, 24, 18
BATCH, RATE = 320, 3e-2
#: Windows that are scored at once.
AT_ONCE = 1024
END = 2 * SUBWORDS
#: The end of a text among the hashes of words.
END_WORD = np.uint64(0xE0F)
_PAD = WINDOW - STRIDE
_LN10 = float(np.log(10))


class Subwords:
    """Trie of subwords with every beginning of a subword in it."""

    def __init__(self, vocabulary: Vocabulary):
        known = {bytes([b]): b for b in range(256)}
        for token in vocabulary.tokens:
            if len(known) < SUBWORDS and len(token) > 1 and token[:-1] in known and not token[:1].isspace():
                known[token] = len(known)
        # Neighbours in the alphabet get neighbouring ids, so that classes of the output hold like subwords.
        order = {t: i for i, t in enumerate(sorted(known))}
        self.first = np.array([order[bytes([b])] for b in range(256)], np.int32)
        self.next = np.full((SUBWORDS, 256), -1, np.int16)
        for token, i in order.items():
            if len(token) > 1:
                self.next[order[token[:-1]], token[-1]] = i

    def spelled(self, words: T.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words of a chunk, given in the order of their places, in a row, and the number of ids of each."""
        data = np.frombuffer(words.blob + b" ", np.uint8)
        marks = np.zeros(len(data), np.int16)  # 1 + id, where a subword has its last byte
        starts, ends = words.starts[which], words.ends[which]
        at, left = starts, ends - starts
        node = self.first[data[at]] if len(at) else np.zeros(0, np.int32)
        while len(at):
            done = left == 1
            marks[at[done]] = 2 * node[done] + 2
            at, left, node = at[~done], left[~done] - 1, node[~done]
            byte = data[at + 1]
            child = self.next[node, byte].astype(np.int32)
            stop = child < 0
            marks[at[stop]] = 2 * node[stop] + 1
            node = np.where(stop, self.first[byte], child)
            at = at + 1
        there = np.flatnonzero(marks)
        return marks[there].astype(np.int32) - 1, np.searchsorted(there, ends) - np.searchsorted(there, starts)

    def cut(self, texts: list[bytes | None]) -> tuple[T.Words, np.ndarray, np.ndarray]:
        """Words of a chunk, its ids in a row (each text followed by END), and the number of ids of each text."""
        words = T.words_of(texts, T.BLANK_SEPARATED)
        _, ids, size = self.tokens(words, words.hashes())
        bounds = np.concatenate([[0], np.cumsum(size)])
        return words, ids, np.diff(bounds[np.concatenate([[0], np.cumsum(words.per_doc + 1)])])

    def tokens(self, words: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a chunk's tokens (words, and after each text its end), their ids in a row, and the number of ids of each token.

        A word that comes again in the chunk is cut once.
        """
        number, first = _distinct(hashes)
        flat, size = self.spelled(words, first)
        flat, size = np.append(flat, np.int32(END)), np.append(size, 1)
        inner = np.ones(len(hashes) + len(words.per_doc), bool)
        inner[np.cumsum(words.per_doc + 1) - 1] = False
        tokens, word = np.full(len(inner), END_WORD), np.full(len(inner), len(size) - 1)
        tokens[inner], word[inner] = hashes, number
        size, begin = size[word], (np.cumsum(size) - size)[word]
        return tokens, flat[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)], size


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every word among the distinct ones in the order of their first places, and these places."""
    number = pa.array(hashes).dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(number > np.concatenate([[-1], np.maximum.accumulate(number)[:-1]])) if len(number) else np.zeros(0, np.int64)
    return number, first


def windows(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (one row per window), which rows begin a text, and the row and column at which each id is predicted.

    Columns are counted from the end of the context.
    """
    begin = np.cumsum(counts) - counts
    per = -(-counts // STRIDE)
    row0 = np.cumsum(per) - per
    place = np.arange(len(ids)) - np.repeat(begin, counts)
    row = np.repeat(row0, counts) + place // STRIDE
    inputs = np.full((per.sum(), WINDOW), END, np.int32)
    shifted = np.concatenate([[END], ids[:-1]])
    shifted[begin] = END
    column = place % STRIDE
    inputs[row, _PAD + column] = shifted
    # The tail of each window is the context of the next one of the same text.
    first = np.zeros(len(inputs), bool)
    first[row0] = True
    later = np.flatnonzero(~first)
    inputs[later, :_PAD] = inputs[later - 1, WINDOW - _PAD:]
    return inputs, first, row, column


#: Largest logit of each place of a window: a cap for the context and what precedes it, next to no weight for the rest; in the
#: first window of a text there is no context.
_CAUSAL = np.where(np.tril(np.ones((STRIDE, WINDOW), bool), _PAD), 60, -1e9).astype(np.float32)
_FIRST = _CAUSAL.copy()
_FIRST[:, :_PAD] = -1e9


_SCALE = np.float32(WIDTH**-0.5)
_LEAVES = int(np.prod(SIDES))
#: Of each step: the nodes, the leaves below one branch, the columns of its logits; and which column belongs to which step.
_NODES = [int(np.prod(SIDES[:i])) for i in range(len(SIDES))]
_BELOW = [int(np.prod(SIDES[i + 1:])) for i in range(len(SIDES))]
_COLUMNS = [slice(sum(SIDES[:i]), sum(SIDES[:i + 1])) for i in range(len(SIDES))]
_STEPS = np.repeat(np.eye(len(SIDES), dtype=np.float32), SIDES, axis=0)
#: Columns of the branches that lead to each leaf; places of each id's row among the embeddings.
_BRANCHES = np.stack([at.start + np.arange(_LEAVES) // b % side for side, b, at in zip(SIDES, _BELOW, _COLUMNS, strict=True)], axis=1)
_CELLS = np.arange((END + 1) * WIDTH).reshape(END + 1, WIDTH)


class Model:
    """Parameters by name, float32."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        self.p = {
            "embed": (0.3 * rng.standard_normal((END + 1, WIDTH))).astype(np.float32), "place": np.zeros((WINDOW, WIDTH), np.float32),
            "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH), "o": 0.3 * normal(WIDTH, WIDTH),
            "up": normal(WIDTH, INNER), "down": 0.3 * normal(INNER, WIDTH),
            **{f"step{i}": 0.1 * normal(n, WIDTH + 1, side) for i, (n, side) in enumerate(zip(_NODES, SIDES, strict=True))},
        }

    def set_biases(self, ids: np.ndarray) -> None:
        """Start from the counts of ids."""
        self.set_counts(np.bincount(ids, minlength=END + 1))

    def set_counts(self, seen: np.ndarray) -> None:
        leaves = np.full(_LEAVES, 1e-9)
        leaves[:END + 1] = seen + 0.1
        for i, (n, side) in enumerate(zip(_NODES, SIDES, strict=True)):
            counts = leaves.reshape(n, side, -1).sum(axis=2)
            self.p[f"step{i}"][:, -1] = np.log(counts / counts.sum(axis=1, keepdims=True))

    def hidden(self, inputs: np.ndarray, first: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Output at the scored places, a row for each. Context places are looked at and do not look.

        Products with a matrix of parameters are taken over the places of all windows at once. Queries meet keys, and values
        the output, by the product of their matrices, so keys and values of the places need not be made.
        """
        p, n = self.p, len(inputs)
        x = p["embed"].take(inputs, axis=0)
        x += p["place"]
        own = x[:, _PAD:].reshape(-1, WIDTH)
        asked = (own @ (p["q"] @ p["k"].T * _SCALE)).reshape(n, STRIDE, WIDTH)
        a = asked @ x.transpose(0, 2, 1)
        np.minimum(a, _CAUSAL, out=a)
        begin = np.flatnonzero(first)
        a[begin] = np.minimum(a[begin], _FIRST)
        np.exp(a, out=a)
        total = a.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), a.dtype)
        mixed = (a @ x).reshape(-1, WIDTH)
        mixed /= total
        h = mixed @ (p["v"] @ p["o"])
        h += own
        u = h @ p["up"]
        np.maximum(u, 0, out=u)
        out = u @ p["down"]
        out += h
        if keep is not None:
            keep |= {"x": x, "own": own, "asked": asked, "a": a, "total": total, "mixed": mixed, "h": h, "u": u}
        return out

    def log10(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of every id."""
        out = np.zeros(len(ids))
        inputs, first, row, column = windows(ids, counts)
        place = row * STRIDE + column
        bounds = np.searchsorted(row, np.arange(0, len(inputs) + AT_ONCE, AT_ONCE))
        for n, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if i < j:
                a = n * AT_ONCE
                h = self.hidden(inputs[a:a + AT_ONCE], first[a:a + AT_ONCE])
                out[i:j] = self._log(h.take(place[i:j] - a * STRIDE, axis=0), ids[i:j])
        return out / _LN10

    def _logits(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of ids by their leaves; in it, the outputs (a 1 behind each, for the bias) and the logits of all steps side by side."""
        order = np.argsort(ids.astype(np.int16), kind="stable")
        hs = np.ones((len(ids), WIDTH + 1), h.dtype)
        hs[:, :-1] = h.take(order, axis=0)
        z = np.empty((len(ids), sum(SIDES)), h.dtype)
        for i, at, below in _paths(ids[order]):
            weights = self.p[f"step{i}"]
            for node, a, b in below:
                np.matmul(hs[a:b], weights[node], out=z[a:b, at])
        return order, hs, z

    def _log(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of the probability of ``ids`` after ``h``: the sum over the steps to each leaf."""
        order, _, z = self._logits(h, ids)
        taken = z[np.arange(len(z))[:, None], _BRANCHES.take(ids[order], axis=0)].sum(axis=1)
        out = np.empty(len(ids), h.dtype)
        top, total = _exp(z)
        out[order] = taken - np.log(total).sum(axis=1) - top
        return out

    def gradients(self, inputs: np.ndarray, first: np.ndarray, row: np.ndarray, column: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss over ``ids``, predicted at (row, column)."""
        p, s, n = self.p, {}, len(inputs)
        out, place = self.hidden(inputs, first, s), row * STRIDE + column
        g = {k: np.zeros_like(v) for k, v in p.items() if k.startswith("step")}
        order, hs, z = self._logits(out.take(place, axis=0), ids)
        _, total = _exp(z)
        z *= (1 / (total * len(ids))) @ _STEPS.T.astype(z.dtype)
        z[np.arange(len(z))[:, None], _BRANCHES.take(ids[order], axis=0)] -= z.dtype.type(1 / len(ids))
        dh, part = np.zeros((2, len(ids), WIDTH), z.dtype)
        for i, at, below in _paths(ids[order]):
            weights, slopes = p[f"step{i}"][:, :-1], g[f"step{i}"]
            for node, a, b in below:
                np.matmul(hs[a:b].T, z[a:b, at], out=slopes[node])
                np.matmul(z[a:b, at], weights[node].T, out=part[a:b])
            dh += part
        d = np.zeros_like(out)
        d[place[order]] = dh
        g["down"] = s["u"].T @ d
        du = d @ p["down"].T
        du *= s["u"] > 0
        g["up"] = s["h"].T @ du
        d += du @ p["up"].T
        both = s["mixed"].T @ d
        g["v"], g["o"] = both @ p["o"].T, p["v"].T @ both
        # The softmax of attention: its weights are a / total, the mean of their slopes is dm by mixed.
        wide = lambda m: m.reshape(n, STRIDE, WIDTH)
        dm = d @ (p["v"] @ p["o"]).T
        dm /= s["total"]
        mean = (dm * s["mixed"]) @ np.ones((WIDTH, 1), d.dtype)
        da = wide(dm) @ s["x"].transpose(0, 2, 1)
        da -= mean.reshape(n, STRIDE, 1)
        da *= s["a"]
        dasked = (da @ s["x"]).reshape(-1, WIDTH)
        both = s["own"].T @ dasked * _SCALE
        g["q"], g["k"] = both @ p["k"], both.T @ p["q"]
        d += dasked @ (p["q"] @ p["k"].T * _SCALE).T
        dx = da.transpose(0, 2, 1) @ s["asked"]
        dx += s["a"].transpose(0, 2, 1) @ wide(dm)
        dx[:, _PAD:] += wide(d)
        g["place"] = dx.sum(axis=0)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"].reshape(-1), _CELLS.take(inputs, axis=0).reshape(-1), dx.reshape(-1))  # far faster than rows at once
        return g

    def train(self, ids: np.ndarray, counts: np.ndarray, seed: int = 4) -> None:
        """One pass of Adam over the windows in random order, the step falling to nothing."""
        if not len(ids):
            return
        self.set_biases(ids)
        steps = -(-int((-(-counts // STRIDE)).sum()) // BATCH)
        self.descend(ids, counts, self.moments(), lambda t: min(1, t / 20) * (1 - (t - 1) / steps), seed)

    def moments(self) -> dict:
        size = sum(v.size for v in self.p.values())
        return {"t": 0, "mean": np.zeros(size, np.float32), "square": np.zeros(size, np.float32)}

    def descend(self, ids: np.ndarray, counts: np.ndarray, state: dict, pace: Callable[[int], float], seed: int = 4) -> None:
        """Adam over the windows in random order, going on from the moments in ``state``."""
        inputs, first, row, column = windows(ids, counts)
        starts = np.searchsorted(row, np.arange(len(inputs) + 1))
        order = np.random.default_rng(seed).permutation(len(inputs))
        # All parameters in a row, of which those by name are views.
        whole = np.concatenate([v.ravel() for v in self.p.values()])
        bounds = np.cumsum([0, *(v.size for v in self.p.values())])
        self.p = {k: whole[a:b].reshape(v.shape) for (k, v), a, b in zip(self.p.items(), bounds[:-1], bounds[1:], strict=True)}
        mean, square, slope, step = state["mean"], state["square"], np.empty_like(whole), np.empty_like(whole)
        for i in range(0, len(order), BATCH):
            chosen = order[i:i + BATCH]
            size = starts[chosen + 1] - starts[chosen]
            local = np.repeat(np.arange(len(chosen)), size)
            own = np.arange(len(local)) + np.repeat(starts[chosen] - (np.cumsum(size) - size), size)
            g = self.gradients(inputs[chosen], first[chosen], local, column[own], ids[own])
            np.concatenate([g[k].ravel() for k in self.p], out=slope)
            state["t"] += 1
            t, rate = state["t"], RATE * pace(state["t"])
            mean *= np.float32(0.9)
            mean += np.multiply(slope, np.float32(0.1), out=step)
            square *= np.float32(0.98)
            slope *= slope
            square += np.multiply(slope, np.float32(0.02), out=step)
            np.sqrt(np.multiply(square, np.float32(1 / (1 - 0.98**t)), out=step), out=step)
            step += np.float32(1e-6)
            np.divide(mean, step, out=step)
            step *= np.float32(rate / (1 - 0.9**t))
            whole -= step


def _exp(z: np.ndarray) -> tuple[np.ndarray | int, np.ndarray]:
    """Logits of all steps become exponentials, in place; the logs taken off each row beforehand, and the sum of each step."""
    top = 0
    if z.max(initial=0) > 80 or z.min(initial=0) < -80:  # near the range of exp in single precision
        highest = np.maximum.reduceat(z, [at.start for at in _COLUMNS], axis=1)
        z -= highest @ _STEPS.T.astype(z.dtype)
        top = highest.sum(axis=1)
    np.exp(z, out=z)
    return top, z @ _STEPS.astype(z.dtype)


def _paths(ids: np.ndarray) -> Iterator[tuple[int, slice, list[tuple[int, int, int]]]]:
    """Every step, the columns of its logits, and its nodes on the way to sorted leaves: number, and which leaves lie below (from, to)."""
    for i, (n, at) in enumerate(zip(_NODES, _COLUMNS, strict=True)):
        bounds = np.searchsorted(ids, np.arange(n + 1) * (_LEAVES // n)).tolist()
        yield i, at, [(node, a, b) for node, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]


def _counts(shared: Broadcast) -> Callable:
    """Counts of words (and ends) in every batch, and of subword ids in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(END + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [np.full(len(texts), END_WORD)]
            seen[END] += len(texts)
            for a, b in T.chunks(texts):
                words = T.words_of(texts[a:b], T.BLANK_SEPARATED)
                found.append(words.hashes())
                number, first = _distinct(found[-1])
                ids, size = shared.value.spelled(words, first)
                seen += np.bincount(ids, np.repeat(np.bincount(number, minlength=len(first)), size), END + 1).astype(np.int64)
            words, n = np.unique(np.concatenate(found), return_counts=True)
            yield _count_rows(words.view(np.int64), n, False)
        there = np.flatnonzero(seen)
        yield _count_rows(there, seen[there], True)

    return run


def _count_rows(word: np.ndarray, n: np.ndarray, subword: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n), pa.array(np.full(len(word), subword))], ["word", "n", "subword"])


def counts(texts: DataFrame, subwords: Subwords) -> DataFrame:
    """How often every word (by its hash) and every subword (by its id) occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(subwords)
    found = texts.select("text").mapInArrow(_counts(shared), "word bigint, n bigint, subword boolean")
    return found.groupBy("word", "subword").agg(F.sum("n").alias("n"))


def _learned_from(docs: DataFrame, learn: Column) -> DataFrame:
    return docs.where(learn & F.col("doc_id").isNotNull())


def _weights(p: dict[str, np.ndarray], seen: np.ndarray) -> dict[str, np.ndarray]:
    """How much each parameter of a task counts: rows of an id or branch as often as it was seen, the others as all ids were."""
    leaves = np.pad(seen, (0, _LEAVES - len(seen)))
    own = {"embed": seen[:, None], **{f"step{i}": leaves.reshape(n, -1).sum(axis=1)[:, None, None] for i, n in enumerate(_NODES)}}
    return {k: own.get(k, seen.sum() * np.ones((1,) * v.ndim)) for k, v in p.items()}


def _learned(shared: Broadcast, pace: float) -> Callable:
    """One task of a round: (task, the sums of its parameters times their weights, and the weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, start = shared.value
        model, seen = Model(), np.zeros(END + 1)
        model.p = {k: v.copy() for k, v in start.items()}
        state = model.moments()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in T.chunks(texts):
                _, ids, counts = subwords.cut(texts[a:b])
                model.descend(ids, counts, state, lambda t: min(1, t / 20) * pace)
                seen += np.bincount(ids, minlength=END + 1)
        if seen.any():
            weights = _weights(model.p, seen)
            sums = {k: (v * weights[k]).astype(np.float32) for k, v in model.p.items()}
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps((sums, weights))], pa.binary())],
                                             ["task", "model"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sums of a group of tasks as one."""
    order = np.argsort(table.column("task").to_numpy(), kind="stable")
    total = None
    for i in order:
        part = pickle.loads(table.column("model")[int(i)].as_py())
        total = part if total is None else tuple({k: x[k] + y[k] for k in x} for x, y in zip(total, part, strict=True))
    return pa.table({"task": pa.array([table.column("task")[0].as_py() // FAN], pa.int64()), "model": pa.array([pickle.dumps(total)], pa.binary())})


def train(docs: DataFrame, subwords: Subwords, learn: Column, counted: DataFrame | None = None) -> Model:
    """The model, trained on all learning documents; ``counted``: their ``counts``, if there already."""
    spark, model = docs.sparkSession, Model()
    texts = _learned_from(docs, learn).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("round"))
    seen = np.zeros(END + 1, np.int64)
    for r in (counted or counts(texts, subwords)).where("subword").collect():  # at most one row per id
        seen[r.word] = r.n
    if not seen.any():
        return model
    model.set_counts(seen)
    for i in range(ROUNDS):
        shared = spark.sparkContext.broadcast((subwords, model.p))
        parts = texts.where(F.col("round") == i).select("text").mapInArrow(_learned(shared, 1 - i / ROUNDS), "task bigint, model binary")
        for _ in range(LEVELS):
            parts = parts.groupBy((F.col("task") / FAN).cast("bigint")).applyInArrow(_added, "task bigint, model binary")
        found = parts.groupBy().applyInArrow(_added, "task bigint, model binary").first()
        if found is not None:
            sums, weights = pickle.loads(bytes(found["model"]))
            model.p = {k: np.where(weights[k] > 0, sums[k] / np.maximum(weights[k], 1), v).astype(np.float32) for k, v in model.p.items()}
    return model


def _block_words(table: pa.Table) -> pa.Table:
    """Distinct words of a block."""
    texts, block = table.column("text").to_pylist(), table.column("block")[0].as_py()
    found = [np.unique(T.words_of(texts[a:b], T.BLANK_SEPARATED).hashes()) for a, b in T.chunks(texts)]
    words = np.unique(np.concatenate([[END_WORD], *found]))
    return pa.table({"word": words.view(np.int64), "block": pa.array(np.full(len(words), block, np.int32))})


def log_scores(docs: DataFrame, path: str, learn: Column) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score; ``learn`` marks rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    subwords = Subwords(Vocabulary(path, RANKS))
    counted = materialise(counts(_learned_from(rows, learn), subwords), "word-counts")
    model = train(rows, subwords, learn, counted)
    counted = counted.where("not subword").select("word", "n")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    shared = spark.sparkContext.broadcast((subwords, model, tuple(total)))

    def score(mine: pa.Table, known: pa.Table) -> pa.Table:
        cutter, net, (n_all, n_distinct, n_once) = shared.value
        words = known.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, counts = words[order], known.column("n").to_numpy()[order]
        texts, out = mine.column("text").to_pylist(), []
        for a, b in T.chunks(texts):
            out.append(_scored(cutter, net, texts[a:b], words, counts, n_all, n_distinct, n_once))
        tokens, seen, base, score = (np.concatenate(c) if c else np.zeros(0) for c in zip(*out, strict=True)) if out else ([],) * 4
        return pa.table({"doc_id": mine.column("doc_id"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()),
                         "train_tokens": pa.array(np.full(len(texts), n_all), pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(score, pa.float64())})

    blocks = max(1, -(-int(size) // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition("block")
    asked = dealt.groupBy("block").applyInArrow(_block_words, "word bigint, block int")
    answered = asked.join(counted, "word").select("block", "word", "n")
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _scored(cutter: Subwords, net: Model, texts: list[bytes | None], known: np.ndarray, counts: np.ndarray, n_all: int, n_distinct: int,
            n_once: int) -> tuple[np.ndarray, ...]:
    """Number of tokens, of known ones, base score and score of each text of a chunk."""
    per_doc, c, base, score = token_scores(cutter, net, texts, known, counts, n_all, n_distinct, n_once)
    text = np.repeat(np.arange(len(texts)), per_doc)
    return (per_doc, *(np.bincount(text, w, len(texts)) for w in (c > 0, base, score)))


def token_scores(cutter: Subwords, net: Model, texts: list[bytes | None], known: np.ndarray, counts: np.ndarray, n_all: int, n_distinct: int,
                 n_once: int) -> tuple[np.ndarray, ...]:
    """Tokens of each text, and of each token its count, base score and score (log10)."""
    words = T.words_of(texts, T.BLANK_SEPARATED)
    tokens, ids, size = cutter.tokens(words, words.hashes())
    first = np.cumsum(size) - size
    per_text = np.add.reduceat(size, words.firsts()[:-1] + np.arange(len(texts))) if len(texts) else size
    c = np.zeros(len(tokens))
    if len(known):
        at = np.searchsorted(known, tokens)
        at[at == len(known)] = 0
        c = np.where(known[at] == tokens, counts[at], 0).astype(np.float64)
    base = np.log10((c + 0.1) / (n_all + 0.1 * (n_distinct + 1)))
    spelled = np.add.reduceat(net.log10(ids, per_text), first)
    share = (1 - n_once / n_all) * c / n_all if n_all else c
    new = np.log10((1 + n_once / n_all) / 2) if n_all else 0.0
    score = np.where(c > 0, np.log10(np.maximum((share + np.power(10.0, np.maximum(spelled, -290))) / 2, 1e-290)), spelled + new)
    return words.per_doc + 1, c, base, score
