"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is assumed about it: each turn's
span is found by rendering the turns so far and the turns with one more, and comparing the two outputs. If the
longer does not begin with the shorter, the template has rewritten history, and the conversation is reported as
``rewritten`` with no loss mask. Where an assistant's text lies inside its span is found in the same way: two probes
that differ from their first character on render to a common head and a common tail, and the text is what a real
turn has between them.

Prefixes are rendered whole, so a template may look back as far as it likes, and work grows with the square of a
conversation's turns. A template that writes each turn by itself can be declared ``local``: prefixes then begin at most
``WINDOW`` turns back, work is linear and a conversation is streamed, sorted, through its task and never held. The
claim is tested whenever turns are dropped: the window must render to its older half followed by its younger half,
or the conversation is reported as ``rewritten``. Digests are chains over all turns of a conversation, so one
conversation stays in one task.

A template that leaves a text out, or says the same for both probes, has no loss span there.

Defined results: a null text is an empty text, a null role an empty role; a null conv_id is a conversation of its
own, null turns come first; turns with one number are ordered by role and text; extra columns are ignored; an empty
table yields no conversations but the added ones.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
WINDOW = 64
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_MARK = re.compile("%(25|3C|0A)")
_PROBES = ("A", "B")


def escape(text: str) -> str:
    """Control strings begin with ``<|``; no text has that once it is escaped."""
    return text.replace("%", "%25").replace("<|", "%3C|")


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: {"25": "%", "3C": "<", "0A": "\n"}[m[1]], text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of the registered query: every turn between a start mark with its role and an end mark."""
    return "".join(f"{START}{escape(role).replace(chr(10), '%0A')}\n{escape(text)}{END}\n" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """Turns back from the output of ``marked_turns``."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Rendering:
    """Grows one conversation turn by turn: ``add`` gives the turn's piece of output and its loss span in the piece."""

    def __init__(self, template: Callable[[list[Turn]], str], loss_roles: tuple[str, ...] = ("assistant",), local: bool = False):
        self.template, self.loss_roles, self.local = template, loss_roles, local
        self.turns: list[Turn] = []
        self.output, self.rewritten = template([]), False

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        if self.local and len(self.turns) == WINDOW:
            older, younger = self.turns[:WINDOW // 2], self.turns[WINDOW // 2:]
            tail = self.template(younger)
            self.rewritten |= self.output != self.template(older) + tail[len(self.template([])):]
            self.turns, self.output = younger, tail
        longer = self.template([*self.turns, (role, text)])
        if not longer.startswith(self.output):
            self.rewritten = True
        piece = longer[len(self.output):]
        begin = end = 0
        if role in self.loss_roles and not self.rewritten:
            a, b = (self.template([*self.turns, (role, p)])[len(self.output):] for p in _PROBES)
            head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
            if a != b:
                begin, end = head, max(head, len(piece) - (len(a) - head - len(_PROBES[0])))
        self.turns.append((role, text))
        self.output = longer
        return piece, begin, end


class _Digest:
    def __init__(self, conv_id: int | None, template: Callable[[list[Turn]], str], local: bool):
        self.conv_id, self.rendering = conv_id, Rendering(template, local=local)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, role: str, text: str) -> None:
        piece, begin, end = self.rendering.add(role, text)
        for got_role, got_text in read_turns(piece):
            self.turns.update(f"{got_role}\n{got_text}\n".encode("utf-8", "replace"))
            self.n_turns += 1
        masked = unescape(piece[begin:end])
        self.loss.update(masked.encode("utf-8", "replace"))
        self.loss_chars += len(masked)
        self.formatted_chars += len(piece)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars, self.rendering.rewritten)


_KINDS = [("conv_id", "bigint", pa.int64()), ("n_turns", "bigint", pa.int64()), ("turns_sha256", "string", pa.string()),
          ("loss_chars", "bigint", pa.int64()), ("loss_sha256", "string", pa.string()),
          ("formatted_chars", "bigint", pa.int64()), ("rewritten", "boolean", pa.bool_())]


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Callable[[list[Turn]], str] = marked_turns, local: bool = False) -> DataFrame:
    """One row per turn: conv_id, turn, piece of output, loss span in the piece (equal ends: none), rewritten so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, rendering = object(), None
        for batch in batches:
            rows = []
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rendering is None or c != conv_id:
                    conv_id, rendering = c, Rendering(template, local=local)
                rows.append((c, turn, *rendering.add(role, text), rendering.rewritten))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["conv_id", "turn", "piece", "loss_from", "loss_to", "rewritten"])

    return _sorted_turns(conversations).mapInArrow(
        run, "conv_id bigint, turn bigint, piece string, loss_from bigint, loss_to bigint, rewritten boolean")


def format_digests(conversations: DataFrame, template: Callable[[list[Turn]], str] = marked_turns, local: bool = True) -> DataFrame:
    """One row per conversation, read back from the formatted output and its loss mask.

    Turns are read back by ``read_turns``, so the template has to be one that it reads, like ``marked_turns``, which is local.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for c, _, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if current is None or c != current.conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(c, template, local)
                current.add(role, text)
            yield _rows(done)
            done = []
        if current is not None:
            yield _rows([current.row()])

    return _sorted_turns(conversations).mapInArrow(run, ", ".join(f"{n} {k}" for n, k, _ in _KINDS))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, _, k) in enumerate(_KINDS)],
                                      [n for n, _, _ in _KINDS])
