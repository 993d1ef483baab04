"""Fill-in-middle with piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers
that never change: its UTF-8 text and the sentinels.  A cut splits the
descriptor it falls into; an arrangement is a permutation of the three spans
with sentinel descriptors between them; the inverse permutation restores.
Digests go over the descriptors' slices one after the other, so no arranged
text is put together for them.

Spans end where a line does.  How many lines each has, and the form, come from
the sha256 of the seed and the row's id, so a rerun gives the same.

Defined results: null text is empty; an empty text, and one that holds a
sentinel, stays plain (its span lengths are null); a null id is hashed as an
empty one; repeated rows each give a row; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from helixframe.llm.util import texts_of

PREFIX, MIDDLE, SUFFIX = 0, 1, 2
TEXT, MARKS = 0, 1
#: The sentinel before each span; their buffer is the three in a row.
SENTINELS = {PREFIX: b"<P>", SUFFIX: b"<S>", MIDDLE: b"<M>"}
#: The spans of each form in the order they are written.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PIECES = "array<struct<buffer:int,start:long,length:long>>"


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, *buffers, pieces: list[Piece] | None = None):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = [Piece(TEXT, 0, len(self.buffers[TEXT]))] if pieces is None else pieces

    def cut(self, i: int, at: int) -> None:
        """Split descriptor i after its first `at` bytes; either part may be empty."""
        buffer, start, length = self.pieces[i]
        self.pieces[i : i + 1] = [Piece(buffer, start, at), Piece(buffer, start + at, length - at)]

    def arranged(self, order: tuple[int, ...], marks: dict[int, Piece]) -> PieceTable:
        """The descriptors in this order, each after its mark."""
        return PieceTable(*self.buffers, pieces=[p for i in order for p in (marks[i], self.pieces[i])])

    def permuted(self, order) -> PieceTable:
        return PieceTable(*self.buffers, pieces=[self.pieces[i] for i in order])

    def slices(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.slices():
            digest.update(part)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.slices())


_MARK_BUFFER = b"".join(SENTINELS.values())
_MARK_PIECES = {span: Piece(MARKS, _MARK_BUFFER.index(mark), len(mark)) for span, mark in SENTINELS.items()}


def code_points(part: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def numbers(seed: int, key) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the seed and a row's id."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16])


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    table: PieceTable


def cut_and_arrange(text, key, marked: bool, seed: int, fim_percent: int, spm_percent: int) -> Cut:
    """text: UTF-8 buffer; marked: whether it holds a sentinel."""
    table = PieceTable(text, _MARK_BUFFER)
    body = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(body == 10) + 1
    if len(body) and (not len(ends) or ends[-1] < len(body)):
        ends = np.append(ends, len(body))  # the last line has no line end
    n = len(ends)
    h1, h2, h3, h4 = numbers(seed, key)
    if not n or marked or h3 % 100 >= fim_percent:
        return Cut(n, "plain", None, None, table)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(ends[k - 1]) if k else 0 for k in (first, second)]
    table.cut(0, at[0])
    table.cut(1, at[1] - at[0])
    form = "spm" if h4 % 100 < spm_percent else "psm"
    prefix, middle, _ = table.slices()
    return Cut(n, form, code_points(prefix), code_points(middle), table.arranged(FORMS[form], _MARK_PIECES))


def restored(output: bytes, form: str) -> PieceTable:
    """Descriptors over an arranged text that give the original, by the form's inverse permutation.

    A sentinel starts with the only `<` and ends with the only `>` it has and
    no span holds one, so the first one found after the span's start ends it.
    """
    if form == "plain":
        return PieceTable(output)
    order, pieces, at = FORMS[form], [], 0
    for i, span in enumerate(order):
        mark = SENTINELS[span]
        if output[at : at + len(mark)] != mark:
            raise ValueError(f"no {mark.decode()} at byte {at} of a text in form {form}")
        start = at + len(mark)
        at = output.find(SENTINELS[order[i + 1]], start) if i + 1 < len(order) else len(output)
        if at < 0:
            raise ValueError(f"a text in form {form} lacks {SENTINELS[order[i + 1]].decode()}")
        pieces.append(Piece(TEXT, start, at - start))
    return PieceTable(output, pieces=pieces).permuted(np.argsort(order).tolist())


def _cuts(b: pa.RecordBatch, seed: int, fim_percent: int, spm_percent: int) -> Iterator[Cut]:
    texts = b.column(1)
    marked = [pc.match_substring(texts, m.decode()) for m in SENTINELS.values()]
    marked = pc.or_(pc.or_(marked[0], marked[1]), marked[2]).to_pylist()
    for key, text, held in zip(b.column(0).to_pylist(), texts, marked):
        yield cut_and_arrange(text.as_buffer(), key, held, seed, fim_percent, spm_percent)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, pieces (descriptors; buffer 0: text, 1: sentinels) and output of each whole text; narrow."""

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = list(_cuts(b, seed, fim_percent, spm_percent))
            pieces = [[p._asdict() for p in c.table.pieces] for c in cuts]
            cols = [pa.array([c[i] for c in cuts], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            kind = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
            output = pa.array([c.table.text() for c in cuts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(pieces, kind), output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output"])

    rows = texts_of(df, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(arranged, f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output string")


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """df with the original text of each arranged one as `restored` (null output: null; null form: plain)."""
    at, form_at = df.columns.index(output_col), df.columns.index(form_col)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else restored(t.encode(), f or "plain").text() for t, f in zip(b.column(at).to_pylist(), b.column(form_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, "restored"])

    return df.mapInArrow(back, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", restored string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256: fill_in_middle() and restore() in one task, only digests leave it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c.n, c.form, c.prefix_chars, c.middle_chars, c.table.sha256(), restored(c.table.text(), c.form).sha256()) for c in _cuts(b, seed, fim_percent, spm_percent)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    rows = texts_of(df, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
