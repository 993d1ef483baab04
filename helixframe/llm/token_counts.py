"""Token counts with a compiled transducer and a prefix scan over chunks.

The sentencepiece model (BPE with byte fallback) becomes a deterministic
transducer whose edges carry the number of tokens they emit.  A text is cut
into chunks.  Each chunk becomes a *state map*, from the state before it to
the state after it and the tokens emitted in between; maps compose
associatively, so a prefix scan joins them: inside a task for texts that are
one row (`count_tokens`), across tasks for texts stored in pieces
(`count_tokens_chunked`).

A word mark after another character brings every state to the same one, which
keeps a map small: the text up to that point (it still depends on the state
before), then one number and one pending text for all states.

Defined results: null or empty text counts 0 tokens; repeated rows each give a
row; an empty table gives an empty table; columns other than id and text are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.bpe_fst import NEVER, Transducer
from helixframe.llm.util import texts_of

MARK = "▁"
#: Code points in a chunk; ordinary documents have several.
CHUNK = 1024
#: Neighbouring maps that one step of a scan across tasks composes.
FAN = 64
#: Words whose counts are kept; the table starts anew beyond.
MEMO = 600_000
#: Texts that are tokenized on their own: a mark starts one, and no piece goes over a line end.
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
SYNC = re.compile("[^ ] ")


class CountMachine:
    """A sentencepiece BPE model as a transducer with token counts on its edges."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and leading word marks is needed")
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a model with the identity normalizer and a dummy prefix is needed")
        normal = [(p.score, p.piece) for p in model.pieces if p.type == p.NORMAL]
        if any(SYNC.search(p.replace(MARK, " ")) or "\n" in p for _, p in normal) or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces that go on over a word mark, and user-defined pieces, are not supported")
        rank = {p: i for i, (_, p) in enumerate(sorted(normal, key=lambda x: (-x[0], x[1])))}

        def emitted(tokens: list[str]) -> int:
            return sum(1 if t in rank else len(t.encode("utf-8")) for t in tokens)

        self.fst = Transducer(rank, lambda a, b: rank.get(a + b, NEVER), emitted)
        self.plain, self.marked = _Segments(self.fst, False), _Segments(self.fst, True)

    def run(self, pending: str, text: str) -> tuple[str, int]:
        """From the state with this pending text over text: the pending text then, and the tokens emitted."""
        st, n = self.fst.state_of(pending), 0
        for symbol in text:
            st, out = st[symbol]
            n += out
        return st.pending, n

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, emitted, pending): over head the state before still matters; pending None: it does to the end."""
        text = text.replace(MARK, " ")
        m = SYNC.search(text)
        if m is None:
            return text.replace(" ", MARK), 0, None
        at = m.end()
        back = re.search(r"[^ ] +[^ ]*$", text).start() + 1  # the last segment may go on in the next chunk
        pending, n = self.run("", text[back:].replace(" ", MARK))
        return text[:at].replace(" ", MARK), n + (self._lines(text[at:back], True) if at <= back else 0), pending

    def compose(self, a, b):
        """The map of two neighbouring chunks; associative."""
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2])
        pending, n = self.run(a[2], b[0])
        return (a[0], a[1] + n + b[1], pending if b[2] is None else b[2])

    def total(self, whole) -> int:
        """Tokens of a text from its map, with the mark the library puts before a text."""
        head, n, pending = whole
        if not head:
            return 0
        before, first = self.run(MARK, head)
        return first + n + self.fst.state_of(before if pending is None else pending).tail

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(text) <= chunk:
            return self._lines(text, True)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        return self.total(prefix_scan(maps, self.compose)[-1])

    def _lines(self, text: str, marked: bool) -> int:
        """Tokens of a text that starts at the reset state (marked: with a mark before it), word by word."""
        lines = text.split("\n")
        n = len(lines) - 1
        word, begin = self.marked.__getitem__, self.marked if marked else self.plain
        for line in lines:
            parts = line.split(" ")
            if "" in parts or MARK in line:
                text = line.replace(" ", MARK)
                n += sum(map(self.plain.__getitem__, SEGMENT.findall(MARK + text if begin is self.marked else text)))
            else:
                n += begin[parts[0]] + sum(map(word, parts[1:]))
            begin = self.plain
        return n


class _Segments(dict):
    """Tokens of a text without inner marks, read from the reset state, or from the state after a mark."""

    def __init__(self, fst: Transducer, marked: bool):
        super().__init__()
        self.fst, self.marked = fst, marked

    def __missing__(self, segment: str) -> int:
        st, n = self.fst.start, 0
        if self.marked:
            st = st[MARK][0]
        for symbol in segment:
            st, out = st[symbol]
            n += out
        n += st.tail
        if len(segment) <= 64:  # rare giants are not kept
            if len(self) >= MEMO:
                self.clear()
            self[segment] = n
        return n


def prefix_scan(items: list, compose: Callable) -> list:
    """Inclusive scan in about 2 log n rounds: neighbours are composed, their scan is taken, the gaps are filled."""
    if len(items) < 2:
        return list(items)
    pairs = prefix_scan([compose(a, b) for a, b in zip(items[::2], items[1::2])], compose)
    out = [items[0]]
    for i in range(1, len(items)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], items[i]))
    return out


@lru_cache(maxsize=4)
def machine(model_path: str) -> CountMachine:
    return CountMachine(model_path)


def _path(model_path: str | None) -> str:
    if model_path:
        return model_path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each whole text; narrow, no shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(_path(model_path))
        for b in batches:
            n = pa.array([m.count(t.as_py(), chunk) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts_of(df, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counts, f"doc_id {key}, n_bytes long, n_tokens long")


def count_tokens_chunked(df: DataFrame, id_col: str, pos_col: str, text_col: str, model_path: str | None = None, fan: int = FAN) -> DataFrame:
    """doc_id and n_tokens of texts stored as pieces in several rows, in the order of pos_col (whole numbers, no two equal).

    The maps of the pieces are made in parallel.  The scan across tasks goes by
    position: each step composes the maps of positions in one range of `fan`
    and gives the range's number to the result, so a task holds at most `fan`
    maps of a document however long it is; log_fan(positions) steps lead to one.
    """
    key = df.schema[id_col].dataType.simpleString()

    def maps(batches):
        m = machine(_path(model_path))
        for b in batches:
            got = [m.chunk_map(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))], ["doc_id", "pos", "head", "emitted", "pending"])

    def composed(batches):
        m = machine(_path(model_path))
        for b in batches:
            got = [prefix_scan([(x["head"], x["emitted"], x["pending"]) for x in v.as_py()], m.compose)[-1] for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))], ["doc_id", "pos", "head", "emitted", "pending"])

    def totals(batches):
        m = machine(_path(model_path))
        for b in batches:
            n = [m.total(x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    schema = f"doc_id {key}, pos long, head string, emitted long, pending string"
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(pos_col).cast("long").alias("pos"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = rows.agg(F.min("pos").alias("low"), F.max("pos").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    state = rows.withColumn("pos", F.col("pos") - low).mapInArrow(maps, schema)
    span = high - low
    while span > 0:
        span //= fan
        ranges = state.groupBy("doc_id", F.floor(F.col("pos") / fan).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "head", "emitted", "pending"))).alias("maps"))
        state = ranges.mapInArrow(composed, schema)
    return state.select("doc_id", "head", "emitted", "pending").mapInArrow(totals, f"doc_id {key}, n_tokens long")
