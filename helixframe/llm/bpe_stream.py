"""Streaming BPE encoding and decoding with bounded memory.

Encoding: texts go to the encoder in slices of `SLICE` code points.  The merge
list gives a sufficient lookahead (`sufficient_lookahead`): a token that ends
that far back can't change any more.  The transducer emits a token as soon as
the vocabulary shows it to be stable, and holds back at most that many symbols
(more is an error), so a run of any length is encoded in constant memory.
Words that come again are served from a bounded table.

Decoding: ids become bytes, and a byte-to-text state machine turns bytes into
text, carrying an unfinished character over to the next piece.

Defined results: null or empty text gives no ids; no ids give an empty text;
special strings inside a text give their ids, as the library does by default;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.bpe_fst import NEVER, Transducer, sufficient_lookahead
from helixframe.llm.util import texts_of

#: White space as the pre-tokenizer's pattern has it.
WS = "\t-\r \x85\xa0  -     　"
#: The published pattern of the byte-level vocabulary, with that white space.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: What the pattern never matches across: a word with the space before it, or white space.
ITEM = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
CUT = re.compile(rf"[^{WS}][{WS}]")
#: One kind of character each, for runs longer than SLICE.
KINDS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[^{WS}\p{{L}}\p{{N}}]+", f"[{WS}]+")]
#: Code points, and ids, handed over at once; ordinary documents have several.
SLICE = 1024
#: Items in each table of words, and states of the transducer, that a worker keeps; its memory is about 300 MB at most.
MEMO, STATES = 200_000, 180_000
#: Rows in a batch of results.
ROWS = 1000
#: Code points kept back so that no decision of the pattern needs more.
HOLD = 4


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeStream:
    """A byte-level BPE vocabulary file as streaming encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        table = byte_chars()
        plain = lambda token: "".join(chr(table[c]) for c in token)
        ids = {plain(t): i for t, i in spec["model"]["vocab"].items() if all(c in table for c in t)}
        pairs = [tuple(map(plain, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lookahead = sufficient_lookahead(pairs)
        self.fst = Transducer(ids, lambda a, b: ranks.get((a, b), NEVER), lambda tokens: tuple(ids[t] for t in tokens), STATES, self.lookahead)
        self.bytes_of = {i: t.encode("latin-1") for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.items, self.spaced = _Items(self, ""), _Items(self, " ")

    def word(self, token: str) -> list[int]:
        """Ids of one match of the pattern."""
        st, out = self.fst.start, []
        for b in token.encode().decode("latin-1"):
            st, ids = st[b]
            out += ids
        out += st.tail
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                parts.append(np.int32(self.special[piece]).tobytes())
            elif len(piece) <= SLICE:
                parts += self.words(piece)  # one slice
            else:
                enc = Encoder(self)
                parts += [enc.feed(piece[i : i + SLICE]) for i in range(0, len(piece), SLICE)]
                parts.append(enc.finish())
        return np.frombuffer(b"".join(parts), np.int32)

    def words(self, text: str) -> list[bytes]:
        """Ids of a slice that ends between a word and white space, item by item."""
        lead = text[:1] == " "
        body = text[1:] if lead else text
        if " ".join(body.split()) != body.replace("\n", " "):
            return list(map(self.items.__getitem__, ITEM.findall(text)))
        parts, line_end = [], self.items["\n"]  # only single spaces and line ends between words
        for line in body.split("\n"):
            first, *others = line.split(" ")
            parts.append((self.spaced if lead else self.items)[first])
            parts += map(self.spaced.__getitem__, others)
            parts.append(line_end)
            lead = False
        return parts[:-1]

    def decode(self, ids, piece: int = SLICE) -> str:
        dec, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        table = self.bytes_of
        for i in range(0, len(ids), piece):
            out.append(dec.decode(b"".join(map(table.__getitem__, ids[i : i + piece].tolist()))))
        return "".join(out) + dec.decode(b"", True)


class _Items(dict):
    """Ids (int32 bytes) of words that have come before, with what stands before each."""

    def __init__(self, stream: BpeStream, before: str):
        super().__init__()
        self.stream, self.before = stream, before

    def __missing__(self, item: str) -> bytes:
        ids: list[int] = []
        for token in PATTERN.findall(self.before + item):
            ids += self.stream.word(token)
        out = array("i", ids).tobytes()
        if len(item) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[item] = out
        return out


class Encoder:
    """Feed text in slices; each call returns the ids (int32 bytes) that are certain by then.

    Kept between calls: less than two slices of text, or, inside a run without
    a place to cut, one code point and a state of the transducer.
    """

    def __init__(self, stream: BpeStream):
        self.stream, self.rest, self.state, self.kind = stream, "", None, None

    def feed(self, text: str, last: bool = False) -> bytes:
        self.rest += text
        parts: list[bytes] = []
        while self.rest or self.kind:
            rest = self.rest
            if self.kind is not None:
                m = self.kind.match(rest)
                end = m.end() if m else 0
                if end == len(rest) and not last:  # the run may go on
                    parts.append(self._push(rest[:-1]))
                    self.rest = rest[-1:]
                    break
                if self.kind is KINDS[3] and end < len(rest):  # the last space belongs to what follows
                    end -= 1
                parts.append(self._push(rest[:end]) + array("i", self.state.tail).tobytes())
                self.rest, self.state, self.kind = rest[end:], None, None
                continue
            if not last and len(rest) < SLICE:
                break
            at = len(rest) if last else self._cut(rest)
            if at:
                parts += self.stream.words(rest[:at])
                self.rest = rest[at:]
                break
            self._open(parts)
            if self.kind is None:
                break
        return b"".join(parts)

    def finish(self) -> bytes:
        return self.feed("", True)

    def _push(self, text: str) -> bytes:
        out: list[int] = []
        for b in text.encode().decode("latin-1"):
            self.state, ids = self.state[b]
            out += ids
        return array("i", out).tobytes()

    @staticmethod
    def _cut(rest: str) -> int:
        """The last place between a word and white space, or 0."""
        for start in range(len(rest) - 256, -256, -256):
            found = [m.start() + 1 for m in CUT.finditer(rest, max(0, start), min(len(rest), start + 260))]
            if found:
                return found[-1]
        return 0

    def _open(self, parts: list[bytes]) -> None:
        """Without a place to cut: encode match by match, and open a run where a match comes near the end."""
        rest, done = self.rest, 0
        for m in PATTERN.finditer(rest):
            if m.end() > len(rest) - HOLD:
                break
            parts.append(array("i", self.stream.word(m[0])).tobytes())
            done = m.end()
        self.rest = rest = rest[done:]
        if len(rest) >= SLICE // 2:
            self.state = self.stream.fst.start
            lead = 1 if rest[0] == " " and not KINDS[3].match(rest[1]) else 0
            self.kind = next(k for k in KINDS if k.match(rest[lead]))
            parts.append(self._push(rest[:lead]))
            self.rest = rest[lead:]


@lru_cache(maxsize=4)
def stream(path: str) -> BpeStream:
    return BpeStream(path)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each whole text; narrow, no shuffle."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = stream(_path(path))
        for b in batches:
            rows = [s.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), int_lists(rows)], ["doc_id", "ids"])

    rows = texts_of(df, id_col, text_col)
    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def bpe_decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Adds the decoded text to (doc_id, ids); ids null: empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = stream(_path(path))
        for b in batches:
            at = b.schema.get_field_index("ids")
            texts = [s.decode(np.asarray(x.values) if x.is_valid else np.empty(0, np.int32)) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return df.mapInArrow(decoded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", decoded string")


def encode_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of each whole text.

    As bpe_decode() of bpe_encode(), but in one Python worker a task, so that
    only one process holds the vocabulary and ids are sent once.
    """

    def tripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = stream(_path(path))
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                rows = [s.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), int_lists(rows), pa.array(map(s.decode, rows), pa.string())], ["doc_id", "ids", "decoded"])

    rows = texts_of(df, id_col, text_col)
    return rows.mapInArrow(tripped, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from encode_round_trip()."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
