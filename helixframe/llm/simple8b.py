"""Token ids in Simple-8b word-aligned files.

A 64-bit word is a 4-bit selector and 60 bits of payload.  The selector says
how many ids of how many bits each the payload packs.  Selector 0 is the
escape for an id of over 60 bits: its low 60 bits are the payload and its high
bits stand in the block's escape area; selector 1 is 120 zeros.

A file is Parquet with a row for each document, in ascending doc_id order:
doc_id, shard, start in the shard, n_tokens, the byte offset of each block in
the payload, and the payload.  A block is three unsigned 32-bit numbers (ids,
words, escapes), the words, then one byte an escape; any block can be decoded
on its own, all words of one selector at once.

Defined results: null or empty text has only the end id; repeated rows are
each written (equal ids in the order of their payloads' checksums, then the
payloads; null ids first); an empty table gives empty files; ids that aren't
whole numbers are an error; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.bpe_stream import int_lists
from helixframe.llm.util import scratch_path, texts_of

#: Ids in a word and bits of each, by selector.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
BLOCK = 4096
#: Runs whose ids are kept.
MEMO = 300_000
#: Rows decoded at once.
ROWS = 500
#: Bytes of text that share a shard.
SHARD_BYTES = 1 << 25
_LOW60 = np.uint64((1 << 60) - 1)
#: After the ids of a run, where runs are joined.
_END = np.int32(-1).tobytes()


_WIDTHS = np.array([n.bit_length() for n in range(1 << 16)], np.int8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit number, 16 at a time from the low end."""
    parts = ids.astype("<u8", copy=False).view("<u2").reshape(-1, 4)
    bits = _WIDTHS[parts[:, 0]]
    for k in (1, 2, 3):
        if parts[:, k].any():
            high = _WIDTHS[parts[:, k]]
            bits = np.where(high > 0, high + np.int8(16 * k), bits)
    return bits


def selectors(bits: np.ndarray) -> np.ndarray:
    """For each place the selector of the word that starts there: the one that packs most of the ids from it."""
    choice = np.where(bits > 60, np.int8(0), np.int8(15))
    widest, span = bits, 1  # the widest of the next `span` ids
    for sel in range(14, 0, -1):
        step = COUNTS[sel] - span
        while step:
            by = min(step, span)
            moved = np.zeros_like(widest)
            np.maximum(widest[:-by], widest[by:], out=moved[:-by])
            moved[-by:] = widest[-by:]
            widest, span, step = moved, span + by, step - by
        fits = widest <= BITS[sel]
        if not fits.any():  # nor do more ids of fewer bits
            break
        np.copyto(choice, np.int8(sel), where=fits)
    return choice


def word_starts(choice: np.ndarray, bases: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the words of all blocks start, ascending; the blocks are walked side by side, a word a step."""
    jump = np.array(COUNTS)[choice]
    taken = np.zeros(len(choice), bool)
    at, ends = bases[sizes > 0], (bases + sizes)[sizes > 0]
    while len(at):
        taken[at] = True
        at = at + jump[at]
        going = at < ends
        if not going.all():
            at, ends = at[going], ends[going]
    return np.flatnonzero(taken)


def pack_many(docs: list[np.ndarray], block: int = BLOCK) -> list[tuple[list[int], bytes]]:
    """For each array of ids: the byte offset of each of its blocks, and its payload."""
    blocks = [d[i : i + block] for d in docs for i in range(0, len(d), block)]
    sizes = np.array([len(x) for x in blocks], np.int64)
    ends = np.cumsum(sizes + 120)
    bases = ends - sizes - 120
    ids = np.zeros(int(ends[-1]) + 120 if len(ends) else 120, np.uint64)  # 120 zeros after each block: no window sees the next one
    for x, base in zip(blocks, bases.tolist()):
        ids[base : base + len(x)] = x
    choice = selectors(bit_lengths(ids))
    starts = word_starts(choice, bases, sizes)
    n_words = np.diff(np.append(np.searchsorted(starts, bases), len(starts))).tolist()
    chosen = choice[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for sel in np.unique(chosen):
        of = np.flatnonzero(chosen == sel)
        part, at, width = np.zeros(len(of), np.uint64), starts[of], BITS[sel]
        for k in range(COUNTS[sel]) if width else ():
            part |= (ids[at + k] & _LOW60) << np.uint64(k * width)
        words[of] |= part
    escapes = chosen == 0
    out, at, i = [], 0, 0
    for d in docs:
        offsets, parts, size = [], [], 0
        for _ in range(0, len(d), block):
            own = slice(at, at + n_words[i])
            high = (ids[starts[own][escapes[own]]] >> np.uint64(60)).astype(np.uint8).tobytes() if escapes[own].any() else b""
            offsets.append(size)
            parts += [struct.pack("<III", sizes[i], n_words[i], len(high)), words[own].astype("<u8", copy=False).tobytes(), high]
            size += 12 + 8 * n_words[i] + len(high)
            at, i = at + n_words[i], i + 1
        out.append((offsets, b"".join(parts)))
    return out


def unpack_many(packed: list[tuple[list[int], bytes]]) -> list[np.ndarray]:
    """The ids of each payload; the words of all blocks are decoded together, selector by selector."""
    heads = [[struct.unpack_from("<III", p, o) + (o,) for o in offsets] for offsets, p in packed]
    flat = [np.frombuffer(p, "<u8", w, o + 12) for (_, p), hs in zip(packed, heads) for _, w, _, o in hs]
    words = np.concatenate(flat) if flat else np.empty(0, np.uint64)
    high = b"".join(p[o + 12 + 8 * w : o + 12 + 8 * w + h] for (_, p), hs in zip(packed, heads) for _, w, h, o in hs)
    sels = (words >> np.uint64(60)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(COUNTS)[sels])])
    ids = np.zeros(int(starts[-1]), np.uint64)
    for sel in np.unique(sels):
        of = np.flatnonzero(sels == sel)
        width, low, at = BITS[sel], words[of] & _LOW60, starts[of]
        if sel == 0:
            ids[at] = low | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(60))
        elif width:
            mask = np.uint64((1 << width) - 1)
            for k in range(COUNTS[sel]):
                ids[at + k] = (low >> np.uint64(k * width)) & mask
    out, at = [], 0
    for hs in heads:
        parts = []
        for n, w, _, _ in hs:
            base = int(starts[at])
            parts.append(ids[base : base + n])
            at += w
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64))
    return out


def in_groups(items: list, size, most: int = 1 << 19) -> Iterator[list]:
    """Runs of items of at most this total size (a larger one stands alone)."""
    group, total = [], 0
    for x in items:
        if group and total + size(x) > most:
            yield group
            group, total = [], 0
        group.append(x)
        total += size(x)
    if group:
        yield group


def groups_of(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Slices of at most this many bytes (a longer text stands alone)."""
    sizes = pc.binary_length(texts).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield texts[start:i]
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield texts[start:]


class Chunks:
    """The tokenizers library over whole texts, cut into pieces that no token goes over.

    A text is cut at ASCII white space, which the vocabulary drops; runs that
    have come before are served from a bounded table.  New runs of printable
    Latin-1 are cut on into the vocabulary's words, as Unicode normal forms
    leave them alone and they have lower case letter by letter: new words need
    only the library's model, which gets them all in one text, a line each (a
    word's last token, and no other, ends with the word mark).  Other new runs
    take the library's whole path.
    """

    #: The word pattern and the word mark of word_bpe_49k.json: fixed values.
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARK = "</w>"
    OTHER = regex.compile(r"[^!-~\xa1-\xac\xae-\xff\n]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = Sequence([Split("\n", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        known = self.WORD in self.library.to_str().replace("\\\\", "\\")
        self.cut = regex.compile(self.WORD + r"|\n").findall if known and self.library.model.end_of_word_suffix == self.MARK else None
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # whether a token ends a word
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.MARK)]] = True
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def plain(self, lines: str) -> list[bool] | None:
        """Which lines are runs that can be cut; None: all of them."""
        if not self.OTHER.search(lines) and not any(m in lines for m in self.marks):
            return None
        return [not self.OTHER.search(run) and not ("<" in run and any(m in run for m in self.marks)) for run in lines.split("\n")]

    def learn(self, runs: list[bytes]) -> None:
        """Put the ids of new runs into the table."""
        if not runs:
            return
        lines = b"\n".join(runs).decode("utf-8")
        cut = (self.plain(lines) if self.cut else [False] * len(runs))
        if cut is not None:
            named = lines.split("\n")
            rest = list(map(not_, cut))
            self.runs.update(zip(compress(runs, rest), ids_of(self.library, list(compress(named, rest)))))
            runs, lines = list(compress(runs, cut)), "\n".join(compress(named, cut))
            if not runs:
                return
        pieces = self.cut(lines.lower() + "\n")
        distinct = set(pieces)
        if len(self.words) + len(distinct) > MEMO:
            self.words.clear()
        new = list(distinct.difference(self.words, "\n"))
        self.words.update(zip(new, self.word_ids(new)))
        self.words["\n"] = _END
        joined = b"".join(map(self.words.__getitem__, pieces))
        ends = (np.flatnonzero(np.frombuffer(joined, np.int32) == -1) * 4).tolist()
        self.runs.update(zip(runs, (joined[i:j] for i, j in zip([0, *(e + 4 for e in ends)], ends))))

    def word_ids(self, words: list[str]) -> Iterator[bytes]:
        """The model's ids of each word."""
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = np.array(self.model.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(some):
                raise ValueError("words and word marks don't agree")
            data = ids.tobytes()
            yield from (data[i:j] for i, j in zip([0, *ends], ends))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; runs are numbered, so a run's ids are fetched once for the whole group."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.values.cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_run = list(map(self.runs.get, distinct))
        new = [r for r, ids in zip(distinct, of_run) if ids is None]
        if len(self.runs) + len(new) > MEMO:
            self.runs.clear()
        self.learn(new)
        of_run = [self.runs[r] if ids is None else ids for r, ids in zip(distinct, of_run)]
        sizes = np.fromiter(map(len, of_run), np.int64, len(of_run)) // 4
        ids, starts = np.frombuffer(b"".join(of_run), np.int32), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        counts = sizes[at]
        ends = np.append(0, np.cumsum(counts))
        flat = ids[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [flat[i:j] for i, j in zip(bounds, bounds[1:])]


def ids_of(library, texts: list[str]) -> Iterator[bytes]:
    return (array("i", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Chunks:
    return Chunks(path)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def one_task_each(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n shards a number that Spark's hash partitioning deals to a task of its own."""
    tried = spark.range(n * (16 + n.bit_length())).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("id"))
    of = {r["task"]: r["id"] for r in tried.collect()}  # a row a shard
    return np.array([of.get(i, i) for i in range(n)], np.int64)


def write_ids(df: DataFrame, out_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts, add the end id to each, and write the files in ascending doc_id order.

    Only packed ids are shuffled.  There are as many shards as the texts have
    `shard_bytes`; their bounds are quantiles of the id column.  An id (or null)
    with more rows than a shard holds gets several, by its payloads' checksums.
    """
    if not df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("document ids must be whole numbers, as files are in their order")
    rows = texts_of(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    shards = max(1, -(-(counts["bytes"] or 0) // shard_bytes), counts["rows"] * 64 // shard_bytes)
    bounds = rows.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 and counts["rows"] > counts["nulls"] else []
    edges = np.sort(np.array(bounds, np.int64))
    null_shards = 1 + counts["nulls"] * shards // max(1, counts["rows"])
    places = one_task_each(df.sparkSession, len(edges) + null_shards)

    def shard_of(ids: pa.Array, checksums: np.ndarray) -> np.ndarray:
        """Null ids first; a bound that comes several times has several shards."""
        none = np.array(ids.is_null())
        known = np.array(ids.fill_null(0))
        low, high = np.searchsorted(edges, known, side="left"), np.searchsorted(edges, known, side="right")
        spread = np.where(high - low > 1, low + (checksums * (high - low + 1) >> 32), high)
        return np.where(none, checksums * null_shards >> 32, null_shards - 1 + spread)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(_path(path))
        for b in batches:
            at = 0
            for texts in groups_of(b.column(1)):
                docs = [np.append(x, np.int32(end_id)) for x in words.encode(texts)]
                packed = pack_many(docs)
                sums = np.array([zlib.crc32(p) for _, p in packed], np.int64)
                own = b.column(0).slice(at, len(docs))
                at += len(docs)
                shard = shard_of(own, sums)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(shard, pa.int32()), pa.array(places[shard]), pa.array(sums), pa.array(map(len, docs), pa.int64()), pa.array([o for o, _ in packed], pa.list_(pa.int32())), pa.array([p for _, p in packed], pa.binary())],
                    ["doc_id", "shard", "place", "checksum", "n_tokens", "block_offsets", "payload"],
                )

    def placed(batches):
        shard, start = None, 0
        for b in batches:
            starts = []
            for s, n in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
                if s != shard:
                    shard, start = s, 0
                starts.append(start)
                start += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())], [*b.schema.names, "shard_start"])

    schema = "doc_id long, shard int, place long, checksum long, n_tokens long, block_offsets array<int>, payload binary"
    ordered = rows.mapInArrow(encoded, schema).repartition(len(places), "place").sortWithinPartitions("shard", "doc_id", "checksum", "payload")
    ordered.mapInArrow(placed, schema + ", shard_start long").drop("place").write.option("compression", "none").parquet(out_path)


def _read(spark: SparkSession, path: str, kind: str, name: str, made) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and what ``made`` gives for a batch's arrays of ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                stored = list(zip(b.column(3).to_pylist(), b.column(4).to_pylist()))
                rows = [ids for group in in_groups(stored, lambda x: len(x[1])) for ids in unpack_many(group)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(r) for r in rows], pa.int64()), made(rows)], ["doc_id", "shard", "shard_start", "n_tokens", name])

    files = spark.read.schema("doc_id long, shard int, checksum long, n_tokens long, block_offsets array<int>, payload binary, shard_start long").parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row a shard
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = files.select("doc_id", "shard", "shard_start", "block_offsets", "payload").mapInArrow(decoded, f"doc_id long, shard int, shard_start long, n_tokens long, {name} {kind}")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", name)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, decoded from the files."""
    return _read(spark, path, "array<int>", "ids", lambda rows: int_lists([r.astype(np.int32) for r in rows]))


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (little-endian unsigned 32-bit ids) of what the files hold."""
    return _read(spark, path, "long", "ids_crc32", lambda rows: pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()))


def ids_through_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and return read_checks() of them."""
    out = scratch_path(df.sparkSession, "ids")
    write_ids(df, out, id_col, text_col, end_id, path)
    return read_checks(df.sparkSession, out)
