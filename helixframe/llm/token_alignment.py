"""Token alignment of two tokenizers with inverted pair bitmaps.

A text is cut into segments (a space or line end and the word after it) that no
token of either vocabulary goes over.  The libraries encode each new segment once;
its alignment (groups between byte offsets where tokens of both end, links
between tokens whose bytes overlap) is kept in a bounded table.

Each task gathers its documents into blocks and inverts them: for every pair
of linked ids a compressed bitmap of the block's documents (16-bit numbers, or
one bit a document where that is smaller), and multiplicity planes: bit k of
plane k says whether the document's links of the pair, as a binary number,
have that bit; planes have a bit for each document of the bitmap.  Batches of
documents are OR-ed into the block's bitmap.  Popcounts give document counts, popcounts
of planes times 2^k link counts.  Blocks hold different documents, so over the
corpus counts add up.  Then the counts go back along the postings: a block's
bitmaps and planes turn each pair's count into its documents' sums.

Defined results: null and empty texts, and texts whose tokens don't spell a
space and the text, have no tokens: zeros and ''; repeated rows each give a
row and each count; special strings inside texts are plain text; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.bpe_stream import WS, byte_chars
from helixframe.llm.simple8b import groups_of, in_groups
from helixframe.llm.util import stored, texts_of

MARK = "▁"
#: From a space or line end that comes after other than white space to the next one of these (B has pieces over other white space).
SEGMENT = re.compile(f"[ \n][{WS}]*[^{WS}]*(?:(?![ \n])[{WS}]+[^{WS}]*)*")
SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))
SPANNING = re.compile(f"[^{WS}] |\n")
#: Documents and bytes of text in a block (the last text may go over), and bytes of text inverted at once.
BLOCK_DOCS, BLOCK_BYTES, BATCH_BYTES = 1 << 15, 1 << 23, 1 << 21
#: Segments, and their code points, whose alignments are kept.
MEMO, MEMO_CHARS = 300_000, 1 << 24
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
#: What a block writes besides doc_id: rows of documents (at: place in the block) and postings (a, b: the pair).
FIELDS = "block long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, n_docs long, links long, docs binary, planes binary"


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, ends) of tokens that end at these bytes: places of linked tokens, and bytes where tokens of both end.

    Between one end of either and the next lie the bytes of one token of each,
    and two tokens share one such piece or none: the pieces are the links.
    """
    pieces = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, pieces), np.searchsorted(ends_b, pieces), np.intersect1d(ends_a, ends_b, assume_unique=True)


class Aligner:
    """Two vocabularies and the alignments of the segments seen so far, as tables indexed by segment."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        table = byte_chars()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = {i: t.encode() if t in special else bytes(table[c] for c in t) for t, i in self.a.get_vocab().items()}
        model = pb.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        normal = [p.piece.replace(MARK, " ") for p in model.pieces if p.type == p.NORMAL]
        if any(map(SPANNING.search, normal)) or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a piece model is needed that adds a space, keeps spaces, and has no pieces over a word's end or a line end")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        if (max(self.bytes_a) + 1) * len(self.bytes_b) >> 32:
            raise ValueError("pairs of these vocabularies don't fit in 32 bits")
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array(list(map(len, self.bytes_b)))
        # how an id is written inside a group, and as the last one of its side
        self.shown = [[f"{i}{mark}" for i in range(n)] for n, mark in ((len(self.size_a), ","), (len(self.size_a), "|"), (len(self.size_b), ","), (len(self.size_b), ";"))]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        #: Each segment's groups, with ; after each; n_a, n_b, n_groups, n_links; and whether its tokens spell it.
        self.groups: list[str] = []
        self.figures, self.right = [array("q") for _ in range(4)], array("b")
        #: Pairs (a times the size of b's vocabulary, plus b) of all segments one after the other, each once a segment; how often; where each segment's end.
        self.linked, self.times, self.ends = array("q"), array("q"), array("q", [0])
        self.chars = 0

    def full(self, memo: int) -> bool:
        return len(self.index) > memo or self.chars > MEMO_CHARS

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """Ids as inside a text: a first space is the one that the model adds; other segments come after a line end, which is left out."""
        lone = self.b.encode("\n")[:1]
        got = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in segments], num_threads=1)
        return [ids[2:] if s[0] != " " else ids if len(s) > 1 else lone for s, ids in zip(segments, got)]

    def learn(self, segments: list[str]) -> None:
        """Put the alignments of new segments into the tables; those that end in white space would not be the same before another."""
        for group in in_groups([s for s in segments if s[-1] not in SPACES], len, 1 << 16):
            self._learn(group)
        for s in segments:
            if s[-1] in SPACES:
                self._learn([s])

    def _learn(self, group: list[str]) -> None:
        text = "".join(group)
        ids_a, lists_b = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), self.ids_b(group)
        ids_b = np.fromiter(chain.from_iterable(lists_b), np.int64, sum(map(len, lists_b)))
        raw = text.encode()
        if not (b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist()))):
            if len(group) > 1:  # find out which segments aren't spelt
                self._learn(group[: len(group) // 2])
                self._learn(group[len(group) // 2 :])
                return
            self._put(group, [""], [np.zeros(1, np.int64)] * 4, False)
            return
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        segment_ends = np.cumsum(np.array([len(s.encode()) for s in group]))
        link_a, link_b, group_ends = align(ends_a, ends_b)
        owner = np.searchsorted(segment_ends, ends_a[link_a])
        pair, times = np.unique(owner << 32 | ids_a[link_a] * len(self.size_b) + ids_b[link_b], return_counts=True)
        # each token's place among the texts of all groups: a group's tokens of A, then those of B
        last_a, last_b = np.searchsorted(ends_a, group_ends), np.searchsorted(ends_b, group_ends)
        of_a, of_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
        at_a = np.arange(len(ids_a)) + np.append(0, last_b + 1)[of_a]
        at_b = np.arange(len(ids_b)) + last_a[of_b] + 1
        shown: list[str] = [""] * (len(ids_a) + len(ids_b))
        ends = [np.isin(np.arange(len(ids_a)), last_a, assume_unique=True), np.isin(np.arange(len(ids_b)), last_b, assume_unique=True)]
        for ids, at, end, inner, outer in ((ids_a, at_a, ends[0], *self.shown[:2]), (ids_b, at_b, ends[1], *self.shown[2:])):
            for i, k, e in zip(ids.tolist(), at.tolist(), end.tolist()):
                shown[k] = outer[i] if e else inner[i]
        until = [np.searchsorted(x, segment_ends, "right") for x in (ends_a, ends_b, group_ends)]
        tokens = (until[0] + until[1]).tolist()
        texts = ["".join(shown[i:j]) for i, j in zip([0, *tokens], tokens)]
        figures = [np.diff(x, prepend=0) for x in until] + [np.bincount(owner, minlength=len(group))]
        self._put(group, texts, figures, True, pair & 0xFFFFFFFF, times, np.bincount(pair >> 32, minlength=len(group)))

    def _put(self, group: list[str], texts: list[str], figures: list[np.ndarray], right: bool, pairs=np.zeros(0, np.int64), times=np.zeros(0, np.int64), n_pairs=np.zeros(1, np.int64)) -> None:
        self.index.update(zip(group, range(len(self.index), len(self.index) + len(group))))
        self.groups += texts
        for column, values in zip((*self.figures, self.linked, self.times, self.ends), (*figures, pairs, times, self.ends[-1] + np.cumsum(n_pairs))):
            column.frombytes(values.astype(np.int64).tobytes())
        self.right.extend([right] * len(group))
        self.chars += sum(map(len, group))

    def segments(self, texts: list[str]) -> list[list[int]]:
        """Segment numbers of a space and each text; an empty text has none."""
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        self.learn(list({s for c in cut for s in c if s not in self.index}))
        return [list(map(self.index.__getitem__, c)) for c in cut]


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of runs of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def summed_pairs(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, doc, times) summed over equal (pair, doc), in their order."""
    key = (pairs.astype(np.uint64) << np.uint64(32)) | docs.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], first) if len(key) else times
    return (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), total


def _slices(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def pack_postings(sizes: np.ndarray, docs: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """Bitmap and planes of each pair; sizes: documents of each pair; docs ascend within a pair.

    A bitmap is 16-bit numbers, or n_docs bits where those take fewer bytes.
    """
    width = (n_docs + 7) // 8
    bits = sizes * 2 > width
    bytes_of = np.where(bits, width, sizes * 2)
    starts = np.cumsum(bytes_of) - bytes_of
    data = np.zeros(int(bytes_of.sum()), np.uint8)
    pair = np.repeat(np.arange(len(sizes)), sizes)
    rank = runs(sizes)
    few = ~bits[pair]
    at = starts[pair[few]] + 2 * rank[few]
    data[at], data[at + 1] = docs[few] & 255, docs[few] >> 8
    many = ~few
    np.bitwise_or.at(data, starts[pair[many]] + docs[many] // 8, (1 << (docs[many] % 8)).astype(np.uint8))
    stride = (sizes + 7) // 8
    most = np.maximum.reduceat(times, np.cumsum(sizes) - sizes) if len(sizes) else times
    n_planes = np.frexp(most.astype(np.float64))[1].astype(np.int64)
    plane_bytes = n_planes * stride
    plane_starts = np.cumsum(plane_bytes) - plane_bytes
    planes = np.zeros(int(plane_bytes.sum()), np.uint8)
    for k in range(int(n_planes.max()) if len(sizes) else 0):
        on = np.flatnonzero((times >> k) & 1)
        np.bitwise_or.at(planes, plane_starts[pair[on]] + k * stride[pair[on]] + rank[on] // 8, (1 << (rank[on] % 8)).astype(np.uint8))
    return _slices(data, bytes_of), _slices(planes, plane_bytes)


def unpack_postings(sizes: np.ndarray, bitmaps: pa.Array, planes: pa.Array, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """docs and times of pack_postings(), pair after pair."""
    width = (n_docs + 7) // 8
    data, bytes_of = _flat(bitmaps)
    starts, firsts = np.cumsum(bytes_of) - bytes_of, np.cumsum(sizes) - sizes
    pair, rank = np.repeat(np.arange(len(sizes)), sizes), runs(sizes)
    docs = np.zeros(len(pair), np.int64)
    bits = sizes * 2 > width
    few = np.flatnonzero(~bits[pair])
    at = starts[pair[few]] + 2 * rank[few]
    docs[few] = data[at] + (data[at + 1].astype(np.int64) << 8)
    for p in np.flatnonzero(bits).tolist():
        docs[firsts[p] : firsts[p] + sizes[p]] = np.flatnonzero(np.unpackbits(data[starts[p] : starts[p] + width], bitorder="little"))
    data, bytes_of = _flat(planes)
    starts, stride, times = np.cumsum(bytes_of) - bytes_of, (sizes + 7) // 8, np.zeros(len(pair), np.int64)
    n_planes = bytes_of // np.maximum(stride, 1)
    for k in range(int(n_planes.max()) if len(sizes) else 0):
        has = np.flatnonzero(n_planes[pair] > k)
        byte = data[starts[pair[has]] + k * stride[pair[has]] + rank[has] // 8]
        times[has] += ((byte >> (rank[has] % 8).astype(np.uint8)) & 1).astype(np.int64) << k
    return docs, times


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and the bytes of each."""
    sizes = np.asarray(pc.binary_length(values), np.int64)
    return np.frombuffer(b"".join(v.as_buffer() for v in values), np.uint8), sizes


def popcounts(planes: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Links of each pair: bits set in plane k times 2^k, over its planes."""
    data, bytes_of = _flat(planes)
    pair = np.repeat(np.arange(len(sizes)), bytes_of)
    plane = runs(bytes_of) // ((sizes + 7) // 8)[pair]
    out = np.zeros(len(sizes), np.int64)
    np.add.at(out, pair, np.bitwise_count(data).astype(np.int64) << plane)
    return out


class Block:
    """Documents gathered for one inversion."""

    def __init__(self, number: int):
        self.number, self.ids, self.rows, self.triples, self.size = number, [], [], [], 0

    def add(self, aligner: Aligner, ids: pa.Array, texts: list[str]) -> None:
        cut = aligner.segments(texts)
        lengths = np.array([len(c) for c in cut], np.int64)
        doc, segment = np.repeat(np.arange(len(cut)), lengths), np.fromiter(chain.from_iterable(cut), np.int64, int(lengths.sum()))
        # a segment that isn't spelt differs in its number of bytes, so its text isn't spelt either
        right = lengths > 0
        right[doc[np.array(aligner.right)[segment] == 0]] = False
        figures = [np.where(right, np.bincount(doc, np.array(f)[segment], len(cut)), 0).astype(np.int64) for f in aligner.figures]
        hashes = [hashlib.sha256("".join(map(aligner.groups.__getitem__, c))[:-1].encode()).hexdigest() if ok else "" for c, ok in zip(cut, right.tolist())]
        key, times = np.unique((doc << 32 | segment)[right[doc]], return_counts=True)
        doc, segment = key >> 32, key & 0xFFFFFFFF
        ends = np.array(aligner.ends)
        lengths = ends[segment + 1] - ends[segment]
        link = np.repeat(ends[segment], lengths) + runs(lengths)
        self.triples.append(summed_pairs(np.repeat(doc, lengths) + self.n_docs, np.array(aligner.linked)[link], np.array(aligner.times)[link] * np.repeat(times, lengths)))
        self.ids.append(ids)
        self.rows.append((*figures, hashes))

    @property
    def n_docs(self) -> int:
        return sum(map(len, self.ids))

    def batches(self, aligner: Aligner, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for each pair."""
        n = self.n_docs
        figures = [np.concatenate([r[i] for r in self.rows]) for i in range(4)]
        yield _batch(schema, n, block=np.full(n, self.number), doc_id=pa.concat_arrays(self.ids), at=np.arange(n, dtype=np.int32), n_a=figures[0], n_b=figures[1], n_groups=figures[2], n_links=figures[3], groups_sha256=[h for r in self.rows for h in r[4]])
        pairs, docs, times = (np.concatenate([t[i] for t in self.triples]) for i in range(3))
        order = np.argsort(pairs, kind="stable")  # documents ascend from batch to batch
        pairs, docs, times = pairs[order], docs[order], times[order]
        firsts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(firsts, len(pairs)))
        bitmaps, planes = pack_postings(sizes, docs, times, n)
        own, m = pairs[firsts], len(firsts)
        yield _batch(schema, m, block=np.full(m, self.number), a=own // len(aligner.size_b), b=own % len(aligner.size_b), n_docs=sizes, links=popcounts(planes, sizes), docs=bitmaps, planes=planes)


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows with these columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    if path_a and path_b:
        return path_a, path_b
    import public_tokenizers

    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def invert(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, memo: int = MEMO) -> DataFrame:
    """Rows of documents (a null) and postings (at null) of all blocks; narrow.  Store it before reading it twice: block numbers are a run's own."""

    if block_docs > 1 << 16:
        raise ValueError("documents of a block are 16-bit numbers")
    step = max(1, block_docs // 8)

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*_paths(path_a, path_b))
        number, block = TaskContext.get().partitionId() << 32, None
        for b in batches:
            schema = pa.schema([b.schema.field(0).with_name("doc_id"), *(pa.field(n, _ARROW[t]) for n, t in (f.split() for f in FIELDS.split(", ")))])
            done = 0
            for texts in groups_of(b.column(1), min(BATCH_BYTES, block_bytes)):
                for i in range(0, len(texts), step):
                    part = texts[i : i + step]
                    block = block or Block(number)
                    block.add(al, b.column(0)[done : done + len(part)], part.to_pylist())
                    block.size += part.nbytes
                    done += len(part)
                    if block.size >= block_bytes or block.n_docs > block_docs - step:
                        yield from block.batches(al, schema)
                        number, block = number + 1, None
                        if al.full(memo):
                            al.clear()
        if block:
            yield from block.batches(al, schema)

    rows = texts_of(df, id_col, text_col)
    return rows.mapInArrow(inverted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links and best (no other a has more links with this b) of each linked pair of an invert() table."""
    counts = index.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("links").alias("n_links"))
    counts = stored(counts, "pairs")
    return counts.join(counts.groupBy("b").agg(F.max("n_links").alias("most")), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def aligned(index: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256: pair_counts() sent back along the postings, block by block."""
    key = index.schema["doc_id"].dataType.simpleString()

    def returned(rows: pa.Table, scores: pa.Table) -> pa.Table:
        is_doc = pc.is_valid(rows["at"])
        docs, pair = rows.filter(is_doc).sort_by("at"), [("a", "ascending"), ("b", "ascending")]
        postings, scores = rows.filter(pc.invert(is_doc)).sort_by(pair).combine_chunks(), scores.sort_by([("id_a", "ascending"), ("id_b", "ascending")])
        best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        if len(postings):
            sizes = np.asarray(postings["n_docs"])
            at, times = unpack_postings(sizes, postings["docs"].combine_chunks(), postings["planes"].combine_chunks(), len(docs))
            np.add.at(total, at, times * np.repeat(np.asarray(scores["count"]), sizes))
            np.add.at(best, at, times * np.repeat(np.asarray(scores["best"]).astype(np.int64), sizes))
        shown = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return shown.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", docs["groups_sha256"])

    # counts find their blocks by the pairs' ids alone; bitmaps and planes are dealt once, by block
    keys = index.filter("a IS NOT NULL").select("block", "a", "b")
    scored = keys.join(counts.select("a", "b", F.col("n_links").alias("count"), "best"), ["a", "b"])
    scored = scored.select(F.col("block").alias("home"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), "count", "best")
    rows = index.select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n_docs", "docs", "planes")
    return rows.groupBy("block").cogroup(scored.groupBy("home")).applyInArrow(returned, f"doc_id {key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """aligned() over all of df."""
    index = stored(invert(df, id_col, text_col, path_a, path_b), "postings")
    return aligned(index, pair_counts(index))
