"""Benchmark decontamination by latent semantic retrieval.

1. *Numbers and statistics, one pass over all documents.*  Every word of every
   document becomes a number: benchmark words have one each, all other words
   share `HASHED` buckets by hash, so the whole vocabulary takes part in bounded
   memory.  Over passages of `window` words each task adds up document
   frequencies and the sketch T'(T S), T the passage-by-term counts and S random
   signs.  All are integers, so sums don't depend on task order.  Documents as
   numbers are kept in the shared folder for step 3.
2. *Randomised SVD.*  With idf on both sides the sketch gives the leading
   right singular vectors of the TF-IDF matrix (a Nystrom approximation from
   one pass); only term-by-rank numbers reach the driver.
3. *Candidates.*  Windows of `window` words, every `stride`-th and the last one
   of each document, are compared with all windows of the items by cosine, one
   matrix product for many documents; items are a stated query set, in blocks of
   at most `MOST_WORDS` words.
4. *Rare words.*  A cosine may miss what the checks would report, so documents
   are also looked up by each item's rarest words: if at most L - k of its L
   words may be missing, any L - k + m of them include m that are there.  With
   this a pair is reported exactly if one span of 2 L + `window` words passes.
5. *Checks.*  Around a candidate the longest common subsequence of words with
   the item is taken.  A pair is reported if it covers `lcs` of the item, or a
   paraphrase's `loose` share and the item's answer (its last words) is there.
   Other words for most of an item leave no such share: there the answer decides, if
   the words before it reach `cosine` with those of the item, in a window that
   does.

`route` says how a pair was found: `cosine` or, where the cosine missed it,
`rare words`; `latent` is a pair that only the cosine and the answer show.

Words are lower-cased runs of anything but space and tab to carriage return,
without punctuation at either end.

Defined results: null or empty documents and items match nothing; repeated
rows are reported once for each (doc_id, item_id); empty tables give an empty
result; other columns are ignored; ids may have any type that can be grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.llm.simple8b import groups_of
from helixframe.llm.util import stored, texts_of

PUNCTUATION = ".,;:!?\"'()[]{}«»“”‘’¡¿…–—-"
#: Words in a passage, words between windows, rank, cosine of a candidate, LCS shares, words of an answer.
WINDOW, STRIDE, RANK, COSINE, LCS, LOOSE, ANSWER = 16, 8, 32, 0.8, 0.8, 0.6, 4
#: Rare words of an item that a span must hold to be checked.
RARE = 4
#: Buckets of words that the benchmark doesn't have.
HASHED = 1 << 14
#: Words of benchmark items that are compared in one run over the documents; more items take more runs.
MOST_WORDS = 100_000
#: Terms in a row of partial sums, words in a step of the sums and of the comparison, words whose vectors are made at once.
BLOCK, STEP, PART = 1024, 1 << 16, 1 << 13


def plain_words(raw: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(raw), characters=PUNCTUATION)


def words_of(text: str) -> list[str]:
    raw = [w.decode("utf-8") for w in text.encode("utf-8").split()]
    return plain_words(pa.array(raw, pa.large_string())).to_pylist()


def bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A hash of each word's bytes, the same in every process."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    sizes = np.diff(offsets)
    if not len(words) or offsets[-1] == offsets[0]:
        return np.zeros(len(words), np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    weight = np.random.default_rng(11).integers(1, 2**63, 1024, np.uint64) | np.uint64(1)
    data = (data + np.uint64(1)) * weight[place % 1024]
    data ^= data >> np.uint64(29)
    sums = np.append(np.uint64(0), np.cumsum(data))  # wraps around, and so do the differences
    at = offsets - offsets[0]
    return ((sums[at[1:]] - sums[at[:-1]]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets


class Vocabulary:
    """Words to numbers: a benchmark term's own, a bucket's after them, then that of no word (punctuation alone)."""

    def __init__(self, terms: dict[str, int], hashed: int = HASHED):
        self.terms = pa.array(sorted(terms, key=terms.get), pa.large_string())
        self.hashed, self.none = hashed, len(terms) + hashed

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of each text's words; a word that comes again in the texts is looked up once."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.values.dictionary_encode()
        raw = coded.dictionary
        plain = plain_words(raw)
        of = pc.index_in(plain, self.terms).fill_null(-1).to_numpy().astype(np.int32)
        other = np.flatnonzero(of < 0)
        of[other] = len(self.terms) + bucket_of(plain.take(pa.array(other)), self.hashed)
        of[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = self.none
        of[pc.equal(raw, "").to_numpy(zero_copy_only=False)] = -1
        flat, bounds = of[coded.indices.to_numpy()], split.offsets.to_numpy()
        if len(of) and of.min() < 0:  # the empty pieces beside leading and trailing space
            there = flat >= 0
            flat, bounds = flat[there], np.append(0, np.cumsum(there))[bounds]
        return [flat[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a; -1 matches nothing."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    places.pop(-1, None)
    row = full = (1 << len(a)) - 1
    for x in b:
        if x in places:
            hit = row & places[x]
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def signs(n_terms: int, rank: int) -> np.ndarray:
    """Random signs, a row a term; the last row, that of no word, is zero."""
    s = np.random.default_rng(7).integers(0, 2, (n_terms + 1, rank), dtype=np.int8) * 2 - 1
    s[-1] = 0
    return s


class Sums:
    """Document frequencies and the sketch over passages; all sums are integers."""

    def __init__(self, n: int, window: int, rank: int):
        self.n, self.window, self.signs = n, window, signs(n, rank)
        self.total = np.zeros((n + 1, 1 + rank))  # whole numbers far below 2 ** 53
        self.passages, self.held, self.size = 0, [], 0

    def feed(self, ids: np.ndarray) -> None:
        self.held += [ids, np.full(-len(ids) % self.window, self.n, np.int32)]  # a passage doesn't go on into the next text
        self.size += len(ids) + len(self.held[-1])
        if self.size >= STEP:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        flat, self.held, self.size = np.concatenate(self.held), [], 0
        for i in range(0, len(flat), STEP):
            ids = flat[i : i + STEP]
            rows = ids.reshape(-1, self.window)
            self.passages += len(rows)
            seen = np.sort(rows, axis=1)
            first = np.ones(seen.shape, bool)
            np.not_equal(seen[:, 1:], seen[:, :-1], out=first[:, 1:])
            self.total[:, 0] += np.bincount(seen[first], minlength=self.n + 1)
            made = self.signs[ids].reshape(*rows.shape, -1).sum(1, dtype=np.int16)  # T S
            for k in range(made.shape[1]):
                self.total[:, 1 + k] += np.bincount(ids, np.repeat(made[:, k], self.window), self.n + 1)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(block, sums) of the terms, 32 bits a number where they fit; the passages as block -1."""
        self.flush()
        yield -1, np.array([self.passages]).tobytes()
        for at in range(0, self.n, BLOCK):
            part = self.total[at : min(at + BLOCK, self.n)]
            if part.any():
                yield at // BLOCK, part.astype(np.int32 if np.abs(part).max() < 2**31 else np.int64).tobytes()


def block_sums(data: bytes, terms: int, rank: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * terms * (1 + rank) else np.int64).reshape(terms, 1 + rank)


def numbered(texts: DataFrame, terms: dict[str, int], window: int, rank: int) -> DataFrame:
    """Documents as numbers (doc_id, ids) and, in other rows, each task's partial sums (block, sums)."""
    key = to_arrow_type(texts.schema["doc_id"].dataType)
    bound = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(bound.value)
        sums = Sums(vocabulary.none, window, rank)
        kind = number_type(vocabulary.none)
        for b in batches:
            at = 0
            for part in groups_of(b.column(1)):
                docs = vocabulary.numbers(part)
                for ids in docs:
                    sums.feed(ids)
                n = len(docs)
                made = pa.array([ids.astype(kind).tobytes() for ids in docs], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), made, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "ids", "block", "sums"])
                at += n
        for block, data in sums.blocks():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.binary()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["doc_id", "ids", "block", "sums"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids binary, block int, sums binary")


def number_type(none: int) -> type:
    return np.uint16 if none < 1 << 16 else np.int32


def statistics(rows: DataFrame, own: Sums) -> tuple[np.ndarray, int]:
    """Document frequency and sketch of each term, and the passages, over all tasks' rows and `own`; a row a block reaches the driver."""
    n, rank = own.n, own.total.shape[1] - 1

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(data, np.int64) if block < 0 else block_sums(data, min(BLOCK, n - block * BLOCK), rank)
                if block in totals:
                    totals[block] += part
                else:
                    totals[block] = part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["block", "sums"])

    parts = rows.filter("block IS NOT NULL").select("block", "sums").repartition("block").mapInArrow(added, "block int, sums binary")
    own.flush()
    total, passages = own.total[:-1].copy(), own.passages
    for r in parts.collect():
        if r["block"] < 0:
            passages += int(np.frombuffer(r["sums"], np.int64)[0])
        else:
            at = r["block"] * BLOCK
            total[at : at + BLOCK] += np.frombuffer(r["sums"], np.int64).reshape(-1, 1 + rank)
    return total, passages


def latent_terms(total: np.ndarray, passages: int) -> np.ndarray:
    """For each term its idf times its row of the right singular vectors over the singular values, so that a
    passage's sum is its row of the left singular vectors and common directions don't outweigh the others; a
    last row of zeros for no word."""
    df, sketch = total[:, 0], total[:, 1:]
    idf = np.log((1 + passages) / (1 + df))
    core = signs(len(total), sketch.shape[1])[:-1].T.astype(float) @ sketch  # S'T'T S: T'T is sketch core^-1 sketch'
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-10
    half = sketch @ (vectors[:, good] / np.sqrt(values[good]))
    terms, sigma, _ = np.linalg.svd(idf[:, None] * half, full_matrices=False)
    table = idf[:, None] * terms / np.maximum(sigma, sigma[0] * 1e-6)
    return np.vstack([table / np.abs(table).max(), np.zeros((1, table.shape[1]))]).astype(np.float32)


def least_common(length: int, share: float) -> int:
    """The fewest common words that make the share of an item."""
    return next((k for k in range(length) if k / length >= share), length)


def rare_words(sequences: list[list[int]], df: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Items by term (where each term's begin, and the items) over each item's rarest words, and how many hits each item needs."""
    pairs, needs = set(), []
    for n, seq in enumerate(sequences):
        k = least_common(len(seq), share)
        needs.append(max(1, min(RARE, k)))
        rarest = sorted(range(len(seq)), key=lambda i: (df[seq[i]] if seq[i] >= 0 else -1, seq[i]))  # -1 is never there
        pairs |= {(seq[i], n) for i in rarest[: len(seq) - k + needs[-1]] if seq[i] >= 0}
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(pairs[:, 0], np.arange(len(df) + 1)), pairs[:, 1], needs


#: A pair that isn't reported yet.
NOTHING = (0.0, False, 0.0, "")


class Items:
    """The asked items as tasks see them."""

    def __init__(self, sequences: list[list[int]], table: np.ndarray, df: np.ndarray, window: int, stride: int, cosine: float, lcs: float, loose: float):
        self.sequences, self.table, self.window, self.stride = sequences, table, window, stride
        self.cosine, self.lcs, self.loose = cosine, lcs, loose
        asked, self.of = [], []
        for n, seq in enumerate(sequences):
            last = max(0, len(seq) - window)
            for at in sorted({*range(0, last + 1, max(1, stride // 2)), last}):  # all of its windows, as long as those of the documents
                asked.append(table[[x for x in seq[at : at + window] if x >= 0]].sum(0))
                self.of.append(n)
        self.asked = np.array(asked, np.float32)
        self.asked /= np.maximum(np.linalg.norm(self.asked, axis=1, keepdims=True), 1e-9)
        self.of = np.array(self.of)
        self.least = min(lcs, loose)
        self.fewest = [least_common(len(seq), self.least) for seq in sequences]
        self.begin, self.owners, needs = rare_words(sequences, df, self.least)
        self.needs, self.sizes = np.array(needs), np.array([2 * len(seq) + window for seq in sequences])
        self.words = [set(seq) - {-1} for seq in sequences]
        self.answers = [[x for x in seq if x >= 0][-ANSWER:] for seq in sequences]

    def windows(self, docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, place, cosine) of the windows near an item; the documents go through one matrix product together."""
        many = np.array([-(-len(d) // self.stride) for d in docs])
        ends = np.cumsum(many)
        none = len(self.table) - 1
        flat = np.full(int(ends[-1]) * self.stride, none, np.int32)
        for d, at in zip(docs, ((ends - many) * self.stride).tolist()):
            flat[at : at + len(d)] = d
        doc = np.repeat(np.arange(len(docs)), many)
        place = (np.arange(len(doc)) - (ends - many)[doc]) * self.stride
        wide, step = -(-self.window // self.stride), PART // self.stride
        for i in range(0, len(doc), step):
            j = min(i + step, len(doc))
            sums = self.table[flat[i * self.stride : (j + wide - 1) * self.stride]]
            sums = sums.reshape(-1, self.stride, sums.shape[1]).sum(1)
            latent = sums[: j - i].copy()
            for k in range(1, wide):
                there = np.flatnonzero(np.arange(i, j) + k < ends[doc[i:j]])
                latent[there] += sums[there + k]
            full = (place[i:j] == 0) | (np.arange(i, j) + wide <= ends[doc[i:j]])  # shorter ones at the end are in the last window
            yield from self.near(latent[full], doc[i:j][full], place[i:j][full])
        long = np.array([n for n, d in enumerate(docs) if len(d) > self.window and (len(d) - self.window) % self.stride], np.int64)
        for i in range(0, len(long), PART // self.window):
            some = long[i : i + PART // self.window]
            last = np.concatenate([docs[n][-self.window :] for n in some.tolist()])
            latent = self.table[last].reshape(len(some), self.window, -1).sum(1)
            yield from self.near(latent, some, np.array([len(docs[n]) - self.window for n in some.tolist()]))

    def near(self, latent: np.ndarray, doc: np.ndarray, place: np.ndarray):
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)
        for i in range(0, len(latent), 1024):
            close = latent[i : i + 1024] @ self.asked.T
            at, q = np.divmod(np.flatnonzero(close >= self.cosine), len(self.asked))
            if len(at):
                yield doc[i + at], self.of[q], place[i + at], close[at, q]

    def rare_spans(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, first, last): where spans of the item's size start that hold enough of its rare words; ranges don't overlap."""
        lengths = np.array([len(d) for d in docs])
        gap = int(self.sizes.max())  # between documents, so that no span goes over
        base = np.cumsum(lengths + gap) - lengths - gap
        ids = np.concatenate(docs)
        has = np.append(self.begin[1:] > self.begin[:-1], [False] * (len(self.table) - len(self.begin) + 1))
        at = np.flatnonzero(has[ids])
        ids = ids[at]
        at = at + np.repeat(base - (np.cumsum(lengths) - lengths), lengths)[at]
        low = self.begin[ids]
        many = self.begin[ids + 1] - low
        place = np.repeat(at, many)
        item = self.owners[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(place))]
        key = np.sort(item.astype(np.int64) << 40 | place)  # by item, then place
        item, place = key >> 40, key & (1 << 40) - 1
        size = self.sizes[item]
        until = np.minimum(np.arange(len(item)) + self.needs[item] - 1, max(0, len(item) - 1))
        good = np.flatnonzero((item[until] == item) & (until - np.arange(len(item)) == self.needs[item] - 1) & (place[until] - place < size))
        doc = np.searchsorted(base, place[good], side="right") - 1
        first, last = np.maximum(place[until[good]] - size[good] + 1, base[doc]) - base[doc], place[good] - base[doc]
        merged: list[tuple[int, int, int, int]] = []
        for d, n, a, b in zip(doc.tolist(), item[good].tolist(), first.tolist(), last.tolist()):
            if merged and merged[-1][:2] == (d, n) and a <= merged[-1][3]:
                merged[-1] = (d, n, merged[-1][2], b)
            else:
                merged.append((d, n, a, b))
        return merged

    def found(self, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, bool, float]]:
        """The best (share, answer found, cosine, route) of each reported (document, item)."""
        best: dict[tuple[int, int], tuple[float, bool, float, str]] = {}
        if not len(docs) or not sum(map(len, docs)):
            return best
        hits = list(self.windows(docs))
        if hits:
            doc, item, place, close = map(np.concatenate, zip(*hits))
            self.check(docs, doc, item, place, close, best)
        for d, n, a, b in self.rare_spans(docs):
            self.check_span(docs[d], d, n, a, b, best)
        return best

    def check(self, docs, doc, item, place, close, best) -> None:
        order = np.lexsort((-close, place, item, doc))
        last, done = None, -1
        for d, n, at, value in zip(doc[order].tolist(), item[order].tolist(), place[order].tolist(), close[order].tolist()):
            if (d, n) == last and at <= done:  # the check of the window before covers this one
                continue
            seq = self.sequences[n]
            last, done = (d, n), at + len(seq) // 4
            if (d, n) in best and best[d, n][0] >= 1.0:
                continue
            got = docs[d][max(0, at - len(seq)) : at + self.window + len(seq)].tolist()
            if len(self.words[n].difference(got)) > len(seq) - self.fewest[n] and not self.answered(n, got):  # no subsequence can be long enough
                continue
            share, has = self.judged(n, got)
            if share >= self.lcs or share >= self.loose and has:
                best[d, n] = max(best.get((d, n), NOTHING), (share, has, value, "cosine"))
            elif has and self.alike(n, got):
                best[d, n] = max(best.get((d, n), NOTHING), (share, has, value, "latent"))

    def answered(self, n: int, got: list[int]) -> bool:
        answer = self.answers[n]
        return any(got[i : i + len(answer)] == answer for i in range(len(got) - len(answer) + 1) if got[i] == answer[0])

    def alike(self, n: int, got: list[int]) -> bool:
        """Whether as many words before an answer as the item has there are as close to them as a candidate; the answer itself doesn't count."""
        seq, answer = self.sequences[n], self.answers[n]
        body = [x for x in seq if x >= 0][: -len(answer)]
        asked = self.table[body].sum(0)
        for i in range(1, len(got) - len(answer) + 1):
            if got[i : i + len(answer)] == answer:
                there = self.table[got[max(0, i - len(body)) : i]].sum(0)
                if there @ asked >= self.cosine * np.linalg.norm(there) * np.linalg.norm(asked) > 0:
                    return True
        return False

    def judged(self, n: int, got: list[int]) -> tuple[float, bool]:
        return common_subsequence(self.sequences[n], got) / len(self.sequences[n]), self.answered(n, got)

    def check_span(self, ids: np.ndarray, d: int, n: int, a: int, b: int, best) -> None:
        """Every span that can pass is checked, in pieces of as many starts as a span has words."""
        seq, size, words = self.sequences[n], int(self.sizes[n]), self.words[n]
        for i in range(a, b + 1, size):
            old = best.get((d, n), NOTHING)
            if old[:2] == (1.0, True):
                return
            got = ids[i : min(b + 1, i + size) + size - 1].tolist()
            if len(words.difference(got)) > len(seq) - self.fewest[n]:
                continue
            hit = [x in words for x in got]
            count = np.append(0, np.cumsum(hit))
            start = np.flatnonzero(hit[: min(b + 1, i + size) - i])  # a span may as well begin at a word of the item
            start = start[count[np.minimum(start + size, len(got))] - count[start] >= self.fewest[n]]
            if not len(start) or common_subsequence(seq, got) < max(self.fewest[n], old[0] * len(seq)):
                continue
            top, where = old[:2], -1
            for j in start.tolist():
                share, has = self.judged(n, got[j : j + size])
                if (share >= self.lcs or share >= self.loose and has) and (share, has) > top:
                    top, where = (share, has), j
                    if top == (1.0, True):
                        break
            if where >= 0:
                best[d, n] = (*top, self.closest(np.array(got[where : where + size]), n), "cosine" if old[3] == "cosine" else "rare words")

    def closest(self, ids: np.ndarray, n: int) -> float:
        """The best cosine of any window of the span."""
        width = min(self.window, len(ids))
        sums = np.append(np.zeros((1, self.table.shape[1])), np.cumsum(self.table[ids], axis=0, dtype=np.float64), axis=0)
        latent = sums[width:] - sums[: len(ids) + 1 - width]
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)
        return float((latent @ self.asked[self.of == n].T).max())


def item_blocks(items: list, most: int) -> Iterator[list]:
    """Runs of items of at most `most` words together (a longer item stands alone)."""
    block, size = [], 0
    for x in items:
        if block and size + len(x[1]) > most:
            yield block
            block, size = [], 0
        block.append(x)
        size += len(x[1])
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    stride: int = STRIDE,
    rank: int = RANK,
    cosine: float = COSINE,
    lcs: float = LCS,
    loose: float = LOOSE,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_found, cosine (the best of the pair) and route of each contaminated pair."""
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    kinds = rows.schema["doc_id"].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, lcs_share double, answer_found boolean, cosine double, route string"
    items = [(r[0], words_of(r[1])) for r in texts_of(benchmark, item_col, "text").orderBy("doc_id", "text").toLocalIterator()]  # the query set
    pairs = None
    for block in item_blocks([(i, w) for i, w in items if any(w)], most_words):
        got = _pairs(rows, block, schema, to_arrow_type(kinds[1]), window, stride, rank, cosine, lcs, loose)
        pairs = got if pairs is None else pairs.unionByName(got)
    if pairs is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("lcs_share", "answer_found", "cosine", "route")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _pairs(rows: DataFrame, items: list, schema: str, item_type: pa.DataType, window: int, stride: int, rank: int, cosine: float, lcs: float, loose: float) -> DataFrame:
    terms = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws if w}))}
    sequences = [[terms[w] if w else -1 for w in ws] for _, ws in items]
    kept = stored(numbered(rows, terms, window, rank), "numbered")
    own = Sums(len(terms) + HASHED, window, rank)
    for seq in sequences:
        own.feed(np.array([x if x >= 0 else own.n for x in seq], np.int32))
    total, passages = statistics(kept, own)
    asked = Items(sequences, latent_terms(total, passages), total[: len(terms), 0], window, stride, cosine, lcs, loose)
    sent = rows.sparkSession.sparkContext.broadcast((asked, [i for i, _ in items]))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, item_ids = sent.value
        kind = number_type(len(asked.table) - 1)
        names = pa.array(item_ids, item_type)
        for b in batches:
            docs = [np.frombuffer(x.as_buffer(), kind) for x in b.column(1)]
            at = 0
            while at < len(docs):  # groups of documents of about STEP words
                until, size = at, 0
                while until < len(docs) and (until == at or size + len(docs[until]) <= STEP):
                    size += len(docs[until])
                    until += 1
                best = asked.found(docs[at:until])
                if best:
                    cols = [b.column(0).take(pa.array([at + d for d, _ in best])), names.take(pa.array([n for _, n in best]))]
                    cols += [pa.array([float(v[0]) for v in best.values()]), pa.array([bool(v[1]) for v in best.values()]), pa.array([round(float(v[2]), 6) for v in best.values()]), pa.array([v[3] for v in best.values()])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "lcs_share", "answer_found", "cosine", "route"])
                at = until

    return kept.filter("block IS NULL").select("doc_id", "ids").mapInArrow(compared, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without contaminated documents.

    A row is named by its id and its text's digest, so rows without an id, and
    other texts under the same id, are judged on their own.
    """
    key = lambda: F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest"))
    gone = contaminated(docs.select(key().alias("doc_id"), F.col(text_col).alias("text")), benchmark, "doc_id", "text").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, key() == F.col("__gone"), "left_anti")
