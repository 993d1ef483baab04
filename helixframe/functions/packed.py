"""Windows of Arrow batches of tiles as numbers, two bits a base, and their pairs with a task's few targets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa

#: Bases in one number, tiles and pairs looked at together, bases of a piece that has a place of its own in a table.
WORD, TILES, PAIRS, DIRECT = 30, 2048, 1 << 20, 10
ODD_BITS = 6148914691236517205
DIGITS = np.full(256, 4, np.int64)
DIGITS[list(b"ACGU")] = range(4)


def piece_edges(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of a window: (first base from 0, base after)."""
    edges = [length * i // (k + 1) for i in range(k + 2)]
    return list(zip(edges, edges[1:]))


def changes(first: int, after: int, length: int, most: int) -> list[int]:
    """What to XOR a window's number with so that at most `most` of the bases first..after-1 change."""
    out = [0]
    for at in range(first, after):
        shift = 2 * (length - 1 - at)
        out += [x ^ (c << shift) for x in out if _changed(x) < most for c in (1, 2, 3)]
    return out


def _changed(x: int) -> int:
    return bin((x | x >> 1) & ODD_BITS).count("1")


def tiles(seqs: pa.Array, size: int, more: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """(row, offset, tile, owned): texts of `size` letters and the `more` that follow, TILES at a time."""
    cut: list[tuple[int, int, str, int]] = []
    for row, seq in enumerate(seqs):
        text = seq.as_py()
        for offset in range(0, len(text), size):
            cut.append((row, offset, text[offset : offset + size + more], min(size, len(text) - offset)))
            if len(cut) == TILES:
                yield _columns(cut)
                cut = []
    if cut:
        yield _columns(cut)


def _columns(cut: list[tuple[int, int, str, int]]) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    row, offset, tile, owned = zip(*cut)
    return pa.array(row, pa.int64()), pa.array(offset, pa.int32()), pa.array(tile, pa.string()), pa.array(owned, pa.int32())


def _digits(texts: list[str]) -> np.ndarray:
    return DIGITS[np.frombuffer("".join(texts).encode("ascii"), np.uint8)]


def _numbers(digits: np.ndarray, n: int) -> np.ndarray:
    """The number of the n digits from each place on."""
    if n == 1:
        return digits
    h = n // 2
    half = _numbers(digits, h)
    both = half[: len(half) - h] << 2 * h | half[h:]
    return both if n % 2 == 0 else both[:-1] << 2 | digits[2 * h :]


def _parts(digits: np.ndarray, n: int, at: np.ndarray) -> list[np.ndarray]:
    """The numbers of the windows of n bases at these places, WORD bases each."""
    return [_numbers(digits[p:], min(WORD, n - p))[at] for p in range(0, n, WORD)]


def codes(texts: list[str], n: int) -> list[np.ndarray]:
    """The numbers of texts of n bases each."""
    return _parts(_digits(texts), n, np.arange(len(texts)) * n)


def windows(texts: list[str], owned: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(tile, place from 0 in it, numbers): the windows of n bases without other letters that tiles own."""
    digits, lengths = _digits(texts), np.array([len(t) for t in texts])
    tile = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(digits)) - (np.cumsum(lengths) - lengths)[tile]
    if len(digits) < n:
        return tile[:0], place[:0], [digits[:0]] * -(-n // WORD)
    others = np.concatenate([[0], np.cumsum(digits == 4)])
    fits = (place < owned[tile]) & (place + n <= lengths[tile])
    at = np.flatnonzero(fits[: len(digits) - n + 1] & (others[n:] == others[:-n]))
    return tile[at], place[at], _parts(digits, n, at)


def mismatches(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int32)
    for x, y in zip(a, b):
        differs = x[i] ^ y[j]
        out += np.bitwise_count((differs | differs >> 1) & ODD_BITS)
    return out


def places(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an item and each of the `count` places from its `first` on, about PAIRS at a time."""
    total, i = np.cumsum(count), 0
    while i < len(count):
        before = total[i] - count[i]
        j = max(i + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        item = np.repeat(np.arange(i, j), count[i:j])
        yield item, np.arange(len(item)) + np.repeat(first[i:j] - (total[i:j] - count[i:j] - before), count[i:j])
        i = j


def chance(length: int, k: int, near: int) -> float:
    """The share of windows of random bases that meet a target at one of its k + 1 pieces with at most `near` changes."""
    return sum(sum(comb(b - a, i) * 3.0**i for i in range(near + 1)) * 4.0 ** (a - b) for a, b in piece_edges(length, k))


class Targets:
    """Few targets of one length, to be met by windows within k mismatches: at one of k + 1 pieces, or near a half."""

    def __init__(self, texts: list[str], n: int, k: int, seeds: bool):
        self.texts, self.n, self.k, self.codes, self.tables = pa.array(texts, pa.string()), n, k, codes(texts, n), []
        for a, b in piece_edges(n, k if seeds else 1):
            opened = np.array(changes(a, b, n, 0 if seeds else k // 2), np.int64)
            shift, mask = 2 * (n - b), (1 << 2 * (b - a)) - 1
            pieces = ((self.codes[0][:, None] ^ opened) >> shift & mask).ravel()
            order = np.argsort(pieces, kind="stable")
            keys, count = np.unique(pieces, return_counts=True)
            first = np.cumsum(count) - count
            if b - a <= DIRECT:
                spread = np.zeros((2, mask + 1), np.int64)
                spread[:, keys] = first, count
                keys, (first, count) = None, spread
            self.tables.append((shift, mask, keys, first, count, order // len(opened)))

    def pairs(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, target, mismatches) of all pairs within k mismatches, each once."""
        size, found = len(self.texts), []
        for shift, mask, keys, first, count, target in self.tables:
            key = w >> shift & mask
            if keys is not None:
                row = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = np.flatnonzero(keys[row] == key)
                row = row[met]
            else:
                met = np.flatnonzero(count[key])
                row = key[met]
            for item, place in places(first[row], count[row]):
                i, j = met[item], target[place]
                near = mismatches([w], i, self.codes, j) <= self.k
                found.append(i[near] * size + j[near])
        each = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        i, j = each // size, each % size
        return i, j, mismatches([w], i, self.codes, j)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILES):
            yield batch.slice(at, TILES)


def _cut(tiles: pa.RecordBatch, n: int):
    texts = tiles.column("tile").to_pylist()
    tile, place, w = windows(texts, tiles.column("owned").to_numpy(), n)
    start = (tiles.column("offset").to_numpy()[tile] + place + 1).astype(np.int32)
    return texts, tile, place, w, start


def window_rows(tiles: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """(accession, start, size, w) of all windows of n bases."""
    _, tile, _, w, start = _cut(tiles, n)
    return pa.RecordBatch.from_arrays([tiles.column("accession").take(pa.array(tile)), pa.array(start), pa.array(np.full(len(tile), n, np.int32)), pa.array(w[0])], ["accession", "start", "size", "w"])


def near_rows(tiles: pa.RecordBatch, targets: Targets) -> pa.RecordBatch:
    """(target, accession, start, size, w, mismatches) of the windows near few targets."""
    _, tile, _, w, start = _cut(tiles, targets.n)
    i, j, differ = targets.pairs(w[0])
    cols = [targets.texts.take(pa.array(j)), tiles.column("accession").take(pa.array(tile[i])), pa.array(start[i]), pa.array(np.full(len(i), targets.n, np.int32)), pa.array(w[0][i]), pa.array(differ)]
    return pa.RecordBatch.from_arrays(cols, ["target", "accession", "start", "size", "w", "mismatches"])


def own_rows(tiles: pa.RecordBatch, n: int, k: int) -> pa.RecordBatch:
    """(target, accession, start, window, mismatches) of tiles that carry their targets of n bases."""
    texts, tile, place, w, start = _cut(tiles, n)
    carried = tiles.column("targets").to_pylist()
    flat, count = [t for ts in carried for t in ts], np.array([len(ts) for ts in carried])
    t, first, hits = codes(flat, n), np.cumsum(count) - count, [np.zeros((3, 0), np.int64)]
    for i, j in places(first[tile], count[tile]):
        differ = mismatches(w, i, t, j)
        near = differ <= k
        hits.append(np.stack([i[near], j[near], differ[near]]))
    i, j, differ = np.concatenate(hits, axis=1)
    shown = [texts[a][b : b + n] for a, b in zip(tile[i].tolist(), place[i].tolist())]
    cols = [pa.array(flat, pa.string()).take(pa.array(j)), tiles.column("accession").take(pa.array(tile[i])), pa.array(start[i]), pa.array(shown, pa.string()), pa.array(differ.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["target", "accession", "start", "window", "mismatches"])
