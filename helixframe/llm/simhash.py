"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of 3-word shingles,
repeats included.  Two that differ in at most `radius` bits agree in whole
blocks of bits, so equal blocks give buckets that together miss no link.  In a
bucket fingerprints are stored vertically, a bit plane for each of the 64 bits.
One fingerprint is compared with all others of the bucket at once: planes are
added into bitwise counters by carry-save steps, lanes past the radius drop
out, and the bucket is abandoned when none is left.  Each fingerprint is
expanded once, against those not yet reached, so a bucket gives a spanning
forest (fewer links than members), never all pairs.

Links become components by alternating star contractions.

Defined results: null or empty text has fingerprint zero, linked like any
other; texts of one or two words are one shingle; repeated rows each give a
row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.util import discard, is_file_scan, stored, texts_of

RADIUS = 3
#: Fingerprints compared in one piece; larger buckets are cut into tiles.
TILE = 8192


def fingerprint(text: str, width: int = 3, slice_: int = 1 << 15) -> int:
    """64 bits, unsigned; A-Z lower-cased, words are runs of anything but space and tab to carriage return."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else iter([b" ".join(w)])
    ones, n, total = np.zeros(64, np.int64), 0, max(1, len(w) - width + 1)
    while n < total:
        size = min(slice_, total - n)
        h = np.fromiter((xxhash.xxh64_intdigest(next(grams), 42) for _ in range(size)), np.uint64, size)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += size
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each whole text; narrow."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = texts_of(df, id_col, text_col)
    return rows.mapInArrow(made, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def planes_of(fps: np.ndarray) -> list[int]:
    """For each bit an integer whose bit i is that bit of fps[i] (one or several words each)."""
    bits = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    cols = np.packbits(bits, axis=0, bitorder="little").T.copy()
    return [int.from_bytes(c.tobytes(), "little") for c in cols]


def within(planes: list[int], fp: int, lanes: int, radius: int = RADIUS) -> int:
    """The lanes whose fingerprints differ from fp in at most radius bits."""
    width = (radius + 1).bit_length()
    start = (1 << width) - 1 - radius  # counters run over exactly when the radius is passed
    counters = [lanes if start >> k & 1 else 0 for k in range(width)]
    for b, plane in enumerate(planes):
        carry = (plane ^ -(fp >> b & 1)) & lanes
        for k in range(width):
            if not carry:
                break
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if carry:
            lanes &= ~carry
            if not lanes:
                return 0
    return lanes


def bucket_links(fps: np.ndarray, radius: int = RADIUS, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links in one bucket: pairs of places; members of one root count as linked already."""
    n = len(fps)
    if n < 2:
        return []
    planes, links = planes_of(fps), []
    values = [int.from_bytes(x.tobytes(), "little") for x in fps.astype("<u8")]
    kin: dict[int, list[int]] = {}
    if roots is not None:
        names, place, count = np.unique(roots, return_inverse=True, return_counts=True)
        if len(names) < n:
            order = np.argsort(place, kind="stable")
            for own in np.split(order, np.cumsum(count)[:-1]):
                if len(own) > 1:
                    kin |= dict.fromkeys(own.tolist(), own.tolist())
    unseen = (1 << n) - 1

    def reached(i: int) -> None:
        """i, and all of its root, are no longer unseen."""
        nonlocal unseen
        lanes = np.zeros(n, np.uint8)
        own = kin.get(i, [i])
        lanes[own] = 1
        unseen &= ~(1 << i if len(own) == 1 else int.from_bytes(np.packbits(lanes, bitorder="little").tobytes(), "little"))
        front.extend(own)

    while unseen:
        front: list[int] = []
        reached((unseen & -unseen).bit_length() - 1)
        while front and unseen:
            i = front.pop()
            while found := within(planes, values[i], unseen, radius):
                if not kin:
                    unseen ^= found
                    while found:
                        j = (found & -found).bit_length() - 1
                        found &= found - 1
                        links.append((i, j))
                        front.append(j)
                    break
                while found:
                    j = (found & -found).bit_length() - 1
                    links.append((i, j))
                    reached(j)
                    found &= unseen
    return links


def tables_for(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Which bit ranges make up each bucket key.

    The 64 bits are cut into radius + extra blocks; two fingerprints within the
    radius agree in at least `extra` of them.  More fingerprints take longer
    keys, so buckets of unrelated ones stay small at any size.
    """
    for extra in (1, 2, 3, 4):
        blocks = radius + extra
        edges = [64 * i // blocks for i in range(blocks + 1)]
        ranges = list(zip(edges, edges[1:]))
        if n <= 64 << sum(b - a for a, b in ranges[:extra]) or extra == 4:
            return [list(c) for c in combinations(ranges, extra)]
    raise AssertionError


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) exactly as all links within the radius do.

    Buckets of more than `tile` are dealt by hash into groups; a task gets two
    groups (or one), and every two groups meet in one task.
    """
    nodes = nodes.select("fp")
    tables = tables_for(nodes.count(), radius)

    def key(ranges) -> F.Column:
        parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("string") for a, b in ranges]
        return F.concat_ws("_", *parts)

    rows = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("table"), key(r).alias("key")) for i, r in enumerate(tables)])).alias("k")).select("fp", "k.table", "k.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["table", "key"]).withColumn("groups", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
    rows = rows.withColumn("own", own).select(
        "fp", "table", "key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"), "own"
    ).select("fp", "table", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    dealt = rows.repartition("table", "key", "lo", "hi").sortWithinPartitions("table", "key", "lo", "hi", "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        def of(bucket):
            fps = np.unique(np.array(bucket, np.int64))
            return [(int(fps[i]), int(fps[j])) for i, j in bucket_links(fps.view(np.uint64), radius)]

        at, bucket, links = None, [], []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for fp, *k in zip(*cols):
                if k != at:
                    links += of(bucket)
                    at, bucket = k, []
                bucket.append(fp)
            if len(links) > 50_000:
                yield out(links)
                links = []
        yield out(links + of(bucket))

    return dealt.mapInArrow(linked, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for nodes with a link.

    Alternating large-star and small-star steps until nothing changes, about
    log2 of the longest way in rounds; each is written to the shared folder.
    Only minima are grouped, never neighbour lists.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    told = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = told(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stored(small.filter("u <> v").distinct(), "links")
        same = told(new)
        edges = new
        if same == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = same


def contracted(links: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """Fewer links (a, b), a < b, that connect the same nodes: of every so many rows one star a component."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= rows:
                yield star(held)
                held = []
        if held:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([np.asarray(h.column(i)) for i in (0, 1) for h in held])
        node, place = np.unique(ends, return_inverse=True)
        a, b = place[: len(place) // 2], place[len(place) // 2 :]
        root = np.arange(len(node))
        while (differ := root[a] != root[b]).any():
            x, y = root[a[differ]], root[b[differ]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        far = root != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[root[far]]), pa.array(node[far])], ["a", "b"])

    return links.select("a", "b").mapInArrow(stars, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of each row.

    Only distinct fingerprints are linked.  Fingerprints with over 1/512 of all
    rows (fewer than 512 of them) meet their rows by broadcast, so copies of one
    text never gather in one task; all others by a shuffled join.
    """
    rows = stored(fingerprints(df, id_col, text_col), "fps")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    total = rows.count()
    roots = components(link_fingerprints(nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "n", "component_id"), "named")
    hot = F.col("n") * 512 > total
    some = F.broadcast(named.filter(hot).select("fp", "component_id"))
    crowd = rows.join(some, "fp")
    rest = rows.join(some, "fp", "left_anti").join(named.filter(~hot).select("fp", "component_id"), "fp")
    return crowd.select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


#: The pipeline's near copies: words in a shingle, least Jaccard similarity of the sets of shingles.
WIDTH, SIMILAR = 5, 0.8
#: Bits of a wide fingerprint, those of them that are compared, and the share in which fingerprints of texts just SIMILAR differ.
WIDE, COMPARED, DIFFER = 256, 128, 0.152
#: Most of the compared bits in which such texts differ: five deviations over their mean.
WIDE_RADIUS = 40
#: Buckets up to here are compared by popcounts at once, larger ones row by row.
SMALL = 32
#: Near pairs a member that a bucket gives one by one; one with more is a crowd, of which only what it connects is given.
PAIRS = 2
#: Tables that tell crowds; the others look only between them.
FIRST = 8
#: Texts, and bytes of their sets, of a crowd that are compared in one piece with as many others.
CROWD, CROWD_BYTES = 8192, 8 << 20
#: Bits of the filter for texts in a pair; 1 MB is sent to tasks.
ASKED = 1 << 23
#: The columns of a wide fingerprint.
BITS = [f"b{k}" for k in range(WIDE // 64)]
#: Odd constants that make WIDE bits out of a 64-bit hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; words as in fingerprint()."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else iter([b" ".join(w)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, max(1, len(w) - width + 1)))


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """WIDE majority bits (0 or 1 each) over distinct hashes."""
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        x = hashes[i : i + (1 << 14), None] * _MIX
        x ^= x >> np.uint64(29)
        x *= _MIX[::-1]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * ones > len(hashes)).astype(np.uint8)


def samples_for(n: int, misses: float = 4.5) -> np.ndarray:
    """Which bits make up each table's key: so many that buckets hold a few of n fingerprints by chance, and so many tables that of pairs just SIMILAR about e^-misses meet in none."""
    bits = max(8, math.ceil(math.log2(max(2, n))) - 4)
    tables = math.ceil(misses / (1 - DIFFER) ** bits)
    rng = np.random.default_rng(7)
    return np.stack([rng.choice(WIDE, bits, replace=False) for _ in range(tables)])


def _all_near(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all near pairs inside runs of equal keys (of at most SMALL), by popcounts."""
    left, right = [], []
    for step in range(1, int(sizes.max()) if len(sizes) else 1):
        ok = sizes > step
        i = np.concatenate([np.arange(a, a + n - step) for a, n in zip(starts[ok].tolist(), sizes[ok].tolist())]) if step > 1 else np.repeat(starts[ok], sizes[ok] - 1) + _runs(sizes[ok] - 1)
        near = np.bitwise_count(fps[i] ^ fps[i + step]).sum(1) <= radius
        left.append(i[near])
        right.append(i[near] + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _runs(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def candidate_pairs(nodes: DataFrame, radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b) that connect nodes (node; b0 to b3: WIDE bits as numbers) as all do that share a sampled key and differ in few of the COMPARED bits."""
    total = nodes.count()
    return candidates(nodes, samples_for(total), total, radius, tile).select("a", "b").distinct()


def candidates(nodes: DataFrame, tables: np.ndarray, total: int, radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b, crowd): near pairs of nodes (see candidate_pairs()) with a key in common, of different roots where nodes have a column `root`.

    Buckets with few near pairs give all of them; one with more than PAIRS a
    member gives a star for each component of its roots, marked as a crowd: pairs
    that it leaves out are inside what the stars connect.
    A bucket of more than `tile` nodes (told by every 64th node; this changes
    only where pairs are found) is dealt into groups, every two of which meet in
    one task.
    """
    own = ["root"] if "root" in nodes.columns else []
    powers = (1 << np.arange(tables.shape[1], dtype=np.int64)).astype(np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                raw = np.stack([np.asarray(c) for c in part.columns[1 : 1 + len(BITS)]], axis=1).astype("<i8").view(np.uint8)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                keys = np.concatenate([bits[:, t].astype(np.int64) @ powers + (i << 40) for i, t in enumerate(tables)])
                words = raw[:, : COMPARED // 8].copy().view("<i8")
                cols = [np.tile(np.asarray(part.column(0)), len(tables)), *(np.tile(words[:, k], len(tables)) for k in range(words.shape[1])), *(np.tile(np.asarray(c), len(tables)) for c in part.columns[1 + len(BITS) :])]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, cols)], ["key", "node", "f0", "f1", *own])

    kinds = ", ".join(f"{c} long" for c in ("key", "node", "f0", "f1", *own))
    rows = nodes.select("node", *BITS, *own).mapInArrow(keyed, kinds)
    every = 64 if total > 64 * tile else 1
    some = nodes.filter(F.pmod("node", F.lit(every)) == 0).select("node", *BITS, *own).mapInArrow(keyed, kinds)
    sizes = some.groupBy("key").agg((F.count("*") * every).alias("n")).filter(F.col("n") > tile)
    if total > tile:  # few rows: each stands for more than `tile` nodes
        rows = rows.join(stored(sizes, "big"), "key", "left")
        groups = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tile)).cast("int")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), groups).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
        met = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))  # the two groups that meet
        rows = rows.select(F.when(groups == 1, F.col("key")).otherwise(met).alias("key"), "node", "f0", "f1", *own)
    dealt = rows.repartition("key").sortWithinPartitions("key", "node")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            key = np.asarray(t["key"])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            if last:
                yield _near(t.slice(0, last), key[:last], radius)
            held = t.slice(last)
        if held is not None and len(held):
            yield _near(held, np.asarray(held["key"]), radius)

    return dealt.mapInArrow(near, "a long, b long, crowd boolean")


def _near(t: pa.Table, key: np.ndarray, radius: int) -> pa.RecordBatch:
    """candidates() of rows sorted by key and node."""
    node, fps = np.asarray(t["node"]), np.stack([np.asarray(t["f0"]), np.asarray(t["f1"])], axis=1).view(np.uint64)
    root = np.asarray(t["root"]) if "root" in t.column_names else node
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    small = (sizes > 1) & (sizes <= SMALL)
    a, b = _all_near(fps, starts[small], sizes[small], radius)
    a, b = a[root[a] != root[b]], b[root[a] != root[b]]
    bucket = np.searchsorted(starts, a, side="right") - 1
    crowded = np.bincount(bucket, minlength=len(starts)) > PAIRS * sizes
    parts = [(a[~crowded[bucket]], b[~crowded[bucket]])]
    for i in np.flatnonzero(sizes > SMALL).tolist():
        at = slice(starts[i], starts[i] + sizes[i])
        pairs = _few_near(fps[at], root[at], radius, PAIRS * int(sizes[i]))
        if pairs is None:
            crowded[i] = True
        else:
            parts.append((starts[i] + pairs[0], starts[i] + pairs[1]))
    n = sum(len(p[0]) for p in parts)
    for i in np.flatnonzero(crowded).tolist():
        at = slice(starts[i], starts[i] + sizes[i])
        top: dict[int, int] = {}  # the first of each tree; nodes come in ascending order
        for x, y in bucket_links(fps[at], radius, root[at]):
            top[y] = top.setdefault(x, x)
        ends = np.array([(x, y) for y, x in top.items() if x != y], np.int64).reshape(-1, 2)
        parts.append((starts[i] + ends[:, 0], starts[i] + ends[:, 1]))
    a, b = (node[np.concatenate([p[i] for p in parts])] for i in (0, 1))
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), np.arange(len(a)) >= n], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2] > 0)], ["a", "b", "crowd"])


def _few_near(fps: np.ndarray, root: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of all near pairs of different roots in one bucket; None: more than `most`."""
    left, right, n = [], [], 0
    for i in range(len(fps) - 1):
        others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        others = others[np.bitwise_count(fps[others] ^ fps[i]).sum(1) <= radius]
        n += len(others)
        if n > most:
            return None
        if len(others):
            left.append(np.full(len(others), i))
            right.append(others)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def set_links(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (distinct numbers) with a Jaccard similarity of at least `similar`: pairs of places, none missed.

    Members are put in order of frequency.  Near sets share one of their first
    members, and what comes after the first that they share bounds all that
    they share; who is left is counted.  Each set is compared only with those
    that are not yet reached.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        x, y = sets
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return [(0, 1)] if shared >= similar * (len(x) + len(y) - shared) else []
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    _, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = (np.sort(row * len(count) + rank[flat]) - row * len(count)).astype(np.int32)
    firsts = np.maximum(sizes - np.ceil(similar * sizes - 1e-9).astype(np.int64) + 1, 0)
    place = _runs(sizes)
    own = np.flatnonzero(place < firsts[row])
    own = own[np.argsort(flat[own], kind="stable")]
    rows, places = row[own].astype(np.int32), place[own].astype(np.int32)  # who has each member among its first, and where
    held = np.bincount(flat[own], minlength=len(count))
    begin = np.cumsum(held) - held
    unseen, left, seen_by = np.ones(len(sets), bool), len(sets), np.full(len(sets), -1, np.int32)
    marked, links = np.zeros(len(count), bool), []
    for first in range(len(sets)):
        if not unseen[first]:
            continue
        unseen[first], left, front = False, left - 1, [first]
        while front and left:
            i = front.pop()
            mine, near = flat[offsets[i] : offsets[i + 1]], []
            for p, m in enumerate(mine[: firsts[i]].tolist()):
                n = held[m]
                if not n:
                    continue
                at = begin[m]
                live = unseen[rows[at : at + n]]
                if not live.all():
                    keep = at + np.flatnonzero(live)
                    n = held[m] = len(keep)
                    rows[at : at + n], places[at : at + n] = rows[keep], places[keep]
                    if not n:
                        continue
                who, where = rows[at : at + n], places[at : at + n]
                new = seen_by[who] != i
                who, where = who[new], where[new]
                seen_by[who] = i
                most = 1 + np.minimum(sizes[i] - p, sizes[who] - where) - 1
                near.append(who[most >= similar * (sizes[i] + sizes[who] - most)])
            if not near:
                continue
            near = np.concatenate(near)
            marked[mine] = True
            for k in range(0, len(near), step := max(1, (1 << 21) // max(1, int(sizes[near].max(initial=1))))):
                who = near[k : k + step]
                n = sizes[who]
                at = np.repeat(offsets[who], n) + _runs(n)
                shared = np.add.reduceat(marked[flat[at]].astype(np.int64), np.cumsum(n) - n)
                found = who[shared >= similar * (sizes[i] + n - shared)]
                unseen[found] = False
                left -= len(found)
                front += found.tolist()
                links += [(i, j) for j in found.tolist()]
            marked[mine] = False
    return links


def crowd_cells(members: DataFrame, most: int = CROWD, most_bytes: int = CROWD_BYTES) -> DataFrame:
    """(met, node): which texts (node, root, bytes) of each root meet; one with more than `most` texts or bytes is dealt into groups, every two of which meet."""
    groups = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("bytes") / most_bytes), F.lit(1)).cast("int")
    rows = members.join(members.groupBy("root").agg(groups.alias("groups")), "root").withColumn("own", F.pmod(F.xxhash64("node"), "groups").cast("int"))
    others = F.when(F.col("groups") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("groups") - 1), F.array("own")))
    return rows.select("node", "root", "own", F.explode(others).alias("other")).select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("met"), "node")


def near_sets(cells: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) that connect the texts (node, shingles) that meet (met, node) exactly as all pairs do whose sets are near."""
    dealt = cells.join(sets, "node").select("met", "node", "shingles").repartition("met").sortWithinPartitions("met", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        def of(nodes, texts):
            return [(nodes[i], nodes[j]) for i, j in set_links(texts, similar)]

        at, nodes, texts, links = None, [], [], []
        for b in batches:
            for met, node, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if met != at:
                    links += of(nodes, texts)
                    at, nodes, texts = met, [], []
                nodes.append(node)
                texts.append(np.frombuffer(x.as_buffer(), np.uint32).copy())
            if len(links) > 50_000:
                yield out(links)
                links = []
        yield out(links + of(nodes, texts))

    return dealt.mapInArrow(linked, "a long, b long")


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(first, root): of each class of texts of equal shingle sets its smallest id, and the component it is in.

    Candidates come from wide fingerprints; a link is a pair whose sets of
    5-word shingles have a Jaccard similarity of at least `similar`, counted
    over all of them (as 32-bit hashes).
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sets = [shingle_hashes(t or "") for t in part.column(1).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                bits = np.packbits(np.array([wide_bits(h) for h in sets], np.uint8), axis=1, bitorder="little").view("<i8")
                small = [np.unique(h.astype(np.uint32)).tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), *map(pa.array, bits.T.copy()), pa.array(small, pa.binary())], ["id", "node", *BITS, "shingles"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = stored(rows.mapInArrow(marked, f"id {rows.schema['id'].dataType.simpleString()}, node long, " + "".join(f"{b} long, " for b in BITS) + "shingles binary"), "marks")
    nodes = stored(marks.groupBy("node").agg(F.min("id").alias("first"), *[F.min(b).alias(b) for b in BITS], F.min(F.length("shingles")).alias("bytes")), "classes")

    def sets_of(ends: DataFrame) -> DataFrame:
        # only texts that are asked for send their sets (told by a bitmap of ASKED bits: a text that only shares its bit leaves in the join), one for
        # each class; a crowd of copies is brought down to one row in each task first
        place = (F.pmod("node", F.lit(ASKED)) + 1).alias("p")
        bitmap = np.zeros(ASKED // 8, np.uint8)
        for r in ends.select(place).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():  # a row for each 32,768 bits
            bitmap[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.asarray(b.column(0)) % ASKED
                yield b.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        return marks.select("node", "shingles").mapInArrow(asked, "node long, shingles binary").join(ends, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))

    total = nodes.count()
    tables = samples_for(total)
    found = stored(candidates(nodes, tables[:FIRST], total).distinct(), "pairs")
    if len(tables) > FIRST:
        known = found.filter("crowd").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        rooted = stored(nodes.join(known, "node", "left").select("node", *BITS, F.coalesce("root", "node").alias("root")), "rooted")
        found = found.unionByName(stored(candidates(rooted, tables[FIRST:], total).distinct(), "pairs"))
    # a crowd's texts are compared where they meet; pairs that lie in one need no look of their own
    crowds = components(contracted(found.filter("crowd")))
    root_of = lambda end: crowds.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    pairs = found.filter("NOT crowd").select("a", "b").distinct().join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    pairs = pairs.filter("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select(F.xxhash64("a", "b").alias("met"), F.explode(F.array("a", "b")).alias("node"))
    cells = stored(crowd_cells(crowds.join(nodes.select("node", "bytes"), "node").select("node", "root", "bytes")).unionByName(pairs), "cells")
    roots = components(contracted(stored(near_sets(cells, sets_of(cells.select("node").distinct()), similar), "near")))
    discard(marks)
    return nodes.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of df, all columns, of each component of similar_texts(): that of the smallest id.

    Rows without an id come after all others, equal ids in the order of a hash
    of all columns, so a null id keeps its row where it is the only one, and of
    repeated rows one stays.  An empty table gives an empty table.  Null and
    empty texts are one component.
    """
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = rows if is_file_scan(df) else stored(rows, "rows")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*df.columns).alias("hash"), F.col("__row").alias("row"))
    found = similar_texts(rows.select(order.alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", similar)
    kept = found.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__kept"))
    return rows.join(kept, rows["__row"] == kept["__kept"], "left_semi").drop("__row")
