"""Mismatch scans of oligos against transcripts.

Transcripts are cut into tiles (a tile owns the windows that start in it) and
windows become numbers, two bits a base, batch by batch (functions/packed.py).
Windows and targets meet on one of k + 1 pieces, of which a window with at most
k mismatches must match one exactly: bit slices of the numbers.  Few targets
(their number is counted first) go to the tasks, where windows meet them as
they are cut, so that only matches become rows; more are joined by a shuffle,
where a pair counts only at its first matching piece, so nothing has to be
made distinct.  Where pieces are so short that they tell little, targets are
opened into all strings near their halves.  Oligos of all lengths share one pass.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import packed
from helixframe.functions.packed import ODD_BITS, WORD, changes, piece_edges
from helixframe.functions.seq import mismatch_positions, normalize_rna, reverse_complement
from helixframe.operators import lineage

#: Windows owned by a tile, targets that are sent to tasks at most, targets that one copy of a transcript carries (about), entries of a task's table of opened targets.
TILE, FEW, CARRIED, OPENED = 256, 2000, 16, 1 << 22


def query_regions(queries: DataFrame, regions: list[tuple[str, int | None, int | None]]) -> DataFrame:
    """One row for each oligo and scan region with the region's sequence and its target; a region past the end has an error."""
    spark = queries.sparkSession
    rows = [(i, name, start, end) for i, (name, start, end) in enumerate(regions)]
    table = spark.createDataFrame(rows, "region_order int, as_region string, region_start int, region_end int")
    rna = queries.withColumn("antisense_5to3", normalize_rna("seq"))
    both = rna.crossJoin(F.broadcast(table))
    start, end = F.coalesce("region_start", F.lit(1)), F.coalesce("region_end", F.length("antisense_5to3"))
    both = both.withColumn("as_region_start", start).withColumn("as_region_end", end)
    both = both.withColumn("error", F.when(end > F.length("antisense_5to3"), F.lit("Scan region ends past the antisense sequence.")))
    region = F.when(F.col("error").isNull(), F.substr("antisense_5to3", "as_region_start", F.col("as_region_end") - F.col("as_region_start") + 1))
    return both.withColumn("as_region_sequence", region).withColumn("target_5to3", reverse_complement("as_region_sequence"))


def tiles(transcripts: DataFrame, longest: int, size: int = TILE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(accession, carried columns, offset, tile, owned): pieces of size + longest - 1 bases; the windows that start in the first `owned` are its own."""
    rows = transcripts.select("accession", *carried, normalize_rna("seq").alias("seq")).filter("seq <> ''")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "seq"]
    names = ("accession", *carried)

    def cut(batches):
        for batch in batches:
            for row, offset, tile, owned in packed.tiles(batch.column("seq"), size, longest - 1):
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(row) for n in names], offset, tile, owned], [*names, "offset", "tile", "owned"])

    return rows.mapInArrow(cut, ", ".join(kinds) + ", offset int, tile string, owned int")


def spread(cut: DataFrame, source: DataFrame) -> DataFrame:
    """The tiles of a source that is too small for all cores, dealt evenly; those of a large one where they are."""
    spark = cut.sparkSession
    estimate = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return cut.repartition(4 * cores) if estimate < 2 * cores << 27 else cut


def windows(transcripts: DataFrame, lengths: list[int], size: int = TILE) -> DataFrame:
    """(accession, start, size, window): every window of these lengths without other letters, 1-based start."""
    cut = spread(tiles(transcripts, max(lengths), size), transcripts)
    sizes = F.array(*[F.lit(n) for n in lengths])
    return _cutouts(cut.withColumn("size", F.explode(sizes)) if len(lengths) > 1 else cut.withColumn("size", F.lit(lengths[0])))


def _cutouts(cut: DataFrame) -> DataFrame:
    """(accession, start, size, window) of tiles with a window size each."""
    last = F.least("owned", F.length("tile") - F.col("size") + 1)
    pure = F.col("tile").rlike("^[ACGU]*$").alias("pure")
    at = cut.filter(last >= 1).select("accession", "offset", "tile", pure, "size", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    cutout = at.select("accession", (F.col("offset") + F.col("i")).cast("int").alias("start"), "size", "pure", F.substr("tile", "i", "size").alias("window"))
    return cutout.filter(F.col("pure") | F.col("window").rlike("^[ACGU]+$")).drop("pure")


def own_matches(transcripts: DataFrame, asked: DataFrame, lengths: list[int], max_mismatches: int) -> DataFrame:
    """(target, accession, start, window, mismatches) of targets (accession, target, size) on the transcripts that they name.

    Each transcript carries its targets as an array and its windows are compared
    where they are cut: transcripts are shuffled once (or not at all, where the
    arrays are small enough to be broadcast), windows never.  An accession with
    many targets is dealt over several copies of its transcript.
    """
    copies = asked.groupBy("accession").agg(F.ceil(F.count("*") / CARRIED).alias("copies"))
    dealt = asked.join(copies, "accession").withColumn("copy", F.pmod(F.xxhash64("target"), F.col("copies")))
    arrays = dealt.groupBy("accession", "size", "copy").agg(F.collect_list("target").alias("targets")).drop("copy")
    held = transcripts.join(arrays, "accession").filter(F.length("seq") >= F.col("size"))
    cut = tiles(held, max(lengths), carried=("size", "targets"))

    def compared(batches):
        for batch in packed.slices(batches):
            for n in batch.column("size").unique().to_pylist():
                yield packed.own_rows(batch.filter(pc.equal(batch.column("size"), n)), n, max_mismatches)

    return cut.mapInArrow(compared, f"target string, accession {_kind(cut)}, start int, window string, mismatches int")


def _kind(df: DataFrame) -> str:
    return df.schema["accession"].dataType.simpleString()


def code(x, part: int = 0) -> Column:
    """Bases WORD*part+1.. of a sequence, two bits each, as a long; letters that are not bases never come here."""
    text = F.substr(x, F.lit(WORD * part + 1), F.lit(WORD))
    return F.coalesce(F.conv(F.translate(text, "ACGU", "0123"), 4, 10).cast("long"), F.lit(0).cast("long"))


def bases(number: Column, size: Column) -> Column:
    """The sequence of a number."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), size, F.lit("0")), "0123", "ACGU")


def code_mismatches(a, b) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ODD_BITS)))


def seeds_tell(length: int, k: int) -> bool:
    """Whether pieces match chance windows seldom enough: on random bases under half of all pairs are compared."""
    return length > k and sum(4.0 ** (a - b) for a, b in piece_edges(length, k)) < 0.5


def _by_size(lengths: list[int], value) -> Column:
    """A number that depends on the column `size`."""
    first, *rest = lengths
    out = F.when(F.col("size") == first, F.lit(value(first)))
    for n in rest:
        out = out.when(F.col("size") == n, F.lit(value(n)))
    return out.cast("long")


def _pieces(number: str, masks: list[Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(no).alias("no"), F.col(number).bitwiseAND(m).alias("piece")) for no, m in enumerate(masks)]))


def _masks(lengths: list[int], edges) -> list[Column]:
    """The bits of each piece where they stand in a window's number; edges: the pieces of a length."""
    mask = lambda n, no: (lambda a, b: (1 << 2 * (n - a)) - (1 << 2 * (n - b)))(*edges(n)[no])
    return [_by_size(lengths, lambda n: mask(n, no)) for no in range(len(edges(lengths[0])))]  # noqa: B023


def _seeded(seen: DataFrame, asked: DataFrame, lengths: list[int], k: int, few: bool) -> DataFrame:
    """Pairs of windows and targets (numbers w and t) within k mismatches, over the pieces; at most WORD bases."""
    masks = _masks(lengths, lambda n: piece_edges(n, k))
    left = seen.withColumn("p", _pieces("w", masks)).select("*", "p.no", "p.piece").drop("p")
    right = asked.withColumn("p", _pieces("t", masks)).select("*", "p.no", "p.piece").drop("p")
    return _checked(left.join(F.broadcast(right) if few else right, ["size", "no", "piece"]), masks, k)


def _checked(pairs: DataFrame, masks: list[Column], k: int) -> DataFrame:
    """Candidate pairs within k mismatches, each at its first piece that matches."""
    differs = F.col("w").bitwiseXOR(F.col("t"))
    first = reduce(lambda a, b: a & b, [(F.col("no") <= no) | (differs.bitwiseAND(masks[no]) != 0) for no in range(len(masks) - 1)], F.lit(True))
    return pairs.withColumn("mismatches", code_mismatches(F.col("w"), F.col("t"))).filter((F.col("mismatches") <= k) & first)


def _neighbours(seen: DataFrame, asked: DataFrame, length: int, k: int, few: bool) -> DataFrame:
    """Pairs within k mismatches where seeds tell nothing: one half of the window has at most k // 2 of them.

    Targets are opened into all strings near each half, which meet the windows'
    halves in an equi-join.
    """
    near, edges = k // 2, piece_edges(length, 1)
    masks = _masks([length], lambda n: piece_edges(n, 1))
    left = seen.withColumn("p", _pieces("w", masks)).select("*", "p.no", "p.piece").drop("p")
    opened = [F.transform(F.array(*[F.lit(x).cast("long") for x in changes(a, b, length, near)]), lambda x: F.struct(F.lit(no).alias("no"), F.col("t").bitwiseAND(masks[no]).bitwiseXOR(x).alias("piece"))) for no, (a, b) in enumerate(edges)]  # noqa: B023
    right = asked.withColumn("p", F.explode(F.concat(*opened))).select("*", "p.no", "p.piece").drop("p")
    pairs = left.join(F.broadcast(right) if few else right, ["size", "no", "piece"])
    again = code_mismatches(F.col("w").bitwiseAND(masks[0]), F.col("t").bitwiseAND(masks[0])) <= near  # the first half found it already
    return pairs.withColumn("mismatches", code_mismatches(F.col("w"), F.col("t"))).filter((F.col("mismatches") <= k) & ((F.col("no") == 0) | ~again))


def _numbered_pairs(seen: DataFrame, asked: DataFrame, lengths: list[int], k: int, plan: str, few: bool) -> list[DataFrame]:
    """Pairs of the windows of tiles (size, w) and targets (size, t) within k mismatches, by the plan that suits each length."""
    if few:
        return [_few_pairs(seen, asked, k, plan)]
    by_seed = [n for n in lengths if n > k and plan != "scan" and (plan == "seed" or seeds_tell(n, k))]
    of = lambda n: (packed_windows(seen, n), asked.filter(F.col("size").isin(n)))
    found = [_seeded(*of(by_seed), by_seed, k, few)] if by_seed else []
    return found + [_neighbours(*of([n]), n, k, few) for n in lengths if n not in by_seed]


def _few_pairs(seen: DataFrame, asked: DataFrame, k: int, plan: str) -> DataFrame:
    """The pairs where tiles lie: FEW targets at most go to the tasks."""
    wanted: dict[int, list[str]] = {}
    for r in asked.select("target", "size").collect():
        wanted.setdefault(r["size"], []).append(r["target"])

    def seeds(n: int, targets: int) -> bool:
        opened = max(packed.chance(b - a, 0, k // 2) * 4.0 ** (b - a) for a, b in piece_edges(n, 1) if a < b)
        return n > k and plan != "scan" and (plan == "seed" or packed.chance(n, k, 0) <= packed.chance(n, 1, k // 2) or opened * targets > OPENED)

    def near(batches):
        tables = [packed.Targets(texts, n, k, seeds(n, len(texts))) for n, texts in sorted(wanted.items())]
        for batch in packed.slices(batches):
            for table in tables:
                yield packed.near_rows(batch, table)

    return seen.mapInArrow(near, f"target string, accession {_kind(seen)}, start int, size int, w bigint, mismatches int")


def window_matches(transcripts: DataFrame, targets: DataFrame, length: int | list[int], max_mismatches: int, plan: str = "auto", per_accession: bool = False) -> DataFrame:
    """(target, accession, start, window, mismatches) for distinct targets (column target_5to3) of these lengths.

    plan: seed, scan (neighbours of halves) or auto, for each length what
    promises fewer comparisons.  With per_accession a target (column
    target_accession) meets only its own transcript: see own_matches().
    """
    k = max_mismatches
    lengths = [length] if isinstance(length, int) else sorted(length)
    asked = targets.select(F.col("target_5to3").alias("target"), *([F.col("target_accession").alias("accession")] if per_accession else [])).distinct()
    asked = asked.filter(F.col("target").rlike("^[ACGU]+$")).withColumn("size", F.length("target"))
    if per_accession:
        return own_matches(transcripts, asked, lengths, k)
    few = asked.limit(FEW + 1).count() <= FEW
    short, found = [n for n in lengths if n <= WORD], []
    if short:
        seen = spread(tiles(transcripts, max(short)), transcripts)
        pairs = _numbered_pairs(seen, asked.withColumn("t", code("target")), short, k, plan, few)
        found += [p.select("target", "accession", "start", bases(F.col("w"), F.col("size")).alias("window"), "mismatches") for p in pairs]
    for n in (n for n in lengths if n > WORD):
        if n <= k:
            raise ValueError(f"{k} mismatches are all bases of a target of {n}")
        parts, edges = range(-(-n // WORD)), piece_edges(n, k)
        seen = windows(transcripts, [n]).select("accession", "start", "window", *[code("window", p).alias(f"w{p}") for p in parts])
        wanted = asked.filter(F.col("size") == n).select("target", *[code("target", p).alias(f"t{p}") for p in parts])
        count = reduce(lambda a, b: a + b, [code_mismatches(F.col(f"w{p}"), F.col(f"t{p}")) for p in parts])
        piece = lambda x, no: F.substring(x, edges[no][0] + 1, edges[no][1] - edges[no][0])  # noqa: B023, E731
        cut = lambda x: F.explode(F.array(*[F.struct(F.lit(no).alias("no"), piece(x, no).alias("piece")) for no in range(k + 1)]))  # noqa: B023, E731
        left = seen.withColumn("p", cut("window")).select("*", "p.no", "p.piece").drop("p")
        right = wanted.withColumn("p", cut("target")).select("*", "p.no", "p.piece").drop("p")
        first = reduce(lambda a, b: a & b, [(F.col("no") <= no) | (piece("window", no) != piece("target", no)) for no in range(k)], F.lit(True))
        pairs = left.join(F.broadcast(right) if few else right, ["no", "piece"]).filter(first)
        found.append(pairs.withColumn("mismatches", count).filter(F.col("mismatches") <= k).select("target", "accession", "start", "window", "mismatches"))
    return reduce(DataFrame.unionByName, found)


def scan(queries: DataFrame, transcripts: DataFrame, regions: list[tuple[str, int | None, int | None]], max_mismatches: int = 3, plan: str = "auto", per_accession: bool | None = False) -> DataFrame:
    """The 15 fields of each match, and the orders that sort it.

    queries: input_order, name, seq (and target_accession where per_accession);
    transcripts: accession, seq.  A window longer than its transcript gives
    nothing.  per_accession: each oligo meets only the transcript it names, and
    oligos that name none are skipped; None: so if any oligo names one.
    """
    if per_accession is None:
        per_accession = "target_accession" in queries.columns and not queries.filter("target_accession <> ''").isEmpty()
    asked = query_regions(queries, regions).filter("target_5to3 IS NOT NULL AND target_5to3 <> ''")
    if per_accession:
        asked = asked.filter("target_accession <> ''")
    lengths = [r[0] for r in asked.select(F.length("target_5to3")).distinct().collect()]  # a row a distinct oligo length
    hits = window_matches(transcripts, asked, lengths or [1], max_mismatches, plan, per_accession)
    same = F.col("target_5to3") == F.col("target")
    found = asked.join(hits, same & (F.col("target_accession") == F.col("accession")) if per_accession else same)
    as_view = reverse_complement("window")
    return found.select(
        "input_order", "region_order", F.col("accession").alias("transcript_name"), F.col("name").alias("antisense_name"), "as_region",
        "as_region_start", "as_region_end", "antisense_5to3", "as_region_sequence", F.col("target_5to3").alias("expected_target_5to3"),
        F.col("start").alias("transcript_start"), (F.col("start") + F.length("window") - 1).alias("transcript_end"), F.col("mismatches"),
        F.col("window").alias("matched_target_5to3"), as_view.alias("matched_as_view_5to3"),
        mismatch_positions("window", "target_5to3").alias("target_mismatch_positions"), mismatch_positions(as_view, "as_region_sequence").alias("as_mismatch_positions"),
    )


def in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("input_order", "region_order", "mismatches", "transcript_name", "transcript_start")


def missing_accessions(wanted: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Accessions asked for that are not in the transcript table."""
    return wanted.filter("target_accession <> ''").select(F.col("target_accession").alias("accession")).distinct().join(transcripts.select("accession"), "accession", "left_anti")


#: Targets of each strand: an oligo binds its reverse complement (the transcript read backwards against the oligo), and finds itself on the other.
STRANDS = {"minus": reverse_complement, "plus": lambda x: F.col(x)}


def packed_windows(cut: DataFrame, lengths: list[int]) -> DataFrame:
    """(accession, start, size, w): all windows of these lengths that tiles own, two bits a base."""
    if max(lengths) > WORD:
        raise ValueError(f"windows of more than {WORD} bases don't fit in one number")

    def numbers(batches):
        for batch in packed.slices(batches):
            for n in lengths:
                yield packed.window_rows(batch, n)

    return cut.mapInArrow(numbers, f"accession {_kind(cut)}, start int, size int, w bigint")


def oligo_targets(queries: DataFrame, strands: tuple[str, ...]) -> DataFrame:
    """(input_order, name, strand, target, size, t) of each oligo of pure bases."""
    rna = queries.select("input_order", "name", normalize_rna("seq").alias("rna")).filter(F.col("rna").rlike("^[ACGU]+$"))
    each = [rna.select("input_order", "name", F.lit(s).alias("strand"), STRANDS[s]("rna").alias("target")) for s in strands]
    return reduce(DataFrame.unionByName, each).withColumns({"size": F.length("target"), "t": code("target")})


def offtarget_topk(queries: DataFrame, transcripts: DataFrame, max_mismatches: int = 3, k: int = 50, plan: str = "auto", strands: tuple[str, ...] = ("minus",), index: SeedIndex | None = None) -> DataFrame:
    """Best k hits of each oligo over all transcripts, in the 12-column hit layout (ungapped; no e-value, no bit score), and the strand.

    The radius grows: exact hits first, then those with 1, 2, ... mismatches,
    each round only for oligos that have fewer than k hits, so an oligo of many
    repeats never lists its near ones.  Fewer mismatches mean longer seeds.
    Tiles are cut once, or windows come from an index that was written before.
    """
    asked = lineage.cut(oligo_targets(queries, strands))
    lengths = sorted(r[0] for r in asked.select("size").distinct().collect())  # a row a distinct oligo length
    if index is None and lengths:
        if lengths[-1] > WORD:
            raise ValueError(f"windows of more than {WORD} bases don't fit in one number")
        seen = lineage.stored(spread(tiles(transcripts, lengths[-1]), transcripts), "tiles")
    open_, rounds = asked.withColumn("have", F.lit(0).cast("long")), []
    for r in range(max_mismatches + 1) if lengths else ():
        wanted = open_.select("target", "size", "t").distinct()
        if index is not None:
            pairs = [index.pairs(wanted, r)]
        else:
            pairs = _numbered_pairs(seen, wanted, lengths, r, plan, wanted.limit(FEW + 1).count() <= FEW)
        exact = reduce(DataFrame.unionByName, [p.filter(F.col("mismatches") == r).select("target", "accession", "start", "size", "w") for p in pairs])
        best = Window.partitionBy("input_order").orderBy("accession", "start", "strand")
        hits = open_.drop("size", "t").join(exact, "target").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        hits = hits.withColumn("rank", (F.col("rank") + F.col("have")).cast("int")).filter(F.col("rank") <= k)
        rounds.append(lineage.stored(hits.withColumn("mismatches", F.lit(r)), f"hits{r}"))
        if r < max_mismatches:
            more = rounds[-1].groupBy("input_order").agg(F.count("*").alias("more"))
            open_ = lineage.cut(open_.join(more, "input_order", "left").withColumn("have", F.col("have") + F.coalesce("more", F.lit(0))).drop("more").filter(F.col("have") < k))
            if open_.isEmpty():
                break
    if not rounds:
        rounds = [asked.select("input_order", "name", "strand", "target", F.lit("").alias("accession"), F.lit(0).alias("start"), "size", F.col("t").alias("w"), F.lit(0).alias("rank"), F.lit(0).alias("mismatches")).limit(0)]
    hits, size = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rounds), F.col("size")
    first, last = F.col("start"), F.col("start") + F.col("size") - 1
    minus = F.col("strand") == "minus"
    return hits.select(
        F.col("name").alias("query_id"), F.col("accession").alias("subject_id"), F.round(100.0 * (size - F.col("mismatches")) / size, 3).alias("percent_identity"),
        size.alias("alignment_length"), "mismatches", F.lit(0).alias("gap_opens"), F.lit(1).alias("query_start"), size.alias("query_end"),
        F.when(minus, last).otherwise(first).alias("subject_start"), F.when(minus, first).otherwise(last).alias("subject_end"), F.lit(None).cast("double").alias("evalue"), F.lit(None).cast("double").alias("bit_score"), "rank", "strand",
    )


class SeedIndex:
    """Packed windows of one length at a path, a row for each of k + 1 pieces, bucketed and sorted by piece.

    Written once, it serves any number of query sets with up to k mismatches:
    only their targets are shuffled (or broadcast), the windows lie where the
    join wants them.  A window within r mismatches keeps one of any r + 1
    pieces, so a smaller radius reads the first r + 1.
    """

    def __init__(self, spark, path: str, length: int, max_mismatches: int, buckets: int, table: str):
        self.spark, self.path, self.length, self.k, self.buckets, self.table = spark, path, length, max_mismatches, buckets, table

    @classmethod
    def write(cls, transcripts: DataFrame, path: str, length: int, max_mismatches: int = 3, buckets: int = 64, table: str = "seed_index") -> SeedIndex:
        masks = _masks([length], lambda n: piece_edges(n, max_mismatches))
        rows = packed_windows(spread(tiles(transcripts, length), transcripts), [length]).withColumn("p", _pieces("w", masks)).select("accession", "start", "size", "w", "p.no", "p.piece")
        # dealt by the buckets' hash, so that a task writes one file of each of its buckets
        rows.repartition(buckets, "no", "piece").write.bucketBy(buckets, "no", "piece").sortBy("no", "piece").option("path", path).format("parquet").saveAsTable(table)
        return cls(transcripts.sparkSession, path, length, max_mismatches, buckets, table)

    @classmethod
    def open(cls, spark, path: str, length: int, max_mismatches: int = 3, buckets: int = 64, table: str = "seed_index") -> SeedIndex:
        """An index that another session wrote, with the length, radius and buckets it was written with."""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (accession string, start int, size int, w bigint, no int, piece bigint) USING parquet CLUSTERED BY (no, piece) SORTED BY (no, piece) INTO {buckets} BUCKETS LOCATION '{path}'")
        return cls(spark, path, length, max_mismatches, buckets, table)

    def pairs(self, asked: DataFrame, radius: int) -> DataFrame:
        """Pairs of the index's windows and targets (target, size, t) within a radius of at most k."""
        if radius > self.k:
            raise ValueError(f"the index was written for {self.k} mismatches")
        masks = _masks([self.length], lambda n: piece_edges(n, self.k))[: radius + 1]
        right = asked.filter(F.col("size") == self.length).withColumn("p", _pieces("t", masks)).select("target", "t", "p.no", "p.piece")
        return _checked(self.spark.table(self.table).filter(F.col("no") <= radius).join(right, ["no", "piece"]), masks, radius)
