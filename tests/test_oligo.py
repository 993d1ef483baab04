import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import hits, oligo, scan
from helixframe.plans import sinks
from helixframe.sources import readers


def scanned(spark, antisense, transcript, k, regions=None, plan="auto"):
    q = spark.createDataFrame([(1, "antisense_query", antisense)], "input_order int, name string, seq string")
    t = spark.createDataFrame([("test_transcript", transcript)], "accession string, seq string")
    return sinks.match_rows(scan.scan(q, t, regions or [("full", None, None)], k, plan)).collect()


def test_exact_scan(spark):
    (row,) = scanned(spark, "AUGC", "GGGCAUTTT", 0)
    assert tuple(map(str, row)) == ("test_transcript", "antisense_query", "full", "1", "4", "AUGC", "AUGC", "GCAU", "3", "6", "0", "GCAU", "AUGC", "", "")


@pytest.mark.parametrize("plan", ["scan", "seed"])
def test_one_mismatch(spark, plan):
    (row,) = scanned(spark, "AUGC", "GGGCAAUUU", 1, plan=plan)
    assert (row["matched_target_5to3"], row["matched_as_view_5to3"], row["mismatches"], row["target_mismatch_positions"], row["as_mismatch_positions"]) == ("GCAA", "UUGC", 1, "4", "1")


def test_region_scan_and_short_transcript(spark):
    (row,) = scanned(spark, "AUGC", "GGCAUU", 0, [("seed", 2, 3)])
    assert (row["as_region_sequence"], row["expected_target_5to3"], row["transcript_start"], row["matched_as_view_5to3"]) == ("UG", "CA", 3, "UG")
    assert scanned(spark, "AUGCAUGC", "AUG", 3) == []


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_plans_agree(spark, k):
    t = spark.createDataFrame([("a", "ACGUUGCAACGGUACGAUCGAUUACGGCAUACGUAGC" * 20), ("b", "ACG"), ("c", "AAAAAAAAAAAAAAAAA")], "accession string, seq string")
    for length in (2, 3, 12, 33):
        targets = spark.createDataFrame([("ACGUUGCAACGGUACGAUCGAUUACGGCAUACGUAGC"[i : i + length],) for i in range(3)] + [("A" * length,)], "target_5to3 string")
        got = {p: {tuple(r) for r in scan.window_matches(t, targets, length, k, p).collect()} for p in ("scan", "seed")}
        assert got["scan"] == got["seed"] and got["scan"]
        brute = {(x[0], a, i + 1, s[i : i + length], sum(c != d for c, d in zip(x[0], s[i : i + length]))) for x in targets.collect() for a, s in t.collect() for i in range(len(s) - length + 1)}
        assert got["scan"] == {b for b in brute if b[4] <= k}


def test_regions():
    assert seq.scan_region("seed:2-8") == ("seed", 2, 8)
    assert seq.scan_region(":2-8") == ("2-8", 2, 8)
    assert seq.scan_regions(None) == [("full", None, None)]
    for bad in ("", "x", "5-2", "0-3"):
        with pytest.raises(ValueError):
            seq.scan_region(bad)


def test_process_table_blanks_on_error(spark):
    df = spark.createDataFrame([("",), ("AUGX",), ("AUGCAUGCAU",), ("atgcatgcatgcatgcatgc",)], "a string")
    rows = oligo.process_table(df, "a").collect()
    assert [r["error"] for r in rows] == ["Sequence is empty after cleanup.", "Sequence contains invalid bases: X", "Sequence must be at least 18 nt long.", ""]
    assert all(r["normalized_antisense"] == "" for r in rows[:3]) and rows[3]["antisense_2-18_5to3"] == "UGCAUGCAUGCAUGCAU"


def test_coordinates(spark):
    df = spark.createDataFrame([(s, "3") for s in ("1,0", "2.0", "12.5", "0", "", "abc", "1")], "start string, end string")
    t = spark.createDataFrame([("t", "ACGUA")], "accession string, seq string")
    rows = {r["start"]: (r["SS matched"], r["match error"]) for r in oligo.fill_ranges(df, t).collect()}
    assert rows["2.0"] == ("CG", "") and rows[""] == ("", "") and rows["1"] == ("ACG", "")
    assert rows["12.5"][1] == "start must be a whole number: 12.5" and rows["abc"][1] == "start is not a number: abc" and rows["0"][1] == "start must be 1 or greater: 0"


def test_duplicates_and_packing(spark):
    q = spark.createDataFrame([(1, "AS_A", "AUGC"), (2, "AS_B", "CCGA"), (3, "AS_C", "ATGC")], "input_order long, name string, seq string")
    got = {r["name"]: (r["is_duplicate"], r["duplicate_names"]) for r in oligo.annotate_queries(q).collect()}
    assert got == {"AS_A": (True, "AS_A;AS_C"), "AS_B": (False, ""), "AS_C": (True, "AS_A;AS_C")}
    packed = oligo.pack_batches(q.repartition(3), 8)
    assert [r["batch_index"] for r in packed.orderBy("input_order").collect()] == [1, 1, 2]
    assert [r["batch_index"] for r in oligo.pack_batches(q, 3).orderBy("input_order").collect()] == [1, 2, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("AS_001,AUGC\n# no\n\nCCGA\nAS_003\tUUAA\n")
    assert [(r["name"], r["seq"]) for r in readers.read_antisense(spark, str(tmp_path / "list.txt")).orderBy("input_order").collect()] == [("AS_001", "AUGC"), ("AS_2", "CCGA"), ("AS_003", "UUAA")]
    (tmp_path / "a.fa").write_text("﻿dropped\n>one\nAC\nGT\n>\nTT\n", encoding="utf-8")
    assert [(r["name"], r["seq"]) for r in readers.read_antisense(spark, str(tmp_path / "a.fa")).orderBy("input_order").collect()] == [("one", "ACGU"), ("AS_2", "UU")]
    assert tuple(readers.read_transcripts(spark, str(tmp_path / "a.fa")).first())[0] == "one"
    (tmp_path / "t.csv").write_text("id,antisense,target_accession,species,notes\nAS_A,AUGC,NM_001,human,lead\n,,x,,\n,CCGA,NM_002,mouse,backup\n")
    rows = readers.read_oligo_table(spark, str(tmp_path / "t.csv")).orderBy("input_order").collect()
    assert [(r["name"], r["seq"], r["target_accession"], r["target_gene"]) for r in rows] == [("AS_A", "AUGC", "NM_001", ""), ("AS_3", "CCGA", "NM_002", "")]
    lines = spark.createDataFrame([("# c",), ("",), ("a,b,c",), ('q,"x,y",1,2,3,4,5,6,7,8,9,10',), ("q,x,1,2,3,4,5,6,7,8,9,10,11",)], "value string")
    assert [r["subject_id"] for r in readers.parse_hits(lines).collect()] == ["x,y"]
    text = spark.createDataFrame([("    RID = ABC123\n    RTOE = 42\n",)], "t string")
    assert text.select(seq.service_field("t", "RID"), seq.service_field("t", "RTOE")).first() == ("ABC123", "42")


def test_hits(spark):
    q = spark.createDataFrame([(1, "a b", "ACGUACGUAC"), (2, "a_b", "ACGUA")], "input_order int, name string, seq string")
    h = spark.createDataFrame([("a_b", "4", "1", "0"), ("a_b", "3", "1", "0"), ("zz", "9", "0", "0"), ("a_b", "5", "x", "0")], "query_id string, alignment_length string, mismatches string, gap_opens string")
    enriched = hits.enrich_hits(h, q)
    assert {(r["alignment_length"], r["alignment_fraction"]) for r in enriched.collect()} == {("4", 0.8), ("3", 0.6), ("9", None), ("5", 1.0)}
    assert [r["alignment_length"] for r in hits.filter_hits(enriched).collect()] == ["4"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for sheet, n in (("s:1", 1), ("s2", 2), ("s:1", 3)):
        sinks.replace_sheet(df.withColumn("a", F.lit(n)), str(tmp_path / "book"), "w", sheet)
    assert {(r["sheet"], r["a"]) for r in sinks.read_store(spark, str(tmp_path / "book")).collect()} == {("s_1", 3), ("s2", 2)}
    text = spark.range(1).select(sinks.fasta_text(F.lit("my oligo"), F.lit("U" * 81))).first()[0]
    assert text == ">my_oligo\n" + "T" * 80 + "\nT"
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert sinks.read_store(spark, str(tmp_path / "log")).count() == 2
    for run, batch, added in (("r", "1", True), ("r", "1", False), ("r", "2", True), ("q", "1", True), ("r", "2", False)):
        assert sinks.append_log(df, str(tmp_path / "runs"), run, batch) == added
    assert sinks.read_store(spark, str(tmp_path / "runs")).count() == 3


def test_oligo_table_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Oligo ID,AS  Sequence,RefSeq Accession,Accession,Organism,Comment\na,AUGC,NM_1,no,no,no\nb,NA,NM_2,,,\n")
    (row,) = readers.read_oligo_table(spark, str(tmp_path / "t.csv")).collect()
    assert tuple(row) == (1, "a", "AUGC", "NM_1", "", "", "")
    (tmp_path / "empty.txt").write_text("# nothing\n")
    with pytest.raises(ValueError):
        readers.read_antisense(spark, str(tmp_path / "empty.txt"))
    with pytest.raises(ValueError):
        readers.transcript_input(spark, sequence="A", accession="x")
    table = spark.createDataFrame([("x", "ATG")], "accession string, seq string")
    assert tuple(readers.transcript_input(spark, accession="x", table=table).first()) == ("x", "AUG")
    assert tuple(readers.transcript_input(spark, sequence=">h 1\nAT\n;c\nGC").first()) == ("h 1", "AUGC")
    with pytest.raises(ValueError):
        readers.transcript_input(spark, accession="y", table=table)


def test_hit_limits_take_whole_parts(spark):
    q = spark.createDataFrame([(1, "a", "ACGUA")], "input_order int, name string, seq string")
    h = spark.createDataFrame([("a", "5.9", "1.0", "0.0"), ("a", "5", "1e0", "0"), ("a", "5", "nan", "0")], "query_id string, alignment_length string, mismatches string, gap_opens string")
    assert [(r["alignment_length"], r["alignment_fraction"]) for r in hits.filter_hits(hits.enrich_hits(h, q)).collect()] == [("5.9", 1.0), ("5", 1.0)]


def test_packing_over_ranges_matches_one_pass(spark):
    import random

    rng = random.Random(1)
    made = [(i, rng.choice(["hot", "hot", "hot", None, f"k{i % 5}"]), "A" * rng.choice([0, 1, 3, 5, 9, 30])) for i in range(800)]
    df = spark.createDataFrame([(i, k, s, "n") for i, k, s in made], "input_order long, job string, seq string, name string").repartition(5)
    expected, state = {}, {}
    for i, k, s in made:
        batch, used = state.get(k, (0, 0))
        batch, used = (batch + 1, len(s)) if not batch or used + len(s) > 12 else (batch, used + len(s))
        state[k], expected[i] = (batch, used), batch
    assert {r["input_order"]: r["batch_index"] for r in oligo.pack_batches(df, 12, "job").collect()} == expected
    whole, out, used, batch = oligo.pack_batches(df, 12), {}, 0, 0
    for i, _, s in made:
        batch, used = (batch + 1, len(s)) if not batch or used + len(s) > 12 else (batch, used + len(s))
        out[i] = batch
    assert {r["input_order"]: r["batch_index"] for r in whole.collect()} == out
    assert oligo.pack_batches(df.limit(0), 12).count() == 0


def test_numbering_duplicates_and_one_transcript(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x int").repartition(4)
    assert sorted((r["x"], r["input_order"]) for r in oligo.numbered(df, ["x"]).collect()) == [(i, i + 1) for i in range(50)]
    q = spark.createDataFrame([(1, "a", "AUGC"), (2, "b", "CCGA"), (3, "c", "ATGC")], "input_order long, name string, seq string")
    assert [(r["is_duplicate"], r["duplicate_group"], r["duplicate_count"]) for r in oligo.flag_duplicates(q).orderBy("input_order").collect()] == [(True, 1, 2), (False, None, 1), (True, 1, 2)]
    assert sorted((r["duplicate_group"], r["name"]) for r in oligo.duplicate_members(q).collect()) == [(1, "a"), (1, "c")]
    two = spark.createDataFrame([("t", "A"), ("u", "C")], "accession string, seq string")
    with pytest.raises(ValueError):
        oligo.fill_ranges(spark.createDataFrame([("1", "1")], "start string, end string"), two)


def test_scan_per_accession(spark):
    q = spark.createDataFrame([(1, "a", "AUGC", "t1"), (2, "b", "AUGC", "t2"), (3, "c", "AUGC", "")], "input_order int, name string, seq string, target_accession string")
    t = spark.createDataFrame([("t1", "GGGCAUUUGCAU"), ("t2", "GCAA"), ("t3", "GCAU")], "accession string, seq string")
    for k, expected in ((0, [("a", "t1", 3), ("a", "t1", 9)]), (1, [("a", "t1", 3), ("a", "t1", 9), ("b", "t2", 1)])):
        got = scan.scan(q, t, [("full", None, None)], k, per_accession=None).collect()
        assert sorted((r["antisense_name"], r["transcript_name"], r["transcript_start"]) for r in got) == expected
    none = q.withColumn("target_accession", F.lit(""))
    assert scan.scan(none, t, [("full", None, None)], 0, per_accession=None).count() == 9


def test_region_columns(spark):
    rows = seq.region_table(spark, ["full", "2-8", " a b : 3 - 4", ":2-8", "", "9-3", "x"]).orderBy("region_order").collect()
    assert [(r["name"], r["start"], r["end"], r["error"] is None) for r in rows] == [("full", None, None, True), ("2-8", 2, 8, True), ("a b", 3, 4, True), ("2-8", 2, 8, True), (None, None, None, False), (None, None, None, False), (None, None, None, False)]


def test_store_is_swapped(spark, tmp_path, monkeypatch):
    path, ids = str(tmp_path / "t"), lambda: sorted(r[0] for r in sinks.read_store(spark, str(tmp_path / "t")).collect())
    spark.range(3).write.parquet(path)
    assert ids() == [0, 1, 2]
    sinks.update_in_place(sinks.read_store(spark, path).withColumn("id", F.col("id") + 10), path)
    assert ids() == [10, 11, 12]

    class Stop(Exception):
        pass

    def stops(*_):
        raise Stop

    more = lambda: sinks.update_in_place(sinks.read_store(spark, path).withColumn("id", F.col("id") + 10), path)
    real = sinks.Store._publish
    for step in ("before the rename", "at the draft", "after the rename"):
        before = ids()
        if step == "before the rename":
            monkeypatch.setattr(sinks.Store, "_publish", stops)
        elif step == "at the draft":
            monkeypatch.setattr(sinks.Store, "_publish", lambda self, n, m: ((tmp_path / "t" / "_manifests" / "draft-x").write_text("{"), stops()))
        else:
            monkeypatch.setattr(sinks.Store, "_publish", lambda self, n, m: (real(self, n, m), stops()))
        with pytest.raises(Stop):
            more()
        monkeypatch.setattr(sinks.Store, "_publish", real)
        assert ids() == ([x + 10 for x in before] if step == "after the rename" else before), step
    more()
    assert ids() == [30 + x for x in (0, 1, 2)]
    store = sinks.Store(spark, path)
    number = store.manifest()[0]
    assert not real(store, number, {}) and store.manifest()[0] == number  # a number that is taken stays as it is
    first = []

    def late(self, n, manifest):
        if not first:  # another writer comes first
            first.append(real(self, n, {**self.manifest()[1], "other": manifest["third"]}))
        return real(self, n, manifest)

    monkeypatch.setattr(sinks.Store, "_publish", late)
    store.put("third", spark.range(100, 101))
    monkeypatch.setattr(sinks.Store, "_publish", real)
    assert first == [True] and set(store.manifest()[1]) == {"table", "other", "third"}
    store.clean()
    assert 100 in ids() and len(list((tmp_path / "t" / "_manifests").glob("0*"))) == 1


def test_packing_keeps_ties_and_blank_orders(spark):
    def brute(rows, budget):
        out, batch, used = [], {}, {}
        for key, order, name, seq in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, len(r[3] or ""), r[2])):
            n = len(seq or "")
            if key not in batch or used[key] + n > budget:
                batch[key], used[key] = batch.get(key, 0) + 1, 0
            used[key] += n
            out.append((key, order, name, batch[key]))
        return sorted(out, key=str)

    rows = [("k", 1, "a", "ACGT"), ("k", 1, "b", "ACGT"), ("k", None, "c", "ACG"), ("k", 2, "d", "ACGTA")]
    rng = random.Random(8)
    rows += [(rng.choice("xyz"), rng.choice([None, *range(6)]), f"n{i:04d}", "A" * rng.randint(0, 13)) for i in range(600)]
    df = spark.createDataFrame(rows, "job string, input_order int, name string, seq string").repartition(7)
    got = oligo.pack_batches(df, 12, "job")
    assert sorted(((r["job"], r["input_order"], r["name"], r["batch_index"]) for r in got.collect()), key=str) == brute(rows, 12)
    stats = oligo.batch_stats(got, "job")
    assert stats.agg(F.sum("query_count")).first()[0] == len(rows) and stats.filter("total_bases > 13").count() == 0
    assert oligo.pack_batches(df.limit(0), 12).count() == 0


def test_own_matches_hot_accession(spark):
    rng = random.Random(2)
    texts = {a: "".join(rng.choices("ACGU", k=n)) for a, n in (("hot", 900), ("b", 300), ("c", 5), ("n", 400))}
    texts["n"] = texts["n"][:200] + "N" + texts["n"][200:]
    asked = [("hot", texts["hot"][i : i + rng.choice([9, 15, 31, 45])]) for i in range(100)] + [("b", texts["hot"][40:55]), ("b", texts["b"][3:18]), ("c", "ACGUACGU"), ("n", texts["n"][188:199]), ("gone", "ACGU")]
    t = spark.createDataFrame(list(texts.items()), "accession string, seq string")
    targets = spark.createDataFrame([(s, a) for a, s in asked], "target_5to3 string, target_accession string")
    lengths = sorted({len(s) for _, s in asked})
    got = scan.window_matches(t, targets, lengths, 3, per_accession=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(accession") <= 4 and "NestedLoop" not in plan and "Cartesian" not in plan
    expected = {(s, a, i + 1, w, m) for a, s in asked if a in texts for i in range(len(texts[a]) - len(s) + 1) for w in [texts[a][i : i + len(s)]] if "N" not in w and (m := sum(x != y for x, y in zip(s, w))) <= 3}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 100


def brute_topk(oligos, texts, most, k, strands):
    rna = {"A": "U", "U": "A", "C": "G", "G": "C"}
    out = set()
    for name, o in oligos:
        hits = []
        for strand in strands:
            target = "".join(rna[c] for c in reversed(o)) if strand == "minus" else o
            hits += [(m, a, i + 1, strand) for a, s in texts.items() for i in range(len(s) - len(o) + 1) if (m := sum(x != y for x, y in zip(target, s[i : i + len(o)]))) <= most]
        out |= {(name, a, m, i, strand, n) for n, (m, a, i, strand) in enumerate(sorted(hits)[:k], 1)}
    return out


def test_growing_radius_of_a_repeat_oligo(spark, monkeypatch):
    rng = random.Random(5)
    texts = {"rep": "ACGUU" * 300, **{f"t{i}": "".join(rng.choices("ACGU", k=300)) for i in range(20)}}
    oligos = [("hot", "AACGUAACGUAACGU"), ("one", texts["t3"][10:25]), ("two", texts["t5"][50:65]), ("short", "ACGUACGUA")]
    q = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(oligos)], "input_order int, name string, seq string")
    t = spark.createDataFrame(list(texts.items()), "accession string, seq string")
    for strands in (("minus",), ("minus", "plus")):
        asked, real = [], scan._numbered_pairs
        monkeypatch.setattr(scan, "_numbered_pairs", lambda seen, wanted, lengths, r, plan, few: (asked.append((r, {x["target"] for x in wanted.collect()})), real(seen, wanted, lengths, r, plan, few))[1])
        got = scan.offtarget_topk(q, t, 3, 20, strands=strands).collect()
        monkeypatch.setattr(scan, "_numbered_pairs", real)
        flat = {(r["query_id"], r["subject_id"], r["mismatches"], min(r["subject_start"], r["subject_end"]), r["strand"], r["rank"]) for r in got}
        assert flat == brute_topk(oligos, texts, 3, 20, strands) and len(got) == len(flat)
        assert all((r["subject_start"] > r["subject_end"]) == (r["strand"] == "minus") for r in got)
        hot = {"ACGUUACGUUACGUU", "AACGUAACGUAACGU"}
        assert asked[0][0] == 0 and hot & asked[0][1] and not any(hot & wanted for r, wanted in asked if r)  # its near hits are never listed
    assert scan.offtarget_topk(q.limit(0), t).count() == 0


def test_seed_index_serves_two_query_sets(spark, tmp_path):
    rng = random.Random(6)
    texts = {f"t{i}": "".join(rng.choices("ACGU", k=400)) for i in range(30)}
    t = spark.createDataFrame(list(texts.items()), "accession string, seq string")
    index = scan.SeedIndex.write(t, str(tmp_path / "index"), 12, 3, buckets=4, table="seed_index_test")
    again = scan.SeedIndex.open(spark, str(tmp_path / "index"), 12, 3, 4, "seed_index_again")
    try:
        for ix, at in ((index, 0), (again, 7)):
            oligos = [(f"o{i}", texts[f"t{i}"][at + i : at + i + 12]) for i in range(6)]
            q = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(oligos)], "input_order int, name string, seq string")
            got = {(r["query_id"], r["subject_id"], r["mismatches"], min(r["subject_start"], r["subject_end"]), r["strand"], r["rank"]) for r in scan.offtarget_topk(q, t, 3, 15, index=ix).collect()}
            assert got == brute_topk(oligos, texts, 3, 15, ("minus",))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = again.pairs(scan.oligo_targets(q, ("minus",)).select("target", "size", "t"), 2)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "SelectedBucketsCount" in plan  # only the targets are shuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE seed_index_test")
        spark.sql("DROP TABLE seed_index_again")


def test_neighbour_join_has_no_cross_join(spark):
    rng = random.Random(7)
    t = spark.createDataFrame([(f"t{i}", "".join(rng.choices("ACGU", k=60))) for i in range(5)], "accession string, seq string")
    for length, k in ((8, 2), (6, 3), (3, 3), (5, 1)):
        targets = spark.createDataFrame([("".join(rng.choices("ACGU", k=length)),) for _ in range(5)], "target_5to3 string")
        got = scan.window_matches(t, targets, length, k, "scan")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        rows = [tuple(r) for r in got.collect()]
        brute = {(x[0], a, i + 1, s[i : i + length], m) for x in targets.collect() for a, s in t.collect() for i in range(len(s) - length + 1) if (m := sum(c != d for c, d in zip(x[0], s[i : i + length]))) <= k}
        assert len(rows) == len(set(rows)) and set(rows) == brute


def test_fasta_and_lists_over_many_splits(spark, tmp_path):
    rng = random.Random(9)

    def record(i):
        head = rng.choice([f">r{i} x", f"  >r{i}", ">", f">>r{i}", f"\t>r{i} > y"])
        end = rng.choice(["\n", "\r\n", "\r"])
        return head + end + end.join("".join(rng.choices("ACGTacgu", k=rng.randint(0, 40))) for _ in range(rng.randint(0, 4))) + "\n"

    made = {"a.fa": "﻿junk\nmore\n" + "".join(map(record, range(300))), "b.fa": "".join(map(record, range(200))), "c.fa": ">only\nACGU", "d.fa": " > x\n", "big.fa": ">one\n" + "ACGT\n" * 400 + ">two\nAC"}
    lists = {"e.txt": "﻿n1,ACGU\n# no\n\n ACG \r\nn3\tAAA\rn4  CCC\x0bGGG\n" + "".join(rng.choice(["ACGU\n", "\n", "#x\n", f"m{i} GG\n", "\r\n"]) for i in range(400)), "f.txt": "ACGT"}
    for name, text in (made | lists).items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        key = lambda df: sorted((r["file"].rsplit("/", 1)[-1], r["input_order"], r["name"], r["seq"]) for r in df.collect())
        whole = readers._texts(spark, str(tmp_path / "*.fa"))
        assert key(readers.read_fasta(spark, str(tmp_path / "*.fa"))) == key(readers.fasta_records(whole))
        texts = readers._texts(spark, str(tmp_path / "*.txt"))
        assert key(readers.read_list(spark, str(tmp_path / "*.txt"))) == key(readers.plain_records(texts))
        both = readers.read_antisense(spark, str(tmp_path / "[a-c,e-f].*"))
        assert key(both) == sorted(r for r in key(readers.fasta_records(whole)) + key(readers.plain_records(texts)) if r[0][0] in "abcef" and r[0] != "big.fa")
        splits = readers._in_splits(spark, str(tmp_path / "a.fa"), "\n>").select("block").distinct().count()
        assert splits > 20
        sizes = readers._in_splits(spark, str(tmp_path / "*.fa"), "\n>").agg(F.max(F.length("value"))).first()[0]
        assert sizes < 2100  # a record, never a file
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "empty.dat").write_text("# none\n\n")
    with pytest.raises(ValueError):
        readers.read_antisense(spark, str(tmp_path / "empty.dat"))


def test_windows_meet_few_targets_where_they_are_cut(spark):
    """Only matches become rows: no row a window, nor a piece of one."""
    t = spark.createDataFrame([("a", "ACGU" * 300 + "NN" + "GGCA" * 5), ("b", ""), ("c", "ACG")], "accession string, seq string")
    targets = spark.createDataFrame([("GUACGUACGUAC",)], "target_5to3 string")
    found = scan.window_matches(t, targets, 12, 2)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["start"], r["mismatches"]) for r in found.collect()) == [(i, 0) for i in range(3, 1200 - 11, 4)]
    cut = scan.tiles(t, 12).collect()
    assert [r["offset"] for r in cut] == [0, 256, 512, 768, 1024, 0] and [r["owned"] for r in cut] == [256] * 4 + [198, 3]
    assert cut[0]["tile"] == ("ACGU" * 67)[:267]
    long = "ACGUU" * 7
    own = spark.createDataFrame([("a", long)], "target_accession string, target_5to3 string")
    here = spark.createDataFrame([("a", "GG" + long[:-1] + "A")], "accession string, seq string")
    assert [tuple(r) for r in scan.window_matches(here, own, 35, 1, per_accession=True).collect()] == [(long, "a", 3, long[:-1] + "A", 1)]


def test_range_cleans_a_transcript_once(spark):
    rows = spark.createDataFrame([("a u-g c", 1, 3), ("augx", 1, 2), (None, 1, 2), ("au", 1, 3)], "seq string, start int, end int")
    out = oligo.transcript_region(rows)
    assert out.filter("error IS NULL")._jdf.queryExecution().executedPlan().toString().count("[^A-Za-z]") == 1
    assert out.columns == ["seq", "start", "end", "transcript_length", "ss_5to3", "as_5to3", "error"] and out.count() == 4
    assert [r["ss_5to3"] for r in out.filter("error IS NULL").collect()] == ["AUG"]
