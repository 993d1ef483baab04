"""Fill-in-middle, random-Fourier quality and token alignment against brute force, the libraries, and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from helixframe.llm import piece_table, queries, rff_quality, token_alignment

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "The the <|endoftext|> isn't  it\n\n\tÉcole ﬁ 漢字 😀\x00\x1c end "), (5, "the quick brown fox " * 4000), (5, "the quick brown fox " * 4000),
    (6, "a" * 70000 + "=" * 3000), (None, "no id at all\nnone"), (7, "▁ x▁▁y  z"), (8, "\n" * 3000 + " " * 3000), (9, "holds <S> itself\nb"), (10, "<\nP>\n<S\n>\nM><"), (11, "}\r\n;\r\n\tx\xa0y \x85z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 0, 0.5, "c") for i, t in ODD], "doc_id long, text string, n string, at int, score double, a string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fim(key, text, fim=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return key, n, "plain", None, None, text
    if h4 % 100 < spm:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_against_brute_force(odd, docs):
    for df in (odd, docs):
        expected = sorted(((*(r := brute_fim(i, t))[:5], sha(r[5]), sha(t)) for i, t in texts(df)), key=str)
        assert sorted(map(tuple, piece_table.digests(df).collect()), key=str) == expected
    assert piece_table.digests(docs.limit(0)).count() == 0


def test_fim_texts_pieces_and_rates(odd, docs):
    for df, fim, spm in ((odd, 100, 50), (docs, 60, 20)):
        made = piece_table.fill_in_middle(df, fim_percent=fim, spm_percent=spm)
        back = piece_table.restore(made.withColumn("extra", F.lit(1)))
        assert back.columns[-2:] == ["extra", "restored"]
        got = back.collect()
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str) == sorted((brute_fim(i, t, fim, spm) for i, t in texts(df)), key=str)
        assert sorted((r["doc_id"], r["restored"]) for r in got if r["doc_id"]) == sorted((i, t) for i, t in texts(df) if i)
        for r in got:
            buffers = (r["restored"].encode(), b"".join(piece_table.SENTINELS.values()))
            assert b"".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r["pieces"]).decode() == r["output"]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        piece_table.restored(b"<P>a<M>b", "psm")


def test_statistics_are_finite(odd):
    for r in rff_quality.document_statistics(odd).collect():
        assert len(r["x"]) == len(rff_quality.STATS) and np.isfinite(r["x"]).all()


def test_pool_adjacent_is_isotonic():
    rng = np.random.default_rng(1)
    for _ in range(30):
        y, w = rng.random(12), rng.integers(1, 9, 12).astype(float)
        got = rff_quality.pool_adjacent(y, w)
        assert (np.diff(got) >= 0).all()
        # min-max formula of isotonic regression
        mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
        assert np.allclose(got, [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)])


def test_sums_over_partitions_are_whole(spark):
    rng = np.random.default_rng(2)
    x, y, fold = rng.random((500, len(rff_quality.STATS))), rng.integers(0, 2, 500), rng.integers(1, 5, 500)
    df = spark.createDataFrame([(int(f), v.tolist(), float(t)) for f, v, t in zip(fold, x, y)], "fold int, x array<double>, y double").repartition(37)
    got = rff_quality.summed(rff_quality.partial_sums(df, lambda v: v, len(rff_quality.STATS)))
    m = np.column_stack([x, y])
    for k in range(1, 5):
        assert np.allclose(got[k].reshape(m.shape[1], -1), m[fold == k].T @ m[fold == k])


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    k = len(rff_quality.STATS)
    model = rff_quality.Model(np.zeros(k), np.ones(k), rng.standard_normal((k, 20000)) / rff_quality.WIDTH, rng.uniform(0, 2 * np.pi, 20000), *(np.zeros(0),) * 3)
    x = rng.standard_normal((6, k))
    z = model.features(x)[:, :-1]
    assert np.allclose(z @ z.T, np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / rff_quality.WIDTH**2), atol=0.05)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_rff_quality(spark, sf).collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([(s > t) + (s == t) / 2 for s in good for t in bad]) > 0.98
    assert np.mean([p == q for _, p, q in held]) > 0.97


def test_quality_odd_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, lang string")
    got = rff_quality.score_documents(odd, none).collect()
    assert len(got) == len(ODD) and {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)}
    alike = spark.createDataFrame([(i, 1, "x") for i in range(12)] + [(None, 0, "x"), (4, None, "x"), (999, 0, "x")], none.schema)
    assert {r["score"] for r in rff_quality.score_documents(odd, alike).collect()} == {1.0}
    few = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(4, 1, "x")], none.schema)
    got = rff_quality.score_documents(odd, few).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert rff_quality.score_documents(odd.limit(0), few).count() == 0


def brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table, names = token_alignment.byte_chars(), {i: t for t, i in a_lib.get_vocab().items()}

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    rows, counts = [], Counter()
    for key, text in docs:
        row = (key, 0, 0, 0, [], "")
        if text:
            ids_a, ids_b, whole = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text), (" " + text).encode()
            spelt_a = [bytes(table[c] for c in names[i]) for i in ids_a]
            spelt_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(spelt_a) == whole == b"".join(spelt_b):
                at_a, at_b = spans(spelt_a), spans(spelt_b)
                groups, links, i, j = [], [], 0, 0
                for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
                    k, m = i, j
                    while i < len(at_a) and at_a[i][1] <= end:
                        i += 1
                    while j < len(at_b) and at_b[j][1] <= end:
                        j += 1
                    groups.append(",".join(map(str, ids_a[k:i])) + "|" + ",".join(map(str, ids_b[m:j])))
                    links += [(ids_a[x], ids_b[y]) for x in range(k, i) for y in range(m, j) if at_a[x][0] < at_b[y][1] and at_b[y][0] < at_a[x][1]]
                row = (key, len(ids_a), len(ids_b), len(groups), links, sha(";".join(groups)))
                counts.update(links)
        rows.append(row)
    most: dict = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((k, a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for k, a, b, g, x, h in rows), key=str), counts


def made_texts():
    rng = random.Random(3)
    letters = list("ab  \n\t\r;{}é漢😀\x00\xa0'<|endoftext|>s1 9.,T　\x85\x1c")
    words = ["<|endoftext|>", "the", "  ", "\n\n", "\n \n", ";\r\n", "}\r", "\t\tx", "isn't", " ", "\r\n", "ﬁ", "<s>", "<0x41>"] + ["▁"] * 1
    return [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))) for i in range(600)] + [(900 + i, "".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(600)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_libraries(spark, docs, odd, small):
    if small:  # blocks of a few documents, and tables that start anew
        made = spark.createDataFrame(made_texts()[:200], "doc_id long, text string").repartition(2)
        index = token_alignment.stored(token_alignment.invert(made, block_docs=24, block_bytes=600, memo=40), "postings")
        assert index.select("block").distinct().count() > 10
        counts = token_alignment.pair_counts(index)
        expected, links = brute_alignment(texts(made))
        assert sorted(map(tuple, token_alignment.aligned(index, counts).collect()), key=str) == expected
        assert {(r["a"], r["b"]): r["n_links"] for r in counts.collect()} == links
        return
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(made_texts(), "doc_id long, text string"))
    expected, links = brute_alignment(texts(df))
    got = token_alignment.align_documents(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected and sum(r[4] > 0 for r in expected) > 1000
    assert token_alignment.align_documents(odd.limit(0)).count() == 0
    assert token_alignment.align_documents(odd.filter("doc_id < 3")).count() == 2


def test_postings_round_trip():
    rng = np.random.default_rng(4)
    for n_docs in (1, 7, 8, 9, 16, 17, 3000, 40000):
        sizes = np.array([1, n_docs, max(1, n_docs // 2), max(1, n_docs // 16), max(1, n_docs // 17), 1])
        docs = np.concatenate([np.sort(rng.choice(n_docs, k, replace=False)) for k in sizes])
        times = rng.choice([1, 1, 1, 2, 5, 70000], len(docs))
        bitmaps, planes = token_alignment.pack_postings(sizes, docs, times, n_docs)
        back_docs, back_times = token_alignment.unpack_postings(sizes, bitmaps, planes, n_docs)
        assert (back_docs == docs).all() and (back_times == times).all()
        firsts = np.cumsum(sizes) - sizes
        assert (token_alignment.popcounts(planes, sizes) == np.add.reduceat(times, firsts)).all()
