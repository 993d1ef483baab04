"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

Base kinds are patterns.  The method adds spans of kind ``novel``: strings of
16 characters or more in a sensitive context, whose marginal compressed size,
with zstandard primed by the corpus's own identifiers, common identifiers and
the surrounding text, stays near their length, or near what the same characters
take in random order without a primer (long strings of a small alphabet).  Code,
prose and names that the surroundings explain compress away; keys do not.

A context is sensitive if one of the `CONTEXT` words stands in the `BEFORE` code
points before the string, or a novel string ends in the `CARRY` before it (the
lines of a key, the parts of a token); `AROUND` code points on either side are
the surroundings.  The identifiers of the corpus are the words before `=`, `(`
and `:`, counted over all texts, cut into words of 3 to 12 letters (no key is
that short); the `DICTIONARY` most frequent ones prime the compressor.  No
compressor tells 16 letters of a word from 16 random ones, so a string without
digits must also surprise the corpus: its letters' bits under the counts of
letter triples of all texts must reach `SURPRISE` (long words of the corpus stay
near 3, random letters near 7), and names in camel case or with underscores
that read like words are passed over.

Spans are code points, end exclusive, of the whole match.  In the patterns,
case-insensitive letters are ASCII letters.

Defined results: null or empty text has no spans; repeated rows each give a
row; an empty table gives an empty table; other columns are ignored (redact()
carries them).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.simple8b import groups_of
from helixframe.llm.util import stored, texts_of

#: The base kinds in order, their patterns, the group measured and its least length.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
#: Long enough runs only, which match where the plain pattern's matches of that length do.
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Words that make a context sensitive.
CONTEXT = re.compile(r"passphrase|passcode|pwd|credential|authorization|bearer|(?:private|access|signing|secret|api)[ _-]?key|client[ _-]?id|signature|session[ _-]?id|cookie|encryption|\bkeys?[\"']?\x20*[:=]|" + "|".join(KEYWORDS))
#: Strings of these characters; points join them, as in web tokens.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST = 16
NAMED = re.compile(r"[A-Za-z][A-Za-z0-9_-]*=(?=[^=])")
#: Identifiers that code shows anywhere.
IDENTIFIERS = (
    "abstract argument array assert async await boolean buffer bytes callback catch class client code config connection const "
    "constructor container context continue controller copy count create database default define delete description document "
    "element error event example exception export extends false field file filter final float format function global handler "
    "header host identifier implements import include index information initialize input instance integer interface iterator "
    "length library license list local location manager message method module namespace number object option output override "
    "package parameter parent password path pattern port private process property protected public query range reader record "
    "reference register release request resource response result return schema select sequence server service session setting "
    "source static status stream string struct super switch system table target template thread timeout token transform true "
    "type undefined update user value variable version virtual void volatile while width window writer 0123456789 abcdef"
)
#: Code points of surrounding text on either side, code points before a candidate that make its context, and the least bits a character.
AROUND, BEFORE, BITS = 1500, 48, 6.0
#: The least share of the unprimed size, and the least bits of entropy of a string measured by it.
SHARE, ENTROPY = 0.93, 64
#: Code points that may lie between a novel string and one that it makes suspicious, the least bits a letter of a string without digits, and identifiers of the corpus that prime the compressor.
CARRY, SURPRISE, DICTIONARY = 8, 4.9, 500
#: Identifiers counted in a task before their counts are handed on.
HELD = 200_000
SUBWORD = re.compile(r"[A-Z]{3,12}(?![a-z])|[A-Za-z][a-z]{2,11}")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-z]{5}")
#: Where a name of several words has its seams.
COMPOUND = re.compile(r"[a-z][A-Z]|_|-|/")
CASES = re.compile(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+")


#: 1 to 26 for a letter in either case, 0 for all else.
_LETTER = np.zeros(256, np.int32)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = np.arange(1, 27)


def triples(raw: bytes) -> np.ndarray:
    """Numbers (base 27) of all letter triples."""
    c = _LETTER[np.frombuffer(raw, np.uint8)]
    return c[:-2] * 729 + c[1:-1] * 27 + c[2:] if len(c) > 2 else np.zeros(0, np.int32)


def letter_bits(counts: np.ndarray) -> np.ndarray:
    """The bits of a third letter after two others, from counts of triples, those of common identifiers among them."""
    counts = counts + 200.0 * np.bincount(triples(IDENTIFIERS.encode()), minlength=27**3)
    pairs = counts.reshape(729, 27).sum(1)
    return -np.log2((counts + 0.5) / (np.repeat(pairs, 27) + 13.5)).astype(np.float32)


def corpus_knowledge(df: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> tuple[str, np.ndarray]:
    """The most frequent identifier words of all texts, one text, and letter_bits() of all texts.

    Counted in tasks and added up by Spark; `most` words and at most 27^3 counts reach the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        letters = np.zeros(27**3, np.int64)

        def out(words, ns, kind) -> pa.RecordBatch:
            none = pa.nulls(len(ns), pa.string() if kind else pa.int32())
            words = pa.array(words, pa.int32() if kind else pa.string())
            return pa.RecordBatch.from_arrays([none, words, pa.array(ns, pa.int64())] if kind else [words, none, pa.array(ns, pa.int64())], ["word", "triple", "n"])

        for b in batches:
            for texts in groups_of(b.column(0)):
                parts = pc.split_pattern_regex(texts.cast(pa.large_string()), "[=(:]")
                named = pc.struct_field(pc.extract_regex(parts.values, r"""(?P<id>[A-Za-z_][A-Za-z0-9_]{2,})["']? ?$"""), "id")
                inner = np.ones(len(named), bool)
                inner[parts.offsets.to_numpy()[1:] - 1] = False  # nothing comes after a text's last part
                named = pc.if_else(pa.array(inner), named, None)
                for x in pc.value_counts(named.drop_null()).to_pylist():
                    for w in SUBWORD.findall(x["values"]):
                        totals[w] += x["counts"]
                letters += np.bincount(triples(b"\n".join(t.as_buffer() for t in texts)), minlength=27**3)
            if len(totals) > HELD:
                yield out(list(totals), list(totals.values()), 0)
                totals.clear()
        yield out(list(totals), list(totals.values()), 0)
        seen = np.flatnonzero(letters)
        yield out(seen, letters[seen], 1)

    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(counted, "word string, triple int, n long")
    sums = stored(rows.groupBy("word", "triple").agg(F.sum("n").alias("n")), "identifiers")
    top = sums.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(most).collect()
    counts = np.zeros(27**3)
    for r in sums.filter("triple IS NOT NULL").collect():  # at most 27^3 rows
        counts[r["triple"]] = r["n"]
    return " ".join(r["word"] for r in reversed(top)), letter_bits(counts)  # the most frequent nearest to the text


def surprise(candidate: str, letters: np.ndarray) -> float:
    """Bits a letter of a candidate's triples."""
    found = triples(candidate.encode())
    return float(letters[found].mean()) if len(found) else 0.0


def reads_like_words(candidate: str) -> bool:
    parts = [x for x in re.split("[^A-Za-z]+", candidate) if len(x) > 2]
    for x in parts:
        low = x.lower()
        if not CASES.fullmatch(x) or 4 * sum(map(low.count, "aeiouy")) < len(x) or CONSONANTS.search(low):
            return False
    return True


def marginal_bits(candidate: str, before: str, after: str, known: str = "") -> float:
    """Bits a character that the candidate adds when identifiers and its surroundings are known."""
    primer = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + known + "\n" + after + "\n" + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return 8 * (len(press.compress(candidate.encode())) - len(press.compress(b""))) / len(candidate)


def unexplained_bits(candidate: str) -> float:
    """Bits a character of the same characters in random order without a primer; infinite if they hold too little entropy."""
    n = len(candidate)
    if sum(k * math.log2(n / k) for k in Counter(candidate).values()) < ENTROPY:
        return math.inf
    draw = random.Random(n)
    mixed = "".join(sorted(candidate, key=lambda _: draw.random()))
    press = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, write_dict_id=False)
    return 8 * (len(press.compress(mixed.encode())) - len(press.compress(b""))) / n


def is_novel(candidate: str, before: str, after: str, bits: float = BITS, known: str = "") -> bool:
    got = marginal_bits(candidate, before, after, known)
    return got >= bits or got >= SHARE * unexplained_bits(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    found = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(k in low for k in KEYWORDS) or kind == "access" and "AKIA" not in text:
            continue
        for m in (HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


def novel_spans(text: str, taken: list[tuple[int, int, str]], bits: float = BITS, known: str = "", letters: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if not CONTEXT.search(low):
        return found
    if len(low) != len(text):  # a few letters have longer lower cases; places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    last = -CARRY - 1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if e - s < LEAST or any(a < e and s < b for a, b, _ in taken):
            continue
        word = m[0]
        named = NAMED.match(word)
        if named:  # a name and = before the string are its context
            s, word = s + named.end(), word[named.end() :]
            if len(word) < LEAST:
                continue
        if not any(c.isdigit() for c in word) and _is_name(word, letters):
            continue
        if (s - last <= CARRY or CONTEXT.search(low, max(0, s - BEFORE), s)) and is_novel(word, text[max(0, s - AROUND) : s], text[e : e + AROUND], bits, known):
            found.append((s, e, "novel"))
            last = e
    return found


def _is_name(word: str, letters: np.ndarray | None) -> bool:
    """Whether a string without digits is made of the corpus's letters as its words are, or is a name of several words."""
    if letters is None:
        return reads_like_words(word)
    return surprise(word, letters) < SURPRISE or bool(COMPOUND.search(word)) and reads_like_words(word)


def spans_of(text: str, known: str = "", letters: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed, the method's last."""
    rank = {k: i for i, k in enumerate(["assign", "access", "hex", "novel"])}
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, known=known, letters=letters), key=lambda x: (x[0], rank[x[2]], x[1]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of each whole text; narrow after the count of identifiers."""
    known, letters = corpus_knowledge(df, text_col)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t.as_py(), known, letters)] for t in b.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = texts_of(df, id_col, text_col)
    return rows.mapInArrow(scanned, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df, all columns, with every span of the text replaced by the mark; null texts stay null."""
    at = df.columns.index(text_col)
    known, letters = corpus_knowledge(df, text_col)

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        parts, done = [], 0
        for s, e, _ in spans_of(text, known, letters):
            if s >= done:
                parts += [text[done:s], mark]
            done = max(done, e)
        return "".join(parts) + text[done:] if done else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([masked(t.as_py()) for t in b.column(at)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (text) from scan_secrets()."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
