"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds) and selectivity (share it rejects) are measured on
a random sample of about `SAMPLE` rows, where they lie; then rules run in falling order of rejection per cost, and a text
leaves at the first rule that rejects it.  What several rules need (words,
lines, repeated windows) is computed once, when first asked for.  The order
changes only the time: a text is kept if no rule rejects it.  `rejected_by` is
the first rule to do so in this run's order, which depends on measured times.
Where the base figures are asked for (`features`), they are computed for every
text, so only the other rules can be saved.

Words are runs of anything but space and tab to carriage return.

Defined results: null or empty text has no words and fails; repeated rows each
give a row; an empty table gives an empty table (and the rules keep the order
given); other columns are ignored or, in keep_good(), carried.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.util import texts_of

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows, on average, on which costs and selectivities are measured.
SAMPLE = 2000


class Doc:
    """One text and what rules ask of it, each computed at most once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8").split()  # splits bytes at just these six spaces

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, until = 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered += i + 3 - max(until, i)
                until = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    """rejects: whether a document goes."""

    name: str
    rejects: Callable[[Doc], bool]


#: The rules that every corpus gets.
BASE = [
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
]
#: Stricter signs of junk; far from anything that prose shows.
MORE = [
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.word_chars),
    Rule("duplicate_lines", lambda d: 10 * d.n_dup_lines > 7 * len(d.lines)),
    Rule("long_words", lambda d: d.word_chars > 40 * d.n_words),
    Rule("short_words", lambda d: 2 * d.word_chars < 3 * d.n_words),
]


def measure(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(name, seconds a row, share rejected) of each rule over a random sample, measured on the executors that hold it; no text moves."""

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, spent, rejected = 0, [0.0] * len(rules), [0] * len(rules)
        for b in batches:
            for t in b.column(1):
                n += 1
                for i, rule in enumerate(rules):
                    doc = Doc(t.as_py())  # without what other rules have computed
                    began = time.perf_counter()
                    rejected[i] += bool(rule.rejects(doc))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(rules)))), pa.array([n] * len(rules)), pa.array(spent), pa.array(rejected)], ["rule", "n", "spent", "rejected"])

    some = texts_of(df, id_col, text_col).sample(min(1.0, sample / max(1, df.count())), seed=7)
    got = some.mapInArrow(timed, "rule long, n long, spent double, rejected long")
    sums = {r["rule"]: r for r in got.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")).collect()}
    return [(r.name, sums[i]["spent"] / max(1, sums[i]["n"]), sums[i]["rejected"] / max(1, sums[i]["n"])) if i in sums else (r.name, 0.0, 0.0) for i, r in enumerate(rules)]


def ordered(rules: list[Rule], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """By rejection per cost, falling; a rule that rejects nothing comes last, cheapest first."""
    key = {name: (-rejected / max(cost, 1e-9), cost) for name, cost, rejected in measured}
    return sorted(rules, key=lambda r: key[r.name])


def cascade(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", features: bool = False, sample: int = SAMPLE) -> DataFrame:
    """doc_id, kept and rejected_by (null: kept) of each whole text; with features, also the base figures of every text."""
    rules = BASE + MORE if rules is None else rules
    order = ordered(rules, measure(df, rules, id_col, text_col, sample))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if features else []

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by, rows = [], []
            for t in b.column(1):
                doc = Doc(t.as_py())
                by.append(next((r.name for r in order if r.rejects(doc)), None))
                rows.append([getattr(doc, f) for f in figures])
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(figures))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x is None for x in by]), pa.array(by, pa.string()), *cols], ["doc_id", "kept", "rejected_by", *figures])

    rows = texts_of(df, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judged, f"doc_id {key}, kept boolean, rejected_by string" + "".join(f", {f} long" for f in figures))


def keep_good(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of df, all columns, that no rule rejects; narrow."""
    rules = BASE + MORE if rules is None else rules
    order = ordered(rules, measure(df, rules, df.columns[0], text_col, sample))
    at = df.columns.index(text_col)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = (Doc(t.as_py() or "") for t in b.column(at))
            yield b.filter(pa.array([not any(r.rejects(d) for r in order) for d in docs], pa.bool_()))

    return df.mapInArrow(passing, df.schema)
