"""Formulas of whole sheets in Arrow batches: references as cell numbers, chains by doubling, averages as their parts become known."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells that are gathered, in whole sheets, before they are worked out.
GATHERED = 100_000
#: Rounds of averages that wait for others; deeper ones go to the slow way.
ROUNDS = 2000
ROW_BITS, COL_BITS = 31, 15
#: What Java's `$` lets follow, and what its `.` is not.
NO_DOT = r"\n\r\x{85}\x{2028}\x{2029}"
END = rf"(?:\r\n|[{NO_DOT}])?$"
AVERAGE = rf"(?i)^AVERAGE\((?P<inner>[^{NO_DOT}]*)\){END}"
#: sheets.REFERENCE, for Arrow.
REFERENCE = rf"^(?:(?:'(?P<quoted>[^']+)'|(?P<plain>[^'!]+))!)?(?P<c1>[A-Za-z]{{1,3}})(?P<r1>[0-9]+)(?::(?P<c2>[A-Za-z]{{1,3}})(?P<r2>[0-9]+))?{END}"
SPLIT = "\U0010ffff"


def _ramp(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for each i, lengths[i] of them."""
    ends = np.cumsum(lengths)
    return np.repeat(start - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _ints(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _edges(sheet: np.ndarray, row: np.ndarray, col: np.ndarray, own: np.ndarray, rect: list[np.ndarray], is_open: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cell that it names) of references `rect` of the cells `own`, for cells that are there; sheets with more than `most` become open."""

    def fitting(n: np.ndarray) -> np.ndarray:
        is_open[np.bincount(sheet[own], weights=n, minlength=len(is_open)) > most] = True
        return ~is_open[sheet[own]]

    key = lambda s, c, r: (s << (ROW_BITS + COL_BITS)) | (c << ROW_BITS) | r
    named = np.flatnonzero((row >= 0) & (row < 1 << ROW_BITS) & (col > 0) & (col < 1 << COL_BITS))
    keys = key(sheet[named], col[named], row[named])
    order = np.argsort(keys, kind="stable")
    named, keys = named[order], keys[order]
    r1, c1, r2, c2 = rect
    fits = fitting(c2 - c1 + 1)
    own, r1, c1, r2, c2 = (x[fits] for x in (own, r1, c1, r2, c2))
    wide = c2 - c1 + 1
    c, own, r1, r2 = _ramp(c1, wide), *(np.repeat(x, wide) for x in (own, r1, r2))
    low, high = np.searchsorted(keys, key(sheet[own], c, r1), "left"), np.searchsorted(keys, key(sheet[own], c, r2), "right")
    fits = fitting(high - low)
    own, low, n = own[fits], low[fits], (high - low)[fits]
    return np.repeat(own, n), named[_ramp(low, n)]


def _averages(src: np.ndarray, dst: np.ndarray, is_average: np.ndarray, number: np.ndarray, has: np.ndarray, slow: Callable) -> None:
    """Fills number and has of averages src over dst; what is on cycles, behind them or deep goes to `slow` (see open_values)."""
    n = len(number)
    known = has[dst]
    total, count = np.bincount(src[known], weights=number[dst[known]], minlength=n), np.bincount(src[known], minlength=n)
    waits = is_average[dst]
    s, d = src[waits], dst[waits]
    order = np.argsort(d, kind="stable")
    s, start = s[order], np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])
    left, done = np.bincount(s, minlength=n), ~is_average
    front = np.flatnonzero(is_average & (left == 0))
    for _ in range(ROUNDS):
        if not len(front):
            break
        done[front] = True
        has[front] = count[front] > 0
        number[front] = total[front] / np.maximum(count[front], 1)
        lengths = start[front + 1] - start[front]
        at, told = s[_ramp(start[front], lengths)], np.repeat(front, lengths)
        got = has[told]
        np.add.at(total, at[got], number[told[got]])
        np.add.at(count, at[got], 1)
        np.subtract.at(left, at, 1)
        front = np.unique(at[left[at] == 0])
    rest = ~done[src]
    links = zip(src[rest].tolist(), dst[rest].tolist(), number[dst[rest]].tolist(), has[dst[rest]].tolist(), (~done[dst[rest]]).tolist())
    for cell, value in slow([(c, to, v if there else None, wait) for c, to, v, there, wait in links]).items():
        if value is not None:
            number[cell], has[cell] = value, True


def _parts(inner: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text, part) of texts at their commas outside single quotes: those with an even number of quotes behind them."""
    pieces = pc.split_pattern(inner, "'")
    of, flat = pc.list_parent_indices(pieces).to_numpy(), pc.list_flatten(pieces)
    n = np.bincount(of, minlength=len(inner))
    behind = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(of))
    flat = pc.if_else(pa.array(behind % 2 == 0), pc.replace_substring(flat, ",", SPLIT), flat)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat), "'")
    parts = pc.split_pattern(joined, SPLIT)
    return pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)


def _column_numbers(letters: pa.Array) -> np.ndarray:
    """Of one to three letters; none: 0."""
    text = pc.utf8_lpad(pc.ascii_upper(letters), 3, "@").to_numpy(zero_copy_only=False).astype("S3")
    return (text.view(np.uint8).reshape(-1, 3).astype(np.int64) - 64) @ np.array([676, 26, 1])


def _row_numbers(digits: pa.Array) -> np.ndarray:
    """-1: none, or no 32-bit number."""
    short = pc.utf8_ltrim(digits, "0")
    fits = pc.and_(pc.less_equal(pc.utf8_length(short), 10), pc.not_equal(digits, ""))
    n = pc.if_else(fits, pc.utf8_lpad(short, 1, "0"), "-1").cast(pa.int64()).to_numpy(zero_copy_only=False)
    return np.where(n < 1 << 31, n, -1)


def references(texts: pa.Array, sheets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(readable, average) of each formula and (formula, other sheet, corners) of each reference; see sheets.formula_edges()."""
    texts = pc.utf8_trim(pc.utf8_slice_codeunits(texts, 1), " ")
    inner = pc.struct_field(pc.extract_regex(texts, AVERAGE), "inner")
    average = np.asarray(inner.is_valid())
    plain = np.flatnonzero(~average)
    of, parts = _parts(inner.drop_null())
    of = np.concatenate([np.flatnonzero(average)[of], plain])
    parts = pa.concat_arrays([parts, texts.take(pa.array(plain))])
    found = pc.extract_regex(pc.replace_substring(pc.utf8_trim(parts, " "), "$", ""), REFERENCE)
    is_one = np.asarray(found.is_valid())
    got = {n: pc.fill_null(pc.struct_field(found, n), "") for n in ("quoted", "plain", "c1", "r1", "c2", "r2")}
    r1, c1, r2, c2 = _row_numbers(got["r1"]), _column_numbers(got["c1"]), _row_numbers(got["r2"]), _column_numbers(got["c2"])
    r2, c2 = np.where(r2 < 0, r1, r2), np.where(c2 == 0, c1, c2)
    bad = ~is_one | (r1 < 0) | (~average[of] & ((r1 != r2) | (c1 != c2)))
    readable = np.ones(len(texts), bool)
    readable[of[bad]] = False
    to = pc.if_else(pc.equal(got["quoted"], ""), got["plain"], got["quoted"])
    other = np.asarray(pc.and_(pc.not_equal(to, ""), pc.not_equal(to, sheets.take(pa.array(of)))))
    kept = readable[of] & (r1 <= r2) & (c1 <= c2)
    return readable, average, of[kept], other[kept], [x[kept] for x in (r1, c1, r2, c2)]


def _begins(rows: pa.Table) -> np.ndarray:
    """Whether a cell is the first of its sheet; names that are null are equal."""
    out = np.ones(len(rows), bool)
    out[1:] = False
    for name in ("workbook", "sheet"):
        c = rows[name].combine_chunks()
        null = np.asarray(c.is_null())
        out[1:] |= ~np.asarray(pc.fill_null(pc.equal(c[1:], c[:-1]), False)) & ~(null[1:] & null[:-1])
    return out


def worked_out(rows: pa.Table, most: int, cached: bool, slow: Callable) -> pa.Table:
    """workbook, sheet, row, col, number of whole sheets' cells that have one; a null number in a sheet that is left open.

    rows: workbook, sheet, row, col, size, number, formula (null: a number).
    Open are sheets that name others or have more than `most` cells or named
    cells; of these only cached numbers are given.
    """
    rows = rows.combine_chunks()
    sheet = np.cumsum(_begins(rows)) - 1
    row, col = _ints(rows["row"].combine_chunks()), _ints(rows["col"].combine_chunks())
    has = np.asarray(rows["number"].combine_chunks().is_valid())
    is_cached, number = has.copy(), np.array(pc.fill_null(rows["number"].combine_chunks(), 0.0))
    is_open = np.zeros(sheet[-1] + 1 if len(sheet) else 0, bool)
    is_open[sheet[np.asarray(pc.greater(rows["size"].combine_chunks(), most))]] = True
    is_open_by_size = is_open.copy()
    named = np.asarray(rows["workbook"].combine_chunks().is_valid()) & np.asarray(rows["sheet"].combine_chunks().is_valid())
    at = np.flatnonzero(~has & named & ~is_open_by_size[sheet])
    readable, average, of, other, rect = references(rows["formula"].combine_chunks().take(pa.array(at)), rows["sheet"].combine_chunks().take(pa.array(at)))
    is_average, is_bare = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    is_average[at], is_bare[at] = readable & average, readable & ~average
    own = at[of]
    is_open[sheet[own[other]]] = True
    src, dst = _edges(sheet, row, col, own, rect, is_open, most)
    kept = ~is_open[sheet[src]]
    src, dst = src[kept], dst[kept]
    # Bare references: to the ends of their chains; -1: to nothing, or in a circle.
    to = np.full(len(rows), -1)
    bare = is_bare[src] & (src != dst)
    to[src[bare]] = dst[bare]
    for _ in range(len(rows).bit_length() + 1):
        on = np.flatnonzero(to >= 0)
        on = on[is_bare[to[on]]]
        if not len(on):
            break
        to[on] = to[to[on]]
    to[(to >= 0) & is_bare[to]] = -1
    of_average = is_average[src]
    src, dst = src[of_average], dst[of_average]
    dst = np.where(is_bare[dst], to[dst], dst)
    kept = (dst >= 0) & (dst != src)
    is_average &= ~is_open[sheet]
    _averages(src[kept], dst[kept], is_average, number, has, slow)
    ends = np.flatnonzero(to >= 0)
    ends = ends[has[to[ends]]]
    number[ends], has[ends] = number[to[ends]], True
    given = has if cached else has & ~is_cached
    marks = _begins(rows) & is_open[sheet]  # one cell of an open sheet says so
    out = rows.select(["workbook", "sheet", "row", "col"])
    values = out.filter(pa.array(given)).append_column("number", pa.array(number[given]))
    says = out.filter(pa.array(marks))
    return pa.concat_tables([values, says.append_column("number", pa.nulls(len(says), pa.float64()))])


def sheet_by_sheet(batches: Iterator[pa.RecordBatch], most: int, cached: bool, slow: Callable) -> Iterator[pa.RecordBatch]:
    """worked_out() of cells that come sheet by sheet; a sheet of more than `most` cells (size) is not held."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        large = batch["size"][-1].as_py() > most
        if sum(map(len, held)) < GATHERED and not large:
            continue
        rows = pa.concat_tables(held)
        n = len(rows) if large else int(np.flatnonzero(_begins(rows))[-1])
        if n:
            yield from worked_out(rows.slice(0, n), most, cached, slow).to_batches()
        held = [rows.slice(n)] if n < len(rows) else []
    if held:
        yield from worked_out(pa.concat_tables(held), most, cached, slow).to_batches()
