"""A table's grid as a relation of cells: places under spans, caption rows, headings, and symbol columns merged into their values."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.passages import text_batches

#: The longest span, symbols that are no values by themselves, and what units, dates, numbers, periods and dashes look like.
SPAN = 1000
MARKERS = ["$", "%", "€", "¥", "£", "₩"]
UNIT = r"\(\s*단위\s*[:：]?\s*[^)]*\)"
DATE = r"\(\s*기준일\s*[:：]\s*\d{4}년\s*\d{1,2}월\s*\d{1,2}일\s*\)"
NUMBER = r"^[\s\d.,()\[\]%$€¥£₩+\-–—/△▲]*\d[\s\d.,()\[\]%$€¥£₩+\-–—/△▲]*$"
PERIOD = r"^(?:(?:19|20)\d{2}(?:\(\d+\))*|\d{1,2}/\d{1,2}/(?:19|20)\d{2}|(?:19|20)\d{2}[./-]\d{1,2}(?:[./-]\d{1,2})?\.?)$"
DASH = r"^[\s$€¥£₩%]*[-–—][\s$€¥£₩%]*$"
SPANS = "array<struct<start_char:bigint,end_char:bigint>>"


#: The patterns as Java reads them: white space and digits are ASCII's, and an end may stand before a last line break.
_END = r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"
_java = lambda pattern: re.compile(re.sub(r"\$\Z", lambda _: _END, pattern), re.ASCII)
_BOTH, _UNIT, _DASH, _NUMBER, _PERIOD = (_java(x) for x in (f"{UNIT}|{DATE}", f"^{UNIT}$", DASH, NUMBER, PERIOD))


@lru_cache(1 << 16)
def is_value(text: str) -> bool:
    """Whether a cell is an amount, dashes included; a period is a label."""
    return bool(_DASH.search(text) or (_NUMBER.search(text) and not _PERIOD.search(text)))


def _annotates(text: str) -> bool:
    """Whether a text is units, and dates beside them, and nothing else."""
    return "단위" in text and not _BOTH.sub("", text).strip(" ") and any(_UNIT.search(m) for m in _BOTH.findall(text))


def _columns(rows: list[int], downs: list[int], acrosses: list[int]) -> list[int]:
    """Each cell's first column: cells of a row stand side by side, past the columns that cells above still span."""
    until: dict[int, int] = {}
    told, row, col = [], None, 0
    for r, down, across in zip(rows, downs, acrosses, strict=True):
        row, col = (r, col) if r == row else (r, 0)
        while until.get(col, -1) >= r:
            col += 1
        told.append(col)
        if down > 1:
            until |= {c: max(until.get(c, -1), r + down - 1) for c in range(col, col + across)}
        col += across
    return told


def _rendered(rows: list[int], cols: list[int], acrosses: list[int], texts: list[str], aligns: list[str | None]) -> dict[int, list[tuple[int, str]]]:
    """Each row's (c, text), where each cell that says something is seen: a right-aligned one in the last of its columns, a centred
    one in all of them that hold other cells' texts somewhere, or else in its first, any other in its first."""
    seen: dict[int, list[tuple[int, str]]] = {}
    full, spread = set(), []
    for r, c, across, text, align in zip(rows, cols, acrosses, texts, aligns, strict=True):
        if text and align == "center" and across > 1:
            spread.append((r, c, across, text))
        elif text:
            c = c + across - 1 if align == "right" else c
            full.add(c)
            seen.setdefault(r, []).append((c, text))
    for r, c, across, text in spread:
        seen.setdefault(r, []).extend((k, text) for k in [k for k in range(c, c + across) if k in full] or [c])
    return seen


def _headed(grid: list[dict[int, str]]) -> int:
    """How many rows are headings: the first that say something beyond the label column and hold no amount, of which one may have a
    label; none if all rows are such. Columns count from 1."""
    n = labels = 0
    for row in grid:
        labels += 1 in row
        if len(row) == (1 in row) or labels > 1 or any(is_value(t) for t in row.values()):
            return n
        n += 1
    return 0


def _moves(grid: list[dict[int, str]], heads: int, width: int) -> dict[int, tuple[int | None, int | None]]:
    """Which columns go, from left to right, as they hold only symbols below the headings, and where their symbols go: a percent sign
    to its left, any other to its right, or to the other side where that column is missing or gone. A column that has taken symbols
    stays."""
    held: dict[int, set[str]] = {}
    for row in grid[heads:]:
        for c, text in row.items():
            held.setdefault(c, set()).add(text)
    gone: dict[int, tuple[int | None, int | None]] = {}
    takes: set[int] = set()
    for c in range(1, width + 1):
        left, right = (c - 1 if c > 1 and c - 1 not in gone else 0), (c + 1 if c < width else 0)
        if c in takes or not (left or right) or c not in held or not all(t in MARKERS for t in held[c]):
            continue
        gone[c] = (left or right if "%" in held[c] else None, right or left if held[c] - {"%"} else None)
        takes |= {t for t in gone[c] if t}
    return gone


def _join(value: str | None, mark: str | None) -> str | None:
    return value if mark is None else mark if value is None else f"{value} %" if mark == "%" else f"{mark} {value}"


def _pair(a: str | None, b: str | None) -> str | None:
    return a if a == b else " ".join(x for x in (a, b) if x is not None) or None


def _merged(grid: list[dict[int, str]], width: int) -> tuple[list[dict[int, str]], dict[int, list[int]]]:
    """The grid with columns that hold only symbols merged into their neighbours' values, in reading order, their headings too; and
    for each of the columns before, the columns that it is part of."""
    heads = _headed(grid)
    gone = _moves(grid, heads, width)
    targets = {c: list(dict.fromkeys(t for t in to if t)) for c, to in gone.items()}
    if not gone:
        return grid, {c: [c] for c in range(1, width + 1)}
    out = []
    for k, row in enumerate(grid):
        sent: dict[int, list[str | None]] = {}
        for c, text in row.items():
            to = [c] if c not in gone else targets[c] if k < heads else [gone[c][0 if text == "%" else 1]]
            for t in to:
                sent.setdefault(t, [None, None, None])[0 if c < t else 1 if c == t else 2] = text
        out.append({t: _pair(_pair(left, own), right) if k < heads else _join(_join(own, left), right) for t, (left, own, right) in sent.items()})
    return out, {c: targets.get(c, [c]) for c in range(1, width + 1)}


def _table(rows: list[int], downs: list[int], acrosses: list[int], texts: list[str], aligns: list[str | None], starts: list[int | None], ends: list[int | None]) -> tuple[list[tuple], list[tuple]]:
    """One table's (row_no, col, header, text, sources) and its captions (text, start_char, end_char)."""
    cols = _columns(rows, downs, acrosses)
    seen = _rendered(rows, cols, acrosses, texts, aligns)
    said = {r: " ".join(t for _, t in sorted(seen[r])) for r in sorted(seen)}
    alone = any("단위" in x for x in said.values()) and _annotates(" ".join(said.values()))
    notes = {r: x for r, x in said.items() if alone or _annotates(x)}
    captions = []
    if notes:
        s, e = ([x for x, r, t in zip(of, rows, texts, strict=True) if t and r in notes and x is not None] for of in (starts, ends))
        captions = [(t, min(s, default=None), max(e, default=None)) for t in dict.fromkeys(_BOTH.findall(" ".join(notes.values())))]

    kept = [r for r in said if r not in notes]
    at = {c: n for n, c in enumerate(sorted({c for r in kept for c, _ in seen[r]}), 1)}
    merged, members = _merged([{at[c]: t for c, t in sorted(seen[r])} for r in kept], len(at))
    spans: list[dict[int, set]] = [{} for _ in kept]
    place, places = {r: n for n, r in enumerate(kept)}, list(at)
    for r, down, c, across, s, e in zip(rows, downs, cols, acrosses, starts, ends, strict=True):
        under = [a for k in places[bisect_left(places, c) : bisect_left(places, c + across)] for a in members[at[k]]]
        for n in ([place[r]] if r in place else ()) if down == 1 else range(bisect_left(kept, r), bisect_left(kept, r + down)):
            for a in under:
                spans[n].setdefault(a, set()).add((s, e))
    dense = {a: n for n, a in enumerate(sorted({a for row in (*merged, *spans) for a in row}), 1)}
    # a row that says nothing any more isn't told of
    some = [n for n, row in enumerate(merged) if any(row.values())]
    heads = _headed([{dense[a]: t for a, t in merged[n].items() if t} for n in some])
    order = lambda span: tuple((x is not None, x or 0) for x in span)
    own = [(kept[n], dense[a] - 1, k < heads, merged[n].get(a) or "", sorted(spans[n].get(a, ()), key=order)) for k, n in enumerate(some) for a in sorted({*merged[n], *spans[n]})]
    return own, captions


def _told(by: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, upto = batch.column("of"), 0
            lists = [of.flatten().field(c).to_pylist() for c in ("row_no", "rowspan", "colspan", "text", "align", "start_char", "end_char")]
            table, out, spans, offsets, notes, noted = [], ([], [], [], []), ([], []), [0], ([], [], []), [0]
            for n, size in enumerate(of.value_lengths().to_pylist()):
                own, captions = _table(*(x[upto : upto + size] for x in lists))
                upto += size
                if captions:
                    own.append((None, None, None, None, None))
                table += [n] * len(own)
                for *row, sources in own:
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
                    for s, e in sources or ():
                        spans[0].append(s)
                        spans[1].append(e)
                    offsets.append(len(spans[0]))
                    noted.append(len(notes[0]))
                if captions:
                    for x, v in zip(notes, zip(*captions, strict=True), strict=True):
                        x += v
                    noted[-1] = len(notes[0])
            kinds = {f.name: f.type for f in schema}
            lists_of = lambda name, at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(values, kinds[name].value_type, strict=True)], fields=list(kinds[name].value_type)), type=kinds[name])  # noqa: B023, E731
            columns = [batch.column(c).take(pa.array(table, pa.int64())) for c in by] + [pa.array(x, kinds[c]) for c, x in zip(("row_no", "col", "header", "text"), out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, lists_of("sources", offsets, spans), lists_of("captions", noted, notes)], schema=schema)

    return run


def told(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_no, col, header, text, sources, captions): both relations of `structured` as one, so that one pass tells both. A
    table's captions stand in a row of their own that has nothing else; other rows have none.

    cells: (by, row_no, cell_no, text, rowspan, colspan, align, start_char, end_char). Spans that are missing or below 1 count as 1,
    and as SPAN at most. All cells of a table meet in one shuffle and nothing is shuffled again: what follows is one table's own.
    Cells without a row stand nowhere and are left out.
    """
    text_batches(cells.sparkSession)
    span = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)), F.lit(SPAN)).cast("int").alias(c)
    cell = F.struct(F.col("row_no").cast("int").alias("row_no"), F.col("cell_no").cast("int").alias("cell_no"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), span("rowspan"), span("colspan"), "align", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))
    one = cells.where("row_no IS NOT NULL").select(*by, cell.alias("cell")).groupBy(*by).agg(F.sort_array(F.collect_list("cell")).alias("of"))
    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "row_no int, col int, header boolean, text string", f"sources {SPANS}", "captions array<struct<text:string,start_char:bigint,end_char:bigint>>"])
    return one.mapInArrow(_told(by, to_arrow_schema(cells.sparkSession.createDataFrame([], schema).schema)), schema)


def structured(cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two relations of tables' source cells, as `tables.pack` takes them: (by, row_no, col, header, text, sources), columns from 0 and
    with the spans of all source cells that a column's place is covered by; and (by, captions) with their texts and the spans of their
    rows' cells.

    Blank rows and columns are left out, caption rows become captions, symbol columns are merged, headings are told by shape. Null
    texts are blank; repeated cells of one place have no defined order; tables without cells give no rows.
    """
    both = told(cells, by)
    return both.where("row_no IS NOT NULL").drop("captions"), both.where("row_no IS NULL").select(*by, "captions")
