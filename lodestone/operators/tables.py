"""Tables as relations of cells: packing into pieces that keep each cell's source, their Markdown, and their cells' spans."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from lodestone.functions.text import collapse

from .chunking import Budget, lexical_plan

#: Fixed value: places between the sentences of a cell.
BETWEEN = r"(?<=[.!?。！？])(?=\s)"
SPANS = "array<struct<start_char:bigint,end_char:bigint>>"
CAPTIONS = "array<struct<text:string,start_char:bigint,end_char:bigint>>"

_CELL = StructType([StructField("i", IntegerType()), StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("told", BooleanType())])
_ROW = StructType([StructField("row_no", LongType()), StructField("cells", ArrayType(_CELL))])
#: Pieces by the numbers of their cells.
PIECES = ArrayType(StructType([StructField("heads", ArrayType(ArrayType(IntegerType()))), StructField("rows", ArrayType(_ROW))]))


class _Table:
    """One table's sizes in tokens and characters, and the pieces that are told from them; no text is here.

    A piece is its columns, for each of them the numbers of its heading's cells, and its rows of (cell, begin, end, role).
    """

    def __init__(self, row_no: list, col: list, header: list, tokens: list, chars: list, sentences: list, base: tuple[int, int], budget: Budget):
        self.cols = sorted(set(col))
        self.rows = sorted({r for r, h in zip(row_no, header, strict=True) if not h})
        self.at = {(r, c): i for i, (r, c, h) in enumerate(zip(row_no, col, header, strict=True)) if not h}
        self.heads: dict[int, list[int]] = {c: [] for c in self.cols}
        for i in sorted((i for i, h in enumerate(header) if h), key=row_no.__getitem__):
            self.heads[col[i]].append(i)
        self.tokens, self.chars, self.sentences, self.base, self.budget = tokens, chars, sentences, base, budget
        # a heading is its rows' texts, one space between them
        self.head_tokens = {c: sum(tokens[i] for i in of) for c, of in self.heads.items()}
        self.head_chars = {c: max(0, sum(chars[i] + 1 for i in of if chars[i]) - 1) for c, of in self.heads.items()}
        self.out: list[tuple] = []

    def size(self, r: int, c: int) -> tuple[int, int]:
        i = self.at.get((r, c))
        return (0, 0) if i is None else (self.tokens[i], self.chars[i])

    def room(self, cols: list[int]) -> tuple[int, int, int]:
        """What is left for rows under the headings of these columns: tokens to the target and to the bound, characters."""
        k, head = len(cols), self.base[0] + sum(self.head_tokens[c] for c in cols)
        lines = 1 + 3 * k + sum(self.head_chars[c] for c in cols) + 1 + 1 + 6 * k
        return self.budget.target - head, self.budget.most - head, self.budget.chars - self.base[1] - lines

    def tell(self, cols: list[int], shown: list[tuple[int, dict[int, tuple[int, int]]]]) -> None:
        """A piece of rows; a column that a row doesn't name is blank there."""
        rows = []
        for r, cells in shown:
            places = [(self.at.get((r, c), -1), *cells.get(c, (0, 0)), c in cells and (r, c) in self.at) for c in cols]
            rows.append((r, places))
        self.out.append(([self.heads[c] for c in cols], rows))

    def groups(self, cols: list[int]) -> list[list[int]]:
        """Columns whose headings leave room for each row, the first one with each group."""
        first = [self.size(r, cols[0]) for r in self.rows]
        out, held, sums = [], cols[:1], first
        for c in cols[1:]:
            target, _, most = self.room([*held, c])
            wider = [(t + x, n + y) for (t, n), (x, y) in zip(sums, (self.size(r, c) for r in self.rows), strict=True)]
            if len(held) > 1 and (max(t for t, _ in wider) > target or max(n for _, n in wider) + 2 + 3 * (len(held) + 1) > most):
                out.append(held)
                held = cols[:1]
                wider = [(t + x, n + y) for (t, n), (x, y) in zip(first, (self.size(r, c) for r in self.rows), strict=True)]
            held, sums = [*held, c], wider
        return [*out, held]

    def pack(self, cols: list[int]) -> None:
        target, bound, most = self.room(cols)
        line = 2 + 3 * len(cols)
        if len(cols) > 2 and (target < 0 or most < line):
            for group in self.groups(cols):
                self.pack(group)
            return
        pending: list[tuple[int, dict[int, tuple[int, int]]]] = []
        held_t = held_n = 0
        for r in self.rows:
            sizes = [self.size(r, c) for c in cols]
            t, n = sum(x for x, _ in sizes), sum(y for _, y in sizes) + line
            fits = t <= target and n <= most
            if pending and (not fits or held_t + t > target or held_n + n > most):
                self.tell(cols, pending)
                pending, held_t, held_n = [], 0, 0
            if fits:
                pending.append((r, {c: (0, y) for c, (_, y) in zip(cols, sizes, strict=True)}))
                held_t, held_n = held_t + t, held_n + n
                continue
            for c in cols:
                if self.size(r, c)[1]:
                    self.cell(cols, r, c, target, bound, most - line)
        if pending:
            self.tell(cols, pending)

    def cell(self, cols: list[int], r: int, c: int, target: int, bound: int, most: int) -> None:
        """One cell of a row that fits nowhere whole: with the row's label, else in sentences."""
        both = [self.size(r, x) for x in {cols[0], c}]
        if sum(t for t, _ in both) <= target and sum(n for _, n in both) <= most:
            self.tell(cols, [(r, {x: (0, self.size(r, x)[1] if x in (cols[0], c) else 0) for x in cols})])
            return
        start = end = held = 0
        i = self.at[r, c]
        for t, n in zip(*(self.sentences[i] or ([self.tokens[i]], [self.chars[i]])), strict=True):
            if t > bound or n > most:
                raise ValueError(f"a sentence of {t} tokens and {n} characters in row {r}, column {c}, fits nowhere under its headings")
            if end > start and (held + t > target or end + n - start > most):
                self.tell(cols, [(r, {c: (start, end)})])
                start, held = end, 0
            end, held = end + n, held + t
        self.tell(cols, [(r, {c: (start, end)})])


class _Flat:
    """Pieces of many tables as flat columns, from which Arrow's nested array is made."""

    def __init__(self):
        self.pieces, self.heads, self.head_cells, self.rows, self.cells = [0], [0], [0], [0], [0]
        self.head_i, self.row_no, self.places = [], [], []

    def add(self, pieces: list[tuple]) -> None:
        for heads, rows in pieces:
            for of in heads:
                self.head_i += of
                self.head_cells.append(len(self.head_i))
            self.heads.append(len(self.head_cells) - 1)
            for row_no, places in rows:
                self.row_no.append(row_no)
                self.places += places
                self.cells.append(len(self.places))
            self.rows.append(len(self.row_no))
        self.pieces.append(len(self.rows) - 1)

    def array(self) -> pa.Array:
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        columns = list(zip(*self.places, strict=True)) or [()] * 4
        cell = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(),) * 3 + (pa.bool_(),), strict=True)], names=["i", "a", "b", "told"])
        row = pa.StructArray.from_arrays([pa.array(self.row_no, pa.int64()), lists(self.cells, cell)], names=["row_no", "cells"])
        heads = lists(self.heads, lists(self.head_cells, pa.array(self.head_i, pa.int32())))
        return lists(self.pieces, pa.StructArray.from_arrays([heads, lists(self.rows, row)], names=["heads", "rows"]))


def pack(cells: DataFrame, by: list[str], notes: DataFrame | None = None, budget: Budget = Budget(), language: str = "en") -> DataFrame:
    """Each table in pieces that fit the budget: (by, piece, captions, heads, rows).

    cells: (by, row_no, col, header, text, sources), header rows being marked; sources are the spans of the original cells that
    a cell is made of. notes: (by, context, captions), one row a table: the header that pieces are indexed under and the unit
    captions above the table, both of which every piece repeats.

    Whole rows are packed up to the target under the headings of all columns. If the headings alone leave no room, columns are
    dealt into groups that do, each with the first column, and each group is packed like a table. A row that doesn't fit by
    itself is told cell by cell, each with the row's label; a cell that doesn't fit with the label is told without it, in whole
    sentences. A sentence beyond the budget's bounds raises an error when it is read: nothing is cut or left out.

    heads: for each column its heading's cells (text, sources); rows: (row_no, cells), a cell for each column: its (text, sources),
    the interval of the table's cell that the text is, and `told`, whether the piece tells of that cell at all: a row of one cell
    leaves the others empty, one of sentences doesn't tell of them. Characters are counted before escaping. A table's cells are
    one group, as it is part of one document; only their sizes go through the loop. A table without body rows gives no rows, and
    null texts are empty.
    """
    count = lexical_plan(language)
    text = F.coalesce("text", F.lit(""))
    sentences = F.filter(F.split(text, BETWEEN), lambda s: s != "")
    # no token crosses a place between sentences, so a cell's tokens are its sentences'; most cells are one sentence
    parts = cells.select(*by, "row_no", "col", "header", text.alias("text"), "sources", F.transform(sentences, lambda s: F.size(count(s))).alias("s_tokens"), F.transform(sentences, lambda s: F.length(s)).alias("s_chars"))
    several = F.size("s_tokens") > 1
    total = F.aggregate("s_tokens", F.lit(0), lambda n, t: n + t)
    sized = parts.select(*by, F.struct(F.col("row_no").cast("bigint").alias("row_no"), F.col("col").cast("int").alias("col"), F.coalesce("header", F.lit(False)).alias("header"), "text", F.col("sources").cast(SPANS).alias("sources"), total.alias("tokens"), F.length("text").alias("chars"), F.when(several, F.col("s_tokens")).alias("s_tokens"), F.when(several, F.col("s_chars")).alias("s_chars")).alias("c"))
    one = sized.groupBy(*by).agg(F.collect_list("c").alias("of"))
    if notes is not None:
        one = one.join(notes.select(*by, F.coalesce("context", F.lit("")).alias("context"), F.coalesce("captions", F.array().cast(CAPTIONS)).alias("captions")), by, "left")
    else:
        one = one.withColumns({"context": F.lit(""), "captions": F.array().cast(CAPTIONS)})
    one = one.withColumns({"context": F.coalesce("context", F.lit("")), "captions": F.coalesce("captions", F.array().cast(CAPTIONS))})
    above = F.array_join(F.col("captions.text"), "\n")
    base_chars = F.when(F.col("context") == "", 0).otherwise(F.length("context") + 2) + F.when(F.size("captions") > 0, F.length(above) + 1).otherwise(0)
    one = one.withColumns({"base_tokens": F.size(count(F.col("context"))) + F.size(count(above)), "base_chars": base_chars})

    @F.arrow_udf(PIECES)
    def told(row_no: pa.Array, col: pa.Array, header: pa.Array, tokens: pa.Array, chars: pa.Array, s_tokens: pa.Array, s_chars: pa.Array, base_tokens: pa.Array, base_chars: pa.Array) -> pa.Array:
        flat = _Flat()
        for r, c, h, t, n, st, sn, bt, bn in zip(*(x.to_pylist() for x in (row_no, col, header, tokens, chars, s_tokens, s_chars, base_tokens, base_chars)), strict=True):
            table = _Table(r, c, h, t, n, [x and (x, y) for x, y in zip(st, sn, strict=True)], (bt, bn), budget)
            if table.rows:
                table.pack(table.cols)
            flat.add(table.out)
        return flat.array()

    of = lambda field: F.col("of")[field]
    dealt = one.select(*by, "of", "captions", told(of("row_no"), of("col"), of("header"), of("tokens"), of("chars"), of("s_tokens"), of("s_chars"), "base_tokens", "base_chars").alias("pieces"))
    at = lambda i: F.get("of", i)
    heads = lambda p: F.transform(p["heads"], lambda h: F.transform(h, lambda i: F.struct(at(i)["text"].alias("text"), at(i)["sources"].alias("sources"))))
    cell = lambda x: F.struct(x["told"].alias("told"), x["a"].alias("text_start"), x["b"].alias("text_end"), F.coalesce(F.substring(at(x["i"])["text"], x["a"] + 1, x["b"] - x["a"]), F.lit("")).alias("text"), at(x["i"])["sources"].alias("sources"))
    rows = lambda p: F.transform(p["rows"], lambda r: F.struct(r["row_no"].alias("row_no"), F.transform(r["cells"], cell).alias("cells")))
    whole = dealt.select(*by, "captions", F.transform("pieces", lambda p: F.struct(heads(p).alias("heads"), rows(p).alias("rows"))).alias("pieces"))
    return whole.select(*by, "captions", F.posexplode_outer("pieces").alias("piece", "p")).where("p IS NOT NULL").select(*by, "piece", "captions", "p.heads", "p.rows")


def markdown() -> Column:
    """A piece of `pack` as Markdown under its table's captions; a heading is the texts of its header rows."""
    shown = lambda text: collapse(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    row = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    head = row(F.transform("heads", lambda h: shown(F.array_join(F.filter(h["text"], lambda t: t != ""), " "))))
    rule = row(F.transform("heads", lambda _: F.lit("---")))
    lines = F.transform("rows", lambda r: row(F.transform(r["cells"], lambda c: shown(c["text"]))))
    return F.array_join(F.concat(F.col("captions.text"), F.array(head, rule), lines), "\n")


def cell_spans() -> Column:
    """The sorted distinct source spans of all that a piece of `pack` tells, its cells, headings that say something and its table's
    captions; null if any of them has no span, for then no part of the table may count, or if there are none."""
    sources = lambda x: F.coalesce(x["sources"], F.array(F.lit(None)).cast(SPANS))
    of_heads = F.flatten(F.transform(F.filter(F.flatten("heads"), lambda h: h["text"] != ""), sources))
    of_cells = F.flatten(F.transform(F.filter(F.flatten(F.col("rows.cells")), lambda c: c["told"]), sources))
    of_captions = F.transform("captions", lambda c: F.struct(c["start_char"].alias("start_char"), c["end_char"].alias("end_char")))
    spans = F.array_distinct(F.concat(of_heads, of_cells, of_captions))
    whole = F.forall(spans, lambda s: s.isNotNull() & s["start_char"].isNotNull() & s["end_char"].isNotNull()) & (F.size(spans) > 0)
    return F.when(whole, F.array_sort(spans))


def spans_of_hits(hits: DataFrame, fragments: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, spans) of the table hits of a ranking whose fragments have spans; a hit that is left out must not be scored."""
    asked = hits.where("kind = 'table'").select(key).distinct()
    return fragments.where("spans IS NOT NULL").join(asked, key, "left_semi").select(key, "spans")


def covered_share(spans: Column, start: Column, end: Column) -> Column:
    """The share of [start, end) that sorted spans cover, what overlaps counted once."""
    clipped = F.filter(F.transform(spans, lambda s: F.struct(F.greatest(s["start_char"], start).alias("a"), F.least(s["end_char"], end).alias("b"))), lambda s: s["a"] < s["b"])
    begin = F.struct(F.lit(0).cast("long").alias("n"), start.cast("long").alias("to"))
    step: Callable[[Column, Column], Column] = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], s["b"]).cast("long").alias("to"))
    return F.aggregate(clipped, begin, step, lambda acc: acc["n"]) / (end - start)
