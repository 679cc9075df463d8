"""Line deduplication by a segment-partition edit join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_of, hits, may_have, table, text_of

#: A segment that more lines than this have, at one place and line length, needs the lines' characters to agree as well.
HOT = 16
#: Characters are counted by these groups, and the rest together.
GROUPS = ["eE ", "tTnN", "aAoO", "iIrR", "sSlLhH", "dDuUcCmM", "éèêàáóíñçäöüß", "pPgGbBvVfFyY"]

#: Lines are alike within so many edits of a code point; shorter lines than LEAST are only compared as a whole.
EDITS, LEAST = 2, 32


def index_specs(edits: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the line is that is looked for, how far its segment has moved) of a line's own segments."""
    return [(i, 0, 0) for i in range(edits + 1)]


def probe_specs(edits: int) -> list[tuple[int, int, int]]:
    """The same for the keys under which lines that are as long or shorter, by `edits` at most, can be found.

    Of two lines within `edits` edits, one of the shorter one's edits + 1 segments is untouched. Before segment i there are
    i edits at most, and behind it the rest, which together bound how far the segment has moved. Lines of one length look
    for each other, so there moves to one side are enough.
    """
    return [(i, d, move) for d in range(edits + 1) for i in range(edits + 1) for move in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1) if d or move >= 0]


def keyed(lines: DataFrame, specs: list[tuple[int, int, int]], edits: int, least: int, name: str) -> DataFrame:
    """(name, key): for each line and spec the hash of the segment's number, its line's length and its text.

    A line of n characters has edits + 1 even segments, of (n + i) div (edits + 1) characters. One key is computed at a time,
    in a row of its own: an array of all of them would be code too long to be compiled. Where all characters are one byte,
    bytes are cut, which need not be walked; equal parts hash alike.
    """
    parts = edits + 1
    rows = lines.select("h1", "line", "bytes", "plain", "length", F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("i", "less", "move"), spec, strict=True)]) for spec in specs])).alias("s"))
    other = "(length - s.less)"
    begin = "1 + s.move" + "".join(f" + IF(s.i > {k}, CAST(({other} + {k}) div {parts} AS INT), 0)" for k in range(edits))
    rows = rows.select("h1", "line", "bytes", "plain", "length", F.col("s.i").alias("i"), F.expr(other).alias("other"), F.expr(begin).alias("begin"), F.expr(f"CAST(({other} + s.i) div {parts} AS INT)").alias("size"))
    rows = rows.where(f"other >= {least} AND begin >= 1 AND begin + size - 1 <= length")
    return rows.select(F.col("h1").alias(name), F.expr("IF(plain, xxhash64(i, other, substring(bytes, begin, size)), xxhash64(i, other, substring(line, begin, size)))").alias("key"))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once. Named columns would be put back into expressions by the optimizer."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    shorter = F.least(F.length(a), F.length(b))
    fits = lambda n: (n <= shorter) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance is `edits` at most: a banded automaton whose states are bits.

    Level e holds, for each diagonal of the band from -edits to edits, whether e edits can lead there; a level is a field of
    2 * edits + 2 bits of one number. Reading a character of b keeps a diagonal where a's character is the same, replaces
    (same diagonal, next level), inserts (diagonal below) or drops characters of a (diagonal above, without reading).
    """
    width = 2 * edits + 1
    field, full = width + 1, (1 << width) - 1
    start = sum((((1 << (e + 1)) - 1) << edits & full) << field * e for e in range(edits + 1))
    number = lambda n: F.lit(n).cast("long")

    def levels(state: Column, same: Column) -> Column:
        out, below = number(0), None
        for e in range(edits + 1):
            new = F.shiftright(state, field * e).bitwiseAND(same)
            if below is not None:
                less = F.shiftright(state, field * (e - 1)).bitwiseAND(number(full))
                new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(below, 1)).bitwiseAND(number(full))
            out = out.bitwiseOR(F.shiftleft(new, field * e))
            below = new
        return out

    def run(chars: Column) -> Column:
        n, m = F.size(chars["a"]), F.size(chars["b"])

        def same(j: Column) -> Column:
            return let(F.get(chars["b"], j), lambda char: sum((F.when(F.get(chars["a"], j + d) == char, number(1 << (d + edits))).otherwise(number(0)) for d in range(-edits, edits + 1)), number(0)))

        walk = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(walk, number(start), lambda state, j: let(same(j), lambda s: levels(state, s)))

        def reached(state: Column) -> Column:
            out = F.lit(False)
            for d in range(-edits, edits + 1):
                out = out | ((n - m == d) & (state.bitwiseAND(number(sum(1 << (field * e + d + edits) for e in range(edits + 1)))) != 0))
            return out

        return let(end, reached)

    chars = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))
    return (F.abs(F.length(a) - F.length(b)) <= edits) & let(F.struct(chars(a).alias("a"), chars(b).alias("b")), run)


def similar(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are within `edits` edits.

    What both begin and end with is cut off first: some best alignment keeps it. Then the first and the last columns of an
    alignment are edits, so with two edits all between them is the same; that cheap test goes before the automaton.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    after = lambda x, n: F.substring(x, n + 1, F.length(x))

    def verified(core: Column) -> Column:
        ok = within(core["a"], core["b"], edits)
        if edits > 2:
            return ok
        inner = F.substring(core["a"], F.lit(2), F.length(core["a"]) - 2)
        return ((F.length(core["a"]) <= 2) | F.contains(core["b"], inner)) & ok

    def from_behind(rest: Column) -> Column:
        return let(common_prefix(rest["a"], rest["b"]), lambda n: let(pair(after(rest["a"], n), after(rest["b"], n)), verified))

    def from_before(lines: Column) -> Column:
        return let(common_prefix(lines["a"], lines["b"]), lambda n: let(pair(F.reverse(after(lines["a"], n)), F.reverse(after(lines["b"], n))), from_behind))

    return (F.abs(F.length(a) - F.length(b)) <= edits) & let(pair(a, b), from_before)


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, stamp, place, line of each line that isn't blank; rows with the same doc and stamp are the same."""
    rows = df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    out = rows.select("doc", F.xxhash64("text").alias("stamp"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return out.where(F.btrim("line", F.lit(" \t\r\x0b\f")) != "").select("doc", "stamp", "place", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _characters(line: Column) -> list[Column]:
    """How many characters of each group a line has. An edit changes two of these numbers by one, or one."""
    counts = [F.length(line) - F.length(F.translate(line, g, "")) for g in GROUPS]
    rest = F.length(F.translate(line, "".join(GROUPS), ""))
    return [c.alias(f"g{k}") for k, c in enumerate([*counts, rest])]


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc, stamp, places): the numbers of the lines that go, for each text that loses lines.

    Lines are what "\\n" separates; blank ones stay. A line goes if the same line occurs earlier, by (id, text's hash,
    number), ids that are null last. A line of `least` code points or more also goes if a line within `edits` edits, of
    `least` or more too, first occurs before it first occurs. That the earlier one goes itself doesn't matter.

    Distinct lines meet under the hashes of segments, never all with all; equal ones are counted with partial sums before
    the shuffle. Under a segment that very many lines have, pairs also need like numbers of characters, as any pair within
    `edits` edits has; so no group is expanded into all its pairs. The texts of candidates only are shuffled.
    """
    order = F.struct(F.col("doc").isNull().alias("late"), F.col("doc").alias("doc"), F.col("stamp").alias("stamp"), F.col("place").alias("place"))
    lines = table(_lines(df, id_col, text_col), "lines")
    again = table(lines.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first"), "again")
    long = lines.withColumn("length", F.length("line")).where(F.col("length") >= least)
    # lines that occur again meet first; the others need no shuffle, but for a few that share a bit with one of them
    marked = long.join(filter_of(again, "h1", "again-filter"), hits(F.col("h1")), "left")
    repeated = table(marked.where("filter_bits IS NOT NULL").groupBy("h1", "h2").agg(F.min("line").alias("line")), "repeated-lines")
    cut = marked.where("filter_bits IS NULL").select("h1", "line").union(repeated.select("h1", "line")).withColumn("length", F.length("line"))
    cut = cut.withColumn("bytes", F.col("line").cast("binary")).withColumn("plain", F.octet_length("line") == F.col("length"))
    same = Window.partitionBy("key")
    index = keyed(cut, index_specs(edits), edits, least, "b").withColumn("n", F.count(F.lit(1)).over(same)).withColumn("nth", F.row_number().over(same.orderBy("b")))
    index = table(index, "line-index")
    # of a segment that very many lines have, probes meet one row only, and its lines later
    held = index.where((F.col("n") <= HOT) | (F.col("nth") == 1)).select(F.col("key").alias("k"), F.when(F.col("n") <= HOT, F.col("b")).alias("b"))
    probes = keyed(cut, probe_specs(edits), edits, least, "a")
    met = table(probes.join(held, (F.col("key") == F.col("k")) & (F.col("b").isNull() | (F.col("a") != F.col("b")))).select("a", "b", "key"), "line-met")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = ordered(met.where("b IS NOT NULL"))
    asked = met.where("b IS NULL").select("a", "key").distinct()
    if not asked.isEmpty():
        hot = index.where(F.col("n") > HOT).select("key", "b")
        names = hot.select(F.col("b").alias("h1")).union(asked.select(F.col("a").alias("h1")))
        counted = table(may_have(long, "h1", filter_of(names, "h1", "hot-filter")).select("h1", *_characters(F.col("line"))).distinct(), "hot-lines")
        of = lambda s: counted.select(F.col("h1").alias(s), *[F.col(f"g{k}").alias(f"{s}{k}") for k in range(len(GROUPS) + 1)])
        apart = sum((F.abs(F.col(f"a{k}") - F.col(f"b{k}")) for k in range(len(GROUPS) + 1)), F.lit(0))
        looking = asked.join(of("a"), "a").withColumnRenamed("key", "k")
        close = looking.join(hot.join(of("b"), "b"), (F.col("k") == F.col("key")) & (F.col("a") != F.col("b")) & (apart <= 2 * edits))
        pairs = pairs.union(ordered(close))
    pairs = table(pairs.distinct(), "line-pairs")
    ends = pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1")))
    texts = may_have(long, "h1", filter_of(ends, "h1", "line-filter")).groupBy("h1", "h2").agg(F.min("line").alias("line"), F.min(order).alias("first"))
    texts = table(texts, "line-texts")
    side = lambda s: texts.select(F.col("h1").alias(s), F.col("h2").alias(f"h2_{s}"), F.col("line").alias(f"line_{s}"), F.col("first").alias(f"first_{s}"))
    alike = pairs.join(side("a"), "a").join(side("b"), "b").where(similar(F.col("line_a"), F.col("line_b"), edits))
    later = F.when(F.col("first_a") > F.col("first_b"), F.struct(F.col("a").alias("h1"), F.col("h2_a").alias("h2"))).otherwise(F.struct(F.col("b").alias("h1"), F.col("h2_b").alias("h2")))
    near = alike.select(later.alias("line")).select("line.h1", "line.h2").distinct().withColumn("near", F.lit(True))
    going = table(again.join(near, ["h1", "h2"], "full"), "going")
    gone = may_have(lines.drop("line"), "h1", filter_of(going, "h1", "going-filter")).join(going, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (order != F.col("first")))
    return gone.groupBy("doc", "stamp").agg(F.collect_set("place").alias("places"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: doc_id, text without the lines that go, n_lines, n_gone, carried. See repeated_lines.

    carried is a struct of the columns named in `carry`, null if there are none.

    Texts that lose lines meet their lines' numbers by a join; those that lose none are mostly told apart by a bounded
    broadcast, and pass straight through. Null texts count as empty; rows that share id and text share one decision;
    other columns are ignored; an empty table gives no rows.
    """
    gone = table(repeated_lines(df, id_col, text_col, edits, least).withColumn("key", F.xxhash64("doc", "stamp")), "gone")
    carried = F.struct(*carry) if carry else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), carried.alias("carried")).withColumn("key", F.xxhash64(F.col("doc_id"), F.xxhash64("text")))
    marked = rows.join(filter_of(gone, "key", "gone-filter"), hits(F.col("key")), "left")
    whole = marked.where("filter_bits IS NULL").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"), F.lit(0).alias("n_gone"), "carried")
    places = gone.select(F.col("key").alias("k"), F.col("doc").alias("d"), "stamp", "places")
    found = marked.where("filter_bits IS NOT NULL").join(places, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("stamp")), "left")
    split = found.select("doc_id", "carried", F.split("text", "\n").alias("parts"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("places"))
    cut = split.select("doc_id", F.array_join(F.transform(stay, lambda k: F.get(F.col("parts"), k)), "\n").alias("text"), F.size("parts").alias("n_lines"), F.size("places").alias("n_gone"), "carried")
    return whole.unionByName(cut)
