"""Secret scans by a trigram inverted index, with DataFrame functions only."""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a regex; of those the ones whose group is `least` long or longer."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules, in the order that ties at one start take. Runs that are too short are left out by the
#: regex itself where that can't change the other matches.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,100}:[^\x20\x09-\x0D/:@]{1,100}@"),
    Rule("bearer", r"(?i:bearer)\x20{1,4}[A-Za-z0-9._~+/-]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE + MORE

#: Matches of one text whose places are summed together.
SPANS_BLOCK = 1_000

#: Slots of the candidates' table that is broadcast: 2**20 rows of 16 bytes at most. Documents that share a slot with a
#: candidate are verified too, so more candidates cost time and no results.
SLOTS = 1 << 20

#: A Boolean query on trigrams: True (any text), a trigram, or ("and" | "or", its parts).
Query = object


def _both(kind: str, parts: list[Query]) -> Query:
    parts = [x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == kind else [p])]
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif not parts or any(p is True for p in parts):
        return True
    parts = sorted(set(parts), key=repr)
    if kind == "or":  # a part that asks for all that another one asks for, and more, adds no text
        asks = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
        parts = [p for p in parts if not any(asks[q] < asks[p] for q in parts)]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _needs(strings: set[str]) -> Query:
    """What holds of a text that contains one of the strings."""
    return _both("or", [_both("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in strings])


@dataclass
class Known:
    """What a part of a regex matches: all its strings, or how they begin and end, and a query that holds besides."""

    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    query: Query = True


_ANY = Known(None, {""}, {""})
#: Sets of more strings than this are turned into queries.
MOST = 40


def _open(x: Known) -> Known:
    """Without the exact strings."""
    return x if x.exact is None else Known(None, {s[:2] for s in x.exact}, {s[-2:] for s in x.exact}, _both("and", [x.query, _needs(x.exact)]))


def _then(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return Known({a + b for a, b in product(x.exact, y.exact)}, set(), set())
    end = x.exact if x.exact is not None else x.suffix
    begin = y.exact if y.exact is not None else y.prefix
    across = _needs({a[-2:] + b[:2] for a, b in product(end, begin)}) if len(end) * len(begin) <= MOST**2 else True
    a, b = _open(x), _open(y)
    prefix = {s + t for s, t in product(x.exact, begin)} if x.exact is not None and len(x.exact) * len(begin) <= MOST else a.prefix
    suffix = {s + t for s, t in product(end, y.exact)} if y.exact is not None and len(end) * len(y.exact) <= MOST else b.suffix
    return Known(None, {s[:8] for s in prefix}, {s[-8:] for s in suffix}, _both("and", [a.query, b.query, across]))


def _either(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST:
        return Known(x.exact | y.exact, set(), set())
    a, b = _open(x), _open(y)
    return Known(None, a.prefix | b.prefix, a.suffix | b.suffix, _both("or", [a.query, b.query]))


def _of(tree) -> Known:
    out = Known({""}, set(), set())
    for op, arg in tree:
        if op is ops.LITERAL:
            part = Known({chr(arg).lower()}, set(), set())
        elif op is ops.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is ops.LITERAL and chars is not None:
                    chars.add(chr(x).lower())
                elif kind is ops.RANGE and chars is not None and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
            part = Known(chars, set(), set()) if chars and len(chars) <= 8 else _ANY
        elif op is ops.SUBPATTERN:
            part = _of(arg[3])
        elif op is ops.BRANCH:
            parts = [_of(x) for x in arg[1]]
            part = parts[0]
            for x in parts[1:]:
                part = _either(part, x)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, inner = arg
            once = _of(inner)
            if low == 0:
                part = _either(Known({""}, set(), set()), once) if high == 1 else _ANY
            elif low == high and low <= 8:
                part = once
                for _ in range(low - 1):
                    part = _then(part, once)
            else:
                part = _open(once)
        else:
            part = _ANY
        out = _then(out, part)
    return out


def trigram_query(regex: str) -> Query:
    """What trigrams (in lower case) any text that the regex matches has; True if there are none that it must have."""
    return _open(_of(parser.parse(regex))).query


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1])) if isinstance(query, tuple) else set()


def _key(id_col: str, text: Column) -> Column:
    """A document's key in the index: rows with the same id and text are the same to a scan."""
    return F.xxhash64(F.col(id_col), text)


def postings(df: DataFrame, wanted: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of the wanted trigrams: (trigram's number, document's key) for each that a text has, in either case."""
    low = df.select(_key(id_col, text_of(text_col)).alias("key"), F.lower(text_of(text_col)).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(wanted)]))
    return low.select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, Query], wanted: list[str]) -> DataFrame:
    """(key, rules) of documents whose postings satisfy a rule's query; rules has bit k for rule k.

    The intersection of the postings: they are dealt by document, and each document's trigrams meet in 62-bit words.
    """
    words = [wanted[k : k + 62] for k in range(0, len(wanted), 62)] or [[]]
    gathered = index.groupBy("key").agg(*[F.bit_or(F.when((F.col("trigram") >= 62 * w) & (F.col("trigram") < 62 * (w + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") - 62 * w)).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(len(words))])
    place = {t: (k // 62, k % 62) for k, t in enumerate(wanted)}

    def holds(query: Query) -> Column:
        if isinstance(query, str):
            w, bit = place[query]
            return F.col(f"m{w}").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
        out = holds(query[1][0])
        for part in query[1][1:]:
            out = out & holds(part) if query[0] == "and" else out | holds(part)
        return out

    rules = F.lit(0).cast("long")
    for k, query in queries.items():
        rules = rules.bitwiseOR(F.when(holds(query), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return gathered.select("key", rules.alias("rules")).where("rules <> 0")


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's matches.

    What lies between matches, and the matches, tell where each begins: their lengths are summed up.
    """
    hits, between = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    parts = F.arrays_zip(F.transform(hits, lambda x: F.length(x)).alias("hit"), F.slice(F.transform(between, lambda x: F.length(x)), 1, F.size(hits)).alias("gap"), F.transform(value, lambda x: F.length(x)).alias("value"))
    return _summed(parts, rule.least, rank)


def _summed(parts: Column, least: int, rank: int) -> Column:
    """Spans of (hit, gap, value) lengths, by a running sum. A fold copies the array that it appends to, so spans are gathered
    in blocks of SPANS_BLOCK, and blocks in an array of blocks: a million matches are a thousand blocks of a thousand."""
    n = F.size(parts)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / SPANS_BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(blocks, lambda b: F.slice(parts, b * SPANS_BLOCK + 1, F.lit(SPANS_BLOCK)))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def inner(at: Column, block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["hit"]).alias("end"))
            return F.struct((start + x["hit"]).alias("at"), F.when(x["value"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step)

    def outer(acc: Column, block: Column) -> Column:
        return F.get(F.transform(F.array(inner(acc["at"], block)), lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))), F.lit(0))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,rank:int,end:int>>>").alias("out"))
    return F.aggregate(cut, begin, outer, lambda acc: F.flatten(acc["out"]))


def _joined(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row for each row of df: doc_id, text, found (array of start, kind's number, end), base_spans and spans.

    Spans are kind:start:end in code points, end exclusive, by start and then by the rules' order, comma-joined; base_spans
    has those of the first `base` rules. Whole texts are scanned; null texts count as empty.

    Each regex gives a Boolean query on the trigrams that its matches must have. Pass one writes the postings of those
    trigrams; their intersection gives each indexed rule's candidates, folded into a table of at most SLOTS rows that is
    broadcast. Pass two verifies candidates by the regex; rules without mandatory trigrams scan every text. Texts are never
    shuffled. Other columns are ignored; null and repeated ids pass through; an empty table gives no rows.
    """
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex)) is not True}
    wanted = sorted(set().union(*map(trigrams, queries.values())))
    index = table(postings(df, wanted, id_col, text_col), "postings")
    slot = lambda key: key.bitwiseAND(F.lit(SLOTS - 1).cast("long"))
    slots = table(candidates(index, queries, wanted).groupBy(slot(F.col("key")).alias("place")).agg(F.bit_or("rules").alias("rules")), "candidates")
    texts = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), slot(_key(id_col, text_of(text_col))).alias("slot"))
    marked = texts.join(F.broadcast(slots), F.col("slot") == F.col("place"), "left").select("doc_id", "text", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        due = F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0 if k in queries else F.lit(True)
        found.append(F.when(due & F.regexp_like("text", F.lit(rule.regex)), _spans(F.col("text"), rule, k)).otherwise(empty))
    told = marked.select("doc_id", "text", F.concat(*found).alias("found"))
    return told.select("doc_id", "text", "found", _joined(F.filter("found", lambda x: x["rank"] < base), rules).alias("base_spans"), _joined(F.col("found"), rules).alias("spans"))


def digest(scanned: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, the base kinds' counts, the digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    return scanned.select("doc_id", *[count(k) for k in range(len(BASE))], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def oracle(rules: list[Rule] = RULES) -> str:
    """DuckDB's SQL for digest(scan(documents))."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(rules):
        parts.append(f"""
        SELECT n, {k} AS rank, {quoted(r.kind)} AS kind, start, start + length(hits[i]) AS stop FROM (
            SELECT n, hits, vals, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
                SELECT n, regexp_extract_all(text, {quoted(r.regex)}) AS hits, regexp_extract_all(text, {quoted(r.regex)}, {r.group}) AS vals, string_split_regex(text, {quoted(r.regex)}) AS gaps
                FROM d WHERE regexp_matches(text, {quoted(r.regex)}))))
        WHERE length(vals[i]) >= {r.least}""")
    count = lambda k: f"coalesce(n{k}, 0)::BIGINT AS n_{rules[k].kind}"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    told AS (
        SELECT n, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans,
               string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
               {", ".join(f"count(*) FILTER (rank = {k}) AS n{k}" for k in range(len(BASE)))}
        FROM found GROUP BY n)
    SELECT doc_id, {", ".join(count(k) for k in range(len(BASE)))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN told USING (n)"""
