"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, and union-find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_of, hits, may_have, table, text_batches, text_of
from .components import components, forest

WIDTH = 5
#: Registers of a signature in bands of ROWS. At a similarity of 0.75 a pair has no band in common once in 12,000 times, at
#: 0.8 once in two million; at 0.3, as documents that share a passage have, one pair in thirty has one.
BANDS, ROWS = 48, 6
#: Hubs that a document tries before the rest of the pairs is verified, and the buckets that it shares with each, at least.
TRIES, SHARED = 2, 3
#: Components of fewer documents are compared document by document, in buckets of up to CROWD such documents by pairs;
#: all else in blocks of so many shingles. HEAD documents of a component are tried before the whole.
FEW, CROWD, BLOCK, HEAD = 8, 16, 500_000, 64
#: Words whose hashes a process keeps.
KEPT = 300_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str], known: Hashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of the distinct word shingles of each text, in order by both.

    A to Z count as lower case; words are what ASCII white space separates. A text of fewer words than `width` has its whole
    sequence as one shingle, one without words has none.
    """
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place, length = np.arange(len(flat)) - begin, np.repeat(lengths, lengths)
    first = np.where(length >= width, place + width <= length, place == 0)
    hashed = np.zeros(len(flat), np.uint64)
    for k in range(width):
        word = np.zeros(len(flat), np.uint64)
        if k < len(flat):
            word[: len(flat) - k] = flat[k:]
        word[place + k >= length] = 0  # a shorter sequence ends here
        hashed = mixed(hashed + word + _GOLD)
    owner, hashed = owner[first], hashed[first]
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return owner[new], hashed[new]


def superminhash(owner: np.ndarray, elements: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """The n sets' signatures of m registers, rows of infinity for empty sets.

    An element draws one random permutation of the registers. In step j it offers its j-th register the value j + r_j with r_j
    uniform below 1, and registers keep the least offer: so an element's values are correlated across registers, which lowers
    the variance against independent hashes. All sets take step j together; once all of a set's registers hold less than
    j + 1, later offers can't change it, and the set drops out. The permutation is a Fisher-Yates shuffle of which only the
    swaps so far are held.
    """
    out = np.full(n * m, np.inf)
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(owner):
            break
        draw = mixed(elements + np.uint64((2 * j + 1) * int(_GOLD) % 2**64))
        value = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        pick = j + ((mixed(draw) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        register = pick
        for i in range(j - 1, -1, -1):
            register = np.where(register == swaps[i], i, register)
        np.minimum.at(out, owner * m + register, value)
        open_ = out.reshape(n, m).max(1) > j + 1
        keep = open_[owner]
        owner, elements = owner[keep], elements[keep]
        swaps = [s[keep] for s in [*swaps, pick]]
    return out.reshape(n, m)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the keys of different bands differ."""
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key + bits[:, :, k])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in batches:
        n = batch.num_rows
        owner, hashed = shingles(batch.column(1).to_pylist(), known)
        sizes = np.bincount(owner, minlength=n)
        keys = bands(superminhash(owner, hashed, n))
        digest = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
        if len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for k in (0, 1):
                digest[k][owner[starts]] = np.add.reduceat(mixed(hashed + np.uint64(k + 1)), starts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for batch in batches:
        n = batch.num_rows
        owner, hashed = shingles(batch.column(1).to_pylist(), known)
        ends = np.searchsorted(owner, np.arange(n + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashed.view(np.int64)))], names=["doc", "set"])


def _asked(sets: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """The sets of the documents that a column names, and as few others as a bounded filter allows."""
    return may_have(sets, "key", filter_of(docs.select(F.xxhash64(doc).alias("key")), "key", "asked-filter"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Only sets that some pair asks for are dealt."""
    half, full = pairs, F.size(F.array_intersect("of_a", "of_b"))
    for side in "ab":
        half = half.join(_asked(sets, pairs, side).select(F.col("doc").alias(side), F.col("set").alias(f"of_{side}")), side)
    return half.where(100 * full >= percent * (F.size("of_a") + F.size("of_b") - full)).select("a", "b")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether the sets' sizes alone leave a link possible."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _hubs(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of documents with a hub: each bucket's is the document that a hash picks. A document tries the TRIES hubs
    that it shares most buckets with, SHARED of them at least: pairs that share fewer are seldom links, and wait for `_rest`.
    """
    hub = F.min(F.struct(F.xxhash64("doc", F.lit(0)).alias("by"), "doc", "n")).alias("hub")
    hubs = table(places.groupBy("band").agg(hub), "hubs", thin=True)
    facing = places.join(hubs, "band").where((F.col("doc") != F.col("hub.doc")) & _alike(F.col("n"), F.col("hub.n"), percent))
    shared = facing.groupBy("doc", F.col("hub.doc").alias("b")).count().where(F.col("count") >= SHARED)
    nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("count").desc(), "b"))
    tries = table(shared.withColumn("nth", nth).where(F.col("nth") <= TRIES).select(F.col("doc").alias("a"), "b"), "tries", thin=True)
    return table(_verified(tries, sets, percent), "links", thin=True)


def _told(places: DataFrame, known: DataFrame) -> DataFrame:
    """The places (band, doc, n, c) in buckets that have several components, c being the document's."""
    told = places.join(known, F.col("doc") == F.col("node"), "left").select("band", "doc", "n", F.coalesce("component", "doc").alias("c"))
    told = table(told, "told", thin=True)
    several = told.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    return table(told.join(several, "band", "left_semi"), "mixed", thin=True)


def _postings(sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets' shingles in order, the number of the set that has each, and the sets' sizes."""
    sizes = np.diff(sets.offsets.to_numpy())
    flat = sets.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes


def _linked(percent: int, one: bool):
    """Links between the documents on the left and those on the right, a spanning forest of them; if `one`, for each document
    on the left just one, which is enough where the right side is one component.

    All overlaps are counted exactly: the right side's shingles are sorted once, and each shingle on the left adds one to
    every document on the right that has it. Where one link is enough, the first HEAD documents on the right are tried before
    the others.
    """

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = right.column("theirs").combine_chunks()
        docs = right.column("b").to_numpy()
        cuts = [0, HEAD, len(docs)] if one and len(docs) > HEAD else [0, len(docs)]
        parts = [(docs[i:j], *_postings(sets.slice(i, j - i))) for i, j in pairwise(cuts)]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        for a, mine in zip(left.column("a").to_pylist(), left.column("mine").combine_chunks(), strict=True):
            x = mine.values.to_numpy()
            for theirs, keys, owner, sizes in parts:
                low, high = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sizes))
                found = theirs[100 * common >= percent * (len(x) + sizes - common)]
                found = found[found != a]
                if len(found):
                    break
            if len(found):
                found = found[:1] if one else found
                held.append((np.full(len(found), a), found))
                n_held += len(found)
            if n_held > BLOCK:
                held = [forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))]
                n_held = 0
        a, b = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1))) if held else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _dealt(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, one: bool) -> DataFrame:
    """Links of left (g, a, n) and right (g, b, n) within each group g, both sides in parts of BLOCK shingles."""
    parts = lambda side, name: side.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name))
    plan = table(parts(left, "lefts").join(parts(right, "rights"), "g"), "parts", thin=True)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda doc, n: F.pmod(F.xxhash64(doc), F.col(n)).cast("int")
    mine = left.join(plan, "g").select(F.col("g").alias("ga"), "a", of("a", "lefts").alias("la"), every("rights").alias("ra"))
    mine = mine.join(_asked(sets, left, "a").select(F.col("doc").alias("d"), F.col("set").alias("mine")), F.col("a") == F.col("d")).select("ga", "la", "ra", "a", "mine")
    theirs = right.join(plan, "g").select(F.col("g").alias("gb"), "b", of("b", "rights").alias("rb"), every("lefts").alias("lb"))
    theirs = theirs.join(_asked(sets, right, "b").select(F.col("doc").alias("d"), F.col("set").alias("theirs")), F.col("b") == F.col("d")).select("gb", "lb", "rb", "b", "theirs")
    return mine.groupBy("ga", "la", "ra").cogroup(theirs.groupBy("gb", "lb", "rb")).applyInArrow(_linked(percent, one), "a long, b long")


def _wholes(told: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of documents with the larger components (large, docs) that they share a bucket with, each faced as a whole.

    Of two large components, the documents of the smaller face the larger: what links them shows from either side.
    """
    sized = told.join(large, F.col("c") == F.col("large"), "left")
    wholes = sized.where("large IS NOT NULL").select("band", F.col("large").alias("g"), F.col("docs").alias("g_docs")).distinct()
    facing = sized.join(wholes, "band").where(F.struct(F.coalesce("docs", F.lit(0)), "c") < F.struct("g_docs", "g")).select("g", F.col("doc").alias("a"), "n").distinct()
    facing = table(facing, "facing", thin=True)
    asked = large.join(facing.select(F.col("g").alias("large")).distinct(), "large", "left_semi")
    whole = told.select("doc", "n", "c").distinct().join(asked, F.col("c") == F.col("large")).select(F.col("large").alias("g"), F.col("doc").alias("b"), "n")
    return table(_dealt(facing, table(whole, "whole", thin=True), sets, percent, one=True), "links", thin=True)


def _rest(told: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components that share a bucket, with those known enough of them to join
    all that is linked. told: (band, doc, n, c) of buckets with several components.

    Documents face a component of FEW documents or more as a whole, see `_wholes`. Those of smaller components face one
    another: in pairs where a bucket has CROWD of them at most, else bucket by bucket, all against those that are not of the
    component that most are of. Wholes and buckets are read in parts of BLOCK shingles, so that no group makes pairs of rows.
    """
    found = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    large = told.groupBy("c").agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") >= FEW).select(F.col("c").alias("large"), "docs")
    large = table(large, "large", thin=True)
    small = told
    if not large.isEmpty():
        found = found.union(_wholes(told, large, sets, percent))
        small = told.join(large, F.col("c") == F.col("large"), "left_anti")
        small = _told(small.select("band", "doc", "n"), table(components(found), "components", thin=True))
    counts = small.groupBy("band", "c").agg(F.count(F.lit(1)).alias("of_c"))
    crowds = counts.groupBy("band").agg(F.sum("of_c").alias("crowd"), F.max(F.struct("of_c", "c")).getField("c").alias("most"))
    small = table(small.join(crowds, "band"), "small", thin=True)
    a, b = (small.where(F.col("crowd") <= CROWD).select("band", F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("c").alias(f"c_{x}")) for x in "ab")
    pairs = a.join(b, "band").where("a > b AND c_a <> c_b").where(_alike(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    crowded = small.where(F.col("crowd") > CROWD)
    right = crowded.select(F.col("band").alias("g"), F.col("doc").alias("b"), "n")
    left = crowded.where("c <> most").select(F.col("band").alias("g"), F.col("doc").alias("a"), "n")
    return found.union(_verified(table(pairs, "pairs", thin=True), sets, percent)).union(_dealt(left, right, sets, percent, one=False))


def _representatives(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One document (doc, n, bands) of each class of equal sets, that with the smallest id; and links (a, b) of the others to it.

    Most rows are told from the others by a bounded broadcast, so their bands aren't shuffled.
    """
    digests = named.select("doc_id", "d1", "d2", "n_shingles")
    classes = table(digests.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "classes", thin=True)
    others = table(digests.join(classes, ["d1", "d2", "n_shingles"]).where("doc_id <> first").withColumn("key", F.xxhash64("doc_id", "d1", "d2")), "copies", thin=True)
    rows = named.withColumn("key", F.xxhash64("doc_id", "d1", "d2"))
    wanted = filter_of(others, "key", "copies-filter")
    sure = rows.join(wanted, hits(F.col("key")), "left_anti")
    rest = may_have(rows, "key", wanted).join(others.select("key", "doc_id", "d1", "d2"), ["key", "doc_id", "d1", "d2"], "left_anti")
    # rows that repeat an id and a set are in a class by themselves, from which one goes on
    firsts = sure.unionByName(rest).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "bands")
    return firsts, others.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept. doc_id is cast to long.

    Documents are linked when 100 * intersection >= percent * union of their word shingles; component_id is the smallest id
    that is reachable, the document itself included, and the row with that id is kept.

    Shingles are told apart by 64-bit hashes, and equal sets by the number and two 64-bit sums of them. Equal sets are one
    class, whose smallest id stands for it. Representatives with a band in common are candidates; bands that one document
    only has are dropped first, and buckets are not expanded into all pairs. If buckets hold many pairs, each names a hub by a
    hash, and each document is verified with the TRIES hubs that it shares most buckets with; union-find joins what is linked.
    Then every document is verified against the other components that it shares a bucket with, on full sets, so no link
    between components is lost. A document's places in buckets are listed once, not once in each step.

    Null or blank texts have no shingles and are linked with nothing. Rows without an id are linked with nothing and kept.
    Rows that share an id are one node. Other columns are ignored; an empty table gives no rows.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    signed = table(rows.mapInArrow(_signed, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    firsts, same = _representatives(signed.where("n_shingles > 0 AND doc_id IS NOT NULL"))
    placed = firsts.select("doc", "n", F.explode("bands").alias("band"))
    buckets = table(placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band"), "buckets", thin=True)
    crowded = may_have(placed, "band", filter_of(buckets, "band", "buckets-filter")).join(buckets, "band", "left_semi")
    places = table(crowded.distinct(), "places")
    keyed = rows.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("doc_id"))
    wanted = may_have(keyed, "key", filter_of(places.select(F.xxhash64("doc").alias("key")), "key", "crowded-filter"))
    sets = table(wanted.select("doc_id", "text").mapInArrow(_sets, "doc long, set array<long>"), "sets").withColumn("key", F.xxhash64("doc"))
    told, known = places.withColumn("c", F.col("doc")), df.sparkSession.createDataFrame([], "node long, component long")
    n_places, n_pairs = places.groupBy("band").count().agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()
    if (n_pairs or 0) > 2 * (n_places or 0):
        known = table(components(_hubs(places, sets, percent)), "components", thin=True)
        told = _told(places, known)
    more = table(_rest(told, known, sets, percent), "links", thin=True)
    found = table(components(same.union(more)), "components", thin=True)
    told = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    return told.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
