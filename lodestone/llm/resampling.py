"""Importance resampling towards a target: a dictionary of distinct n-grams, gains by hashed bucket, and a seeded top-k draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, table, text_batches, text_of

BUCKETS = 10_000
#: A block holds documents of so many bytes of text, or one document that is longer.
BLOCK_BYTES = 8 << 20
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20

#: ASCII other than letters and digits parts words; A to Z count as lower case.
_GAP = bytes(i for i in range(128) if not chr(i).isalnum())
_FOLD = bytes.maketrans(_GAP + bytes(range(65, 91)), b" " * len(_GAP) + bytes(range(97, 123)))

PACKED = "slice int, block long, target boolean, strings binary, held binary, docs binary, counts binary, ids array<long>, n_words array<long>"
TOLD = "block long, sums array<long>, held binary, buckets binary, counts binary, ids array<long>, n_words array<long>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class Places(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them: its letter, the number of bytes, and these, compressed."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in "BHIQ" if most <= np.iinfo(k).max)
    raw = values.astype(kind).tobytes()
    return f"{kind}{len(raw)}:".encode() + pa.compress(raw, "zstd", asbytes=True)


def loosened(told: bytes) -> np.ndarray:
    head, _, rest = told.partition(b":")
    return np.frombuffer(pa.decompress(rest, int(head[1:]), "zstd", asbytes=True), head[:1].decode()).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(texts: list[str], slices: int) -> tuple[np.ndarray, Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]]:
    """The texts' numbers of words, and for each slice of its distinct features: their strings, each ended by a line feed; by how
    many texts each is held, by which (as differences), and how often by each.

    A feature is one word or two neighbours. It is numbered by its words' places in the sorted list of words, so that strings
    come in an order in which they share beginnings; its slice follows from its words, the same in every block.
    """
    places = Places()
    flats = [np.fromiter(map(places.__getitem__, words(t)), np.int64) for t in texts]
    lengths = np.array([len(f) for f in flats], np.int64)
    vocabulary = list(places)
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.zeros(len(vocabulary), np.int64)
    rank[order] = np.arange(len(vocabulary))
    flat = rank[np.concatenate([np.zeros(0, np.int64), *flats])] + 1
    owner = np.repeat(np.arange(len(texts)), lengths)
    base, n = len(vocabulary) + 1, max(1, len(texts))
    same = owner[1:] == owner[:-1]
    held_by = np.concatenate([flat * base * n + owner, ((flat[:-1] * base + flat[1:]) * n + owner[1:])[same]])
    held_by, count = np.unique(held_by, return_counts=True)
    feature, doc = held_by // n, held_by % n
    first = np.flatnonzero(np.diff(feature, prepend=-1))
    held = np.diff(first, append=len(feature))
    one, two = feature[first] // base, feature[first] % base
    listed = pa.array([b"", *(vocabulary[k] for k in order)], pa.large_binary())
    hashed = np.array([0, *(xxhash.xxh3_64_intdigest(vocabulary[k]) for k in order)], np.uint64)
    part = (_mixed(_mixed(hashed[one]) + hashed[two]) % np.uint64(slices)).astype(np.int64)

    def parts() -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        by_part = np.argsort(part, kind="stable")
        for at in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(by_part) else []:
            left = listed.take(pa.array(one[at]))
            right = listed.take(pa.array(two[at], mask=two[at] == 0))
            strings = pc.binary_join_element_wise(left, right, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
            text = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            m = held[at]
            starts = np.cumsum(m) - m
            rows = np.repeat(first[at] - starts, m) + np.arange(m.sum())
            gaps = np.diff(doc[rows], prepend=0)
            gaps[starts] = doc[first[at]]
            yield int(part[at[0]]), text.buffers()[2].to_pybytes()[: len(b"\n") * len(at) + int(pc.sum(pc.binary_length(strings)).as_py())], m, gaps, count[rows]

    return lengths, parts()


def _blocks(slices: int):
    """Packs documents block by block: a row for each slice of a block's features, and one with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[str] = []
        size, target = 0, False
        schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("target", pa.bool_()), ("strings", pa.binary()), ("held", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            lengths, parts = features(texts, slices)
            for part, strings, held, gaps, counts in parts:
                packed = f"{len(strings)}:".encode() + pa.compress(strings, "zstd", asbytes=True)
                if target:
                    starts = np.cumsum(held) - held
                    row = (part, number, True, packed, None, None, squeezed(np.add.reduceat(counts, starts)), None, None)
                else:
                    row = (part, number, False, packed, squeezed(held), squeezed(gaps), squeezed(counts), None, None)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)
            if not target:
                row = (int(number % slices), number, False, None, None, None, None, ids, lengths.tolist())
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)
            ids.clear()
            texts.clear()
            number, size = number + 1, 0

        for batch in batches:
            for key, text, kind in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if texts and (size + len(text) > BLOCK_BYTES or kind != target):
                    yield from told()
                target = kind
                ids.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield from told()

    return run


def _dictionary(rows: pa.Table) -> pa.Table:
    """A slice's dictionary: each distinct string counted over all blocks and hashed once; the buckets' counts, and each block's
    documents with their features' buckets in place of strings."""
    out: dict[str, list] = {c.split()[0]: [] for c in TOLD.split(", ")}

    def tell(**values) -> None:
        for c, column in out.items():
            column.append(values.get(c))

    packed = []
    strings = []
    for row in rows.to_pylist():
        if row["strings"] is None:
            tell(block=row["block"], ids=row["ids"], n_words=row["n_words"])
            continue
        size, _, rest = row.pop("strings").partition(b":")
        text = pa.decompress(rest, int(size), "zstd")
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
        strings.append(pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), text]))
        packed.append(row)
    if packed:
        coded = pa.chunked_array(strings).combine_chunks().dictionary_encode()
        bucket = np.fromiter((zlib.crc32(s[:-1]) % BUCKETS for s in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        entry, sums, at = coded.indices.to_numpy(), np.zeros((2, len(bucket)), np.int64), 0
        for row, held_strings in zip(packed, strings, strict=True):
            mine, counts = entry[at : at + len(held_strings)], loosened(row["counts"])
            at += len(held_strings)
            if row["target"]:
                sums[1] += np.bincount(mine, counts, len(bucket)).astype(np.int64)
                continue
            held, gaps = loosened(row["held"]), loosened(row["docs"])
            starts = np.cumsum(held) - held
            run = np.cumsum(gaps)
            doc = run - np.repeat(run[starts] - gaps[starts], held)
            mine = np.repeat(mine, held)
            sums[0] += np.bincount(mine, counts, len(bucket)).astype(np.int64)
            key, again = np.unique(doc * BUCKETS + bucket[mine], return_inverse=True)
            doc = key // BUCKETS
            tell(block=row["block"], held=squeezed(np.bincount(doc)), buckets=squeezed(key % BUCKETS), counts=squeezed(np.bincount(again, counts).astype(np.int64)))
        tell(sums=np.concatenate([np.bincount(bucket, n, BUCKETS) for n in sums]).astype(np.int64).tolist())
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        total += batch.column(0).flatten().to_numpy().reshape(-1, 2 * BUCKETS).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["sums"])


def bucket_gains(told: DataFrame) -> list[int]:
    """The gain of each bucket, a list of BUCKETS numbers whatever the input: floor of 1000 times the log of its smoothed share in
    the target against its smoothed share in the documents."""
    spark = told.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    sums = told.where("sums IS NOT NULL").select("sums").coalesce(tasks).mapInArrow(_summed, "sums array<long>")
    one = sums.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    both = one.groupBy((F.col("at") % BUCKETS).alias("bucket")).agg(*(F.sum(F.when(F.floor(F.col("at") / BUCKETS) == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate("st")))
    both = table(both, "buckets", thin=True)
    S, T = (n or 0 for n in both.agg(F.sum("s"), F.sum("t")).first())
    share = ((F.col("t") + 1) * F.lit(float(S + BUCKETS))) / ((F.col("s") + 1) * F.lit(float(T + BUCKETS)))
    out = [0] * BUCKETS
    for bucket, gain in both.select("bucket", F.floor(1000 * F.log(share))).collect():
        out[bucket] = gain
    return out


def _gained(gains: list[int]):
    """What each slice adds to the sums of a block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            told = []
            for block, held, buckets, counts, ids, n_words in zip(*columns, strict=True):
                sums = None
                if held is not None:
                    held = loosened(held)
                    owner = np.repeat(np.arange(len(held)), held)
                    sums = np.zeros(len(held), np.int64)
                    np.add.at(sums, owner, gain[loosened(buckets)] * loosened(counts))
                    sums = pa.compress(sums.tobytes(), "zstd", asbytes=True)
                told.append((block, None if sums is None else len(held), sums, ids, n_words))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds, strict=True)] if told else [pa.array([], k) for k in kinds], names=["block", "n", "sums", "ids", "n_words"])

    return run


def _documents(rows: pa.Table) -> pa.Table:
    """A block's documents with the sums of all slices."""
    told = rows.to_pylist()
    block = next(r for r in told if r["ids"] is not None)
    n_words = np.array(block["n_words"], np.int64)
    sums = np.zeros(len(n_words), np.int64)
    for r in told:
        if r["sums"] is not None:
            sums[: r["n"]] += np.frombuffer(pa.decompress(r["sums"], 8 * r["n"], "zstd", asbytes=True), np.int64)
    n_features = np.maximum(2 * n_words - 1, 0)
    return pa.table({"doc_id": pa.array(block["ids"], pa.int64()), "n_words": n_words, "n_features": n_features, "weight": sums // np.maximum(n_features, 1)})


def weights(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_features, weight, the floored mean of the gains of its features.

    Features are counted by block of documents first; each block sends a slice of the dictionary the strings that it holds, once
    each and compressed, with their documents and counts. A slice counts each distinct string over all blocks, hashes it once,
    adds up the buckets, and puts the buckets in the strings' place; the gains, BUCKETS numbers, are then joined to these
    per-document counts, and a block's documents add up what the slices found. A frequent feature is one string a block, so no
    slice is hot. There are twice as many slices as shuffle partitions.

    Null texts have no words and weight 0; null and repeated ids are documents of their own. doc_id is cast to long; other columns
    are ignored. An empty target or an empty df is no error.
    """
    spark = df.sparkSession
    text_batches(spark)
    slices = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.lit(False).alias("target"))
    rows = rows.union(target.select(F.lit(None).cast("long"), text_of(target_col), F.lit(True)))
    told = table(rows.mapInArrow(_blocks(slices), PACKED).groupBy("slice").applyInArrow(_dictionary, TOLD), "dictionary")
    parts = told.where("sums IS NULL").select("block", "held", "buckets", "counts", "ids", "n_words")
    added = parts.mapInArrow(_gained(bucket_gains(told)), "block long, n long, sums binary, ids array<long>, n_words array<long>")
    return added.groupBy("block").applyInArrow(_documents, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A seeded Gumbel variable of an id, in floored thousandths."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((hashed.cast("long") + 0.5) / 4294967296.0)))


def resample(df: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, **columns: str) -> DataFrame:
    """weights() with score and rank: of the N documents with LEAST_WORDS words or more, floor(percent * N / 100) are drawn, those
    with the highest sums of weight and noise, ties going to the smaller id and null ids last; rank counts from 1 and is null for
    documents that are not drawn. Ranks are told by ranges of scores, so no task holds all documents."""
    scored = table(weights(df, target, **columns).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    ranked = numbered(scored.where(F.col("n_words") >= LEAST_WORDS), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], label="ranked")
    drawn = F.col("rank") < F.floor(F.col("size") * percent / 100)
    out = ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank") + 1).alias("rank"))
    return out.unionByName(scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")))
