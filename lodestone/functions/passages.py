"""Passages looked for word for word in many texts at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes of texts that a worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1_024, 8 << 20
#: Bytes of a passage that are looked for first, shares of a table of their hashes, and bytes of passages that go to all tasks, at most.
ANCHOR, TABLE_LOG2, MOST = 8, 20, 16 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def text_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of texts. Spark reads the settings when a result is run, so they stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _anchors(passages: list[bytes]) -> np.ndarray:
    """Where in each passage the eight bytes stand that fewest places of the passages share."""
    seen = Counter(p[i : i + ANCHOR] for p in passages for i in range(len(p) - ANCHOR + 1))
    return np.array([min(range(len(p) - ANCHOR + 1), key=lambda i: seen[p[i : i + ANCHOR]]) for p in passages], np.int64)


def _found(ids: pa.Array, passages: list[bytes], schema: pa.Schema):
    """(item_id, doc_id, start_char, end_char): the first place of each passage in each text of a batch."""
    word = lambda p, i: int.from_bytes(p[i : i + ANCHOR], "little")
    offset = _anchors(passages)
    anchor = np.array([word(p, i) for p, i in zip(passages, offset, strict=True)], np.uint64)
    order = np.argsort(anchor, kind="stable")
    last, size, chars = np.array([word(p, len(p) - ANCHOR) for p in passages], np.uint64), np.array([len(p) for p in passages]), [len(p.decode()) for p in passages]
    slot = lambda w: (w * _MULTIPLIER) >> np.uint64(64 - TABLE_LOG2)
    table = np.zeros(1 << TABLE_LOG2, bool)
    table[slot(anchor)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: ends[-1]] if len(text) else np.zeros(0, np.uint8)
            places = []
            for shift in range(min(ANCHOR, max(0, len(data) - ANCHOR + 1))):
                words = np.frombuffer(data, "<u8", (len(data) - shift) // ANCHOR, shift)
                places.append(np.flatnonzero(table[slot(words)]) * ANCHOR + shift)
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            view = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - ANCHOR + 1), ANCHOR), (1, 1)) if len(data) >= ANCHOR else np.zeros((0, ANCHOR), np.uint8)
            words_at = lambda i: np.ascontiguousarray(view[i]).view("<u8").reshape(-1)  # noqa: B023, E731
            w = words_at(at)
            low, high = np.searchsorted(anchor[order], w), np.searchsorted(anchor[order], w, "right")
            n = high - low
            which = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            begin = np.repeat(at, n) - offset[which]
            row = np.searchsorted(ends, np.repeat(at, n), "right") - 1
            fits = (begin >= ends[row]) & (begin + size[which] <= ends[row + 1])
            which, begin, row = which[fits], begin[fits], row[fits]
            same = words_at(begin + size[which] - ANCHOR) == last[which]
            which, begin, row = which[same], begin[same], row[same]
            first: dict[tuple[int, int], int] = {}
            for k, b, r in zip(which.tolist(), begin.tolist(), row.tolist(), strict=True):
                if b < first.get((r, k), b + 1) and data[b : b + size[k]].tobytes() == passages[k]:
                    first[r, k] = b
            rows, ks = [r for r, _ in first], [k for _, k in first]
            start = np.array([len(data[ends[r] : b].tobytes().decode(errors="replace")) for (r, _), b in first.items()], np.int64)
            end = start + np.array([chars[k] for k in ks], np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(ks, pa.int64())), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(start), pa.array(end)], schema=schema)

    return run


def found(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id, start_char, end_char): where documents (doc_id, text) hold passages (item_id, passage) word for word, by the
    first place of each, half-open in code points.

    All passages are looked for in one pass over a text's bytes: by eight bytes of each, then by its last eight, then as a whole.
    Passages of fewer bytes, and all where they are many, are looked for one by one.
    """
    spark = documents.sparkSession
    one = documents.select("doc_id", "text").join(F.broadcast(passages), F.contains("text", "passage"))
    start = F.expr("locate(passage, text)") - 1
    one_by_one = lambda df: df.select("item_id", "doc_id", start.cast("long").alias("start_char"), (start + F.length("passage")).cast("long").alias("end_char"))
    passages = passages.where("passage IS NOT NULL")
    sizes = passages.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)), F.count_if(F.octet_length("passage") < ANCHOR)).first()
    if sizes[0] > MOST:
        return one_by_one(one)
    told = passages.where(F.octet_length("passage") >= ANCHOR).toArrow()
    short = one_by_one(one.where(F.octet_length("passage") < ANCHOR))
    if not told.num_rows:
        return short
    text_batches(spark)
    schema = to_arrow_schema(short.schema)
    ids, texts = told["item_id"].combine_chunks(), [t.encode() for t in told["passage"].to_pylist()]
    out = documents.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(_found(ids, texts, schema), short.schema)
    return out.unionByName(short) if sizes[1] else out
