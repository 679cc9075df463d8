"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both encodings agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of

#: Code points of a chunk, and by how many two neighbours overlap at first.
CHUNK, OVERLAP = 16_384, 256
#: Texts that go to the library in one call hold so many code points together.
CALL = 1_000_000

_loaded: dict[str, object] = {}


def processor(path: str):
    """The tokenizer at path, loaded once in a process."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def encode_with_offsets(sp, text: str, at: int = 0) -> list[tuple[int, int, int]]:
    """(begin, end, id) of each token, in UTF-8 bytes from `at` on."""
    return [(p.begin + at, p.end + at, p.id) for p in sp.encode(text, return_type="proto").pieces]


def splice(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], start: int) -> tuple[int, int] | None:
    """(i, j) such that left[:i] + right[j:] is the encoding of the joined text, or None.

    A merge tokenizer's sequence is the right one exactly if each pair of neighbours is right for their joint text. So if
    both hold the same token with the same span, every pair of the joined sequence is a pair of one of them. The chunk's
    first token doesn't count, as the tokenizer puts a space before it; nor does the left one's last, which the cut ends.
    Of the shared tokens the one nearest to the overlap's middle is taken. Byte tokens without text of their own don't count.
    """
    spans = {t: k for k, t in enumerate(left[:-1]) if t[1] > t[0] >= start}
    shared = [(spans[t], j) for j, t in enumerate(right) if j and t in spans]
    return shared[len(shared) // 2] if shared else None


def encode_long(sp, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The tokens of a text of any length, encoded in chunks; only two chunks are encoded at a time.

    Where two neighbours share no token the overlap is doubled, up to the whole text before it.
    """
    done, end = encode_with_offsets(sp, text[:chunk]), chunk
    end_byte = len(text[:chunk].encode())
    while end < len(text):
        wide = overlap
        while True:
            start = max(0, end - wide)
            if start == 0:
                done = encode_with_offsets(sp, text[: end + chunk])
                break
            start_byte = end_byte - len(text[start:end].encode())
            right, tail = encode_with_offsets(sp, text[start : end + chunk], start_byte), max(0, len(done) - 8 * wide)
            if (at := splice(done[tail:], right, start_byte)) is not None:
                done[tail + at[0] :] = right[at[1] :]
                break
            wide *= 2
        end_byte += len(text[end : end + chunk].encode())
        end += chunk
    return done


def _counts(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    sp = processor(path)
    for batch in batches:
        texts, counts = batch.column(1).to_pylist(), [0] * batch.num_rows
        group: list[int] = []
        held = 0

        def flush() -> None:
            for k, ids in zip(group, sp.encode([texts[k] for k in group], num_threads=1), strict=True):
                counts[k] = len(ids)
            group.clear()

        for k, text in enumerate(texts):
            if len(text) > chunk:
                counts[k] = len(encode_long(sp, text, chunk, overlap))
                continue
            group.append(k)
            held += len(text)
            if held > CALL:
                flush()
                held = 0
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 tokens. Texts over `chunk` code points are encoded in overlapping chunks and spliced at
    proven boundaries, so that a text of any length needs memory for its tokens only. No shuffle. Ids of any type pass
    through, null and repeated ones too; other columns are ignored.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = dict(rows.dtypes)["doc_id"]
    counted = rows.mapInArrow(lambda batches: _counts(batches, model, chunk, overlap), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
