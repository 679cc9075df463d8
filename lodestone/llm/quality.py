"""Quality classification: histogram gradient-boosted trees over statistics of documents, flattened into arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of

#: Labelled rows that a model is fitted on at most: those first by hash of their ids.
MAX_ROWS = 20_000

MARKS = "!?.,;:|#*$%&@<>{}[]()/\\_=+-\"'"

FEATURES = [
    "log_words", "word_length", "word_length_sd", "longest_word", "distinct_words", "top_word", "top_pair", "distinct_pairs",
    "repeated_lines", "line_length", "short_lines", "upper", "lower", "digits", "space", "high", "control", "entropy", "vowels",
    "capital_words", "all_caps_words", "ends_sentence", "words_with_digits", "words_without_letters", "marked_words", *(f"mark_{m}" for m in MARKS),
]

_byte = np.arange(256)
_classes = np.stack(
    [
        (_byte >= 65) & (_byte <= 90),
        (_byte >= 97) & (_byte <= 122),
        (_byte >= 48) & (_byte <= 57),
        np.isin(_byte, [9, 10, 11, 12, 13, 32]),
        _byte >= 128,
        (_byte < 9) | ((_byte > 13) & (_byte < 32)) | (_byte == 127),
        np.isin(_byte, list(b"aeiouAEIOU")),
        *[_byte == ord(m) for m in MARKS],
    ],
    axis=1,
).astype(np.float64)


def features(text: str) -> list[float]:
    """The statistics of one text, in the order of FEATURES; all finite, those of an empty text too."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(raw))
    shares = counts @ _classes / n
    p = counts[counts > 0] / n
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    lines = raw.split(b"\n")
    upper, lower, digits, space, high, control, vowels, *marks = shares
    return [
        np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        np.log1p(len(tally)) / np.log1p(w), max(tally.values(), default=0) / w, max(pairs.values(), default=0) / w, np.log1p(len(pairs)) / np.log1p(w),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(x) < 30 for x in lines) / len(lines),
        upper, lower, digits, space, high, control, -(p * np.log(p)).sum(), vowels,
        sum(x[:1].isupper() for x in words) / w, sum(x.isupper() for x in words) / w, float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
        sum(not x.isalpha() and any(48 <= c <= 57 for c in x) for x in tally) / w, sum(x.lower() == x.upper() and x[0] < 128 for x in words) / w, sum(x[-1] < 65 and x[-2:-1] == x[-1:] for x in words) / w,
        *marks,
    ]


@dataclass
class Trees:
    """Trees in arrays: row t holds tree t's nodes. A leaf points to itself, so that a fixed number of steps ends in leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x: all rows and trees step down together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                go = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(go, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1e-3) -> Trees:
    """Boosted trees for the logistic loss; splits are searched in histograms of quantile bins. No rows or one label: a constant."""
    n, m = x.shape
    size = 2 ** (depth + 1) - 1
    trees = Trees(*(np.zeros((rounds, size), k) for k in (np.int32, np.float64, np.int32, np.int32, np.float64)), 0.0, depth)
    trees.left[:] = trees.right[:] = np.arange(size)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    trees.base = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, trees.base)
    offsets = np.arange(m) * bins
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        leaves = {0}
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first)[:, None] * (m * bins) + offsets + binned
            live = node >= first
            flat = at[live].ravel()
            gh = [np.bincount(flat, np.repeat(v[live], m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (g, h)]
            gl, hl = gh[0][:, :, :-1], gh[1][:, :, :-1]
            ga, ha = gh[0][:, :1, -1:], gh[1][:, :1, -1:]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < 1) | (ha - hl < 1)] = -1
            for k in range(width):
                if first + k not in leaves:
                    continue
                j, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, j, b] <= least or b >= len(edges[j]):
                    continue
                here, a = first + k, 2 * (first + k) + 1
                trees.feature[t, here], trees.threshold[t, here] = j, edges[j][b]
                trees.left[t, here], trees.right[t, here] = a, a + 1
                inside = node == here
                node[inside] = np.where(binned[inside, j] <= b, a, a + 1)
                leaves = leaves - {here} | {a, a + 1}
        weight = np.bincount(node, -g, size) / (np.bincount(node, h, size) + l2) * rate
        trees.value[t] = weight
        margin += weight[node]
    return trees


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Fits trees on labelled rows for which `learn` (an expression on the labels' table) holds, max_rows at most.

    Those rows are the first by a hash of their ids; the features of their whole texts come to the driver, some 50 doubles each.
    Rows without a label or a document are left out.
    """
    text_batches(docs.sparkSession)
    sample = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    got = texts.join(F.broadcast(sample), F.col("doc") == F.col("id")).select("label", "text").mapInArrow(_features, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums of floats must not
    return fit(x[order], y[order])


def classify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (probability of label 1), predicted. Null texts count as empty.

    Every whole text is scored, in Arrow batches of bounded rows without a shuffle. Other columns are ignored; null and
    repeated ids pass through.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            score = trees.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def accept(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text is predicted to have label 1, with all their columns and without a shuffle."""
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(trees.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
