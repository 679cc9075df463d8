"""Toxicity scores from two class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_of, may_have, table, text_batches, text_of

#: Labelled rows to fit the score on at most, first by hash of their ids; with more rows to count, labels are not broadcast.
MAX_ROWS = 200_000
#: Prefixes that fewer words begin with are not stored: they back off.
MIN_COUNT = 8
#: Bytes of a word that its prefixes are told apart by.
DEPTH = 24
#: A text is also judged by so many of its most toxic words, lest length dilutes them.
TOP = 3
#: Words that a counting task gathers before it passes them on, and that a scoring process keeps.
FLUSH, KEPT = 200_000, 300_000

_to_space = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks and white space separate them."""
    return text.lower().encode("utf-8", "replace").translate(_to_space).split()


@dataclass
class Model:
    """A trie of prefixes with a log-likelihood for each class (columns: ordinary, toxic).

    A word is read byte by byte, with a space as its end. In each class the next byte depends on the whole prefix so far;
    where a prefix was seen rarely it backs off to counts that both classes share. So an expression that neither class knows
    is as likely in both.
    """

    #: The place of each stored prefix in `through`.
    nodes: dict[bytes, int]
    #: Log-likelihood of a prefix; then that of leaving the stored prefixes after it. Place 0 is the empty prefix.
    through: np.ndarray
    leave: np.ndarray
    #: Shared log-likelihoods of a byte after a byte.
    shared: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0, 1.0, 0.0]))

    def word(self, word: bytes) -> tuple[float, float]:
        """Log-likelihoods of a word in both classes."""
        word += b" "
        low, high, at = 0, min(len(word), DEPTH), 0
        while low < high:  # prefixes of a stored prefix are stored
            middle = (low + high + 1) // 2
            found = self.nodes.get(word[:middle])
            if found is None:
                high = middle - 1
            else:
                low, at = middle, found
        ll = self.through[at]
        if low < len(word):
            rest = np.frombuffer(word[max(0, low - 1) :] if low else b" " + word, np.uint8)
            ll = ll + self.leave[at] + self.shared[rest[:-1], rest[1:]].sum()
        return float(ll[0]), float(ll[1])

    def statistics(self, texts: list[str], known: dict[bytes, tuple[float, float]]) -> np.ndarray:
        """For each text: log-likelihood a word in each class, mean of its differences and of the TOP largest, log of the length.

        known: the words so far, kept for the next call.
        """
        out = np.zeros((len(texts), 5))
        for k, text in enumerate(texts):
            tokens = words(text)
            if not tokens:
                continue
            for w in set(tokens).difference(known):
                if len(known) >= KEPT:
                    known.clear()
                known[w] = self.word(w)
            try:
                ll = np.array([known[w] for w in tokens])
            except KeyError:  # the store was emptied while this text's words came in
                ll = np.array([self.word(w) for w in tokens])
            diff = ll[:, 1] - ll[:, 0]
            top = np.partition(diff, len(diff) - TOP)[-TOP:] if len(diff) > TOP else diff
            out[k] = [*ll.mean(0), diff.mean(), top.sum() / TOP, np.log1p(len(tokens))]
        return out

    def score(self, statistics: np.ndarray) -> np.ndarray:
        z = self.weights[0] + statistics[:, 2:] @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def discount(n1: int, n2: int) -> float:
    """The absolute discount from the numbers of entries seen once and twice."""
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def smooth(prefixes: list[bytes], counts: np.ndarray, totals: np.ndarray) -> Model:
    """Interpolated Kneser-Ney for both classes (columns: ordinary, toxic).

    counts: how often each prefix began a word; totals: all words. A prefix that is not listed (seen too rarely) is
    discounted whole, and what it leaves goes to the shared counts: of a byte after a byte, over distinct prefixes of either
    class. The larger class's counts are thinned to the smaller one's size first, as otherwise anything unseen would speak
    for the smaller class.
    """
    order = sorted(range(len(prefixes)), key=lambda k: (len(prefixes[k]), prefixes[k]))
    prefixes, counts = [prefixes[k] for k in order], counts[order].reshape(-1, 2)
    nodes = {p: k for k, p in enumerate(prefixes, 1)}
    n = len(prefixes) + 1
    parent = np.array([0] + [nodes[p[:-1]] if len(p) > 1 else 0 for p in prefixes])
    last = np.array([32] + [p[-1] for p in prefixes])
    before = np.array([32] + [p[-2] if len(p) > 1 else 32 for p in prefixes])
    follow = np.full((256, 256), 0.02)
    np.add.at(follow, (before[1:], last[1:]), 1.0)
    shared = follow / follow.sum(1, keepdims=True)
    thin = np.maximum(totals, 1).min() / np.maximum(totals, 1)
    k = np.concatenate([np.maximum(totals, 1)[None], counts]) * thin
    whole = counts.sum(1)
    least = whole.min() if len(whole) else 1
    d = discount(int((whole == least).sum()), int((whole == least + 1).sum()))
    seen = np.maximum(k - d * np.minimum(1, k), 0) / np.maximum(k[parent], 1e-9)
    seen[0] = 0
    mass = np.stack([np.bincount(parent, seen[:, c], n) for c in (0, 1)], 1)
    leave = np.clip(1 - mass, 1e-6, 1)
    step = np.log(np.maximum(seen + leave[parent] * shared[before, last][:, None], 1e-12))
    step[0] = 0
    through = np.zeros((n, 2))
    for j in range(1, n):
        through[j] = through[parent[j]] + step[j]
    return Model(nodes, through, np.log(leave), np.log(shared))


def calibrate(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression (constant first) by Newton's steps; without both labels, plain defaults."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-1.0, 1.0, 1.0, 0.0])
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, penalty = np.zeros(a.shape[1]), l2 * np.eye(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of (label, text) rows with their counts in both classes, summed over a task's batches as far as memory allows."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        both = list(held[0].keys() | held[1].keys())
        got = pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), *(pa.array([c[k] for k in both], pa.int64()) for c in held)], names=["word", "ordinary", "toxic"])
        for c in held:
            c.clear()
        return got

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[label].update(words(text))
        if len(held[0]) + len(held[1]) > FLUSH:
            yield out()
    yield out()


def _prefixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of counts by prefix, over words that come in order; all words with the same first bytes are in this task.

    Only the prefixes of the current word are held. Those with fewer than `least` words are left out.
    """
    stack: list[list] = []
    path = b""
    out: list[tuple[bytes, int, int]] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            o, t = stack.pop()
            if o + t >= least:
                out.append((path[: len(stack) + 1], o, t))
            if stack:
                stack[-1][0] += o
                stack[-1][1] += t

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))], names=["prefix", "ordinary", "toxic"])
        out.clear()
        return got

    for batch in batches:
        for word, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            word = (word + b" ")[:DEPTH]
            same = 0
            while same < len(stack) and same < len(word) and path[same] == word[same]:
                same += 1
            close(same)
            path = word
            stack += [[0, 0] for _ in range(len(word) - same)]
            stack[-1][0] += o
            stack[-1][1] += t
        if len(out) > 10_000:
            yield flush()
    close(0)
    yield flush()


def train(docs: DataFrame, labels: DataFrame, learn: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, min_count: int = MIN_COUNT) -> Model:
    """Counts the words of whole labelled texts for which `learn` holds, and fits the score on those of `tune`.

    Both are expressions on the labels' table. Words of all labelled rows are counted; Spark sums their counts, and
    prefixes that min_count words or more begin with come to the driver. The score is fitted on max_rows rows at most. A label of 1 is toxic, any other ordinary; rows
    without a label or document are left out.
    """
    text_batches(docs.sparkSession)
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("label"), learn.alias("learn"), tune.alias("tune"))
    learnt = table(picked.where("learn").select("id", "label"), "toxic-labels")
    tuned = table(picked.where("tune").select("id", "label").orderBy(F.xxhash64("id"), "id").limit(max_rows), "toxic-tune-labels")
    texts = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    rows = texts
    if learnt.count() <= max_rows:
        learnt = F.broadcast(learnt)
    elif dict(docs.dtypes)[id_col] == dict(labels.dtypes)[id_col]:  # as ids of other types hash otherwise
        rows = may_have(texts.withColumn("key", F.xxhash64("doc")), "key", filter_of(learnt.select(F.xxhash64("id").alias("key")), "key", "toxic-filter"))
    counted = rows.join(learnt, F.col("doc") == F.col("id")).select("label", "text").mapInArrow(_count, "word binary, ordinary long, toxic long")
    tally = table(counted.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxic-words")
    total = tally.agg(F.sum("ordinary"), F.sum("toxic")).first()
    ordered = tally.repartition(F.substring("word", 1, 2)).sortWithinPartitions("word")
    got = ordered.mapInArrow(lambda b: _prefixes(b, min_count), "prefix binary, ordinary long, toxic long").groupBy("prefix").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    model = smooth(got.column("prefix").to_pylist(), np.stack([got.column(c).to_numpy() for c in ("ordinary", "toxic")], 1).astype(float).reshape(-1, 2), np.array([total[0] or 0, total[1] or 0], float))
    names = ["mean", "top", "length"]
    told = _apply(texts.join(F.broadcast(tuned), F.col("doc") == F.col("id")).select("label", "text"), model, lambda s, head: [head, *(pa.array(s[:, k]) for k in (2, 3, 4))], ["label", *names], "label int, mean double, top double, length double").toArrow()
    told = told.sort_by([(c, "ascending") for c in (*names, "label")])
    model.weights = calibrate(np.stack([told.column(c).to_numpy() for c in names], 1), told.column("label").to_numpy().astype(float))
    return model


def _apply(rows: DataFrame, model: Model, columns, names: list[str], schema: str) -> DataFrame:
    """rows: a column to pass on, and the text. The model goes to each executor once."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = sent.value, {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(columns(tool.statistics(batch.column(1).to_pylist(), known), batch.column(0)), names=names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), predicted, and each class's log-likelihood a word.

    Every whole text is scored without a shuffle. Null texts count as empty: their score is that of no evidence. Other
    columns are ignored; null and repeated ids pass through.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    bare = Model({}, *[np.zeros((0, 2))] * 3, model.weights)  # the arrays travel by broadcast

    def columns(s: np.ndarray, head: pa.Array) -> list[pa.Array]:
        p = bare.score(s)
        return [head, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(s[:, 1]), pa.array(s[:, 0])]

    return _apply(rows, model, columns, ["doc_id", "score", "predicted", "toxic_ll", "ordinary_ll"], f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int, toxic_ll double, ordinary_ll double")
