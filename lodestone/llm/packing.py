"""Packing of token sequences: vector bin packing by dot products under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of

#: The id that ends each example.
END = 1
#: Pieces that a task chooses from, at most; it refills the pool once half of them are placed.
POOL = 4096
#: Runs of non-blank characters, and pieces of them, whose ids a process keeps.
KEPT = 400_000
#: Bytes of ids in a batch of results; a sequence is never split over batches.
OUT_BYTES = 8 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, loss long, doc_tokens long, sequence_id long, offset long"


class Limits(NamedTuple):
    """What a sequence holds at most. A limit on loss-bearing tokens below `tokens` keeps sequences' gradients of one size."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


#: Runs of printable ASCII and Latin-1 letters have one normal form, and split as SPLIT says; these values are the vocabulary's.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


class Encoder(dict):
    """Ids of texts as the tokenizers library gives them, in little-endian unsigned 32-bit numbers.

    The vocabulary's pre-tokenizer lets no piece cross white space, and no normal form joins characters across a space or a
    line feed, so a text's ids are those of its runs between these two. A plain run is split further, so that a word is
    merged once, by the library's model, whatever marks stand beside it. Any other run goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)").search
        self.merged = self.library.model.tokenize
        # how the vocabulary writes a character's bytes
        self.written = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if _PLAIN(c)}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, run: str) -> bytes:
        return np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def _asked(self, piece: str) -> bytes:
        tokens = self.merged(piece if piece.isascii() else piece.translate(self.written))
        found = self.pieces[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return found

    def __missing__(self, run: str) -> bytes:
        if not _PLAIN(run) or self.special(run):
            return self._whole(run)
        known = self.pieces
        found = self[run] = b"".join([known.get(p) or self._asked(p) for p in _SPLIT(run.lower())])
        return found

    def __call__(self, text: str) -> bytes:
        if len(self) > KEPT:
            self.clear()
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder at path, made once in a process, so that tasks share what it keeps."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Example(NamedTuple):
    """An example's id, its ids' bytes, their number, and how many of the first ones bear no loss."""

    key: int | None
    ids: bytes
    n: int
    prompt: int

    def loss(self, start: int, length: int) -> int:
        return max(0, start + length - max(start, self.prompt))

    def most(self, start: int, tokens: int, loss: int) -> int:
        """The length of the longest piece from `start` on within these limits."""
        return min(self.n - start, tokens, max(self.prompt - start, 0) + loss)


class Packer:
    """Places pieces of examples, sequence by sequence, from a bounded pool.

    A sequence takes, of the pool's pieces that still fit, the one with the greatest dot product between its sizes and the room
    that is left, both as shares of the limits and weighted by how much of each limit the pool asks for; so a sequence short
    of loss-bearing room takes prompts, and one with few segments left takes long pieces.
    """

    def __init__(self, limits: Limits, fill: bool, slack: int):
        self.limits, self.fill, self.slack = limits, fill, slack
        self.pool: list[tuple[Example, int]] = []
        self.tokens, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, examples: list[Example]) -> Iterator[list[tuple[Example, int, int]]]:
        """Puts examples into the pool; yields sequences that one long example fills alone."""
        fresh = []
        for x in examples:
            start = 0
            while x.n - start > (most := x.most(start, self.limits.tokens, self.limits.loss)) or most == self.limits.tokens:
                if most < self.limits.tokens:
                    fresh.append((x, start, most))
                else:
                    yield [(x, start, most)]
                start += most
                if start == x.n:
                    break
            if start < x.n:
                fresh.append((x, start, x.n - start))
        self.pool += [(x, start) for x, start, _ in fresh]
        self.tokens = np.r_[self.tokens, np.array([n for _, _, n in fresh], np.int64)]
        self.loss = np.r_[self.loss, np.array([x.loss(s, n) for x, s, n in fresh], np.int64)]

    def drain(self, down_to: int) -> Iterator[list[tuple[Example, int, int]]]:
        """Yields sequences until the pool holds `down_to` pieces at most. The last of all are powers of two long where examples
        may be cut, since these need no padding."""
        left = len(self.pool)
        while left > down_to:
            room = self.limits.tokens
            total = int(self.tokens.sum())
            if self.fill and total < room:
                room = 1 << (total.bit_length() - 1)
            sequence = self._sequence(room, 0 if room < self.limits.tokens else self.slack)
            left = int((self.tokens > 0).sum())
            yield sequence
        keep = np.flatnonzero(self.tokens > 0)
        self.pool = [self.pool[i] for i in keep.tolist()]
        self.tokens, self.loss = self.tokens[keep], self.loss[keep]

    def _sequence(self, room: int, slack: int) -> list[tuple[Example, int, int]]:
        # a piece that is placed has 0 tokens from then on
        most = self.limits
        want_tokens, want_loss = self.tokens.sum() / most.tokens, self.loss.sum() / most.loss
        want_segments = (self.tokens > 0).sum() / most.segments
        tokens, segments, loss = room, most.segments, most.loss
        out: list[tuple[Example, int, int]] = []
        while segments and tokens > 0:
            gain = self.tokens * (want_tokens * tokens / most.tokens**2) + self.loss * (want_loss * loss / most.loss**2)
            gain += want_segments * segments / most.segments**2
            gain[(self.tokens == 0) | (self.tokens > tokens) | (self.loss > loss)] = -1
            i = int(gain.argmax())
            if gain[i] >= 0:
                n = int(self.tokens[i])
            else:
                if not self.fill or tokens <= slack and out:
                    break
                i = int(self.tokens.argmax())
                x, start = self.pool[i]
                n = min(x.most(start, tokens, loss), int(self.tokens[i]))
                if n <= 0:
                    break
            x, start = self.pool[i]
            bears = x.loss(start, n)
            out.append((x, start, n))
            self.pool[i] = (x, start + n)
            self.tokens[i] -= n
            self.loss[i] -= bears
            tokens, segments, loss = tokens - n, segments - 1, loss - bears
        return out


def _packed(path: str, limits: Limits, fill: bool, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(limits, fill, slack)
        number, end = TaskContext.get().partitionId() << 32, np.array([END], "<u4").tobytes()
        rows: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            nonlocal held
            fields = zip(*rows, strict=True)
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(fields, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            held = 0
            return batch

        def take(sequences: Iterator[list[tuple[Example, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            for sequence in sequences:
                offset = 0
                for x, start, n in sequence:
                    rows.append((x.key, start, n, x.ids[4 * start : 4 * (start + n)], x.loss(start, n), x.n, number, offset))
                    offset += n
                held += 4 * offset
                number += 1
                if held > OUT_BYTES:
                    yield told()

        for batch in batches:
            keys, texts, prompts = (batch.column(k).to_pylist() for k in range(3))
            fresh = []
            for key, prompt, text in zip(keys, prompts, texts, strict=True):
                before = encode(prompt) if prompt else b""
                ids = before + encode(text) + end
                fresh.append(Example(key, ids, len(ids) // 4, len(before) // 4))
            yield from take(packer.add(fresh))
            if len(packer.pool) > POOL:
                yield from take(packer.drain(POOL // 2))
        yield from take(packer.drain(0))
        if rows:
            yield told()

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, limits: Limits = Limits(), fill: bool = True, slack: int = 8) -> DataFrame:
    """The pieces of all examples in packed sequences: doc_id, start, length, ids, loss, doc_tokens, sequence_id, offset.

    An example is its prompt's ids, which bear no loss, its text's ids and END. Each id lies in one piece; a sequence's pieces
    follow one another from offset 0 on and keep to all three limits. An example beyond a limit is cut into pieces that keep
    it; with `fill`, others are cut too where a sequence would be left with more than `slack` tokens to pad, and the last
    sequences of a partition are cut to powers of two. `ids` are little-endian unsigned 32-bit numbers, `loss` the number of
    them that bear loss.

    Each partition packs what it reads: nothing is shuffled, memory holds POOL pieces, and a hot source needs no care. A task
    that is run again gives the same pieces for the same rows; sequence_id holds the partition's number in its upper half.

    Null texts and prompts count as empty, so such an example is END alone. Null and repeated ids are examples of their own.
    doc_id is cast to long; other columns are ignored; an empty table gives no rows.
    """
    if min(limits) < 1:
        raise ValueError("limits are 1 or more")
    text_batches(df.sparkSession)
    prompt = text_of(prompt_col) if prompt_col else F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(_packed(tokenizer, limits, fill, slack), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 of their ids' bytes in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss")
