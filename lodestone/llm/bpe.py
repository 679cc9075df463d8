"""Byte-pair encoding and decoding with a tokenization automaton built by successive merge gadgets.

The automaton reads tokens and accepts exactly the sequences that are the tokenization of some text. It begins as one state
with a loop for each byte. The gadget of a merge (u, v) -> uv acts on every state p with an arc u to a state q that has an
arc v: q is copied without its arc v, p's arc u leads to the copy, and p gets an arc uv to where v led. So

- all arcs of one token lead to one state; so a state is named by the token that leads to it, -1 being the first state. A
  merge (u, v) -> uv turns u's state into the copy, and the arc uv leads to the state that v had then: uv's state begins as v's.
- a state is told by its losses: u's state lost the arc v when (u, v) was merged, and before u came to be, its history is that
  of u's right part. A table of losses takes memory in proportion to the merges, where explicit tables of arcs would take its
  square. `Automaton.arc` reads a state's arcs off it.

Words are bytes, while arcs are tokens: several arcs may begin alike. So the automaton is run over bytes as its subset
construction: a configuration holds the states at the ends of those tokenized beginnings of the word from which some token's
bytes are still being read, each with its place in the trie of labels. As each beginning of a word has one tokenization, one
arc at most ends at each byte, and the transition (configuration, byte) gives the next configuration and that arc. The
transitions are a table that is filled as words ask for them; encoding a word is one look-up a byte, then the arcs are read
from the end. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of

#: How byte-level tokenizers split texts into words, with Unicode's white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Words and transitions that a process keeps at most; beyond, it starts anew, so that memory does not grow with the corpus.
#: A word's own transitions come on top, one a byte.
KEPT_WORDS, KEPT_ARCS = 200_000, 500_000


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; those that aren't printable follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Compiled from a vocabulary (bytes of each id) and merges (left id, right id, joined id) in their order."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        n = len(labels)
        #: When each token came to be, and the parts of its merge.
        self.made, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        #: When the state of a token lost an arc, by token << 24 | arc.
        self.losses: dict[int, int] = {}
        usable = {t for t, label in enumerate(labels) if len(label) == 1 and t not in special.values()}
        for now, (u, v, uv) in enumerate(merges, 1):
            if not self.arc(u, v):
                continue  # no state has u before v, so the gadget finds nothing to act on
            self.losses[u << 24 | v] = now
            self.made[uv], self.left[uv], self.right[uv] = now, u, v
            usable.add(uv)
        #: The trie of labels: a node's children by byte, and the token that ends there, or -1.
        self.children: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for token in usable:
            node = 0
            for b in labels[token]:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.ends.append(-1)
            self.ends[node] = token
        self.words: dict[str, tuple[int, ...]] = {}
        self._clear()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _clear(self) -> None:
        """Empties the tables of transitions. Configuration 0 is the one before a word."""
        self.configurations: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.numbers = {self.configurations[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}

    def arc(self, state: int, token: int) -> bool:
        """Has the state an arc `token`? It has unless the arc was lost, by the state itself or in the part of its history
        that it shares with its right part's state; and an arc uv was added only where the state then had the arc u, which
        is asked of the token's left part in turn, as of the time when uv was made."""
        losses, made, left, right = self.losses, self.made, self.left, self.right
        until = 1 << 60
        while token >= 0:
            at, before, since = state, 1 << 60, made[token]
            while at >= 0:
                lost = losses.get(at << 24 | token)
                if lost is not None and made[at] < lost < before and since < lost <= until:
                    return False
                before, at = made[at], right[at]
            until, token = since, left[token]
        return True

    def _transition(self, at: int, byte: int) -> tuple[int, int]:
        """The configuration after a byte, and the arc that ends there; computed once and kept in the table."""
        going, token = [], -1
        children, ends = self.children, self.ends
        for pair in self.configurations[at]:
            node = children[pair[1]].get(byte)
            if node is not None:
                end = ends[node]
                if end >= 0 and token < 0 and self.arc(pair[0], end):
                    token = end
                if children[node]:
                    going.append((pair[0], node))
        if token < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        going.append((token, 0))
        after = tuple(going)
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.configurations)
            self.configurations.append(after)
        self.table[at << 8 | byte] = got = number, token
        return got

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of a word, by the table."""
        if len(self.table) >= KEPT_ARCS:
            self._clear()
        table, at, arcs = self.table, 0, []
        for byte in word:
            at, token = table.get(at << 8 | byte) or self._transition(at, byte)
            arcs.append(token)
        out, end = [], len(word)
        while end:
            out.append(arcs[end - 1])
            end -= len(self.labels[out[-1]])
        return tuple(reversed(out))

    def _piece(self, text: str) -> list[tuple[int, ...]]:
        words, out = self.words, []
        for w in WORDS.findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                ids = self.encode_word(w.encode())
                if len(w) <= 64:
                    words[w] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special strings in it become their own ids."""
        if self.split is None or not any(s in text for s in self.special):
            return [i for ids in self._piece(text) for i in ids]
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else [i for ids in self._piece(part) for i in ids]
        return out

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels in turn, special ones too; bytes that are no UTF-8 become U+FFFD. Ids that aren't in the vocabulary,
        and nulls, are left out, as the library does."""
        n, labels = len(self.labels), self.labels
        return b"".join([labels[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


#: The settings that this encoder implements; a file with others is refused.
SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
FLAGS = {"single_word": False, "lstrip": False, "rstrip": False}


def _differs(wanted, got) -> bool:
    """Whether a setting is none of those wanted; what a file leaves out is off, and an empty string counts as none."""
    if isinstance(wanted, dict):
        return not isinstance(got, dict) or any(_differs(w, got.get(k)) for k, w in wanted.items())
    return (wanted or None) != (got or None)


def compile_file(path: str) -> Automaton:
    """The automaton of a byte-level tokenizer's JSON file. Raises ValueError if its settings aren't those implemented here."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if wrong := [k for k, v in SETTINGS.items() if _differs(v, data.get(k))] + [t["content"] for t in data["added_tokens"] if _differs(FLAGS, t)]:
        raise ValueError(f"{path}: settings that aren't implemented: {', '.join(wrong)}")
    vocab, to_byte = data["model"]["vocab"], printable_bytes()
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        labels[i] = bytes(to_byte[c] for c in token) if token not in special else token.encode()
    for token, i in special.items():
        labels[i] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)


_compiled: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once in a process."""
    if path not in _compiled:
        _compiled[path] = compile_file(path)
    return _compiled[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, ids (array of int), n_tokens, and whether decoding gives the text again.

    Null texts count as empty and have no ids; a text of any length is one row's list. Null and repeated ids pass through,
    other columns are ignored, and an empty table gives no rows. Only text that holds no valid UTF-8 fails to come back.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [tool.encode(t) for t in texts]
            same = [tool.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "decodes"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, n_tokens long, decodes boolean")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of df: doc_id and text.

    A null list counts as empty and gives an empty text; in a list, nulls and ids outside the vocabulary are left out. Null
    and repeated doc_ids pass through, other columns are ignored, and an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_tokens, ids_sha256, decoded_sha256; null texts count as empty.

    Encodes and decodes each whole text in one pass without a shuffle; ids are not stored. Other columns are ignored; null
    and repeated ids pass through.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton(path)
        names = [str(i) for i in range(len(tool.labels))]
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = tool.encode(text)
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
