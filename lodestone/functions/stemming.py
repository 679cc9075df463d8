"""English lexemes: stop words out, the rest by their stems, as the published suffix-stripping algorithm for English has them."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .text import HANGUL, tokens

#: English words that no index holds.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Words with stems of their own, words that stay, words that stay once their s is gone, and beginnings whose rest is
#: the first region.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = "sky news howe atlas cosmos bias andes".split()
STAY_THEN = "inning outing canning herring earring proceed exceed succeed".split()
BEGIN = "gener|commun|arsen"
#: For each step its suffixes and what stands in their place; where a region or what goes before decides, see `stem`.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_ends = lambda suffixes: re.compile(f"(?:{'|'.join(sorted(suffixes, key=len, reverse=True))})$")
_REGION = re.compile("[aeiouy][^aeiouy]")
_END_1A, _END_1B, _END_2, _END_3, _END_4 = _ends(["sses", "ied", "ies", "us", "ss", "s"]), _ends(["eed", "eedly", "ed", "edly", "ing", "ingly"]), _ends(STEP_2), _ends(STEP_3), _ends(STEP_4)
_STOP, _HANGUL = set(STOP), re.compile(HANGUL)
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _cut(word: str, ending: re.Pattern) -> tuple[str, str]:
    """What stands before the longest of a step's suffixes, and that suffix, empty if there is none."""
    m = ending.search(word)
    return (word[: m.start()], m[0]) if m else (word, "")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word. Letters beyond a to z count as consonants."""
    if len(word) < 3 or word in STAY:
        return word
    if word in OWN:
        return OWN[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    first = re.match(BEGIN, word) or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    r2 = second.end() if second else len(word)

    head, end = _cut(word, _END_1A)
    if end == "sses":
        word = head + "ss"
    elif end in ("ied", "ies"):
        word = head + ("i" if len(head) > 1 else "ie")
    elif end == "s" and re.search("[aeiouy].", head):
        word = head
    if word in STAY_THEN:
        return word

    head, end = _cut(word, _END_1B)
    if end in ("eed", "eedly"):
        word = head + "ee" if len(head) >= r1 else word
    elif end and re.search("[aeiouy]", head):
        word = head
        if re.search("(?:at|bl|iz)$", word):
            word += "e"
        elif re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.search(word):
            word += "e"
    word = re.sub("(?<=.[^aeiouy])[yY]$", "i", word)

    head, end = _cut(word, _END_2)
    before = {"ogi": "l", "li": "cdeghkmnrt"}.get(end)
    if end and len(head) >= r1 and (before is None or head[-1:] and head[-1] in before):
        word = head + STEP_2[end]
    head, end = _cut(word, _END_3)
    if end and len(head) >= (r2 if end == "ative" else r1):
        word = head + STEP_3[end]
    head, end = _cut(word, _END_4)
    if end and len(head) >= r2 and (end != "ion" or head[-1:] in ("s", "t")):
        word = head
    head = word[:-1]
    if word.endswith("e") and (len(head) >= r2 or len(head) >= r1 and not _SHORT.search(head)) or word.endswith("ll") and len(head) >= r2:
        word = head
    return word.replace("Y", "y")


def runs(text: Column, language: Column) -> Column:
    """The runs of characters that a text's plan reads; `stems` and `terms` make lexemes of them."""
    return F.coalesce(F.when(language.eqNullSafe("ko"), F.regexp_extract_all(text, F.lit(rf"({HANGUL}+|[0-9][0-9,.]*[0-9]|[A-Za-z0-9]+)"), F.lit(1))).otherwise(tokens(text)), F.array().cast("array<string>"))


def _english(run: str) -> list[str]:
    return [] if run in _STOP else [stem(run)]


def _korean(run: str) -> list[str]:
    if not _HANGUL.match(run):
        return [run.lower()]
    return [run[k : k + 2] for k in range(max(1, len(run) - 1))]


def _lexemes(lists: pa.Array, english: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lexemes of all lists' runs, how many each list has, and how many each run; a batch's distinct runs are read once."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    told = [*map(_korean, known), *map(_english, known)]
    lengths = np.array([len(t) for t in told], np.int64)
    starts = np.cumsum(lengths) - lengths
    at = coded.indices.to_numpy() + len(known) * np.repeat(english.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    n = lengths[at]
    place = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return pa.array([x for t in told for x in t], pa.string()).take(pa.array(place, pa.int64())), np.bincount(owner, n, len(sizes)).astype(np.int64), n


@F.arrow_udf(ArrayType(StringType()))
def stems(lists: pa.Array, english: pa.Array) -> pa.Array:
    """Each list's lexemes in order."""
    told, sizes, _ = _lexemes(lists, english)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), told)


@F.arrow_udf(ArrayType(StructType([StructField("lexeme", StringType()), StructField("tf", LongType())])))
def terms(lists: pa.Array, english: pa.Array) -> pa.Array:
    """Each list's distinct lexemes with their counts."""
    told, sizes, _ = _lexemes(lists, english)
    coded = told.dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(pair, np.arange(len(sizes) + 1) * n)
    both = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % n)), pa.array(tf, pa.int64())], names=["lexeme", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


@F.arrow_udf(ArrayType(StructType([StructField("lexeme", StringType()), StructField("at", LongType())])))
def spots(lists: pa.Array, english: pa.Array) -> pa.Array:
    """Each list's lexemes with their places: words that are left out keep theirs, and each Korean pair has one of its own."""
    told, sizes, n = _lexemes(lists, english)
    given = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.arange(given.sum()) - np.repeat(np.cumsum(given) - given, given)
    pair = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.where(np.repeat(english.to_numpy(zero_copy_only=False), sizes), np.repeat(run, n), pair)
    both = pa.StructArray.from_arrays([told, pa.array(at, pa.int64())], names=["lexeme", "at"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), both)


def lexemes(text: Column, language: Column) -> Column:
    """A text's lexemes in order, by the plan of its language: pairs of Hangul for ko, which nothing rewrites, English stems of
    words that are no stop words for all else. A null text has none."""
    return stems(runs(text, language), ~language.eqNullSafe("ko"))


def lexeme_counts(text: Column, language: Column) -> Column:
    """A text's distinct lexemes with their counts, by the same plans."""
    return terms(runs(text, language), ~language.eqNullSafe("ko"))


def lexeme_spots(text: Column, language: Column) -> Column:
    """A text's lexemes with their places, by the same plans."""
    return spots(runs(text, language), ~language.eqNullSafe("ko"))
