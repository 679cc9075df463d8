"""Column functions on text: tokens, scripts, years, redaction, whitespace, figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three ranges of Hangul characters.
HANGUL = r"[가-힣ᄀ-ᇿ㄰-㆏]"
#: Fixed value: a year between 1900 and 2099 that no digit touches.
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
#: What is hidden before anything is stored, in this order.
SECRETS = [
    (r"sk-[A-Za-z0-9_-]{8,}", "[REDACTED]"),
    (r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)(Bearer\s+)[A-Za-z0-9._~+/-]+", "$1[REDACTED]"),
]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, their marks and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def korean_tokens(text: Column) -> Column:
    """Runs of Hangul as overlapping pairs of characters (a single one stays), other runs in lower case, figures joined."""
    runs = F.regexp_extract_all(text, F.lit(rf"({HANGUL}+|[0-9][0-9,.]*[0-9]|[A-Za-z0-9]+)"), F.lit(1))
    pairs = lambda run: F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, F.lit(2))))
    return F.flatten(F.transform(runs, lambda run: F.when(run.rlike(HANGUL), pairs(run)).otherwise(F.array(F.lower(run)))))


def language(text: Column) -> Column:
    """ko where any Hangul is, else en."""
    return F.when(text.rlike(HANGUL), F.lit("ko")).otherwise(F.lit("en"))


def years(text: Column) -> Column:
    """The distinct fiscal years that a text names, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({YEAR})"), F.lit(1)), lambda y: y.cast("int"))))


def question_years(question: Column, today: int) -> Column:
    """Named years and those of relative wording, seen from the year `today`: longer offsets are read, and taken out, first."""
    text, found = question, years(question)
    for wording, back in ((r"(?i)two years ago|재작년", 2), (r"(?i)last year|prior year|전년|작년", 1), (r"(?i)this year|current year|올해|금년", 0)):
        found = F.concat(found, F.when(text.rlike(wording), F.array(F.lit(today - back))).otherwise(F.array().cast("array<int>")))
        text = F.regexp_replace(text, wording, " ")
    return F.array_sort(F.array_distinct(found))


def normalize_query(question: Column) -> Column:
    """R&D in words, which tokens would lose."""
    return F.regexp_replace(question, r"(?i)\bR\s*&\s*D\b", "research development")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def redact(text: Column) -> Column:
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def index_text(header: Column, body: Column) -> Column:
    """The text that is indexed: the header over the body, or the body alone."""
    return F.when(F.coalesce(header, F.lit("")) == "", body).otherwise(F.concat(header, F.lit("\n\n"), body))


def figures(text: Column) -> Column:
    """Figures of a text: digits with separators, without identifiers, dates, quarters and bare years."""
    plain = F.regexp_replace(text, r"(?i)\b10-[KQ]\b|\bFY\s?\d{4}|\bItem\s+\d+[A-C]?\b|\bQ[1-4]\b|제\s?\d+기|\d+분기", " ")
    plain = F.regexp_replace(plain, r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4}|\d{4}[.-]\d{1,2}[.-]\d{1,2}|\d{4}년(?:\s*\d{1,2}월)?(?:\s*\d{1,2}일)?", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9.,])([0-9][0-9,]*(?:\.[0-9]+)?)(?![A-Za-z0-9])"), F.lit(1))
    return F.filter(found, lambda f: ~f.rlike(r"^(?:19|20)\d{2}$"))


def magnitude(figure: Column) -> Column:
    """A figure's size without signs and separators; null if it is no number."""
    return F.abs(F.regexp_replace(figure, r"[^0-9.]", "").try_cast("decimal(38,10)"))


def truncate(text: Column, most: int) -> Column:
    """A text of `most` code points or fewer as it is; a longer one up to its last space within them, if there is one."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(text) <= most, text).when(cut == "", head).otherwise(cut)


def is_value(cell: Column) -> Column:
    """Whether a table's cell is a number with its marks, or a dash; labels of periods are not."""
    number = cell.rlike(r"^[\s$€£¥₩(△▲+-]*\d[\d,.]*[\s)%]*$") & ~cell.rlike(r"^\s*(?:19|20)\d{2}\s*$")
    return number | cell.rlike(r"^\s*[-–—]\s*$")


#: Roman numerals that have one character, and full-width digits, as plain letters and digits.
FOLDED = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "Ⅺ": "XI", "Ⅻ": "XII"}


def fold_numerals(title: Column) -> Column:
    for one, plain in FOLDED.items():
        title = F.replace(title, F.lit(one), F.lit(plain))
    return F.translate(title, "０１２３４５６７８９．", "0123456789.")
