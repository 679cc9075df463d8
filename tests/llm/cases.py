"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, slot long, __id long, count long"


def docs(spark, rows):
    """rows: (doc_id, text[, source]); the other columns hold clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
