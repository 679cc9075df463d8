"""Queries of units, tables, titles and intents over whole documents, whose lines stand in for a filing's blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import stemming as S
from lodestone.operators import chunking, crossrefs, grids, headings, indexing, matching, ranking, tables, units
from lodestone.sources import views

from .queries import CHUNK, DOCUMENT, query
from .suite_queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

# --- units ---------------------------------------------------------------------------------------------------------

#: Lines as blocks: by their lengths headings, tables, tables of captions only, captions and paragraphs, in groups of 40 lines.
BLOCK = f"""{CHUNK}, {DOCUMENT}, block AS (
    SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY line_no) AS k, line_no AS block_no, c.start_char, c.end_char,
           CASE length(body) % 9 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'note' WHEN 3 THEN 'caption' ELSE 'text' END AS kind,
           CASE length(body) % 9 WHEN 2 THEN '(단위 : ' || length(body) % 4 || ')' WHEN 3 THEN '(단위 : ' || length(body) % 5 || ')' ELSE body END AS body,
           line_no // 40 AS grp, CASE WHEN line_no // 40 % 2 = 0 THEN 'Part ' || line_no // 40 END AS grp_heading,
           d.issuer || ' FY' || d.fiscal_year AS citation, d.form AS title
    FROM chunk c JOIN document d USING (doc_id))"""


def filing_blocks(spark, d):
    kind = F.length("body") % 9
    noted = lambda n: F.concat(F.lit("(단위 : "), (F.length("body") % n).cast("string"), F.lit(")"))
    group = F.floor(F.col("line_no") / 40).cast("int")
    docs = views.documents(spark, d).select("doc_id", F.concat("issuer", F.lit(" FY"), "fiscal_year").alias("citation"), F.col("form").alias("title"))
    return views.chunks(spark, d).join(docs, "doc_id").select(
        "doc_id", F.col("line_no").alias("block_no"), F.when(kind == 0, "heading").when(kind.isin(1, 2), "table").otherwise("text").alias("kind"),
        F.when(kind == 2, "").when(kind == 3, noted(5)).otherwise(F.col("body")).alias("text"), group.alias("source_group"),
        F.when(group % 2 == 0, F.concat(F.lit("Part "), group.cast("string"))).alias("source_heading"),
        F.when(kind == 2, F.array(noted(4))).alias("captions"), "citation", "title", "start_char", F.col("end_char").cast("long").alias("end_char"),
    )


@query(rf"""
    WITH RECURSIVE {BLOCK},
    sized AS (SELECT *, len(regexp_extract_all(lower(body), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS tokens FROM block),
    pass AS (
        SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS unit, false AS is_open, 0::BIGINT AS tokens, 0::BIGINT AS chars, NULL::BIGINT AS grp, NULL::VARCHAR AS heading, false AS run,
               []::VARCHAR[] AS caps, NULL::VARCHAR AS kind, NULL::BIGINT AS of_unit, NULL::VARCHAR AS shown, []::VARCHAR[] AS used FROM document
        UNION ALL
        SELECT doc_id, k, CASE WHEN kind = 'text' THEN of_unit ELSE unit + (kind = 'table')::INT END, CASE WHEN kind = 'text' THEN true WHEN kind = 'caption' THEN is_open ELSE false END,
               CASE WHEN kind = 'text' THEN CASE WHEN joins THEN old_tokens ELSE 0 END + tokens ELSE old_tokens END,
               CASE WHEN kind = 'text' THEN CASE WHEN joins THEN old_chars + 2 ELSE 0 END + chars ELSE old_chars END,
               grp, heading, kind = 'heading' OR (run AND kind IN ('note', 'caption')),
               CASE WHEN kind IN ('note', 'caption') THEN list_append(caps, body) ELSE [] END, kind, of_unit,
               CASE WHEN kind = 'table' AND len(caps) > 0 THEN concat_ws(' · ', heading, array_to_string(list_filter(caps, lambda c, i: list_position(caps, c) = i), ' · ')) ELSE heading END,
               CASE WHEN kind = 'table' THEN caps ELSE [] END
        FROM (
            SELECT *, is_open AND kind = 'text' AND head_tokens + old_tokens + tokens <= 120 AND head_chars + old_chars + 2 + chars <= 900 AS joins,
                   CASE WHEN kind = 'table' THEN unit + 1 WHEN kind = 'text' THEN unit + CASE WHEN joins THEN 0 ELSE 1 END END AS of_unit
            FROM (
                SELECT p.doc_id, s.k, p.unit, p.tokens AS old_tokens, p.chars AS old_chars, s.tokens, length(s.body) AS chars, s.grp, s.kind, s.body,
                       p.is_open AND s.grp IS NOT DISTINCT FROM p.grp AND s.kind NOT IN ('heading', 'table', 'note') AS is_open,
                       CASE WHEN s.grp IS DISTINCT FROM p.grp THEN [] ELSE p.caps END AS caps, p.run AND s.grp IS NOT DISTINCT FROM p.grp AS run,
                       CASE WHEN s.kind = 'heading' THEN CASE WHEN p.run AND s.grp IS NOT DISTINCT FROM p.grp THEN p.heading || ' · ' || s.body ELSE s.body END
                            WHEN s.grp IS DISTINCT FROM p.grp THEN s.grp_heading ELSE p.heading END AS heading,
                       concat_ws(' · ', s.citation, s.title, heading) AS head, len(regexp_extract_all(lower(head), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS head_tokens, length(head) + 2 AS head_chars
                FROM pass p JOIN sized s ON s.doc_id = p.doc_id AND s.k = p.k + 1))),
    member AS (SELECT p.*, b.body, b.start_char, b.end_char FROM pass p JOIN block b USING (doc_id, k) WHERE of_unit IS NOT NULL)
    SELECT doc_id, (of_unit - 1)::INT AS unit_no, any_value(kind) AS kind, sha256(string_agg(body, chr(10) || chr(10) ORDER BY k)) AS body_sha256, any_value(shown) AS heading,
           max(len(used))::INT AS n_captions, min(start_char)::BIGINT AS start_char, max(end_char)::BIGINT AS end_char, count(*)::INT AS n_blocks
    FROM member GROUP BY doc_id, of_unit""")
def ref_units(spark, d):
    out = units.units(filing_blocks(spark, d), ["doc_id"], chunking.Budget(120, 1_000_000, 900))
    return out.select("doc_id", F.col("unit_no").cast("int").alias("unit_no"), "kind", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), "heading", F.size("captions").alias("n_captions"), "start_char", "end_char", "n_blocks")


# --- tables --------------------------------------------------------------------------------------------------------

#: Each document as a table: a line is a row of its first word, its rest, its length and its words; some figures lack a span.
#: Atoms are what is packed: rows that fit, else cells that fit beside the row's label, else sentences.
ATOMS = rf"""{CHUNK}, {DOCUMENT},
    line AS (SELECT doc_id, line_no, start_char, end_char, body, CASE WHEN instr(body, ' ') > 1 THEN instr(body, ' ') ELSE length(body) + 1 END AS gap FROM chunk),
    cell AS (
        SELECT doc_id, line_no, 0 AS col, body[:gap - 1] AS text, start_char AS s, start_char + gap - 1 AS e FROM line
        UNION ALL SELECT doc_id, line_no, 1, body[gap + 1:], start_char + least(gap, length(body)), end_char FROM line
        UNION ALL SELECT doc_id, line_no, 2, length(body)::VARCHAR, start_char, end_char FROM line
        UNION ALL SELECT doc_id, line_no, 3, CASE WHEN length(body) % 2 = 0 THEN 'even' ELSE '' END, CASE WHEN doc_id % 7 <> 3 THEN start_char END, end_char FROM line),
    note AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN repeat('context ', 57) ELSE issuer END AS context, CASE WHEN doc_id % 3 = 0 THEN ['(단위 : 원)'] ELSE [] END AS captions FROM document),
    base AS (SELECT doc_id, len(regexp_extract_all(lower(context), '[\p{{L}}\p{{M}}\p{{N}}]+')) + 2 * len(captions) AS base, captions FROM note),
    sized AS (SELECT *, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS n FROM cell),
    grp AS (SELECT doc_id, base, captions, unnest(CASE WHEN base + 4 > 60 THEN [[0, 1], [0, 2], [0, 3]] ELSE [[0, 1, 2, 3]] END) AS cols FROM base),
    rows AS (
        SELECT doc_id, cols, captions, 60 - base - len(cols) AS room, line_no, sum(n) FILTER (list_contains(cols, col)) AS n, max(n) FILTER (col = 0) AS label
        FROM sized JOIN grp USING (doc_id) GROUP BY ALL),
    atom AS (
        SELECT doc_id, cols, line_no, -1 AS col, 0 AS nth, room, n::BIGINT AS n, 'row' AS kind, '' AS text FROM rows WHERE n <= room
        UNION ALL
        SELECT doc_id, cols, line_no, col, 0, room, s.n, 'cell', text FROM rows r JOIN sized s USING (doc_id, line_no)
        WHERE r.n > room AND list_contains(cols, col) AND text <> '' AND s.n + CASE WHEN col > 0 THEN label ELSE 0 END <= room
        UNION ALL
        SELECT doc_id, cols, line_no, col, unnest(range(len(parts))), room, len(regexp_extract_all(lower(unnest(parts)), '[\p{{L}}\p{{M}}\p{{N}}]+')), 'sentence', unnest(parts)
        FROM (
            SELECT doc_id, cols, line_no, col, room, list_filter(string_split(regexp_replace(text, '([.!?。！？])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: p <> '') AS parts
            FROM rows r JOIN sized s USING (doc_id, line_no)
            WHERE r.n > room AND list_contains(cols, col) AND text <> '' AND s.n + CASE WHEN col > 0 THEN label ELSE 0 END > room)),
    ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cols, line_no, col, nth) AS k FROM atom),
    pass AS (
        SELECT doc_id, 0::BIGINT AS k, -1::BIGINT AS piece, NULL::INT[] AS cols, 0::BIGINT AS line_no, 0 AS col, ''::VARCHAR AS kind, ''::VARCHAR AS text, 0::BIGINT AS held, 0::BIGINT AS begun FROM document
        UNION ALL
        SELECT doc_id, k, piece + (NOT joins)::INT, cols, line_no, col, kind, text, n + CASE WHEN joins THEN held ELSE 0 END,
               CASE WHEN kind = 'sentence' AND goes_on THEN begun + before ELSE 0 END FROM (
            SELECT p.doc_id, o.k, p.piece, o.cols, o.line_no, o.col, o.kind, o.text, o.n, p.held, p.begun, length(p.text) AS before,
                   p.kind = o.kind AND p.cols = o.cols AND p.line_no = o.line_no AND p.col = o.col AS goes_on,
                   p.kind = o.kind AND p.cols = o.cols AND p.held + o.n <= o.room AND (o.kind = 'row' OR (o.kind = 'sentence' AND goes_on)) AS joins
            FROM pass p JOIN ordered o ON o.doc_id = p.doc_id AND o.k = p.k + 1)),
    told AS (SELECT doc_id, piece, kind, any_value(cols) AS cols, line_no, any_value(col) AS col, string_agg(text, '' ORDER BY k) AS part, min(begun) AS begun FROM pass WHERE k > 0 GROUP BY doc_id, piece, kind, line_no),
    member AS (
        SELECT t.doc_id, t.piece, t.line_no, c.col, t.kind, t.col AS own, c.s, c.e,
               CASE WHEN t.kind = 'row' OR (t.kind = 'cell' AND c.col IN (0, t.col)) THEN c.text WHEN t.kind = 'sentence' AND c.col = t.col THEN t.part ELSE '' END AS text,
               CASE WHEN t.kind = 'sentence' THEN t.begun ELSE 0 END AS first, t.kind <> 'sentence' OR c.col = t.col AS tells
        FROM told t JOIN cell c ON c.doc_id = t.doc_id AND c.line_no = t.line_no AND list_contains(t.cols, c.col))"""
SHOWN = "'| ' || array_to_string({}, ' | ') || ' |'"


def document_tables(spark, d):
    """(cells, notes) of the stand-in for tables."""
    gap = F.when(F.instr("body", " ") > 1, F.instr("body", " ")).otherwise(F.length("body") + 1)
    lines = views.chunks(spark, d).withColumn("gap", gap)
    span = lambda a, b: F.struct(a.cast("long").alias("start_char"), b.cast("long").alias("end_char"))
    cell = lambda col, text, source: F.struct(F.lit(col).alias("col"), text.alias("text"), F.array(source).alias("sources"))
    start, end, body = F.col("start_char"), F.col("end_char"), F.col("body")
    of_line = F.array(
        cell(0, F.substring(body, F.lit(1), F.col("gap") - 1), span(start, start + F.col("gap") - 1)),
        cell(1, F.substring(body, F.col("gap") + 1, F.length(body)), span(start + F.least("gap", F.length(body)), end)),
        cell(2, F.length(body).cast("string"), span(start, end)),
        cell(3, F.when(F.length(body) % 2 == 0, "even").otherwise(""), span(F.when(F.col("doc_id") % 7 != 3, start), end)),
    )
    cells = lines.select("doc_id", F.col("line_no").alias("row_no"), F.lit(False).alias("header"), F.explode(of_line).alias("c"))
    docs = views.documents(spark, d)
    names = F.explode(F.array(*(cell(k, F.lit(n), span(F.lit(0), F.lit(1))) for k, n in enumerate(("Label", "Text", "Length", "Even")))))
    heads = docs.select("doc_id", F.lit(-1).alias("row_no"), F.lit(True).alias("header"), names.alias("c"))
    captions = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("(단위 : 원)").alias("text"), F.lit(0).cast("long").alias("start_char"), F.lit(2).cast("long").alias("end_char"))))
    notes = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.repeat(F.lit("context "), F.lit(57))).otherwise(F.col("issuer")).alias("context"), captions.alias("captions"))
    return cells.unionByName(heads).select("doc_id", "row_no", "header", "c.col", "c.text", "c.sources"), notes


TABLE_BUDGET = chunking.Budget(60, 1_000_000, 1_000_000_000)


@query(rf"""
    WITH RECURSIVE {ATOMS},
    shown AS (SELECT doc_id, piece, line_no, {SHOWN.format(r"list(trim(regexp_replace(replace(replace(text, '\', '\\'), '|', '\|'), '\s+', ' ', 'g')) ORDER BY col)")} AS line FROM member GROUP BY doc_id, piece, line_no),
    whole AS (SELECT doc_id, piece, string_agg(line, chr(10) ORDER BY line_no) AS lines, count(*)::INT AS n_rows FROM shown GROUP BY doc_id, piece),
    counted AS (SELECT doc_id, piece, count(*) FILTER (tells)::INT AS n_cells, sum(CASE WHEN tells THEN (line_no + 1) * (col + 1) * (first + length(text) + 1) ELSE 0 END)::BIGINT AS places FROM member GROUP BY doc_id, piece),
    head AS (SELECT DISTINCT doc_id, piece, cols FROM told)
    SELECT doc_id, piece::INT AS piece, n_rows, n_cells, places,
           sha256(CASE WHEN len(captions) > 0 THEN captions[1] || chr(10) ELSE '' END || {SHOWN.format("list_transform(cols, lambda c: ['Label', 'Text', 'Length', 'Even'][c + 1])")} || chr(10) || {SHOWN.format("list_transform(cols, lambda c: '---')")} || chr(10) || lines) AS body_sha256
    FROM whole JOIN counted USING (doc_id, piece) JOIN head USING (doc_id, piece) JOIN base USING (doc_id)""")
def ref_table_pieces(spark, d):
    cells, notes = document_tables(spark, d)
    pieces = tables.pack(cells, ["doc_id"], notes, TABLE_BUDGET)
    places = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + F.aggregate(F.transform(r["cells"], lambda c, i: F.when(c["told"], (r["row_no"] + 1) * (F.get("cols", i) + 1) * (c["text_end"] + 1)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x))
    # with four columns they are all; a group of two is the label and the column whose heading it has
    cols = F.transform("heads", lambda h: F.array_position(F.array(*map(F.lit, ("Label", "Text", "Length", "Even"))), h[0]["text"]).cast("int") - 1)
    told = pieces.withColumn("cols", cols)
    n_cells = F.size(F.filter(F.flatten(F.col("rows.cells")), lambda c: c["told"]))
    return told.select("doc_id", F.col("piece"), F.size("rows").alias("n_rows"), n_cells.alias("n_cells"), places.alias("places"), F.sha2(tables.markdown().cast("binary"), 256).alias("body_sha256"))


@query(rf"""
    WITH RECURSIVE {ATOMS},
    spans AS (
        SELECT doc_id, piece, s, e FROM member WHERE tells
        UNION SELECT doc_id, piece, 0, 1 FROM told
        UNION SELECT doc_id, piece, 0, 2 FROM told JOIN base USING (doc_id) WHERE len(captions) > 0)
    SELECT doc_id, piece::INT AS piece, CASE WHEN count(*) = count(s) THEN count(*) END::INT AS n_spans, CASE WHEN count(*) = count(s) THEN sha256(string_agg(s || '-' || e, ',' ORDER BY s, e)) END AS spans_sha256
    FROM spans GROUP BY doc_id, piece""")
def ref_cell_spans(spark, d):
    cells, notes = document_tables(spark, d)
    spans = tables.pack(cells, ["doc_id"], notes, TABLE_BUDGET).select("doc_id", "piece", tables.cell_spans().alias("spans"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_char"].cast("string"), s["end_char"].cast("string"))), ",")
    return spans.select("doc_id", "piece", F.when(F.col("spans").isNotNull(), F.size("spans")).alias("n_spans"), F.sha2(told.cast("binary"), 256).alias("spans_sha256"))


# --- lexemes -------------------------------------------------------------------------------------------------------


def _stem_sql() -> str:
    """stemmed(word, lexeme): the distinct tokens of all texts, step by step; a step's suffix is the longest that matches."""
    end = lambda w, suffixes: f"regexp_extract({w}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$')"
    both = lambda suffixes: f"{end('w', suffixes)} AS e, w[:length(w) - length({end('w', suffixes)})] AS h"
    put = lambda table: "CASE e " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
    one_of = lambda words: ", ".join(f"'{w}'" for w in words)
    short = "regexp_matches({0}, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"
    region = "coalesce(nullif(length(regexp_extract({0}, '^.*?[aeiouy][^aeiouy]')), 0), length({0}))"
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.OWN.items())
    return rf"""
    vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)),
    kept AS (SELECT word, regexp_replace(word, '(^|[aeiouy])y', '\1Y', 'g') AS w FROM vocabulary WHERE word NOT IN ({one_of(S.STOP)})),
    r AS (SELECT *, CASE WHEN regexp_matches(w, '^({S.BEGIN})') THEN length(regexp_extract(w, '^({S.BEGIN})')) ELSE {region.format("w")} END AS r1 FROM kept),
    rr AS (SELECT *, r1 + {region.format("w[r1 + 1:]")} AS r2 FROM r),
    a0 AS (SELECT *, {end("w", ["sses", "ied", "ies", "us", "ss", "s"])} AS e FROM rr),
    a1 AS (SELECT * REPLACE (CASE WHEN e = 'sses' THEN w[:-3] WHEN e IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
        WHEN e = 's' AND regexp_matches(w[:-2], '[aeiouy].') THEN w[:-2] ELSE w END AS w) FROM a0),
    b0 AS (SELECT * EXCLUDE (e), {both(["eed", "eedly", "ed", "edly", "ing", "ingly"])} FROM a1),
    b1 AS (SELECT *, e NOT IN ('', 'eed', 'eedly') AND regexp_matches(h, '[aeiouy]') AS cut FROM b0),
    b2 AS (SELECT * REPLACE (CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(h) >= r1 THEN h || 'ee' ELSE w END
        WHEN NOT cut THEN w WHEN regexp_matches(h, '(at|bl|iz)$') THEN h || 'e' WHEN regexp_matches(h, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN h[:-2]
        WHEN length(h) <= r1 AND {short.format("h")} THEN h || 'e' ELSE h END AS w) FROM b1),
    c1 AS (SELECT * REPLACE (regexp_replace(w, '(.[^aeiouy])[yY]$', '\1i') AS w) FROM b2),
    d0 AS (SELECT * EXCLUDE (e, h), {both(S.STEP_2)} FROM c1),
    d1 AS (SELECT * REPLACE (CASE WHEN e = '' OR length(h) < r1 OR (e = 'ogi' AND h[-1] <> 'l') OR (e = 'li' AND NOT regexp_matches(h, '[cdeghkmnrt]$')) THEN w ELSE h || {put(S.STEP_2)} END AS w) FROM d0),
    e0 AS (SELECT * EXCLUDE (e, h), {both(S.STEP_3)} FROM d1),
    e1 AS (SELECT * REPLACE (CASE WHEN e = '' OR length(h) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN w ELSE h || {put(S.STEP_3)} END AS w) FROM e0),
    f0 AS (SELECT * EXCLUDE (e, h), {both(S.STEP_4)} FROM e1),
    f1 AS (SELECT * REPLACE (CASE WHEN e = '' OR length(h) < r2 OR (e = 'ion' AND NOT regexp_matches(h, '[st]$')) THEN w ELSE h END AS w) FROM f0),
    g1 AS (SELECT * REPLACE (CASE WHEN (w[-1] = 'e' AND (length(w) > r2 OR (length(w) > r1 AND NOT {short.format("w[:-2]")}))) OR (w[-2:] = 'll' AND length(w) > r2) THEN w[:-2] ELSE w END AS w) FROM f1),
    stemmed AS MATERIALIZED (
        SELECT g1.word, CASE WHEN length(g1.word) < 3 OR g1.word IN ({one_of(S.STAY)}) THEN g1.word ELSE CASE g1.word {own} ELSE
            CASE WHEN a1.w IN ({one_of(S.STAY_THEN)}) THEN a1.w ELSE replace(g1.w, 'Y', 'y') END END END AS lexeme FROM g1 JOIN a1 USING (word))"""


#: The terms of each line, as the index holds them.
TERM = rf"""{_stem_sql()}, {CHUNK},
    term AS MATERIALIZED (SELECT doc_id, line_no, language, lexeme, count(*) AS tf
        FROM (SELECT doc_id, line_no, language, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM chunk) JOIN stemmed USING (word) GROUP BY ALL)"""


@query(rf"""
    WITH {TERM}
    SELECT c.doc_id, c.line_no, coalesce(sum(tf), 0)::BIGINT AS dl, sha256(coalesce(string_agg(lexeme || ':' || tf, ',' ORDER BY lexeme), '')) AS terms_sha256
    FROM chunk c LEFT JOIN term t ON c.doc_id = t.doc_id AND c.line_no = t.line_no GROUP BY c.doc_id, c.line_no""")
def ref_lexemes(spark, d):
    index = indexing.forward(views.chunks(spark, d), ["doc_id", "line_no"])
    told = F.array_join(F.transform(F.array_sort("terms"), lambda t: F.concat_ws(":", t["lexeme"], t["tf"].cast("string"))), ",")
    return index.select("doc_id", "line_no", "dl", F.sha2(told.cast("binary"), 256).alias("terms_sha256"))


#: BM25 over the lines' terms; `asked` holds the questions' lexemes.
SCORED = r"""
    weighed AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY language, lexeme) AS df, sum(tf) OVER (PARTITION BY doc_id, line_no) AS dl FROM term),
    stat AS (SELECT language, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, line_no, language, dl FROM weighed) GROUP BY language),
    asked AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, lexeme FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM benchmark) JOIN stemmed USING (word)),
    scored AS (
        SELECT query_id, doc_id, line_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM weighed JOIN asked USING (lexeme) JOIN stat USING (language) GROUP BY ALL)"""


@query(rf"""
    WITH {TERM}, {SCORED}
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, line_no)::INT AS rank FROM scored QUALIFY rank <= 10""")
def ref_bm25_lexemes(spark, d):
    index = indexing.forward(views.chunks(spark, d), ["doc_id", "line_no"])
    return ranking.bm25_best(views.questions(spark, d), index, ["doc_id", "line_no"], 10)


# --- web searches --------------------------------------------------------------------------------------------------


@query(rf"""
    WITH {_stem_sql()},
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS spot FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents)),
    place AS (SELECT doc_id, spot, lexeme FROM word JOIN stemmed USING (word)),
    q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM benchmark),
    part AS (
        SELECT query_id, 0 AS operand, false AS excluded, 0 AS pos, w[1] AS word FROM q
        UNION ALL SELECT query_id, 1, false, 0, w[2] FROM q UNION ALL SELECT query_id, 1, false, 1, w[3] FROM q UNION ALL SELECT query_id, 1, false, 2, w[4] FROM q
        UNION ALL SELECT query_id, 2, false, 0, w[9] FROM q
        UNION ALL SELECT query_id, 3, true, 0, w[6] FROM q),
    wanted AS (SELECT query_id, operand, excluded, lexeme, pos - min(pos) OVER (PARTITION BY query_id, operand) AS nth, count(*) OVER (PARTITION BY query_id, operand) AS n FROM part JOIN stemmed USING (word)),
    met AS (SELECT query_id, operand, excluded, doc_id FROM wanted JOIN place USING (lexeme) GROUP BY query_id, operand, excluded, doc_id, spot - nth, n HAVING count(*) = n)
    SELECT query_id, doc_id FROM met GROUP BY query_id, doc_id HAVING NOT bool_or(excluded)""")
def ref_web_search(spark, d):
    w = F.regexp_extract_all(F.lower("question"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))
    asked = views.questions(spark, d).select("query_id", w.alias("w"))
    at = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(""))
    queries = asked.select("query_id", F.concat(at(0), F.lit(' "'), at(1), F.lit(" "), at(2), F.lit(" "), at(3), F.lit('" OR '), at(8), F.lit(" -"), at(5)).alias("query"))
    return matching.relaxed(queries, views.documents(spark, d), ["doc_id"])


# --- cross-references ----------------------------------------------------------------------------------------------

#: The plain text of a title, and its words that say something.
PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'))"
SAID = "list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array({0}, ' +'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in crossrefs.SILENT) + ")), lambda w: regexp_replace(w, 's+$', ''))))"


@query(rf"""
    WITH RECURSIVE {CHUNK},
    title AS (
        SELECT doc_id, (line_no * 7) % 11 * 1000000 + line_no AS row_no, line_no AS page,
               CASE WHEN line_no % 2 = 0 THEN '* ' || body || '!' ELSE array_to_string(list_reverse(string_split(body, ' ')), ' ') END AS title
        FROM chunk WHERE line_no % 3 = 1),
    plain AS (SELECT doc_id, row_no, page, {PLAIN.format("title")} AS p, {SAID.format(PLAIN.format("title"))} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS k FROM title),
    body AS (SELECT doc_id, line_no, {PLAIN.format("body")} AS p, {SAID.format(PLAIN.format("body"))} AS w FROM chunk WHERE line_no % 6 <> 5 AND length({PLAIN.format("body")}) < 120),
    exact AS (SELECT t.doc_id, k, list(line_no ORDER BY line_no) AS places FROM plain t JOIN body b ON t.doc_id = b.doc_id AND t.p = b.p AND t.p <> '' GROUP BY ALL),
    same AS (SELECT t.doc_id, k, list(line_no ORDER BY line_no) AS places FROM plain t JOIN body b ON t.doc_id = b.doc_id AND t.w = b.w AND len(t.w) > 0 GROUP BY ALL),
    pair AS MATERIALIZED (SELECT p.doc_id, p.k, p.row_no, p.page, coalesce(e.places, []) AS e, coalesce(s.places, []) AS s FROM plain p LEFT JOIN exact e USING (doc_id, k) LEFT JOIN same s USING (doc_id, k)),
    walk AS (
        SELECT DISTINCT doc_id, 0::BIGINT AS k, 0 AS cursor, NULL::INT AS hit FROM plain
        UNION ALL
        SELECT b.doc_id, b.k, coalesce(h + 1, cursor), h FROM (
            SELECT b.doc_id, b.k, w.cursor, coalesce(list_min(list_filter(b.e, lambda x: x >= w.cursor)), list_min(list_filter(b.s, lambda x: x >= w.cursor))) AS h
            FROM walk w JOIN pair b ON b.doc_id = w.doc_id AND b.k = w.k + 1) b)
    SELECT doc_id, row_no::INT AS row_no, page::BIGINT AS page, hit AS block_no FROM walk JOIN pair USING (doc_id, k) WHERE hit IS NOT NULL""")
def ref_located_titles(spark, d):
    lines = views.chunks(spark, d)
    turned = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("* "), "body", F.lit("!"))).otherwise(F.array_join(F.reverse(F.split("body", " ")), " "))
    titles = lines.where(F.col("line_no") % 3 == 1).select("doc_id", ((F.col("line_no") * 7) % 11 * 1000000 + F.col("line_no")).alias("row_no"), turned.alias("title"), F.col("line_no").cast("bigint").alias("page"))
    blocks = lines.select("doc_id", F.col("line_no").alias("block_no"), F.col("body").alias("text"), (F.col("line_no") % 6 == 5).alias("skip"))
    return crossrefs.located(titles, blocks).select("doc_id", "row_no", "page", "block_no")


@query(rf"""
    WITH RECURSIVE {CHUNK},
    rows AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, n, length(body) AS l,
               line_no // 5 % 16 + 1 AS item, trim(rtrim(body[:20], ':')) AS title, n = 0 AS is_item, n = 0 AND l % 4 = 3 AS open_row,
               CASE WHEN n = 0 THEN ['Not applicable', '(a)', (l % 300) || '-' || ((l + 7) % 300), ''][l % 4 + 1] WHEN n = 1 THEN 'Page ' || l % 200 WHEN n = 2 THEN ['none', '(b)', ''][l % 3 + 1] ELSE '' END AS value
        FROM (SELECT *, line_no % 5 AS n FROM chunk)),
    pass AS (
        SELECT DISTINCT doc_id, 0::BIGINT AS k, 0 AS entry, true AS closed, false AS taken, ''::VARCHAR AS value FROM rows
        UNION ALL
        SELECT r.doc_id, r.k, p.entry + r.is_item::INT, CASE WHEN r.is_item THEN NOT r.open_row ELSE p.closed OR r.value = 'none' END,
               r.is_item OR (p.entry > 0 AND NOT p.closed AND r.value <> ''), r.value
        FROM pass p JOIN rows r ON r.doc_id = p.doc_id AND r.k = p.k + 1),
    note AS (SELECT p.doc_id, CASE n WHEN 3 THEN 'a' ELSE 'b' END AS letter, arg_max(CASE n WHEN 3 THEN 'Incorporated ' ELSE 'By reference ' END || repeat('x', l % 7 + 1), k) AS note FROM pass p JOIN rows r USING (doc_id, k) WHERE n IN (3, 4) GROUP BY ALL),
    told AS (
        SELECT doc_id, entry, max(item) FILTER (is_item) AS item, max(title) FILTER (is_item) AS title,
               string_agg(CASE WHEN n = 0 THEN least(l % 300, (l + 7) % 300) || '-' || greatest(l % 300, (l + 7) % 300) ELSE (l % 200) || '-' || (l % 200) END, ',' ORDER BY k) FILTER (regexp_matches(p.value, '[0-9]')) AS spans,
               arg_max(p.value, k) FILTER (p.value IN ('Not applicable', 'none', '(a)', '(b)')) AS last, arg_max(p.value[2:2], k) FILTER (p.value IN ('(a)', '(b)')) AS letter
        FROM pass p JOIN rows r USING (doc_id, k) WHERE taken GROUP BY ALL)
    SELECT doc_id, entry, item::VARCHAR AS item, title, coalesce(spans, '') AS spans,
           CASE WHEN spans IS NOT NULL THEN 'parsed' WHEN last IN ('(a)', '(b)') AND NOT regexp_matches(title, '(?i)^\s*(not applicable|none|n/?a|\[?reserved\]?)\.?\s*$') THEN 'incorporated_by_reference' ELSE 'empty_disclosure' END AS status,
           coalesce(note, letter) AS reference
    FROM told LEFT JOIN note USING (doc_id, letter)""")
def ref_index_entries(spark, d):
    n, l = F.col("line_no") % 5, F.length("body")
    item = F.concat(F.lit("Item "), (F.floor(F.col("line_no") / 5) % 16 + 1).cast("string"), F.lit("."))
    title, text = F.substring("body", 1, 20), lambda c: c.cast("string")
    value = F.when(l % 4 == 0, "Not applicable").when(l % 4 == 1, "(a)").when(l % 4 == 2, F.concat(text(l % 300), F.lit("-"), text((l + 7) % 300)))
    cells = (
        F.when(n == 0, F.array_compact(F.array(item, title, value)))
        .when(n == 1, F.array(F.lit("Statements"), F.concat(F.lit("Page "), text(l % 200))))
        .when(n == 2, F.array(F.when(l % 3 == 0, "none").when(l % 3 == 1, "(b)").otherwise("see there")))
        .when(n == 3, F.array(F.concat(F.lit("(a) Incorporated "), F.repeat(F.lit("x"), l % 7 + 1))))
        .otherwise(F.array(F.concat(F.lit("(b) By reference "), F.repeat(F.lit("x"), l % 7 + 1))))
    )
    out = crossrefs.entries(views.chunks(spark, d).select("doc_id", F.col("line_no").alias("row_no"), cells.alias("cells")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["low"].cast("string"), s["high"].cast("string"))), ",")
    return out.select("doc_id", F.col("entry").cast("int").alias("entry"), "item", "title", spans.alias("spans"), "status", "reference")


@query(rf"""
    WITH {CHUNK},
    line AS (SELECT doc_id, line_no, {SAID.format(PLAIN.format("body"))} AS w, body FROM chunk),
    rng AS (
        SELECT doc_id, line_no AS entry, (line_no % 16 + 1) || CASE WHEN line_no % 3 = 0 THEN 'A' ELSE '' END AS item, w, unnest([line_no * 2 % 90, line_no % 40 + 50]) AS low, unnest([line_no * 2 % 90 + 10, line_no % 40 + 53]) AS high
        FROM line WHERE line_no % 4 = 0 AND line_no % 12 <> 8),
    hit AS (
        SELECT l.doc_id, l.line_no, r.item, row_number() OVER (PARTITION BY l.doc_id, l.line_no ORDER BY len(list_intersect(l.w, r.w)) DESC, high - low, length(item), entry) AS nth
        FROM line l JOIN rng r ON l.doc_id = r.doc_id AND l.line_no * 3 % 97 BETWEEN low AND high)
    SELECT doc_id, line_no, item FROM hit WHERE nth = 1""")
def ref_page_items(spark, d):
    lines = views.chunks(spark, d)
    at = F.col("line_no")
    spans = F.array(*(F.struct(low.cast("int").alias("low"), (low + n).cast("int").alias("high")) for low, n in ((at * 2 % 90, 10), (at % 40 + 50, 3))))
    code = F.concat((at % 16 + 1).cast("string"), F.when(at % 3 == 0, "A").otherwise(""))
    index = lines.where((at % 4 == 0)).select("doc_id", at.alias("entry"), code.alias("item"), F.col("body").alias("title"), spans.alias("spans"), F.when(at % 12 == 8, "empty_disclosure").otherwise("parsed").alias("status"))
    points = lines.select("doc_id", "line_no", (at * 3 % 97).cast("bigint").alias("page"), F.col("body").alias("title"))
    return crossrefs.items_of_pages(points, index).select("doc_id", "line_no", "item")


# --- headings ------------------------------------------------------------------------------------------------------


@query(rf"""
    WITH {CHUNK},
    block AS (
        SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, CASE WHEN length(body) % 3 < 2 THEN 'Item ' || (line_no % 18 + 1) || ['A', '', '.', ' -'][length(body) % 4 + 1] || ' ' || body ELSE body END AS text,
               [400, 700, 800][length(body) % 5 % 3 + 1] AS weight, 8 + length(body) % 4 * 0.5::DOUBLE AS size, length(body) % 10 > 5 + doc_id % 4 AS in_table
        FROM chunk),
    named AS (SELECT *, upper(regexp_extract(text, '(?i)^\s*item\s+(1[0-6]|[1-9])([A-C])?\s*[.\-–—:]?\s*.*$', 1) || regexp_extract(text, '(?i)^\s*item\s+(1[0-6]|[1-9])([A-C])?\s*[.\-–—:]?\s*.*$', 2)) AS item FROM block),
    cand AS (SELECT *, item <> '' AND length(text) <= 300 AS is_named, is_named AND weight >= 700 AS bold FROM named),
    doc AS (
        SELECT doc_id, count(*) AS n, count(*) FILTER (bold AND NOT in_table) AS n_out, count(*) FILTER (bold) AS n_bold, count(*) FILTER (is_named) AS n_named, max(k) FILTER (is_named) - min(k) FILTER (is_named) AS spread,
               min(weight) FILTER (bold AND NOT in_table) AS w_out, min(size) FILTER (bold AND NOT in_table) AS s_out, min(weight) FILTER (bold) AS w_all, min(size) FILTER (bold) AS s_all
        FROM cand GROUP BY doc_id),
    rule AS (
        SELECT doc_id, n_out < 15 AS tables, CASE WHEN n_out >= 15 THEN w_out ELSE w_all END AS w, CASE WHEN n_out >= 15 THEN s_out ELSE s_all END AS s
        FROM doc WHERE n_out >= 15 OR (n_bold >= 5 AND NOT (n_named >= 10 AND spread < n * 0.15)))
    SELECT doc_id, line_no AS block_no, item FROM cand JOIN rule USING (doc_id) WHERE item <> '' AND weight >= w AND size >= s AND (tables OR NOT in_table)""")
def ref_headings(spark, d):
    l = F.length("body")  # noqa: E741
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n + 1).cast("int"))
    text = F.when(l % 3 < 2, F.concat(F.lit("Item "), (F.col("line_no") % 18 + 1).cast("string"), pick(("A", "", ".", " -"), l % 4), F.lit(" "), "body")).otherwise(F.col("body"))
    blocks = views.chunks(spark, d).select("doc_id", F.col("line_no").alias("block_no"), text.alias("text"), pick((400, 700, 800), l % 5 % 3).alias("font_weight"), (8 + l % 4 * 0.5).alias("font_size"), (l % 10 > 5 + F.col("doc_id") % 4).alias("in_table"))
    items = blocks.select("doc_id", "block_no", headings.item_number(F.col("text")).alias("item")).where("item IS NOT NULL")
    return headings.headings(blocks, items, headings.number_rules(blocks))


@query(rf"""
    WITH {CHUNK},
    title AS (SELECT doc_id AS item, trim(regexp_replace(lower(body[:24]), '[^a-z ]', '', 'g')) AS c FROM chunk WHERE line_no = 0 AND doc_id % 4 = 0),
    text AS (SELECT doc_id, line_no, trim(regexp_replace(lower(body[:8 + length(body) % 20]), '[^a-z ]', '', 'g')) AS t FROM chunk),
    path AS (SELECT c AS path, item FROM title WHERE length(c) BETWEEN 1 AND 13 UNION ALL SELECT c[:n], item FROM title, range(8, 15) r(n) WHERE length(c) >= 14)
    SELECT doc_id, line_no, min(item) AS item FROM text JOIN path ON length(t) >= 8 AND (t = path OR (length(path) = 14 AND t[:14] = path)) GROUP BY doc_id, line_no""")
def ref_canonical_titles(spark, d):
    lines = views.chunks(spark, d)
    titles = lines.where((F.col("line_no") == 0) & (F.col("doc_id") % 4 == 0)).select(F.col("doc_id").alias("item"), F.col("doc_id").alias("place"), F.substring("body", 1, 24).alias("title"))
    texts = lines.select("doc_id", "line_no", F.substring("body", F.lit(1), 8 + F.length("body") % 20).alias("text"))
    return headings.canonical_items(texts, titles, ["doc_id", "line_no"])


@query(rf"""
    WITH {TERM}, {SCORED.replace("FROM benchmark", "FROM (SELECT * FROM benchmark WHERE item_id % 5 <> 0)")},
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, line_no)::INT AS rank FROM scored QUALIFY rank <= 3),
    state AS (SELECT count(*) AS n_chunks, count(*) AS n_indexed, 0::BIGINT AS n_missing, 0::BIGINT AS n_stale, 0::BIGINT AS n_orphans, true AS ready FROM chunk)
    SELECT q.item_id AS query_id, n_chunks, n_indexed, n_missing, n_stale, n_orphans, ready, doc_id, line_no, score, rank
    FROM (SELECT DISTINCT item_id FROM benchmark) q CROSS JOIN state LEFT JOIN best ON best.query_id = q.item_id""")
def ref_ready_search(spark, d):
    chunks = views.chunks(spark, d).withColumn("version", F.sha2(F.col("body").cast("binary"), 256))
    index = indexing.forward(chunks, ["doc_id", "line_no", "version"])
    questions = views.questions(spark, d)
    # a fifth of the questions has stop words only, and so no hit
    asked = questions.withColumn("question", F.when(F.col("query_id") % 5 == 0, "what is this of").otherwise(F.col("question")))
    state = indexing.readiness(chunks, index, ["doc_id", "line_no"], "version")
    return ranking.answered(questions, ranking.bm25_best(asked, index, ["doc_id", "line_no"], 3), state)


# --- grids ---------------------------------------------------------------------------------------------------------


@query(rf"""
    WITH {CHUNK},
    doc AS (SELECT DISTINCT doc_id FROM chunk)
    SELECT doc_id, -1 AS row_no, 0 AS col, true AS header, '(단위 : 원) (기준일 : 2024년 3월 1일)' AS text, '3-6' AS sources FROM doc WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 1, unnest([0, 1, 2]), true, unnest(['', 'Amount', 'Share of all']), unnest(['0-1', '1-2', '2-3']) FROM doc
    UNION ALL SELECT doc_id, line_no + 2, 0, false, 'L' || line_no, start_char || '-' || (start_char + 1) FROM chunk
    UNION ALL SELECT doc_id, line_no + 2, 1, false, CASE WHEN length(body) % 2 = 0 THEN '$ ' ELSE '€ ' END || length(body), start_char || '-' || (start_char + 2) || ',' || start_char || '-' || (start_char + 3) FROM chunk
    UNION ALL SELECT doc_id, line_no + 2, 2, false, length(body) % 100 || CASE WHEN length(body) % 5 > 0 THEN ' %' ELSE '' END, start_char || '-' || (start_char + 4) || CASE WHEN length(body) % 5 > 0 OR any_sign THEN ',' || start_char || '-' || (start_char + 5) ELSE '' END
        FROM (SELECT *, bool_or(length(body) % 5 > 0) OVER (PARTITION BY doc_id) AS any_sign FROM chunk)""")
def ref_grids(spark, d):
    lines = views.chunks(spark, d)
    at, l = F.col("start_char"), F.length("body")  # noqa: E741
    cell = lambda k, text, start, end, across=1, align=None: F.struct(F.lit(k).alias("cell_no"), text.alias("text"), F.lit(1).alias("rowspan"), F.lit(across).alias("colspan"), F.lit(align).cast("string").alias("align"), start.cast("long").alias("start_char"), end.cast("long").alias("end_char"))
    texts = (F.concat(F.lit("L"), F.col("line_no").cast("string")), F.when(l % 2 == 0, "$").otherwise("€"), l.cast("string"), (l % 100).cast("string"), F.when(l % 5 > 0, "%").otherwise(""))
    body = lines.select("doc_id", (F.col("line_no") + 2).alias("row_no"), F.explode(F.array(*(cell(k, t, at, at + k + 1) for k, t in enumerate(texts)))).alias("c"))
    docs = views.read(spark, d, "documents").where(F.exists(F.split("text", "\n"), lambda x: F.trim(x) != "")).select("doc_id").distinct()
    heads = F.array(cell(0, F.lit(""), F.lit(0), F.lit(1)), cell(1, F.lit("Amount"), F.lit(1), F.lit(2), 2, "right"), cell(2, F.lit("Share of all"), F.lit(2), F.lit(3), 2))
    notes = F.array(cell(0, F.lit("(단위 : 원)"), F.lit(3), F.lit(4), 4), cell(1, F.lit("(기준일 : 2024년 3월 1일)"), F.lit(5), F.lit(6)))
    above = F.array(F.struct(F.lit(1).alias("row_no"), heads.alias("cells")), F.struct(F.lit(0).alias("row_no"), F.when(F.col("doc_id") % 3 == 0, notes).alias("cells")))
    cells = body.unionByName(docs.select("doc_id", F.inline(above)).select("doc_id", "row_no", F.explode("cells").alias("c")))
    told = grids.told(cells.select("doc_id", "row_no", "c.*"), ["doc_id"])
    spans = F.array_join(F.transform("sources", lambda s: F.concat_ws("-", s["start_char"].cast("string"), s["end_char"].cast("string"))), ",")
    first, noted = F.get("captions", F.lit(0)), F.col("row_no").isNull()
    of_first = F.concat_ws("-", first["start_char"].cast("string"), first["end_char"].cast("string"))
    return told.select(
        "doc_id", F.coalesce("row_no", F.lit(-1)).alias("row_no"), F.coalesce("col", F.lit(0)).alias("col"), F.coalesce("header", F.lit(True)).alias("header"),
        F.when(noted, F.array_join(F.col("captions.text"), " ")).otherwise(F.col("text")).alias("text"), F.when(noted, of_first).otherwise(spans).alias("sources"),
    )
