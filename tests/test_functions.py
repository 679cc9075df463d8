import pytest
from pyspark.sql import functions as F

from lodestone.functions import spans, vectors
from lodestone.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("삼성전자", "삼성 성전 전자"), ("칩 설계", "칩 설계"), ("HBM 매출 300,870,903원 (58.1%)", "hbm 매출 300,870,903 원 58.1")])
def test_korean_tokens(spark, text, want):
    assert " ".join(one(spark, T.korean_tokens(F.col("t")), t=text)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("NVIDIA revenue in 2024", [2024]),
        ("2023년과 2024년 매출 비교", [2023, 2024]),
        ("AMD revenue last year", [2025]),
        ("올해 매출은 전년 대비 얼마나 늘었나", [2025, 2026]),
        ("revenue two years ago", [2024]),
        ("What are NVIDIA's main risks?", []),
        ("id 120245", []),
    ],
)
def test_question_years(spark, text, want):
    assert one(spark, T.question_years(F.col("t"), 2026), t=text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("FY2024 Item 7 of the 10-K, Q4 results.", []),
        ("As of December 28, 2024 and 2024.12.31, revenue was 1,641.", ["1,641"]),
        ("2024년 12월 31일 기준 매출은 25,785백만원, 1분기 제56기", ["25,785"]),
        ("영업이익률 14.5%", ["14.5"]),
    ],
)
def test_figures(spark, text, want):
    assert one(spark, T.figures(F.col("t")), t=text) == want


def test_language_redaction_and_headers(spark):
    assert one(spark, T.language(F.col("t")), t="abc 가") == "ko" and one(spark, T.language(F.col("t")), t="abc") == "en"
    assert one(spark, T.redact(F.col("t")), t="api_key=abc, Bearer xyz.1 sk-abcdefghij") == "api_key=[REDACTED], Bearer [REDACTED] [REDACTED]"
    assert one(spark, T.normalize_query(F.col("t")), t="r & D costs") == "research development costs"
    assert one(spark, T.index_text(F.col("h"), F.col("b")), h="", b="x") == "x" and one(spark, T.index_text(F.col("h"), F.col("b")), h="h", b="x") == "h\n\nx"
    assert float(one(spark, T.magnitude(F.col("t")), t="(1,641.5)")) == 1641.5 and one(spark, T.magnitude(F.col("t")), t="-") is None


@pytest.mark.parametrize("cells,want", [([(0, 100), (200, 300)], 0), ([(100, 130), (110, 140)], 40), ([(0, 150), (140, 400)], 100)])
def test_union_coverage(spark, cells, want):
    df = spark.createDataFrame([(cells,)], "c array<struct<s:long,e:long>>")
    assert df.select(spans.covered(F.col("c"), F.lit(100), F.lit(200)).alias("x")).first().x == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(0.96), None]
    assert [r.x for r in df.select(vectors.valid(F.col("a"), 2).alias("x")).collect()] == [True, False]


def test_tokens_of_any_script(spark):
    assert one(spark, T.tokens(F.col("t")), t="Données für Straße, 12 ЦЕНА café-x") == ["données", "für", "straße", "12", "цена", "café", "x"]
