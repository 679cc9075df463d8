import pytest

from lodestone.operators import figures

CELLS = [(1, 1, 1, 2, "$ 25,785"), (1, 1, 2, 3, "$ 22,680"), (1, 2, 1, 2, "1,641"), (1, 2, 2, 3, "(33)"), (2, 1, 1, 2, "7"), (3, 1, 1, 2, "8")]


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.createDataFrame(CELLS, "table_id int, row int, start_col int, end_col int, value string")
    headers = spark.createDataFrame([(1, 1, 2, "December 28, 2024"), (1, 2, 3, "December 30, 2023"), (3, 0, 1, "2022")], "table_id int, h_start int, h_end int, h_text string")
    captions = spark.createDataFrame([(1, "years 2023 and 2024"), (2, "fiscal 2021"), (3, "2020 and 2021")], "table_id int, caption string")
    return figures.column_years(df, headers, captions)


def test_column_years(cells):
    got = {(r.table_id, r.row, r.start_col): r.years for r in cells.collect()}
    assert got == {(1, 1, 1): [2024], (1, 1, 2): [2023], (1, 2, 1): [2024], (1, 2, 2): [2023], (2, 1, 1): [2021], (3, 1, 1): []}


@pytest.mark.parametrize(
    "answer,requested,verdict,found",
    [
        ("2024 revenue was $25,785 million.", [2024], "verified", [2024]),
        ("2024 revenue was $22,680 million.", [2024], "period_mismatch", [2023]),
        ("2024 revenue was $26,000 million.", [2024], "unverified", []),
        ("Revenue was $22,680 million.", [], "verified", [2023]),
        ("The 2023 net loss was 33 million.", [2023], "verified", [2023]),
        ("Revenue grew 14%.", [2024], "unverified", []),
        ("Revenue grew 14%.", [], "verified", []),
        ("No figures here.", [2024], "verified", None),
    ],
)
def test_verdicts(spark, cells, answer, requested, verdict, found):
    answers = spark.createDataFrame([(1, answer, requested)], "answer_id int, answer string, requested array<int>")
    prose = spark.createDataFrame([(1, "14", [])], "answer_id int, value string, years array<int>")
    evidence = cells.where("table_id = 1").selectExpr("1 AS answer_id", "value", "years").union(prose)
    assert figures.answer_verdicts(answers, evidence).first().verdict == verdict
    told = [r.found_years for r in figures.check_figures(answers, evidence).collect()]
    assert told == ([found] if found is not None else [])
