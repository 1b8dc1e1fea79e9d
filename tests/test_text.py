"""Amounts, dates, references."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.fuzzy import common_length, most, partial_ratio

AMOUNTS = ["7,35,120.45", "8640", "9,018.07", "+64.5", "-3,771.30", "18.20 DR", "6,405.90 cr", "USD 77.15", "₹4,450", "€ 12.99", "Rs 640.005", "7", "33"]
NO_AMOUNTS = ["IMPS", "Cheque-deposit", "17-11-2025", "Particulars", "", "\t ", "12 apples", "five", "1.2.3", "Q R S"]
DATES = ["17-11-2025", "2023/02/28", "30/12/19", "7 Oct 2022", "Sep 30, 2021", "15 August", "08Feb", "9 Nov", "45/67/8901"]
NO_DATES = ["IMPS", "318.75", "Particulars", "", "20251117", "17-Nov-2025", "noon"]


def each(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["r"] for r in df.select("i", make(F.col("t")).alias("r")).orderBy("i").collect()]


def test_is_amount(spark):
    assert each(spark, AMOUNTS, X.is_amount) == [True] * len(AMOUNTS)
    assert each(spark, NO_AMOUNTS, X.is_amount) == [False] * len(NO_AMOUNTS)


def test_is_date(spark):
    assert each(spark, DATES, X.is_date) == [True] * len(DATES)
    assert each(spark, NO_DATES, X.is_date) == [False] * len(NO_DATES)


@pytest.mark.parametrize(
    ("text", "value", "sign"),
    [("318.75", 318.75, "unknown"), ("6405.90 CR", 6405.9, "credit"), ("18.20 DR", 18.2, "debit"), ("-3771.30", 3771.3, "debit"), ("7,35,120.45", 735120.45, "unknown"), ("64.00CR", 64.0, "unknown"), ("Rs. 640", 0.64, "unknown")],
)
def test_parse_amount(spark, text, value, sign):
    assert each(spark, [text], X.parse_amount) == [(value, sign)]


def test_parse_amount_without_value(spark):
    assert each(spark, ["IMPS-REFUND", "Rs.6,405.90", None], X.parse_amount) == [None] * 3
    assert each(spark, ["9,018.07", "IMPS"], X.clean_amount) == [9018.07, None]


def test_extract(spark):
    assert each(spark, ["Booked 17/11/2025, by card", "nothing dated", "20251117"], X.extract_date) == ["17/11/2025", None, "20251117"]
    assert each(spark, ["see IMPS202511170042317", "none"], X.extract_reference) == ["IMPS202511170042317", None]
    # groups of two digits are tried first, so 9,018.07 falls apart
    assert each(spark, ["cost 318.75 plus 4 at 0.002", "9,018.07", "none"], X.extract_amounts) == [[318.75, 4.0], [901.0, 8.07], []]


def test_dates_in_all_places(spark):
    """What each pattern finds, by Python's own regular expressions, over texts with and without digits."""
    import re

    texts = [f"{a}{d}{b}" for d in [*DATES, *NO_DATES, "x", "20251117"] for a, b in (("", ""), ("on ", " paid"), ("n", ""), ("(", ")"))]
    found = [next((m[0].strip() for p in X.DATES if (m := re.search(p, t))), None) for t in texts]
    assert each(spark, texts, X.extract_date) == found


def test_noise(spark):
    texts = ["", "Date", "Summary of account", "Description of Date", "12345678", "https://x", "rent 500"]
    assert each(spark, texts, lambda t: X.is_noise(t, F.lit(False))) == [True] * 6 + [False]


def test_partial_ratio():
    assert common_length("debit", "credit") == 3
    assert partial_ratio("debit", "credit") == 75.0
    assert partial_ratio("description", "cr") == 100.0
    assert round(partial_ratio("txn date", "reference"), 1) < 75
    assert partial_ratio("", "a") == 0.0


def test_bound_of_partial_ratio():
    """A keyword that the bound rules out could never reach the score that it was ruled out for."""
    texts = ("date", "txn date", "narration", "balance cr", "aab", "baa", "x", "", "withdrawal amt dr", "saldo")
    for a in texts:
        for b in texts:
            if a and b:
                assert partial_ratio(a, b) <= most(a, b) + 1e-9
    assert most("abc", "xyz") == 0.0 and most("date", "date") == 100.0
