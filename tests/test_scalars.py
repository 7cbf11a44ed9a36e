"""Constant tables of the scalar parsers and claim filters."""

import pytest
from pyspark.sql import functions as F

from veriloom.functions import scalars, text
from veriloom.operators import quality


def run(spark, f, given):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    return [r.out for r in rows.select("i", f(F.col("g")).alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "52.35 million": 52_350_000.0, "Rs 1.5 crore": 15_000_000.0, "2 lakh": 200_000.0, "3 billion": 3e9, "1,234.5": 1234.5, "(12)": -12.0, "-7.5": -7.5,
        "5000": 500.0, "in FY24 it was 200 crore": 24e7, "3 crores": 3.0, "none": None, "": None, None: None,
    }
    assert run(spark, scalars.numeric, list(cases)) == list(cases.values())


def test_times(spark):
    cases = {
        "9 AM": "09:00", "9:30 PM": "21:30", "14:30": "14:30", "09:15:00": "09:15", "9 AM to 5 PM": "09:00-17:00", "10:00 - 11:30": "10:00-11:30", "12 AM": "00:00", "12 PM": "12:00",
        "noon": "noon", "Founded in 1998 at 3:30 PM": "19:00", "": None, None: None,
    }
    assert run(spark, scalars.time, list(cases)) == list(cases.values())


def test_dates(spark):
    cases = {
        "2012-03-14": "2012-03-14", "14 March 2012": "2012-03-14", "March 14, 2012": "2012-03-14", "14/03/2012": "2012-03-14", "2012/3/4": "2012-03-04", "Mar 14 2012": "2012-03-14",
        "14th Mar 2012": "2012-03-14", "03/14/2012": "03/14/2012", "2024-02-31": "2024-02-31", "FY2024": "FY2024", "": None, None: None,
    }
    assert run(spark, scalars.date, list(cases)) == list(cases.values())


def test_booleans(spark):
    cases = {"yes": True, "No": False, " TRUE ": True, "absent": False, "1": True, "maybe": None, None: None}
    assert run(spark, scalars.boolean, list(cases)) == list(cases.values())


def test_fact_types(spark):
    assert run(spark, scalars.fact_type, [" Numeric ", "DATE", "thing", None]) == ["numeric", "date", "semantic", "semantic"]


def test_plain_numbers(spark):
    assert run(spark, scalars.plain_number, ["-1,200.5", "2012-03-14", "Rs. 5", "1.2.3", "none", None]) == [1200.5, 20120314.0, 0.5, None, None, None]


@pytest.mark.parametrize(
    ("claim", "reason"),
    [
        ("[Insert name here]", "placeholder"), ("The value is TBD", "placeholder"), ("password: hunter2secret", "credential"), ("Page 1 of 4", "document_meta"), ("Section 4", "label"), ("Table II", "label"),
        ("Reg No: 12-3456789", "reference"), ("ab", "short"), ("it was of the", "no_content_word"), ("U74999 MH", "identifier"), ("1,234 / 567", "no_content_word"), (None, "short"), ("", "short"),
        ("Revenue grew to 5 crore", None), ("The company opened 14 offices", None),
    ],
)
def test_reject_reason(spark, claim, reason):
    assert run(spark, quality.reject_reason, [claim]) == [reason]


def test_support(spark):
    rows = spark.createDataFrame([("Revenue grew strongly", "revenue grew by a lot"), ("Total 42", "42"), ("Total 43", "42"), (None, "x"), ("x", None)], "c string, q string")
    assert [r.s for r in rows.select(quality.supported(F.col("c"), F.col("q")).alias("s")).collect()] == [True, True, False, False, False]


def test_text(spark):
    assert run(spark, text.normalize, ["  A  b\n", None]) == ["a b", ""]
    assert run(spark, text.clean_claim, [" It is so. . ", None]) == ["It is so", ""]
    assert run(spark, text.capitalize, ["aBC"]) == ["Abc"]
    assert run(spark, scalars.longest_number_literal, ["7 and $1,200.50 and 9,999", "none", None]) == ["$1,200.50", None, None]
