import datetime
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantloom.functions import scalars as S


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double", datetime.date: "date", list: "array<string>"}
    schema = ", ".join(f"{k} {types[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("a   b\n\tc", "a b c"), (None, ""), ("  hello  ", "hello")])
def test_clean(spark, text, want):
    assert one(spark, S.clean(F.col("x")), x=text) == want


def test_nfkc(spark):
    rows = spark.createDataFrame([(1, "ﬁ①Ａ\u00a0 bé e\u0301", [["ﬁ", None], None, []]), (2, "plain", None), (3, None, [["a"]])], "k int, x string, t array<array<string>>")
    got = {r["k"]: tuple(r)[1:] for r in rows.select("k", S.clean(S.compatible(F.col("x"))), S.compatible_rows(F.col("t"))).collect()}
    assert got == {1: ("fi1A bé é", [["fi", None], None, []]), 2: ("plain", None), 3: ("", [["a"]])}


@pytest.mark.parametrize(("text", "want"), [("intra", "INTRA"), (None, "")])
def test_norm_cell(spark, text, want):
    assert one(spark, S.norm_cell(F.col("x")), x=text) == want


@pytest.mark.parametrize(("names", "company", "want"), [(["UCD", "intra"], "INTRA", True), (["All Partners"], "XYZ", True), (["UCD", "NTU"], "INTRA", False), ([], "A", False)])
def test_partner_match(spark, names, company, want):
    assert one(spark, S.partner_match(F.col("x"), F.lit(company)), x=names) is want


@pytest.mark.parametrize(("token", "want"), [("M01", 1), ("M1", 1), ("M12", 12), ("1", 1), ("", 0), ("none", 0)])
def test_month_number(spark, token, want):
    assert one(spark, S.month_number(F.col("x")), x=token) == want


@pytest.mark.parametrize(("token", "want"), [("M1", "M01"), ("M01", "M01"), ("1", "M01"), ("12", "M12"), ("Μ5", "M05"), ("abc", ""), ("123", "M123")])
def test_month_token(spark, token, want):
    assert one(spark, S.month_token(F.col("x")), x=token) == want


@pytest.mark.parametrize(("cell", "want"), [("D5.1, D5.3", ["D5.1", "D5.3"]), ("D1.6 - D1.2", ["D1.6", "D1.2"]), ("D1.1 - D2.3", ["D1.1", "D2.3"]), ("D1.2 – D1.4", ["D1.2", "D1.3", "D1.4"])])
def test_deliverable_ids(spark, cell, want):
    assert one(spark, S.deliverable_ids(F.col("x")), x=cell) == want


@pytest.mark.parametrize(("start", "token", "first", "last"), [("2025-01-01", "M05", "2025-05-01", "2025-05-31"), ("2025-01-31", "M02", "2025-02-28", "2025-03-27"), ("2025-01-01", "", None, None)])
def test_month_dates(spark, start, token, first, last):
    day = datetime.date.fromisoformat(start)
    want = [None if x is None else x + "T17:00:00Z" for x in (first, last)]
    assert [one(spark, S.planner_date(F.col("d"), F.col("t"), end), d=day, t=token) for end in (False, True)] == want


@pytest.mark.parametrize(("text", "want"), [("My Plan: 2nd!", "my-plan-2nd"), ("", "proposal")])
def test_slug(spark, text, want):
    assert one(spark, S.slug(F.col("x")), x=text) == want


def test_parsed_tasks(spark):
    whole = '{"id":"T1.1","wp_id":"WP1","title":"","start_month":"","end_month":"","partners":["A"],"description":""}'
    answer = f'```json\n[{whole}, {{"id":"T1.2"}}]\n```'
    found = one(spark, S.parsed_tasks(F.col("x")), x=answer)
    assert [(t["id"], t["partners"]) for t in found] == [("T1.1", ["A"])]
    assert one(spark, S.parsed_tasks(F.col("x")), x="no json") == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="ascii"), max_size=12), min_size=1, max_size=30))
def test_month_functions_against_python(spark, texts):
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", S.to_float(F.col("x")).alias("f"), S.month_number(F.col("x")).alias("n")).orderBy("k").collect()
    for r, x in zip(got, texts, strict=True):
        m = re.search(r"[0-9]+(?:\.[0-9]+)?", x.replace(",", "."))
        n = re.search(r"[0-9]+", x)
        assert r["f"] == (float(m[0]) if m else 0.0)
        assert r["n"] == (int(n[0]) if n and int(n[0]) < 2**31 else 0)
