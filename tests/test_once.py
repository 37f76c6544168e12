"""What a query computes of each row, it computes once: no filter writes out the expressions of a row's fields anew."""

import unicodedata

from conftest import SF
from pyspark.sql import functions as F

from grantloom.functions import scalars as S
from grantloom.operators import tables
from grantloom.plans import queries as plans


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filters(df):
    return [line for line in plan(df).splitlines() if "Filter " in line.split("#")[0]]


def python_steps(df):
    return plan(df).count("ArrowEvalPython")


def test_deliverables_are_read_once_for_both_readings(spark):
    found = plans.queries()["deliv_parse"](spark, SF)
    assert python_steps(found) == 1 and "Union" not in plan(found)
    assert not any("RLIKE" in x or "regexp" in x for x in filters(found))


def test_rows_of_work_package_lists_are_read_once(spark):
    for name in ("wp_list_parse", "wp_list_strict"):
        found = plans.queries()[name](spark, SF)
        assert not any("regexp_replace" in x or "regexp_extract" in x for x in filters(found)), name
    assert python_steps(plans.queries()["wp_list_parse"](spark, SF)) == 1


def test_only_keeps_rows_of_which_the_condition_is_true(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "a long, b boolean")
    assert [tuple(r) for r in S.only(rows, F.col("b")).collect()] == [(1, True)]


def test_text_that_stays_in_the_jvm_is_in_its_compatibility_form(spark):
    texts = [a + b for a in map(chr, (*range(32, 127), *range(0x80, 0x250), *range(0x2000, 0x2030))) for b in ("", "́")]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", S.compatible(F.col("text")).alias("form")).collect()
    assert all(r.form == unicodedata.normalize("NFKC", r.text) for r in rows)


def test_month_tokens_of_a_row(spark):
    cells = ["", "M3", "12", "Μ 100", "m07 ", "x5", "M99999999999", "-1"]
    rows = spark.createDataFrame([(cells,)], "row array<string>").select(S.month_tokens(F.transform("row", S.clean)).alias("tokens"))
    assert rows.first().tokens == ["M03", "M12", "M100", "M07"]


def test_texts_of_sections_are_read_once(spark):
    for name in ("sections_found", "tasks_from_prose"):
        found = plans.queries()[name](spark, SF)
        assert python_steps(found) == 1, name
        assert not any("regexp_replace" in x for x in filters(found)), name


def test_pages_need_one_look_at_the_orders(spark):
    assert plan(plans.queries()["tasks_from_prose"](spark, SF)).count("Join Inner") == 1


def test_headings_are_read_once(spark):
    found = plans.queries()["heading_forms"](spark, SF)
    assert not any("regexp" in x for x in filters(found))


_RAW = [("p", 0, 0, [["WP", "WP Title", "Leader", "PMs", "Start", "End"], ["WP1", "Plan", "AB", "2", "M1", "M3"], ["WP2", "Tool", "CD", "3", "M1", "M3"]])]
_SCHEMA = "proposal string, page_idx int, table_idx int, rows array<array<string>>"


def test_labels_are_made_once(spark):
    raw = spark.createDataFrame(_RAW, _SCHEMA)
    ruled = tables.classified(tables.worth_classifying(raw)).withColumn("label_source", F.lit("rules"))
    found = tables.picked(ruled)
    assert [r.label for r in found.collect()] == ["wp_list"]
    assert not any("RLIKE" in x or "regexp" in x for x in filters(found))


def test_no_rule_goes_through_the_cells_of_a_table(spark):
    for name in ("table_rules", "tables_classified"):
        found = plan(plans.queries()[name](spark, SF)).split("Aggregate")[0]
        assert found.count("RLIKE(lambda") <= 1 and "array_sort" not in plan(plans.queries()[name](spark, SF)), name  # the header's acronyms


def test_tables_beyond_ascii_or_with_untidy_cells_are_cleaned(spark):
    odd = [[" a", "b  c", None, "d\te"], None, [], ["ﬁ", "x　y"]]
    tidy = [["a b", ""], ["é", "a|b"]]
    rows = spark.createDataFrame([(1, odd), (2, tidy), (3, None), (4, [["a"], ["b", None]]), (5, [["①", "a | b"]]), (6, [["\u0085"]])], "k int, rows array<array<string>>")
    got = {r.k: r.rows for r in tables.cleaned(rows).collect()}
    assert got == {1: [["a", "b c", "", "d e"], ["fi", "x y"]], 2: tidy, 3: [], 4: [["a"], ["b", ""]], 5: [["1", "a | b"]], 6: [[""]]}
    assert python_steps(tables.cleaned(rows)) == 1


def test_a_rule_stays_within_a_cell(spark):
    head = ["", "AB", "CD", "Total PM"]
    cells = {1: [head, ["WP", "1", "2", "3"], ["x", "4", "5"]], 2: [head, ["1 2", "3", "x"], ["y", "2", "3"], ["z", "2", "3"]], 3: [["D", "1.1", "PU", "M3"], ["D", "1.2", "PU"]], 4: [["x" * 400, "y"]], 5: [["x" * 401]], 6: [["aMS1", "MS"]], 7: [["1", "M1", "M2"], ["WP 2", "M1 M2"]], 8: [["D1.1", "PU"], ["D1.2 and more", "SEN"]]}
    found = tables.classified(spark.createDataFrame([(k, 0, 0, v) for k, v in cells.items()], "proposal int, page_idx int, table_idx int, rows array<array<string>>"))
    assert {r.proposal: r.label for r in found.collect()} == {1: None, 2: "effort", 3: None, 4: None, 5: "other", 6: None, 7: "wp_list", 8: None}


def test_tokens_and_numbers_of_a_row_are_made_where_its_columns_lack_them(spark):
    found = plan(tables.work_package_list(spark.createDataFrame(_RAW, _SCHEMA)))
    assert "THEN regexp_extract_all" in found and "lambdafunction(RLIKE(lambda c" not in found
    rows = [["WP", "WP Title", "Leader", "PMs", "Start", "End"], ["3", "Long title", "AB", "x", "", "", "7", "2,5", "M4", "M12"], ["WP 4", "Other", "AB", "6", "M1", "M2"], ["x", "y"]]
    got = tables.work_package_list(spark.createDataFrame([("p", 0, 0, rows)], _SCHEMA)).orderBy("wp_id").collect()
    assert [(r.wp_id, r.pms, r.start, r.end) for r in got] == [("WP3", 2.5, "M04", "M12"), ("WP4", 6.0, "M01", "M02")]


def test_rows_of_deliverables_are_sorted_natively(spark):
    found = plan(plans.queries()["deliverable_rows"](spark, SF))
    assert "sort_array" in found and "array_sort" not in found and python_steps(plans.queries()["deliverable_rows"](spark, SF)) == 1
