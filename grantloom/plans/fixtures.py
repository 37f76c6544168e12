"""Literal cases of rules of tables and prose, which the tests run; the SQL states the expected rows. messy.py has the same rules over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.operators import sections, tables
from grantloom.plans import pipeline

_TABLES = "proposal string, page_idx int, table_idx int, rows array<array<string>>"
_PAGES = "proposal string, page_idx int, text string"

WP_ONE = [["WP", "WP Title", "Leader", "PMs", "Start", "End"], ["WP1", "Project management", "AB", "64", "M1", "M36"], ["WP2", "Methods and tools", "CD", "13,5", "M07", "M48"]]
WP_TWO = [["WP", "Work package title", "Lead", "Lead", "Person", "Start", "End"], ["No", "", "No", "Short name", "Months", "month", "month"], ["1", "Project management", "1", "AB", "64", "M1", "M36"]]
WP_SWALLOWED = [["WP", "WP Title", "Leader", "PMs", "Start", "End"], ["1", "Innovation management", "AB", "10", "M1", "M12"], ["2", "Data tools", "CD", "20", "M1", "M24"]]
EFFORT_EXPLICIT = [["", "AB", "CD", "Total PM"], ["WP1", "24", "2", "26"], ["WP2", "4", "3,5", "7,5"]]
EFFORT_WHOLE = [["", "AB", "CD", "Total PM"], ["WP1", "24", "2", "26"], ["WP2", "4", "3", "7"], ["WP3", "5", "0", "5"]]
EFFORT_POSITIONAL = [["AB", "CD", "EF", "Total"], ["1", "2", "3", "6"], ["4", "5", "6", "15"]]
EFFORT_ROW = [["", "WP1", "WP2", "WP3", "Total"], ["10/CD", "1", "", "4", "5"]]
DELIVERABLES = [["D1.2 – D1.4", "Data plan", "Long text here about the plan", "WP1", "AB", "R", "SEN", "M06, M20"], ["D5.1", "Tool set", "Software for all of it", "WP5", "", "R", "PU", "M12"]]
DELIVERABLE_HEAD = [["No", "Deliverable name", "Type", "Due"], ["D1.1", "Plan", "R", "M6"], ["D1.2", "Tools", "R", "M9"]]
PROSE = [["x" * 401, "a"], ["b", "c"]]
MILESTONES = [["Milestone", "Due"], ["MS1", "M6"], ["MS2", "M9"]]
CONTINUED = [["3", "Third", "M1", "M18"], ["4", "Fourth", "M2", "M20"]]
UNSURE = [["alpha", "beta"], ["gamma", "delta"]]

HEADINGS = {
    "a": "T1.2 Data layer (AB, CD) Build it.",
    "b": "T2.1 Sensing (AB, CD | M3-M9) Deploy.",
    "c": "T3.1 Models [M2–M8] (EF; AB, CD) Train.",
    "d": "T4.1 Pilots [M5-M9, M20-M30] - Leader: GH - Task Partners: AB, CD - [PMs: 12] Run pilots.",
}

SECTION_PAGES = [
    "Contents Excellence Impact Implementation",
    "Work package description WP1 Management Objectives: lead the work. T1.1 Planning (AB, CD) plan it.",
    "T1.2 Reporting (AB) report it.",
    "WP2 Methods Objectives: find methods. T2.1 Search (CD | M3-M9) search. List of deliverables D1.1 Plan",
    "WP3 Other Objectives: none. T3.1 Never read (AB) no.",
]


def _tables(spark: SparkSession, *named: tuple[str, list[list[str]]]) -> DataFrame:
    return spark.createDataFrame([(name, 0, 0, rows) for name, rows in named], _TABLES)


def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _tables(spark, ("wp", WP_ONE), ("continued", CONTINUED), ("effort", EFFORT_WHOLE), ("decimal_effort", EFFORT_EXPLICIT), ("effort_row", [*EFFORT_ROW, ["11/AB", "2", "3", "4", "9"], ["12/EF", "2", "3", "4", "9"], ["13/GH", "2", "3", "4", "9"]]), ("deliverable", DELIVERABLE_HEAD), ("prose", PROSE), ("milestones", MILESTONES), ("unsure", UNSURE))
    return tables.classified(found).select("proposal", "label")


def wp_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_package_list(tables.joined_fragments(_tables(spark, ("one", WP_ONE), ("two", WP_TWO), ("swallowed", WP_SWALLOWED))))


def wp_list_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_package_list(tables.joined_fragments(_tables(spark, ("swallowed", WP_SWALLOWED))), strict=True).select("proposal", "wp_id", "title")


def wp_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fragment at page 2; one three pages on counts, one four pages on doesn't."""
    rows = [("p", page, 0, [["WP", "WP Title"], [f"WP{page}", "Title"]], "wp_list", "rules") for page in (2, 5, 6)]
    found = tables.picked(spark.createDataFrame(rows, _TABLES + ", label string, label_source string"))
    return found.select("proposal", "page_idx")


def effort_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _tables(spark, ("explicit", EFFORT_EXPLICIT), ("positional", EFFORT_POSITIONAL), ("row", EFFORT_ROW), ("nowhere", [["AB", "EF"], ["1", "2"]]))
    expected = spark.createDataFrame([("positional", "WP10"), ("positional", "WP2")], "proposal string, wp_id string")
    return tables.effort_matrix(found, "CD", expected)


def deliv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.deliverable_list(_tables(spark, ("p", DELIVERABLES))).unionByName(tables.deliverable_list(_tables(spark, ("strict", DELIVERABLES)), strict=True))
    return found.select("proposal", F.array_join("ids", " ").alias("ids"), "name", "description", "wp", "lead", "type", "dissemination", F.array_join("months", " ").alias("months"))


def heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame(list(HEADINGS.items()), "form string, chunk string")
    return sections.headings(found).select("form", "id", "title", "start_month", "end_month", "leader", F.array_join("names", ",").alias("names"), "body")


def chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "Intro. T3.1 Alpha (AB) does work with T2.4 (CD) output here. T3.2 Beta (AB) ends."
    found = spark.createDataFrame([("p", 0, "WP3", text)], "proposal string, section_idx int, wp_id string, section_text string")
    return sections.chunks(found).select("proposal", "wp_id", "chunk")


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p", k, text) for k, text in enumerate(SECTION_PAGES)], _PAGES)


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(_pages(spark)).select("proposal", F.col("section_idx").cast("long").alias("section_idx"), "wp_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), F.length("section_text").cast("long").alias("chars"))


def extracted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.tasks(sections.sections(_pages(spark))).select("proposal", "id", "wp_id", "title", "start_month", "end_month", F.array_join("partners", ",").alias("partners"), "description")


def whole_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and tables of one proposal, through all stages."""
    found = spark.createDataFrame([("p", 0, 0, WP_ONE), ("p", 1, 0, EFFORT_WHOLE), ("p", 2, 0, [["No", "Deliverable name", "Type", "Level", "Due"], ["D2.1", "Search tool", "R", "PU", "M08", "CD"], ["D2.2", "Other tool", "R", "PU", "M30", "CD"]])], _TABLES)
    nested = pipeline.run(_pages(spark), found, "CD", whole_document=True)
    shown = F.transform("tasks", lambda t: F.concat(t["id"], F.lit(":"), t["role"], F.lit(":"), F.coalesce(F.array_join(F.transform(t["deliverables"], lambda d: d["id"]), "+"), F.lit(""))))
    return nested.select("proposal", "wp_id", "title", "leader", "role", "person_months", "start", "end", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("tasks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (table_rules, wp_list_parse, wp_list_strict, wp_fragments, effort_layouts, deliv_parse, heading_forms, chunk_rules, section_texts, extracted_tasks, whole_pipeline)}


def _values(columns: str, *rows: tuple) -> str:
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v[0]} AS {v[1]})" if isinstance(v, tuple) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({columns})"


def oracle_sql() -> dict[str, str]:
    wp = 'proposal, wp_id, title, leader, pms, start, "end"'
    texts = [len(f"{SECTION_PAGES[1][SECTION_PAGES[1].index('WP1') :]}\n{SECTION_PAGES[2]}"), len(SECTION_PAGES[3][: SECTION_PAGES[3].index("List of")].strip())]
    return {
        "table_rules": _values("proposal, label", ("wp", "wp_list"), ("continued", "wp_list"), ("effort", "effort"), ("decimal_effort", None), ("effort_row", "effort"), ("deliverable", "deliverable"), ("prose", "other"), ("milestones", "other"), ("unsure", None)),
        "wp_list_parse": _values(wp, ("one", "WP1", "Project management", "AB", 64.0, "M01", "M36"), ("one", "WP2", "Methods and tools", "CD", 13.5, "M07", "M48"), ("two", "WP1", "Project management", "AB", 64.0, "M01", "M36"), ("swallowed", "WP2", "Data tools", "CD", 20.0, "M01", "M24")),
        "wp_list_strict": _values("proposal, wp_id, title", ("swallowed", "WP1", "Innovation management"), ("swallowed", "WP2", "Data tools")),
        "wp_fragments": _values("proposal, page_idx", ("p", (2, "INTEGER")), ("p", (5, "INTEGER"))),
        "effort_layouts": _values("proposal, company, wp_id, person_months", ("explicit", "CD", "WP1", 2.0), ("explicit", "CD", "WP2", 3.5), ("positional", "CD", "WP2", 2.0), ("positional", "CD", "WP10", 5.0), ("row", "CD", "WP1", 1.0), ("row", "CD", "WP2", 1.0), ("row", "CD", "WP3", 4.0)),
        "deliv_parse": _values("proposal, ids, name, description, wp, lead, type, dissemination, months", ("p", "D1.2 D1.3 D1.4", "Data plan", "Long text here about the plan", "WP1", "AB", "R", "RE", "M06 M20"), ("strict", "D1.2 D1.3 D1.4", "Data plan", "Long text here about the plan", "WP1", "AB", "R", "SEN", "M06 M20")),
        "heading_forms": _values("form, id, title, start_month, end_month, leader, names, body", ("a", "T1.2", "Data layer", "", "", "", "AB,CD", "Build it."), ("b", "T2.1", "Sensing", "M03", "M09", "", "AB,CD", "Deploy."), ("c", "T3.1", "Models", "M02", "M08", "EF", "AB,CD", "Train."), ("d", "T4.1", "Pilots", "M05", "M30", "GH", "AB,CD", "Run pilots.")),
        "chunk_rules": _values("proposal, wp_id, chunk", ("p", "WP3", "T3.1 Alpha (AB) does work with"), ("p", "WP3", "T3.2 Beta (AB) ends.")),
        "section_texts": _values("proposal, section_idx, wp_id, pages, chars", ("p", (0, "BIGINT"), "WP1", "1,2", (texts[0], "BIGINT")), ("p", (1, "BIGINT"), "WP2", "3", (texts[1], "BIGINT"))),
        "whole_pipeline": _values('proposal, wp_id, title, leader, role, person_months, start, "end", tasks', ("p", "WP1", "Project management", "AB", "participant", 2.0, "M01", "M36", "T1.1:participant:"), ("p", "WP2", "Methods and tools", "CD", "leader", 3.0, "M07", "M48", "T2.1:leader:D2.1")),
        "extracted_tasks": _values("proposal, id, wp_id, title, start_month, end_month, partners, description", ("p", "T1.1", "WP1", "Planning", "", "", "AB,CD", "plan it."), ("p", "T1.2", "WP1", "Reporting", "", "", "AB", "report it."), ("p", "T2.1", "WP2", "Search", "M03", "M09", "CD", "search.")),
    }
