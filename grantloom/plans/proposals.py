"""Raw tables and pages made of the whole star schema, so that the parsers of tables and prose run at any scale factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.operators import sections, tables
from grantloom.plans import projection as P

HEADERS = {
    0: ["WP", "WP Title", "Leader", "PMs", "Start", "End"],
    1: ["Del. No", "Deliverable name", "Description", "Lead", "Type", "Diss", "Due"],
    2: ["Milestone", "Name", "Due"],
    3: ["Remark", "Note", "Text"],
}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, of the kind that its key modulo 4 gives: work packages, deliverables, milestones, or none of these."""
    part, m1 = F.col("l_partkey"), _text("M", F.col("m1"))
    lead = _text("X", F.translate(F.col("l_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"))
    cells = {
        0: F.array(_text("WP", F.col("n")), _text("Part ", part), _text("S", F.col("l_suppkey")), F.floor("l_quantity").cast("string"), m1, _text("M", F.col("m2"))),
        1: F.array(_text("D", F.col("k"), ".", F.col("n")), _text("Deliverable part ", part), _text("Long text about part ", part), lead, F.lit("R"), F.lit("PU"), m1),
        2: F.array(_text("MS", F.col("n")), _text("Part ", part), m1),
        3: F.array(_text("Part ", part), _text("Returned ", F.col("l_returnflag")), F.lit("plain")),
    }
    choice = lambda by: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in by.items()])
    line = P.lines(spark, sf_dir).withColumn("kind", (F.col("o_orderkey") % 4).cast("int"))
    rows = line.select("o_orderkey", "kind", F.struct("n", choice(cells).alias("row")).alias("x"))
    body = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"])  # an order's line items
    header = choice({k: F.array(*map(F.lit, h)) for k, h in HEADERS.items()})
    grouped = rows.groupBy("o_orderkey", "kind").agg(body.alias("body"))
    return grouped.select(F.col("o_orderkey").alias("proposal"), F.lit(0).alias("page_idx"), F.lit(0).alias("table_idx"), F.concat(F.array(header), "body").alias("rows"), "kind")


def effort_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix for each customer: a row per order, with what its line items number, sum up to and are worth at most."""
    by = P.lines(spark, sf_dir).groupBy("proposal", "k").agg(F.count("*").alias("a"), F.floor(F.sum("l_quantity")).alias("b"), F.floor(F.max("l_quantity")).alias("c"))
    row = F.struct("k", F.array(_text("WP", F.col("k")), *[F.col(x).cast("string") for x in "abc"], (F.col("a") + F.col("b") + F.col("c")).cast("string")).alias("row"))
    body = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["row"])  # a customer's orders
    return by.groupBy("proposal").agg(body.alias("body")).select("proposal", F.lit(0).alias("page_idx"), F.lit(0).alias("table_idx"), F.concat(F.array(F.array(*map(F.lit, ["", "AB", "CD", "EF", "Total"]))), "body").alias("rows"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: a work package's heading, and a task for each line item."""
    task = P.tasks(spark, sf_dir, more=("o_orderkey", "wp_title"))
    number = lambda c: F.ltrim(F.substring(c, 2, 9), F.lit("0"))
    told = _text(F.col("id"), " ", F.col("title"), " (", F.array_join("partners", ", "), " | M", number(F.col("start_month")), "-M", number(F.col("end_month")), ") ", F.col("description"), ".")
    each = task.groupBy("o_orderkey", "proposal", "k", "wp_title").agg(F.sort_array(F.collect_list(F.struct("n", told.alias("text")))).alias("x"))
    text = _text(F.when(F.col("k") == F.min("k").over(W.partitionBy("proposal")), "Work package description ").otherwise(""), "WP", F.col("k"), " Priority ", F.col("wp_title"), " Objectives: to deliver. ", F.array_join(F.transform("x", lambda x: x["text"]), " "))
    return each.select("proposal", (F.col("k") - 1).cast("int").alias("page_idx"), text.alias("text"))


def tables_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.classified(tables.worth_classifying(raw_tables(spark, sf_dir))).select("proposal", "label")


def wp_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_package_list(raw_tables(spark, sf_dir).filter("kind = 0"))


def deliverable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.deliverable_list(raw_tables(spark, sf_dir).filter("kind = 1"))
    return found.select("proposal", F.col("row_ord").cast("long").alias("n"), F.array_join("ids", " ").alias("ids"), "name", "description", "wp", "lead", "type", "dissemination", F.array_join("months", " ").alias("months"))


def effort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.effort_matrix(effort_tables(spark, sf_dir), "CD")


def sections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(pages(spark, sf_dir)).select("proposal", F.col("section_idx").cast("long").alias("section_idx"), "wp_id", "wp_title")


def tasks_from_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.tasks(sections.sections(pages(spark, sf_dir)))
    return found.select("proposal", "id", "wp_id", "title", "start_month", "end_month", F.array_join("partners", ",").alias("partners"), "description")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (tables_classified, wp_list_rows, deliverable_rows, effort_rows, sections_found, tasks_from_prose)}


_WITH = f"WITH {P.PROJECTION_SQL}"
_TOKEN = "'M' || CASE WHEN {0} < 10 THEN '0' ELSE '' END || {0}"
ORACLES: dict[str, str] = {
    "tables_classified": f"""{_WITH} SELECT o_orderkey AS proposal, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN count(*) >= 2 THEN 'wp_list' END WHEN 1 THEN 'deliverable' WHEN 2 THEN 'other' END AS label FROM line GROUP BY o_orderkey""",
    "wp_list_rows": f"""{_WITH} SELECT o_orderkey AS proposal, 'WP' || n AS wp_id, 'Part ' || l_partkey AS title, own AS leader, floor(l_quantity) AS pms, {_TOKEN.format("m1")} AS start, {_TOKEN.format("m2")} AS "end" FROM line WHERE o_orderkey % 4 = 0""",
    "deliverable_rows": f"""{_WITH} SELECT o_orderkey AS proposal, n, 'D' || k || '.' || n AS ids, 'Deliverable part ' || l_partkey AS name, 'Long text about part ' || l_partkey AS description, 'WP' || k AS wp,
        'X' || translate(substr(own, 2), '0123456789', 'ABCDEFGHIJ') AS lead, 'R' AS type, 'PU' AS dissemination, 'M' || m1 AS months FROM line WHERE o_orderkey % 4 = 1""",
    "effort_rows": f"""{_WITH} SELECT proposal, 'CD' AS company, wp_id, floor(sum(l_quantity)) AS person_months FROM line GROUP BY proposal, wp_id""",
    "sections_found": f"""{_WITH} SELECT proposal, row_number() OVER (PARTITION BY proposal ORDER BY k) - 1 AS section_idx, 'WP' || k AS wp_id, 'Priority ' || title AS wp_title FROM wp WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "tasks_from_prose": f"""{_WITH} SELECT proposal, id, wp_id, title, start_month, end_month, array_to_string(partners, ',') AS partners, description || '.' AS description FROM task""",
}
