"""Untidy tables and pages made of the whole star schema: headers in two rows, rows that pass for headers, missing and
shifted cells, matrices in both directions, ranges of ids, headings of all forms, contents pages and passages that stop the reader.

An order or a customer is a proposal; what is wrong with its table follows from its key, so that SQL can state the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.operators import sections, tables
from grantloom.plans import pipeline
from grantloom.plans import projection as P
from grantloom.plans.proposals import _text
from grantloom.sources import files

WP_HEADER = ["WP", "WP Title", "Leader", "PMs", "Start", "End"]
WP_HEADER_TWO = [["WP", "Work package title", "Lead", "Lead", "Person", "Start", "End"], ["No", "", "No", "Short name", "Months", "month", "month"]]
EFFORT_HEADER = ["", "AB", "CD", "Total PM"]
#: The work package whose page stops the reader.
LAST = 4


def _row(*cells: Column | str | int) -> Column:
    return F.array(*[(F.lit(c) if isinstance(c, str | int) else c).cast("string") for c in cells])


def _rows(lists: list[list[str]]) -> Column:
    return F.array(*[_row(*x) for x in lists])


def _choice(of: Column, by: dict[int, Column]) -> Column:
    return F.coalesce(*[F.when(of == k, v) for k, v in by.items()])


def _gathered(rows: DataFrame, keys: list[str], order: str, head: Column, several: bool = False) -> DataFrame:
    """A table for each key: its head and its rows in order; an order's or a customer's own rows bound it. several: row is
    an array of rows."""
    body = F.transform(F.sort_array(F.collect_list(F.struct(order, "row"))), lambda x: x["row"])
    body = F.flatten(body) if several else body
    grouped = rows.groupBy(*keys).agg(body.alias("body"))
    return grouped.select(F.col(keys[0]).alias("proposal"), F.lit(0).alias("page_idx"), F.lit(0).alias("table_idx"), F.concat(head, "body").alias("rows"), *keys[1:])


def _half(x: Column) -> Column:
    return _text(F.floor(x), ",5")


# ---------------------------------------------------------------- tables


def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, three rows for a line item, of nine kinds."""
    kind = (F.col("o_orderkey") % 9).cast("int")
    line = P.lines(spark, sf_dir).select("o_orderkey", "k", "l_partkey", "n", kind.alias("kind"))
    of = lambda i: {
        0: _row(_text("WP", i), _text("Part ", F.col("l_partkey")), "AB", i, "M1", "M36"), 1: _row(i % 90, "Third of them", "M1", "M18"), 2: _row(_text("WP", i), i, i + 1, 2 * i + 1),
        3: _row(_text("WP", i), _half(i), _half(i + 1), _half(2 * i)), 4: _row(_text(i, "/CD"), "1", "", i, "5"), 5: _row(_text("D", F.col("k"), ".", i), "Plan", "R", "M6"),
        6: _row(F.rpad(F.lit("x"), 401, "x"), i), 7: _row(_text("MS", i), "M6"), 8: _row("alpha", "beta"),
    }
    # Within transform() the kinds aren't written out into one method, which would be too long for the JVM to compile.
    row = F.transform(F.sequence(3 * F.col("n"), 3 * F.col("n") + 2), lambda i: _choice(F.col("kind"), of(i)))
    heads = {0: [WP_HEADER], 2: [EFFORT_HEADER], 3: [EFFORT_HEADER], 4: [["", "WP1", "WP2", "WP3", "Total"]], 5: [["No", "Deliverable name", "Type", "Due"]], 7: [["Milestone", "Due"]]}
    head = F.coalesce(_choice(F.col("kind"), {k: _rows(v) for k, v in heads.items()}), F.array().cast("array<array<string>>"))
    return tables.classified(_gathered(line.withColumn("row", row), ["o_orderkey", "kind"], "n", head, several=True)).select("proposal", "label")


def _work_package_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each order: tidy; under a header of two rows; with titles that pass for header words; with cells that are
    missing or shifted."""
    n, part, own = F.col("n"), F.col("l_partkey"), P.partner(F.col("l_suppkey"))
    m1, m2, pms = _text("M", F.col("m1")), _text("M", F.col("m2")), F.floor("l_quantity")
    row = _choice(F.col("kind"), {
        0: _row(_text("WP", n), _text("Part ", part), own, _half(pms), m1, m2), 1: _row(n, _text("Part ", part), n, own, pms, m1, m2), 2: _row(n, _text("Innovation ", part), own, pms, m1, m2),
        3: _row(_text("WP ", n), "", "", _half(pms), "AB", _text("Topic of part ", part), m1, m2),
    })
    line = P.lines(spark, sf_dir).withColumn("kind", (F.col("o_orderkey") % 4).cast("int")).withColumn("row", row)
    return _gathered(line, ["o_orderkey", "kind"], "n", F.when(F.col("kind") == 1, _rows(WP_HEADER_TWO)).otherwise(_rows([WP_HEADER])))


def wp_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_package_list(tables.joined_fragments(_work_package_lists(spark, sf_dir)))


def wp_list_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_package_list(tables.joined_fragments(_work_package_lists(spark, sf_dir)), strict=True).select("proposal", "wp_id", "title")


def wp_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a table of its customer, some pages on, with a label by rules or by a model."""
    order = P.work_packages(spark, sf_dir)
    key = F.col("o_orderkey")
    labelled = order.select("proposal", (F.col("k") + key % 3).cast("int").alias("page_idx"), key.alias("table_idx"), _choice(key % 4, {0: F.lit("wp_list"), 1: F.lit("effort"), 2: F.lit("deliverable"), 3: F.lit("other")}).alias("label"), F.when(key % 5 == 0, "model").otherwise("rules").alias("label_source"))
    return tables.picked(labelled).select("proposal", "page_idx", "table_idx", "label")


def _efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proposal, k, form (of the customer's matrix), a, b, c: what an order's line items number, sum up to and are at most."""
    by = P.lines(spark, sf_dir).groupBy("proposal", "k").agg(F.count("*").alias("a"), F.floor(F.sum("l_quantity")).alias("b"), F.floor(F.max("l_quantity")).alias("c"))
    return by.withColumn("form", (F.col("proposal") % 4).cast("int"))


def effort_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix for each customer: rows that name work packages; rows that don't, of which two in three packages are expected;
    packages on top, with empty cells; and a matrix without the company."""
    by = _efforts(spark, sf_dir)
    k, a, b, c = (F.col(x) for x in "kabc")
    down = by.withColumn("row", _choice(F.col("form"), {0: _row(_text("WP", k), a, _half(b), c), 1: _row(a, b, c, a + b + c), 3: _row(a, b)}))
    heads = _choice(F.col("form"), {0: _rows([EFFORT_HEADER]), 1: _rows([["AB", "CD", "EF", "Total"]]), 3: _rows([["AB", "EF"]])})
    across = by.filter("form = 2").groupBy("proposal").agg(F.array_sort(F.collect_list(F.struct("k", b.cast("string").alias("b")))).alias("x"))
    # A cell is empty if the one before it isn't; orders without line items may leave two such packages side by side.
    before = lambda i: F.get("x", i - 1)
    cells = F.transform("x", lambda x, i: F.when(x["k"] % 4 != 0, x["b"]).when(before(i)["k"] % 4 == 0, before(i)["b"]).otherwise(""))
    on_top = F.array(F.concat(_row(""), F.transform("x", lambda x: _text("WP", x["k"]))), F.concat(_row("10/CD"), cells))
    found = _gathered(down.filter("form <> 2"), ["proposal", "form"], "k", heads).drop("form").unionByName(across.select("proposal", F.lit(0).alias("page_idx"), F.lit(0).alias("table_idx"), on_top.alias("rows")))
    expected = by.filter((F.col("form") == 1) & (k % 3 != 0)).select("proposal", _text("WP", k).alias("wp_id"))
    return tables.effort_matrix(found, "CD", expected)


def deliv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each order, read loosely and strictly: plain rows, ranges of ids with two months, rows without a lead, and
    rows whose level is none, of which the loose reading finds one within a word."""
    k, n = F.col("k"), F.col("n")
    kind = n % 4
    row = _row(
        F.when(kind == 1, _text("D", k, ".", n, " – D", k, ".", n + 2)).otherwise(_text("D", k, ".", n)), _text("Tidy plan ", n), _text(F.when(kind == 3, "Software").otherwise("A long"), " kind of text on part ", F.col("l_partkey")), _text("WP", k + 1),
        F.when(kind == 2, "").otherwise("AB"), "R", F.when(kind == 3, "XX").otherwise("SEN"), F.when(kind == 1, _text("M", F.col("m1"), ", M", F.col("m2"))).otherwise(_text("M", F.col("m1"))),
    )
    found = _gathered(P.lines(spark, sf_dir).withColumn("row", row), ["o_orderkey"], "n", _rows([["Del. No", "Name", "Text", "WP", "Lead", "Type", "Level", "Due"]]))
    return tables.deliverable_readings(found).select("proposal", "reading", F.col("row_ord").cast("long").alias("n"), F.array_join("ids", " ").alias("ids"), "name", "description", "wp", "lead", "type", "dissemination", F.array_join("months", " ").alias("months"))


# ---------------------------------------------------------------- prose


def heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's chunk for each line item, in the four forms of a heading."""
    own, span = P.partner(F.col("l_suppkey")), lambda dash: _text("M", F.col("m1"), dash, "M", F.col("m2"))
    begin = _text("T", F.col("k"), ".", F.col("n"), " Part ", F.col("l_partkey"))
    chunk = _choice((F.col("n") % 4).cast("int"), {
        0: _text(begin, " (", own, ", CD) Build it."), 1: _text(begin, " (", own, ", CD | ", span("-"), ") Deploy."), 2: _text(begin, " [", span("–"), "] (EF; ", own, ", CD) Train."),
        3: _text(begin, " [", span("-"), ", M90-M99] - Leader: GH - Task Partners: ", own, ", CD - [PMs: 12] Run pilots."),
    })
    found = sections.headings(P.lines(spark, sf_dir).select("o_orderkey", "n", chunk.alias("chunk")))
    return found.select("o_orderkey", "n", "id", "title", "start_month", "end_month", "leader", F.array_join("names", ",").alias("names"), "body")


def chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each order, whose tasks mention the tasks of the next work package."""
    k, n = F.col("k"), F.col("n")
    told = _text("T", k, ".", n, " Part ", F.col("l_partkey"), " (AB) does work with T", k + 1, ".", n, " (CD) output here.")
    by = P.lines(spark, sf_dir).groupBy("o_orderkey", "k").agg(F.array_sort(F.collect_list(F.struct("n", told.alias("t")))).alias("x"))
    found = by.select(F.col("o_orderkey").alias("proposal"), F.lit(0).alias("section_idx"), _text("WP", k).alias("wp_id"), _text("Intro. ", F.array_join(F.transform("x", lambda x: x["t"]), " ")).alias("section_text"))
    return sections.chunks(found).select("proposal", "wp_id", "chunk")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer a contents page, and two pages for each order; the second one of LAST has what stops the reader."""
    order, k = P.work_packages(spark, sf_dir), F.col("k")
    first = _text(F.when(k == 1, "Work package description ").otherwise(""), "WP Number ", k, " Priority ", F.col("title"), " Objectives: to deliver. T", k, ".1 Alpha (CD, AB | M3-M9) plan it.")
    second = _text("T", k, ".2 Beta (AB) report it.", F.when(k == LAST, " List of deliverables D1.1 Plan").otherwise(""))
    both = order.select("proposal", F.posexplode(F.array(first, second)).alias("half", "text"), "k")
    contents = order.filter("k = 1").select("proposal", F.lit(0).alias("page_idx"), F.lit("Contents Excellence Impact Implementation").alias("text"))
    return both.select("proposal", (2 * k - 1 + F.col("half")).cast("int").alias("page_idx"), "text").unionByName(contents)


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.sections(_pages(spark, sf_dir))
    return found.select("proposal", F.col("section_idx").cast("long").alias("section_idx"), "wp_id", "wp_title", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), F.length("section_text").cast("long").alias("chars"))


def extracted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.tasks(sections.sections(_pages(spark, sf_dir)))
    return found.select("proposal", "id", "wp_id", "title", "start_month", "end_month", F.array_join("partners", ",").alias("partners"), "description")


def whole_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's pages, and its work packages, effort and deliverables as tables, through all stages."""
    order, k = P.work_packages(spark, sf_dir), F.col("k")
    lead = F.when(k % 2 == 0, "CD").otherwise("AB")
    kinds = [
        (_row(_text("WP", k), _text("Part ", k), lead, k, "M1", _text("M", 12 + k)), [WP_HEADER]),
        (_row(_text("WP", k), k, k % 3, k + k % 3), [EFFORT_HEADER]),
        (_row(_text("D", k, ".1"), "Search tool", "R", "PU", "M08", "CD"), [["No", "Deliverable name", "Type", "Level", "Due", "Lead"]]),
    ]
    found = [_gathered(order.withColumn("row", row), ["proposal"], "k", _rows(head)).withColumn("page_idx", F.lit(page)) for page, (row, head) in enumerate(kinds)]
    nested = pipeline.run(_pages(spark, sf_dir), found[0].unionByName(found[1]).unionByName(found[2]), "CD", whole_document=True, keep=files.saved)
    shown = F.transform("tasks", lambda t: F.concat(t["id"], F.lit(":"), t["role"], F.lit(":"), F.coalesce(F.array_join(F.transform(t["deliverables"], lambda d: d["id"]), "+"), F.lit(""))))
    return nested.select("proposal", "wp_id", "title", "leader", "role", "person_months", "start", "end", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("tasks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (table_rules, wp_list_parse, wp_list_strict, wp_fragments, effort_layouts, deliv_parse, heading_forms, chunk_rules, section_texts, extracted_tasks, whole_pipeline)}


_WITH = f"WITH {P.PROJECTION_SQL}"
_TOKEN = "'M' || CASE WHEN {0} < 10 THEN '0' ELSE '' END || {0}"
_M1, _M2 = _TOKEN.format("m1"), _TOKEN.format("m2")
_PRE = "length('WP Number ' || k || ' Priority ' || title || ' Objectives: to deliver. T' || k || '.1 Alpha (CD, AB | M3-M9) plan it.') + 1 + length('T' || k || '.2 Beta (AB) report it.')"
_LISTED = "of AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS c, o_orderkey % 4 AS kind FROM line)"
ORACLES: dict[str, str] = {
    "table_rules": f"{_WITH} SELECT o_orderkey AS proposal, CASE o_orderkey % 9 WHEN 0 THEN 'wp_list' WHEN 1 THEN 'wp_list' WHEN 2 THEN 'effort' WHEN 4 THEN 'effort' WHEN 5 THEN 'deliverable' WHEN 6 THEN 'other' WHEN 7 THEN 'other' END AS label FROM line GROUP BY o_orderkey",
    # Under a loose reading the first row of a list of titles like "Innovation" passes for a second header row.
    "wp_list_parse": f"""{_WITH}, {_LISTED}
        SELECT o_orderkey AS proposal, 'WP' || n AS wp_id, CASE kind WHEN 2 THEN 'Innovation ' WHEN 3 THEN 'Topic of part ' ELSE 'Part ' END || l_partkey AS title, CASE kind WHEN 3 THEN 'AB' ELSE own END AS leader,
               floor(l_quantity) + CASE WHEN kind IN (0, 3) THEN 0.5 ELSE 0 END AS pms, {_M1} AS start, {_M2} AS "end" FROM of WHERE NOT (kind = 2 AND n = 1 AND c > 1)""",
    "wp_list_strict": f"{_WITH}, {_LISTED} SELECT o_orderkey AS proposal, 'WP' || n AS wp_id, CASE kind WHEN 2 THEN 'Innovation ' WHEN 3 THEN 'Topic of part ' ELSE 'Part ' END || l_partkey AS title FROM of",
    "wp_fragments": f"""{_WITH}, t AS (SELECT proposal, CAST(k + o_orderkey % 3 AS INTEGER) AS page_idx, o_orderkey AS table_idx, CASE o_orderkey % 4 WHEN 0 THEN 'wp_list' WHEN 1 THEN 'effort' WHEN 2 THEN 'deliverable' END AS label, o_orderkey % 5 = 0 AS asked FROM wp),
        r AS (SELECT *, min(page_idx) OVER (PARTITION BY proposal, label) AS first, row_number() OVER (PARTITION BY proposal, label ORDER BY asked, page_idx, table_idx) AS place FROM t WHERE label IS NOT NULL)
        SELECT proposal, page_idx, table_idx, label FROM r WHERE label = 'deliverable' OR (label = 'effort' AND place = 1) OR (label = 'wp_list' AND page_idx <= first + 3)""",
    "effort_layouts": f"""{_WITH}, e AS (SELECT proposal, k, floor(sum(l_quantity)) AS b, count(*) AS a FROM line GROUP BY proposal, k),
        o AS (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY k) AS place, lag(b) OVER (PARTITION BY proposal ORDER BY k) AS before, count(*) OVER (PARTITION BY proposal) AS c FROM e),
        x AS (SELECT proposal, k, row_number() OVER (PARTITION BY proposal ORDER BY k) AS place FROM e WHERE k % 3 <> 0)
        SELECT proposal, 'CD' AS company, 'WP' || k AS wp_id, b + 0.5 AS person_months FROM o WHERE proposal % 4 = 0
        UNION ALL SELECT proposal, 'CD', 'WP' || x.k, b FROM o JOIN x USING (proposal, place) WHERE proposal % 4 = 1
        UNION ALL SELECT proposal, 'CD', 'WP' || k, CASE WHEN k % 4 = 0 THEN before ELSE b END FROM o WHERE proposal % 4 = 2 AND c >= 3""",
    "deliv_parse": f"""{_WITH}, r AS (SELECT *, unnest(['loose', 'strict']) AS reading FROM line WHERE n % 4 <> 2)
        SELECT o_orderkey AS proposal, reading, n, 'D' || k || '.' || n || CASE WHEN n % 4 = 1 THEN ' D' || k || '.' || (n + 1) || ' D' || k || '.' || (n + 2) ELSE '' END AS ids, 'Tidy plan ' || n AS name,
               CASE WHEN n % 4 = 3 THEN 'Software' ELSE 'A long' END || ' kind of text on part ' || l_partkey AS description, 'WP' || (k + 1) AS wp, 'AB' AS lead, 'R' AS type, CASE WHEN n % 4 = 3 THEN 'RE' ELSE 'SEN' END AS dissemination,
               'M' || m1 || CASE WHEN n % 4 = 1 THEN ' M' || m2 ELSE '' END AS months FROM r WHERE NOT (reading = 'strict' AND n % 4 = 3)""",
    "heading_forms": f"""{_WITH} SELECT o_orderkey, n, 'T' || k || '.' || n AS id, 'Part ' || l_partkey AS title, CASE WHEN n % 4 = 0 THEN '' ELSE {_M1} END AS start_month, CASE n % 4 WHEN 0 THEN '' WHEN 3 THEN 'M99' ELSE {_M2} END AS end_month,
        CASE n % 4 WHEN 2 THEN 'EF' WHEN 3 THEN 'GH' ELSE '' END AS leader, own || ',CD' AS names, CASE n % 4 WHEN 0 THEN 'Build it.' WHEN 1 THEN 'Deploy.' WHEN 2 THEN 'Train.' ELSE 'Run pilots.' END AS body FROM line""",
    "chunk_rules": f"{_WITH} SELECT o_orderkey AS proposal, 'WP' || k AS wp_id, 'T' || k || '.' || n || ' Part ' || l_partkey || ' (AB) does work with' AS chunk FROM line",
    "section_texts": f"{_WITH} SELECT proposal, k - 1 AS section_idx, 'WP' || k AS wp_id, 'Priority ' || title AS wp_title, (2 * k - 1) || ',' || (2 * k) AS pages, CAST({_PRE} AS BIGINT) AS chars FROM wp WHERE k <= {LAST}",
    "extracted_tasks": f"""{_WITH} SELECT proposal, 'T' || k || '.1' AS id, 'WP' || k AS wp_id, 'Alpha' AS title, 'M03' AS start_month, 'M09' AS end_month, 'CD,AB' AS partners, 'plan it.' AS description FROM wp WHERE k <= {LAST}
        UNION ALL SELECT proposal, 'T' || k || '.2', 'WP' || k, 'Beta', '', '', 'AB', 'report it.' FROM wp WHERE k <= {LAST}""",
    "whole_pipeline": f"""{_WITH}, o AS (SELECT *, count(*) OVER (PARTITION BY proposal) AS c FROM wp)
        SELECT proposal, 'WP' || k AS wp_id, 'Part ' || k AS title, CASE WHEN k % 2 = 0 THEN 'CD' ELSE 'AB' END AS leader, CASE WHEN k % 2 = 0 THEN 'leader' ELSE 'participant' END AS role, CAST(k % 3 AS DOUBLE) AS person_months,
               'M01' AS start, 'M' || (12 + k) AS "end", CASE WHEN k <= {LAST} THEN 'T' || k || '.1:leader:D' || k || '.1' ELSE '' END AS tasks FROM o WHERE c >= 3 AND k % 3 > 0""",
}
