"""Proposals made of the driver's star schema, so that every operator can run at any scale factor.

A customer is a proposal, its orders are work packages, line items are tasks, suppliers are partners, and returned
line items are deliverables. PROJECTION_SQL has the same rules as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.functions.scalars import m_token

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proposal, wp_id, k, o_orderkey, start (the proposal's), title, leader."""
    orders = read(spark, sf_dir, "orders")
    by = W.partitionBy("o_custkey")
    return orders.select(
        F.col("o_custkey").alias("proposal"),
        "o_orderkey",
        F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("k"),
        F.min("o_orderdate").over(by).cast("date").alias("start"),
        F.col("o_orderpriority").alias("title"),
    ).withColumn("wp_id", F.concat(F.lit("WP"), F.col("k").cast("string")))


def lines(spark: SparkSession, sf_dir: str, company: int | None = None) -> DataFrame:
    """Work packages by line item: n (ordinal in the order), months m1 and m2 from the proposal's start. company: those of
    orders with a line item of this supplier, whose line items are all kept."""
    item = read(spark, sf_dir, "lineitem")
    if company is not None:
        item = item.join(item.filter(F.col("l_suppkey") == company).select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    item = item.withColumn("n", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long"))
    both = item.join(work_packages(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.col("l_shipdate").cast("date")
    m1 = F.greatest((F.year(ship) - F.year("start")) * 12 + F.month(ship) - F.month("start") + 1, F.lit(1))
    return both.select("proposal", "wp_id", "k", "o_orderkey", "start", F.col("title").alias("wp_title"), "n", "l_suppkey", "l_quantity", "l_returnflag", "l_partkey", m1.alias("m1"), (m1 + F.floor("l_quantity").cast("int") % 12).cast("int").alias("m2"))


def partner(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


def tasks(spark: SparkSession, sf_dir: str, line: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """proposal, wp_id, k, n, id, title, start_month, end_month, partners (own supplier first), description, start, and more of lines()."""
    line = lines(spark, sf_dir) if line is None else line
    names = F.array_sort(F.collect_set(partner(F.col("l_suppkey"))).over(W.partitionBy("o_orderkey")))  # a few suppliers an order
    own = partner(F.col("l_suppkey"))
    return line.withColumn("names", names).select(
        "proposal", "wp_id", "k", "n", "start",
        F.concat(F.lit("T"), F.col("k").cast("string"), F.lit("."), F.col("n").cast("string")).alias("id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        m_token(F.col("m1")).alias("start_month"),
        m_token(F.col("m2")).alias("end_month"),
        F.concat(F.array(own), F.filter("names", lambda x: x != own)).alias("partners"),
        F.concat(F.lit("Returned: "), F.col("l_returnflag")).alias("description"),
        *more,
    )


def deliverables(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """proposal, wp_id, n, id, name, due_months."""
    line = (lines(spark, sf_dir) if line is None else line).filter(F.col("l_returnflag") == "R")
    return line.select("proposal", "wp_id", "n", F.concat(F.lit("D"), F.col("k").cast("string"), F.lit("."), F.col("n").cast("string")).alias("id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"), F.array(m_token(F.col("m1"))).alias("due_months"))


def effort(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """proposal, company, wp_id, person_months."""
    return (lines(spark, sf_dir) if line is None else line).groupBy("proposal", partner(F.col("l_suppkey")).alias("company"), "wp_id").agg(F.sum("l_quantity").alias("person_months"))


def wp_info(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """proposal, wp_id, title, leader, start, end; the first line item's supplier leads."""
    line = lines(spark, sf_dir) if line is None else line
    return line.groupBy("proposal", "wp_id").agg(F.min_by(partner(F.col("l_suppkey")), "n").alias("leader"), m_token(F.min("m1")).alias("start"), m_token(F.max("m2")).alias("end"), F.first("wp_title").alias("title"))


PROJECTION_SQL = """
    wp AS (SELECT o_custkey AS proposal, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k,
                  CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS start, o_orderpriority AS title FROM orders),
    item AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS n FROM lineitem),
    line0 AS (SELECT proposal, 'WP' || k AS wp_id, k, o_orderkey, start, title, n, 'S' || l_suppkey AS own, l_quantity, l_returnflag, l_partkey,
                     greatest((year(l_shipdate) - year(start)) * 12 + month(l_shipdate) - month(start) + 1, 1) AS m1 FROM item JOIN wp ON l_orderkey = o_orderkey),
    line AS (SELECT *, m1 + CAST(floor(l_quantity) AS INTEGER) % 12 AS m2 FROM line0),
    names AS (SELECT o_orderkey, list_sort(list(DISTINCT own)) AS names FROM line GROUP BY o_orderkey),
    task AS (SELECT proposal, wp_id, k, n, start, m1, m2, 'T' || k || '.' || n AS id, 'Part ' || l_partkey AS title,
                    'M' || CASE WHEN m1 < 10 THEN '0' ELSE '' END || m1 AS start_month, 'M' || CASE WHEN m2 < 10 THEN '0' ELSE '' END || m2 AS end_month,
                    list_concat([own], list_filter(names, lambda x: x <> own)) AS partners, 'Returned: ' || l_returnflag AS description
             FROM line JOIN names USING (o_orderkey)),
    deliv AS (SELECT proposal, wp_id, n, m1 AS due, 'D' || k || '.' || n AS id, 'Part ' || l_partkey AS name, 'M' || CASE WHEN m1 < 10 THEN '0' ELSE '' END || m1 AS due_month FROM line WHERE l_returnflag = 'R'),
    effort AS (SELECT proposal, own AS company, wp_id, sum(l_quantity) AS person_months FROM line GROUP BY ALL),
    info AS (SELECT proposal, wp_id, min(title) AS title, min_by(own, n) AS leader,
                    'M' || CASE WHEN min(m1) < 10 THEN '0' ELSE '' END || min(m1) AS start_month, 'M' || CASE WHEN max(m2) < 10 THEN '0' ELSE '' END || max(m2) AS end_month FROM line GROUP BY ALL)
"""
