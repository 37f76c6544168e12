"""Ready-to-load relations for a planner and an issue tracker, from nested work packages or flat tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.functions.scalars import joined_title, label_color, milestone_date, months_range, planner_date, slug


def planner_buckets(wps: DataFrame) -> DataFrame:
    return wps.select("proposal", F.col("wp_id").alias("external_id"), F.btrim(F.concat("wp_id", F.lit(" - "), "title"), F.lit(" -")).alias("name"))


def planner_tasks(tasks: DataFrame) -> DataFrame:
    """One row per task with its bucket and dates; tasks need the proposal's start."""
    start = F.col("start")
    return tasks.select("proposal", F.col("id").alias("external_id"), F.col("wp_id").alias("bucket_external_id"), F.btrim(F.concat("id", F.lit(" - "), "title"), F.lit(" -")).alias("title"), planner_date(start, F.col("start_month")).alias("start_date_time"), planner_date(start, F.col("end_month"), True).alias("due_date_time"))


def planner_checklist(attached: DataFrame) -> DataFrame:
    """An item for each deliverable of a task and each month it is due."""
    item = attached.select("proposal", "wp_id", "task_id", F.col("deliverable.id").alias("deliverable_id"), F.col("deliverable.name").alias("name"), F.explode("deliverable.due_months").alias("due_month"))
    return item.select("proposal", "wp_id", F.col("task_id").alias("task_external_id"), F.concat("deliverable_id", F.lit(" - "), "name", F.lit(" ("), "due_month", F.lit(")")).alias("title"))


def milestones(wps: DataFrame, plan_title: str) -> DataFrame:
    """One per work package, due with its last month; wps need the proposal's start date as proposal_start."""
    title = joined_title(F.lit(plan_title.strip()), joined_title(F.col("wp_id"), F.col("title")))
    return wps.select("proposal", F.col("wp_id").alias("external_id"), title.alias("title"), milestone_date(F.col("proposal_start"), F.col("end"), True).alias("due_on"))


def labels(tasks: DataFrame, plan_title: str, order: tuple[str, ...] = ("proposal", "wp_id", "n")) -> DataFrame:
    """Distinct labels: the proposal's, roles and partners, each with its color and what it stands for, as the first task in
    the given order says it."""
    each = F.array(
        F.struct(F.concat(F.lit("proposal:"), slug(F.lit(plan_title))).alias("name"), F.lit("proposal").alias("description")),
        F.struct(F.concat(F.lit("role:"), F.col("role")).alias("name"), F.lit("role").alias("description")),
    )
    every = F.concat(each, F.transform("partners", lambda p: F.struct(p.alias("name"), F.lit("partner").alias("description"))))
    rows = tasks.select(F.struct(*order).alias("task"), F.posexplode(every).alias("pos", "label")).filter(F.col("label.name") != "")
    named = rows.groupBy(F.col("label.name").alias("name")).agg(F.min_by("label.description", F.struct("task", "pos")).alias("description"))
    return named.withColumn("color", label_color(F.col("name")))


def issue_body(tasks: DataFrame) -> DataFrame:
    """Adds body: schedule, role and partners, the description, and a checklist of deliverables (an array column)."""
    dash = "–"
    item = lambda d: F.concat(F.lit("- [ ] "), d["id"], F.lit(f" {dash} "), F.coalesce(F.nullif(d["name"], F.lit("")), d["id"]), F.when(F.size(d["due_months"]) > 0, F.concat(F.lit(" ("), F.array_join(d["due_months"], ", "), F.lit(")"))).otherwise(F.lit("")))
    months = months_range(F.col("start_month"), F.col("end_month"))
    some = lambda keep, text: F.when(keep, text)
    listed = F.coalesce(F.size("deliverables"), F.lit(0)) > 0
    parts = F.concat(
        F.array(
            some(months != "", F.concat(F.lit("**Schedule:** "), months)),
            some(F.col("role") != "", F.concat(F.lit("**Role:** "), F.col("role"))),
            some(F.size("partners") > 0, F.concat(F.lit("**Partners:** "), F.array_join("partners", ", "))),
            F.lit(""),
            some(F.col("description") != "", F.concat(F.col("description"), F.lit("\n"))),
            some(listed, F.lit("**Deliverables**")),
        ),
        F.when(listed, F.transform("deliverables", item)).otherwise(F.array().cast("array<string>")),
    )
    return tasks.withColumn("body", F.btrim(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"), F.lit(" \n")))


def issues(tasks: DataFrame, plan_title: str) -> DataFrame:
    """One per task: its milestone, title, body and labels. deliverables may be missing."""
    rows = tasks if "deliverables" in tasks.columns else tasks.withColumn("deliverables", F.expr("cast(array() as array<struct<id:string,name:string,due_months:array<string>>>)"))
    title = joined_title(F.lit(plan_title.strip()), joined_title(F.col("id"), F.col("title")))
    names = F.concat(F.array(F.concat(F.lit("proposal:"), slug(F.lit(plan_title))), F.concat(F.lit("role:"), F.col("role"))), F.col("partners"))
    return issue_body(rows).select("proposal", F.col("id").alias("external_id"), F.col("wp_id").alias("milestone_external_id"), title.alias("title"), "body", F.array_distinct(names).alias("labels"))
