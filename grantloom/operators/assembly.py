"""Joining tables, tasks and deliverables into work packages of one company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.functions.scalars import first_listed, month_number, partner_match, quality_score

KEY = ["proposal", "wp_id"]


def role(is_leader: Column) -> Column:
    return F.when(F.coalesce(is_leader, F.lit(False)), "leader").otherwise("participant")


def company_effort(effort: DataFrame, company: str) -> DataFrame:
    """The work packages in which the company spends effort."""
    return effort.filter((F.col("company") == company.upper()) & (F.col("person_months") > 0)).drop("company")


def company_tasks(tasks: DataFrame, kept: DataFrame, company: str) -> DataFrame:
    """Tasks of those work packages that name the company (or everyone), and the company's role in them."""
    name = company.upper()
    with_key = tasks.withColumn("wp_id", F.upper("wp_id"))
    return with_key.join(kept.select(*KEY), KEY, "left_semi").filter(partner_match(F.col("partners"), F.lit(name))).withColumn("role", role(F.upper(first_listed(F.col("partners"))) == name))


def with_info(kept: DataFrame, info: DataFrame, company: str) -> DataFrame:
    """Work packages of the company with what the list says of them; without an entry, empty."""
    both = kept.join(info, KEY, "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "leader", "start", "end")}
    return both.withColumns(blank).withColumn("role", role(F.upper("leader") == company.upper()))


def exploded_deliverables(raw: DataFrame) -> DataFrame:
    """A row for each id of a deliverable row, with all months of the row; rows without work package go."""
    return raw.filter(F.coalesce("wp", F.lit("")) != "").select("*", F.posexplode("ids").alias("id_ord", "id")).drop("ids")


def _nearest(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each key with their rank; Spark drops the others before it shuffles, so a hot key is no task's burden."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= most)


def attach_deliverables(deliverables: DataFrame, tasks: DataFrame, most: int = 3) -> DataFrame:
    """Each deliverable with the tasks in whose months it falls due, the ones that end closest first, most at most.

    An interval join within a work package: tasks and deliverables need proposal, wp_id, n (their order), start_month,
    end_month and due_months. Deliverables of equal value are attached to a task once.

    Of the tasks that begin and end in the same months only the first few can be among a deliverable's nearest, as all of them
    are equally far from whatever is due. So a deliverable meets the spans of months of its work package and not its tasks:
    their number has a bound that the calendar sets, however many tasks there are."""
    due = F.filter(F.transform("due_months", month_number), lambda m: m > 0)
    left = deliverables.select(*KEY, F.col("n").alias("d_n"), F.struct(*[c for c in deliverables.columns if c not in (*KEY, "n")]).alias("deliverable"), due.alias("due"))
    right = tasks.select(*KEY, F.col("n").alias("t_n"), F.col("id").alias("task_id"), month_number(F.col("start_month")).alias("a"), month_number(F.col("end_month")).alias("b")).filter((F.col("a") > 0) & (F.col("b") > 0))
    spans = _nearest(right, [*KEY, "a", "b"], ["t_n"], most).drop("rank")
    met = left.join(spans, KEY).filter(F.exists("due", lambda m: (m >= F.col("a")) & (m <= F.col("b"))))
    met = met.withColumn("distance", F.array_min(F.transform("due", lambda m: F.abs(F.col("b") - m))))
    near = _nearest(met, [*KEY, "d_n", "deliverable"], ["distance", "t_n"], most)
    first = near.groupBy(*KEY, "t_n", "task_id", "deliverable").agg(F.min_by(F.struct("d_n", "distance", "rank"), "d_n").alias("row"))
    return first.select(*KEY, "row.d_n", "deliverable", "t_n", "task_id", "row.distance", "row.rank")


def work_packages(info: DataFrame, effort: DataFrame, tasks: DataFrame, deliverables: DataFrame, company: str) -> DataFrame:
    """Nested: a row per work package of the company, its tasks in order, and each one's deliverables.

    Every array holds what one work package has, which a proposal's own size bounds."""
    kept = company_effort(effort, company)
    own = company_tasks(tasks, kept, company)
    attached = attach_deliverables(deliverables, own)
    by_task = attached.groupBy(*KEY, F.col("t_n").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d_n", "deliverable"))), lambda x: x["deliverable"]).alias("deliverables"))
    fields = ["id", "title", "start_month", "end_month", "partners", "role", "description"]
    nested = own.join(by_task, [*KEY, "n"], "left").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("n", *fields, "deliverables"))).alias("tasks"))
    return with_info(kept, info, company).join(nested, KEY, "left").orderBy(*KEY)


# ---------------------------------------------------------------- picking one row of many


def best_by_score(tasks: DataFrame, order: list[str]) -> DataFrame:
    """Of the rows of an id (in upper case) the most complete; the earlier of equals."""
    scored = tasks.withColumn("score", quality_score(*[F.col(c) for c in ("title", "start_month", "end_month", "partners", "description")]))
    rank = F.row_number().over(W.partitionBy("proposal", F.upper("id")).orderBy(F.desc("score"), *order))
    return scored.withColumn("rank", rank).filter(F.col("rank") == 1).drop("rank")


def first_by(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row of each key, by partial aggregates: a hot key is no single task's."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*key, "row.*")


def last_by(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*key, "row.*")


#: Page classes, the one that wins a tie first.
VOTES = ("section3_start", "section3_body", "toc_or_index", "other")


def majority(votes: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """The most frequent label of each key; ties go by VOTES."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, VOTES)), F.col(label)), F.lit(0)), F.lit(len(VOTES) + 1))
    counts = votes.groupBy(*key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), place, F.col(label))).alias("row")).select(*key, "row.*")
