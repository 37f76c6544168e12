"""What an idempotent push would create: plans against what the remote tracker has. Sending them is the sink's part.

Where rows of a payload compete, the first by the payload's order wins; order is any column or struct that gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labels_to_create(labels: DataFrame, remote: DataFrame, order: Column) -> DataFrame:
    """Labels that the remote doesn't have in any case; of those that differ in case only the first."""
    first = labels.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "description", "color"), order).alias("row"))
    return first.join(remote.select(F.lower("name").alias("key")).distinct(), "key", "left_anti").select("row.*")


def milestone_plan(milestones: DataFrame, remote: DataFrame) -> DataFrame:
    """Each milestone with the remote number of its exact title; without one it is to be created."""
    known = remote.groupBy("title").agg(F.max("number").alias("number"))
    return milestones.join(known, "title", "left").withColumn("action", F.when(F.col("number").isNull(), "create").otherwise("skip"))


def existing_issues(remote: DataFrame, order: Column) -> DataFrame:
    """milestone, title and number of what the tracker has; of several issues of one title the last. Pull requests are not issues."""
    return remote.filter(~F.col("is_pull_request")).groupBy("milestone", "title").agg(F.max_by("number", order).alias("number"))


def issue_plan(issues: DataFrame, known: DataFrame, order: Column) -> DataFrame:
    """Adds action and number: an issue whose milestone has its title (known: existing_issues()) is skipped and has that
    issue's number; so are repeats within the payload, after the first.

    Both sides are aggregated by (milestone, title) first, so a hot title is one row."""
    keyed = issues.groupBy("milestone", "title").agg(F.min(order).alias("first_in_payload"))
    state = keyed.join(known.select("milestone", "title", "number", F.lit(True).alias("is_known")), ["milestone", "title"], "left")
    both = issues.join(state, ["milestone", "title"])
    return both.withColumn("action", F.when(F.col("is_known").isNotNull() | (order != F.col("first_in_payload")), "skip").otherwise("create")).drop("is_known", "first_in_payload")


def push_counts(plan: DataFrame, *key: str) -> DataFrame:
    """How many rows of a plan are created and skipped."""
    return plan.groupBy(*key).agg(F.count_if(F.col("action") == "create").alias("created"), F.count_if(F.col("action") == "skip").alias("skipped"))


def resolved(children: DataFrame, parents: DataFrame, key: str, number: str) -> DataFrame:
    """Children with their parent's number; one without parent is an error, not a lost row."""
    both = children.join(parents.select(key, number), key, "left")
    return both.withColumn(number, F.coalesce(F.col(number), F.raise_error(F.concat(F.lit("no parent for "), F.col(key).cast("string"))).cast("long")))
