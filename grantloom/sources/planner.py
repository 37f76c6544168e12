"""A planner as a sink: a plan for each proposal, its buckets, tasks and their details, in the order that they depend on.

The planner has no key to find an old plan by, so a push without a journal makes a new one each time. With a journal (see
tracker.Journal) each thing is created once: a repeated task, or a second evaluation of the frame, finds what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.sources.tracker import Journal

#: Times that details are sent again with a new tag, as somebody else has changed them meanwhile.
TAG_TRIES = 5
PUSHED = "proposal long, kind string, external_id string, id string, error string"


class TagChanged(Exception):
    """The details have changed since their tag was read."""


class Planner(Protocol):
    """What a client of the planner's service does; each create gives the new thing's id. update_details raises TagChanged
    if the tag isn't the details' any more. A client that can look for what it has made has find(kind, external_id) too."""

    def create_plan(self, title: str) -> str: ...
    def create_bucket(self, plan_id: str, name: str) -> str: ...
    def create_task(self, plan_id: str, bucket_id: str, title: str, **dates: str) -> str: ...
    def details_tag(self, task_id: str) -> str: ...
    def update_details(self, task_id: str, tag: str, **details: object) -> None: ...


def payload(buckets: DataFrame, tasks: DataFrame, checklist: DataFrame) -> DataFrame:
    """A row per proposal: buckets, and tasks with their checklist, as arrays that a proposal's own size bounds."""
    items = checklist.groupBy("proposal", F.col("task_external_id").alias("external_id")).agg(F.array_sort(F.collect_list("title")).alias("checklist"))
    with_items = tasks.join(items, ["proposal", "external_id"], "left").withColumn("checklist", F.coalesce("checklist", F.array().cast("array<string>")))
    fields = [c for c in with_items.columns if c != "proposal"]
    of_tasks = with_items.groupBy("proposal").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tasks"))
    of_buckets = buckets.groupBy("proposal").agg(F.array_sort(F.collect_list(F.struct("external_id", "name"))).alias("buckets"))
    return of_buckets.join(of_tasks, "proposal", "left")


def updated_details(client: Planner, task_id: str, details: dict[str, object]) -> None:
    """Reads the tag and sends the details with it, again if they have changed in between."""
    for left in range(TAG_TRIES - 1, -1, -1):
        try:
            return client.update_details(task_id, client.details_tag(task_id), **details)
        except TagChanged:
            if not left:
                raise


#: Makes a thing of a kind and an external id, or finds it: once(kind, external_id, create).
Once = Callable[[str, str, Callable[[], str]], str]


def push_one(client: Planner, title: str, buckets: list, tasks: list, once: Once = lambda kind, external_id, create: create()) -> Iterator[tuple[str, str, str]]:
    """(kind, external id, id) of everything that is made. Dates and details that a task lacks are left out; a task without
    details isn't read back for its tag."""
    plan_id = once("plan", title, lambda: client.create_plan(title))
    yield "plan", title, plan_id
    made = {}
    for bucket in buckets:
        made[bucket["external_id"]] = once("bucket", bucket["external_id"], lambda b=bucket: client.create_bucket(plan_id, b["name"]))
        yield "bucket", bucket["external_id"], made[bucket["external_id"]]
    for task in tasks:
        dates = {k: task[k] for k in ("start_date_time", "due_date_time") if task.get(k)}
        task_id = once("task", task["external_id"], lambda t=task, d=dates: client.create_task(plan_id, made[t["bucket_external_id"]], t["title"], **d))
        details = {k: task[k] for k in ("description", "checklist") if task.get(k) is not None and len(task[k])}
        if details:
            once("details", task["external_id"], lambda i=task_id, d=details: updated_details(client, i, d) or i)
        yield "task", task["external_id"], task_id


def journaled(client: Planner, journal: Journal, proposal: int) -> Once:
    """Creates a proposal's things once. Details are sent again after a try that broke off, which changes nothing; another
    thing that such a try may have made is looked for, and is an error if the client can't look."""

    def once(kind: str, external_id: str, create: Callable[[], str]) -> str:
        def find() -> str | None:
            if kind == "details":
                return None
            if not hasattr(client, "find"):
                raise RuntimeError(f"{kind} {external_id} may be there from a push that broke off")
            return client.find(kind, external_id)

        return journal.once((str(proposal), kind, external_id), create, find)[0]

    return once


def pushed(plans: DataFrame, connect: Callable[[], Planner], title: str, journal: str | None = None) -> DataFrame:
    """Pushes payload() when it is written: proposal, kind, external_id, id, and the error that ended a proposal's push.

    journal: a shared folder that keeps each evaluation of the frame after the first from creating anything again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = connect(), Journal(journal) if journal else None
        for batch in batches:
            rows = []
            for proposal, buckets, tasks in zip(batch["proposal"], batch["buckets"], batch["tasks"], strict=True):
                once = {"once": journaled(client, kept, proposal)} if kept else {}
                try:
                    rows += [(proposal, *made, None) for made in push_one(client, title, list(buckets), [] if tasks is None else list(tasks), **once)]
                except Exception as e:
                    rows.append((proposal, "plan", title, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["proposal", "kind", "external_id", "id", "error"])

    return plans.select(F.col("proposal").cast("long").alias("proposal"), "buckets", "tasks").mapInPandas(run, PUSHED)
