"""The stages from pages and tables to work packages, over many proposals at once."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.operators import assembly, sections, tables


class Assembler(Protocol):
    """Nested work packages of a company from typed tables and tasks."""

    def __call__(self, first: Stage1, tasks: DataFrame, company: str) -> DataFrame: ...


class TaskExtractor(Protocol):
    """Tasks from sections: proposal, task_ord, id, wp_id, title, start_month, end_month, partners, description."""

    def __call__(self, found: DataFrame) -> DataFrame: ...


@dataclass
class Stage1:
    wp_info: DataFrame
    effort: DataFrame
    deliverables: DataFrame
    warnings: DataFrame


def parameters(company: str | None = None, start_date: str | None = None) -> tuple[str, str]:
    """Blank ones become the defaults; a company has 1 to 32 characters, and a date is ISO."""
    from datetime import date

    name = (company or "").strip().upper() or "INTRA"
    day = (start_date or "").strip() or "2025-01-01"
    if len(name) > 32:
        raise ValueError("the company has more than 32 characters")
    date.fromisoformat(day)
    return name, day


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def stage1(raw_tables: DataFrame, company: str, label_of=None, strict: bool = False, whole_pages: bool = False, keep: Callable[[DataFrame], DataFrame] = _as_it_is) -> Stage1:
    """Typed tables. label_of: see tables.with_fallback_label(); without it tables that no rule knows are left out. Tables
    that are too small for any label are left out before. whole_pages: rows of deliverables are looked for in all tables of
    a page that has a list of them, whatever their labels. keep: what to do with tables that have their label, of which all that follows is made (files.saved)."""
    every, raw_tables = raw_tables, tables.worth_classifying(raw_tables)
    labelled = tables.classified(raw_tables).withColumn("label_source", F.lit("rules")) if label_of is None else tables.with_fallback_label(raw_tables, label_of)
    kept = keep(tables.picked(labelled))  # none without a label is among these
    of = lambda label: kept.filter(F.col("label") == label)
    info = tables.work_package_list(tables.joined_fragments(of("wp_list")), strict)
    effort = tables.effort_matrix(of("effort"), company, info.select("proposal", "wp_id"))
    found = every.select("proposal").distinct()
    missing = lambda df, text: found.join(df.select("proposal").distinct(), "proposal", "left_anti").withColumn("warning", F.lit(text))
    lists = every.join(of("deliverable").select("proposal", "page_idx").distinct(), ["proposal", "page_idx"], "left_semi") if whole_pages else of("deliverable")
    deliverables = tables.deliverable_list(lists, strict)
    warnings = missing(info, "no work package list").unionByName(missing(effort, "no effort for the company")).unionByName(missing(deliverables, "no deliverables"))
    return Stage1(info, effort, deliverables, warnings)


def stage2(pages: DataFrame, extract: TaskExtractor = sections.tasks) -> DataFrame:
    return extract(sections.sections(pages))


def stage3(first: Stage1, tasks: DataFrame, company: str) -> DataFrame:
    """Nested work packages of the company. Deliverables are rows of one id with all months of their list row."""
    each = assembly.exploded_deliverables(first.deliverables)
    delivered = each.select("proposal", F.col("wp").alias("wp_id"), F.struct("page_idx", "table_idx", "row_ord", "id_ord").alias("n"), "id", "name", "description", "lead", "type", "dissemination", F.col("months").alias("due_months"))
    return assembly.work_packages(first.wp_info, first.effort, tasks.withColumnRenamed("task_ord", "n"), delivered, company)


def of_section3(pages: DataFrame, raw_tables: DataFrame, votes: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tables on the pages of section 3, and the proposals without one (proposal, warning), of which no table is left."""
    kept = sections.section3_pages(pages, votes, strict).select("proposal", "page_idx")
    lost = pages.select("proposal").distinct().join(kept.select("proposal").distinct(), "proposal", "left_anti").withColumn("warning", F.lit("no section 3"))
    return raw_tables.join(kept, ["proposal", "page_idx"], "left_semi"), lost


def run(pages: DataFrame, raw_tables: DataFrame, company: str, extract: TaskExtractor = sections.tasks, label_of=None, assemble: Assembler = stage3, whole_document: bool = False, votes: DataFrame | None = None, progress: Callable[[str], None] | None = None, keep: Callable[[DataFrame], DataFrame] = _as_it_is) -> DataFrame:
    """All stages. Tables count on the pages of section 3 only, unless whole_document is set. votes: see section3_pages(). keep: is
    applied to each result that later ones are made of (files.saved writes it; otherwise they are made anew for each).
    progress gets the name of each stage as its plan is made, before Spark does any work on it (progress.run_reported() tells
    of work that is done); what it raises doesn't stop the run."""

    def began(stage: str) -> None:
        if progress:
            with suppress(Exception):
                progress(stage)

    began("tables")
    counted = raw_tables if whole_document else of_section3(pages, raw_tables, votes)[0]
    first = stage1(counted, company, label_of, keep=keep)
    if keep is not _as_it_is:
        first = Stage1(keep(first.wp_info), keep(first.effort), keep(first.deliverables), first.warnings)
    began("tasks")
    found = keep(stage2(pages, extract))
    began("assembly")
    result = assemble(first, found, company)
    began("done")
    return result
