"""The queries of the reference's own operators, each over whole driver tables, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.functions import scalars as S
from grantloom.operators import assembly, payloads, upserts
from grantloom.plans import projection as P

COMPANY = "S1"
PLAN = "Proposal Plan"


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in several languages; the compatibility form has no SQL, so its marks are counted and not compared."""
    text = S.clean(S.compatible(F.col("text")))
    return P.read(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("chars"), F.size(F.filter(F.split(text, " "), lambda x: x != "")).cast("long").alias("words"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "part").select("p_partkey", S.clean(F.concat(F.lit("  "), "p_name", F.lit(" \n\t "), "p_type", F.lit(" "))).alias("text"))


def norm_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "part").select("p_partkey", S.norm_cell(F.concat("p_name", F.lit("   "), "p_brand")).alias("cell"))


def month_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("int")
    raw = F.when(n % 4 == 0, F.concat(F.lit("M"), n.cast("string"))).when(n % 4 == 1, n.cast("string")).when(n % 4 == 2, F.concat(F.lit(" m"), n.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("x"), n.cast("string")))
    rows = P.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "raw", S.month_token(F.col("raw")).alias("token"), S.month_number(F.col("raw")).cast("long").alias("number"))


def to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("ca. "), F.regexp_replace(F.col("c_acctbal").cast("decimal(20,2)").cast("string"), r"\.", ","), F.lit(" PM"))
    return P.read(spark, sf_dir, "customer").select("c_custkey", S.to_float(raw).alias("value"))


def partner_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tasks(spark, sf_dir).select("proposal", "id", S.partner_match(F.col("partners"), F.lit(COMPANY)).alias("matches"), S.first_listed(F.col("partners")).alias("first"))


def deliv_id_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    n, m = F.col("l_linenumber").cast("int"), F.col("l_linenumber").cast("int") + q % 5 - 1
    cell = F.concat(F.lit("D"), (q % 3).cast("string"), F.lit("."), n.cast("string"), F.when(q % 2 == 0, " – ").otherwise(", "), F.lit("d"), (q % 3).cast("string"), F.lit("."), m.cast("string"))
    rows = P.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", cell.alias("cell"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "cell", F.array_join(S.deliverable_ids(F.col("cell")), ";").alias("ids"))


def planner_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("start")
    return P.tasks(spark, sf_dir).select("proposal", "id", S.planner_date(start, F.col("start_month")).alias("starts"), S.planner_date(start, F.col("end_month"), True).alias("ends"), S.milestone_date(start, F.col("end_month"), True).alias("due"))


def slug_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(": "), "p_type", F.lit("!"))).alias("slug"), S.label_color(F.col("p_brand")).alias("color"))


def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.col("text"), r"\. ", ".... 7\n")
    return P.read(spark, sf_dir, "documents").select("doc_id", S.is_toc_page(text).alias("toc"))


def months_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.tasks(spark, sf_dir).select("proposal", "id", F.when(F.col("n") % 3 == 0, "").otherwise(F.col("start_month")).alias("a"), F.when(F.col("n") % 5 == 0, "").otherwise(F.col("end_month")).alias("b"))
    return rows.select("proposal", "id", S.months_range(F.col("a"), F.col("b")).alias("months"))


def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.work_packages(spark, sf_dir).select("proposal", "wp_id", S.progress_percent(F.col("k"), F.count("*").over(W.partitionBy("proposal"))).alias("percent"))


def section_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last page of each conversation's user turns, and the turns within (a page is a turn)."""
    turns = P.read(spark, sf_dir, "conversations")
    by = W.partitionBy("conv_id")
    user = F.when(F.col("role") == "user", F.col("turn"))
    spans = turns.withColumns({"low": F.min(user).over(by), "high": F.max(user).over(by)})
    return spans.filter(F.col("turn").between(F.col("low"), F.col("high"))).groupBy("conv_id").agg(F.min("turn").alias("first_page"), F.max("turn").alias("last_page"), F.count("*").alias("pages"))


_EVENT_ORDER = ["ts", "event_id"]


def zone_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user from the first click on (opens a zone) up to and with the first error after it (stops it)."""
    by = W.partitionBy("user_id").orderBy(*_EVENT_ORDER)
    opened = F.max((F.col("event_type") == "click").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = P.read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type").withColumn("opened", opened)
    stop = ((F.col("event_type") == "error") & (F.col("opened") == 1)).cast("int")
    rows = rows.withColumn("stopped", F.coalesce(F.max(stop).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.filter((F.col("opened") == 1) & (F.col("stopped") == 0)).select("user_id", "event_id")


def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a user's events, each begun by a signup: a running count, then a group."""
    by = W.partitionBy("user_id").orderBy(*_EVENT_ORDER).rowsBetween(W.unboundedPreceding, 0)
    rows = P.read(spark, sf_dir, "events").withColumn("section", F.sum((F.col("event_type") == "signup").cast("long")).over(by))
    return rows.filter(F.col("section") > 0).groupBy("user_id", "section").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))


def chunk_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk ends where the next candidate begins, rejected ones too: lead() before the filter."""
    by = W.partitionBy("user_id").orderBy(*_EVENT_ORDER)
    rows = P.read(spark, sf_dir, "events").withColumn("until", F.lead("event_id").over(by))
    return rows.filter(F.col("event_type") == "view").select("user_id", "event_id", "until")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected work packages in numeric order meet numeric rows in table order; the longer side is cut."""
    wps = P.work_packages(spark, sf_dir).select("proposal", "wp_id", F.row_number().over(W.partitionBy("proposal").orderBy("k")).alias("place"))
    rows = P.lines(spark, sf_dir).filter(F.col("n") == 1).select("proposal", "l_quantity", F.row_number().over(W.partitionBy("proposal").orderBy(F.desc("o_orderkey"))).alias("place")).filter(F.col("l_quantity") >= 10)
    return wps.join(rows, ["proposal", "place"]).select("proposal", "wp_id", F.col("l_quantity").alias("effort"))


def best_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.tasks(spark, sf_dir).select("proposal", F.concat(F.lit("t"), F.col("n").cast("string")).alias("id"), "k", "n", F.col("title"), F.when(F.col("k") % 2 == 0, "").otherwise(F.col("start_month")).alias("start_month"), "end_month", F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("partners")).alias("partners"), "description")
    return assembly.best_by_score(rows, ["k", "n"]).select("proposal", "id", "k", "score")


def first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.tasks(spark, sf_dir).select("proposal", F.col("n").alias("task"), "k", "title")
    return assembly.first_by(rows, ["proposal", "task"], F.col("k"))


def last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.tasks(spark, sf_dir).select("proposal", F.col("n").alias("task"), "k", "title")
    return assembly.last_by(rows, ["proposal", "task"], F.col("k"))


def vote_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", "section3_body").when(kind == "signup", "section3_start").when(kind == "view", "toc_or_index").otherwise("other")
    return assembly.majority(P.read(spark, sf_dir, "events").select("user_id", label.alias("label")), ["user_id"])


def wp_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = assembly.company_effort(P.effort(spark, sf_dir), COMPANY)
    info = P.wp_info(spark, sf_dir).filter(F.col("leader") != "S2")
    return assembly.with_info(kept, info, COMPANY).select("proposal", "wp_id", "person_months", "title", "leader", "role", "start", "end")


def task_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = assembly.company_effort(P.effort(spark, sf_dir), COMPANY)
    return assembly.company_tasks(P.tasks(spark, sf_dir), kept, COMPANY).select("proposal", "wp_id", "id", "role")


def deliv_range_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = assembly.attach_deliverables(P.deliverables(spark, sf_dir), P.tasks(spark, sf_dir))
    return met.select("proposal", "wp_id", F.col("deliverable.id").alias("deliverable_id"), "task_id", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model might answer for each customer: a task for each order, some of them without a key, with partners that are
    no list, or no objects; whole answers in a fence, cut off, or with an object around the list."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 6
    text = F.format_string(
        '{"id":"T%d","wp_id":"WP%d","title":"%s","start_month":"M%02d","end_month":%s,"partners":%s%s}', key, F.col("o_custkey"), F.col("o_orderpriority"), key % 12 + 1,
        F.when(kind == 2, "null").when(kind == 4, "12").otherwise('"M14"'), F.when(kind == 0, '"S1"').when(kind == 3, '["S1","S2"]').otherwise("[]"), F.when(kind == 1, "").otherwise(', "description":"a \\"b\\""'),
    )
    orders = P.read(spark, sf_dir, "orders").select("o_custkey", F.struct(key, F.when(kind == 5, "7").otherwise(text).alias("t")).alias("o"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["t"]), ","), F.lit("]"))
    form = F.col("o_custkey") % 5
    lists = orders.groupBy("o_custkey").agg(listed.alias("a"))
    answer = F.when(form == 0, F.concat(F.lit("```json\n"), "a", F.lit("\n```"))).when(form == 1, F.substring("a", F.lit(1), F.length("a") - 1)).when(form == 2, F.concat(F.lit('{"tasks":'), "a", F.lit("}"))).otherwise(F.col("a"))
    return lists.select(F.col("o_custkey").alias("proposal"), answer.alias("answer"))


def answer_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _answers(spark, sf_dir).select("proposal", F.explode(S.parsed_tasks(F.col("answer"))).alias("t"))
    return each.select("proposal", "t.id", "t.wp_id", "t.title", "t.start_month", "t.end_month", F.array_join("t.partners", "+").alias("partners"), "t.description")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = P.lines(spark, sf_dir, int(COMPANY[1:]))  # the company's orders before anything is sorted or numbered
    return assembly.work_packages(P.wp_info(spark, sf_dir, line), P.effort(spark, sf_dir, line), P.tasks(spark, sf_dir, line), P.deliverables(spark, sf_dir, line), COMPANY)


def work_packages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _packages(spark, sf_dir)
    return nested.select("proposal", "wp_id", "title", "leader", "role", "person_months", "start", "end", F.coalesce(F.array_join(F.transform("tasks", lambda t: F.concat(t["id"], F.lit("="), F.coalesce(F.array_join(F.transform(t["deliverables"], lambda d: d["id"]), "+"), F.lit("")))), ","), F.lit("")).alias("tasks"))


def planner_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.planner_buckets(P.wp_info(spark, sf_dir))


def planner_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.planner_tasks(P.tasks(spark, sf_dir))


def planner_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.planner_checklist(assembly.attach_deliverables(P.deliverables(spark, sf_dir), P.tasks(spark, sf_dir)))


def gh_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = P.work_packages(spark, sf_dir).select("proposal", F.col("start").alias("proposal_start")).distinct()
    return payloads.milestones(P.wp_info(spark, sf_dir).join(starts, "proposal"), PLAN)


def _company_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.company_tasks(P.tasks(spark, sf_dir), assembly.company_effort(P.effort(spark, sf_dir), COMPANY), COMPANY)


def gh_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.labels(_company_tasks(spark, sf_dir), PLAN)


def gh_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.issues(_company_tasks(spark, sf_dir), PLAN).withColumn("labels", F.array_join("labels", ","))


def label_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item names its supplier, in either case; the tracker has every third supplier."""
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("s"), F.col("l_suppkey").cast("string"))
    labels = P.read(spark, sf_dir, "lineitem").select(name.alias("name"), F.lit("partner").alias("description"), F.lit("ffffff").alias("color"), "l_orderkey", "l_linenumber")
    remote = P.read(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 3 == 0).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return upserts.labels_to_create(labels, remote, F.struct("l_orderkey", "l_linenumber"))


def milestone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stones = P.read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    remote = P.read(spark, sf_dir, "part").filter(F.col("p_partkey") % 3 == 0).select(F.col("p_name").alias("title"), F.col("p_partkey").alias("number"))
    return upserts.milestone_plan(stones, remote)


def issue_push_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = P.read(spark, sf_dir, "lineitem")
    issues = item.select(F.col("l_suppkey").alias("milestone"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"), F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("external_id"))
    remote = item.filter(F.col("l_returnflag") == "R").select(F.col("l_suppkey").alias("milestone"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"), F.col("l_orderkey").alias("number"), (F.col("l_linestatus") == "O").alias("is_pull_request"))
    return upserts.issue_plan(issues, upserts.existing_issues(remote, F.col("number")), F.col("external_id"))


def issue_push_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.push_counts(issue_push_plan(spark, sf_dir), "milestone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from grantloom.plans import job_queries, messy, proposals

    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in ("queries", "oracle_sql")}
    return own | job_queries.queries() | proposals.queries() | messy.queries()


def oracle_sql() -> dict[str, str]:
    from grantloom.plans import job_queries, messy, proposals
    from grantloom.plans.oracles import ORACLES

    return ORACLES | job_queries.ORACLES | proposals.ORACLES | messy.ORACLES
