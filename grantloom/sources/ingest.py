"""Where documents, tables and earlier results come from, and where results go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "proposal string, page_idx int, text string, width double, height double, images array<struct<width:double,height:double>>"
RAW_TABLES = "proposal string, page_idx int, table_idx int, rows array<array<string>>, extractor string"
TASKS = "proposal string, id string, wp_id string, title string, start_month string, end_month string, partners array<string>, description string"
#: What stage 1 leaves: typed tables, warnings, and work packages that failed.
TABLES = {
    "wp_info": "proposal string, wp_id string, title string, leader string, pms double, start string, end string",
    "effort": "proposal string, company string, wp_id string, person_months double",
    "deliverables": "proposal string, page_idx int, table_idx int, row_ord int, ids array<string>, name string, description string, wp string, lead string, type string, dissemination string, months array<string>",
    "warnings": "proposal string, warning string",
    "failed_wps": "proposal string, wp_id string, error string",
}
EXTRACTED = "path string, page_idx int, text string, error string"

#: What an upload may say it is.
PDF_TYPES = ("application/pdf", "application/octet-stream")


def pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages that were extracted before, with a declared schema."""
    return spark.read.schema(PAGES).format(kind).load(path)


def raw_tables(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW_TABLES).format(kind).load(path)


def is_pdf(mime: Column, name: Column) -> Column:
    return F.coalesce(mime.isin(*PDF_TYPES), F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def extracted_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of documents from spark.read.format("binaryFile"), through any extractor of texts from bytes.

    A document that the extractor can't read is a row with its error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, k, text or "", None) for k, text in enumerate(extract(bytes(content)))]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_idx", "text", "error"]).astype({"page_idx": "Int32"})

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def with_column_names(tables: DataFrame) -> DataFrame:
    """Tables of the structure extractor: their column names (header) become the first row, missing cells are empty."""
    rows = F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    return tables.select("proposal", "page_idx", "table_idx", F.concat(F.array("header"), rows).alias("rows"), F.lit("structure").alias("extractor"))


def save_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from a checkpoint; fields that an older one lacks are empty."""
    found = spark.read.schema(TASKS).json(path)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "start_month", "end_month", "description")}
    return found.withColumns(blank | {"partners": F.coalesce("partners", F.array().cast("array<string>"))})


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A checkpoint of typed tables, one folder for each of TABLES; a folder that an older one lacks is empty."""
    found = {}
    for name, schema in TABLES.items():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        found[name] = spark.read.schema(schema).json(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    return found


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name in TABLES:
        if name in tables:
            save_checkpoint(tables[name], f"{path}/{name}")


def page_safe(native: DataFrame, fallback: DataFrame) -> DataFrame:
    """Tables of the structure extractor where it read a page, and the native ones of pages that it failed on or found
    nothing on. fallback: proposal, page_idx, tables (an array; null: failed); native: proposal, page_idx, tables."""
    both = native.select("proposal", "page_idx", F.col("tables").alias("own")).join(fallback.select("proposal", "page_idx", F.col("tables").alias("other")), ["proposal", "page_idx"], "left")
    other = F.size(F.coalesce("other", F.array().cast("array<array<array<string>>>"))) > 0
    return both.select("proposal", "page_idx", F.when(other, F.col("other")).otherwise(F.col("own")).alias("tables"), F.when(other, "structure").otherwise("native").alias("extractor"))


def as_json(work_packages: DataFrame) -> DataFrame:
    """A JSON array of work packages for each proposal, in the order of their ids."""
    rows = F.array_sort(F.collect_list(F.struct("wp_id", F.to_json(F.struct(*[c for c in work_packages.columns if c != "proposal"])).alias("json"))))
    return work_packages.groupBy("proposal").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["json"]), ","), F.lit("]")).alias("json"))


def push(plan: DataFrame, send: Callable[[dict], None]) -> None:
    """Sends what a plan would create, partition by partition. A task that is repeated sends again: send must be idempotent."""

    def each(rows: Iterator) -> None:
        for row in rows:
            send(row.asDict(recursive=True))

    plan.filter(F.col("action") == "create").foreachPartition(each)
