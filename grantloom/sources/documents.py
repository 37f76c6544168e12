"""Documents as pages: a scan that splits long documents over tasks, and conversions that are kept by content."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from grantloom.sources import files
from grantloom.sources.ingest import EXTRACTED

#: A document of more bytes than this is several tasks' work.
BYTES_A_TASK = 4 << 20
#: Opens a document: its pages' texts by place, each read only when it is asked for.
Opener = Callable[[bytes], Sequence[str]]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Share(InputPartition):
    """One of the equal shares of a document's pages."""

    path: str
    share: int
    shares: int


class DocumentReader(DataSourceReader):
    def __init__(self, folder: str, bytes_a_task: int, opener: Opener):
        self.folder, self.bytes_a_task, self.opener = folder, bytes_a_task, opener

    def partitions(self) -> list[Share]:
        """By the files' sizes alone: nothing is read to plan the scan."""
        system, path = located(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        sized = [(x.path, max(1, -(-x.size // self.bytes_a_task))) for x in found if x.type == fs.FileType.File]
        return [Share(name, k, n) for name, n in sorted(sized) for k in range(n)]

    def read(self, part: Share) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """The share's pages; a document that can't be opened is one row with its error, and a page that can't be read another."""
        system, _ = located(self.folder)
        try:
            with system.open_input_file(part.path) as file:
                pages = self.opener(file.read())
            low, high = (k * len(pages) // part.shares for k in (part.share, part.share + 1))
        except Exception as e:
            if part.share == 0:
                yield part.path, None, None, f"{type(e).__name__}: {e}"
            return
        for k in range(low, high):
            try:
                yield part.path, k, pages[k] or "", None
            except Exception as e:
                yield part.path, k, None, f"{type(e).__name__}: {e}"


def document_source(opener: Opener, name: str = "documents") -> type[DataSource]:
    """spark.dataSource.register(document_source(opener)); spark.read.format("documents").option("bytesPerTask", n).load(path)

    A file is opened by each of its shares, and a share reads its own pages only."""

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return EXTRACTED

        def reader(self, schema) -> DataSourceReader:
            return DocumentReader(self.options["path"], int(self.options.get("bytesPerTask", BYTES_A_TASK)), opener)

    return Documents


# ---------------------------------------------------------------- conversions that are kept

#: What one is known by, besides the bytes: the pages asked for (null: from the first, to the last) and whether images are read.
KEY = ["digest", "first", "last", "ocr"]
_KEPT = "digest string, first int, last int, ocr boolean, page_idx int, text string, error string"


def _kept(spark, memo: str) -> DataFrame:
    """Pages of all batches whose write has ended; of a conversion that several batches have the first batch's."""
    whole = [f"{memo}/{x}" for x in files.names(spark, memo) if x.startswith("batch=") and files.committed(spark, f"{memo}/{x}")]
    if not whole:
        return spark.createDataFrame([], _KEPT + ", batch string")
    every = spark.read.schema(_KEPT + ", batch string").option("basePath", memo).parquet(*whole)
    right = every.filter(F.col("error").isNull())
    first = right.groupBy(*KEY).agg(F.min("batch").alias("batch"))
    return right.join(first, [*[right[c].eqNullSafe(first[c]) for c in KEY], right["batch"] == first["batch"]], "left_semi")


def memoised_pages(documents: DataFrame, convert: Callable[[bytes, int | None, int | None, bool], list[str]], memo: str, first: int | None = None, last: int | None = None, ocr: bool = False) -> DataFrame:
    """path, page_idx, text, error of documents (path, content, as of the binaryFile format).

    A conversion is known by the document's SHA-256, the range of pages and ocr. Those that the memo (a folder) lacks are
    made, once for all copies of a document, and added as a batch of their own, which counts when its write has ended; if
    none is lacking nothing is converted or written. Errors are rows and are tried again the next time."""
    spark = documents.sparkSession
    key = {"first": F.lit(first).cast("int"), "last": F.lit(last).cast("int"), "ocr": F.lit(ocr)}
    batch = uuid.uuid4().hex
    digests = f"{memo}/runs/{batch}"
    documents.select("path", F.sha2("content", 256).alias("digest")).write.parquet(digests)
    asked = spark.read.schema("path string, digest string").parquet(digests).withColumns(key)
    kept = _kept(spark, memo)
    lacking = asked.join(kept, [asked[c].eqNullSafe(kept[c]) for c in KEY], "left_anti").groupBy("digest").agg(F.min("path").alias("path"))
    failed = spark.createDataFrame([], _KEPT)
    if lacking.limit(1).count():

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in batches:
                for digest, content in zip(some["digest"], some["content"], strict=True):
                    try:
                        # A document without pages has one row without a page, so that it is known.
                        rows = [(k, text or "", None) for k, text in enumerate(convert(bytes(content), first, last, ocr), first or 0)] or [(None, None, None)]
                    except Exception as e:
                        rows = [(None, None, f"{type(e).__name__}: {e}")]
                    yield pd.DataFrame([(digest, first, last, ocr, *row) for row in rows], columns=[x.split()[0] for x in _KEPT.split(", ")]).astype({"first": "Int32", "last": "Int32", "page_idx": "Int32"})

        made = documents.select("path", "content").join(lacking, "path").select("digest", "content").mapInPandas(run, _KEPT)
        made.write.parquet(f"{memo}/batch={batch}")
        kept = _kept(spark, memo)
        failed = spark.read.schema(_KEPT).parquet(f"{memo}/batch={batch}").filter(F.col("error").isNotNull())
    found = kept.select(*failed.columns).unionByName(failed)
    both = asked.join(found, [asked[c].eqNullSafe(found[c]) for c in KEY])
    return both.filter(F.col("page_idx").isNotNull() | F.col("error").isNotNull()).select("path", "page_idx", "text", "error")
