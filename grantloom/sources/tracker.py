"""An issue tracker as a sink: labels, milestones and issues are created once, whatever is repeated.

A journal in a shared folder has an entry for each thing by its kind and external id. An entry is written before the thing
is created (that it will be) and after (its number). A task that runs again, or a second write of the same rows, finds the number.
If it finds the intention alone, the thing may or may not be there, so the tracker is asked for it before anything is created.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from grantloom.sources import files
from grantloom.sources.documents import located

#: Fixed value: the tracker's answer to a label that somebody else has just made.
PRESENT = 422
ROWS = "kind string, external_id string, parent_external_id string, title string, body string"
RECEIPTS = "kind string, external_id string, number long, outcome string"


class Refused(Exception):
    """An answer that is no success."""

    def __init__(self, status: int):
        super().__init__(f"the service answered {status}")
        self.status = status


class Tracker(Protocol):
    """A client. find gives the number of what has the external id, or None; create gives the new thing's number (a label has none)."""

    def find(self, kind: str, external_id: str) -> int | None: ...
    def create(self, kind: str, external_id: str, title: str, body: dict, parent: int | None) -> int | None: ...


class Journal:
    """Entries by key in a folder, a small file each; an entry is replaced as a whole."""

    def __init__(self, folder: str):
        self.system, self.folder = located(folder)
        self.system.create_dir(self.folder, recursive=True)

    def _file(self, key: tuple[str, ...]) -> str:
        return f"{self.folder}/{sha256(json.dumps(key).encode()).hexdigest()}.json"

    def get(self, key: tuple[str, ...]) -> dict | None:
        name = self._file(key)
        if self.system.get_file_info(name).type != fs.FileType.File:
            return None
        with self.system.open_input_stream(name) as file:
            return json.loads(file.read())

    def put(self, key: tuple[str, ...], entry: dict) -> None:
        name = self._file(key)
        part = f"{name}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as file:
            file.write(json.dumps(entry).encode())
        self.system.move(part, name)

    def once(self, key: tuple[str, ...], create: Callable[[], object], find: Callable[[], object | None]) -> tuple[object, str]:
        """What a thing is known by, and whether it was created now, was known, or was found after a try that broke off."""
        entry = self.get(key)
        if entry and "made" in entry:
            return entry["made"], "known"
        found = find() if entry else None
        if not entry:
            self.put(key, {"begun": True})
        made = create() if found is None else found
        self.put(key, {"made": made})
        return made, "created" if found is None else "found"


@dataclass
class Receipt(WriterCommitMessage):
    """What a task has pushed: kind, external id, number, outcome."""

    rows: list[tuple[str, str, int | None, str]] = field(default_factory=list)


class TrackerWriter(DataSourceWriter):
    def __init__(self, connect: Callable[[], Tracker], journal: str, receipts: str):
        self.connect, self.journal, self.receipts = connect, journal, receipts

    def write(self, iterator: Iterator[Row]) -> Receipt:
        client, journal, done = self.connect(), Journal(self.journal), Receipt()
        for row in iterator:
            number, outcome = self._pushed(client, journal, row)
            done.rows.append((row["kind"], row["external_id"], number, outcome))
        return done

    def _pushed(self, client: Tracker, journal: Journal, row: Row) -> tuple[int | None, str]:
        parent = journal.get(("milestone", row["parent_external_id"])) if row["parent_external_id"] else {}
        if parent is None or row["parent_external_id"] and "made" not in parent:
            raise ValueError(f"no parent {row['parent_external_id']} for {row['external_id']}")
        create = lambda: client.create(row["kind"], row["external_id"], row["title"], json.loads(row["body"] or "{}"), parent.get("made"))
        if row["kind"] != "label":
            return journal.once((row["kind"], row["external_id"]), create, lambda: client.find(row["kind"], row["external_id"]))
        try:  # a label's name is its key in the tracker itself
            return create(), "created"
        except Refused as answer:
            if answer.status != PRESENT:
                raise
            return None, "present"

    def commit(self, messages: list[Receipt | None]) -> None:
        """The numbers of everything that this write pushed, as one file of lines."""
        system, folder = located(self.receipts)
        system.create_dir(folder, recursive=True)
        names = [x.split()[0] for x in RECEIPTS.split(", ")]
        with system.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json") as file:
            for row in (row for message in messages if message for row in message.rows):
                file.write(json.dumps(dict(zip(names, row, strict=True))).encode() + b"\n")

    def abort(self, messages: list[Receipt | None]) -> None:
        """What was created stays, and the journal knows it."""


def tracker_sink(connect: Callable[[], Tracker], journal: str, receipts: str, name: str = "tracker") -> type[DataSource]:
    """spark.dataSource.register(tracker_sink(...)); rows(...).write.format("tracker").mode("append").save()

    Milestones are written before the issues that name them as parents, in a write of their own."""

    class TrackerSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROWS

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return TrackerWriter(connect, journal, receipts)

    return TrackerSink


def pushed(spark: SparkSession, receipts: str) -> DataFrame:
    """The receipts of all writes; a thing that several pushed has a row for each."""
    return spark.read.schema(RECEIPTS).json(receipts) if files.exists(spark, receipts) else spark.createDataFrame([], RECEIPTS)
