"""Scans by shares of pages, kept conversions, and sinks whose tasks fail and are repeated."""

import json
import os
import uuid

import pytest

from grantloom.sources import documents, ingest, planner, tracker


class Lines:
    """A document whose pages are read one by one."""

    def __init__(self, raw):
        if raw.startswith(b"\xff"):
            raise ValueError("no document")
        self.pages = raw.decode().split("\f")

    def __len__(self):
        return len(self.pages)

    def __getitem__(self, k):
        if self.pages[k] == "torn":
            raise ValueError("torn page")
        return self.pages[k]


def shown(rows, whole=True):
    return sorted((os.path.basename(r["path"]), r["page_idx"], r["text"], r["error"]) for r in rows if whole or r["error"] is None)


def test_document_scan_equals_extraction(spark, tmp_path):
    (tmp_path / "in" / "more").mkdir(parents=True)
    (tmp_path / "in" / "long.pdf").write_bytes("\f".join(f"page {k} " + "x" * 50 for k in range(101)).encode())
    (tmp_path / "in" / "more" / "short.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "in" / "blank.pdf").write_bytes(b"\f")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    want = shown(ingest.extracted_pages(found, lambda raw: list(Lines(raw))).collect())
    spark.dataSource.register(documents.document_source(Lines))
    for size, tasks in ((1000, 8), (10**9, 3), (1, None)):
        scan = spark.read.format("documents").option("bytesPerTask", size).load(f"file://{tmp_path}/in")
        assert shown(scan.collect()) == want
        assert tasks is None or scan.rdd.getNumPartitions() == tasks
    (tmp_path / "in" / "bad.pdf").write_bytes(b"\xff" * 5000)
    (tmp_path / "in" / "torn.pdf").write_bytes(b"a\ftorn\fb")
    got = spark.read.format("documents").option("bytesPerTask", 1000).load(str(tmp_path / "in")).collect()
    assert [x for x in shown(got) if x[3]] == [("bad.pdf", None, None, "ValueError: no document"), ("torn.pdf", 1, None, "ValueError: torn page")]
    assert shown(got, whole=False) == sorted([*want, ("torn.pdf", 0, "a", None), ("torn.pdf", 2, "b", None)])


def test_conversions_are_kept_by_content(spark, tmp_path):
    calls, source, memo = tmp_path / "calls", tmp_path / "in", str(tmp_path / "memo")
    calls.mkdir()
    source.mkdir()

    def convert(raw, first, last, ocr):
        (calls / uuid.uuid4().hex).write_bytes(raw)
        if raw == b"bad":
            raise ValueError("no document")
        return raw.decode().split("\f")[first or 0 : last] if raw != b"-" else []

    def run(**options):
        before = {x.name for x in calls.iterdir()}
        got = documents.memoised_pages(spark.read.format("binaryFile").load(str(source)), convert, memo, **options)
        rows = sorted((os.path.basename(r["path"]), r["page_idx"], r["text"], r["error"]) for r in got.collect())
        return rows, sorted(x.read_bytes() for x in calls.iterdir() if x.name not in before)

    for name, raw in (("a", b"one\ftwo"), ("b", b"one\ftwo"), ("c", b"three"), ("d", b"-"), ("e", b"bad")):
        (source / name).write_bytes(raw)
    rows = [("a", 0, "one", None), ("a", 1, "two", None), ("b", 0, "one", None), ("b", 1, "two", None), ("c", 0, "three", None), ("e", None, None, "ValueError: no document")]
    assert run() == (rows, [b"-", b"bad", b"one\ftwo", b"three"])
    assert run() == (rows, [b"bad"])  # an error is tried again
    (source / "e").unlink()
    (source / "c").write_bytes(b"four")
    changed = [("c", 0, "four", None) if r[0] == "c" else r for r in rows[:-1]]
    assert run() == (changed, [b"four"])
    assert run() == (changed, [])
    assert run(first=1) == ([("a", 1, "two", None), ("b", 1, "two", None)], [b"-", b"four", b"one\ftwo"])
    assert run(ocr=True)[1] == [b"-", b"four", b"one\ftwo"]
    # A batch whose write didn't end doesn't count.
    for batch in (tmp_path / "memo").glob("batch=*"):
        (batch / "_SUCCESS").unlink()
    assert run() == (changed, [b"-", b"four", b"one\ftwo"])


class FolderTracker:
    """A tracker in a folder. The first creation of what is named in `breaks` answers with an error after the thing is there."""

    def __init__(self, folder):
        self.folder = folder

    def _all(self):
        return [json.loads((self.folder / x).read_text()) for x in os.listdir(self.folder) if x.endswith(".json")]

    def find(self, kind, external_id):
        return next((x["number"] for x in self._all() if (x["kind"], x["external_id"]) == (kind, external_id)), None)

    def create(self, kind, external_id, title, body, parent):
        if kind == "label" and any(x["kind"] == "label" and x["title"].lower() == title.lower() for x in self._all()):
            raise tracker.Refused(422)
        if title == "forbidden":
            raise tracker.Refused(403)
        number = uuid.uuid4().int % 10**9
        (self.folder / f"{uuid.uuid4().hex}.json").write_text(json.dumps({"kind": kind, "external_id": external_id, "title": title, "body": body, "parent": parent, "number": number}))
        if (self.folder / f"break-{external_id}").exists():
            (self.folder / f"break-{external_id}").unlink()
            raise ConnectionError("lost the answer")
        return number


def test_tracker_creates_once(spark, tmp_path):
    folder = tmp_path / "tracker"
    folder.mkdir()
    receipts = f"file://{tmp_path}/receipts"
    spark.dataSource.register(tracker.tracker_sink(lambda: FolderTracker(folder), f"file://{tmp_path}/journal", receipts))

    def write(rows):
        spark.createDataFrame(rows, tracker.ROWS).repartition(3).write.format("tracker").mode("append").save()

    milestones = [("milestone", f"M{k}", None, f"WP{k}", None) for k in range(4)]
    issues = [("issue", f"T{k}", f"M{k % 4}", f"Task {k}", '{"labels": ["x"]}') for k in range(12)]
    write(milestones)
    (folder / "break-T5").touch()
    (folder / "break-T8").touch()
    for _ in range(2):  # the task breaks off after T5 or T8 was made, and its number isn't known
        with pytest.raises(Exception, match="lost the answer"):
            write(issues)
            write(issues)
    write(issues)
    write(issues)
    made = FolderTracker(folder)._all()
    assert sorted(x["external_id"] for x in made) == sorted(r[1] for r in milestones + issues)
    numbers = {x["external_id"]: x["number"] for x in made}
    assert all(x["parent"] == numbers[f"M{int(x['external_id'][1:]) % 4}"] and x["body"] == {"labels": ["x"]} for x in made if x["kind"] == "issue")
    got = tracker.pushed(spark, receipts).collect()
    assert all(r["number"] == numbers[r["external_id"]] for r in got) and {r["external_id"] for r in got} == set(numbers)
    assert {r["outcome"] for r in got if r["external_id"] in ("T5", "T8")} <= {"found", "known"}
    with pytest.raises(Exception, match="no parent M9"):
        write([("issue", "T99", "M9", "x", None)])
    assert "T99" not in {x["external_id"] for x in FolderTracker(folder)._all()}


def test_labels_that_are_there_count_as_present(spark, tmp_path):
    folder = tmp_path / "tracker"
    folder.mkdir()
    receipts = f"file://{tmp_path}/receipts"
    spark.dataSource.register(tracker.tracker_sink(lambda: FolderTracker(folder), f"file://{tmp_path}/journal", receipts, "labels"))
    frame = spark.createDataFrame([("label", x, None, x, None) for x in ("Role", "task")], tracker.ROWS)
    for _ in range(2):
        frame.coalesce(1).write.format("labels").mode("append").save()
    assert sorted((r["external_id"], r["outcome"]) for r in tracker.pushed(spark, receipts).collect()) == [("Role", "created"), ("Role", "present"), ("task", "created"), ("task", "present")]
    with pytest.raises(Exception, match="answered 403"):
        spark.createDataFrame([("label", "f", None, "forbidden", None)], tracker.ROWS).write.format("labels").mode("append").save()


class FolderPlanner:
    def __init__(self, folder):
        self.folder = folder

    def _make(self, kind, **what):
        name = uuid.uuid4().hex
        (self.folder / f"{name}.json").write_text(json.dumps({"kind": kind, "id": name, **what}))
        return name

    def create_plan(self, title):
        return self._make("plan", title=title)

    def create_bucket(self, plan_id, name):
        return self._make("bucket", title=name, plan=plan_id)

    def create_task(self, plan_id, bucket_id, title, **dates):
        name = self._make("task", title=title, bucket=bucket_id, **dates)
        if (self.folder / f"break-{title}").exists():
            (self.folder / f"break-{title}").unlink()
            raise ConnectionError("lost the answer")
        return name

    def details_tag(self, task_id):
        tag = self.folder / f"tag-{task_id}"
        return tag.read_text() if tag.exists() else "0"

    def update_details(self, task_id, tag, **details):
        self._make("details", task=task_id, tag=tag, title=str(details))


class FindingPlanner(FolderPlanner):
    def find(self, kind, external_id):
        every = [json.loads((self.folder / x).read_text()) for x in os.listdir(self.folder) if x.endswith(".json")]
        return next((x["id"] for x in every if x["kind"] == kind and x["title"].endswith(external_id)), None)


def test_planner_pushes_once_with_a_journal(spark, tmp_path):
    folder, journal = tmp_path / "planner", f"file://{tmp_path}/journal"
    folder.mkdir()
    buckets = spark.createDataFrame([(1, "b1", "WP1"), (2, "b1", "WP1")], "proposal long, external_id string, name string")
    tasks = spark.createDataFrame([(p, f"t{k}", f"do t{k}", "b1", "2025-01-01", None, "text") for p in (1, 2) for k in range(3)], "proposal long, external_id string, title string, bucket_external_id string, start_date_time string, due_date_time string, description string")
    plans = planner.payload(buckets, tasks, spark.createDataFrame([(1, "t1", "first")], "proposal long, task_external_id string, title string"))
    (folder / "break-do t1").touch()
    frame = planner.pushed(plans.coalesce(1), lambda: FindingPlanner(folder), "Plan", journal)
    first = frame.collect()
    assert [r["error"] for r in first if r["error"]] == ["ConnectionError: lost the answer"]
    second, third = frame.collect(), frame.collect()
    assert sorted(second) == sorted(third) and not any(r["error"] for r in second)
    kinds = sorted(json.loads(x.read_text())["kind"] for x in folder.glob("*.json"))
    assert kinds == ["bucket"] * 2 + ["details"] * 6 + ["plan"] * 2 + ["task"] * 6
    # A client that can't look for what it has made doesn't make it twice.
    (folder / "break-do t1").touch()
    lost = planner.pushed(plans.coalesce(1), lambda: FolderPlanner(folder), "Plan", journal + "-2")
    lost.collect()
    assert [r["error"] for r in lost.collect() if r["error"]] == ["RuntimeError: task t1 may be there from a push that broke off"]


def test_details_are_sent_again_with_a_changed_tag():
    class Client:
        def __init__(self, changes):
            self.changes, self.tag, self.sent = changes, 0, []

        def details_tag(self, task_id):
            return str(self.tag)

        def update_details(self, task_id, tag, **details):
            if self.changes:
                self.changes -= 1
                self.tag += 1
            if tag != str(self.tag):
                raise planner.TagChanged
            self.sent.append((task_id, tag, details))

    client = Client(3)
    planner.updated_details(client, "t", {"description": "x"})
    assert client.sent == [("t", "3", {"description": "x"})]
    with pytest.raises(planner.TagChanged):
        planner.updated_details(Client(planner.TAG_TRIES), "t", {"description": "x"})
