"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

The reader checks every record: the member's gzip checksum, the version line, the headers, the length, the end of the
record, and the digests that it names (nothing covers the values of headers outside gzip). After a failed check it searches for the next gzip member or version line, byte by
byte, until a record there passes all checks; the bytes between are reported as a gap with the first failed check. Damage
therefore costs the records that it touches and no others. Memory is bounded by the largest record that passes, whatever
the size of the file or of a member: a length is tried at the place where it ends, and digests are taken in steps, before a
block is brought into memory. So damaged lengths take time in proportion to the file; only lengths that do lead to another
record's end are hashed that far. The search can go back to any place, as files can be read from there again.

A member's content is searched in the same way as it inflates, so one bad record, or damage behind some records, costs
no others of the member; what is lost of it is one gap over the member. Where the gzip checks fail, only records whose
block digest holds are trusted, their headers as little as those outside gzip; others wait for the member's end.

The writer puts each record in a member of its own. Among records with equal payloads of at least min_bytes, the smallest
id is a response, and others revisit it; shorter ones are all responses. Which id that is gets decided on digests and ids
alone; payloads are shuffled once, by both, so that a payload that a third of all rows share is spread over its ids.

A null html is an empty payload, a null url leaves its header out. Rows that repeat the smallest id of a payload revisit
its first row. Rows without id refer to others but are never referred to. An empty table gives no archives and no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from contextlib import closing
from hashlib import sha256
from shutil import copyfileobj
from tempfile import SpooledTemporaryFile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm import files
from grantloom.llm.common import saved, scratch

#: No row can hold more, so a record that claims to be longer is damaged.
MAX_RECORD = 1 << 31
#: Bytes of a member's content that are kept in memory; more lie on disk, without a name.
KEPT = 1 << 24
END = b"\r\n\r\n"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_GZIP, _VERSION, _END = (re.compile(re.escape(x)) for x in (GZIP, VERSION, END))
_EITHER = re.compile(_GZIP.pattern + b"|" + _VERSION.pattern)
_URN = "urn:grantloom:page:"


class Damaged(Exception):
    """A failed check."""


# ---------------------------------------------------------------- writing


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes) -> bytes:
    pressed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pressed.compress(raw) + pressed.flush()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, max_file: int = 1 << 28, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes page_id, url, html as .warc.gz files and returns the manifest, one row per file: path, n_records."""
    folder = folder or scratch(pages.sparkSession, "warc")
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    page_id = pages["page_id"].cast("long")
    # A null id is a key of its own, so that one equality join finds every row.
    key = [F.unhex(F.sha2(html, 256)).alias("digest"), F.coalesce(page_id, F.lit(0).cast("long")).alias("id"), page_id.isNull().alias("no_id")]
    narrow = saved(pages.select(*key, (F.octet_length(html) >= min_bytes).alias("long_enough")), "warc-digests")
    first = narrow.filter("long_enough").groupBy("digest").agg(F.min(F.when(~F.col("no_id"), F.col("id"))).alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull())
    known = narrow.filter("long_enough").join(first, "digest").select("digest", "id", "no_id", "first").distinct()
    # html is shuffled once, by digest and id. That is dealt out here, not by the join, as rows of one digest and id must
    # stay in one task, which Spark's splitting of skewed joins wouldn't keep to.
    names = ["digest", "id", "no_id"]
    rows = pages.select(*key, pages["url"].cast("string").alias("url"), html.alias("html")).repartition(*names).join(known.hint("merge"), names, "left")
    sorted_ = rows.sortWithinPartitions(*names, "url").select(F.when(~F.col("no_id"), F.col("id")).alias("page_id"), "url", "html", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size, done, last = None, "", 0, 0, [], None
        for batch in batches:
            for page_id, url, text, digest, original in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload, digest = text.encode("utf-8", "surrogatepass"), digest.hex()
                # Rows of one digest and id are together in one partition, so the first of them is known here.
                own = original is None or (page_id == original and last != (digest, page_id))
                last = (digest, page_id)
                raw = member(record("response" if own else "revisit", page_id, url, payload, digest, None if own else original, date))
                if out is None or size + len(raw) > max_file:
                    if out is not None:
                        out.close()
                        done.append((path, n))
                    path, n, size = files.fresh_name(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz"), 0, 0
                    out = files.writer(path)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            done.append((path, n))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "n_records"])

    return saved(sorted_.mapInArrow(write, "path string, n_records long"), "warc-manifest")


# ---------------------------------------------------------------- reading


class _File:
    """A file's bytes by place."""

    def __init__(self, source):
        self.source, self.size = source, source.seek(0, 2)

    def read_at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def forget(self, before: int) -> None:
        pass


class _Stream:
    """A window over bytes by place: a read or search near the last one finds them in memory."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step, self.held, self.base, self.last = source, step, b"", 0, False

    def _load(self, at: int, n: int) -> None:
        n = max(n, self.step)
        self.held, self.base = self.source.read_at(at, n), at
        self.last = len(self.held) < n  # nothing follows

    def _holds(self, at: int, n: int) -> bool:
        return self.base <= at and (self.last or at + n <= self.base + len(self.held))

    def bytes(self, at: int, n: int) -> bytes:
        if not self._holds(at, n):
            self._load(at, n)
        return self.held[at - self.base : at - self.base + n]

    def peek(self, at: int, n: int) -> bytes:
        """A few bytes of any place, without moving the window there."""
        return self.bytes(at, n) if self._holds(at, n) else self.source.read_at(at, n)

    def digest(self, begin: int, end: int) -> str:
        hashed = sha256()
        for at in range(begin, end, self.step):
            hashed.update(self.bytes(at, min(self.step, end - at)))
        return hashed.hexdigest()

    def find(self, at: int, mark: re.Pattern[bytes]) -> int | None:
        """The next place, from at on, where a mark of up to seven bytes begins."""
        if not self._holds(at, 7):
            self._load(at, 7)
        while True:
            found = mark.search(self.held, at - self.base)
            if found:
                return self.base + found.start()
            known = self.base + len(self.held)
            at = max(at, known - 6)
            self._load(at, 7)
            if self.base + len(self.held) <= known:
                return None


def _headers(stream: _Stream, at: int) -> tuple[dict[str, str], int]:
    """The headers of the record at a place, and where its block begins. No more is read than up to the first bad line."""
    want = 1 << 12
    while True:
        raw = stream.bytes(at, want)
        cut = raw.find(END)
        lines = (raw[:cut] if cut >= 0 else raw.rpartition(b"\r\n")[0]).split(b"\r\n")
        if not raw.startswith(VERSION):
            raise Damaged("no version line")
        if not all(b":" in line for line in lines[1:]):
            raise Damaged("a header without colon")
        if cut >= 0:
            break
        if len(raw) < want or want > MAX_RECORD:
            raise Damaged("the file ends within a record")
        want *= 4
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return head, at + cut + len(END)


def _record(stream: _Stream, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at a place, checked, and its length. A length is tried at the place where it ends before anything of the
    block is read, digests are taken in steps, and only a block that passes is brought into memory."""
    head, begin = _headers(stream, at)
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in head:
        raise Damaged("no length or type")
    if len(size.lstrip("0")) > 10 or begin - at + int(size) > MAX_RECORD:
        raise Damaged("the record is longer than any row")
    end = begin + int(size)
    mark = stream.peek(end, len(END))
    if mark != END:
        raise Damaged("the file ends within a record" if len(mark) < len(END) else "the record doesn't end where its length says")
    for name, start in (("warc-block-digest", begin), ("warc-payload-digest", _payload_at(stream, head, begin, end))):
        if head.get(name, "").startswith("sha256:") and start is not None and stream.digest(start, end) != head[name][7:].lower():
            raise Damaged(f"{name} differs")
    return head, stream.bytes(begin, end - begin), end + len(END) - at


def _payload_at(stream: _Stream, head: dict[str, str], begin: int, end: int) -> int | None:
    """Where the payload of a block begins, as payload_of() has it."""
    if head["warc-type"] == "revisit":
        return None
    if "application/http" not in head.get("content-type", ""):
        return begin
    cut = stream.find(begin, _END)
    return end if cut is None or cut + len(END) > end else cut + len(END)


def payload_of(head: dict[str, str], block: bytes) -> bytes | None:
    """What an HTTP response carries; a record that isn't one is its own payload, and a revisit has none."""
    if head["warc-type"] == "revisit":
        return None
    if "application/http" not in head.get("content-type", ""):
        return block
    cut = block.find(END)
    return block[cut + len(END) :] if cut >= 0 else b""


class _Member:
    """A gzip member's content by place, as it inflates; what lies before forget() is let go, and what exceeds KEPT lies on
    disk. error: the gzip check that failed, if one did, once all has been read."""

    def __init__(self, stream: _Stream, at: int):
        self.stream, self.at, self.inflate, self.error = stream, at, zlib.decompressobj(31), ""
        self.kept, self.first, self.size = SpooledTemporaryFile(KEPT), 0, 0

    def place(self) -> int:
        """How far the file has been read for this."""
        left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return self.at - len(left)

    def read_at(self, at: int, n: int) -> bytes:
        self.kept.seek(0, 2)
        while self.size < at + n:
            content = self.read(1 << 20)
            if not content:
                break
            self.kept.write(content)
            self.size += len(content)
        self.kept.seek(max(0, at - self.first))
        return self.kept.read(n)

    def forget(self, before: int) -> None:
        """Lets go of what lies before a place, once that is more than what lies behind it."""
        if before - self.first > max(KEPT, self.size - before):
            self.kept.seek(before - self.first)
            rest = SpooledTemporaryFile(KEPT)
            copyfileobj(self.kept, rest, 1 << 20)
            self.kept.close()
            self.kept, self.first = rest, before

    def read(self, n: int) -> bytes:
        while not self.inflate.eof and not self.error:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.stream.bytes(self.at, 1 << 16)
                self.at += len(raw)
            if not raw:
                self.error = "the file ends within a member"
                break
            before = self.inflate.copy()
            try:
                content = self.inflate.decompress(raw, n)
            except zlib.error as e:
                self.error = f"gzip: {e}"
                self.at -= len(raw)
                return self._up_to_damage(before, raw)
            if content:
                return content
        return b""

    def _up_to_damage(self, inflate, raw: bytes) -> bytes:
        """What the bytes before the failed check hold: zlib gives nothing of a call that fails."""
        content = bytearray()
        try:
            for k in range(len(raw)):
                self.at += 1
                content += inflate.decompress(raw[k : k + 1])
        except zlib.error:
            pass
        self.inflate = zlib.decompressobj(31)  # nothing is left over
        return bytes(content)

    def close(self) -> None:
        self.kept.close()


def _within(member: _Member, lost: list[str]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a member that can be trusted; lost: gets the reason for each stretch of its content that can't."""
    stream, at, broken = _Stream(member), 0, False
    with SpooledTemporaryFile(KEPT) as waiting, closing(member):
        while stream.bytes(at, 1):
            try:
                head, block, size = _record(stream, at)
            except Damaged as e:
                if not broken:
                    lost.append(str(e).replace("the file", "the member"))
                broken = True
                following = stream.find(at + 1, _VERSION)
                if following is None:
                    break
                at = following
                member.forget(at)
                continue
            broken = False
            if head.get("warc-block-digest", "").startswith("sha256:"):
                yield head, block
            else:
                pickle.dump((head, block), waiting)
            at += size
            member.forget(at)
        while not member.error and not member.inflate.eof:
            member.read(1 << 20)
        held = waiting.tell()
        if held and member.error:
            lost.append(member.error)
        waiting.seek(0)
        while not member.error and waiting.tell() < held:
            yield pickle.load(waiting)


def _next(stream: _Stream, at: int, plain_from: int) -> int | None:
    """The next place, from at on, where a member or, from plain_from on, a version line may begin."""
    if at < plain_from:
        place = stream.find(at, _GZIP)
        if place is not None and place < plain_from:
            return place
        at = plain_from
    return stream.find(at, _EITHER)


def salvage(source) -> Iterator[tuple]:
    """("record", begin, end, head, block) for each record that passes all checks, and ("gap", begin, end, reason) for the bytes between.

    A member's records begin where it does and end where the file had been read to; so do its gaps."""
    stream, at, gap, reason = _Stream(_File(source)), 0, None, ""
    while stream.bytes(at, 1):
        plain_from, failed, lost, end = 0, "", [], at
        if stream.bytes(at, 3) == GZIP:
            member, last = _Member(stream, at), None
            for head, block in _within(member, lost):
                if gap is not None:
                    yield "gap", gap, at, reason
                    gap = None
                if last is not None:
                    yield "record", at, member.place(), *last
                last = head, block
            end, failed = member.place(), member.error
            if last is not None:
                yield "record", at, end, *last
                plain_from = end  # a version line within a member is no second record
            if not failed and lost and last is not None:
                yield "gap", at, end, lost[0]
            elif not failed and lost:
                failed = lost[0]
                plain_from = end
        else:
            try:
                head, block, size = _record(stream, at)
            except Damaged as e:
                failed = str(e)
            else:
                if gap is not None:
                    yield "gap", gap, at, reason
                    gap = None
                end = at + size
                yield "record", at, end, head, block
        if failed:
            if gap is None:
                gap, reason = at, failed
            following = _next(stream, at + 1, plain_from)
            if following is None:
                break
            at = following
            continue
        at = end
    if gap is not None:
        yield "gap", gap, stream.source.size, reason


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(_URN)
    return int(text) if text.lstrip("-").isdigit() else None


READ = "kind string, path string, begin long, end long, reason string, record_type string, record_id string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of two kinds from the files that manifest.path names: record, and gap (begin, end: bytes of the file; reason).

    Of a revisit, payload_bytes and payload_digest are the original's, as its record states them, and payload is null.
    with_payload: otherwise payload is null throughout."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in READ.split(", ")]
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.seekable(path) as source:
                    for kind, begin, end, *rest in salvage(source):
                        if kind == "gap":
                            rows.append((kind, path, begin, end, rest[0], *[None] * 8))
                        else:
                            head, block = rest
                            payload = payload_of(head, block)
                            if payload is None:
                                http = block.split(END)[0].lower().split(b"\r\ncontent-length:")
                                n = http[1].split(b"\r\n")[0].strip() if len(http) > 1 else b""
                                length, digest = int(n) if n.isdigit() else None, head.get("warc-payload-digest", "").rpartition(":")[2] or None
                            else:
                                length, digest = len(payload), sha256(payload).hexdigest()
                            rows.append((kind, path, begin, end, None, head["warc-type"], head.get("warc-record-id"), _page(head.get("warc-record-id")), head.get("warc-target-uri"), _page(head.get("warc-refers-to")), length, digest, payload if with_payload else None))
                            size += len(block) if with_payload else 0
                        if len(rows) >= 5000 or size > 1 << 24:
                            yield out()
                            rows.clear()
                            size = 0
        if rows:
            yield out()

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, READ)
