"""What the operators of this subpackage share: the shared folder, rows of text as bytes, and hashes of words."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes (\x20 and \x09-\x0D); all of them are ASCII, so bytes.split() agrees.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

_run: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This run's folder below the one the cluster names in spark.checkpoint.dir; one of our own only where that is unset and
    all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _run.setdefault("own", "file://" + tempfile.mkdtemp(prefix="grantloom-"))
    key = f"{spark.sparkContext.applicationId} {base}"
    if key not in _run:
        root = _run[key] = f"{base.rstrip('/')}/grantloom-{uuid.uuid4().hex[:12]}"
        atexit.register(lambda: _quietly(remove, spark, root))
    return _run[key]


def _quietly(f, *args) -> None:
    try:
        f(*args)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
        pass


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in there.listStatus(where)] if there.exists(where) else []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: a Parquet table in the shared folder, which outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(*frames: DataFrame) -> None:
    """Deletes tables written by saved() that nothing reads any more."""
    for df in frames:
        root = _plain(shared_root(df.sparkSession))
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if _plain(path).startswith(root):
                remove(df.sparkSession, path)


def _plain(uri: str) -> str:
    return re.sub("^file:/+", "/", uri)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(text: Column) -> Column:
    """The words of a text, as an array (null: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


# ---------------------------------------------------------------- what workers keep

#: How each kind of things that a worker keeps between tasks is let go of.
_let_go: dict[str, Callable[[], None]] = {}
_kept = {"kind": ""}


def keeps(kind: str, let_go: Callable[[], None]) -> None:
    """Names things that tasks leave in their worker for the next task. let_go: how they go."""
    _let_go[kind] = let_go


def only(kind: str) -> None:
    """For the beginning of a task: its worker keeps one kind of things at a time. Spark uses a worker again in all of a run's
    steps, and an executor's memory has to hold what its workers keep."""
    if _kept["kind"] != kind:
        _kept["kind"] = kind
        for name, let_go in _let_go.items():
            if name != kind:
                let_go()
        gc.collect()
        pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- texts as bytes


def texts_of(array: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each row's text in UTF-8; null counts as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A text is split in pieces of about this many bytes, so that the lists of its words don't grow with it.
PIECE = 1 << 20
#: Hashes that a worker keeps, of words up to so many bytes.
KEPT_WORDS, KEPT_BYTES = 300_000, 64


class _Digests(dict):
    """The first 8 bytes of each word's BLAKE2b digest; words repeat, so those met lately are kept."""

    def __missing__(self, word: bytes) -> bytes:
        found = blake2b(word, digest_size=8).digest()
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


_digests = _Digests()
_powers = {}
keeps("digests", lambda: (_digests.clear(), _powers.clear()))


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, inverse))
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pieces_of(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end where a word does; most texts are one."""
    at = 0
    while len(text) - at > 2 * PIECE:
        gap = _SPACE.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def word_hashes(text: bytes, fold: bool = False) -> np.ndarray:
    """A 64-bit hash for each word of a text; fold: A-Z count as a-z. Words that differ collide by chance only."""
    found = [hashes_of((x.lower() if fold else x).split()) for x in pieces_of(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_digests.__getitem__, words)), np.uint64)


def run_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n consecutive words. Equal runs agree; a power series modulo 2**64 can also make runs agree that
    differ, so this finds candidates and settles nothing. base: an odd number."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words) + 1, np.uint64(base))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + np.uint64(n))
