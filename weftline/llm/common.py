"""Shared helpers: written intermediates, batch reading and the word/shingle kernel."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

np.seterr(over="ignore")

#: Bytes of text that a kernel call works on at once; bounds a Python worker's memory.
BATCH_BYTES = 1_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Also ASCII punctuation and control characters.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE = (np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: The byte values with A-Z mapped to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in one process, as in tests, a temporary one.

    Raises on a cluster that names none, as a folder of one machine is no other's.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="weftline-")
        shared_dir.own = root
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, which cuts its lineage and survives lost executors.

    most: see ``gathered``.
    """
    spark = df.sparkSession
    df = df if most is None else gathered(df, most)
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, most: int) -> DataFrame:
    """df in at most so many tasks, but two a core at least; no row is moved or left out.

    A shuffle deals to as many partitions as the session says, be its rows few, and each would write a file. On local
    folders Hadoop starts several processes for each file, and an executor's memory is there twice while one starts.
    """
    return df.coalesce(max(most, 2 * df.sparkSession.sparkContext.defaultParallelism))


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark hands a Python worker at once, in the session's settings: whole texts make large rows."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = re.match(r"(-?\d+)[bB]?$", str(spark.conf.get(key)))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's collector finds them unreferenced.

    Without it they stay for as long as the driver has memory to spare, and fill the executors' disks.
    """
    for _ in range(2):  # what the first round frees lets go of the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def partitions(df: DataFrame) -> int:
    """How many buckets a shuffle of df takes: follows the input's splits, and the session's setting as the least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def text_batches(batches, column="text", limit=None):
    """Slices of Arrow record batches that hold about BATCH_BYTES of one column; a longer text comes alone."""
    limit = limit or BATCH_BYTES
    for batch in batches:
        sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)]) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            run = np.cumsum(sizes[at:])
            take = max(1, int(np.searchsorted(run, limit, side="right")))
            yield batch.slice(at, take)
            at += take


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives no bytes."""
    return [bytes(x.as_buffer()) if x.is_valid else b"" for x in column]


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BATCH_BYTES + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def words(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word of all texts in order, and the bounds of each text's words.

    A word is a run of bytes other than those marked in ``between``: space and 0x09-0x0D.
    """
    buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = between[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[buf] * up[: len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return hashes, np.r_[0, np.searchsorted(starts, stops)].astype(np.int64)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 places of a text reach into the next and aren't valid."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + hashes[j : len(hashes) - k + 1 + j]
    return mix(out + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; a text of fewer words is one shingle, one without words has none."""
    hashes, bounds = words(texts)
    whole = shingles(hashes, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(shingles(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def beside(df: DataFrame, *taken: str) -> list:
    """The fields of df but those named like a working or result column, in any case: the result takes such a column's place."""
    return [f for f in df.schema if f.name.lower() not in taken]


def listed(fields: list) -> str:
    """Fields as a schema's text, each followed by a comma."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
