"""Shared folder, word rules and hashing used by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every operator here, `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Spark's setting that deletes the shuffle files of a query as soon as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words a worker remembers before it starts afresh; bounds its memory.
CACHE_WORDS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (tests) is a local temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a replicated table."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # what the write shuffled is of no more use once it is done
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words_col(text) -> F.Column:
    """Array of the words of a text column; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def n_words_col(text) -> F.Column:
    return F.size(words_col(text)).cast("long")


#: Bytes that are hashed in one go, unless a single text is longer.
HASH_BYTES = 1 << 20
_POWER: list[np.ndarray] = []
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; those of HASH_BYTES are remembered."""
    if not _POWER or len(_POWER[0]) < n:
        size = max(n, HASH_BYTES)
        made = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > HASH_BYTES:
            return made[0], made[1]
        _POWER[:] = made
    return _POWER[0], _POWER[1]


def byte_values(seed: int, same: dict[int, int] | None = None) -> np.ndarray:
    """A random 64-bit value for each byte; bytes in ``same`` take another byte's."""
    out = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    for a, b in (same or {}).items():
        out[a] = out[b]
    return out


_ASCII_SPACE = np.array([chr(i) in SPACES for i in range(256)])
_FOLDED = byte_values(1, {i: i + 32 for i in range(ord("A"), ord("Z") + 1)})


def hash_words(texts: list[bytes], space: np.ndarray, values: np.ndarray, signs: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, words of each text) for runs of texts.

    Words are the runs of bytes that are not ``space``; with ``signs``, runs of these bytes are
    words of their own. A word's hash is the polynomial of its bytes' values modulo 2**64,
    scrambled; all words of a run come from one running sum.
    """
    kind = (~space).astype(np.uint8) if signs is None else np.where(space, 0, np.where(signs, 2, 1)).astype(np.uint8)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < HASH_BYTES):
            size += len(texts[end]) + 1
            end += 1
        run = texts[at:end]
        raw = np.frombuffer(b" " + b" ".join(run) + b" ", np.uint8)
        of = kind[raw]
        turn = np.flatnonzero(of[1:] != of[:-1])
        first, last = turn[of[turn + 1] > 0] + 1, turn[of[turn] > 0] + 1
        power, inverse = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * power[: len(raw)], out=sums[1:])
        hashes = mix((sums[last] - sums[first]) * inverse[first])
        ends = np.cumsum([len(x) + 1 for x in run]) + 1
        yield at, hashes, np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Odd multipliers of the places in a shingle.
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_runs(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes, hashes of each text) for runs of texts: each text's sorted
    distinct 64-bit hashes of its shingles of ``width`` words, A-Z lower-cased. A text with fewer
    words is one shingle of all its words; one without has none."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    places = np.resize(_PLACES, width)
    for at, words, counts in hash_words(raw, _ASCII_SPACE, _FOLDED):
        full = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width if len(full) else 0):
                full += words[i : i + len(full)] * places[i]
            begin = np.cumsum(counts) - counts
            sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
            of = np.repeat(np.arange(len(counts)), sizes)
            first = np.cumsum(sizes) - sizes
            where = begin[of] + np.arange(len(of)) - first[of]
            out = full[np.minimum(where, max(len(full) - 1, 0))] if len(full) else np.zeros(len(of), np.uint64)
            for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():
                k = int(counts[i])
                out[first[i]] = (words[begin[i] : begin[i] + k] * places[:k]).sum(dtype=np.uint64) + np.uint64(k)
            out = mix(out)
        for i, j in zip(first.tolist(), (first + sizes).tolist()):
            out[i:j].sort()
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
        yield at, out[fresh], np.bincount(of[fresh], minlength=len(counts))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text, one after the other; see `shingle_runs`."""
    for _, hashes, counts in shingle_runs(texts, width):
        yield from np.split(hashes, np.cumsum(counts)[:-1])
