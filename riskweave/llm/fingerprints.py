"""Document fingerprints from closed syncmers, and how alike two of them are.

A k-mer is an anchor if its least s-mer stands at one of its edges. Whether it is depends on its own
bytes alone, so shared passages have the same anchors wherever they stand. A fingerprint keeps the
anchors of least hash with their places; two are compared by the anchors that they share in the
same order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, mix

#: Bytes of an inner substring and of a k-mer; a k-mer has 16 inner substrings.
S, K = 8, 23
#: Anchors of a fingerprint.
ANCHORS = 128
#: Bytes of a text that are looked at in one go.
CHUNK = 1 << 20
#: Compressed bytes of texts that one task brings into order, about.
PART_BYTES = 32 << 20
_VALUES = byte_values(12)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: No byte of UTF-8; stands before and after each text, so that short texts have k-mers too.
_EDGE = b"\xff" * (K - 1)


def _inner(raw: bytes) -> np.ndarray:
    """Hashes of the s-mers of some bytes, each from two halves of half its length."""
    h = _VALUES[np.frombuffer(raw, np.uint8)]
    for span, factor in zip((1, 2, 4), _FACTORS, strict=True):
        h = h[:-span] * factor + h[span:]
    return h


def _anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """40-bit hashes and places of the closed syncmers of some bytes."""
    h = least = _inner(raw)
    for span in (1, 2, 4, 8):
        least = np.minimum(least[:-span], least[span:])
    at = np.flatnonzero((h[: len(least)] == least) | (h[K - S :] == least))
    whole = mix(h[at] * _FACTORS[0] + h[at + S] * _FACTORS[1] + h[at + K - S])
    return whole >> np.uint64(24), at


def _least(hashes: np.ndarray, places: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``anchors`` least distinct hashes, each with its first place."""
    some = 4 * anchors
    while some < len(hashes):
        near = hashes <= np.partition(hashes, some)[some]
        u, first = np.unique(hashes[near], return_index=True)
        if len(u) >= anchors:
            return u[:anchors], places[near][first[:anchors]]
        some *= 8
    u, first = np.unique(hashes, return_index=True)
    return u[:anchors], places[first[:anchors]]


def fingerprint_of(text: str | None, anchors: int = ANCHORS) -> str:
    """The fingerprint of a whole text: 5 bytes of hash and 4 of place for each anchor kept, by hash,
    in base 64. Null and empty texts have none, ``''``. Texts of any length are read in chunks."""
    if not text:
        return ""
    raw = _EDGE + text.encode("utf-8", "surrogatepass") + _EDGE
    hashes, places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for begin in range(0, len(raw) - K + 1, CHUNK):
        h, at = _anchors(raw[begin : begin + CHUNK + K - 1])
        hashes, places = _least(np.concatenate([hashes, h]), np.concatenate([places, at + begin]), anchors)
    if not len(hashes):  # no k-mer qualifies: the text is its own anchor
        hashes, places = np.array([int.from_bytes(hashlib.sha256(raw).digest()[:5], "big")], np.uint64), np.zeros(1, np.int64)
    packed = np.empty((len(hashes), 9), np.uint8)
    packed[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    packed[:, 5:] = (places & 0xFFFFFFFF).astype(">u4").view(np.uint8).reshape(-1, 4)
    return base64.b64encode(packed.tobytes()).decode()


def _decoded(fingerprint: str) -> tuple[list[int], list[int]]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 9)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw[:, :5]
    return wide.view(">u8")[:, 0].tolist(), np.ascontiguousarray(raw[:, 5:]).view(">u4")[:, 0].tolist()


def likeness_of(a: str | None, b: str | None, anchors: int = ANCHORS) -> float:
    """Share of anchors, 0 to 1, that two fingerprints have in common in the same order.

    Anchors above the greatest hash of a full fingerprint are unknown there and left out on both
    sides. The shared ones are matched by place: those of the longest run of rising places count.
    Two fingerprints without anchors are alike (1), one of them is like no other (0).
    """
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (ha, pa_), (hb, pb) = _decoded(a), _decoded(b)
    limit = min([h[-1] for h in (ha, hb) if len(h) >= anchors], default=1 << 63)
    there = dict(zip(hb, pb, strict=True))
    shared = sorted((p, there[h]) for h, p in zip(ha, pa_, strict=True) if h <= limit and h in there)
    tails: list[int] = []
    for _, p in shared:
        i = bisect.bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return 2 * len(tails) / (bisect.bisect_right(ha, limit) + bisect.bisect_right(hb, limit))


def fingerprint(text: Column, anchors: int = ANCHORS) -> Column:
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, anchors) for t in texts], dtype=object)

    return made(text)


def likeness(a: Column, b: Column, anchors: int = ANCHORS) -> Column:
    """How alike the fingerprints of two columns are, for pairs that another step proposes."""

    @F.pandas_udf("double")
    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(p, q, anchors) for p, q in zip(x, y, strict=True)], dtype=float)

    return made(a, b)


def edited_text(text: str, following: str) -> str:
    """A text whose last half (rounded down) is replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: int = ANCHORS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document's fingerprint beside that of an edited form and that of the next document.

    Documents stand in order of their whole-number id, null first, rows of one id by the hash of
    their text; after the last comes the first, so a single document is its own next. Null texts
    are empty. An empty table gives no row; other columns are not read, so their names do not matter.

    Ids are cut into ranges at approximate quantiles (an id that fills several is divided by the
    hash), texts move once, compressed, to their range's task and are read there in order. The
    first row of each range also goes to the range before. No task holds more than two texts and a
    batch; a run of one id is divided like any other rows.
    """
    low = -(1 << 63)
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, total = x.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], OUT).withColumnRenamed("doc_id", id_col)
    parts = max(8, 2 * (total or 0) // part_bytes)
    key = F.coalesce("id", F.lit(low))
    cuts = x.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    ends, repeats = np.unique(np.array(sorted(cuts), np.int64), return_counts=True)
    first_of = np.cumsum(repeats) - repeats + np.arange(len(ends))  # a range ends below its cut, then come the cut's own rows

    def part_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ends, ids)
        out = np.where(at < len(ends), np.append(first_of, 0)[at], len(cuts) + len(ends))
        own = (at < len(ends)) & (np.append(ends, 0)[at] == ids)
        share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
        n = np.append(repeats, 1)[at]
        return out + np.where(own, 1 + np.minimum(np.floor(share * n), n - 1), 0).astype(np.int64)

    hashed = x.select("id", key.alias("key"), F.xxhash64("text").alias("h"), "text")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = part_of(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), b.column(1)], ["part", "key", "h"])

    firsts = hashed.select("key", "h").mapInArrow(dealt, "part long, key long, h long").groupBy("part").agg(F.min(F.struct("key", "h")).alias("m")).orderBy("part").collect()  # a row for each range
    before = {(r["m"]["key"], r["m"]["h"]): (r["part"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                keys, hashes = b.column("key").to_numpy(), b.column("h").to_numpy()
                part = part_of(keys, hashes)
                sizes, packed = [], []
                for t in b.column("text"):
                    raw = t.as_buffer()
                    sizes.append(raw.size)
                    packed.append(codec.compress(raw, asbytes=True) if raw.size else b"")
                extra = [(i, before[k][1]) for i, k in enumerate(zip(keys.tolist(), hashes.tolist(), strict=True)) if k in before and before[k][0] == part[i]]
                again = [i for i, _ in extra]
                rows = [*range(b.num_rows), *again]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([part, np.array([p for _, p in extra], np.int64)])), pa.array([False] * b.num_rows + [True] * len(again)),
                        b.column("id").take(pa.array(rows)), pa.array(keys[rows]), pa.array(hashes[rows]), pa.array([sizes[i] for i in rows], pa.int64()), pa.array([packed[i] for i in rows], pa.binary()),
                    ],
                    ["part", "after", "id", "key", "h", "size", "text"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, out = pa.Codec("zstd"), None, []
        names = [c.split()[0] for c in OUT.split(", ")]

        def handed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

        for b in batches:
            part, after, ids, sizes, texts = (b.column(c) for c in ("part", "after", "id", "size", "text"))
            for i in range(b.num_rows):
                p, n = part[i].as_py(), sizes[i].as_py()
                if held and held[0] != p:
                    held = None  # its last row has met the first of the next range
                if held is None and after[i].as_py():
                    continue  # a further row equal to the first of the next range
                text = codec.decompress(texts[i].as_buffer(), n, asbytes=True).decode("utf-8", "surrogatepass") if n else ""
                mark = fingerprint_of(text, anchors)
                if held:
                    _, key, own, own_mark = held
                    edited = edited_text(own, text)
                    edited_mark = fingerprint_of(edited, anchors)
                    out.append((key, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, edited_mark, likeness_of(own_mark, edited_mark, anchors), likeness_of(own_mark, mark, anchors)))
                held = None if after[i].as_py() else (p, ids[i].as_py(), text, mark)
                if len(out) >= 500:
                    yield handed()
                    out.clear()
        yield handed()

    moved = hashed.mapInArrow(sent, "part long, after boolean, id long, key long, h long, size long, text binary")
    n = len(cuts) + len(ends) + 1
    ordered = moved.repartition(n, "part").sortWithinPartitions("part", "after", "key", "h")
    return ordered.mapInArrow(compared, OUT).withColumnRenamed("doc_id", id_col)
