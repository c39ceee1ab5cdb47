"""Phrase collocations by SON partitioning: shards are mined completely at a support lowered in
proportion, what is frequent in some shard is counted globally, and the phrases that hold together
best are ranked.

A phrase that stands f times in the corpus stands at least f times a shard's share of the corpus in
some shard. Shards are few and as large as the corpus asks, so each is itself mined by many tasks:
n-grams travel as packed 64-bit hashes by shard and range of hash, one length after the other, and
only n-grams whose both parts of one word less are frequent in the shard go on. Hashes only choose
candidates and count them within a task; tasks' counts meet by the phrases' text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HASH_BYTES, _powers, byte_values, drop_shared, materialise, mix

#: Shards of the corpus: a support of 30 is lowered to about 5.
SHARDS = 6
#: n-grams that a task holds before it counts them and hands them on.
HELD = 1_000_000
#: Hashes of one shard that one task brings together, about.
BUCKET = 2_000_000
#: Bytes of text whose candidates are counted together in a task.
COUNT_BYTES = 2 << 20
#: Greatest size of all shards' filters of frequent n-grams, which every task holds; beyond the
#: n-grams that fill it, filters let more pass, which costs time but no result.
FILTER_BYTES = 48 << 20
#: Bytes between words, and bytes that also end a piece.
_BLANK, _STOP = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.array([2 if c in _STOP else 1 if c in _BLANK else 0 for c in range(256)], np.uint8)
_VALUES = byte_values(13)
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def words_of(texts: list[bytes], langs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hash, begin, end, piece, number of the text) of the words of some texts, A-Z lower-cased;
    a word's hash holds its text's language."""
    raw = b"\n" + b"\n".join(texts).lower() + b"\n"
    codes = np.frombuffer(raw, np.uint8)
    kind = _KIND[codes]
    inside = kind == 0
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = turn[::2], turn[1::2]
    hashes = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):  # running sums over about HASH_BYTES at a time
        end = max(int(np.searchsorted(last, first[at] + HASH_BYTES)), at + 1)
        begin = int(first[at])
        some = codes[begin : int(last[end - 1])]
        power, inverse = _powers(len(some) + 1)
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(_VALUES[some] * power[: len(some)], out=sums[1:])
        hashes[at:end] = (sums[last[at:end] - begin] - sums[first[at:end] - begin]) * inverse[first[at:end] - begin]
        at = end
    starts = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
    of = np.searchsorted(starts, first, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    return raw, mix(hashes + langs[of]), first, last, piece, of


def grams(words: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words from each word on, and whether they lie in one piece."""
    n = max(len(words) - size + 1, 0)
    if size == 1 or not n:
        return words[:n], np.ones(n, bool)
    out = words[:n] * _PLACES[0]
    for i in range(1, size):
        out = out + words[i : i + n] * _PLACES[i]
    return mix(out + np.uint64(size)), piece[:n] == piece[size - 1 :]


class Filter:
    """Bits of the leading parts of hashes, one block of them for each shard: ``has`` may be wrong for a
    hash that is not there, never for one that is."""

    def __init__(self, bits: np.ndarray, shift: int):
        self.bits, self.shift = bits, np.uint64(shift)

    def has(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[shard][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    def any(self) -> Filter:
        """What some shard has, as the only block."""
        return Filter(np.bitwise_or.reduce(self.bits, axis=0)[None], int(self.shift))


def _spaced(phrase: bytes) -> bytes:
    """Words with one space between them."""
    if b"\t" in phrase or b"  " in phrase:
        return b" ".join(w for w in phrase.replace(b"\t", b" ").split(b" ") if w)
    return phrase


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], np.ndarray, list[str], np.ndarray]]:
    """(texts, language hashes, languages, shards) of about ``most`` bytes at a time, by shard."""
    texts, langs, shards, size = [], [], [], 0
    seen: dict[str, int] = {}

    def handed():
        order = np.argsort(np.array(shards), kind="stable").tolist()
        named = [langs[i] for i in order]
        for lang in set(named) - set(seen):
            seen[lang] = int(mix(np.array([pd.util.hash_array(np.array([lang], object))[0]], np.uint64))[0])
        return [texts[i] for i in order], np.array([seen[x] for x in named], np.uint64), named, np.array(shards)[order]

    for b in batches:
        for shard, lang, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            texts.append(raw)
            langs.append(lang.as_py())
            shards.append(shard.as_py())
            size += len(raw)
            if size >= most:
                yield handed()
                texts, langs, shards, size = [], [], [], 0
    if texts:
        yield handed()


def _mined(size: int, known: Broadcast | None, bits: int, shards: int) -> Callable:
    """A task's work on n-grams of ``size`` words: counts of those whose both parts of one word less
    pass the shard's filter, packed by shard and leading ``bits`` of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(shards)]
        count = 0

        def handed() -> pa.RecordBatch:
            rows = []
            for s in range(shards):
                if not held[s]:
                    continue
                u, n = np.unique(np.concatenate(held[s]), return_counts=True)
                ends = np.searchsorted(u >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(u)])
                for bucket in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[bucket], ends[bucket + 1]
                    many = n[a:b] > 1
                    rows.append((s, bucket, u[a:b][~many].tobytes(), u[a:b][many].tobytes(), n[a:b][many].astype(np.int64).tobytes()))
                held[s].clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "bucket", "once", "often", "times"])

        for texts, lang, _, shard in _batches(batches, HASH_BYTES):
            _, words, _, _, piece, of = words_of(texts, lang)
            bounds = np.searchsorted(shard[of], np.arange(shards + 1))
            for s in range(shards):
                w, p = words[bounds[s] : bounds[s + 1]], piece[bounds[s] : bounds[s + 1]]
                if size > 1:
                    part, whole = grams(w, p, size - 1)
                    good = known.value.has(part, s) & whole
                    out, whole = grams(w, p, size)
                    out = out[whole & good[: len(out)] & good[1 : len(out) + 1]]
                else:
                    out = w
                if len(out):
                    held[s].append(out)
                    count += len(out)
            if count >= HELD:
                yield handed()
                count = 0
        if count:
            yield handed()

    return run


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their counts from packed ones."""
    of = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
    once, often = of("once", np.uint64), of("often", np.uint64)
    keys, times = np.concatenate([once, often]), np.concatenate([np.ones(len(once), np.int64), of("times", np.int64)])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times


def _filter(frequent: DataFrame, shards: int, bits: int) -> Filter:
    """The filter of the packed hashes of a table of shards and buckets: each task sets the bits of its
    rows' ranges, and these, of a fixed size together, meet on the driver."""
    total = frequent.agg(F.sum("n")).first()[0] or 0
    wide = max(bits + 3, 10, min(int(np.log2(FILTER_BYTES * 8 // shards)), int(np.ceil(np.log2(16 * total / shards + 2)))))
    span = 1 << (wide - bits - 3)  # bytes of a bucket

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, bucket, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = np.frombuffer(packed, np.uint64) >> np.uint64(64 - wide)
                made = np.zeros(span, np.uint8)
                np.bitwise_or.at(made, (at >> np.uint64(3)).astype(np.int64) - bucket * span, np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                rows.append((s, bucket, made.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["shard", "bucket", "bits"])

    out = np.zeros((shards, 1 << (wide - 3)), np.uint8)
    for r in frequent.select("shard", "bucket", "grams").mapInArrow(bytes_of, "shard int, bucket long, bits binary").toLocalIterator():
        out[r["shard"], r["bucket"] * span : (r["bucket"] + 1) * span] = np.frombuffer(r["bits"], np.uint8)
    return Filter(out, 64 - wide)


def frequent_phrases(docs: DataFrame, support: int = 30, longest: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS) -> DataFrame:
    """``lang, words, phrase, n``: all phrases of 1 to ``longest`` words with at least ``support``
    contiguous occurrences within pieces of one language, and for each language a row of 0 words with
    the number of all its words. Null languages are ``und``; null and empty texts have no words."""
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(shards)).cast("int")
    x = docs.select(shard.alias("shard"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).where("length(text) > 0")
    size = {r["shard"]: r["b"] for r in x.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()}
    total = sum(size.values())
    least = {s: max(1, -(-support * b // total)) for s, b in size.items()}  # shares of bytes; any that add up to 1 will do
    bits = int(np.ceil(np.log2(max(total / 6 / shards / BUCKET, 4))))
    known, kept = None, []  # filters of the length before, and of each length over all shards
    for k in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(known) if known else None
        packed = x.mapInArrow(_mined(k, shared, bits, shards), "shard int, bucket long, once binary, often binary, times binary")

        def frequent(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            found, n = _summed(pdf)
            found = found[n >= least[key[0]]]
            return pd.DataFrame({"shard": [key[0]], "bucket": [key[1]], "n": [len(found)], "grams": [found.tobytes()]})

        table = materialise(packed.groupBy("shard", "bucket").applyInPandas(frequent, "shard int, bucket long, n long, grams binary"), f"phrases-{k}")
        known = _filter(table, shards, bits)
        drop_shared(table)
        if shared:
            shared.unpersist()
        kept.append(known.any())
    candidates = spark.sparkContext.broadcast(kept)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, lang, named, _ in _batches(batches, COUNT_BYTES):
            raw, words, first, last, piece, of = words_of(texts, lang)
            out: list[list] = [[], [], [], []]
            names, n = np.unique(np.array(named, object)[of].astype(str), return_counts=True) if len(of) else ([], [])
            for name, count in zip(names, n):
                for column, value in zip(out, (str(name), 0, "", int(count)), strict=True):
                    column.append(value)
            good = np.ones(len(words) + 1, bool)
            for k, known in enumerate(candidates.value, 1):
                found, whole = grams(words, piece, k)
                ok = whole & known.has(found, 0) & good[: len(found)] & good[1 : len(found) + 1]
                at = np.flatnonzero(ok)
                _, where, n = np.unique(found[at], return_index=True, return_counts=True)
                i = at[where]
                out[0] += [named[d] for d in of[i].tolist()]
                out[1] += [k] * len(i)
                out[2] += [_spaced(raw[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(first[i].tolist(), last[i + k - 1].tolist(), strict=True)]
                out[3] += n.tolist()
                good = ok
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "words", "phrase", "n"])

    rows = x.mapInArrow(counted, "lang string, words int, phrase string, n long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= support))


def collocations(docs: DataFrame, support: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to
    ``longest`` words that occur ``a >= support`` times.

    A phrase cut after its first k words has ``l`` and ``r`` occurrences of its parts and the score
    ``floor(2000000 * a / (l + r))``; its lowest score counts, ties to the smallest k. A phrase inside a
    longer one with at least ``covered`` percent of its occurrences is left out. Order: score and a
    descending, phrase ascending in bytes. Languages without such a phrase, and empty tables, give no
    row. Repeated rows count again; other columns are not read; products are decimals of 38 digits.

    Parts of a phrase are at least as frequent, so all counts come from the table of frequent phrases.
    """
    f = materialise(frequent_phrases(docs, support, longest, id_col, text_col, lang_col, shards), "phrases-counts")
    words = F.split("phrase", " ", -1)
    phrases = f.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), words.alias("w"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda b: part(b, m))))
    inside = phrases.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    covers = F.coalesce(F.lit(100) * whole("longer") >= F.lit(covered) * whole("a"), F.lit(False))
    left = phrases.join(inside, ["lang", "phrase"], "left").where(~covers)
    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    counts = f.where("words > 0")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    scored = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)  # tasks keep their first ``top`` before rows move
    total = f.where("words = 0").select("lang", F.col("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
