"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is counted on trusted text. It is kept as numbers by key: for a word the logarithms of
its interpolation weight as a context and of its continuation probability, for a bigram what its
probability adds to those of its words. A document's log-probability is then a sum over its keys,
0 for unknown ones. Keys are dealt into shards by hash; counting, modelling and scoring run over
a few groups of shards one after the other, so that only a part of all n-grams is on disk at once;
in a shard's task the model's slice is looked up for the keys of blocks of documents. Keys travel
in packs of five bytes each, those of documents as those of the model. A shard with a frequent key
is scored in several tasks, each with some of the blocks and the whole slice. Nothing of the corpus
goes to the driver but counts of counts and each shard's count of keys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.core import cumulate_within

from .common import SPACES, byte_values, drop_shared, hash_words, materialise, mix

_SPACE = np.array([chr(i) in SPACES for i in range(256)])
_SIGN = np.array([chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" for i in range(256)])
_VALUES = byte_values(2)
#: Word hashes have so many bits; a key within a shard has 40. Both are shared by chance only.
WORD_BITS, KEY_BITS = 48, 40
BEGIN, END = 1, 2
#: Keys of documents in a shard on average; a task gets about twice as many at most.
SHARD_KEYS = 8_000_000
#: Trusted ids that are broadcast, counted first (8 bytes each); with more, trusted texts are joined by key and written.
BROADCAST_IDS = 1_000_000
#: Keys are counted in so many bins, of which shards are made.
BINS = 1 << 14
#: Documents whose keys travel together.
BLOCK_DOCS = 256


def word_ids(texts: list[str | None]) -> list[np.ndarray]:
    """48-bit hashes of the words of each text, with marks of the beginning and the end. Case is
    kept, and runs of ASCII signs are words of their own. Empty for a text without words."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    out = []
    for _, hashes, counts in hash_words(raw, _SPACE, _VALUES, _SIGN):
        h, at = np.maximum(hashes >> np.uint64(64 - WORD_BITS), np.uint64(3)), 0
        for k in counts.tolist():
            out.append(np.concatenate([[np.uint64(BEGIN)], h[at : at + k], [np.uint64(END)]]) if k else np.zeros(0, np.uint64))
            at += k
    return out


def word_key(w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(w * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(v + np.uint64(0x632BE59BD9B4E019)) + w)


def _bin(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(50)).astype(np.int64)


def pack_keys(key: np.ndarray) -> np.ndarray:
    """The lowest KEY_BITS of each key, 5 bytes a row."""
    return np.ascontiguousarray((key & np.uint64((1 << KEY_BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def unpack_keys(raw: bytes) -> np.ndarray:
    key = np.zeros((len(raw) // 5, 8), np.uint8)
    key[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return key.view("<i8").ravel()


def _block_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All keys of some texts, the number of the text that each belongs to, and each text's words."""
    seqs = word_ids(texts)
    flat = np.concatenate([np.zeros(0, np.uint64), *seqs])
    of = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    word, pair = np.flatnonzero(flat > END), np.flatnonzero(of[1:] == of[:-1])
    key = np.concatenate([word_key(flat[word]), pair_key(flat[pair], flat[pair + 1])])
    return key, np.concatenate([of[word], of[pair]]), [max(len(s) - 2, 0) for s in seqs]


def _sizes(docs: DataFrame) -> DataFrame:
    """``id, lang, words long, bins array<int>, keys array<long>``: how many words `word_ids` finds
    in each text; and for each task a row with ``bins``, the keys of its texts with ids by bin."""

    def run(batches):
        lang, names, total = None, ["id", "lang", "words", "bins", "keys"], np.zeros(BINS, np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(i, BLOCK_DOCS)
                key, of, words = _block_keys(b.column(2).to_pylist())
                scored = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                total += np.bincount(_bin(key[scored[of]]), minlength=BINS)
                lang = b.column(1).type
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.nulls(len(words), pa.list_(pa.int32())), pa.nulls(len(words), pa.list_(pa.int64()))], names)
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, lang), pa.array([0], pa.int64()), pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([total[held].tolist()], pa.list_(pa.int64()))], names)

    lang = docs.schema["lang"].dataType.simpleString()
    return docs.select("id", "lang", "text").mapInArrow(run, f"id long, lang {lang}, words long, bins array<int>, keys array<long>")


def salts(sizes: DataFrame, shards: int) -> dict[int, int]:
    """Shard to number of tasks, for the shards whose documents' keys are too many for one."""
    by = sizes.where("bins is not null").select(F.explode(F.arrays_zip("bins", "keys")).alias("x")).groupBy((F.col("x.bins") % shards).alias("shard")).agg(F.sum("x.keys").alias("n"))
    return {r["shard"]: -(-r["n"] // (2 * SHARD_KEYS)) for r in by.where(F.col("n") > 2 * SHARD_KEYS).collect()}


def _pairs(docs: DataFrame, group: int, groups: int) -> DataFrame:
    """``v long, w long``: bigrams of ``text`` whose context belongs to a group."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), BLOCK_DOCS):
                seqs = word_ids(texts[i : i + BLOCK_DOCS])
                v, w = (np.concatenate([np.zeros(0, np.uint64), *[s[cut] for s in seqs]]) for cut in (slice(None, -1), slice(1, None)))
                mine = mix(v) % np.uint64(groups) == group
                yield pa.RecordBatch.from_arrays([pa.array(x[mine].view(np.int64)) for x in (v, w)], ["v", "w"])

    return docs.select("text").mapInArrow(run, "v long, w long")


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts 1 to 4."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 / n2), 3 - 4 * y * (n4 / n3) if n3 else 1.0]
    return [min(max(d, 0.01), k - 0.01) for d, k in zip(raw, (1, 2, 3), strict=True)]


def _counts_of_counts(df: DataFrame, col: str) -> list[int]:
    return [int(x or 0) for x in df.agg(*[F.sum((F.col(col) == k).cast("long")) for k in (1, 2, 3, 4)]).first()]


def _discount(col: str, d: list[float]) -> F.Column:
    return F.when(F.col(col) == 1, d[0]).when(F.col(col) == 2, d[1]).otherwise(d[2])


class Model:
    """``slices``: shard, packed keys and values; ``floor``: log-probability of a word in a place where
    neither context nor word is known; ``ends``: what the marks of beginning and end add."""

    def __init__(self, slices: DataFrame, shards: int, floor: float, ends: float):
        self.slices, self.shards, self.floor, self.ends = slices, shards, floor, ends


def train(trusted: DataFrame, shards: int, groups: int = 4) -> Model:
    """Count bigrams of all trusted texts (column ``text``) and write the model in shards. A table of
    texts in the shared folder is deleted as soon as it is counted. Repeated texts count as often as
    they stand there, null ones not at all; without texts the model knows no word and gives every
    text the same."""
    counts, contexts, follows = [], [], []
    for g in range(groups):
        c = materialise(_pairs(trusted, g, groups).groupBy("v", "w").agg(F.count(F.lit(1)).alias("c")).sortWithinPartitions("v", "w"), "kn-counts")
        of = lambda k: F.sum((F.col("c") == k).cast("long"))
        contexts.append(materialise(c.groupBy("v").agg(F.sum("c").alias("total"), of(1).alias("n1"), of(2).alias("n2"), F.sum((F.col("c") > 2).cast("long")).alias("n3")), "kn-contexts"))
        follows.append(materialise(c.groupBy("w").agg(F.count(F.lit(1)).alias("k")), "kn-follows"))
        counts.append(c)
    drop_shared(trusted)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionAll(union(parts[1:]))
    d = discounts([sum(x) for x in zip(*[_counts_of_counts(c, "c") for c in counts], strict=True)])
    cont = materialise(union(follows).groupBy("w").agg(F.sum("k").alias("k")), "kn-continuations")
    types, words, low, mid, high = (x or 0 for x in cont.agg(F.sum("k"), F.count(F.lit(1)), *[F.sum(c.cast("long")) for c in (F.col("k") == 1, F.col("k") == 2, F.col("k") > 2)]).first())
    dc = discounts(_counts_of_counts(cont, "k"))
    unknown = (dc[0] * low + dc[1] * mid + dc[2] * high) / max(types, 1) / (words + 1) if types else 1.0
    p1 = ((F.col("k") - _discount("k", dc)) / max(types, 1) + unknown).alias("p1")
    weight = ((d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")).alias("weight")
    lower = cont.select("w", p1)
    floor = math.log(unknown)
    ctx = union(contexts).select("v", "total", weight)
    both = lower.join(ctx.select(F.col("v").alias("w"), "weight"), "w", "full").select("w", F.coalesce(F.log("weight"), F.lit(0.0)).alias("lw"), F.coalesce(F.log("p1"), F.lit(floor)).alias("lp"))
    marks = {r["w"]: r for r in both.where(F.col("w").isin(BEGIN, END)).collect()}
    ends = (marks[BEGIN]["lw"] if BEGIN in marks else 0.0) + (marks[END]["lp"] if END in marks else floor)

    def keyed(pair):
        def run(batches):
            for b in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                ids = [c.view(np.uint64) for c in cols[:-1]]
                key = pair_key(*ids) if pair else word_key(*ids)
                shard = (_bin(key) % shards).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                shard, packed, value = shard[order], pack_keys(key[order]), cols[-1][order].astype("<f4")
                cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist() if len(shard) else [0]
                spans = list(zip(cut, cut[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]], pa.int32()), *[pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (packed, value)]], ["shard", "keys", "vals"])

        return run

    schema, parts = "shard int, keys binary, vals binary", []
    parts.append(materialise(both.where(F.col("w") > END).select("w", (F.col("lw") + F.col("lp") - floor).alias("value")).mapInArrow(keyed(False), schema), "kn-model"))
    for c, x in zip(counts, contexts, strict=True):
        j = c.join(x.select("v", "total", weight), "v").join(lower, "w")
        p = (F.col("c") - _discount("c", d)) / F.col("total") + F.col("weight") * F.col("p1")
        parts.append(materialise(j.select("v", "w", (F.log(p) - F.log("weight") - F.log("p1")).alias("value")).mapInArrow(keyed(True), schema), "kn-model"))
        drop_shared(c)
    for x in (*contexts, *follows, cont):
        drop_shared(x)
    return Model(union(parts), shards, floor, ends)


def _keys(docs: DataFrame, shards: int, group: int, groups: int, split: dict[int, int]) -> DataFrame:
    """``shard, salt int, ids array<long>, lens array<int>, keys binary``: for each block of
    documents and shard of a group the documents' keys, 5 bytes each. Blocks take the salts of a
    shard in ``split`` in turn."""

    def run(batches):
        turn = TaskContext.get().partitionId()
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(i, BLOCK_DOCS)
                key, doc, _ = _block_keys(b.column(1).to_pylist())
                shard = _bin(key) % shards
                mine = np.flatnonzero(shard % groups == group)
                mine = mine[np.lexsort((doc[mine], shard[mine]))]
                shard, doc, key = shard[mine], doc[mine], key[mine]
                packed = pack_keys(key)
                ids, out = b.column(0).to_numpy(zero_copy_only=False), []
                for s in np.unique(shard).tolist():
                    lo, hi = np.searchsorted(shard, [s, s + 1])
                    lens = np.bincount(doc[lo:hi], minlength=len(ids))
                    held = np.flatnonzero(lens)
                    out.append((s, turn % split.get(s, 1), ids[held].tolist(), lens[held].tolist(), packed[lo:hi].tobytes()))
                turn += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], ["shard", "salt", "ids", "lens", "keys"])

    return docs.select("id", "text").mapInArrow(run, "shard int, salt int, ids array<long>, lens array<int>, keys binary")


def _look_up(_: tuple, model: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """Sum of the values of each document's keys in one shard, for the blocks of one salt."""
    known = unpack_keys(b"".join(model["keys"]))
    order = np.argsort(known)
    known, value = known[order], np.frombuffer(b"".join(model["vals"]), "<f4")[order].astype(float)
    ids, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for r in docs.itertuples():
        key = unpack_keys(r.keys)
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        got = np.where(known[at] == key, value[at], 0.0) if len(known) else np.zeros(len(key))
        ends = np.cumsum(r.lens)
        ids.append(r.ids)
        sums.append(np.add.reduceat(got, ends - r.lens))
    return pd.DataFrame({"id": np.concatenate(ids), "part": np.concatenate(sums)})


def score(docs: DataFrame, model: Model, groups: int = 4, split: dict[int, int] | None = None) -> DataFrame:
    """``id, logprob``: each document's sum over its keys, by groups of shards (columns ``id, text``).
    ``split``: shards that several tasks score, see `salts`."""
    parts, split = [], split or {}
    salted = docs.sparkSession.createDataFrame([(s, i) for s, n in split.items() for i in range(n)], "shard int, salt int")
    for g in range(groups):
        mine = model.slices.where(F.col("shard") % groups == g)
        if split:
            mine = mine.join(F.broadcast(salted), "shard", "left").select("shard", F.coalesce("salt", F.lit(0)).alias("salt"), "keys", "vals")
        else:
            mine = mine.select("shard", F.lit(0).alias("salt"), "keys", "vals")
        keys = _keys(docs, model.shards, g, groups, split)
        found = mine.groupBy("shard", "salt").cogroup(keys.groupBy("shard", "salt")).applyInPandas(_look_up, "id long, part double")
        parts.append(materialise(found.groupBy("id").agg(F.sum("part").alias("part")), "kn-scores"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    out = materialise(out.groupBy("id").agg(F.sum("part").alias("logprob")), "kn-logprob")
    for p in parts:
        drop_shared(p)
    return out


def _thresholds(known: DataFrame, quantile: float) -> DataFrame:
    """``lang, whole, own``: the least perplexity that a share ``quantile`` of a language's texts does not
    pass, and with ``whole`` that of all texts. Counts by perplexity are added up over ranges of each
    language, so no task holds the texts of one."""
    lang = known.schema["lang"].dataType
    sides = F.inline(F.array(F.struct("lang", F.lit(False).alias("whole")), F.struct(F.lit(None).cast(lang).alias("lang"), F.lit(True).alias("whole"))))
    counted = known.select("perplexity", sides).groupBy("lang", "whole", "perplexity").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "kn-counted")  # read by cuts, sums and totals
    total = counted.groupBy(F.col("lang").alias("of"), F.col("whole").alias("whole_of")).agg(F.sum("n").alias("all_n"))
    placed = cumulate_within(counted, ["lang", "whole"], "perplexity", {"upto": "n"})
    placed = placed.join(total, F.col("lang").eqNullSafe(F.col("of")) & (F.col("whole") == F.col("whole_of")))
    out = materialise(placed.where(F.col("upto") >= F.ceil(quantile * F.col("all_n"))).groupBy("lang", "whole").agg(F.min("perplexity").alias("own")), "kn-limits")
    drop_shared(counted)
    return out


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, held_out: int = 10, groups: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``<id>, lang, n_tokens, perplexity, threshold, kept`` for each row.

    The model is counted on all texts with a trusted id (once each) but every
    ``held_out``-th, by a hash of the id; the perplexities of those give each language's
    threshold, their ``quantile``. Of several texts of a trusted id the first in order counts. A language without such texts takes that of all; without
    trusted text everything with words is kept. Texts without words have no perplexity and are
    not kept. Null languages are a language. Rows with equal ids are scored together; null ids are
    judged like texts without words. Texts of any length are scored whole. An empty table gives no row.
    Columns besides the three are not read, so their names do not matter. Thresholds are exact
    quantiles at any number of texts set aside.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    measured = materialise(_sizes(named), "kn-sizes")
    sizes = measured.where("bins is null")
    words = sizes.agg(F.sum("words")).first()[0] or 0
    shards = min(BINS, max(8 * groups, groups * math.ceil(2 * words / SHARD_KEYS / groups)))
    chosen = trusted_ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    aside = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(held_out)) == 0
    learned = materialise(chosen.where(~aside), "kn-learned")
    trusted = named.where("text is not null").join(F.broadcast(learned) if learned.count() <= BROADCAST_IDS else learned, "id", "left_semi")
    if sizes.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        trusted = trusted.groupBy("id").agg(F.min("text").alias("text"))  # a repeated id counts once
    trusted = trusted.select("text")
    if learned.count() > BROADCAST_IDS:
        trusted = materialise(trusted, "kn-trusted")
    model = train(trusted, shards, 2 * groups)
    logprob = score(named.where("id is not null").select("id", "text"), model, groups, salts(measured, shards))
    per_id = sizes.where("id is not null and words > 0").groupBy("id").agg(F.sum("words").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("lang").alias("lang"))
    # a document's n words and its end are n + 1 places; words take the floor where nothing is known
    total = F.coalesce("logprob", F.lit(0.0)) + F.col("n") * model.floor + F.col("rows") * model.ends
    scored = materialise(per_id.join(logprob, "id", "left").select("id", "lang", (F.col("n") + F.col("rows")).alias("n_tokens"), F.exp(-total / (F.col("n") + F.col("rows"))).alias("perplexity")), "kn-perplexity")
    known = scored.join(chosen.where(aside), "id", "left_semi")
    limits = _thresholds(known, quantile)
    overall = limits.where("whole").agg(F.max("own").alias("all_langs"))
    limits = limits.where("not whole")
    x = sizes.select("id", "lang").join(scored.drop("lang"), "id", "left").alias("x").join(limits.alias("t"), F.col("x.lang").eqNullSafe(F.col("t.lang")), "left").crossJoin(F.broadcast(overall))
    out = x.select(F.col("x.id").alias(id_col), F.col("x.lang").alias(lang_col), "n_tokens", "perplexity", F.coalesce("own", "all_langs").alias("threshold"))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
