"""Documents with nearly equal sets of word shingles, by parity sketches.

Every shingle flips one bit of a document's sketch, so two sketches differ in no more bits than
the two sets have elements that they do not share. Documents are banded by set size; the sketch of
a band has some more words of 32 bits than the most elements in which linked sets can differ, so
linked documents agree in several words at least (pigeonhole) and meet when joined on one. Pairs
that meet are verified on the sets. No candidate is dropped:

* documents with equal sets are one class, of which one document stands for all;
* a word that got no shingle counts only where a document has so many that they could be all it
  shares;
* a document that meets others in fewer words than linked documents must agree in has no link;
* in a bucket (documents that agree in a word) all are first verified against one hub, twice with
  different hubs, and verified links are merged into components;
* where a bucket still holds several components, every document outside the largest is compared
  with all others of the bucket, in blocks of bounded size, by the whole sketch, and what the
  bound on the difference allows is verified.

Words travel as keys of five bytes in blocks of documents, dealt into shards by hash. A shard that a
frequent key makes too large for one task is joined as rows instead, where Spark combines before
the shuffle and splits a hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, materialise, mix, shingle_runs, shingle_sets

#: Rows of a bucket that are compared in memory at once.
BLOCK = 2048
#: Links that one task of the component rounds takes; their tables have as many files.
EDGES_A_FILE = 500_000
#: Rows of small blocks that are handed to Python in one call, about.
BATCH_ROWS = 10_000
#: Keys in a shard on average; one task takes up to twice as many.
SHARD_KEYS = 2_000_000
#: Documents whose keys travel together: their number in a block has one byte.
BLOCK_DOCS = 256
#: Ids that are broadcast, counted first (8 bytes each); more are joined by key.
BROADCAST_IDS = 500_000
_KEYS, _NAMES = np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3)


def band_starts(num: int, den: int, most: int) -> np.ndarray:
    """Smallest sizes of the bands: sets that can link lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, (den * (out[-1] - 1)) // num + 1))
    return np.array(out, np.int64)


def sketch_words(starts: np.ndarray, band, num: int, den: int):
    """Words of a band's sketch, and the most of them in which linked sets can differ there. Some
    more words than those and one: then linked sets agree in several, and words that got no
    shingle, in which any two sets may agree, need not be looked at unless a set has many."""
    most = (2 * (starts[band + 1] - 1)) * (den - num) // (den + num)
    return most + 1 + (most + 7) // 8, most


def sketch(shingles: np.ndarray, n_words: int, of=0, sets: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketch: each shingle flips one of ``32 * n_words`` bits; and for each word the XOR of
    its shingles' hashes, which tells contents apart that the word's few bits do not. Of several
    ``sets`` at once where ``of`` holds each shingle's set and ``n_words`` its words: then the
    sketches follow each other."""
    at = mix(shingles ^ _KEYS)
    words = np.broadcast_to(np.asarray(n_words, np.int64), (sets,))
    word = (((at >> np.uint64(32)) * words[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + (np.cumsum(words) - words)[of]
    names, bits = np.zeros(int(words.sum()), np.uint32), np.zeros(int(words.sum()), np.uint32)
    np.bitwise_xor.at(names, word, at.astype(np.uint32))
    np.bitwise_xor.at(bits, word, np.uint32(1) << (at & np.uint64(31)).astype(np.uint32))
    return bits, names


_BANDS: dict[tuple[int, int], np.ndarray] = {}


def _bands(num: int, den: int, size: int) -> np.ndarray:
    have = _BANDS.get((num, den))
    if have is None or have[-3] <= size:
        have = _BANDS[num, den] = band_starts(num, den, max(1 << 20, 4 * size))
    return have


def _named(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``id, n, h1, h2, keys``: set size, two 64-bit sums that name the set, and the words of its
    sketches; of rows ``id, text``."""
    names = ["id", "n", "h1", "h2", "keys"]

    def run(batches):
        for b in batches:
            for at, s, n in shingle_runs(b.column(1).to_pylist(), width):
                starts = _bands(num, den, int(n.max(initial=0)))
                band = np.maximum(np.searchsorted(starts, n, "right") - 1, 0)
                keys = np.where(n > 0, sum(sketch_words(starts, band + x, num, den)[0] for x in (0, 1)), 0)
                ends = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (s, mix(s ^ _NAMES))]
                h1, h2 = ((c[ends[1:]] - c[ends[:-1]]).view(np.int64) for c in sums)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), *[pa.array(x) for x in (n, h1, h2, keys)]], names)

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, keys long")


def _packed(docs: DataFrame, width: int, num: int, den: int, shards: int) -> DataFrame:
    """``shard int, ids array<long>, least array<int>, docs binary, keys binary`` of rows ``id, text``.

    For each block of documents and shard their keys, 5 bytes each, whose lowest bit is 1 for the
    sketch of the band above, and for each key the number of its document in ``ids``, 1 byte. A
    row without a shard has for each document the words in which it must meet others at least to
    have a link, in its own band and in the next.
    """
    names = ["shard", "ids", "least", "docs", "keys"]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def keys_of(s, n):
        """Keys of a run of sets with the number of their set, and what each set must meet in."""
        have, of = np.flatnonzero(n), np.repeat(np.arange(int((n > 0).sum())), n[n > 0])
        starts = _bands(num, den, int(n.max(initial=0)))
        band = np.searchsorted(starts, n[have], "right") - 1
        out, least = [], np.zeros((len(n), 2), np.int32)
        for up in (0, 1):
            words, most = sketch_words(starts, band + up, num, den)
            _, made = sketch(s, words, of, len(have))
            begin = np.cumsum(words) - words
            owner = np.repeat(np.arange(len(have)), words)
            # linked sets agree in words - most words at least: with fewer empty ones, in one that is not
            empty = np.bincount(owner[made == 0], minlength=len(have))
            zero = empty >= words - most
            least[have, up] = np.where(zero, 1, words - most - empty)
            kept = np.flatnonzero((made != 0) | zero[owner])
            place = (band[owner[kept]] + up).astype(np.uint64) << np.uint64(32) | (kept - begin[owner[kept]]).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = mix(mix(place + np.uint64(0x632BE59BD9B4E019)) + made[kept])
            out.append((key, have[owner[kept]], np.full(len(kept), up, np.uint64)))
        return [np.concatenate(x) for x in zip(*out, strict=True)], least

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(i, BLOCK_DOCS)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for at, s, n in shingle_runs(b.column(1).to_pylist(), width):
                    (key, doc, up), least = keys_of(s, n)
                    mine = ids[at : at + len(n)]
                    shard = ((key >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)
                    order = np.lexsort((doc, shard))
                    shard, doc = shard[order], doc[order]
                    raw = ((key << np.uint64(1) | up)[order] & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist() if len(shard) else []
                    out = [(None, mine.tolist(), least.ravel().tolist(), None, None)]
                    for lo, hi in zip(cut, cut[1:]):
                        held = np.flatnonzero(np.bincount(doc[lo:hi]))
                        local = np.searchsorted(held, doc[lo:hi]).astype(np.uint8)
                        out.append((int(shard[lo]), mine[held].tolist(), None, local.tobytes(), raw[lo:hi].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, "shard int, ids array<long>, least array<int>, docs binary, keys binary")


def _unpack(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key with its shard, document and whether of the band above, for each key of packed rows."""
    rows = [(s, np.array(i, np.int64), np.frombuffer(d, np.uint8), np.frombuffer(k, np.uint8)) for s, i, d, k in zip(*[table.column(c).to_pylist() for c in ("shard", "ids", "docs", "keys")], strict=True)]
    none = [np.zeros(0, np.int64)]
    raw = np.zeros((sum(len(d) for _, _, d, _ in rows), 8), np.uint8)
    raw[:, :5] = np.concatenate([np.zeros(0, np.uint8), *[k for *_, k in rows]]).reshape(-1, 5)
    key = raw.view("<i8").ravel()
    shard = np.repeat(np.array([s for s, *_ in rows], np.int64), [len(d) for _, _, d, _ in rows])
    return shard << 39 | key >> 1, np.concatenate([*none, *[i[d] for _, i, d, _ in rows]]), (key & 1).astype(np.int32)


def _meet(packed: DataFrame) -> DataFrame:
    """``key, id, up`` of the keys that documents share, one of them in its own band at least."""
    counted = packed.where("shard is not null").groupBy("shard").agg(F.sum(F.octet_length("docs")).alias("n"))
    hot = [r["shard"] for r in counted.where(F.col("n") > 2 * SHARD_KEYS).select("shard").collect()]  # few: their keys are hot
    schema = "key long, id long, up int"

    def batch(key, doc, up):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(up)], ["key", "id", "up"])

    def shared(table):
        key, doc, up = _unpack(table)
        order = np.argsort(key, kind="stable")
        key, doc, up = key[order], doc[order], up[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        low = np.minimum.reduceat(up, first) == 0 if len(key) else size > 0
        held = np.repeat((size > 1) & low, size)
        return pa.Table.from_batches([batch(key[held], doc[held], up[held])])

    rest = packed.where("shard is not null" + (f" and shard not in ({', '.join(map(str, hot))})" if hot else ""))
    met = rest.select("shard", "ids", "docs", "keys").groupBy("shard").applyInArrow(shared, schema)
    if hot:
        rows = packed.where(F.col("shard").isin(hot)).select("shard", "ids", "docs", "keys").mapInArrow(lambda bs: (batch(*_unpack(b)) for b in bs), schema)
        met = met.unionAll(_full(rows))
    return met


def _full(met: DataFrame) -> DataFrame:
    """Rows ``key, id, up`` of keys with two rows at least, one of them in its own band."""
    full = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("up").alias("low")).where("size > 1 and low = 0").select("key")
    return met.join(full.hint("merge"), "key", "left_semi")


def _of_ids(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids``, of which there are ``n``."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_hash"), "id", "left_semi")


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, s array<long>`` of documents ``id, text``."""

    def run(batches):
        for b in batches:
            for at, s, n in shingle_runs(b.column(1).to_pylist(), width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(s.view(np.int64)))], ["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def _sketches(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``id, n, own, next`` of ``id, s``: sketches in the set's own band and in the next."""
    ints = pa.list_(pa.int32())

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                s = np.array(x, np.int64).view(np.uint64)
                starts = _bands(num, den, len(s))
                band = int(np.searchsorted(starts, len(s), "right")) - 1
                out.append((len(s), *[sketch(s, sketch_words(starts, band + up, num, den)[0])[0].view(np.int32) for up in (0, 1)]))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), ints, ints), strict=True)]], ["id", "n", "own", "next"])

    return sets.mapInArrow(run, "id long, n long, own array<int>, next array<int>")


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: for every end of an edge ``a, b`` the smallest id of its component.

    Each round gives every document the smallest label around it and then the label's label, and
    contracts the edges; rounds end when no edge joins two labels. Tables are cut in the shared folder.
    """
    live = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    n = live.count()
    small = lambda df, name: materialise(df.coalesce(1 + n // EDGES_A_FILE), name)  # noqa: E731  few edges, few tasks
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    label = small(ends.withColumn("comp", F.col("id")), "components")
    while n:
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = small(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "parents")
        while True:  # pointer jumping: parents are smaller or equal, so it ends at roots
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = small(parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
            drop_shared(parent)
            moved = jumped.where("moved").limit(1).count()
            parent = jumped.drop("moved")
            parent._shared_path = jumped._shared_path
            if not moved:
                break
        nxt = label.join(parent, label["comp"] == parent["a"], "left").select("id", F.coalesce("p", "comp").alias("comp"))
        a, b = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        fewer = live.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()
        old, label = label, small(nxt, "components")
        was, live = live, small(fewer, "edges")
        n = live.count()
        for x in (old, was, parent):
            drop_shared(x)
    drop_shared(live)
    return label


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` whose sets link, by exact sizes of intersection and union."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.where(den * both >= num * (F.size("sa") + F.size("sb") - both)).select("a", "b")


#: Pairs that are listed at once, and 64-bit words of sketches that are compared at once.
_LISTED, _COMPARED = 1 << 18, 1 << 19


def _compare(num: int, den: int):
    """Pairs of outsiders and members of a bucket's block that the sketches cannot rule out.

    A call gets the blocks of a batch and each of their documents' sketches once. Pairs are listed
    outsider by outsider over all its blocks, a bounded number at once, so that a pair that meets
    in many of them is compared once or, cut between two listings, twice; a part of the sketch
    rules most pairs out.
    """

    def run(_: tuple, rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        out: list = [(np.zeros(0, np.int64),) * 2]
        made = made.sort_values(["id", "up"], kind="stable", ignore_index=True)
        lists = made["sketch"].to_numpy()
        words = np.array([len(x) for x in lists], np.int64)
        line, sketches = np.zeros(len(lists), np.int64), {}
        for w in np.unique(words).tolist():  # a table for each length: none is filled up to the longest
            mine = np.flatnonzero(words == w)
            line[mine] = np.arange(len(mine))
            table = np.zeros((len(mine), (w + 1) // 2 * 2), np.int32)
            for i, x in enumerate(lists[mine]):
                table[i, :w] = x
            sketches[w] = table.view(np.uint64)
        names, n = made["id"].to_numpy(), made["n"].to_numpy()

        def near(q, m):
            for w in np.unique(words[q]).tolist():
                table, mine = sketches[w], words[q] == w
                x, y = q[mine], m[mine]
                for width in (max(1, table.shape[1] // 4), table.shape[1]):
                    ok, step = np.zeros(len(x), bool), max(1, _COMPARED // width)
                    for j in range(0, len(x), step):
                        a, b = x[j : j + step], y[j : j + step]
                        differ = np.bitwise_count(table[line[a], :width] ^ table[line[b], :width]).sum(axis=1, dtype=np.int64)
                        ok[j : j + step] = differ <= (n[a] + n[b]) * (den - num) // (num + den)
                    x, y = x[ok], y[ok]
                out.append((names[x], names[y]))

        # a repeated id has a sketch for each of its sets: all of them stand in its place
        place = made.reset_index(names="at")[["id", "up", "at"]]
        rows = rows.merge(place, on=["id", "up"]).sort_values(["key", "q", "m", "side"], kind="stable")
        comp, up, at, side = (rows[c].to_numpy() for c in ("comp", "up", "at", "side"))
        same = rows[["key", "q", "m"]].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(rows)))
        asked = np.add.reduceat(1 - side, first) if len(rows) else size
        # two outsiders of a block that are members there too meet from both sides: one is enough
        block = np.repeat(np.arange(len(first)), size)
        code, one = block * len(names) + at, side == 0
        both = np.isin(code, np.intersect1d(code[one], code[~one]))
        asking = np.flatnonzero(one)
        asking = asking[np.argsort(at[asking], kind="stable")]
        members = (size - asked)[block[asking]]
        ends = np.cumsum(members)
        for lo in range(0, int(members.sum()), _LISTED):
            number = np.arange(lo, min(lo + _LISTED, int(ends[-1])))
            turn = np.searchsorted(ends, number, "right")
            q = asking[turn]
            m = first[block[q]] + asked[block[q]] + number - (ends - members)[turn]
            ok = (comp[q] != comp[m]) & ((up[q] == 0) | (up[m] == 0)) & (words[at[q]] == words[at[m]]) & ~(both[q] & both[m] & (at[m] < at[q]))
            q, m = at[q[ok]], at[m[ok]]
            new = np.unique(np.minimum(q, m) * len(names) + np.maximum(q, m))
            near(new // max(len(names), 1), new % max(len(names), 1))
        a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def dealt(opened: DataFrame) -> tuple[DataFrame, int]:
    """``key, batch`` of open buckets (``key, hub``, ``size`` documents, ``most`` in the largest
    component), and the number of batches.

    A bucket fills so many rows once outsiders are repeated for each block of members and members
    for each of outsiders. Buckets of one hub hold much the same documents and come together, in
    several batches if their rows are many.
    """
    outside = F.col("size") - F.col("most")
    rows = (outside * F.ceil(F.col("size") / BLOCK) + F.col("size") * F.ceil(outside / BLOCK)).alias("rows")
    filled = opened.select("key", "hub", rows)
    parts = filled.groupBy("hub").agg(F.ceil(F.sum("rows") / BATCH_ROWS).alias("parts"))
    total = max(1, -(-int(filled.agg(F.sum("rows")).first()[0] or 0) // BATCH_ROWS))
    salt = F.pmod(F.xxhash64(F.lit(5), "key"), F.col("parts"))
    return filled.join(parts, "hub").select("key", F.pmod(F.xxhash64("hub", salt), F.lit(total)).alias("batch")), total


def link(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_shingles, component_id`` for each row: documents linked when their shingle sets
    have ``den * intersection >= num * union``, and the smallest id reachable by links.

    A document without words has an empty set and stays alone. Shingles are told apart by 64-bit
    hashes, equal sets by two 64-bit sums and the size. Rows with equal ids are one document with
    several rows; a null id is linked with nothing and its component is null. Texts of any length
    are taken whole: the sketch grows with the set. An empty table gives no row; further columns
    are ignored.
    """
    name = ["n", "h1", "h2"]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_rows = materialise(_named(texts, width, num, den), "jaccard-rows")
    filled = all_rows.where("n > 0 and id is not null")
    classes = materialise(filled.groupBy(name).agg(F.min("id").alias("rep"), F.max("keys").alias("keys")), "jaccard-classes")
    count, keys = classes.agg(F.count(F.lit(1)), F.sum("keys")).first()
    repeated = filled.groupBy("id").count().where("count > 1").limit(1).count() > 0
    once = lambda df: df.dropDuplicates() if repeated else df  # noqa: E731  only repeated ids can have a row twice

    # a class's first document stands for it: equal sets meet nowhere
    reps = once(_of_ids(texts.where("id is not null"), classes.select(F.col("rep").alias("id")), count))
    packed = materialise(_packed(reps, width, num, den, max(32, (keys or 0) // SHARD_KEYS)), "jaccard-packed")
    shared = materialise(_meet(packed), "jaccard-shared")
    # linked documents agree in several words: what meets others in fewer goes, and buckets it leaves alone
    least = packed.where("shard is null").select(F.posexplode("ids").alias("at", "id"), "least").select("id", F.inline(F.array(*[F.struct(F.lit(up).alias("up"), F.get("least", F.col("at") * 2 + up).alias("least")) for up in (0, 1)])))
    least = least.groupBy("id", "up").agg(F.min("least").alias("least"))
    often = shared.groupBy("id", "up").agg(F.count(F.lit(1)).alias("met")).join(least, ["id", "up"]).where("met >= least").select("id", "up")
    met = materialise(_full(shared.join(often, ["id", "up"], "left_semi")), "jaccard-met")
    drop_shared(packed)
    drop_shared(shared)

    in_play = materialise(met.select("id").distinct(), "jaccard-in-play")
    sets = materialise(once(_shingle_sets(once(_of_ids(texts.where("id is not null"), in_play, in_play.count())), width)), "jaccard-sets")
    hub = lambda salt: F.min(F.struct(F.xxhash64(F.lit(salt), F.col("id")).alias("h"), "id"))["id"]
    hubs = met.groupBy("key").agg(F.array(hub(1), hub(2)).alias("hubs"))
    stars = met.join(hubs, "key").select(F.explode("hubs").alias("hub"), "id").where("hub <> id")
    stars = stars.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    first = materialise(_verified(stars, sets, num, den), "jaccard-links")
    comp = components(first)

    # buckets that still hold several components: outsiders against all, in blocks
    placed = met.join(comp, "id", "left").select("key", "id", "up", F.coalesce("comp", "id").alias("comp"))
    order = F.min(F.struct(F.xxhash64(F.lit(1), F.col("id")).alias("h"), "id"))
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"), order.alias("hub"))
    largest = per.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("members", "comp"))["comp"].alias("main"), F.sum("members").alias("size"), F.max("members").alias("most"), F.min("hub")["id"].alias("hub")).where("comps > 1")
    largest = materialise(largest, "jaccard-open")
    batch, together = dealt(largest)
    blocks = placed.join(largest.join(batch, "key"), "key").select("key", "id", "up", "comp", "batch", (F.col("comp") != F.col("main")).alias("outside"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("qs"), F.ceil(F.col("size") / BLOCK).cast("int").alias("ms"))
    blocks = materialise(blocks, "jaccard-blocks")
    sketches = _sketches(sets.join(blocks.select("id").distinct(), "id", "left_semi"), num, den)
    mine = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.col(n)).cast("int")
    # a block's number is part of its batch's: a bucket of many blocks is dealt over many batches
    dealt_block = F.when((F.col("qs") == 1) & (F.col("ms") == 1), F.col("batch")).otherwise(F.pmod(F.xxhash64("key", "q", "m"), F.lit(together))).alias("batch")
    asked = blocks.where("outside").withColumn("q", mine("qs", 3)).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1))).withColumn("side", F.lit(0))
    against = blocks.withColumn("m", mine("ms", 4)).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).withColumn("side", F.lit(1))
    cols = [dealt_block, "key", "q", "m", "side", "id", "up", "comp"]
    both = asked.select(cols).union(against.select(cols))
    needed = against.select(dealt_block, "id", "up").union(asked.select(dealt_block, "id", "up")).distinct()
    made = needed.join(sketches, "id").select(F.col("batch").alias("batch"), F.col("id").alias("id"), F.col("up").alias("up"), "n", F.when(F.col("up") == 0, F.col("own")).otherwise(F.col("next")).alias("sketch"))
    pairs = both.groupBy("batch").cogroup(made.groupBy("batch")).applyInPandas(_compare(num, den), "a long, b long").distinct()
    second = _verified(pairs, sets, num, den)
    links = materialise(first.union(second), "jaccard-links")
    final = components(links)

    named = classes.join(final, classes["rep"] == final["id"], "left").select(*name, F.coalesce("comp", "rep").alias("component"))
    rows = all_rows.select("id", *name).join(named, name, "left")
    out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    out = materialise(out, "jaccard-components")
    for x in (all_rows, classes, met, in_play, sets, first, comp, largest, blocks, links, final):
        drop_shared(x)
    return out
