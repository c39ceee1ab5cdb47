"""Spelling variants: words one edit apart, found over a bit-sliced position index.

Words are counted in tasks, shards of the vocabulary are indexed by position and letter, and each
word is led to its form, the much more frequent word next to it, and on to the last of its forms.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, materialise

#: Letters of a run: A-Z, lower-cased, a-z and U+00C0 to U+00FF; every other Latin-1 byte divides.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words that a counting task remembers before it hands them on.
HELD_WORDS = 400_000
#: Rows that one task's call takes, on average; hot groups are cut into blocks of these sizes.
BUCKET_ROWS = 40_000
INDEX_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 16
#: Limits of one step over bitsets: 64-bit words of an index, and pairs of a query with such a word.
STEP_WORDS, STEP_PAIRS = 4096, 400_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: runs of letters of whole texts, A-Z lower-cased, with at least ``least_length``
    code points and ``least_count`` occurrences.

    Where ``drop_every`` divides the crc32 h of ``<id>:<run>``, the run's code point ``h % length``
    is left out first (0: never). Null texts have no runs; a null id is written as nothing before
    the colon. Tasks count before anything moves, so a frequent word is one row for each task.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for run, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                        if len(run) < least_length:
                            continue  # an edit only shortens
                        if drop_every:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                            if h % drop_every == 0:
                                k = h % len(run)
                                run = run[:k] + run[k + 1 :]
                                if len(run) < least_length:
                                    continue
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD_WORDS:
                    yield handed()
                    held.clear()
        yield handed()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _index(letters: np.ndarray, word: np.ndarray, bit: np.ndarray, kinds: int, words: int) -> np.ndarray:
    """The bitsets of one position: for each letter, which words of the index have it there."""
    out = np.zeros(kinds * words, np.uint64)
    np.bitwise_or.at(out, letters.astype(np.int64) * words + word, bit)
    return out


def _step(spelt: np.ndarray, long: np.ndarray, index: np.ndarray, slot: np.ndarray, words: int, query: np.ndarray, pair_query: np.ndarray, pair_word: np.ndarray, size: int, half: int, suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and of index words that are one edit apart.

    ``spelt`` holds letter codes by row and position, ``long`` says which rows have ``size + 1``
    letters (queries have ``size``). For every pair of a query with 64 words of the index, three
    bitsets go along the query's letters: words equal so far, words with one letter replaced, and
    words with one letter more, which are read one position ahead. Words that share the first
    ``half`` letters are left to the groups by prefix, others to those by suffix.
    """
    kinds = int(spelt.max()) + 1
    word, bit = slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64)
    same = np.full(len(pair_query), ~np.uint64(0))
    one, more, prefix = np.zeros_like(same), np.zeros_like(same), same
    here = _index(spelt[index, 0], word, bit, kinds, words)
    for i in range(size):
        if i == half:
            prefix = same.copy()
        ahead = _index(spelt[index, i + 1], word, bit, kinds, words)
        at = spelt[query, i].astype(np.int64)[pair_query] * words + pair_word
        equal = here[at]
        more = (more | same) & ahead[at]
        one = (one & equal) | (same & ~equal)
        same = same & equal
        here = ahead
    longer = np.zeros(words, np.uint64)
    np.bitwise_or.at(longer, word[long[index]], bit[long[index]])
    longer = longer[pair_word]
    found = (one & ~longer) | ((more | same) & longer)
    found &= ~prefix if suffix else prefix
    used = np.zeros(words, np.uint64)
    np.bitwise_or.at(used, word, bit)
    found &= used[pair_word]
    hit = np.flatnonzero(found)
    row, place = np.nonzero(np.unpackbits(found[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at_slot = np.full(words * 64, -1, np.int64)
    at_slot[slot] = index
    return query[pair_query[hit[row]]], at_slot[pair_word[hit[row]] * 64 + place]


def _pairs_of(group: np.ndarray, role: np.ndarray, spelt: np.ndarray, long: np.ndarray, size: int, half: int, suffix: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs within groups of rows of one size; roles: 0 both, 1 of the index, 2 query only."""
    index = np.flatnonzero(role != 2)
    index = index[np.argsort(group[index], kind="stable")]
    groups = int(group.max()) + 1
    held = np.bincount(group[index], minlength=groups)
    blocks = -(-held // 64)
    query = np.flatnonzero((role != 1) & ~long & (held[group] > (role == 0)))
    query = query[np.argsort(group[query], kind="stable")]
    asked = np.bincount(group[query], minlength=groups)
    first_index, first_query = np.cumsum(held) - held, np.cumsum(asked) - asked
    live = np.flatnonzero((asked > 0) & (blocks > 0))
    at = 0
    while at < len(live):
        end, words, pairs = at, 0, 0
        while end < len(live) and (end == at or words + blocks[live[end]] <= STEP_WORDS and pairs + blocks[live[end]] * asked[live[end]] <= STEP_PAIRS):
            words += int(blocks[live[end]])
            pairs += int(blocks[live[end]] * asked[live[end]])
            end += 1
        taken = live[at:end]
        start = np.cumsum(blocks[taken]) - blocks[taken]
        own = np.concatenate([index[first_index[g] : first_index[g] + held[g]] for g in taken])
        which = np.repeat(np.arange(len(taken)), held[taken])
        slot = start[which] * 64 + np.arange(len(own)) - (np.cumsum(held[taken]) - held[taken])[which]
        asks = np.concatenate([query[first_query[g] : first_query[g] + asked[g]] for g in taken])
        of = np.repeat(np.arange(len(taken)), asked[taken])
        each = max(1, STEP_PAIRS // max(1, int(blocks[taken].max()))) if len(taken) == 1 else len(asks)
        for q in range(0, len(asks), each):
            some, whose = asks[q : q + each], of[q : q + each]
            n = blocks[taken][whose]
            pair_query = np.repeat(np.arange(len(some)), n)
            pair_word = np.repeat(start[whose] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield _step(spelt, long, own, slot, words, some, pair_query, pair_word, size, half, suffix)
        at = end


def near_in_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """``word, n_near, best_n, best`` of the words with a near word among ``rows``: how many there are,
    and the one of largest n (ties: the first in code-point order)."""
    ids: dict[bytes, int] = {}
    word_of = np.array([ids.setdefault(w.encode("latin-1"), len(ids)) for w in rows["word"]])
    words = list(ids)
    n = np.zeros(len(words), np.int64)
    n[word_of] = rows["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    size, suffix, role = rows["size"].to_numpy(), rows["suffix"].to_numpy(bool), rows["role"].to_numpy()
    group = rows.groupby(["grp", "i", "j"], sort=False).ngroup().to_numpy()
    for c in np.unique(size):
        for side in (False, True):
            at = np.flatnonzero((size == c) & (suffix == side))
            if len(at) < 2:
                continue
            c = int(c)
            spelt = np.frombuffer(b"".join(words[w].ljust(c + 1, b"\0") for w in word_of[at]), np.uint8).reshape(-1, c + 1)
            kinds, codes = np.unique(spelt, return_inverse=True)
            codes = codes.reshape(spelt.shape).astype(np.uint8)
            long = spelt[:, c] != 0
            dense = np.unique(group[at], return_inverse=True)[1]
            for a, b in _pairs_of(dense, role[at], codes, long, c, c // 2, side):
                of, by = word_of[at[a]], word_of[at[b]]
                both = long[b]
                of, by = np.concatenate([of, by[both]]), np.concatenate([by, of[both]])
                near += np.bincount(of, minlength=len(words))
                np.minimum.at(best, of, rank[by])
    got = np.flatnonzero(near)
    chosen = [order[r] for r in best[got]]
    return pd.DataFrame({"word": [words[i].decode("latin-1") for i in got], "n_near": near[got], "best_n": n[chosen] if len(got) else np.zeros(0, np.int64), "best": [words[i].decode("latin-1") for i in chosen]})


def near_words(vocabulary: DataFrame, rows: int | None = None) -> DataFrame:
    """``word, n_near, best_n, best`` from ``word, n``: for every word with a near one, how many are
    one inserted, deleted or replaced code point away, and the most frequent of them.

    An edit leaves one half of the shorter word as it is: for each size c, words of c and c + 1
    letters meet by the first c // 2 letters and by the last ones, and each group has its own
    index. A pair is found once. Groups above `INDEX_BLOCK` words are cut into blocks of the index
    and of the queries, each pair of blocks a task's work, so no task holds a hot group; within a
    group nothing is emitted but each word's count and best. Words are of Latin-1 letters.
    """
    rows = vocabulary.count() if rows is None else rows
    letters = F.length("word")
    halves = []
    for size, extra in ((letters, 0), (letters - 1, 1)):
        half = F.floor(size / 2).cast("int")
        tail = F.expr(f"substring(word, cast(floor((length(word) - {extra}) / 2) as int) + {1 + extra})")
        for suffix, key in ((False, F.substring("word", F.lit(1), half)), (True, tail)):
            halves.append(F.struct(size.cast("int").alias("size"), F.lit(suffix).alias("suffix"), key.alias("key")))
    keyed = vocabulary.select("word", "n", F.inline(F.array(*halves))).withColumn("grp", F.xxhash64("size", "suffix", "key")).drop("key")
    hot = materialise(keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > INDEX_BLOCK), "spelling-hot")  # at most 4 * words / INDEX_BLOCK rows
    if hot.limit(1).count():
        side = F.broadcast(hot) if 4 * rows // INDEX_BLOCK <= 200_000 else hot
        x = keyed.join(side, "grp", "left")
        ni = F.greatest(F.lit(1), F.ceil(F.coalesce("held", F.lit(0)) / INDEX_BLOCK)).cast("int")
        nq = F.greatest(F.lit(1), F.ceil(F.coalesce("held", F.lit(0)) / QUERY_BLOCK)).cast("int")
        h = F.xxhash64("word", F.lit(1))
        alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role")))
        indexed = F.transform(F.sequence(F.lit(0), nq - 1), lambda q: F.struct(F.pmod(h, ni).cast("int").alias("i"), q.alias("j"), F.lit(1).alias("role")))
        asking = F.transform(F.sequence(F.lit(0), ni - 1), lambda i: F.struct(i.alias("i"), F.pmod(F.shiftright(h, 20), nq).cast("int").alias("j"), F.lit(2).alias("role")))
        parts = F.when(F.col("held").isNull(), alone).when(letters == F.col("size"), F.concat(indexed, asking)).otherwise(indexed)
        dealt = x.select("word", "n", "size", "suffix", "grp", F.inline(parts))
    else:
        dealt = keyed.select("word", "n", "size", "suffix", "grp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role"))
    buckets = max(8, 4 * rows // BUCKET_ROWS)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInPandas(lambda pdf: near_in_rows(pdf), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of `count_words`.

    ``form`` is the near word of largest n (ties: the first in code-point order) if that n is at
    least ``ratio`` times the word's, else null; ``root`` is the end of the chain of forms. An empty
    table, or one of null or empty texts, gives no row; repeated rows count again; other columns
    are not read, so their names do not matter; very long runs are words like others.

    Roots go down from words without a form to those that name them, a level at a time: a word is
    named by few, one edit away, so these joins have no hot key. Each level at least doubles n.
    """
    vocabulary = materialise(count_words(docs, id_col, text_col, drop_every, least_length, least_count), "spelling-words")
    near = near_words(vocabulary)
    joined = vocabulary.join(near, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    drop_shared(vocabulary)
    levels = [forms.where("form is null").select("word", "form", F.col("word").alias("root"), "n", "n_near", "form_n")]
    named = forms.where("form is not null")
    while True:
        up = levels[-1].select(F.col("word").alias("form"), "root")
        level = materialise(named.join(up, "form").select("word", "form", "root", "n", "n_near", "form_n"), "spelling-level")
        if not level.limit(1).count():
            drop_shared(level)
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
