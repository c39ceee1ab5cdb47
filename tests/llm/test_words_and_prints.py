"""Spelling variants, fingerprints and collocations against brute force and SQL, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.llm import fingerprints, phrases, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, shard int"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def rows_of(n=60, seed=3):
    rng = random.Random(seed)
    base = ["winter", "wintér", "garden", "gardén", "houses", "hörses", "thing", "things", "thinks", "a", "of", "the", "Straße", "×÷×÷×"]
    edit = lambda w: w if rng.random() < 0.7 else w[: (i := rng.randrange(len(w)))] + rng.choice(["", "x", "é", w[i] + w[i]]) + w[i + 1 :]
    text = lambda k: "".join(edit(rng.choice(base)) + rng.choice([" ", " ", ", ", "\n", "  ", "\t", "1", "漢", "! ", " 🙂 "]) for _ in range(k))
    shared = text(80)
    out = [(i, text(rng.randrange(0, 90)), rng.choice(["en", "de", None, "und"])) for i in range(n)]
    out += [(1000 + i, shared, "en") for i in range(5)] + [(1000, shared, "en"), (None, text(40), "en"), (None, text(40), None), (2000, None, "en"), (2001, "", "de"), (2002, "x" * 40_000 + " words words", "en"), (2003, text(9000), "en"), (2004, "..;; \t\n", "fr")]
    return [(a, b, c, "s", 7, "clash", 9, 3) for a, b, c in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, drop_every=97):
    n = Counter()
    for key, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    for w in n:
        by = [v for v in n if near(w, v)]
        best = min(by, key=lambda v: (-n[v], v)) if by else None
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(by), n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


@pytest.mark.parametrize("drop_every", [97, 5])
def test_variants_by_brute_force(docs, drop_every):
    got = spelling.variants(docs, drop_every=drop_every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    want = brute_variants(rows_of(), drop_every)
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 50
    assert sum(r["form"] is not None for r in rows) > 20


def test_hot_groups_are_cut_into_blocks(spark, docs, monkeypatch):
    vocabulary = spelling.count_words(docs).persist()
    whole = {tuple(r) for r in spelling.near_words(vocabulary).collect()}
    monkeypatch.setattr(spelling, "INDEX_BLOCK", 5)
    monkeypatch.setattr(spelling, "QUERY_BLOCK", 7)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 60)
    assert {tuple(r) for r in spelling.near_words(vocabulary).collect()} == whole and whole


def test_small_steps_find_the_same_pairs(monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.choice([5, 6]))) for _ in range(900)})
    rows = pd.DataFrame([(w, i % 50, 5, suffix, 0, 0, 0, 0) for suffix in (False, True) for i, w in enumerate(words)], columns=["word", "n", "size", "suffix", "grp", "i", "j", "role"])
    want = {w: sum(near(w, v) for v in words if 5 in (len(w), len(v))) for w in words}
    for pairs in (spelling.STEP_PAIRS, 700):
        monkeypatch.setattr(spelling, "STEP_PAIRS", pairs)
        got = spelling.near_in_rows(rows)
        assert dict(zip(got["word"], got["n_near"])) == {w: n for w, n in want.items() if n}


def test_variants_without_words(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "ab cd ef")], "doc_id long, text string")).count() == 0


def in_order(rows):
    """Rows as `compare_with_next` orders them, but for rows of one id."""
    return sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("part_bytes", [1 << 25, 2000])
def test_fingerprints_of_edited_and_next(docs, part_bytes):
    rows = [r for r in in_order(rows_of()) if r[0] is not None]
    seen = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs.where("doc_id is not null"), part_bytes=part_bytes).collect()}
    texts, ids = dict(rows), sorted({r[0] for r in rows})
    for i, key in enumerate(ids):
        if key == 1000:
            continue  # two equal rows follow each other
        text, after, r = texts[key], texts[ids[(i + 1) % len(ids)]], seen[key]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        mark, mark_edited = fingerprints.fingerprint_of(text), fingerprints.fingerprint_of(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (mark, mark_edited)
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness_of(mark, mark_edited), fingerprints.likeness_of(mark, fingerprints.fingerprint_of(after)))


@pytest.mark.parametrize("part_bytes", [1 << 25, 1000])
def test_fingerprints_of_ties_nulls_and_hot_ids(spark, docs, empty, part_bytes):
    out = fingerprints.compare_with_next(docs, part_bytes=part_bytes)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert out.count() == len(rows_of()) and out.where("doc_id is null").count() == 2
    hot = spark.createDataFrame([(7 if i % 3 else i, f"text number {i} " * 9) for i in range(300)], "doc_id long, text string").repartition(4)
    got = fingerprints.compare_with_next(hot, part_bytes=part_bytes).toPandas()
    assert len(got) == 300 and (got["doc_id"] == 7).sum() == 200
    key = {r[1]: r[2] for r in hot.select("doc_id", "text", F.xxhash64("text")).collect()}
    order = sorted(((7 if i % 3 else i, key[f"text number {i} " * 9], f"text number {i} " * 9) for i in range(300)))
    want = Counter((a[0], hashlib.sha256(fingerprints.edited_text(a[2], b[2]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter(zip(got["doc_id"], got["edited_sha256"])) == want
    assert fingerprints.compare_with_next(empty).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (one["n_chars"], one["fingerprint"], one["near_edited"], one["near_next"]) == (0, "", 1.0, 1.0)


def brute_anchors(raw):
    """Closed syncmers by their definition, over every k-mer."""
    h = lambda b: int(fingerprints._inner(b)[0])
    out = []
    for i in range(len(raw) - fingerprints.K + 1):
        inner = [h(raw[i + j : i + j + fingerprints.S]) for j in range(fingerprints.K - fingerprints.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers_and_free_of_context():
    rng = random.Random(2)
    raw = bytes(rng.choice(b"abcdefgh ") for _ in range(600))
    hashes, at = fingerprints._anchors(raw)
    assert at.tolist() == brute_anchors(raw)
    cut, moved = fingerprints._anchors(b"other words " + raw[100:400])
    inside = dict(zip((moved + 88).tolist(), cut.tolist()))
    assert all(inside[p] == h for p, h in zip(at.tolist(), hashes.tolist()) if 100 <= p <= 400 - fingerprints.K)
    assert np.diff(at).max() <= fingerprints.K - fingerprints.S  # one in every window


def test_likeness_follows_shared_text():
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))
    mark, like = fingerprints.fingerprint_of, fingerprints.likeness_of
    for n in (40, 300, 4000):
        a, b = text(n), text(n)
        assert like(mark(a), mark(a)) == 1.0 and like(mark(a), mark(b)) < 0.05
        assert 0.3 < like(mark(a), mark(fingerprints.edited_text(a, b))) < 0.7
        assert like(mark(a), mark(a.replace(a[50:60], "XX"))) > 0.8
    a = [text(12) for _ in range(60)]
    assert like(mark("\n".join(a)), mark("\n".join(reversed(a)))) < 0.4  # same sentences, another order
    assert like(mark(""), mark("")) == 1.0 and like(mark(""), mark("a")) == 0.0 and mark("a") == mark("a") != mark("b")
    long = text(60_000)
    assert len(long.encode()) < fingerprints.CHUNK and len(mark(long)) == len(mark(long * 3))
    assert like(mark(long * 3), mark(long * 3 + "x")) > 0.95


def test_likeness_of_columns(spark):
    df = spark.createDataFrame([("some words of a text", "some words of a text"), (None, "other")], "a string, b string")
    got = df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("x")).collect()
    assert [r["x"] for r in got] == [1.0, 0.0]


def sql_phrases(rows, support, top):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "lang"]))
    sql = queries.OP13_SQL.replace(">= 30", f">= {support}").replace("rank <= 2000", f"rank <= {top}")
    return {tuple(r) for r in c.sql(sql).fetchall()}


@pytest.mark.parametrize(("support", "top", "shards"), [(30, 2000, 6), (5, 2000, 4), (3, 20, 2), (7, 2000, 1)])
def test_collocations_by_sql(docs, monkeypatch, support, top, shards):
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(phrases, "COUNT_BYTES", 3000)
    got = phrases.collocations(docs, support=support, top=top, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = sql_phrases(rows_of(), support, top)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_collocations_edge_cases(spark, empty, monkeypatch):
    assert phrases.collocations(empty).count() == 0
    same = spark.createDataFrame([(None, "A b,a\tB;a  b" * 10, None)] * 4, "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "FILTER_BYTES", 1 << 10)
    got = phrases.collocations(same, support=20).collect()
    assert {tuple(r) for r in got} == sql_phrases([(None, "A b,a\tB;a  b" * 10, None)] * 4, 20, 2000)
    assert got[0]["lang"] == "und"


def test_large_counts_stay_exact(spark, monkeypatch):
    big = 10**15
    made = spark.createDataFrame([("x", 0, "", 9 * big), ("x", 1, "a", 3 * big + 1), ("x", 1, "b", 3 * big), ("x", 2, "a b", 3 * big - 1)], "lang string, words int, phrase string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: made)
    row = phrases.collocations(made).first()
    assert row["score"] == 2_000_000 * (3 * big - 1) // (6 * big + 1)
