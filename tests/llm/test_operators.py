"""Operators against brute force, and the edge cases that every operator must survive."""

import gzip
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ann, common, jaccard, langid, licenses, mixing, packing, perplexity, queries, rules, token_files, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge_rows():
    rng = random.Random(5)
    words = ["the", "of", "wald", "licht", "casa", "été", "Zug", "mar", "no", "und"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "x", "y", "z"]) for _ in range(n))
    base = text(90)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " end", "en", "b"), (4, None, None, None), (5, "", "de", "b"), (None, text(60), "de", None)]
    rows += [(6, "  \n\t ", "fr", "a"), (7, "one", "fr", "c"), (8, "same line\nsame line\n\nsame line " * 9, "en", "c"), (9, "### $$$ ***", "en", "a"), (10, text(9000), "en", "a")]
    rows += [(20 + i, text(40 + i), "en", rng.choice("abc")) for i in range(25)]
    return [(i, t, lang, s, -1, "clash", 3) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def encode(name, text, end):
    from tokenizers import Tokenizer

    t = encode.made.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


encode.made = {}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    rng = random.Random(3)
    parts = ["Hello ", "world", ", ", ". ", ".\n", ",", "\n", "\n\n", "a", "É", "é", " ", "  ", "\t", ".", "'s", "12", "²", "Σ", "İ", "漢字", "🙂", "\xa0", "\x1c", "\r", "...", "#", "ß", "_", "\0", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path(name))
    got = tokens.WordTokenizer(public_tokenizers.path(name)).ids(texts)
    assert all(np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == g for t, g in zip(texts, got, strict=True))


def test_packing_covers_every_id_once(docs, empty):
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), seq_len=64)
    rows = sorted(out.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    flat, at = {}, {}
    for r in rows:
        assert r["offset"] == at.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 64 for s, n in at.items() if s < max(at)) and sorted(at) == list(range(len(at)))
    texts = Counter((r[0], encode("byte_bpe_50k.json", r[1], 1).tobytes()) for r in edge_rows())
    for r in rows:
        flat.setdefault((r["doc_id"], r["sequence_id"] if r["start"] == 0 else None), None)
    total = sum(len(k[1]) // 4 * n for k, n in texts.items())
    assert sum(at.values()) == total
    start = {}
    for r in rows:  # pieces of a row follow each other
        start.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    for i, blob in {k[0]: k[1] * n for k, n in texts.items()}.items():
        assert b"".join(start[i]) == blob
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    path = common.new_path(spark, "t")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), row_index_stride=1000)
    rows = sorted(token_files.digest(token_files.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    want = sorted((r[:2] for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert [r["doc_id"] for r in rows] == [w[0] for w in want]
    for r, w in zip(rows, want, strict=True):
        ids = encode("word_bpe_49k.json", w[1], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.lookup(spark, path, [3]).count() == 1
    none = common.new_path(spark, "t")
    token_files.write_tokens(empty, none, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, none).count() == 0


def test_lookups_skip_stripes_and_row_groups(spark):
    path = common.new_path(spark, "t")
    many = spark.range(40_000).select((F.col("id") * 10).alias("doc_id"), F.concat(F.lit("some words of document "), "id").alias("text"))
    token_files.write_tokens(many.repartition(4), path, public_tokenizers.path("word_bpe_49k.json"), stripe_bytes=1 << 16, row_index_stride=1000)

    def read(ids):
        found = token_files.lookup(spark, path, ids)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return len(rows), plan.metrics().apply("numOutputRows").value()

    assert read([123_450])[0] == 1 and read([123_450])[1] < 8_000  # one row group or stripe of 40
    assert read([123_455]) == (0, 0)  # within the range of a row group, excluded by its Bloom filter
    assert read([-5, 400_005]) == (0, 0)  # outside all ranges


def brute_rules(text):
    w = WORD.findall(text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    covered = {j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, empty):
    rows = rules.judge(docs).collect()
    assert len(rows) == len(edge_rows())
    want = Counter((r[0], *brute_rules(r[1])) for r in edge_rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["host_ok"])
    assert rules.judge(empty).count() == 0


def test_a_bad_host_is_refused_and_a_small_one_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "a b"
    rows = [(i, good if i % 20 else bad, h) for h in "abcdef" for i in range(100)] + [(i, bad if i % 5 else good, "junk") for i in range(100)] + [(0, bad, "tiny")]
    v = {r["host"]: r for r in rules.host_verdicts(rules.measure(spark.createDataFrame(rows, "doc_id long, text string, host string")), "host").collect()}
    assert not v["junk"]["host_ok"] and v["a"]["host_ok"]
    assert v["tiny"]["rate_short"] < 1.0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype("f4")
    x[5], x[7] = 0, np.nan
    x[100:200] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [1.0, None] + [0.0] * 14), (None, x[1].tolist()), (3, x[3].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")), F.col("id") % 20 == 0, k=20).collect()
    ok = [i for i in range(600) if i not in (5, 7)]
    hit = 0
    for q in [i for i in ok if i % 20 == 0]:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in [r["vec_id"] for r in mine]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        s = x[ok].astype("f8") @ x[q].astype("f8")
        best = {ok[j] for j in np.lexsort((ok, -s)) if ok[j] != q}
        best = [ok[j] for j in np.lexsort((np.array(ok), -np.round(s, 12))) if ok[j] != q][:20]
        hit += len({r["vec_id"] for r in mine} & set(best))
    assert hit >= 0.9 * 20 * 30
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


def test_license_scan(spark, docs, empty):
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    names = list(licenses.TEMPLATES)
    rows = [(i, f"{noise(rng.randint(0, 60))} {licenses.TEMPLATES[names[i % len(names)]]} {noise(rng.randint(0, 60))}") for i in range(66)]
    rows += [(100, noise(300)), (101, None), (102, ""), (103, "Released under"), (None, licenses.TEMPLATES["MIT"]), (3, rows[3][1])]
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    sh = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    want = {(i, k) for i, t in rows if i is not None for k, v in licenses.TEMPLATES.items() if len(sh(v) & sh(t)) >= 0.8 * len(sh(v))}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(got) == len(want)
    assert licenses.scan(empty).count() == 0


def test_damaged_notices_are_retrieved(spark):
    """Words of notices changed at random: at a containment of 0.5 and of 0.8 no more than the bands allow are missed."""
    rng = random.Random(4)
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    sh = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    short = {"one": "five words make one shingle", "two": "six words in all make two", "three": "this notice has exactly seven words total"}
    rows = []
    for i in range(600):
        w = (licenses.TEMPLATES | short)[sorted(licenses.TEMPLATES | short)[i % 14]].split()
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    texts = licenses.TEMPLATES | short
    for least, missed in ((0.8, 0), (0.5, 2)):
        want = {(i, k) for i, t in rows for k, v in texts.items() if len(sh(v) & sh(t)) >= least * len(sh(v))}
        got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts, least).collect()}
        assert got <= want and len(want - got) <= missed and len(want) > 100


def test_warc_round_trip(spark, monkeypatch):
    big = "x" * 1500 + "é"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "short"), (7, "http://a/7", "short"), (None, "http://a/8", big), (2, "http://a/2", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = warc.package_folder(spark)
    m = warc.write_packages(df, folder)
    got = warc.read_packages(m, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        revisit = html == big and r["page_id"] != 3
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (3 if revisit else None)
        assert bytes(r["payload"]) == (b"" if revisit else html.encode())
    key = lambda rs: sorted(str(r) for r in rs)
    monkeypatch.setattr(warc, "READ_BYTES", 300)  # many runs of a package, read by several tasks
    again = warc.read_packages(m, folder, with_payload=True)
    assert key(again.collect()) == key(got) and again.select(F.spark_partition_id()).distinct().count() > 2
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 500)  # packages are closed and others begun
    folder = warc.package_folder(spark)
    m = warc.write_packages(df, folder)
    assert m.count() > 3 and key(warc.read_packages(m, folder, with_payload=True).collect()) == key(got)
    none = warc.write_packages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_packages(none, folder).count() == 0


def test_zip64_directory():
    data = b"hello"
    local = struct.pack("<4s5H3L2H", warc.LOCAL, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"a" + struct.pack("<2H2Q", 1, 16, 5, 5) + data
    extra = struct.pack("<2H3Q", 1, 24, 5, 5, 0)
    entry = struct.pack("<4s6H3L5H2L", warc.ENTRY, 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    end64 = struct.pack("<4sQ2H2L4Q", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sLQL", warc.LOCATOR64, 0, len(local) + len(entry), 1)
    end = struct.pack("<4s4H2LH", warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    blob = local + entry + end64 + locator + end
    assert warc.members(len(blob), lambda at, n: blob[at : at + n]) == {"a": (len(local) - 5, 5)}
    assert gzip.decompress(warc.record(1, "u", b"x", "00" * 20, None, "d")).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_language_forward_sums_all_segmentations():
    vocab = langid.Vocabulary(["a", "b", "ab", "ba", "aba"])
    p = np.array([[0.05], [0.2], [0.25], [0.2], [0.1], [0.2], [0.0]])

    def total(w):
        if not w:
            return 1.0
        return sum(p[vocab.number.get(w[:k], 0 if k == 1 else -1), 0] * total(w[k:]) for k in range(1, min(3, len(w)) + 1))

    words = ["a", "abab", "abba", "c", "bacab" * 5]
    assert np.allclose(langid.forward(vocab, p, words)[:, 0], [np.log(total(w)) for w in words])
    assert np.allclose([langid._forward_long(vocab, p, w)[0] for w in words], [np.log(total(w)) for w in words])


@pytest.mark.filterwarnings("error")
def test_long_runs_of_letters_take_linear_time():
    pieces = langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    vocab, rng = langid.Vocabulary(pieces), np.random.default_rng(1)
    probs = np.vstack([rng.dirichlet(np.ones(vocab.size), 3).T, np.zeros(3)])
    run = "▁" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz語文"), 100_000))
    begin = time.process_time()
    got = langid.forward(vocab, probs, [run, run[:50_001]])
    assert np.isfinite(got).all() and (got[0] < got[1]).all() and (got[0] > 2.2 * got[1]).all()
    assert time.process_time() - begin < 60
    assert max(map(len, langid.short_words([run]))) == langid.LONG_WORD and "".join(langid.short_words([run, "ab"])) == run + "ab"


def test_language_id(spark, docs, empty):
    en, de = "the quick brown fox and the lazy dog of this house".split(), "der schnelle braune fuchs und die faulen hunde aus diesem haus".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(w) for _ in range(30)), lang) for i in range(200) for w, lang in ((en, "en"), (de, "de"))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(train, public_tokenizers.path("piece_bpe_32k.model"), docs_per_language=100, rounds=2)
    test = spark.createDataFrame([(1, " ".join(rng.choice(en) for _ in range(9)), "x"), (2, " ".join(rng.choice(de) for _ in range(9)), "x"), (3, None, "x"), (4, "12 ###", "x"), (5, "", "x"), (6, "x" * 5000, "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in langid.identify(test, m).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[6]["lang_pred"] in ("en", "de")
    none = langid.train(empty, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_repeated_vectors_take_one_place(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    near = x[0] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(70, near.tolist())] * 30
    rows += [(71, (near * (1 + 0.001 * i)).tolist()) for i in range(30)]  # one id, many near vectors
    best = {i: max(float(np.dot(x[0], v)) for j, v in rows if j == i) for i, _ in rows if i}
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=20, recall=1 - 1e-9).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == want


def brute_links(rows, width, num, den):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(sh(t))
            parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_links_match_brute_force(spark, width, num):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t, *_ in edge_rows()]
    n = 100
    for _ in range(12):  # families of near copies, some near the threshold
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 9, 12, 30, 120, 400]))]
        for _ in range(rng.randint(2, 30)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w).title()))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = jaccard.link(df, width, num, 100).collect()
    assert len(got) == len(rows)
    want = brute_links(rows, width, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_bucket_is_dealt_over_batches(spark):
    size, most = 20_000, 1  # one bucket, all of it outside the largest component but one
    opened = spark.createDataFrame([(i, 7, size, most) for i in range(3)], "key long, hub long, size long, most long")
    batch, total = jaccard.dealt(opened)
    assert total * jaccard.BATCH_ROWS >= 3 * (size - most + size) * (size // jaccard.BLOCK)
    assert batch.count() == 3 and all(0 <= r["batch"] < total for r in batch.collect())
    assert jaccard.dealt(spark.createDataFrame([], opened.schema))[1] == 1


def test_keys_of_hot_shards_and_small_blocks_lose_nothing(spark, monkeypatch):
    """A passage that all documents share, keys in rows, blocks of a few documents, few pairs at once."""
    monkeypatch.setattr(jaccard, "SHARD_KEYS", 60)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng = random.Random(9)
    vocab, passage = [f"w{i}" for i in range(300)], [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):  # families that differ by the words around the passage
        base = random.Random(i // 6)
        w = [base.choice(vocab) for _ in range(12)]
        w[rng.randrange(12)] = rng.choice(vocab)
        rows.append((i, " ".join([*w[:6], *passage, *w[6:]])))
    for width, num in ((5, 80), (3, 90)):
        got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, num, 100).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute_links(rows, width, num, 100)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.concatenate([a[rng.integers(0, 30) :], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])
        x, y = jaccard.sketch(a, 20)[0], jaccard.sketch(b, 20)[0]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_mixing(docs, empty):
    a, b = (mixing.mix(docs).collect() for _ in range(2))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["taken"])
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and len(a) == len(edge_rows())
    want = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in edge_rows())
    assert Counter((r["doc_id"], r["size"]) for r in a) == want
    total, by = 1.5 * sum(r["size"] for r in a), {}
    for r in sorted(a, key=key):
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = {}, set()
    while True:
        left = total - sum(2 * size[s] for s in full)
        free = [s for s in names if s not in full]
        goal = {s: 2 * size[s] for s in full} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if goal[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert by[s][0]["source_size"] == size[s] and abs(by[s][0]["target"] - goal[s]) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_knapsack_is_best():
    rng = random.Random(4)
    for _ in range(200):
        sizes = rng.sample(range(1, 15), 4)
        counts = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(1, 60)
        got = mixing.knapsack(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= budget)
        assert all(n <= dict(zip(sizes, counts, strict=True))[s] for s, n in got.items())


def kneser_ney(train, texts):
    seqs = [["<", *re.split(r"[\s!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", t.lower().strip()), ">"] for t in train]
    c = Counter((a, b) for s in seqs for a, b in zip(s, s[1:]))
    ctx, cont = {}, Counter(b for _, b in c)
    for (a, _), n in c.items():
        ctx.setdefault(a, []).append(n)
    d = perplexity.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    e = perplexity.discounts([sum(v == k for v in cont.values()) for k in (1, 2, 3, 4)])
    types = sum(cont.values())
    unk = sum(e[min(k, 3) - 1] for k in cont.values()) / types / (len(cont) + 1)
    p1 = lambda w: (cont[w] - e[min(cont[w], 3) - 1]) / types + unk if w in cont else unk

    def p(a, b):
        if a not in ctx:
            return p1(b)
        n = c.get((a, b), 0)
        return ((n - d[min(n, 3) - 1]) / sum(ctx[a]) if n else 0) + sum(d[min(k, 3) - 1] for k in ctx[a]) / sum(ctx[a]) * p1(b)

    out = []
    for t in texts:
        s = ["<", *t.lower().split(), ">"]
        out.append(np.exp(-sum(np.log(p(a, b)) for a, b in zip(s, s[1:])) / (len(s) - 1)))
    return out


def test_perplexity_matches_the_formula(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(40)), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = df.where("doc_id < 40").select("doc_id")
    got = {r["doc_id"]: r for r in perplexity.classify(df, trusted).collect()}
    aside = {r[0] for r in df.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(10)) == 0).select("doc_id").collect()}
    want = kneser_ney([t for i, t, _ in rows if i < 40 and i not in aside], [t for _, t, _ in rows])
    assert np.allclose([got[i]["perplexity"] for i, _, _ in rows], want, rtol=1e-4)
    edge = perplexity.classify(docs, docs.where("doc_id < 30").select("doc_id")).collect()
    assert len(edge) == len(edge_rows()) and all(r["kept"] is not None for r in edge)
    assert not any(r["kept"] for r in edge if r["doc_id"] in (4, 5, 6))
    assert perplexity.classify(empty, empty.select("doc_id")).count() == 0
    assert perplexity.classify(df, empty.select("doc_id")).where("kept").count() == 60


def test_thresholds_are_quantiles_of_each_language(spark):
    rng = random.Random(7)
    langs = ["en", "de", None]
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2 + i % 3) for _ in range(rng.randint(0, 30))), langs[i % 3]) for i in range(300)] + [(300 + i, "a bb c", "fr") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("threshold", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in perplexity.classify(df, df.where("doc_id < 240").select("doc_id"), quantile=0.7, held_out=3).collect()}
    assert len(got) == 304
    aside = {r[0] for r in df.where("doc_id < 240").where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)) == 0).select("doc_id").collect()}
    at = lambda ids: sorted(got[i]["perplexity"] for i in ids if got[i]["perplexity"] is not None)
    quantile = lambda v: v[math.ceil(0.7 * len(v)) - 1]
    limits = {x: quantile(at(i for i in aside if got[i]["lang"] == x)) for x in langs} | {"fr": quantile(at(aside))}
    for i, t, lang in rows:
        r = got[i]
        assert r["threshold"] == limits[lang] and (r["perplexity"] is None) == (not t)
        assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= limits[lang])


def test_soft_counts_sum_over_all_segmentations():
    vocab = langid.Vocabulary(["a", "b", "ab", "ba", "aba"])
    p = np.array([0.05, 0.2, 0.25, 0.2, 0.1, 0.2, 0.0])

    def ways(w):
        if not w:
            yield []
        for k in range(1, min(3, len(w)) + 1):
            piece = vocab.number.get(w[:k], 0 if k == 1 else -1)
            if piece >= 0:
                yield from ([piece, *rest] for rest in ways(w[k:]))

    words, counts, want = ["abab", "c", "abba", "aba"], np.array([2.0, 1.0, 3.0, 5.0]), np.zeros(vocab.size)
    for w, n in zip(words, counts, strict=True):
        each = [(np.prod(p[x]), x) for x in ways(w)]
        for q, x in each:
            np.add.at(want, x, n * q / sum(q for q, _ in each))
    assert np.allclose(langid.soft_counts(vocab, p, words, counts), want)


def test_perplexity_sees_signs_and_case(spark):
    assert [len(x) for x in perplexity.word_ids(["ab !!, Ab\tab.", "...", " ", None, "a", "é-x"])] == [7, 3, 0, 0, 3, 5]
    ab, signs, Ab, again, stop = perplexity.word_ids(["ab !!, Ab\tab."])[0][1:-1].tolist()
    assert ab == again and len({ab, signs, Ab, stop}) == 4
    rng = random.Random(8)
    words = [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    base = [text() for _ in range(300)]
    junk = [re.sub(" ", "*** ", base[0]), base[1].upper(), re.sub(" ", " | ", base[2]), re.sub(" ", "!! ", base[3])]
    df = spark.createDataFrame(list(enumerate(base + junk)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in perplexity.classify(df, df.where("doc_id < 300").select("doc_id")).collect()}
    assert [got[300 + i]["kept"] for i in range(4)] == [False] * 4
    assert sum(got[i]["kept"] for i in range(300)) > 280
    assert [got[i]["n_tokens"] for i in (0, 300, 301)] == [61, 60 + 59 + 1, 61]


def test_a_frequent_key_is_scored_in_several_tasks(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["the", rng.choice("abcdefghij") * rng.randint(1, 3)]) for _ in range(30))
    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    want = {r["doc_id"]: r["perplexity"] for r in perplexity.classify(df, df).collect()}
    made, score = {}, perplexity.score

    def watched(docs, model, groups, split):
        made.update(split)
        per = perplexity._keys(docs, model.shards, 0, 1, split).groupBy("shard", "salt").agg(F.sum(F.length("keys") / 5).alias("n"))
        assert per.where(F.col("n") > 8000).count() == 0  # 'the' alone is some 22500 keys
        return score(docs, model, groups, split)

    monkeypatch.setattr(perplexity, "SHARD_KEYS", 3000)
    monkeypatch.setattr(perplexity, "BLOCK_DOCS", 20)
    monkeypatch.setattr(perplexity, "score", watched)
    got = {r["doc_id"]: r["perplexity"] for r in perplexity.classify(df, df).collect()}
    assert max(made.values()) >= 3
    assert all(abs(got[i] - want[i]) < 1e-6 * want[i] for i in want)


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, docs, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    clash = ["times", "copy", "kept_id", "mix_id", "lang_pred", "score", "row_hash", "h", "kept", "Text_Hash"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in clash})
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.materialise(stage(spark, at, sf), "t")
        assert at.columns == docs.columns
        assert all({r[c] for r in at.select(*clash).collect()} == {f"own {c}"} for c in clash)
    assert at.where("doc_id in (4, 5, 6, 7, 9)").count() == 0
    assert at.where("doc_id in (2, 3)").count() == 0  # near copies of 1
    assert at.where("doc_id is null").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stage_keeps_one_row_of_an_id(spark, sf):
    import corpus_pipeline

    rows = [(1, f"t{i} " * 60, "en", "a", i, "h", i) for i in range(3)] * 2 + [(2, "other words here " * 20, "en", "a", 0, "h", 0)]
    made = [corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(r, DOCS), sf).collect() for r in (rows, rows[::-1])]
    assert sorted(map(str, made[0])) == sorted(map(str, made[1])) and sorted(r["doc_id"] for r in made[0]) == [1, 2]
