"""The queries ``opN_<name>`` and their SQL: thin uses of the operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, jaccard, langid, licenses, mixing, packing, perplexity, phrases, rules, spelling, token_files, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), seq_len=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_files(spark, sf_dir):
    path = new_path(spark, "tokens-orc")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.digest(token_files.read_tokens(spark, path))


def op3_quality_rules(spark, sf_dir):
    judged = rules.judge(table(spark, sf_dir, "documents"))
    rates = [F.round(f"rate_{k}", 6).alias(f"host_{k}") for k in rules.rules()]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_ok", *rates)


def op4_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    folder = warc.package_folder(spark)
    manifest = warc.write_packages(table(spark, sf_dir, "pages"), folder)
    return warc.read_packages(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()), vocabulary("piece_bpe_32k.model"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_passes=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op10_perplexity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return perplexity.classify(table(spark, sf_dir, "documents"), labels)


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), drop_every=97, least_length=5, least_count=3, ratio=2)


def op12_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), support=30, longest=4, top=2000, covered=80)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


_RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
_MOMENTS = ", ".join(f"avg(f_{k} / docs) AS mu_{k}, var_pop(f_{k} / docs) AS var_{k}" for k in _RULES)
_WEIGHT = "CASE WHEN var_{0} > 0 AND mu_{0} * (1 - mu_{0}) > var_{0} THEN least(mu_{0} * (1 - mu_{0}) / var_{0} - 1, 1e6) WHEN var_{0} > 0 THEN 1.0 ELSE m_docs END"
_RATES = ", ".join(f"(f_{k} + ({_WEIGHT.format(k)}) * mu_{k}) / (docs + ({_WEIGHT.format(k)})) AS rate_{k}" for k in _RULES)

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
q AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
m AS (SELECT l.r, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN q ON l.r = q.r),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines,
  n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS word_length FROM m),
h AS (SELECT source, count(*)::DOUBLE AS docs, {", ".join(f"sum({k}::INTEGER)::DOUBLE AS f_{k}" for k in _RULES)} FROM f GROUP BY source),
a AS (SELECT avg(docs) AS m_docs, {_MOMENTS} FROM h),
s AS (SELECT source, {_RATES} FROM h, a),
v AS (SELECT *, greatest({", ".join(f"rate_{k}" for k in _RULES)}) <= 0.5 AS host_ok FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND host_ok AS kept,
  host_ok, {", ".join(f"round(rate_{k}, 6) AS host_{k}" for k in _RULES)}
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON payload_digest = d
"""


OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, piece_text FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece_text FROM documents WHERE text IS NOT NULL)),
s AS (SELECT piece, lang, list_filter(string_split_regex(piece_text, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT piece, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
a AS (SELECT lang, 1 AS k, w AS phrase FROM g UNION ALL SELECT lang, 2, w || ' ' || w2 FROM g WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM g WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS n FROM a GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
d AS (SELECT s.lang, s.phrase FROM (SELECT lang, a, array_to_string(list_slice(ws, b, b + m - 1), ' ') AS phrase FROM c, (VALUES (2), (3)) m(m), (VALUES (1), (2), (3)) b(b) WHERE m < k AND b + m - 1 <= k) s
  JOIN c ON s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.a >= 80 * c.a),
x AS (SELECT c.lang, c.phrase, c.a, q.q, array_to_string(list_slice(ws, 1, q.q), ' ') AS first, array_to_string(list_slice(ws, q.q + 1, k), ' ') AS rest
  FROM c, (VALUES (1), (2), (3)) q(q) WHERE q.q < k AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.phrase = c.phrase)),
y AS (SELECT x.lang, x.phrase, x.a, x.q, l.n AS l, r.n AS r, ((2000000 * x.a::HUGEINT) // (l.n + r.n))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, q) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z),
n AS (SELECT lang, count(*)::BIGINT AS n FROM t GROUP BY lang)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON k.lang = n.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The other queries cannot be told in SQL: tokenizers, hashing searches, language models and subset sums."""
    return {"op3_quality_rules": OP3_SQL, "op6_warc": OP6_SQL, "op13_collocations": OP13_SQL}
