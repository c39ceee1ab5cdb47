"""Language identification with unigrams of pieces, marginal over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum over all its segmentations into pieces, found with the forward algorithm; a
text's is the product over its words. Piece probabilities are fitted by expectation
maximisation: soft counts of pieces over all segmentations of the words of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import CACHE_WORDS, drop_shared, materialise

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Languages whose shares are broadcast, counted first; more are joined by language.
BROADCAST_LANGUAGES = 100_000
#: Words of more letters are scored but not remembered.
LONG_WORD = 32


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece file in order of id, lower-cased, once each."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(p.lower() for p in plain))


class Vocabulary:
    """Piece to number; number 0 stands for any single sign that is no piece."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i + 1 for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces) + 1

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(begin, end) -> piece number of that span for each of equally long words, -1 for none."""
        n, get = len(words[0]), self.number.get
        spans = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                ids = np.fromiter((get(w[i:j], -1) for w in words), np.int32, len(words))
                if j == i + 1:
                    ids[ids < 0] = 0
                if (ids >= 0).any():
                    spans[i, j] = ids
        return spans


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def forward(vocab: Vocabulary, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word (rows) in each language (columns), all segmentations summed.

    ``probs`` is piece by language, with a last row of zeros for spans that are no piece. Words of
    one length are summed together; long ones one by one, in time linear in their length.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for n, where in by_length(words).items():
        if n > LONG_WORD + 1:
            for i in where:
                out[i] = _forward_long(vocab, probs, words[i])
            continue
        spans = vocab.lattice([words[i] for i in where])
        alpha, scale = [np.ones((len(where), probs.shape[1]))], np.zeros((len(where), probs.shape[1]))
        for j in range(1, n + 1):
            a = sum(alpha[i] * probs[spans[i, j]] for i in range(max(0, j - vocab.longest), j) if (i, j) in spans)
            if j % 16 == 0:  # keep the numbers in range
                down = np.maximum(a, 1e-300)
                scale += np.log(down)
                alpha, a = [x / down for x in alpha], a / down
            alpha.append(a)
        out[where] = np.log(np.maximum(alpha[n], 1e-300)) + scale
    return out


def _forward_long(vocab: Vocabulary, probs: np.ndarray, word: str) -> np.ndarray:
    """The same for one word; only the sums that a piece can reach back to are kept and rescaled."""
    get, far = vocab.number.get, vocab.longest
    alpha, scale = np.zeros((far, probs.shape[1])), np.zeros(probs.shape[1])
    alpha[0] = 1  # the sum up to place i is in row i % far
    for j in range(1, len(word) + 1):
        spans = [(i % far, get(word[i:j], -1)) for i in range(max(0, j - far), j - 1)]
        spans = [(i, p) for i, p in spans if p >= 0] + [((j - 1) % far, get(word[j - 1], 0))]
        rows, pieces = (list(x) for x in zip(*spans, strict=True))
        a = (alpha[rows] * probs[pieces]).sum(axis=0)
        if j % 8 == 0:
            down = np.maximum(a, 1e-200)
            scale += np.log(down)
            alpha /= down
            a = a / down
        alpha[j % far] = a
    return np.log(np.maximum(a, 1e-300)) + scale


def soft_counts(vocab: Vocabulary, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words of one language."""
    out = np.zeros(vocab.size)
    for n, where in by_length(words).items():
        spans, c = vocab.lattice([words[i] for i in where]), counts[where]
        shape = (n + 1, len(where))
        alpha, beta = np.zeros(shape), np.zeros(shape)
        alpha[0], beta[n] = 1, 1
        for (i, j), ids in sorted(spans.items(), key=lambda x: x[0][1]):
            alpha[j] += alpha[i] * probs[ids]
        for (i, j), ids in sorted(spans.items(), key=lambda x: -x[0][0]):
            beta[i] += beta[j] * probs[ids]
        total = np.maximum(alpha[n], 1e-300)
        for (i, j), ids in spans.items():
            np.add.at(out, ids, np.where(ids >= 0, c * alpha[i] * probs[ids] * beta[j] / total, 0.0))  # -1 adds nothing
    return out


def short_words(words: list[str]) -> list[str]:
    """Words of more than LONG_WORD letters in cuts of that length, others whole."""
    return [w[i : i + LONG_WORD] for w in words for i in range(0, len(w), LONG_WORD)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each with the vocabulary's mark of a word's beginning."""
    return [f"▁{w}" for w in LETTERS.findall(text.lower())] if text else []


@dataclass
class LanguageModel:
    """Piece probabilities of each language: at most pieces x languages numbers, whatever the corpus."""

    pieces: list[str]
    languages: list[str]
    probs: np.ndarray  # piece by language, last row zeros


def train(docs: DataFrame, vocabulary_path: str, docs_per_language: int = 400, rounds: int = 3, smoothing: float = 0.01, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit a model to the rows with a text and a language.

    About ``docs_per_language`` rows of each language, chosen by a hash of the id, are enough for
    a vocabulary of fixed size; this bound is the only sampling, and it bears on training alone.
    Spark counts words and runs each round's expectations; the driver gets a row for each piece
    and language, never more than the model holds. Longer runs than LONG_WORD letters are learned
    from in cuts. Without rows the model has no language. Repeated rows count as often as they are.
    """
    vocab = Vocabulary(load_pieces(vocabulary_path))
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_003)).alias("h"))
    share = rows.groupBy("lang").agg((F.lit(docs_per_language * 1_000_003.0) / F.count(F.lit(1))).alias("below"))
    share = materialise(share, "langid-languages")
    chosen = rows.join(F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share, "lang").where("h < below")

    def count(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(short_words(words_of(text)))
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "langid-words")
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    probs = np.full((vocab.size + 1, len(languages)), 1.0 / vocab.size)
    probs[-1] = 0
    pieces = list(vocab.number)
    at = {x: i for i, x in enumerate(languages)}

    for _ in range(rounds if languages else 0):
        held = counted.sparkSession.sparkContext.broadcast(probs)

        def expect(batches, held=held):
            known, total = Vocabulary(pieces), {}
            for b in batches:
                pdf = b.to_pandas()
                for lang, g in pdf.groupby("lang"):
                    got = soft_counts(known, held.value[:, at[lang]], list(g["word"]), g["n"].to_numpy(float))
                    total[lang] = total.get(lang, 0) + got
            for lang, x in total.items():
                used = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int64)), pa.array(x[used])], ["lang", "piece", "uses"])

        uses = counted.mapInArrow(expect, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        new = np.full_like(probs, smoothing)
        for lang, g in uses.groupby("lang"):
            new[g["piece"].to_numpy(), at[lang]] += g["uses"].to_numpy()
        new[-1] = 0
        probs = new / new.sum(axis=0)
        held.unpersist()
    drop_shared(counted)
    drop_shared(share)
    return LanguageModel(pieces, languages, probs)


class _Scorer:
    """Scores texts, remembering the scores of a bounded number of words."""

    def __init__(self, model: LanguageModel):
        self.vocab, self.model = Vocabulary(model.pieces), model
        self.row: dict[str, int] = {}
        self.score = np.zeros((1024, len(model.languages)), np.float32)

    def learn(self, words: list[str]) -> None:
        if len(self.row) + len(words) > CACHE_WORDS:
            self.row = {}
        start, new = len(self.row), forward(self.vocab, self.model.probs, words)
        need = start + len(words)
        if need > len(self.score):
            grown = np.zeros((max(need, 2 * len(self.score)), self.score.shape[1]), np.float32)
            grown[:start] = self.score[:start]
            self.score = grown
        self.score[start:need] = new
        self.row.update(zip(words, range(start, need), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) for t in texts]
        new = [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in self.row]
        short = [w for w in new if len(w) <= LONG_WORD]
        if len(self.row) + len(short) > CACHE_WORDS:
            short = [w for w in dict.fromkeys(w for ws in found for w in ws) if len(w) <= LONG_WORD]
            self.row = {}
        if short:
            self.learn(short)
        names, sure = [], []
        for words in found:
            if not words or not self.model.languages:
                names.append("und")
                sure.append(0.0)
                continue
            long = [w for w in words if len(w) > LONG_WORD]
            rows = np.fromiter((self.row[w] for w in words if len(w) <= LONG_WORD), np.int64)
            total = self.score[rows].sum(axis=0, dtype=np.float64)
            if long:
                total = total + forward(self.vocab, self.model.probs, long).sum(axis=0)
            p = np.exp(total - total.max())
            best = int(np.argmax(p))
            names.append(self.model.languages[best])
            sure.append(float(p[best] / p.sum()))
        return names, sure


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", batch: int = 256, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Add ``lang_pred string`` and ``score double`` (the posterior with an even prior), or columns
    of other names.

    Only the text is looked at, all of it, in time linear in its length. Null texts and texts without a letter are ``und`` with
    score 0, as are all texts of a model without languages; equal posteriors go to the first
    language by name. Columns of the same names are replaced; repeated rows stay. An empty table gives
    no row.
    """
    docs = docs.drop(lang_name, score_name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = _Scorer(held.value)
        for b in batches:
            names, sure, texts = [], [], b.column(at).to_pylist()
            for i in range(0, len(texts), batch):
                got = scorer.predict(texts[i : i + batch])
                names += got[0]
                sure += got[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
