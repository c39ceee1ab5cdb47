"""Tokenising whole texts inside Spark tasks with public tokenizer files."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Trailing signs that every supported pre-tokeniser splits off a run of letters.
TAIL = ".,;:!?)#*$%&|"
#: Signs on whose class libraries may differ (controls, rare spaces, late scripts): such texts go whole.
ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u0130\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\U00010000-\U0010ffff]")
#: A full stop or comma beside another sign, or after a space: it may belong to a longer run of signs.
RUN = re.compile(r"[.,](?:(?<=[\W_][.,])|(?=[^\w\s]|_))")
#: Words and runs of letters whose ids a worker remembers before it starts afresh.
KNOWN_WORDS, KNOWN_CORES = 300_000, 1_200_000
#: What it keeps of them once a task has ended, at most: a worker lives on through other steps.
KEPT_WORDS, KEPT_CORES = 30_000, 100_000


class WordTokenizer:
    """Token ids of whole texts, remembering the ids of space-separated words.

    In the supported vocabularies (byte-level BPE and BPE with word ends) no token crosses the
    place before a space that stands between two non-spaces, nor the place between letters and
    signs, so the ids of a text are those of its parts, one after the other. Texts with other
    runs of spaces, odd signs, combining marks that compose or strings of special tokens go to the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # as in the library's plain call, the strings of special tokens are those tokens; texts with them go whole
        self.special = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.folds = "Lowercase" in str(self.model.normalizer)
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.before = self._before()

    def _before(self) -> str | None:
        """What the pre-tokeniser puts before a plain word that follows a space, where the model by itself
        then gives such a word the library's ids; else None."""
        pre, probes = self.model.pre_tokenizer, ("q", "the", "straightforwardly", "zqxjkvb", "internationalization")
        found = {tuple(x for x, _ in pre.pre_tokenize_str(f" {w}")) for w in probes} if pre else set()
        starts = {x[0].removesuffix(w) for w in probes for x in found if len(x) == 1 and x[0].endswith(w)}
        if len(found) != len(probes) or (start := min(starts, key=len, default=None)) is None:
            return None
        same = all([t.id for t in self.model.model.tokenize(start + w)] == self.model.encode(f" {w}", add_special_tokens=False).ids for w in probes)
        return start if same else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, cores: list[str], step: int = 200) -> list[bytes]:
        """Ids of runs of letters that begin with a space each, many in one call."""
        out = []
        for i in range(0, len(cores), step):
            part = cores[i : i + step]
            e = self.model.encode("".join(part), add_special_tokens=False)
            ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            cut = [0, *((np.flatnonzero(np.diff(word)) + 1) * 4).tolist(), len(ids)]
            out += [ids[a:b] for a, b in zip(cut, cut[1:])] if len(cut) == len(part) + 1 else self._whole(part)
        return out

    def _plain(self, cores: list[str]) -> list[bytes]:
        """Ids of runs of ASCII letters that begin with a space each, by the library's model alone: neither
        normalising nor splitting changes them, but for their case."""
        split, start = self.model.model.tokenize, self.before
        ids = [[t.id for t in split(start + (x[1:].lower() if self.folds else x[1:]))] for x in cores]
        flat, ends = np.array([i for x in ids for i in x], "<u4").tobytes(), np.cumsum([0, *[4 * len(x) for x in ids]]).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, words: set[str]) -> None:
        known, cores = self.known, self.cores
        if len(known) > KNOWN_WORDS:
            known.clear()
        split, rest = {}, []
        for w in words.difference(known):
            core = w.rstrip(TAIL)
            if core[1:].isalpha() and core[0] == " ":
                split[w] = core
            else:
                rest.append(w)
        self._learn_cores({*split.values(), *[w[len(c) :] for w, c in split.items()]})
        known.update({w: cores[core] + cores[w[len(core) :]] for w, core in split.items()})
        known.update(zip(rest, self._whole(rest), strict=True))

    def _learn_cores(self, parts: set[str]) -> None:
        cores = self.cores
        if len(cores) > KNOWN_CORES:
            cores.clear()
        new = parts.difference(cores)
        plain, letters, rest = [], [], []
        for x in new:
            if x[:1] != " " or not x[1:].isalpha():
                rest.append(x)
            elif self.before is not None and x.isascii():
                plain.append(x)
            else:
                letters.append(x)
        cores.update(zip(plain, self._plain(plain), strict=True))
        cores.update(zip(letters, self._letters(letters), strict=True))
        cores.update(zip(rest, self._whole(rest), strict=True))

    def rest(self) -> None:
        """Gives back the memory of a task that has ended; few remembered words stay for the next."""
        for known, most in ((self.known, KEPT_WORDS), (self.cores, KEPT_CORES)):
            if len(known) > most:
                known.clear()
        pa.default_memory_pool().release_unused()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The little-endian unsigned 32-bit ids of each text; of none for null."""
        out: list[bytes] = [b""] * len(texts)
        whole, by_word, by_core = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if "  " in text or " \n" in text or "\n " in text or "\t" in text or "\n\n\n" in text or text.endswith("\n\n") or ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                whole.append(i)
                continue
            folded = text.lower() if self.folds else text
            if any(x in folded for x in self.special):
                whole.append(i)
                continue
            if "Σ" not in text:  # a final sigma would depend on its neighbours
                text = folded
            if RUN.search(text):
                by_word.append((i, text.replace(" ", "\0 ").replace("\n", "\0\n\0")))
            else:
                by_core.append((i, text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.\0").replace(",", "\0,\0")))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for found, known, learn in ((by_word, self.known, self._learn), (by_core, self.cores, self._learn_cores)):
            if found:
                for (i, _), ids in zip(found, _joined([text for _, text in found], known, learn), strict=True):
                    out[i] = ids
        return out


def _joined(texts: list[str], known: dict[str, bytes], learn: Callable[[set[str]], None]) -> list[bytes]:
    """Ids of texts whose parts stand between ``\\0``: Arrow numbers the parts, each different one is looked
    up once, and Numpy lays their ids side by side."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), "\0")
    coded = parts.values.dictionary_encode()
    words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    blobs = list(map(known.get, words))
    if new := {w for w, x in zip(words, blobs) if x is None}:
        learn(new)
        blobs = [known[w] if x is None else x for w, x in zip(words, blobs)]
    pool, n = np.frombuffer(b"".join(blobs), "<u4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    size, before = n[code], (np.cumsum(n) - n)[code]
    upto = np.concatenate([[0], np.cumsum(size)])
    ids = pool[np.repeat(before - upto[:-1], size) + np.arange(upto[-1])]
    ends = upto[parts.offsets.to_numpy()]
    return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", as_array: bool = False, rows: int = 512) -> DataFrame:
    """``(part int, local_start long, <id>, n_tokens long, ids)`` of every row, in row order.

    ``ids`` holds little-endian unsigned 32-bit ids as binary, or ``array<int>``, ``end_id`` last.
    ``part`` is the task's partition and ``local_start`` counts its ids before the row, so that
    written output gives global offsets with one sum for each partition. Rows leave the worker
    ``rows`` at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        tok = tokenizer(path)
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, rows):
                    b = whole.slice(i, rows)
                    ids = [x + end for x in tok.ids(b.column(1).to_pylist())]
                    n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                    ends = np.cumsum(n)
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))) if as_array else pa.array(ids, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), b.column(0), pa.array(n), column], ["part", "local_start", id_col, "n_tokens", "ids"])
                    at += int(ends[-1])
        finally:
            tok.rest()

    return docs.select(id_col, text_col).mapInArrow(run, f"part int, local_start long, `{id_col}` {kind}, n_tokens long, ids {'array<int>' if as_array else 'binary'}")
