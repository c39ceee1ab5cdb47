"""Plain words get their ids from the tokenizer's model alone, the same as whole texts from the library."""

import numpy as np
import pytest

from riskweave.llm import queries, tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_plain_words_skip_normalising_and_keep_their_ids(name):
    rng, tok = np.random.default_rng(5), tokens.WordTokenizer(queries.vocabulary(name))
    letters = list("abcdefghijklmnopqrstuvwxyzABCXYZéßñÀ")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(3000)]
    signs = rng.choice([" ", " ", " ", ", ", ". ", "\n", " (", ") ", "'s ", " 3.14 ", "?.", "; "], len(words))
    texts = ["".join(w + s for w, s in zip(words[i::30], signs[i::30], strict=True)) + "end" for i in range(30)] + ["\n", "", ".", "a", "one  two\tthree"]
    asked, whole = [], tok._letters
    tok._letters = lambda cores: asked.extend(cores) or whole(cores)
    got = tok.ids(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tok.model.encode_batch(texts, add_special_tokens=False)]
    assert asked and not any(x.isascii() for x in asked)
    assert tok.ids([None, *texts[:3]]) == [b"", *got[:3]]
