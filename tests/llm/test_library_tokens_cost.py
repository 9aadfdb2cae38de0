"""Words of plain texts are looked up; what stands around the look-up costs less than one pass of ``str.translate``."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from atrium.llm.library_tokens import encoder, read_tokenizer

FILE = P.path("word_bpe_49k.json")


def test_known_words_cost_little():
    encode, text = encoder(read_tokenizer(FILE), True), "é word and, more words " * 200_000
    ids = encode("é word and, more words ")
    feeds, took = str.maketrans("", "", "\t\n\r"), {}
    for name, work in (("translate", lambda: text.translate(feeds)), ("encode", lambda: encode(text))):
        took[name] = []
        for _ in range(3):
            start = time.process_time()
            out = work()
            took[name].append(time.process_time() - start)
    assert out == ids * 200_000
    assert min(took["encode"]) < min(took["translate"])


def test_words_in_any_case_and_before_signs():
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    encode = encoder(read_tokenizer(FILE), True)
    words = ["Word", "word,", "WORD.", "élan", "ÉLAN!", "ß;", "ÿ:", "a's,", "'s", "s'", "'", ",", ",,", "1,", "x1.", "²,", "ª.", "µ?", "word,,", "it's", "<|endoftext|>", "a" * 60, "A" * 60 + "."]
    for a in words:
        for b in words:
            for text in (f"{a} {b}", f"{a}{b}", f"{a}\n{b}"):
                assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
