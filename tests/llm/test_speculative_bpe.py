"""Proposals, the test of adjacent tokens, exact merging and the whole operator, against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atrium.llm import speculative_bpe

PATH = P.path("word_bpe_49k.json")
ODD = ["", "Hello <|endoftext|>World's  café", "a<|endoftext|>b <|ENDOFTEXT|><|startoftext|>", "ﬁ É́ 日本 \x1c x\x00y �\xad İSTANBUL ΣΑΣ", "x" * 5000, "ab" * 3000, " \n\t\r", "½ ² ① don't WE'LL 'sSs", "aaaa aaaaaaa aaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return speculative_bpe.Words(f.read(), most=500)


def texts(seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    out += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 70))) for _ in range(2000)]
    return out + ["".join(chr(rng.choice([rng.randint(0x20, 0x17F), rng.randint(0, 0xD7FF)])) for _ in range(20)) for _ in range(500)]


def test_equal_to_the_library_with_small_memories(coder, library):
    for seed in range(2):
        asked = ODD + texts(seed)
        for at in range(0, len(asked), 700):
            for text, data in zip(asked[at : at + 700], coder.encode(asked[at : at + 700]), strict=True):
                ids = library.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(data, "uint32").tolist() == ids, text[:50]
                assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert 0 < coder.exact < coder.proposed  # both ways were taken


def test_adjacent_tokens_are_compatible_where_merging_keeps_them(coder):
    m, rng = coder.merges, random.Random(5)
    inner, last = list(m.inner), list(m.last)
    pairs = [(rng.choice(inner), rng.choice(last)) for _ in range(4000)]
    a, b = np.array([m.inner[x] for x, _ in pairs]), np.array([m.last[y] for _, y in pairs])
    merged = m.exact([x + y for x, y in pairs])
    for pair, i, j, good, ids in zip(pairs, a, b, m.compatible(a, b), merged, strict=True):
        assert good == (ids == [i, j]), pair
    for word in ("aaaa", "aaaaa", "aaabaaab", "thethethe"):
        assert m._merged_long([m.vocab[c] for c in word[:-1]] + [m.vocab[word[-1] + m.suffix]]) == m.exact([word])[0]


def test_tokens_that_their_letters_do_not_give_are_not_proposed():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "a#", "b#", "c#", "bc#", "ab", "abc#"])}
    m = speculative_bpe.Merges(vocab, [("a", "b"), ("b", "c#"), ("a", "bc#")], "#")  # a and b merge first, so abc# never comes about
    assert "abc" not in m.last and m.encode(["abc", "bc"])[0] == [[vocab["ab"], vocab["c#"]], [vocab["bc#"]]]
    with pytest.raises(ValueError, match="earlier merges"):
        speculative_bpe.Merges(vocab, [("a", "bc#"), ("b", "c#")], "#")


def test_column_with_clashing_names(spark, library):
    rows = [(1, ODD[1]), (2, None), (2, None), (None, ODD[3]), (3, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(1))
    out = speculative_bpe.encode_column(df, PATH).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    key = lambda r: (r[0] or 0, len(r[1]))
    assert sorted(((r.doc_id, r.ids) for r in out), key=key) == sorted(want, key=key)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in out)
    digests = speculative_bpe.encode_column(df, PATH, digests=True).collect()
    assert {r.ids_sha256 for r in digests} == {hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for _, i in want}
    assert speculative_bpe.encode_column(df.limit(0), PATH, digests=True).collect() == []


def test_query_against_the_library(spark, library):
    from atrium.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_speculative_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
