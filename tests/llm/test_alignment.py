"""Alignment of two tokenizers against a plain version over all pairs of byte ranges."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atrium.llm import alignment
from atrium.llm.library_tokens import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["Hello  wörld\n the  end ", "  lead", "", None, "日本 😀 \x00 x　y ﬁ <s> </s> <unk> <0x41> q", "a <|endoftext|> b", "under ▁ bar", "one\ntwo three\nfour", "end ", "\n", " ", "x" * 3000, "the the the", "½ ² ① don't\tWE'LL", "é é \xa0 \xad", "Straße, naïve: façade."]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_letters())}

    def b_bytes(i):
        return bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()

    rows, corpus = [], collections.Counter()
    for text in texts:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        sides = [[bytes(byte[c] for c in a_side.id_to_token(i)) for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(s) != b" " + text.encode() for s in sides):
            rows.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
        spans = [[(e - len(t), e) for t, e in zip(s, es, strict=True)] for s, es in zip(sides, ends, strict=True)]
        links, j = [], 0
        for x, (low, high) in zip(a, spans[0], strict=True):
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < high:
                links.append((x, b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        corpus.update(links)
        rows.append((a, b, groups, links))
    highest = collections.Counter()
    for (_, y), n in corpus.items():
        highest[y] = max(highest[y], n)
    return [(len(a), len(b), len(g), len(links), sum(corpus[p] == highest[p[1]] for p in links), sum(corpus[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, links in rows]


@pytest.mark.parametrize(("most_common", "held"), [(1 << 19, 1 << 21), (40, 30), (1, 1)])
def test_equal_to_all_pairs_of_ranges(spark, monkeypatch, most_common, held):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    texts = ODD + [r.text for r in docs] + ["repeated row"] * 3
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)  # it goes to the tasks with the function that names it
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit("x")).withColumn("pairs", F.lit(1)).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.aligned(df, A, B, most_common=most_common).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_chunks_give_what_whole_texts_give():
    with open(A, "rb") as f, open(B, "rb") as g:
        sides = alignment.Sides(f.read(), g.read(), most=50)
    assert sides.by_chunk
    texts = [t for t in ODD if t] + ["new words of a line\nand one more line, then: more", "ends with feed\n", "a b c d e f g h i j k l m n o p q r s t"] * 2
    for at in range(0, len(texts), 4):
        for t, (a, b) in zip(texts[at : at + 4], sides.encode(texts[at : at + 4]), strict=True):
            assert np.frombuffer(a, "uint32").tolist() == sides.a.encode(" " + t, add_special_tokens=False).ids, t
            assert np.frombuffer(b, "uint32").tolist() == sides.b.encode(t), t


def test_sums_are_taken_together():
    sums = alignment._Sums(3)
    assert not sums.add(np.array([5, 7]), np.array([1, 1])) and sums.add(np.array([5, 9]), np.array([2, 1]))
    assert not sums.add(np.array([5, 7, 9]), np.array([1, 1, 1]))  # over twice as many: added up first
    pair, n = sums.take()
    assert dict(zip(pair.tolist(), n.tolist(), strict=True)) == {5: 4, 7: 2, 9: 2} and len(sums.take()[0]) == 0


def test_rows_repeat_and_tables_may_be_empty(spark):
    df = spark.createDataFrame([(1, "the the"), (1, "the the"), (None, "the"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, alignment.aligned(df, A, B).collect()), key=repr)
    want = sorted([(i, *p) for i, p in zip([1, 1, None, 2], plain(["the the", "the the", "the", None]), strict=True)], key=repr)
    assert got == want
    assert alignment.aligned(df.limit(0), A, B).collect() == []
    texts = alignment.align(df, A, B, texts=True).filter("n_a = 1").first()
    assert "|" in texts.groups and len(texts.pairs) == 1
