"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atrium.llm import byte_bpe, gif, language_id, media, near_dedup, one_bit_search, packing, resampling, secrets, sharding, token_table
from atrium.llm.bpe_transducer import Stream, Transducer
from atrium.llm.library_tokens import encoder, read_tokenizer
from atrium.llm.utf8 import Utf8Stream

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


ROWS = [
    (0, prose(0, 60), "en", "a", 1), (1, None, "en", "a", None), (2, "", None, None, 0), (3, prose(0, 60), "en", "a", 1), (4, prose(0, 59) + " changed", "en", "a", 1),
    (5, prose(5, 3000), "fr", "b", 1), (6, "x" * 5000, "fr", "b", 1), (7, " \n\t ", "de", "b", 1), (8, "one two", "de", "b", 1), (8, "one two", "de", "b", 1), (None, prose(9, 20), "es", "c", 1), (10, "日本語 text 😀 <|endoftext|> it's  two", "es", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    # columns that clash with the operators' own names
    return df.withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit("y")).withColumn("kept", F.lit("z")).withColumn("shard", F.lit("s"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_utf8_stream_at_every_cut():
    data = "aé日😀".encode() + b"\xff\xc3(\xf0\x9f\x98" + "ß".encode() + b"\xe2\x82"
    want = data.decode("utf-8", "replace")
    for cut in range(len(data) + 1):
        for second in range(cut, len(data) + 1):
            s = Utf8Stream()
            assert s.feed(data[:cut]) + s.feed(data[cut:second]) + s.feed(data[second:]) + s.close() == want


def test_transducer_small_moves_and_long_piece():
    raw = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = byte_bpe.read_ranks(raw)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = Transducer(ranks, most_moves=50)  # forgets all the time
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 40)))
        assert machine.encode(piece.encode()) == library.encode_ordinary(piece)


def test_transducer_emits_with_bounded_lookahead():
    ranks = byte_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    machine, rng = Transducer(ranks, most_moves=500), random.Random(5)
    longest = max(map(len, ranks))
    for _ in range(40):
        data = "".join(rng.choice(["the", "and", "ion", "an", "e", "r", "ß", "s", "7", "-"]) for _ in range(300)).encode()
        stream, ids, sizes = Stream(machine), [], 0
        for i in range(len(data)):
            out = stream.feed(data[i : i + 1])
            ids += out
            sizes += sum(machine.size_of[t] for t in out)
            assert i + 1 - sizes <= longest and len(stream.ended) <= longest
        assert ids + stream.close() == library.encode_ordinary(data.decode()) == machine.encode(data, at_once=64)


def test_op1_megabytes_in_one_piece():
    ranks = byte_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    machine, rng = Transducer(ranks), random.Random(6)
    text = "".join(rng.choice("abcdeinrst") for _ in range(1 << 20))
    ids = machine.encode(text.encode())
    assert machine.decode(ids) == text and len(ids) < len(text) // 2


def test_op1_decodes_cut_characters():
    ranks = byte_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    machine = Transducer(ranks)
    data = "aé日😀 ".encode() + b"\xff\xc3(\xf0\x9f\x98" + "ß".encode() + b"\xe2\x82"
    ids = [ranks[data[i : i + 1]] for i in range(len(data))]  # a token for each byte: every state is met
    assert machine.decode(ids) == machine.text.decode(ids, 3) == data.decode("utf-8", "replace")


def test_op1_matches_the_library(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.encode_column(docs, path, P.PATTERN).collect()
    assert len(rows) == len(ROWS)
    for row, source in zip(rows, ROWS, strict=True):
        assert row.ids == library.encode_ordinary(source[1] or "") and row.decoded == (source[1] or "")
    assert byte_bpe.encode_column(empty, path, P.PATTERN, digests=True).count() == 0


@pytest.mark.parametrize(("file", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_library_encoders(file, words):
    library = Tokenizer.from_file(P.path(file))
    library.encode_special_tokens = True
    encode, rng = encoder(read_tokenizer(P.path(file)), words), random.Random(1)
    letters = list("aAeÉßth  \n\t,.'019é_-²日😀\xa0\x1c×ÿ") + ["'s", " 'RE", "<|endoftext|>", "!!"]
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_op2_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1500, 24)).astype("float32")
    v[200:400] = v[200]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [None] * 24), (5003, [float("nan")] * 24), (5004, [1.0]), (None, [1.0] * 24), (5100, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = collections.defaultdict(list)
    for r in one_bit_search.search(df, at_once=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype("float64") - v[q].astype("float64")) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len(set(best.tolist()) & {i for i, _ in found})
        assert np.allclose([s for _, s in found], [d[i] for i, _ in found])
    assert hit >= 0.9 * 10 * len(got)
    assert one_bit_search.search(df.limit(0)).count() == 0


def test_op2_recall_ties_and_repeated_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, "float64")) for r in table.select("vec_id", "embedding").collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, v = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    got = collections.defaultdict(list)
    for r in one_bit_search.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, total = hits + len(set(best) & set(got[q])), total + len(best)
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(0, 500, 50)] * 2, "vec_id long, embedding array<double>")
    for q in (0, 100):
        near = [(r.vec_id, r.score) for r in one_bit_search.search(few).filter(f"query_id = {q}").orderBy("rank").collect()]
        assert near == sorted([(i, 0.0) for i in range(0, 500, 50) if i != q] * 2)[:10]


def test_op2_estimates_from_packed_bits():
    rng = np.random.default_rng(4)
    v, centre, turn = rng.standard_normal((4000, 96)), rng.standard_normal(96) / 5, one_bit_search.rotation(96)
    words, length, fit = one_bit_search.code(v, centre, turn)
    assert words.shape == (4000, 2)
    ones = np.bitwise_count(words).sum(axis=1)
    query = one_bit_search.Query(v[0] + 0.3, centre, turn)
    estimate, low = query.bounds(words, ones, length, fit)
    true = ((v - query.vector) ** 2).sum(axis=1)
    unit = np.unpackbits(words.view("uint8"), axis=1)[:, :96] * 2.0 - 1
    level = query.planes.view("uint8")
    q = query.low + query.step * sum(np.unpackbits(level[i : i + 1], axis=1)[0, :96].astype("float64") * 2**i for i in range(4))
    base = length**2 + query.far**2
    assert np.allclose(estimate, base - 2 * length * query.far * (unit @ q) / np.sqrt(96) / fit)  # the same from unpacked signs
    assert np.corrcoef(estimate, true)[0, 1] > 0.7 and (low <= true).mean() > 0.98


def test_op3_pieces(docs, empty):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), shard_rows=5).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text, *_ in ROWS:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        if i == 8:  # two equal rows, cut at places of their own
            assert sum(r.length for r in pieces[i]) == 2 * len(want)
            continue
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == want and all(r.doc_tokens == len(want) for r in got)
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_op3_scores_and_order_against_brute_force(monkeypatch):
    monkeypatch.setattr(packing, "TERM_BLOCK", 7)
    rng, n, mean = np.random.default_rng(2), 30, 55.0
    tf = [dict(zip(*(x.tolist() for x in np.unique(rng.integers(0, 60, rng.integers(1, 400)), return_counts=True)), strict=True)) for _ in range(n)]
    tf[7] = dict(tf[3])  # a copy: ties go to the earlier row
    lengths, idf = np.array([sum(d.values()) for d in tf]), rng.random(60)
    score = lambda s, o: sum(idf[t] * tf[o][t] * 2.2 / (tf[o][t] + 1.2 * (0.25 + 0.75 * lengths[o] / mean)) for t in tf[s] if t in tf[o])
    got = packing.scores([np.array(sorted(d)) for d in tf], [np.array([d[t] for t in sorted(d)]) for d in tf], lengths, idf, mean)
    want = np.array([[score(s, o) for o in range(n)] for s in range(n)])
    assert np.allclose(got[~np.eye(n, dtype=bool)], want[~np.eye(n, dtype=bool)], rtol=1e-4)
    order, used, at, seed = [], set(), 0, None
    while len(order) < n:  # the rule, word for word
        near = [o for o in range(n) if o not in used and seed is not None and at % 100 and got[seed, o] > 0]
        pick = max(near, key=lambda o: (got[seed, o], -o)) if near else min(set(range(n)) - used)
        seed = seed if near else pick
        order.append(pick)
        used.add(pick)
        if (at + lengths[pick]) // 100 > at // 100:
            seed = pick
        at += lengths[pick]
    assert packing.filling_order(got, lengths, 100) == order


def test_op3_shards_are_bounded():
    plan = packing.shards_of_ranges([(5, 100, 2), (1, 30, 1), (2, 50, 1), (3, 40, 1), (9, 10, 9)], 100, 4)
    assert plan == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (5, 2, 1), (9, 3, 3)]


def test_op3_copies_of_one_row_spread_and_long_texts_stay_whole(spark):
    long = prose(1, 150_000)  # a megabyte
    rows = [(1, prose(3, 40))] * 300 + [(2, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, P.path("byte_bpe_50k.json"), shard_tokens=5000).collect()
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == 1}) >= 3
    tokens = max(r.doc_tokens for r in got if r.doc_id == 1)
    assert sum(r.length for r in got if r.doc_id == 1) == 300 * tokens
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [x for r in sorted((r for r in got if r.doc_id == 2), key=lambda r: r.start) for x in r.ids] == [*library.encode(long, add_special_tokens=False).ids, 0]


def test_op4_findings_and_marks(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [prose(i, 50) for i in range(30)]
    texts[3] += f' token = "{key}" tail'
    texts[4] += " commit " + hashlib.sha1(b"c").hexdigest() + " " + "".join(WORDS[:5])
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (31, ""), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    forest = secrets.fit(df, sample_rows=30)
    found = secrets.findings(df, forest).collect()
    assert {(r.doc_id, r.candidate) for r in found if r.secret} == {(3, key)}
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.candidate for r in found)
    clean = {r.doc_id: r.text for r in secrets.redacted(df, forest).collect()}
    assert clean[3] == texts[3].replace(key, secrets.MARK) and clean[4] == texts[4] and clean[None] is None
    assert secrets.fit(df.limit(0)) is None and secrets.findings(df.limit(0), None).count() == 0


def test_op4_learns_words_of_all_texts(spark):
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}word common words") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = df.orderBy(F.xxhash64("text")).first().text
    copies = df.union(spark.createDataFrame([(900 + i, first) for i in range(20)], df.schema))
    assert secrets.sampled(copies, "text", 5, 7).select("n").distinct().count() == 5
    forest = secrets.fit(copies, sample_rows=5)
    assert all(t.split()[0] in forest.words for _, t in rows)


def test_op4_votes_as_the_trained_model(spark):
    """The CASE expressions give the share of the model's own trees, and the features are those of a plain Python version."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.random((300, 4)).round(3)
    df = spark.createDataFrame([([float(v) for v in r], float(r[0] + r[1] * r[2] > 0.9)) for r in x], "x array<double>, label double")
    model = RandomForestClassifier(numTrees=7, maxDepth=4, seed=1, featuresCol="v").fit(df.select(array_to_vector("x").alias("v"), "label"))
    trees = secrets.read_forest(model.toDebugString)
    for r in df.select("x", secrets.vote(trees, F.col("x")).alias("got")).collect():
        assert r.got == pytest.approx(np.mean([t.predict(Vectors.dense(r.x)) for t in model.trees]))


def test_op4_features_against_plain_python(spark):
    signs = " " + secrets.LETTERS
    pairs = [(3 * i + j) % 90 for i in range(37) for j in range(37)]
    words = ["the", "and", "key", "ab"]
    values = ["aB3-the/AND_x9", "zz", "ab", "0123456789abcdef" * 3, "the" * 7, "#§ü!ab"]

    def plain(c):
        place = lambda ch: secrets.LETTERS.find(ch) + 1
        low = c.lower()
        kind = lambda ch: 0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3
        mean = sum(pairs[place(a) * len(signs) + place(b)] for a, b in zip(low, low[1:], strict=False)) / len(c)
        covered = sum(len(w) for w in re.split("[^a-z]+", low) if w in words) / len(c)
        digits, upper, lower = (sum(kind(ch) == k for ch in c) / len(c) for k in (2, 1, 0))
        return [len(c), digits, upper, lower, mean, covered, c.count("/") / len(c), len(set(c)) / len(c)]

    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = df.select("c", secrets.features(F.col("c"), F.lit(" token = "), F.lit(" "), pairs, words).alias("f")).collect()
    for r in got:
        f = r.f
        assert [f[0], f[1], f[2], f[3], f[5], f[6], f[7], f[13]] == pytest.approx(plain(r.c)), r.c
        assert f[10] == f[11] == 1.0 and f[12] == 0.0


def test_op4_short_secrets_and_long_candidates(spark):
    texts = [prose(i, 50) for i in range(40)]
    planted = {3: 'password = "hunter2#x"', 4: "db_passwd: kH7!q9zz", 5: "pwd=Sommer2024!"}
    harmless = {6: "password: alpha", 7: "the author = beta", 8: 'token = "********"'}
    for i, t in (planted | harmless).items():
        texts[i] += f" {t} tail"
    blob = base64.b64encode(np.random.default_rng(1).bytes(750_000)).decode()  # a megabyte
    df = spark.createDataFrame([*enumerate(texts), (99, f"data {blob} end")], "doc_id long, text string")
    forest = secrets.fit(df.filter("doc_id < 99"), sample_rows=40)
    start = time.time()
    found = secrets.findings(df, forest).collect()
    assert time.time() - start < 60
    said = {r.doc_id for r in found if r.secret and r.doc_id < 99}
    assert set(planted) <= said and not said & set(harmless)
    assert [r.length for r in found if r.doc_id == 99] == [len(blob)]
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.candidate for r in found if r.doc_id < 99)


def test_op4_forest_reads_as_the_model_votes(spark):
    printed = "M\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.5)\n     Predict: 0.0\n    Else (feature 0 > 2.5)\n     If (feature 1 <= 0.1)\n      Predict: 1.0\n     Else (feature 1 > 0.1)\n      Predict: 0.0\n  Tree 1 (weight 1.0):\n    Predict: 1.0\n"
    trees = secrets.read_forest(printed)
    df = spark.createDataFrame([([1.0, 0.0],), ([3.0, 0.0],), ([3.0, 1.0],)], "x array<double>")
    assert [r[0] for r in df.select(secrets.vote(trees, F.col("x"))).collect()] == [0.5, 1.0, 0.5]


def test_op5_exact_sizes_and_repeatable(docs, empty):
    rows = sharding.shard_documents(docs, shards=8).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(ROWS) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sharding.shard_documents(empty).count() == 0


def test_op5_draws_follow_the_law(spark):
    n = 4000
    df = spark.range(n).select(sharding.hypergeometric(sharding.uniform(F.lit(5), F.col("id")), F.lit(10).cast("long"), F.lit(30).cast("long"), F.lit(70).cast("long")).alias("k"))
    got = np.array([r.k for r in df.collect()])
    assert got.min() >= 0 and got.max() <= 10
    assert abs(got.mean() - 3.0) < 0.1 and abs(got.var() - 10 * 0.3 * 0.7 * 90 / 99) < 0.15


def test_op6_keeps_good_and_drops_junk(spark):
    good, junk = [prose(i, 40) for i in range(150)], [" ".join(random.Random(i).choice(["###", "$$$", "!!!"]) for _ in range(40)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate([*good, *junk])] + [(900, None), (901, ""), (None, good[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_x", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(i, 0, 0) for i in range(150, 170)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    done = {r.doc_id: r._kept for r in resampling.resample(df, labels).collect()}
    assert sum(done[i] for i in range(150)) >= 147 and not any(done[i] for i in range(150, 190))
    assert not done[900] and not done[901]
    assert resampling.resample(df, labels, k=20).filter("_kept").count() == 20
    assert resampling.resample(df, labels.limit(0)).filter("_kept").count() == 191
    assert resampling.resample(df.limit(0), labels).count() == 0


def test_op6_bar_from_good_and_bad_labels(spark):
    assert resampling.best_bar(np.array([4.0, 1.0, 5.0, 6.0]), np.array([0.0, 2.0, 3.0])) == 3.5
    assert resampling.best_bar(np.array([1.0, 4.0]), np.array([2.0]), 0.5) == 1.0
    good, junk = [prose(i, 40) for i in range(150)], [" ".join(random.Random(i).choice(["###", "$$$", "!!!"]) for _ in range(40)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate([*good, *junk])), "doc_id long, text string")
    # toxic rows that look like junk, and one good label on junk, say nothing about where good texts begin
    rows = [(i, 1, 0) for i in range(0, 150, 2)] + [(i, 1, 1) for i in range(150, 170)] + [(i, 0, 0) for i in range(170, 190)] + [(209, 1, 0)]
    done = {r.doc_id: r._kept for r in resampling.resample(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert sum(done[i] for i in range(150)) >= 147 and not any(done[i] for i in range(150, 209))


def test_op6_drops_labelled_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    done = resampling.resample(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id")
    share = {r.quality: r.share for r in done.groupBy("quality").agg(F.avg(F.col("_kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.2


def test_op6_keys_against_plain_python(spark):
    texts = [prose(i, 30) for i in range(40)] + ["### $$$", "", None, prose(0, 30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = [0, 2, 4, 6]
    got = resampling.keyed(df, resampling.models(df.withColumnRenamed("doc_id", "_id"), spark.createDataFrame([(i,) for i in target], "id long")), seed=5).collect()

    def buckets(text):
        h = [zlib.crc32(w.encode()) for w in (text or "").split()]
        pairs = [(a * 0x9E3779B1 + b * 0x85EBCA6B & 0xFFFFFFFF) ^ 0x5BD1E995 for a, b in zip(h, h[1:], strict=False)]
        return [x % 10_000 for x in h] + [(p ^ p >> 15) % 10_000 for p in pairs]

    raw, good = np.ones(10_000), np.ones(10_000)
    for i, t in rows:
        for b in buckets(t):
            raw[b] += 1
            good[b] += i in target
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for r in got:
        own = buckets(r.text)
        assert r._n_grams == len(own)
        if not own:
            assert r._key is None and r._log_ratio is None
            continue
        u = (zlib.crc32(f"5|{r.doc_id}|{r.text}".encode()) + 0.5) / 2**32
        assert r._log_ratio == pytest.approx(ratio[own].mean()) and r._key == pytest.approx(100 * ratio[own].mean() - np.log(-np.log(u)))


def test_op6_draws_the_k_largest_keys(spark):
    rows = [(i, prose(i, 20)) for i in range(60)] + [(7, prose(7, 20))] * 2  # repeated rows share their key
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("page no", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for k in (0, 1, 25, 500):
        done = resampling.resample(df, labels, k=k).collect()
        keys = sorted((r._key for r in done), reverse=True)
        bar = keys[min(k, len(keys)) - 1] if k else np.inf
        assert all(r._kept == (r._key >= bar) for r in done) and "page no" in done[0].asDict()
    ratio, marks, least = resampling.drawn(df, labels)
    assert marks.filter(F.col("_key") >= least).count() >= marks.count() // 3


def test_op6_kth_largest(spark):
    df = spark.range(5000).select((F.pmod(F.col("id") * 7919, F.lit(5003)) / 3.0).alias("_key"))
    values = sorted((r[0] for r in df.collect()), reverse=True)
    for k in (1, 7, 2500, 5000):
        assert resampling.kth_largest(df, k, few=50) == values[k - 1]


def test_op7_table(spark, docs, empty):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rows = token_table.token_digests(docs, P.path("word_bpe_49k.json")).orderBy("start").collect()
    at = 0
    known = collections.Counter((r[0], zlib.crc32(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in ROWS)
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in rows) == known
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_table.token_digests(empty, P.path("word_bpe_49k.json")).count() == 0


def test_op7_selective_read(spark, docs, tmp_path):
    path = f"file://{tmp_path}/t"
    token_table.write_tokens(docs.filter("doc_id is not null"), P.path("word_bpe_49k.json"), 2, path)
    some = token_table.read_tokens(spark, path, first=4, last=6, columns=["doc_id", "n_tokens"])
    assert sorted(r.doc_id for r in some.collect()) == [4, 5, 6]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,4)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_op8_learns_and_rejects(spark):
    rows = []
    for i in range(240):
        rng = random.Random(i)
        kind = i % 2
        rows.append((i, " ".join(rng.choice([["the", "and", "thing", "with"], ["der", "und", "schön", "nicht"]][kind]) for _ in range(60)), ["en", "de"][kind], "s", "x"))
    rows += [(1000, None, "en", "s", "x"), (1001, "123 ...", "de", "s", "x"), (1002, "der und nicht schön", None, "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    test = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out for r in test) and np.mean([got[r[0]].lang_pred == r[2] for r in test]) > 0.95
    assert got[1000].lang_pred == "und" and got[1001].lang_pred == "und" and got[1002].lang_pred == "de"
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.filter("lang is null")).collect()} == {"und"}


def test_op8_number_signs_are_no_letters_and_any_columns(spark):
    rows = [(i, ["the and with thing", "der und nicht schön"][i % 2], ["en", "de"][i % 2]) for i in range(60)] + [(900, "½ ² ①", "en"), (901, "ª", "en"), (902, "the " * 300_000, None), (902, "the " * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("page no", F.lit(1)).withColumn("score", F.lit("z"))
    network = language_id.fit(df, ~language_id.held_out())
    got = language_id.predict(df.withColumnRenamed("score", "own"), network, more=["page no"]).collect()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.lang_pred, r.score))
    assert by_id[900] == [("und", 0.0)] and by_id[901][0][0] != "und"
    assert len(set(by_id[902])) == 1 and by_id[902][0][0] == "en" and len(by_id[902]) == 2


def test_op8_forward_pass_against_plain_python(spark):
    network = language_id.Network.fresh(["a", "b", "c"], seed=1)
    rng = np.random.default_rng(2)
    network.out[:] = rng.standard_normal(network.out.shape)
    network.out_shift[:] = rng.standard_normal(3)
    text = "Grüße aus dem Süden! " * 30  # more than one window, the last not full
    data = text.encode()
    logits, total = np.zeros(3), 0
    for at in range(0, len(data), 256):
        window = data[at : at + 256].ljust(256, b"\0")
        hidden = []
        for width, filters, shift in zip(language_id.WIDTHS, network.filters, network.shifts, strict=True):
            seen = [np.concatenate([network.vectors[b] for b in window[i : i + width]]) @ filters for i in range(256 - width + 1)]
            hidden += np.maximum(np.max(seen, axis=0) + shift, 0).tolist()
        n = len(data[at : at + 256])
        logits, total = logits + n * (np.array(hidden) @ network.out + network.out_shift), total + n
    p = np.exp(logits / total - (logits / total).max())
    p /= p.sum()
    row = language_id.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), network).first()
    assert row.lang_pred == "abc"[int(p.argmax())] and row.score == pytest.approx(p.max(), rel=1e-4)


def test_op9_cut_and_broken_images(spark):
    rng = random.Random(3)
    whole = media.to_gif(rng.randbytes(64 * 5000))  # two frames
    full = gif.read(whole)
    assert len(full) == 2
    for at in [*range(0, 900, 7), *range(len(whole) - 300, len(whole), 7), len(whole) // 2]:
        got = gif.read(whole[:at])
        assert len(got) <= 2 and all((a.picture == b.picture).all() for a, b in zip(got, full, strict=False))
    for _ in range(60):
        broken = bytearray(whole)
        for _ in range(5):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        assert len(gif.read(bytes(broken))) <= 3000
    df = spark.createDataFrame([(1, whole), (2, whole[:500]), (3, b"text"), (4, None)], "doc_id long, media binary")
    assert collections.Counter(r.doc_id for r in media.read_media(df).collect()) == {1: 2}


def test_op9_reads_the_stream_of_another_writer():
    # fixed values: a picture of ten by ten pixels in four colours that is printed in the format's common tutorials
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert gif.lzw_decode(stream, 2, 100) == bytes(int(c) for r in rows for c in r)


def test_op9_round_trip(docs, empty):
    want = []
    for source in ROWS:
        data = (source[1] or "").encode()
        payload = media.payload_of(data)
        assert len(payload) % 64 == 0 and payload and payload.startswith(data)
        want.append((source[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    rows = media.media_digests(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == collections.Counter(want)
    assert media.media_digests(empty).count() == 0
    assert media.read_media(media.write_media(docs)).count() == len(ROWS)


def test_op9_lzw_and_rules_of_drawing():
    rng = random.Random(1)
    for data in (b"a", b"\0" * 70000, bytes(range(256)) * 70, rng.randbytes(50000)):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    red_blue = bytes([255, 0, 0, 0, 0, 255]) + bytes(250 * 3 + 12)
    one = gif.write([(bytes([0, 0, 0, 0]), 2)], 2, palette=red_blue)
    body = gif.write([(bytes([0, 0, 0, 0]), 2), (bytes([1, 9, 9, 1]), 2)], 2, delay=7, palette=red_blue)
    assert gif.read(one)[0].box()[0, 0].tolist() == [255, 0, 0, 255]
    # the second frame with index 9 transparent, after a first one that is cleared away (disposal 2) or kept (1)
    second = body.rindex(b"\x21\xf9\x04")
    seen = {}
    for disposal in (1, 2):
        b = bytearray(body)
        first = body.index(b"\x21\xf9\x04")
        b[first + 3] = disposal << 2
        b[second + 3], b[second + 6] = (1 << 2) | 1, 9
        frames = gif.read(bytes(b))
        assert [f.at_ms for f in frames] == [0, 70]
        seen[disposal] = frames[1].picture[0].tolist()
    assert seen[1] == [[0, 0, 255, 255], [255, 0, 0, 255]] and seen[2] == [[0, 0, 255, 255], [0, 0, 0, 0]]


def brute_groups(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "few", "levels"), [(2048, 1 << 22, 6), (7, 3, 2)])
def test_op10_against_brute_force(spark, monkeypatch, block, few, levels):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HOT", block)
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    base = prose(77, 120).split()
    for k in range(60):  # copies edited ever further from their source, so that some link only through others
        rng = random.Random(k)
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(300 + k, prose(300 + k, 30)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0))
    groups, sizes = brute_groups(rows)
    got = near_dedup.near_duplicates(df, few=few, levels=levels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == groups[r.doc_id] and r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_op10_nulls_and_empty(spark, docs, empty):
    got = [r for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is None]
    assert len(got) == 1 and got[0].component_id is None and got[0].kept
    assert near_dedup.near_duplicates(empty).count() == 0


def test_op3_frequencies_cover_all_rows(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, prose(i % 9, 40)) for i in range(40)] + [(50, None)]
    table, _ = packing.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), P.path("byte_bpe_50k.json"), 0, "doc_id", "text")
    got = packing.inverse_frequencies(table, len(rows))
    want = collections.Counter(t for _, text in rows for t in {*library.encode(text or "").ids, 0})
    for t in [*want, 49_999]:
        assert got[t] == pytest.approx(np.log1p((len(rows) - want[t] + 0.5) / (want[t] + 0.5)))
