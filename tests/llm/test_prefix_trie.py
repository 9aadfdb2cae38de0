"""The prefix trie against a plain version, on conversations with copies, nulls, ties, gaps and lengths."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from atrium.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}|{role}{text}".encode()).digest(), role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in own.items()}
    members, ends, kids, leaves, saved = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list), {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def found(spark, rows):
    got = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("k1", F.lit("y"))).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def made(seed, convs, texts, longest):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in convs for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = made(seed, range(60), ["a b", "a", "", None, "c\x0bd e"], 5)
    assert found(spark, rows) == plain(rows)


def test_defined_cases(spark):
    rows = [(None, 0, "user", "left out"), (40, None, "user", "first"), (40, 0, "user", "second"), (40, 0, None, "tie"), (40, 0, None, "tie"), (41, 7, "user", None), (41, 3, None, None), (42, 0, "us", "er"), (43, 0, "u", "ser")]
    rows += [(c, 0, "user", "x") for c in range(60, 90)]  # of one turn, so some have none of their own left
    rows += [(200, t, "user", f"long {t}") for t in range(700)] + [(219, t, "user", f"long {t}" if t < 500 else "other") for t in range(700)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert sum(r[1] == 0 for r in got) == 1


def test_lists_of_ids_over_several_pieces_and_many_children(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    rows = [(c, t, "user", "same words here") for c in range(0, 2000, 7) for t in range(3)] + [(3000 + c, t, "user", "hub" if t == 0 else f"own {c}") for c in range(0, 120) for t in range(4)]
    rows += [(-5, 0, "user", "same words here"), (-40, 0, "user", "hub")]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
