"""One text has one score, whatever stands beside it and however the table is cut."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.llm import language_id


@pytest.fixture(scope="module")
def network():
    net, rng = language_id.Network.fresh(["a", "b", "c"]), np.random.default_rng(1)
    net.out = rng.standard_normal(net.out.shape).astype("float32")
    net.shifts = [rng.standard_normal(len(s)).astype("float32") for s in net.shifts]
    return net


def test_logits_are_those_of_matrix_products_and_do_not_move_with_the_window(network):
    rng = np.random.default_rng(2)
    own, other = (rng.integers(0, 256, (235, language_id.WINDOW)).astype("uint8") for _ in range(2))
    alone = network.logits(own)
    for moved in (*range(0, 64, 7), 1, 63):
        for tail in (0, 1, 40, 64):
            assert np.array_equal(network.logits(np.concatenate([other[:moved], own, other[:tail]]))[moved : moved + len(own)], alone)
    x = network.vectors[own]
    hidden = [np.maximum((np.stack([x[:, o : x.shape[1] - w + 1 + o] for o in range(w)], axis=2).reshape(len(x), -1, w * x.shape[2]) @ f + s).max(axis=1), 0) for w, f, s in zip(language_id.WIDTHS, network.filters, network.shifts, strict=True)]
    assert np.allclose(np.concatenate(hidden, axis=1) @ network.out + network.out_shift, alone, atol=1e-4)


def test_equal_texts_have_equal_scores_in_every_layout(spark, network):
    texts = ["the same text of some words " * k for k in (1, 3, 40, 900, 20_000)]
    rows = [(i, texts[i % 5] if i % 3 else "something else " * (i * 37 % 91 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for parts in (1, 3, 8):
        got = language_id.predict(df.repartition(parts, F.xxhash64("doc_id", F.lit(parts))), network, more=["text"])
        seen += [(r.text, r.lang_pred, r.score) for r in got.filter(F.length("text") > 0).collect()]
    assert len(set(seen)) == len({t for t, _, _ in seen})
