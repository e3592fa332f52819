"""Scores of prompts: one product a batch, blocks of prompts, odd widths."""

import numpy as np
import pytest

from nearfield.operators import vectors


@pytest.mark.parametrize("block", [4096, 4])
def test_best_of_each_class(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "PROMPTS", block)
    rng = np.random.default_rng(1)
    x, p = rng.standard_normal((40, 3)), rng.standard_normal((11, 3))
    classes = ["b", "a", "c"] * 3 + ["a", "b"]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [])], "vec_id long, embedding array<double>")
    prompts = spark.createDataFrame([*zip(classes, p.tolist(), strict=True), ("d", [1.0]), (None, [1.0] * 3), ("e", None)], "class string, vector array<double>")
    got = {(r.vec_id, r["class"]): r.score for r in vectors.class_scores(items, prompts, "vec_id", "embedding").collect()}
    want = {(i, c): max(float(v @ q) for q, k in zip(p, classes, strict=True) if k == c) for i, v in enumerate(x) for c in "abc"}
    assert {k: v for k, v in got.items() if k[0] < 100} == pytest.approx(want)
    assert all(v is None for k, v in got.items() if k[0] >= 100) and {k[0] for k in got} == {*range(40), 100, 101, 102}
    assert vectors.class_scores(items, prompts.where("false"), "vec_id", "embedding").count() == 0
