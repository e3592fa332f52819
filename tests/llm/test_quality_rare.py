"""Rare but pure features tell toxic documents, however many rows are rated."""

import numpy as np

from nearfield.llm import quality


def rows(n, seed):
    """Toxic rows are told from clean ones by one of 50 rare words alone, poor ones by one common word."""
    rng = np.random.default_rng(seed)
    grade = rng.choice(3, size=n, p=[0.14, 0.10, 0.76])
    rare = rng.integers(6000, 6050, n)
    return [np.unique([*rng.integers(0, 3000, 40), 5000 + (g > 0), *([r] if g == 1 else [])]) for g, r in zip(grade, rare, strict=True)], grade


def test_rare_words_tell_toxic_rows():
    model = quality.fit(*rows(6000, 0), 3)
    at, grade = rows(2000, 1)
    kept = model.tails(np.array([model.weights[x].sum() for x in at]))[:, -1] >= quality.MIN_TAIL
    assert kept[grade == 2].mean() > 0.98 and kept[grade == 1].mean() < 0.2 and kept[grade == 0].mean() < 0.05
