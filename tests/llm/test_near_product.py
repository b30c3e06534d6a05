"""The sparse product: a tile against all pairs, and many small and cut tiles against one."""

import numpy as np
import pytest

from siltstone.llm import jaccard, product


def components(sets):
    part = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(set(x.tolist()) & set(y.tolist()))
            if 100 * both >= 75 * (len(x) + len(y) - both) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return part


@pytest.mark.parametrize("seed", range(8))
def test_tile(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 60, rng.integers(1, 60)).astype(np.uint64) for _ in range(6)]
    common = rng.integers(0, 1 << 60, 10).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base[rng.integers(6)].copy()
        change = rng.random(len(s)) < rng.choice([0.03, 0.1, 0.15])
        s[change] = rng.integers(0, 1 << 60, change.sum())
        sets.append(np.unique(np.concatenate([s, common[: rng.integers(0, 10)]])))
    want = components(sets)
    none = np.ones(len(sets), dtype=bool)
    assert product.merged_parts(sets, np.arange(len(sets)), none).tolist() == want
    assert product.merged_parts(sets, np.array(want), none).tolist() == want
    assert product.merged_parts(sets, np.arange(len(sets)), ~none).tolist() == list(range(len(sets)))
    assert product.merged_parts([], np.arange(0), none[:0]).tolist() == []


def test_small_tiles(spark, monkeypatch):
    """A large group of near copies, a group that shares much and links little, and pairs, all cut over many tiles."""
    rng = np.random.default_rng(5)
    word = lambda k: f"w{k}"
    rows = []
    for group, (copies, changes) in enumerate([(120, 1), (80, 4), (60, 8), (2, 1), (2, 2), (3, 3)]):
        base = [word(k) for k in rng.integers(0, 100_000, 90)]
        for _ in range(copies):
            w = list(base)
            for at in rng.integers(0, 90, changes):
                w[at] = word(rng.integers(0, 100_000))
            rows.append((len(rows) * 3 % 997 + 1000 * group, " ".join(w[: 90 - rng.integers(0, 12)])))
    rows += [(50_000, rows[0][1] + " x"), (50_000, rows[130][1] + " y")]  # an id with two texts connects their groups
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [jaccard.shingles(t.encode()) for _, t in rows]
    part = components(sets)
    low, high = sorted((part[-1], part[-2]))
    part = [low if p == high else p for p in part]
    least = {}
    for (d, _), p in zip(rows, part, strict=True):
        least[p] = min(d, least.get(p, d))
    want = sorted((d, len(s), least[p]) for (d, _), s, p in zip(rows, sets, part, strict=True))
    for shared, cuts in ((1 << 18, 1 << 19), (300, 400)):
        monkeypatch.setattr(jaccard, "SHARED_TILE", shared)
        monkeypatch.setattr(jaccard, "CUT_TILE", cuts)
        assert sorted(tuple(r) for r in jaccard.group_near(df).collect()) == want
