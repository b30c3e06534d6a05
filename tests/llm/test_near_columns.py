"""What the near-duplicate join carries between its passes, told by what its steps are given."""

import random

import numpy as np
import pyarrow as pa

from siltstone.llm import jaccard


def _corpus() -> list[tuple[int, str]]:
    """40 texts of 400 words, a near copy of each, and one passage of eight words that all have."""
    rng = random.Random(7)
    passage = " ".join(f"common{k}" for k in range(8))
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        rows.append((2 * k, " ".join([*words, passage])))
        rows.append((2 * k + 1, " ".join([*words[:390], *(f"v{rng.randrange(10**9)}" for _ in range(10)), passage])))
    return rows


def test_near_copies_carry_few_columns(spark, monkeypatch):
    """Columns that the same rows have are one, and rows that share too few open columns meet no other tile."""
    units, sent = [], []
    tiled, across = jaccard._tiled, jaccard._across

    def seen_tiled(frame, salt):
        units.append((frame.count(), frame.select("c", "slot").distinct().count()))
        return tiled(frame, salt)

    def seen_across(*frames):
        out = across(*frames)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_tiled", seen_tiled)
    monkeypatch.setattr(jaccard, "_across", seen_across)
    monkeypatch.setattr(jaccard, "SHARED_TILE", 2000)
    df = spark.createDataFrame(_corpus(), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.group_near(df).collect())
    assert got == [(d, 404, d - d % 2) for d in range(80)]
    columns, rows = units[0]
    assert rows == 80 and columns <= 8 * rows  # about 100 a row, if each shingle is a column
    assert sent == [0]  # the passage alone is no reason to compare


def test_heads_give_the_prefixes_that_texts_give():
    """A prefix taken from a head is the text's own; a head with too many frequent shingles gives none."""
    texts = [t.encode() for _, t in _corpus()[:20]] + [b"one", b"a b c d e f g"]
    some = np.concatenate([jaccard.shingles(t)[:k] for k, t in enumerate(texts[:20])] + [jaccard.shingles(texts[20])[:90]])
    frequent = np.unique(some)
    heads = next(jaccard._headed.func(iter([pa.array(texts, pa.binary())])))
    want = next(jaccard._prefixed(frequent, np.ones(len(frequent), dtype=np.int64)).func(iter([pa.array(texts, pa.binary())]))).field("prefix").to_pylist()
    got = jaccard._rare_of(frequent).func(heads.field("head"), heads.field("n")).to_pylist()
    assert heads.field("digest").to_pylist()[0] and [len(g) for g in got].count(0) == 1 and not got[20]
    assert [g for g in got if g] == [w for g, w in zip(got, want, strict=True) if g]
