"""Language identification: multinomial logistic regression over hashed TF-IDF character n-grams.

Texts are lower-cased; their 1- to 3-grams of code points are hashed to ``DIMS`` counters, log-scaled, weighed by
inverse document frequency and normalised.  The weights are trained with follow-the-regularised-leader
(proximal, per-coordinate rates, L1 and L2 penalties), which leaves most of them zero; then one
temperature is set by likelihood on labelled rows kept out of training, so that scores are probabilities.

Scale: training reads a sample of the same number of labelled rows for every language, ``TRAIN_ROWS`` in all but
``LEAST_ROWS`` of a language, or all it has.  It is drawn by a hash of id and text (counts of distinct hashes first,
no sort), its features are made on the executors; the driver gets at most ``DIMS`` numbers a row.  Document
frequencies are counted over all labelled rows that may be learned from, by one more scan.  Prediction is one scan without a shuffle; the model is ``DIMS`` by languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, with_fields

DIMS = 1 << 15
#: Labelled rows that training takes, and the share that calibration keeps: one in so many.
TRAIN_ROWS, KEPT_OUT = 2000, 5
#: Rows that each language has at least, if it has so many; more languages mean more rows.
LEAST_ROWS = 100
#: Rows drawn for one that is taken: counts of distinct hashes are approximate.
SPARE = 2
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.002
#: Code points that are hashed at a time.
CHUNK = 1 << 20
#: Odd multipliers, one for each place of an n-gram, and one that spreads the sum.
_MULTIPLY = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_SPREAD = np.uint32(0x27D4EB2F)


def counts_of(text: str) -> np.ndarray:
    """How often each of ``DIMS`` n-gram hashes occurs in the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(DIMS, dtype=np.int64)
    for start in range(0, len(points), CHUNK):
        part = points[start : start + CHUNK + 2]
        for n in (1, 2, 3):
            ends = min(CHUNK, len(part) - n + 1)  # n-grams that begin in this chunk
            if ends <= 0:
                continue
            mixed = np.full(ends, n, dtype=np.uint32)
            for k in range(n):
                mixed = (mixed + part[k : k + ends]) * _MULTIPLY[k]
                mixed ^= mixed >> np.uint32(15)
            total += np.bincount((mixed * _SPREAD) >> np.uint32(17), minlength=DIMS)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = counts_of(text)
    at = np.flatnonzero(counts)
    return weighed(at, counts[at], idf)


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.log1p(counts) * idf[at]
    norm = np.linalg.norm(values)
    return at, values / norm if norm else values


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader for a softmax over classes."""

    def __init__(self, dims: int, classes: int):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(values @ w)
        error[label] -= 1
        gradient = np.outer(values, error)
        rate = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - rate * w
        self.n[at] += gradient**2


def temperature_for(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the greatest likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, golden = np.log(0.1), np.log(10.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        one, other = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, other) if loss(one) <= loss(other) else (one, high)
    return float(np.exp((low + high) / 2))


def train(rows: list[tuple[list[int], list[int], str]], seen: np.ndarray, n_docs: int) -> dict:
    """A model of (n-gram hashes, counts, language) rows, in the order given; none: no languages.

    ``seen`` is in how many of ``n_docs`` documents each n-gram hash occurs.
    """
    names = sorted({lang for _, _, lang in rows})
    sparse = [(np.asarray(at, dtype=np.int64), np.asarray(n, dtype=np.float64), names.index(lang)) for at, n, lang in rows]
    idf = np.log((1 + n_docs) / (1 + seen)) + 1
    leader = Leader(DIMS, len(names))
    ready = [(*weighed(at, n, idf), y) for at, n, y in sparse]
    kept = [x for k, x in enumerate(ready) if k % KEPT_OUT == KEPT_OUT - 1]
    for _ in range(EPOCHS):
        for k, x in enumerate(ready):
            if k % KEPT_OUT != KEPT_OUT - 1:
                leader.learn(*x)
    weights = leader.weights(slice(None)).astype(np.float32)
    logits = np.array([values @ weights[at] for at, values, _ in kept]).reshape(len(kept), len(names))
    return {"names": names, "idf": idf.astype(np.float32), "weights": weights, "temperature": temperature_for(logits, np.array([y for *_, y in kept], dtype=np.int64))}


def predict(text: str | None, model: dict) -> tuple[str, float]:
    if not text or not model["names"] or not any(map(str.isalpha, text)):
        return "und", 0.0
    at, values = features(text, model["idf"])
    p = softmax(values @ model["weights"][at] / model["temperature"])
    k = int(p.argmax())
    return model["names"][k], float(p[k])


@F.arrow_udf(T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))]))
def _counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    for batch in texts:
        out = []
        for text in batch:
            counts = counts_of(text.as_py() or "")
            at = np.flatnonzero(counts)
            out.append({"at": at.astype(np.int32), "n": counts[at]})
        yield pa.array(out, type=kind)


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is the text "null"."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen += counts_of(text.as_py()) > 0
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["at", "n"])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of one column of texts each n-gram hash occurs, and the number of rows."""
    seen, n_docs = np.zeros(DIMS), 0
    for r in texts.mapInArrow(_document_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if r["at"] < 0:
            n_docs = r["n"]
        else:
            seen[r["at"]] = r["n"]
    return seen, n_docs


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> dict:
    """A model of the labelled rows that aren't held out and have a text.

    Of every language, the rows of the least hashes of id and text; copies of both count once.  Ties are in the order
    of id and a second hash of the text, so reruns agree.  Without such rows, as of an empty table, the model knows no language.
    Texts of any length are read whole; no other column is read.
    """
    id_, text = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")), F.col(quoted(text_col))
    learnable = docs.where(F.col(quoted(lang_col)).isNotNull() & text.isNotNull() & ~held_out(F.col(quoted(id_col))))
    labelled = learnable.select(id_.alias("id"), F.col(quoted(lang_col)).alias("lang"), text.alias("text"), F.xxhash64(id_, text).alias("mark"), F.xxhash64(text).alias("key"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()}
    if not sizes:
        return train([], np.zeros(DIMS), 0)
    each = max(rows // len(sizes), LEAST_ROWS)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(SPARE * each / max(n, 1), 1) * 1_000_000_007))])
    drawn = labelled.where(F.pmod("mark", F.lit(1_000_000_007)) < F.element_at(share, F.col("lang")))
    once = drawn.groupBy("lang", "mark", "id", "key").agg(F.min("text").alias("text"))
    got, taken, left = once.select("lang", "mark", "id", "key", _counted(F.col("text")).alias("c")).collect(), [], dict.fromkeys(sizes, each)
    for r in sorted(got, key=lambda r: (r["mark"] % 1_000_000_007, r["mark"], r["id"], r["key"], r["lang"])):
        if left[r["lang"]]:
            left[r["lang"]] -= 1
            taken.append((r["c"]["at"], r["c"]["n"], r["lang"]))
    return train(taken, *document_frequencies(learnable.select(text)))


def identify(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    A text that is null or has no letter is ``und`` with score 0, as all are under a model that saw no
    labelled rows.  Of languages as probable the first by name is told; repeated rows each get the same.  Texts of any length
    are read whole; an empty table gives no rows.  No other column is read; columns named like the new ones are replaced.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [predict(t.as_py(), model) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["lang", "score"])

    return with_fields(docs, guess(F.col(quoted(text_col))), {"lang_pred": "lang", "score": "score"})
