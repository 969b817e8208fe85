"""Quality classifier: naive Bayes support vectors on hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import cut, mix64, small_batches, tidy, words_of

#: Log2 of the number of n-gram indicators; the model is two arrays of that length, whatever the input.
BITS = 18
#: Labelled rows that the classifier is fitted on at most (chosen by a hash of the id), and the parts it is fitted in.
FIT_ROWS, PARTS = 12_000, 8
PENALTY, EPOCHS = 1.0, 12


@dataclass
class Model:
    """weights: hinge-loss weights times log-count ratios, by indicator; slope and offset turn a margin into a score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margins = np.array([self.margin(indicators(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(max(1, len(at)))) + self.bias


def indicators(text: str | None) -> np.ndarray:
    """Sorted places of the n-grams that occur: character trigrams and 4-grams (bytes), words and pairs of words.

    A word equal to the one before it reads as one fixed word, so that runs of any repeated word share their pairs.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        return np.empty(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    tri = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16) if len(b) > 2 else b[:0]
    four = tri[:-1] | b[3:] << np.uint64(24) if len(b) > 3 else b[:0]
    words = np.array(list(map(xxhash.xxh3_64_intdigest, words_of(text))), np.uint64)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    words[again] = np.uint64(7)
    pairs = mix64(words[:-1]) ^ words[1:]
    kinds = [tri | np.uint64(1) << np.uint64(40), four | np.uint64(2) << np.uint64(40), words, pairs]
    at = np.sort((mix64(np.concatenate(kinds)) >> np.uint64(64 - BITS)).astype(np.int32))
    return at[np.append(True, at[1:] != at[:-1])]


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, epochs: int) -> tuple[np.ndarray, float]:
    """Linear L1-hinge support vectors by dual coordinate descent over rows of ratio-scaled indicators of unit scale.

    Costs are weighted so that both classes count alike. Returns (weights by indicator, bias).
    """
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    share = np.array([max(1, (y == s).sum()) for s in (-1, 1)])
    upper = np.where(y > 0, penalty * len(y) / (2 * share[1]), penalty * len(y) / (2 * share[0]))
    alpha, order = np.zeros(len(y)), np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratio, bias


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit_quality(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on rows with an id, a text and a label 0 or 1; other rows don't count. Of more than fit_rows labelled rows about
    fit_rows are used, by a hash of the id (a documented bound). The rows are dealt to PARTS tasks by that hash:

    1. indicator counts per class over the fitted rows give log-count ratios;
    2. each task fits on its part by dual coordinate descent; weights are averaged;
    3. a logistic curve turns margins into scores: each part's margins come from the average of the others' weights.

    With one class only, or no rows, the score is a constant.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).cast("int").alias("_y"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [indicators(t).astype("<i4").tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(at, pa.binary())], names=["_id", "_y", "at"])
        tidy()

    part = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(PARTS)).cast("int")
    data = cut(rows.mapInArrow(featurise, "_id string, _y int, at binary").withColumn("part", part))
    tally = {r["_y"]: r["n"] for r in data.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    size = 1 << BITS
    if len(tally) < 2:
        p = 0.5 if not tally else float(next(iter(tally)))
        return Model(np.zeros(size, np.float32), 0.0, 1.0, float(np.log((p + 0.01) / (1.01 - p))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, size), np.int64)
        for b in batches:
            for y, at in zip(b["_y"], b["at"], strict=True):
                n[y, np.frombuffer(at, "<i4")] += 1
        hit = np.flatnonzero(n.sum(axis=0))
        yield pd.DataFrame({"at": hit, "n0": n[0, hit], "n1": n[1, hit]})

    counts = data.select("_y", "at").mapInPandas(count, "at int, n0 bigint, n1 bigint").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    p, q = np.ones(size), np.ones(size)
    p[counts["at"]] += counts["n1"]
    q[counts["at"]] += counts["n0"]
    ratio = np.log(p / (tally[1] + 2)) - np.log(q / (tally[0] + 2))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("_id")
        found = [np.frombuffer(a, "<i4") for a in g["at"]]
        w, bias = descend(found, np.where(g["_y"].to_numpy() > 0, 1.0, -1.0), ratio, PENALTY, EPOCHS)
        tidy()
        return pd.DataFrame({"part": [int(g["part"].iloc[0])], "w": [w.astype("<f4").tobytes()], "bias": [bias]})

    fitted = data.groupBy("part").applyInPandas(fit, "part int, w binary, bias double").toPandas().sort_values("part")
    parts = dict(zip(fitted["part"], zip([np.frombuffer(w, "<f4") for w in fitted["w"]], fitted["bias"], strict=True), strict=True))
    weights, bias = np.mean([w for w, _ in parts.values()], axis=0, dtype=np.float64).astype(np.float32), float(np.mean([b for _, b in parts.values()]))
    others = {k: ((weights * len(parts) - w) / max(1, len(parts) - 1), (bias * len(parts) - b) / max(1, len(parts) - 1)) for k, (w, b) in parts.items()} if len(parts) > 1 else parts

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = [float(others[k][0][i].sum() / np.sqrt(max(1, len(i)))) + others[k][1] for k, i in ((k, np.frombuffer(a, "<i4")) for k, a in zip(b["part"], b["at"], strict=True))]
            yield pd.DataFrame({"m": m, "y": b["_y"]})

    margins = data.mapInPandas(cross, "m double, y int").toPandas().sort_values(["m", "y"])
    slope, offset = _platt(margins["m"].to_numpy(float), margins["y"].to_numpy())
    return Model(weights, bias, slope, offset)


def sample_labels(labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> DataFrame:
    """All labels, or about fit_rows of them by a hash of the id; the share is set so that the bound is met on average."""
    total = labels.count()
    if total <= fit_rows:
        return labels
    return labels.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1. Null and blank texts have no n-grams and get the curve's value there.

    Rows stay, repeated ones alike; a column named like the score is replaced, others stay whatever their names. An empty
    table gives an empty result."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = shared.value.scores(b.column(text_col).to_pylist()) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(values, pa.float64())], names=[*names, score_col])
        tidy()

    schema = docs.select(*names).schema.add(score_col, "double")
    return docs.select(*names).mapInArrow(score, schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Texts of the usable labelled rows, at most about fit_rows of them: a list of ids of that bound is sent to the scan.

    Null ids and labels other than 0 and 1 don't count; a document with both labels has the lower one."""
    usable = usable & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)
    chosen = sample_labels(labels.filter(usable).groupBy("doc_id").agg(F.min(label_col).alias(label_col)), fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
