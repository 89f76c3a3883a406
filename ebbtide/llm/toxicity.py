"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. Each model is a logistic regression over
word and word-beginning features, a few figures of the text, and the probabilities that the
chain gave for the earlier categories. What a model sees of an earlier category in training
are out-of-fold predictions, made by models that did not learn from that row; in prediction
it sees those of the model fitted to all rows.

Fitting uses a bounded sample of the labelled rows, ``max_rows``, chosen by a hash of doc_id.
Features are chosen by how strongly they tell a category apart in that sample, ``per_category``
for each; the models behind the out-of-fold predictions use features chosen without that fold.
The model is a few thousand numbers. Prediction is a projection: whole texts, no
shuffle.

Words are runs of letters, marks and digits, lower-cased; a feature is present or not. Null
texts and texts without a word have probability 0 in every category. Repeated labels of one
doc_id count as their maximum. A null label says nothing: the row still counts for every
category that its other label decides. A category without a positive row in the sample has
probability 0 everywhere. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa

from ebbtide.llm import words as W
from ebbtide.llm.scratch import hash_share, stored
from pyspark.sql import Column, DataFrame, Window, functions as F

#: What the labels tell apart, in the order of the chain.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 AND quality = 0",
}
DECIDES = "toxic"
THRESHOLD = 0.4
MAX_ROWS = 20_000
PER_CATEGORY = 256
FOLDS = 3
#: A feature is a word, or its first bytes of one of these lengths.
PREFIXES = (4, 5, 6, 7, 8)
LEAST_ROWS = 2
PENALTY = 0.3
FIGURES = 3
TABLE_BITS = 18


@dataclass
class Chain:
    """Fitted weights by category: features, then figures, then earlier categories."""

    features: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    rows: int = 0
    positives: dict[str, int] = field(default_factory=dict)


def _inputs(docs: DataFrame) -> tuple[Column, Column]:
    clean = W.normalised(docs["text"])
    kept = F.length(clean) / F.greatest(F.length(docs["text"]), F.lit(1))
    return clean, kept


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of every feature occurrence, stretch by stretch. A word comes first."""
    for rows, hashes, heads in W.segments(texts, PREFIXES):
        yield rows, hashes
        for head in heads:
            yield rows[head != 0], head[head != 0]


def _figures(texts: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few figures of each text, and its number of words."""
    data, ends = W.buffer_of(texts)
    size = np.diff(ends)
    spaces = np.concatenate(([0], np.cumsum(data[ends[0]:ends[-1]] == W.SPACE)))[ends - ends[0]]
    count = np.where(size > 0, np.diff(spaces) + 1, 0)
    figures = np.stack([np.log1p(count), kept, size / np.maximum(count, 1)], axis=1)
    return np.nan_to_num(figures), count


def _unique(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


class _Chosen:
    """Finds the chosen features among many hashes: a bit table first, then a search."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[features >> np.uint64(64 - TABLE_BITS)] = True

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every chosen feature of the texts, each once."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, hashes in _features(texts):
            likely = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
            rows, hashes = rows[likely], hashes[likely]
            at = np.searchsorted(self.features, hashes)
            hit = at < len(self.features)
            hit[hit] = self.features[at[hit]] == hashes[hit]
            found.append(_unique(rows[hit], at[hit]))
        return _unique(*map(np.concatenate, zip(*found)))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(text, kept, fold, category...)`` of a bounded sample of the labelled documents. A
    category that the labels of a document leave open is null."""
    known = labels.select(labels["doc_id"].alias("id"), labels["quality"].alias("quality"),
                          labels["toxic"].alias("toxic")).where(
        "id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = stored(known, "labels")
    rate = min(1.0, 0.97 * max_rows / max(1, known.count()))
    chosen = known.where(hash_share(F.col("id"), 3) < rate).select(
        "id", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(FOLDS)).cast("int").alias("fold"),
        *[F.expr(f"CAST({rule} AS INT)").alias(name) for name, rule in CATEGORIES.items()])
    clean, kept = _inputs(docs)
    # At most about max_rows rows of a few numbers.
    return docs.select(docs["doc_id"].alias("id"), clean.alias("text"), kept.alias("kept")).join(
        F.broadcast(chosen), "id")


def choose_features(rows: DataFrame, per_category: int = PER_CATEGORY) -> list[np.ndarray]:
    """Hashes of the features that tell some category apart best, in order: for each fold
    those of the rows outside it, and at last those of all rows."""
    names = list(CATEGORIES)
    sums = [f"{kind}_{n}" for n in names for kind in ("known", "is")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            found = [_unique(*f) for f in _features(batch.column("text"))]
            if not found:
                continue
            at, hashes = _unique(*map(np.concatenate, zip(*found)))
            hashes, group = np.unique(hashes, return_inverse=True)
            cell = group * FOLDS + batch.column("fold").to_numpy()[at]
            cells, cell = np.unique(cell, return_inverse=True)
            counts = []
            for name in names:
                column = batch.column(name)
                counts += [column.is_valid().to_numpy(zero_copy_only=False),
                           column.fill_null(0).to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.signed(hashes[cells // FOLDS])), pa.array((cells % FOLDS).astype(np.int32)),
                 *[pa.array(np.bincount(cell, c[at], len(cells)).astype(np.int64)) for c in counts]],
                names=["feature", "fold", *sums])

    def without(fold: int, column: str):
        """The sum over all folds but one; over all, if there is no such fold."""
        return F.sum(F.when(F.col("fold") != fold, F.col(column)).otherwise(0))

    choices = range(FOLDS + 1)
    total = rows.groupBy("fold").agg(*[
        f(n).alias(f"{kind}_{n}") for n in names for kind, f in (("known", F.count), ("is", F.sum))])
    total = [r.asDict() for r in total.collect()]
    strengths = []
    for choice in choices:
        for name in names:
            known, positive = (sum(r[f"{kind}_{name}"] or 0 for r in total if r["fold"] != choice)
                               for kind in ("known", "is"))
            if not positive:
                continue
            share, n = positive / known, without(choice, f"known_{name}")
            expected = n * share
            # Squared distance of the positive rows from what chance gives, in its variance.
            strength = F.pow(without(choice, f"is_{name}") - expected, 2) / (
                expected * (1 - share) + 0.5)
            strengths.append(F.struct(
                F.lit(choice).alias("choice"), F.lit(name).alias("name"),
                F.when(n >= LEAST_ROWS, strength).alias("strength")))
    chosen = [set() for _ in choices]
    if strengths:
        counts = rows.select("text", "fold", *names).mapInArrow(
            run, "feature long, fold int, " + ", ".join(f"{c} long" for c in sums))
        each = counts.groupBy("feature").agg(F.array(*strengths).alias("all")).select(
            "feature", F.inline("all")).where("strength IS NOT NULL")
        order = Window.partitionBy("choice", "name").orderBy(F.desc("strength"), "feature")
        # At most per_category rows of each choice and category.
        best = each.withColumn("place", F.row_number().over(order)).where(
            F.col("place") <= per_category)
        for r in best.select("choice", "feature").distinct().collect():
            chosen[r["choice"]].add(r["feature"])
    return [np.sort(np.array(sorted(c), dtype=np.int64).view(np.uint64)) for c in chosen]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_linear(row: np.ndarray, column: np.ndarray, columns: int, dense: np.ndarray,
               target: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with conjugate gradients; the last weight is the
    intercept and is not penalised. ``use`` says which rows count."""
    n, d = len(target), columns + dense.shape[1] + 1
    penalty = np.full(d, PENALTY)
    penalty[-1] = 1e-6

    def times(w: np.ndarray) -> np.ndarray:
        return (np.bincount(row, w[:columns][column], n) + dense @ w[columns:-1] + w[-1]) * use

    def back(r: np.ndarray) -> np.ndarray:
        r = r * use
        return np.concatenate([np.bincount(column, r[row], columns), dense.T @ r, [r.sum()]])

    w = np.zeros(d)
    for _ in range(12):
        p = _logistic(times(w))
        gradient = back(p - target) + penalty * w
        if np.abs(gradient).max() < 1e-3:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, rest = np.zeros(d), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(25):
            bent = back(curve * times(way)) + penalty * way
            rate = size / (way @ bent)
            step, rest = step + rate * way, rest - rate * bent
            size, before = rest @ rest, size
            if size < 1e-6 * (gradient @ gradient):
                break
            way = rest + size / before * way
        w = w + step
    return w


def _fit_chain(group: pd.DataFrame, usable: np.ndarray) -> pd.DataFrame:
    """All models of the chain, from the rows of the sample. ``usable`` says which features
    the model without a fold may use, in its last row those of the model of all rows."""
    listed = [np.asarray(x, np.int64) for x in group["present"]]
    row = np.repeat(np.arange(len(group)), [len(x) for x in listed])
    column = np.concatenate(listed) if len(listed) else np.zeros(0, np.int64)
    columns = usable.shape[1]
    figures = np.stack(group["figures"].to_numpy())
    mean, scale = figures.mean(axis=0), figures.std(axis=0) + 1e-6
    dense, fold = (figures - mean) / scale, group["fold"].to_numpy()
    result = [("mean", mean), ("scale", scale)]
    for name in CATEGORIES:
        target = group[name].to_numpy(float)
        known = ~np.isnan(target)
        target = np.where(known, target, 0.0)
        out = np.zeros(len(group))
        if target.any():
            for f in range(FOLDS + 1):
                kept = usable[f][column]
                w = fit_linear(row[kept], column[kept], columns, dense, target,
                               (known & (fold != f)).astype(float))
                if f == FOLDS:
                    result.append((name, np.concatenate((w[:columns][usable[f]], w[columns:]))))
                    continue
                z = np.bincount(row, w[:columns][column], len(group)) + dense @ w[columns:-1] + w[-1]
                out = np.where(fold == f, _logistic(z), out)
        dense = np.column_stack([dense, out])
    return pd.DataFrame({"name": [n for n, _ in result], "weights": [list(w) for _, w in result]})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
        per_category: int = PER_CATEGORY) -> Chain:
    """The chain, fitted to a bounded sample of the labelled documents."""
    rows = stored(sample(docs, labels, max_rows), "sample")
    choices = choose_features(rows, per_category)
    features = np.unique(np.concatenate(choices))
    usable = np.array([np.isin(features, c) for c in choices])
    chosen = _Chosen(features)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            at, number = chosen.present(batch.column("text"))
            figures, _ = _figures(batch.column("text"), batch.column("kept").to_numpy(
                zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(np.searchsorted(
                    at, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(number, pa.int64())),
                pa.array(list(figures)), batch.column("fold"),
                *[batch.column(n) for n in CATEGORIES]],
                names=["present", "figures", "fold", *CATEGORIES])

    matrix = rows.mapInArrow(present, "present array<long>, figures array<double>, fold int, "
                             + ", ".join(f"{n} int" for n in CATEGORIES))
    # The sample is bounded, and so are its rows: numbers of chosen features.
    fitted = matrix.groupBy(F.lit("all").alias("one")).applyInPandas(
        lambda group: _fit_chain(group, usable), "name string, weights array<double>")
    found = {r["name"]: np.array(r["weights"]) for r in fitted.collect()}
    none = np.zeros(FIGURES)
    return Chain(choices[-1], found.pop("mean", none), found.pop("scale", none + 1), found)


def _predict(chain: Chain, chosen: _Chosen, texts: pa.Array, kept: np.ndarray) -> list[np.ndarray]:
    at, number = chosen.present(texts)
    figures, count = _figures(texts, kept)
    dense, columns, result = (figures - chain.mean) / chain.scale, len(chain.features), []
    for name in CATEGORIES:
        w = chain.weights.get(name)
        p = np.zeros(len(texts))
        if w is not None:
            z = np.bincount(at, w[:columns][number], len(texts)) + dense @ w[columns:-1] + w[-1]
            p = np.where(count > 0, _logistic(z), 0.0)
        result.append(p)
        dense = np.column_stack([dense, p])
    return result


def probabilities(docs: DataFrame, chain: Chain) -> Column:
    """A struct column with the probability of each category."""
    chosen = _Chosen(chain.features)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in CATEGORIES) + ">")
    def run(texts: pa.Array, kept: pa.Array) -> pa.Array:
        share = kept.to_numpy(zero_copy_only=False)
        found = [_predict(chain, chosen, texts.slice(at, n), share[at:at + n])
                 for at, n in W.spans(texts)]
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(p)) for p in zip(*found)] or [pa.array([], "float64")] * len(CATEGORIES),
            names=list(CATEGORIES))

    return run(*_inputs(docs))


def scored(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_<category>..., toxic)`` per document."""
    found = docs.select(docs["doc_id"].alias("doc_id"), probabilities(docs, chain).alias("p"))
    return found.select("doc_id", *[F.col(f"p.{n}").alias(f"p_{n}") for n in CATEGORIES],
                        (F.col(f"p.{DECIDES}") >= threshold).alias("toxic"))


def clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic; all columns stay."""
    return docs.where(probabilities(docs, chain)[DECIDES] < threshold)
