"""Linear decoders on cached features, chosen by their validation error: one output, or many from one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.operators import metrics
from chromaloom.session import materialise


def as_features(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vec)))


def fit_decoder(
    train: DataFrame,
    val: DataFrame,
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
    weight: str | None = None,
) -> tuple[LinearRegressionModel, DataFrame]:
    """Fit one model per L2 strength on rows (vec, y) and keep the one with the least validation error.

    Returns the model and the runs (reg_param, val_loss). The training rows are written once, not
    recomputed for every strength.
    """
    train = as_features(materialise(train, "decoder-train"))
    val = as_features(materialise(val, "decoder-val"))
    models, losses = {}, []
    for strength in reg_params:
        learner = LinearRegression(
            featuresCol="features", labelCol="y", predictionCol="y_hat", regParam=strength, standardization=False
        )
        if weight:
            learner = learner.setWeightCol(weight)
        models[strength] = learner.fit(train)
        losses.append((float(strength), metrics.mse(models[strength].transform(val)).first().mse))
    runs = train.sparkSession.createDataFrame(losses, "reg_param double, val_loss double")
    return models[metrics.best_run(runs).first().reg_param], runs


def score(model: LinearRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(as_features(rows)).drop("features")


# Partial moments are added up by this many tasks before the driver adds the rest.
FAN = 32


class Moments:
    """Weight, means and centred products of features and outputs side by side."""

    def __init__(self, weight: float, mean: np.ndarray, products: np.ndarray):
        self.weight, self.mean, self.products = weight, mean, products

    @classmethod
    def of(cls, values: np.ndarray, weights: np.ndarray) -> Moments:
        total = float(weights.sum())
        mean = weights @ values / total if total else np.zeros(values.shape[1])
        centred = values - mean
        return cls(total, mean, centred.T @ (centred * weights[:, None]))

    def __add__(self, other: Moments) -> Moments:
        total = self.weight + other.weight
        if not total:
            return self
        apart = other.mean - self.mean
        products = self.products + other.products + np.outer(apart, apart) * (self.weight * other.weight / total)
        return Moments(total, self.mean + apart * (other.weight / total), products)


def _plain(values: pa.Array, what: str) -> np.ndarray:
    """Lists of one length as a matrix."""
    lengths = set(values.value_lengths().to_pylist())
    flat = values.flatten()
    if len(lengths) != 1 or None in lengths or flat.null_count:
        raise ValueError(f"{what} must be complete and of one length, got lengths {sorted(map(str, lengths))}")
    return flat.to_numpy().reshape(len(values), -1)


def moments(rows: DataFrame, weight: str | None = None, fan: int = FAN) -> dict[str, Moments]:
    """Moments by split of rows (split, vec, ys), in one pass: each task sends one matrix per split.

    The matrices, square in features plus outputs, are added up in ``fan`` tasks and then on the driver, so neither
    rows nor the number of tasks reach it. Rows without a vector or labels must be left out before; a weight of
    zero counts for nothing.
    """
    schema = "split string, part int, weight double, mean array<double>, products array<double>"

    def packed(found: dict[str, Moments], part: int) -> Iterator[pa.RecordBatch]:
        for split, own in found.items():
            fields = [[split], [part], [own.weight], [own.mean.tolist()], [own.products.ravel().tolist()]]
            types = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            names = ["split", "part", "weight", "mean", "products"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(fields, types)], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.hstack([_plain(batch.column("vec"), "features"), _plain(batch.column("ys"), "outputs")])
            weights = batch.column("w").to_numpy()
            names = np.array(batch.column("split").to_pylist(), object)
            for split in set(names):
                here = names == split
                own = Moments.of(values[here], weights[here])
                found[split] = found[split] + own if split in found else own
        yield from packed(found, TaskContext.get().partitionId() % fan)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                mean = np.array(row["mean"])
                own = Moments(row["weight"], mean, np.array(row["products"]).reshape(len(mean), -1))
                found[row["split"]] = found[row["split"]] + own if row["split"] in found else own
        yield from packed(found, 0)

    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    plain = rows.select(
        F.col("split").cast("string").alias("split"), *[F.col(c).cast("array<double>").alias(c) for c in ("vec", "ys")], weights.alias("w")
    )
    sums = plain.mapInArrow(partial, schema)
    dealt = sums.repartition(fan, "part").mapInArrow(added, schema).toArrow()
    found: dict[str, Moments] = {}
    for row in sorted(dealt.to_pylist(), key=lambda r: (r["split"], r["weight"], r["mean"])):
        mean = np.array(row["mean"])
        own = Moments(row["weight"], mean, np.array(row["products"]).reshape(len(mean), -1))
        found[row["split"]] = found[row["split"]] + own if row["split"] in found else own
    return found


class LinearDecoder:
    """Several linear outputs: coefficients (features x outputs), intercepts, and the L2 strength they were fitted with."""

    def __init__(self, coefficients: np.ndarray, intercepts: np.ndarray, strength: float):
        self.coefficients, self.intercepts, self.strength = coefficients, intercepts, strength

    def predict(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        """``rows`` with an array ``y_hat``, one value per output; the products are made inside the row."""
        outputs = []
        for weights, base in zip(self.coefficients.T, self.intercepts):
            fixed = F.array(*[F.lit(float(w)) for w in weights])
            products = F.zip_with(F.col(vec).cast("array<double>"), fixed, lambda x, w: x * w)
            outputs.append(F.aggregate(products, F.lit(float(base)), lambda total, x: total + x))
        return rows.withColumn("y_hat", F.array(*outputs))


def _losses(held: Moments, model: LinearDecoder) -> np.ndarray:
    """Mean squared error of each output, from the moments alone."""
    features = len(model.coefficients)
    xx, xy = held.products[:features, :features], held.products[:features, features:]
    yy = np.diag(held.products[features:, features:])
    b = model.coefficients
    spread = (yy - 2 * (b * xy).sum(0) + (b * (xx @ b)).sum(0)) / held.weight
    shift = held.mean[features:] - held.mean[:features] @ b - model.intercepts
    return spread + shift**2


def fit_outputs(
    rows: DataFrame, reg_params: Sequence[float], weight: str | None = None, train: str = "train", val: str = "val"
) -> tuple[LinearDecoder, DataFrame]:
    """Ridge regressions of all outputs for every strength, from one pass over rows (split, vec, ys).

    The strength with the least validation error, averaged over outputs, is kept (the smallest of equal ones). The
    intercept is not penalised; directions without variance get no weight at strength 0. Returns the decoder and the
    runs (reg_param, output, val_loss). Without training or validation rows there is nothing to choose from: an error.
    """
    found = moments(rows, weight)
    if not all(found.get(split) and found[split].weight > 0 for split in (train, val)):
        raise ValueError(f"rows of both {train} and {val} are needed")
    features = rows.where(F.col("split") == train).select(F.size("vec")).first()[0]
    own, held = found[train], found[val]
    values, axes = np.linalg.eigh(own.products[:features, :features] / own.weight)
    turned = axes.T @ (own.products[:features, features:] / own.weight)
    models, losses = {}, []
    for strength in reg_params:
        stretched = values + strength
        inverse = np.where(stretched > 1e-12 * max(values.max(), 1e-300), 1 / np.where(stretched == 0, 1, stretched), 0.0)
        coefficients = axes @ (inverse[:, None] * turned)
        models[strength] = LinearDecoder(coefficients, own.mean[features:] - own.mean[:features] @ coefficients, float(strength))
        losses += [(float(strength), k, float(loss)) for k, loss in enumerate(_losses(held, models[strength]))]
    runs = rows.sparkSession.createDataFrame(losses, "reg_param double, output int, val_loss double")
    means = {s: np.mean([loss for r, _, loss in losses if r == s]) for s in map(float, reg_params)}
    best = min(means, key=lambda s: (means[s], s))
    return models[next(s for s in reg_params if float(s) == best)], runs


def output_scores(preds: DataFrame) -> DataFrame:
    """(output, mse, pearson, spearman) of rows (ys, y_hat), arrays with a value per output."""
    both = F.posexplode(F.arrays_zip(F.col("ys").alias("y"), F.col("y_hat").alias("y_hat")))
    long_form = preds.select(both.alias("output", "v")).select("output", "v.y", "v.y_hat")
    long_form = materialise(long_form, "output-predictions")
    keys = ["output"]
    scores = metrics.mse(long_form, keys).join(metrics.pearson(long_form, keys), keys)
    return scores.join(metrics.spearman(long_form, keys), keys)
