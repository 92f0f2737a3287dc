"""Scores of predictions (accession, gene_idx, y, y_hat) and similarity of expression profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.operators import ranks, skew
from chromaloom.session import materialise, small_side


def mse(df: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean squared error, over all rows or per key; the weight is off unless named."""
    square = F.pow(F.col("y_hat") - F.col("y"), F.lit(2.0))
    if weight is None:
        return df.groupBy(*keys).agg(F.avg(square).alias("mse"))
    return df.groupBy(*keys).agg((F.sum(square * F.col(weight)) / F.sum(weight)).alias("mse"))


def _ratio(covariance: Column, spread: Column, strict: bool) -> Column:
    """NULL for a constant column, or NaN (which then spoils a mean) when strict."""
    missing = F.lit(float("nan")) if strict else F.lit(None).cast("double")
    return F.when(spread == 0, missing).otherwise(F.try_divide(covariance, spread))


def pearson(df: DataFrame, keys: Sequence[str] = ("accession",), strict: bool = False) -> DataFrame:
    """Correlation per key, or over all rows at once with no keys; rows that lack a side do not count."""
    y, y_hat = F.when(F.col("y_hat").isNotNull(), F.col("y")), F.when(F.col("y").isNotNull(), F.col("y_hat"))
    sums = df.groupBy(*keys).agg(
        F.covar_pop(y_hat, y).alias("_cov"),
        (F.stddev_pop(y_hat) * F.stddev_pop(y)).alias("_spread"),
    )
    return sums.select(*keys, _ratio(F.col("_cov"), F.col("_spread"), strict).alias("pearson"))


def spearman(df: DataFrame, keys: Sequence[str] = ("accession",), strict: bool = False) -> DataFrame:
    """Correlation of average ranks.

    Equal (y_hat, y) pairs are merged first; each different value then looks up its rank, with values
    that hold much of a table (unexpressed genes) joined apart. Ranks are centred before they are
    multiplied, their mean being known.
    """
    grouped = list(keys) or ["_all"]
    source = (df if keys else df.withColumn("_all", F.lit(0))).dropna(subset=["y", "y_hat"])
    pairs = materialise(
        source.groupBy(*grouped, "y", "y_hat").agg(F.count(F.lit(1)).alias("_w")), "score-pairs"
    )
    for col in ("y", "y_hat"):
        ranked = ranks.value_ranks(pairs, grouped, col, weight="_w").select(
            *grouped,
            col,
            (F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"_r_{col}"),
        )
        pairs = skew.join_unique(pairs, ranked, [*grouped, col])
    a, b, w = F.col("_r_y"), F.col("_r_y_hat"), F.col("_w")
    sums = pairs.groupBy(*grouped).agg(
        F.sum(w * a * b).alias("_cov"),
        F.sqrt(F.sum(w * a * a) * F.sum(w * b * b)).alias("_spread"),
    )
    return sums.select(*keys, _ratio(F.col("_cov"), F.col("_spread"), strict).alias("spearman"))


def mean_score(per_key: DataFrame, col: str) -> DataFrame:
    return per_key.agg(F.avg(col).alias(f"mean_{col}"))


def _profile_sums(block: pd.DataFrame) -> pd.DataFrame:
    """Sums needed for the correlation of each (test, train) profile over one block of genes."""
    gene, _ = pd.factorize(block["gene_idx"])
    sides = {}
    for role in ("test", "train"):
        rows = (block["role"] == role).to_numpy()
        code, labels = pd.factorize(block["accession"][rows])
        value = np.zeros((gene.max() + 1, len(labels)))
        there = np.zeros_like(value)
        value[gene[rows], code] = block["y"][rows]
        there[gene[rows], code] = 1.0
        sides[role] = labels, value, there
    (tests, x, in_x), (trains, y, in_y) = sides["test"], sides["train"]
    sums = {
        "n": in_x.T @ in_y,
        "sx": x.T @ in_y,
        "sy": in_x.T @ y,
        "sxx": (x * x).T @ in_y,
        "syy": in_x.T @ (y * y),
        "sxy": x.T @ y,
    }
    index = pd.MultiIndex.from_product([tests, trains], names=["test", "train"])
    return pd.DataFrame({k: v.ravel() for k, v in sums.items()}, index=index).reset_index()


def expression_similarity(
    expr: DataFrame, test: DataFrame, train: DataFrame, genes_per_block: int = 1024, profiles_per_block: int = 1024
) -> DataFrame:
    """Pearson correlation of each test profile with each training profile over shared genes.

    Genes and profiles are dealt into blocks of limited size; a block gives one row of sums per profile
    pair by matrix products, and the sums are added up.
    """
    roles = test.select("accession", F.lit("test").alias("role")).unionByName(
        train.select("accession", F.lit("train").alias("role"))
    )
    # A profile's mean is taken off first, as sums of squares of large values would cancel.
    means = expr.groupBy("accession").agg(F.avg("y").alias("_mean")).join(F.broadcast(roles.distinct()), "accession")
    means = materialise(means, "roles")
    count = means.count()
    chunks = max(1, -(-count // profiles_per_block))
    means = means.withColumn("_chunk", F.pmod(F.xxhash64("accession"), F.lit(chunks)).cast("int"))
    means, _ = small_side(means)
    own, every = F.array("_chunk"), F.sequence(F.lit(0), F.lit(chunks - 1))
    # A test profile meets every chunk of training profiles and the other way round.
    placed = expr.join(means, "accession").select(
        F.floor(F.col("gene_idx") / genes_per_block).alias("block"), "gene_idx", "accession", "role", (F.col("y") - F.col("_mean")).alias("y"),
        F.explode(F.when(F.col("role") == "test", own).otherwise(every)).alias("test_chunk"), "_chunk",
    )
    other = F.when(F.col("role") == "train", F.array("_chunk")).otherwise(every)
    blocked = placed.withColumn("train_chunk", F.explode(other)).drop("_chunk")
    sums = blocked.groupBy("block", "test_chunk", "train_chunk").applyInPandas(
        _profile_sums,
        "test string, train string, n double, sx double, sy double, sxx double, syy double, sxy double",
    )
    added = sums.groupBy("test", "train").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    covariance = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    spread_x = F.col("n") * F.col("sxx") - F.pow("sx", F.lit(2.0))
    spread_y = F.col("n") * F.col("syy") - F.pow("sy", F.lit(2.0))
    spread = F.when((spread_x <= 0) | (spread_y <= 0), 0.0).otherwise(F.sqrt(spread_x * spread_y))
    return added.select("test", "train", _ratio(covariance, spread, False).alias("similarity"))


# Values of one dense block of profiles; a group makes about six matrices of that size (32 MB each).
BLOCK_VALUES = 4_000_000
# Similarities that agree in so many digits are equal.
TIE_DIGITS = 12


def _dense(profiles: pd.DataFrame, genes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of some profiles over the sorted genes."""
    value = np.zeros((len(profiles), len(genes)))
    there = np.zeros_like(value)
    for i, (gene, y) in enumerate(zip(profiles["genes"], profiles["ys"])):
        at = np.searchsorted(genes, gene)
        value[i, at] = y
        there[i, at] = 1.0
    return value, there


def _best_of_blocks(block: pd.DataFrame) -> pd.DataFrame:
    """The most similar training profile of each test profile, among those of one pair of blocks."""
    test, train = (block[block["role"] == role].sort_values("accession", ignore_index=True) for role in ("test", "train"))
    genes = np.unique(np.concatenate(list(block["genes"])))
    (x, in_x), (y, in_y) = _dense(test, genes), _dense(train, genes)
    n, sx, sy, sxy = in_x @ in_y.T, x @ in_y.T, in_x @ y.T, x @ y.T
    spread_x = np.maximum(n * ((x * x) @ in_y.T) - sx * sx, 0)
    spread_y = np.maximum(n * (in_x @ (y * y).T) - sy * sy, 0)
    spread = np.sqrt(spread_x * spread_y)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Rounded, as the products of equal profiles may differ in their last digits.
        similar = np.where(spread > 0, np.round((n * sxy - sx * sy) / spread, TIE_DIGITS), -np.inf)
    # Profiles are in the order of their names, and the first of equal ones is taken.
    best = similar.argmax(axis=1)
    top = similar[np.arange(len(test)), best]
    found = top > -np.inf
    return pd.DataFrame(
        {"test": test["accession"][found], "train": train["accession"].to_numpy()[best[found]], "similarity": top[found]}
    )


def nearest_profiles(expr: DataFrame, test: DataFrame, train: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(test, train, similarity): the training profile of the highest correlation over shared genes, for each test profile.

    A profile travels as one row of arrays, as long as its genes. Profiles are dealt to blocks by their order, so many
    that a dense block holds ``block_values`` values. A pair of blocks makes its correlations by matrix products and
    returns one row per test profile: tests x blocks rows leave this step, not tests x training profiles. Equal
    similarities (to ``TIE_DIGITS`` digits) go to the name that sorts first. Test profiles without any correlation are left
    out; of a gene that a profile repeats, the largest value counts.
    """
    roles = test.select("accession", F.lit("test").alias("role")).unionByName(
        train.select("accession", F.lit("train").alias("role"))
    ).distinct()
    listed, _ = small_side(materialise(roles.select("accession").distinct(), "profile-names"))
    genes = F.array_sort(F.collect_list(F.struct("gene_idx", F.col("y").cast("double").alias("y"))))
    # A profile's mean is taken off, as sums of squares of large values would cancel.
    packed = (
        expr.dropna(subset=["y"]).join(listed, "accession", "left_semi")
        .groupBy("accession").agg(genes.alias("_genes"), F.avg("y").alias("_mean"))
        .select("accession", F.col("_genes.gene_idx").alias("genes"), F.transform("_genes.y", lambda v: v - F.col("_mean")).alias("ys"))
    )
    packed = materialise(packed, "profiles")
    widest = packed.agg(F.max(F.size("genes"))).first()[0] or 1
    per_block = max(1, block_values // widest)
    dealt = ranks.ordinal(roles.join(packed.select("accession"), "accession"), ["role"], "accession", "at")
    dealt = materialise(dealt.select("role", "accession", F.floor(F.col("at") / per_block).cast("int").alias("own")), "profile-blocks")
    last = {r.role: r.last for r in dealt.groupBy("role").agg(F.max("own").alias("last")).collect()}
    if len(last) < 2:
        return expr.sparkSession.createDataFrame([], "test string, train string, similarity double")
    dealt, _ = small_side(dealt)
    blocks = F.when(F.col("role") == "test", F.lit(last["train"])).otherwise(F.lit(last["test"]))
    met = packed.join(dealt, "accession").withColumn("other", F.explode(F.sequence(F.lit(0), blocks)))
    is_test = F.col("role") == "test"
    best = met.groupBy(
        F.when(is_test, F.col("own")).otherwise(F.col("other")).alias("test_block"),
        F.when(is_test, F.col("other")).otherwise(F.col("own")).alias("train_block"),
    ).applyInPandas(_best_of_blocks, "test string, train string, similarity double")
    first = F.min(F.struct((-F.col("similarity")).alias("_distance"), F.col("train"), F.col("similarity")))
    return best.groupBy("test").agg(first.alias("_best")).select("test", "_best.train", "_best.similarity")


def impute_from_nearest(
    expr: DataFrame, preds: DataFrame, test: DataFrame, train: DataFrame, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """Predictions of the most similar training biosample, for each test biosample (``nearest_profiles``)."""
    nearest = nearest_profiles(expr, test, train, block_values).select("test", "train")
    nearest, _ = small_side(materialise(nearest, "nearest"))
    return preds.join(nearest, preds["accession"] == nearest["train"]).select(
        F.col("test").alias("accession"), F.col("train").alias("source"), "gene_idx", "y_hat"
    )


def best_run(runs: DataFrame, loss: str = "val_loss") -> DataFrame:
    """The run with the smallest loss."""
    return runs.orderBy(F.col(loss), *[c for c in runs.columns if c != loss]).limit(1)
