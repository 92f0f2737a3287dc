"""Embeddings as rows, and the sequence-bin by contact-grid feature join.

Sequence embeddings are rows (m, bin, vec), contact embeddings rows (b, m, r, c, vec). Vectors are
averaged by the JVM summarizer, which combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import arrays, numeric, permute


def vector_mean(vec: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))


def mean_pool(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    return df.groupBy(*keys).agg(vector_mean(vec).alias(vec))


def _expected(bins: Column, expected: int) -> Column:
    """The bins, or an error where an item has not exactly so many; read off the row, nothing is shuffled."""
    message = F.concat(F.lit(f"expected {expected} bins, an item has "), F.size(bins).cast("string"))
    return F.when(F.size(bins) != expected, F.raise_error(message)).otherwise(bins)


def seq_bins(flat: DataFrame, dim: int, expected: int | None = None) -> DataFrame:
    """Flat sequence vectors to one row per bin; with ``expected``, every item must have that many."""
    bins = arrays.reshape_bins(F.col("vec"), dim)
    if expected is not None:
        bins = _expected(bins, expected)
    return flat.select("m", F.posexplode(bins).alias("bin", "vec"))


def grid_cells(flat: DataFrame, n_cols: int, dim: int) -> DataFrame:
    """Flat contact vectors to one row per grid cell, row by row."""
    bins = arrays.reshape_bins(F.col("vec"), dim)
    rows = flat.select("b", "m", F.posexplode(bins).alias("i", "vec"))
    return rows.select(
        "b", "m", F.floor(F.col("i") / n_cols).alias("r"), (F.col("i") % n_cols).alias("c"), "vec"
    )


def center_crop_2d(grid: DataFrame, rows: int, cols: int, n_rows: int, n_cols: int) -> DataFrame:
    """Middle cells of a stored n_rows x n_cols grid, counted again from 0."""
    if n_rows < rows or n_cols < cols:
        raise ValueError(f"grid {n_rows} x {n_cols} is smaller than the crop {rows} x {cols}")
    r0, c0 = (n_rows - rows) // 2, (n_cols - cols) // 2
    kept = grid.where(F.col("r").between(r0, r0 + rows - 1) & F.col("c").between(c0, c0 + cols - 1))
    return kept.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def store_dims(grid: DataFrame, batch: int) -> DataFrame:
    """Grid size, vector length and batches per epoch, read from the stored data."""
    shape = grid.agg(
        (F.max("r") + 1).cast("bigint").alias("n_rows"),
        (F.max("c") + 1).cast("bigint").alias("n_cols"),
        F.max(F.size("vec")).cast("bigint").alias("dim"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    items = F.col("n_cells") / (F.col("n_rows") * F.col("n_cols"))
    return shape.withColumn("steps", F.ceil(items / batch)).drop("n_cells")


def epoch_order(rows: DataFrame, n_bio: int, n_items: int, batch: int, seed: int, epoch: int) -> DataFrame:
    """Rows (b, m) with their ``batch`` and ``place`` in an epoch's order, which is a function of the pair alone.

    Every pair of the n_bio x n_items grid has a position of its own, so nothing is sorted or shuffled here, and
    each task can tell where its rows go. Pairs outside the grid get nulls.
    """
    inside = F.col("b").between(0, n_bio - 1) & F.col("m").between(0, n_items - 1)
    position = permute.permuted(numeric.flat_index(F.col("b"), F.col("m"), n_items), n_bio * n_items, seed, epoch)
    placed = rows.withColumn("_position", F.when(inside, position))
    return placed.withColumns(
        {"batch": F.call_function("div", F.col("_position"), F.lit(batch)), "place": F.col("_position") % batch}
    ).drop("_position")


def batch_pairs(places: DataFrame, n_bio: int, n_items: int, batch: int, seed: int, epoch: int) -> DataFrame:
    """The pair (b, m) of each (batch, place) of an epoch: ``epoch_order`` read the other way.

    With it the pairs of some batches are known without a look at any other row. Places that the epoch
    lacks get nulls.
    """
    position = F.col("batch").cast("bigint") * batch + F.col("place")
    held = F.col("place").between(0, batch - 1) & position.between(0, n_bio * n_items - 1)
    flat = F.when(held, permute.index_at(position, n_bio * n_items, seed, epoch))
    found = places.withColumn("_flat", flat)
    return found.withColumns(
        {"b": F.call_function("div", F.col("_flat"), F.lit(n_items)), "m": F.pmod("_flat", F.lit(n_items))}
    ).drop("_flat")


def check_training_shapes(hic: DataFrame, seq: DataFrame, y: DataFrame) -> None:
    """Items of both embedding tables must agree and labels must cover every (b, m)."""
    pairs = hic.select("b", "m").distinct()
    items = pairs.select("m").distinct().withColumn("_hic", F.lit(1))
    loose = items.join(seq.select("m").distinct().withColumn("_seq", F.lit(1)), "m", "full_outer")
    if not loose.where("_hic IS NULL OR _seq IS NULL").isEmpty():
        raise ValueError("sequence and contact embeddings hold different items")
    if not pairs.join(y.select("b", "m").distinct(), ["b", "m"], "left_anti").isEmpty():
        raise ValueError("labels do not cover every biosample and item")


def training_rows(hic: DataFrame, seq: DataFrame, y: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Contact vector, sequence vector, label and weight per (b, m); the weight is 1 without a table.

    Sequence and weight depend on the item only and are joined to each other first.
    """
    items = seq.select("m", F.col("vec").alias("seq_vec"))
    if weights is None:
        items = items.withColumn("w", F.lit(1.0))
    else:
        items = items.join(weights.select("m", "w"), "m")
    labelled = hic.select("b", "m", F.col("vec").alias("hic_vec")).join(
        y.select("b", "m", F.col("y").cast("float").cast("double").alias("y")), ["b", "m"]
    )
    return labelled.join(items, "m").select("b", "m", "hic_vec", "seq_vec", "y", "w")


def align_bins(bins: DataFrame, n_rows: int, n_cols: int, ratio: int, mode: str) -> DataFrame:
    """Row and column streams of sequence bins, each counted from 0.

    ``cols``: the bins span the grid's columns and the row stream is their middle. ``rows``: the
    bins span the grid's rows and serve as both streams. Every item must have exactly the bins that
    are spanned.
    """
    if n_rows > n_cols:
        raise ValueError("the grid must not have more rows than columns")
    if mode == "cols":
        expected, surplus = n_cols * ratio, (n_cols - n_rows) * ratio
        if surplus % 2:
            raise ValueError("(n_cols - n_rows) * ratio must be even")
    elif mode == "rows":
        expected, surplus = n_rows * ratio, 0
    else:
        raise ValueError(f"unknown mode {mode}")
    bins = check_bin_count(bins, expected)
    start = surplus // 2
    in_rows = F.col("bin").between(start, start + n_rows * ratio - 1)
    col_part = F.struct(F.lit("col").alias("stream"), F.col("bin").alias("bin"))
    row_part = F.struct(F.lit("row").alias("stream"), (F.col("bin") - start).cast("int").alias("bin"))
    streams = F.when(in_rows, F.array(col_part, row_part)).otherwise(F.array(col_part))
    return (
        bins.withColumn("bin", F.col("bin").cast("int"))
        .select("m", F.explode(streams).alias("s"), "vec")
        .select("m", "s.stream", "s.bin", "vec")
    )


def check_bin_count(bins: DataFrame, expected: int) -> DataFrame:
    """Every item must have exactly the expected bins."""
    counts = bins.groupBy("m").agg(F.count_distinct("bin").alias("n"), F.max("bin").alias("last"))
    bad = counts.where((F.col("n") != expected) | (F.col("last") != expected - 1)).first()
    if bad is not None:
        raise ValueError(f"expected bins 0 to {expected - 1} (expected {expected} bins), item {bad.m} has {bad.n} up to {bad['last']}")
    return bins


def downsample_bins(streams: DataFrame, ratio: int) -> DataFrame:
    """Mean of each run of ``ratio`` bins; ``pos`` is the grid row or column."""
    runs = streams.withColumn("pos", F.floor(F.col("bin") / ratio))
    return mean_pool(runs, ["m", "stream", "pos"])


def outer_sum(streams: DataFrame) -> DataFrame:
    """cell(r, c) = row[r] + col[c] for each item.

    An item has as many vectors as the grid has rows and columns; both streams meet in one group,
    so neither is computed twice.
    """
    entry = F.struct("stream", "pos", "vec")
    items = streams.groupBy("m").agg(F.collect_list(entry).alias("e"))
    rows = F.filter("e", lambda x: x["stream"] == "row")
    cols = F.filter("e", lambda x: x["stream"] == "col")
    split = items.select("m", F.explode(rows).alias("row"), cols.alias("cols"))
    cells = split.select("m", "row", F.explode("cols").alias("col"))
    return cells.select(
        "m",
        F.col("row.pos").alias("r"),
        F.col("col.pos").alias("c"),
        arrays.vector_sum(F.col("row.vec"), F.col("col.vec")).alias("vec"),
    )


def pad_columns(grid: DataFrame, n_rows: int, n_cols: int, value: float = 0.0) -> DataFrame:
    """Widen an n_rows x n_rows grid to n_cols columns of a constant, an odd surplus on the right.

    Each row's first cell also brings the row's new columns, so nothing is joined.
    """
    left = (n_cols - n_rows) // 2
    shifted = F.array(F.struct((F.col("c") + left).alias("c"), F.col("vec").alias("vec")))
    blank = F.transform("vec", lambda _: F.lit(float(value)))
    outside = [c for c in range(n_cols) if not left <= c < left + n_rows]
    extra = F.array(
        *[F.struct(F.lit(c).cast("bigint").alias("c"), blank.alias("vec")) for c in outside]
    )
    cells = shifted if not outside else F.when(F.col("c") == 0, F.concat(shifted, extra)).otherwise(shifted)
    return grid.withColumn("c", F.col("c").cast("bigint")).select("m", "r", F.explode(cells).alias("x")).select(
        "m", "r", "x.c", "x.vec"
    )


def normalise_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, arrays.layer_norm(F.col(vec)))


def fuse(hic: DataFrame, seq: DataFrame, scale: float = 1.0) -> DataFrame:
    """Contact cell plus scaled sequence cell."""
    cells = seq.select("m", "r", "c", F.col("vec").alias("seq_vec"))
    return hic.join(cells, ["m", "r", "c"]).select(
        "b", "m", "r", "c", arrays.add_scaled(F.col("vec"), F.col("seq_vec"), scale).alias("vec")
    )


def fused_features(
    hic: DataFrame, bins: DataFrame, n_rows: int, n_cols: int, ratio: int, mode: str, scale: float = 1.0, norm: bool = False
) -> DataFrame:
    """Align, downsample, add up, pad and fuse; optionally normalise both sides before fusing."""
    streams = downsample_bins(align_bins(bins, n_rows, n_cols, ratio, mode), ratio)
    seq = outer_sum(streams)
    if norm:
        hic, seq = normalise_vectors(hic), normalise_vectors(seq)
    if mode == "rows" and n_cols > n_rows:
        seq = pad_columns(seq, n_rows, n_cols)
    return fuse(hic, seq, scale)


def _spans(n_rows: int, n_cols: int, ratio: int, mode: str) -> tuple[int, int]:
    """Bins that an item must have, and the first bin of the row stream."""
    if n_rows > n_cols:
        raise ValueError("the grid must not have more rows than columns")
    if mode == "rows":
        return n_rows * ratio, 0
    if mode != "cols":
        raise ValueError(f"unknown mode {mode}")
    surplus = (n_cols - n_rows) * ratio
    if surplus % 2:
        raise ValueError("(n_cols - n_rows) * ratio must be even")
    return n_cols * ratio, surplus // 2


def sequence_grids(
    flat: DataFrame, dim: int, n_rows: int, n_cols: int, ratio: int, mode: str
) -> DataFrame:
    """(m, seq_grid): per item its cells row by row, aligned, pooled, added up and padded with zeros.

    One row per item goes through from the flat vector to the grid; nothing is exploded or shuffled.
    """
    expected, first = _spans(n_rows, n_cols, ratio, mode)
    width = n_cols if mode == "cols" else n_rows

    def pooled(bins: Column, start: int, count: int) -> Column:
        def mean(p: Column) -> Column:
            run = F.slice(bins, p * ratio + start + 1, ratio)
            total = F.aggregate(run, F.array_repeat(F.lit(0.0), dim), lambda acc, x: arrays.vector_sum(acc, x))
            return F.transform(total, lambda x: x / ratio)

        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), mean)

    left = (n_cols - width) // 2
    blank = F.array_repeat(F.lit(0.0), dim)

    def cells(rows: Column, cols: Column) -> Column:
        def cell(i: Column) -> Column:
            r, c = F.floor(i / n_cols).cast("int"), (i % n_cols) - left
            made = arrays.vector_sum(F.get(rows, r), F.get(cols, c))
            return F.when(c.between(0, width - 1), made).otherwise(blank)

        return F.transform(F.sequence(F.lit(0), F.lit(n_rows * n_cols - 1)), cell)

    bins = flat.select("m", _expected(arrays.reshape_bins(F.col("vec"), dim), expected).alias("bins"))
    streams = bins.select("m", pooled(F.col("bins"), first, n_rows).alias("rows"), pooled(F.col("bins"), 0, width).alias("cols"))
    return streams.select("m", cells(F.col("rows"), F.col("cols")).alias("seq_grid"))


def fused_items(
    hic: DataFrame, seq: DataFrame, dim: int, n_rows: int, n_cols: int, ratio: int, mode: str, scale: float = 1.0, norm: bool = False
) -> DataFrame:
    """(b, m, r, c, vec) from flat contact vectors (b, m, vec) and flat sequence vectors (m, vec).

    The same as ``fused_features``, with both sides whole rows until their one join on the item.
    """
    grids = sequence_grids(seq, dim, n_rows, n_cols, ratio, mode)
    cells = _expected(arrays.reshape_bins(F.col("vec"), dim), n_rows * n_cols)
    both = hic.select("b", "m", cells.alias("hic_grid")).join(grids, "m")
    rows = both.select("b", "m", F.posexplode(F.arrays_zip("hic_grid", "seq_grid")).alias("i", "cell"))
    hic_vec, seq_vec = F.col("cell.hic_grid"), F.col("cell.seq_grid")
    if norm:  # padding is zero before and after
        hic_vec, seq_vec = arrays.layer_norm(hic_vec), arrays.layer_norm(seq_vec)
    place = [F.floor(F.col("i") / n_cols).alias("r"), (F.col("i") % n_cols).cast("bigint").alias("c")]
    return rows.select("b", "m", *place, arrays.add_scaled(hic_vec, seq_vec, scale).alias("vec"))
