"""The two-dimensional range join between cells and regions, and window records.

A window of height H and width W holds at most H*W distinct cells after
``contacts.sum_cells``; that bounds every per-window group below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import names, numeric
from chromaloom.operators import contacts, regions as region_ops, skew
from chromaloom.session import BROADCAST_ROWS, bucketed, materialise, small_side

TILE = 64
TILE_KEY = ["chrom", "row_tile", "col_tile"]
# Cells carry the window's start bins; the text key is made once per window, after grouping.
WINDOW = ["accession", "chrom", "rs", "cs"]


def window_key() -> Column:
    return names.submat_key(F.col("chrom"), F.col("rs"), F.col("cs"))


def with_key(cells: DataFrame) -> DataFrame:
    """Cells or windows named by their text key instead of their start bins."""
    return cells.withColumn("submat_key", window_key()).drop("chrom", "rs", "cs")


def distinct_windows(binned_regions: DataFrame) -> DataFrame:
    """One row per window key, the last region row deciding the flip."""
    kept = binned_regions.where((F.col("rs") >= 0) & (F.col("cs") >= 0))
    return region_ops.last_wins(
        kept.select("submat_key", "chrom", "rs", "cs", "flip", "bedpe_idx"), ["submat_key"], "bedpe_idx"
    )


def window_tiles(windows: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """Each window once per tile of the matrix that it touches."""
    def cover(start: str, size: int) -> Column:
        first = F.floor(F.col(start) / tile).cast("int")
        last = F.floor((F.col(start) + size - 1) / tile).cast("int")
        return F.explode(F.sequence(first, last))

    return (
        windows.select("chrom", F.col("rs").cast("int").alias("rs"), F.col("cs").cast("int").alias("cs"), "flip", cover("rs", height).alias("row_tile"))
        .select("*", cover("cs", width).alias("col_tile"))
    )


def stored_blocks(windows: DataFrame, height: int, width: int, block: int) -> DataFrame:
    """(block, windows): the store blocks that some window touches, and how many windows do."""
    touched = window_tiles(windows, height, width, block)
    name = contacts.stored_block(F.col("chrom"), F.col("row_tile"), F.col("col_tile"))
    return touched.groupBy(name.alias("block")).agg(F.count(F.lit(1)).alias("windows"))


def _tiled(cells: DataFrame, tile: int) -> DataFrame:
    return cells.withColumns(
        {
            "row_tile": F.floor(F.col("row") / tile).cast("int"),
            "col_tile": F.floor(F.col("col") / tile).cast("int"),
        }
    )


def _within(cells: DataFrame, tiles: DataFrame, height: int, width: int, tile: int, keys: list[str] = TILE_KEY) -> DataFrame:
    joined = _tiled(cells, tile).join(tiles, keys)
    row, col = F.col("row") - F.col("rs"), F.col("col") - F.col("cs")
    inside = row.between(0, height - 1) & col.between(0, width - 1)
    return joined.where(inside).select(*WINDOW, row.alias("row"), col.alias("col"), "value", "flip")


def extract_windows(
    cells: DataFrame, windows: DataFrame, height: int, width: int, tile: int = TILE
) -> DataFrame:
    """Cells of every window, as offsets from its corner.

    An equi-join on matrix tiles followed by the exact bounds. ``cells`` are unique per accession,
    so no tile holds more than tile*tile of one accession, however hot its region.
    """
    tiles, _ = small_side(materialise(window_tiles(windows, height, width, tile), "tiles"))
    return _within(cells, tiles, height, width, tile)


def extract_from_contacts(
    kept: DataFrame, windows: DataFrame, height: int, width: int, dims: DataFrame, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``symmetrise`` and ``extract_windows`` in one go.

    The mirrored contacts outside every window are dropped before the sum in every plan, so only what some
    window needs is shuffled; the tiles in use are broadcast if they are few, which overlapping windows
    do not change. A window table too large to broadcast is joined by accession and tile (the accessions
    of ``dims``), so a tile at the diagonal is no hot key of all accessions.
    """
    tiles = materialise(window_tiles(windows, height, width, tile), "tiles")
    wanted, _ = small_side(materialise(tiles.select(*TILE_KEY).distinct(), "tiles-in-use"), broadcast_rows)
    mirrored = _tiled(contacts.mirror(kept), tile).join(wanted, TILE_KEY, "left_semi")
    tiles, is_small = small_side(tiles, broadcast_rows)
    cells = contacts.sum_cells(mirrored)
    if is_small:
        return _within(cells, tiles, height, width, tile)
    owners, _ = small_side(dims.select("accession", "chrom").distinct())
    return _within(cells, tiles.join(owners, "chrom"), height, width, tile, ["accession", *TILE_KEY])


def strand_flip(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Minus-strand windows are turned over both axes, by the nominal size even at a matrix edge."""
    flip = F.col("flip")
    return cells.withColumns(
        {
            "row": F.when(flip, F.lit(height - 1) - F.col("row")).otherwise(F.col("row")),
            "col": F.when(flip, F.lit(width - 1) - F.col("col")).otherwise(F.col("col")),
        }
    ).drop("flip")


def _valid_windows(valid: DataFrame) -> DataFrame:
    starts = [F.col(c).cast("int").alias(c) for c in ("rs", "cs")]
    return valid.select("accession", "chrom", *starts).distinct()


def window_stats(valid: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored entries (explicit zeros count) and total per window, also for empty windows."""
    stored = cells.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("nnz"),
        F.sum(F.col("value").cast("double")).alias("total"),
    )
    return _valid_windows(valid).join(stored, WINDOW, "left").select(
        "accession",
        window_key().alias("submat_key"),
        F.coalesce("nnz", F.lit(0)).alias("nnz"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.col("nnz").isNull().alias("is_empty"),
    )


def empty_windows(valid: DataFrame, cells: DataFrame) -> DataFrame:
    """Region rows without any stored cell; duplicates of a key repeat."""
    stored = cells.select(*WINDOW).distinct()
    return valid.join(stored, WINDOW, "left_anti").select("accession", "bedpe_idx", "chrom", "rs", "cs")


def _packed(cells: DataFrame, half: bool, ordered: bool = False) -> DataFrame:
    value = numeric.to_float16(F.col("value")) if half else F.col("value")
    entry = F.struct(
        numeric.to_int16(F.col("row")).alias("row"),
        numeric.to_int16(F.col("col")).alias("col"),
        value.cast("float").alias("data"),
    )
    entries = F.collect_list(entry)
    packed = cells.groupBy(*WINDOW).agg((F.array_sort(entries) if ordered else entries).alias("entries"))
    return packed.select(*WINDOW, "entries.row", "entries.col", "entries.data")


def pack_windows(cells: DataFrame, half: bool = True, ordered: bool = False) -> DataFrame:
    """One record per window with parallel arrays; row-major when ``ordered``, which no operator needs."""
    return with_key(_packed(cells, half, ordered)).select("accession", "submat_key", "row", "col", "data")


def window_records(valid: DataFrame, cells: DataFrame, totals: DataFrame, half: bool = True) -> DataFrame:
    """Records for all valid windows, the empty ones with empty arrays, with the store's total.

    The windows are joined on the columns the cells were grouped by, so no array is shuffled again.
    """
    found = _valid_windows(valid).join(_packed(cells, half), WINDOW, "left")
    arrays = {
        "row": F.coalesce("row", F.array().cast("array<smallint>")),
        "col": F.coalesce("col", F.array().cast("array<smallint>")),
        "data": F.coalesce("data", F.array().cast("array<float>")),
        "is_empty": F.col("row").isNull() | (F.size("row") == 0),
    }
    records = found.select("accession", window_key().alias("submat_key"), *[e.alias(n) for n, e in arrays.items()])
    totals, _ = small_side(materialise(totals.select("accession", "total_count"), "totals"))
    return records.join(totals, "accession", "left")


def unpack_windows(records: DataFrame, height: int, width: int, keys: tuple[str, ...] = ("accession", "submat_key")) -> DataFrame:
    """Back to one row per cell; offsets outside the window are ignored."""
    return (
        records.select(*keys, F.explode(F.arrays_zip("row", "col", "data")).alias("cell"))
        .select(
            *keys,
            F.col("cell.row").cast("int").alias("row"),
            F.col("cell.col").cast("int").alias("col"),
            F.col("cell.data").alias("value"),
        )
        .where(in_window(height, width))
    )


def in_window(height: int, width: int) -> Column:
    return F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)


def _pair_counts(listed: DataFrame, regions: DataFrame, hot_rows: int) -> DataFrame:
    """(accession, submat_key, _n) of the pairing's keys that may pass ``hot_rows``, from counts of either side."""
    owners = materialise(listed.groupBy("accession").agg(F.count(F.lit(1)).alias("_owners")), "owners")
    most = owners.agg(F.max("_owners")).first()[0] or 0
    keys = regions.groupBy("submat_key").agg(F.count(F.lit(1)).alias("_regions")).where(F.col("_regions") * most > hot_rows)
    return skew.pair_all(owners, keys, order="accession").withColumn("_n", F.col("_owners") * F.col("_regions"))


def _items(found: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Columns of paired windows; one without a window is empty, and a stored flag is believed."""
    return found.select(
        "bio_idx",
        "bedpe_idx",
        "accession",
        "chrom",
        "rs",
        "cs",
        "submat_key",
        F.coalesce("row", F.array().cast("array<smallint>")).alias("row"),
        F.coalesce("col", F.array().cast("array<smallint>")).alias("col"),
        F.coalesce("data", F.array().cast("array<float>")).alias("data"),
        F.coalesce("is_empty", F.col("row").isNull() | (F.size("row") == 0)).alias("is_empty"),
        F.coalesce("total_count", F.lit(0.0)).alias("total_count"),
        *(more or []),
    )


def listed_windows(
    biosamples: DataFrame, regions: DataFrame, records: DataFrame, hot_rows: int = skew.HOT_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store with its empty flags, the listed biosamples with their totals, and how often hot windows are asked for."""
    if "is_empty" not in records.columns:
        records = records.withColumn("is_empty", F.lit(None).cast("boolean"))
    totals = records.groupBy("accession").agg(F.max("total_count").alias("total_count"))
    listed = biosamples.select("bio_idx", "accession").join(totals, "accession", "left")
    return records, listed, _pair_counts(listed, regions, hot_rows)


def assemble(
    biosamples: DataFrame, binned_regions: DataFrame, records: DataFrame, hot_rows: int = skew.HOT_ROWS, partitions: int | None = None
) -> DataFrame:
    """Every biosample with every region, in biosample-major order by ``bio_idx`` and ``bedpe_idx``.

    A window that is missing from the store is an empty one; a stored flag is believed. The pairing is made once:
    how often a window is asked for is the product of its regions and its accession's biosamples. The narrow pairs
    are dealt by window into ``partitions`` tasks; a model that follows runs there.
    """
    records, listed, counts = listed_windows(biosamples, binned_regions, records, hot_rows)
    pairs = skew.pair_all(
        listed, binned_regions.select("bedpe_idx", "chrom", "rs", "cs", "submat_key"), order="bio_idx"
    )
    stored = records.drop("total_count")
    found = skew.join_unique(pairs, stored, ["accession", "submat_key"], "left", hot_rows, counts=counts, partitions=partitions)
    return _items(found)


def colocated_rows(
    biosamples: DataFrame, regions: DataFrame, records: DataFrame, buckets: int, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """``assemble``, with the regions' further columns (sequences), over tables bucketed by window key.

    Windows and regions are written to ``buckets`` buckets of their key, which is the one time that windows move; they
    meet there without an exchange, biosamples are broadcast, and a model may run in the buckets as they are. Pairs
    whose window is missing are found on keys alone and meet their regions in their buckets, too. Windows asked for
    by more than ``hot_rows`` regions would crowd a bucket and go the way of ``assemble`` instead.
    """
    if "is_empty" not in records.columns:
        records = records.withColumn("is_empty", F.lit(None).cast("boolean"))
    more = [c for c in regions.columns if c not in ("bedpe_idx", "chrom", "rs", "cs", "submat_key")]
    regions = materialise(regions.select("bedpe_idx", "chrom", "rs", "cs", "submat_key", *more), "regions")
    hot = regions.groupBy("submat_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("submat_key")
    hot = materialise(hot, "hot-windows")
    few, _ = small_side(hot)
    places = bucketed(regions.join(few, "submat_key", "left_anti"), "regions", buckets, "submat_key")
    stored = bucketed(records, "windows", buckets, "submat_key")
    totals = stored.groupBy("accession").agg(F.max("total_count").alias("total_count"))
    listed = materialise(biosamples.select("bio_idx", "accession").join(totals, "accession", "left"), "biosamples")
    narrow, _ = small_side(listed)
    # Merged by key, whatever the sizes, so that the rows stay in their buckets.
    found = places.join(stored.drop("total_count").hint("merge"), "submat_key").join(narrow, "accession")
    asked = skew.pair_all(listed, places.select("submat_key").distinct(), order="bio_idx")
    missing = asked.join(stored.select("accession", "submat_key"), ["accession", "submat_key"], "left_anti")
    absent = places.join(missing.hint("merge"), "submat_key")
    none = {c: F.lit(None).cast(records.schema[c].dataType) for c in ("row", "col", "data", "is_empty")}
    rows = _items(found, more).unionByName(_items(absent.withColumns(none), more))
    if hot.isEmpty():
        return rows
    crowded = regions.join(few, "submat_key", "left_semi")
    salted = assemble(biosamples, crowded.drop(*more), stored, hot_rows).join(crowded.select("bedpe_idx", *more), "bedpe_idx")
    return rows.unionByName(_items(salted, more))


def item_meta(items: DataFrame, bedpe: DataFrame) -> DataFrame:
    """Description of each item, with the region's own start and end and the empty flag as a number."""
    ends = bedpe.select("bedpe_idx", "start1", "end1")
    return items.join(ends, "bedpe_idx").select(
        "bio_idx",
        "bedpe_idx",
        "accession",
        "chrom",
        "rs",
        "cs",
        "start1",
        "end1",
        F.col("is_empty").cast("bigint").alias("is_empty"),
    )
