"""Statistics over images and frames as pixel relations.

Pixels are rows (image, x, y, channels) or, for whole boards and frames, arrays:
one row with its grey values in order.  Frames are compared element by element
in the JVM, boards are measured in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import previous_row

# Fixed values.
INK, TRUE_INK, MISSING_INK = 180, 160, 0.01
WIPE_STEP, WIPE_TOTAL, GHOST = 12.0, 8.0, 24.0
BLANK_STD, LOW_EDGE, EDGE = 15.0, 0.005, 30
CHALK_LUMA, PAPER_LUMA = 130.0, 185.0
ROW_STEP, FILL_RUN = 6, 3
TEXT_BAND, TEXT_HEIGHT_CV, TEXT_GAP_CV, TEXT_HEIGHT, BAND_PX = 0.025, 0.2, 0.5, 0.05, 15.0


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def frame_changes(frames: DataFrame, clip: str, order: str, values: str) -> DataFrame:
    """Per clip: the largest mean change from frame to frame, and that from the first to the last; one frame gives 0."""
    steps = previous_row(frames.select(clip, order, values), [clip], [order], F.col(values), "_before")
    ends = steps.groupBy(clip).agg(F.coalesce(F.max(mean_abs_diff(F.col(values), F.col("_before"))), F.lit(0.0)).alias("max_step"), F.count("*").alias("n_frames"),
                                   F.min_by(values, order).alias("_first"), F.max_by(values, order).alias("_last"))
    return ends.select(clip, "n_frames", "max_step", mean_abs_diff(F.col("_last"), F.col("_first")).alias("total_change"))


def wipe_findings(changes: DataFrame) -> DataFrame:
    """Clips that cut hard or do not change at all."""
    code = F.when(F.col("max_step") >= WIPE_STEP, "hard_cut").when(F.col("total_change") < WIPE_TOTAL, "no_change")
    return changes.withColumn("finding", code).where("finding is not null")


STATS = ("mean", "std", "median", "corner_tl", "corner_tr", "corner_bl", "corner_br", "bottom", "top", "edge_ratio", "background", "ghost")


def _stats(v: np.ndarray, patch: int, edge: int, band: tuple[int, int]) -> dict[str, float]:
    height, width = v.shape
    framed = np.pad(v, 1, mode="reflect") if min(height, width) > 1 else np.pad(v, 1, mode="edge")
    lap = framed[:-2, 1:-1] + framed[2:, 1:-1] + framed[1:-1, :-2] + framed[1:-1, 2:] - 4 * v
    border = np.ones(v.shape, bool)
    border[edge:height - edge, edge:width - edge] = False
    ground = float(np.median(v[border]))
    rows = v[band[0]:band[1]]
    return {"mean": v.mean(), "std": v.std(), "median": np.median(v), "corner_tl": v[:patch, :patch].mean(), "corner_tr": v[:patch, -patch:].mean(),
            "corner_bl": v[-patch:, :patch].mean(), "corner_br": v[-patch:, -patch:].mean(), "bottom": v[int(height * 0.8):].mean(), "top": v[:int(height * 0.6)].mean(),
            "edge_ratio": (np.abs(lap) > EDGE).mean(), "background": ground, "ghost": np.abs(rows - ground).mean() if rows.size else 0.0}


def board_stats(boards: DataFrame, image: str, values: str, width: int, height: int, patch: int, edge: int = 10, ink: int = INK, band: tuple[int, int] = (502, 930)) -> DataFrame:
    """Per image: the statistics of its grey values, one array row by row.

    Mean, population deviation and median, four corner means, bottom fifth and
    top three fifths, the share of pixels whose Laplacian is above 30 (the border
    mirrors itself), the border's median as background, ``ghost``, the mean
    distance of a band of rows from it, and ``n_ink``, the pixels further from it
    than ``ink``.  A board is one row, worked out whole in Arrow batches; arrays
    of another length or with nulls give nulls.
    """
    source = boards.select(image, F.col(values).cast("array<double>").alias("_v"))
    typ = source.schema[image].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column(1):
                v = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0)
                if len(v) != width * height or np.isnan(v).any():
                    out.append(dict.fromkeys([*STATS, "n_ink"]))
                    continue
                v = v.reshape(height, width)
                found = _stats(v, patch, edge, band)
                out.append({**found, "n_ink": int((np.abs(v - found["background"]) > ink).sum())})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.float64()) for k in STATS), pa.array([r["n_ink"] for r in out], pa.int64())], [image, *STATS, "n_ink"])

    return source.mapInArrow(run, f"`{image}` {typ}, {', '.join(f'{k} double' for k in STATS)}, n_ink bigint")


def board_findings(stats: DataFrame, image: str, mode: str = "paper") -> DataFrame:
    """(image, code, severity) of blank, empty, wrongly lit or crowded boards."""
    blank = F.col("std") < BLANK_STD
    rules = [("blank", "blocking", blank), ("low_information", "warning", ~blank & (F.col("edge_ratio") < LOW_EDGE))]
    for corner in ("corner_tl", "corner_tr", "corner_bl", "corner_br"):
        rules.append((corner, "blocking", F.col(corner) > CHALK_LUMA if mode == "chalk" else F.col(corner) < PAPER_LUMA))
    rules.append(("bottom_band", "warning", F.col("bottom") > F.col("median") + 40 if mode == "chalk" else F.col("bottom") > F.col("top") * 0.75))
    said = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"))) for n, s, c in rules]), lambda f: f.isNotNull())
    return stats.select(image, F.explode(said).alias("f")).select(image, "f.code", "f.severity")


def border_median(pixels: DataFrame, image: str, channels: list[str], x: str, y: str, width: int, height: int, edge: int) -> DataFrame:
    """Median of each channel over the border of ``edge`` pixels: the background."""
    at = (F.col(x) < edge) | (F.col(x) >= width - edge) | (F.col(y) < edge) | (F.col(y) >= height - edge)
    return pixels.where(at).groupBy(image).agg(*[F.median(c).alias(c) for c in channels])


def ink(pixels: DataFrame, background: DataFrame, image: str, channels: list[str], threshold: int = INK) -> DataFrame:
    """Add ``is_ink``: the summed channel distance from the image's background is above the threshold."""
    b = background.select(image, *[F.col(c).alias("_b" + c) for c in channels])
    far = sum((F.abs(F.col(c) - F.col("_b" + c)) for c in channels), F.lit(0.0))
    return pixels.join(b, image).withColumn("is_ink", far > threshold).drop(*["_b" + c for c in channels])


def missing_ratio(pairs: DataFrame, key: str, wanted: str, got: str) -> DataFrame:
    """Share of the wanted pixels that are not there; 0 where none is wanted.

    ``wanted`` and ``got`` are arrays of flags, one for each pixel of a frame.
    """
    n = F.sum(F.size(F.filter(wanted, lambda x: x)))
    lost = F.sum(F.size(F.filter(F.zip_with(wanted, got, lambda w, g: w & ~g), lambda x: x)))
    return pairs.groupBy(key).agg(n.alias("n_wanted"), (lost / F.greatest(n, F.lit(1))).alias("missing_ratio"))


def fill_runs(pixels: DataFrame, image: str, x: str, y: str, is_ink: str, step: int = ROW_STEP, least: int = FILL_RUN) -> DataFrame:
    """Runs of inked pixels on every ``step``-th row: image, row, ``from_x``, ``to_x`` in the direction of drawing."""
    rows = pixels.where((F.col(y) % step == step // 2) & F.col(is_ink))
    w = Window.partitionBy(image, y).orderBy(x)
    runs = rows.withColumn("_g", F.col(x) - F.row_number().over(w)).groupBy(image, y, "_g").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("n")).where(F.col("n") >= least)
    # every run is stored right to left: the collected order of even rows is turned round
    return runs.select(image, y, F.col("_hi").alias("from_x"), F.col("_lo").alias("to_x"), "n")


def blend_background(v: Column, distance: Column, shift: Column) -> Column:
    """A channel moved toward the palette: fully at the background, not at all from a distance of 120 on."""
    weight = 1 - F.least(F.greatest(distance / 120.0, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(v + shift * weight, F.lit(0.0)), F.lit(255.0))


NEAR_GROUND, LEAST_SHIFT, DOMINANT = 120, 12, 0.05  # fixed values


def background_plan(pixels: DataFrame, image: str, x: str, y: str, width: int, height: int, patch: int, target: tuple[int, int, int]) -> DataFrame:
    """(image, bg_r, bg_g, bg_b, dominance, decision): whether an image's ground is to be moved to the theme's.

    The ground is the median of the four corners; ``near`` where no channel is
    12 or more off the target, ``not_dominant`` where less than a twentieth of
    the image is near the corners' colour, else ``move``.
    """
    p = min(patch, height // 4, width // 4)
    corner = ((F.col(x) < p) | (F.col(x) >= width - p)) & ((F.col(y) < p) | (F.col(y) >= height - p))
    ground = pixels.groupBy(image).agg(*[F.median(F.when(corner, F.col(c))).alias(f"bg_{c}") for c in ("r", "g", "b")])
    far = sum((F.abs(F.col(c) - F.col(f"bg_{c}")) for c in ("r", "g", "b")), F.lit(0.0))
    share = pixels.join(ground, image).groupBy(image, "bg_r", "bg_g", "bg_b").agg(F.avg(F.when(far < NEAR_GROUND, 1.0).otherwise(0.0)).alias("dominance"))
    shift = F.greatest(*[F.abs(F.lit(t) - F.col(f"bg_{c}")) for c, t in zip(("r", "g", "b"), target, strict=True)])
    return share.withColumn("decision", F.when(shift < LEAST_SHIFT, "near").when(F.col("dominance") < DOMINANT, "not_dominant").otherwise("move"))


def moved_background(pixels: DataFrame, plan: DataFrame, image: str, target: tuple[int, int, int]) -> DataFrame:
    """The pixels of the images to be moved, with their new ``r``, ``g``, ``b``; the others as they are."""
    rows = pixels.join(plan.select(image, "bg_r", "bg_g", "bg_b", "decision"), image)
    far = sum((F.abs(F.col(c) - F.col(f"bg_{c}")) for c in ("r", "g", "b")), F.lit(0.0))
    move = F.col("decision") == "move"
    new = {c: F.when(move, F.floor(blend_background(F.col(c), far, F.lit(t) - F.col(f"bg_{c}")))).otherwise(F.col(c)).cast("int") for c, t in zip(("r", "g", "b"), target, strict=True)}
    return rows.withColumns(new).select(*pixels.columns)


def variation(values: Column) -> Column:
    """Population deviation over mean of an array, the mean 1e-6 at least; 0 for fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    dev = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    return F.when(n < 2, 0.0).otherwise(dev / F.greatest(mean, F.lit(1e-6)))


def text_lines(parts: DataFrame, image: str, width: int, height: int) -> DataFrame:
    """Rows of like-sized, evenly spaced small components: image, ``line_no``, ``n_parts``.

    ``parts`` has ``x, y, w, h, area, cx, cy``.  A line takes all components
    within a band of its first; that anchor is what makes it a fold over the
    image's components in order of height.
    """
    small = ((F.col("area").between(20, 3000)) & (F.col("w") / F.greatest(F.col("h"), F.lit(1))).between(0.1, 10) & (F.col("w") < width * 0.3) & (F.col("h") < height * 0.3)
             & ~((F.col("cx") < width * 0.18) & (F.col("cy") < height * 0.10)) & ~((F.col("cx") > width * 0.82) & (F.col("cy") > height * 0.92)))
    item = F.struct(F.col("cy").cast("double").alias("cy"), F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    packed = parts.where(small).groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("ps"))
    band = max(BAND_PX, height * TEXT_BAND)
    start = F.struct(F.lit(-1e18).alias("anchor"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("nos"))

    def step(acc: Column, p: Column) -> Column:
        new = p["cy"] - acc["anchor"] > band
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(F.when(new, p["cy"]).otherwise(acc["anchor"]).alias("anchor"), no.alias("no"), F.concat(acc["nos"], F.array(no)).alias("nos"))

    placed = packed.withColumn("nos", F.aggregate("ps", start, step, lambda a: a["nos"])).select(image, F.explode(F.arrays_zip("ps", "nos")).alias("z"))
    lines = placed.groupBy(image, F.col("z.nos").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("z.ps.x", "z.ps.w", "z.ps.h"))).alias("l")).where(F.size("l") >= 3)
    heights = F.transform("l", lambda p: p["h"])
    gaps = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.element_at("l", i + 1)["x"] - (F.element_at("l", i)["x"] + F.element_at("l", i)["w"]))
    mean_h = F.aggregate(heights, F.lit(0.0), lambda s, v: s + v) / F.size("l")
    even = (mean_h <= height * TEXT_HEIGHT) & (variation(heights) <= TEXT_HEIGHT_CV) & (variation(gaps) <= TEXT_GAP_CV)
    return lines.where(even).select(image, "line_no", F.size("l").alias("n_parts"))


def ghost(frames: DataFrame, background: DataFrame, image: str, channels: list[str], y: str, rows: tuple[int, int] = (502, 930)) -> DataFrame:
    """(image, ``deviation``, ``is_ghost``): mean distance of a band of rows from the background after a cut."""
    b = background.select(image, *[F.col(c).alias("_b" + c) for c in channels])
    far = sum((F.abs(F.col(c) - F.col("_b" + c)) for c in channels), F.lit(0.0)) / len(channels)
    band = frames.where((F.col(y) >= rows[0]) & (F.col(y) < rows[1])).join(b, image)
    return band.groupBy(image).agg(F.avg(far).alias("deviation")).withColumn("is_ghost", F.col("deviation") >= GHOST)


def new_ink(before: DataFrame, after: DataFrame, image: str, x: str, y: str, reach: int = 3) -> DataFrame:
    """Inked pixels of ``after`` with no ink of ``before`` within ``reach`` pixels on both axes.

    The old ink is spread to its neighbours - a fixed number - and anti-joined,
    an equi-join on the pixel.
    """
    at = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    wide = before.select(image, x, y, at.alias("_dx")).select(image, x, y, "_dx", at.alias("_dy"))
    covered = wide.select(image, (F.col(x) + F.col("_dx")).alias(x), (F.col(y) + F.col("_dy")).alias(y)).distinct()
    return after.join(covered, [image, x, y], "left_anti")


def keyed(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel is the magenta of a keyed background: red and blue well above green."""
    return (F.least(r, b) - g > 60) & (F.abs(r - b) < 80)


def key_alpha(distance: Column, spread: Column) -> Column:
    """Opacity of a pixel by its distance from the keyed ground, whose corners differ by ``spread``; a faint haze and an unknown distance are clear."""
    low = F.greatest(F.lit(30.0), spread * 0.6)
    high = F.least(F.lit(200.0), low + 110.0)
    rising = F.least(F.greatest((distance - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255
    return F.floor(F.least(F.greatest((rising - 60) * (255.0 / 195.0), F.lit(0.0)), F.lit(255.0))).cast("int")


def despilled(r: Column, g: Column, b: Column) -> Column:
    """(r, b) of a pixel with the ground's magenta pulled toward its green."""
    spill = F.least(r, b) - g > 24
    pull = lambda c: F.floor(F.when(spill, c * 0.55 + g * 0.45).otherwise(c)).cast("int")
    return F.struct(pull(r).alias("r"), pull(b).alias("b"))


def chalk_tips(pixels: DataFrame, image: str, x: str, y: str) -> DataFrame:
    """(image, tip_x, tip_y): the middle of the bright, opaque pixels about the one furthest down and left; images without any have no row.

    ``pixels`` has ``r``, ``g``, ``b`` and ``alpha``; the first in reading order
    is taken among equals.
    """
    bright = (F.least("r", "g", "b") > 175) & (F.abs(F.col("r") - F.col("b")) < 55) & (F.col("alpha") > 200)
    rows = pixels.where(bright).select(image, F.col(x).alias("_x"), F.col(y).alias("_y"), (F.col(y) - F.col(x)).alias("_s"))
    best = rows.groupBy(image).agg(F.max(F.struct("_s", (-F.col("_y")).alias("ny"), (-F.col("_x")).alias("nx"))).alias("_b"))
    near = rows.join(best, image).where((F.abs(F.col("_y") + F.col("_b.ny")) < 8) & (F.abs(F.col("_x") + F.col("_b.nx")) < 8) & (F.col("_s") >= F.col("_b._s") - 16))
    return near.groupBy(image).agg(F.bround(F.avg("_x"), 0).cast("int").alias("tip_x"), F.bround(F.avg("_y"), 0).cast("int").alias("tip_y"))
