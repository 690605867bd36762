"""Ordered computations over timelines: offsets, order, chains, captions, runs, sliding audits.

``keys`` name a timeline (an episode's scene); its rows are ordered by
``order``, which should end in a unique column.  Columns are ``text``,
``start_ms``, ``end_ms`` unless said otherwise.  Nulls in the bounds are the
caller's to drop; empty frames give empty frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import next_row, prefix_sums

# Fixed values, milliseconds, characters, pixels.
CAPTION_CHARS, CAPTION_PAUSE = 22, 400
LINE_CHARS, LINE_PAUSE = 18, 350
SWEEP_WINDOW, SWEEP_HOP, SWEEP_TRAVEL, SWEEP_ARC = 2000, 500, 800, 60.0
BOUND_TOLERANCE = 50
REGION_GAP = 150


def scene_windows(words: DataFrame, keys: list[str]) -> DataFrame:
    """First start, last end and number of units of each scene."""
    return words.groupBy(*keys).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_units"))


def running_offsets(durations: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """Add ``offset_ms``, the sum of the durations before."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return durations.withColumn("offset_ms", F.coalesce(F.sum(duration).over(upto), F.lit(0)))


def with_total(details: DataFrame, group: str, value: str) -> DataFrame:
    """Sums by group, and one row of the total with a null group."""
    return details.rollup(group).agg(F.sum(value).alias(value), F.grouping(group).cast("int").alias("is_total"))


def order_violations(units: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Units that start before the valid unit before them; units of negative duration are passed over."""
    w = Window.partitionBy(*keys).orderBy(*order)
    valid = units.where(F.col("end_ms") >= F.col("start_ms")).withColumn("previous_start_ms", F.lag("start_ms").over(w))
    return valid.where(F.col("start_ms") < F.col("previous_start_ms"))


def outside_windows(units: DataFrame, windows: DataFrame, keys: list[str], tolerance: int = BOUND_TOLERANCE) -> DataFrame:
    """Units that reach out of their scene's window by more than the tolerance; units without a window are not judged."""
    w = windows.select(*keys, F.col("start_ms").alias("window_start"), F.col("end_ms").alias("window_end"))
    out = (F.col("start_ms") < F.col("window_start") - tolerance) | (F.col("end_ms") > F.col("window_end") + tolerance)
    return units.join(w, keys).where(out)


def chain_breaks(steps: DataFrame, keys: list[str], order: list[str], leaves: str, enters: str) -> DataFrame:
    """Neighbours of which the first's ``leaves`` is not the second's ``enters``; blank ones are not judged."""
    nxt = next_row(steps, keys, order, F.col(enters), "next_state")
    a, b = F.trim(leaves), F.trim("next_state")
    return nxt.where(T.nonempty(F.col(leaves)) & T.nonempty(F.col("next_state")) & (a != b))


def _segments(words: DataFrame, keys: list[str], order: list[str], pause: int) -> DataFrame:
    """Words with ``_seg``: maximal stretches without a break that depends on neighbours alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev_end, prev_closed = F.lag("end_ms").over(w), F.lag(T.is_sentence_end(F.col("text"))).over(w)
    new = F.when(prev_end.isNull() | prev_closed | (F.col("start_ms") - prev_end >= pause), 1).otherwise(0)
    return words.withColumn("_new", new).withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _fold(words: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Line numbers within a segment under a budget of characters that a new line resets.

    Only the budget needs a fold, and only within one segment; its words are
    folded in the JVM.
    """
    fields = dict.fromkeys([*order, "_n", "text", "start_ms", "end_ms"])
    packed = words.withColumn("_n", F.length("text")).groupBy(*keys, "_seg").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ws"))
    start = F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("lines"))

    def step(acc: Column, w: Column) -> Column:
        full = acc["used"] >= limit
        line = F.when(full, acc["line"] + 1).otherwise(acc["line"])
        used = F.when(full, F.lit(0).cast("bigint")).otherwise(acc["used"]) + w["_n"]
        return F.struct(line.alias("line"), used.alias("used"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    lines = F.aggregate("ws", start, step, lambda acc: acc["lines"])
    return (packed.withColumn("lines", lines).select(*keys, "_seg", F.explode(F.arrays_zip("ws", "lines")).alias("z"))
            .select(*keys, "_seg", F.col("z.lines").alias("_line"), "z.ws.*").drop("_n"))


def captions(words: DataFrame, keys: list[str], order: list[str], limit: int = CAPTION_CHARS, pause: int = CAPTION_PAUSE) -> DataFrame:
    """Captions of each scene: keys, ``caption_no`` from 1, ``text``, ``start_ms``, ``end_ms``, ``n_words``.

    A caption closes at a sentence's end, at a pause, and once it holds
    ``limit`` characters.  Blank words are passed over.
    """
    real = words.where(T.nonempty(F.col("text")))
    lined = _fold(_segments(real, keys, order, pause), keys, order, limit)
    groups = lined.groupBy(*keys, "_seg", "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "").alias("text"),
        F.min_by("start_ms", F.struct(*order)).alias("start_ms"), F.max_by("end_ms", F.struct(*order)).alias("end_ms"), F.count("*").alias("n_words"))
    w = Window.partitionBy(*keys).orderBy("_seg", "_line")
    return groups.withColumn("caption_no", F.row_number().over(w)).drop("_seg", "_line")


def subtitle_lines(words: DataFrame, keys: list[str], order: list[str], limit: int = LINE_CHARS, pause: int = LINE_PAUSE) -> DataFrame:
    """Words with their subtitle line: keys, order, ``text``, bounds, ``line_no`` from 1.

    A line breaks before a word if it already holds ``limit`` characters or the
    pause is long, and after a sentence's end.  Empty words are left out.
    """
    real = words.where(F.col("text") != "")
    lined = _fold(_segments(real, keys, order, pause), keys, order, limit)
    w = Window.partitionBy(*keys).orderBy("_seg", "_line")
    return lined.withColumn("line_no", F.dense_rank().over(w)).drop("_seg", "_line")


def karaoke(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``gap_cs`` before each word of a line and its own ``k_cs``, in hundredths of a second."""
    w = Window.partitionBy(*keys, "line_no").orderBy(*order)
    gap = T.half_even((F.col("start_ms") - F.coalesce(F.lag("end_ms").over(w), F.col("start_ms"))) / 10)
    own = F.greatest(F.lit(1), T.half_even((F.col("end_ms") - F.col("start_ms")) / 10))
    return lines.withColumn("gap_cs", F.greatest(gap, F.lit(0))).withColumn("k_cs", own)


def runs(rows: DataFrame, keys: list[str], order: list[str], flag: Column, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` neighbours for which ``flag`` holds: keys, ``run_no``, first and last position, length."""
    marked = rows.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("_flag"))
    placed = prefix_sums(marked, keys, order, {"_pos": F.lit(1), "_set": F.col("_flag").cast("int")}).where("_flag")
    islands = placed.withColumn("_island", F.col("_pos") - F.col("_set")).groupBy(*keys, "_island")
    found = islands.agg(F.min("_pos").cast("int").alias("first_pos"), F.max("_pos").cast("int").alias("last_pos"), F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = prefix_sums(found, keys, ["first_pos"], {"run_no": F.lit(1)})
    return numbered.select(*keys, "first_pos", "last_pos", "n", F.col("run_no").cast("int").alias("run_no"))


def sweep_audit(tasks: DataFrame, key: str, window: int = SWEEP_WINDOW, hop: int = SWEEP_HOP, travel: int = SWEEP_TRAVEL, arc: float = SWEEP_ARC) -> DataFrame:
    """Sliding windows in which the hand moves but hardly draws: key, ``n_windows``, ``n_sweeps``.

    Tasks (``kind``, ``start_ms``, ``end_ms``, ``length``) count by their
    start.  Each task goes to the windows that hold it - a fixed number - and
    partial sums meet there; windows without tasks hold no travel.  A timeline
    no longer than the window has none.
    """
    # a timeline's windows start at 0, hop, ... below its end less the window
    ends = tasks.groupBy(key).agg(F.max("end_ms").alias("dur"))
    n = F.greatest(F.ceil((F.col("dur") - window) / hop), F.lit(0)).cast("bigint")
    first = F.greatest(F.floor((F.col("start_ms") - window) / hop).cast("bigint") + 1, F.lit(0).cast("bigint"))
    last = F.floor(F.col("start_ms") / hop).cast("bigint")
    placed = tasks.where((F.col("start_ms") >= 0)).select(key, "kind", "length", (F.col("end_ms") - F.col("start_ms")).alias("ms"), F.explode(F.sequence(first, last)).alias("slot"))
    sums = placed.groupBy(key, "slot").agg(F.sum(F.when(F.col("kind") == "draw", F.col("length")).otherwise(0.0)).alias("arc"),
                                           F.sum(F.when(F.col("kind") == "travel", F.col("ms")).otherwise(0)).alias("travel"))
    flagged = sums.where((F.col("arc") < arc) & (F.col("travel") > travel))
    counted = flagged.join(ends, key).where(F.col("slot") < n).groupBy(key).agg(F.count("*").alias("n_sweeps"))
    return ends.select(key, n.alias("n_windows")).join(counted, key, "left").fillna(0, ["n_sweeps"])


def even_split(ops: DataFrame, keys: list[str], order: list[str], n_panels: str) -> DataFrame:
    """Add ``panel_no``: the ops of a scene over its panels in order, the first panels get one more."""
    w = Window.partitionBy(*keys)
    i, n, k = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w), F.col(n_panels)
    rows = ops.withColumn("_i", i).withColumn("_n", n)
    base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    cut = extra * (base + 1)
    panel = F.when(F.col("_i") < cut, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - cut) / F.greatest(base, F.lit(1))))
    return rows.withColumn("panel_no", (panel + 1).cast("int")).drop("_i", "_n")


def protected_regions(panels: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``n_protected`` and ``protected_area``: how many panels come before, in order, and their area.

    The rectangles themselves are one ordered list per scene, of which a panel's
    are the first ``n_protected`` (:func:`ordered_regions`): none is copied to
    the panels after it.
    """
    area = F.col("w").cast("bigint") * F.col("h")
    return (prefix_sums(panels.withColumn("_a", area), keys, order, {"_n": F.lit(1), "_sum": F.col("_a")})
            .withColumn("n_protected", F.col("_n") - 1).withColumn("protected_area", F.col("_sum") - F.col("_a")).drop("_n", "_sum", "_a"))


def ordered_regions(panels: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, ``regions``: the rectangles of a scene's panels in order; a scene's panels fit on one board."""
    item = F.struct(*order, F.struct("x", "y", "w", "h").alias("r"))
    return panels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["r"]).alias("regions"))


def serialise(regions: DataFrame, keys: list[str], order: list[str], gap: int = REGION_GAP) -> DataFrame:
    """Add ``actual_start``, ``actual_end``: each region starts when wanted or ``gap`` after the one before.

    ``start_i' = max(start_i, end_{i-1}' + gap)`` in closed form: with S the sum
    of the durations and gaps before, it is S plus the running maximum of
    start - S, so a window is enough.  Regions of null or no duration are kept
    out of the chain and get nulls.
    """
    live = F.col("duration_ms") > 0
    w = Window.partitionBy(*keys).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = regions.withColumn("_s", F.coalesce(F.sum(F.when(live, F.col("duration_ms") + gap)).over(before), F.lit(0)))
    lead = F.max(F.when(live, F.greatest(F.col("start_ms"), F.lit(gap)) - F.col("_s"))).over(upto)
    rows = rows.withColumn("actual_start", F.when(live, F.col("_s") + lead))
    return rows.withColumn("actual_end", F.col("actual_start") + F.col("duration_ms")).drop("_s")


def contiguous(windows: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """Windows without holes: the first starts at 0, each gap goes to the one before, the last ends at ``total``.

    Windows without cues (null bounds) are empty at the end before them.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    reach = F.coalesce(F.max("end_ms").over(upto), F.lit(0))
    rows = windows.withColumn("_reach", reach).withColumn("_last", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())) == 1)
    rows = rows.withColumn("_start", F.greatest(F.coalesce(F.col("start_ms"), F.coalesce(F.lag("_reach").over(w), F.lit(0))), F.coalesce(F.lag("_reach").over(w), F.lit(0))))
    rows = rows.withColumn("_start", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("_start")))
    nxt = F.min("_start").over(after)
    end = F.when(F.col("_last"), F.greatest(F.when(F.col(total) > 0, F.col(total)).otherwise(F.col("_reach")), F.col("_start"))).otherwise(F.coalesce(nxt, F.col("_reach")))
    return rows.withColumn("repaired_start", F.col("_start")).withColumn("repaired_end", end).drop("_reach", "_last", "_start")


def clusters(rows: DataFrame, keys: list[str], order: list[str], gap: int) -> DataFrame:
    """Add ``cluster_no``: a row that starts more than ``gap`` after the furthest end before opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_o", F.when(reach.isNull() | (F.col("start_ms") - reach > gap), 1).otherwise(0))
    return opened.withColumn("cluster_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def to_local(units: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds from the scene's start on, 0 at least."""
    w = windows.select(*keys, F.col("start_ms").alias("_w"))
    shift = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("_w"))
    return units.join(w, keys).withColumn("local_start_ms", shift("start_ms")).withColumn("local_end_ms", shift("end_ms")).drop("_w")


def arc_lengths(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``arc``, the length of the polyline up to each point."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("arc", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def frame_states(tasks: DataFrame, key: str, fps: int = 30) -> DataFrame:
    """What is going on at each frame: key, ``frame_no``, ``kind``, ``progress`` (0 to 1 of the task).

    Every task lists the frames it covers, so no range join is needed; where
    tasks overlap, the one that began last is shown.  Frames without a task do
    not appear; empty and reversed tasks cover none.
    """
    first = F.ceil(F.col("start_ms") * fps / 1000).cast("bigint")
    last = (F.ceil(F.col("end_ms") * fps / 1000) - 1).cast("bigint")
    rows = tasks.where(F.col("end_ms") > F.col("start_ms")).select(key, "kind", "start_ms", "end_ms", F.explode(F.when(last >= first, F.sequence(first, last))).alias("frame_no"))
    shown = rows.groupBy(key, "frame_no").agg(F.max(F.struct("start_ms", "end_ms", "kind")).alias("_t"))
    progress = (F.col("frame_no") * 1000 / fps - F.col("_t.start_ms")) / (F.col("_t.end_ms") - F.col("_t.start_ms"))
    return shown.select(key, "frame_no", F.col("_t.kind").alias("kind"), progress.alias("progress"))


HAND_LEAD, HAND_SETTLE, HAND_FADE, LABEL_FADE = 350, 180, 240, 300  # fixed values, milliseconds


def _covered(rows: DataFrame, key: str, first: Column, last: Column, fps: int) -> DataFrame:
    """(key, frame_no) of the frames from ``first`` to ``last`` milliseconds, both included."""
    a, b = F.greatest(F.ceil(first * fps / 1000), F.lit(0)).cast("bigint"), F.floor(last * fps / 1000).cast("bigint")
    return rows.select(key, F.explode(F.when(b >= a, F.sequence(a, b))).alias("frame_no"))


def hand_frames(tasks: DataFrame, key: str, fps: int = 30) -> DataFrame:
    """(key, frame_no): the frames that show the hand.

    It is there while something is drawn, 350 ms before, and 180 ms after the
    last; never while an object moves.  Frames end with the last task.
    """
    draws, moves = tasks.where("kind = 'draw'"), tasks.where("kind = 'move'")
    total = tasks.groupBy(key).agg(F.bround(F.max("end_ms") * fps / 1000, 0).cast("bigint").alias("_n"))
    last = draws.groupBy(key).agg(F.max("end_ms").alias("_z")).where("_z > 0")
    shown = _covered(draws, key, F.col("start_ms") - HAND_LEAD, F.col("end_ms"), fps).unionByName(_covered(last, key, F.col("_z"), F.col("_z") + HAND_SETTLE - 1e-6, fps)).distinct()
    hidden = _covered(moves, key, F.col("start_ms"), F.col("end_ms"), fps).distinct()
    return shown.join(hidden, [key, "frame_no"], "left_anti").join(total, key).where("frame_no < _n").select(key, "frame_no")


def faded(shown: Column, fps: int = 30) -> Column:
    """Opacity frame by frame of what is shown in an array of flags: it comes and goes over 240 ms; a scene's frames are its row."""
    step = 1000.0 / fps / HAND_FADE

    def follow(acc: Column, on: Column) -> Column:
        now = F.when(on, F.least(F.lit(1.0), acc["a"] + step)).otherwise(F.greatest(F.lit(0.0), acc["a"] - step))
        return F.struct(now.alias("a"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(shown, F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out")), follow, lambda acc: acc["out"])


def label_alpha(at_ms: Column, reveal_ms: Column) -> Column:
    """Opacity of a label, 300 ms from its reveal on; 0 before it and without one."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at_ms - reveal_ms) / LABEL_FADE)), F.lit(0.0))


def label_reveals(labels: DataFrame, tasks: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """When each label fades in: the last task's end of its element, else its window's end, else the end of all drawing.

    ``labels`` and ``windows`` have keys and ``eid``; ``tasks`` also ``kind``.
    """
    done = tasks.groupBy(*keys, "eid").agg(F.max("end_ms").alias("_task"))
    drawn = tasks.where("kind = 'draw'").groupBy(*keys).agg(F.max("end_ms").alias("_drawn"))
    planned = windows.groupBy(*keys, "eid").agg(F.max("end_ms").alias("_window"))
    rows = labels.join(done, [*keys, "eid"], "left").join(planned, [*keys, "eid"], "left").join(drawn, keys, "left")
    return rows.withColumn("reveal_ms", F.coalesce("_task", "_window", "_drawn")).drop("_task", "_window", "_drawn")
