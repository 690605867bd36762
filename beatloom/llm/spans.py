"""Long exact spans shared between documents, by level-wise doubling.

Windows of a quarter of the wanted length are compared first; those that more
than one text has are extended to twice that length, and again, until the
wanted length.  At each level a text offers only anchors: the windows whose
hash is least among the neighbours, over a stretch so wide that every run of
the wanted length holds one.  Two texts that share a run choose the same anchor
in it, so nothing is lost, and a level compares about 2 L / (wanted length) of
the positions.  At the wanted length itself every window near a surviving
anchor is compared, by a 128-bit digest of its characters.

Copies are folded first: one text per class is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n + 1, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = BASE, BACK
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` characters."""
    n = len(codes)
    size = 1 << max(12, (n + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(codes + np.uint64(1)) * up[:n], out=sums[1:])
    return _mixed((sums[length:] - sums[:n + 1 - length]) * down[:n + 1 - length])


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every ``w`` neighbours."""
    if w == 1:
        return x
    m = len(x)
    pad = -m % w
    rows = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, w)
    left = op.accumulate(rows, axis=1).ravel()
    right = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:m - w + 1], left[w - 1:m])


def _near(n_runs: int, positions: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Whether each run of ``wanted`` characters holds one of the windows at ``positions``."""
    up = np.bincount(np.clip(positions + length - wanted, 0, n_runs), minlength=n_runs + 1)
    down = np.bincount(np.clip(positions + 1, 0, n_runs), minlength=n_runs + 1)
    return np.cumsum(up - down)[:n_runs] > 0


def anchors(codes: np.ndarray, length: int, wanted: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of ``length``: the windows that are the least of a run that is alive."""
    hashes = window_hashes(codes, length)
    w = wanted - length + 1
    low = _sliding(hashes, w, np.minimum, np.iinfo(np.uint64).max)
    pad = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([pad, np.where(alive, low, np.uint64(0)), pad]), w, np.maximum, 0)
    at = np.flatnonzero((high == hashes) & (high > 0))
    return at, hashes[at]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


CHUNK = 400_000  # characters that are hashed at once


def _level(texts: DataFrame, length: int, kept_length: int, wanted: int) -> DataFrame:
    """(cls, pos, h) of a level's anchors; at the wanted length h is the digest of the window.

    Texts are laid end to end and hashed together; runs that reach over the end
    of a text are never alive.  All texts have ``wanted`` characters at least.
    """
    final = length == wanted

    def chunk(cls: list, ts: list, kept: list) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in ts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        n_runs = int(starts[-1]) - wanted + 1
        alive = np.zeros(n_runs + wanted, bool)
        if kept_length:
            at = np.concatenate([np.asarray(k, np.int64) + s for k, s in zip(kept, starts, strict=False)])
            alive[:n_runs] = _near(n_runs, at, kept_length, wanted)
        else:
            alive[:n_runs] = True
        for end in starts[1:]:
            alive[max(0, end - wanted + 1):end] = False
        alive = alive[:n_runs]
        if final:
            at = np.flatnonzero(alive)
        else:
            at, hashes = anchors(_codes("".join(ts)), length, wanted, alive)
        which = np.searchsorted(starts, at, side="right") - 1
        pos = (at - starts[which]).astype(np.int32)
        if final:
            marks = pa.array([blake2b(ts[n][p:p + wanted].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                              for n, p in zip(which.tolist(), pos.tolist(), strict=True)], pa.binary())
        else:
            marks = pa.array(hashes.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(cls, np.int64)[which]), pa.array(pos), marks], ["cls", "pos", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, ts, kept, n = [], [], [], 0
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist() if kept_length else [None] * b.num_rows, strict=True)
            for c, t, k in rows:
                cls.append(c), ts.append(t), kept.append(k)
                n += len(t)
                if n >= CHUNK:
                    yield chunk(cls, ts, kept)
                    cls, ts, kept, n = [], [], [], 0
        if ts:
            yield chunk(cls, ts, kept)

    columns = ["cls", "text", "kept"] if kept_length else ["cls", "text"]
    return texts.select(*columns).mapInArrow(run, f"cls bigint, pos int, h {'binary' if final else 'bigint'}")


def _repeated(found: DataFrame) -> DataFrame:
    """(h, lo, hi): the marks of more than one text, with the first and the last of them."""
    return found.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")


def _survivors(found: DataFrame) -> DataFrame:
    """The rows whose mark stands in more than one text; laid out by mark once, for telling and for taking them."""
    by_mark = found.repartition("h")
    return by_mark.join(_repeated(by_mark).select("h").hint("shuffle_hash"), "h", "left_semi")  # each mark once: nothing to sort


def _folded(docs: DataFrame, key: str, text: str, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Members (cls, key) of each class of equal texts, and one text per class (cls, text, n_members)."""
    long = docs.where(F.length(text) >= wanted).select(F.col(key).alias("key"), F.col(text).alias("text"), F.unhex(F.sha2(text, 256)).alias("same"))
    one = long.groupBy("same").agg(F.min("key").alias("cls"), F.count("*").alias("n_members"), F.first("text").alias("text"))
    one = materialise(one, "span-texts")
    many = one.where("n_members > 1").select("same", "cls")
    members = long.select("key", "same").join(many, "same").select("cls", "key").where("cls <> key")
    return members, one.select("cls", "text", "n_members")


def shared_windows(texts: DataFrame, wanted: int) -> DataFrame:
    """(cls, pos, h) of every window of ``wanted`` characters that stands in more than one of the texts."""
    level, kept_length, current = max(wanted // 4, 1), 0, texts.select("cls", "text")
    while True:
        found = materialise(_level(current, level, kept_length, wanted), f"span-level-{level}")
        survivors = _survivors(found)
        if level == wanted:
            return materialise(survivors, "span-windows")
        kept = survivors.groupBy("cls").agg(F.collect_list("pos").alias("kept"))
        current = texts.select("cls", "text").join(kept, "cls")
        kept_length, level = level, min(2 * level, wanted)


CELL = 1_000  # members of a key that meet as one


def _met(rows: DataFrame, key: str, member: str, n: str, hot: bool) -> DataFrame:
    """(a, b), a < b, of the members of each key; ``n`` is how many it has, ``hot`` whether any has more than a cell.

    Members of such a key are cut into cells, and any two cells meet in a task
    of their own: no task makes more than a million pairs of one key.
    """
    few = rows.where(F.col(n) <= CELL)
    pairs = few.select(key, F.col(member).alias("a")).join(few.select(key, F.col(member).alias("b")), key).where("a < b").select("a", "b")
    if not hot:
        return pairs
    celled = rows.where(F.col(n) > CELL).select(key, member, F.pmod(F.xxhash64(member), F.ceil(F.col(n) / CELL)).cast("int").alias("cell"))
    cells = celled.select(key, "cell").distinct()
    blocks = cells.select(key, F.col("cell").alias("ca")).join(cells.select(key, F.col("cell").alias("cb")), key).where("ca <= cb")
    blocks = materialise(blocks, "span-blocks")
    left = celled.select(key, F.col(member).alias("a"), F.col("cell").alias("ca")).join(blocks, [key, "ca"])
    right = celled.select(key, F.col(member).alias("b"), F.col("cell").alias("cb")).join(blocks, [key, "cb"])
    met = left.join(right, [key, "ca", "cb"]).where("ca < cb or a < b")
    return pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _pairs(windows: DataFrame) -> DataFrame:
    """Pairs of classes that share a window.

    Windows that stand in the same set of classes - told by their number and
    two sums of hashes - give the same pairs, so one window speaks for each set.
    """
    each = windows.select("h", "cls").repartition("h").distinct()
    part = lambda s: F.xxhash64(F.col("cls"), F.lit(s)).cast("decimal(20,0)")
    sets = each.groupBy("h").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(2)).alias("b"))
    chosen = sets.groupBy("n", "a", "b").agg(F.min("h").alias("h")).select("h", "n")
    few = materialise(each.join(chosen.hint("shuffle_hash"), "h"), "span-sets")
    return _met(few, "h", "cls", "n", not few.where(F.col("n") > CELL).isEmpty()).distinct().toDF("cls_a", "cls_b")


def shared_pairs(docs: DataFrame, key: str, text: str, wanted: int = 200) -> DataFrame:
    """(doc_a, doc_b), the smaller key first, of documents with a run of ``wanted`` characters in common.

    Equal texts of that length share themselves.  Null, empty and shorter texts
    share nothing.  ``key`` must be unique; characters are code points.
    """
    members, texts = _folded(docs, key, text, wanted)
    pairs = _pairs(shared_windows(texts, wanted))
    own = texts.select("cls", F.col("cls").alias("key"))
    everyone = members.unionByName(own)  # class and document, the class's own included
    sizes = texts.where("n_members > 1").select("cls", "n_members")
    hot = not sizes.where(F.col("n_members") > CELL).isEmpty()
    within = _met(everyone.join(sizes, "cls"), "cls", "key", "n_members", hot).toDF("doc_a", "doc_b")
    left = pairs.join(everyone.select(F.col("cls").alias("cls_a"), F.col("key").alias("ka")), "cls_a")
    both = left.join(everyone.select(F.col("cls").alias("cls_b"), F.col("key").alias("kb")), "cls_b")
    across = both.select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b"))
    return across.unionByName(within)


def shared_classes(docs: DataFrame, key: str, text: str, wanted: int = 200) -> tuple[DataFrame, DataFrame]:
    """What :func:`shared_pairs` says without its pairs of copies: membership and the pairs of representatives.

    The first is one row for each document: (doc_id, ``class_id``, ``n_copies``,
    ``n_links``), its class the least key among equal texts, ``n_copies`` how
    many the class has, ``n_links`` with how many other documents it shares a
    run.  Documents too short to share are classes of their own without links.
    The second is (class_a, class_b) of classes that share a run.
    """
    members, texts = _folded(docs, key, text, wanted)
    pairs = materialise(_pairs(shared_windows(texts, wanted)), "span-pairs")
    sizes = texts.select("cls", "n_members")
    ends = pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(pairs.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    links = ends.join(sizes.select(F.col("cls").alias("other"), F.col("n_members").alias("n")), "other").groupBy("cls").agg(F.sum("n").alias("across"))
    classes = sizes.join(links, "cls", "left").select("cls", "n_members", (F.col("n_members") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    copies = members.join(classes, "cls").select("key", "cls", "n_members", "n_links")
    known = copies.unionByName(classes.select(F.col("cls").alias("key"), "cls", "n_members", "n_links"))
    every = docs.select(F.col(key).alias("key")).join(known, "key", "left")
    membership = every.select(F.col("key").alias("doc_id"), F.coalesce("cls", "key").alias("class_id"), F.coalesce("n_members", F.lit(1)).cast("bigint").alias("n_copies"),
                              F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return membership, pairs.toDF("class_a", "class_b")


def _runs(windows: DataFrame) -> DataFrame:
    """(cls, run, units): the neighbouring units of each text of which any two stand side by side in another text too.

    A unit (first, last, id) is a row of windows that follow each other wherever
    one of them stands, so it stands whole wherever a part of it does.
    """
    by_text = Window.partitionBy("cls").orderBy("pos")  # one text's windows
    beside = lambda of, step: F.when(of("pos").over(by_text) == F.col("pos") + step, of("h").over(by_text))
    linked = windows.select("cls", "pos", "h", beside(F.lag, -1).alias("prev"), beside(F.lead, 1).alias("next"))
    alone = lambda c: F.coalesce((F.count(c) < F.count("*")) | (F.min(c) != F.max(c)), F.lit(True))
    loose = linked.groupBy("h").agg(alone("prev").alias("left"), alone("next").alias("right")).where("left or right")
    marked = linked.join(loose, "h", "left").fillna(False, ["left", "right"])
    opened = F.col("prev").isNull() | F.col("left") | F.lag("right").over(by_text)
    units = (marked.withColumn("o", F.when(opened, 1).otherwise(0)).withColumn("u", F.sum("o").over(by_text))
             .groupBy("cls", "u").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("h", "pos").alias("id")))
    by_unit = Window.partitionBy("cls").orderBy("first")
    before = F.when(F.lag("last").over(by_unit) + 1 == F.col("first"), F.lag("id").over(by_unit))
    units = materialise(units.withColumn("before", before).drop("u"), "span-units")
    shared = units.where("before is not null").groupBy("before", "id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    joined = units.join(shared.select("before", "id", F.lit(0).alias("same")), ["before", "id"], "left")
    runs = joined.withColumn("run", F.sum(F.coalesce("same", F.lit(1))).over(by_unit)).groupBy("cls", "run")
    return materialise(runs.agg(F.sort_array(F.collect_list(F.struct("first", "last", "id"))).alias("units")), "span-runs")


MASK, STEP_A, STEP_B = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
FEW = 24  # units that are gone through one by one


class _Row:
    """The units of a run, with a digest of any stretch of them from sums over their ids."""

    def __init__(self, ids: list[bytes]) -> None:
        self.sums, self.powers = [(0, 0)], [(1, 1)]
        a = b = 0
        p = q = 1
        for word in ids:
            x, y = unpack("<2Q", word)
            a, b = (a * STEP_A + x) & MASK, (b * STEP_B + y) & MASK
            p, q = p * STEP_A & MASK, q * STEP_B & MASK
            self.sums.append((a, b))
            self.powers.append((p, q))

    def digest(self, i: int, j: int) -> bytes:
        """Of the units i to j."""
        (a, b), (c, d), (p, q) = self.sums[i], self.sums[j + 1], self.powers[j + 1 - i]
        return pack("<2Q", (c - a * p) & MASK, (d - b * q) & MASK)

    def digests(self) -> set[bytes]:
        """Of all stretches, each once: a row of one repeated unit has no more than it has units."""
        r = len(self.sums) - 1
        if r <= FEW:
            return {self.digest(i, j) for i in range(r) for j in range(i, r)}
        sums, powers = np.array(self.sums, np.uint64), np.array(self.powers, np.uint64)
        found: set[bytes] = set()
        for n in range(1, r + 1):
            marks = np.ascontiguousarray(sums[n:] - sums[:-n] * powers[n]).view("V16").ravel()
            found.update(x.tobytes() for x in np.unique(marks))
        return found


def _parts(runs: DataFrame) -> DataFrame:
    """(cls, run, h): the digests of the stretches of a run's units."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, run, ids in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                marks = list(_Row(ids).digests())
                yield pa.RecordBatch.from_arrays([pa.array([cls] * len(marks), pa.int64()), pa.array([run] * len(marks), pa.int64()), pa.array(marks, pa.binary())], ["cls", "run", "h"])

    ids = runs.select("cls", F.col("run").cast("bigint"), F.col("units.id").alias("ids"))
    return ids.mapInArrow(parts, "cls bigint, run bigint, h binary")


def _stretches(windows: DataFrame, wanted: int) -> DataFrame:
    """(cls, start_char, end_char, span_id, lo, hi): the stretches that stand whole in another text and in no longer such stretch."""
    runs = _runs(windows)
    parts = materialise(_parts(runs), "span-parts")
    shared = parts.join(_repeated(parts), "h").groupBy("cls", "run").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("shared"))
    rows = runs.withColumn("run", F.col("run").cast("bigint")).join(shared, ["cls", "run"]).select("cls", "units", "shared")
    names = ["cls", "start_char", "end_char", "span_id", "lo", "hi"]

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cls, units, known in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                held, row, end, last = {x["h"]: x for x in known}, _Row([u["id"] for u in units]), 0, -1
                for i in range(len(units)):
                    end = max(end, i)  # what is shared from one unit on is shared from the next
                    while end + 1 < len(units) and row.digest(i, end + 1) in held:
                        end += 1
                    if end > last:
                        x = held[row.digest(i, end)]
                        out.append((cls, units[i]["first"], units[end]["last"] + wanted, x["h"].hex(), x["lo"], x["hi"]))
                        last = end
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(longest, "cls bigint, start_char int, end_char int, span_id string, lo bigint, hi bigint")


def shared_spans(docs: DataFrame, key: str, text: str, wanted: int = 200) -> DataFrame:
    """(doc_id, ``start_char``, ``end_char``, ``span_id``, ``other_doc``): the stretches of each document that stand whole in another.

    Only those within no longer one; stretches found in different documents may
    overlap.  Equal stretches have one ``span_id``.  ``other_doc`` is a document
    that has the stretch: the least of the classes of equal texts that have it,
    the greatest of them where the document's own is the least.  A text with
    copies is shared whole, with the least copy or, if it is that, the greatest.
    """
    members, texts = _folded(docs, key, text, wanted)
    runs = _stretches(shared_windows(texts, wanted), wanted)
    many = texts.where("n_members > 1")
    single = runs.join(many.select("cls"), "cls", "left_anti")
    other = F.when(F.col("lo") == F.col("cls"), F.col("hi")).otherwise(F.col("lo"))
    whole = many.select("cls", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.md5("text").alias("span_id"))
    last = members.groupBy("cls").agg(F.max("key").alias("other_doc"))
    columns = ["start_char", "end_char", "span_id", "other_doc"]
    return (single.withColumn("other_doc", other).select(F.col("cls").alias("doc_id"), *columns)
            .unionByName(whole.join(last, "cls").select(F.col("cls").alias("doc_id"), *columns))
            .unionByName(members.join(whole, "cls").withColumn("other_doc", F.col("cls")).select(F.col("key").alias("doc_id"), *columns)))


def shared_report(docs: DataFrame, key: str, text: str, wanted: int = 200) -> DataFrame:
    """(doc_id, ``n_chars``, ``n_spans``, ``shared_chars``) of every document; null texts have 0 characters.

    Characters in more than one span count once.
    """
    passed = F.lag("end_char", 1, 0).over(Window.partitionBy("doc_id").orderBy("start_char"))  # a later start has a later end
    spans = shared_spans(docs, key, text, wanted).withColumn("fresh", F.col("end_char") - F.greatest("start_char", passed))
    spans = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("fresh").alias("shared_chars"))
    every = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    return every.join(spans, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
