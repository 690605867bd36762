"""Token ids by a public byte-pair vocabulary, through prefix dynamic programming.

For every byte prefix of a piece exactly one token can end a valid encoding of
it.  That last token is stored per prefix: the candidates are the vocabulary
entries that end there (one pass of an Aho-Corasick automaton), and a candidate
is valid if it and the last token of what lies before it would not have been
merged in another way.  The encoding is read back from the end.  Since a
prefix's entry depends only on the bytes before it, appended bytes continue the
table, and an edit recomputes it from there until it runs in step again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from copy import copy
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REMEMBERED = 400_000  # pieces whose ids a worker keeps


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    rest = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, the pair each was merged from, and the automaton that finds them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, ids = _byte_letters(), model["vocab"]
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.size: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        special = {word for word in ids if any(c not in letters for c in word)}
        merged = set()
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = ids[a + b]
            self.pairs[ids[a], ids[b]] = t
            self.split[t] = ids[a], ids[b]
            merged.add(a + b)
        for word, t in ids.items():
            if word in merged or (len(word) == 1 and word not in special):
                self.split.setdefault(t, (t, t))
                self.size[t] = len(word)
                self.automaton.add_word("".join(chr(letters[c]) for c in word), (t, len(word)))
        self.automaton.make_automaton()
        self.longest = max(self.size.values())
        self._fits: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens ``a``, ``b`` side by side are what byte-pair merging makes of their bytes.

        The two are taken apart along the border, latest merge first; a pair
        across the border that would have merged earlier than what was taken
        apart speaks against it.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        pairs, split, bound, x, y, good = self.pairs, self.split, 1 << 60, a, b, True
        while True:
            t = pairs.get((x, y))
            if t is not None and t < bound:
                good = False
                break
            (xl, xr), (yl, yr) = split[x], split[y]
            open_x, open_y = xl != xr or xl != x, yl != yr or yl != y
            if open_x and (x > y or not open_y):
                bound, x = x, xr
            elif open_y:
                bound, y = y + 1, yl
            else:
                break
        if len(self._fits) > 4_000_000:
            self._fits.clear()
        self._fits[key] = good
        return good


class Prefixes:
    """The table of last tokens over the byte prefixes of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.made = 0  # entries that were worked out
        self.append(data)

    def _extend(self, start: int, stop_in_step: list[int] | None = None, shift: int = 0, after: int = 0) -> None:
        """Fill the table from prefix ``start`` on; with an old table, until it runs in step with it."""
        v, last = self.vocabulary, self.last
        fits = v.fits
        origin, held = max(0, start - v.longest + 1), len(last)
        done, agree = start - 1, 0
        for end, (t, n) in v.automaton.iter(self.data[origin:].decode("latin-1")):
            end += origin
            if end <= done:
                continue
            p = end - n
            if p < -1 or (p >= 0 and not fits(last[p], t)):
                continue
            last.append(t)
            done = end
            if stop_in_step is not None and end >= after:
                agree = agree + 1 if stop_in_step[end - shift] == t else 0
                if agree >= v.longest:
                    self.made += len(last) - held
                    last += stop_in_step[end - shift + 1:]
                    return
        self.made += len(last) - held

    def append(self, more: bytes) -> None:
        """Continue the table over ``more``: the ids are those of the whole."""
        start = len(self.last)
        self.data += more
        self._extend(start)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of bytes ``begin`` to ``end``; only entries near the edit are made again."""
        old, shift = self.last, len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        self.last = old[:begin]
        self._extend(begin, old, shift, begin + len(new))

    def ids(self) -> list[int]:
        out, i, last, size = [], len(self.last) - 1, self.last, self.vocabulary.size
        while i >= 0:
            out.append(last[i])
            i -= size[last[i]]
        return out[::-1]


class Encoder:
    """Text to ids: pieces by the vocabulary's pattern, each piece by its prefix table."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary, self.pattern = Vocabulary(path), regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = Prefixes(self.vocabulary, text.encode("utf-8")).ids()
            if len(text) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for p in self.pattern.findall(text):
            ids = known.get(p)
            out += self.piece(p) if ids is None else ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, pattern)


def worker_encoder(spark: SparkSession, path: str | None, pattern: str | None) -> Callable[[], Encoder]:
    """What gives a worker its encoder: the vocabulary is sent to the executors, which need no copy of their own."""
    path, pattern = path or default_path(), pattern or default_pattern()
    spark.sparkContext.addFile(path)
    name = Path(path).name
    return lambda: encoder(SparkFiles.get(name), pattern)


def _encoded(df: DataFrame, keys: list[str], text: str, path: str | None, pattern: str | None, count: bool) -> DataFrame:
    load = worker_encoder(df.sparkSession, path, pattern)
    source = df.select(*keys, F.col(text).cast("string").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out, typ = ("n_tokens", "int") if count else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load().encode
        for b in batches:
            lists = [encode(t) if t else [] for t in b.column(len(keys)).to_pylist()]
            sizes = np.fromiter((len(x) for x in lists), np.int32, len(lists))
            if count:
                col = pa.array(sizes)
            else:
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), col], [*keys, out])

    return source.mapInArrow(run, f"{ddl}, {out} {typ}")


def token_ids(df: DataFrame, keys: list[str], text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Keys and ``ids`` of each row's text, without special tokens; their strings are ordinary text.

    A null and an empty text both give an empty list.  One row per row of
    ``df``; whole texts, whatever their length.
    """
    return _encoded(df, keys, text, path, pattern, count=False)


def token_counts(df: DataFrame, keys: list[str], text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Keys and ``n_tokens``, the number of ids that :func:`token_ids` gives."""
    return _encoded(df, keys, text, path, pattern, count=True)


class Edited:
    """The encoding of a text that goes on being edited: its pieces with their tables, made again only where they change."""

    def __init__(self, encoder: Encoder, text: str) -> None:
        self.encoder = encoder
        self.pieces = [(p, self._table(p)) for p in encoder.pattern.findall(text)]

    def _table(self, piece: str) -> Prefixes:
        return Prefixes(self.encoder.vocabulary, piece.encode("utf-8"))

    def become(self, text: str) -> int:
        """Follow an edit; how many entries it took.

        Pieces that were there before keep their tables; where one piece became
        another, its table is edited between its first and last changed byte.
        """
        old, new = self.pieces, self.encoder.pattern.findall(text)
        head = _in_common([p for p, _ in old], new)
        tail = _in_common([p for p, _ in old[head:]][::-1], new[head:][::-1])
        was, now = old[head:len(old) - tail], new[head:len(new) - tail]
        if len(was) == len(now) == 1:
            table, data = copy(was[0][1]), now[0].encode("utf-8")  # pieces alike share a table
            a = _in_common(table.data, data)
            z = _in_common(table.data[a:][::-1], data[a:][::-1])
            known = table.made
            table.replace(a, len(table.data) - z, data[a:len(data) - z])
            made, middle = table.made - known, [(now[0], table)]
        else:
            known, made, middle = dict(was), 0, []
            for p in now:
                if p not in known:
                    known[p] = self._table(p)
                    made += known[p].made
                middle.append((p, known[p]))
        self.pieces = [*old[:head], *middle, *old[len(old) - tail:]]
        return made

    def ids(self) -> list[int]:
        return [t for _, table in self.pieces for t in table.ids()]


def _in_common(a: Sequence, b: Sequence) -> int:
    """How many first items are the same."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def edited_ids(df: DataFrame, keys: list[str], old: str, new: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Keys, ``ids`` of the text ``new``, ``n_bytes`` of it and ``n_made``, the table entries that the edit from ``old`` took.

    A null text counts as empty, before and after; the ids are those of
    :func:`token_ids`.  ``old`` is encoded for the comparison; a caller who
    keeps :class:`Edited` pays the edit alone.
    """
    load = worker_encoder(df.sparkSession, path, pattern)
    source = df.select(*keys, F.coalesce(F.col(old).cast("string"), F.lit("")).alias("_old"), F.coalesce(F.col(new).cast("string"), F.lit("")).alias("_new"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for b in batches:
            ids, made, size = [], [], []
            for was, now in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True):
                edited = Edited(encoder, was)
                made.append(edited.become(now))
                ids.append(edited.ids())
                size.append(len(now.encode("utf-8")))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(ids, pa.list_(pa.int32())), pa.array(size, pa.int32()), pa.array(made, pa.int32())],
                                             [*keys, "ids", "n_bytes", "n_made"])

    return source.mapInArrow(run, f"{ddl + ', ' if ddl else ''}ids array<int>, n_bytes int, n_made int")
