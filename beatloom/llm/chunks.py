"""Splitting oversized texts into overlapping pieces at natural boundaries.

Prefix sums of the sizes of a text's units and sorted arrays of the unit
numbers after which a sentence or a word ends; each cut is found by binary
search: the last boundary at which the piece still is under the limit, a hard
cut where there is none, then a step back by the overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .sentences import ends
from .tokens import Encoder, worker_encoder

# after white space or a hyphen, and around every letter of a script without spaces
_WORD_END = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}][-‐–—/])(?=\S)|(?<=[\p{Han}\p{Hiragana}\p{Katakana}，。、！？；：」』）])(?=\S)")
_JOINED = regex.compile(r"[\p{M}\p{Cf}\N{ZERO WIDTH JOINER}]")


def cut_points(size: np.ndarray, sentence: list[int], word: list[int], limit: int, overlap: int, text: str | None = None) -> list[tuple[int, int]]:
    """(start, end) unit ranges of the pieces, each of size at most ``limit``.

    ``size`` holds the prefix sums of unit sizes (``size[0] == 0``);
    ``sentence`` and ``word`` are sorted unit numbers to cut before.  A piece
    begins where the last ``overlap`` of the one before begins.  A sentence
    boundary counts if it fills half the limit, then a word boundary, then any
    boundary that moves on; else the cut is hard, kept off the middle of a
    character with marks where ``text`` tells.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be under the limit")
    n, pieces, start = len(size) - 1, [], 0
    while True:
        base = int(size[start])
        top = int(np.searchsorted(size, base + limit, side="right")) - 1
        if top >= n:
            pieces.append((start, n))
            return pieces
        top = max(top, start + 1)  # a single unit over the limit stands alone
        moved = int(np.searchsorted(size, base + overlap, side="right"))
        moved = min(max(moved, start + 1), top)
        half = int(np.searchsorted(size, base + limit // 2, side="left"))

        def last(cuts: list[int], low: int, top: int = top) -> int | None:
            i = bisect_right(cuts, top)
            return cuts[i - 1] if i and cuts[i - 1] >= low else None

        low = max(half, moved)
        end = last(sentence, low) or last(word, low) or last(sentence, moved) or last(word, moved)
        if end is None:
            end = top
            if text is not None:
                while end > moved and _JOINED.match(text[end]):
                    end -= 1
                end = top if end == moved and _JOINED.match(text[end]) else end
        pieces.append((start, end))
        back = int(np.searchsorted(size, int(size[end]) - overlap, side="left"))
        start = min(max(back, start + 1), end)


def token_offsets(text: str, encoder: Encoder) -> np.ndarray:
    """Prefix sums of token sizes at the characters: how many tokens end at or before each."""
    encoded = text.encode("utf-8")
    ends_at = np.cumsum([encoder.vocabulary.size[t] for t in encoder.encode(text)], dtype=np.int64)
    first = np.flatnonzero((np.frombuffer(encoded, np.uint8) & 0xC0) != 0x80)  # bytes that begin a character
    return np.searchsorted(ends_at, np.append(first, len(encoded)), side="right")


def split(text: str, limit: int, overlap: int, lang: str | None = None, encoder: Encoder | None = None) -> list[tuple[int, int]]:
    """(start, end) character ranges of the pieces of ``text``, whose size is that in characters, or in tokens of ``encoder``."""
    if len(text) <= limit and encoder is None:
        return [(0, len(text))]
    size = np.arange(len(text) + 1) if encoder is None else token_offsets(text, encoder)
    if size[-1] <= limit:
        return [(0, len(text))]
    sentence = ends(text, lang)
    word = [m.start() for m in _WORD_END.finditer(text)]
    del word[:bisect_left(word, 1)]
    return cut_points(size, sentence, word, limit, overlap, text)


PIECES = ArrayType(StructType([StructField(n, IntegerType()) for n in ("no", "n", "s", "e")]))


def _exploded(source: DataFrame, keys: list[str], pieces: Column) -> DataFrame:
    """The splitter is asked for once, below the explode."""
    rows = source.select(*keys, "_text", F.explode(pieces).alias("_p"))
    return rows.select(*keys, F.col("_p.no").alias("piece_no"), F.col("_p.n").alias("n_pieces"), F.col("_p.s").alias("start_char"), F.col("_p.e").alias("end_char"),
                       F.substring("_text", F.col("_p.s") + 1, F.col("_p.e") - F.col("_p.s")).alias("piece"))


def _numbered(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"no": i, "n": len(ranges), "s": s, "e": e} for i, (s, e) in enumerate(ranges)]


def _source(df: DataFrame, keys: list[str], text: str, lang: str | None) -> DataFrame:
    lang_col = F.lower(F.trim(F.col(lang))) if lang else F.lit(None).cast("string")
    return df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), lang_col.alias("_lang"))


def split_items(df: DataFrame, keys: list[str], text: str, limit: int = 600, overlap: int = 60, lang: str | None = None) -> DataFrame:
    """One row per piece: keys, ``piece_no`` from 0, ``n_pieces``, ``start_char``, ``end_char``, ``piece``.

    Characters are code points.  A text of at most ``limit`` is one piece, and
    never leaves the JVM; an empty text is one empty piece; a null one gives no
    rows.  Repeated rows are split alike.
    """
    @F.pandas_udf(PIECES)
    def ranges(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _numbered(split(t, limit, overlap, g)) for t, g in zip(texts, langs, strict=True)], dtype=object)

    long = F.length("_text") > limit
    whole = F.array(F.struct(F.lit(0).alias("no"), F.lit(1).alias("n"), F.lit(0).alias("s"), F.length("_text").alias("e")))
    pieces = F.when(long, ranges(F.when(long, F.col("_text")), F.when(long, F.col("_lang")))).otherwise(whole)
    return _exploded(_source(df, keys, text, lang), keys, pieces)


def split_items_by_tokens(df: DataFrame, keys: list[str], text: str, limit: int = 256, overlap: int = 32, lang: str | None = None,
                          path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of :func:`split_items` for limits in tokens of a public tokenizer.

    Sizes are those of the whole text's encoding: its token offsets, of which a
    piece holds at most ``limit`` (a single character of more stands alone) and
    takes up at most the last ``overlap`` of the one before, less only where a
    character of several tokens would pass it.  The same rules for null, empty
    and repeated texts.
    """
    load = worker_encoder(df.sparkSession, path, pattern)

    @F.pandas_udf(PIECES)
    def ranges(texts: pd.Series, langs: pd.Series) -> pd.Series:
        encoder = load()
        return pd.Series([None if t is None else _numbered(split(t, limit, overlap, g, encoder)) for t, g in zip(texts, langs, strict=True)], dtype=object)

    return _exploded(_source(df, keys, text, lang), keys, ranges("_text", "_lang"))
