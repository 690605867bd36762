"""One consistent form for texts that look the same (a confusables skeleton).

Decompose, replace every character by the prototype of its look, decompose
again.  Texts of equal skeleton look the same.

Folded: canonical and letter compatibility forms (full and half width, fonts,
ligatures, presentation forms, radicals), marks of their own, characters
without width, spaces of any kind, hyphens, and letters of other scripts that
look alike.  Kept apart: case, accents, raised, lowered and circled characters,
other punctuation, line breaks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shared import materialise

# Prototypes and the letters of other scripts that look like them.
LOOKS_LIKE = {
    # small
    "a": "аαɑ", "b": "ЬᏏ", "c": "сϲᴄⲥ", "d": "ԁᏧ", "e": "еҽ", "f": "ſ", "g": "ɡց", "h": "һհᏂ", "i": "іιıɩᎥ", "j": "јϳ", "l": "ӏǀ",
    "n": "ոռ", "o": "оοօᴏσⲟ०", "p": "рρⲣ", "q": "ԛգզ", "r": "г", "s": "ѕꜱ", "u": "υսʋᴜ", "v": "νѵᴠ", "w": "ԝᴡѡ", "x": "хχ", "y": "уүγʏᎩ", "z": "ᴢ",
    "ĸ": "кκ", "ᴛ": "тτ", "ᴍ": "м", "ʜ": "н", "ʙ": "вⲃ",
    # capital
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀᏳꓖ", "H": "НΗᎻꓧⲎ", "I": "ІӀΙꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ",
    "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏕᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ",
    "W": "ԜᎳᏔꓪ", "X": "ХΧꓫⲬ", "Y": "УΥҮᎽꓬⲨ", "Z": "ΖᏃꓜ",
    # marks and figures
    "3": "ЗӠ", ":": "∶꞉",
}
LOOK_ALIKE = {c: prototype for prototype, others in LOOKS_LIKE.items() for c in others}
# Hyphens.
HYPHENS = "‐‑‒⁃˗−﹣"
# Compatibility forms that are visibly another character.
VISIBLE_FORMS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
# Characters without width beside the format characters (category Cf).
NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
# Format characters that are drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2}


class Look(dict):
    """Character code -> what it is replaced by: nothing, or the prototypes of the characters it is made of.

    ``table`` (a character to its prototype) comes before the built-in one.
    """

    def __init__(self, table: dict[str, str] | None = None) -> None:
        self.table = {**LOOK_ALIKE, **(table or {})}

    def __missing__(self, code: int) -> str:
        self[code] = shown = self._prototype(chr(code))
        return shown

    def _prototype(self, ch: str) -> str:
        code, cat = ord(ch), unicodedata.category(ch)
        if (cat == "Cf" and code not in DRAWN_FORMAT) or code in NO_WIDTH or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            return ""
        if cat == "Zs" or ch == "\t":
            return " "
        if ch in HYPHENS:
            return "-"
        if ch in self.table:
            return self.table[ch]
        form = unicodedata.decomposition(ch)
        if form.startswith("<"):
            tag, *codes = form.split()
            parts = "".join(chr(int(c, 16)) for c in codes)
            letter = cat[0] in "LMN" or tag in ("<wide>", "<narrow>", "<font>") or (tag == "<compat>" and unicodedata.category(parts[0])[0] == "L")
            if tag in VISIBLE_FORMS or not letter:
                return ch
            return "".join(self[ord(c)] for c in parts)
        full = unicodedata.normalize("NFD", ch)
        return "".join(self[ord(c)] for c in full) if full != ch else ch


BUILT_IN = Look()


def read_prototypes(path: str) -> dict[str, str]:
    """The look-alike table in a file of the public form ``source ; prototype ; class # note``, code points in hexadecimal.

    Only single characters outside ASCII are taken.  Prototypes that would join
    what stays apart here are mended or left out: a capital whose prototype is
    the small l is a capital I, and a character of another general kind than its
    prototype (letter, figure, mark) or of another case keeps its own look.
    """
    table: dict[str, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = [x.split() for x in line.split("#", 1)[0].split(";")]
            if len(fields) < 2 or len(fields[0]) != 1:
                continue
            ch, prototype = chr(int(fields[0][0], 16)), "".join(chr(int(x, 16)) for x in fields[1])
            if prototype == "l" and ch.isupper():
                prototype = "I"
            same_kind = all(unicodedata.category(ch)[0] == unicodedata.category(p)[0] for p in prototype if unicodedata.category(p)[0] != "M")
            same_case = not (ch.isupper() and prototype.islower()) and not (ch.islower() and prototype.isupper())
            if not ch.isascii() and unicodedata.category(ch)[0] != "M" and same_kind and same_case:
                table[ch] = prototype
    return table


def skeleton(text: str | None, look: Look = BUILT_IN) -> str | None:
    """The consistent form of ``text``; null stays null, empty stays empty."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ").replace("\r\n", "\n")
    return unicodedata.normalize("NFD", text.translate(look)).replace("\r\n", "\n")


class _Kept(dict):
    """Character code -> the one character that :func:`folded` shows for it, None for none."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        one = c if c < "\x80" or (c not in HYPHENS and unicodedata.category(c)[0] in "PS") else BUILT_IN[code]
        other_kind = len(one) != 1 or (one not in " -" and unicodedata.category(one)[0] != unicodedata.category(c)[0]) or (c.isupper() and one.islower())
        self[code] = None if not one else c if other_kind else one
        return self[code]


_KEPT = _Kept()


def folded(text: str) -> tuple[str, Sequence[int]]:
    """``text`` in the consistent form, one character per kept one, and where each stood.

    For readers of positions: unlike :func:`skeleton` it never grows, so a
    character that folds into several or into one of another kind or case is
    kept as it is; so is punctuation.
    """
    if text.isascii():
        return text, range(len(text))
    shown = text.translate(_KEPT)
    if len(shown) == len(text):
        return shown, range(len(text))
    return shown, [i for i, c in enumerate(text) if _KEPT[ord(c)] is not None]


def _folding(table: dict[str, str] | None) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def fold(texts: pd.Series) -> pd.Series:
        look = Look(table) if table else BUILT_IN
        return texts.map(lambda t: skeleton(t, look))
    return fold


def skeleton_of(text: Column, table: dict[str, str] | None = None) -> Column:
    """Skeleton of a column.  Plain ASCII stays in the JVM; only other texts go to Python."""
    plain = text.rlike(r"\A[\x00-\x08\x0A-\x0C\x0E-\x7F]*\z")
    return F.when(plain, text).otherwise(_folding(table)(F.when(~plain, text)))


def with_skeleton(df: DataFrame, text: str, out: str = "skeleton", table: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the consistent form of ``text``; every row and column is kept."""
    return df.withColumn(out, skeleton_of(F.col(text), table))


def _looks(texts: DataFrame, table: dict[str, str] | None, id_out: str, text_out: str) -> DataFrame:
    """Texts that are not blank with their skeleton, which is never null: a join on it needs no second look."""
    shown = texts.where(F.col("text").rlike(r"\S"))
    return shown.select(F.col("id").alias(id_out), F.col("text").alias(text_out), F.coalesce(skeleton_of(F.col("text"), table), F.lit("")).alias("skeleton"))


def look_alikes(terms: DataFrame, texts: DataFrame, max_terms: int = 100_000, table: dict[str, str] | None = None) -> DataFrame:
    """(id_a, id_b) of terms and texts of equal skeleton that are not equal as written.

    Both frames have ``id`` and ``text``.  The terms are broadcast when they
    are at most ``max_terms`` (counted first), joined by shuffle beyond that.
    Null and blank texts pair with nothing; repeated rows give their own pairs.
    """
    a, b = _looks(terms, table, "id_a", "text_a"), _looks(texts, table, "id_b", "text_b")
    few = terms.limit(max_terms + 1).count() <= max_terms
    pairs = b.join(F.broadcast(a) if few else a, "skeleton")
    return pairs.where("text_a <> text_b").select("id_a", "id_b")


def look_alike_pairs(texts: DataFrame, table: dict[str, str] | None = None, cells: int = 256) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of texts of equal skeleton that are not equal as written.

    A skeleton's texts are classed by spelling and a class is cut into up to
    ``cells`` cells by id.  Skeletons written in one way only end there, however
    many copies they have.  The spellings of the others are paired, then their
    cells, and only then do ids meet, cell by cell: the work is that of the rows
    that come out, and no key holds more than a cell's share of it.  Null and
    blank texts pair with nothing.
    """
    mark = lambda c: F.unhex(F.md5(c))
    shown = texts.where(F.col("text").rlike(r"\S")).select("id", "text")
    looks = shown.select("id", mark(F.col("text")).alias("spelling"), mark(F.coalesce(skeleton_of(F.col("text"), table), F.lit(""))).alias("look"))
    rows = materialise(looks.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")), "spellings")
    each = rows.groupBy("look", "spelling", "cell").agg(F.count("*").alias("n"))
    varied = each.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("look")
    each = materialise(each.join(varied, "look", "left_semi").select("look", "spelling", "cell"), "spelling-cells")
    side = lambda df, s: df.select("look", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "look"])
    classes = each.select("look", "spelling").distinct()
    met = side(classes, "a").join(side(classes, "b"), "look").where("spelling_a < spelling_b")
    met = met.join(side(each, "a"), ["look", "spelling_a"]).join(side(each, "b"), ["look", "spelling_b"])
    met = materialise(met.withColumn("block", mark(F.concat("look", "spelling_a", "spelling_b", F.hex("cell_a"), F.lit("/"), F.hex("cell_b")))), "spelling-blocks")
    a = met.join(side(rows, "a"), ["look", "spelling_a", "cell_a"]).select("block", "id_a")
    b = met.join(side(rows, "b"), ["look", "spelling_b", "cell_b"]).select("block", "id_b")
    return a.join(b, "block").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
