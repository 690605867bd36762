"""Sentence boundaries across languages and scripts.

Cascading rule tables: every candidate position (after a final mark with its
closing marks, at white space beside Thai) is decided by the first rule, in
order, whose regular expressions match before and after it.  A document's own
language comes first, then the shared rules, then the other languages', since
texts mix languages.  Line breaks and the end of the text always end a
sentence; inside balanced quotation marks and brackets of one line nothing does.

The rules of a cascade are compiled into one expression that is matched at the
candidate, looking back and ahead as far as the line goes.

Rules see the text in the consistent form of :mod:`.unify` (without characters
of no width, look-alike letters folded), so disguised abbreviations are
abbreviations still; positions are those of the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unify import folded, skeleton

PLAIN, LED, HELD = "plain", "led", "held"  # no quotation closes here; one that opened the sentence; one further inside
QUOTED = (LED, HELD)


class Rule(NamedTuple):
    breaks: bool
    before: str  # in front of the closing marks
    after: str
    at: tuple[str, ...] = (PLAIN,)


# Abbreviations that never end a sentence, by language.
ABBREVIATIONS = {
    "en": "Dr Prof Mr Mrs Ms Mx St Sgt Capt Lt Col Gen Gov Rev Hon vs approx i.e e.g cf viz fig figs Fig Figs vol Vol eq Eq eds pp",
    "de": "Dr Prof Hr Fr Abb Abs Tab Nr Bd Kap ca bzw vgl Vgl sog evtl ggf inkl exkl d h z B u a o i v zzgl Str St geb gest",
    "fr": "M MM Mme Mlle Mgr Dr Pr fig Fig env p pp cf vol chap éd tél",
    "es": "Sr Sra Srta Sres Dr Dra D Dña Prof fig Fig aprox p pág págs ej núm vol cap art Ud Uds ca",
    "ru": "Проф проф Др др См см рис Рис табл стр гл т е г гг в им ул д-р акад доц руб тыс млн млрд напр ср",
    "hi": "डॉ श्री सुश्री प्रो पं स्व कु",
    "ar": "د أ م ص ج ق هـ",
    "vi": "TS ThS PGS GS BS KS TP Tp v.d VD tr Q P Th",
    "th": "ดร ศ รศ ผศ นพ พญ พ.ศ ค.ศ น ม ร ต จ อ ถ",
    "ko": "Dr Prof Mr Ms",
}
# Abbreviations of several parts, with or without the space.
SEVERAL_PARTS = ["p. ex", "p. ej", "d. h", "z. B", "u. a", "i. e", "e. g", "т. е"]
# Abbreviations that stand before a number.
BEFORE_NUMBER = "no No nos Nos Nr nr n nº № p pp S s Abb fig Fig Tab vol Vol ch Ch sec Sec art Art núm Núm pág рис Рис стр гл табл hình Hình Bd Kap"
# Months and other words that follow a German ordinal.
AFTER_ORDINAL = ("Januar Februar März April Mai Juni Juli August September Oktober November Dezember "
                 "Jan Feb Mär Apr Jun Jul Aug Sep Okt Nov Dez Jahrhundert Mal Platz Kapitel Klasse Stock Teil")


def _shown(words: list[str], capitals: bool) -> frozenset[str]:
    """A rule's words as a text shows them, with accents in their letters or as marks of their own.

    Capitals are folded apart: not all of them are the capitals of the folded small letters.
    """
    written = [*words, *(w.upper() for w in words)] if capitals else words
    return frozenset(form for w in written for form in (folded(w)[0], skeleton(w)))


_SPLIT = {**{lang: words.split() for lang, words in ABBREVIATIONS.items()}, "number": BEFORE_NUMBER.split(), "ordinal": AFTER_ORDINAL.split(),
          "parts": [form for x in SEVERAL_PARTS for form in (x, x.replace(" ", ""))]}
WORDS = {capitals: {k: _shown(words, capitals) for k, words in _SPLIT.items()} for capitals in (False, True)}

WORD_START = r"(?<![\p{L}\p{M}\p{N}])"
GAP = r"[^\S\n]"  # white space within a line
LANGUAGE_RULES = {lang: [Rule(False, rf"{WORD_START}\L<{lang}>\.", rf"{GAP}+\S")] for lang in ABBREVIATIONS}
LANGUAGE_RULES["de"].append(Rule(False, rf"{WORD_START}\d{{1,2}}\.", rf"{GAP}+\L<ordinal>\b"))
LANGUAGE_RULES["ar"].append(Rule(False, rf"{WORD_START}\p{{Arabic}}\.", rf"{GAP}+\S"))
LANGUAGE_RULES["hi"].append(Rule(False, rf"{WORD_START}\p{{Devanagari}}\p{{M}}?\.", rf"{GAP}+\S"))
LANGUAGE_RULES["ja"] = [Rule(False, "", r"(?:と|って|という|が|を|は|も|の|に|で|へ|や|な)", QUOTED)]
LANGUAGE_RULES["ko"].append(Rule(False, "", r"\p{Hangul}", QUOTED))
LANGUAGE_RULES["th"] += [Rule(False, r"[,،、，:;]", rf"{GAP}+\S"), Rule(False, r"\S", rf"{GAP}+[ๆฯ]", (PLAIN, *QUOTED))]

QUOTATION_RULES = [
    Rule(False, "", rf"{GAP}*[,،、，;:：—–-]", QUOTED),  # the words that tell who says it follow
    Rule(False, "", rf"{GAP}*\p{{Ll}}", QUOTED),
    Rule(False, "", rf"{GAP}*\p{{Lo}}", (LED,)),  # in a script without case
]
SHARED_RULES = [
    Rule(False, r"[.!?…。！？｡।॥؟۔]", r"[.!?…。！？｡।॥؟۔,;:،؛、，；：]"),  # the run of marks goes on
    Rule(False, r"(?:\.\.|…)", rf"{GAP}*[\p{{Ll}}\p{{N}},;:،、，；：]"),  # a pause
    Rule(False, r"…", r"\p{Lo}"),
    Rule(False, rf"(?:{WORD_START}|[’'.])\p{{Lu}}\.", rf"{GAP}+\S"),  # an initial
    Rule(False, rf"{WORD_START}\L<parts>\.", rf"{GAP}+\S"),
    Rule(False, rf"{WORD_START}\L<number>\.", rf"{GAP}*\p{{N}}"),
    Rule(False, rf"(?:\A|\n){GAP}*\p{{N}}{{1,3}}\.", rf"{GAP}+\S"),  # the number of a list's item
    Rule(False, r"\.", r"[\p{Ll}\p{Lu}\p{N}_/\\@#%&*+=~$€£-]"),  # decimals, versions, codes, file names
    Rule(False, r"\.", rf"{GAP}+\p{{Ll}}"),  # an abbreviation that no table knows
]
CAPITAL_RULES = [  # in a sentence written in capitals, where case tells nothing
    Rule(False, "", rf"{GAP}*\p{{Lu}}", (LED,)),
    Rule(False, r"(?:\A|\s)(?:\.\.\.|…)", rf"{GAP}+\S"),
    Rule(False, rf"{WORD_START}[AP]\.{GAP}?M\.", rf"{GAP}+\S"),
]
LAST_RULES = [
    Rule(True, r"[。！？｡।॥؟۔]", "", (PLAIN, *QUOTED)),
    Rule(True, r"[.!?…]", rf"(?:{GAP}|[¿¡«“„「『\"(（])", (PLAIN, *QUOTED)),
    Rule(True, r"\p{Thai}\S*", rf"{GAP}+\S", (PLAIN, *QUOTED)),  # white space beside a Thai word
    Rule(True, r"\S", rf"{GAP}+\S*\p{{Thai}}", (PLAIN, *QUOTED)),
]
LATE = ("ja", "ko", "th")  # rules that touch only the letters of their own script come after all others


def _rules(lang: str, capitals: bool, state: str) -> list[Rule]:
    others = [r for k in sorted(LANGUAGE_RULES, key=lambda k: k in LATE) if k != lang for r in LANGUAGE_RULES[k]]
    rules = [*(CAPITAL_RULES if capitals else []), *LANGUAGE_RULES.get(lang, []), *QUOTATION_RULES, *SHARED_RULES, *others, *LAST_RULES]
    return [r for r in rules if state in r.at]


def _side(expression: str, capitals: bool) -> str:
    cased = r"\p{Ll}" in expression or r"\p{Lu}" in expression
    return f"(?i:{expression})" if capitals and not cased else f"(?:{expression})"


@lru_cache(maxsize=64)
def _cascade(lang: str, capitals: bool, full_stop: bool) -> tuple[regex.Pattern, list[bool]]:
    """The rules without a quotation as one expression; its last group tells the first rule that matches, and so the decision."""
    rules = [r for r in _rules(lang, capitals, PLAIN) if full_stop or not r.before.endswith(r"\.")]
    parts = [rf"(?={_side(r.after, capitals)})(?<={_side(r.before, capitals)})()" for r in rules]
    text = "|".join(parts)
    return regex.compile(text, **{k: v for k, v in WORDS[capitals].items() if rf"\L<{k}>" in text}), [r.breaks for r in rules]


@lru_cache(maxsize=64)
def _quoted_cascade(lang: str, capitals: bool, state: str) -> list[tuple[bool, regex.Pattern, regex.Pattern]]:
    """The rules where a quotation closes: closing marks stand between what is before and what is after."""
    return [(r.breaks, regex.compile(rf"(?<={_side(r.before, capitals)})"), regex.compile(_side(r.after, capitals))) for r in _rules(lang, capitals, state)]


# Closing marks and what each may close.
CLOSES = {"”": "“„", "“": "„", "»": "«", "«": "»", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "】": "【", "》": "《", "〉": "〈", '"': '"'}
OPENS = set("“„«»「『(（[【《〈\"")
_PAIRED = regex.compile(r"[“”„«»「」『』()（）\[\]【】《》〈〉\"\n]")
_MARKS = regex.compile(r"[.!?…。！？｡।॥؟۔]+")
_BREAK = regex.compile("[\n\r\v\f\x85  ]")
_THAI = regex.compile(r"\p{Thai}")
_THAI_GAP = regex.compile(r"(?<=\S)[^\S\n]+(?=\S)")
_SPACES = regex.compile(r"[^\S\n]*+")
_INK = regex.compile(r"\S")
_LINE_ENDS = regex.compile(r"[^\S\n]*+(?:\n|\Z)")
_LOWER, _UPPER = regex.compile(r"\p{Lowercase}"), regex.compile(r"\p{Uppercase}")
_SAID = regex.compile(r"(?<=\w\w)[.!?]|\n")


class _Next:
    """First match of an expression from a position on; asked for rising positions, it reads the text once."""

    def __init__(self, expression: regex.Pattern, text: str) -> None:
        self.search, self.text, self.at = expression.search, text, -1

    def __call__(self, start: int) -> int:
        if self.at < start:
            m = self.search(self.text, start)
            self.at = m.start() if m else len(self.text)
        return self.at


def _spans(text: str) -> dict[int, int]:
    """Closing position -> opening position of the quotations and brackets that are balanced on one line."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened = dict.fromkeys(OPENS, 0)  # how many of each stand on the stack
    for m in _PAIRED.finditer(text):
        c, i = m.group(), m.start()
        if c == "\n":
            stack.clear()
            opened = dict.fromkeys(OPENS, 0)
            continue
        closes = CLOSES.get(c, "")
        if any(opened[o] for o in closes):
            while True:
                top, at = stack.pop()
                opened[top] -= 1
                if top in closes:
                    break
            pairs[i] = at
        elif c in OPENS:
            stack.append((c, i))
            opened[c] += 1
    return pairs


def _outermost(pairs: dict[int, int]) -> list[tuple[int, int]]:
    """The spans that stand in no other, in order."""
    outer: list[tuple[int, int]] = []
    for o, c in sorted((o, c) for c, o in pairs.items()):
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def _candidates(shown: str, pairs: dict[int, int]) -> list[tuple[int, int, int | None]]:
    """(position, end of the mark, opening of a quotation that closes between the two, -1 at a line break), in order."""
    found: list[tuple[int, int, int | None]] = []
    for m in _MARKS.finditer(shown):
        e, opened = m.end(), None
        while pairs:
            n = _SPACES.match(shown, e).end()
            if pairs.get(n, len(shown)) >= m.start():
                break
            e, opened = n + 1, pairs[n]
        found.append((e, m.end(), opened))
    if _THAI.search(shown):
        found += [(m.start(), m.start(), None) for m in _THAI_GAP.finditer(shown)]
    found += [(m.start(), m.start(), -1) for m in regex.finditer("\n", shown)]
    found.sort(key=lambda f: f[0])
    return found


def _cuts(shown: str, lang: str) -> list[int]:
    """Positions in ``shown`` after which a sentence ends, that of the text left out."""
    pairs = _spans(shown)
    outer = _outermost(pairs)
    lower, lower_after, said = _Next(_LOWER, shown), _Next(_LOWER, shown), _Next(_SAID, shown)
    ink = _Next(_INK, shown)
    cuts: list[int] = []
    span, sentence = 0, ink(0)
    for e, mark, opened in _candidates(shown, pairs):
        if opened != -1:
            while span < len(outer) and outer[span][1] < e - 1:
                span += 1
            if span < len(outer) and outer[span][0] < e - 1 < outer[span][1]:
                continue
            if not _LINE_ENDS.match(shown, e):
                capitals = False  # the sentence so far and what follows are written in capitals
                if lower(sentence) >= e and _UPPER.search(shown, sentence, e) and lower_after(e) >= (near := said(e)):
                    first = _UPPER.search(shown, e, near)
                    capitals = bool(first and _UPPER.search(shown, first.end(), near))
                if opened is None:
                    cascade, breaks = _cascade(lang, capitals, shown[e - 1] == ".")
                    m = cascade.match(shown, e)
                    if not m or not breaks[m.lastindex - 1]:
                        continue
                else:
                    rules = _quoted_cascade(lang, capitals, LED if opened <= sentence else HELD)
                    if not next((b for b, p, q in rules if q.match(shown, e) and p.match(shown, mark)), False):
                        continue
        if not cuts or e > cuts[-1]:
            cuts.append(e)
            sentence = ink(e)
    return cuts


def ends(text: str, lang: str | None = None) -> list[int]:
    """End of each sentence as characters from the start, white space after it left out.

    A blank text has none.
    """
    shown, at = folded(_BREAK.sub("\n", text))
    lang = (lang or "").strip().lower()[:2]
    out: list[int] = []
    last = 0
    for cut in [*(at[c] if c < len(at) else len(text) for c in _cuts(shown, lang if lang in LANGUAGE_RULES else "")), len(text)]:
        piece = text[last:cut].rstrip()
        if not piece or piece.isspace():
            continue
        if any(not ch.isspace() and (ch.isascii() or folded(ch)[0]) for ch in piece):
            out.append(last + len(piece))
        last = cut
    return out


def sentence_ends(df: DataFrame, keys: list[str], text: str, lang: str | None = None) -> DataFrame:
    """One row per sentence: keys, ``sentence_no`` from 0, ``start_char``, ``end_char``.

    Null and blank texts give no rows, repeated rows give repeated sentences,
    a text without any final mark is one sentence.  A null or unknown language
    uses the shared rules.  Texts of any length are taken whole.
    """
    source = df.select(*keys, F.col(text).cast("string").alias("_text"), (F.lower(F.trim(lang)) if lang else F.lit(None).cast("string")).alias("_lang"))
    source = source.where(F.col("_text").rlike(r"\S"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    names = [*keys, "sentence_no", "start_char", "end_char"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, number, start, end = [], [], [], []
            for n, (t, lang_) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                last = 0
                for i, e in enumerate(ends(t, lang_)):
                    s = last + len(t[last:e]) - len(t[last:e].lstrip())
                    where.append(n), number.append(i), start.append(s), end.append(e)
                    last = e
            picked = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(picked) for i in range(len(keys))),
                                              *(pa.array(x, pa.int32()) for x in (number, start, end))], names)

    return source.mapInArrow(cut, f"{ddl}, sentence_no int, start_char int, end_char int")
