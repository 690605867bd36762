"""Text and time-code expressions.  All stay in the JVM but :func:`gestalt_ratio`."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values.
SENTENCE = "[^。？！!?]+[。？！!?]?"
SENTENCE_END = "。！？!?；;…"
PUNCTUATION_ONLY = r"[\s，。！？；：、,.!?;:\"'“”‘’（）()《》【】\[\]—…·~]+"
BLANK = r"\A[\s\p{Z}\x1C-\x1F\x85]*\z"
KNOWLEDGE_BY_TASK = {"C": "technical", "MECHANISM": "technical", "B": "educational", "CONCEPT": "educational", "A": "opinion", "CORRECTION": "opinion"}
KNOWLEDGE_WORDS = [
    ("story", ["故事", "人物", "经历", "历史", "传说", "案例"]),
    ("technical", ["算法", "代码", "技术", "架构", "系统", "原理", "机制", "模型"]),
    ("opinion", ["应该", "必须", "观点", "认为", "批判", "反思"]),
]


def is_blank(s: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(s.rlike(BLANK), F.lit(True))


def nonempty(s: Column) -> Column:
    return ~is_blank(s)


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty; blanks count as given."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def normalize(s: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")


def strip_punctuation(s: Column) -> Column:
    """Without white space and common punctuation; symbols such as ``_``, ``-`` and ``%`` stay."""
    return F.regexp_replace(s, PUNCTUATION_ONLY, "")


def split_sentences(s: Column) -> Column:
    """Array of the runs that end at a full stop, question or exclamation mark; blank ones dropped."""
    return F.filter(F.regexp_extract_all(s, F.lit(SENTENCE), F.lit(0)), nonempty)


def is_sentence_end(s: Column) -> Column:
    """Whether the last character, white space aside, ends a sentence."""
    bare = F.regexp_replace(s, r"[\s\p{Z}]+\z", "")
    return F.coalesce(bare.rlike(f"[{SENTENCE_END}]\\z"), F.lit(False))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, by code points; both empty 1, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


@F.pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two texts; nulls count as empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def srt_to_ms(s: Column) -> Column:
    """``HH:MM:SS,mmm`` (or a point) to milliseconds; null if it is no time code."""
    part = lambda i: F.regexp_extract(s, r"\A\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*\z", i).try_cast("bigint")
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def _parts(ms: Column, unit: int, size: int) -> Column:
    return F.floor(ms / unit).cast("bigint") % size if size else F.floor(ms / unit).cast("bigint")


def ms_to_srt(ms: Column) -> Column:
    """Milliseconds to ``HH:MM:SS,mmm``, 0 at least."""
    t = F.greatest(ms.cast("bigint"), F.lit(0))
    return F.format_string("%02d:%02d:%02d,%03d", _parts(t, 3_600_000, 0), _parts(t, 60_000, 60), _parts(t, 1000, 60), t % 1000)


def half_even(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(x.cast("double"), 0).cast("bigint")


def ms_to_ass(ms: Column) -> Column:
    """Milliseconds to ``h:mm:ss.cc``, hundredths rounded half to even."""
    cs = half_even(F.greatest(ms, F.lit(0)) / 10)
    return F.format_string("%d:%02d:%02d.%02d", _parts(cs, 360_000, 0), _parts(cs, 6000, 60), _parts(cs, 100, 60), cs % 100)


def ticks_to_ms(ticks: Column) -> Column:
    """Units of 100 ns to whole milliseconds."""
    return F.floor(ticks / 10_000).cast("bigint")


def strip_markup(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]+>", "")


def newline_to_ass(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("\\N"))


def task_tokens(s: Column) -> Column:
    """Tokens separated by plus signs and white space."""
    return F.filter(F.split(F.replace(F.coalesce(s, F.lit("")), F.lit("+"), F.lit(" ")), r"\s+"), lambda t: t != "")


def knowledge_type(task_type: Column, narration: Column) -> Column:
    """Class of a script: by its task type, else by the first word list of which a word stands in the narration."""
    upper = F.upper(task_type)
    case = F.when(F.lit(False), F.lit(""))
    for task, kind in KNOWLEDGE_BY_TASK.items():
        case = case.when(upper == task, kind)
    for kind, words in KNOWLEDGE_WORDS:
        case = case.when(F.coalesce(narration, F.lit("")).rlike("|".join(words)), kind)
    return case.otherwise("educational")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{{NAME}}`` replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def utc_minutes(ts: Column) -> Column:
    """ISO 8601 to the minute with an offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mmxxx")


def canonical_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def labelled_list(label: Column, values: Column) -> Column:
    """``label: a, b``, underscores of the label as spaces; null if there are no values."""
    return F.when(F.size(values) > 0, F.concat(F.replace(label, F.lit("_"), F.lit(" ")), F.lit(": "), F.array_join(values, ", ")))
