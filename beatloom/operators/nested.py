"""Deeply nested JSON records as related flat tables.

1. :func:`shred` parses every document once and walks it down each of its
   lists, into one row per document: the entries of every list, with their
   ordinals, and the paths at which it has objects.  Lists show as ``[]`` in a
   path; ``%``, ``.`` and ``[`` within a name are written as percent codes.
2. :func:`levels_of` merges what the documents show: the paths that are lists.
3. :func:`related` explodes the entries of all levels into rows with the
   document's key, the parent's surrogate key and the ordinals.  Documents with
   an object where others have a list are walked again, now that this is known.
4. :func:`child_table` projects one level's rows to columns.

:func:`flatten` walks to levels named by the caller; :func:`merged_schema` has
the statistics of every path.

Documents are parsed in Arrow batches by the standard JSON parser: positions
must follow the written order of object members and distinguish text from
JSON, both of which the JVM's map and variant types give up.

Irregular shapes: a non-empty object in place of a list is the list of its
values if they all are objects, else a list of itself alone; text that holds
JSON stands for what it holds.  Entries that are not objects keep their
ordinal; they are rows with their ``type``, so that lists of values and lists of
lists are related tables too.  A null or malformed document, or one nested
deeper than the parser goes, gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise

ROOT = ""  # the level of the document itself
MAX_PATHS = 100_000  # a merged schema of more paths is refused: keys that are data need a level of their own
HELD = 50_000  # statistics that a task keeps before it passes them on
ENTRY = "struct<level:string,ordinals:array<int>,type:string,value:string>"


class Refs(NamedTuple):
    """Entries of a level that the record names by id, kept once beside the parent level."""

    member: str  # list of ids in the parent record
    pool: str  # member of the document that holds the named objects
    id: str = "id"


def _no_json(name: str) -> Any:
    raise ValueError(name)


def parse(text: str | None) -> Any:
    """The JSON value of ``text``; None if it is null or malformed (``NaN`` and ``Infinity`` are not JSON)."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_no_json)
    except (ValueError, RecursionError):
        return None


def unwrap(value: Any) -> Any:
    """What a text that holds a JSON list or object stands for."""
    while isinstance(value, str):
        inner = parse(value) if value.lstrip()[:1] in ("{", "[", '"') else None
        if inner is None:
            return value
        value = inner
    return value


def as_list(value: Any) -> list:
    """The entries of what stands in place of a list."""
    value = unwrap(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value:
        values = list(value.values())
        return values if all(isinstance(v, dict) for v in values) else [value]
    return []


def kind(value: Any) -> str:
    """Raw JSON type: null, boolean, integer, decimal, string, list or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "decimal", str: "string", list: "list", dict: "object"}[type(value)]


def _named(path: str, member: str) -> str:
    """The path of a member."""
    if "." in member or "[" in member or "%" in member or not member:
        member = member.replace("%", "%25").replace(".", "%2E").replace("[", "%5B") or "%"
    return f"{path}.{member}" if path else member


def _count(value: Any, path: str, seen: Counter) -> None:
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        inner = unwrap(v)
        seen[p, "text of " + kind(inner) if inner is not v else kind(v)] += 1
        if isinstance(inner, list):
            stack += [(x, p + "[]") for x in inner]
        elif isinstance(inner, dict):
            stack += [(x, _named(p, k)) for k, x in inner.items()]
            if inner and all(isinstance(x, dict) for x in inner.values()):
                stack += [(x, p + "[]") for x in inner.values()]


def _counted(seen: Counter) -> pa.RecordBatch:
    rows = list(seen.items())
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()),
         pa.array([n for _, n in rows], pa.int64())], ["path", "type", "n"])


def merged_schema(df: DataFrame, body: str) -> DataFrame:
    """(path, type, n): how often each JSON type stands at each path over all documents.

    An object whose values all are objects counts under its keys and as a list,
    since only the other documents tell which it is.  Null and malformed
    documents add nothing.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if (doc := parse(text)) is not None:
                    _count(doc, "", seen)
                if len(seen) > HELD:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    parts = df.select(F.col(body).cast("string")).mapInArrow(walk, "path string, type string, n bigint")
    return parts.groupBy("path", "type").agg(F.sum("n").alias("n"))


class Levels:
    """Which paths are lists, and which lead to one."""

    def __init__(self, levels: list[str]) -> None:
        self.wanted, self.lists, self.on_the_way = set(levels), set(), set()
        for level in levels:
            for i, c in enumerate(level):
                if c == "." or level.startswith("[]", i):
                    self.on_the_way.add(level[:i])
                if level.startswith("[]", i):
                    self.lists.add(level[:i])
        self.on_the_way |= self.wanted


class Walk:
    """The entries of a document's lists, those named by ``refs`` included.

    Without ``known`` levels every list is walked, and objects are objects; with
    them only the way to the levels is, and an object where a list belongs is a
    list.
    """

    def __init__(self, refs: dict[str, Refs], known: Levels | None) -> None:
        self.known, self.refs = known, {}
        for level, ref in refs.items():
            if known is None or level in known.on_the_way:
                parent, _, member = level[:-2].rpartition(".")
                self.refs.setdefault(parent, []).append((member, ref))

    def __call__(self, doc: Any) -> tuple[list, set, set]:
        """(entries as (level, ordinals, entry), paths of lists, paths of objects)."""
        known, out, lists, objects, pools = self.known, [], set(), set(), {}
        stack: list = [(doc, "", [])] if isinstance(doc, (dict, list)) else []
        if type(doc) is list:
            lists.add("")
        while stack:
            v, path, at = stack.pop()
            if type(v) is list:
                level = path + "[]"
                if known and level not in known.on_the_way:
                    continue
                for i, x in enumerate(v):
                    if x is _NOTHING:
                        continue
                    here = [*at, i]
                    out.append((level, here, x))
                    if type(x) is dict or type(x) is list:
                        stack.append((x, level, here))
                        if type(x) is list:
                            lists.add(level)
                continue
            for name, x in v.items():
                text = type(x) is str
                if text and x[:1] in _OPENING:
                    x = unwrap(x)
                if type(x) is not list and (type(x) is not dict or not x):
                    continue
                p = _named(path, name)
                if known and p not in known.on_the_way:
                    continue
                if type(x) is dict:
                    if known and p in known.lists:
                        x = as_list(x)
                    else:
                        objects.add(p)
                elif not text:
                    lists.add(p)
                stack.append((x, p, at))
            for member, ref in self.refs.get(path, ()):
                if member not in v and type(doc) is dict and ref.pool in doc:
                    if ref not in pools:
                        held = [x for x in as_list(doc[ref.pool]) if isinstance(x, dict) and isinstance(x.get(ref.id), str)]
                        pools[ref] = {x[ref.id]: x for x in reversed(held)}
                    named = [pools[ref].get(r, _NOTHING) if isinstance(r, str) else _NOTHING for r in as_list(v.get(ref.member))]
                    p = _named(path, member)
                    lists.add(p)
                    stack.append((named, p, at))
        return out, lists, objects


_NOTHING = object()  # keeps the place of a name without an entry
_OPENING = ("{", "[", '"', " ", "\n", "\t", "\r")  # how a text that holds JSON begins


def _value(x: Any) -> str | None:
    return None if x is None or type(x) is list else x if type(x) is str else json.dumps(x, ensure_ascii=False)


def _ddl_of(fields: list) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)


def shred(df: DataFrame, keys: list[str], body: str, refs: dict[str, Refs] | None = None, values: bool = True) -> DataFrame:
    """One row per document, written to the shared folder: keys, ``body``, ``entries``, ``lists``, ``objects``.

    ``entries`` are (level, ordinals, type, value) of every list, of objects
    alone and without values if ``values`` is false.  Null and malformed
    documents give no rows.
    """
    walk = Walk(refs or {}, None)
    source = df.select(*keys, F.col(body).cast("string").alias("_body"))
    strings = pa.list_(pa.string())
    entry = pa.struct([("level", pa.string()), ("ordinals", pa.list_(pa.int32())), ("type", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, offsets, rows, lists, objects = [], [0], [], [], []
            for n, text in enumerate(b.column(len(keys)).to_pylist()):
                doc = parse(text)
                if isinstance(doc, (dict, list)):
                    found, ls, os = walk(doc)
                    rows += found if values else [r for r in found if type(r[2]) is dict]
                    kept.append(n), offsets.append(len(rows)), lists.append(sorted(ls)), objects.append(sorted(os))
            parts = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                     pa.array([kind(r[2]) for r in rows], pa.string()), pa.array([_value(r[2]) if values else None for r in rows], pa.string())]
            entries = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(entry)))
            picked = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(picked) for c in b.columns), entries, pa.array(lists, strings), pa.array(objects, strings)],
                                             [*keys, "_body", "entries", "lists", "objects"])

    ddl = f"{_ddl_of(source.schema.fields)}entries array<{ENTRY}>, lists array<string>, objects array<string>"
    return materialise(source.mapInArrow(run, ddl), "shredded")


def levels_of(shredded: DataFrame, max_paths: int = MAX_PATHS) -> list[str]:
    """Paths of the list levels that the documents show, parents first.

    Only distinct paths reach the driver; more than ``max_paths`` is an error.
    """
    rows = shredded.select(F.explode("lists").alias("path")).distinct().limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise ValueError(f"more than {max_paths} paths of lists: are keys of the documents data?")
    lists = {r["path"] for r in rows}

    def under_key_of_level(p: str) -> bool:  # seen only where an object stands in place of the list
        return any(p[:i] in lists and not p[:i].endswith("[]") for i, c in enumerate(p) if c == ".")

    return sorted((p + "[]" for p in lists if not under_key_of_level(p)), key=lambda p: (p.count("[]"), p))


def _keyed(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    parts = F.split("level", r"\[\]\.?")
    path = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.element_at(parts, i), F.lit("["), F.element_at("ordinals", i).cast("string"), F.lit("]"))), ".")
    depth = F.size("ordinals")
    return rows.select(*keys, "level", "ordinals", F.when(depth > 0, path(depth)).alias("node_key"),
                       F.when(depth > 1, path(depth - 1)).alias("parent_key"), "type", "value", *more)


def related(shredded: DataFrame, keys: list[str], levels: list[str], refs: dict[str, Refs] | None = None, values: bool = True) -> DataFrame:
    """The rows of :func:`flatten` for ``levels``, from documents that are shredded already."""
    lists = [F.lit(p) for p in Levels(levels).lists]
    irregular = F.arrays_overlap("objects", F.array(*lists)) if lists else F.lit(False)
    regular = shredded.where(~irregular).select(*keys, F.explode("entries").alias("_e")).select(*keys, "_e.*").where(F.col("level").isin(levels))
    again = flatten(shredded.where(irregular).select(*keys, "_body"), keys, "_body", levels, refs, values)
    return _keyed(regular, keys).unionByName(again if values else again.where("type = 'object'"))


def _members(found: list) -> pa.MapArray:
    """The members of the objects among the entries, each with its type and text; null ones left out."""
    offsets, names, types, texts = [0], [], [], []
    for _, _, x in found:
        if type(x) is dict:
            for name, v in x.items():
                if v is not None:
                    names.append(name)
                    types.append(kind(v) if type(v) is not int or -(2**63) <= v < 2**63 else "string")
                    texts.append(v if type(v) is str else json.dumps(v, ensure_ascii=False, separators=(",", ":")))
        offsets.append(len(names))
    held = pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(texts, pa.string())], names=["type", "text"])
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), held)


def flatten(df: DataFrame, keys: list[str], body: str, levels: list[str], refs: dict[str, Refs] | None = None,
            values: bool = True, members: bool = False) -> DataFrame:
    """One row per entry at any of ``levels``: keys, ``level``, ``ordinals``, ``node_key``, ``parent_key``, ``type``, ``value``.

    The level ``""`` is the document itself, without ordinals and ``node_key``.
    ``ordinals`` count from 0 in written order, outermost level first;
    ``node_key`` joins with the children's ``parent_key`` (both are unique
    within the keys; null for children of the document itself).  ``type`` is the
    entry's JSON type, ``value`` the JSON text of an object, a text as it is,
    null for a list (its entries are the level below) or with ``values=False``.
    With ``members`` there is also ``members``, an object's members with their
    types and texts.  Repeated documents give repeated rows; null and malformed
    ones none.
    """
    known, wanted = Levels(levels), set(levels)
    walk, root = Walk(refs or {}, known), ROOT in wanted
    source = df.select(*keys, F.col(body).cast("string").alias("_body"))
    names = [*keys, "level", "ordinals", "type", "value", *(["members"] if members else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, out = [], []
            for n, text in enumerate(b.column(len(keys)).to_pylist()):
                doc = parse(text)
                before = len(out)
                if root and isinstance(doc, dict):
                    out.append((ROOT, [], doc))
                out += [e for e in walk(doc)[0] if e[0] in wanted]
                where += [n] * (len(out) - before)
            picked = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(picked) for i in range(len(keys))),
                 pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.int32())),
                 pa.array([kind(r[2]) for r in out], pa.string()), pa.array([_value(r[2]) if values else None for r in out], pa.string()),
                 *([_members(out)] if members else [])], names)

    ddl = f"{_ddl_of(source.schema.fields[:-1])}level string, ordinals array<int>, type string, value string"
    more = ", members map<string,struct<type:string,text:string>>" if members else ""
    return _keyed(source.mapInArrow(run, ddl + more), keys, *(["members"] if members else []))


def _column(types: set[str]) -> str:
    """The type of a column whose values have these: whole and other numbers are one, what else differs is text."""
    if len(types) == 1:
        return {"boolean": "boolean", "integer": "bigint", "decimal": "double"}.get(next(iter(types)), "string")
    return "double" if types == {"integer", "decimal"} else "string"


def child_table(flat: DataFrame, keys: list[str], level: str, prefix: str = "", max_paths: int = MAX_PATHS) -> DataFrame:
    """The objects of ``level``: keys, ``node_key``, ``parent_key``, ``ordinal`` and a column ``prefix + member`` for each member.

    ``flat`` has ``members``.  Columns and types are those of the rows
    themselves: entries named by reference and lone objects count like those of
    a list.  Mixed types become text, nested values JSON text.  A prefix keeps
    members apart from keys of the same name; ``ordinal`` is the place in the
    list (null for documents).
    """
    own: list[Column] = [*map(F.col, keys), F.col("node_key"), F.col("parent_key"), F.try_element_at("ordinals", F.lit(-1)).alias("ordinal")]
    rows = materialise(flat.where((F.col("level") == level) & (F.col("type") == "object")).select(*own, "members"), "entries")
    seen = rows.select(F.explode("members").alias("m", "x")).select("m", "x.type").distinct().limit(max_paths + 1).collect()
    if len(seen) > max_paths:
        raise ValueError(f"{level} has more than {max_paths} members")
    types: dict[str, set[str]] = {}
    for r in seen:
        types.setdefault(r["m"], set()).add(r["type"])
    text = lambda m: F.try_element_at("members", F.lit(m))["text"]
    typed = lambda m, t: text(m) if t == "string" else text(m).try_cast(t)
    return rows.select(*rows.columns[:-1], *[typed(m, _column(t)).alias(prefix + m) for m, t in sorted(types.items())])
