"""Schemas that drift between files.

1. :func:`path_values` loads each file as a path-value map with raw JSON types.
2. :func:`file_statistics` has the types at each path of each file,
   :func:`type_statistics` aggregates them over files.
3. :func:`compared` holds the statistics of each file against those of the one
   before it; :func:`changes` reports what differs, and :func:`found_synonyms`
   takes the fields that were renamed into one another for one field.
4. :func:`derived_fields` makes columns and types of the statistics and the
   synonyms, :func:`typed_table` projects them and reports failed casts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nested import kind
from .ordered import previous_row

MEMBER = "struct<outer:string,inner:string,type:string,value:string>"
MAX_COLUMNS = 5_000  # files of more members are refused: keys that are data need rows of their own
JSON = ("list", "object")

Member = str | tuple[str, str]  # a member of the payload, or (outer, inner)


def path_values(df: DataFrame, body: str, out: str = "members") -> DataFrame:
    """Add ``out``: array of (outer, inner, type, value) of the payload's members and of their members.

    ``inner`` is null for a member of the payload itself.  ``value`` is
    canonical JSON (members sorted, 1 and 1.0 apart).  Null members are left
    out, a member given twice counts as the last.  Null for a null or malformed
    payload, empty for a payload that is no object.
    """
    canon = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def members(text: str | None) -> list | None:
        if text is None:
            return None
        try:
            doc = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not isinstance(doc, dict):
            return []
        rows = []
        for k, v in doc.items():
            if v is None:
                continue
            rows.append({"outer": k, "inner": None, "type": kind(v), "value": canon(v)})
            if isinstance(v, dict):
                rows += [{"outer": k, "inner": i, "type": kind(w), "value": canon(w)} for i, w in v.items() if w is not None]
        return rows

    typ = pa.list_(pa.struct([(n, pa.string()) for n in ("outer", "inner", "type", "value")]))
    keep = [c for c in df.columns if c != out]
    fields = df.select(*keep).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<{MEMBER}>"
    at = keep.index(body)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = pa.array([members(t) for t in b.column(at).to_pylist()], typ)
            yield pa.RecordBatch.from_arrays([*b.columns, col], [*keep, out])

    return df.select(*keep).mapInArrow(load, ddl)


def _field(m: Column) -> Column:
    return F.concat_ws(".", m["outer"], m["inner"])


def file_statistics(loaded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``path``, ``outer``, ``inner``, ``type``, ``value``): each path of each file with its raw type."""
    m = F.col("m")
    return (loaded.select(*keys, F.explode("members").alias("m"))
            .select(*keys, _field(m).alias("path"), m["outer"].alias("outer"), m["inner"].alias("inner"), m["type"].alias("type"), m["value"].alias("value")))


def type_statistics(loaded: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, type, files): in how many files each path has each raw type."""
    return file_statistics(loaded, by).groupBy(*by, "path", "type").agg(F.count("*").alias("files"))


CHANGE = "array<struct<outer:string,was:string,now:string,change_kind:string>>"


def compared(df: DataFrame, key: str, group: list[str], order: list[str], load: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, ``outer``, ``was``, ``now``, ``change_kind``): how the statistics of each file differ from those of the one before it.

    ``df`` has ``members``, or gets it by ``load``.  ``outer`` is the member whose
    members are compared, null for those of the payload itself; ``was`` is null
    for an added field, ``now`` for one removed.
    """
    groups, orders = [f"_g{i}" for i in range(len(group))], [f"_o{i}" for i in range(len(order))]
    rest = [c for c in ("_body", "members") if c in df.columns]
    narrow = df.select(F.col(key).alias("_key"), *rest, *[F.col(c).alias(a) for c, a in zip([*group, *order], [*groups, *orders], strict=True)])
    pairs = previous_row(narrow, groups, orders, F.col("members"), "before", load).where("before is not null")
    top = lambda ms: F.filter(ms, lambda m: m["inner"].isNull())
    objects = lambda ms: F.transform(F.filter(top(ms), lambda m: m["type"] == "object"), lambda m: m["outer"])
    pairs = pairs.withColumn("both", F.array_intersect(objects("members"), objects("before")))
    counted = lambda ms: F.filter(ms, lambda m: m["inner"].isNull() | F.array_contains("both", m["outer"]))
    pairs = pairs.select("_key", counted("members").alias("now"), counted("before").alias("was"))
    # what differs in name or type, by hashing; the loops below see only that
    ident = lambda m: F.to_json(F.struct(m["outer"], m["inner"], m["type"]))
    idents = lambda ms: F.transform(ms, ident)
    pairs = (pairs.withColumn("d", F.array_except(idents("now"), idents("was")))
             .withColumn("e", F.array_except(idents("was"), idents("now")))
             .where((F.size("d") > 0) | (F.size("e") > 0))
             .select("_key", F.filter("now", lambda m: F.array_contains("d", ident(m))).alias("now"),
                     F.filter("was", lambda m: F.array_contains("e", ident(m))).alias("was")))
    same = lambda m, w: m["outer"].eqNullSafe(w["outer"]) & m["inner"].eqNullSafe(w["inner"])
    pairs = pairs.select("_key", F.filter("now", lambda m: F.exists("was", lambda w: same(m, w))).alias("retyped"),
                         F.filter("now", lambda m: ~F.exists("was", lambda w: same(m, w))).alias("fresh"),
                         F.filter("was", lambda m: ~F.exists("now", lambda w: same(m, w))).alias("gone"))
    level = lambda m: F.when(m["inner"].isNotNull(), m["outer"])
    like = lambda m, w: level(m).eqNullSafe(level(w)) & (m["value"] == w["value"])
    nth = lambda ms: F.transform(ms, lambda m, i: F.struct(
        m["outer"].alias("outer"), m["inner"].alias("inner"), m["value"].alias("value"),
        F.size(F.filter(F.slice(ms, 1, i), lambda w: like(m, w))).alias("nth")))
    pairs = pairs.select("_key", "retyped", nth(F.col("fresh")).alias("fresh"), nth(F.col("gone")).alias("gone"))
    match = lambda m, ws: F.get(F.filter(ws, lambda w: like(m, w) & (m["nth"] == w["nth"])), F.lit(0))
    name, none = lambda m: F.coalesce(m["inner"], m["outer"]), F.lit(None).cast("string")
    said = lambda m, was, now, what: F.struct(level(m).alias("outer"), was.alias("was"), now.alias("now"), what.alias("change_kind"))
    fresh = lambda m: said(m, name(match(m, F.col("gone"))), name(m), F.when(match(m, F.col("gone")).isNull(), "added").otherwise("renamed"))
    gone = F.filter("gone", lambda m: match(m, F.col("fresh")).isNull())
    found = F.concat(F.transform("fresh", fresh).cast(CHANGE), F.transform(gone, lambda m: said(m, name(m), none, F.lit("removed"))).cast(CHANGE),
                     F.transform("retyped", lambda m: said(m, name(m), name(m), F.lit("retyped"))).cast(CHANGE))
    return pairs.select("_key", F.explode(found).alias("c")).select(F.col("_key").alias(key), "c.*")


def changes(df: DataFrame, key: str, group: list[str], order: list[str], body: str) -> DataFrame:
    """(key, ``field_name``, ``change_kind``): what each file changes against the one before it in its group.

    Files with a null or malformed payload are passed over.  Fields are the
    members and, as ``outer.inner``, those of a member that is an object under
    the same name in both files; null members count as absent.  A gone and a
    new field of one level with the same JSON value are one ``renamed`` (in
    written order, each used once); else ``added``, ``removed``; ``retyped``
    where the raw type differs.  The first file of a group has no changes, nor
    have repeated files.  Files with a null group value form groups of their own.
    """
    load = lambda rows: path_values(rows, "_body").where("members is not null").drop("_body")
    c = compared(df.drop("members").withColumn("_body", F.col(body)), key, group, order, load)
    return c.select(key, F.concat_ws(".", "outer", F.coalesce("now", "was")).alias("field_name"), "change_kind")


def found_synonyms(loaded: DataFrame, differences: DataFrame, max_columns: int = MAX_COLUMNS) -> dict[str, list[str]]:
    """Members of the payload that were renamed into one another: the commonest name -> all its names, commonest first.

    Two names that stand beside each other in some file are two fields, whatever
    value they once had in common.  ``differences`` is what :func:`compared`
    gives; only distinct pairs of names reach the driver, more than
    ``max_columns`` of them are an error.
    """
    edges = differences.where("change_kind = 'renamed' and outer is null").select("was", "now").distinct().limit(max_columns + 1).collect()
    if len(edges) > max_columns:
        raise ValueError(f"more than {max_columns} renames: are keys of the files data?")
    if not edges:
        return {}
    top = F.transform(F.filter("members", lambda m: m["inner"].isNull()), lambda m: m["outer"])
    pairs = F.array(*[F.struct(F.lit(e["was"]).alias("a"), F.lit(e["now"]).alias("b")) for e in edges])
    own = loaded.select(top.alias("top"))
    beside = own.select(F.explode(F.filter(pairs, lambda p: F.array_contains("top", p["a"]) & F.array_contains("top", p["b"]))).alias("p")).distinct().collect()
    apart = {frozenset(r["p"]) for r in beside}
    files = {r["n"]: r["files"] for r in own.select(F.explode(F.array_intersect("top", F.array(*map(F.lit, {n for e in edges for n in e})))).alias("n")).groupBy("n").agg(F.count("*").alias("files")).collect()}
    one: dict[str, set[str]] = {n: {n} for e in edges for n in e}
    for e in sorted(edges):
        a, b = one[e["was"]], one[e["now"]]
        if a is not b and not any(frozenset((x, y)) in apart for x in a for y in b):
            a |= b
            one.update(dict.fromkeys(a, a))
    classes = {min(c, key=lambda n: (-files.get(n, 0), n)): c for c in one.values() if len(c) > 1}
    return {name: sorted(c, key=lambda n: (-files.get(n, 0), n)) for name, c in sorted(classes.items())}


def _key(outer: Column, inner: Column | None = None) -> Column:
    """A member's name as one text; the length keeps ``a.b`` apart from ``b`` in ``a``."""
    own = F.concat(F.length(outer).cast("string"), F.lit(":"), outer)
    return own if inner is None else F.when(inner.isNull(), own).otherwise(F.concat(own, F.lit("."), inner))


def _column_type(files: Counter, fractional: int) -> str:
    """The type most files have; integers and decimals are one, whole unless some value has a fraction."""
    number = files.pop("integer", 0) + files.pop("decimal", 0)
    most = max([("string", files.pop("string", 0)), ("number", number), *sorted(files.items())], key=lambda x: x[1])[0]
    return ("double" if fractional else "bigint") if most == "number" else most


def derived_fields(loaded: DataFrame, synonyms: dict[str, list[str]], keys: list[str], max_columns: int = MAX_COLUMNS) -> dict[str, tuple[list[Member], str]]:
    """Fields for :func:`typed_table` from the type statistics of all files: every member and every member of one has a column.

    Members named in ``synonyms`` (column to names) share its column, and so do
    their members; one that stands beside an earlier name in some file is no
    synonym and has its own.  The others' columns are named ``outer`` and
    ``outer.inner``, with a number where that name is taken (upper and lower case
    count as one).  More than ``max_columns`` names are an error.
    """
    earlier = {n: names[:i] for names in synonyms.values() for i, n in enumerate(names) if i}
    top = F.transform(F.filter("members", lambda m: m["inner"].isNull()), lambda m: m["outer"])
    rows_of = file_statistics(loaded.withColumn("_top", top), ["_top"])
    outer, number = F.col("outer"), F.col("value").try_cast("double")
    beside = F.lit(False)
    for n, names in earlier.items():
        beside = beside | ((outer == n) & F.arrays_overlap("_top", F.array(*map(F.lit, names))))
    whole = F.coalesce((number == F.floor(number)) & (F.abs(number) < 2.0**63), F.lit(False))
    stats = rows_of.groupBy("outer", "inner", "type").agg(F.count("*").alias("files"), F.count_if((F.col("type") == "decimal") & ~whole).alias("fractional"), F.count_if(beside).alias("beside"))
    rows = stats.limit(6 * max_columns + 1).collect()
    apart = {r["outer"] for r in rows if r["beside"]}
    column = {n: c for c, names in synonyms.items() for n in names if n not in apart}
    place = {n: i for names in synonyms.values() for i, n in enumerate(names)}
    found: dict[tuple, list] = {(c, None): [Counter(), 0, {n for n in names if n not in apart}] for c, names in synonyms.items()}
    for r in rows:
        known = r["outer"] in column
        at = (column[r["outer"]] if known else (r["outer"],), r["inner"])  # a tuple: no column of the synonyms
        field = found.setdefault(at, [Counter(), 0, set()])
        field[0][r["type"]] += r["files"]
        field[1] += r["fractional"]
        field[2].add(r["outer"])
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} members: are keys of the files data?")
    plain = lambda c: c if isinstance(c, str) else c[0]
    fields: dict[str, tuple[list[Member], str]] = {}
    taken = {k.lower() for k in [*keys, "failed_casts"]}
    for (c, inner), (files, fractional, names) in sorted(found.items(), key=lambda x: (x[0][1] is not None, not isinstance(x[0][0], str), list(synonyms).index(x[0][0]) if isinstance(x[0][0], str) else 0, plain(x[0][0]), x[0][1] or "")):
        wanted = name = (plain(c) if inner is None else f"{plain(c)}.{inner}") or "_"
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{wanted}_{n}"
        taken.add(name.lower())
        ordered = sorted(names, key=lambda o: (place.get(o, 0), o))
        fields[name] = ([o if inner is None else (o, inner) for o in ordered], _column_type(files, fractional))
    return fields


def typed_table(loaded: DataFrame, keys: list[str], fields: dict[str, tuple[list[Member], str]]) -> DataFrame:
    """One row per file: keys, one typed column per field, and ``failed_casts``.

    ``fields`` maps a column to (member names tried in order, type): a name is
    that of a member or (outer, inner), a type that of Spark, or ``list`` or
    ``object`` for canonical JSON text.  A value that does not cast gives null
    and its column's name in ``failed_casts`` (comma-separated); an absent one
    gives null alone.  In a column of text, or of JSON text, one of another shape
    (list or object in text, anything else in JSON text) keeps its text and is
    named there too.  Files with a malformed payload give nulls.
    """
    values = F.map_from_entries(F.transform("members", lambda m: F.struct(_key(m["outer"], m["inner"]), F.struct(m["type"].alias("type"), m["value"].alias("value")))))
    rows = loaded.withColumn("_m", F.coalesce(values, F.expr("map()").cast("map<string,struct<type:string,value:string>>")))
    name = lambda n: _key(F.lit(n)) if isinstance(n, str) else _key(F.lit(n[0]), F.lit(n[1]))
    held = F.array(*[F.coalesce(*[F.try_element_at("_m", name(n)) for n in names]) for names, _ in fields.values()])
    rows = rows.select(*keys, held.alias("_h"))
    unquoted = lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)

    def to(v: Column, t: str) -> Column:
        if t in ("int", "bigint"):  # 3.0 is whole, 3.5 fails
            return F.coalesce(v.try_cast(t), F.when(v.try_cast("decimal(38,9)") % 1 == 0, v.try_cast("decimal(38,9)").try_cast(t)))
        return v if t == "string" else v.try_cast(t)

    cast, failed = {}, []
    for i, (c, (_, t)) in enumerate(fields.items()):
        raw = F.get("_h", F.lit(i))
        cast[c] = raw["value"] if t in JSON else to(unquoted(raw["value"]), t)
        shape = raw["type"] != t if t in JSON else raw["type"].isin(*JSON) if t == "string" else F.lit(False)
        failed.append(F.when(raw.isNotNull() & (cast[c].isNull() | shape), F.lit(c)))
    names = F.filter(F.array(*failed), lambda x: x.isNotNull())
    return rows.select(*keys, *[v.alias(c) for c, v in cast.items()], F.array_join(names, ",").alias("failed_casts"))
