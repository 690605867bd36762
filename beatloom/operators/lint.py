"""Integrity rules over content documents, as one table of (code, severity, relation, condition).

A document is a variant column, so malformed entries stay rows and an absent
key differs from a null.  Each relation (document, scene, beat, reveal, ...) is
one explode of its parent; all rules of a relation are judged in one pass over
it, and referential rules look up the few ids of the same document in arrays.
Findings never raise and never change the input.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise

# Closed sets and required members.
TASK_TYPES = ["A", "B", "C", "D"]
CONFIDENCE = ["source-backed fact", "model inference", "teaching simplification"]
COGNITIVE = ["IDENTIFY", "DISTINGUISH", "RELATE", "EXPLAIN", "APPLY"]
OBSTACLES = ["MISSING", "CONFLICT", "GAP", "ABSTRACTION", "OVERLOAD", "TRANSFER"]
NARRATIVE = ["DECLARE", "QUESTION", "CONTRAST", "EXPLAIN", "TRACE", "INTERPRET", "GENERALIZE", "CHECK"]
VISUAL = ["INTRODUCE", "CONTRAST", "CONNECT", "DECOMPOSE", "TRANSFORM", "CAUSE", "EXAMPLE", "COUNTEREXAMPLE", "HIGHLIGHT", "SUMMARIZE"]
REVEAL = ["DRAW", "CONNECT", "CHANGE", "HIGHLIGHT", "ANNOTATE", "GROUP", "REMOVE", "REFRAME"]
UNSUPPORTED = ["HIGHLIGHT", "REMOVE", "REFRAME"]
CHANNELS = ["verbal", "visual", "shared"]
KM_REQUIRED = ["subject", "target_claim", "task_type", "learner", "model", "learning_outcome", "evidence", "dependencies", "scope", "source_coverage"]
CONSTRAINTS = ["prerequisites", "misconceptions_to_resolve", "essential_relations", "optional_details", "load_budget"]
OUTCOMES = ["recognition", "explanation", "prediction", "application"]

B, W = "blocking", "warning"
EMPTY = r"""^(?:null|\[\]|\{\}|"(?:[\s\p{Z}]|\\[nrtfb]|\\u00(?:0[0-9a-f]|1[0-9a-f]|85|a0))*")$"""

# Conditions are SQL text over the relation's columns: a rule set of this size
# is parsed in one go, where column objects would cost a call for every node.


def get(v: str, *names: str) -> str:
    """Member of an object, of its member, ...; null where one is absent or no object."""
    return f"try_variant_get({v}, '$.{'.'.join(names)}', 'variant')"


def text(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def kind(v: str) -> str:
    """OBJECT, ARRAY, a scalar type, VOID for JSON null; null where absent."""
    return f"regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0)"


def is_object(v: str) -> str:
    return f"coalesce(startswith(schema_of_variant({v}), 'OBJECT'), false)"


def entries(v: str) -> str:
    """The entries of a list; none for anything else."""
    return f"coalesce(try_variant_get({v}, '$', 'array<variant>'), cast(array() as array<variant>))"


def objects(v: str) -> str:
    return f"filter({entries(v)}, o -> {is_object('o')})"


def texts(v: str) -> str:
    return f"filter(transform({entries(v)}, t -> {text('t')}), t -> t is not null)"


def nonempty(v: str) -> str:
    """Neither absent, null, blank text, nor an empty list or object; 0 and false count as given."""
    return f"coalesce(not (to_json({v}) rlike r'{EMPTY}'), false)"


def empty(v: str) -> str:
    return f"(not {nonempty(v)})"


def one_of(v: str, values: list[str]) -> str:
    listed = ", ".join(f"'{json.dumps(x)}'" for x in values)
    return f"coalesce(to_json({v}) in ({listed}), false)"


def given_but_not(v: str, values: list[str]) -> str:
    return f"({nonempty(v)} and not {one_of(v, values)})"


def same(a: str, b: str) -> str:
    return f"coalesce(trim({text(a)}) = trim({text(b)}), false)"


def object_or_none(v: str) -> str:
    return f"({is_object(v)} or {empty(v)})"


def findings(rows: DataFrame, keys: list[str], path: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """keys, ``severity``, ``code``, ``path`` of every rule (code, severity, condition) that a row breaks."""
    said = ", ".join(f"case when {c} then named_struct('severity', '{sev}', 'code', '{code}') end" for code, sev, c in rules)
    return (rows.select(*keys, F.expr(path).alias("path"), F.explode(F.expr(f"filter(array({said}), f -> f is not null)")).alias("f"))
            .select(*keys, "f.severity", "f.code", "path"))


def _each(rows: DataFrame, keys: list[str], path: str, code: str, severity: str, values: str) -> DataFrame:
    """One finding per entry of ``values``."""
    return rows.select(*keys, F.explode(F.expr(values)).alias("x"), F.expr(path).alias("p")).select(
        *keys, F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat_ws("/", "p", F.col("x").cast("string")).alias("path"))


def _relations(docs: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    ids = lambda v: f"filter(transform({entries(v)}, n -> {text(get('n', 'id'))}), i -> i <> '')"
    base = docs.selectExpr(
        *keys, "doc", f"{get('doc', 'knowledge_model')} as km", f"{get('doc', 'learner_model')} as lm",
        f"{ids(get('doc', 'knowledge_model', 'model', 'nodes'))} as nodes", f"{ids(get('doc', 'knowledge_model', 'evidence'))} as evidence_ids",
        f"flatten(transform({objects(get('doc', 'scenes'))}, s -> {texts(get('s', 'beat_refs'))})) as refs",
        f"flatten(transform({entries(get('doc', 'knowledge_model', 'model', 'nodes'))}, n -> {texts(get('n', 'evidence'))})) as bound")
    down = lambda df, v, no, name, *keep: df.selectExpr(*keys, *keep, f"posexplode({v}) as ({no}, {name})")
    scene = down(base, entries(get("doc", "scenes")), "scene_no", "scene", "evidence_ids", "refs").where(is_object("scene"))
    scene = scene.withColumn("sid", F.expr(f"coalesce(nullif({text(get('scene', 'id'))}, ''), format_string('scene-%02d', scene_no + 1))"))
    beat = down(scene, entries(get("scene", "beats")), "beat_no", "beat", "sid", "scene_no", "evidence_ids", "refs").where(is_object("beat"))
    beat = beat.withColumn("bid", F.expr(f"coalesce(nullif({text(get('beat', 'id'))}, ''), concat(sid, '-b', beat_no + 1))"))
    return {
        "document": base, "scene": scene, "beat": beat,
        "element": down(scene, entries(get("scene", "elements")), "no", "v", "sid"),
        "evidence": down(base, entries(get("km", "evidence")), "no", "v"),
        "relation": down(base, entries(get("km", "model", "relations")), "no", "v", "nodes"),
        "transition": down(base, entries(get("lm", "transitions")), "no", "v", "lm"),
        "reveal": down(beat, entries(get("beat", "reveal")), "no", "v", "bid", f"size({entries(get('beat', 'narrative', 'spans'))}) as n_spans"),
        "part": down(beat, entries(get("beat", "elements")), "no", "v", "bid"),
    }


def lint(docs: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, ``severity``, ``code``, ``path``: every broken rule of every document.

    A null body gives ``IR.NO_SCRIPT``, one that is not a JSON object
    ``IR.BAD_JSON``, and nothing else.  Repeated documents give their findings
    again.
    """
    held = docs.select(*keys, F.col(body).isNull().alias("_none"), F.try_parse_json(F.col(body)).alias("doc"))
    parsed, ok = materialise(held, "parsed"), is_object("doc")  # parsed once, read by every relation
    r = _relations(parsed.where(ok), keys)
    km = lambda *n: get("km", *n)
    lm = lambda *n: get("lm", *n)
    has_km, has_lm = is_object("km"), is_object("lm")
    core = f"coalesce(trim({text(km('model', 'core'))}), trim({text(km('model'))}))"
    unbound = "array_except(evidence_ids, bound)"
    n_beats = f"size(flatten(transform({objects(get('doc', 'scenes'))}, s -> {objects(get('s', 'beats'))})))"
    n_transitions = f"size({entries(lm('transitions'))})"
    none_given = lambda names, of: " and ".join(empty(of(n)) for n in names)
    doc = r["document"]
    out = [
        findings(parsed, keys, "'/'", [("IR.NO_SCRIPT", B, "_none"), ("IR.BAD_JSON", B, f"not _none and not {ok}")]),
        findings(doc, keys, "'/'", [
            ("KM.MISSING", B, f"not {has_km}"), ("KM.SCOPE", B, f"{has_km} and {object_or_none(km('scope'))} and {empty(km('scope', 'exclude'))}"),
            ("KM.SCARECROW", W, f"{has_km} and {nonempty(km('learner', 'misconception'))} and {empty(km('learner', 'misconception_source'))}"),
            ("KM.OUTCOME", B, f"{has_km} and {object_or_none(km('learning_outcome'))} and {none_given(OUTCOMES, lambda n: km('learning_outcome', n))}"),
            ("KM.EVIDENCE_UNBOUND", W, f"{has_km} and size({unbound}) > 0"),
            ("KM.CLAIM_IS_MODEL", B, f"coalesce(trim({text(km('target_claim'))}) = {core} and {core} <> '', false)"),
            ("LM.MISSING", B, f"not {has_lm}"), ("LM.NO_TRANSITION", B, f"{has_lm} and {n_transitions} = 0"),
            ("P5.BEAT_COUNT", B, f"{has_lm} and {n_transitions} > 0 and {n_beats} > 0 and {n_beats} <> {n_transitions}")]),
    ]
    pick = lambda names, of, cond: "filter(array(" + ", ".join(f"case when {cond(of(n))} then '{n}' end" for n in names) + "), x -> x is not null)"
    bad_tokens = f"filter(split(replace(coalesce({text(km('task_type'))}, ''), '+', ' '), '[ ]+'), t -> t <> '' and t not in ({', '.join(map(repr, TASK_TYPES))}))"
    out.append(_each(doc.where(has_km), keys, "'knowledge_model'", "KM.REQUIRED", B, pick(KM_REQUIRED, km, empty)))
    out.append(_each(doc.where(has_km), keys, "'task_type'", "KM.TASK_TYPE", B, bad_tokens))
    out.append(_each(doc.where(has_lm), keys, "'constraints'", "LM.CONSTRAINTS", B, pick(CONSTRAINTS, lambda n: lm("constraints", n), lambda x: f"{x} is null")))

    sid = get("scene", "id")
    out.append(findings(r["scene"], keys, "sid", [
        ("SCENE.ID_FIELD_MISSING", B, f"{sid} is null"), ("SCENE.ID_BAD_FORMAT", B, f"{sid} is not null and not coalesce({text(sid)} rlike '^scene-[0-9]{{2}}$', false)")]))
    m = lambda *n: get("v", *n)
    out.append(findings(r["element"], keys, "concat_ws('/', sid, no)", [
        ("SCENE.ELEMENT_ID_FIELD_MISSING", B, f"{m('id')} is null"),
        ("SCENE.ELEMENT_ID_BAD_FORMAT", B, f"{m('id')} is not null and not coalesce(startswith({text(m('id'))}, 'panel-'), false)"),
        ("SCENE.ELEMENT_PHRASE_EMPTY", W, f"{empty(m('phrase'))} and {empty(m('text'))}")]))

    obj = is_object("v")
    out.append(findings(r["evidence"], keys, "format_string('evidence/%d', no)", [
        ("KM.EVIDENCE", B, f"not {obj}"), ("KM.EVIDENCE_SOURCE", B, f"{obj} and {empty(m('source'))}"),
        ("KM.EVIDENCE_CONFIDENCE", B, f"{obj} and not {one_of(m('confidence'), CONFIDENCE)}"),
        ("KM.SIMPLIFICATION_UNDOC", W, f"{obj} and {one_of(m('confidence'), CONFIDENCE[2:])} and {empty(m('note'))}")]))
    out.append(findings(r["relation"], keys, "format_string('relations/%d', no)", [
        ("KM.RELATION", B, f"not {obj}"), ("KM.RELATION_TYPE", B, f"{obj} and {empty(m('type'))}"),
        *[("KM.RELATION_DANGLING", B, f"{obj} and {nonempty(m(e))} and not array_contains(nodes, coalesce({text(m(e))}, ''))") for e in ("from", "to")]]))

    integer = lambda x: f"case when {kind(x)} = 'BIGINT' then try_variant_get({x}, '$', 'bigint') end"
    start, end = m("from_state"), m("to_state")
    out.append(findings(r["transition"], keys, "format_string('transitions/%d', no)", [
        ("LM.TRANSITION", B, f"not {obj}"), ("LM.STATE_EMPTY", B, f"{obj} and ({empty(start)} or {empty(end)})"),
        ("LM.STATE_NO_CHANGE", B, f"{obj} and {nonempty(start)} and {nonempty(end)} and {same(start, end)}"),
        ("LM.OPERATION", B, f"{obj} and not {one_of(m('cognitive_operation'), COGNITIVE)}"), ("LM.OBSTACLE", B, f"{obj} and not {one_of(m('obstacle'), OBSTACLES)}"),
        ("LM.SUCCESS_CONDITION", B, f"{obj} and {empty(m('success_condition'))}"),
        ("LM.OVERLOAD", W, f"{obj} and coalesce({integer(m('load'))} > {integer(lm('constraints', 'load_budget'))}, false)"),
        ("LM.ORDER_UNJUSTIFIED", W, f"{obj} and {empty(lm('ordering_rationale'))}")]))
    chain = r["transition"].where(obj).selectExpr(*keys, "no", f"trim({text(end)}) as leaves", f"trim({text(start)}) as enters")
    chain = chain.withColumn("next", F.lead("enters").over(Window.partitionBy(*keys).orderBy("no")))
    out.append(findings(chain, keys, "format_string('transitions/%d', no)", [("LM.CHAIN_BROKEN", B, "coalesce(leaves <> '' and next <> '' and leaves <> next, false)")]))

    b = lambda *n: get("beat", *n)
    before, after = b("state_before"), b("state_after")
    out.append(findings(r["beat"], keys, "bid", [
        ("EP.STATE_EMPTY", B, f"{empty(before)} or {empty(after)}"), ("EP.STATE_NO_CHANGE", B, f"{nonempty(before)} and {nonempty(after)} and {same(before, after)}"),
        ("EP.OPERATION", B, given_but_not(b("cognitive_operation"), COGNITIVE)), ("EP.OBSTACLE", B, given_but_not(b("obstacle"), OBSTACLES)),
        ("EP.NARRATION_GOAL", B, empty(b("narration_goal"))), ("EP.VISUAL_GOAL", B, empty(b("visual_goal"))),
        ("EP.ATTENTION", B, f"{object_or_none(b('expression_goal'))} and {empty(b('expression_goal', 'attention_target'))}"),
        ("EP.NARRATIVE_FUNCTION", B, f"{object_or_none(b('narrative'))} and not {one_of(b('narrative', 'function'), NARRATIVE)}"),
        ("EP.NARRATIVE_SPANS", B, f"{object_or_none(b('narrative'))} and {empty(b('narrative', 'spans'))}"),
        ("EP.VISUAL_OPERATION", B, given_but_not(b("visual_operation"), VISUAL)), ("EP.NO_REVEAL", B, f"size({entries(b('reveal'))}) = 0"),
        ("EP.CHANNEL_EMPTY", B, f"{object_or_none(b('channel_allocation'))} and {none_given(CHANNELS, lambda n: b('channel_allocation', n))}"),
        ("EP.ORPHAN_BEAT", B, "not array_contains(refs, bid)")]))
    alloc = b("channel_allocation")
    members = f"map_keys(coalesce(try_variant_get({alloc}, '$', 'map<string,variant>'), cast(map() as map<string,variant>)))"
    out.append(_each(r["beat"].where(is_object(alloc)), keys, "bid", "EP.CHANNEL", B, f"filter({members}, k -> k not in ({', '.join(map(repr, CHANNELS))}))"))
    out.append(_each(r["beat"].where("size(evidence_ids) > 0"), keys, "bid", "EP.EVIDENCE_DANGLING", B, f"filter({texts(b('evidence_refs'))}, x -> not array_contains(evidence_ids, x))"))

    bound = m("bound_span")
    unset = f"coalesce({kind(bound)} = 'VOID', true)"
    number = f"coalesce(try_variant_get({bound}, '$', 'bigint'), cast(try_variant_get({bound}, '$', 'double') as bigint), try_cast({text(bound)} as bigint))"
    out.append(findings(r["reveal"], keys, "concat_ws('/', bid, no)", [
        ("EP.REVEAL_SHAPE", B, f"not {obj}"), ("EP.REVEAL_OP", B, f"{obj} and not {one_of(m('op'), REVEAL)}"), ("ISA.UNSUPPORTED_OP", B, f"{obj} and {one_of(m('op'), UNSUPPORTED)}"),
        ("EP.REVEAL_TARGET", B, f"{obj} and {empty(m('target'))}"), ("EP.REVEAL_UNBOUND", B, f"{obj} and {unset}"),
        ("EP.NARRATIVE_SPANS", B, f"{obj} and not {unset} and n_spans = 0"),
        ("EP.SPAN_INDEX", B, f"{obj} and not {unset} and n_spans > 0 and not coalesce({number} between 0 and n_spans - 1, false)"),
        ("EP.HANDKEYED_TIME", W, f"{obj} and {nonempty(m('at_ms'))}")]))
    out.append(findings(r["part"], keys, "concat_ws('/', bid, no)", [
        ("EP.ELEMENT_SHAPE", B, f"not {obj}"), ("P6.ELEMENT_NO_ROLE", B, f"{obj} and ({empty(m('semantic_role'))} or {empty(m('cognitive_function'))})"),
        ("P6.ORNAMENT", W, f"{obj} and {empty(m('used_by'))}"), ("EP.INTRODUCED_AT", W, f"{obj} and {empty(m('introduced_at'))}")]))
    return reduce(DataFrame.unionByName, out)


def panel_findings(panels: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes whose layout has another number of panels than elements, or one or more than four panels."""
    p, e = panels.groupBy(*keys).agg(F.count("*").alias("n_panels")), elements.groupBy(*keys).agg(F.count("*").alias("n_elements"))
    both = p.join(e, keys, "left").fillna(0, ["n_elements"])
    return findings(both, keys, "'/'", [("BOARD.PANEL_ELEMENT_MISMATCH", B, "n_panels <> n_elements"), ("BOARD.PANEL_COUNT", W, "n_panels > 4 or n_panels < 2")])


def layout_files(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``IR.BAD_LAYOUT`` for layout texts that are not JSON; a null text is no layout and no finding."""
    bad = texts.where(F.col(text).isNotNull() & F.try_parse_json(text).isNull())
    return bad.select(*keys, F.lit(B).alias("severity"), F.lit("IR.BAD_LAYOUT").alias("code"), F.lit("/").alias("path"))
