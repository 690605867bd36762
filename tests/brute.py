"""Plain Python versions of the general operators, for comparison."""

import json


def _loads(t):
    try:
        return json.loads(t)
    except Exception:
        return None


def _listed(v):
    if isinstance(v, str):
        v = _loads(v)
    if isinstance(v, list):
        return v
    if isinstance(v, dict) and v:
        return list(v.values()) if all(isinstance(x, dict) for x in v.values()) else [v]
    return []


def _member(v, k):
    if isinstance(v, str):
        v = _loads(v)
    return v.get(k) if isinstance(v, dict) else None


def script_items(script_id, body):
    doc, out = _loads(body) if body is not None else None, []
    if not isinstance(doc, dict):
        return out
    for i, s in enumerate(_listed(doc.get("scenes"))):
        if not isinstance(s, dict):
            continue
        out.append((script_id, "scene", i, -1, -1))
        if "beats" not in s and "beats" in doc:
            ids = {}
            for b in _listed(doc["beats"]):
                if isinstance(b, dict):
                    ids.setdefault(b.get("id"), b)
            beats = [ids.get(r) if isinstance(r, str) else None for r in _listed(s.get("beat_refs"))]
        else:
            beats = _listed(s.get("beats"))
        for j, b in enumerate(beats):
            if not isinstance(b, dict):
                continue
            out.append((script_id, "beat", i, j, -1))
            out += [(script_id, "reveal", i, j, k) for k, r in enumerate(_listed(b.get("reveal"))) if isinstance(r, dict)]
    km = _member(doc, "knowledge_model")
    model = _member(km, "model")
    for name, v in (("node", _member(model, "nodes")), ("relation", _member(model, "relations")), ("evidence", _member(km, "evidence"))):
        out += [(script_id, name, -1, -1, k) for k, x in enumerate(_listed(v)) if isinstance(x, dict)]
    return out


def gaps(intervals, min_gap):
    """intervals: (key, start, end)."""
    by = {}
    for k, s, e in intervals:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = []
    for k, xs in by.items():
        reach = None
        for s, e in sorted(xs):
            if reach is not None and s - reach >= min_gap:
                out.append((k, reach, s))
            reach = e if reach is None else max(reach, e)
    return sorted(out, key=str)


def periods(intervals, min_gap):
    by = {}
    for k, s, e in intervals:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = []
    for k, xs in by.items():
        cur = None
        for s, e in sorted(xs):
            if cur and s - cur[1] < min_gap:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    out.append((k, *cur))
                cur = [s, e]
        out.append((k, *cur))
    return sorted(out, key=str)


_KIND = {bool: "boolean", int: "integer", float: "decimal", str: "string", list: "list", dict: "object"}


def _level(a, b, prefix):
    canon = lambda v: json.dumps(v, sort_keys=True)
    a = {k: v for k, v in a.items() if v is not None}
    b = {k: v for k, v in b.items() if v is not None}
    gone = [k for k in a if k not in b]
    out = []
    for k in b:
        if k not in a:
            hit = next((g for g in gone if canon(a[g]) == canon(b[k])), None)
            if hit is not None:
                gone.remove(hit)
            out.append((prefix + k, "renamed" if hit is not None else "added"))
        elif type(a[k]) is not type(b[k]):
            out.append((prefix + k, "retyped"))
    return out + [(prefix + g, "removed") for g in gone], a, b


def changes(files):
    """files: (file_id, group, order, payload)."""
    before, out = {}, []
    for fid, g, _, p in sorted(files, key=lambda r: (str(r[1]), r[2], r[0])):
        doc = _loads(p) if p is not None else None
        if doc is None and (p is None or p.strip() != "null"):
            continue
        doc = doc if isinstance(doc, dict) else {}
        if g in before:
            found, a, b = _level(before[g], doc, "")
            for k in b:
                if isinstance(a.get(k), dict) and isinstance(b[k], dict):
                    found += _level(a[k], b[k], k + ".")[0]
            out += [(fid, *f) for f in found]
        before[g] = doc
    return sorted(out)


def reveal_windows(duration, spans):
    """The windows of a scene's panels, one after the other; spans hold (start, end) or None."""
    first, last = 1050, max(1500, duration - 600)
    out, free = [], first
    for span in spans:
        if span is None:
            out.append(None)
            continue
        start = min(max(span[0], free, first), last - 450)
        out.append((start, max(min(max(span[1], start + 450), last), start + 450)))
        free = out[-1][1] + 150
    known = [-1, *(i for i, w in enumerate(out) if w), len(out)]
    for left, right in zip(known, known[1:], strict=False):
        stop = out[right][0] - 150 if right < len(out) else last
        t, n = min(out[left][1] + 150 if left >= 0 else first, stop), right - left - 1
        if n:
            each = (stop - t - 150 * (n - 1)) // n
            each = max(120, each) if each < 300 else each
            for k in range(n):
                at = t + k * (each + 150)
                out[left + 1 + k] = (at, max(min(at + each, stop), at + 120)) if k == 0 or at < stop else (last - 300, last)
    if out and out[0][0] > 1200:
        out[0] = (first, out[0][1])
    return out
