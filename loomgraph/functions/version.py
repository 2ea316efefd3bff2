"""Version order, ranges, and CVSS v3 scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("major", "minor", "patch")),
        T.StructField("final", T.IntegerType()),
        T.StructField("pre", T.ArrayType(T.StructType([T.StructField("text", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("word", T.StringType())]))),
    ]
)


def parse(text: str | None) -> tuple | None:
    """Comparable form of a lenient semantic version; None if it has none (more than three numbers, letters in front)."""
    if text is None:
        return None
    m = re.fullmatch(r"[vV=]?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-.]?([A-Za-z][0-9A-Za-z.-]*)|-([0-9A-Za-z.-]+))?(?:\+.*)?", text.strip())
    if not m:
        return None
    numbers = tuple(int(x or 0) for x in m.groups()[:3])
    if any(n > 2**62 for n in numbers):
        return None
    pre = m[4] or m[5] or ""
    parts = [(0, int(p), "") if p.isdigit() and len(p) < 18 else (1, 0, p) for p in re.split(r"[.-]", pre) if p]
    return (*numbers, 0 if parts else 1, parts)


@F.pandas_udf(VERSION)
def version_key(text: pd.Series) -> pd.DataFrame:
    """A struct that compares as versions do; all null where the order is undetermined."""
    rows = [parse(t) for t in text]
    make = lambda r: {"major": r[0], "minor": r[1], "patch": r[2], "final": r[3], "pre": [{"text": a, "number": b, "word": c} for a, b, c in r[4]]}
    out = [make(r) if r else {"major": None, "minor": None, "patch": None, "final": None, "pre": None} for r in rows]
    return pd.DataFrame(out, columns=["major", "minor", "patch", "final", "pre"])


def compare(a: str, b: str) -> int | None:
    x, y = parse(a), parse(b)
    return None if x is None or y is None else (x > y) - (x < y)


def in_range(version: str, events: list[tuple[str, str]]) -> str:
    """affected, unaffected or undetermined, by events (introduced, fixed, last_affected, limit) in document order."""
    inside, settled = False, True
    for kind, bound in events:
        if kind == "introduced" and bound == "0":
            inside = True
            continue
        c = compare(version, bound)
        if c is None:
            settled = False
            continue
        if kind == "introduced" and c >= 0:
            inside = True
        elif (kind in ("fixed", "limit") and c >= 0) or (kind == "last_affected" and c > 0):
            inside = False
    return "undetermined" if not settled else "affected" if inside else "unaffected"


@F.pandas_udf(T.StringType())
def range_verdict(version: pd.Series, versions: pd.Series, ranges: pd.Series) -> pd.Series:
    """Verdict of a version: listed versions first, else affected over undetermined over unaffected of all ranges.

    ranges: array of arrays of (type, bound).
    """
    out = []
    for v, listed, rs in zip(version, versions, ranges):
        if listed is not None and v in list(listed):
            out.append("affected")
            continue
        verdicts = {in_range(v, [(e["type"], e["bound"]) for e in r]) for r in (rs if rs is not None else [])}
        out.append(next((x for x in ("affected", "undetermined") if x in verdicts), "unaffected"))
    return pd.Series(out)


# The published weights of CVSS v3.1.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
UI = {"N": 0.85, "R": 0.62}
PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}


def _weight(metric: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), metric)


def cvss3(vector: str | Column) -> Column:
    """Base score of a v3 vector string; null where a metric is missing."""
    c = F.col(vector) if isinstance(vector, str) else vector
    m = F.str_to_map(F.regexp_replace(c, r"^CVSS:3\.[01]/", ""), F.lit("/"), F.lit(":"))
    get = lambda k: F.try_element_at(m, F.lit(k))
    changed = get("S") == "C"
    pr = F.when(changed, _weight(get("PR"), PR["C"])).otherwise(_weight(get("PR"), PR["U"]))
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  binds a value once
    loss = 1 - (1 - _weight(get("C"), CIA)) * (1 - _weight(get("I"), CIA)) * (1 - _weight(get("A"), CIA))
    impact = let(loss, lambda x: F.when(changed, 7.52 * (x - 0.029) - 3.25 * F.pow(F.abs(x - 0.02), 15)).otherwise(6.42 * x))
    ease = 8.22 * _weight(get("AV"), AV) * _weight(get("AC"), AC) * pr * _weight(get("UI"), UI)
    # Round up to one digit, as the specification's integer arithmetic does.
    up = lambda w: F.when(w % 10_000 == 0, w / 100_000).otherwise((F.floor(w / 10_000) + 1) / 10)
    whole = lambda x: F.round(F.least(F.when(changed, 1.08 * (x.i + x.e)).otherwise(x.i + x.e), F.lit(10.0)) * 100_000).cast("long")
    score = let(F.struct(impact.alias("i"), ease.alias("e")), lambda x: F.when(x.i <= 0, 0.0).otherwise(let(whole(x), up)))
    return F.when(c.isNotNull() & get("S").isNotNull(), score)


def band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("none")


def satisfies(version: str, requirement: str) -> bool | None:
    """Whether a version meets a requirement: comma-joined terms with =, >, >=, <, <=, ^, ~, * or none (caret); None if it cannot be read."""
    mine = parse(version)
    if mine is None:
        return None
    for term in (t.strip() for t in requirement.split(",")):
        m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?\s*(.+)", term)
        if term in ("", "*"):
            continue
        text = re.sub(r"\.[*xX]", "", m[2])
        bound = parse(text)
        if bound is None:
            return None
        given = text.lstrip("v").split("-")[0].count(".") + 1
        op = m[1] or ("~" if text != m[2] else "^")
        ok = {">=": mine >= bound, "<=": mine <= bound, ">": mine > bound, "<": mine < bound, "=": mine == bound}.get(op)
        if ok is None:
            if op == "~":
                fixed = max(1, min(given, 2))
            else:
                fixed = next((i + 1 for i, n in enumerate(bound[:given][:3]) if n), given)
            ok = mine >= bound and mine[:fixed] == bound[:fixed]
        if not ok:
            return False
    return True
