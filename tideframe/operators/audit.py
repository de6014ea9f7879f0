"""Audit of expressions for look-ahead, on Spark's own analysed plan of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

#: Window frames and functions that read later rows.
_AHEAD = (
    (re.compile(r"\blead\(", re.I), "lead", "reads a later row"),
    (re.compile(r"specifiedwindowframe\(\w+, [^,]+, (?:unboundedfollowing\$\(\)|[1-9]\d*)\)", re.I), "frame", "the frame ends after the current row"),
    (re.compile(r"specifiedwindowframe\(\w+, (?:currentrow\$\(\)|0|[1-9]\d*), unboundedfollowing\$\(\)\)", re.I), "backward fill", "the frame is the rest of the entity"),
)
_PARTITION = re.compile(r"windowspecdefinition\((.*?), specifiedwindowframe", re.I | re.S)


@dataclass(frozen=True)
class Finding:
    rule: str
    reason: str
    text: str


def audit(df: DataFrame, expr: Column, time: str | None = None) -> list[Finding]:
    """What in an expression reads later rows of a time-ordered window.

    Windows over a date alone (no order) are cross-sections and pass; a window over an entity without an order is its whole
    history, and is reported.
    """
    plan = df.select(expr.alias("__x"))._jdf.queryExecution().analyzed().toString()
    own = set(df._jdf.queryExecution().analyzed().toString().splitlines())
    line = "\n".join(x for x in plan.splitlines() if "windowspecdefinition" in x and x not in own)
    found = [Finding(rule, why, m.group(0)) for pattern, rule, why in _AHEAD for m in pattern.finditer(line)]
    if time is not None:
        found = [f for f in found if not (f.rule == "frame" and _is_cross_section(line, time))]
    return found


def _is_cross_section(line: str, time: str) -> bool:
    specs = _PARTITION.findall(line)
    return bool(specs) and all(" ASC " not in s and " DESC " not in s and re.search(rf"\b{re.escape(time)}#", s) for s in specs)


def assert_causal(df: DataFrame, expr: Column, time: str | None = None) -> Column:
    """The expression, if nothing in it reads later rows."""
    if found := audit(df, expr, time):
        raise ValueError("; ".join(f"{f.rule}: {f.reason}" for f in found))
    return expr
