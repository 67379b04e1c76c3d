"""Band conditions as column expressions.

A condition is clauses joined by `` and ``: a comparison with a number, an inclusive
range ``a - b``, or ``name == true/false`` over named inputs (absent reads false). Text
is matched, never evaluated; an unknown clause is an error.
"""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"-?\d+(?:\.\d+)?"
_COMPARE = re.compile(rf"(<=|>=|<|>|==)\s*({_NUM})")
_RANGE = re.compile(rf"({_NUM})\s*-\s*({_NUM})")
_INPUT = re.compile(r"(\w+)\s*==\s*(true|false)", re.IGNORECASE)
_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}


def clause_holds(clause: str, value: Column, inputs: dict[str, bool] | None = None) -> Column:
    clause = clause.strip()
    if m := _COMPARE.fullmatch(clause):
        return _OPS[m[1]](value, F.lit(float(m[2])))
    if m := _RANGE.fullmatch(clause):
        return value.between(float(m[1]), float(m[2]))
    if m := _INPUT.fullmatch(clause):
        return F.lit(bool((inputs or {}).get(m[1], False)) is (m[2].lower() == "true"))
    raise ValueError(f"unrecognised band clause: {clause!r}")


def band_holds(condition: str, value: Column, inputs: dict[str, bool] | None = None) -> Column:
    holds = F.lit(True)
    for clause in str(condition).split(" and "):
        holds = holds & clause_holds(clause, value, inputs)
    return holds


def band_score(bands: dict, value: Column, inputs: dict[str, bool] | None = None) -> Column:
    """Highest band whose condition holds; 1 when none does."""
    score = F.lit(1)
    for band in sorted(bands, key=int):  # later, higher bands override
        score = F.when(band_holds(bands[band], value, inputs), F.lit(int(band))).otherwise(score)
    return score


def capped_score(base: int, caps: list[dict], counts: dict[str, Column]) -> Column:
    """``base`` lowered to the smallest cap whose condition holds on its flag's count."""
    limits = [F.when(clause_holds(c["when"], counts[c["flag"]]), F.lit(int(c["max_score"]))).otherwise(F.lit(int(base)))
              for c in caps or []]
    return F.least(F.lit(int(base)), *limits) if limits else F.lit(int(base))
