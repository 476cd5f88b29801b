"""Band labels and constant lookups as generated CASE expressions, so banding stays inside whole-stage codegen.

Builders return SQL text (``*_sql``) or one parsed Column: a plan with a hundred bands is parsed in one step instead
of thousands of calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.reference import BANDS

ROUND_PLACES = 6


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def shifted(edge: float, right_closed: bool = False) -> str:
    """Edge literal moved by half a unit of the rounding place."""
    half = 0.5 * 10.0 ** -ROUND_PLACES
    return f"{float(edge) + (half if right_closed else -half)!r}D"


def band_sql(name: str, x: str) -> str:
    """Label of expression ``x`` in the named table. NULL stays NULL; +inf lands in the top band.

    Values are banded after rounding to six places. Half a unit in the sixth place is folded into the edges instead,
    so each arm is one double comparison: ``round(x, 6) < e`` is ``x < e - 5e-7`` and ``round(x, 6) <= e`` is
    ``x < e + 5e-7``.
    """
    edges, labels, right_closed = BANDS[name]
    arms = " ".join(f"WHEN {x} < {shifted(e, right_closed)} THEN {_text(lab)}" for e, lab in zip(edges, labels, strict=False))
    return f"CASE WHEN {x} IS NULL THEN NULL {arms} ELSE {_text(labels[-1])} END"


def lookup_sql(mapping: dict, key: str) -> str:
    """Constant dictionary as a CASE: no join, no broadcast, folds into codegen."""
    arms = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} END"


def band(name: str, x: str) -> Column:
    return F.expr(band_sql(name, x))


def lookup(mapping: dict, key: str) -> Column:
    return F.expr(lookup_sql(mapping, key))


def bureau_band_sql(x: str) -> str:
    """A missing score means new to credit, which is its own label."""
    return f"coalesce({band_sql('bureau_score', x)}, 'NTC')"


def bureau_band(x: str) -> Column:
    return F.expr(bureau_band_sql(x))


def valuation_spread_sql(a: str, b: str) -> str:
    hi = f"greatest({a}, {b})"
    return f"(CASE WHEN {hi} > 0 THEN CAST({hi} - least({a}, {b}) AS DOUBLE) / {hi} WHEN {hi} IS NOT NULL THEN 0D END)"


def balance_change_sql(first: str, last: str) -> str:
    """Trend of the last two months' balance against the first two, on integer sums so ties are exact."""
    return (f"CASE WHEN {first} IS NULL OR {last} IS NULL THEN NULL WHEN {first} <= 0 THEN 'flat'"
            f" WHEN {last} * 10 <= {first} * 6 THEN 'falling_40_plus' WHEN {last} * 10 <= {first} * 9 THEN 'falling_10_40'"
            f" WHEN {last} * 10 >= {first} * 11 THEN 'rising' ELSE 'flat' END")
