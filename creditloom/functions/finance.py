"""Loan arithmetic as Column expressions. Rates are annual percent, FOIR and LTV percent, DSCR a ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEWTON_STEPS = 14


def emi(principal: Column, rate_pct: Column, months: Column) -> Column:
    """Level instalment in arrears; NULL for a non-positive term or a negative principal."""
    r = rate_pct.cast("double") / 1200.0
    p, n = principal.cast("double"), months.cast("double")
    growth = F.exp(n * F.log1p(r))
    value = F.when(r == 0, p / n).otherwise(p * r * growth / F.nullif(growth - 1.0, F.lit(0.0)))
    return F.when((months > 0) & (principal >= 0), value)


def apr_sql(principal: str, fees: str, instalment: str, months: str) -> str:
    """Nominal annualised IRR in percent of ``principal - fees`` repaid by level instalments.

    The present value of the instalments is convex and decreasing in the monthly rate, so Newton's method started at
    or left of the root climbs to it without overshooting. By Jensen's inequality the rate that solves
    ``pay * n * (1 + r) ** (-(n + 1) / 2) = net`` is such a start and lies close to the root for any real loan. The
    search is one higher-order aggregate per row: no UDF, no join, no driver loop. NULL when the inputs are no loan.
    """
    net, pay, n = f"CAST({principal} - {fees} AS DOUBLE)", f"CAST({instalment} AS DOUBLE)", f"CAST({months} AS DOUBLE)"
    # expm1/log1p keep full precision near zero; the series form covers a rate of exactly zero
    pv = "a.pay * (-expm1(-a.n * log1p(a.r))) / a.r"
    slope = "a.pay * (a.n * exp(-a.n * log1p(a.r)) * a.r / (1D + a.r) + expm1(-a.n * log1p(a.r))) / (a.r * a.r)"
    step = (f"CASE WHEN abs(a.r) < 1e-9D THEN a.r + (a.pay * a.n * (1D - a.r * (a.n + 1D) / 2D) - a.net)"
            f" / (a.pay * a.n * (a.n + 1D) / 2D) ELSE a.r - ({pv} - a.net) / ({slope}) END")
    start = (f"named_struct('r', power({pay} * {n} / {net}, 2D / ({n} + 1D)) - 1D, 'pay', {pay}, 'n', {n}, 'net', {net})")
    return (f"CASE WHEN {net} > 0 AND {pay} > 0 AND {n} > 0 THEN aggregate(sequence(1, {_NEWTON_STEPS}), {start},"
            f" (a, i) -> named_struct('r', {step}, 'pay', a.pay, 'n', a.n, 'net', a.net), a -> 1200D * a.r) END")


def apr(principal: str, fees: str, instalment: str, months: str) -> Column:
    return F.expr(apr_sql(principal, fees, instalment, months))


def foir(total_emi: Column, income: Column) -> Column:
    return F.when(income > 0, 100.0 * total_emi.cast("double") / F.nullif(income.cast("double"), F.lit(0.0)))


def ltv(loan: Column, value: Column) -> Column:
    return F.when(value > 0, 100.0 * loan.cast("double") / F.nullif(value.cast("double"), F.lit(0.0)))


def dscr(accruals: Column, debt: Column) -> Column:
    """No debt service is unlimited cover."""
    return F.when(debt == 0, F.lit(float("inf"))).when(
        debt > 0, accruals.cast("double") / F.nullif(debt.cast("double"), F.lit(0.0))
    )
