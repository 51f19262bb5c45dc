"""Tail probabilities in SQL by Simpson's rule over the density, a way that shares nothing with the folds of `functions.tails`."""

from __future__ import annotations

STEPS = 2000


def simpson(density: str, top: str) -> str:
    """Integral of density (of u) from 0 to top."""
    weight = f"CASE WHEN own_k = 0 OR own_k = {STEPS} THEN 1 WHEN own_k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({top}) / {3 * STEPS} * list_sum(list_transform(range(0, {STEPS + 1}), lambda own_k: ({weight}) * ({density.replace('{u}', f'(({top}) * own_k / {STEPS})')}))))"


def normal_two_sided(x: str) -> str:
    return f"(1 - 2 * {simpson('exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'abs({x})')})"


def t_upper(x: str, freedom: str) -> str:
    """Chance of a larger t value; the density over the angle whose tangent is t / sqrt(freedom), which ends at a right angle."""
    half = simpson(f"cos({{u}}) ** ({freedom} - 1)", f"atan(({x}) / sqrt({freedom}))")
    return f"(0.5 - exp(lgamma(({freedom} + 1) / 2.0) - lgamma({freedom} / 2.0)) / sqrt(pi()) * {half})"


def chi2_upper(x: str, freedom: str) -> str:
    """The density over the square root."""
    return f"(1 - {simpson(f'2 * {{u}} ** ({freedom} - 1) * exp(-{{u}} * {{u}} / 2)', f'sqrt({x})')} / (2 ** ({freedom} / 2.0) * gamma({freedom} / 2.0)))"


def f_upper(x: str, top: str, bottom: str) -> str:
    """The beta density over the angle whose sine squared is bottom / (bottom + top x)."""
    angle = f"asin(sqrt({bottom} / ({bottom} + {top} * ({x}))))"
    log_beta = f"(lgamma({bottom} / 2.0) + lgamma({top} / 2.0) - lgamma(({bottom} + {top}) / 2.0))"
    return f"({simpson(f'2 * sin({{u}}) ** ({bottom} - 1) * cos({{u}}) ** ({top} - 1)', angle)} / exp({log_beta}))"
