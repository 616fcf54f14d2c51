"""Numbers without a statistics library: the binomial tail, the GC verdict, text of doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def binomial_above(n: int, p: float, k: int) -> float:
    """P(X > k) for Binomial(n, p); 1 where p is no proper probability."""
    if n == 0 or p <= 0 or p >= 1:
        return 1.0
    return incomplete_beta(k + 1, n - k, p) if k < n else 0.0


def gc_summary(bins: Sequence[float]) -> tuple[float, float, float, list[float]]:
    """Mode, standard deviation, deviation from the normal curve in percent, and that curve, of 101 bins."""
    total, top = math.fsum(bins), max(range(101), key=lambda k: (bins[k], -k))
    near = lambda k: bins[k] > bins[top] - bins[top] / 10
    up = next((k for k in range(top, 101) if not near(k)), None)
    down = next((k for k in range(top - 1, -1, -1) if not near(k)), None)
    if up is None or down is None:  # the peak runs off the scale
        mode = float(top)
    else:
        mode = sum(range(down + 1, up)) / (up - down - 1)
    if total <= 1:
        return mode, math.nan, math.nan, [math.nan] * 101
    stdev = math.sqrt(max(0.0, math.fsum((k - mode) ** 2 * n for k, n in enumerate(bins)) / (total - 1)))
    if stdev == 0:
        return mode, 0.0, math.nan, [math.nan] * 101
    curve = [total / math.sqrt(2 * math.pi * stdev * stdev) * math.exp(-((k - mode) ** 2) / (2 * stdev * stdev)) for k in range(101)]
    return mode, stdev, 100 * math.fsum(abs(c - n) for c, n in zip(curve, bins, strict=True)) / total, curve


def double_text(x: float) -> str:
    """Shortest digits; plain between 1e-3 and 1e7, else with an exponent; always with a decimal point."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    digits = repr(abs(x))
    mantissa, _, power = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    exponent = int(power or 0) + len(whole) - 1
    all_digits = (whole + part).lstrip("0")
    exponent -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if 1e-3 <= abs(x) < 1e7:
        if exponent >= 0:
            all_digits = all_digits.ljust(exponent + 1, "0")
            return f"{sign}{all_digits[: exponent + 1]}.{all_digits[exponent + 1 :] or '0'}"
        return f"{sign}0.{'0' * (-exponent - 1)}{all_digits}"
    return f"{sign}{all_digits[0]}.{all_digits[1:] or '0'}E{exponent}"


def base_total(n: int) -> str:
    """n bp, kbp, Mbp or Gbp, cut (not rounded) to one decimal, which is left out if 0."""
    for unit, size in (("Gbp", 10**9), ("Mbp", 10**6), ("kbp", 10**3)):
        if n >= size:
            tenths = n * 10 // size
            return f"{tenths // 10}.{tenths % 10} {unit}" if tenths % 10 else f"{tenths // 10} {unit}"
    return f"{n} bp"
