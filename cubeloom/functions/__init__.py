"""Cell functions with array semantics: missing values, division, rounding, reducers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def is_na(c: Column) -> Column:
    return c.isNull() | F.coalesce(F.isnan(c.cast("double")), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """a / b where a zero divisor gives Inf, -Inf or NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a), NAN).when(a > 0, INF).when(a < 0, -INF).when(a.isNotNull(), NAN)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(divide(a, b)).cast("double")


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))))


def compare(op: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """A comparison that is missing where either side is."""
    return F.when(~is_na(a) & ~is_na(b), op(a, b))


def log(c: Column, base: float | None = None) -> Column:
    out = F.when(c == 0, -INF).when(c < 0, NAN).otherwise(F.ln(c))
    return out if base is None else out / F.ln(F.lit(base))


def sqrt(c: Column) -> Column:
    return F.when(c < 0, NAN).otherwise(F.sqrt(c))


def signif(c: Column, digits: int = 6) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.rint(c * scale) / scale)


#: Lanczos approximation of the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _at_pole(c: Column) -> Column:
    return (c <= 0) & (c == F.floor(c))


def lgamma(c: Column) -> Column:
    """Log of the absolute gamma function; Inf at its poles."""
    c = c.cast("double")
    x = F.when(c < 0.5, 1 - c).otherwise(c) - 1
    total = F.lit(LANCZOS[0])
    for k, v in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(v) / (x + k)
    t = x + 7.5
    right = 0.5 * F.ln(2 * F.pi()) + (x + 0.5) * F.ln(t) - t + F.ln(total)
    left = F.ln(F.pi()) - F.ln(F.abs(F.sin(F.pi() * c))) - right
    return F.when(_at_pole(c), INF).when(c < 0.5, left).otherwise(right)


def gamma(c: Column) -> Column:
    """The gamma function; NaN at its poles."""
    c = c.cast("double")
    sign = F.when((c < 0) & (F.floor(c) % 2 != 0), -1.0).otherwise(1.0)
    return F.when(_at_pole(c), NAN).otherwise(sign * F.exp(lgamma(c)))


def _polygamma(c: Column, shifted: Column, term: Column) -> Column:
    """A series that holds for large arguments, carried down eight steps."""
    for k in range(8):
        shifted = shifted + term(c + k)
    return shifted


def digamma(c: Column) -> Column:
    """Derivative of lgamma; NaN at the poles."""
    c = c.cast("double")
    x = F.when(c < 0.5, 1 - c).otherwise(c)
    y = x + 8
    z = 1 / (y * y)
    far = F.ln(y) - 0.5 / y - z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z * (F.lit(1 / 240) - z / 132))))
    right = _polygamma(x, far, lambda v: -1 / v)
    return F.when(_at_pole(c), NAN).when(c < 0.5, right - F.pi() * try_cot(c)).otherwise(right)


def try_cot(c: Column) -> Column:
    return F.try_divide(F.cos(F.pi() * c), F.sin(F.pi() * c))


def trigamma(c: Column) -> Column:
    """Second derivative of lgamma; Inf at the poles."""
    c = c.cast("double")
    x = F.when(c < 0.5, 1 - c).otherwise(c)
    y = x + 8
    z = 1 / (y * y)
    far = 1 / y + z / 2 + z / y * (F.lit(1 / 6) - z * (F.lit(1 / 30) - z * (F.lit(1 / 42) - z * (F.lit(1 / 30) - z * 5 / 66))))
    right = _polygamma(x, far, lambda v: 1 / (v * v))
    sine = F.sin(F.pi() * c)
    return F.when(_at_pole(c), INF).when(c < 0.5, F.try_divide(F.pi() * F.pi(), sine * sine) - right).otherwise(right)


#: The math group; round is half to even.
MATH: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sign": F.signum, "sqrt": sqrt, "floor": F.floor, "ceiling": F.ceil,
    "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "round": lambda c, digits=0: F.bround(c, digits), "signif": signif,
    "exp": F.exp, "log": log, "log2": lambda c: log(c, 2), "log10": lambda c: log(c, 10), "expm1": F.expm1,
    "log1p": lambda c: F.when(c == -1, -INF).when(c < -1, NAN).otherwise(F.log1p(c)),
    "cos": F.cos, "sin": F.sin, "tan": F.tan, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cosh": F.cosh, "sinh": F.sinh, "tanh": F.tanh,
    "acosh": F.acosh, "asinh": F.asinh, "atanh": F.atanh,
    "cospi": lambda c: F.cos(c * F.pi()), "sinpi": lambda c: F.sin(c * F.pi()), "tanpi": lambda c: F.tan(c * F.pi()),
    "lgamma": lgamma, "gamma": gamma, "digamma": digamma, "trigamma": trigamma,
}

#: Reducers: (aggregate over present values, result of an empty group once missing values are dropped).
REDUCERS: dict[str, tuple[Callable[[Column], Column], float | None]] = {
    "mean": (F.avg, NAN), "sum": (F.sum, 0.0), "max": (F.max, -INF), "min": (F.min, INF), "var": (F.var_samp, None), "sd": (F.stddev_samp, None),
    "median": (lambda c: F.percentile(c, F.lit(0.5)), None), "prod": (F.product, 1.0), "length": (F.count, 0.0),
}


def reducer(fun: str | Callable[[Column], Column], value: str, cells: int | Column | None, na_rm: bool) -> Column:
    """A reducer with array semantics: missing if any of the ``cells`` is, unless ``na_rm``."""
    if fun == "length":
        return F.lit(cells).cast("double") if cells is not None else F.count(F.lit(1)).cast("double")
    agg, empty = REDUCERS[fun] if isinstance(fun, str) else (fun, None)
    clean = F.when(~is_na(F.col(value)), F.col(value))
    if na_rm:
        return agg(clean) if empty is None else F.coalesce(agg(clean), F.lit(empty))
    whole = F.lit(cells) if cells is not None else F.count(F.lit(1))
    return F.when(F.count(clean) == whole, agg(clean))
