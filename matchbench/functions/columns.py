"""Column builders: similarities, labels, hashes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of both sides over their norms, each raised by 1e-12."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def chi2(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y) where x + y > 0."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))


def unit(a: Column, least: float = 1e-8) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x / n)


def concat_features(*parts: Column) -> Column:
    return F.concat(*[unit(p) for p in parts])


def condition(yaw: Column, illumination: Column) -> Column:
    """``yaw+15_dark``: signed yaw without decimals, and the illumination."""
    return F.concat(F.lit("yaw"), F.format_string("%+d", F.bround(yaw).cast("long")), F.lit("_"), F.coalesce(illumination, F.lit("NA")))


def anonymous(subject: Column) -> Column:
    """S and eight decimal digits from the first eight hexadecimal digits of the id's hash."""
    digits = F.transform(F.split(F.substring(F.sha2(subject, 256), 1, 8), ""), lambda c: (F.conv(c, 16, 10).cast("int") % 10).cast("string"))
    return F.concat(F.lit("S"), F.array_join(digits, ""))


def hash32(x: Column) -> Column:
    """An integer below 2^32, equal in every engine that has md5."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def seed_of(*parts: str) -> Column:
    """A seed below 2^32 from the names of an experiment's parts."""
    return F.conv(F.substring(F.sha2(F.lit("|".join(parts)), 256), 1, 8), 16, 10).cast("long")


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def to_uint8(x: Column) -> Column:
    """Half-even rounding of the value clipped to [0, 1], times 255."""
    return F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def normal_deviate(p: Column) -> Column:
    """Quantile of the standard normal distribution for p clipped to [1e-5, 1 - 1e-5] (rational
    approximation in three regions, relative error below 1.2e-9)."""
    # Coefficients of a published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(k, x):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    p = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    q, t, u = p - 0.5, F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, poly(c, t) / poly(d, t)).when(p > 1 - 0.02425, -poly(c, u) / poly(d, u)).otherwise(q * poly(a, q * q) / poly(b, q * q))


#: Similarities by name, higher for the same person.
SIMILARITIES = {
    "cosine": cosine,
    "l2": lambda a, b: -l2(a, b),
    "chi2": lambda a, b: -chi2(a, b),
}
