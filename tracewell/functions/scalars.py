"""Column helpers built from native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import constants as K


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or null."""
    return F.when(cond, 1).otherwise(0)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def ratio3(num: Column, den: Column) -> Column:
    """Half-even rounding to three digits."""
    return F.bround(num / den, 3)


def safe_div(num: Column, den: Column) -> Column:
    """num/den as double, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(
        num.cast("double") / F.when(den == 0, None).otherwise(den))


def last_segment(user: Column) -> Column:
    return F.element_at(F.split(user, ":"), -1)


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to timestamp, null when it does not parse."""
    return F.try_to_timestamp(text)


def severity_band(score: Column, floor: str = "NONE") -> Column:
    """Label of the highest band reached."""
    expr = F.lit(floor)
    for label, low in reversed(K.SEVERITY_BANDS):
        expr = F.when(score >= low, label).otherwise(expr)
    return expr


def wilson_lb(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval, 0 for n = 0."""
    n_ = F.when(n == 0, None).otherwise(n).cast("double")
    p = k / n_
    centre = p + F.lit(z * z) / (2 * n_)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n_ + F.lit(z * z) / (4 * n_ * n_))
    return F.coalesce(F.greatest(F.lit(0.0), (centre - spread) / (1 + F.lit(z * z) / n_)), F.lit(0.0))


def subsequence_match(observed: Column, pattern: list[str]) -> Column:
    """True when the pattern occurs in the array in order, gaps allowed."""
    pat = F.array(*[F.lit(t) for t in pattern])
    end = F.aggregate(
        observed, F.lit(0),
        lambda pos, x: pos + F.when(F.get(pat, pos) == x, 1).otherwise(0))
    return end == len(pattern)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to integer; null when it is not one."""
    part = [F.split_part(ip, F.lit("."), F.lit(i)) for i in (1, 2, 3)]
    # The pattern lets a line end stand behind the quad.
    part.append(F.regexp_extract(F.split_part(ip, F.lit("."), F.lit(4)), r"^\d+", 0))
    a, b, c, d = (p.cast("bigint") for p in part)
    return F.when(ip.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), a * (1 << 24) + b * (1 << 16) + c * (1 << 8) + d)


def in_network(ip: Column, network: str) -> Column:
    """Membership of an address in a CIDR block, false for anything unparseable.

    A block is a range of values per octet, so it is one pattern.
    """
    base, bits = network.split("/")
    octets = []
    for i, low in enumerate(int(p) for p in base.split(".")):
        width = 1 << min(8, max(0, 8 * (i + 1) - int(bits)))
        low = low // width * width
        octets.append(_OCTET if width == 256 else "(?:" + "|".join(
            f"0{{0,{3 - len(str(v))}}}{v}" for v in range(low, low + width)) + ")")
    return F.coalesce(ip.rlike("^" + r"\.".join(octets) + "$"), F.lit(False))


def register_sql_functions(spark: SparkSession) -> None:
    """Offer the reusable helpers to SQL users."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION subsequence_match(seq ARRAY<STRING>, pat ARRAY<STRING>)
        RETURNS BOOLEAN
        RETURN aggregate(seq, 0, (p, x) -> IF(get(pat, p) = x, p + 1, p)) = size(pat)""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION wilson_lb(k BIGINT, n BIGINT)
        RETURNS DOUBLE
        RETURN CASE WHEN n = 0 THEN 0D ELSE greatest(0D,
          (k/n + 1.96D*1.96D/(2*n)
           - 1.96D*sqrt((k/n)*(1-k/n)/n + 1.96D*1.96D/(4D*n*n))) / (1 + 1.96D*1.96D/n)) END""")
