"""Two-sided p-value of Student's t as a column expression.

With the angle a = atan(|t| / sqrt(nu)) the p-value is the integral of
cos ** (nu - 1) from a to a quarter turn over the same integral from 0.  Both are
taken by one rule with fixed nodes over the part that carries weight, and the
common factor cos(a) ** (nu - 1) stays apart as a power of 1 + t ** 2 / nu, so
small tails keep their digits.  Cost and formula are the same for every nu >= 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 64
#: Powers of e from which on the integrand carries no weight.
REACH = 40.0


def _relative(tangent: Column, exponent: Column) -> Column:
    """Integral of (cos(a + d) / cos(a)) ** exponent over d, where tan(a) = ``tangent``.

    The logarithm of the integrand falls at least like exponent * (tangent d + d ** 2 / 2).
    """
    scale = 2 * REACH / F.greatest(exponent.cast("double"), F.lit(1e-9))
    end = F.least(F.atan2(F.lit(1.0), tangent), scale / (tangent + F.sqrt(tangent * tangent + scale)))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    rule = F.array(
        *[F.struct(F.lit(float(x + 1) / 2).alias("x"), F.lit(float(w) / 2).alias("w")) for x, w in zip(nodes, weights, strict=True)]
    )

    def step(total: Column, node: Column) -> Column:
        d = end * node["x"]
        half = F.sin(d / 2)
        fall = F.log1p(-2 * half * half - tangent * F.sin(d))
        return total + node["w"] * F.exp(exponent * fall)

    return end * F.aggregate(rule, F.lit(0.0), step)


def two_sided_p(t: Column, nu: Column) -> Column:
    """P(|T| >= |t|) with ``nu`` degrees of freedom; NULL for nu < 1."""
    exponent = nu.cast("double") - 1
    tangent = F.abs(t) / F.sqrt(nu.cast("double"))
    factor = F.exp(-exponent / 2 * F.log1p(tangent * tangent))
    p = factor * _relative(tangent, exponent) / _relative(F.lit(0.0), exponent)
    return F.when(nu.isNotNull() & (nu >= 1) & t.isNotNull(), p)
