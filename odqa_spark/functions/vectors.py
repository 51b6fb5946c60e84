"""Vector expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from odqa_spark.functions.binding import let

# Fixed value: smallest norm a vector is divided by.
NORM_FLOOR = 1e-12


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def finite(vec: Column) -> Column:
    """No part is null, NaN or infinite."""
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def squared_norm(vec: Column) -> Column:
    return _sum(F.transform(vec, lambda x: x * x))


def l2_normalize(vec: Column) -> Column:
    norm = F.greatest(F.sqrt(squared_norm(vec)), F.lit(NORM_FLOOR))
    return let(norm, lambda n: F.transform(vec, lambda x: x / n))


def with_aux_dim(vec: Column, phi: Column) -> Column:
    """Append ``sqrt(phi - |vec|^2)``: turns inner-product order into distance order."""
    return F.concat(vec, F.array(F.sqrt(F.greatest(phi - squared_norm(vec), F.lit(0.0)))))


def masked_mean(hidden: Column, mask: Column) -> Column:
    """Mean over the token vectors whose mask is not 0; null when none is set."""
    kept = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] != 0)
    vectors = F.transform(kept, lambda t: t["h"])
    total = F.aggregate(
        vectors,
        F.transform(F.element_at(hidden, 1), lambda _: F.lit(0.0)),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    count = _sum(F.transform(mask, lambda m: m.cast("double")))
    return let(count, lambda n: F.when(n > 0, F.transform(total, lambda x: x / n)))
