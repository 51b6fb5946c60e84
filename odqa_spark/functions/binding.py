"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside the function of ``transform``, ``filter`` or
    ``exists`` is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(value: Column) -> Column:
    """``value``, kept in the projection it is written in.

    Spark inlines a column that is used once into its consumer. If the consumer is
    a Python UDF and the column has nested lambda functions, where the inner one
    uses a variable of the outer one, the planner then fails to run the UDF in
    Python. A value that is not deterministic to the optimizer is never inlined.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
