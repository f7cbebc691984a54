"""Arrow functions that are made on call, so that modules can be imported without a session (as on executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of pandas Series as a column function with that result."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap
