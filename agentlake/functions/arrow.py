"""Arrow UDFs that are made when first applied, so importing them needs no Spark session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str) -> Callable:
    """``pandas_udf`` with its result type as DDL."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def apply(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return apply

    return decorate
