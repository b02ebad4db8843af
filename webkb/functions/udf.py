"""Pandas and Arrow UDFs that are made when they are first called, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


def array_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Likewise, of a function of Arrow arrays."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.arrow_udf(f, kind)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap
