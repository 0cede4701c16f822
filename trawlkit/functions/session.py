"""Column expressions that are costly to build, kept for the length of a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def per_session(build):
    """``build`` (hashable arguments to a column), called once for each application and arguments.

    A column names its inputs only, so one may serve in any number of frames.
    """
    held: dict[tuple, object] = {}

    @functools.wraps(build)
    def found(*args):
        session = SparkSession.getActiveSession()
        key = (session.sparkContext.applicationId if session else None, *args)
        if key not in held:
            held[key] = build(*args)
        return held[key]

    return found


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is read; inside a lambda nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
