"""Column trees that are built once."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext


def kept(make: Callable[..., Any]) -> Callable[..., Any]:
    """make(*args), which builds Columns over named columns, called once for each Spark context and arguments.

    Each node of a Column is a call to the JVM, and the rules about nodes of a page are thousands of them; as trees they belong to no
    DataFrame and can be used again.
    """
    made: dict[SparkContext | None, dict] = {}

    @functools.wraps(make)
    def get(*args: Any) -> Any:
        context = SparkContext._active_spark_context
        if context not in made:
            made.clear()  # of a context that has ended
            made[context] = {}
        if args not in made[context]:
            made[context][args] = make(*args)
        return made[context][args]

    return get
