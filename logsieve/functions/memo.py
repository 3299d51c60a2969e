"""Column expressions are built once per Spark context: building them is what takes time."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext


def per_session(build):
    """Cache the columns ``build`` returns for as long as the Spark context lives."""
    kept: dict = {}

    @wraps(build)
    def wrapper(*args):
        context = SparkContext._active_spark_context
        if kept.get("context") is not context:
            kept.clear()
            kept["context"] = context
        if args not in kept:
            kept[args] = build(*args)
        return kept[args]

    return wrapper
