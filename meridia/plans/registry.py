"""All queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with equivalent DuckDB SQL if there is any."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


from . import edge_queries, geometry_queries, inventory_queries, mesh_queries, render_queries, report_queries, scene_queries, source_queries, stream_queries, type_queries, vision_queries, workflow_queries  # noqa: E402, F401
