"""Every registered query of the library, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import builds, curves, fuzzy, library, lines, live, nearby, places, roads, routes, scalars, search, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**tracks.QUERIES, **places.QUERIES, **library.QUERIES, **scalars.QUERIES, **routes.QUERIES, **fuzzy.QUERIES, **search.QUERIES, **lines.QUERIES, **roads.QUERIES, **builds.QUERIES, **nearby.QUERIES, **live.QUERIES, **curves.QUERIES}
ORACLE: dict[str, str] = {**tracks.ORACLE, **places.ORACLE, **library.ORACLE, **scalars.ORACLE, **routes.ORACLE, **fuzzy.ORACLE, **search.ORACLE, **lines.ORACLE, **roads.ORACLE, **builds.ORACLE, **nearby.ORACLE, **live.ORACLE, **curves.ORACLE}
FLAGSHIP = "ride_totals"
