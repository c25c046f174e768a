"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectrove.plans import collections, named, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**collections.QUERIES, **relational.QUERIES, **named.QUERIES}
ORACLE_SQL: dict[str, str] = {**collections.ORACLE_SQL, **relational.ORACLE_SQL, **named.ORACLE_SQL}
