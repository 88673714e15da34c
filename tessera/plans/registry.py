"""Query registry: each bound query has a Spark builder and (optionally) an
independent DuckDB SQL oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class BoundQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ops: str
    bench: bool = True


REGISTRY: dict[str, BoundQuery] = {}


def query(name: str, ops: str, oracle: str | None = None, bench: bool = True):
    def deco(fn):
        REGISTRY[name] = BoundQuery(name, fn, oracle, ops, bench)
        return fn
    return deco
