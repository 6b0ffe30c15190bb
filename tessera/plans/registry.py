"""Registered queries: a name, how Spark runs it, and the SQL that another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import compat
from ..session import load_views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    run: Run
    oracle: str | None


class Family:
    """Queries of one family of operators."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def sql(self, name: str, text: str, oracle: str | None = "") -> None:
        """A query in SQL; ``oracle`` is its text for the checking engine if that differs, None if there is none."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            compat.register(spark)
            load_views(spark, sf_dir, text)
            return spark.sql(text)

        self._add(name, run, text if oracle == "" else oracle)

    def frame(self, name: str, oracle: str | None) -> Callable[[Run], Run]:
        """A query in DataFrame operations: ``run(spark, sf_dir)``."""

        def add(run: Run) -> Run:
            def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
                compat.register(spark)
                return run(spark, sf_dir)

            self._add(name, prepared, oracle)
            return run

        return add

    def _add(self, name: str, run: Run, oracle: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = Query(name, run, oracle)
