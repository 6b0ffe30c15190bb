"""Session settings and the loading of tables as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
}


def build(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` override them (dots written as double underscores)."""
    make = SparkSession.builder.master(master).appName("tessera")
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        make = make.config(key, value)
    return make.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Make the tables that ``sql`` names visible as temporary views.

    The session keeps the folder that each view stands for, so that a table's footer is read once.
    """
    if not hasattr(spark, "_tessera_views"):
        spark._tessera_views = {}
    for name in set(re.findall(r"\w+", sql)) & set(TABLES):
        if spark._tessera_views.get(name) != sf_dir:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
            spark._tessera_views[name] = sf_dir
