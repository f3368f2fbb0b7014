"""Registers queries with their SQL, and binds the domain's tables to the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import parts


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


class Tables:
    """The driver's tables by name, and what the domain makes of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cites(self) -> DataFrame:
        """Distinct links of orders (citing) to parts (cited)."""
        return self.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()

    def graph(self) -> DataFrame:
        """Distinct links of each part to the next one of an order, without loops."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        rows = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        n = parts(self.lineitem)
        linked = rows.repartition(n, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst")
        return linked.repartition(n, "src", "dst").distinct()


CITES = "cites AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
GRAPH = "graph AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"
