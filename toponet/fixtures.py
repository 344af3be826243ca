"""Spark side of the derived views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixture_sql import FIXTURE_SQL
from .operators.numbering import dense_ids_on_key
from .session import shorten_plans

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


class Views:
    """Lazy access to base tables and derived views of one data folder.

    ``views.places`` is the ``fx_places`` view, ``views.table("part")`` a base
    table. Nothing is read until an action runs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        shorten_plans(spark)

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"fx_{name}" not in FIXTURE_SQL:
            raise AttributeError(name)
        key = f"fx_{name}"
        if key not in self._made:
            special = {"submissions": self._submissions, "lot_vertices": self._lot_vertices}
            made = special.get(name, lambda: self._view(key))
            self._made[key] = made()
        return self._made[key]

    def _view(self, key: str) -> DataFrame:
        sql = FIXTURE_SQL[key]
        for other in FIXTURE_SQL:
            if other != key and f"{other} " in sql.replace("\n", " "):
                getattr(self, other[3:]).createOrReplaceTempView(other)
        for base in BASE_TABLES:
            if re.search(rf"\b{base}\b", sql):
                self.table(base).createOrReplaceTempView(base)
        return self.spark.sql(sql)

    def _lot_vertices(self) -> DataFrame:
        """``fx_lot_vertices`` with its four corners exploded instead of cross joined."""
        head = FIXTURE_SQL["fx_lot_vertices"].split("from nation cross join")[0]
        corners = [(0.0005, 0.0005), (0.0031, 0.0007), (0.0029, 0.0033), (0.0003, 0.0027)]
        rows = ", ".join(
            f"named_struct('i', {i}, 'dlat', {a}D, 'dlng', {b}D)" for i, (a, b) in enumerate(corners)
        )
        self.table("nation").createOrReplaceTempView("nation")
        return self.spark.sql(f"{head} from nation lateral view inline(array({rows})) v as i, dlat, dlng")

    def _submissions(self) -> DataFrame:
        """``fx_submissions`` with its running id numbered per order key.

        The SQL text numbers all rows in one window, which would sort the table
        in one task; ``dense_ids_on_key`` yields the same numbers order by order.
        """
        order = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_quantity".split()
        rows = self._queue_rows(order)
        numbered = dense_ids_on_key(rows, order, "l_orderkey", 1 << 14, "id")
        return numbered.select("id", *[c for c in rows.columns if c not in order])

    def submission_rows(self) -> DataFrame:
        """``fx_submissions`` without its id, for steps that don't ask for it."""
        return self._queue_rows([])

    def _queue_rows(self, order: list[str]) -> DataFrame:
        """The rows of ``fx_submissions`` and the columns ``order``, dealt out by order key.

        Orders meet their place first, so that line items are shuffled once. Places don't go
        through the driver: their computed columns are far larger than Spark's estimate.
        """
        head, tail = FIXTURE_SQL["fx_submissions"].split("cast(row_number()", 1)
        chosen, source = tail.split("as bigint) id,", 1)[1].split("\nfrom ", 1)
        joined = "lineitem join orders on l_orderkey = o_orderkey join fx_places p on p.place_id = o_custkey"
        if source.strip() != joined:
            raise ValueError("fx_submissions reads other tables than this plan")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        placed = orders.join(self.places.hint("merge"), F.col("place_id") == F.col("o_custkey"))
        placed.hint("merge").createOrReplaceTempView("fx_placed_orders")
        self.table("lineitem").createOrReplaceTempView("lineitem")
        columns = "".join(f"{c}, " for c in order)
        return self.spark.sql(f"{head} {columns}{chosen} from lineitem join fx_placed_orders p on l_orderkey = p.o_orderkey")


def table_columns(df: DataFrame, prefix: str) -> list:
    """All columns of ``df`` renamed with a prefix, for self joins."""
    return [F.col(c).alias(f"{prefix}{c}") for c in df.columns]
