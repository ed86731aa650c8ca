"""Records made of the star schema's tables, with a hierarchy and query columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Frame:
    """Where records come from: SQL over the tables, the same for Spark and an oracle."""

    tables: tuple[str, ...]
    sql: str
    hierarchy: tuple[str, ...]
    queries: tuple[str, ...]

    def records(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.sql, **{t: table(spark, sf_dir, t) for t in self.tables})

    @property
    def oracle(self) -> str:
        """The same records from registered views."""
        return self.sql.format(**{t: t for t in self.tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_GEO = "JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_CUSTOMERS = ("customer", "nation", "region")
CUSTOMERS = Frame(_CUSTOMERS, f"SELECT r_name, n_name, c_mktsegment FROM {{customer}} {_GEO}", ("r_name", "n_name"), ("c_mktsegment",))
ORDERS = Frame(("orders", *_CUSTOMERS), f"SELECT r_name, n_name, o_orderstatus, o_orderpriority FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey {_GEO}", ("r_name", "n_name"), ("o_orderstatus", "o_orderpriority"))
LINEITEMS = Frame(
    ("lineitem", "orders", *_CUSTOMERS),
    f"SELECT r_name, n_name, c_mktsegment, l_returnflag, l_linestatus, o_orderpriority FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey {_GEO}",
    ("r_name", "n_name", "c_mktsegment"),
    ("l_returnflag", "l_linestatus", "o_orderpriority"),
)
SPARSE = Frame(("lineitem",), "SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM {lineitem}", ("l_returnflag", "l_linestatus"), ("l_quantity", "l_discount", "l_tax"))
LABELLED = Frame(("documents", "labels"), "SELECT lang, source, quality, toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", ("lang", "source"), ("quality", "toxic"))
USERS = Frame(("events",), "SELECT CAST(user_id % 10 AS STRING) AS user_bucket, CAST(user_id AS STRING) AS user_id, event_type FROM {events}", ("user_bucket", "user_id"), ("event_type",))
LINES = Frame(("lineitem",), "SELECT l_returnflag, l_linenumber, l_linestatus FROM {lineitem}", ("l_linestatus",), ("l_linenumber", "l_returnflag"))
