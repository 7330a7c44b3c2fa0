"""S1 scan_table: typed scans of the raw parquet tables.

Schemas are fixed here and never inferred. A scan only declares the schema;
column pruning and filter pushdown happen when the consumer selects / filters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", _I), ("r_name", _S)),
    "nation": _st(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D),
                    ("c_mktsegment", _S)),
    "supplier": _st(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                ("p_retailprice", _D)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                  ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                    ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                    ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _st(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D),
                  ("props", _S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Typed full scan of one raw table."""
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(table_path(sf_dir, name))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All raw tables as typed DataFrames (lazy; nothing is read until an action)."""
    return {name: scan(spark, sf_dir, name) for name in RAW_SCHEMAS}
