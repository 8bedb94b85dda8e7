"""The parsing and text functions for spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from listinglens.functions import parse as P
from listinglens.functions import text as X

#: SQL name, Column function.
FUNCTIONS = {
    "normalize_url": P.normalize_url,
    "parse_money": P.parse_money,
    "parse_int_text": P.parse_int,
    "scrub_phone_numbers": P.scrub_pii,
    "normalize_string": P.normalize_string,
    "room_count": P.room_count,
    "floor_value": P.floor_value,
    "furnished_flag": P.furnished_flag,
    "path_key": P.path_key,
    "collapse_ws": X.collapse_ws,
    "ascii_fold": X.ascii_fold,
    "clean_text": X.clean_text,
}


def register(spark: SparkSession) -> list[str]:
    """Publish FUNCTIONS as temporary SQL functions of one text argument; they are expressions, not Python at run time."""
    for name, function in FUNCTIONS.items():
        body = spark.range(0).select(F.lit("").alias("value")).select(function(F.col("value")).alias("x"))
        sql = body._jdf.queryExecution().analyzed().expressions().head().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURN {sql.split(' AS x')[0].replace('`value`', 'value')}")
    return sorted(FUNCTIONS)
