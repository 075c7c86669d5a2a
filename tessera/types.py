"""Type names of the dialect and their Spark types; collations."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Names of collations in the dialect and in Spark.
COLLATIONS = {"NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM", "BINARY": "UTF8_BINARY"}

# Type names of the dialect, without their lengths, and Spark's.
TYPES = {
    "INT": "INT", "INTEGER": "INT", "INT4": "INT", "BIGINT": "BIGINT", "INT8": "BIGINT", "SMALLINT": "SMALLINT", "INT2": "SMALLINT", "TINYINT": "TINYINT",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "NUMERIC": "DOUBLE", "DECIMAL": "DOUBLE",
    "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN", "BLOB": "BINARY", "VARBINARY": "BINARY", "BINARY": "BINARY", "BYTEA": "BINARY",
    "DATE": "DATE", "TIME": "STRING", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_NTZ",
    "TEXT": "STRING", "CLOB": "STRING", "VARCHAR": "STRING", "CHAR": "STRING", "STRING": "STRING", "VECTOR": "ARRAY<FLOAT>",
}


def spark_type(name: str) -> str:
    """Spark's type for a type name: declared widths and precisions are honoured, other names pass through."""
    m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z]+)?)\s*(?:\(([^)]*)\))?\s*", name)
    if not m:
        return name
    base, size = " ".join(m[1].upper().split()), m[2]
    if base in ("NUMERIC", "DECIMAL") and size:
        return f"DECIMAL({size})"
    return TYPES.get(base, name)


def length_limit(name: str) -> int | None:
    """The greatest number of characters of a VARCHAR(n) or CHAR(n)."""
    m = re.fullmatch(r"\s*(?:VARCHAR|CHAR|STRING)\s*\(\s*(\d+)\s*\)\s*", name, re.IGNORECASE)
    return int(m[1]) if m else None


def data_type(name: str) -> T.DataType:
    return T.DataType.fromDDL(spark_type(name))
