"""Functions that Spark lacks, as SQL functions that are expanded inside the JVM, and pattern translators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.patterns import glob_to_regex, strftime_to_pattern

_SUM = "aggregate({}, CAST(0 AS DOUBLE), (t, x) -> t + x)"
_SAME = "IF(size({{a}}) = size({{b}}), {}, CAST(raise_error('vectors differ in length') AS DOUBLE))"
_DOT = _SUM.format("zip_with({a}, {b}, (x, y) -> x * y)")
_NORMS = " * ".join("sqrt(" + _SUM.format(f"transform({{{v}}}, x -> x * x)") + ")" for v in "ab")

#: name -> (parameters, return type, body). Vectors are read as doubles before any arithmetic.
SQL_FUNCTIONS = {
    "l2_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SAME.format("sqrt(" + _SUM.format("zip_with({a}, {b}, (x, y) -> (x - y) * (x - y))") + ")")),
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SAME.format(f"coalesce(try_divide({_DOT}, {_NORMS}), 0D)")),
    "fts_match": ("a STRING, b STRING", "BOOLEAN", "contains(lower({a}), lower({b}))"),
}


def inline(name: str, a: str, b: str) -> str:
    """A call as a plain expression, which may stand where Spark takes no SQL function, such as ORDER BY."""
    kinds = [x.split(" ", 1)[1] for x in SQL_FUNCTIONS[name][0].split(", ")]
    return "(" + SQL_FUNCTIONS[name][2].format(a=f"CAST({a} AS {kinds[0]})", b=f"CAST({b} AS {kinds[1]})") + ")"


def register_functions(spark: SparkSession) -> None:
    """Define the SQL functions in the session; repeated calls replace them."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body.format(a='a', b='b')}")


__all__ = ["SQL_FUNCTIONS", "inline", "glob_to_regex", "register_functions", "strftime_to_pattern"]
