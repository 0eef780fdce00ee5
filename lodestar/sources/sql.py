"""SQL as a source of plans: text or files over the catalog's views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.catalog import register_views


#: Texts, quoted names and comments, in which a semicolon ends nothing.
_PART = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", re.S)


def statements(text: str) -> list[str]:
    """The statements of a text that semicolons separate; those that hold comments alone are left out."""
    out, held, real = [], [], False
    for m in [*_PART.finditer(text), None]:
        if m is None or m[0] == ";":
            if real:
                out.append("".join(held).strip())
            held, real = [], False
            continue
        held.append(m[0])
        real |= not m[0].startswith(("--", "/*")) and not m[0].isspace()
    return out


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Any Spark SQL over the tables of a directory; several statements may be separated by semicolons, the last gives the result."""
    register_views(spark, sf_dir)
    result = None
    for statement in statements(text):
        result = spark.sql(statement)
    if result is None:
        raise ValueError("no statement")
    return result


def run_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """A query from a local file."""
    with open(path, encoding="utf-8") as f:
        return run_sql(spark, sf_dir, f.read())
