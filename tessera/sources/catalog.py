"""Tables by Parquet path, declared-schema delimited files, keyword text, in-memory rows, and the sampling text sink."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

#: The declared schema of a delimited lineitem file: fixed values of the file format.
LINEITEM_FIELDS = [
    ("l_orderkey", "int"),
    ("l_partkey", "int"),
    ("l_suppkey", "int"),
    ("l_linenumber", "int"),
    ("l_quantity", "decimal(15,2)"),
    ("l_extendedprice", "decimal(15,2)"),
    ("l_discount", "decimal(15,2)"),
    ("l_tax", "decimal(15,2)"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "date"),
    ("l_commitdate", "date"),
    ("l_receiptdate", "date"),
    ("l_shipinstruct", "string"),
    ("l_shipmode", "string"),
    ("l_comment", "string"),
]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, root: str, names: Iterable[str] = TABLES) -> None:
    """Temp views over the Parquet tables, for ``spark.sql``."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def view_name(path: str) -> str:
    """A path as the name of a view."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", path)


def delimited(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], sep: str = "|", view: str | None = None) -> DataFrame:
    """A delimited text table with a declared schema (nothing is inferred, no extra pass). ``view`` also names it for SQL; a path works as a name in quotes, with what no name may hold written as '_'
    (``view_name``)."""
    df = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in fields)).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    if view:
        df.createOrReplaceTempView(f"`{view_name(view)}`")
    return df


def keyword_rows(lines: DataFrame, sep: str = "|") -> DataFrame:
    """``value`` lines of the form id|word|word... to (id, keywords). Trailing empty fields go, as they carry no keyword."""
    parts = F.split(F.regexp_replace("value", f"[{sep}]+$", ""), f"[{sep}]")
    return lines.select(parts.alias("p")).select(F.element_at("p", 1).alias("id"), F.expr("slice(p, 2, greatest(size(p) - 1, 0))").alias("keywords"))


def keyword_text(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Keyword text from any Hadoop URI."""
    return keyword_rows(spark.read.text(path), sep)


def keyword_list(spark: SparkSession, rows: Iterable[tuple[str, Sequence[str]]]) -> DataFrame:
    """In-memory points."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))])
    return spark.createDataFrame([(i, list(k)) for i, k in rows], schema)


def sample_text(spark: SparkSession, source: str, target: str, fraction: float, seed: int | None = None, files: int | None = 1) -> None:
    """Write a sample of text lines, without replacement. One file is the feature's default; ``files=None`` keeps the input's partitions, which a large sample needs."""
    lines = spark.read.text(source).sample(False, fraction, seed)
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(target)
