"""Personal data: annotations in column metadata, export of all that concerns a subject, inspection, strict mode."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("personal", "sensitive", "special")
_KEY = "personal_data"


def annotate(df: DataFrame, **levels: str) -> DataFrame:
    """Marks columns as personal data, with a level."""
    for c, level in levels.items():
        if level not in LEVELS:
            raise ValueError(f"level must be one of {LEVELS}")
        df = df.withMetadata(c, {**df.schema[c].metadata, _KEY: level})
    return df


def personal_fields(df: DataFrame) -> dict[str, str]:
    return {x.name: x.metadata[_KEY] for x in df.schema.fields if _KEY in x.metadata}


def subject_rows(tables: dict[str, tuple[DataFrame, str]], subject) -> DataFrame:
    """collection and document (JSON) of every row whose field equals the subject; tables: name -> (rows, field)."""
    if not tables:
        raise ValueError("no collections")
    parts = [df.where(F.col(field) == F.lit(subject)).select(F.lit(name).alias("collection"), F.to_json(F.struct(*df.columns)).alias("document")) for name, (df, field) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def subject_counts(tables: dict[str, tuple[DataFrame, str]], subject, spark) -> DataFrame:
    """Rows of the subject per collection, 0 included."""
    names = spark.createDataFrame([(n,) for n in tables], "collection string")
    found = subject_rows(tables, subject).groupBy("collection").agg(F.count("*").alias("n"))
    return names.join(found, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, so that each is one cell."""
    nested = {c for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))


def inspect(spark, tables: dict[str, DataFrame], policies: Sequence[str] = ()) -> DataFrame:
    """A row per collection: fields, personal fields, whether it has a retention policy."""
    rows = [(name, len(df.columns), ",".join(sorted(personal_fields(df))), name in policies) for name, df in tables.items()]
    return spark.createDataFrame(rows, "collection string, fields int, personal string, retained boolean")


def strict(spark, tables: dict[str, DataFrame], policies: Sequence[str] = (), audited: bool = False) -> list[str]:
    """Fails where tables aren't encrypted; returns, and warns of, what else strict handling of personal data lacks."""
    if not spark.sparkContext._jsc.hadoopConfiguration().get("parquet.crypto.factory.class"):
        raise RuntimeError("strict mode needs encrypted tables: set parquet.crypto.factory.class")
    lacking = [] if audited else ["no audit log is set"]
    lacking += [f"{name} has personal data ({', '.join(sorted(p))}) and no retention policy" for name, df in tables.items() if (p := personal_fields(df)) and name not in policies]
    for x in lacking:
        warnings.warn(x, stacklevel=2)
    return lacking
