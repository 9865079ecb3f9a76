"""The legacy text form of seqlets, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_seqlet() -> Column:
    rc = F.when(F.col("is_revcomp"), "True").otherwise("False")
    return F.concat(F.lit("example:"), F.col("example_idx").cast("string"), F.lit(",start:"), F.col("start_pos").cast("string"), F.lit(",end:"), F.col("end_pos").cast("string"), F.lit(",rc:"), rc)


def parse_seqlet(rows: DataFrame, line: str, *keep: str) -> DataFrame:
    """example_idx, start_pos, end_pos, is_revcomp of each line, after the columns to keep."""
    part = lambda name: F.regexp_extract(line, rf"(?:^|,){name}:([^,]*)", 1)
    return rows.select(*keep, part("example").cast("bigint").alias("example_idx"), part("start").cast("int").alias("start_pos"), part("end").cast("int").alias("end_pos"), (part("rc") == "True").alias("is_revcomp"))
