"""Text formats: peaks (BED), motif databases (MEME), TOMTOM tables; and their writers.

Writers take ordered tables. A file that must be one file is written by one task: patterns are few; seqlets are capped
per metacluster, which bounds it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..operators import seqlets as S

DATATYPES = ("PFM", "CWM", "hCWM", "CWM-PFM", "hCWM-PFM")


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos, score (column 5 where there is one), ord: the line's place in the file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord")).where("value <> ''")
    f = F.split("value", "\t")
    return lines.select(f[0].alias("chrom"), f[1].cast("bigint").alias("start_pos"), f[2].cast("bigint").alias("end_pos"), F.try_element_at(f, F.lit(5)).alias("score"), "ord")


def parse_meme(text: str) -> list[tuple[str, list[list[float]]]]:
    """(name, rows of four) of every motif of a MEME file; the name is the whole rest of its line."""
    found, rows, name = [], None, None
    for line in text.splitlines():
        if line.startswith("MOTIF"):
            name = line[5:].strip()
        elif line.startswith("letter-probability matrix"):
            rows = []
            found.append((name, rows))
        elif rows is not None and re.fullmatch(r"\s*(?:[-+.\deE]+\s+){3}[-+.\deE]+\s*", line):
            rows.append([float(x) for x in line.split()])
        elif rows:
            rows = None
    return found


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """name, width, pwm array<array<double>> from MEME files."""
    parse = F.udf(parse_meme, "array<struct<name:string,pwm:array<array<double>>>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(parse("value")).alias("m"))
    return rows.select("m.name", F.size("m.pwm").alias("width"), "m.pwm")


def read_tomtom(spark: SparkSession, path: str) -> DataFrame:
    """target and q-value (columns 1 and 5) of a TOMTOM table; # starts a comment."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    return rows.select(F.col(rows.columns[1]).alias("target"), F.col(rows.columns[5]).cast("double").alias("qvalue"))


def read_tomtom_tables(spark: SparkSession, path: str) -> DataFrame:
    """query, target, qval, place of all tables `<query>.tomtom.tsv` under path, files or folders of parts, in the order of
    their lines; the query's name comes from the file's path, and a table without matches gives no rows."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    named = rows.withColumn("_query", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.tomtom\.tsv(?:/[^/]*)?$", 1))
    found = named.select(F.col("_query").alias("query"), F.trim(rows.columns[1]).alias("target"), F.col(rows.columns[5]).cast("double").alias("qval"), F.monotonically_increasing_id().alias("place"))
    return found.where("query <> '' and target is not null")


def write_tomtom(matches: DataFrame, path: str) -> None:
    """A pattern's matches as a TOMTOM table, best first, by one task: at most one row per motif of the database."""
    rows = matches.orderBy("pval", "target").coalesce(1)
    strand = F.when(F.col("is_rc"), "-").otherwise("+")
    table = rows.select(
        F.col("query").alias("Query_ID"), F.col("target").alias("Target_ID"), F.col("offset").alias("Optimal_offset"), F.col("pval").alias("p-value"),
        F.col("evalue").alias("E-value"), F.col("qval").alias("q-value"), strand.alias("Orientation"),
    )
    table.write.mode("overwrite").csv(path, sep="\t", header=True)


def motif_matrix(sequence: np.ndarray, contrib: np.ndarray, hyp: np.ndarray, datatype: str) -> np.ndarray:
    """The matrix that a MEME file of this type shows; the PFM forms of scores are softmaxes over bases."""
    if datatype not in DATATYPES:
        raise ValueError(f"{datatype} is none of {', '.join(DATATYPES)}")
    if datatype == "PFM":
        total = sequence.sum(axis=1, keepdims=True)
        return np.divide(sequence, total, out=np.zeros_like(sequence), where=total != 0)
    m = contrib if datatype.startswith("CWM") else hyp
    if datatype.endswith("-PFM"):
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return m


def meme_text(motifs: list[tuple[str, np.ndarray, int]], background: tuple[float, ...] = (0.25,) * 4) -> str:
    """A minimal MEME file of (name, matrix, number of sites)."""
    head = ["MEME version 5", "", "ALPHABET= ACGT", "", "Background letter frequencies", " ".join(f"{letter} {q}" for letter, q in zip("ACGT", background, strict=True)), ""]
    for name, matrix, sites in motifs:
        head += [f"MOTIF {name}", f"letter-probability matrix: alength= 4 w= {len(matrix)} nsites= {sites}", *(" ".join(f"{x:.6f}" for x in row) for row in matrix), ""]
    return "\n".join(head) + "\n"


def meme_of(patterns: DataFrame, datatype: str) -> str:
    """patterns: metacluster, pattern, n_seqlets, sequence, contrib_scores, hypothetical_contribs; in name order."""
    rows = patterns.orderBy(F.desc("metacluster"), F.col("pattern").cast("string")).collect()  # a row per pattern
    array = lambda m: np.array(m, dtype=float)
    motifs = [(f"{r.metacluster}_patterns.pattern_{r.pattern}", motif_matrix(array(r.sequence), array(r.contrib_scores), array(r.hypothetical_contribs), datatype), r.n_seqlets) for r in rows]
    return meme_text(motifs)


def write_meme(patterns: DataFrame, datatype: str, path: str) -> None:
    write_text(patterns.sparkSession, meme_of(patterns, datatype), path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text through Spark's writer, so that path may be in any store; gives a folder with one part."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def seqlet_locations(members: DataFrame, peaks: DataFrame, window: int, chroms: tuple[str, ...] = ("*",)) -> DataFrame:
    """Members with chrom, chrom_start, chrom_end, strand, score and tag (pattern_0, ...: both metaclusters count from 0)."""
    rows = S.absolute(S.with_peaks(members, peaks, chroms), window)
    return rows.withColumn("tag", F.concat(F.lit("pattern_"), F.col("pattern").cast("string")))


def bed_lines(located: DataFrame) -> DataFrame:
    """line, with the columns that order it; missing columns move later ones left."""
    line = F.concat_ws("\t", "chrom", F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), F.concat("tag", F.lit("."), F.col("ord").cast("string")), "score", "strand")
    return located.select(line.alias("line"), "metacluster", "pattern", "ord")


def track_line(name: Column, description: Column) -> Column:
    """A BED track line, its values quoted."""
    return F.concat(F.lit('track name="'), name, F.lit('" description="'), description, F.lit('"'))


def bed_tracks(located: DataFrame) -> DataFrame:
    """bed_lines with a track line ahead of each pattern's members, and a blank line between tracks."""
    names = located.select("metacluster", "pattern", "tag").distinct()
    nth = F.row_number().over(Window.orderBy(F.desc("metacluster"), F.col("pattern").cast("string")))  # a row per pattern
    head = track_line(F.col("tag"), F.concat(F.lit("Pattern '"), "tag", F.lit("' on the positive strand.")))
    heads = names.select(F.when(nth == 1, head).otherwise(F.concat(F.lit("\n"), head)).alias("line"), "metacluster", "pattern", F.lit(-1).alias("ord"))
    return bed_lines(located).unionByName(heads)


def fasta_lines(located: DataFrame) -> DataFrame:
    """line (header, newline, letters) with the columns that order it; located has letters (text)."""
    header = F.concat(F.lit(">"), "chrom", F.lit(":"), F.col("chrom_start").cast("string"), F.lit("-"), F.col("chrom_end").cast("string"), F.lit(" dir="), "strand", F.lit(" "), "tag", F.lit("."), F.col("ord").cast("string"))
    return located.select(F.concat_ws("\n", header, "letters").alias("line"), "metacluster", "pattern", "ord")


def member_fasta(values: DataFrame) -> DataFrame:
    """line (header of example and coordinates, newline, letters on the member's strand) with the columns that order it;
    values is a store's seqlet_values, whole or of one pattern."""
    header = F.format_string(">example%d:%d-%d", "example_idx", "start_pos", "end_pos")
    return values.select(F.concat_ws("\n", header, T.letters_text(F.col("letters"))).alias("line"), "metacluster", "pattern", "ord")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order of metacluster (positive first), pattern name and member, range-partitioned and sorted."""
    lines.orderBy(F.desc("metacluster"), F.col("pattern").cast("string"), "ord").select(F.col("line").alias("value")).write.mode("overwrite").text(path)

