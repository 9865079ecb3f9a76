"""Command line: motifs, merge, report, report-simple, convert, convert-backward, meme, seqlet-bed, seqlet-fasta, member-fasta."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tracks as T
from .plans import discovery, report, runs
from .sources import store, tensors, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motifloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flags, kw in options:
            p.add_argument(*flags.split(), **kw)
        return p

    required, number = {"required": True}, lambda d: {"type": int, "default": d}
    command(
        "motifs", ("-s --sequences", {}), ("-a --attributions", {}), ("-i --h5py", {}), ("-n --max_seqlets", {"type": int, "required": True}), ("-l --n_leiden", number(50)),
        ("-w --window", number(400)), ("-z --size", number(20)), ("-t --trim_size", number(30)), ("-f --seqlet_flank_size", number(5)), ("-g --initial_flank_to_add", number(10)),
        ("-j --final_flank_to_add", number(0)), ("-o --output", {"default": "results"}), ("-v --verbose", {"action": "store_true"}),
    )
    shared = (("-i --input", required), ("-o --output", required), ("-s --suffix", {"default": "./"}), ("-m --meme_db", {}), ("-n --n_matches", number(3)), ("-l --lite", {"action": "store_true"}), ("-e --tomtom_tables", {}))
    command("report", *shared, ("-t --tomtom", {"action": "store_true"}), ("--n_examples", number(10)), ("--trim_threshold", {"type": float, "default": 0.3}))
    command("report-simple", *shared, ("-t --tomtom", {"action": "store_true"}))
    command("convert", ("-i --input", required), ("-o --output", required))
    command("convert-backward", ("-i --input", required), ("-o --output", required))
    command("meme", ("-i --input", required), ("-t --datatype", {"required": True, "choices": text.DATATYPES}), ("-o --output", {}), ("-q --quiet", {"action": "store_true"}))
    places = (("-i --input", required), ("-o --output", {}), ("-p --peaks", required), ("-c --chroms", {"default": "*"}), ("-q --quiet", {"action": "store_true"}), ("-w --window", {"type": int}))
    command("seqlet-bed", *places)
    runs = {"required": True, "nargs": "+"}
    command("merge", ("-i --input", runs), ("-s --sequences", runs), ("-a --attributions", runs), ("-o --output", required), ("-w --window", {"type": int}))
    command("member-fasta", ("-i --input", required), ("-o --output", {}), ("-q --quiet", {"action": "store_true"}))
    command("seqlet-fasta", *places, ("-s --sequences", required))
    return top


def located(spark: SparkSession, a) -> DataFrame:
    window = store.window_size(spark, a.input, a.window)
    return text.seqlet_locations(store.load(spark, a.input, "seqlets"), text.read_peaks(spark, a.peaks), window, tuple(a.chroms.split(",")))


def emit(lines: DataFrame, a) -> None:
    if a.output:
        text.write_lines(lines, a.output)
    if not a.quiet:
        for row in lines.orderBy(F.desc("metacluster"), F.col("pattern").cast("string"), "ord").toLocalIterator():
            print(row.line)


def motifs(spark: SparkSession, a) -> None:
    if a.h5py:
        seq, hyp = tensors.read_h5(spark, a.h5py, a.window)
    else:
        seq, hyp = tensors.read_tensor(spark, a.sequences, a.window), tensors.read_tensor(spark, a.attributions, a.window)
    tracks = discovery.kept(tensors.tracks_from(seq, hyp), "tracks")
    options = discovery.Options(window=a.size, flank=a.seqlet_flank_size, target_fdr=0.05, max_seqlets=a.max_seqlets, n_seeds=a.n_leiden, trim=a.trim_size, initial_flank=a.initial_flank_to_add, final_flank=a.final_flank_to_add)
    store.save(discovery.discover(tracks, options), tracks, a.output, a.window)


def merge(spark: SparkSession, a) -> None:
    """The patterns of several stores as one store; sequences and attributions are given in the order of the stores."""
    if not len(a.input) == len(a.sequences) == len(a.attributions):
        raise ValueError("each store needs its sequences and its attributions")
    windows = {store.window_size(spark, path, a.window) for path in a.input}
    if len(windows) > 1:
        raise ValueError(f"the stores differ in their window: {sorted(windows)}")
    (window,) = windows
    given = []
    for path, seq, hyp in zip(a.input, a.sequences, a.attributions, strict=True):
        tracks = tensors.tracks_from(tensors.read_tensor(spark, seq, window), tensors.read_tensor(spark, hyp, window))
        given.append((store.load(spark, path, "seqlets"), discovery.kept(tracks, "tracks")))
    store.save(*runs.merge_runs(given), a.output, window)


def seqlet_fasta(spark: SparkSession, a) -> None:
    """Letters of each seqlet as the track has them, first base left out, not reversed: the format's old habit."""
    seq = tensors.read_tensor(spark, a.sequences)
    letters = F.transform("position_values", lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))
    part = F.slice("letters", F.col("start_pos") + 2, F.col("end_pos") - F.col("start_pos") - 1)
    rows = located(spark, a).join(seq.select("example_idx", letters.alias("letters")), "example_idx")
    emit(text.fasta_lines(rows.withColumn("letters", T.letters_text(part))), a)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("motifloom").getOrCreate()
    if a.command == "motifs":
        motifs(spark, a)
    elif a.command in ("report", "report-simple"):
        how = {k: getattr(a, k) for k in ("trim_threshold", "n_examples") if hasattr(a, k)}
        report.write_report(spark, a.input, a.output, motif_db=a.meme_db, n_matches=a.n_matches, euclidean=a.lite, simple=a.command == "report-simple", tomtom=a.tomtom, tables=a.tomtom_tables, **how)
    elif a.command == "merge":
        merge(spark, a)
    elif a.command == "member-fasta":
        emit(text.member_fasta(store.load(spark, a.input, "seqlet_values")), a)
    elif a.command == "convert":
        store.from_legacy(spark, a.input, a.output)
    elif a.command == "convert-backward":
        store.to_legacy(spark, a.input, a.output)
    elif a.command == "meme":
        found = text.meme_of(store.load(spark, a.input, "patterns"), a.datatype)
        if a.output:
            text.write_text(spark, found, a.output)
        if not a.quiet:
            print(found, end="")
    elif a.command == "seqlet-bed":
        emit(text.bed_tracks(located(spark, a)), a)
    else:
        seqlet_fasta(spark, a)


if __name__ == "__main__":
    main()
