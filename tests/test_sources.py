"""Sources, sinks, stores and the command line."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom import cli
from motifloom.operators import matching
from motifloom.plans import discovery, report, runs
from motifloom.sources import store, tensors, text


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """Tensor files of sequences with one of two planted words on either strand."""
    rng = np.random.default_rng(2)
    n, length = 120, 120
    hot, hyp = np.zeros((n, 4, length), np.float32), rng.normal(0, 0.02, (n, 4, length)).astype(np.float32)
    for i in range(n):
        letters = rng.integers(0, 4, length)
        w = np.array([2, 0, 3, 3, 0, 1, 0, 2, 2, 1] if i % 2 else [1, 1, 2, 3, 0, 3, 2, 1, 0, 0])
        w = 3 - w[::-1] if rng.random() < 0.5 else w
        at = int(rng.integers(45, 65))
        letters[at : at + 10] = w
        hyp[i, :, at : at + 10] = -0.3
        hyp[i, w, np.arange(at, at + 10)] = 1 + rng.normal(0, 0.05, 10)
        hot[i, letters, np.arange(length)] = 1
    path = tmp_path_factory.mktemp("tensors")
    np.save(path / "seq.npy", hot)
    np.savez(path / "hyp.npz", hyp)
    return path


def test_tensor_source(spark, planted):
    rows = tensors.read_tensor(spark, f"{planted}/seq.npy", 100)
    assert rows.count() == 120
    whole = np.load(planted / "seq.npy")
    first = rows.where("example_idx = 7").first()
    assert np.array_equal(np.array(first.position_values), whole[7, :, 10:110].T)
    assert tensors.read_tensor(spark, f"{planted}/hyp.npz").count() == 120
    for bad in (101, 400):
        with pytest.raises(ValueError):
            tensors.crop(120, bad)


def test_discovery_store_and_files(spark, planted, tmp_path):
    tracks = discovery.kept(tensors.tracks_from(tensors.read_tensor(spark, f"{planted}/seq.npy"), tensors.read_tensor(spark, f"{planted}/hyp.npz")), "tracks")
    options = discovery.Options(window=20, flank=5, target_fdr=0.05, n_seeds=2, max_seqlets=200, neighbours=40, min_metacluster=50, min_n=10, rounds=1, initial_flank=5, trim=20)
    members = discovery.kept(discovery.discover(tracks, options), "found")
    sizes = {(r.metacluster, r.pattern): r["count"] for r in members.groupBy("metacluster", "pattern").count().collect()}
    assert set(sizes) == {("pos", 0), ("pos", 1)} and min(sizes.values()) >= 50
    out = f"{tmp_path}/store"
    store.save(members, tracks, out, 120)
    assert store.window_size(spark, out) == 120 and store.window_size(spark, out, 7) == 7
    patterns = store.load(spark, out, "patterns").collect()
    for p in patterns:
        assert np.allclose(np.array(p.sequence).sum(axis=1), 1)
        assert (np.array(p.sequence).max(axis=1) > 0.9).sum() >= 8
    cli.main(["meme", "-i", out, "-t", "CWM-PFM", "-o", f"{tmp_path}/meme", "-q"], spark)
    motifs = text.read_motifs(spark, f"{tmp_path}/meme/*.txt").collect()
    assert [m.name for m in motifs] == ["pos_patterns.pattern_0", "pos_patterns.pattern_1"]
    assert np.allclose(np.array(motifs[0].pwm).sum(axis=1), 1, atol=1e-5)
    peaks = tmp_path / "peaks.bed"
    peaks.write_text("".join(f"chr{1 + i % 2}\t{1000 * i}\t{1000 * i + 120}\tp{i}\t{i}\n" for i in range(120)))
    cli.main(["seqlet-bed", "-i", out, "-p", str(peaks), "-o", f"{tmp_path}/bed", "-q"], spark)
    check_bed(spark, f"{tmp_path}/bed", members)
    cli.main(["seqlet-fasta", "-i", out, "-p", str(peaks), "-s", f"{planted}/seq.npy", "-o", f"{tmp_path}/fasta", "-q"], spark)
    assert spark.read.text(f"{tmp_path}/fasta").where("value like '>chr%'").count() == members.count()
    cli.main(["convert-backward", "-i", out, "-o", f"{tmp_path}/old"], spark)
    cli.main(["convert", "-i", f"{tmp_path}/old", "-o", f"{tmp_path}/new"], spark)
    keys = ["metacluster", "pattern", "ord", "example_idx", "start_pos", "end_pos", "is_revcomp"]
    back = store.load(spark, f"{tmp_path}/new", "seqlets").select(*keys).toPandas().sort_values(keys).reset_index(drop=True)
    want = members.select(*keys).toPandas().sort_values(keys).reset_index(drop=True)
    assert back.astype(str).equals(want.astype(str))
    with pytest.raises(ValueError):
        store.window_size(spark, f"{tmp_path}/new")
    cli.main(["report", "-i", out, "-o", f"{tmp_path}/html", "-m", f"{tmp_path}/meme/*.txt"], spark)
    page = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/html/report.html").collect())
    assert page.count("<svg") >= 6 + 2 * (2 + 10 + 1) and "pos_patte" in page
    cli.main(["report-simple", "-i", out, "-o", f"{tmp_path}/html", "-m", f"{tmp_path}/meme/*.txt", "-t"], spark)
    assert "<h2>" not in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/html/motifs.html").collect())
    for k in (0, 1):
        table = text.read_tomtom(spark, f"{tmp_path}/html/tomtom/pos_patterns.pattern_{k}.tomtom.tsv").collect()
        assert table[0].target == f"pos_patterns.pattern_{k}" and 0 <= table[0].qvalue < 0.05
    check_values(spark, out, tracks, members, tmp_path)
    for part in ("a", "b"):  # the same run twice, merged from its files
        store.save(members, tracks, f"{tmp_path}/{part}", 120)
    cli.main(["merge", "-i", f"{tmp_path}/a", f"{tmp_path}/b", "-s", *[f"{planted}/seq.npy"] * 2, "-a", *[f"{planted}/hyp.npz"] * 2, "-o", f"{tmp_path}/both"], spark)
    both = store.load(spark, f"{tmp_path}/both", "patterns").collect()
    assert len(both) == 2 and sum(p.n_seqlets for p in both) >= 1.9 * members.count() and store.window_size(spark, f"{tmp_path}/both") == 120
    check_merged_runs(tracks, members, options)


def check_bed(spark, path, members):
    """The file's text: a track line per pattern in name order, a blank line between tracks, and the members' rows."""
    want = []
    rows = sorted(members.collect(), key=lambda m: (m.metacluster != "pos", str(m.pattern), m.ord))
    for m in rows:
        if m.ord == 0:
            want += [""] * bool(want) + [f"track name=\"pattern_{m.pattern}\" description=\"Pattern 'pattern_{m.pattern}' on the positive strand.\""]
        middle = (1000 * m.example_idx + 1000 * m.example_idx + 120) // 2 - 60
        want.append("\t".join(map(str, (f"chr{1 + m.example_idx % 2}", middle + m.start_pos + 1, middle + m.end_pos, f"pattern_{m.pattern}.{m.ord}", m.example_idx, "-" if m.is_revcomp else "+"))))
    assert [r.value for r in spark.read.text(path).collect()] == want


def test_report_from_tables_made_elsewhere(spark, tmp_path):
    tables = tmp_path / "tables"
    tables.mkdir()
    head = "Query_ID\tTarget_ID\tOptimal_offset\tp-value\tE-value\tq-value\tOverlap\n"
    (tables / "pos_patterns.pattern_0.tomtom.tsv").write_text(head + "1\t second \t0\t0.2\t1\t0.4\t9\n1\tfirst\t0\t0.1\t1\t0.2\t9\n\n# made elsewhere\n")
    (tables / "pos_patterns.pattern_1.tomtom.tsv").write_text(head)
    (tables / "neg_patterns.pattern_0.tomtom.tsv").write_text(head + "1\tother\t0\t0.2\t1\t0.5\t9\n")
    found = sorted((r["query"], r.target, r.qval) for r in text.read_tomtom_tables(spark, str(tables)).collect())
    assert found == [("neg_patterns.pattern_0", "other", 0.5), ("pos_patterns.pattern_0", "first", 0.2), ("pos_patterns.pattern_0", "second", 0.4)]
    tracks = spark.createDataFrame([(0, [0, 1, 2, 3] * 3, [[1.0, 0.0, 0.0, 0.5]] * 12)], "example_idx bigint, letters array<int>, hyp array<array<double>>")
    members = spark.createDataFrame([("pos", p, 0, 0, 0, 1, 9, False) for p in (0, 1)], f"metacluster string, {discovery.MEMBERS}")
    store.save(members, tracks, f"{tmp_path}/store", 12)
    for simple in (False, True):
        page = report.write_report(spark, f"{tmp_path}/store", f"{tmp_path}/html", simple=simple, tables=str(tables), n_matches=2)
        assert page.index("<td>second</td><td>0.4</td>") < page.index("<td>first</td><td>0.2</td>") and "second;first" in page and "other" not in page
        assert ("<th>forward</th><th>reverse</th>" in page) == simple
    con = np.array([r.contrib_scores for r in store.load(spark, f"{tmp_path}/store", "patterns").where("pattern = 0").collect()][0])
    assert report.logo_svg(matching.support(con[::-1, ::-1], con[::-1, ::-1], 0.3, (2, 3))) in page
    cli.main(["member-fasta", "-i", f"{tmp_path}/store", "-o", f"{tmp_path}/members", "-q"], spark)
    assert [r.value for r in spark.read.text(f"{tmp_path}/members").collect()] == [">example0:1-9", "CGTACGTA"] * 2


def check_values(spark, out, tracks, members, tmp_path):
    """Letters and matrices of members, their statistics, examples and FASTA against plain Python."""
    values = store.load(spark, out, "seqlet_values")
    whole = {r.example_idx: r for r in tracks.collect()}
    want, lines = {}, []
    for m in sorted(members.collect(), key=lambda m: (m.pattern, m.ord)):
        t = whole[m.example_idx]
        letters, hyp = np.array(t.letters)[m.start_pos : m.end_pos], np.array(t.hyp)[m.start_pos : m.end_pos]
        if m.is_revcomp:
            letters, hyp = 3 - letters[::-1], hyp[::-1, ::-1]
        want[m.pattern, m.ord] = letters, np.abs(hyp[np.arange(len(letters)), letters]).sum()
        lines += [f">example{m.example_idx}:{m.start_pos}-{m.end_pos}", "".join("ACGT"[b] for b in letters)]
    got = {(r.pattern, r.ord): r for r in report.with_importance(values).collect()}
    assert got.keys() == want.keys()
    for key, (letters, importance) in want.items():
        assert got[key].letters == letters.tolist() and got[key].importance == pytest.approx(importance)
    text.write_lines(text.member_fasta(values), f"{tmp_path}/members")
    assert [r.value for r in spark.read.text(f"{tmp_path}/members").collect()] == lines
    for r in report.seqlet_stats(values).collect():
        mine = [x for (p, _), x in want.items() if p == r.pattern]
        assert r.n == len(mine) and r.std_importance == pytest.approx(np.std([x for _, x in mine]))
        assert r.gc_content == pytest.approx(np.mean([np.isin(x, (1, 2)).mean() for x, _ in mine]) / 2)
    for r in report.importance_histograms(values).collect():
        mine = [x for (p, _), (_, x) in want.items() if p == r.pattern]
        counts = np.histogram(mine, 30)[0]
        assert sum(r.counts.values()) == len(mine) and sum(abs(counts[b] - r.counts.get(b, 0)) for b in range(30)) <= 2
    for k in (0, 1):
        shown = report.member_examples(values, 5).where(f"pattern = {k}").orderBy("place").collect()
        mine = sorted(x for (p, _), (_, x) in want.items() if p == k)
        assert len(shown) == 5 and shown[0].importance == pytest.approx(mine[-1])
        assert [r.importance for r in shown] == sorted((r.importance for r in shown), reverse=True)


def check_merged_runs(tracks, members, options):
    """Two halves as two runs give the patterns of the whole again."""
    halves = [(members.where(f"example_idx div 2 % 2 = {k}"), tracks.where(f"example_idx div 2 % 2 = {k}").withColumn("example_idx", F.col("example_idx") + 7 * k)) for k in (0, 1)]
    halves[1] = (halves[1][0].withColumn("example_idx", F.col("example_idx") + 7), halves[1][1])
    united, shared = runs.united(halves)
    assert united.select("pattern").distinct().count() == 4
    used = sorted(r.example_idx for r in shared.select("example_idx").collect())
    assert used == list(range(len(used))) and len(used) == members.select("example_idx").distinct().count()
    merged, _ = runs.merge_runs(halves, dataclasses.replace(options, trim=20, initial_flank=5))
    sizes = {r.pattern: r["count"] for r in merged.groupBy("pattern").count().collect()}
    assert set(sizes) == {0, 1} and sum(sizes.values()) >= 0.95 * members.count()
    with pytest.raises(ValueError):
        runs.merge_runs([])


def test_store_and_report_without_patterns(spark, tmp_path):
    tracks = spark.createDataFrame([(0, [0, 1], [[1.0] * 4] * 2)], "example_idx bigint, letters array<int>, hyp array<array<double>>")
    members = spark.createDataFrame([], f"metacluster string, {discovery.MEMBERS}")
    store.save(members, tracks, f"{tmp_path}/store", 2)
    for simple in (False, True):
        assert "No patterns" in report.write_report(spark, f"{tmp_path}/store", f"{tmp_path}/html", simple=simple)


def test_missing_peak_is_an_error(spark):
    from motifloom.operators import seqlets as S

    members = spark.createDataFrame([(5, 0, 10, False)], "example_idx bigint, start_pos int, end_pos int, is_revcomp boolean")
    peaks = spark.createDataFrame([("c", 0, 9, "1", 0)], "chrom string, start_pos bigint, end_pos bigint, score string, ord bigint")
    with pytest.raises(Exception, match="no peak"):
        S.with_peaks(members, peaks).collect()


def test_null_weighs_columns():
    query, columns = np.eye(4)[[0, 1]], np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0]])
    twice = matching.null_tails(query, columns[[0, 0, 0, 1]], "euclidean", -np.sqrt(2), 0.0)
    counted = matching.null_tails(query, columns, "euclidean", -np.sqrt(2), 0.0, np.array([3.0, 1.0]))
    assert all(np.allclose(a, b) for a, b in zip(twice, counted, strict=True))


def test_meme_text_is_fixed():
    m = np.array([[0.25, 0.25, 0.5, 0], [1, 0, 0, 0]])
    assert text.meme_text([("a", m, 3)]).splitlines()[7:] == ["MOTIF a", "letter-probability matrix: alength= 4 w= 2 nsites= 3", "0.250000 0.250000 0.500000 0.000000", "1.000000 0.000000 0.000000 0.000000", ""]
    assert text.parse_meme(text.meme_text([("a b", m, 3)])) == [("a b", m.tolist())]
    with pytest.raises(ValueError):
        text.motif_matrix(m, m, m, "XYZ")


def test_stream_scores_like_a_table(spark, tmp_path):
    from motifloom.operators.seqlets import pick_seqlets
    from motifloom.streaming.scoring import stream_seqlets

    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=40).tolist()) for i in range(20)], "example bigint, attr array<double>")
    rows.write.parquet(f"{tmp_path}/in")
    stream = stream_seqlets(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 5, 1, 2.0, -2.0)
    stream.writeStream.format("memory").queryName("picked").trigger(availableNow=True).start().awaitTermination()
    want = pick_seqlets(rows, 5, 1, 3, 2.0, -2.0)
    assert sorted(map(tuple, spark.table("picked").collect())) == sorted(map(tuple, want.collect()))
