"""Places of highest importance, in plain form."""

import random

import pytest

from motifloom.plans.catalogue_tracks import best_positions, top_positions


@pytest.mark.parametrize("n", [1, 19, 20, 21, 9999, 10_001, 35_000])
@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz \n", "aé漢😀\x00z"])
def test_best_positions(n, letters):
    text = "".join(random.Random(n).choices(letters, k=n))
    want = sorted(range(n), key=lambda p: (-(ord(text[p]) % 7), p))[:20]
    assert best_positions(text)[1].tolist() == want


def test_texts_of_one_id_meet_and_no_letter_is_a_row(spark, tmp_path):
    """No row per letter is sorted in the plan; an id given twice is one row, empty and null texts are none."""
    rows = [(1, "ab" * 8000), (1, "gn" * 30), (2, ""), (3, None), (4, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = top_positions(spark, str(tmp_path))
    assert "regexp_extract_all" not in frame._jdf.queryExecution().toString()
    got = {r.doc_id: r.positions for r in frame.collect()}
    both = sorted((-(ord(c) % 7), p) for i, t in rows[:2] for p, c in enumerate(t) if i == 1)[:20]
    assert got == {1: ",".join(map(str, sorted(p for _, p in both))), 4: "0"}
