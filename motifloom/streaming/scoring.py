"""Scoring new examples against stored thresholds as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.seqlets import pick_seqlets


def stream_seqlets(tracks: DataFrame, window: int, flank: int, positive: float, negative: float) -> DataFrame:
    """Seqlets of a stream of tracks (example, attr array): a narrow plan without state, the same as on a table."""
    return pick_seqlets(tracks, window, flank, int(0.5 * window) + flank, positive, negative)
