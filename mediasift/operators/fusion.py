"""Scores of several techniques in one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_score(parts: Mapping[str, tuple[Column, float]]) -> Column:
    """The mean of those scores that are there, by their weights; null if none is."""
    there = lambda c, x: F.when(c.isNotNull() & ~F.isnan(c), x).otherwise(F.lit(0.0))
    total = sum((there(c.cast("double"), F.lit(w)) for c, w in parts.values()), F.lit(0.0))
    return F.when(total > 0, sum((there(c.cast("double"), c.cast("double") * w) for c, w in parts.values()), F.lit(0.0)) / total)


def duration_similarity(a: Column, b: Column) -> Column:
    """Of a clip of length a and a whole of length b: from one half for a short clip to 1 for equal lengths; b / a for a clip that is longer. 0 if a length is null or not above 0."""
    return F.when(~F.coalesce((a > 0) & (b > 0), F.lit(False)), 0.0).when(a <= b, 0.5 + 0.5 * a / b).otherwise(b / a)


def resolution_similarity(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Ratio of widths times ratio of heights, the smaller by the larger; 0 if one is unknown."""
    known = F.coalesce((w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0), F.lit(False))
    return F.when(known, F.least(w1, w2) / F.greatest(w1, w2) * (F.least(h1, h2) / F.greatest(h1, h2))).otherwise(0.0)


def stage_scores(video: Column, audio: Column, video_offset: Column, audio_offset: Column, durations: Column, resolutions: Column, lexical: Column, segment_s: float) -> dict[str, Column]:
    """The scores of the stages, each clipped to 0..1: `metadata` of lengths and resolutions, `visual` of words and alignment, `audio`, and `temporal`, which adds how far the two
    offsets agree: fully at the same place, not at all from ten segments (a second at least) apart."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    agreement = clip(1.0 - F.abs(video_offset - audio_offset) / max(1.0, 10.0 * segment_s))
    return {
        "metadata": clip(0.7 * durations + 0.3 * resolutions), "visual": clip(0.3 * lexical + 0.7 * video), "audio": clip(audio),
        "temporal": clip(0.25 * durations + 0.45 * video + 0.20 * audio + 0.10 * agreement),
    }


#: Weights of the stages in the whole.
STAGES = {"metadata": 0.20, "visual": 0.30, "audio": 0.25, "temporal": 0.25}
