"""Frames, rates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frames of a window at least, and how far apart picture and sound may end, in seconds.
LEAST_FRAMES = 2
AV_TOLERANCE = 0.1


def frames_for_seconds(seconds: float, rate: Column, least: int = LEAST_FRAMES) -> Column:
    """Frames of so many seconds: rounded to 9 decimals, for noise in measured rates, then half up; LEAST_FRAMES at least."""
    return F.greatest(F.floor(F.round(F.lit(seconds) * rate, 9) + 0.5).cast("long"), F.lit(least).cast("long"))


def antialias_warning(source: Column, target: float) -> Column:
    """What a resampling from source to target samples a second loses, or null if it is no more than 1.5 times slower."""
    lost = F.format_string("source %.3f Hz decimated to %.3f Hz without an anti-alias filter; content above %.3f Hz will alias", source, F.lit(target), F.lit(target / 2))
    return F.when((source > 0) & (source > 1.5 * target), lost)


def av_status(video: Column, audio: Column, tolerance: float = AV_TOLERANCE) -> Column:
    """ok, no_audio_stream where audio is null, or av_duration_mismatch where the two differ by more or video is unknown."""
    off = F.abs(F.round(video - audio, 4)) > tolerance
    return F.when(audio.isNull(), "no_audio_stream").when(video.isNull() | off, "av_duration_mismatch").otherwise("ok")
