"""Splits of clips into train, val and test that meet ratios by count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
SPEAKERS, CLIPS = "speaker_disjoint", "clip_disjoint"


def _deal(total: int, ratios: tuple[float, float, float]):
    wanted = [round(total * r) for r in ratios]
    wanted[0] = total - wanted[1] - wanted[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = np.array(wanted, dtype=np.int64)
        for batch in batches:
            places = []
            for n in batch["n"]:
                k = int(left.argmax())
                left[k] -= n
                places.append(SPLITS[k])
            yield batch.assign(split=places)

    return run


def greedy_split(clips: DataFrame, clip: str, speaker: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """clips with ``split`` and ``split_kind``: groups, in an order by a hash of the seed, each to the split that lacks most clips.

    A group is all clips of a speaker where every clip has one; where any has none, each clip is a group of its own
    (``clip_disjoint``), repeated rows of it together. Of equal lacks the first split takes the group; an empty table gives no rows.
    Dealing depends on all groups before, so it is one task's work: it reads sorted pairs of group and count, never
    clips, as a stream with three counters for state, and the driver holds none of them.
    """
    total, known = clips.agg(F.count("*"), F.count(speaker)).first()
    by = F.col(speaker if total == known else clip)
    groups = clips.groupBy(by.alias("_group")).agg(F.count("*").alias("n"))
    ordered = groups.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("_group").cast("string")))).repartition(1).sortWithinPartitions("_h", "_group")
    kind = ordered.schema["_group"].dataType.simpleString()
    dealt = ordered.select("_group", "n").mapInPandas(_deal(total, ratios), f"_group {kind}, n long, split string").drop("n")
    return clips.join(dealt, by.eqNullSafe(F.col("_group")), "left").drop("_group").withColumn("split_kind", F.lit(SPEAKERS if total == known else CLIPS))
