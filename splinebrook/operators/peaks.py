"""Peaks with a least distance in series of any length: the highest first, none within the distance of a higher one that stays.

A series is cut into segments. A segment sees its own peaks and those of its neighbours that are within the distance of its
borders. Of its own it settles all that it can: a peak goes if a higher one in its reach stays, and stays if all higher ones in its
reach are gone. What waits for a neighbour's peak is settled in the next round; the highest peak that is not settled always
can be, and chains over a border are short, so the rounds are few.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Steps
from .timeseries import raw_peaks

#: Samples of a segment, in distances.
SPAN = 256
OPEN, STAYS, GOES = 0, 1, 2
ROUNDS = 100_000


def settled(t: np.ndarray, height: np.ndarray, state: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """States of peaks in order of t, with what can be told of the own ones. The earlier of two equal peaks is the higher."""
    state = state.copy()
    first = np.searchsorted(t, t - distance, side="right")
    stop = np.searchsorted(t, t + distance, side="left")
    for k in np.lexsort((t, -height)):
        if state[k] != OPEN or not own[k]:
            continue
        near = np.arange(first[k], stop[k])
        higher = near[(height[near] > height[k]) | ((height[near] == height[k]) & (t[near] < t[k]))]
        if (state[higher] == STAYS).any():
            state[k] = GOES
        elif (state[higher] == GOES).all():
            state[k] = STAYS
    return state


def thinned(long: DataFrame, keys: Sequence[str], distance: int, order: str = "t", value: str = "y") -> DataFrame:
    """Rows (*keys, order, value) of the strict maxima that stay. order counts samples. A distance of 1 keeps all.

    Null values are no peaks; a series of fewer than three samples has none.
    """
    if distance < 1:
        raise ValueError("the distance is one sample at least")
    steps = Steps(long.sparkSession, "peaks")
    span = SPAN * distance
    found = raw_peaks(long.select(*keys, order, value), list(keys), order, value).filter("kind = 1")
    peaks = steps.save(found.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value), F.lit(OPEN).alias("state")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in peaks.schema)
    own = F.floor(F.col(order) / span)
    seen_from = F.sequence(F.floor((F.col(order) - distance + 1) / span), F.floor((F.col(order) + distance - 1) / span))

    def segment(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        t, mine = frame[order].to_numpy(), frame["own"].to_numpy()
        frame["state"] = settled(t, frame[value].to_numpy(), frame["state"].to_numpy(), mine, distance)
        return frame.loc[mine, [*keys, order, value, "state"]]

    for _ in range(ROUNDS):
        if peaks.filter(F.col("state") == OPEN).isEmpty():
            return peaks.filter(F.col("state") == STAYS).select(*keys, order, value)
        sent = peaks.select("*", F.explode(seen_from).alias("segment")).withColumn("own", F.col("segment") == own)
        peaks = steps.save(sent.groupBy(*keys, "segment").applyInPandas(segment, fields))
        steps.forget(2)
    raise RuntimeError("the peaks did not settle")
