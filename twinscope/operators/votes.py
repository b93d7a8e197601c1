"""Signals, thresholded votes and voting policies, as Columns over scored pairs.

A missing score abstains: it is never a vote.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNALS = ("ahash", "phash", "hsvhash", "shash", "orb")
COUNTS = frozenset({"orb"})  # fire above the threshold; distances fire at or below it
LIST_PANEL = ("ahash", "phash", "hsvhash", "shash")
COUNT_PANEL = ("ahash", "phash", "hsvhash", "orb")
#: Thresholds on canvases; those of photographs are FROZEN and FROZEN_COUNT.
THRESHOLDS = {"ahash": 12, "phash": 16, "hsvhash": 4, "shash": 3.0, "orb": 24}
# Published thresholds, and the two for counts of matches.
FROZEN = {"ahash": 7, "phash": 15, "hsvhash": 3, "shash": 17}
FROZEN_COUNT = (16, 23)
DETAIL = ("pixelated",)
COLOUR = ("color_swap_modify_saturate", "background_color_change")
GEOMETRY = ("flip_rotate_mirror", "resize_crop_reposition")


def fires(signal: str, threshold: Column | float, score: Column | None = None) -> Column:
    score = F.col(signal) if score is None else score
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(score > threshold if signal in COUNTS else score <= threshold, F.lit(False))


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def votes(panel: Sequence[str], thresholds: Mapping[str, float]) -> Column:
    return total([fires(s, thresholds[s]).cast("int") for s in panel])


def at_least(panel: Sequence[str], thresholds: Mapping[str, float], k: int) -> Column:
    return votes(panel, thresholds) >= k


def quorum_of(size: Column) -> Column:
    """Two of three or more, else one."""
    return F.when(size >= 3, 2).otherwise(1)


def quorum_verdict(panel: Sequence[str], thresholds: Mapping[str, float], healthy: Mapping[str, Column], quorum: Mapping[int, int]) -> Column:
    """Votes of the healthy signals reach the quorum of their number; where none is set, all of them, one at least."""
    size = total([healthy[s].cast("int") for s in panel])
    fired = total([(healthy[s] & fires(s, thresholds[s])).cast("int") for s in panel])
    needed = reduce(lambda c, kv: F.when(size == kv[0], kv[1]).otherwise(c), quorum.items(), F.greatest(F.lit(1), size))
    return fired >= needed


def masses(shares: Mapping[str, Column]) -> dict[str, Column]:
    """What a classifier's shares say of lost detail, changed colour and changed geometry; absent classes say nothing."""
    of = lambda names: total([shares.get(n, F.lit(0.0)) for n in names])
    return {"detail": of(DETAIL), "colour": of(COLOUR), "geometry": of(GEOMETRY)}


def healthy_panel(detail: Column, colour: Column, tau: Column | float, multi: bool = False, geometry: Column | None = None) -> dict[str, Column]:
    """Which signals to trust. multi: lost detail takes the list distance too. geometry: takes average and perceptual hashes."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    whole, tinted = detail <= tau, colour <= tau
    still = geometry <= tau if geometry is not None else F.lit(True)
    return {"ahash": still, "phash": still, "hsvhash": tinted, "shash": whole if multi else F.lit(True), "orb": whole}


def routed(panel: Sequence[str], thresholds: Mapping[str, float], healthy: Mapping[str, Column]) -> Column:
    size = total([healthy[s].cast("int") for s in panel])
    return total([(healthy[s] & fires(s, thresholds[s])).cast("int") for s in panel]) >= quorum_of(size)


def weighted(panel: Sequence[str], thresholds: Mapping[str, float], weights: Mapping[str, Column]) -> Column:
    return total([F.when(fires(s, thresholds[s]), weights[s]).otherwise(0.0) for s in panel])


def soft_weights(detail: Column, colour: Column) -> dict[str, Column]:
    one = F.lit(1.0)
    return {"ahash": one, "phash": one, "hsvhash": one - colour, "shash": one - detail, "orb": one - detail}
