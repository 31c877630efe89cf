"""Column expressions of the domain: predicates on detections, labels, latencies and dwell times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualifies(detections: str, classes: list[str] | None, threshold: float) -> Column:
    """Some detection has a class of the set (any, if None; case ignored) and a confidence of at least the threshold."""
    ok = lambda d: (d.conf >= threshold) & (F.lit(True) if classes is None else F.lower(d.cls).isin([c.lower() for c in classes]))
    return F.coalesce(F.exists(detections, ok), F.lit(False))


def max_confidence(detections: str, classes: list[str] | None = None) -> Column:
    """The highest confidence among detections of the set, 0 if there is none."""
    keep = F.col(detections) if classes is None else F.filter(detections, lambda d: F.lower(d.cls).isin([c.lower() for c in classes]))
    return F.coalesce(F.array_max(F.transform(keep, lambda d: d.conf)), F.lit(0.0))


def config_label(deployment: Column, profile: Column) -> Column:
    """The deployment, with the network profile if there is one (null and 'none' count as none)."""
    return F.when(F.coalesce(profile, F.lit("none")) == "none", deployment).otherwise(F.concat_ws("-", deployment, profile))


def ms(later: Column, earlier: Column) -> Column:
    """Milliseconds between two instants in whole nanoseconds; subtracted as whole numbers first."""
    return (later - earlier) / F.lit(1e6)


def drop_rate(drops: Column, frames: Column) -> Column:
    return drops / F.greatest(F.lit(1), drops + frames)


def dwell_frames(seconds: Column, rate: Column) -> Column:
    """Frames that a dwell time takes at a frame rate, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.round(seconds * rate, 6))).cast("long")


def chance_of_hit(rate_per_hour: Column, window_ms: Column) -> Column:
    """Probability of one or more false alarms in the window if they come at random."""
    return 1 - F.exp(-rate_per_hour * window_ms / F.lit(3.6e6))


def remap_prefix(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Replace the first prefix that fits; null if none does."""
    out = F.lit(None).cast("string")
    for old, new in reversed(rules):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    return out


def wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    """Lower (sign -1) or upper (1) limit of a binomial share; null for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    root = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) + sign * z * root) / (1 + z * z / n))


def usable(verified: Column, unusable: Column, onset: Column, least: int = 0) -> Column:
    """An annotation that was verified, is not marked unusable and has an onset from ``least`` on; nulls are no verification and no mark."""
    return F.coalesce(verified, F.lit(False)) & ~F.coalesce(unusable, F.lit(False)) & F.coalesce(onset >= least, F.lit(False))


def share_cell(k: Column, n: Column, digits: int = 1) -> Column:
    """Text of a share: ``3/8 (37.5 %)``, a dash for no rows."""
    return F.when(n > 0, F.concat(k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), F.format_string(f"%.{digits}f", F.round(100.0 * k / n, digits)), F.lit(" %)"))).otherwise("-")
