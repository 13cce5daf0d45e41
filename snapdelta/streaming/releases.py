"""Releases as a stream: what is new in each against all that came before."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(events: DataFrame) -> DataFrame:
    """First day of each (user_id, capability): the batch form of new_capabilities."""
    return events.groupBy("user_id", "capability").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


def deduplicated(findings: DataFrame, delay: str = "7 days") -> DataFrame:
    """Findings of a stream, replays of a fingerprint dropped within `delay` of event time published_at."""
    return findings.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["package", "fingerprint"])


def new_capabilities(signals: DataFrame) -> DataFrame:
    """(package, capability, version, published_at, late) for each capability a package had never shown.

    `signals` is a stream of package, version, published_at and capability. The state of a
    package is its set of capabilities and the newest time seen; a release older than that is
    marked late and not dropped.
    """
    import pandas as pd

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, newest = state.get if state.exists else ([], None)
        known = set(known)
        newest = pd.Timestamp(newest) if newest is not None else None
        rows = pd.concat(list(frames)).sort_values(["published_at", "version", "capability"])
        out = []
        for r in rows.itertuples():
            late = newest is not None and r.published_at < newest
            newest = r.published_at if newest is None else max(newest, r.published_at)
            if r.capability not in known:
                known.add(r.capability)
                out.append((key[0], r.capability, r.version, r.published_at, late))
        state.update((sorted(known), newest))
        yield pd.DataFrame(out, columns=["package", "capability", "version", "published_at", "late"])

    schema = "package string, capability string, version string, published_at timestamp, late boolean"
    return signals.groupBy("package").applyInPandasWithState(update, schema, "known array<string>, newest timestamp", "append", "NoTimeout")


def tumbling_counts(findings: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Findings by severity and window of event time; late data beyond `delay` is dropped by the watermark."""
    return findings.withWatermark("published_at", delay).groupBy(F.window("published_at", width), "severity").agg(F.count("*").alias("findings")).select(F.col("window.start").alias("start"), "severity", "findings")
