"""The stateless functions of a page and windowed counts, on streams as well as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import markup, text, urls


def page_features(pages: DataFrame, body: str = "body", url: str = "final_url") -> DataFrame:
    """Native columns of each page; without state or shuffle, so a stream needs no watermark."""
    b = F.col(body)
    return pages.select("*", urls.registrable_domain(urls.host_of(F.col(url))).alias("site"), urls.page_type(F.col(url)).alias("page_type"), markup.frameworks(b).alias("frameworks"), markup.empty_mount(b).alias("empty_mount"), text.word_count(b).alias("markup_words"))


def windowed(events: DataFrame, size: str, late: str = "30 minutes") -> DataFrame:
    """(window, event_type, n, value) of tumbling event-time windows; on a stream, events later than the
    watermark are left out, and a window's row is emitted when the watermark has passed it."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
