"""Line dedup by site-relative frequency: drop the lines that too large a share of a site's pages contain.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the number of the
host's pages; lines above ``max_ratio`` on at least ``min_pages`` pages are boilerplate and are dropped everywhere on
that host. Lines are compared without outer spaces; a line that repeats within a page counts once; lines without any
character but spaces are neither counted nor dropped.

Defined results: a null host is a host of its own; a null text stays null and is a page without lines; an empty text
stays empty; a page whose every line is boilerplate keeps its row with an empty text; rows that repeat an id are pages
of their own; an empty table gives no rows. Working columns start with ``__line_``, all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_RATIO = 0.1
MIN_PAGES = 3
SCRIPT_OR_STYLE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
TAG = r"<[^>]*>"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def html_lines(html: Column) -> Column:
    """The texts between tags, without scripts and styles, a line each, joined by newlines; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(html, SCRIPT_OR_STYLE, "\n"), TAG, "\n")
    kept = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(kept, "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, texts: int = 1) -> DataFrame:
    """(__line_host, __line_keys): md5 keys, as hex, of each host's boilerplate lines.

    With ``texts`` of 2, a line must stand in two different texts: copies of one page are no sign of boilerplate.
    A host has at most (distinct lines of a page on average) / max_ratio of them, so the array is bounded however
    many pages the host has. Hosts and lines are counted with partial aggregation: a hot host is spread by line.
    """
    distinct = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _key))
    rows = pages.select(host.alias("__line_host"), distinct.alias("__line_keys"), F.xxhash64(text).alias("__line_text"))
    totals = rows.groupBy("__line_host").agg(F.count(F.lit(1)).alias("__line_pages"))
    counts = (
        rows.select("__line_host", F.explode("__line_keys").alias("__line_key"), "__line_text")
        .groupBy("__line_host", "__line_key")
        .agg(F.count(F.lit(1)).alias("__line_n"), *([F.min("__line_text").alias("__line_one"), F.max("__line_text").alias("__line_other")] if texts > 1 else []))
        .where(F.col("__line_n") >= min_pages)
    )
    if texts > 1:
        counts = counts.where("__line_one < __line_other").drop("__line_one", "__line_other")
    totals = totals.withColumnRenamed("__line_host", "__line_t")
    found = counts.join(totals, F.col("__line_host").eqNullSafe(F.col("__line_t")))
    above = found.where(F.col("__line_n") / F.col("__line_pages") > max_ratio)
    return above.groupBy("__line_host").agg(F.collect_list(F.lower(F.hex("__line_key"))).alias("__line_keys"))


def drop_boilerplate_lines(pages: DataFrame, host: Column, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, texts: int = 1, counts: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; with ``counts``, also n_lines and n_dropped (long)."""
    found = settle(boilerplate(pages, host, F.col(text), max_ratio, min_pages, texts), "lines").select(F.col("__line_host").alias("__line_b"), "__line_keys")
    # The settled table's size is known: Spark broadcasts it only below its threshold and else splits hot hosts (AQE).
    joined = pages.withColumn("__line_host", host).join(found, F.col("__line_host").eqNullSafe(F.col("__line_b")), "left")
    lines = F.split(text, "\n")
    # A set operation meets the host's keys with the page's, so that lines are compared with the page's own boilerplate alone.
    joined = joined.withColumn("__line_own", F.when(F.col("__line_keys").isNotNull(), F.transform(lines, lambda x: F.md5(F.trim(x)))))
    joined = joined.withColumn("__line_bad", F.array_intersect("__line_own", "__line_keys"))
    bad = lambda i: F.array_contains("__line_bad", F.element_at("__line_own", i + 1))
    kept = F.when(F.coalesce(F.size("__line_bad"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x, i: (F.trim(x) == "") | ~bad(i)))
    joined = joined.withColumn("__line_kept", kept)
    out = joined
    if counts:
        full = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
        size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(full(lines)).cast("long")
        left = F.when(F.col(text).isNull(), F.lit(0)).otherwise(full(F.col("__line_kept"))).cast("long")
        out = out.withColumns({"n_lines": size, "n_dropped": size - left})
    return out.withColumn(text, F.array_join("__line_kept", "\n")).drop("__line_host", "__line_b", "__line_keys", "__line_own", "__line_bad", "__line_kept")
