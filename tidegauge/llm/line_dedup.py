"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's share is the number of the host's pages that contain it,
divided by all the host's pages. Lines over ``RATIO``, on at least ``MIN_PAGES`` pages, are
boilerplate and are dropped from every page of the host.

Lines count once a page, as MD5 digests, and are counted by (host, line) with a partial
aggregation first, so one line on a third of all pages is a handful of rows. A host has fewer
than ``lines per page / RATIO`` boilerplate lines, so they travel as one array a host; each
side of the joins on the host is a written table, which Spark broadcasts if its size allows
and else splits where a host is hot.

Defined cases: a null text has no lines; pages without a host are no site and keep all
lines; blank lines are dropped and don't count; a repeated page counts again; null ids are
carried along; a page left without lines has the empty text; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

RATIO = 0.3
MIN_PAGES = 3
#: What browsers do not show, and tags that end a line. What is not closed hides the rest, and a tag
#: ends before the next one begins, so that no part of a text is searched again and again.
HIDDEN = r"(?is)<script[^<>]*>.*?(?:</script>|\z)|<style[^<>]*>.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
BLOCK = (
    r"(?i)</?(?:!doctype|html|head|title|meta|body|header|footer|nav|main|article|section|aside|div|p|ul|ol|li|table|tr|td|th"
    r"|h[1-6]|br|hr|pre|blockquote|form)(?:[\s/][^<>]*)?>"
)
TAG = r"<[^<>]*>"


def html_text(html: str | Column) -> Column:
    """The text of a page, a line for each block."""
    text = F.regexp_replace(text_or_empty(html), HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def drop_boilerplate(
    pages: DataFrame, host: Column, text: Column, id_col: str = "page_id", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines that stay, one below the other)."""
    split = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), lines_of(text_or_empty(text)).alias("lines"))
    rows = durable(split)
    sites = rows.where("host <> ''")
    line = F.explode(F.array_distinct(F.transform("lines", _digest))).alias("line")
    counts = sites.select("host", line).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = durable(sites.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    common = durable(counts).join(totals, "host").where(F.col("n") > F.col("pages") * F.lit(ratio))
    boilerplate = durable(common.groupBy("host").agg(F.collect_list("line").alias("boilerplate")))
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("boilerplate", _digest(x)), F.lit(False)))
    out = rows.join(boilerplate, "host", "left").withColumn("kept", kept)
    return out.select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
