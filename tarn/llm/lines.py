"""Removal of boilerplate lines by their frequency on a site, in Spark expressions alone.

Pages are grouped by host. The pages of a host that contain a line, divided by the host's pages, give the line's
ratio; lines above a given ratio are boilerplate and are dropped from the host's pages. Counting moves hashes of
lines, not lines. Few lines can be that frequent (at most the mean number of lines of a page over the ratio), so a
host's boilerplate is one short list of hashes, which is joined to its pages; what a page shares with the list is
found by hashing, and lines are looked up in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.quality import bound
from tarn.llm.scratch import Scratch

#: White space at a line's ends, which does not distinguish lines.
BLANK = " \t\x0b\x0c\r"
#: Hashes of boilerplate lines up to which the hosts' lists are broadcast; beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Tags that end a line of a web page.
BLOCK_TAGS = "p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|main|aside|form|pre|blockquote|dl|dt|dd|hr|figure|option|select"
#: Patterns of HTML and what they become, in this order; Java and RE2 read them alike.
HTML_STEPS = (
    (r"(?s)<(?:[sS][cC][rR][iI][pP][tT]\b.*?</[sS][cC][rR][iI][pP][tT]>|[sS][tT][yY][lL][eE]\b.*?</[sS][tT][yY][lL][eE]>|!--.*?-->)", ""),
    (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)
#: Entities and what they stand for, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def html_lines(html: Column) -> Column:
    """The visible lines of a page, one per block, without white space at their ends; none is blank."""
    for pattern, into in HTML_STEPS:
        html = F.regexp_replace(html, pattern, into)
    for name, into in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(into))
    return F.filter(F.transform(F.split(html, "\n"), _bare), lambda x: x != "")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def hashes(lines: Column) -> Column:
    """The hash of each line without the white space at its ends; null for a line without a word."""
    return F.transform(lines, lambda x: bound(_bare(x), lambda y: F.when(y != "", F.xxhash64(y))))


def boilerplate(pages: DataFrame, ratio: float, least: int, copies: bool) -> DataFrame:
    """Per host of ``pages`` (_host, _hashes, _page): _common, the hashes of its boilerplate lines. Null hosts and texts have none."""
    rows = pages.where("_host is not null and _hashes is not null").select("_host", "_page", F.array_compact(F.array_distinct("_hashes")).alias("_hashes"))
    if not copies:
        rows = rows.groupBy("_host", "_page").agg(F.first("_hashes").alias("_hashes"))
    totals = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    each = rows.select("_host", F.explode("_hashes").alias("_line"))
    counts = each.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    scratch = Scratch(pages.sparkSession)
    counts = scratch.save(counts)
    common = counts.join(totals, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_total"))
    found = scratch.save(common.groupBy("_host").agg(F.collect_list("_line").alias("_common")))
    scratch.drop(counts)
    return found


def without_boilerplate(pages: DataFrame, ratio: float, least: int, copies: bool) -> DataFrame:
    """``pages`` (_row, _host, _lines, _hashes, _page) as _row, _host, text, n_lines and n_dropped, without their hosts' boilerplate.

    _lines are a page's lines, _hashes ``hashes`` of them, _page a hash of its text. A line is dropped if it is on
    more than ``ratio`` of the host's pages, and on ``least`` at least. Each row is a page; without ``copies``, rows
    of a host with equal texts are one. The other lines stay as they are, in their order, with every repetition; so
    do lines without a word. n_lines counts lines with a word, before dropping. A null host has no boilerplate; null
    lines give a null text, with no lines; very long texts are handled whole; repeated rows fare alike; an empty
    table gives no rows. Columns within _row may have any names.
    """
    common = boilerplate(pages, ratio, least, copies)
    small = (common.agg(F.sum(F.size("_common"))).first()[0] or 0) + common.count() <= MOST_BROADCAST
    joined = pages.join(F.broadcast(common) if small else common, "_host", "left")
    none = F.lit(0).cast("long")

    def cut(own: Column) -> Column:
        """``own``: the page's boilerplate."""
        gone = lambda x: F.coalesce(F.array_contains(own, x), F.lit(False))
        kept = F.when(F.size(own) <= 0, F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~gone(F.get("_hashes", i))))
        dropped = F.when(F.size(own) <= 0, none).otherwise(F.size(F.filter("_hashes", gone)).cast("long"))
        return F.struct(F.array_join(kept, "\n").alias("text"), dropped.alias("n_dropped"))

    own = F.when(F.col("_common").isNull(), F.array().cast("array<long>")).otherwise(F.array_compact(F.array_intersect("_hashes", "_common")))
    there = F.col("_lines").isNotNull()
    out = joined.select("_row", "_host", bound(own, cut).alias("_cut"), there.alias("_there"), F.size(F.array_compact("_hashes")).cast("long").alias("_n"))
    return out.select(
        "_row",
        "_host",
        F.when(F.col("_there"), F.col("_cut.text")).alias("text"),
        F.when(F.col("_there"), F.col("_n")).otherwise(none).alias("n_lines"),
        F.when(F.col("_there"), F.col("_cut.n_dropped")).otherwise(none).alias("n_dropped"),
    )


def clean_pages(pages: DataFrame, ratio: float = 0.1, least: int = 2) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text of web pages (page_id, url, html), without their sites' boilerplate.

    Every row is a page of its URL's host. A line on ``ratio`` of them or fewer stays, as does one on fewer than
    ``least``: a line on one page only is repeated nowhere, and without that a host with one page would lose all it
    has (1 is no minimum). Null, empty and relative URLs have no host and no boilerplate; a null html gives a null
    text; very long pages are read whole; repeated rows are pages each, and fare alike; an empty table gives no rows;
    other columns are not read, so their names cannot clash.
    """
    rows = pages.select(F.struct("page_id").alias("_row"), host_of(F.col("url")).alias("_host"), html_lines(F.col("html")).alias("_lines"))
    # Read twice; tags are taken out once.
    rows = Scratch(pages.sparkSession).save(rows.select("*", hashes(F.col("_lines")).alias("_hashes"), F.lit(0).alias("_page")))
    out = without_boilerplate(rows, ratio, least, True)
    return out.select("_row.page_id", F.col("_host").alias("host"), "n_lines", "n_dropped", "text")


def clean_documents(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = 0.1, least: int = 5) -> DataFrame:
    """``docs`` with the boilerplate lines of their ``site`` cut from ``text``; n_chars, if there is one, follows. Other columns stay.

    Documents with equal texts count as one, so that a text copied often is not taken for boilerplate; a line is on
    ``least`` different ones at least. Null sites have no boilerplate; null texts stay null, empty ones empty; very
    long texts are handled whole; repeated rows fare alike; an empty table gives no rows; columns may have any names.
    """
    rows = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row")[site].cast("string").alias("_host"), F.split(F.col("_row")[text], "\n").alias("_lines"), F.xxhash64(F.col("_row")[text]).alias("_page"))
    out = without_boilerplate(rows.withColumn("_hashes", hashes(F.col("_lines"))), ratio, least, False)
    fresh = {text: F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(fresh.get(x) if fresh.get(x) is not None else F.col("_row")[x]).alias(x) for x in docs.columns])
