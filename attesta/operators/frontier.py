"""The walk over a site's stored pages from its homepage, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import structured_data, text
from attesta.functions.names import host_of, registrable_domain
from attesta.functions.web import classify_url
from attesta.sources.workspace import kept

MOST_PAGES = 8


def _domain(url):
    return registrable_domain(host_of(url))


def walk(pages: DataFrame, homes: DataFrame, key: str, most_pages: int = MOST_PAGES) -> DataFrame:
    """(key, url, level, position, page_type, priority) of the pages that a walk takes, the homepage first.

    pages: url, html.  homes: ``key``, which names a site, and url.  A level takes the
    internal links of the level before that no level has seen, by priority, then by
    the place where they were first found, as long as there are fewer than
    ``most_pages`` pages besides the homepage; links of no priority and links to pages
    that aren't stored take none.

    Each level adds a page or is the last, so there are ``most_pages`` at most, and
    what a site has at a level is bounded by its pages' links.  Rows: of pages of one
    url the one with the least html counts; of homes of one key the least url; a home
    that isn't stored gives no walk; a null html has no links; empty tables give an
    empty table.
    """
    once = pages.filter("url IS NOT NULL").groupBy("url").agg(F.min("html").alias("html"))
    home = homes.groupBy(key).agg(F.min("url").alias("url"))
    fetched = home.join(once, "url").select(key, "url", F.lit(0).alias("level"), F.lit(0).cast("long").alias("position"), F.lit("HOME").alias("page_type"), F.lit(60).alias("priority"), "html")
    last = kept(fetched, "walk-level")
    seen = last.drop("html")
    for level in range(1, most_pages + 1):
        found = last.select(key, F.col("url").alias("_from"), "position", structured_data.anchors("html", "url").alias("_a"))
        links = found.select(key, "position", F.posexplode(text.page_links(F.col("_a"), _domain(F.col("_from")), _domain)["internal"]).alias("_n", "url"))
        links = links.groupBy(key, "url").agg(F.min(F.struct("position", "_n")).alias("_at")).join(seen.select(key, "url"), [key, "url"], "left_anti")
        links = links.withColumn("_c", classify_url(F.col("url"))).filter("_c.priority > 0")
        stored = links.join(once, "url")
        taken = seen.groupBy(key).agg((F.count("*") - 1).alias("_taken"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_c.priority").desc(), "_at", "url"))
        ranked = stored.withColumn("_rank", rank).join(taken, key).withColumn("position", F.col("_taken") + F.col("_rank")).filter(F.col("position") <= most_pages)
        last = kept(ranked.select(key, "url", F.lit(level).alias("level"), "position", "_c.page_type", "_c.priority", "html"), "walk-level")
        if last.isEmpty():
            break
        seen = kept(seen.unionByName(last.drop("html")), "walk-seen")
    return seen
