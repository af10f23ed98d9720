"""Temporal URL filters, in DataFrame functions alone.

List entries are dated events (added, removed). They become validity intervals, and each capture of a
page is judged by the entries that were active when it was fetched. The join is an equi-join on keys:
a URL's host with its parent domains, and the host with each beginning of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """All keys an entry could have that covers the URL: host, parent domains of two labels or more, host with path beginnings."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from dated events (list, key, action, day); ``valid_to`` is exclusive.

    An addition holds until the next later event of its list and key, for ever if there is none. Of
    several events on one day a removal wins. Events that lack a list, key, day or action are ignored,
    repeated ones count once, and a removal without an addition says nothing.
    """
    known = entries.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    # One row for each list, key and day; the history of a key is bounded by the calendar.
    days = known.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    later = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    ended = days.withColumn("valid_to", F.coalesce(later, F.lit(FOREVER).cast("date")))
    return ended.where("action = 'add'").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(id_col, host, day_col, n_active, lists, entry, blocked), one row for each row of ``captures``.

    ``n_active`` counts the entries (list and key) that cover the URL on the day it was fetched,
    ``lists`` their lists (distinct, sorted, comma-joined), ``entry`` the longest of their keys, of equals the
    first in order (null if there is none). A null URL, one without a host, or a null day matches nothing.
    Repeated rows repeat, null ids stay, other columns are ignored, and an empty table on either side is fine.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day"))
    asked = rows.where("url IS NOT NULL AND day IS NOT NULL").select("url", "day").distinct()
    spread = asked.select("url", "day", F.explode(keys_of(F.col("url"))).alias("key"))
    held = intervals(entries).withColumnRenamed("key", "held_key")
    active = (F.col("key") == F.col("held_key")) & (F.col("day") >= F.col("valid_from")) & (F.col("day") < F.col("valid_to"))
    hits = spread.join(held, active).groupBy("url", "day").agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.min_by("key", F.struct(-F.length("key"), F.col("key"))).alias("entry"),
    )
    joined = rows.join(hits, ["url", "day"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select(
        F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), F.col("day").alias(day_col), n.alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"), "entry", (n > 0).alias("blocked"),
    )
