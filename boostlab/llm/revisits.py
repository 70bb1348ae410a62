"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit record has no body: the server said that nothing changed. Each is joined as of its
date to the latest earlier full response of the same canonical URL. Validators are compared
(entity tags weakly, else last-modified dates, else payload digests); where they agree the
revisit takes the response's body, and the headers a not-modified answer may update replace
those of the response.

The as-of join is by periods: within (URL, period) a window carries the last response
forward, one row per URL and period carries it across periods. So a URL with a third of all
records is dealt to as many tasks as it has periods, and bodies take no part: they are
joined by record id at the end.

Defined results: a response at the date of the revisit is not earlier; of responses at one
date the greatest record id counts; a revisit without URL or date, or without an earlier
response, is ``missing``; without a validator on both sides it is ``unverified`` and takes
no body; null headers are none; header names are matched in lower case, of equal names the
last holds; repeated revisits give repeated rows, repeated responses count once; empty
tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a not-modified answer updates.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires",
             "last-modified", "vary")
# Query parameters that do not select content.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and trailing slash go;
    the host is in lower case, the parameters are sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.lit("?")).otherwise(""),
                    F.array_join(kept, "&"))


def _lowered_names(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _validity(mine: Column, theirs: Column, digest: Column, their_digest: Column) -> Column:
    def tag(headers: Column) -> Column:
        return F.regexp_replace(headers["etag"], "^W/", "")

    same = F.coalesce(
        tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"],
        digest == their_digest)
    return F.when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")


def resolve(records: DataFrame, period: str = "day") -> DataFrame:
    """Revisits with what they stand for.

    ``records``: record_id long, kind (``response`` or ``revisit``), url, date timestamp,
    headers map, digest (of the payload), body. Gives record_id, url_key, response_id, state,
    headers, body.
    """
    rows = records.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "date",
        _lowered_names(F.col("headers")).alias("headers"), "digest", "body")
    slim = rows.filter(
        "url_key is not null and date is not null and kind in ('response', 'revisit')"
    ).select("record_id", "kind", "url_key", "date",
             F.date_trunc(period, "date").alias("period"),
             F.when(F.col("kind") == "response", F.col("record_id")).alias("full_id"))
    within = Window.partitionBy("url_key", "period").orderBy(
        "date", F.desc("kind"), "record_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # a revisit before responses of its date
    inner = slim.withColumn("inner_id", F.last("full_id", ignorenulls=True).over(within))
    ends = slim.filter("full_id is not null").groupBy("url_key", "period").agg(
        F.max_by("full_id", F.struct("date", "record_id")).alias("end_id"))
    periods = slim.select("url_key", "period").distinct().join(
        ends, ["url_key", "period"], "left")
    across = Window.partitionBy("url_key").orderBy("period").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = periods.select("url_key", "period", F.last("end_id", ignorenulls=True)
                             .over(across).alias("outer_id"))
    found = (
        inner.filter("kind = 'revisit'").join(carried, ["url_key", "period"])
        .select("record_id", F.coalesce("inner_id", "outer_id").alias("response_id"))
        .filter("response_id is not null").dropDuplicates(["record_id"])
    )
    responses = rows.filter("kind = 'response'").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("response_id"), F.col("headers").alias("their_headers"),
        F.col("digest").alias("their_digest"), F.col("body").alias("their_body"))
    joined = (
        rows.filter("kind = 'revisit'").drop("body", "kind", "date")
        .join(found, "record_id", "left").join(responses, "response_id", "left")
    )
    state = F.when(F.col("response_id").isNull(), "missing").otherwise(_validity(
        F.col("headers"), F.col("their_headers"), F.col("digest"), F.col("their_digest")))
    judged = joined.withColumn("state", state)
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(
        F.map_filter("their_headers", lambda k, _: ~F.coalesce(
            F.map_contains_key(update, k), F.lit(False))), update)
    good = F.col("state") == "resolved"
    return judged.select(
        "record_id", "url_key", "response_id", "state",
        F.when(good, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("their_body")).alias("body"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """An archive derived from the pages: every page is captured as a response, one minute
    per page; two hours later its address is visited again and found unchanged. Every fifth
    revisit names another entity tag, every seventh no tag but a date, every eleventh
    neither."""
    begin = F.lit(1_700_000_000)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    responses = pages.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url",
        F.timestamp_seconds(begin + 60 * F.col("page_id")).alias("date"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), F.md5("url"),
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("no-cache"),
        ).alias("headers"),
        F.sha2("html", 256).alias("digest"), F.col("html").alias("body"))
    number = F.col("page_id")
    revisits = pages.select(
        (2 * number + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat("url", F.lit("#again")).alias("url"),
        F.timestamp_seconds(begin + 60 * number + 7200).alias("date"),
        F.when(number % 11 == 0, F.create_map(F.lit("Content-Type"), F.lit("text/plain")))
        .when(number % 7 == 0, F.create_map(F.lit("Last-Modified"), F.md5("url")))
        .when(number % 5 == 0, F.create_map(F.lit("ETag"), F.lit('"other"')))
        .otherwise(F.create_map(
            F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"),
            F.lit("max-age=60"), F.lit("Content-Type"), F.lit("text/plain"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("body"))
    return responses.unionByName(revisits)
