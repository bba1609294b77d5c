"""Events from browser history, downloads and the activity feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.textcols import (activity_name, base_name, blank_to_null, file_uri_to_path, first_filled,
                                  prefixed, thousands, timeline_app_name, timeline_payload)
from ..functions.timecols import as_col, unix_s_to_ns, unix_us_to_ns, webkit_us_to_ns
from .aggregates import latest_n
from .timeline import to_events

DOWNLOAD_NOTE = "downloads/destinationFileURI"


def browser_of(path) -> Column:
    """Browser of a history database by its path."""
    low = F.lower(as_col(path))
    name = F.substring_index(base_name(low), "/", -1)
    return (F.when(low.contains("firefox") | (name == "places.sqlite"), "Firefox")
            .when(low.contains("edge"), "Edge").otherwise("Chrome"))


def _newest(rows: DataFrame, order: str, limit: int | None, ties: list[str]) -> DataFrame:
    return rows if limit is None else latest_n(rows, ["db_id"], order, limit, ties=ties)


def _visit_message(browser: Column) -> Column:
    url, title = F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))
    quoted = F.when((title != "") & (title != url), F.concat(F.lit(' - "'), title, F.lit('"'))).otherwise("")
    return F.concat(F.lit("Browser Visit: "), url, quoted, F.lit(" ["), browser, F.lit("]"))


def _kind(text: str, browser: Column) -> Column:
    return F.concat(F.lit(f"{text} ("), browser, F.lit(")"))


def chromium_visit_events(visits: DataFrame, urls: DataFrame, limit: int | None = None) -> DataFrame:
    """All visits joined to their URLs; with ``limit`` only the newest per database."""
    pages = urls.select("db_id", F.col("id").alias("url_id"), "url", "title")
    joined = visits.filter("visit_time > 0").join(pages, ["db_id", "url_id"])
    rows = _newest(joined, "visit_time", limit, ["url_id"])
    ns = webkit_us_to_ns("visit_time")
    return to_events(
        rows.filter(ns > 0), artifact_type="BROWSER", source="BROWSER",
        artifact=_kind("Browser Visit", F.col("browser")), ts=ns, file_path=F.col("url"),
        message=_visit_message(F.col("browser")))


def chromium_download_events(downloads: DataFrame) -> DataFrame:
    target, origin = blank_to_null("target_path"), blank_to_null("tab_url")
    size = F.coalesce(F.nullif("received_bytes", F.lit(0)), F.nullif("total_bytes", F.lit(0)))
    ns = webkit_us_to_ns("start_time")
    message = F.concat(
        F.lit("Browser Download: "), F.coalesce(base_name(target), F.lit("unknown")),
        F.coalesce(F.concat(F.lit(" from "), origin), F.lit("")),
        F.lit(" ["), F.col("browser"), F.lit("]"),
        F.coalesce(F.concat(F.lit(" ("), thousands(size), F.lit(" bytes)")), F.lit("")))
    return to_events(
        downloads.filter(ns > 0), artifact_type="BROWSER", source="BROWSER",
        artifact=_kind("Browser Download", F.col("browser")), ts=ns,
        file_path=first_filled("target_path", "tab_url"), message=message)


def firefox_visit_events(visits: DataFrame, places: DataFrame, limit: int | None = None) -> DataFrame:
    pages = places.select("db_id", F.col("id").alias("place_id"), "url", "title")
    joined = visits.filter("visit_date > 0").join(pages, ["db_id", "place_id"])
    rows = _newest(joined, "visit_date", limit, ["place_id"])
    ns = unix_us_to_ns("visit_date")
    return to_events(
        rows.filter(ns > 0), artifact_type="BROWSER", source="BROWSER",
        artifact="Browser Visit (Firefox)", ts=ns, file_path=F.col("url"),
        message=_visit_message(F.lit("Firefox")))


def firefox_download_events(annos: DataFrame, places: DataFrame, attributes: DataFrame) -> DataFrame:
    """Download notes: inner join to their page, semi join to the download attribute."""
    wanted = attributes.filter(F.col("name") == DOWNLOAD_NOTE).select(
        "db_id", F.col("id").alias("anno_attribute_id"))
    pages = places.select("db_id", F.col("id").alias("place_id"), "url")
    rows = (annos.filter("date_added > 0")
            .join(wanted, ["db_id", "anno_attribute_id"], "left_semi").join(pages, ["db_id", "place_id"]))
    dest = F.coalesce(file_uri_to_path("content"), F.lit(""))
    name = F.coalesce(base_name(blank_to_null(dest)), F.lit("unknown"))
    ns = unix_us_to_ns("date_added")
    return to_events(
        rows.filter(ns > 0), artifact_type="BROWSER", source="BROWSER",
        artifact="Browser Download (Firefox)", ts=ns, file_path=first_filled(dest, "url"),
        message=F.concat(F.lit("Browser Download: "), name, F.lit(" from "),
                         F.coalesce("url", F.lit("")), F.lit(" [Firefox]")))


def wintimeline_events(activity: DataFrame, limit: int | None = None) -> DataFrame:
    """All activity feed entries; with ``limit`` only the newest per database by start time.  The message shows 120
    characters of the payload, ``extra`` holds the whole of it."""
    kept = activity.filter("start_time > 0 OR last_modified_time > 0")
    rows = _newest(kept, "start_time", limit, ["last_modified_time", "app_id", "payload"])
    ns = unix_s_to_ns(F.coalesce(F.nullif("start_time", F.lit(0)), "last_modified_time"))
    rows = (rows.filter(ns > 0).withColumn("_app", timeline_app_name("app_id"))
            .withColumn("_payload", timeline_payload("payload")))
    message = F.concat_ws(
        " | ", F.concat(F.lit("Timeline: "), activity_name("activity_type")), prefixed("app=", "_app"),
        blank_to_null(F.left("_payload", F.lit(120))))
    return to_events(
        rows, artifact_type="WINTIMELINE", source="WINTIMELINE", artifact="Windows Timeline", ts=ns,
        file_path=first_filled("_payload", "db_id"), message=message, extra={"payload": F.col("_payload")})
