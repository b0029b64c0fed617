"""Not-modified revisits of web captures, resolved to the response they confirm.

A revisit record has no body: it says that a page had not changed. It is resolved
by an as-of join to the latest strictly earlier full response with the same canonical
URL. Its validators (entity tag, else date of last modification, and the payload
digest where both have one) must agree with that response; then it takes over the
payload, and the response's headers with those replaced that a not-modified answer
may update.

All captures of a URL at one instant are one row of the as-of step. A URL with very many
instants is cut into stretches of time of about equally many rows: rows look back within
their stretch, and the latest response before a stretch comes from one row a stretch.
Bodies take no part in that; they join, by URL, instant, id and validators of the response,
at the end, with those revisits alone that have one.

Edge cases: revisits without URL or time, and those with no earlier response, are
``no_earlier_response``; of responses at one instant the one with the greatest id counts, a
null id being the least, and of equal ids one, by a hash of the validators; of responses
alike in all of these any one's headers and body are taken; a revisit with no validator in
common with the response is ``unvalidated``; null headers count as none. Every revisit row
gives one row: ids may be null or repeat, under other URLs too, and a response given
twice multiplies nothing. Bodies of any length travel once for each revisit they resolve. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.llm.common import scratch
from tidewell.workspace import Workspace

# Headers that a not-modified answer may update, and query parameters
# that don't tell pages apart.
PERMITTED = (
    "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary",
)
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)"

# Stretches of time: one for so many rows, at least and at most so many.
ROWS_A_STRETCH, LEAST_STRETCHES, MOST_STRETCHES = 1_000_000, 16, 512


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, leading ``www.``, default port, fragment, final slash and
    tracking parameters; the host in small letters, the other parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    )
    return F.concat(
        host,
        F.regexp_replace(path, "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def _entries(headers: Column) -> Column:
    """Header entries with names in small letters; null headers give none."""
    pairs = F.coalesce(F.map_entries(headers), F.expr("array()"))
    return F.transform(
        pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted ones of the not-modified answer, sorted by name.

    array<struct<key, value>>. A name given twice in different case keeps both values.
    """
    new = F.filter(_entries(fresh), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(new, lambda e: e["key"])
    old = F.filter(_entries(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.array_sort(F.concat(old, new))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _stretch(instants: DataFrame) -> Column:
    """Number of the stretch of time that ``at`` falls into; stretches hold about equally many rows."""
    count = instants.count()
    parts = max(LEAST_STRETCHES, min(MOST_STRETCHES, count // ROWS_A_STRETCH))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = instants.agg(F.percentile_approx("at", shares, 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda cut: cut <= F.col("at")))


def latest_responses(records: DataFrame, workspace: Workspace) -> DataFrame:
    """(key, at, response_at, response_id, mark) of the instants at which a URL was revisited
    after an earlier full response.

    ``records``: record_id, at and mark (longs), key, is_full. Which response is the latest
    depends on URL and instant alone, so all captures of one instant are one row.
    """
    response = F.when(F.col("is_full"), F.struct(F.col("record_id").alias("id"), "mark"))
    instants = (
        records.where("key is not null and at is not null")
        .groupBy("key", "at")
        .agg(F.max(response).alias("here"), F.max(~F.col("is_full")).alias("asked"))
    )
    instants = workspace.stage(instants, "instants")
    rows = instants.withColumn("stretch", _stretch(instants))
    full = F.when(F.col("here").isNotNull(), F.struct(F.col("at").alias("response_at"), "here.*"))
    rows = rows.select("key", "at", "asked", "stretch", full.alias("response"))
    within = Window.partitionBy("key", "stretch").orderBy("at")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    before = (
        Window.partitionBy("key")
        .orderBy("stretch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy("key", "stretch")
        .agg(F.max("response").alias("last"))
        .select("key", "stretch", F.max("last").over(before).alias("carried"))
    )
    near = rows.withColumn("near", F.last("response", ignorenulls=True).over(earlier)).where("asked")
    found = near.join(carried, ["key", "stretch"]).select(
        "key", "at", F.coalesce("near", "carried").alias("response")
    )
    found = found.where("response is not null").select(
        "key", "at", "response.response_at", F.col("response.id").alias("response_id"), "response.mark"
    )
    return workspace.stage(found, "found")


def _judged(pairs: DataFrame) -> DataFrame:
    """The status of revisits joined with their response, and what it gives them."""
    tag = F.when(
        F.col("etag").isNotNull() & F.col("full_etag").isNotNull(),
        _strong(F.col("etag")) == _strong(F.col("full_etag")),
    )
    modified = F.col("last_modified") == F.col("full_last_modified")
    body = F.col("digest") == F.col("full_digest")
    agrees = F.coalesce(tag, modified, body)
    status = (
        F.when(agrees.isNull(), "unvalidated")
        .when(agrees & F.coalesce(body, F.lit(True)), "resolved")
        .otherwise("validator_mismatch")
    )
    resolved = F.col("status") == "resolved"
    return pairs.withColumn("status", status).select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "status",
        F.when(resolved, F.col("response_id")).alias("response_id"),
        F.when(resolved, merged_headers(F.col("full_headers"), F.col("headers"))).alias("headers"),
        F.when(resolved, F.col("full_payload")).alias("payload"),
    )


def resolve_revisits(records: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Every revisit with the response it confirms.

    ``records``: record_id long, url string, at long (an instant in any unit),
    kind string (``response`` or ``revisit``), etag, last_modified and digest strings,
    headers map<string, string>, payload string; further columns are ignored. Returns
    record_id, canonical_url, status, response_id, headers (merged, array of key and value)
    and payload, the last three null unless the status is ``resolved``.
    """
    workspace = workspace or scratch(records.sparkSession, "revisits")
    keyed = records.select(
        "record_id", "url", F.col("at").cast("long").alias("at"), "kind", "etag",
        "last_modified", "digest", "headers", "payload",
    ).withColumn("key", canonical_url(F.col("url")))
    mark = F.xxhash64("etag", "last_modified", "digest").alias("mark")
    narrow = keyed.where("kind in ('response', 'revisit')").select(
        "record_id", "at", "key", F.expr("kind = 'response'").alias("is_full"), mark
    )
    found = latest_responses(narrow, workspace)
    revisits = keyed.where("kind = 'revisit'").drop("payload", "url", "kind")
    known = revisits.where("key is not null and at is not null")
    # Only what was found meets the bodies, so rows without a response make no key hot.
    matched = known.join(found, ["key", "at"])
    lost = known.join(found.select("key", "at"), ["key", "at"], "left_anti").select(revisits.columns)
    lost = lost.unionByName(revisits.where("key is null or at is null"))
    identity = ["key", "response_at", "response_id", "mark"]
    full = keyed.where("kind = 'response'").select(
        "key",
        F.col("at").alias("response_at"),
        F.col("record_id").alias("response_id"),
        mark,
        *(F.col(c).alias(f"full_{c}") for c in ("etag", "last_modified", "digest", "headers", "payload")),
    )
    counted = narrow.where("is_full").groupBy("key", "at", "record_id", "mark").count()
    if not counted.where("count > 1").isEmpty():
        full = full.dropDuplicates(identity)
    same = F.col("f.response_id").eqNullSafe(F.col("r.response_id"))
    for column in ("key", "response_at", "mark"):
        same = same & (F.col(f"f.{column}") == F.col(f"r.{column}"))
    pairs = matched.alias("r").join(full.alias("f"), same).select(
        "r.*", *(f"f.full_{c}" for c in ("etag", "last_modified", "digest", "headers", "payload"))
    )
    judged = _judged(pairs)
    kinds = dict(judged.dtypes)
    missing = lost.select(
        "record_id",
        F.col("key").alias("canonical_url"),
        F.lit("no_earlier_response").alias("status"),
        *(F.lit(None).cast(kinds[c]).alias(c) for c in ("response_id", "headers", "payload")),
    )
    return judged.unionByName(missing)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Records as a crawl of ``pages`` would leave them: three for every page.

    A full response when the page's turn comes; a revisit before that turn, which
    only another page of the same canonical URL can precede; and a revisit after it,
    under another spelling of the URL. Of four of these later revisits one repeats the
    entity tag, one weakly, one has only the date, and one tells of another version.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    case = F.col("page_id") % 4
    shared = [F.col("page_id"), F.col("url"), F.col("html")]

    def record(number: int, kind: str, url: Column, shift: int, etag: Column, headers: Column):
        return F.struct(
            (F.col("page_id") * 3 + number).alias("record_id"),
            url.alias("url"),
            (F.col("page_id") * 10 + shift).alias("at"),
            F.lit(kind).alias("kind"),
            etag.alias("etag"),
            day.alias("last_modified"),
            F.when(F.lit(kind == "response"), F.md5("html")).alias("digest"),
            headers.alias("headers"),
            F.when(F.lit(kind == "response"), F.col("html")).alias("payload"),
        )

    revisit_tag = (
        F.when(case == 0, tag)
        .when(case == 1, F.concat(F.lit("W/"), tag))
        .when(case == 3, F.lit('"other"'))
    )
    kept = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag,
        F.lit("Date"), day, F.lit("Server"), F.lit("first"),
    )
    fresh = F.create_map(
        F.lit("Date"), F.concat(day, F.lit(" later")), F.lit("Server"), F.lit("second"),
        F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    records = F.array(
        record(0, "response", F.col("url"), 0, tag, kept),
        record(1, "revisit", again, 5, revisit_tag, fresh),
        record(2, "revisit", F.col("url"), -5, tag, fresh),
    )
    return pages.select(*shared).select(F.inline(records))
