"""Revisits against a plain as-of search, with ids and rows that repeat."""

import random

from tidewell.llm.revisit import resolve_revisits

SCHEMA = (
    "record_id long, url string, at long, kind string, etag string, last_modified string, digest string,"
    " headers map<string,string>, payload string, key int, stretch string"
)


def row(record_id, url, at, kind, etag=None, modified=None, digest=None, headers=None, payload=None):
    return (record_id, url, at, kind, etag, modified, digest, headers, payload, 1, "clash")


def resolved(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(
        ((r["record_id"], r["canonical_url"], r["status"], r["response_id"], r["payload"]) for r in resolve_revisits(frame).collect()),
        key=repr,
    )


def expected(rows):
    found = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [
            f for f in rows
            if f[3] == "response" and f[1] is not None and f[1] == r[1] and None not in (f[2], r[2]) and f[2] < r[2]
        ]
        if not earlier:
            found.append((r[0], r[1], "no_earlier_response", None, None))
            continue
        best = max(earlier, key=lambda f: (f[2], f[0] is not None, f[0] or 0))
        pairs = [(r[4], best[4]), (r[5], best[5]), (r[6], best[6])]
        pairs = [a == b for a, b in pairs if None not in (a, b)]
        status = "unvalidated" if not pairs else "resolved" if pairs[0] else "validator_mismatch"
        if status == "resolved" and None not in (r[6], best[6]) and r[6] != best[6]:
            status = "validator_mismatch"
        ok = status == "resolved"
        found.append((r[0], r[1], status, best[0] if ok else None, best[8] if ok else None))
    return sorted(found, key=repr)


def test_repeated_responses_ids_and_null_ids(spark):
    rows = [
        row(1, "a/x", 1, "response", "t", payload="first"), row(1, "a/x", 1, "response", "t", payload="first"),
        row(2, "a/x", 2, "revisit", "t"), row(2, "a/y", 2, "revisit", "t"), row(2, "a/x", 2, "revisit", "t"),
        row(1, "a/y", 1, "response", "t", payload="other"), row(None, "a/x", 5, "revisit", "t"),
        row(None, "a/z", 1, "response", "n", payload="nameless"), row(7, "a/z", 2, "revisit", "n"),
        row(8, None, 3, "revisit"), row(9, "a/x", None, "revisit"), row(None, None, None, None),
    ]
    assert resolved(spark, rows) == expected(rows)


def test_many_captures_in_bursts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        url = rng.choice(["a/hot", "a/hot", "a/hot", "a/one", "a/two", None])
        at = rng.choice([None, 5, 5, 5, 6, *range(7, 40), 10**12])
        kind = rng.choice(["response", "revisit", "revisit", "revisit"])
        tag = rng.choice([None, "s", "t"])
        rows.append(row(i, url, at, kind, tag, rng.choice([None, "d"]), None, {"Date": "x"}, f"body {i}"))
    assert resolved(spark, rows) == expected(rows)


def test_nothing_at_all(spark):
    assert resolved(spark, []) == []
    assert resolved(spark, [row(1, "a", 1, "revisit")]) == [(1, "a", "no_earlier_response", None, None)]
