"""Revisit resolution against a plain search."""

import random

import pytest

from tideclock.llm import warc

SCHEMA = "record_id bigint, kind string, url string, date bigint, http_status int, etag string, last_modified string, headers map<string,string>, body string, part string, canonical_url string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#top", "example.com/a?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com/?ref=x", "example.com"),
        ("https://example.com:8080/A//", "example.com:8080/A"),
        ("https://example.com/x?referrer=1&ref", "example.com/x?referrer=1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(warc.F.col("u"))).first()[0] == want


def plain(rows):
    out = []
    for rid, kind, url, date, _, etag, modified, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and r[4] == 200 and url is not None and r[2] == url and date is not None and r[3] is not None and (r[3], r[0]) < (date, rid)]
        if not earlier:
            out.append((rid, "no_response", None, None, None))
            continue
        r = max(earlier, key=lambda r: (r[3], r[0]))
        weak = lambda t: t and t.removeprefix("W/")
        if etag is None and modified is None:
            out.append((rid, "no_validator", r[0], None, None))
        elif (weak(etag) == weak(r[5])) if etag is not None else (modified is not None and modified == r[6]):
            folded = lambda h: {k.lower(): v for k, v in sorted((h or {}).items()) if v is not None}
            fresh = {k: v for k, v in folded(headers).items() if k in warc.PERMITTED}
            out.append((rid, "resolved", r[0], folded(r[7]) | fresh, r[8]))
        else:
            out.append((rid, "mismatch", r[0], None, None))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("parts", [1024, 3])
def test_against_plain_search(spark, monkeypatch, parts):
    monkeypatch.setattr(warc, "PARTS", parts)
    rng, rows = random.Random(parts), []
    for rid in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        url = rng.choice(["a.com/1"] * 6 + ["a.com/2", "b.org", None])
        tag = rng.choice(['"x"', 'W/"x"', '"y"', None])
        headers = rng.choice([None, {"Date": str(rid), "Content-Length": "0"}, {"ETag": "n", "X-A": "1", "VARY": None}, {"Date": "1", "date": str(rid), "DATE": "0", "x-a": None, "X-a": "2"}])
        rows.append((rid, kind, url, rng.choice([None, *range(40)]), rng.choice([200, 200, 404]) if kind == "response" else 304, tag, rng.choice(["m1", "m2", None]), headers, f"body{rid}" if kind == "response" else None))
    given = [(*r[:2], r[2] and "http://" + r[2], *r[3:], "p", "c") for r in rows]
    got = warc.resolve(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    assert sorted(((r["record_id"], r["status"], r["response_id"], r["headers"], r["body"]) for r in got), key=lambda x: x[0]) == plain(rows)
    assert {r["status"] for r in got} == {"resolved", "no_response", "no_validator", "mismatch"}


def test_empty_table(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_bad_date_and_a_hot_url(spark):
    """A date far off the others leaves the records of a hot URL dealt over the parts."""
    rows = [(i, "response" if i % 2 else "revisit", "http://a.com/", 10**14 if i == 77 else i, 200, '"x"', None, None, "b", "p", "c") for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    bounds = warc.quantile_bounds(frame, "date", 64)
    sizes = [r["count"] for r in frame.groupBy(warc.range_of(warc.F.col("date"), bounds, "bigint")).count().collect()]
    assert max(sizes) < 200
    got = {r["record_id"]: r["response_id"] for r in warc.resolve(frame).collect()}
    assert all(got[i] == (None if i == 0 else i - 1 if i != 78 else 75) for i in range(0, 4000, 2))
