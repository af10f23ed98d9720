import datetime as dt

from hazegrid.llm import urlfilter

D = dt.date
ENTRIES = [
    ("adult", "bad.example.com", "add", D(2024, 1, 10)),
    ("adult", "bad.example.com", "remove", D(2024, 2, 1)),
    ("adult", "bad.example.com", "add", D(2024, 3, 1)),
    ("adult", "bad.example.com", "add", D(2024, 3, 1)),
    ("spam", "example.com", "add", D(2024, 1, 20)),
    ("spam", "ok.org/a/b", "add", D(2024, 1, 1)),
    ("spam", "both.org", "add", D(2024, 1, 5)),
    ("spam", "both.org", "remove", D(2024, 1, 5)),
    ("spam", None, "add", D(2024, 1, 5)),
    ("x", "never.org", "remove", D(2024, 1, 5)),
    ("x", "bad.day.org", "add", None),
]
URLS = [
    "http://bad.example.com/", "HTTPS://user:pw@Bad.Example.COM:8080/x?y#z", "http://sub.bad.example.com./q", "http://notbad.example.com",
    "http://ok.org/a/b/c", "http://ok.org/a/bc", "http://ok.org//a//b", "http://both.org/", "ftp://never.org", "no url at all", "", None,
    "http://bad.day.org/", "http://com/", "http://" + "a." * 60 + "example.com/" + "p/" * 200,
]
DAYS = [D(2024, 1, 5), D(2024, 1, 10), D(2024, 1, 25), D(2024, 2, 1), D(2024, 2, 15), D(2024, 3, 2), None]


def slow(url, day):
    """All events replayed up to the day, for every key that covers the URL."""
    if url is None or "://" not in url:
        return None, []
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".")
    path = rest[cut:].split("?")[0].split("#")[0]
    if not host:
        return None, []
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    keys = {host} | {".".join(labels[i:]) for i in range(len(labels) - 1)} | {"/".join([host, *parts[:i]]) for i in range(1, len(parts) + 1)}
    held = []
    for lst, key in sorted({(a, k) for a, k, _, d in ENTRIES if k in keys and d}):
        now = False
        for when in sorted({d for a, k, _, d in ENTRIES if (a, k) == (lst, key) and d}):
            if day is not None and when <= day:
                now = "remove" not in {x for a, k, x, d in ENTRIES if (a, k, d) == (lst, key, when)}
        if now:
            held.append((lst, key))
    return host, held


def test_captures_against_replay(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, key string, action string, day date")
    rows = [(i, u, d, "extra") for i, (u, d) in enumerate((u, d) for u in URLS for d in DAYS)]
    rows += [(0, *rows[0][1:]), (None, "http://bad.example.com/", D(2024, 1, 25), "extra")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, key string")
    got = urlfilter.judge(captures, entries)
    assert got.count() == len(rows)
    have = sorted((str(r.page_id), r.host, r.n_active, r.lists, r.entry, r.blocked) for r in got.collect())
    want = []
    for i, u, d, _ in rows:
        host, held = slow(u, d)
        entry = min((k for _, k in held), key=lambda k: (-len(k), k), default=None)
        want.append((str(i), host, len(held), ",".join(sorted({x for x, _ in held})), entry, bool(held)))
    assert sorted(have, key=str) == sorted(want, key=str)
    nothing = spark.createDataFrame([], entries.schema)
    assert urlfilter.judge(captures, nothing).where("blocked").count() == 0
    assert urlfilter.judge(captures.limit(0), entries).count() == 0
