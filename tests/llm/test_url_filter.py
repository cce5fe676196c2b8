from lumaloom.llm import url_filter as U

ENTRIES = [
    ("host", "A.example.com", "block", "add", 10), ("host", "a.example.com", "block", "remove", 20), ("host", "a.example.com", "block", "add", 30),
    ("path", "a.example.com/ok", "allow", "add", 5), ("domain", "example.org", "block", "add", 0), ("domain", "example.org", "block", "add", 0),
    ("host", None, "block", "add", 1), ("host", "same.net", "block", "add", 7), ("host", "same.net", "block", "remove", 7), ("host", "tie.net", "block", "add", 0), ("host", "tie.net", "allow", "add", 0),
]
CAPTURES = [
    (1, "http://a.example.com/x", 9, "none"), (2, "http://a.example.com/x", 10, "block"), (3, "http://A.example.com:80/x?y#z", 19, "block"), (4, "http://a.example.com/x", 20, "none"),
    (5, "http://a.example.com/x", 99, "block"), (6, "http://u:p@a.example.com/ok/deep", 12, "allow"), (7, "http://a.example.com/okay", 12, "block"), (8, "https://sub.example.org./", 1, "block"),
    (9, "https://notexample.org/", 1, "none"), (10, None, 1, "none"), (11, "not a url", 1, "none"), (12, "http://a.example.com/x", None, "none"), (13, "http://same.net/", 8, "none"), (14, "http://tie.net/", 1, "block"),
]


def test_verdicts(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, list string, action string, day int")
    captures = spark.createDataFrame([c[:3] + ("x",) for c in CAPTURES + CAPTURES[:1]], "page_id long, url string, fetched_day int, key string")
    got = sorted((r["page_id"], r["verdict"]) for r in U.filter_urls(captures, entries).collect())
    # both rows of a repeated capture stay
    assert got == sorted([(c[0], c[3]) for c in CAPTURES + CAPTURES[:1]])
    assert U.filter_urls(captures.limit(0), entries).count() == 0
    assert {r["verdict"] for r in U.filter_urls(captures, entries.limit(0)).collect()} == {"none"}


def test_captures_of_one_id(spark):
    """Captures of one page at other times, with other URLs, without an id and at equal times."""
    entries = spark.createDataFrame([("host", "a.example.com", "block", "add", 10)], "kind string, pattern string, list string, action string, day int")
    rows = [(1, "http://a.example.com/", 5), (1, "http://a.example.com/", 50), (1, "http://b.example.com/", 50), (None, "http://a.example.com/", 50), (None, "http://a.example.com/", 5), (1, "http://a.example.com/", 50)]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_day int"), entries).collect()
    want = [(None, 5, "none", 1), (None, 50, "block", 1), (1, 5, "none", 1), (1, 50, "block", 1), (1, 50, "block", 1), (1, 50, "none", 0)]
    assert sorted(((r["page_id"] or 0, r["fetched_day"], r["verdict"], r["n_listed"]) for r in got)) == [(a or 0, *b) for a, *b in want]
