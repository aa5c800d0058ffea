import datetime as dt
import random

from maskwright.llm import queries, url_lists

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def keys(url):
    head, _, tail = url.partition("://")
    host = tail.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    cut = min([i for i in (tail.find("?"), tail.find("#")) if i >= 0], default=len(tail))
    path = tail[:cut][tail[:cut].find("/") :] if "/" in tail[:cut] else ""
    labels, parts = host.split("."), path.split("/")
    found = {("host", host)} | {("domain", ".".join(labels[i:])) for i in range(max(len(labels) - 1, 1))}
    return found | {("prefix", host + "/".join(parts[:i]) + ("/" if i < len(parts) else "")) for i in range(1, len(parts) + 1)}


def active(entries, lst, key, at):
    state = {}
    for name, kind, value, action, dated in entries:
        if (name, kind, value) == (lst, *key) and dated <= at:
            state[dated] = max(state.get(dated, ""), action)
    return bool(state) and state[max(state)] == "add"


def test_random_lists(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/1.html', '/en//2', '?q=/z', '/en/1#f'])}" for _ in range(80)]
    captures = [(i, u, day(rng.randint(0, 30))) for i, u in enumerate(urls)] + [(99, "HTTPS://me@B.A.com:80/en/1.html", day(9))]
    pool = sorted({k for u in urls for k in keys(u)})
    entries = [(rng.choice(["spam", "allow"]), *rng.choice(pool), rng.choice(["add", "remove"]), day(rng.randint(0, 30))) for _ in range(150)]
    found = url_lists.evaluated(
        spark.createDataFrame(captures, "page_id int, url string, fetched_at date"),
        spark.createDataFrame(entries, "list string, kind string, value string, action string, dated date"),
    )
    rows = {r.page_id: r for r in found.collect()}
    assert len(rows) == len(captures)
    for i, url, at in captures:
        own = sorted(f"{lst}:{k}:{v}" for lst in ("spam", "allow") for k, v in keys(url) if active(entries, lst, (k, v), at))
        assert rows[i].active == ",".join(own), (url, at)
        assert rows[i].n_active == len(own)
        assert rows[i].blocked == (bool(own) and not any(x.startswith("allow:") for x in own))


def test_intervals(spark):
    entries = [("l", "host", "h", a, day(d)) for a, d in [("remove", 1), ("add", 2), ("add", 3), ("remove", 5), ("add", 5), ("add", 7), ("remove", 9), ("remove", 10), ("add", 20)]]
    df = spark.createDataFrame(entries + entries[:3], "list string, kind string, value string, action string, dated date")
    rows = sorted((r.valid_from, r.valid_to or day(99)) for r in url_lists.intervals(df).collect())
    # on day 5 both happen and the removal counts
    assert rows == [(day(2), day(5)), (day(7), day(9)), (day(20), day(99))]


def test_awkward_captures(spark):
    schema = "page_id int, url string, fetched_at date, kind string, value string"
    rows = [(1, None, DAY, "k", "v"), (2, "", DAY, "k", "v"), (3, "no url", None, "k", "v"), (4, "http://a.com/" + "x/" * 2000, DAY, "k", "v"), (5, "http://a.com", None, "k", "v"), (5, "http://a.com", None, "k", "v")]
    entries = spark.createDataFrame([("spam", "host", "a.com", "add", DAY), (None, "host", "a.com", "add", DAY), ("spam", "host", "a.com", "add", None)], "list string, kind string, value string, action string, dated date")
    captures = spark.createDataFrame(rows, schema)
    found = {r.page_id: r for r in url_lists.evaluated(captures, entries).collect()}
    assert {i: r.n_active for i, r in found.items()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    assert url_lists.evaluated(captures, entries.limit(0)).filter("blocked").count() == 0
    assert url_lists.evaluated(captures.limit(0), entries).count() == 0


def test_no_python_in_the_plan(spark):
    found = queries.op3_temporal_url_lists(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
