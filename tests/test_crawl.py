import pytest
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.operators import crawl
from webloom.operators.ranking import first_per_key
from webloom.sources import crawl_log
from webloom.streaming import frontier

LOG = """https://a.example.com/1 --> 200 --> pages/1.html
https://a.example.com/2 --> 200 --> ERROR_SAVING_HTML
https://a.example.com/3 --> forbidden by robotstxt for AgentX
https://a.example.com/4 --> ERROR: 403 Client Error
https://a.example.com/5 --> ERROR: Read timed out (ReadTimeoutError)
https://a.example.com/6 --> Unreachable
https://a.example.com/7 --> UNEXPECTED_ERROR: boom --> again
line without arrows
"""


@pytest.fixture
def log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    return crawl_log.read_crawl_log(spark, str(tmp_path / "log.txt"))


def test_log_fields(log):
    rows = log.orderBy("pos").collect()
    assert [r.status for r in rows] == ["fetched", "save_error", "forbidden", "error", "error", "unreachable",
                                        "unexpected"]
    assert [r.http_status for r in rows] == [200, 200, None, None, None, None, None]
    assert [r.file for r in rows] == ["pages/1.html"] + [None] * 6
    assert rows[2].detail == "AgentX" and rows[6].detail == "boom --> again"
    classes = log.filter("status = 'error'").orderBy("pos").select(F.expr(X.classify_error("detail"))).collect()
    assert [c[0] for c in classes] == ["access_denied", "timeout"]


def test_log_round_trip_and_missing_file(spark, log, tmp_path):
    out = str(tmp_path / "out")
    crawl_log.write_crawl_log(log, out)
    crawl_log.write_crawl_log(log.limit(0), out)
    again = crawl_log.read_crawl_log(spark, out)
    assert sorted(map(tuple, again.drop("pos").collect()), key=str) == sorted(map(tuple, log.drop("pos").collect()), key=str)
    missing = crawl_log.read_crawl_log(spark, str(tmp_path / "none"))
    assert missing.count() == 0 and missing.columns == log.columns


def test_multi_line_results(spark, tmp_path):
    (tmp_path / "r.jl").write_text('{"url": "https://a/",\n "crawl_time": "2025-06-20 21:41:50",\n "errors": "late"}')
    row = crawl_log.read_crawl_results(spark, str(tmp_path / "r.jl")).first()
    assert row.url == "https://a/" and str(row.crawl_time) == "2025-06-20 21:41:50" and row.errors == "late"


def test_unvisited_keeps_order_and_repetitions(spark, log):
    urls = spark.createDataFrame([(i, f"https://a.example.com/{n}") for i, n in enumerate([9, 1, 3, 8, 9])],
                                 "pos long, url string")
    got = crawl.unvisited_urls(urls, log).orderBy("pos").collect()
    assert [(r.pos, r.url[-1]) for r in got] == [(0, "9"), (3, "8"), (4, "9")]
    summary = {r.status: r.n_urls for r in crawl.crawl_summary(urls, log).collect()}
    assert summary["skipped_visited"] == 2 and summary["error"] == 2 and summary["fetched"] == 1


@pytest.mark.parametrize("limit", [0, 1, 3, 2000])
def test_max_pages_counts_only_fetched(spark, limit):
    rows = [(i, "h" if i % 3 else "g", "fetched" if i % 4 else "forbidden") for i in range(6000)]
    df = spark.createDataFrame(rows, "pos long, host string, status string").repartition(5)
    expected = []
    for host in ("h", "g"):
        done = 0
        for pos, h, status in rows:
            if h == host and done < limit:
                expected.append(pos)
                done += status == "fetched"
    assert sorted(r.pos for r in crawl.max_pages(df, limit).collect()) == sorted(expected)


def test_first_per_key_beyond_the_group_limit(spark):
    df = spark.range(5000).selectExpr("id", "id % 2 AS k").repartition(4)
    small = first_per_key(df, ["k"], [F.col("id")], 3)
    large = first_per_key(df, ["k"], [F.col("id")], 1500)
    assert sorted(r.id for r in small.collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.id for r in large.collect()) == list(range(3000))
    assert sorted(r.id for r in first_per_key(df, [], [F.col("id")], 2).collect()) == [0, 1]


def test_filter_in_list(spark):
    df = spark.createDataFrame([("US",), ("DE",), (None,)], "code string")
    assert crawl.filter_in_list(df, "code", ["DE"]).count() == 1
    assert crawl.filter_in_list(df, "code", []).count() == crawl.filter_in_list(df, "code", None).count() == 3


def test_frontier_and_forbidden(spark, log):
    urls = spark.createDataFrame([(i, f"https://a.example.com/{p}") for i, p in enumerate(["x", "1", "no/1", "y", "z"])],
                                 "pos long, url string")
    files = spark.createDataFrame([("https://a.example.com/robots.txt", "User-agent: *\nDisallow: /no", 200)],
                                  "robotstxt_url string, body string, http_status int")
    got = crawl.crawl_frontier(urls, log, files, "AgentX", 2).orderBy("pos").collect()
    assert [r.url[-1] for r in got] == ["x", "y"]
    decided = crawl.crawl_decisions(urls, log, files, "AgentX")
    lines = crawl.forbidden_outcomes(decided, "AgentX").selectExpr(f"{crawl_log.crawl_log_line()} AS l").collect()
    assert [r.l for r in lines] == ["https://a.example.com/no/1 --> forbidden by robotstxt for AgentX"]


def test_incremental_frontier_passes_every_url_once(spark, tmp_path):
    def deliver(*urls):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(checkpoint):
        frontier.incremental_frontier(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / checkpoint), 1) \
            .awaitTermination()
        return sorted(r.url for r in frontier.passed_urls(spark, str(tmp_path / "out")).collect())

    deliver("a", "b", "a")
    deliver("b", "c")
    assert run("c1") == ["a", "b", "c"]
    assert run("c1") == ["a", "b", "c"]
    deliver("c", "d")
    assert run("c1") == ["a", "b", "c", "d"]
    assert run("c2") == ["a", "b", "c", "d"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    batch = spark.createDataFrame([("a",), ("b",)], "url string")
    frontier.pass_batch(batch, 0, table, "s")
    frontier.pass_batch(batch.union(batch), 0, table, "s")
    frontier.pass_batch(batch, 1, table, "s")
    assert sorted(r.url for r in frontier.passed_urls(spark, table).collect()) == ["a", "b"]


def test_page_limit_of_a_run(spark):
    rows = [(i, "fetched" if i % 2 else "error") for i in range(9)]
    df = spark.createDataFrame(rows, "pos long, status string")
    kept = lambda n: [r.pos for r in crawl.max_pages(df, n, keys=()).orderBy("pos").collect()]
    assert kept(2) == [0, 1, 2, 3] and kept(50) == list(range(9)) and kept(0) == []


def test_a_batch_reads_only_its_slices(spark, tmp_path):
    table = str(tmp_path / "t")
    frontier.pass_batch(spark.range(2000).selectExpr("cast(id AS string) AS url"), 0, table, "s")
    one = frontier.passed_urls(spark, table).filter("slice IN (3) AND batch_id < 1").select("url")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < one.count() < 100
    frontier.pass_batch(spark.createDataFrame([("7",), ("new",), (None,)], "url string"), 1, table, "s")
    assert frontier.passed_urls(spark, table).filter("batch_id = 1").select("url").collect() == [("new",)]


def test_log_positions_follow_file_names_and_lines(spark, tmp_path):
    """An old file of one line comes before a new one of many, whatever Spark packs first; splits keep their order."""
    from webloom.sources.crawl_log import read_crawl_log

    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "part-0000.txt").write_text("https://old.com/1 --> Unreachable\n")
    (folder / "part-0001.txt").write_text("".join(f"https://new.com/{i} --> 200 --> f{i}.html\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = read_crawl_log(spark, str(folder)).select("pos", "url").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = [r.url for r in sorted(rows, key=lambda r: r.pos)]
    assert got == ["https://old.com/1"] + [f"https://new.com/{i}" for i in range(3000)]
    assert sorted(r.pos for r in rows) == list(range(3001))


@pytest.mark.parametrize("keys", [["host"], []])
def test_first_rows_beyond_the_group_limit_spread_over_tasks(spark, keys):
    """A key with most rows and n above the window group limit: same rows as a plain ranking, and rows move by ranges,
    so no exchange brings a whole key into one task."""
    from webloom.operators.ranking import ranked_per_key

    rows = [("hot" if i % 4 else f"h{i % 7}" if i % 3 else None, i, (i * 7919) % 10007) for i in range(20000)]
    df = spark.createDataFrame(rows, "host string, i long, o long")
    order = [F.col("o"), F.col("i")]
    got = ranked_per_key(df, keys, order, 4000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Rows move by ranges of (key, order); only the counts, one row per partition and key, meet by key alone.
    assert "rangepartitioning" in plan
    assert "SinglePartition" not in plan or not keys
    plain = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        plain.setdefault(r[0] if keys else None, []).append(r)
    want = {(r[1], rank + 1) for rs in plain.values() for rank, r in enumerate(rs[:4000])}
    assert {(r["i"], r["rank"]) for r in got.collect()} == want


def test_frontier_folders_stay_few_and_reruns_change_nothing(spark, tmp_path):
    """40 batches with a fan-out of 2 leave a logarithmic number of folders; every URL passes once; a batch that runs
    again, and a merge cut off before it was whole, change nothing."""
    table = str(tmp_path / "out")
    batches = [spark.createDataFrame([(f"u{b}-{i}",) for i in range(3)] + [("u0-0",)], "url string") for b in range(40)]
    for b, batch in enumerate(batches):
        frontier.pass_batch(batch, b, table, "s", fanout=2)
    units = frontier._units(spark, table, "s")
    assert len(units) <= 2 * 7
    want = sorted({f"u{b}-{i}" for b in range(40) for i in range(3)})
    assert sorted(r.url for r in frontier.passed_urls(spark, table).collect()) == want
    frontier.pass_batch(batches[-1], 39, table, "s", fanout=2)
    (tmp_path / "out" / "_merged" / "source=s" / "range=0-99").mkdir(parents=True)
    assert sorted(r.url for r in frontier.passed_urls(spark, table).collect()) == want
