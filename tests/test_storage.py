"""Payloads cut over many tasks, and tables of which only touched parts are rewritten."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crawlscope.operators import search as Q
from crawlscope.sinks.current import CurrentTable, History
from crawlscope.skew import latest_rows
from crawlscope.sources import payloads as P

RECORD = "struct<url:string,title:string,n:int,big:string>"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "60000", "spark.sql.files.openCostInBytes": "0"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def hostile(rng):
    return "".join(rng.choice(["}", "{", '"', "\\", "a", " ", "[", "]", ":", ",", "é", "\n", '"pages":[{', "漢"]) for _ in range(rng.randint(0, 12)))


def land(folder: Path, payloads, indent=None):
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join(json.dumps(p, indent=indent, ensure_ascii=bool(indent)) for p in payloads))


def flat(rows):
    return [(r.url, r.title, r.n, len(r.big or "")) for r in sorted(rows, key=lambda r: (r.place.file, r.place.split, r.place.number))]


@pytest.mark.parametrize("indent", [None, 1])
def test_records_of_split_payloads(spark, small_splits, tmp_path, indent):
    rng = random.Random(1)
    want = {}
    for site, n in ((0, 4000), (1, 3), (2, 0)):
        recs = [{"url": f"u{i}", "title": hostile(rng), "og": {hostile(rng): [{}, {"a": "}"}]}, "n": i, "big": hostile(rng) * (40_000 if i == 1300 else 1)} for i in range(n)]
        payload = {"x": {"pages": [{"url": "deeper"}]}, hostile(rng): [{"url": "other"}], "pages": recs, "pages2": [{"url": "other"}], "errors": ["}"]}
        land(tmp_path / f"project_id={site}/snapshot_id=1", [payload, {"pages": [1, "s", {"url": "second", "n": -1}, None]}, {"pages": {"url": "no array"}}], indent)
        want[site] = [(r["url"], r.get("title"), r["n"], len(r.get("big", ""))) for r in [*recs, {"url": "second", "n": -1}]]
    rows = P.read_records(spark, str(tmp_path), "pages", RECORD).collect()
    assert len({r.place.split for r in rows if r.project_id == 0}) > 3
    for site in want:
        assert flat([r for r in rows if r.project_id == site]) == want[site]


def test_a_payload_of_200000_pages_is_read_by_many_tasks(spark, tmp_path):
    land(tmp_path / "project_id=1/snapshot_id=1", [{"pages": [{"url": f"https://a.example/{i}", "title": 'a "quoted" {title}', "n": i} for i in range(200_000)]}])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000000")
    try:
        rows = P.read_records(spark, str(tmp_path), "pages", RECORD)
        assert rows.agg(F.count("*"), F.count_distinct("n"), F.count_distinct("url"), F.count_distinct("title")).first() == (200_000, 200_000, 200_000, 1)
        by_task = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(by_task) > 3 and max(r["count"] for r in by_task) < 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_only_named_payloads_are_read(spark, tmp_path, monkeypatch):
    for snapshot in (1, 2):
        for site in (1, 2):
            land(tmp_path / f"project_id={site}/snapshot_id={snapshot}", [{"pages": [{"url": "a", "n": snapshot}, {"url": "a", "n": 10 + snapshot}, {"url": "b", "n": snapshot}]}])
    index = spark.createDataFrame([(1, 1, "crawler", "ok"), (1, 2, "crawler", "error"), (2, 1, "crawler", "ok"), (2, 2, "crawler", "partial")], "project_id int, snapshot_id int, collector string, status string")
    newest = P.newest_payloads(index, "crawler")
    for few in (100, 0):
        monkeypatch.setattr(P, "FEW", few)
        rows = P.read_records(spark, str(tmp_path), "pages", RECORD, newest)
        last = P.last_of(rows, ["project_id", "snapshot_id", "url"])
        assert sorted((r.project_id, r.snapshot_id, r.url, r.n) for r in last.collect()) == [(1, 1, "a", 11), (1, 1, "b", 1), (2, 2, "a", 12), (2, 2, "b", 2)]
    monkeypatch.setattr(P, "FEW", 100)
    assert "dynamicpruning" in P.record_texts(spark, str(tmp_path), "pages", newest)._jdf.queryExecution().executedPlan().toString()


# --- current tables ------------------------------------------------------------------------------------


def files(path, folder="bucket"):
    found = {}
    for f in Path(path).rglob("*.parquet"):
        found.setdefault(next(p for p in f.parts if p.startswith(f"{folder}=")), set()).add(f.name)
    return found


def test_upsert_leaves_untouched_buckets(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["project_id", "url"], buckets=16)
    assert table.read() is None
    first = spark.createDataFrame([(i % 3, f"u{i}", i, "2024-01-01") for i in range(400)], "project_id int, url string, n int, seen string")
    assert len(table.upsert(first)) == 16
    before = files(tmp_path / "t")
    updates = spark.createDataFrame([(1, "u1", 100, "2024-02-01"), (1, "u1", 101, "2024-02-02"), (None, "new", 5, None)], first.schema)
    touched = table.upsert(updates, keep=["seen"], order="n")
    after = files(tmp_path / "t")
    assert 1 <= len(touched) <= 2
    assert all((before[b] == after[b]) == (int(b.split("=")[1]) not in touched) for b in before)
    rows = {(r.project_id, r.url): (r.n, r.seen) for r in table.read().collect()}
    assert len(rows) == 401 and rows[1, "u1"] == (101, "2024-01-01") and rows[None, "new"] == (5, None) and rows[2, "u2"] == (2, "2024-01-01")
    assert table.upsert(updates.limit(0)) == [] and files(tmp_path / "t") == after
    with pytest.raises(ValueError):
        CurrentTable(spark, str(tmp_path / "t"), ["project_id", "url"], buckets=8).read()


def test_slices_stay_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("crawlscope.sinks.current.ROWS_PER_FILE", 50)
    table = CurrentTable(spark, str(tmp_path / "t"), ["site", "day", "place"], by=["site", "day"], buckets=8)
    rows = [(s, d, p, p) for s in range(4) for d in range(5) for p in range(400 if s == d == 1 else 3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be written by one task
    table.replace_slice(spark.createDataFrame(rows, "site int, day int, place int, v int"), ["site", "day"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(len(v) for v in files(tmp_path / "t").values()) > 1  # the heavy slice is written by several tasks
    touched = table.replace_slice(spark.createDataFrame([(1, 1, 7, -1)], "site int, day int, place int, v int"), ["site", "day"])
    assert len(touched) == 1
    assert sorted(map(tuple, table.read().collect())) == sorted([r for r in rows if r[:2] != (1, 1)] + [(1, 1, 7, -1)])
    with pytest.raises(ValueError):
        table.replace_slice(spark.createDataFrame([(1, 1)], "site int, day int"), ["site"])


def test_a_broken_swap_is_finished(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    schema = "k int, v int"
    table.upsert(spark.createDataFrame([(i, 0) for i in range(40)], schema))
    # as if the driver had died after writing: a whole copy lies beside the table, one bucket is moved already
    new = spark.createDataFrame([(i, 1) for i in range(40)], schema).withColumn("bucket", table._folder_of())
    new.write.partitionBy("bucket").parquet(str(tmp_path / "t-staging"))
    moved = tmp_path / "t/buckets=4/bucket=2"
    for f in moved.iterdir():
        f.unlink()
    moved.rmdir()
    (tmp_path / "t-staging/bucket=2").rename(moved)
    assert sorted(map(tuple, table.read().collect())) == [(i, 1) for i in range(40)]
    assert not (tmp_path / "t-staging").exists()
    # one that was not written in full counts for nothing
    spark.createDataFrame([(1, 9)], schema).withColumn("bucket", table._folder_of()).write.partitionBy("bucket").parquet(str(tmp_path / "t-staging"))
    (tmp_path / "t-staging/_SUCCESS").unlink()
    assert {r.v for r in table.read().collect()} == {1}


# --- histories -----------------------------------------------------------------------------------------


def test_history_reads_only_the_newest_folders(spark, tmp_path):
    rng = random.Random(2)
    schema = "project_id int, date date, query string, page string, clicks long, impressions long, position double"
    rows = [(s, d, f"q{i}", f"p{i % 3}", rng.randint(0, 3), 9, rng.random() * 30) for s in (1, 2, 3, None) for d in range(1, 9 - (s or 0)) for i in range(6)]
    facts = spark.createDataFrame([(s, f"2024-01-0{d}", *r) for s, d, *r in rows], schema.replace("date date", "date string")).withColumn("date", F.to_date("date"))
    kept = History(spark, str(tmp_path / "h"))
    assert len(kept.land(facts)) == 8
    before = files(tmp_path / "h/rows", "date")
    fresh = facts.filter("project_id = 2 AND date = '2024-01-06'").withColumn("clicks", F.lit(50).cast("long")).limit(2)
    late = facts.filter("project_id = 3 AND date = '2024-01-02'")
    assert len(kept.land(fresh.unionByName(late))) == 2
    after = files(tmp_path / "h/rows", "date")
    assert {d for d in before if before[d] != after[d]} == {"date=2024-01-02", "date=2024-01-06"}
    newest = {(r.project_id, str(r.date)) for r in kept.newest().collect()}
    assert newest == {(1, "2024-01-07"), (2, "2024-01-06"), (3, "2024-01-05"), (None, "2024-01-08")}
    whole = facts.filter("NOT (project_id <=> 2 AND date = '2024-01-06')").unionByName(fresh)
    # a site without a name has no newest date that could be met
    assert sorted(map(tuple, kept.current().collect()), key=str) == sorted(map(tuple, latest_rows(whole, ["project_id"], "date").select(*kept.current().columns).collect()), key=str)
    assert sorted(map(tuple, Q.ctr_curve(kept).collect())) == sorted(map(tuple, Q.ctr_curve(whole).collect()))
    plan = Q.ctr_curve(kept)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "clicks" in line]
    assert len(scans) == 1 and "date#" in scans[0].split("PartitionFilters")[1].split("PushedFilters")[0]
    assert all(f"2024-01-0{d}" in scans[0] for d in (5, 6, 7, 8)) and "2024-01-01" not in scans[0]  # the folders of the newest dates
    assert kept.land(facts.limit(0)) == []
