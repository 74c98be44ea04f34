import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from parasift.plans.stages import StagedJob, run_pages_job
from parasift.schema import DOCUMENT
from parasift.sources.exchange import read_records, write_records
from parasift.sources.page_files import read_page_files
from parasift.sources.tables import read_table

GOOD = '{"doc_id":"a","title":null,"segments":[{"segment_id":"s","text":"x","path":null,"position":0}],"hints":{"k":"v"}}'


def test_bad_lines_go_to_the_quarantine_with_reasons(spark, tmp_path):
    lines = [GOOD, '{"doc_id":"b","segments":[{"text":"x"', "not json", '{"title":"no id"}', "", '{"doc_id":"c","segments":"wrong kind"}', "[1]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text("\n".join(lines))
    with gzip.open(tmp_path / "in" / "two.json.gz", "wt") as f:
        f.write(GOOD.replace('"a"', '"z"'))
    good, bad = read_records(spark, str(tmp_path / "in"), DOCUMENT, ["doc_id"], str(tmp_path / "bad"))
    assert sorted(r["doc_id"] for r in good.collect()) == ["a", "z"]
    row = good.filter("doc_id = 'a'").first()
    assert row["title"] is None and row["hints"] == {"k": "v"} and row["segments"][0]["path"] is None and row["url"] is None
    found = {r["record"]: (r["file"], r["reason"]) for r in bad.collect()}
    assert found["not json"] == ("one.json", "unreadable") and found['{"title":"no id"}'][1] == "without doc_id"
    assert len(found) == 5 and os.path.exists(tmp_path / "bad" / "_SUCCESS")


def test_records_round_trip_with_nulls(spark, tmp_path):
    docs = spark.createDataFrame([("a", None, [("s", "x", None, 0)], None), ("b", "t", [], {"k": None})],
                                 "doc_id string, title string, segments array<struct<segment_id:string,text:string,path:string,position:long>>, hints map<string,string>")
    write_records(docs, str(tmp_path / "out"))
    good, bad = read_records(spark, str(tmp_path / "out"), docs.schema)
    assert sorted(good.collect(), key=lambda r: r[0]) == sorted(docs.collect(), key=lambda r: r[0]) and bad.count() == 0


def test_page_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "https%3A%2F%2Fa.example%2Fx%3Fq%3D1.html").write_text("<title>é</title>", encoding="utf-8")
    (tmp_path / "sub" / "plain.html").write_bytes(b"<meta charset='iso-8859-1'><p>caf\xe9</p>")
    (tmp_path / "broken.html").write_bytes(b"<p>\xff\xfe\x80</p>")
    (tmp_path / "empty.html").write_bytes(b"")
    (tmp_path / "other.txt").write_text("no page")
    rows = {r["path"].split("/")[-1]: r for r in read_page_files(spark, str(tmp_path)).collect()}
    assert len(rows) == 3 and len({r["page_id"] for r in rows.values()}) == 3  # no row for the empty file
    by_url = {r["url"]: r for r in rows.values()}
    assert by_url["https://a.example/x?q=1"]["html"] == "<title>é</title>"
    assert rows["plain.html"]["html"].endswith("<p>café</p>") and rows["plain.html"]["url"].endswith("plain.html")
    assert rows["broken.html"]["html"] is None and "character set" in rows["broken.html"]["error"]
    assert rows["plain.html"]["error"] is None
    none = tmp_path / "none"
    none.mkdir()
    assert read_page_files(spark, str(none)).count() == 0


def test_page_files_feed_the_job_and_a_second_run_resumes(spark, sf0001, tmp_path):
    src = tmp_path / "crawl"
    src.mkdir()
    pages = read_table(spark, sf0001, "pages").limit(6).collect()
    for r in pages:
        (src / f"p{r['page_id']}.html").write_text(r["html"], encoding="utf-8")
    read = read_page_files(spark, str(src)).filter("error IS NULL")
    out, job = run_pages_job(read, str(tmp_path / "job"))
    assert [s.name for s in job.stages] == ["documents", "segments", "selection", "metrics", "analysis", "summary"]
    assert out["summary"].count() == job.stages[0].rows == 6 and not any(s.reused for s in job.stages)
    titles = {r["title"] for r in out["documents"].collect()}
    os.remove(tmp_path / "job" / "summary" / "_SUCCESS")  # as if the last stage had failed
    again, second = run_pages_job(read, str(tmp_path / "job"), resume=True)
    assert [s.reused for s in second.stages] == [True] * 5 + [False] and {r["title"] for r in again["documents"].collect()} == titles
    assert second.table().count() == 6


def test_stage_times_show_a_slow_stage(spark, tmp_path):
    job = StagedJob(spark, str(tmp_path))

    def slow():
        time.sleep(3)
        return spark.range(5)

    job.run("quick", lambda: spark.range(3))
    rows = job.run("slow", slow)
    table = {r["stage"]: r for r in job.table().collect()}
    assert rows.count() == table["slow"]["rows"] == 5 and table["quick"]["rows"] == 3
    assert table["slow"]["seconds"] >= 3 and table["slow"]["position"] == 1


def test_a_failing_stage_leaves_no_result(spark, tmp_path):
    job = StagedJob(spark, str(tmp_path))
    with pytest.raises(Exception):
        job.run("bad", lambda: spark.range(3).select(F.raise_error(F.lit("broken"))))
    assert job.stages == [] and not job._complete(f"{tmp_path}/bad")


def test_release_gives_back_the_cached_documents(spark, sf0001):
    from parasift.plans.pipeline import run_pages

    r = run_pages(read_table(spark, sf0001, "pages").limit(3))
    assert r.documents.storageLevel.useMemory
    r.release()
    assert not r.documents.storageLevel.useMemory and r.documents.count() == 3
