"""Chunk reader on the array-per-file layout, missing files and manifests."""

import gzip
import json

import pytest
from pyspark.sql import types as T

from hirelens.sources import chunks as CH

SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("company", T.StringType())])


def test_reads_arrays_skips_missing_and_handles_no_manifest(spark, tmp_path):
    d = tmp_path / "data" / "chunks"
    d.mkdir(parents=True)
    with gzip.open(d / "jobs_chunk_0.json.gz", "wt", encoding="utf-8") as f:
        json.dump([{"title": "Eng", "company": "acme"}, {"title": "Ops", "company": "beta"}], f, indent=0)
    (d / "jobs_manifest.json").write_text(json.dumps(
        {"chunks": ["jobs_chunk_0.json.gz", "jobs_chunk_1.json.gz"], "totalJobs": 3, "last_updated": "x"}))
    rows = CH.read_chunks(spark, str(tmp_path / "data"), SCHEMA).collect()
    assert sorted((r["title"], r["company"]) for r in rows) == [("Eng", "acme"), ("Ops", "beta")]
    assert [r.file for r in CH.missing_chunks(spark, str(tmp_path / "data")).collect()] == ["jobs_chunk_1.json.gz"]
    with pytest.raises(FileNotFoundError, match="jobs_chunk_1"):
        CH.read_chunks(spark, str(tmp_path / "data"), SCHEMA, strict=True)
    assert CH.read_chunks(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0
    problems = [r[0] for r in CH.check_snapshot(spark, str(tmp_path / "data")).collect()]
    assert problems == ["missing: jobs_chunk_1.json.gz"]
    assert [r[0] for r in CH.check_snapshot(spark, str(tmp_path / "nothing")).collect()] == ["manifest missing"]


def test_exact_chunk_sizes(spark, tmp_path):
    df = spark.range(0, 2503).selectExpr("cast(id as long) as job_id", "concat('c', id % 7) as company",
                                         "concat('t', id) as title")
    m = CH.write_chunks(df, str(tmp_path / "rel"), "ts", size=1000, tie="job_id")
    assert m["totalJobs"] == 2503 and m["chunkRows"] == {"0": 1000, "1": 1000, "2": 503}
    order = sorted(range(2503), key=lambda i: (f"c{i % 7}", f"t{i}"))
    for k, f in enumerate(m["chunks"]):
        with gzip.open(tmp_path / "rel" / "chunks" / f, "rt", encoding="utf-8") as g:
            assert [r["job_id"] for r in json.load(g)] == order[k * 1000:(k + 1) * 1000]  # one array, in publish order
    assert CH.read_chunks(spark, str(tmp_path / "rel"), T.StructType([T.StructField("job_id", T.LongType())]), strict=True).count() == 2503


def test_publish_switches_the_pointer_and_keeps_metadata(spark, tmp_path):
    df = spark.range(0, 30).selectExpr("id as job_id", "'c' as company", "'t' as title")
    for release in ("r1", "r2", "r3"):
        CH.publish(df, str(tmp_path), release, keep=2, tie="job_id", size=10, metadata={"total_jobs": 30})
        assert (tmp_path / "current").read_text() == release
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["r2", "r3"]
    assert json.loads((tmp_path / "r3" / "metadata.json").read_text()) == {"total_jobs": 30}
    assert not list(tmp_path.glob("*.tmp"))


def test_empty_dataset_has_no_chunks(spark, tmp_path):
    df = spark.range(0, 0).selectExpr("id as job_id", "'c' as company", "'t' as title")
    m, problems = CH.publish(df, str(tmp_path), "r1")
    assert m["chunks"] == [] and [r.problem for r in problems.collect()] == ["no chunks listed"]
    assert not (tmp_path / "current").exists()


def test_folders_are_listed_in_a_few_tasks(spark, tmp_path):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(name)
    with CH._few_listing_tasks(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
    df = spark.range(0, 81).selectExpr("id as job_id", "'c' as company", "'t' as title")
    _, problems = CH.publish(df, str(tmp_path), "r1", tie="job_id", size=2)  # more folders than the driver lists itself
    assert problems.isEmpty()
    got = CH.read_chunks(spark, str(tmp_path / "r1"), T.StructType([T.StructField("job_id", T.LongType())]), strict=True)
    assert sorted(r.job_id for r in got.collect()) == list(range(81)) and spark.conf.get(name) == was
