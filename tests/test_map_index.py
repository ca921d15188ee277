"""The map index: viewports hold exactly their rows, read few folders, and a crowded point is dealt over many."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from hirelens.operators import map_index

SCHEMA = "job_id long, lat double, lng double, n long"


def plain(rows, box):
    s, w, n, e = box
    over = (lambda x: w <= x <= e) if w <= e else (lambda x: x >= w or x <= e)
    return sorted(k for k, lat, lng, _ in rows if lat is not None and lng is not None and s <= lat <= n and over(lng))


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180), k) for k in range(12_000)] + [(20_000 + k, 48.14, 11.58, 0) for k in range(6_000)]
    rows += [(1, None, 3.0, 0), (2, 3.0, None, 0), (3, 91.5, 181.0, 0), (4, -90.0, -180.0, 0), (4, -90.0, -180.0, 0), (5, 90.0, 180.0, 0)]
    return rows, map_index.build(spark.createDataFrame(rows, SCHEMA).repartition(8), F.col("job_id"), 200)


@pytest.mark.parametrize("box", [(-90, -180, 90, 180), (40, 0, 50, 20), (48.14, 11.58, 48.14, 11.58), (-20, 170, 20, -170), (90, 180, 95, 190), (50, 0, 40, 20), (-90, -180, -90, -180)])
def test_viewports_hold_their_rows(crowded, box):
    rows, index = crowded
    got = index.inside(box)
    assert got.columns == ["job_id", "lat", "lng", "n"]
    assert sorted(r.job_id for r in got.collect()) == plain(rows, box)


def test_a_small_viewport_reads_few_folders(crowded):
    _, index = crowded
    assert index.boxes.count() > 150 and index.met((-35, -70, -30, -60)).count() < 0.1 * index.boxes.count()
    assert index.boxes.agg(F.max("n")).first()[0] < 3 * 18_000 / 200  # also those of the crowded point
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        index.inside((-35, -70, -30, -60)).explain("formatted")
    assert "dynamicpruning" in text.getvalue()


def test_z_order(spark):
    at = spark.createDataFrame([(-90.0, -180.0), (-90.0, 180.0), (90.0, -180.0), (90.0, 180.0), (0.0, 0.0)], "lat double, lng double")
    even = sum(1 << (2 * k) for k in range(16))
    assert [r.z for r in at.select(map_index.z_order(F.col("lat"), F.col("lng")).alias("z")).collect()] == [0, even, 2 * even, 3 * even, 3 << 30]


def test_nothing_to_store(spark):
    index = map_index.build(spark.createDataFrame([(1, None, None, 0)], SCHEMA), F.col("job_id"), 4)
    assert index.inside((-90, -180, 90, 180)).count() == 0
