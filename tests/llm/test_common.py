import random

import helpers
import pytest
from pyspark.sql import functions as F

from cadenza.llm import linking
from cadenza.llm.common import connected_components, number_rows


def test_numbers_are_gapless_per_group(spark, scratch):
    rows = [(g, v) for g in (None, "a", "b") for v in range(40)] * 2
    df = spark.createDataFrame(rows, "g string, v int")
    got = number_rows(scratch, df, [F.col("v")], "n", ["g"]).collect()
    for g in (None, "a", "b"):
        mine = sorted((r["n"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in mine] == list(range(80))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_numbers_of_an_empty_table(spark, scratch):
    df = spark.createDataFrame([], "v int")
    assert number_rows(scratch, df, [F.col("v")], "n").count() == 0


def test_components_of_chains_stars_and_cycles(spark, scratch):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)]
    links += [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1)]
    links += [(rng.randrange(300, 500), rng.randrange(300, 500))
              for _ in range(120)] + [(1, 2), (9, 9)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in
           connected_components(scratch, df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == helpers.components(
        nodes, [(a, b) for a, b in links if a != b])


def test_components_without_links(spark, scratch):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert connected_components(scratch, df).count() == 0


@pytest.mark.parametrize("block", [1000, 20])
def test_linking_finds_every_link_of_a_crowded_bucket(
        spark, scratch, monkeypatch, block):
    """Numbers on a line: one bucket, links only between near ones."""
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = random.Random(5)
    points = {i: rng.randrange(2000) for i in range(150)}
    members = scratch.stage(spark.createDataFrame(
        [(b, i, p) for i, p in points.items() for b in (0, 1 + i % 3)],
        "bucket bigint, id bigint, p bigint"), "members")
    asked = []

    def near(a, b):
        far = F.abs(a("p") - b("p"))
        return far <= 12, far

    def test(pairs):
        asked.append(pairs)
        place = members.select("id", "p").distinct()
        return (pairs.join(place.toDF("a", "pa"), "a")
                .join(place.toDF("b", "pb"), "b")
                .where("abs(pa - pb) <= 6").select("a", "b"))

    got = {r["id"]: r["comp"] for r in linking.components(
        scratch, members, near, test,
        members.select("id", F.col("p").alias("q")).distinct(),
        lambda x, y: F.abs(x["q"] - y["q"]) <= 6).collect()}
    links = [(a, b) for a in points for b in points
             if a < b and abs(points[a] - points[b]) <= 6]
    want = helpers.components(points, links)
    assert {i: got.get(i, i) for i in points} == want
    seen = [tuple(r) for pairs in asked for r in pairs.collect()]
    assert len(seen) == len(set(seen))  # no pair is tested twice
