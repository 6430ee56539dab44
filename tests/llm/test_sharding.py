import random
import zlib

import helpers
import pytest
from pyspark.sql import functions as F

from cadenza.llm import sharding as S


def table(spark, sizes, langs=("en", "fr", None)):
    rng = random.Random(4)
    return helpers.documents(spark, [
        (i, "".join(rng.choice("abcdé ") for _ in range(n)),
         langs[i % len(langs)], f"s{rng.randrange(4)}")
        for i, n in enumerate(sizes)])


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_bytes_are_nearly_equal(spark, scratch, shards):
    rng = random.Random(9)
    docs = table(spark, [rng.randrange(400) for _ in range(600)])
    rows = S.shard(scratch, docs, shards).collect()
    assert len(rows) == 600
    sizes = check(rows, shards)
    largest = max(r["size"] for r in rows)
    mean = sum(sizes.values()) / shards
    assert len(sizes) == shards
    assert all(abs(s - mean) <= largest for s in sizes.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        content = texts[r["doc_id"]].encode()
        assert r["size"] == len(content) + 16
        assert r["text_crc32"] == zlib.crc32(content)


def test_a_hot_text_is_divided_and_small_groups_stay(spark, scratch):
    rows = [(i, "hot text " * 4, "en", "s") for i in range(300)]
    rows += [(1000 + i, f"pair {i // 2}", "en", f"s{i % 2}")
             for i in range(400)]
    got = S.shard(scratch, helpers.documents(spark, rows), 4).collect()
    sizes = check(got, 4)
    mean = sum(sizes.values()) / 4
    assert all(abs(s - mean) <= 60 for s in sizes.values())
    place = {r["doc_id"]: r["shard"] for r in got}
    together = sum(place[1000 + 2 * i] == place[1001 + 2 * i]
                   for i in range(200))
    assert together == 200
    assert len({place[i] for i in range(300)}) > 1


def test_target_bytes(spark, scratch):
    docs = table(spark, [100] * 64)
    total = sum(r["size"] for r in S.shard(scratch, docs, 1).collect())
    rows = S.shard(scratch, docs, target_bytes=-(-total // 8)).collect()
    assert len(check(rows, 8)) == 8


def test_edge_rows(spark, scratch):
    docs = helpers.documents(spark, [
        (1, None, None, None), (1, None, None, None), (None, "", "x", "y"),
        (2, "a" * 100000, None, "y")]).withColumn("shard", F.lit("clash"))
    rows = S.shard(scratch, docs, 40).collect()
    check(rows, 40)
    assert sorted(r["size"] for r in rows) == [16, 16, 16, 100016]
    assert {r["text_crc32"] for r in rows if r["size"] == 16} == {0}
    assert S.shard(scratch, docs.limit(0), 40).count() == 0
    bare = docs.select("doc_id", "text")
    assert S.shard(scratch, bare, 3).count() == 4


def test_the_tree_cuts_where_sorting_would(spark, scratch):
    rng = random.Random(1)
    weights = [rng.randrange(1, 50) for _ in range(3000)]
    units = scratch.stage(spark.createDataFrame(
        [(i, w) for i, w in enumerate(weights)],
        "rank0 bigint, weight bigint"), "units")
    tree = S.build_tree(units, ["rank0"], 3)
    goal, seen = sum(weights) / 3, 0
    cut = next(i for i, w in enumerate(weights)
               if (seen := seen + w) > goal)
    assert tree.threshold in (cut, cut + 1)
