import random

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import minhash as M


def brute(texts, size, percent=80):
    sets = {i: helpers.shingles(t, size) for i, t in texts.items()}
    links = []
    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (
                    len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    return helpers.components(sets, links), sets


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10 ** 6)}" if rng.random() < share
                    else w for w in text.split(" "))


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, scratch, size):
    rng = random.Random(size)
    texts = {i: helpers.prose(rng, rng.randrange(1, 120)) for i in range(60)}
    for i in range(60, 160):
        texts[i] = edited(rng, texts[rng.randrange(60)],
                          rng.choice((0, 0.01, 0.03, 0.05)))
    hot = helpers.prose(rng, 150, 5000)
    for i in range(160, 260):  # a crowd of near copies with chains
        texts[i] = edited(rng, hot, rng.choice((0.01, 0.03, 0.08)))
    want, sets = brute(texts, size)
    docs = helpers.documents(spark, [(i, t, None, None)
                                     for i, t in texts.items()])
    got = M.near_duplicates(scratch, docs, M.Settings(words=size)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_edge_rows(spark, scratch):
    long = " ".join(f"w{i}" for i in range(40000))
    docs = helpers.documents(spark, [
        (1, None, None, None), (2, "", None, None), (3, " \n\t", None, None),
        (4, "One", None, None), (5, "one", None, None),
        (6, "one two", None, None), (8, long, None, None),
        (7, long + " x", None, None), (7, long + " x", None, None),
        (None, "one", None, None), (None, None, None, None)]).withColumn(
        "kept", F.lit("clash")).withColumn("id", F.lit(0))
    rows = M.near_duplicates(scratch, docs, M.Settings(words=2)).collect()
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"])
                 for r in rows)
    assert got == sorted([
        ("1", "1", True), ("2", "2", True), ("3", "3", True),
        ("4", "4", True), ("5", "4", False), ("6", "6", True),
        ("7", "7", True), ("7", "7", True), ("8", "7", False),
        ("None", "4", False), ("None", "None", True)])
    assert M.near_duplicates(scratch, docs.limit(0),
                             M.Settings()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 5000])
def test_every_coordinate_fills_and_agreement_is_similarity(n):
    rng = np.random.default_rng(n)
    items = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
    drawn = M.sketch(items, 336)
    assert (drawn != np.uint64(2 ** 64 - 1)).all()
    assert (M.sketch(items[::-1].copy(), 336) == drawn).all()
    if n == 5000:
        other = np.concatenate([items[:4000], rng.integers(
            0, 2 ** 63, 1000).astype(np.uint64)])
        agree = (M.sketch(other, 336) == drawn).mean()
        assert abs(agree - 4000 / 6000) < 0.1


def test_rounds_taken_together_change_nothing(monkeypatch):
    items = np.arange(1, 9, dtype=np.uint64)
    drawn = M.sketch(items, 64)
    out = np.full(64, np.uint64(2 ** 64 - 1))
    low = np.uint64(0xFFFFFFFF)
    for turn in range(128):
        i = np.array([turn], np.uint64)
        h = M.mix(items + M.mix(i + np.uint64(1)))
        at = ((h >> np.uint64(32)) * np.uint64(64)) >> np.uint64(32) \
            if turn < 64 else np.full(8, turn - 64)
        np.minimum.at(out, at.astype(int), (i << np.uint64(32)) | (h & low))
    assert (out == drawn).all()
