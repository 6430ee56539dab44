import random
import tracemalloc

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontamination as D


def smith_waterman(a, b, s):
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (s.match if x == y else s.mismatch),
                           last[j + 1] + s.gap, row[j] + s.gap))
        best, last = max(best, *row), row
    return best


@pytest.mark.parametrize("seed", range(6))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 6, 12).astype(np.uint64)
    windows = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
               for _ in range(20)]
    s = D.Settings()
    for (score, end), window in zip(D.align(item, windows, s), windows):
        assert score == smith_waterman(item, window, s)
        assert score == 0 or smith_waterman(item, window[:end], s) == score


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_exact_edited_and_clean(spark, scratch):
    rng = random.Random(6)
    items = [(i, helpers.prose(rng, 30, 3000)) for i in range(8)]
    docs, want = [], set()
    for i in range(80):
        text = helpers.prose(rng, rng.randrange(20, 200), 3000).split()
        if i % 4 == 1:
            number, passage = items[i % 8]
            passage = passage.upper().split()
            for _ in range(i % 6):  # paraphrased here and there
                passage[rng.randrange(len(passage))] = "else"
            if i % 3:
                del passage[rng.randrange(len(passage))]
            at = rng.randrange(len(text))
            text[at:at] = passage
            want.add((i, number))
        docs.append((i, " ".join(text) + ".", None, None))
    got = D.contaminated(scratch, helpers.documents(spark, docs),
                         items_table(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    s = D.Settings()
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        item = D.hashes(D.words(dict(items)[r["item_id"]]))
        whole = smith_waterman(item, D.hashes(D.words(texts[r["doc_id"]])), s)
        assert r["score"] == whole / (s.match * len(item))


def test_an_item_that_every_text_holds_is_found(spark, scratch):
    rng = random.Random(2)
    common = helpers.prose(rng, 25)
    docs = [(i, f"{helpers.prose(rng, 40)} {common}", None, None)
            for i in range(150)]
    got = D.contaminated(scratch, helpers.documents(spark, docs),
                         items_table(spark, [(1, common)])).collect()
    assert {r["doc_id"] for r in got} == set(range(150))


def test_edge_rows(spark, scratch):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = helpers.documents(spark, [
        (1, None, None, None), (2, "", None, None), (3, passage, None, None),
        (3, passage, None, None), (None, passage, None, None),
        (4, "x " * 50000 + passage + " y" * 50000, None, None),
        (5, "solo word", None, None), (6, "other", None, None)]).withColumn(
        "item", F.lit("clash"))
    items = items_table(spark, [(1, passage), (2, passage), (3, None),
                                (4, ""), (None, "solo word")])
    got = sorted(str((r["doc_id"], r["item_id"])) for r in
                 D.contaminated(scratch, docs, items).collect())
    assert got == sorted(
        [str((d, i)) for d in (3, 3, None, 4) for i in (1, 2)]
        + [str((5, None))])
    assert D.contaminated(scratch, docs.limit(0), items).count() == 0
    assert D.contaminated(scratch, docs, items.limit(0)).count() == 0


def test_equals_all_items_against_all_texts(spark, scratch):
    """Whole alignments of every pair, no seeds and no windows."""
    rng = random.Random(31)
    items = [(i, helpers.prose(rng, rng.choice((1, 2, 5, 9, 25)), 500))
             for i in range(12)] + [(90, None), (91, "")]
    texts = []
    for i in range(60):
        text = helpers.prose(rng, rng.randrange(0, 120), 500).split()
        if i % 2:
            item = items[i % 12][1].split()
            for _ in range(len(item) * (i % 3) // 10):
                item[rng.randrange(len(item))] = "else"
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        texts.append((i, " ".join(text), None, None))
    s, want = D.Settings(), {}
    for number, item in items:
        a = D.hashes(D.words(item))
        for i, text, *_ in texts if len(a) else ():
            share = smith_waterman(a, D.hashes(D.words(text)), s) / (
                s.match * len(a))
            if share >= D._least(len(a), s):
                want[i, number] = share
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(
        scratch, helpers.documents(spark, texts), items_table(
            spark, items)).collect()}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("copies", [0, 400])
def test_recall_of_edited_copies(spark, scratch, copies):
    """The same, whether or not the corpus is full of the items' n-grams."""
    rng = random.Random(17)
    items = [(i, helpers.prose(rng, 40, 4000)) for i in range(60)]
    docs, planted = [], {}
    for percent in (10, 20, 30):
        for number, item in items:
            edited = item.split()
            for at in rng.sample(range(40), 40 * percent // 100):
                edited[at] = helpers.word(9000 + rng.randrange(999))
            text = helpers.prose(rng, 60, 4000).split()
            text[30:30] = edited
            docs.append((len(docs), " ".join(text), None, None))
            planted[docs[-1][0]] = percent, number
    for i in range(copies):  # runs of items, too short to count
        item = items[i % 60][1].split()
        at = rng.randrange(30)
        docs.append((10000 + i, " ".join([
            helpers.prose(rng, 20, 4000), *item[at:at + 10],
            helpers.prose(rng, 20, 4000)]), None, None))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(
        scratch, helpers.documents(spark, docs),
        items_table(spark, items)).collect()}
    recall = {p: sum((doc, number) in got for doc, (own, number)
                     in planted.items() if own == p) / 60
              for p in (10, 20, 30)}
    assert recall[10] == 1 and recall[20] == 1 and recall[30] >= 0.9, recall
    assert not [d for d, _ in got if d >= 10000]


def test_of_two_adjacent_grams_one_is_a_seed(spark):
    items = spark.createDataFrame(
        [(1, [10, 11, 12, 13, 14]), (2, [20]), (3, [30, 31])],
        "item bigint, grams array<bigint>")
    counts = spark.createDataFrame(
        [(10, 5), (11, 2), (12, 9), (14, 1), (20, 1000), (30, 3), (31, 3)],
        "gram bigint, n bigint")
    got = {(r["item"], r["position"]) for r in
           D.choose_seeds(items, counts).collect()}
    # 13 is in no text, so that its neighbours stand in for it
    assert got == {(1, 1), (1, 2), (1, 4), (2, 0), (3, 0), (3, 1)}


def test_a_very_long_text_takes_bounded_memory():
    rng = np.random.default_rng(3)
    item = rng.integers(1, 2 ** 60, 12).astype(np.uint64)
    text = np.tile(np.concatenate([item[:5], rng.integers(
        1, 2 ** 60, 5).astype(np.uint64), item[5:]]), 60000)
    short = [(item.copy(), item, np.array([0]))] * 300
    pairs = [(text, item, np.arange(0, len(text), 17)), *short]
    s = D.Settings()
    tracemalloc.start()
    found = D.best_alignments(pairs, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 10 ** 6 and peak < 500 << 20
    assert found[0][0] == 0 and len(found) == 301
    assert found[0][1] * 24 == smith_waterman(item, text[:200], s)
    assert all(share == 1 for _, share, _ in found[1:])


def test_pieces_of_a_window_hold_every_alignment(monkeypatch):
    monkeypatch.setattr(D, "CELLS", 8)
    rng = np.random.default_rng(8)
    s = D.Settings()
    for _ in range(30):
        item = rng.integers(0, 9, 8).astype(np.uint64)
        text = rng.integers(0, 30, 300).astype(np.uint64)
        at = rng.integers(0, 290)
        text[at:at + 8] = item[:len(text[at:at + 8])]
        found = D.best_alignments([(text, item, np.arange(300))], s)
        assert found[0][1] * 16 == smith_waterman(item, text, s)


def test_characters_are_words_where_there_are_no_blanks(spark, scratch):
    item = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    edited = "山" + item[:9] + "雪" + item[10:] + "水"
    got = D.contaminated(scratch, helpers.documents(spark, [
        (1, edited, None, None), (2, item[::-1], None, None)]),
        items_table(spark, [(1, item)])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)]


def test_an_edited_copy_of_a_frequent_item_is_found(spark, scratch):
    """Each n-gram of the item is in over 100 texts; every fourth word of
    the copy is another, so that a seed of each four n-grams may be gone."""
    rng = random.Random(4)
    item = helpers.prose(rng, 20, 3000)
    edited = item.split()
    edited[2::4] = ["else"] * len(edited[2::4])
    docs = [(i, f"{helpers.prose(rng, 30, 3000)} {item}", None, None)
            for i in range(130)]
    docs.append((900, " ".join([helpers.prose(rng, 30, 3000), *edited]),
                 None, None))
    docs.append((901, helpers.prose(rng, 60, 3000), None, None))
    got = D.contaminated(scratch, helpers.documents(spark, docs),
                         items_table(spark, [(1, item)])).collect()
    assert {r["doc_id"] for r in got} == {*range(130), 900}
