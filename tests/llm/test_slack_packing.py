import itertools
import random
import struct

import helpers
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cadenza.llm import slack_packing as P

REFERENCE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODE = P.public_word_bpe()


def ids_of(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


def unpacked(data):
    return list(struct.unpack(f"<{len(data) // 4}I", bytes(data)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(
    "aİΣßﬁ'st1 ́  \x1c\x85\t\n<|endoftext|>", max_size=40)),
    max_size=4))
def test_remembered_words_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [unpacked(e) for e in ENCODE(texts)] == [
        ids_of(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5),
       st.integers(0, 40))
def test_the_fullest_combination_is_found(left, room):
    left = dict(sorted(left.items(), reverse=True))
    sums = {0}
    for length, count in left.items():
        sums |= {s + length * i for s in sums for i in range(count + 1)}
    got = P.fullest(left, room)
    assert all(0 < n <= left[length] for length, n in got.items())
    assert sum(length * n for length, n in got.items()) == max(
        s for s in sums if s <= room)


def test_combinations_use_up_all_and_leave_little():
    rng = random.Random(12)
    for sizes in ([rng.randrange(1, 4097) for _ in range(3000)],
                  [int(rng.lognormvariate(5, 1)) % 4096 + 1
                   for _ in range(20000)],
                  [3000] * 1000 + [1096] * 999 + [500] * 3, [2049] * 50, []):
        histogram = {s: sizes.count(s) for s in set(sizes)}
        chosen = P.combinations(histogram, 4096)
        used = {}
        for times, bin_ in chosen:
            assert sum(length * n for length, n in bin_.items()) <= 4096
            for length, n in bin_.items():
                used[length] = used.get(length, 0) + n * times
        assert used == histogram
        bins = sum(times for times, _ in chosen)
        if sizes and sizes[0] != 2049:
            large = sum(s > 2048 for s in sizes)
            assert bins <= max(large, -(-sum(sizes) // 4096)) * 1.01 + 1


def test_few_bins_of_small_cases_are_the_fewest():
    rng = random.Random(3)
    worse = 0
    for _ in range(60):
        sizes = [rng.randrange(2, 11) for _ in range(6)]
        got = sum(times for times, _ in P.combinations(
            {s: sizes.count(s) for s in sizes}, 12))
        fewest = min(
            len([b for b in range(6) if b in put])
            for put in itertools.product(range(6), repeat=6)
            if put[0] == 0 and all(sum(s for s, p in zip(sizes, put)
                                       if p == b) <= 12 for b in range(6)))
        assert fewest <= got <= fewest + 1
        worse += got > fewest
    assert worse <= 3


def test_pieces_rebuild_every_document(spark, scratch):
    rng = random.Random(2)
    texts = ["one two three", None, "", "Again and again " * 900,
             "Ünïcode 漢字 <|endoftext|> x<|endoftext|>y", "x" * 5000]
    texts += [helpers.prose(rng, rng.randrange(60)) for _ in range(200)]
    texts += ["same words here"] * 300
    docs = helpers.documents(spark, [(i, t, None, None) for i, t in
                                     enumerate(texts)]).repartition(3)
    rows = P.pack(scratch, docs, length=64).collect()
    by_doc, bins = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [
            64 * n for n in range(len(parts))]
        assert all(r["length"] == 64 for r in parts[:-1])
        assert [x for r in parts for x in unpacked(r["ids"])] == [
            *ids_of(text), P.END_OF_TEXT]
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    tokens = sum(r["length"] for r in rows)
    assert len(bins) <= -(-tokens // 64) + 1


def test_repeated_rows_null_ids_and_empty_tables(spark, scratch):
    docs = helpers.documents(spark, [(1, "a b", None, None)] * 2
                             + [(None, "c", None, None)])
    rows = P.pack(scratch, docs.withColumnRenamed("lang", "piece")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert {r["sequence_id"] for r in rows} == {0}
    assert P.pack(scratch, docs.limit(0)).count() == 0
