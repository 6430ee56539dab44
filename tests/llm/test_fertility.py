from collections import Counter

import helpers
import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from cadenza.llm import fertility as Q


def brute(text):
    found = helpers.words(text)
    grams = Counter(zip(found, found[1:], found[2:]))
    inside = [False] * len(found)
    for i in range(len(found) - 2):
        if grams[tuple(found[i:i + 3])] > 1:
            inside[i:i + 3] = [True] * 3
    lines = [x for x in (text or "").split("\n") if helpers.words(x)]
    return (len(found), sum(map(len, found)),
            sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), sum(inside))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_repeat_words(ids):
    text = " ".join(map(str, ids))
    assert Q.repeat_words(np.array(ids, np.int64)) == brute(text)[4]


def test_base_counts_and_measures(spark, scratch):
    texts = [None, "", " \n\t", "one", "a b a b a b a b " * 20,
             "x\ny\n x\nx\n\n\ny\x0bz\nÄ #$ \x1f\u00a0 <tag>",
             "word " * 30000, "漢字 かな " * 60, "plain words " * 3]
    docs = helpers.documents(spark, [
        (i, t, "en" if i % 2 else None, None) for i, t in enumerate(texts)])
    rows = {r["doc_id"]: r for r in Q.judge(
        scratch, Q.measure(docs)).collect()}
    pieces = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, text in enumerate(texts):
        r = rows[i]
        counts = (r["n_words"], r["word_chars"], r["n_symbols"],
                  r["n_dup_lines"], r["n_repeat_words"])
        assert counts == brute(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and r["kept"] != failed
        ids = [t for w in helpers.words(text) for t in pieces.encode(w)]
        assert r["n_tokens"] == len(ids)
        if ids:
            share = np.array(list(Counter(ids).values())) / len(ids)
            assert abs(r["token_entropy"]
                       + (share * np.log2(share)).sum()) < 1e-9
            assert abs(r["byte_share"] - np.mean(
                [pieces.is_byte(t) for t in ids])) < 1e-12
        else:
            assert r["chars_per_token"] is None


def test_band_rejects_what_does_not_fit(spark, scratch):
    rng = __import__("random").Random(2)
    stems = "time year people way day man thing woman life child".split()
    rows = [(i, " ".join(rng.choice(stems) for _ in range(80)), "en", None)
            for i in range(200)]
    rows.append((900, " ".join("\u16a0\u16b1\u16c7" + str(i)
                               for i in range(80)), "en", None))
    got = {r["doc_id"]: r for r in Q.judge(scratch, Q.measure(
        helpers.documents(spark, rows))).collect()}
    assert not got[900]["kept"]
    assert not got[900]["base_failed"] and got[900]["byte_share"] > 0
    assert sum(r["kept"] for r in got.values()) >= 198


def test_empty_table_repeats_and_script(spark, scratch):
    docs = helpers.documents(spark, [(1, "a b", None, None)] * 2)
    rows = Q.judge(scratch, Q.measure(docs)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert rows[0]["band"] == "latin"
    assert Q.judge(scratch, Q.measure(docs.limit(0))).count() == 0
    assert [Q.script(t) for t in (None, "12", "слово", "漢字", "Ab")] == [
        "none", "none", "cyrillic", "han", "latin"]


def prose(rng, count):
    return helpers.prose(rng, count, 5000)


def kept(scratch, spark, rows):
    return {r["doc_id"]: r["kept"] for r in Q.judge(scratch, Q.measure(
        helpers.documents(spark, rows))).collect()}


def test_an_emoji_or_copies_do_not_reject_clean_texts(spark, scratch):
    rng = __import__("random").Random(7)
    rows = [(i, prose(rng, 100), "en", None) for i in range(80)]
    rows.append((900, prose(rng, 99) + " \U0001F600", "en", None))
    copy = prose(rng, 100)
    rows += [(1000 + i, copy, "de", None) for i in range(400)]
    rows += [(2000 + i, prose(rng, 100), "de", None) for i in range(60)]
    got = kept(scratch, spark, rows)
    assert got[900]
    assert all(got[1000 + i] for i in range(400))
    assert all(got[2000 + i] for i in range(60))


def test_small_classes_are_judged(spark, scratch):
    rng = __import__("random").Random(3)

    def junk(count):
        return " ".join("\u16a0\u16b1\u16c7" + helpers.word(
            rng.randrange(5000)) for _ in range(count))
    rows = [(i, prose(rng, 100), "en", None) for i in range(80)]
    rows += [(900, prose(rng, 3000), "en", None),   # the only long ones
             (901, junk(3000), "en", None),
             (902, prose(rng, 100), "es", None),    # a rare language
             (903, junk(100), "es", None)]
    got = kept(scratch, spark, rows)
    assert got[900] and got[902] and all(got[i] for i in range(80))
    assert not got[901] and not got[903]
    small = kept(scratch, spark, rows[80:])  # nothing to learn from
    assert small == {900: True, 901: False, 902: True, 903: False}


def test_quartiles_are_exact(spark):
    rng = __import__("random").Random(12)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(2), *[
        None if rng.random() < 0.1 else rng.uniform(0, 9) for _ in range(3)])
        for _ in range(900)] + [("none", 0, None, None, None)]
    table = spark.createDataFrame(
        rows, "a string, b int, chars_per_token double, byte_share double, "
        "token_entropy double").repartition(5)
    got = {(r["a"], r["b"]): r for r in Q.quartiles(
        table, ["a", "b"]).collect()}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        assert got[key]["_n"] == len(own)
        for i, m in enumerate(Q.MEASURES, 2):
            values = sorted(round(r[i], 3) for r in own if r[i] is not None)
            want = [values[-(-len(values) * q // 4) - 1] if values else None
                    for q in (1, 3)]
            assert got[key][f"_{m}"] == want


def test_bands_equal_a_plain_computation(spark, scratch):
    """Each class against its own quartiles, or those of the nearest class
    of its language, of its script, or the fixed ones."""
    rng = __import__("random").Random(21)
    rows, n = [], 0
    for lang, count, sizes in (("en", 150, (70, 200)), ("de", 40, (90,)),
                               (None, 160, (80, 300)), ("ja", 5, (60,))):
        for _ in range(count):
            text = prose(rng, rng.choice(sizes))
            if n % 13 == 0:
                text += " \u16a0\u16b1" * rng.randrange(1, 40)
            rows.append((n, text, lang, None))
            n += 1
    rows += [(5000 + i, rows[0][1], "en", None) for i in range(30)]
    measured = Q.measure(helpers.documents(spark, rows))
    got = {r["doc_id"]: r for r in Q.judge(scratch, measured).collect()}
    facts = {r["doc_id"]: r for r in measured.collect()}

    def size_class(r):
        return max(r["n_words"], 1).bit_length() - 1
    known = {}
    for rank, key in ((0, "band"), (1, "script")):
        groups = {}
        for r in facts.values():
            groups.setdefault((r[key], size_class(r)), {})[r["version"]] = r
        for (name, size), own in groups.items():
            if len(own) >= Q.MIN_DOCUMENTS:
                known.setdefault((rank, name), {})[size] = {
                    m: sorted(round(r[m], 3) for r in own.values())
                    for m in Q.MEASURES}
    assert len(known) >= 3
    for doc, r in facts.items():
        size, fits = size_class(r), True
        bands = known.get((0, r["band"])) or known.get((1, r["script"]))
        for m in Q.MEASURES:
            if bands:
                near = min(bands, key=lambda c: (abs(c - size), c))
                values = bands[near][m]
                low, high = (values[-(-len(values) * q // 4) - 1]
                             for q in (1, 3))
                reach = max((high - low) * Q.FENCE, Q.LEAST_REACH[m])
                if m == "token_entropy":
                    reach += abs(near - size)
            else:
                low, high = Q.FIXED_BANDS[m]
                reach = 0
            fits &= low - reach <= r[m] <= high + reach
        failed = r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]
        assert got[doc]["kept"] == (fits and not failed), doc
    assert {r["kept"] for r in got.values()} == {True, False}
