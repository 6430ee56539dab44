import random
import re

import helpers
import zstandard
from pyspark.sql import functions as F

from cadenza.llm import language_id as L

WORDS = {"en": "the of and to in that is was for on are with".split(),
         "fr": "le la les des une est dans pour que qui sur avec".split(),
         "de": "der die und das ist nicht ein mit auf für dem den".split()}


def corpus(spark, count=120):
    rng = random.Random(1)
    rows = []
    for i in range(count):
        lang = ("en", "fr", "de")[i % 3]
        stem = [rng.choice(WORDS[lang]) + rng.choice(
            ("", "", rng.choice(WORDS[lang]))) for _ in range(60)]
        rows.append((i, " ".join(stem), lang, "s"))
    return helpers.documents(spark, rows)


def test_held_out_documents_are_recognised(spark):
    docs = corpus(spark).withColumn("out", L.held_out(F.col("doc_id")))
    model = L.fit(docs.where("not out"))
    assert sorted(model.dictionaries) == ["de", "en", "fr"]
    got = L.identify(docs, model).collect()
    assert len(got) == 120 and any(r["out"] for r in got)
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"]
               and 0 < r["score"] <= 1 for r in got)


def test_task_and_plain_classifier_agree(spark):
    docs = corpus(spark, 30)
    model = L.fit(docs)
    plain = L.Classifier(model)
    for r in L.identify(docs, model).collect():
        assert (r["lang_pred"], r["score"], r["rejected"]) == \
            plain.predict(r["text"])


def test_edge_texts(spark):
    model = L.fit(corpus(spark))
    docs = helpers.documents(spark, [
        (1, None, None, None), (2, "", "en", "s"), (3, "12 !? \n", "en", "s"),
        (None, "the of and to", None, None), (5, "the of and " * 40000,
                                              "en", "s"),
        (5, "the of and " * 40000, "en", "s"), (6, "字" * 50, None, "s")])
    docs = docs.withColumn("score", F.lit("clash"))
    got = {(r["doc_id"], r["lang"]): r for r in
           L.identify(docs, model).collect()}
    for key in ((1, None), (2, "en"), (3, "en")):
        assert got[key]["lang_pred"] == "und" and got[key]["rejected"]
        assert got[key]["score"] == 0
    assert got[5, "en"]["lang_pred"] == "en"
    assert got[6, None]["rejected"]  # no dictionary helps
    assert L.identify(docs.limit(0), model).count() == 0
    assert L.identify(docs, model).count() == 7


def test_labels_may_be_missing(spark):
    docs = helpers.documents(spark, [(1, "the of", None, "s"),
                                     (2, None, "en", "s")])
    model = L.fit(docs)
    assert model.dictionaries == {}
    assert {r["lang_pred"] for r in L.identify(docs, model).collect()} == \
        {"und"}
    one = L.fit(helpers.documents(spark, [(1, "the of", "en", "s")]))
    assert {r["lang_pred"] for r in L.identify(docs, one).collect()} == \
        {"en", "und"}


def test_sample_is_bounded_and_copies_count_once(spark):
    docs = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, "the of and").otherwise(
            F.concat(F.lit("word "), "id")).alias("text"),
        F.lit("en").alias("lang"))
    content = L.fit(docs).dictionaries["en"]
    assert len(content) <= L.DICTIONARY_BYTES
    assert content.count(b"the of and") <= 1


def compressed(text, content):
    """Bytes of the text's blocks, each compressed and read back."""
    plain = re.sub(r"[\x00-@\[-`{-\x7f]+", " ", text.lower()).strip(
        " ").encode()
    total = 0
    for at in range(0, len(plain), L.BLOCK_BYTES):
        block = plain[at:at + L.BLOCK_BYTES]
        words = zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressor(
            dict_data=words,
            compression_params=zstandard.ZstdCompressionParameters.from_level(
                L.LEVEL, source_size=L.BLOCK_BYTES, dict_size=len(content),
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=False, write_checksum=False,
                write_dict_id=False)).compress(block)
        assert zstandard.ZstdDecompressor(
            dict_data=words, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        ).decompress(made, max_output_size=L.BLOCK_BYTES) == block
        total += len(made)
    return total


def test_every_text_against_every_dictionary(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(WORDS[("en", "fr", "de")[i % 3]])
                         for _ in range(rng.randrange(1, 2500))), None, None)
            for i in range(60)]
    rows += [(100, "Mixed: the of and, der die das; 42 le la les!", None,
              None), (101, "Ünïcode 漢字 the of", None, None)]
    model = L.fit(corpus(spark))
    seen = set()
    for r in L.identify(helpers.documents(spark, rows), model).collect():
        sizes = {name: compressed(r["text"], content)
                 for name, content in model.dictionaries.items()}
        best, rest = sorted(sizes.values())[:2]
        winner = next(n for n in model.dictionaries if sizes[n] == best)
        assert r["lang_pred"] == winner
        assert abs(r["score"] - (1 - best / rest)) < 1e-12
        assert r["rejected"] == (1 - best / rest < model.min_margin)
        seen.add((r["lang_pred"], r["rejected"]))
    assert {name for name, _ in seen} == {"en", "fr", "de"}
