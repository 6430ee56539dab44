import random
import zlib

import helpers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from cadenza.llm import language_id
from cadenza.session import write_and_read

CLASHES = ("gone", "_gone", "_doc_id", "_version", "version", "score",
           "lang_pred", "rejected", "n_lines", "n_removed", "kept")


def table(spark, rows):
    """Documents with columns that the operators use inside."""
    return helpers.documents(spark, rows).withColumns(
        {"n_chars": F.length("text").cast("long")}
        | {c: F.concat(F.lit(c), F.col("doc_id").cast("string"))
           for c in CLASHES})


def benchmark(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text "
                          "string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def run_stage(spark, name, docs, folder):
    """The stage's rows, with the columns and their order checked."""
    out = dict(P.STAGES)[name](spark, docs, folder)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
    assert all(r["text"] is None or r["n_chars"] == len(r["text"])
               for r in rows)
    return rows


ENGLISH = "the people of this town have their own way with words".split()
GERMAN = "die leute in dieser stadt haben ihre eigene art mit worten".split()


def sample(spark, extra=()):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), lang, None)
            for i, (words, lang) in enumerate(
                [(ENGLISH, "en"), (GERMAN, "de")] * 30)]
    return table(spark, rows + list(extra))


def test_language_stage_keeps_what_the_classifier_accepts(spark, tmp_path):
    docs = sample(spark, [(100, None, "en", None), (101, "", "en", None),
                          (102, "123 !", None, None), (103, "x", None, None)])
    got = {r["doc_id"]: r["text"] for r in run_stage(
        spark, "language_id", docs, str(tmp_path))}
    rows = docs.collect()
    learned = language_id.fit(docs.where(
        ~language_id.held_out(F.col("doc_id"))))
    own = language_id.Classifier(learned)
    assert got == {r["doc_id"]: r["text"] for r in rows
                   if not own.predict(r["text"])[2]}
    assert {100, 101, 102}.isdisjoint(got) and len(got) >= 60


def test_line_stage_drops_later_lines_and_emptied_documents(spark, tmp_path):
    line, other = "one common line of words", "a line that only I have"
    docs = table(spark, [
        (1, f"{line}\n{other}", None, None), (2, line, None, None),
        (3, f"{line.upper()}!\nnew words stand here", None, None),
        (4, None, None, None), (5, "", None, None), (6, "ab\nab", None, None)])
    assert {r["doc_id"]: r["text"] for r in run_stage(
        spark, "line_dedup", docs, str(tmp_path))} == {
        1: f"{line}\n{other}", 3: "new words stand here", 4: None, 5: "",
        6: "ab\nab"}


def test_near_duplicate_stage_keeps_the_smallest_id(spark, tmp_path):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = helpers.prose(rng, 150).split()
        for edits in range(3):
            for _ in range(edits):
                base[rng.randrange(150)] = helpers.word(999)
            texts.append(" ".join(base))
    texts += ["a", "a", "", "", None]
    rng.shuffle(texts)
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    sets = [helpers.shingles(t, 5) for t in texts]
    group = helpers.components(range(len(texts)), [
        (i, j) for i, a in enumerate(sets) for j in range(i)
        if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(
            a | sets[j])])
    assert sorted(r["doc_id"] for r in run_stage(
        spark, "near_duplicates", docs, str(tmp_path))) == sorted(
        i for i in group if group[i] == i)


def test_decontamination_stage_drops_benchmark_passages(spark, tmp_path):
    rng = random.Random(9)
    items = [helpers.prose(rng, 40, 3000) for _ in range(5)]
    texts = [helpers.prose(rng, 200, 3000) for _ in range(20)]
    for i, item in enumerate(items):
        texts[i] = f"{texts[i][:300]} {item} {texts[i][300:]}"
    docs = table(spark, [(i, t, None, None) for i, t in
                         enumerate([*texts, None, ""])])
    assert sorted(r["doc_id"] for r in run_stage(
        spark, "decontamination", docs, benchmark(
            spark, tmp_path, [*items, None, ""]))) == list(range(5, 22))


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_repeated_rows_together_and_empty_tables(
        spark, tmp_path, name):
    folder = benchmark(spark, tmp_path, ["an item of some more words"])
    docs = sample(spark)
    twice = write_and_read(docs.union(docs), "twice")
    rows = run_stage(spark, name, twice, folder)
    assert rows and all(sum(r["doc_id"] == s["doc_id"] for s in rows) == 2
                        for r in rows)
    assert run_stage(spark, name, docs.limit(0), folder) == []


def test_run_applies_all_stages(spark, tmp_path):
    folder = benchmark(spark, tmp_path, ["w" * 9 + " nothing like the rest"])
    docs = sample(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    left = docs
    for name, stage in P.STAGES[:-1]:
        left = write_and_read(stage(spark, left, folder), name)
    want = {r["doc_id"]: r["text"] for r in left.collect()}
    assert want
    tokens = {}
    for r in P.run(spark, folder).collect():
        tokens.setdefault(r["doc_id"], []).append(
            (r["start"], bytes(r["ids"])))
    from cadenza.llm import packing
    encode = packing.public_byte_bpe()
    assert {i: zlib.crc32(b"".join(ids for _, ids in sorted(p)))
            for i, p in tokens.items()} == {
        i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [
            *encode(t), packing.END_OF_TEXT])) for i, t in want.items()}
