import struct

import helpers
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cadenza.llm import packing as P

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = P.public_byte_bpe()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(
    ["<|endoftext|>", "<|endoftext|", " ", "a", "é", "\n", "漢"]))
    .map("".join)))
def test_ids_are_those_of_the_json_file(text):
    text = text.encode("utf-8", "replace").decode()
    assert ENCODE(text) == REFERENCE.encode(
        text, add_special_tokens=False).ids


def read(rows):
    """ids by document row, checked piece by piece."""
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = struct.unpack(f"<{r['length']}I", bytes(r["ids"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids, r))
    return by_doc


def test_an_added_token_in_a_text_is_one_id():
    assert ENCODE("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_pieces_rebuild_every_document(spark, scratch):
    texts = ["one two three", None, "", "again and again " * 900,
             "Ünïcode 漢字 <|endoftext|>", "x" * 5000]
    docs = helpers.documents(spark, [(i, t, None, None) for i, t in
                                     enumerate(texts)]).repartition(3)
    rows = P.pack(scratch, docs, length=64).collect()
    by_doc = read(rows)
    for i, text in enumerate(texts):
        want = REFERENCE.encode(text or "", add_special_tokens=False).ids
        got = [x for _, ids, _ in sorted(by_doc[i], key=lambda p: p[0])
               for x in ids]
        assert got == [*want, P.END_OF_TEXT]
        assert all(r["doc_tokens"] == len(got) for _, _, r in by_doc[i])
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    last = max(at)
    assert sorted(at) == list(range(last + 1))
    assert all(at[s] == 64 for s in at if s != last) and at[last] <= 64


def test_a_window_may_end_with_a_document(spark, scratch):
    docs = helpers.documents(spark, [(i, "", None, None) for i in range(8)])
    rows = P.pack(scratch, docs, length=4).collect()
    assert sorted((r["sequence_id"], r["offset"]) for r in rows) == [
        (s, o) for s in (0, 1) for o in range(4)]


def test_repeated_rows_null_ids_and_empty_tables(spark, scratch):
    docs = helpers.documents(spark, [(1, "a b", None, None)] * 2
                             + [(None, "c", None, None)])
    rows = P.pack(scratch, docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert P.pack(scratch, docs.limit(0)).count() == 0
