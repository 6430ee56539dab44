import hashlib

from hypothesis import given, settings, strategies as st
import pytest

from cadenza.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PIECES = st.lists(st.sampled_from([
    "[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[OUT] ", "[ROLE x] ",
    " [/ROLE]", "\\", "[\\INST]", "[", "<", "]", "/", " ", "a\n", "é𝄞"]),
    max_size=8).map("".join)


def brute(rows):
    made = {}
    for conv, turn, role, text in sorted(
            rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "",
                                 r[3] or "")):
        made.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in made.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    got = C.digests(C.format_conversations(
        spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"],
                           r["loss_sha256"]) for r in got} == brute(rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(
    ["user", "assistant", "system", "a] b%", "[ROLE", None]), PIECES),
    min_size=1, max_size=25))
def test_turns_are_read_back_exactly(spark, drawn):
    check(spark, [(c, i, r, t) for i, (c, r, t) in enumerate(drawn)])


def test_edge_rows(spark):
    check(spark, [(1, None, "user", None), (1, 2, None, "x"),
                  (1, 2, None, "x"), (None, 0, "assistant", "y"),
                  (3, 0, "user", "long " * 50000), (3, 1, "assistant", ""),
                  (-7, 0, "user", "</s>[INST] ok [/INST]"),
                  (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.format_conversations(empty)).count() == 0


@pytest.mark.parametrize("roles, bad", [
    ("user assistant", None), ("system user assistant user assistant", None),
    ("assistant", 0), ("user user", 1), ("user", 1), ("system", 1),
    ("user assistant system", 2), ("user tool assistant", 1)])
def test_machine(spark, roles, bad):
    rows = [(1, i, r, "t") for i, r in enumerate(roles.split())]
    row = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row["valid"], row["bad_turn"]) == (bad is None, bad)


def test_segments_make_the_text(spark):
    rows = [(1, 0, "user", "q [INST]"), (1, 1, "assistant", "a </s>")]
    row = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == "".join(s["text"] for s in row["segments"])
    assert row["formatted"] == \
        "<s>[INST] q [\\INST] [/INST][OUT] a <\\/s> </s>"
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["a <\\/s>"]
