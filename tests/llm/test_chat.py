import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loanrisk.llm import catalog, chat
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute_valid(roles):
    """(valid, place of the error) by a table of states."""
    state = "start"
    for k, role in enumerate(roles):
        state = {(s, r): t for s, r, t in chat.INSTRUCT.transitions}.get((state, role))
        if state is None:
            return False, k
    return (True, None) if state in chat.INSTRUCT.final else (False, len(roles))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    planted = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", planted), (-7, 1, "assistant", planted)]
    got = {r.conv_id: r for r in catalog.op7_chat(spark, SMALL).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        turns = sorted((t, role, text or "") for c, t, role, text in rows if c == i)
        said = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
        valid, place = brute_valid([role for _, role, _ in turns])
        assert (r.valid, r.error_turn) == (valid, -1 if place is None else place)


def tricky(seed):
    rng = random.Random(seed)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", ">>", "<<", "<", ">", "&", "&amp;", "&eos;",
            "[", "/", "]", "s", "INST", "é", "\n", " ", "\\", "$1", "😀", "amp;"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))


def test_texts_come_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "<</SYS", "", tricky(c * 91 + t)]), tricky(c * 31 + t), "x")
            for c in range(120) for t in range(rng.randrange(1, 6))]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    out = out.withColumn("back", chat.parse_turns(F.col("formatted")))
    controls = [c for c, _ in chat.INSTRUCT.controls if c != ">>"]
    for r in out.collect():
        want = [(role, text) for c, _, role, text, _ in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.back] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        for (role, _), (_, body, _) in zip(want, [r.segments[k:k + 3] for k in range(0, len(r.segments), 3)]):
            assert body.loss == (role == "assistant") and not any(c in body.text for c in controls)
        assert (r.valid, r.error_turn) == brute_valid([role for role, _ in want])


def test_edges(spark):
    rows = [(1, 1, "assistant", None, None), (1, 0, "user", "q", None), (2, None, None, None, None), (2, 0, "user", "b", None),
            (2, 0, "user", "a", None), (None, 0, "user", "x", None), (None, 1, "assistant", "y", None), (3, 0, "system", "", None)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in out.withColumn("back", chat.parse_turns(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", "q"), ("assistant", "")] and got[1].valid
    assert [tuple(t) for t in got[2].back] == [("", ""), ("user", "a"), ("user", "b")] and got[2].error_turn == 0
    assert got[None].valid and (got[3].valid, got[3].error_turn) == (False, 1)
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["", "&", "&lt;", "<s></s>", "a&eos;b", "&amp;eos;"])
def test_escape_round_trip(spark, text):
    row = spark.range(1).select(F.lit(text).alias("t")).select(
        chat.escaped(F.col("t"), chat.INSTRUCT).alias("e")).select("e", chat.unescaped(F.col("e"), chat.INSTRUCT).alias("u")).first()
    assert row.u == text
