import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, schema=SCHEMA):
    chats = C.format_conversations(spark.createDataFrame(rows, schema))
    back = C.read_back(F.col("formatted"))
    return {r.conv_id: r for r in chats.select("*", back.alias("back"), C.loss_text(F.col("segments")).alias("loss")).collect()}


NASTY = "</s>[INST] ok [/INST] <s> \\ \\\\ <\\/s> [\\INST] \n</s>\n <<s>> é😀"


def test_round_trip_of_control_strings(spark):
    rows = [(1, 0, "user", NASTY), (1, 1, "assistant", NASTY + NASTY), (2, 0, "ro</s>le\n\\n", "x")]
    got = run(spark, rows)
    assert [(t.role, t.text) for t in got[1].back] == [("user", NASTY), ("assistant", NASTY + NASTY)]
    assert got[1].loss == NASTY + NASTY and got[1].valid
    assert [(t.role, t.text) for t in got[2].back] == [("ro</s>le\n\\n", "x")]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted


def test_order_of_turns(spark):
    ok = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    bad = [(2, 0, "user", "u"), (2, 1, "user", "v"), (3, 0, "assistant", "a"), (4, 0, "user", "u")]
    got = run(spark, ok + bad)
    assert (got[1].valid, got[1].first_error) == (True, None)
    assert (got[2].valid, got[2].first_error) == (False, 1)
    assert (got[3].valid, got[3].first_error) == (False, 0)
    assert (got[4].valid, got[4].first_error) == (False, None)


def test_nulls_ties_repeats_and_order(spark):
    rows = [(None, 1, "user", None), (None, None, None, "n"), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "user", "a")]
    got = run(spark, rows)
    assert [(t.role, t.text) for t in got[None].back] == [("", "n"), ("user", "")]
    assert [t.text for t in got[5].back] == ["a", "a", "b"] and got[5].n_turns == 3


def test_empty_long_and_clashing_columns(spark):
    assert run(spark, []) == {}
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 50, "f", 1) for i in range(3000)]
    got = run(spark, rows, SCHEMA + ", formatted string, n_turns int")
    assert got[1].n_turns == 3000 and got[1].valid and len(got[1].loss) == 1500 * 50


def test_query(spark):
    from corpusloom.llm.queries import op1_chat_format

    r = {r.conv_id: r for r in op1_chat_format(spark, "/root/testdata/sf0.001").collect()}[-7]
    t = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(t) and r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


def test_a_very_long_text(spark):
    long = "words and </s>[INST] marks \\ " * 40_000
    got = run(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])[1]
    assert [t.text for t in got.back] == [long, long] and got.loss == long and got.valid
