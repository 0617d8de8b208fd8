import hashlib

from pyspark.sql import functions as F

from corpusloom.llm.reply_trees import ReplyTrees, from_turns, loss_text, turns_of

NODES = "conv_id long, node_id long, parent_id long, role string, text string, score double"


def read(out):
    rows = out.select("conv_id", "leaf_id", "rank", "score", turns_of(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    return {(r.conv_id, r.leaf_id): (r["rank"], [(x.role, x.text) for x in r.t], r.loss) for r in rows}


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "c", 3.0), (1, 5, 1, "assistant", "d", None), (2, 1, 9, "user", "orphan", 1.0), (3, 1, 2, "x", "ring", 1.0), (3, 2, 1, "x", "ring", 1.0)]
    nodes = spark.createDataFrame(rows, NODES)
    got = read(ReplyTrees().format(nodes))
    assert got == {(1, 4): (1, [("user", "q"), ("assistant", "b"), ("user", "c")], "b"), (1, 2): (2, [("user", "q"), ("assistant", "a")], "a"), (1, 5): (3, [("user", "q"), ("assistant", "d")], "d"), (2, 1): (1, [("user", "orphan")], "")}
    assert set(read(ReplyTrees(branches=2).format(nodes))) == {(1, 4), (1, 2), (2, 1)}
    assert set(read(ReplyTrees(branches=1).format(nodes))) == {(1, 4), (2, 1)}


def test_control_strings_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "&lt;&amp;#91;", "", None, "a\nb", "\U0001f600"]
    rows = [(7, i, ("assistant", "us<er\nx", None)[i % 3], t, "k") for i, t in enumerate(odd)] + [(None, 1, "assistant", "n", "k"), (8, None, "user", "x", "k"), (8, None, "user", "x", "k")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {k[0]: v for k, v in read(ReplyTrees().format(from_turns(turns))).items()}
    assert got[7][1] == [(r or "", t or "") for _, _, r, t, _ in rows[:7]]
    assert got[7][2] == "".join(t or "" for _, _, r, t, _ in rows[:7] if r == "assistant")
    assert got[None][1] == [("assistant", "n")] and got[8][1] == [("user", "x")] * 2


def test_a_long_thread_and_no_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = ReplyTrees().format(from_turns(turns))
    (value,) = read(out).values()
    assert [t for _, t in value[1]] == [f"t{i}" for i in range(300)]
    assert hashlib.sha256(value[2].encode()).hexdigest() == hashlib.sha256("".join(f"t{i}" for i in range(1, 300, 2)).encode()).hexdigest()
    assert ReplyTrees().format(from_turns(turns.where("1 = 0"))).count() == 0


def test_a_very_long_text_and_a_conversation_over_many_partitions(spark):
    """One conversation holds most rows, among them very many equal ones; another holds one very long text."""
    rows = [(1, i // 3, "assistant" if i % 2 else "user", f"t{i % 4}") for i in range(600)] + [(1, 5000, "user", "same")] * 100
    rows += [(2, 0, "user", "[<&" * 300_000), (2, 1, "assistant", "ok")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    got = {k[0]: v for k, v in read(ReplyTrees().format(from_turns(turns))).items()}
    assert got[1][1] == [(r, t) for c, _, r, t in sorted(rows) if c == 1]
    assert got[2][1] == [(r, t) for c, _, r, t in rows if c == 2] and got[2][2] == "ok"
