"""Chat formatting: exact round trips, and branches against a plain walk."""

import random

from hypothesis import given, settings, strategies as st

from tideclock.llm import chat

PARTS = st.lists(st.sampled_from(["a", "é", "🙂", " ", "\n", "\\", "[", "]", "<", ">", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[\\", "<\\"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PARTS), PARTS), max_size=6))
def test_round_trip(turns):
    formatted, mask = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_nulls_are_empty():
    assert chat.parse_turns(chat.format_turns([(None, None), ("user", None)])[0]) == [("", ""), ("user", "")]


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "tree string, node bigint, parent bigint, role string, text string, score double, up string, branch string")


def test_branches(spark):
    rng, rows = random.Random(4), []
    for tree in range(12):
        for node in range(rng.choice([1, 2, 9, 40])):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else None
            rows.append((f"t{tree}", node, parent, "user", f"{tree}.{node}", rng.choice([None, 0.0, 1.0, -1.0, 2.0])))
    got = {}
    for r in chat.paths(messages(spark, rows), branches=3).collect():
        got.setdefault((r["tree"], r["branch"]), []).append((r["steps"], r["node"]))
    want = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        ways = []
        for leaf in nodes.keys() - {r[2] for r in nodes.values()}:
            way = [leaf]
            while nodes[way[-1]][2] is not None:
                way.append(nodes[way[-1]][2])
            ways.append((-sum(nodes[n][5] or 0 for n in way), leaf, way))
        for i, (_, _, way) in enumerate(sorted(ways)[:3], 1):
            want[tree, i] = list(enumerate(way))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_deep_chain_and_cycle(spark):
    rows = [("deep", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", str(i), 0.0) for i in range(300)]
    rows += [("loop", 1, 2, "user", "a", 0.0), ("loop", 2, 1, "user", "b", 0.0), ("orphan", 5, 77, "user", "c", 0.0)]
    got = {r["tree"]: r["formatted"] for r in chat.format_trees(messages(spark, rows)).collect()}
    assert set(got) == {"deep", "orphan"}
    assert [t for _, t in chat.parse_turns(got["deep"])] == [str(i) for i in range(300)]


def test_conversations(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, tree string, node string"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "</s>[INST]"), (2, 0, None, None), (None, 3, "user", "x"), (3, None, "user", "late"), (3, None, "user", "late"), (3, 1, "assistant", "z" * 100_000)]
    frame = spark.createDataFrame([(*r, "t", "n") for r in rows], kind)
    got = {r["tree"]: r for r in chat.digest(chat.format_trees(chat.as_tree(frame))).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {"=1": 2, "=2": 1, "null": 1, "=3": 3}
    assert got["=3"]["loss_chars"] == 100_000 and got["=1"]["loss_chars"] == 1
    assert chat.digest(chat.format_trees(chat.as_tree(frame.limit(0)))).count() == 0


def test_null_id_and_the_id_null(spark):
    rows = [(None, 0, "user", "of nobody"), ("null", 0, "user", "of null"), ("", 0, "user", "of the empty id"), ("=", 0, "user", "of the sign")]
    frame = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    got = chat.format_trees(chat.as_tree(frame)).withColumn("conv_id", chat.conv_id(chat.F.col("tree"))).collect()
    assert {(r["conv_id"], chat.parse_turns(r["formatted"])[0][1]) for r in got} == {(r[0], r[3]) for r in rows}
