"""Chat forests against plain reading of the conversations, the template's escapes, and what each token may attend to."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modsplit_spark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    """Turns of each conversation by (turn, role) with nulls as empty texts."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def formatted(turns):
    return "".join("".join(chat.format_turn(*t)) for t in turns)


def plain(rows):
    out = []
    for conv, turns in conversations(rows).items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted(turns))))
    return sorted(out, key=repr)


def checked(spark, rows):
    """The digest, and every conversation as its last piece sees it; the forest's tokens of each tree have no gap and no overlap."""
    forest = chat.build(spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, ids string, start int").repartition(3))
    assert sorted((tuple(r) for r in chat.read_back(forest).collect()), key=repr) == plain(rows)
    pieces = {(p["tree"], p["start"]): p for p in forest.pieces.collect()}
    trees = {}
    for (tree, start), p in sorted(pieces.items()):
        assert start == len(trees.get(tree, b"")) // 2 and p["n_tokens"] == len(p["ids"]) // 2
        trees[tree] = trees.get(tree, b"") + p["ids"]
    last = {}
    for t in forest.turns.collect():
        if t["ordinal"] >= last.get(t["conv_id"], (0,))[0]:
            last[t["conv_id"]] = (t["ordinal"], t["tree"], t["start"])
    for conv, turns in conversations(rows).items():
        n, tree, start = last[conv]
        p = pieces[tree, start]
        seen = b"".join(trees[tree][2 * i["start"] : 2 * i["end"]] for i in p["attends"])
        assert n == len(turns) and p["position"] == len(seen) // 2
        assert chat.decode(seen + p["ids"]) == formatted(turns) and chat.read_turns(formatted(turns)) == turns
    return forest, pieces, trees


def test_shared_turns_stand_once(spark):
    rows = []
    for conv, path in enumerate(["ab", "abc", "abd", "abcde", "x", "abd", "abcdf", "ay", "abcg", "xz", "ayyyy"]):
        rows += [(conv, 2 * i, ("user", "assistant", "system")[i % 3], f"text {c}") for i, c in enumerate(path)]
    _, pieces, trees = checked(spark, rows)
    texts = {tree: [t for _, t in chat.read_turns(chat.decode(ids))] for tree, ids in trees.items()}
    # Depth first, the least conversation's turns first: ab, c, its ends, then what leaves earlier.
    assert {int(k): "".join(t[-1] for t in v) for k, v in texts.items()} == {0: "abcdefgdyyyy", 4: "xz"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in rnd.sample(range(-50, 500), 120):
        for turn in range(rnd.choice([1, 2, 3, 4, 6, 30])):
            rows.append((conv, turn * 3, rnd.choice(["user", "assistant"]) if seed == 1 else "user", rnd.choice("ab" if rnd.random() < 0.8 else "abcdefg") * (1 + turn % 2)))
    rows += [(1000 + i, t, r, x) for i in range(60) for _, t, r, x in [q for q in rows if q[0] == rows[0][0]]]
    checked(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, 0, "user", None), (1, 1, None, ""), (None, 5, "user", "hi"), (None, None, "assistant", "ho"), (2, 0, "user", long), (2, 1, "assistant", long + "\U0001f600"), (3, 7, "tool\n[/ROLE]", "<s>"), (4, 0, "user", "a"), (4, 0, "user", "a"), (2**63 - 1, 0, "user", "hi"), (-(2**63), 0, "user", "hi")]
    rows += [(5, 0, "user", "</s>[INST] ok [/INST]"), (5, 1, "assistant", "</s>[INST] ok [/INST]")]
    checked(spark, rows)
    empty = chat.build(spark.createDataFrame([], SCHEMA))
    assert empty.pieces.collect() == [] and chat.read_back(empty).collect() == []


def test_one_conversation_over_many_partitions(spark):
    """A third and more of all rows in one conversation, and as many conversations that begin alike."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"t{i % 17}") for i in range(900)] + [(100 + i, j, ("user", "assistant")[j % 2], f"t{j % 17}") for i in range(300) for j in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        checked(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


PART = st.sampled_from([*chat.RESERVED, "\\", "<", "[", "s>", "/s>", "INST]", "/ROLE]", " ", "\n", "é", "x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.lists(PART, max_size=4).map("".join)), st.lists(PART, max_size=8).map("".join)), max_size=5))
def test_template_is_read_back(turns):
    text = "".join("".join(chat.format_turn(*t)) for t in turns)
    assert chat.read_turns(text) == turns
    for _, t in turns:
        assert not any(m in chat.escape(t) for m in chat.RESERVED) and chat.unescape(chat.escape(t)) == t
