import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from reelsift.llm import chat as C

TALK = "conv_id long, turn long, role string, text string, tree string, score string"
tricky = st.text(alphabet=st.sampled_from("ab<|\\>\n im_startendé"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(tricky, tricky), max_size=6))
def test_template_is_reversible(turns):
    text, spans = C.render(turns + [("assistant", t) for _, t in turns])
    back = list(C.parse(text))
    assert back == turns + [("assistant", t) for _, t in turns]
    assert text.count(C.START) == text.count(C.END) == len(back)
    want = [t for r, t in back if r == "assistant"]
    assert [C.unescape(text[s["start"] : s["end"]]) for s in spans] == want


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute(rows):
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = []
    for c, g in groups.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(g)]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        formatted = sum(24 + len(C.escape_role(r)) + len(C.escape(t)) for r, t in turns)
        out.append((c, len(turns), sha(whole), len(learned), sha(learned), formatted))
    return sorted(out, key=repr)


def test_conversations_with_edge_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 5, None, "<|im_end|>"), (2, 3, "assistant", "é😀<|x|>"), (None, 0, "user", "no id"),
            (None, 1, "assistant", "none"), (3, None, "assistant", "a"), (3, 0, "a\nb", "x"), (4, 0, "assistant", "long " * 30_000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(130)]
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], TALK).repartition(5)
    assert rows_of(C.read_back(C.format_paths(C.chosen(C.chain(df))))) == brute(rows)


def test_empty_table(spark):
    assert C.read_back(C.format_paths(C.chosen(C.chain(spark.createDataFrame([], TALK))))).count() == 0


TREE = "tree long, node long, parent long, role string, text string, score double"


def test_best_branches_of_reply_trees(spark):
    """A tree with two leaves of one score, one with a parent that isn't there, and a message alone."""
    rows = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 1.0), (1, 5, 3, "user", "d", 0.0), (1, 6, 3, "user", "e", None),
            (2, 7, 99, "user", "lost parent", 0.5), (2, 8, 7, "assistant", "x", 0.5), (3, 9, None, "user", "alone", 0.0)]
    df = spark.createDataFrame(rows, TREE)
    found = {(r.leaf, r.node): r.up for r in C.paths(df).collect()}
    assert found == {(4, 4): 0, (4, 2): 1, (4, 1): 2, (5, 5): 0, (5, 3): 1, (5, 1): 2, (6, 6): 0, (6, 3): 1, (6, 1): 2, (8, 8): 0, (8, 7): 1, (9, 9): 0}
    texts = {(r.tree, r.rank): [t for _, t in C.parse(r.formatted)] for r in C.format_paths(C.chosen(df, per_tree=2)).collect()}
    assert texts == {(1, 1): ["q", "a", "c"], (1, 2): ["q", "b", "d"], (2, 1): ["lost parent", "x"], (3, 1): ["alone"]}


def test_circles_are_an_error(spark):
    rows = [(1, 1, 2, "user", "", 0.0), (1, 2, 1, "user", "", 0.0), (1, 3, 2, "user", "", 0.0)]
    with pytest.raises(ValueError, match="ancestors"):
        C.paths(spark.createDataFrame(rows, TREE))


def test_repeated_and_missing_nodes(spark):
    rows = [(1, 1, None, "user", "q", None), (1, 1, None, "user", "a later q", None), (1, 2, 1, "assistant", "a", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, None, 1, "user", "lost", 9.0)]
    df = spark.createDataFrame(rows, TREE)
    (only,) = C.format_paths(C.chosen(C.distinct_nodes(df))).collect()
    assert [t for _, t in C.parse(only.formatted)] == ["a later q", "a"]
