from furrow.plans.conversations import HISTORY_HEADER, last_turns


def test_last_turns_pairs_invocations(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "ctx USER MESSAGE: q1 "), (1, 2, "assistant", "a1"), (1, 3, "assistant", " a1b "),
            (1, 4, "user", "  "), (1, 5, "user", "q3"), (1, 6, "assistant", None), (1, 7, "user", "now"), (1, 8, "assistant", "part"),
            (2, 0, "user", "only"), (3, 0, "system", "s"), (3, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: (r.n_turns, r.history) for r in last_turns(turns, chunk_turns=2).collect()}
    lines = [HISTORY_HEADER, "Turn 1 assistant: hello", "Turn 2 user: q1", "Turn 2 assistant: a1b", "Turn 3 user: q3"]
    assert got == {1: (3, "\n".join(lines)), 3: (1, HISTORY_HEADER + "\nTurn 1 assistant: a")}
    two = {r.conv_id: r.history for r in last_turns(turns, k=2, skip_current=False).collect()}
    assert two[1].split("\n")[1:] == ["Turn 1 user: q3", "Turn 2 user: now", "Turn 2 assistant: part"]


def test_last_turns_empty(spark):
    assert last_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
