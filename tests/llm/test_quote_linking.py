import time

from sparkloom.llm import quote_linking as m

SCHEMA = "conv_id long, turn long, role string, text string, lines string"
TALK = [
    (1, 0, "user", "Where do the  herons\nnest this year?\n\nAnd who counts them?"),
    (1, 1, "assistant", "On Monday Ann wrote:\n> Where do the herons nest\n> this year?\n\nIn the reeds by the lock."),
    (1, 2, "user", "> In the reeds by the lock.\n\nWhich lock?\n"),
    (1, 3, "assistant", ">> in the reeds by the lock.\n> Which lock?\n\nThe upper one."),
    (1, 4, "user", "> And who counts them?\nStill asking."),
    (1, 5, "user", "> nobody ever said this\nreally?"),
    (1, 6, "user", "Which lock?"),
    (1, 7, "user", "> Which lock?\nthat one"),
    (1, 1100, "user", "far away"),
    (1, 2500, "user", "  > > The upper one.\n > far away\nlate"),
    (2, 0, "user", "> The upper one.\nfrom elsewhere"),
    (2, 1, "user", "> from elsewhere\nsame"),
    (2, 1, "assistant", "b"), (2, 1, "assistant", "b"),
    (2, 2, "user", ""), (2, 3, None, None), (2, 4, "user", ">"), (2, 5, "user", "On it he wrote:"),
    (3, 0, "user", "I think so."), (3, 1, "user", "> I think so.\n> Ann wrote:\n>> a deeper one\nyes"), (3, 2, "user", "Ann wrote:\nno quote here"),
    (None, 0, "user", "> from elsewhere\nx"), (2, None, "user", "> from elsewhere\ny"), (None, None, None, None),
]


def talk(spark, rows=TALK):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_replies(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in m.conversations(talk(spark)).filter("conv_id = 1").collect()}
    parents = {t: rows[1, t]["parent_turn"] for t in (0, 1, 2, 3, 4, 5, 7, 2500)}
    assert parents == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: None, 7: 6, 2500: 1100}
    assert [rows[1, t]["depth"] for t in (0, 1, 2, 3, 4)] == [0, 1, 2, 3, 1]
    assert {rows[1, t]["thread_turn"] for t in (0, 1, 2, 3, 4)} == {0}
    assert rows[1, 1]["text"] == "In the reeds by the lock."
    assert rows[1, 3]["text"] == "The upper one."
    assert [t for _, t in sorted((r["position"], r["turn"]) for r in rows.values())] == [0, 1, 2, 3, 4, 5, 6, 7, 1100, 2500]


def test_link_across_conversations(spark):
    links = m.link(m.passages_of(m.parse(talk(spark)))).filter("conv_id = 2 AND turn = 0").collect()
    assert [(r["source_conv"], r["source_turn"]) for r in links] == [(1, 3)]


def test_same_as_sql(spark, oracle, same):
    df = talk(spark)
    same(m.conversations(df), oracle(m.ORACLES["op1_quote_linking"], conversations=df))


def test_introduction_inside_a_quote(spark):
    rows = {r["turn"]: r for r in m.conversations(talk(spark)).filter("conv_id = 3").collect()}
    assert rows[1]["parent_turn"] == 0 and rows[1]["n_quotes"] == 2
    assert rows[2]["text"] == "Ann wrote:\nno quote here"


def test_very_long_text(spark):
    """Ten thousand lines, alternately quoted, take seconds: the work grows with the lines, not with their square."""
    lines = [("> " if i % 3 == 0 else "") + f"line {i} of a very long message" for i in range(10_000)]
    rows = [(9, 0, "user", "line 0 of a very long message"), (9, 1, "user", "\n".join(lines)), (9, 2, "user", "> line 1 of a very long message line 2 of a very long message\nhere")]
    began = time.monotonic()
    got = {r["turn"]: r for r in m.conversations(talk(spark, rows)).collect()}
    assert time.monotonic() - began < 60
    assert got[1]["n_quotes"] == 3334 and got[1]["parent_turn"] == 0 and got[2]["parent_turn"] == 1
    assert got[1]["text"] == "\n".join(x for x in lines if not x.startswith(">"))


def test_hot_conversation_and_passage(spark, oracle, same):
    rows = [(7, t, "user", "hello there" if t % 2 else "> hello there\nagain") for t in range(3000)]
    df = talk(spark, rows)
    same(m.conversations(df), oracle(m.ORACLES["op1_quote_linking"], conversations=df))


def test_empty(spark):
    assert m.conversations(talk(spark, [])).collect() == []
