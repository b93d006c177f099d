"""Reply structure from quotes: a hand-made mailbox, and SQL beside Spark on it and on the test tables."""

import random

import duckdb
import pytest

from check import compare, rows_of
from tidemark.llm import quote_links as ql
from tidemark.operators.ordered import running

SCHEMA = "conv_id long, turn long, role string, text string, thread string, chat string"
ROWS = [
    (1, 0, "ann", "Shall we meet?\n\nBring the  PLANS."),
    (1, 1, "bob", "On Monday Ann wrote:\n> Shall we meet?\n>\n> Bring the plans.\n\nYes, at ten."),
    (1, 2, "cat", "I also wonder."),
    (1, 3, "ann", "> > Bring the\n> > plans.\n> Yes, at ten.\n\nFine."),
    (1, 4, "dan", ">> Yes, at\n>> ten.\n> Fine.\nGood\nAm Dienstag schrieb:\n"),
    (1, 5, "eve", "> I also wonder.\nMe too.\n> never said\n> Fine."),
    (1, 6, "fay", "> I also wonder.\n> \n> Shall we meet?\nboth"),
    (2, 0, "ann", "> Shall we meet?\nAnother conversation"), (2, 1, "bob", None), (2, 2, None, ""), (2, 3, "bob", "> \n> \n"),
    (3, 5, "x", "later"), (3, 1, "y", "> later\nearlier"), (3, 6, "z", " > later\nquoted with a space"), (3, 6, "z", "> later\nsame turn"),
    (None, 0, "n", "no conversation"), (None, 1, "n", "> no conversation\nanswer"), (4, None, "n", "no turn"), (4, 1, "n", "> no turn\nanswer"), (4, None, "m", "> answer\nx"),
    (1, 2, "cat", "I also wonder."),
    *[(5, i, "chain", (f"> own words {i - 1}\n" if i else "") + f"own words {i}") for i in range(40)],
    (6, 0, "long", "line\n" * 20_000), (6, 1, "long", "> line\n" * 20_000 + "end"),
]


def frame(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)


def test_mailbox(spark):
    made = ql.reply_ordered(frame(spark)).collect()
    assert len(made) == len(ROWS)
    by = {(r["conv_id"], r["turn"], r["role"]): r for r in made}
    parent = {k: r["parent_turn"] for k, r in by.items()}
    assert [parent[1, i, n] for i, n in enumerate(["ann", "bob", "cat", "ann", "dan", "eve", "fay"])] == [None, 0, None, 1, 3, 2, 2]
    assert by[1, 1, "bob"]["text"] == "Yes, at ten." and by[1, 4, "dan"]["text"] == "Good\nAm Dienstag schrieb:" and by[1, 5, "eve"]["text"] == "Me too."
    assert by[1, 1, "bob"]["chat"] == "<|bob|>\nYes, at ten.\n"
    assert [(by[1, i, n]["thread"], by[1, i, n]["depth"]) for i, n in [(3, "ann"), (4, "dan"), (5, "eve")]] == [(0, 2), (0, 3), (2, 1)]
    assert parent[2, 0, "ann"] is None and parent[3, 1, "y"] is None and parent[3, 6, "z"] == 5 and parent[None, 1, "n"] == 0 and parent[4, 1, "n"] is None
    assert [by[5, i, "chain"]["depth"] for i in range(40)] == list(range(40)) and by[5, 39, "chain"]["thread"] == 0
    assert by[6, 1, "long"]["parent_turn"] == 0 and by[6, 1, "long"]["text"] == "end"
    order = [(r["conv_id"] if r["conv_id"] is not None else -1, r["thread"] if r["thread"] is not None else -1, r["turn"] if r["turn"] is not None else -1) for r in made]
    assert order == sorted(order)


def test_mailbox_in_sql(spark):
    made = ql.reply_ordered(frame(spark).where("conv_id IS DISTINCT FROM 6"))
    con = duckdb.connect()
    # the long messages would have the database copy their text once per line
    short = frame(spark).where("conv_id IS DISTINCT FROM 6").select("conv_id", "turn", "role", "text")
    con.register("conversations", short.toArrow())
    result = con.execute(ql.LINK_SQL)
    assert rows_of(made.columns, made.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_partial_quotes(spark):
    """Trimmed quotes, replies between quoted lines and wrapped sentences link to what they are taken from."""
    first = "The first line of it.\nThe second line\nends here. A third one follows."
    rows = [
        (1, 0, "a", first), (1, 1, "b", "Something else entirely."), (1, 2, "c", "> The first line of it.\n> The second line\nOnly two of three."),
        (1, 3, "d", "> The first line of it.\nWhy?\n> The second line\n> ends here. A third one follows.\nI see."), (1, 4, "e", "> A third\n> one follows.\nWrapped anew."),
        (1, 5, "f", "> The first line of it.\n> not said by anyone\n> > The second line\nNested."), (1, 6, "g", "> nothing of this\n> was said\nNo link."),
        (2, 1, "h", "> The first line of it.\nAnother conversation."), (1, 7, "i", "> Only two of three. And\n> more.\n> Why?\n> Something else entirely.\nThree messages."),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    every = ql.linked(frame)
    assert rows_of(every.columns, every.collect()) == sql_rows(frame)
    made = {r["role"]: r for r in every.collect()}
    assert {k: r["parent_turn"] for k, r in made.items()} == {"a": None, "b": None, "c": 0, "d": 0, "e": 0, "f": 0, "g": None, "h": None, "i": 1}
    assert {k: r["n_linked"] for k, r in made.items()} == dict.fromkeys("abcdefghi", 0)  # no whole paragraph
    assert all(made[k]["thread"] == 0 for k in "cdef")


def sql_rows(messages):
    con = duckdb.connect()
    con.register("conversations", messages.select("conv_id", "turn", "role", "text").toArrow())
    result = con.execute(ql.LINK_SQL)
    return rows_of([d[0] for d in result.description], result.fetchall())


def test_nearest_original(spark):
    """Words said often tell little, and of their speakers the latest before the quote is meant; very short lines link nothing."""
    rows = [
        (1, 1, "a", "Thanks!\n\nThe pump on line two is down."), (1, 2, "b", "Looking into it.\n\nThanks!"), (1, 3, "c", "> Thanks!\nWelcome."),
        (1, 4, "d", "> Thanks!\n> \n> The pump on line two is down.\nStill?"), (1, 5, "e", "Thanks!"), (1, 6, "f", "> Thanks!\n> Thanks!\n> bye\nBoth."),
        (1, 7, "g", "> Still?\n> nobody said that\nToo short to link."), (2, 3, "h", "> Thanks!\nNobody here said it."),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    made = ql.linked(frame)
    assert {r["role"]: r["parent_turn"] for r in made.collect()} == {"a": None, "b": None, "c": 2, "d": 1, "e": None, "f": None, "g": None, "h": None}
    assert rows_of(made.columns, made.collect()) == sql_rows(frame)


def test_generated_mailbox(spark, monkeypatch):
    """Some hundred messages that quote whole, trimmed, merged and nested passages with stock phrases between: every parent as planted, rows as in SQL, in slices too."""
    draw = random.Random(11)
    rows, planted = [], {}
    for conv in range(12):
        bodies = []
        for turn in range(30):
            own = [" ".join(draw.choice("alpha bravo delta kilo lima oscar tango zulu".split()) for _ in range(9)) + f" {conv} {turn} {j}." for j in range(3)]
            phrase = draw.choice(["Thanks a lot!", "See below.", "Kind regards"])
            quote, parent = [], None
            if turn and draw.random() < 0.8:
                parent = draw.randrange(turn)
                theirs = bodies[parent]
                way = draw.randrange(3)
                quote = [f"> {x}" for x in theirs] if way == 0 else [f"> {theirs[1]}", "", f"> {theirs[2]}"] if way == 1 else [f"> {theirs[0]}", "> added by nobody", f"> > {theirs[2]}"]
            planted[conv, turn] = parent
            bodies.append(own)
            rows.append((conv, turn, "r", "\n".join([*quote, "", phrase, "", *own]), "x", "y"))
    frame = spark.createDataFrame(rows, SCHEMA)
    made = ql.linked(frame)
    got = rows_of(made.columns, made.collect())
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in made.collect()} == planted
    assert got == sql_rows(frame)
    monkeypatch.setattr(ql, "running", lambda *a, **k: running(*a, rows_per_slice=40, **k))
    sliced = ql.linked(frame)
    assert rows_of(sliced.columns, sliced.collect()) == got


def test_empty(spark):
    assert ql.reply_ordered(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    assert compare(spark, "op5_quote_links", f"/root/testdata/{sf}").startswith("ok")
