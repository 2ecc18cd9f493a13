import random

import duckdb

from pentad.llm.queries import ORACLE_SQL
from pentad.llm.quote_links import conversations, link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, seq long, depth long"
ROWS = [
    (1, 0, "user", "Hello there\nHow is the  weather?\n\nbye"),
    (1, 1, "assistant", "> how is THE weather?\nSunny."),
    (1, 2, "user", "On Monday X wrote:\n> Sunny.\n> > How is the weather?\n\nThanks\n> not from anyone"),
    (1, 3, "user", "> Hello there\n>How is the weather?\nI ask too"),
    (1, 4, "assistant", "no quote here"),
    (1, 5, "user", "> >  deep only, unknown\n > thanks\nOn Monday X wrote:\nplain"),
    (1, 6, "user", "> later line"),
    (1, 7, "user", "later line\r\n> no quote here\r\nend"),
    (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "user", "> Sunny."), (2, None, "user", "first"), (2, 3, None, ">\n> \n>>"),
    (None, 0, "user", "lost"), (None, 1, "user", "> lost\nfound"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "x " * 50000 + "\n> y"),
]


def test_links_and_order(spark):
    got = {(r.conv_id, r.seq): r for r in link_quotes(spark.createDataFrame([(*r, 5, 6) for r in ROWS], SCHEMA)).collect()}
    assert len(got) == len(ROWS)
    assert [got[1, i].reply_to for i in range(8)] == [None, 0, 1, 0, 3, 2, 5, 4]
    assert [got[1, i].depth for i in range(8)] == [0, 1, 2, 1, 2, 3, 4, 3]
    assert got[1, 2].body == "Thanks" and (got[1, 2].n_quoted, got[1, 2].n_linked) == (3, 2)
    assert got[1, 7].body == "later line\nend" and got[2, 3].link == "sequence" and got[2, 4].n_quoted == 0
    order = sorted(range(8), key=lambda i: got[1, i].position)
    assert all(order.index(got[1, i].reply_to) < order.index(i) for i in range(1, 8))


def test_against_sql(spark):
    df = spark.createDataFrame([(*r, 5, 6) for r in ROWS], SCHEMA)
    con, got = duckdb.connect(), link_quotes(df)
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    want = con.sql(ORACLE_SQL["op1_quote_links"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    assert link_quotes(df.limit(0)).count() == 0


def test_rewrapped_passages_link(spark):
    prose = "The first sentence is long enough to wrap. A second one follows it here! And a third, which stays unquoted."
    rows = [
        (1, 0, "user", prose), (1, 1, "assistant", "unrelated words"), (1, 2, "user", "nothing here"),
        (1, 3, "user", "> The first sentence is long\n>   enough to WRAP. A second\n> one follows it here!\nyes"),
        (1, 4, "user", "> second one follows it here, somewhat changed\nno"),
        (1, 5, "user", ">> yes\n> The first sentence is long enough\n> to wrap.\nagain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.seq: r for r in link_quotes(df).collect()}
    assert [got[i].reply_to for i in range(6)] == [None, 0, 1, 0, 3, 0] and got[3].n_linked == 1 and got[4].n_linked == 0
    assert (got[5].n_quoted, got[5].n_linked, got[5].body) == (2, 2, "again")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(ORACLE_SQL["op1_quote_links"])
    assert sorted(map(repr, map(tuple, link_quotes(df).select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_conversations_in_blocks(spark):
    df = spark.createDataFrame([(*r, 5, 6) for r in ROWS], SCHEMA)
    told = {(r.conv_id, r.position): r for r in link_quotes(df).collect()}
    seen = 0
    for r in conversations(df, block=3).collect():
        assert 0 < len(r.messages) <= 3
        for i, m in enumerate(r.messages):
            t = told[r.conv_id, 3 * r.block + i]
            up = next((u.position for u in told.values() if u.conv_id == r.conv_id and u.seq == t.reply_to), None)
            assert (m.role, m.body, m.answers) == (t.role, t.body, up) and (up is None or up < t.position)
            seen += 1
    assert seen == len(ROWS) and conversations(df.limit(0)).count() == 0


def test_long_chains_of_quotes(spark):
    rng = random.Random(9)
    rows = [(1, i, "user", f"message number {i}." if i % 7 else f"> message number {rng.randrange(max(1, i - 40), max(2, i))}.\nmessage number {i}.") for i in range(700)]
    df = spark.createDataFrame([*rows, *((2, i, "user", "same line") for i in range(50))], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.seq): r for r in link_quotes(df).collect()}
    depth = {}
    for key in sorted(got):
        up = got[key].reply_to
        depth[key] = 0 if up is None else depth[key[0], up] + 1
        assert got[key].depth == depth[key]
    order = sorted((k for k in got if k[0] == 1), key=lambda k: (depth[k], k[1]))
    assert [got[k].position for k in order] == list(range(700))
