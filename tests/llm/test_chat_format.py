"""Quotation linking against a loop over each conversation."""

import random
import re

from tidewake.llm import chat_format as C


def brute(rows):
    parse = {}
    for conv, turn, _, text in rows:
        out = []
        for x in re.split(r"\r?\n", text or ""):
            m = re.match(C.MARK, x)
            out.append([m[0].count(">") if m else 0, x[m.end() :] if m else x])
        for a, b in zip(out, out[1:]):
            if a[0] == 0 and b[0] > 0 and re.search(C.ANNOUNCES, a[1]):
                a[0] = -1
        runs = []
        for (n, x), last in zip(out, [None, *out]):
            if last and x.strip() and last[1].strip() and last[0] == n:
                runs[-1][1].append(x)
            else:
                runs.append((n, [x]))
        out += [[n, " ".join(xs)] for n, xs in runs if len(xs) > 1]
        parse.setdefault((conv, turn), []).append(out)
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    own = {k: {norm(x) for ls in v for n, x in ls if n == 0} for k, v in parse.items()}
    parent = {}
    for (conv, turn), versions in parse.items():
        votes = {}
        for ls in versions:
            for n, x in ls:
                if n > 0 and norm(x):
                    src = max((t for c, t in own if c == conv and t < turn and norm(x) in own[c, t]), default=None)
                    if src is not None:
                        votes[n, src] = votes.get((n, src), 0) + 1
        if votes:
            low = min(n for n, _ in votes)
            parent[conv, turn] = max((k, s) for (n, s), k in votes.items() if n == low)[1]
    out = {}
    for key in parse:
        at, depth = key[1], 0
        while (key[0], at) in parent:
            at, depth = parent[key[0], at], depth + 1
        out[key] = (parent.get(key), at, depth)
    return out


def talk(seed):
    rng, rows = random.Random(seed), []
    for conv in range(6):
        said = []
        for turn in range(rng.choice([1, 3, 40])):
            text = [f"line {rng.randrange(30)} of {conv}", "Common line"]
            if said and rng.random() < 0.7:
                quoted = rng.choice(said)
                text = ["On Monday x wrote:"] * rng.randrange(2) + [">" + " " * rng.randrange(2) + x.upper() for x in quoted] + text
            said.append(text)
            rows.append((conv, turn * rng.choice([1, 1, 600]) + (turn * 2000 if conv == 5 else 0), "user", "\n".join(text)))
    return rows


def test_against_brute_force(spark):
    rows = talk(1) + [(0, 0, "user", "again\nCommon line")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread", C.F.lit("x"))
    got = C.format_chat(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["parent"], r["thread"], r["depth"]) == want[r["conv_id"], r["turn"]]
        assert ">" not in r["own_text"] and r["formatted"].startswith("<|user|>\n")
    assert max(r["depth"] for r in got) > 2


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "> x"), (1, None, "user", "x"), (2, 0, "a", "> " * 5000 + "x")], "conv_id long, turn long, role string, text string")
    got = C.format_chat(df).collect()
    assert len(got) == 5 and all(r["depth"] == 0 and r["parent"] is None for r in got)
    assert C.format_chat(df.limit(0)).count() == 0


def test_a_passage_that_was_wrapped_anew_finds_its_source(spark):
    original = "The first words of it\nand then some more words\nand the last ones.\n\nSomething else"
    rows = [(1, 0, "a", original), (1, 1, "b", "No quote"), (1, 2, "a", "> > The first words of it and then\n> > some more words and the\n> > last ones.\n> No quote\nI see"), (1, 3, "b", "> the FIRST words of it and then some more words and the last ones.\nYes"), (1, 4, "b", "> words of it and then\nNo")]
    got = {r["turn"]: r for r in C.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t]["parent"] for t in range(5)] == [None, None, 1, 0, None]
    assert got[2]["n_quoted"] == 4 and got[3]["own_text"] == "Yes"


def test_sql_gives_the_same_rows(spark):
    import duckdb
    import pandas as pd

    rows = talk(1) + talk(2)[:40] + [(0, 0, "user", "again\nCommon line"), (90, 0, "a", "  one\ntwo three\n\n four "), (90, 1, "b", "> one two three\n>> deep\n>> er\nok \n"), (90, 2, None, "Am Montag schrieb x:\n> ok\n"), (91, 0, "a", ""), (92, 3, "b", None)]
    want = C.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    cur = con.sql(C.SQL)
    assert cur.columns == want.columns
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in want.collect())
