"""Conversation repair against exhaustive search and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import duckdb
import pandas as pd
import pytest

from siftlog.llm import conversations as C
from siftlog.llm import queries_sql

SCHEMA = "conv_id long, turn long, role string, text string, n string, at string"


def least(symbols):
    """The cheapest, then least, audit by trying every edit at every place."""
    def step(state, initial):  # states: start, s, u, * (after a)
        if state == "start":
            return {"s": "s", "u": "u"}.get(initial)
        if state in ("s", "*"):
            return "u" if initial == "u" else None
        return "*" if initial == "a" else None

    @cache
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(symbols) and state in ("start", "*") else []
        if inserted < 3:
            for x in "ua":
                if to := step(state, x):
                    c, a = best(i, to, inserted + 1)
                    ways.append((c + 3, "I" + a))
        if i < len(symbols):
            role, go, truncated = symbols[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a))
            if not go:
                if to := step(state, role):
                    c, a = best(i + 1, to, 0)
                    ways.append((c + 3 * truncated, "K" + a))
                for x in "ua":
                    if to := step(state, x):
                        c, a = best(i + 1, to, 0)
                        ways.append((c + 3 + 3 * truncated, "R" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "start", 0)


def symbol(role, go, truncated):
    return C.GO if go else "suax".index(role) * 2 + truncated


def runs_of(symbols):
    out = []
    for s in (symbol(*x) for x in symbols):
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1] + 1)
        else:
            out.append((s, 1))
    return out


def test_runs_give_the_least_of_all_edits():
    r = random.Random(1)
    for trial in range(1500):
        n = r.randint(0, 9) if trial % 3 else r.randint(10, 60)
        few = [(r.choice("suax"), r.random() < 0.15, r.random() < 0.3) for _ in range(r.randint(1, 4))]
        symbols = [x for _ in range(n) for x in [r.choice(few)] * r.choice((1, 1, 1, 2, 5))][:n]
        runs = runs_of(symbols)
        cut = r.randint(0, len(runs))
        cost, letters = C.solve([runs[:cut], runs[cut:]])
        assert (cost, "".join(letters)) == least(tuple(symbols)), symbols


def test_long_runs_advance_by_powers():
    for role in "suax":
        for truncated in (False, True):
            s = symbol(role, False, truncated)
            for n in (1, 2, 3, 7, 64, 1000):
                v = C.END
                for _ in range(n):
                    v = C._step(s, v)
                assert C.advance(s, n, C.END) == v
            one = C.solve([[(s, 1)]] * 3000)
            assert C.solve([[(s, 3000)]]) == (one[0], ["".join(one[1])])
    cost, (audit,) = C.solve([[(symbol("u", False, False), 5_000_000)]])
    assert cost == 3 * 2_500_000 and audit == "KR" * 2_500_000


def awkward():
    r = random.Random(4)
    rows = []
    for c in range(150):
        said = ["Fine.", "What?", "no end", "", " \n\t", None, "End!  \n", "a.b", " ", "ü."]
        for t in range(r.randint(1, 12)):
            turn = r.choice((t, t, t, t + 3, None))
            rows.append((c, turn, r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "U")), r.choice(said) if r.random() < 0.4 else f"text {r.random()}."))
    rows += rows[:40]  # repeated rows
    rows += [(None, t, r.choice(("user", "assistant")), r.choice(("one.", "two."))) for t in (None, 0, 1, 2, 2, 5)]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t // 4}.") for t in range(1500)]
    rows += [(1001, t, "user", "again and again") for t in range(800)]
    gone = next(i for i in range(2000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped"), (gone + 5000, None, None, None), (-3, -9_000_000_000, "user", "x" * 100_000 + ".")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*x, "n", "at") for x in awkward()], SCHEMA).repartition(7)


def test_report_matches_sql(table, spark):
    rows = pd.DataFrame(awkward(), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("rows", rows)
    con.sql("CREATE TABLE conversations AS SELECT conv_id::bigint AS conv_id, turn::bigint AS turn, role, text FROM rows")
    order = lambda x: (x[0] is not None, x)
    want = sorted(con.sql(queries_sql.CONVERSATIONS).fetchall(), key=order)
    got = sorted(map(tuple, C.report(C.damage(table)).collect()), key=order)
    assert len(got) == len({x[0] for x in awkward()})
    assert got == want


def test_damage_is_what_the_hash_says(table):
    want = []
    for c, t, role, text in awkward():
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda x: tuple((v is not None, v) for v in x)
    got = [tuple(r)[:4] for r in C.damage(table).where("times > 0").collect() for _ in range(r["times"])]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_repaired_messages_have_the_form_and_the_hash(table):
    rows = C.damage(table)
    found: dict = {}
    for r in C.repair(rows).collect():
        found.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for r in C.report(rows).collect():
        messages = sorted(found.get(r["conv_id"], []))
        initials = "".join(role[0] for _, role, _ in messages)
        body = initials[1:] if initials[:1] == "s" else initials
        assert body == "ua" * (len(body) // 2) and (body or not initials)
        assert [m[0] for m in messages] == list(range(len(messages)))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in messages).encode()).hexdigest() == r["repaired_sha256"]
        edits = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in r["audit"])
        assert r["cost"] - edits in range(0, 3 * r["truncated"] + 1, 3)


def test_a_conversation_in_many_pieces(spark, table):
    whole = sorted(C.report(C.damage(table)).collect(), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(C.report(C.damage(table)).collect(), key=str) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report(C.damage(none)).collect() == [] and C.repair(C.damage(none)).collect() == []
