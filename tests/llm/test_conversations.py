"""Structure repair against a search over all edits, on conversations with ties, faults and very many rows."""

import hashlib
import heapq
import random

from pyspark.sql import functions as F

from riskloom.llm import conversations
from riskloom.llm.conversations import TURNS, Chain, code_of, only

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
WHITE = " \t\n\x0b\x0c\r"


def judged(rows):
    """(role, text, turn, fault) in order."""
    def order(r):
        return (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())

    given = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, out = set(), []
    for turn, role, text in sorted(given, key=order):
        last = text.rstrip(WHITE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, turn, fault))
    return out


def cheapest(rows):
    """Least cost, then least audit: a shortest path over (turns read, last initial) with the audit as second key."""
    queue, done = [(0, "", 0, "", [])], set()
    while queue:
        cost, audit, at, last, lines = heapq.heappop(queue)
        if (at, last) in done:
            continue
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        done.add((at, last))
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        speaker = {"u": "user", "a": "assistant"}[follow]
        heapq.heappush(queue, (cost + 3, audit + "I", at, follow, lines + [f"{speaker}:"]))
        if at < len(rows):
            role, text, _, fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                slip = 3 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + 3 + slip, audit + "R", at + 1, follow, lines + [f"{speaker}:{text}"]))
                if role[:1] == follow or (role[:1] == "s" and last == ""):
                    heapq.heappush(queue, (cost + slip, audit + "K", at + 1, role[:1], lines + [f"{role}:{text}"]))
    raise AssertionError


def plain(rows):
    rows = judged(rows)
    cost, audit, lines = cheapest(rows)
    turns = [r[2] for r in rows if r[2] is not None]
    count = [r[3] for r in rows].count
    initials = [r[0][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def drawn(rng, n):
    roles = rng.choice([["user", "assistant"], ["system", "user", "assistant", "unknown"], ["user"], ["s", "u", "a", "", None, "Über"]])
    texts = rng.choice([["a.", "b!", "c?", "d"], ["", " \t", "x", "y."], [f"{i}." for i in range(50)]])
    return [(rng.choice([None, rng.randrange(n + 2), i]), rng.choice(roles), rng.choice(texts + [None])) for i in range(n)]


def test_crossings_equal_a_search_over_all_edits():
    rng = random.Random(5)
    faults = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    chain = Chain(TURNS, remember=True)
    for _ in range(400):
        rows = judged(drawn(rng, rng.randrange(1, 12)))
        codes = [code_of(conversations._initial(r[0]), faults[r[3]]) for r in rows]
        ends = chain.forward(only(0), codes)
        cost, _, end = min((v[0] + 3 * len(conversations.TAILS[s]), v[1], s) for s, v in enumerate(ends) if v)
        states = chain.crossings(codes, 0, end)
        audit = "".join(TURNS[c][a][b][1] for c, a, b in zip(codes, states, states[1:])) + conversations.TAILS[end]
        assert (cost, audit) == cheapest(rows)[:2]


def test_equals_plain_repair(spark):
    rng = random.Random(6)
    given = {c: drawn(rng, rng.randrange(1, 14)) for c in range(60)}
    given[None] = drawn(rng, 5)
    given[100] = [(t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}!"])) for t in range(700)]
    given[101] = [(3, "user", "same.")] * 300  # copies of one row
    given[102] = [(i, "user", "") for i in range(40)]  # nothing stays
    given[103] = [(0, "user", "word " * 60_000 + "."), (1, "assistant", "x" * 200_000)]
    rows = [(c, *r, "x", 1) for c, rs in given.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    wanted = {c: plain(rs) for c, rs in given.items()}
    assert found(conversations.repair_report(df)) == wanted
    # Short runs: most conversations are put together of several.
    assert found(conversations.repair_report(df, run_rows=20)) == wanted


def test_repaired_turns_are_well_formed(spark):
    rng = random.Random(7)
    rows = [(c, *r, "x", 1) for c in range(40) for r in drawn(rng, 8)]
    _, turns = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "role", "edit", "text"))).alias("t"))
    for r in said.collect():
        initials = "".join(t["role"][0] for t in r["t"])
        body = initials.removeprefix("s")
        assert body and body == "ua" * (len(body) // 2)
        assert all(t["text"] == "" for t in r["t"] if t["edit"] == "I")


def test_damage_and_rows_that_are_all_dropped(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c}, {t}. More! Why?", None, None) for c in range(200) for t in range(3)]
    rows += [(None, None, None, None, None, None), (1, None, "user", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    hurt = conversations.damaged(df)
    assert 0.9 < hurt.count() / len(rows) < 1.1
    single = df.where("turn = 0")
    report = conversations.repair_report(conversations.damaged(single), all_of=single)
    got = found(report)
    assert set(got) == set(range(200))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    dropped = set(range(200)) - {r[0] for r in conversations.damaged(single).select("conv_id").collect()}
    assert dropped and all(got[c] == nothing for c in dropped)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_report(conversations.damaged(df), all_of=df).isEmpty()
