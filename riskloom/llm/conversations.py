"""Conversation structure repair: cheapest edits to well-formed turns, by Hirschberg's divide and conquer over four states.

A well-formed conversation is empty or an optional system turn and then pairs of user and assistant turns. While it is
read, it is in one of four states: nothing said, system, user or assistant spoke last. What a run of turns does to
the states is a matrix of least costs, and matrices of neighbouring runs combine, so a conversation is cut into runs
that tasks summarise apart. Forward costs from its start and backward costs from its end meet in the middle; the state they
cross in splits the problem in two, until each run, and in it each turn, knows the states around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskloom.llm._common import staged

SPACES = " \t\n\x0b\x0c\r"
# Rows of a run: a task holds one run of turn keys (no texts) at a time.
RUN_ROWS = 50_000

OK, TRUNCATED, BLANK, DUPLICATE = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = "sua"
OTHER = 3
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
DELETE_COST, CHANGE_COST, TRUNCATED_COST = 4, 3, 3
# The turn that may follow each state, as the state it leads to; a system turn only comes first.
FOLLOWS = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SPOKEN = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
# Turns that complete a conversation which ends in a state.
TAILS = {NOTHING: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}

# From one state to another: least cost, and what orders equally cheap audits (letters, or the rank of their text).
Step = tuple[int, object]
Matrix = tuple[tuple[Step | None, ...], ...]
# Least cost to reach a state, and the rank of the least audit that does so among those of the other states.
Vector = tuple[tuple[int, int] | None, ...]


def _turn_matrix(initial: int, fault: int) -> Matrix:
    """Every way over one turn: turns inserted before it, then the turn kept, given another role, or deleted."""
    ways: list[list[Step | None]] = [[None] * 4 for _ in STATES]

    def offer(source: int, target: int, cost: int, letters: str) -> None:
        if ways[source][target] is None or (cost, letters) < ways[source][target]:
            ways[source][target] = (cost, letters)

    for source in STATES:
        state, spent, letters = source, 0, ""
        for _ in range(3):
            offer(source, state, spent + DELETE_COST, letters + DELETE)
            if fault in (OK, TRUNCATED):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                following = FOLLOWS[state]
                own = SYSTEM if initial == 0 and state == NOTHING else following if initial == following - 1 else None
                if own is not None:
                    offer(source, own, spent + extra, letters + KEEP)
                offer(source, following, spent + CHANGE_COST + extra, letters + REROLE)
            state, spent, letters = FOLLOWS[state], spent + CHANGE_COST, letters + INSERT
    return tuple(map(tuple, ways))


TURNS = [_turn_matrix(initial, fault) for initial in range(4) for fault in range(4)]


def code_of(initial: int, fault: int) -> int:
    return initial * 4 + fault


def advance(vector: Vector, matrix: Matrix) -> Vector:
    """The forward vector after a step. No audit is the beginning of another of as many turns, so ranks decide ties."""
    best: list[tuple | None] = [None] * 4
    for source, reached in enumerate(vector):
        if reached is not None:
            for target, step in enumerate(matrix[source]):
                if step is not None:
                    way = (reached[0] + step[0], reached[1], step[1])
                    if best[target] is None or way < best[target]:
                        best[target] = way
    order = sorted((b[1:], t) for t, b in enumerate(best) if b is not None)
    rank = {t: i for i, (_, t) in enumerate(order)}
    return tuple(None if b is None else (b[0], rank[t]) for t, b in enumerate(best))


def retreat(costs: tuple, matrix: Matrix) -> tuple:
    """The backward costs before a step."""
    return tuple(
        min((step[0] + costs[t] for t, step in enumerate(row) if step is not None and costs[t] is not None), default=None)
        for row in matrix
    )


class Chain:
    """Steps by number in a table of matrices. Vectors differ by little but a common cost, so moves are remembered."""

    def __init__(self, table: Sequence[Matrix], remember: bool):
        self.table = table
        self.ahead: dict | None = {} if remember else None
        self.back: dict | None = {} if remember else None

    def forward(self, vector: Vector, steps: Iterable[int]) -> Vector:
        if self.ahead is None:
            return reduce(lambda v, s: advance(v, self.table[s]), steps, vector)
        base, vector = _lowered(vector)
        for step in steps:
            known = self.ahead.get((vector, step))
            if known is None:
                known = self.ahead[vector, step] = _lowered(advance(vector, self.table[step]))
            base += known[0]
            vector = known[1]
        return tuple(None if v is None else (v[0] + base, v[1]) for v in vector)

    def backward(self, costs: tuple, steps: Sequence[int]) -> tuple:
        """Up to a common cost."""
        for step in reversed(steps):
            known = self.back.get((costs, step)) if self.back is not None else None
            if known is None:
                known = retreat(costs, self.table[step])
                least = min(c for c in known if c is not None)
                known = tuple(None if c is None else c - least for c in known)
                if self.back is not None:
                    self.back[costs, step] = known
            costs = known
        return costs

    def crossings(self, steps: Sequence[int], start: int, end: int) -> list[int]:
        """The state at every border between steps on the cheapest way with the least audit, in linear space."""
        states = [start] * len(steps) + [end]
        open_parts = [(0, len(steps))]
        while open_parts:
            low, high = open_parts.pop()
            if high - low < 2:
                continue
            middle = (low + high) // 2
            ahead = self.forward(only(states[low]), steps[low:middle])
            back = self.backward(tuple(0 if s == states[high] else None for s in STATES), steps[middle:high])
            states[middle] = min(
                (ahead[s][0] + back[s], ahead[s][1], s) for s in STATES if ahead[s] is not None and back[s] is not None
            )[2]
            open_parts += [(low, middle), (middle, high)]
        return states


def only(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in STATES)


def _lowered(vector: Vector) -> tuple[int, Vector]:
    least = min(v[0] for v in vector if v is not None)
    return least, tuple(None if v is None else (v[0] - least, v[1]) for v in vector)


_turns = Chain(TURNS, remember=True)


def _spread(copies: int) -> str:
    """Equal rows at one place: all but the first are deleted."""
    return DELETE * (copies - 1)


# Schemas: a run of turns, its facts, and the states around each run of a conversation.
_ROWS = "rows array<struct<turn:long,role:string,sha:binary,fault:int,copies:long>>"
_FACTS = (
    "extra long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_initial int, last_initial int, costs array<long>, ranks array<int>"
)
_BORDERS = "runs array<struct<part:int,enter:int,leave:int,tail:string>>"
_TURNS = "turns array<struct<at:int,edit:string,role:string,turn:long,said_by:string,sha:binary>>"


def _initial(role: str) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return OTHER if at < 0 else at


def _facts(rows: list[dict]) -> tuple:
    """What a run does to its conversation: counts, borders and the matrix of least costs."""
    codes = [code_of(_initial(r["role"]), r["fault"]) for r in rows]
    repeats = sum(r["copies"] - 1 for r in rows)
    blank = sum(r["copies"] for r in rows if r["fault"] == BLANK)
    duplicate = sum(r["copies"] - (r["fault"] != DUPLICATE) for r in rows if r["fault"] != BLANK)
    initials = [c // 4 for c in codes]
    illegal = repeats + sum((a, b) not in LEGAL for a, b in zip(initials, initials[1:]))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    ways = [_turns.forward(only(s), codes) for s in STATES]
    flat = [None if w is None else w for way in ways for w in way]
    return (
        repeats * DELETE_COST, blank, duplicate, sum(r["fault"] == TRUNCATED for r in rows), illegal,
        sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns), turns[0] if turns else None, turns[-1] if turns else None,
        initials[0], initials[-1], [None if w is None else w[0] for w in flat], [None if w is None else w[1] for w in flat],
    )


def _runs(schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a partition, sorted by conversation and turn, as one row per conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mine: list[dict] = []
        done: list[tuple] = []
        held = 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)

        for batch in batches:
            for row in batch.to_pylist():
                conv = row.pop("conv")
                if mine and conv != current:
                    done.append((current, part, mine, *_facts(mine)))
                    held += len(mine)
                    mine = []
                    if held > 10_000:
                        yield written()
                        done, held = [], 0
                current = conv
                mine.append(row)
        if mine:
            done.append((current, part, mine, *_facts(mine)))
        if done:
            yield written()

    return run


def _whole(runs: list[dict]) -> dict:
    """Counts and borders of a conversation from its runs in order."""
    table = []
    for r in runs:
        cells = [None if c is None else (c, k) for c, k in zip(r["costs"], r["ranks"])]
        table.append(tuple(tuple(cells[4 * s : 4 * s + 4]) for s in STATES))
    chain = Chain(table, remember=False)
    steps = list(range(len(table)))
    last = chain.forward(only(NOTHING), steps)
    cost, _, end = min((v[0] + CHANGE_COST * len(TAILS[s]), v[1], s) for s, v in enumerate(last) if v is not None)
    states = chain.crossings(steps, NOTHING, end)
    illegal = sum((a["last_initial"], b["first_initial"]) not in LEGAL for a, b in zip(runs, runs[1:]))
    said = [r for r in runs if r["turns"]]
    turns = sum(r["turns"] for r in said) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(said, said[1:]))
    gaps = said[-1]["last_turn"] - said[0]["first_turn"] + 1 - turns if said else 0
    total = {name: sum(r[name] for r in runs) for name in ("extra", "blank", "duplicate", "truncated", "illegal")}
    return {
        "gaps": min(gaps, 2**63 - 1), "blank": total["blank"], "duplicate": total["duplicate"], "truncated": total["truncated"],
        "illegal": total["illegal"] + illegal, "cost": cost + total["extra"],
        "runs": [{"part": r["part"], "enter": a, "leave": b, "tail": ""} for r, a, b in zip(runs[:-1], states, states[1:])]
        + [{"part": runs[-1]["part"], "enter": states[-2], "leave": end, "tail": TAILS[end]}],
    }


def _conversations(schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"conv": r["conv"], **_whole(r["runs"])} for r in batch.to_pylist()], schema)

    return run


def _edits(rows: list[dict], start: int, end: int, tail: str) -> tuple[str, list[dict]]:
    """Audit of a run between two states, and the turns that stay, change their role or are inserted."""
    codes = [code_of(_initial(r["role"]), r["fault"]) for r in rows]
    states = _turns.crossings(codes, start, end)
    letters: list[str] = []
    turns: list[dict] = []
    state = start

    def speak(edit: str, row: dict | None) -> None:
        nonlocal state
        if edit == KEEP:
            state = SYSTEM if row["role"].startswith("s") else FOLLOWS[state]
            role = row["role"]
        else:
            state = FOLLOWS[state]
            role = SPOKEN[state]
        given = {"turn": row["turn"], "said_by": row["role"], "sha": row["sha"]} if row else {"turn": None, "said_by": None, "sha": None}
        turns.append({"at": len(turns), "edit": edit, "role": role, **given})

    for row, code, a, b in zip(rows, codes, states, states[1:]):
        step = TURNS[code][a][b][1]
        for letter in step:
            if letter != DELETE:
                speak(letter, None if letter == INSERT else row)
        letters.append(step + _spread(row["copies"]))
    for letter in tail:
        speak(letter, None)
    return "".join(letters) + tail, turns


def _walks(schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    audit, turns = _edits(r["rows"], r["enter"], r["leave"], r["tail"])
                    out.append({"conv": r["conv"], "part": r["part"], "audit": audit, "turns": turns})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join in which null keys are equal; the right side's key columns go."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys]
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", run_rows: int = RUN_ROWS
) -> tuple[DataFrame, DataFrame]:
    """A report per conversation, and the repaired turns.

    Report: gaps, blank, duplicate, truncated, illegal, cost (longs) and audit, the letters K, R, D, I of the cheapest
    edits in order, least in ASCII order among equally cheap ones. Turns: part and at (their order in the conversation), edit,
    role and text.

    Only keys, hashes and flags of the rows are sorted, over ranges of conversation and turn, so a conversation with
    a third of all rows is spread over tasks in runs of about ``run_rows`` rows. A task sees the 4 x 4 matrices of a
    conversation's runs, of which there are no more than partitions. Texts are shuffled to the turns that stay.

    Odd rows: nulls in role or text count as one space, and turns come in the order of turn (nulls first), role and SHA-256 of the
    text. Rows equal in all four are counted first, so repeats of one row are one row of a run. Rows without a conversation
    are a conversation of their own. Gaps ignore null turns. Empty tables give no rows; other columns are ignored.
    """
    kind = rows.schema[conv].dataType.simpleString()
    said = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    light = said.select("conv", "turn", "role", "sha", fault.alias("fault"))
    light = staged(light.groupBy("conv", "turn", "role", "sha").agg(F.min("fault").alias("fault"), F.count("*").alias("copies")), "turns")

    # The earliest turn of each text of a role. Both sides of the join have each key once, so no key is hot.
    unknown, least = F.max(F.col("turn").isNull()), F.min("turn")
    earliest = light.groupBy("conv", "role", "sha").agg(F.when(~unknown, least).alias("turn"), F.lit(True).alias("first"))
    marked = _with(light, earliest, ["conv", "turn", "role", "sha"], "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-light.count() // run_rows))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    ranged = marked.withColumn("fault", fault).drop("first").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"conv {kind}, part int, {_ROWS}, {_FACTS}"
    columns = ["conv", "turn", "role", "sha", "fault", "copies"]
    runs = staged(ranged.select(*columns).mapInArrow(_runs(_arrow(schema)), schema), "runs")

    facts = ["part", *[f.split()[0] for f in _FACTS.split(", ")]]
    gathered = runs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*facts))).alias("runs"))
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, {_BORDERS}"
    whole = staged(gathered.mapInArrow(_conversations(_arrow(schema)), schema), "conversations")

    border = whole.select("conv", F.explode("runs").alias("run")).select("conv", "run.*")
    walked = _with(runs.select("conv", "part", "rows"), border, ["conv", "part"], "inner")
    schema = f"conv {kind}, part int, audit string, {_TURNS}"
    edits = staged(walked.mapInArrow(_walks(_arrow(schema)), schema), "edits")

    pieces = F.sort_array(F.collect_list(F.struct("part", "audit")))
    audits = edits.groupBy("conv").agg(F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    report = _with(whole.drop("runs"), audits, ["conv"], "inner").withColumnRenamed("conv", conv)

    kept = edits.select("conv", "part", F.explode("turns").alias("t")).select("conv", "part", "t.*")
    texts = said.withColumnRenamed("role", "said_by").groupBy("conv", "turn", "said_by", "sha").agg(F.first("text").alias("text"))
    stay = _with(kept.where("edit <> 'I'"), texts, ["conv", "turn", "said_by", "sha"], "inner")
    added = kept.where("edit = 'I'").withColumn("text", F.lit(""))
    out = ["conv", "part", "at", "edit", "role", "text"]
    return report, stay.select(*out).unionByName(added.select(*out)).withColumnRenamed("conv", conv)


def damaged(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Faults by CRC-32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3
    repeats it, 4 sets the role to user. Nulls count as one space."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    draw = F.crc32(F.concat(given[0], F.lit(":"), given[1]).cast("binary")) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    by = F.coalesce(F.col(role), F.lit(" "))
    hurt = rows.select(
        F.col(conv).alias(conv),
        F.col(turn).alias(turn),
        F.when(draw == 4, "user").otherwise(by).alias(role),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("_times"),
    )
    return hurt.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_time", "_times")


def _digests(conv: str, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """SHA-256 of each conversation's lines, which come in order; no conversation is held as a whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = None
        done: list[tuple] = []
        for batch in batches:
            for at, role, text in zip(*(batch.column(c).to_pylist() for c in (conv, "role", "text"))):
                if digest is not None and at == current:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = at, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)
                done = []
        if digest is not None:
            done.append((current, digest.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)

    return run


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, repaired_sha256: of ``role:text`` lines joined by line breaks.

    A digest has to read its conversation in order, so its lines stream through one task, which sorts them on disk.
    """
    schema = f"{conv} {turns.schema[conv].dataType.simpleString()}, repaired_sha256 string"
    ordered = turns.repartition(conv).sortWithinPartitions(conv, "part", "at")
    return ordered.select(conv, "role", "text").mapInArrow(_digests(conv, _arrow(schema)), schema)


def repair_report(rows: DataFrame, conv: str = "conv_id", all_of: DataFrame | None = None, **options) -> DataFrame:
    """The report with the digest of the repaired conversation; ``all_of`` names conversations that may have no row left.

    Those have zeros, an empty audit and the digest of an empty text.
    """
    report, turns = repair(rows, conv, **options)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    tables = [report, digests(turns, conv), *([all_of.select(conv)] if all_of is not None else [])]
    columns: Callable[[DataFrame], list[Column]] = lambda df: [
        F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
        for c, t in [(conv, df.schema[conv].dataType), *[(c, "long") for c in longs], ("audit", "string"), ("repaired_sha256", "string")]
    ]
    joined = reduce(DataFrame.unionByName, [df.select(*columns(df)) for df in tables]).groupBy(conv)
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )
