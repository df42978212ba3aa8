"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of an automaton: perhaps one system turn, then user and assistant turns in
alternation, ending with the assistant. Dynamic programming over its states gives each turn a role so that
the sum of merges (into the message before, of the same role), relabels and empty insertions is least;
of equal sums the one with the lowest states wins. The repaired sequence is then rendered, each turn
its own piece: the pieces of a conversation in order are its whole text.

A conversation is cut into blocks of ``BLOCK`` turn numbers. A block's effect is a small matrix of costs
from state to state, made from roles alone. For conversations of several blocks these matrices, one row
a block, are chained to find the state at each border; then all blocks are solved and rendered by
themselves, so a conversation with a large part of all turns is spread over many tasks.

Defined cases: turns go by number, then role, then text; exact repeats of a turn are one turn; a null or
unknown role may take any role at ``UNKNOWN``; a null text is empty; turns without a number come first;
a turn without a conversation id is a conversation of its own; no turns, no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE, INSERT, RELABEL, UNKNOWN = 1.0, 2.0, 3.0, 1.0
BLOCK = 256
ROLES = ("", "system", "user", "assistant")
CODE = {r: i for i, r in enumerate(ROLES) if r}
#: States are the role of the last message, 0 before the first.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ACCEPT = 3
NEVER = float("inf")


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest roles to insert after one state so that another role may follow."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in NEXT:
        edge: list[tuple[int, tuple[int, ...]]] = [(s, ())]
        seen = {s}
        while edge:
            later = []
            for at, path in edge:
                for t in NEXT[at]:
                    out.setdefault((s, t), path)
                    if t not in seen:
                        seen.add(t)
                        later.append((t, (*path, t)))
            edge = later
    return out


INSERTED = _insertions()
CLOSING = {s: () if s == ACCEPT else (*INSERTED[s, ACCEPT], ACCEPT) for s in (1, 2, 3)}


def _options() -> list[list[list[tuple[float, str, tuple[int, ...]]]]]:
    """By role code (0: unknown), state and new role: cost, whether it merges, what is inserted."""
    table = []
    for role in range(4):
        rows = []
        for s in range(4):
            row = [(NEVER, "", ())]
            for t in (1, 2, 3):
                relabel = 0.0 if role == t else RELABEL if role else UNKNOWN
                choices = [(MERGE, "merge", ())] if s == t else []
                if (s, t) in INSERTED:
                    choices.append((INSERT * len(INSERTED[s, t]), "append", INSERTED[s, t]))
                cost, how, path = min(choices, key=lambda c: c[0], default=(NEVER, "", ()))
                row.append((cost + relabel, how, path))
            rows.append(row)
        table.append(rows)
    return table


OPTIONS = _options()


def code(role: str | None) -> int:
    return CODE.get((role or "").strip().lower(), 0)


def transfer(roles: Iterable[int]) -> list[float]:
    """Least costs from each state to each over a block of turns, row by row."""
    rows = [[0.0 if s == t else NEVER for t in range(4)] for s in range(4)]
    for r in roles:
        rows = [[min(row[s] + OPTIONS[r][s][t][0] for s in range(4)) for t in range(4)] for row in rows]
    return [x for row in rows for x in row]


def borders(matrices: list[list[float]]) -> list[int]:
    """The state before each block and after the last, along the cheapest way that ends legally."""
    cost, back = [0.0, NEVER, NEVER, NEVER], []
    for m in matrices:
        best = [min(range(4), key=lambda s, t=t: (cost[s] + m[4 * s + t], s)) for t in range(4)]
        cost = [cost[best[t]] + m[4 * best[t] + t] for t in range(4)]
        back.append(best)
    state = min((1, 2, 3), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), s))
    out = [state]
    for best in reversed(back):
        state = best[state]
        out.append(state)
    return out[::-1]


def repair(roles: list[int], start: int = 0, end: int | None = None) -> list[int]:
    """The state before the first turn and after each turn, of least cost between the ends."""
    cost, back = [NEVER] * 4, []
    cost[start] = 0.0
    for r in roles:
        best = [min(range(4), key=lambda s, t=t: (cost[s] + OPTIONS[r][s][t][0], s)) for t in range(4)]
        cost = [cost[best[t]] + OPTIONS[r][best[t]][t][0] for t in range(4)]
        back.append(best)
    if end is None:
        end = min((1, 2, 3), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), s))
    out = [end]
    for best in reversed(back):
        out.append(best[out[-1]])
    return out[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


SHUT = "<|im_end|>\n"


def pieces(turns: list[tuple[int, str]], start: int = 0, end: int | None = None, last: bool = True) -> list[tuple[str, str, int, float, str]]:
    """For (role code, text) turns: new role, action, messages inserted, cost, and the rendered piece."""
    states = repair([r for r, _ in turns], start, end)
    out = []
    for k, (role, text) in enumerate(turns):
        s, t = states[k], states[k + 1]
        cost, how, path = OPTIONS[role][s][t]
        if how == "merge":
            piece = "\n" + text
        else:
            piece = (SHUT if s else "") + "".join(_open(x) + SHUT for x in path) + _open(t) + text
        inserted = len(path) if how == "append" else 0
        action = ("merge" if how == "merge" else "insert" if inserted else "") + ("+" if role != t and (how == "merge" or inserted) else "") + ("relabel" if role != t else "") or "keep"
        if last and k == len(turns) - 1:
            piece += SHUT + "".join(_open(x) + SHUT for x in CLOSING[t])
            inserted += len(CLOSING[t])
            cost += INSERT * len(CLOSING[t])
        out.append((ROLES[t], action, inserted, cost, piece))
    return out


def format_chats(conversations: DataFrame, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conversations`` -> (conv, turn, role, new_role, action, inserted, cost, rendered), a row per distinct turn."""
    keys = ["conv", "own", "block"]
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("own", F.when(F.col("conv").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    blocks = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    several = rows.groupBy("conv", "own").agg(F.min("block").alias("a"), F.max("block").alias("z")).filter("a < z").select("conv", "own")
    ends = "start int, end int, last boolean"
    if several.isEmpty():
        solved = blocks.withColumn("start", F.lit(0)).withColumn("end", F.lit(None).cast("int")).withColumn("last", F.lit(True))
    else:
        # A repeat is told by its text, but a matrix needs the roles alone.
        parts = rows.join(several, ["conv", "own"], "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("turn", "role", F.xxhash64("text").alias("h")))).alias("turns"))

        def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [transfer(code(r) for r in roles) for roles in batch.column("roles").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(made, pa.list_(pa.float64()))], [*keys, "costs"])

        def chain(group: pa.Table) -> pa.Table:
            group = group.sort_by("block")
            at = borders(group.column("costs").to_pylist())
            n = group.num_rows
            return pa.table([*(group.column(k) for k in keys), pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32()), pa.array([k == n - 1 for k in range(n)])], [*keys, "start", "end", "last"])

        kind = f"conv {rows.schema['conv'].dataType.simpleString()}, own long, block long"
        costs = parts.select(*keys, F.col("turns.role").alias("roles")).mapInArrow(matrices, kind + ", costs array<double>")
        found = costs.groupBy("conv", "own").applyInArrow(chain, f"{kind}, {ends}")
        met = blocks["conv"].eqNullSafe(found["conv"]) & (blocks["own"] == found["own"]) & (blocks["block"] == found["block"])
        solved = blocks.join(found, met, "left").select(blocks["conv"], "turns", F.coalesce("start", F.lit(0)).alias("start"), "end", F.coalesce("last", F.lit(True)).alias("last"))

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 200):
                batch = big.slice(k, 200)
                out: list[tuple] = []
                for conv, turns, start, end, last in zip(*(batch.column(c).to_pylist() for c in ("conv", "turns", "start", "end", "last"))):
                    made = pieces([(code(t["role"]), t["text"] or "") for t in turns], start, end, last)
                    out += [(conv, t["turn"], t["role"], *m) for t, m in zip(turns, made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["conv", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]
    kind = rows.schema["conv"].dataType.simpleString()
    types = [pa.int64() if kind in ("bigint", "int") else pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
    kind = "long" if kind in ("bigint", "int") else "string"
    solved = solved.select(F.col("conv").cast(kind).alias("conv"), "turns", "start", "end", "last")
    done = solved.mapInArrow(render, f"conv {kind}, turn long, role string, new_role string, action string, inserted long, cost double, rendered string")
    return done.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)
