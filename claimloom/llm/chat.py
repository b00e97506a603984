"""Chat formatting: role sequences are repaired at the least cost, then rendered.

A legal conversation has an optional system turn, then user and assistant turns in alternation, and ends with an
assistant turn. Every turn is either given out (under its role or, at a cost, another), after empty turns that make
it legal, or merged into the turn before it. Dynamic programming over the automaton's states finds the cheapest repair; among
equals, giving out comes before merging and earlier states before later ones.

Conversations of any length are repaired in pieces: rows are range-partitioned by conversation and turn, each piece of
a conversation that crosses partitions becomes a matrix of least costs between states, the matrices are chained, and every
piece is traced back between the states the chain gives it. The output has one row for each source turn; the rendered
pieces of a conversation, in the order of ``place``, are its text.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import written

ROLES = ["system", "user", "assistant"]
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
RELABEL, INSERT, MERGE = 3, 2, 1
#: What may follow a state: 0 nothing given out yet, 1 system, 2 user, 3 assistant.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
FAR = 10**12


def _path(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which the role may follow the state."""
    seen, todo = {state}, [(state, ())]
    for s, path in todo:
        if role in LEGAL[s]:
            return path
        for t in LEGAL[s]:
            if t not in seen:
                seen.add(t)
                todo.append((t, (*path, t)))
    return None


PATHS = {(s, r): _path(s, r) for s in range(4) for r in (1, 2, 3)}
#: Empty turns after the last one, by state.
ENDING = {s: () if s == LAST else (*PATHS[s, LAST], LAST) for s in range(4)}


def _steps(code: int) -> list[tuple[int, int, int, bool]]:
    """cost, state before, state after, merged: what may be done with a turn of this role (0 for unknown ones)."""
    out = []
    for role in (1, 2, 3):
        cost = 0 if code == role else RELABEL
        for s in range(4):
            if PATHS[s, role] is not None:
                out.append((cost + INSERT * len(PATHS[s, role]), s, role, False))
        out.append((cost + MERGE, role, role, True))
    return out


STEPS = {code: _steps(code) for code in range(4)}


def costs(codes: list[int], start: list[int]) -> tuple[list[int], list[list[tuple[int, bool] | None]]]:
    """Least costs of the states after all turns, and for each turn and state how it was reached."""
    now, back = list(start), []
    for code in codes:
        new, came = [FAR] * 4, [None] * 4
        for cost, s, t, merged in STEPS[code]:
            if now[s] + cost < new[t]:
                new[t], came[t] = now[s] + cost, (s, merged)
        now = new
        back.append(came)
    return now, back


def between(codes: list[int]) -> list[int]:
    """Least costs from every state to every state, row by row."""
    return [c for s in range(4) for c in costs(codes, [0 if t == s else FAR for t in range(4)])[0]]


def chained(parts: list[list[int]]) -> tuple[list[tuple[int, int]], int]:
    """States before and after each piece of the cheapest repair of a whole conversation, and its cost."""
    now, back = [0, FAR, FAR, FAR], []
    for m in parts:
        options = [min((now[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
        now, came = [min(c, FAR) for c, _ in options], [s for _, s in options]
        back.append(came)
    best, state = min((now[s] + INSERT * len(ENDING[s]), s) for s in range(4))
    out = []
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1], best


def traced(codes: list[int], first: int, last: int) -> list[tuple[int, int, bool]]:
    """State before, state after, merged: of each turn on the cheapest way between two states."""
    _, back = costs(codes, [0 if s == first else FAR for s in range(4)])
    out, state = [], last
    for came in reversed(back):
        s, merged = came[state]
        out.append((s, state, merged))
        state = s
    return out[::-1]


def _opened(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSED = "<|end|>\n"


def _rendered(step: tuple[int, int, bool], text: str, ends: bool) -> tuple[str, str, str]:
    """What is done with a turn, the empty turns put before it and after the last one, and its rendered piece."""
    before, after, merged = step
    text = text.replace("<|", "< |")
    inserted = () if merged else PATHS[before, after]
    piece = "\n" if merged else CLOSED * (before > 0) + "".join(_opened(r) + CLOSED for r in inserted) + _opened(after)
    closing = ENDING[after] if ends else ()
    piece += text + (CLOSED + "".join(_opened(r) + CLOSED for r in closing) if ends else "")
    return "merge" if merged else "give", ",".join(ROLES[r - 1] for r in (*inserted, *closing)), piece


def role_code(role: Column) -> Column:
    """1 to 3, or 0 for null and unknown roles; case and outer spaces don't matter, aliases are known."""
    name = F.lower(F.trim(role))
    known = {r: i + 1 for i, r in enumerate(ROLES)} | {a: ROLES.index(r) + 1 for a, r in ALIASES.items()}
    out = F.lit(0)
    for r, i in known.items():
        out = F.when(name == r, i).otherwise(out)
    return out


def _segments(part: pd.DataFrame) -> list[tuple[int, int]]:
    """Ranges of rows of one conversation each; a null id is one conversation."""
    names = [None if pd.isna(c) else c for c in part["conv_id"]]
    out, at = [], 0
    for _, rows in groupby(names):
        n = sum(1 for _ in rows)
        out.append((at, at + n))
        at += n
    return out


def repaired(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, place, turn, role, new_role, action (give, merge), inserted (roles of empty turns), rendered: a row for each source turn.

    Turns are in the order of turn, then role and text, nulls first; repeated rows each are turns. Null and unknown roles
    get the cheapest legal one. A null text is an empty one; turns that are empty stay turns. Rows without a
    conversation id are one conversation. Control marks in a text are taken apart (``<|`` becomes ``< |``). An empty table gives no rows.
    """
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "role", "text", "tie"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower
    table = written(placed.withColumn("place", mark).withColumn("part", F.shiftright("place", 33)).withColumn("code", role_code(F.col("role"))).drop("tie"), "turns")

    def cross(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        spans = _segments(part)
        ends = [spans[0], *spans[-1:]] if len(spans) > 1 else spans
        codes = part["code"].tolist()
        found = [(part["conv_id"].iat[a], part["part"].iat[a], between(codes[a:b])) for a, b in ends]
        return pd.DataFrame(found, columns=["conv_id", "part", "costs"]).astype({"conv_id": "Int64"})

    def chain(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("part")
        states, _ = chained([list(m) for m in pieces["costs"]])
        n = len(pieces)
        return pd.DataFrame({
            "conv_id": pieces["conv_id"].astype("Int64"), "part": pieces["part"], "first": [a for a, _ in states], "last": [b for _, b in states], "ends": [i + 1 == n for i in range(n)],
        })

    edges = table.select("conv_id", "part", "place", "code").groupBy("part").applyInPandas(cross, "conv_id bigint, part bigint, costs array<bigint>")
    states = edges.groupBy("conv_id").applyInPandas(chain, "conv_id bigint, part bigint, first int, last int, ends boolean")

    def render(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        codes, texts, out = part["code"].tolist(), part["text"].tolist(), []
        given = {None if pd.isna(c) else c: (a, b, e) for c, a, b, e in zip(known["conv_id"], known["first"], known["last"], known["ends"], strict=True)}
        for a, b in _segments(part):
            name = part["conv_id"].iat[a]
            first, last, ends = given.get(None if pd.isna(name) else name) or (*chained([between(codes[a:b])])[0][0], True)
            for i, step in zip(range(a, b), traced(codes[a:b], first, last), strict=True):
                out.append((ROLES[step[1] - 1], *_rendered(step, texts[i] if isinstance(texts[i], str) else "", bool(ends) and i + 1 == b)))
        new = pd.DataFrame(out, columns=["new_role", "action", "inserted", "rendered"], index=part.index)
        return pd.concat([part[["conv_id", "place", "turn", "role"]].astype({"conv_id": "Int64", "turn": "Int64"}), new], axis=1)

    schema = "conv_id bigint, place bigint, turn bigint, role string, new_role string, action string, inserted string, rendered string"
    return table.groupBy("part").cogroup(states.groupBy("part")).applyInPandas(render, schema)
