"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation from a user turn on, with an assistant
turn at the end. For each turn, in order, dynamic programming over this automaton chooses to keep or relabel it
(cost ``RELABEL``), to merge it into the turn before (``MERGE``), or to insert empty turns before it (``INSERT`` each), so
that the sum is least; of equal sums the first in the order of actions, turn by turn, wins. Then every turn is rendered.

Turns are dealt by ranges of (conv_id, turn) into parts of about ``PART`` rows, so one conversation may take many parts and no task
holds more than its part. A part gives, for its first and last conversation, the least cost between any two states and the place of that
path among those from the same state; these few numbers are joined along each conversation, which fixes the states at the cuts, and each
part is then repaired on its own. The result does not depend on where the cuts fall.

Roles are compared without case and outer blanks, by the names in ``NAMES``; any other or null role has to be relabelled.
Null text is empty. Null conv_ids form one conversation; null turns come first. Turns that tie are ordered by role, text and then as stored;
equal rows are equal turns. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import materialize

RELABEL, MERGE, INSERT = 3, 1, 2
PART = 5_000
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Names of roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def inserted(start: int, end: int) -> tuple[int, ...] | None:
    """The shortest legal run of turns that leads from one state to another."""
    runs = {start: ()}
    queue = [start]
    while queue:
        s = queue.pop(0)
        for t in NEXT[s]:
            if t not in runs:
                runs[t] = (*runs[s], t)
                queue.append(t)
    return runs.get(end)


def moves() -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """(from, to, merged, inserted before) of every move over one turn, in the order that breaks ties."""
    out = []
    for s in range(4):
        out += [(s, t, False, ()) for t in NEXT[s]]
        out += [(s, s, True, ())] if s != START else []
        out += [(s, t, False, inserted(s, m)) for m in range(4) if m != s and inserted(s, m) for t in NEXT[m]]
    return sorted(out, key=lambda m: (len(m[3]), m[2], m[1], m[3]))


MOVES = moves()


def cost(move: tuple, role: int) -> int:
    _, to, merged, before = move
    return MERGE * merged + RELABEL * (to != role) + INSERT * len(before)


def solve(roles: list[int]) -> dict[tuple[int, int], tuple[int, bytes]]:
    """Least cost and first path (indexes of MOVES) between any two states over some turns."""
    best = {(s, s): (0, b"") for s in range(4)}
    for role in roles:
        step: dict[tuple[int, int], tuple[int, bytes]] = {}
        for (s, m), (c, path) in best.items():
            for i, move in enumerate(MOVES):
                if move[0] == m:
                    found = (c + cost(move, role), path + bytes([i]))
                    if found < step.get((s, move[1]), (1 << 60, b"")):
                        step[s, move[1]] = found
        best = step
    return best


def closing(state: int) -> tuple[int, ...]:
    """Turns to append at the end, so that it is an assistant's."""
    return () if state == ASSISTANT else inserted(state, ASSISTANT)


def placed(found: dict[tuple[int, int], tuple[int, bytes]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Cost, and place in order among the paths from the same state, of the paths between any two states."""
    order = {s: sorted((p, t) for (a, t), (_, p) in found.items() if a == s) for s in range(4)}
    return {(s, t): (found[s, t][0], i) for s, paths in order.items() for i, (_, t) in enumerate(paths)}


def join(fragments: list[dict[tuple[int, int], tuple[int, int]]]) -> list[tuple[int, int]]:
    """The states at which the best path over all fragments of a conversation enters and leaves each of them.

    Of equal costs the path first in order wins. Paths are kept as back pointers and their order as a number, so a step costs the same anywhere.
    """
    best, back = {START: (0, 0)}, []  # cost and order of the best path to each state
    for found in fragments:
        step: dict[int, tuple] = {}
        for (s, t), (c, place) in found.items():
            if s in best:
                new = (best[s][0] + c, (best[s][1], place), s)
                if t not in step or new < step[t]:
                    step[t] = new
        back.append({t: s for t, (_, _, s) in step.items()})
        orders = {x: i for i, x in enumerate(sorted({o for _, o, _ in step.values()}))}
        best = {t: (c, orders[o]) for t, (c, o, _) in step.items()}
    state = min((c + INSERT * len(closing(t)), order, t) for t, (c, order) in best.items())[2]
    out = []
    for pointers in reversed(back):
        out.append((pointers[state], state))
        state = pointers[state]
    return out[::-1]


def whole(roles: list[int]) -> tuple[list[int], tuple[int, ...]]:
    """Moves of a complete conversation and the turns appended to it."""
    found = solve(roles)
    _, path, end = min((c + INSERT * len(closing(t)), p, t) for (s, t), (c, p) in found.items() if s == START)
    return list(path), closing(end)


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n"


OUT = "conv_id {c}, turn {t}, role string, new_role string, merged boolean, cost int, inserted string, appended string, rendered string"


def repaired(turns: DataFrame) -> DataFrame:
    """Every turn with its new role, whether it is merged into the turn before, its cost, the empty turns inserted before it and
    appended after it (role names joined by commas), and its rendered text; the renderings of a conversation in order are the chat."""
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    # Ids without nulls beside flags: nullable numbers would become floats in pandas.
    keys = ["named", "conv_id", "numbered", "turn", "role", "text", "row"]
    whole_ids = [F.coalesce(F.col(c), F.lit("0").cast(kinds[c])).alias(c) for c in kinds]
    flags = F.col("conv_id").isNotNull().alias("named"), F.col("turn").isNotNull().alias("numbered")
    rows = turns.select(*flags, *whole_ids, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    n = max(1, -(-rows.count() // PART))
    dealt = materialize(rows.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), "turns")

    def conversations(pdf: pd.DataFrame):
        pdf = pdf.sort_values(keys, kind="stable").reset_index(drop=True)
        new = (pdf["conv_id"] != pdf["conv_id"].shift()) | (pdf["named"] != pdf["named"].shift())
        starts = [*new[new].index, len(pdf)]
        roles = [NAMES.get(r.strip().lower(), -1) for r in pdf["role"]]
        return pdf, [(a, b, roles[a:b]) for a, b in zip(starts, starts[1:], strict=False)]

    def ends(part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = conversations(pdf)
        edge = sorted({0, len(found) - 1})
        out = [(pdf["named"].iloc[found[i][0]], pdf["conv_id"].iloc[found[i][0]], part[0], [f"{s} {t} {c} {p}" for (s, t), (c, p) in placed(solve(found[i][2])).items()]) for i in edge]
        return pd.DataFrame(out, columns=["named", "conv_id", "part", "paths"]).astype({"conv_id": pdf["conv_id"].dtype})

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        if len(pdf) < 2:
            return pd.DataFrame({"named": pdf["named"], "conv_id": pdf["conv_id"], "part": pdf["part"], "enter": -1, "leave": -1, "last": True})
        split = [[x.split(" ") for x in paths] for paths in pdf["paths"]]
        states = join([{(int(x[0]), int(x[1])): (int(x[2]), int(x[3])) for x in paths} for paths in split])
        last = [False] * (len(pdf) - 1) + [True]
        return pd.DataFrame({"named": pdf["named"], "conv_id": pdf["conv_id"], "part": pdf["part"], "enter": [s for s, _ in states], "leave": [t for _, t in states], "last": last})

    cuts = dealt.groupBy("part").applyInPandas(ends, f"named boolean, conv_id {kinds['conv_id']}, part int, paths array<string>").groupBy("named", "conv_id").applyInPandas(across, f"named boolean, conv_id {kinds['conv_id']}, part int, enter int, leave int, last boolean")
    cuts = materialize(cuts, "cuts")

    def repair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf, found = conversations(left)
        fixed = {(r.named, r.conv_id): r for r in right.itertuples()}
        out = []
        for a, b, roles in found:
            cut = fixed.get((pdf["named"].iloc[a], pdf["conv_id"].iloc[a]))
            if cut is None or cut.enter < 0:
                path, appended = whole(roles)
            else:
                path, appended = list(solve(roles)[cut.enter, cut.leave][1]), closing(cut.leave) if cut.last else ()
            for i, m in enumerate(path):
                _, to, merged, before = MOVES[m]
                after = appended if i == len(path) - 1 else ()
                text = pdf["text"].iloc[a + i]
                shown = "".join(render(ROLES[r], "") for r in before) + (text + "\n" if merged else render(ROLES[to], text)) + "".join(render(ROLES[r], "") for r in after)
                names = [",".join(ROLES[r] for r in x) for x in (before, after)]
                out.append((pdf["named"].iloc[a + i], pdf["numbered"].iloc[a + i], pdf["conv_id"].iloc[a + i], pdf["turn"].iloc[a + i], pdf["role"].iloc[a + i], ROLES[to], merged, cost(MOVES[m], roles[i]) + INSERT * len(after), *names, shown))
        return pd.DataFrame(out, columns=["named", "numbered", "conv_id", "turn", "role", "new_role", "merged", "cost", "inserted", "appended", "rendered"])

    done = dealt.groupBy("part").cogroup(cuts.groupBy("part")).applyInPandas(repair, "named boolean, numbered boolean, " + OUT.format(c=kinds["conv_id"], t=kinds["turn"]))
    ids = F.when(F.col("named"), F.col("conv_id")).alias("conv_id"), F.when(F.col("numbered"), F.col("turn")).alias("turn")
    return done.select(*ids, *[c for c in done.columns if c not in ("named", "numbered", "conv_id", "turn")])
