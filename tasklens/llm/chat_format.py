"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the last one by the assistant. Dynamic programming over this
automaton chooses for every turn whether it keeps its role, is merged into the
turn before, is relabelled, or has empty turns put in before it, so that the
sum of the costs is smallest. The repaired sequence is rendered in segments,
one for each input turn or inserted turn; a conversation is the concatenation
of its segments in order.

The turns are sorted into ranges. A turn is a (min, +) matrix over the four
states, so a conversation that reaches over several ranges is a product of one
matrix per range: the states at the borders are chosen from these products, and
every range is then repaired by itself. A conversation with a third of all rows
is therefore no large task, and what reaches the driver is bounded by the
number of ranges.

Edge cases: turns are in the order of ``turn`` (nulls last), equal ones in the
order in which they are read; roles are compared without case and outer space,
a null or unknown role is always relabelled; null texts render as empty;
repeated rows are turns of their own; a null conv_id is a conversation; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
NEXT = {START: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}
FINAL = ASSISTANT
MERGE, INSERT, RELABEL = 1, 2, 3
NEVER = 1 << 40
END_MARK = "<|end|>\n"


def paths() -> dict[tuple[int, int], list[int]]:
    """For two states the fewest roles put in between them."""
    out: dict[tuple[int, int], list[int]] = {}
    for s in range(4):
        front = [(o, []) for o in NEXT[s]]
        while front:
            o, via = front.pop(0)
            if (s, o) not in out:
                out[s, o] = via
                front += [(n, [*via, o]) for n in NEXT[o]]
    return out


PATHS = paths()


def step_table():
    """cost[role][state][new role] and how: 'next' (with inserted turns) or
    'merge'; a legal step is taken before an equally dear merge."""
    cost = [[[NEVER] * 4 for _ in range(4)] for _ in range(4)]
    merge = [[False] * 4 for _ in range(4)]
    for s in range(4):
        for o in (SYSTEM, USER, ASSISTANT):
            step = len(PATHS[s, o]) * INSERT if (s, o) in PATHS else NEVER
            merge[s][o] = s == o and step > MERGE
            least = min(step, MERGE) if s == o else step
            for r in range(4):      # role 0: unknown
                cost[r][s][o] = min(least + (RELABEL if r != o else 0), NEVER)
    end = [0 if s == FINAL else INSERT * (len(PATHS[s, FINAL]) + 1) for s in range(4)]
    end[START] = 0
    return cost, merge, end


COST, MERGED, END_COST = step_table()


def forward(vector: list[int], roles: list[int]) -> list[list[int]]:
    """Least costs of every state after each turn."""
    out = []
    for r in roles:
        c = COST[r]
        vector = [min(NEVER, *(vector[s] + c[s][o] for s in range(4))) for o in range(4)]
        out.append(vector)
    return out


def product(roles: list[int]) -> list[list[int]]:
    """(min, +) matrix of some turns, by entry state."""
    return [forward([0 if t == s else NEVER for t in range(4)], roles)[-1] for s in range(4)]


def best(values: list[int]) -> int:
    return min(range(4), key=lambda s: (values[s], s))


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> list[int]:
    """New roles of the turns, from the state ``entry`` to ``leave`` (None: the
    cheapest legal end)."""
    costs = [[0 if s == entry else NEVER for s in range(4)], *forward(
        [0 if s == entry else NEVER for s in range(4)], roles)]
    o = best([c + e for c, e in zip(costs[-1], END_COST, strict=True)]) if leave is None else leave
    out = []
    for i in range(len(roles) - 1, -1, -1):
        out.append(o)
        o = best([costs[i][s] + COST[roles[i]][s][o] for s in range(4)])
    return out[::-1]


def borders(products: list[list[list[int]]]) -> list[tuple[int, int]]:
    """Entry and exit states of consecutive ranges of one conversation."""
    costs = [[0, NEVER, NEVER, NEVER]]
    for m in products:
        costs.append([min(NEVER, *(costs[-1][s] + m[s][o] for s in range(4))) for o in range(4)])
    o, out = best([c + e for c, e in zip(costs[-1], END_COST, strict=True)]), []
    for i in range(len(products) - 1, -1, -1):
        s = best([costs[i][t] + products[i][t][o] for t in range(4)])
        out.append((s, o))
        o = s
    return out[::-1]


def segments(turns: list[tuple], roles: list[int], new: list[int], entry: int, close: bool):
    """Rows (place, turn, sub, action, role, segment) of repaired turns."""
    state, out = entry, []

    def opened(role):
        return ("" if state == START else END_MARK) + f"<|{ROLES[role]}|>\n"

    for (place, turn, text), r, o in zip(turns, roles, new, strict=True):
        sub = 0
        label = "relabel" if r != o else ""
        if MERGED[state][o]:
            out.append((place, turn, sub, f"{label}+merge".strip("+"), ROLES[o], "\n" + text))
        else:
            for p in PATHS[state, o]:
                out.append((place, turn, sub, "insert", ROLES[p], opened(p)))
                state, sub = p, sub + 1
            out.append((place, turn, sub, label or "keep", ROLES[o], opened(o) + text))
        state = o
    if close and turns:
        place, turn, sub = out[-1][:3]
        for p in [*PATHS[state, FINAL], FINAL] if state != FINAL else []:
            sub += 1
            out.append((place, turn, sub, "insert", ROLES[p], opened(p)))
            state = p
        out.append((place, turn, sub + 1, "end", ROLES[FINAL], END_MARK))
    return out


def _groups(frames: Iterator[pd.DataFrame]):
    """Rows of one (conversation, range) after the other, across batches."""
    rest = None
    for f in frames:
        if rest is not None:
            f = pd.concat([rest, f], ignore_index=True)
        key = f["conv"].fillna("") + "\0" + f["range"].astype(str) + f["conv"].isna().astype(str)
        ends = key.ne(key.shift(-1)).to_numpy().nonzero()[0]
        at = 0
        for e in ends[:-1]:
            yield f.iloc[at:e + 1]
            at = e + 1
        rest = f.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def _role_ids(f: pd.DataFrame) -> list[int]:
    return [ROLES.index(r) if r in ROLES[1:] else 0 for r in f["role"]]


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, place, turn, sub, action, role, segment: the repaired turns.

    Segments of a conversation are in the order of (place, sub). ``action`` is
    keep, merge, relabel, relabel+merge, insert (an empty turn) or end.
    """
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    read = F.monotonically_increasing_id()
    order = ["conv_id", F.col("turn").asc_nulls_last(), "read"]
    rows = conversations.select("conv_id", "turn", F.lower(F.trim("role")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"), read.alias("read"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the key as text tells null from every id, and groups of any type
    rows = written(rows.select("conv_id", "turn", "role", "text", F.col("conv_id").cast("string").alias("conv"),
                               F.spark_partition_id().alias("range"),
                               F.monotonically_increasing_id().alias("place")))
    split = rows.groupBy("conv").agg(F.min("range").alias("a"), F.max("range").alias("b")).filter("a < b")
    split = split.withColumnRenamed("conv", "split")

    def products(frames):
        for f in _groups(frames):
            yield pd.DataFrame({"conv": [f["conv"].iat[0]], "range": [f["range"].iat[0]],
                                "m": [[x for row in product(_role_ids(f)) for x in row]]})

    def dealt(df):
        return df.repartition("conv", "range").sortWithinPartitions("conv", "range", "place")

    across = rows.join(split, F.col("conv").eqNullSafe(F.col("split"))).select("conv", "range", "place", "role")
    at: dict = {}
    # at most two rows for each range
    found = dealt(across).mapInPandas(products, "conv string, range int, m array<long>").collect()
    for r in sorted(found, key=lambda r: r["range"]):
        at.setdefault(r.conv, []).append((r["range"], [r.m[i:i + 4] for i in range(0, 16, 4)]))
    states, finals = {}, {}
    for conv, parts in at.items():
        for (part, _), pair in zip(parts, borders([m for _, m in parts]), strict=True):
            states[conv, part] = pair
        finals[conv] = parts[-1][0]

    def run(frames):
        out = []
        for f in _groups(frames):
            conv, part = f["conv"].iat[0], int(f["range"].iat[0])
            conv = None if pd.isna(conv) else conv
            entry, leave = states.get((conv, part), (START, None))
            close = finals.get(conv, part) == part
            roles = _role_ids(f)
            new = repair(roles, entry, leave)
            turns = list(zip(f["place"], f["turn"], f["text"], strict=True))
            out += [(f["conv_id"].iat[0], *row) for row in segments(turns, roles, new, entry, close)]
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["conv_id", "place", "turn", "sub", "action", "role", "segment"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "place", "turn", "sub", "action", "role", "segment"])

    return dealt(rows).mapInPandas(
        run, f"conv_id {kinds['conv_id']}, place long, turn {kinds['turn']}, sub int, action string, "
             "role string, segment string")
