"""Conversation structure repair: cheapest edits by depth-first branch-and-bound over blocks of turns."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import WORD_PATTERN, cut, join_copies, small_batches

#: A conversation is solved in blocks of at most so many turns.
BLOCK = 1024
#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. What a turn of each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that is wanted in each state, and the state after it.
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Pairs of initials that may stand side by side.
LEGAL = {"su", "ua", "au"}


def suffix_bounds(turns: str, goals: tuple[int, ...], last: bool) -> list[list[float]]:
    """For each turn and state what the turns from there on cost at least, until one of `goals`; infinite where none can be met."""
    out = [[0.0 if q in goals else math.inf for q in range(4)]]
    for k in range(len(turns), -1, -1):
        if k < len(turns):
            after, c = out[-1], turns[k]
            more = CUT_SHORT if c.isupper() else 0
            out.append([DELETE + after[q] if c == "D" else min(DELETE + after[q], REROLE + more + after[WANTED[q][1]], KEEP + more + after[NEXT[q, c.lower()]] if (q, c.lower()) in NEXT else math.inf) for q in range(4)])
        if k < len(turns) or last:
            for _ in range(3):
                out[-1] = [min(x, INSERT + out[-1][WANTED[q][1]]) for q, x in enumerate(out[-1])]
    return out[::-1]


def solve(turns: str, entry: int, goals: tuple[int, ...], last: bool) -> tuple[int, str, int] | None:
    """The cheapest edits of a run of turns from state `entry` to one of `goals`: (cost, audit, state), of equal costs the
    audit that is least in ASCII; None if there are none.

    A turn is the initial of its role (s, u, a; x is any other), in capitals if it is truncated, or D if it must be deleted.
    Insertions stand before a turn; after the last one only if `last`.

    Branch and bound, depth first with an explicit stack. A node is (turn, state); its bound adds what the turns that follow
    cost at least from that state (`suffix_bounds`). The incumbent is the best whole (cost, audit) so far; each node's table
    entry is the best prefix that reached it, and a prefix that is no better ends there. Two prefixes of one node and cost
    are never the start of one another (they have equally many other letters, and each insertion costs), so the lesser one
    stays the lesser. The search ends when the stack is empty: nothing that is left could be better.
    """
    n, bound = len(turns), suffix_bounds(turns, goals, last)
    best: tuple[int, str, int] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        k, state, cost, audit = stack.pop()
        if bound[k][state] == math.inf or best is not None and (cost + bound[k][state], audit[: len(best[1])]) > (best[0], best[1][: len(audit)]):
            continue
        seen = table.get((k, state))
        if seen is not None and seen <= (cost, audit):
            continue
        table[k, state] = (cost, audit)
        if k == n and state in goals and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, state)
        children = []
        if k < n or last:
            children.append((k, WANTED[state][1], cost + INSERT, audit + "I"))
        if k < n:
            c = turns[k]
            children.append((k + 1, state, cost + DELETE, audit + "D"))
            if c != "D":
                more = CUT_SHORT if c.isupper() else 0
                if (state, c.lower()) in NEXT:
                    children.append((k + 1, NEXT[state, c.lower()], cost + KEEP + more, audit + "K"))
                children.append((k + 1, WANTED[state][1], cost + REROLE + more, audit + "R"))
        # the most promising is tried first: pushed last
        children.sort(key=lambda x: (x[2] + bound[x[0]][x[1]], x[3]), reverse=True)
        stack += children
    return best


@functools.lru_cache(50_000)
def solve_short(turns: str, entry: int, goals: tuple[int, ...], last: bool) -> tuple[int, str, int] | None:
    """`solve` for short runs, which come again and again."""
    return solve(turns, entry, goals, last)


def plan_of(initials: str, audit: str, entry: int) -> tuple[list[str], list[str | None], list[str], list[str]]:
    """What an audit does to each turn of a block: its edit letter, its new role if it gets one, the initials of turns
    inserted before it, and (for the last turn) after it."""
    letters: list[str] = []
    roles: list[str | None] = []
    before: list[str] = []
    state, waiting, k = entry, "", 0
    for c in audit:
        if c == "I":
            role, state = WANTED[state]
            waiting += role[0]
            continue
        letters.append(c)
        before.append(waiting)
        roles.append(WANTED[state][0] if c == "R" else None)
        state = state if c == "D" else WANTED[state][1] if c == "R" else NEXT[state, initials[k]]
        waiting, k = "", k + 1
    return letters, roles, before, [*[""] * (len(letters) - 1), waiting]


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows (c, conv, turn, role, text) with the faults of the contract: of crc32(`conv_id:turn`) mod 20, 0 drops the row,
    1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes the role user. A null id, turn, role or text reads as one space;
    a null turn sorts first. `c` tells conversations apart, a null id from all others."""
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.withColumn("_kind", kind).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(conversation_key(F.col("conv")).alias("c"), "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_again")).drop("_again")


def conversation_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def ordered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a number `rid`, and without their texts in order: c, turn, rid, pos, block, initial, kind).

    Order: conversation, turn (nulls first), role, the first 64 characters of the text, its MD5; equal rows in any order. Rows
    are dealt by ranges of this order, so that a conversation of any size lies in as many tasks as it needs; `pos` numbers
    them, `block` is a run of at most BLOCK numbers. kind: blank, duplicate, truncated or fine, the first that holds.
    """
    spark = rows.sparkSession
    held = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    light = held.select("c", "turn", "role", F.substring("text", 1, 64).alias("head"), F.md5(F.col("text").cast("binary")).alias("h"), "rid", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), (~F.col("text").rlike(WORD_PATTERN)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut_short"))
    order = ["c", "turn", "role", "head", "h", "rid"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = light.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    same = F.unhex(F.sha2(F.concat_ws("\n", F.length("c").cast("string"), "c", F.length("role").cast("string"), "role", "h").cast("binary"), 256))
    placed = cut(placed.select("c", "turn", "rid", "pos", "initial", "blank", "cut_short", same.alias("same")))
    groups = placed.groupBy("same").agg(F.min("pos").alias("begun"), F.count("*").alias("copies")).filter("copies > 1")
    told = join_copies(placed, cut(groups), "same", "copies", "left")
    kind = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("begun"), "duplicate").when(F.col("cut_short"), "truncated").otherwise("fine")
    return held, told.select("c", "turn", "rid", "pos", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block"), "initial", kind.alias("kind"))


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per block of a conversation: its turns' numbers, initials and codes in order (at most BLOCK), and whether it
    is the conversation's first and last."""
    code = F.when(F.col("kind").isin("blank", "duplicate"), "D").when(F.col("kind") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    items = turns.groupBy("c", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "rid", "initial", code.alias("code")))).alias("items"))
    blocks = cut(items.select("c", "block", F.col("items.rid").alias("rids"), F.array_join("items.initial", "").alias("initials"), F.array_join("items.code", "").alias("codes")))
    ends = blocks.groupBy("c").agg(F.min("block").alias("begin"), F.max("block").alias("end"), F.count("*").alias("copies"))
    return join_copies(blocks, cut(ends), "c", "copies")


def _solved(blocks: DataFrame) -> DataFrame:
    """Each block with its options: of a whole conversation the one that repairs it, of others the best from each state to each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            options = []
            for codes, first, last in zip(b["codes"], b["first"], b["last"], strict=True):
                search = solve_short if len(codes) <= 32 else solve
                ways = [(entry, search(codes, entry, goals, bool(last))) for entry in ((START,) if first else range(4)) for goals in (((START, ASSISTANT),) if last else ((g,) for g in range(4)))]
                options.append([(entry, got[2], got[0], got[1]) for entry, got in ways if got is not None])
            illegal = [sum(x + y not in LEGAL for x, y in zip(t, t[1:], strict=False)) for t in b["initials"]]
            yield b.drop(columns="codes").assign(**{name: [[o[k] for o in x] for x in options] for k, name in enumerate(("entry", "leaves", "cost", "audit"))}, illegal=illegal)

    told = blocks.select("c", "block", "rids", "initials", "codes", (F.col("block") == F.col("begin")).alias("first"), (F.col("block") == F.col("end")).alias("last"))
    solved = told.mapInPandas(run, "c string, block bigint, rids array<bigint>, initials string, first boolean, last boolean, entry array<int>, leaves array<int>, cost array<bigint>, audit array<string>, illegal bigint")
    return solved.withColumn("options", F.arrays_zip("entry", "leaves", "cost", "audit")).drop("entry", "leaves", "cost", "audit")


def _chosen(solved: DataFrame) -> DataFrame:
    """(c, block, entry, leaves, between): the way through the blocks of each conversation that has several, and how many
    pairs across their borders are illegal.

    A conversation is here one row of at most 16 costs and ranks for each BLOCK turns. From its end the least cost of what
    follows each state is known; from its start the cheapest way is taken, of equal ones the block's least audit. Audits of a
    block from one state are never the start of one another, so the first that differs decides."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        ways = [list(zip(*(x.tolist() for x in w), strict=True)) for w in zip(group["entry"], group["leaves"], group["cost"], group["rank"], strict=True)]
        follows = [dict.fromkeys(range(4), 0)]
        for options in reversed(ways):
            least: dict[int, int] = {}
            for entry, leaves, cost, _ in options:
                if leaves in follows[-1]:
                    least[entry] = min(cost + follows[-1][leaves], least.get(entry, cost + follows[-1][leaves]))
            follows.append(least)
        follows.reverse()
        state, entries, exits = START, [], []
        for options, after in zip(ways, follows[1:], strict=True):
            _, _, leaves = min((cost + after[leaves], rank, leaves) for entry, leaves, cost, rank in options if entry == state and leaves in after)
            entries.append(state)
            exits.append(leaves)
            state = leaves
        pairs = group["tail"].shift(fill_value="") + group["head"]
        between = [int(len(p) == 2 and p not in LEGAL) for p in pairs]
        return group[["c", "block"]].assign(entry=entries, leaves=exits, between=between)

    audits = F.array_sort("options.audit")
    ranks = F.transform("options", lambda o: F.array_position(audits, o["audit"]).cast("int"))
    rows = solved.filter("not (first and last)").select("c", "block", *(F.col(f"options.{k}").alias(k) for k in ("entry", "leaves", "cost")), ranks.alias("rank"), F.substring("initials", 1, 1).alias("head"), F.substring("initials", -1, 1).alias("tail"))
    return rows.groupBy("c").applyInPandas(run, "c string, block bigint, entry int, leaves int, between bigint")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, turns) of conversations given as rows (c, turn, role, text) without nulls but in `turn`.

    summary: per conversation c, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: each turn with its edit (K, R,
    D) and each inserted one (I): c, pos, step (both give the order), edit, role and text after it.

    Any turn may be null (it sorts first and counts in no gap), texts may be of any length (they move whole and are read by
    no search), repeated rows are duplicates of one another, other columns don't matter, no rows give no rows. A hot
    conversation is cut into blocks that are solved apart; what meets in one task is one short row a block.
    """
    small_batches(rows.sparkSession)
    held, turns = ordered_turns(rows)
    turns = cut(turns)
    solved = cut(_solved(_blocks(turns)))
    way = cut(_chosen(solved))
    one = solved.filter("first and last").select("c", "block", "rids", "initials", "illegal", F.lit(0).cast("long").alias("between"), F.col("options")[0].alias("o"))
    met = solved.filter("not (first and last)").join(way, ["c", "block"])
    several = met.select("c", "block", "rids", "initials", "illegal", "between", F.filter("options", lambda o: (o["entry"] == F.col("entry")) & (o["leaves"] == F.col("leaves")))[0].alias("o"))
    done = cut(one.unionByName(several))

    by_turn = turns.groupBy("c", "turn").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    faults = by_turn.groupBy("c").agg(gaps.alias("gaps"), *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    parts = F.sort_array(F.collect_list(F.struct("block", F.col("o.audit").alias("audit"))))
    whole = done.groupBy("c").agg(F.sum(F.col("illegal") + F.col("between")).alias("illegal"), F.sum("o.cost").alias("cost"), F.array_join(parts["audit"], "").alias("audit"))
    return faults.join(whole, "c"), _edited(held, done)


def _edited(held: DataFrame, done: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plans = [plan_of(i, audit, entry) for i, audit, entry in zip(b["initials"], b["audit"], b["entry"], strict=True)]
            place = [list(range(len(p[0]))) for p in plans]
            yield pd.DataFrame({"block": b["block"], "rids": b["rids"], "place": place, "edit": [p[0] for p in plans], "as_role": [p[1] for p in plans], "before": [p[2] for p in plans], "behind": [p[3] for p in plans]})

    plans = done.select("block", "rids", "initials", "o.audit", "o.entry").mapInPandas(run, "block bigint, rids array<bigint>, place array<int>, edit array<string>, as_role array<string>, before array<string>, behind array<string>")
    each = plans.select("block", F.explode(F.arrays_zip("rids", "place", "edit", "as_role", "before", "behind")).alias("e"))
    each = each.select(F.col("e.rids").alias("rid"), "block", F.col("e.place").alias("place"), F.col("e.edit").alias("edit"), F.col("e.as_role").alias("as_role"), F.col("e.before").alias("before"), F.col("e.behind").alias("behind"))
    new = lambda side: F.transform(F.filter(F.split(F.col(side), ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("edit"), F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct("edit", F.coalesce("as_role", "role").alias("role"), "text"))
    rows = held.join(each, "rid").select("c", "block", "place", F.posexplode(F.concat(new("before"), own, new("behind"))).alias("step", "row"))
    return rows.select("c", (F.col("block") * BLOCK + F.col("place")).alias("pos"), "step", F.col("row.edit").alias("edit"), F.col("row.role").alias("role"), F.col("row.text").alias("text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(c, sha256) of the repaired conversations: `role:text` of the turns that stay, in order, joined by newlines.

    A digest is a chain through all its bytes, so a conversation's turns pass through one task, sorted and one after another
    in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, None
        for b in batches:
            out: list[tuple[str, str]] = []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("c", "role", "text")), strict=True):
                if c != at:
                    if chain is not None:
                        out.append((at, chain.hexdigest()))
                    at, chain = c, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["c", "sha256"])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([chain.hexdigest()])], names=["c", "sha256"])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = turns.filter("edit != 'D'").repartition(n, "c").sortWithinPartitions("c", "pos", "step")
    return kept.select("c", "role", "text").mapInArrow(run, "c string, sha256 string")


def repair_report(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row for every conversation of the table: its id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, after `damage` and `repair_conversations`. A conversation of which no row is left has zeros, an empty
    audit and the digest of nothing. Null ids are one conversation; other columns, whatever their names, don't matter."""
    summary, turns = repair_conversations(damage(conversations, id_col, turn_col))
    told = summary.join(conversation_digests(turns), "c", "left")
    convs = conversations.groupBy(F.col(id_col).alias("conv")).agg(F.count("*")).select("conv", conversation_key(F.col("conv")).alias("c"))
    numbers = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return convs.join(told, "c", "left").select(F.col("conv").alias(id_col), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
