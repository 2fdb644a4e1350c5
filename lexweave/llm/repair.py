"""Conversation structure repair: the cheapest edits of role sequences, found over a Re-Pair grammar with one transfer matrix per rule."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import ready
from lexweave.sources.tables import stage

#: What edits cost, and the legal neighbours of roles by initial.
RENAME, DROP, ADD, CUT_OFF = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: States while reading (s?(ua)+)?: nothing yet, after s, after u, after a. Where a letter leads, and what an added turn is.
STATES, FAR = 4, 1 << 40
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEXT_TURN = "uuau"
FULL = {"u": "user", "a": "assistant"}
#: Costs and letters of the turns to add after the last row, by state.
CLOSING = {0: (0, ""), 1: (2 * ADD, "II"), 2: (ADD, "I"), 3: (0, "")}
#: Symbols of rows: blank or duplicate, else 1 + 2 * role + truncated; and rows of one conversation in one block.
ROLES, MUST_GO = "sua?", 0
BLOCK_ROWS = 1 << 16


class Grammar(NamedTuple):
    """Symbols up to ``2 * len(ROLES)`` are rows; symbol s beyond is the rule left[s] right[s].

    ``cost[s, i, k]`` is the least cost from state i to k, ``rank[s, i, k]`` the place of its audit among those
    of the same i in ASCII order, ``mid[s, i, k]`` the state between the halves. Audits from one state to two
    states differ before either ends (each ends with a row's letter), so ranks alone decide ties.
    """
    left: np.ndarray
    right: np.ndarray
    cost: np.ndarray
    rank: np.ndarray
    mid: np.ndarray


def row_edits() -> tuple[np.ndarray, np.ndarray, list[list[list[str | None]]]]:
    """Costs, ranks and letters of one row for every symbol: added turns first, then Delete, Keep or Rerole."""
    count = 1 + 2 * len(ROLES)
    cost = np.full((count, STATES, STATES), FAR, np.int64)
    letters: list = [[[None] * STATES for _ in range(STATES)] for _ in range(count)]
    for symbol in range(count):
        role, cut = (None, 0) if symbol == MUST_GO else (ROLES[(symbol - 1) // 2], (symbol - 1) % 2 * CUT_OFF)
        for start in range(STATES):
            state, spent = start, 0
            for added in range(3):
                edits = [("D", state, DROP)]
                if role:
                    edits += [("K", AFTER[role, state], cut)] if (role, state) in AFTER else []
                    edits.append(("R", AFTER[NEXT_TURN[state], state], RENAME + cut))
                for letter, to, price in edits:
                    now = (spent + price, "I" * added + letter)
                    if now < (cost[symbol, start, to], letters[symbol][start][to] or "~"):
                        cost[symbol, start, to], letters[symbol][start][to] = now
                state, spent = AFTER[NEXT_TURN[state], state], spent + ADD
    rank = np.zeros_like(cost)
    for symbol in range(count):
        for start in range(STATES):
            known = sorted((x, k) for k, x in enumerate(letters[symbol][start]) if x)
            for place, (_, k) in enumerate(known):
                rank[symbol, start, k] = place
    return cost, rank, letters


def product(cost: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus products of pairs of matrices, ties by the ASCII order of the audits."""
    tie = STATES * STATES
    total = cost[left][:, :, :, None] + cost[right][:, None, :, :]  # i, j, k
    order = rank[left][:, :, :, None] * STATES + rank[right][:, None, :, :]
    mid = np.argmin(np.minimum(total, FAR) * tie + order, axis=2)
    pick = lambda x: np.take_along_axis(x, mid[:, :, None, :], 2)[:, :, 0, :]
    best = np.minimum(pick(total), FAR)
    return best, np.argsort(np.argsort(pick(order), axis=2, kind="stable"), axis=2), mid


def repair_pairs(symbols: np.ndarray, owner: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """A grammar for many sequences, one after the other (``owner``: whose each symbol is), and the symbol each ends as.

    Each round replaces the most frequent pairs of neighbours (those at least half as frequent as the most
    frequent) by new symbols, as in Re-Pair, one matrix per rule; when no pair is left that occurs twice,
    neighbours are joined two by two. Equal pairs share their rule across all sequences.
    """
    cost, rank, _ = row_edits()
    mid = np.zeros_like(cost)
    left = right = np.full(len(cost), -1, np.int64)
    while len(symbols) > 1:
        near = owner[1:] == owner[:-1]
        at = np.flatnonzero(near)
        if not len(at):
            break
        pair, which, n = np.unique(symbols[at] << 32 | symbols[at + 1], return_inverse=True, return_counts=True)
        chosen = n >= max(2, n.max() // 2) if n.max() > 1 else np.ones(len(n), bool)
        taken = np.zeros(len(symbols) + 1, bool)
        taken[at[chosen[which]]] = True
        taken = taken[:-1]
        where = np.flatnonzero(taken)  # of overlapping pairs every second one, from the left
        fresh = np.append(True, np.diff(where) > 1)
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - begin) % 2 == 0]
        used, name = np.unique(symbols[where] << 32 | symbols[where + 1], return_inverse=True)
        a, b = used >> 32, used & 0xFFFFFFFF
        c, r, m = product(cost, rank, a, b)
        symbols = symbols.copy()
        symbols[where] = len(cost) + name
        left, right = np.append(left, a), np.append(right, b)
        cost, rank, mid = np.concatenate([cost, c]), np.concatenate([rank, r]), np.concatenate([mid, m])
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return Grammar(left, right, cost, rank, mid), symbols, owner


def unrolled(g: Grammar, roots: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rope of audits written out: (symbol, state before, state after) of every row below the roots, in order."""
    symbol, i, k = roots, start, end
    while (wide := g.left[symbol] >= 0).any():
        n = np.where(wide, 2, 1)
        at = np.cumsum(n) - n
        out = [np.repeat(x, n) for x in (symbol, i, k)]
        m = g.mid[symbol, i, k][wide]
        first, second = at[wide], at[wide] + 1
        out[0][first], out[0][second] = g.left[symbol[wide]], g.right[symbol[wide]]
        out[2][first] = out[1][second] = m
        symbol, i, k = out
    return symbol, i, k


# -- rows ------------------------------------------------------------------
def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns, under their names, with the damage that crc32 of ``conv:turn`` asks for (nulls: one space)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    body = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(F.col(conv), F.col(turn), F.when(kind == 4, F.lit("user")).otherwise(said(role)).alias(role), body.alias(text),
                                        F.explode(copies).alias("_copy")).drop("_copy")


def placed(rows: DataFrame) -> DataFrame:
    """Staged rows in order (conv, turn with nulls first, role, text) with ``seq``, their place in the whole table.

    Ranges are cut by all order columns and a digit of chance, so a conversation of any length spans many.
    """
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    salted = rows.withColumn("_at", F.monotonically_increasing_id())
    ranges = salted.repartitionByRange(*order, F.col("_at")).sortWithinPartitions(*order, "_at").drop("_at")
    return stage(ranges.withColumn("seq", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """Narrow rows: ``conv, turn, seq, initial, fault`` (blank, duplicate, truncated or null; the first that holds counts).

    A row is no duplicate if it is the first of its conversation, role and text; these first rows are
    joined on ``seq``, which is unique, so a turn that is repeated without end meets in no task.
    """
    narrow = turns.select("conv", "turn", "seq", F.substring("role", 1, 1).alias("initial"), F.col("role"), F.sha2("text", 256).alias("digest"),
                          (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    firsts = narrow.groupBy("conv", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return narrow.join(firsts, "seq", "left").select("conv", "turn", "seq", "initial", fault.alias("fault"))


def symbol_of(initial: Column, fault: Column) -> Column:
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(fault.isin("blank", "duplicate"), MUST_GO).otherwise(1 + 2 * role + F.coalesce((fault == "truncated").cast("int"), F.lit(0)))


BLOCKS = ("seq bigint, last bigint, symbols binary, first_initial string, last_initial string, illegal bigint, cost array<bigint>, rank array<bigint>")


def same_as_before(column: pa.Array) -> np.ndarray:
    """Of each value but the first, whether it equals the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return equal | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order become blocks: the symbols of one conversation in one batch, and their matrix from the batch's grammar."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            rows = b.slice(at, BLOCK_ROWS)
            seq = rows.column("seq").to_numpy()
            symbols = rows.column("symbol").to_numpy().astype(np.int64)
            initial = rows.column("initial").cast(pa.string())
            new = np.append(True, ~same_as_before(rows.column("conv")))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(seq))
            bad = np.append(False, ~pc.is_in(pc.binary_join_element_wise(initial.slice(0, len(seq) - 1), initial.slice(1), ""),
                                            value_set=pa.array(LEGAL)).to_numpy(zero_copy_only=False)) if len(seq) > 1 else np.zeros(1, bool)
            bad[starts] = False
            g, roots, _ = repair_pairs(symbols, np.cumsum(new) - 1)
            sums = np.append(0, np.cumsum(bad))
            raw = symbols.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([
                rows.column("conv").take(pa.array(starts)), pa.array(seq[starts]), pa.array(seq[ends - 1]),
                pa.array([raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())], pa.binary()), initial.take(pa.array(starts)), initial.take(pa.array(ends - 1)),
                pa.array(sums[ends] - sums[starts]), pa.array(list(g.cost[roots].reshape(-1, STATES ** 2)), pa.list_(pa.int64())),
                pa.array(list(g.rank[roots].reshape(-1, STATES ** 2)), pa.list_(pa.int64()))],
                ["conv", "seq", "last", "symbols", "first_initial", "last_initial", "illegal", "cost", "rank"])


def chosen_states(cost: np.ndarray, rank: np.ndarray) -> tuple[list[int], int]:
    """The states between the blocks of one conversation on the cheapest way, and its cost without the closing turns' letters."""
    ahead, steps = [(CLOSING[k][0], k) for k in range(STATES)], []
    for c, r in zip(cost[::-1], rank[::-1]):
        step = [min((int(c[i, k]) + ahead[k][0], int(r[i, k]), k) for k in range(STATES)) for i in range(STATES)]
        steps.append([k for _, _, k in step])
        ahead = [(min(total, FAR), k) for total, _, k in step]
    states = [0]
    for step in reversed(steps):
        states.append(step[states[-1]])
    return states, ahead[0][0]


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, conversation by conversation: the state before and after each, and on the first the totals."""
    held: pa.Table | None = None
    names = ["conv", "seq", "start", "end", "closing", "cost", "illegal", "head"]

    def done(t: pa.Table) -> pa.RecordBatch:
        new = np.append(True, ~same_as_before(t.column("conv").combine_chunks()))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(new))
        cost, rank = (np.array(t.column(c).combine_chunks().flatten()).reshape(-1, STATES, STATES) for c in ("cost", "rank"))
        close = np.array([CLOSING[k][0] for k in range(STATES)])
        total = cost[:, 0, :] + close
        end = np.argmin(total * STATES + rank[:, 0, :], axis=1)
        start, price = np.zeros(len(new), np.int64), np.take_along_axis(total, end[:, None], 1)[:, 0]
        joins = np.zeros(len(new), np.int64)
        heads, tails = t.column("first_initial").to_pylist(), t.column("last_initial").to_pylist()
        for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            states, price[a] = chosen_states(cost[a:z], rank[a:z])
            start[a:z], end[a:z] = states[:-1], states[1:]
            joins[a] = sum(x + y not in LEGAL for x, y in zip(tails[a: z - 1], heads[a + 1: z]))
        bad = np.add.reduceat(t.column("illegal").to_numpy(), starts)
        illegal = np.zeros(len(new), np.int64)
        illegal[starts] = bad + joins[starts]
        closing = np.where(np.append(new[1:], True), end, -1)
        return pa.RecordBatch.from_arrays([t.column("conv").combine_chunks(), t.column("seq").combine_chunks(), pa.array(start), pa.array(end.astype(np.int64)),
                                           pa.array(closing.astype(np.int64)), pa.array(price), pa.array(illegal), pa.array(new)], names)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        new = np.flatnonzero(~same_as_before(t.column("conv").combine_chunks())) + 1
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield done(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield done(held)


def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their states as audits, one text of letters per row, joined by a comma; closing turns come last."""
    _, _, letters = row_edits()
    table = np.array([[[x or "" for x in row] for row in m] for m in letters])
    for b in batches:
        raw = b.column("symbols").to_pylist()
        size = np.array([len(x) for x in raw])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        g, roots, _ = repair_pairs(symbols, np.repeat(np.arange(len(raw)), size))
        s, i, k = unrolled(g, roots, b.column("start").to_numpy(), b.column("end").to_numpy())
        words = table[s, i, k].tolist()
        closing = b.column("closing").to_pylist()
        out, at = [], 0
        for n, c in zip(size.tolist(), closing):
            out.append(",".join(words[at: at + n]) + ("," + CLOSING[c][1] if c >= 0 and CLOSING[c][1] else ""))
            at += n
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seq"), pa.array(out)], ["conv", "seq", "edits"])


SUMMARY, TURNS = "audit string, repaired_sha256 string", "place bigint, role string, text string, edit string"


def rewritten(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of edits and the rows they edit, in order: each conversation's audit and the digest of what it has become, or its new turns.

    Texts stream through one by one; only the letters of one conversation are held.
    """
    open_, key, now, out = False, None, {}, []

    def turn(role: str, text: str, edit: str) -> None:
        if turns:
            out.append({"conv": key, "place": now["place"], "role": role, "text": text, "edit": edit})
        else:
            now["sha"].update(f"{chr(10) if now['place'] else ''}{role}:{text}".encode())
        now["place"] += 1
        now["state"] = AFTER[role[:1], now["state"]]

    def add(letters: str) -> None:
        for _ in range(letters.count("I")):
            turn(FULL[NEXT_TURN[now["state"]]], "", "I")

    def finish() -> None:
        add(now["left"][-1] if now["left"] else "")
        if not turns:
            out.append({"conv": key, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()})

    schema = None
    for b in batches:
        schema = pa.schema([b.schema.field("conv"), *([("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
                                                      if turns else [("audit", pa.string()), ("repaired_sha256", pa.string())])])
        for conv, role, text, edits in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text", "edits"))):
            if not open_ or conv != key:
                if open_:
                    finish()
                open_, key = True, conv
                now = {"sha": hashlib.sha256(), "place": 0, "state": 0, "audit": [], "left": []}
            if edits is not None:
                now["audit"].append(edits.replace(",", ""))
                now["left"] = edits.split(",")[::-1]
                continue
            word = now["left"].pop()
            add(word)
            if word[-1] == "K":
                turn(role, text, "K")
            elif word[-1] == "R":
                turn(FULL[NEXT_TURN[now["state"]]], text, "R")
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if open_:
        finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


class Repair(NamedTuple):
    """``turns``: rows in order; ``narrow``: their faults; ``heads``: costs of conversations; ``edited``: edits and rows, in order."""
    turns: DataFrame
    narrow: DataFrame
    heads: DataFrame
    edited: DataFrame


def plan(rows: DataFrame) -> Repair:
    kind = dict(rows.dtypes)["conv"]
    turns = placed(rows)
    narrow = stage(faults(turns), "faults")
    coded = narrow.select("conv", "seq", "initial", symbol_of(F.col("initial"), F.col("fault")).cast("int").alias("symbol"))
    blocks = coded.repartition(F.shiftright("seq", 33)).sortWithinPartitions("seq").mapInArrow(packed, f"conv {kind}, {BLOCKS}")
    blocks = stage(blocks, "blocks")
    ways = blocks.drop("symbols").repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(
        solved, f"conv {kind}, seq bigint, start bigint, end bigint, closing bigint, cost bigint, illegal bigint, head boolean")
    ways = stage(ways, "ways")
    edits = blocks.select("conv", "seq", "symbols").join(ways.select("seq", "start", "end", "closing"), "seq").select(
        "conv", "seq", "symbols", "start", "end", "closing").mapInArrow(lettered, f"conv {kind}, seq bigint, edits string")
    both = turns.select("conv", "seq", F.lit(1).alias("kind"), "role", "text").unionByName(edits.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return Repair(turns, narrow, ways.where("head"), both.repartition("conv").sortWithinPartitions("conv", "seq", "kind"))


def named(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))


def audit(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    Rows of a conversation are taken by turn (nulls first), then role and text. The roles that stay must
    read (s?(ua)+)? by their initials; Keep costs nothing, Rerole 2, Delete 3 (blank and duplicate rows must
    go), Insert 2, a truncated row that stays 1; of the cheapest audits the ASCII-least is taken. Null roles and
    texts are one space; null turns come first and count in no gap; a null conversation id is one conversation;
    repeated rows are duplicates; ``conversations`` names (in the column ``conv``) more that may have no rows
    and then get zeros; an empty table gives none; other columns play no part.

    Rows are cut into ranges of the whole order, so a long conversation spans many tasks. A task builds one
    Re-Pair grammar for the row symbols of all its conversations, with one min-plus matrix per rule; a
    conversation's blocks are then joined by their 4 x 4 matrices alone, and the audits are written out from the rules.
    Only the digest of the repaired text, which is sequential, reads a conversation in one task, as a stream.
    """
    ready(rows.sparkSession)
    p = plan(named(rows, conv, turn, role, text))
    per_turn = p.narrow.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == x, 1)).alias(x) for x in ("blank", "duplicate", "truncated")])
    gaps = (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long")
    stats = per_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    told = p.edited.drop("kind", "seq").mapInArrow(lambda b: rewritten(b, False), f"conv {dict(p.turns.dtypes)['conv']}, {SUMMARY}")
    parts = [stats, p.heads.select("conv", "cost", "illegal"), told] + ([conversations.select("conv")] if conversations is not None else [])
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return every.groupBy("conv").agg(*[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                     F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                     F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: ``conv, place`` (from 0), ``role, text`` and ``edit`` (K kept, R with another role, I added); rules as in ``audit``."""
    ready(rows.sparkSession)
    p = plan(named(rows, conv, turn, role, text))
    return p.edited.drop("kind", "seq").mapInArrow(lambda b: rewritten(b, True), f"conv {dict(p.turns.dtypes)['conv']}, {TURNS}")
