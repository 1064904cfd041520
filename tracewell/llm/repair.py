"""Conversation structure repair by depth-first branch-and-bound.

A repaired conversation reads ``(system? (user assistant)+)?`` in role initials. Each row is kept (0), given the role
its place wants (2) or deleted (3, the only choice for blank and duplicate rows); empty turns are inserted (2); a
truncated row that stays costs 1. Wanted are the cheapest edits, and of those the first by their letters.

The rows of a conversation, one letter each, are cut into blocks. A block is searched for every state it can start
and end in: an explicit stack, children in the order of their letters, a suffix bound (rows that cost something
whatever is done, and disjoint neighbours that cannot both stay as they are), an incumbent (cost, audit) from a
greedy run, and per node (row, state) the best prefix so far: a worse one is dropped. Of equal costs into one node, no
audit is a beginning of another, so the smaller prefix stays the smaller whole. An empty stack proves the incumbent.
Blocks of a conversation are then joined in order, so a conversation of any length is searched by many tasks; what
meets in one task is one answer per block, and the conversation's text streams through one hash.

Defined cases: null roles and texts are one space, null turns come first; rows without a conversation id are one
conversation; rows of one turn are ordered by role, then by digest of the text, a repeated row beside its first;
roles other than system, user and assistant can only be given another role or be deleted; texts of any length are
read whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Store, prepared, read
from tracewell.llm.prefix_trie import CRC_BITS
from tracewell.llm.runs import runs

BLOCK_ROWS = 64
KNOWN_BLOCKS = 50_000  # answers that one task keeps for blocks of equal letters
# Costs of the edits; the states are nothing yet, a system turn, a user turn, an assistant turn.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "ABCDEFGHIJKLMNOP"  # 4 x fault (none, blank, duplicate, truncated) + role initial (s, u, a, other)
EMPTY = hashlib.sha256(b"").hexdigest()
FAULTS = ("blank", "duplicate", "truncated")


def _row(letter: str) -> tuple[bool, int, int]:
    """(must go, cost of staying, state after it or 0) of a row's letter."""
    fault, initial = divmod(LETTERS.index(letter), 4)
    return fault in (1, 2), TRUNCATED if fault == 3 else 0, (initial + 1) % 4


def _fits(state: int, role: int) -> bool:
    """Whether a turn that leads to state ``role`` may follow ``state``."""
    if role == SYSTEM:
        return state == START
    return role == ASSISTANT if state == USER else role == USER


def _wanted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _clash(left: int, right: int) -> bool:
    return bool(left and right) and (left, right) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


class _Bounds:
    """Lower bounds of the cost of all rows from ``i`` on, when the last turn must lead to ``goal``."""

    def __init__(self, rows: list[tuple[bool, int, int]], goal: int) -> None:
        n = len(rows)
        self.own, self.live, self.pairs = [0] * (n + 1), [n] * (n + 1), [0] * (n + 2)
        self.roles = [role for _, _, role in rows] + [0]
        after = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            gone, stays, role = rows[i]
            self.own[i] = self.own[i + 1] + (DELETE if gone else stays + (0 if role else REROLE))
            self.live[i] = self.live[i + 1] if gone else i
            after[i] = self.live[i + 1]
            if gone:
                self.pairs[i] = self.pairs[i + 1]
            else:
                follower = after[i]
                if follower < n:
                    apart = INSERT * _clash(role, rows[follower][2]) + self.pairs[after[follower]]
                else:
                    apart = INSERT * bool(role and role != goal)
                self.pairs[i] = max(self.pairs[i + 1], apart)
        self.after = after

    def rest(self, i: int, state: int) -> int:
        first = self.live[i]
        if first >= len(self.after) - 1:
            return self.own[i]
        role = self.roles[first]
        apart = bool(role) and not _fits(state, role)
        return self.own[i] + max(self.pairs[i], INSERT * apart + self.pairs[self.after[first]])


def _greedy(rows: list[tuple[bool, int, int]], state: int) -> tuple[int, str, int]:
    """Cost, letters and final state of one plain way through ``rows``."""
    cost, audit = 0, ""
    roles = [role for gone, _, role in rows if not gone] + [0]
    seen = 0
    for gone, stays, role in rows:
        if gone:
            cost, audit = cost + DELETE, audit + "D"
            continue
        seen += 1
        if role and _fits(state, role):
            cost, audit, state = cost + stays, audit + "K", role
        elif role in (USER, ASSISTANT) and _fits(role, roles[seen]):
            cost, audit, state = cost + stays + INSERT, audit + "IK", role
        else:
            cost, audit, state = cost + stays + REROLE, audit + "R", _wanted(state)
    return cost, audit, state


def search(letters: str, entry: int, goal: int, final: bool) -> tuple[int, str] | None:
    """Cheapest and then first (cost, audit) from state ``entry`` through all rows to ``goal``; None if there is none.

    ``final``: turns may also be inserted behind the last row.
    """
    rows = [_row(letter) for letter in letters]
    n = len(rows)
    if goal == START:
        return (DELETE * n, "D" * n) if entry == START else None
    if goal == SYSTEM:
        if entry == SYSTEM:
            return DELETE * n, "D" * n
        kept = [(DELETE * (n - 1) + stays, "D" * i + "K" + "D" * (n - 1 - i)) for i, (gone, stays, role) in enumerate(rows) if role == SYSTEM and not gone]
        return min(kept, default=None) if entry == START else None
    bounds, best = _Bounds(rows, goal), None
    if n > 2:
        cost, audit, state = _greedy(rows[:-2], entry)
        tail = search(letters[-2:], state, goal, final)
        best = (cost + tail[0], audit + tail[1]) if tail else None
    tables: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best:
            least = cost + bounds.rest(i, state)
            if least > best[0] or (least == best[0] and audit > best[1][:len(audit)]):
                continue
        known = tables.get((i, state))
        if known and known <= (cost, audit):
            continue
        tables[i, state] = (cost, audit)
        if i == n and state == goal:
            best = min(best, (cost, audit)) if best else (cost, audit)
            continue
        wanted, children = _wanted(state), []
        if i < n:
            gone, stays, role = rows[i]
            children.append((i + 1, state, cost + DELETE, audit + "D"))
            children.append((i, wanted, cost + INSERT, audit + "I"))
            if not gone and role and _fits(state, role):
                children.append((i + 1, role, cost + stays, audit + "K"))
            if not gone:
                children.append((i + 1, wanted, cost + stays + REROLE, audit + "R"))
        elif final:
            children.append((n, wanted, cost + INSERT, audit + "I"))
        stack.extend(reversed(children))
    return best


def _block(letters: str, first: bool, final: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of a block by (entry, exit)."""
    goals = (START, ASSISTANT) if final else (START, SYSTEM, USER, ASSISTANT)
    found = {(entry, goal): search(letters, entry, goal, final) for entry in ((START,) if first else range(4)) for goal in goals}
    return {states: answer for states, answer in found.items() if answer}


def _joined(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    at = {START: (0, "")}
    for table in tables:
        ways: dict[int, tuple[int, str]] = {}
        for (entry, goal), (cost, audit) in table.items():
            if entry in at:
                way = (at[entry][0] + cost, at[entry][1] + audit)
                ways[goal] = min(ways.get(goal, way), way)
        at = ways
    return min(at.values())


def _illegal(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def faulty(rows: DataFrame, store: Store) -> DataFrame:
    """``(conv, at, last, letter)`` of ``rows(conv, turn, role, text, copy)``: first fault and role initial of each."""
    text, role = F.col("text"), F.col("role")
    facts = rows.select(
        "conv", "turn", "role", F.md5(text.cast("binary")).alias("text_key"), "copy", (~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
        (~F.rlike(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("cut"))
    order = [F.col("turn").asc_nulls_first(), role, F.col("text_key"), F.col("copy")]
    facts = store.save(facts, "facts")  # texts are read once, not again for the bounds of the sort
    placed = store.save(runs(facts, "conv", order, store, "turns"), "placed")
    # First of its kind or not: told by (conversation, place), which no other row shares.
    firsts = placed.groupBy("conv", "role", "text_key").agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("fresh"))
    told = placed.join(firsts, ["conv", "at"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("fresh").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.instr(F.lit("sua"), F.substring(role, 1, 1))
    initial = F.when((role == "") | (initial == 0), 3).otherwise(initial - 1)
    return told.select("conv", "at", "last", F.substring(F.lit(LETTERS), fault * 4 + initial + 1, F.lit(1)).alias("letter"))


def repairs(letters: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(conv, blank, duplicate, truncated, illegal, cost, audit)`` per conversation of :func:`faulty` rows."""
    place = F.struct("at", "letter")
    blocks = letters.groupBy("conv", F.floor(F.col("at") / block_rows).alias("block")).agg(
        F.array_sort(F.collect_list(place)).alias("rows"), F.max("last").alias("final"))
    blocks = blocks.select("conv", "block", "final", F.array_join(F.transform("rows", lambda row: row["letter"]), "").alias("letters"))
    answer = "array<struct<entry:int,goal:int,cost:long,audit:string>>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        for batch in batches:
            answers = []
            for block, final, row in zip(*[batch.column(name).to_pylist() for name in ("block", "final", "letters")]):
                key = (row, block == 0, final)
                if key not in known:
                    if len(known) >= KNOWN_BLOCKS:
                        known.clear()
                    known[key] = [{"entry": e, "goal": g, "cost": c, "audit": a} for (e, g), (c, a) in _block(*key).items()]
                answers.append(known[key])
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), batch.column("letters"), pa.array(answers, kind)], names=["conv", "block", "letters", "answers"])

    solved = blocks.mapInArrow(solve, f"conv string, block long, letters string, answers {answer}")
    # One entry per block: an audit is one value, so the answers of a conversation have to meet.
    whole = solved.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "letters", "answers"))).alias("blocks"))
    fields = [*FAULTS, "illegal", "cost"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {name: [] for name in [*fields, "audit"]}
            for blocks in batch.column("blocks").to_pylist():
                row = "".join(block["letters"] for block in blocks)
                kinds = [divmod(LETTERS.index(letter), 4) for letter in row]
                for number, name in enumerate(FAULTS, 1):
                    found[name].append(sum(fault == number for fault, _ in kinds))
                found["illegal"].append(_illegal("".join("sua?"[initial] for _, initial in kinds)))
                cost, audit = _joined([{(a["entry"], a["goal"]): (a["cost"], a["audit"]) for a in block["answers"]} for block in blocks])
                found["cost"].append(cost)
                found["audit"].append(audit)
            arrays = [pa.array(found[name], pa.int64()) for name in fields]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *arrays, pa.array(found["audit"], pa.string())], names=["conv", *fields, "audit"])

    return whole.mapInArrow(join, "conv string, " + ", ".join(f"{name} long" for name in fields) + ", audit string")


def repaired_turns(rows: DataFrame, audits: DataFrame, hashed: bool = False) -> DataFrame:
    """``(conv, at, role, text)``: the turns of repaired conversations; ``hashed``: ``(conv, repaired_sha256)`` instead.

    The audit travels as a conversation's first row, its turns stream behind it. ``repartition`` by the conversation
    keeps them in one task, in order; nothing but the audit is held there.
    """
    text_key = F.md5(F.col("text").cast("binary"))
    tagged = rows.select("conv", F.lit(1).alias("tag"), "turn", "role", text_key.alias("text_key"), "copy", "text").unionByName(
        audits.select("conv", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text_key"),
                      F.lit(0).alias("copy"), F.col("audit").alias("text")))
    lined = tagged.repartition("conv").sortWithinPartitions("conv", "tag", F.col("turn").asc_nulls_first(), "role", "text_key", "copy")
    names = {USER: "user", ASSISTANT: "assistant"}

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, place, state, at, digest = None, "", 0, START, 0, None
        out: list[tuple] = []

        def turn(role: str, text: str) -> None:
            nonlocal at
            if hashed:
                digest.update(("\n" if at else "").encode() + f"{role}:{text}".encode())
            else:
                out.append((conv, at, role, text))
            at += 1

        def inserts() -> None:
            nonlocal place, state
            while place < len(audit) and audit[place] == "I":
                state = _wanted(state)
                turn(names[state], "")
                place += 1

        def close() -> None:
            if conv is not None:
                inserts()
                if hashed:
                    out.append((conv, digest.hexdigest()))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            kinds = [("conv", pa.string()), ("repaired_sha256", pa.string())] if hashed else \
                [("conv", pa.string()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], names=[name for name, _ in kinds])

        for batch in batches:
            for this, tag, role, text in zip(*[batch.column(name).to_pylist() for name in ("conv", "tag", "role", "text")]):
                if tag == 0:
                    close()
                    conv, audit, place, state, at, digest = this, text, 0, START, 0, hashlib.sha256()
                    continue
                inserts()
                letter, place = audit[place], place + 1
                if letter == "K":
                    state = "sua".index(role[0]) + 1
                    turn(role, text)
                elif letter == "R":
                    state = _wanted(state)
                    turn(names[state], text)
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return lined.mapInArrow(edit, "conv string, repaired_sha256 string" if hashed else "conv string, at long, role string, text string")


NAMED = ("coalesce(cast(conv_id as string), '') AS conv", "cast(turn as long) AS turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text")


def named(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, copy)``: the form the steps above read; ids as text, a null id as the empty text."""
    return conversations.selectExpr(*NAMED, "0 AS copy")


def damaged(conversations: DataFrame) -> DataFrame:
    """``named`` rows after the damage of the contract, with ``fate``; dropped rows are still there with fate 0."""
    label = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kept = conversations.select("conv_id", "turn", "role", "text", (F.crc32(label.cast("binary")) % 20).alias("fate"))
    text = F.coalesce("text", F.lit(" "))
    fate = F.col("fate")
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    fated = kept.select("conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(copies).alias("copy"), "fate")
    return fated.selectExpr(*NAMED, "copy", "fate")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    store = Store(spark, "repair")
    every = damaged(read(spark, sf_dir, "conversations"))
    left = every.filter("fate <> 0").drop("fate")
    turn = F.when(F.col("fate") != 0, F.col("turn"))
    wide = lambda column: column.cast("decimal(20,0)")
    gaps = wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn)
    convs = every.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    audits = store.save(repairs(faulty(left, store)), "audits")
    hashes = repaired_turns(left, audits.select("conv", "audit"), hashed=True)
    found = convs.join(audits, "conv", "left").join(hashes, "conv", "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in (*FAULTS, "illegal", "cost")]
    return found.select(
        F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


# A plain shortest path, row by row, over all four states.
OP12_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS label FROM conversations),
fated AS (SELECT *, CRC % 20 AS fate FROM base),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM fated, (VALUES (0), (1)) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged),
faults AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (clash) AS illegal, count(*) AS n
  FROM (SELECT *, i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS clash FROM faults) f GROUP BY conv_id),
inserts(s, t, letters, price, lines) AS (VALUES
  (0, 0, '', 0, ''), (0, 2, 'I', 2, 'user:' || chr(10)), (0, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (1, 1, '', 0, ''), (1, 2, 'I', 2, 'user:' || chr(10)), (1, 3, 'II', 4, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 2, '', 0, ''), (2, 3, 'I', 2, 'assistant:' || chr(10)), (3, 3, '', 0, ''), (3, 2, 'I', 2, 'user:' || chr(10))),
edits AS (
  SELECT f.conv_id, f.i, s.t AS before, e.letter,
         CASE e.letter WHEN 'D' THEN s.t WHEN 'R' THEN CASE WHEN s.t = 2 THEN 3 ELSE 2 END ELSE position(f.initial IN 'sua') END AS after,
         CASE e.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (f.fault = 'truncated' AND e.letter <> 'D')::INT AS price,
         CASE e.letter WHEN 'D' THEN '' WHEN 'R' THEN CASE WHEN s.t = 2 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) ELSE f.role || ':' || f.text || chr(10) END AS line
  FROM faults f, (VALUES (0), (1), (2), (3)) s(t), (VALUES ('D'), ('K'), ('R')) e(letter)
  WHERE e.letter = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR
        (f.initial = 's' AND s.t = 0) OR (f.initial = 'u' AND s.t <> 2) OR (f.initial = 'a' AND s.t = 2)))),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS out FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.after, p.cost + s.price + e.price, p.audit || s.letters || e.letter, p.out || s.lines || e.line
  FROM paths p JOIN inserts s ON s.s = p.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.before = s.t
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.after ORDER BY p.cost + s.price + e.price, p.audit || s.letters || e.letter) = 1),
ended AS (
  SELECT p.conv_id, p.cost + s.price AS cost, p.audit || s.letters AS audit, p.out || s.lines AS out
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN inserts s ON s.s = p.state AND s.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + s.price, p.audit || s.letters) = 1)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit,
       sha256(coalesce(left(e.out, greatest(length(e.out) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
""".replace("CRC", CRC_BITS.format("label"))
