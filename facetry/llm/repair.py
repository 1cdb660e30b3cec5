"""Cheapest repair of conversations by depth-first branch and bound.

A repaired conversation is empty, or has the role initials ``s?(ua)+``.  A row is kept
(free), given the role that is due (3), or deleted (4); blank rows and duplicates must be
deleted, and a truncated row that stays costs 3 more.  A missing turn may be inserted
anywhere with an empty text (3).  Of the cheapest edits the one whose letters
(D, I, K, R) come first in ASCII is taken.

Faults are found by Spark row by row.  For the search a conversation is one code letter
per row, so it needs as many bytes as its result has letters.  The edits meet the rows
again by position, and the repaired text is digested as a stream in order, so neither
text is ever gathered.  A repeated row is told from the first by the SHA-256 digest of
role and text.

Null roles and texts count as one space, also in the key that chooses the damage.  An
empty role has no initial: it is illegal in any pair and cannot be kept.  Rows with a
null conv_id belong to no conversation and are left out.  Rows of one turn are ordered by
role, then text.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.kernels import keep
from facetry.llm.turns import numbered
from facetry.session import ship_package

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: States by the last role initial given out; the repair may end in EMPTY and in A.
EMPTY, S, U, A = range(4)
#: State after a turn with this initial, by the state before.
LEGAL = {"s": {EMPTY: S}, "u": {EMPTY: U, S: U, A: U}, "a": {U: A}}
#: State after the turn that is due.
DUE = {EMPTY: U, S: U, A: U, U: A}
WORD = r"[^\x20\x09-\x0D]"

EDIT_SCHEMA = "conv_id long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy``: conversations with planted faults."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(
            ":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
        ).cast("binary")) % 20).alias("kind"),
    )
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )


def code(fault: Column, role: Column) -> Column:
    """A letter per row: ``x`` must go, upper case is truncated, ``o`` is any other role."""
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(known)).otherwise(known)


def find_faults(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, ``fault`` (blank, duplicate, truncated or null) and ``code`` to ``conv_id, turn, role, text``."""
    # Beginnings of role and text tell where the rows of one turn may be cut.
    cuts = ["turn", F.substring("role", 1, 16), F.substring("text", 1, 64)]
    placed = keep(numbered(rows.select("conv_id", "turn", "role", "text"), "conv_id", ["turn", "role", "text"], cuts))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # The first of each content, found by a grouping that is combined before its shuffle.
    first = placed.groupBy("conv_id", F.unhex(same).alias("_same")).agg(F.min("pos").alias("pos")).select(
        "conv_id", "pos", F.lit(True).alias("_first")
    )
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(last == "", "blank").when(F.col("_first").isNull(), "duplicate")
        .when(~last.rlike(r"[.!?]"), "truncated")
    )
    found = placed.join(first, ["conv_id", "pos"], "left").withColumn("fault", fault)
    return found.select("conv_id", "pos", "turn", "role", "text", "fault", code(F.col("fault"), F.col("role")).alias("code"))


def completion_costs(codes: str) -> list[tuple[int, int, int, int]]:
    """Least cost of the rows from each place on, by state: the search's lower bounds."""
    never = 1 << 60
    # At the end S lacks two turns and U one.
    rest = [(0, 2 * INSERT, INSERT, 0)]
    for letter in reversed(codes):
        after, low, cut = rest[-1], letter.lower(), CUT * letter.isupper()
        legal = LEGAL.get(low, {})
        own = []
        for state in range(4):
            best = DELETE + after[state]
            if low != "x":
                best = min(best, REROLE + cut + after[DUE[state]])
                best = min(best, cut + after[legal[state]] if state in legal else never)
            own.append(best)
        # An inserted turn leads to the state that is due; two may stand before a row.
        for _ in range(2):
            own = [min(c, INSERT + own[DUE[s]]) for s, c in enumerate(own)]
        rest.append(tuple(own))
    return rest[::-1]


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and edits of the best repair of rows with these codes.

    Nodes are (rows done, state).  Children are stacked so that the letter first in ASCII
    is opened first; prefixes are therefore met in ASCII order, and of two that cost the
    same the earlier is the better.  A node is dropped if its bound is not under the
    incumbent's cost, or if its table entry holds a prefix that is as cheap.  Once the
    stack is empty, the incumbent is proved best.  Prefixes are linked back to front.
    """
    n, bound = len(codes), completion_costs(codes)
    table: dict[tuple[int, int], int] = {}
    best_cost, best_link = bound[0][EMPTY] + 1, None
    stack: list[tuple] = [(0, EMPTY, 0, None)]
    while stack:
        at, state, cost, link = stack.pop()
        if cost + bound[at][state] >= best_cost or table.get((at, state), cost + 1) <= cost:
            continue
        table[at, state] = cost
        children = []
        if at == n and state in (EMPTY, A):
            best_cost, best_link = cost, link
        if at < n:
            children.append((at + 1, state, cost + DELETE, ("D", link)))
        children.append((at, DUE[state], cost + INSERT, ("I", link)))
        if at < n and codes[at] != "x":
            low, cut = codes[at].lower(), CUT * codes[at].isupper()
            if state in LEGAL.get(low, {}):
                children.append((at + 1, LEGAL[low][state], cost + cut, ("K", link)))
            children.append((at + 1, DUE[state], cost + REROLE + cut, ("R", link)))
        stack.extend(c for c in reversed(children) if c[2] + bound[c[0]][c[1]] < best_cost)
    letters = []
    while best_link is not None:
        letters.append(best_link[0])
        best_link = best_link[1]
    return best_cost, "".join(reversed(letters))


def solve(coded: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` for ``conv_id, codes``."""
    ship_package(coded.sparkSession)

    def work(batches):
        known: dict[str, tuple[int, str]] = {}
        for batch in batches:
            rows = []
            for letters in batch.column(1).to_pylist():
                answer = known.get(letters) or cheapest(letters)
                if len(letters) <= 64 and len(known) < 100_000:
                    known[letters] = answer
                rows.append(answer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])],
                ["conv_id", "cost", "audit"],
            )

    return coded.select("conv_id", "codes").mapInArrow(work, EDIT_SCHEMA)


def edit_rows(edits: DataFrame) -> DataFrame:
    """``conv_id, pos, ord, letter, new_role``: a row per edit that leaves a turn behind.

    ``pos`` is null for inserted turns, ``new_role`` for kept ones; ``ord`` orders them.
    """
    def work(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for conv, codes, audit in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, state = 0, EMPTY
                for ord_, letter in enumerate(audit):
                    target = DUE[state] if letter in "IR" else None
                    if letter == "K":
                        state = LEGAL[codes[at].lower()][state]
                    elif target is not None:
                        state = target
                    if letter != "D":
                        role = None if target is None else "user" if target == U else "assistant"
                        for column, value in zip(columns, (conv, None if letter == "I" else at, ord_, letter, role)):
                            column.append(value)
                    at += letter != "I"
                if len(columns[0]) >= 1 << 16:
                    yield _edit_batch(columns)
                    columns = [[], [], [], [], []]
            if columns[0]:
                yield _edit_batch(columns)

    ship_package(edits.sparkSession)
    return edits.select("conv_id", "codes", "audit").mapInArrow(
        work, "conv_id long, pos long, ord long, letter string, new_role string"
    )


def _edit_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "pos", "ord", "letter", "new_role"]
    )


def repaired_turns(found: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, ord, role, text`` of the repaired conversations."""
    steps = edit_rows(edits)
    kept = steps.where(F.col("pos").isNotNull()).join(found.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"])
    given = steps.where(F.col("pos").isNull()).select("conv_id", "ord", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.select("conv_id", "ord", F.coalesce("new_role", "role").alias("role"), "text").unionByName(given)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text`` by ``ord``, joined by line breaks."""
    def work(batches):
        conv = state = None
        for batch in batches:
            done: list[tuple] = []
            for here, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != conv or state is None:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = here, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield _digest_batch(done)
        if state is not None:
            yield _digest_batch([(conv, state.hexdigest())])

    line = F.concat_ws(":", "role", "text").alias("line")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "ord").select("conv_id", line)
    return ordered.mapInArrow(work, "conv_id long, repaired_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
        ["conv_id", "repaired_sha256"],
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts, cost and audit per conversation of ``conv_id, turn, role, text``; and the repaired turns."""
    found = keep(find_faults(rows))
    initial = F.substring("role", 1, 1)
    # The next row's initial comes over positions, so that no conversation is gathered.
    following = found.select("conv_id", (F.col("pos") - 1).alias("pos"), initial.alias("_next"))
    pair = F.concat(initial, F.col("_next"))
    of = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    illegal = found.join(following, ["conv_id", "pos"]).groupBy("conv_id").agg(
        F.count_if(~pair.isin("su", "ua", "au")).alias("illegal")
    )
    spans = found.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy(
        "conv_id"
    ).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # Codes travel as strings of up to 65,536 letters; a conversation's strings meet once.
    parts = found.groupBy("conv_id", F.floor(F.col("pos") / 65536).alias("_part")).agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])).alias("codes"),
        of("blank"), of("duplicate"), of("truncated"),
    )
    counts = parts.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("_part", "codes"))), lambda x: x["codes"])).alias("codes"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    coded = keep(counts)
    edits = keep(solve(coded))
    whole = coded.join(edits, "conv_id").join(illegal, "conv_id", "left").join(spans, "conv_id", "left")
    summary = whole.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
        F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit",
    )
    return summary, repaired_turns(found, whole.select("conv_id", "codes", "audit"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation after planted damage: its faults, the cheapest edits and the repaired digest."""
    summary, turns = repair(damaged(conversations))
    every = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(summary, "conv_id", "left").join(digests(turns), "conv_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
