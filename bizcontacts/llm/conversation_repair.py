"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

A repaired conversation is empty, or an optional system turn followed by pairs of user and
assistant. Each turn is kept, given another role or deleted, and empty turns may be inserted; the
edits with the least cost win, among equals those whose initials sort first.

Rank-convergence parallel Viterbi: turns are cut into chunks. What the turns after a chunk will cost
is unknown to it, so it starts from speculative cost vectors, one per state, and works backward.
Where the results differ only by constants, the chunk's answer holds for whatever follows. Chunks
that did not converge are fixed up in passes, each with the vectors of the stretch after it, so
that the stretch known doubles with every pass. With the backward costs stitched, tracing forward
takes the least edit at each turn that still leads to the least cost; the state a chunk is entered
in is found by the same passes, from the states it is left in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizcontacts.llm.common import Scratch, map_batches, ship
from bizcontacts.llm.ranking import ranked

CHUNK = 4096
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
SPACES = " \t\n\x0b\f\r"

# States by what has been written: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# the state an inserted or reroled turn leads to
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
# what a speculative vector costs at the other states: more than any two real costs of one place differ
FAR = 64


def _closed(w: list[int]) -> list[int]:
    """Costs where empty turns may be inserted first; a third insertion only comes back."""
    once = [min(w[q], INSERT + w[NEXT[q]]) for q in STATES]
    return [min(once[q], INSERT + once[NEXT[q]]) for q in STATES]


# Costs after the last turn: only the empty and the assistant state may end.
END = _closed([0, NEVER, NEVER, 0])


def _kept(initial: str, state: int) -> int | None:
    """State after a turn is kept; None where its role does not fit."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _before(initial: str, fault: str, v: list[int]) -> list[int]:
    """Costs before a turn from the costs ``v`` after it."""
    w = [DELETE + c for c in v]
    if fault not in "bd":
        extra = CUT_OFF if fault == "t" else 0
        for q in STATES:
            w[q] = min(w[q], extra + REROLE + v[NEXT[q]])
            k = _kept(initial, q)
            if k is not None:
                w[q] = min(w[q], extra + v[k])
    return _closed(w)


def _parallel(vectors: list[list[int]]) -> bool:
    first = vectors[0]
    return all(len({a - b for a, b in zip(v, first, strict=True)}) == 1 for v in vectors[1:])


def speculate(roles: str, faults: str) -> list[list[int]]:
    """Costs before a chunk for each speculative vector after it; one is enough once all are parallel."""
    vectors = [[0 if q == k else FAR for q in STATES] for k in STATES]
    shift = None
    for initial, fault in zip(reversed(roles), reversed(faults), strict=True):
        vectors = [_before(initial, fault, v) for v in vectors]
        if shift is None and _parallel(vectors):
            shift = [v[0] - vectors[0][0] for v in vectors]
            vectors = vectors[:1]
    return vectors if shift is None else [[c + s for c in vectors[0]] for s in shift]


def trace(roles: str, faults: str, end: list[int], state: int, last: bool) -> tuple[str, int]:
    """(edit initials, state left in) of a chunk entered in ``state``, least initials first.

    Insertions after the last turn of a chunk are left to the next one, but for the last chunk.
    """
    costs = [end]
    for initial, fault in zip(reversed(roles), reversed(faults), strict=True):
        costs.append(_before(initial, fault, costs[-1]))
    costs.reverse()
    out, at, n = [], 0, len(roles)
    while at < n or last:
        here = costs[at]
        if at < n and DELETE + costs[at + 1][state] == here[state]:
            out.append("D")
            at += 1
        elif INSERT + here[NEXT[state]] == here[state]:
            out.append("I")
            state = NEXT[state]
        elif at == n:
            break
        else:
            extra = CUT_OFF if faults[at] == "t" else 0
            k = _kept(roles[at], state)
            if k is not None and extra + costs[at + 1][k] == here[state]:
                out.append("K")
                state = k
            else:
                out.append("R")
                state = NEXT[state]
            at += 1
    return "".join(out), state


def turn_faults(text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no character but white space; the last other character ends no sentence."""
    bare = F.rtrim(text, F.lit(SPACES))
    return bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")


def damage_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) damaged by the crc32 of ``conv_id:turn`` mod 20; a null is one space.

    0 drops a row, 1 empties its text, 2 takes out sentence ends, 3 repeats it, 4 makes it the user's.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rule = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    hit = turns.select("conv_id", "turn", named[2].alias("role"), named[3].alias("text"), rule.alias("rule"))
    text = (F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (hit.filter("rule <> 0").withColumn("copy", F.explode(copies))
            .select("conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text")))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """(conv, chunk, roles, faults): one character per turn each, so a chunk is a short text."""
    seen = (rows.groupBy("conv", "role", "digest").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
            .filter("n > 1").drop("n"))
    initial = F.left("role", F.lit(1))
    fault = (F.when(F.col("blank"), "b").when(F.col("idx") > F.col("first"), "d")
             .when(F.col("truncated"), "t").otherwise("-"))
    coded = rows.drop("text").join(seen, ["conv", "role", "digest"], "left").select(
        "conv", F.expr(f"idx div {size}").alias("chunk"), "idx",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    held = F.sort_array(F.collect_list(F.struct("idx", "initial", "fault")))
    grouped = coded.groupBy("conv", "chunk").agg(held.alias("t"))
    return grouped.select("conv", "chunk", F.array_join("t.initial", "").alias("roles"),
                          F.array_join("t.fault", "").alias("faults"))


def _settle(table: DataFrame, value: str, done: Callable[[Column], Column],
            composed: Callable[[Column, Column], Column], step: int, scratch: Scratch) -> DataFrame:
    """Passes over (conv, chunk, value) until each value holds whatever lies beyond, ``step`` +1 or -1 away."""
    span = 1
    table = scratch.save(table, value)
    while not table.filter(~done(F.col(value))).isEmpty():
        beyond = table.select("conv", (F.col("chunk") - step * span).alias("chunk"), F.col(value).alias("beyond"))
        passed = F.when(done(F.col(value)), F.col(value)).otherwise(composed(F.col(value), F.col("beyond")))
        after = scratch.save(table.join(beyond, ["conv", "chunk"], "left").select(
            "conv", "chunk", passed.alias(value)), value)
        scratch.drop(table)
        table, span = after, 2 * span
    return table


def _parallel_sql(v: Column) -> Column:
    first = v[0]
    return F.forall(v, lambda c: F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: c[i] - c[0] == first[i] - first[0]))


def _costs_beyond(own: Column, beyond: Column) -> Column:
    """Costs before a stretch for each vector after the one beyond it: the least sum over the states between."""
    states = F.sequence(F.lit(0), F.lit(3))
    return F.transform(beyond, lambda n: F.transform(states, lambda i: F.array_min(
        F.transform(states, lambda k: n[k] + own[k][i]))))


def _stitched(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Chunks with the costs after them (end) and the state they are entered in (entry)."""
    def costs(batch):
        out = []
        for roles, faults, last in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "last")), strict=True):
            vectors = speculate(roles, faults)
            if last:  # what follows is known, so all four are the same
                vectors = [[min(END[k] + vectors[k][i] for k in STATES) for i in STATES]] * 4
            out.append(vectors)
        return {"conv": batch.column("conv"), "chunk": batch.column("chunk"), "costs": out}

    solved = _settle(map_batches(chunks, "conv long, chunk long, costs array<array<long>>", costs),
                     "costs", _parallel_sql, _costs_beyond, 1, scratch)
    # costs after a chunk are those before the next one, from whose least value they count
    least = F.array_min(F.col("costs")[0])
    after = solved.select("conv", (F.col("chunk") - 1).alias("chunk"),
                          F.transform(F.col("costs")[0], lambda c: c - least).alias("end"))
    accept = F.array(*[F.lit(c).cast("long") for c in END])
    chunks = scratch.save(chunks.join(after, ["conv", "chunk"], "left").withColumn("end", F.coalesce("end", accept)),
                          "ends")

    def exits(batch):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("chunk", "roles", "faults", "end", "last"))
        for chunk, roles, faults, end, last in zip(*columns, strict=True):
            out.append([trace(roles, faults, end, q if chunk else START, last)[1] for q in STATES])
        return {"conv": batch.column("conv"), "chunk": batch.column("chunk"), "exits": out}

    left = _settle(map_batches(chunks, "conv long, chunk long, exits array<int>", exits), "exits",
                   lambda e: F.forall(e, lambda x: x == e[0]),
                   lambda own, beyond: F.transform(beyond, lambda q: own[q]), -1, scratch)
    before = left.select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("exits")[0].alias("entry"))
    return chunks.join(before, ["conv", "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))


def conversation_edits(turns: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """The edits that repair each conversation, in order: (conv_id, chunk, place, edit, fault, turn, given_role, role, text).

    ``turns`` has conv_id, turn, role, text. Turns stand in the order of their number, null first;
    equal numbers in the order of role and the hash of the text; rows equal in all are exchangeable. ``edit`` is
    K(eep), R(erole), D(elete) or I(nsert); ``fault`` the first that holds of b(lank), d(uplicate: role and
    text came before), t(runcated) or ``-``. Deleted rows have no new role, inserted ones no turn.
    Only roles that begin with s, u or a can be kept; null roles and texts count as empty; rows of
    a null conv_id are one conversation. No rows, no edits; other columns are not read.

    Conversations may be of any length: they are ranked by range, cut into chunks and repaired
    chunk by chunk, wherever the chunk lies.
    """
    conv_type = turns.schema["conv_id"].dataType
    text = F.coalesce("text", F.lit(""))
    blank, truncated = turn_faults(text)
    ready = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                         text.alias("text"), blank.alias("blank"), truncated.alias("truncated"),
                         F.sha2(text, 256).alias("digest"))
    rows = ranked(ready, "conv_id", ["turn", "role", "digest"], scratch).withColumnRenamed("group_no", "conv")
    chunks = _chunks(rows, chunk)
    ends = chunks.groupBy("conv").agg(F.max("chunk").alias("top"))
    chunks = scratch.save(chunks.join(ends, "conv").withColumn("last", F.col("chunk") == F.col("top")).drop("top"),
                          "chunks")
    whole = chunks.filter("last and chunk = 0").select(
        "*", F.array(*[F.lit(c).cast("long") for c in END]).alias("end"), F.lit(START).alias("entry"))
    cut = chunks.filter("not last or chunk > 0")
    if not cut.isEmpty():
        whole = whole.unionByName(_stitched(cut, scratch))

    def audit(batch):
        columns = (batch.column(c).to_pylist() for c in ("roles", "faults", "end", "entry", "last"))
        return {**{c: batch.column(c) for c in ("conv", "chunk", "entry", "faults")},
                "audit": [trace(*c)[0] for c in zip(*columns, strict=True)]}

    traced = map_batches(whole, "conv long, chunk long, entry int, faults string, audit string", audit)
    place = F.expr(f"idx div {chunk}").alias("chunk")
    said = rows.select("conv", place, "idx", "conv_id", "turn", "role", "text")
    both = said.unionByName(traced.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    out = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("chunk", T.LongType()), T.StructField("place", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("edit", "fault")], T.StructField("turn", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("given_role", "role", "text")]])
    return (both.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "idx")
            .select("chunk", "idx", "conv_id", "turn", "role", "text", "entry", "faults", "audit")
            .mapInArrow(_applied(out), out))


def _applied(out: T.StructType) -> Callable:
    """Stream of chunks, each its audit followed by its turns, into edits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(batches):
        audit, faults, state, at, place, held = "", "", START, 0, 0, (None, 0)
        made: list[tuple] = []

        def until_turn(stop: bool):
            """Insertions at hand; in front of a turn, or behind the last one."""
            nonlocal at, state, place
            while at < len(audit) and (audit[at] == "I" or stop):
                state = NEXT[state]
                made.append((*held, place, "I", None, None, None, ROLE[state], ""))
                at, place = at + 1, place + 1

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)
            made.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if r["idx"] < 0:
                    until_turn(True)
                    audit, faults, state, at, place = r["audit"], r["faults"], r["entry"], 0, 0
                    turn_no = 0
                    continue
                held = (r["conv_id"], r["chunk"])
                until_turn(False)
                edit, role, text = audit[at], r["role"], r["text"]
                if edit == "D":
                    role = text = None
                elif edit == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                else:
                    state = _kept(role[:1], state)
                made.append((*held, place, edit, faults[turn_no], r["turn"], r["role"], role, text))
                at, place, turn_no = at + 1, place + 1, turn_no + 1
                if len(made) >= 500:
                    yield flush()
        until_turn(True)
        if made:
            yield flush()

    return run


LEGAL = {"su", "ua", "au"}


def repair_digest(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, counts of faults, cost, audit and hash of the repaired turns.

    Edits stream by in order, so even a very long conversation is held by none but its audit. A
    conversation without edits gets zeros, no audit and the hash of nothing.
    """
    ship(edits.sparkSession)
    known = conversations.select("conv_id").distinct().withColumn("chunk", F.lit(-1).cast("long"))
    both = (edits.unionByName(known, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions("conv_id", "chunk", "place"))
    kind = T.StructType([edits.schema["conv_id"], *[
        T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(kind)
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches):
        conv, state = None, None

        def fresh():
            return {"gaps": 0, "b": 0, "d": 0, "t": 0, "-": 0, "illegal": 0, "cost": 0, "audit": [],
                    "sha": hashlib.sha256(), "lines": 0, "initial": None, "turn": None}

        def emit():
            s = state
            row = [conv, s["gaps"], s["b"], s["d"], s["t"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target, strict=True)], schema=target)

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        yield emit()
                    conv, state = r["conv_id"], fresh()
                s, edit = state, r["edit"]
                if edit is None:
                    continue
                s["audit"].append(edit)
                s["cost"] += price[edit]
                if edit != "I":
                    s[r["fault"]] += 1
                    if edit != "D" and r["fault"] == "t":
                        s["cost"] += CUT_OFF
                    initial = r["given_role"][:1]
                    if s["initial"] is not None and s["initial"] + initial not in LEGAL:
                        s["illegal"] += 1
                    s["initial"] = initial
                    if r["turn"] is not None:
                        # turns ascend: what lies between two neighbours is missing
                        if s["turn"] is not None and r["turn"] > s["turn"]:
                            s["gaps"] += r["turn"] - s["turn"] - 1
                        s["turn"] = r["turn"]
                if edit != "D":
                    line = f"{r['role']}:{r['text']}"
                    s["sha"].update((("\n" if s["lines"] else "") + line).encode("utf-8", "surrogatepass"))
                    s["lines"] += 1
        if state is not None:
            yield emit()

    return both.mapInArrow(run, kind)
