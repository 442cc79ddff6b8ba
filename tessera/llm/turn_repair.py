"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A backward dynamic programme over (turn, grammar state) gives the cost to go; a forward walk then takes the
ASCII-least edit among those that keep to that cost. The grammar of role initials is ``(s?(ua)+)?``; edits are Keep (0), Rerole to user or
assistant (2), Delete (3; the only edit of a blank or duplicate turn) and Insert of an empty turn (2), and a
truncated turn that stays adds 1. Costs to go are kept relative to their minimum, of which there are few, so a
step of either direction is one lookup.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks. A task solves the
conversations that it holds whole. Those at the edges of its range may go on in other tasks: each stretch of such a one is
a 4 x 4 table of costs from state to state; tables are folded backwards to costs to go at the borders, each stretch is walked from
all four states, and a forward fold picks the walk. A fold takes one row for each stretch, so at most as many as there are tasks.

A null role or text reads as one space; null turns come first, null conv_ids are one conversation. Turns of one number come in the order of role, the first
64 characters of the text and its hash. A role that begins with none of s, u and a (also an empty one) can't be kept. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import plain_rows, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each state's own next role leads to, and that role's initial.
NEXT = (USER, USER, ASSISTANT, USER)
WANTED = ("u", "u", "a", "u")
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
FAR = 1 << 40
#: Codes of a walk: inserts and reroles with the role they give.
INSERT, REROLE = {"u": "i", "a": "j"}, {"u": "r", "a": "t"}
ROLES = {"i": "user", "j": "assistant", "r": "user", "t": "assistant"}
_SPACES = " \t\n\x0b\x0c\r"

Costs = tuple[int, int, int, int]


# ---------------------------------------------------------------- the programme


def settled(costs: list[int]) -> Costs:
    """Costs to go once turns may be inserted here."""
    for _ in range(3):
        costs = [min(c, 2 + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(min(c, FAR) for c in costs)


END = settled([0, FAR, FAR, 0])


def kept_state(initial: str, state: int) -> int | None:
    """Where keeping a turn leads, if the grammar lets it."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == WANTED[state] else None


@lru_cache(maxsize=1 << 16)
def before(after: Costs, initial: str, fault: int) -> Costs:
    """Costs to go before a turn, from those after it."""
    out = [3 + c for c in after]
    if fault in (FINE, TRUNCATED):
        for q in range(4):
            kept = kept_state(initial, q)
            out[q] = min(out[q], fault + 2 + after[NEXT[q]], FAR if kept is None else fault + after[kept])
    return settled(out)


@lru_cache(maxsize=1 << 16)
def relative(after: Costs, initial: str, fault: int) -> tuple[Costs, int]:
    """(costs before a turn less their minimum, that minimum)."""
    costs = before(after, initial, fault)
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


@lru_cache(maxsize=1 << 16)
def edits_at(after: Costs, initial: str, fault: int, state: int) -> tuple[str, int]:
    """(codes of the inserts before a turn and of its own edit, state after it): the ASCII-least of the tight ones."""
    costs, codes = before(after, initial, fault), ""
    while True:
        if costs[state] == 3 + after[state]:
            return codes + "D", state
        if costs[state] == 2 + costs[NEXT[state]]:
            codes += INSERT[WANTED[state]]
            state = NEXT[state]
            continue
        kept = kept_state(initial, state)
        if kept is not None and costs[state] == fault + after[kept]:
            return codes + "K", kept
        return codes + REROLE[WANTED[state]], NEXT[state]


def tail_from(state: int) -> str:
    """Codes of the inserts after the last turn."""
    codes = ""
    while END[state]:
        codes += INSERT[WANTED[state]]
        state = NEXT[state]
    return codes


def backwards(turns: list[tuple[str, int]], end: Costs) -> tuple[list[Costs], int, Costs]:
    """(relative costs after each of the turns (initial, fault), what the first ones are relative to, relative costs before the first)."""
    least = min(end)
    now, total, after = tuple(c - least if c < FAR else FAR for c in end), least, []
    for initial, fault in reversed(turns):
        after.append(now)
        now, least = relative(now, initial, fault)
        total += least
    return after[::-1], total, now


def walk(turns: list[tuple[str, int]], after: list[Costs], state: int) -> tuple[list[str], int]:
    """(codes at each turn, last state) from a state on."""
    out = []
    for (initial, fault), costs in zip(turns, after):
        codes, state = edits_at(costs, initial, fault, state)
        out.append(codes)
    return out, state


def letters(codes: str) -> str:
    return codes.translate(str.maketrans("ijrt", "IIRR"))


def applied(codes: str, role: str, text: str) -> list[tuple[str, str | None, str | None]]:
    """(edit, role, text) of a turn's codes; a deleted turn has neither."""
    out = []
    for c in codes:
        kept = (role if c == "K" else ROLES.get(c), "" if c in "ij" else text)
        out.append((letters(c), *(kept if c != "D" else (None, None))))
    return out


def fault_of(text: str) -> int:
    held = text.rstrip(_SPACES)
    return BLANK if not held else FINE if held[-1] in ".!?" else TRUNCATED


# ---------------------------------------------------------------- conversations that a task holds whole

_KEY = "known boolean, conv long"
_FIGURES = "gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string, repaired_sha256: string"
_TURNS = f"{_KEY}, part int, place long, turn long, role string, text string, fault int, mark binary, edit string, figures struct<{_FIGURES}>"


def _mark(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def _whole(rows: list[tuple], digest: bool) -> list[tuple]:
    """Turns (known, conv, turn, role, text) of one conversation to its figures, or to a row for each edit."""
    faults, seen, state = [], set(), START
    for *_, role, text in rows:
        fault = fault_of(text)
        if fault != BLANK:
            fault = DUPLICATE if (role, text) in seen else fault
            seen.add((role, text))
        faults.append(fault)
    turns = [(r[3][:1], f) for r, f in zip(rows, faults)]
    after, total, first = backwards(turns, END)
    codes, state = walk(turns, after, START)
    codes[-1] += tail_from(state)
    done = [(r, e) for r, c in zip(rows, codes) for e in applied(c, r[3], r[4])]
    key = rows[0][:2]
    if not digest:
        return [(*key, 0, k, r[2], role, text, None, None, edit, None) for k, (r, (edit, role, text)) in enumerate(done)]
    numbers = [r[2] for r in rows if r[2] is not None]
    text = "\n".join(f"{role}:{text}" for _, (edit, role, text) in done if edit != "D")
    figures = {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(turns, turns[1:])),
        "cost": total + first[START],
        "audit": letters("".join(codes)),
        "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    }
    return [(*key, 0, 0, *[None] * 6, figures)]


def _table(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), like)], schema=like)


_KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema(
    [(n, _KINDS[k]) for n, k in (p.split() for p in _TURNS.split(", figures")[0].split(", "))]
    + [("figures", pa.struct([(n, _KINDS[k]) for n, k in (p.split(": ") for p in _FIGURES.split(", "))]))]
)


def _solved(digest: bool):
    """Turns in order: conversations inside the task's range are solved; the turns of those at its edges go on with fault and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, held, first, out = None, [], True, []

        def edge() -> Iterator[tuple]:
            for k, (known, conv, turn, role, text) in enumerate(held):
                yield known, conv, part, k, turn, role, text, fault_of(text), _mark(role, text), None, None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if held:
                        out.extend(edge() if first else _whole(held, digest))
                        first = False
                    key, held = row[:2], []
                held.append(row)
            if len(out) >= 4096:
                yield _table(out, _ARROW)
                out = []
        out.extend(edge())
        if out:
            yield _table(out, _ARROW)

    return run


# ---------------------------------------------------------------- conversations at the edges of ranges


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (known, conv, part, turns) to (known, conv, part, initials, faults, costs from state to state)."""
    for batch in batches:
        out = []
        for known, conv, part, turns in zip(*(c.to_pylist() for c in batch.columns)):
            initials, faults = "".join(t["initial"] for t in turns), [t["fault"] for t in turns]
            table = []
            for end in range(4):
                _, total, first = backwards(list(zip(initials, faults)), settled([0 if q == end else FAR for q in range(4)]))
                table.append([min(c + total, FAR) for c in first])
            out.append((known, conv, part, initials, faults, [table[e][q] for q in range(4) for e in range(4)]))
        names = ["known", "conv", "part", "initials", "faults", "costs"]
        kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (known, conv, stretches (part, costs)) to (known, conv, part, end): costs to go after each stretch, by a backward fold."""
    for batch in batches:
        out = []
        for known, conv, stretches in zip(*(c.to_pylist() for c in batch.columns)):
            now, last = END, True
            for s in reversed(stretches):
                out.append((known, conv, s["part"], list(now), last))
                now, last = tuple(min(s["costs"][4 * q + e] + now[e] for e in range(4)) for q in range(4)), False
        names, kinds = ["known", "conv", "part", "end", "last"], [pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (known, conv, part, initials, faults, end, last) to (known, conv, part, exits, codes): a walk from each state, a comma after each turn."""
    for batch in batches:
        out = []
        for known, conv, part, initials, faults, end, last in zip(*(c.to_pylist() for c in batch.columns)):
            turns = list(zip(initials, faults))
            after, _, _ = backwards(turns, tuple(end))
            exits, codes = [], []
            for state in range(4):
                steps, left = walk(turns, after, state)
                if last:
                    steps[-1] += tail_from(left)
                exits.append(left)
                codes.append(",".join(steps))
            out.append((known, conv, part, exits, codes))
        names, kinds = ["known", "conv", "part", "exits", "codes"], [pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)


def _entered(stretches: Column) -> Column:
    """(part, state at its start) of each stretch (part, exits), by a forward fold."""
    empty = F.expr("cast(array() as array<struct<part: int, state: int>>)")
    start = F.struct(F.lit(START).alias("state"), empty.alias("done"))
    step = lambda a, s: F.struct(
        F.get(s["exits"], a["state"]).alias("state"), F.concat(a["done"], F.array(F.struct(s["part"].alias("part"), a["state"].alias("state")))).alias("done")
    )
    return F.aggregate(stretches, start, step)["done"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to (known, conv, audit, repaired_sha256), with no more than a batch held."""
    kinds = [pa.bool_(), pa.int64(), pa.string(), pa.string()]
    key, audit, digest, begun = None, [], None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, "".join(audit), digest.hexdigest()), kinds)], ["known", "conv", "audit", "repaired_sha256"])

    for batch in batches:
        for known, conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (known, conv) != key:
                if key is not None:
                    yield row()
                key, audit, digest, begun = (known, conv), [], hashlib.sha256(), False
            audit.append(edit)
            if edit != "D":
                digest.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
    if key is not None:
        yield row()


def _edges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, figures without audit and hash) of the conversations at the edges."""
    key = ["known", "conv"]
    at = F.col("part").cast("long") * (1 << 40) + F.col("place")
    firsts = turns.where(F.col("fault") != BLANK).groupBy(*key, "mark").agg(F.min(at).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & (F.col("first") < at), DUPLICATE).otherwise(F.col("fault"))
    initial = F.rpad(F.substring("role", 1, 1), 1, " ")
    judged = turns.join(firsts, [*key, "mark"], "left").select(*key, "part", "place", "turn", initial.alias("initial"), fault.alias("fault"))
    judged = written(judged, "judged")
    in_order = F.sort_array(F.collect_list(F.struct("place", "turn", "initial", "fault")))
    listed = written(judged.groupBy(*key, "part").agg(in_order.alias("turns")), "listed")
    stretches = listed.mapInArrow(_stretches, f"{_KEY}, part int, initials string, faults array<int>, costs array<long>")
    stretches = written(stretches, "stretches")
    costs = stretches.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("stretches"))
    ends = costs.mapInArrow(_borders, f"{_KEY}, part int, end array<long>, last boolean")
    walks = stretches.join(ends, [*key, "part"]).select(*key, "part", "initials", "faults", "end", "last")
    walks = written(walks.mapInArrow(_walks, f"{_KEY}, part int, exits array<int>, codes array<string>"), "walks")
    entered = walks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("s"))
    entered = entered.select(*key, F.explode(_entered(F.col("s"))).alias("e")).select(*key, "e.part", "e.state")
    chosen = walks.join(entered, [*key, "part"]).select(*key, "part", F.split(F.get("codes", "state"), ",").alias("codes"))
    steps = chosen.select(*key, "part", F.posexplode("codes").alias("p", "codes")).withColumn("place", F.col("p").cast("long"))
    each = turns.join(steps, [*key, "part", "place"]).select(*key, "part", "place", "turn", "role", "text", F.posexplode(F.split("codes", "")).alias("k", "code"))
    each = each.where("code <> ''")
    given = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    kept = F.when(F.col("code") == "K", F.col("role")).otherwise(F.try_element_at(given, F.col("code")))
    text = F.when(F.col("code").isin("i", "j"), "").when(F.col("code") != "D", F.col("text"))
    edits = each.select(*key, "part", "place", "k", "turn", F.translate("code", "ijrt", "IIRR").alias("edit"), kept.alias("role"), text.alias("text"))
    # Figures: sums over stretches, and what happens at their borders.
    inner = "aggregate(sequence(1, size(turns) - 1), 0L, (n, i) -> n + if(array_contains(array('su', 'ua', 'au'), concat(turns[i - 1].initial, turns[i].initial)), 0, 1))"
    per = listed.select(
        *key,
        "part",
        F.expr(f"if(size(turns) > 1, {inner}, 0L)").alias("inside"),
        F.expr("turns[0].initial").alias("head"),
        F.expr("turns[size(turns) - 1].initial").alias("foot"),
        *[F.expr(f"cast(size(filter(turns, t -> t.fault = {f})) as long)").alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))],
    )
    per = per.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("inside", "blank", "duplicate", "truncated")], F.sort_array(F.collect_list(F.struct("part", "head", "foot"))).alias("b"))
    across = F.expr("if(size(b) > 1, aggregate(sequence(1, size(b) - 1), 0L, (n, i) -> n + if(array_contains(array('su', 'ua', 'au'), concat(b[i - 1].foot, b[i].head)), 0, 1)), 0L)")
    numbers = judged.select(*key, "turn").distinct().groupBy(*key).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    cost = costs.select(*key, F.explode("stretches").alias("s")).select(*key, "s.part", "s.costs").join(ends, [*key, "part"])
    least = F.array_min(F.zip_with(F.slice("costs", 1, 4), "end", lambda a, b: a + b))
    cost = cost.select(*key, F.struct("part", least.alias("least")).alias("c")).groupBy(*key).agg(F.min("c")["least"].alias("cost"))
    figures = per.withColumn("illegal", F.col("inside") + across).drop("inside", "b").join(numbers, key).join(cost, key)
    return edits, figures


# ---------------------------------------------------------------- repair


def _in_order(rows: DataFrame, digest: bool) -> DataFrame:
    turns = plain_rows(rows, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").isNotNull().alias("known"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = ["known", "conv", "turn", "role", F.left("text", F.lit(64)), F.xxhash64("text")]
    # Equal turns are dealt apart, too; which of them comes first makes no difference.
    dealt = turns.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(_solved(digest), _TURNS), "solved")


def _conv_id() -> Column:
    return F.when(F.col("known"), F.col("conv")).alias("conv_id")


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation of rows (conv_id, turn, role, text): conv_id, place (long, rising), turn (of the row edited or inserted before), edit, role, text.

    A deleted turn has neither role nor text; without such rows, the rest in order of place is the repaired conversation.
    """
    solved = _in_order(rows, digest=False)
    edits, _ = _edges(solved.where("mark is not null"))
    number = (F.col("part").cast("long") * (1 << 40) + F.col("place")) * 8 + F.col("k")
    at_edges = edits.select(_conv_id(), number.alias("place"), "turn", "edit", "role", "text")
    return solved.where("mark is null").select(_conv_id(), "place", "turn", "edit", "role", "text").unionByName(at_edges)


def audited(rows: DataFrame) -> DataFrame:
    """The figures of each conversation of rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    names = [p.split(": ")[0] for p in _FIGURES.split(", ")]
    solved = _in_order(rows, digest=True)
    edits, figures = _edges(solved.where("mark is not null"))
    ordered = edits.repartition("known", "conv").sortWithinPartitions("known", "conv", "part", "place", "k").select("known", "conv", "edit", "role", "text")
    hashed = ordered.mapInArrow(_hashed, f"{_KEY}, audit string, repaired_sha256 string")
    at_edges = figures.join(hashed, ["known", "conv"]).select(_conv_id(), *names)
    return solved.where("figures is not null").select(_conv_id(), "figures.*").unionByName(at_edges)


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults by crc32 of ``conv_id:turn`` modulo 20; nulls read as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text, kind = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("kind")
    hurt = plain_rows(rows, "conv_id", "turn", "role", "text").withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0")
    return hurt.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every conv_id."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = audited(damaged(rows)).withColumnRenamed("conv_id", "id")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    none = hashlib.sha256(b"").hexdigest()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB: crc32 by bits, and a forward walk that keeps each state's cheapest, ASCII-least edits, one turn of all conversations at a time."""
    ins = lambda q, role: f"CASE WHEN {q} IS NOT NULL THEN {{'c': {q}.c + 2, 'a': {q}.a || 'I', 't': {q}.t || chr(10) || '{role}:'}} END"
    gone = lambda q: f"CASE WHEN {q} IS NOT NULL THEN {{'c': {q}.c + 3, 'a': {q}.a || 'D', 't': {q}.t}} END"
    kept = lambda q, initial: f"CASE WHEN {q} IS NOT NULL AND f < 2 AND ini = '{initial}' THEN {{'c': {q}.c + f, 'a': {q}.a || 'K', 't': {q}.t || chr(10) || role || ':' || text}} END"
    other = lambda q, role: f"CASE WHEN {q} IS NOT NULL AND f < 2 THEN {{'c': {q}.c + f + 2, 'a': {q}.a || 'R', 't': {q}.t || chr(10) || '{role}:' || text}} END"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    u = [gone("q2")] + [g("q" + k) for k in "013" for g in (lambda q: kept(q, "u"), lambda q: other(q, "user"))]
    return rf"""
with recursive bits as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_reduce([4294967295::bigint] || flatten(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
      lambda x: list_transform(range(8), lambda k: (ord(x) >> k) & 1))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) as c
  from conversations
),
hurt as (
  select conv_id, turn, xor(c, 4294967295) % 20 as kind, role, text from bits
),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from hurt where kind <> 0
),
placed as (
  select *, row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as same,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final
  from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)
),
judged as (
  select *, case when final = '' then 2 when same > 1 then 3 when final in ('.', '!', '?') then 0 else 1 end as f, left(role, 1) as ini,
    lag(left(role, 1)) over (partition by conv_id order by i) as before
  from placed
),
walk as (
  select conv_id, 0::bigint as i, {{'c': 0, 'a': '', 't': ''}} as q0, null::struct(c integer, a varchar, t varchar) as q1,
    {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}} as q2, {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} as q3
  from (select distinct conv_id from conversations)
  union all
  select conv_id, i, q0, q1, q2, {least("q3", ins("q2", "assistant"))} from (
    select conv_id, i, q0, q1, {least("q2", ins("q0", "user"), ins("q1", "user"), ins("q3", "user"))} as q2, q3 from (
      select w.conv_id, j.i, {gone("q0")} as q0, {least(gone("q1"), kept("q0", "s"))} as q1,
        {least(*u)} as q2, {least(gone("q3"), kept("q2", "a"), other("q2", "assistant"))} as q3
      from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1
    )
  )
),
ended as (select conv_id, {least("q0", "q3")} as q from walk where i = (select count(*) from judged j where j.conv_id is not distinct from walk.conv_id)),
figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = 2) as blank, count(*) filter (where f = 3) as duplicate,
    count(*) filter (where f = 1) as truncated, count(*) filter (where before is not null and before || ini not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, q.c::bigint as cost, q.a as audit, sha256(substr(q.t, 2)) as repaired_sha256
from ended e left join figures g on g.conv_id is not distinct from e.conv_id
"""


OP11_SQL = _sql()
