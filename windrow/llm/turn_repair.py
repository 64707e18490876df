"""Repair of a conversation's structure by the cheapest edits, found with iterative-deepening A*.

A repaired conversation has the roles ``(s?(ua)+)?`` by initial.  Edits and their costs: keep a row (0), give it the role the place asks for
(1), delete it (2; the only edit for blank and repeated rows), insert an empty row (5); a truncated row that stays costs 5 more.

Rows of a conversation are cut in blocks of ``BLOCK`` rows, so that a conversation of any length is shared by many tasks.  The place in the
pattern has four states, so a block's least costs are a 4 x 4 table; running folds of these tables (:mod:`windrow.llm.scans`) give every block
the exact cost of what follows it.  Each block is then searched from each state it may be entered in, and a second fold of the found
exits picks the entered one.  Insertions belong to the row after them, so that blocks and the whole search agree on the order of edits.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import BLANK, stored
from windrow.llm.scans import Fold, running

BLOCK = 128
#: fixed values: costs of the edits
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: places in the pattern: nothing yet, after a leading system turn, after a user turn, after an assistant turn; next place by role initial
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ASKED = ("u", "u", "a", "u")
ENDS = (True, False, False, True)
NEVER = 1 << 40

#: row codes: initial s, u, a or x (any other), upper case if truncated; "-" if it must be deleted
CODES = "suaxSUAX-"


def moves(code: str, place: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next place, rows taken) in ASCII order of the edit."""
    role, late = code.lower(), TRUNCATED if code.isupper() else 0
    asked = NEXT[place][ASKED[place]]
    out = [("D", DELETE, place, 1), ("I", INSERT, asked, 0)]
    if code != "-":
        if role in NEXT[place]:
            out.append(("K", KEEP + late, NEXT[place][role], 1))
        out.append(("R", REROLE + late, asked, 1))
    return out


MOVES = {code: tuple(tuple(moves(code, p)) for p in range(4)) for code in CODES}


def closing() -> tuple[int, ...]:
    """Least cost to end the pattern from each place when no row is left."""
    return tuple(0 if ENDS[p] else INSERT * (1 + (not ENDS[NEXT[p][ASKED[p]]])) for p in range(4))


def cost_table(codes: str) -> tuple[int, ...]:
    """Least cost of the rows from each place (16 numbers, by entry and exit); insertions only before rows."""
    table = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for code in codes:
        step = []
        for place in range(4):
            best = [NEVER] * 4
            spent, at = 0, place
            for _ in range(4):  # insertions run through at most the four places
                for edit, cost, then, taken in MOVES[code][at]:
                    if taken:
                        best[then] = min(best[then], spent + cost)
                spent, at = spent + INSERT, NEXT[at][ASKED[at]]
            step.append(best)
        table = [[min(row[k] + step[k][j] for k in range(4)) for j in range(4)] for row in table]
    return tuple(min(x, NEVER) for row in table for x in row)


def joined_tables(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    return tuple(min(NEVER, min(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4))


def search(codes: str, place: int, after: Sequence[int], last: bool) -> tuple[str, int, int]:
    """Edits, exit place and cost (without ``after``) of the cheapest edits of ``codes`` entered at ``place``; ties: the ASCII-least edits.

    ``after``: exact cost of all that follows, by exit place.  Iterative-deepening A*: depth first in ASCII order of the edits under a cost
    bound, which starts at the estimate and rises to the least cost that exceeded it; the first accepting path is the answer.  The estimate
    of the rows left is the sum of each row's own least cost (a row that must go or is truncated 2, one of another role 1).  A state (row,
    place) that failed under some remaining cost is not entered again with as little or less.  Only in the last block may insertions follow the rows.
    """
    n = len(codes)
    left = [min(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (DELETE if codes[i] == "-" or codes[i].isupper() else REROLE if codes[i] == "x" else 0)
    bound = left[0]
    while True:
        failed: dict[int, int] = {}
        beyond = NEVER
        # explicit stack: (row, place, spent, moves left to try, edit that led here)
        stack = [(0, place, 0, iter(_steps(codes, 0, place, last)), "")]
        while stack:
            row, at, spent, rest, _ = stack[-1]
            if row == n and (ENDS[at] if last else True) and spent + (0 if last else after[at]) <= bound:
                return "".join(s[4] for s in stack), at, spent
            for edit, cost, then, taken in rest:
                now, to = spent + cost, row + taken
                guess = now + (after[then] if to == n and not last else left[to])
                if guess > bound:
                    beyond = min(beyond, guess)
                    continue
                key = to * 4 + then
                if failed.get(key, -1) >= bound - now:
                    continue
                stack.append((to, then, now, iter(_steps(codes, to, then, last)), edit))
                break
            else:
                key = row * 4 + at
                failed[key] = max(failed.get(key, -1), bound - spent)
                stack.pop()
        bound = beyond


def _steps(codes: str, row: int, place: int, last: bool) -> tuple:
    if row < len(codes):
        return MOVES[codes[row]][place]
    return (("I", INSERT, NEXT[place][ASKED[place]], 0),) if last else ()


def repaired(rows: Sequence[tuple[str, str]], edits: str, place: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    names, given = {"u": "user", "a": "assistant"}, iter(rows)
    for edit in edits:
        role, text = (names[ASKED[place]], "") if edit == "I" else next(given)
        if edit == "D":
            continue
        if edit == "R":
            role = names[ASKED[place]]
        place = NEXT[place][role[:1] if edit == "K" else ASKED[place]]
        yield role, text


def _tables() -> Fold:
    """Fold of cost tables from the end of a conversation: the later block stands in front of what is folded already."""
    names = tuple((f"t{k}", "long") for k in range(16))
    unit = tuple(0 if i == j else NEVER for i in range(4) for j in range(4))
    return Fold(("codes",), names, cost_table, lambda later, earlier: joined_tables(earlier, later), tuple, tuple, unit)


def _exits() -> Fold:
    """Fold of the maps from entry to exit place."""
    return Fold(("x0", "x1", "x2", "x3"), tuple((f"m{k}", "int") for k in range(4)), lambda *m: m, lambda a, b: tuple(b[k] for k in a), tuple, tuple, (0, 1, 2, 3))


def _turns() -> Fold:
    """Running number of rows and the role initial of the latest."""
    return Fold(("initial",), (("position", "long"), ("latest", "string")), lambda i: (1, i), lambda a, b: (a[0] + b[0], b[1] if b[0] else a[1]), tuple, tuple, (0, None))


def pair_digest() -> Column:
    """32 bytes that name a role and a text."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def turn_codes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, tie, role, text; no nulls but in conv_id and turn) without their texts, with pair, position, initial, previous initial, fault and code.

    Order in a conversation: turn, null first, then ``tie`` and the digest ``pair`` of role and text, so that only equal rows are exchangeable.  fault:
    blank (nothing but white space), duplicate (role and text of an earlier row) or truncated (last visible character not ``.``, ``!`` or ``?``), the
    first that holds, else null.
    """
    seen = F.regexp_extract("text", rf"([^{BLANK}])[{BLANK}]*\z", 1)
    narrow = rows.select("conv_id", "turn", "tie", pair_digest().alias("pair"), F.substring("role", 1, 1).alias("initial"), seen.alias("closing"))
    placed = running(narrow, "conv_id", ["turn", "tie", "pair"], _turns(), "repair-turns").withColumnRenamed("latest_before", "previous")
    first = placed.groupBy("conv_id", "pair").agg(F.min("position").alias("first"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.pair") == F.col("b.pair"))
    both = placed.alias("a").join(first.alias("b"), same).select("a.*", F.col("b.first"))
    fault = F.when(F.col("closing") == "", "blank").when(F.col("position") > F.col("first"), "duplicate").when(~F.col("closing").isin(".", "!", "?"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return both.withColumn("fault", fault).select("conv_id", "turn", "tie", "pair", "position", "initial", "previous", "fault", code.alias("code"))


def repair_plan(coded: DataFrame) -> DataFrame:
    """(conv_id, block, entry, edits, cost) of every block of every conversation in ``coded`` (conv_id, position from 1, code)."""
    blocks = coded.groupBy("conv_id", F.floor((F.col("position") - 1) / BLOCK).cast("long").alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "code"))), lambda s: s["code"]), "").alias("codes"))
    tables = running(blocks, "conv_id", ["block"], _tables(), "repair-costs", descending=True)
    end = closing()
    names = [f"t{k}_before" for k in range(16)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = [0 if i == j else NEVER for i in range(4) for j in range(4)]
        known: dict[tuple, tuple] = {}
        for batch in batches:
            out: dict[str, list] = {f"{x}{p}": [] for p in range(4) for x in "xec"}
            columns = batch.to_pydict()
            for k, (block, codes) in enumerate(zip(columns["block"], columns["codes"])):
                table = [columns[n][k] for n in names]
                last = table == unit
                after = end if last else tuple(min(table[4 * i + j] + end[j] for j in range(4)) for i in range(4))
                for p in range(4):
                    if block == 0 and p:  # a conversation begins at place 0
                        found = ("", 0, 0)
                    else:
                        key = (codes, p, after, last)
                        found = known.get(key) or search(codes, p, after, last)
                        if len(known) < 20_000:  # short conversations are often alike
                            known[key] = found
                    for x, v in zip("exc", found):
                        out[f"{x}{p}"].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *[pa.array(out[f"x{p}"], pa.int32()) for p in range(4)],
                                              *[pa.array(out[f"e{p}"], pa.string()) for p in range(4)], *[pa.array(out[f"c{p}"], pa.int64()) for p in range(4)]],
                                             names=["conv_id", "block", *[f"x{p}" for p in range(4)], *[f"e{p}" for p in range(4)], *[f"c{p}" for p in range(4)]])

    schema = "conv_id long, block long, x0 int, x1 int, x2 int, x3 int, e0 string, e1 string, e2 string, e3 string, c0 long, c1 long, c2 long, c3 long"
    found = tables.select("conv_id", "block", "codes", *names).mapInArrow(run, schema)
    entered = running(found, "conv_id", ["block"], _exits(), "repair-exits")
    pick = lambda x: F.element_at(F.array(*[f"{x}{p}" for p in range(4)]), F.col("m0_before") + 1)
    return stored(entered.select("conv_id", "block", F.col("m0_before").alias("entry"), pick("e").alias("edits"), pick("c").alias("cost")), "repair-plan")


def repaired_digest(rows: DataFrame, coded: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired ``role:text`` lines joined by line feeds.

    Texts are shuffled once, in the order of the conversation; a block's plan is sorted in front of its first row.  A task holds the plans that
    are due and one batch of rows; the digest of one conversation is by its definition one stream.
    """
    starts = coded.where((F.col("position") - 1) % BLOCK == 0).select(
        F.col("conv_id").alias("of"), F.floor((F.col("position") - 1) / BLOCK).cast("long").alias("at"), "turn", "tie", "pair")
    marks = plan.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).select(
        "conv_id", "turn", "tie", "pair", "block", F.lit("").alias("role"), F.lit("").alias("text"), "edits", "entry")
    lines = rows.select("conv_id", "turn", "tie", pair_digest().alias("pair"), F.lit(None).cast("long").alias("block"), "role", "text", F.lit(None).cast("string").alias("edits"),
                        F.lit(None).cast("int").alias("entry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current, digest, written = False, None, None, 0
        due: deque[tuple[str, int]] = deque()
        edits, place, at = "", 0, 0

        def line(role: str, text: str) -> None:
            nonlocal written
            digest.update(("\n" if written else "").encode() + role.encode() + b":")
            digest.update(text.encode())
            written += 1

        def insertions() -> None:
            nonlocal at, place
            while at < len(edits) and edits[at] == "I":
                line("user" if ASKED[place] == "u" else "assistant", "")
                place, at = NEXT[place][ASKED[place]], at + 1

        for batch in batches:
            out = []
            c = batch.to_pydict()
            for conv, role, text, plan_edits, entry in zip(c["conv_id"], c["role"], c["text"], c["edits"], c["entry"]):
                if not started or conv != current:
                    if started:
                        insertions()
                        out.append((current, digest.hexdigest()))
                    started, current, digest, written = True, conv, hashlib.sha256(), 0
                    edits, at = "", 0
                if plan_edits is not None:
                    due.append((plan_edits, entry))
                    continue
                if at == len(edits):
                    (edits, place), at = due.popleft(), 0
                insertions()
                edit = edits[at]
                at += 1
                if edit != "D":
                    if edit == "R":
                        role = "user" if ASKED[place] == "u" else "assistant"
                    place = NEXT[place][role[:1]]
                    line(role, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if started:
            insertions()
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "tie", "pair", F.col("block").asc_nulls_last()]
    return lines.unionByName(marks).repartition(parts, "conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "edits", "entry").mapInArrow(
        run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation in ``conversations`` (conv_id; distinct, null is one too): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` as for :func:`turn_codes`.  gaps: missing turns between the least and the greatest, nulls ignored.  illegal: neighbours whose role
    initials are not su, ua or au (a role without characters has none).  audit: the edits' initials (D, I, K, R).  A conversation without
    rows has zeros, an empty audit and the digest of nothing.
    """
    rows = stored(rows.select("conv_id", "turn", "tie", "role", "text"), "repair-rows")
    coded = stored(turn_codes(rows), "repair-codes")
    plan = repair_plan(coded)
    counts = coded.groupBy("conv_id").agg(*[F.count_if(F.col("fault").eqNullSafe(F.lit(f))).alias(f) for f in ("blank", "duplicate", "truncated")],
                                           F.count_if((F.col("position") > 1) & ~F.concat("previous", "initial").isin("su", "ua", "au")).alias("illegal"))
    # distinct turns are counted from (conversation, turn) groups, so that a conversation of any length combines before its shuffle
    turns = coded.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    audits = plan.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "edits"))), lambda s: s["edits"]), "").alias("audit"))
    out = conversations.select("conv_id")
    for k, more in enumerate((counts, turns, audits, repaired_digest(rows, coded, plan))):
        more = more.withColumnRenamed("conv_id", f"c{k}")
        out = out.join(more, out["conv_id"].eqNullSafe(more[f"c{k}"]), "left").drop(f"c{k}")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame, kind: Column) -> DataFrame:
    """Rows of ``conversations`` with the damage ``kind`` names: 0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it,
    4 makes its role user.  Null roles and texts are one space.  ``tie`` orders rows of one turn by their undamaged role and text."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                                F.coalesce(F.col("text").cast("string"), space).alias("text"))
    kept = rows.withColumn("kind", kind).where("kind <> 0")
    tie = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.select("conv_id", "turn", tie.alias("tie"), role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _sql() -> str:
    """The same result in SQL: least (cost, edits) for every row and place by recursion over the rows."""
    steps = []
    for code in CODES:
        for place in range(4):
            lead, lines, spent, at = "", "", 0, place
            for _ in range(3):
                for edit, cost, then, taken in MOVES[code][at]:
                    if taken:
                        steps.append((code, place, lead + edit, spent + cost, then, lines, edit, ASKED[at]))
                lines += "user:~" if ASKED[at] == "u" else "assistant:~"
                lead, spent, at = lead + "I", spent + INSERT, NEXT[at][ASKED[at]]
    values = ", ".join(f"('{c}', {p}, '{e}', {n}, {t}, '{l}', '{k}', '{a}')" for c, p, e, n, t, l, k, a in steps)
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: list_concat([ord(c)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295::bigint)"""
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    return f"""
with recursive moves(code, place, edits, cost, next_place, inserted, edit, asked) as (values {values}),
closing(place, edits, cost, inserted) as (values (0, '', 0, ''), (1, 'II', 10, 'user:~assistant:~'), (2, 'I', 5, 'assistant:~'), (3, '', 0, '')),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc.format(key)} % 20 as kind from conversations),
hurt as (
  select conv_id, turn, sha256(length(role)::varchar || ':' || role || text) as tie, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from raw, lateral (select unnest(case when kind = 0 then [] when kind = 3 then [0, 1] else [0] end) as copy)),
placed as (
  select *, row_number() over w as pos, lag(left(role, 1)) over w as previous, right(rtrim(text, {blank}), 1) as seen
  from hurt window w as (partition by conv_id order by turn nulls first, tie)),
faults as (
  select *, case when seen = '' then 'blank' when pos > min(pos) over (partition by conv_id, role, text) then 'duplicate' when seen not in ('.', '!', '?') then 'truncated' else '' end as fault,
         case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as initial
  from placed),
coded as (select *, case when fault in ('blank', 'duplicate') then '-' when fault = 'truncated' then upper(initial) else initial end as code from faults),
walk as (
  select conv_id, 0::bigint as pos, 0 as place, struct_pack(cost := 0, audit := '', lines := '') as best from (select distinct conv_id from conversations)
  union all
  select w.conv_id, c.pos, m.next_place, min(struct_pack(cost := w.best.cost + m.cost, audit := w.best.audit || m.edits, lines := w.best.lines || replace(m.inserted, '~', chr(10)) ||
         case m.edit when 'D' then '' when 'K' then c.role || ':' || c.text || chr(10) else case m.asked when 'u' then 'user' else 'assistant' end || ':' || c.text || chr(10) end))
  from walk w join coded c on c.conv_id is not distinct from w.conv_id and c.pos = w.pos + 1 join moves m on m.code = c.code and m.place = w.place
  group by w.conv_id, c.pos, m.next_place),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (pos > 1 and previous || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from coded group by conv_id),
ended as (
  select w.conv_id, min(struct_pack(cost := w.best.cost + e.cost, audit := w.best.audit || e.edits, lines := w.best.lines || replace(e.inserted, '~', chr(10)))) as best
  from walk w left join counts k on k.conv_id is not distinct from w.conv_id join closing e on e.place = w.place where w.pos = coalesce(k.n, 0) group by w.conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       e.best.cost::bigint as cost, e.best.audit as audit, sha256(left(e.best.lines, greatest(length(e.best.lines) - 1, 0))) as repaired_sha256
from ended e left join counts k on k.conv_id is not distinct from e.conv_id"""


SQL = _sql()
