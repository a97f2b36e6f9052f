"""Repair of the structure of conversations: the cheapest edits after which an optional system turn and pairs of user and assistant follow.

A turn is kept, gets another role, or is deleted; turns are put in. The programme runs over the turns that are retained: the
best way to retain a turn under a role is the least, over the role retained before it, of that role's running minimum plus the
prefix sum of deletions since (which prices the gap), the turns to put in between the two roles, and the edit itself. Of equally
cheap ways the one whose audit, the edits' initials in order, is the least goes on: the audits behind the four minima are kept in
order by rank, so a tie is settled without comparing texts.

A conversation may be larger than a task. Rows are sorted by ranges and numbered, cut into blocks of consecutive rows, and
each piece of a conversation within a block is solved for each role that may stand before it. What a piece amounts to is 16 costs
and ranks; pieces of one conversation are chained by these alone, and then each piece tells its own turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivel.llm.common import crc_sql, lean, partitions_for, persist, prepare

SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows of a block, as a power of two.
BLOCK_BITS = 10
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
#: How many turns must be put in between two retained roles (none: no way), and after the last.
_BETWEEN = {(_START, _SYSTEM): 0, (_START, _USER): 0, (_START, _ASSISTANT): 1, (_SYSTEM, _USER): 0, (_SYSTEM, _ASSISTANT): 1, (_USER, _ASSISTANT): 0, (_USER, _USER): 1, (_ASSISTANT, _USER): 0, (_ASSISTANT, _ASSISTANT): 1}
_BEFORE = {q: [(p, n) for (p, r), n in _BETWEEN.items() if r == q] for q in (_SYSTEM, _USER, _ASSISTANT)}
_AFTER = (0, 2, 1, 0)
_LEGAL = ("su", "ua", "au")
_NONE, _BLANK, _DUPLICATE, _CUT = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """Faults put into turns by a checksum of conversation and turn: one in 20 is dropped, emptied, loses its sentence ends, is repeated, becomes the user's.

    Null roles and texts become one space, as do null ids within the checksum. Columns: conv_id, turn, role, text.
    """
    c = F.col
    space = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    out = rows.where(kind != 0).select("conv_id", c("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """The rows as a table with a number `pos` that rises by conversation, turn (nulls first), role and text; within a partition of the table without gaps.

    Texts of one turn and role are told apart by their first 64 characters and then by a hash. Range partitions may cut through
    a conversation, through a turn and through copies of one row.
    """
    c = F.col
    space = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    own = rows.select("conv_id", c("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    keyed = own.select("*", F.substring("text", 1, 64).alias("front"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "front", "hash", "tie"]
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranged = keyed.repartitionByRange(partitions_for(rows.sparkSession, size, 16_000_000), *order).sortWithinPartitions(*order)
    return persist(ranged.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, pos, turn, initial and fault of numbered turns: blank, role and text seen earlier in the conversation, or cut short; the first that holds."""
    c = F.col
    digest = F.unhex(F.sha2(F.concat(F.coalesce(c("conv_id").cast("string"), F.lit("\x00")), F.lit("\n"), F.length("role").cast("string"), F.lit("\n"), c("role"), c("text")), 256))
    end = F.rtrim(c("text"), F.lit(SPACE_CHARS))
    light = turns.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), digest.alias("digest"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(*".!?")).alias("cut"))
    first = light.groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    fault = F.when(c("blank"), _BLANK).when(c("pos") > c("first"), _DUPLICATE).when(c("cut"), _CUT).otherwise(_NONE)
    return light.join(first, "digest", "left").select("conv_id", "pos", "turn", "initial", fault.alias("fault"))


class Way(NamedTuple):
    """The cheapest edits of a piece from one role before it to one after it; rank orders the audits from one role before it."""

    cost: int
    rank: int
    audit: str


def solve(initials: list[str], fault: list[int], before: int) -> dict[int, Way]:
    """For each role that may be the last retained one after these rows: the cheapest edits if `before` was retained before them.

    least[q] is the running minimum over rows retained as q of cost less prefix deletion sum; order[q] ranks the audits behind
    the minima, all of which cover the rows so far. Two such audits never begin one another, as each row has one edit that is
    no insertion and none ends with an insertion.
    """
    least: dict[int, int] = {before: 0}
    order: dict[int, int] = {before: 0}
    chain: dict[int, tuple | None] = {before: None}
    deleted = 0  # prefix sum of deletions
    for j, (initial, bad) in enumerate(zip(initials, fault, strict=True)):
        if bad in (_BLANK, _DUPLICATE):
            deleted += DELETE
            continue
        extra, found = TRUNCATED * (bad == _CUT), {}
        for q, ways in _BEFORE.items():
            keep = _STATES.get(initial) == q
            best = min(((least[p] + INSERT * n, order[p], p, n) for p, n in ways if p in least), default=None)
            if best is not None and (keep or q != _SYSTEM):
                cost, rank, p, n = best
                found[q] = (cost + deleted + extra + REROLE * (not keep), rank, "I" * n + ("K" if keep else "R"), p)
        deleted += DELETE
        behind = {q: (order[q], "D") for q in least}
        taken = {}
        for q, (cost, rank, edits, p) in found.items():
            if q not in least or (cost - deleted, rank, edits) < (least[q], order[q], "D"):
                taken[q] = (cost - deleted, (chain[p], j, edits))
                behind[q] = (rank, edits)
        least |= {q: t[0] for q, t in taken.items()}
        chain |= {q: t[1] for q, t in taken.items()}
        order = {q: k for k, q in enumerate(sorted(behind, key=behind.get))}
    return {q: Way(least[q] + deleted, order[q], _audit(chain[q], len(initials))) for q in least}


def _audit(node: tuple | None, n: int) -> str:
    parts, end = [], n
    while node is not None:
        node, j, edits = node
        parts += ["D" * (end - j - 1), edits]
        end = j
    return "".join(reversed([*parts, "D" * end]))


_PIECE = "seg long, n int, blank int, duplicate int, truncated int, illegal int, first string, last string, first_turn long, last_turn long, turns long, roles string, cost array<int>, rank array<int>, told array<int>, audit array<string>"


def _conv(turns: DataFrame) -> T.StructField:
    return T.StructField("conv_id", turns.schema["conv_id"].dataType)


def _with_conv(turns: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([_conv(turns), *T.StructType.fromDDL(ddl).fields])


def _as_batch(rows: list[tuple], schema: T.StructType, conv_type: pa.DataType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, conv_type if k == 0 else kinds.field(k).type) for k, c in enumerate(columns)], schema.names)


def pieces(marked: DataFrame) -> DataFrame:
    """A row for each piece of a conversation within a block: its counts, and its cheapest edits from each role before it to each after it."""
    schema = _with_conv(marked, _PIECE)

    def piece(conv, pos: list, turn: list, initial: list, fault: list) -> tuple:
        starts = [_START] if pos[0] & ((1 << BLOCK_BITS) - 1) else range(4)
        cost, rank, told, audit = [None] * 16, [None] * 16, [None] * 16, [None] * 16
        for p in starts:
            for q, way in solve(initial, fault, p).items():
                cost[4 * p + q], rank[4 * p + q], audit[4 * p + q] = way
                told[4 * p + q] = len(way.audit) - way.audit.count("D")
        known = [t for t in turn if t is not None]
        pairs = sum(a + b not in _LEGAL for a, b in zip(initial, initial[1:], strict=False))
        counts = [sum(f == k for f in fault) for k in (_BLANK, _DUPLICATE, _CUT)]
        changes = sum(a != b for a, b in zip(known, known[1:], strict=False)) + bool(known)
        roles = "".join(i if i in _STATES else "?" for i in initial)
        return (conv, pos[0], len(pos), *counts, pairs, initial[0], initial[-1], known[0] if known else None, known[-1] if known else None, changes, roles, cost, rank, told, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, out = None, [], []
        for batch in batches:
            kind = batch.column("conv_id").type
            for row in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "turn", "initial", "fault")), strict=True):
                if held and (held[-1][0] != row[0] or held[-1][1] + 1 != row[1] or held[-1][1] >> BLOCK_BITS != row[1] >> BLOCK_BITS):
                    out.append(piece(held[0][0], *([r[k] for r in held] for k in range(1, 5))))
                    held = []
                held.append(row)
            if len(out) >= 256:
                yield _as_batch(out, schema, kind)
                out = []
        if held:
            out.append(piece(held[0][0], *([r[k] for r in held] for k in range(1, 5))))
        if out:
            yield _as_batch(out, schema, kind)

    own = marked.select("*", F.shiftright("pos", BLOCK_BITS).alias("block")).repartition("block").sortWithinPartitions("pos")
    return own.select("conv_id", "pos", "turn", "initial", "fault").mapInArrow(lean(run), schema)


_CHAIN = "seg long, entry int, leave int, place long, tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def chained(parts: DataFrame) -> DataFrame:
    """For each piece the roles before and after it in the whole conversation's cheapest edits, and the place of its first repaired turn.

    The last piece of a conversation also has its sums and `tail`, the number of turns put in at its end. A task holds four
    small numbers for each piece of one conversation, a piece being about 1000 rows.
    """
    schema = _with_conv(parts, _CHAIN)
    names = ["conv_id", "seg", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns", "cost", "rank", "told"]

    def close(rows: list) -> list[tuple]:
        conv, sums = rows[0]["conv_id"], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        ways, back, last, low, high = {_START: (0, 0)}, [], None, None, None
        for r in rows:
            for x in sums:
                sums[x] += r[x]
            if last is not None and last + r["first"] not in _LEGAL:
                sums["illegal"] += 1
            if r["first_turn"] is not None:
                sums["turns"] -= high == r["first_turn"]
                low, high = r["first_turn"] if low is None else low, r["last_turn"]
            last = r["last"]
            best = {}
            for q in range(4):
                found = [(ways[p][0] + r["cost"][4 * p + q], ways[p][1], p) for p in ways if r["cost"][4 * p + q] is not None]
                if found:
                    best[q] = min(found)
            places = sorted(best, key=lambda q: (best[q][1], r["rank"][4 * best[q][2] + q]))
            back.append({q: best[q][2] for q in best})
            ways = {q: (best[q][0], k) for k, q in enumerate(places)}
        end = min(ways, key=lambda q: (ways[q][0] + INSERT * _AFTER[q], ways[q][1]))
        path, q = [], end
        for step in reversed(back):
            path.append((step[q], q))
            q = step[q]
        out, place = [], 0
        for r, (p, q) in zip(rows, reversed(path), strict=True):
            out.append([conv, r["seg"], p, q, place, 0, None, None, None, None, None, None])
            place += r["told"][4 * p + q]
        gaps = 0 if low is None else high - low + 1 - sums["turns"]
        out[-1][5:] = [_AFTER[end], gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], ways[end][0] + INSERT * _AFTER[end]]
        return [tuple(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, out = None, [], []
        for batch in batches:
            kind = batch.column("conv_id").type
            for row in batch.to_pylist():
                if held and held[-1]["conv_id"] != row["conv_id"]:
                    out += close(held)
                    held = []
                held.append(row)
            if len(out) >= 4096:
                yield _as_batch(out, schema, kind)
                out = []
        if held:
            out += close(held)
        if out:
            yield _as_batch(out, schema, kind)

    return parts.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(lean(run), schema)


def told(picked: DataFrame) -> DataFrame:
    """The repaired turns of picked pieces: conv_id, place, the row they stand at, their new role (null: as it was) and whether they were put in."""
    schema = _with_conv(picked, "place long, pos long, new_role string, inserted boolean")
    names = {_USER: "user", _ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state, k, place, roles = r["entry"], 0, r["place"], r["roles"]
                for edit in r["audit"]:
                    if edit == "D":
                        k += 1
                        continue
                    due = _ASSISTANT if state == _USER else _USER
                    state = _STATES[roles[k]] if edit == "K" else due
                    out.append((r["conv_id"], place, r["seg"] + min(k, len(roles) - 1), None if edit == "K" else names[state], edit == "I"))
                    place, k = place + 1, k + (edit != "I")
            yield _as_batch(out, schema, batch.column("conv_id").type)

    return picked.select("conv_id", "seg", "entry", "place", "roles", "audit").mapInArrow(lean(run), schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, its repaired turns) of rows with conv_id, turn, role and text.

    The first: conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (rows by
    first fault), illegal (adjacent rows whose roles' initials may not follow each other), cost and audit. The second:
    conv_id, place (from 0), role, text.

    Rows are taken by turn, null turns first; rows of one turn by role, then text. Null roles and texts are one space; a null
    conv_id is a conversation of its own. Rows that occur twice are duplicates of each other. Further columns are not looked at; no rows
    give no rows. A conversation of any length is read in blocks; its audit is one value, so as long as the conversation has turns.
    """
    prepare(rows.sparkSession)
    turns = numbered(rows)
    parts = persist(pieces(faults(turns)), "pieces")
    links = persist(chained(parts), "chains")
    c = F.col
    audit = F.concat(F.element_at("audit", (c("entry") * 4 + c("leave") + 1).cast("int")), F.repeat(F.lit("I"), c("tail")))
    picked = persist(parts.select("seg", "roles", "audit").join(links, "seg").withColumn("audit", audit), "picked")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    summary = picked.groupBy("conv_id").agg(*(F.max(x).alias(x) for x in sums), whole.alias("audit"))
    repaired = told(picked).join(turns.select("pos", "role", "text"), "pos")
    text = F.when(c("inserted"), F.lit("")).otherwise(c("text"))
    return summary, repaired.select("conv_id", "place", F.coalesce("new_role", "role").alias("role"), text.alias("text"))


def hashed(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the turns as `role:text`, one a line. A conversation streams through its task line by line."""
    prepare(repaired.sparkSession)
    schema = _with_conv(repaired, "sha string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, kind = None, [], None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode("utf-8", "replace")
                if now is None or now[0] != conv:
                    out += [(now[0], now[1].hexdigest())] if now else []
                    now = (conv, hashlib.sha256(line))
                else:
                    now[1].update(b"\n" + line)
            if len(out) >= 4096:
                yield _as_batch(out, schema, kind)
                out = []
        out += [(now[0], now[1].hexdigest())] if now else []
        if out:
            yield _as_batch(out, schema, kind)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text").mapInArrow(lean(run), schema)


def report(given: DataFrame, rows: DataFrame) -> DataFrame:
    """The repair of `rows` for every conv_id of `given`, with a hash of the repaired turns; a conversation without rows has zeros and empty texts."""
    summary, repaired = repair(rows)
    c, zero = F.col, F.lit(0).cast("long")
    ids = given.select(c("conv_id").alias("given_id")).distinct()
    shas = hashed(repaired).select(c("conv_id").alias("sha_id"), "sha")
    out = ids.join(summary, c("given_id").eqNullSafe(c("conv_id")), "left").join(shas, c("given_id").eqNullSafe(c("sha_id")), "left")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(c("given_id").alias("conv_id"), *(F.coalesce(x, zero).alias(x) for x in sums), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a recursive query over rows in order."""
    between = ", ".join(f"('{'^sua'[p]}', '{'^sua'[q]}', {n}, '{'I' * n}', '{('assistant' if p == _USER else 'user') + ':' if n else ''}')" for (p, q), n in _BETWEEN.items())
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc_sql("key")} % 20 AS k FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS t(copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM rows_),
marked AS (SELECT *, left(role, 1) AS q, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault FROM seen),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1),
between_ (p, q, n, ins, line) AS (VALUES {between}),
moves AS (SELECT conv_id, i, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS q, {DELETE} AS cost, 'D' AS edits, '' AS lines FROM marked
  UNION ALL SELECT conv_id, i, b.p, b.q, {INSERT} * b.n + CASE WHEN marked.q = b.q THEN 0 ELSE {REROLE} END + CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END, b.ins || CASE WHEN marked.q = b.q THEN 'K' ELSE 'R' END,
    CASE WHEN b.n > 0 THEN chr(10) || b.line ELSE '' END || chr(10) || CASE WHEN marked.q = b.q THEN role WHEN b.q = 'u' THEN 'user' ELSE 'assistant' END || ':' || text
  FROM marked JOIN between_ AS b ON marked.q = b.q OR b.q <> 's' WHERE fault NOT IN (1, 2)),
way AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '^' AS p, ROW(CAST(0 AS BIGINT), '', '') AS best FROM sums
  UNION ALL SELECT conv_id, i, p, min(best) FROM (SELECT way.conv_id, moves.i, coalesce(moves.q, way.p) AS p, ROW(way.best[1] + moves.cost, way.best[2] || moves.edits, way.best[3] || moves.lines) AS best
    FROM way JOIN moves ON moves.conv_id IS NOT DISTINCT FROM way.conv_id AND moves.i = way.i + 1 AND (moves.p IS NULL OR moves.p = way.p)) GROUP BY 1, 2, 3),
ends (p, n, edits, lines) AS (VALUES ('^', 0, '', ''), ('s', 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 1, 'I', chr(10) || 'assistant:'), ('a', 0, '', '')),
done AS (SELECT sums.conv_id, min(ROW(best[1] + {INSERT} * ends.n, best[2] || ends.edits, best[3] || ends.lines)) AS best FROM way JOIN sums ON sums.conv_id IS NOT DISTINCT FROM way.conv_id AND i = sums.n JOIN ends USING (p) GROUP BY 1)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best[1], 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(substr(best[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS g LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM g.conv_id
"""


ORACLE = _sql()
