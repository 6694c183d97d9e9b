"""Conversation structure repair as lightest derivations (Knuth's agenda).

Edits turn a conversation's rows into one whose role initials read ``(s?(ua)+)?``. An *item* (position, state) says that
the rows before the position can be turned into a text that brings the pattern to the state; its weight is (cost, audit).
Each edit is a deduction from one item to another, each summary of a run of rows a deduction from two items. The agenda
pops items by (cost, position, audit): every deduction adds cost or position, so its conclusion comes after its premises,
and audits of equal cost over the same rows are never prefixes of each other, so adding letters keeps their order. The
functions are thus superior, an item's first pop is final, and the derivation ends when the goal is popped.

Rows are sorted over all tasks by conversation and turn, and cut into runs of at most ``RUN_ROWS`` rows. A conversation
that lies in one run is repaired there. Of a conversation cut by a task's end or by length, each run is summarised by its
lightest derivations between all states; the summaries are composed in order, and each run then replays its own part.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, ORACLE, arrow_schema, given_id, query, stored, table
from tessera.llm.sharding import crc32_sql

#: Most rows and about the most bytes of text in a run.
RUN_ROWS = 512
RUN_BYTES = 1 << 20

#: The pattern: at its start, after the system turn, after a user turn, after an assistant turn.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_GOALS = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"

Edge = tuple[int, int, int, str]  # from state, to state, cost, letters


def _expected(state: int) -> str:
    """The role that an inserted or changed row takes."""
    return "assistant" if state == 2 else "user"


def row_edges(role: str, truncated: bool, free: bool, forced: int) -> list[Edge]:
    """Ways over a row: one that may be kept if ``free``, and ``forced`` copies behind it that must be deleted."""
    tail, cost = "D" * forced, 3 * forced
    if not free:
        return [(q, q, cost, tail) for q in range(4)]
    out = [(q, q, cost + 3, "D" + tail) for q in range(4)]
    for q in range(4):
        kept = _NEXT.get((q, role[:1]))
        if kept is not None:
            out.append((q, kept, cost + truncated, "K" + tail))
        changed = _NEXT[q, _expected(q)[0]]
        if changed != kept:
            out.append((q, changed, cost + 2 + truncated, "R" + tail))
    return out


def lightest(steps: list[list[Edge]], entry: int, goals: tuple[int, ...] | None) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the states behind all steps, from ``entry`` before the first; with ``goals`` only of the lightest goal."""
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", entry)]
    done: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str]] = {}
    last = len(steps)
    while agenda:
        cost, at, audit, state = heapq.heappop(agenda)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == last:
            if goals and state in goals:
                return {state: (cost, audit)}
            out[state] = (cost, audit)
            if len(out) == 4:
                return out
        else:
            for p, q, more, letters in steps[at]:
                if p == state and (at + 1, q) not in done:
                    heapq.heappush(agenda, (cost + more, at + 1, audit + letters, q))
        inserted = _NEXT[state, _expected(state)[0]]
        if (at, inserted) not in done:
            heapq.heappush(agenda, (cost + 2, at, audit + "I", inserted))
    return out


def replay(rows: list[tuple[str, str, int]], letters: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of the repaired rows; ``rows``: role, text and copies."""
    out: list[tuple[str, str]] = []
    flat = ((role, text) for role, text, copies in rows for _ in range(copies))
    for letter in letters:
        role, text = (_expected(state), "") if letter == "I" else next(flat)
        if letter == "D":
            continue
        if letter == "R":
            role = _expected(state)
        state = _NEXT[state, role[:1]]
        out.append((role, text))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with a fault put into them by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes its ``[.!?]``,
    3 repeats it (copies 2), 4 makes it a user's. A null is one blank, also in what is hashed."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies")
    )


_STATS = "n_rows long, blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, n_turns long, first_turn long, last_turn long, head string, tail string"
_EDGES = "edges array<struct<p: int, q: int, cost: long, letters: string>>"
_ROWS = "rows array<struct<role: string, text: string, copies: int>>"
_TURNS = "turns array<struct<role: string, text: string>>"


def _statistics(run: list[tuple]) -> dict:
    """Counts of a run, with what joining it to its neighbours takes."""
    out = dict(n_rows=0, blank=0, duplicate=0, truncated=0, illegal=0, least_turn=None, most_turn=None, n_turns=0, first_turn=run[0][0], last_turn=run[-1][0])
    before, turns = None, set()
    for turn, role, _, copies, blank, free, truncated in run:
        out["n_rows"] += copies
        out["blank"] += copies if blank else 0
        out["duplicate"] += 0 if blank else copies - free
        out["truncated"] += truncated
        legal = (role[:1] * 2 in ("su", "ua", "au"), before is None or before + role[:1] in ("su", "ua", "au"))
        out["illegal"] += (not legal[1]) + (copies - 1) * (not legal[0])
        before = role[:1]
        if turn is not None:
            turns.add(turn)
    if turns:
        out |= dict(least_turn=min(turns), most_turn=max(turns), n_turns=len(turns))
    return out | dict(head=run[0][1][:1], tail=before)


def _joined(a: dict, b: dict) -> dict:
    """The statistics of two neighbouring runs of one conversation."""
    out = {k: a[k] + b[k] for k in ("n_rows", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in ("su", "ua", "au"))
    for k, best in (("least_turn", min), ("most_turn", max)):
        out[k] = best((x[k] for x in (a, b) if x[k] is not None), default=None)
    out["n_turns"] = a["n_turns"] + b["n_turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"])
    return out | dict(first_turn=a["first_turn"], last_turn=b["last_turn"], head=a["head"], tail=b["tail"])


def _sha(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in rows], schema=schema)


def runs(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation into runs: conv, run (ascending inside a conversation), whole, statistics, and the
    repair (cost, audit, sha, turns) of a whole conversation or edges and rows of a part of one."""
    schema, arrow = arrow_schema(f"conv long, run long, whole boolean, {_STATS}, cost long, audit string, sha string, {_TURNS}, {_EDGES}, {_ROWS}")

    def closed(conv: int, number: int, run: list[tuple], whole: bool) -> dict:
        steps = []
        for _, role, _, copies, _, free, truncated in run:
            steps.append(row_edges(role, bool(truncated), bool(free), copies - free))
        out = {"conv": conv, "run": number, "whole": whole} | _statistics(run)
        plain = [(role, text, copies) for _, role, text, copies, *_ in run]
        if whole:
            ((cost, audit),) = lightest(steps, 0, _GOALS).values()
            turns = replay(plain, audit, 0)
            return out | {"cost": cost, "audit": audit, "sha": _sha(turns), "turns": [{"role": r, "text": t} for r, t in turns]}
        edges = [{"p": p, "q": q, "cost": c, "letters": a} for p in range(4) for q, (c, a) in lightest(steps, p, None).items()]
        return out | {"edges": edges, "rows": [{"role": r, "text": t, "copies": n} for r, t, n in plain]}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        conv, run, size, inner = None, [], 0, False
        for batch in batches:
            out = []
            for own, turn, role, text, copies, first in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "first")), strict=True):
                new = own != conv
                if run and (new or len(run) >= RUN_ROWS or size >= RUN_BYTES):
                    out.append(closed(conv, base + number, run, new and inner))
                    number, run, size, inner = number + 1, [], 0, new
                conv = own
                body = text.rstrip(_SPACE)
                free = int(first and bool(body))
                run.append((turn, role, text, copies, not body, free, int(free and body[-1] not in ".!?")))
                size += len(text)
            if out:
                yield _batch(out, arrow)
        if run:  # the next task may go on with it
            yield _batch([closed(conv, base + number, run, False)], arrow)

    return rows.mapInArrow(cut, schema)


def compose(parts: DataFrame) -> DataFrame:
    """The summaries of each cut conversation's runs put together: for each run its entry state and letters, and with the
    last one the statistics, cost and audit. Streams over the summaries; of a run it keeps the four lightest ways."""
    schema, arrow = arrow_schema(f"conv long, run long, entry int, letters string, last boolean, {_STATS}, cost long, audit string")

    def ended(conv: int, ways: dict, taken: list, stats: dict) -> list[dict]:
        cost, _, state = min((c, tail, q) for q, (c, tail) in ways.items() if q in _GOALS)
        out = []
        for number, best in reversed(taken):
            entry, letters = best[state]
            out.append({"conv": conv, "run": number, "entry": entry, "letters": letters, "last": False})
            state = entry
        out[0] |= stats | {"cost": cost, "last": True, "audit": "".join(r["letters"] for r in reversed(out))}
        return out

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ways, taken, stats = None, {}, [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["conv"] != conv:
                    if taken:
                        yield _batch(ended(conv, ways, taken, stats), arrow)
                    conv, ways, taken, stats = row["conv"], {0: (0, "")}, [], None
                held = {k: row[k] for k in _STAT_NAMES}
                stats = held if stats is None else _joined(stats, held)
                after: dict[int, tuple[int, str, int, str]] = {}
                for e in row["edges"]:
                    if e["p"] in ways:
                        cost, tail = ways[e["p"]]
                        way = (cost + e["cost"], tail + e["letters"], e["p"], e["letters"])
                        if e["q"] not in after or way[:2] < after[e["q"]][:2]:
                            after[e["q"]] = way
                taken.append((row["run"], {q: w[2:] for q, w in after.items()}))
                shared = len(os.path.commonprefix([w[1] for w in after.values()]))  # decided: equal in all ways that are left
                ways = {q: (w[0], w[1][shared:]) for q, w in after.items()}
        if taken:
            yield _batch(ended(conv, ways, taken, stats), arrow)

    slim = parts.select("conv", "run", *_STAT_NAMES, "edges")
    return slim.repartition("conv").sortWithinPartitions("conv", "run").mapInArrow(fold, schema)


_STAT_NAMES = [x.split()[0] for x in _STATS.split(", ")]


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``: conv_id, turn, role, text and, if there, copies. Returns the conversations and their repaired turns.

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256. Turns:
    conv_id, run, edits, turns (role, text), the repaired rows in runs that ascend inside a conversation.

    Rows stand by turn (nulls first), those of one turn by role and SHA-256 of the text; rows that agree in all of it
    are repeats. A null role or text is one blank. Null ids are one conversation. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (its last character that is no white space is none of ``.!?``).
    Keep costs 0, Rerole 2, Delete 3, Insert 2, an undeleted truncated row 1 more; blank and duplicate rows must go.
    Of equal costs the audit least in ASCII order is taken. An empty table gives empty tables; other columns are left out.

    Neither the derivations nor the search for duplicates gathers a conversation. Its audit and hash are one value each:
    summaries of its runs (1 / 512 of its rows) and, for the hash, its repaired text stream through one task in order.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), copies.alias("copies"))
    plain = plain.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies")).withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = plain.groupBy("conv", "role", "digest").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select("conv", "role", "digest", F.struct("at.turn").alias("at"))
    marked = plain.join(again, ["conv", "role", "digest"], "left")
    first = F.col("at").isNull() | F.col("turn").eqNullSafe(F.col("at.turn"))
    order = ["conv", "turn", "role", "digest"]
    ordered = marked.select(*order, "text", "copies", first.alias("first")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(runs(ordered))
    whole, cut = parts.where("whole"), parts.where("NOT whole")
    decided = stored(compose(cut))
    pieces = stored(_replayed(cut.select("conv", "run", "rows").join(decided.select("run", "entry", "letters"), "run")))
    composed = decided.where("last").join(_hashed(pieces), "conv")
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    columns = ["conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")]
    found = whole.select(*columns).unionByName(composed.select(*columns))
    turns = whole.select("conv", "run", F.col("audit").alias("edits"), "turns").unionByName(pieces)
    id_ = F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id")
    return found.select(id_, *found.columns[1:]), turns.select(id_, *turns.columns[1:])


def _replayed(cut: DataFrame) -> DataFrame:
    schema, arrow = arrow_schema(f"conv long, run long, edits string, {_TURNS}")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                turns = replay([(r["role"], r["text"], r["copies"]) for r in row["rows"]], row["letters"], row["entry"])
                yield _batch([row | {"edits": row["letters"], "turns": [{"role": r, "text": t} for r, t in turns]}], arrow)

    return cut.mapInArrow(lines, schema)


def _hashed(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each cut conversation's repaired lines, read in order and not kept."""
    schema, arrow = arrow_schema("conv long, sha string")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("conv")[i].as_py()
                if own != conv:
                    if state:
                        yield _batch([{"conv": conv, "sha": state.hexdigest()}], arrow)
                    conv, state, begun = own, hashlib.sha256(), False
                for t in batch.column("turns")[i].as_py():
                    state.update(f"{chr(10) * begun}{t['role']}:{t['text']}".encode())
                    begun = True
        if state:
            yield _batch([{"conv": conv, "sha": state.hexdigest()}], arrow)

    return pieces.select("conv", "run", "turns").repartition("conv").sortWithinPartitions("conv", "run").mapInArrow(hashes, schema)


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    found, _ = repair_conversations(damaged(conversations))
    key = F.coalesce("conv_id", F.lit(NO_ID)).alias("id")
    every = conversations.select(key).distinct().join(found.withColumn("id", key).drop("conv_id"), "id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select(given_id("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _add(way: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(left({way}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}'"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _to_user(cost: str, letter: str) -> str:
    return _least(*(_add(f"v{q}", cost, letter) for q in (0, 1, 3)))


_FREE = "NOT (blank OR dup)"
_STEPS = {
    "n0": _add("v0", "3", "D"),
    "n1": _least(_add("v1", "3", "D"), f"CASE WHEN {_FREE} AND initial = 's' THEN {_add('v0', 'late', 'K')} END"),
    "n2": _least(_add("v2", "3", "D"), f"CASE WHEN {_FREE} THEN {_to_user('late + 2', 'R')} END", f"CASE WHEN {_FREE} AND initial = 'u' THEN {_to_user('late', 'K')} END"),
    "n3": _least(_add("v3", "3", "D"), f"CASE WHEN {_FREE} THEN {_add('v2', 'late + 2', 'R')} END", f"CASE WHEN {_FREE} AND initial = 'a' THEN {_add('v2', 'late', 'K')} END"),
}
_INSERTED = _least("n2", *(_add(f"n{q}", "2", "I") for q in (0, 1, 3)))
ORACLE["op11_conversation_repair"] = f"""
    WITH RECURSIVE hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_sql("encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h
        FROM conversations),
    copied AS (
        SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hashed WHERE h <> 0),
    placed AS (
        SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k,
            count(*) OVER (PARTITION BY conv_id) AS n
        FROM copied),
    judged AS (
        SELECT *, body = '' AS blank, body <> '' AND k > 1 AS dup,
            CAST(body <> '' AND k = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS INTEGER) AS late,
            coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
        FROM placed),
    walk AS (
        SELECT DISTINCT conv_id, n, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000000002I' AS v2, '000000004II' AS v3 FROM judged
        UNION ALL
        SELECT conv_id, n, i, n0, n1, c2, {_least("n3", _add("c2", "2", "I"))} FROM (
            SELECT *, {_INSERTED} AS c2 FROM (
                SELECT w.conv_id, w.n, j.i, {", ".join(f"{v} AS {k}" for k, v in _STEPS.items())}
                FROM walk AS w JOIN judged AS j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1))),
    best AS (SELECT conv_id, {_least("v0", "v3")} AS way FROM walk WHERE i = n),
    letters AS (
        SELECT conv_id, j, substr(way, 9 + j, 1) AS letter FROM (SELECT conv_id, way, unnest(range(1, len(way) - 8)) AS j FROM best)),
    counted AS (
        SELECT *, sum(CAST(letter <> 'I' AS INTEGER)) OVER w AS i, sum(CAST(letter <> 'D' AS INTEGER)) OVER w AS o
        FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
    lines AS (
        SELECT c.conv_id, c.o, c.letter, CASE WHEN c.letter <> 'I' THEN p.role END AS role, CASE WHEN c.letter = 'I' THEN '' ELSE p.text END AS text,
            max(CAST(c.o = 1 AND c.letter = 'K' AND p.initial = 's' AS INTEGER)) OVER (PARTITION BY c.conv_id) AS shift
        FROM counted AS c LEFT JOIN placed AS p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i
        WHERE c.letter <> 'D'),
    hashes AS (
        SELECT conv_id, sha256(string_agg(
            (CASE WHEN letter = 'K' THEN role WHEN (o + shift) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY o)) AS sha
        FROM lines GROUP BY conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS BIGINT)) AS blank,
            sum(CAST(dup AS BIGINT)) AS dup, sum(late) AS late, sum(CAST(odd AS BIGINT)) AS odd
        FROM judged GROUP BY conv_id)
    SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
        CAST(coalesce(dup, 0) AS BIGINT) AS duplicate, CAST(coalesce(late, 0) AS BIGINT) AS truncated, CAST(coalesce(odd, 0) AS BIGINT) AS illegal,
        CAST(coalesce(CAST(left(way, 9) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(way, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS e
    LEFT JOIN counts AS c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best AS b ON e.conv_id IS NOT DISTINCT FROM b.conv_id
    LEFT JOIN hashes AS h ON e.conv_id IS NOT DISTINCT FROM h.conv_id"""
