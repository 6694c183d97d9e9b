"""Shards of near-equal bytes by histogram sort; DataFrame operations only.

Rows have a total order: a hash of the text, then the id, then a row number, so equal texts stand together. A shard is a
run of that order. Its ends (splitters) are found by counting, not by sorting: every round lays ``PROBES`` boundaries
over the key interval that still holds a splitter and counts the exact bytes between them over all partitions; the
interval between the two boundaries around the splitter's target is probed next. A round returns at most ``PROBES`` sums
for each splitter, whatever the table's size, and narrows the interval by that factor. Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, ORACLE, query, stored, table

#: Boundaries laid over a splitter's interval in one round.
PROBES = 512

#: Bytes of text that one task of the exchange takes, and the most tasks; both only spread the work.
PIECE = 32 << 20
MOST_PIECES = 1 << 16

_KEYS = ("k1", "k2", "k3")
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Interval:
    """Keys that begin with ``prefix`` and go on with ``low`` to ``high``; ``below``: bytes of all smaller keys."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int


@dataclass(frozen=True)
class Splitter:
    """Rows before it: keys less than ``prefix`` + ``value``, and those equal to it if ``with_equal``."""

    prefix: tuple[int, ...]
    value: int
    with_equal: bool

    def passed(self) -> Column:
        """Whether a row stands behind the splitter."""
        key = F.col(_KEYS[len(self.prefix)])
        out = key > self.value if self.with_equal else key >= self.value
        for name, v in zip(reversed(_KEYS[: len(self.prefix)]), reversed(self.prefix), strict=True):
            out = (F.col(name) > v) | ((F.col(name) == v) & out)
        return out


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _histogram(rows: DataFrame, intervals: list[Interval]) -> dict[Interval, list[tuple[int, int, int]]]:
    """For each interval (least key, greatest key, bytes) of its probe ranges that have rows, ascending."""
    bucket = None
    for i, x in enumerate(intervals):
        name = _KEYS[len(x.prefix)]
        shift = int(x.high - x.low >= 1 << 62)  # so that differences fit a long
        step = ((x.high >> shift) - (x.low >> shift)) // PROBES + 1
        inside = F.col(name).between(x.low, x.high)
        for other, v in zip(_KEYS, x.prefix, strict=False):
            inside &= F.col(other) == v
        place = F.struct(
            F.lit(i).alias("interval"), F.expr(f"(shiftright({name}, {shift}) - ({x.low >> shift})) div {step}").alias("range"), F.col(name).alias("key")
        )
        bucket = F.when(inside, place) if bucket is None else bucket.when(inside, place)
    counted = (
        rows.select(bucket.alias("b"), "size").where("b IS NOT NULL").groupBy("b.interval", "b.range")
        .agg(F.min("b.key").alias("least"), F.max("b.key").alias("most"), F.sum("size").alias("bytes"))
    )
    out: dict[Interval, list[tuple[int, int, int]]] = {x: [] for x in intervals}
    for r in sorted(counted.collect()):  # at most PROBES rows for each interval
        out[intervals[r["interval"]]].append((r["least"], r["most"], r["bytes"]))
    return out


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """``shards - 1`` splitters of ``rows`` (k1, k2, k3, size).

    A splitter is the end of a k1 nearest to its target (the lower of two). Where that end misses by more than
    ``tolerance`` of a shard's mean bytes, it is the nearest end of a k2 in there, and beyond that of a row.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return []
    at = {i: Interval((), _LEAST, _MOST, 0) for i in range(1, shards)}
    found: dict[int, Splitter] = {}
    while at:
        ranges = _histogram(rows, sorted(set(at.values()), key=str))
        for i, x in list(at.items()):
            below, target = x.below, i * total  # both sides of a comparison are multiplied by shards
            for least, most, size in ranges[x]:
                if shards * (below + size) >= target:
                    break
                below += size
            before, after = target - shards * below, shards * (below + size) - target
            if least < most:
                at[i] = replace(x, low=least, high=most, below=below)
            elif min(before, after) <= tolerance * total or len(x.prefix) == 2:
                found[i] = Splitter(x.prefix, least, with_equal=after < before)
                del at[i]
            else:
                at[i] = Interval((*x.prefix, least), _LEAST, _MOST, below)
    return [found[i] for i in range(1, shards)]


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as row (struct of all its columns), with size, shard and slot.

    size is the UTF-8 bytes of the text plus 1 (a null text has none). Shards are numbered 0 to ``shards - 1`` and differ
    from the mean by at most the largest row or ``tolerance`` of the mean, whichever is more. Equal texts share a shard,
    but for groups that lie over a splitter and are larger than ``tolerance`` allows: those are cut by id. Rows that
    agree in id and text are told apart by a row number, so they may be cut, too. A null id sorts before all others.
    slot numbers a shard's rows without gaps from 0. An empty table gives an empty table. Columns of ``docs`` may have
    any name. ``shards`` is meant to be at most some hundreds: each splitter is a term of one expression.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        _hash60(text).alias("k1"),
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )
    rows = stored(rows)  # rounds read its keys and sizes only; row numbers stay what they are if an executor is lost
    splitters = find_splitters(rows, shards, tolerance)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = min(-(-total // (shards * PIECE)), MOST_PIECES // shards) or 1
    shard = sum((x.passed().cast("int") for x in splitters), F.lit(0))
    # a shard's rows are spread over its pieces by hashes of text and id, so neither a large group nor a hot text is one task
    salt = F.pmod(F.col("k1") % parts + _hash60(F.col("k2").cast("string")) % parts, F.lit(parts))
    placed = rows.select("row", "size", "k1", "k2", "k3", shard.alias("shard"), (shard * parts + salt).cast("int").alias("piece"))
    sizes = placed.groupBy("shard", "piece").count().collect()  # at most MOST_PIECES rows
    first, seen = {}, dict.fromkeys(range(shards), 0)
    for r in sorted(sizes):
        first[r["piece"]] = seen[r["shard"]]
        seen[r["shard"]] += r["count"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(sorted(first.items()), "at int, before long")
    exchanged = placed.repartitionById(shards * parts, F.col("piece")).sortWithinPartitions("k1", "k2", "k3")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = exchanged.select("row", "size", "shard", "piece", inside.alias("i"))
    return numbered.join(F.broadcast(offsets), F.col("piece") == F.col("at")).select("row", "size", "shard", (F.col("before") + F.col("i")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows of ``shard_documents`` as Parquet, a folder for each shard."""
    sharded.write.partitionBy("shard").parquet(path)


@query("op12_histogram_shards")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = shard_documents(table(spark, folder, "documents"))
    return out.select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_CRC_STEP = "CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END"


def crc32_sql(blob: str) -> str:
    """DuckDB: unsigned CRC-32 of an expression that gives ASCII-safe hex pairs' bytes, one shift at a time."""
    pairs = f"regexp_extract_all(hex({blob}), '..')"
    steps = f"flatten(list_transform({pairs}, lambda p: [CAST('0x' || p AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda acc, x: {_CRC_STEP}, CAST(4294967295 AS BIGINT)), 4294967295)"


_H60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
ORACLE["op12_histogram_shards"] = f"""
    WITH sized AS (
        SELECT doc_id, coalesce(text, '') AS body, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
            {_H60.format("coalesce(text, '')")} AS k1, coalesce(doc_id, {NO_ID}) AS k2 FROM documents),
    ordered AS (
        SELECT *, CAST(sum(size) OVER (ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total FROM sized),
    ends AS (
        SELECT i, i * total AS target, 8 * (upto - size) AS a, 8 * upto AS b, total,
            8 * min(upto - size) OVER (PARTITION BY k1) AS ga, 8 * max(upto) OVER (PARTITION BY k1) AS gb
        FROM ordered, range(1, 8) AS t(i)),
    splitters AS (
        SELECT i, CASE
            WHEN least(target - ga, gb - target) <= 0.005 * total THEN CASE WHEN gb - target < target - ga THEN gb ELSE ga END
            WHEN b - target < target - a THEN b ELSE a END AS cut
        FROM ends WHERE a < target AND target <= b),
    sharded AS (
        SELECT o.*, (SELECT count(*) FROM splitters WHERE cut <= 8 * (upto - size)) AS shard,
            greatest(CAST(ceil(total / (8 * {PIECE})) AS BIGINT), 1) AS parts FROM ordered AS o)
    SELECT doc_id, size, {crc32_sql("encode(body)")} AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY (k1 % parts + {_H60.format("CAST(k2 AS VARCHAR)")} % parts) % parts, k1, k2) - 1 AS slot,
        CAST(NULL AS INTEGER) AS grown_shard
    FROM sharded"""
