"""Delimited metadata, manifests and prediction tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, platform_from_path
from tessera.operators.joins import ContractError, require_unique
from tessera.session import cut_lineage


def detect_separator(spark: SparkSession, path: str) -> str:
    """``;`` when the header line has more of them than commas."""
    head = spark.read.text(path).limit(1).first()
    line = head[0] if head else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Delimited file with header, every column as text (values are mapped later, not inferred)."""
    sep = detect_separator(spark, path)
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding="UTF-8", multiLine=False)


def find_column(df: DataFrame, aliases: Sequence[str], required: bool = True) -> str | None:
    """Column whose name equals one of the aliases, ignoring case and outer blanks."""
    folded = {c.strip().lower(): c for c in df.columns}
    for a in aliases:
        if a.strip().lower() in folded:
            return folded[a.strip().lower()]
    if required:
        raise ContractError(f"none of {list(aliases)} is a column of {df.columns}")
    return None


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """Rename alias columns to their canonical names; absent optional ones become NULL columns."""
    picked = []
    for name, names in aliases.items():
        found = find_column(df, names, name in required)
        picked.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*picked)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths and lengths below a folder; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )


#: Different header lines that the files of one folder may have.
MOST_HEADERS = 1000


def header_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, header)``: the first line of every file below a folder, found in one pass."""
    lines = _lines(spark, root, pattern).where("start = 0").withColumn("i", F.monotonically_increasing_id())
    return lines.groupBy("path").agg(F.min_by("value", "i").alias("header"))


def _without_mark(c: str) -> Column:
    """Text without a leading byte order mark."""
    return F.expr(f"trim(LEADING '\ufeff' FROM {c})")


def _lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def read_many(
    spark: SparkSession, root: str, pattern: str, aliases: Mapping[str, Sequence[str]], key: str
) -> tuple[DataFrame, int]:
    """Union of all metadata files that have the key column, tagged with the platform of their path.

    Headers differ between files: one pass finds them, and files of the same header are one case of the expression that
    parses a line, so the plan grows with the different headers, not with the files. A line that repeats its file's
    header is dropped; values do not run over lines. Returns the union and the number of skipped files.
    """
    heads = cut_lineage(header_lines(spark, root, pattern))
    kinds = heads.groupBy("header").agg(F.count(F.lit(1)).alias("n")).limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise ContractError(f"more than {MOST_HEADERS} different header lines below {root}")
    parsed, skipped = None, 0
    for kind in sorted(kinds):
        line = kind["header"].lstrip("\ufeff")
        sep = ";" if line.count(";") > line.count(",") else ","
        names = next(csv.reader([line], delimiter=sep), [])
        place = {n.strip().lower(): i for i, n in reversed(list(enumerate(names)))}
        at = {name: next((place[a.strip().lower()] for a in own if a.strip().lower() in place), None) for name, own in aliases.items()}
        if at[key] is None:
            skipped += kind["n"]
            continue
        cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep})
        row = F.struct(*[(F.lit(None).cast("string") if i is None else cells[f"c{i}"]).alias(name) for name, i in at.items()])
        own = F.col("header") == kind["header"]
        parsed = F.when(own, row) if parsed is None else parsed.when(own, row)
    if parsed is None:
        raise ContractError(f"no file below {root} has a {key} column")
    lines = _lines(spark, root, pattern).join(heads, "path").where(_without_mark("value") != _without_mark("header"))
    merged = lines.select(parsed.alias("r"), "path").where("r IS NOT NULL").select("r.*", platform_from_path(F.col("path")).alias("platform"))
    return merged.where(canonical(F.col(key)).isNotNull()), skipped


def read_unique(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Delimited file whose key is unique and never blank."""
    df = read_table(spark, path)
    if df.where(canonical(F.col(key)).isNull()).limit(1).count():
        raise ContractError(f"{path}: blank {key}")
    return require_unique(df, [key], path)


def read_ratings(spark: SparkSession, path: str, suffix: str, levels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Quality ratings ``(unit_id, quality)``: exact header, suffix on every name, closed value range, unique."""
    df = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if set(df.columns) != {"FILENAME", "QUALITY"}:
        raise ContractError(f"unexpected columns {df.columns}")
    q = F.col("QUALITY").try_cast("int")
    bad = df.where(~F.col("FILENAME").endswith(suffix) | q.isNull() | ~q.isin(*levels))
    if bad.limit(1).count():
        raise ContractError("a rating has an unexpected name or value")
    out = df.select(F.expr(f"left(FILENAME, length(FILENAME) - {len(suffix)})").alias("unit_id"), q.alias("quality"))
    return require_unique(out, ["unit_id"], path)


def read_split_file(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated ``recording split`` lines; shorter lines are ignored."""
    parts = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .where(F.size(parts) >= 2)
        .select(parts[0].alias("recording"), F.lower(parts[1]).alias("split"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON records of one file, nested fields kept as structs."""
    return spark.read.option("multiLine", "true").json(path)


def map_to_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """Explode a map column to ``(key, field, value)`` rows."""
    return df.select(key, F.explode(column).alias("field", "value"))


def read_predictions(spark: SparkSession, path: str, arms: Sequence[str] | None = None) -> DataFrame:
    """Long prediction table; naming arms prunes partitions or row groups."""
    df = spark.read.parquet(path)
    return df.where(F.col("arm").isin(*arms)) if arms else df


def compatible_arms(pred: DataFrame, needed: Sequence[int]) -> DataFrame:
    """Arms that have either every needed seed or a single one (deterministic)."""
    per = pred.groupBy("arm").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    full = F.array(*[F.lit(s) for s in sorted(needed)]).cast(dict(per.dtypes)["seeds"])
    kind = F.when(F.size("seeds") == 1, F.lit("single")).when(F.col("seeds") == full, F.lit("full"))
    return per.select("arm", F.size("seeds").alias("n_seeds"), F.coalesce(kind, F.lit("incompatible")).alias("kind"))


def replicate_single_seed(pred: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """A deterministic arm (one seed) repeated for every seed, so that arms can be paired by seed."""
    kinds = compatible_arms(pred, seeds).select("arm", "kind")
    every = F.array(*[F.lit(s) for s in seeds]).cast(f"array<{dict(pred.dtypes)['seed']}>")
    own: Column = F.array("seed")
    return (
        pred.join(kinds, "arm")
        .where(F.col("kind") != "incompatible")
        .withColumn("seed", F.explode(F.when(F.col("kind") == "single", every).otherwise(own)))
        .drop("kind")
    )
