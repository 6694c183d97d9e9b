"""Recording discovery, path parsing and agreement between manifest and disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantile_summary
from tessera.session import cut_lineage
from tessera.sources.tables import list_files

# File name endings that count as audio.
AUDIO_PATTERN = r"(?i)\.(wav|flac|ogg|mp3|m4a|webm|aac)$"


def path_part(path: Column, from_end: int) -> Column:
    """Path component counted from the end, 1 = file name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def in_layout(paths: DataFrame, relative: str, unit: str, shared_folder: str, modalities: Sequence[str]) -> DataFrame:
    """Recordings of the wanted modalities among paths relative to a release's folder, with their ``unit`` and ``modality``.

    Both layouts may be mixed: ``<unit>/.../file`` and ``<shared_folder>/<unit>/.../file``. Files that are not audio, that
    lie outside a unit's folder, or whose names start with ``._`` are left out.
    """
    parts = F.split(relative, "/")
    shared = F.col("__parts")[0] == shared_folder
    name = F.element_at("__parts", -1)
    d = paths.withColumn("__parts", parts).where(F.size("__parts") >= F.when(shared, 3).otherwise(2))
    d = d.where(name.rlike(AUDIO_PATTERN) & ~name.startswith("._"))
    d = d.withColumns({unit: F.when(shared, F.col("__parts")[1]).otherwise(F.col("__parts")[0]), "modality": modality(name)})
    return d.where(F.col("modality").isin(*modalities)).drop("__parts")


def discover(
    spark: SparkSession,
    root: str,
    allowed: DataFrame,
    unit: str,
    manifest: DataFrame | None = None,
    shared_folder: str = "form-app-users",
    modalities: Sequence[str] = ("cough",),
) -> DataFrame:
    """``(unit, path, modality)`` of recordings of allowed units, from a manifest or from the folder tree.

    A manifest has ``path`` and may have ``modality`` (without it every row counts as the first one wanted, and case does
    not matter); relative paths are below ``root``. The listing of a tree reads no file contents.
    """
    if manifest is None:
        prefix = spark._jvm.org.apache.hadoop.fs.Path(root)
        prefix = prefix.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(prefix).toString().rstrip("/") + "/"
        listed = list_files(spark, root, "*").withColumn("__relative", F.expr(f"substring(path, {len(prefix) + 1})"))
        found = in_layout(listed, "__relative", unit, shared_folder, modalities).select(unit, "path", "modality")
    else:
        named = F.lower("modality") if "modality" in manifest.columns else F.lit(modalities[0])
        path = F.col("path").cast("string")
        whole = F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), path))
        wanted = [m.lower() for m in modalities]
        found = manifest.select(unit, whole.alias("path"), named.alias("modality")).where(F.col("modality").isin(*wanted))
    return found.join(allowed.select(unit).distinct(), unit, "left_semi").dropDuplicates([unit, "path"])


def modality(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("cough"), F.lit("cough"))
        .when(low.contains("breath"), F.lit("breath"))
        .when(low.contains("read") | low.contains("voice"), F.lit("voice_or_read"))
        .otherwise(F.lit("other_audio"))
    )


def parse_release_path(df: DataFrame, relative: str, shared_folder: str) -> DataFrame:
    """Subject, sample, platform and modality from relative paths; unparsed rows keep NULLs.

    Below the shared folder the next component is both subject and sample. Elsewhere the first
    component of 10 or 12 characters that has a folder below it is the subject.
    """
    dirs = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    d = df.withColumn("__d", F.when(F.size(F.split(relative, "/")) > 1, dirs).otherwise(F.array().cast("array<string>")))
    at = F.array_position("__d", F.lit(shared_folder)).cast("int")
    web = F.try_element_at("__d", at + 1)
    spots = F.filter(
        F.transform("__d", lambda c, i: F.struct(i.alias("i"), c.alias("c"))),
        lambda s: F.length(s["c"]).isin(10, 12) & (s["i"] + 1 < F.size("__d")),
    )
    first = F.try_element_at(spots, F.lit(1))
    mobile_sample = F.try_element_at("__d", (first["i"] + 2).cast("int"))
    shared = at > 0
    subject = F.when(shared, web).otherwise(first["c"])
    sample = F.when(shared, web).otherwise(mobile_sample)
    platform = F.when(shared & web.isNotNull(), F.lit("WEB")).when(
        ~shared & first.isNotNull(), F.when(F.length(first["c"]) == 10, F.lit("ANDROID")).otherwise(F.lit("IOS"))
    )
    name = F.element_at(F.split(relative, "/"), -1)
    return d.withColumns(
        {"subject": subject, "sample": sample, "platform": platform, "modality": modality(name)}
    ).drop("__d")


def inventory(parsed: DataFrame) -> DataFrame:
    """``(section, item, n)`` counts of a parsed release; no identifier appears."""
    ok = parsed.where(F.col("subject").isNotNull())
    per_sample = ok.groupBy("subject", "sample").agg(
        F.count(F.lit(1)).alias("c"), F.min("platform").alias("p0"), F.max("platform").alias("p1")
    )
    per_subject = cut_lineage(
        per_sample.groupBy("subject").agg(
            F.sum("c").alias("recordings"), F.count(F.lit(1)).alias("samples"), F.min("p0").alias("p0"), F.max("p1").alias("p1")
        )
    )
    files = parsed.groupBy("modality", F.col("subject").isNull().alias("unparsed")).agg(F.count(F.lit(1)).alias("n"))
    several = F.coalesce(F.sum((F.col("p0") != F.col("p1")).cast("long")), F.lit(0))
    unparsed = F.coalesce(F.sum(F.when(F.col("unparsed"), F.col("n"))), F.lit(0))

    def section(df: DataFrame, name: str, item: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"), "n")

    def histogram(col: str) -> DataFrame:
        return per_subject.groupBy(col).agg(F.count(F.lit(1)).alias("n"))

    def check(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit("check").alias("section"), F.lit(name).alias("item"), "n")

    return (
        section(histogram("recordings"), "recordings_per_subject", "recordings")
        .unionByName(section(histogram("samples"), "samples_per_subject", "samples"))
        .unionByName(section(histogram("p0"), "platform", "p0"))
        .unionByName(section(files.where(~F.col("unparsed")), "modality", "modality"))
        .unionByName(check(per_subject.agg(several.alias("n")), "subject_on_several_platforms"))
        .unionByName(check(files.agg(unparsed.alias("n")), "unparsed"))
    )


def per_subject_summary(parsed: DataFrame) -> DataFrame:
    per = parsed.where(F.col("subject").isNotNull()).groupBy("subject").agg(F.count(F.lit(1)).alias("recordings"))
    return quantile_summary(per, "recordings")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def recording_of(segment: Column, parts: int = 5) -> Column:
    """First ``parts`` underscore fields of a segment name."""
    return F.array_join(F.slice(F.split(stem(segment), "_"), 1, parts), "_")


def patient_of(segment: Column) -> Column:
    return F.split(F.element_at(F.split(segment, "/"), -1), "_")[0]


def squeeze(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def parse_filter_name(name: Column) -> Column:
    """``BP12_asthma,E W,P L L,56,M`` -> filter letter, patient, diagnosis, age and sex."""
    text = squeeze(stem(name))
    rest = F.split(F.regexp_extract(text, r"^[A-Z]P\d+_(.+)$", 1), ",")
    field = lambda i: F.trim(F.try_element_at(rest, F.lit(i)))
    known = text.rlike(r"^[BDE]P\d+_.+$")
    return F.when(
        known,
        F.struct(
            F.substring(text, 1, 1).alias("filter"),
            F.regexp_extract(text, r"^[BDE](P\d+)_", 1).alias("patient"),
            F.lower(field(1)).alias("diagnosis"),
            field(4).try_cast("int").alias("age"),
            F.upper(field(5)).alias("sex"),
        ),
    )


def manifest_agreement(manifest: DataFrame, measured: DataFrame, key: str, claimed: str, decoded: str, tolerance: float = 0.010) -> DataFrame:
    """Missing and extra files, undecodable files and durations that differ by more than the tolerance."""
    a = manifest.select(key, F.col(claimed).alias("__c"), F.lit(True).alias("__m"))
    b = measured.select(key, F.col(decoded).alias("__d"), F.lit(True).alias("__f"))
    gap = F.abs(F.col("__d") - F.col("__c"))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    both = F.col("__m").isNotNull() & F.col("__f").isNotNull()
    return a.join(b, key, "full").agg(
        n(both).alias("n_checked"),
        n(F.col("__f").isNull()).alias("n_missing"),
        n(F.col("__m").isNull()).alias("n_extra"),
        n(both & F.col("__d").isNull()).alias("n_undecodable"),
        n(gap > tolerance).alias("n_duration_mismatch"),
        F.max(gap).alias("max_duration_gap"),
    )


def allowed_files(files: DataFrame, names: Sequence[str]) -> DataFrame:
    return files.where(F.col("file_name").isin(*names))
