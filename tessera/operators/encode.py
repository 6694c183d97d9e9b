"""Records as text and as model input: rendering, levels, vocabularies, one-hot, probe targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import or_missing, salted_sha
from tessera.operators.joins import ContractError, same_key_join
from tessera.operators.quantiles import exact_quantile, quantile_array
from tessera.operators.ranked import ranked
from tessera.session import cut_lineage


def three_digits(c: Column) -> Column:
    """A double with three significant digits and no trailing zeros, like ``%.3g`` in its plain range."""
    size = F.greatest(F.floor(F.log10(F.abs(c))), F.lit(-4)).cast("int")
    plain = F.when(size >= 2, F.format_string("%.0f", c)).when(size == 1, F.format_string("%.1f", c)).when(
        size == 0, F.format_string("%.2f", c)
    ).when(size == -1, F.format_string("%.3f", c)).when(size == -2, F.format_string("%.4f", c)).otherwise(
        F.format_string("%.5f", c)
    )
    trimmed = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(c == 0, F.lit("0")).otherwise(trimmed)


def render(fields: Mapping[str, Column]) -> Column:
    """``[TAG=value] [TAG=value]`` in the given order; NULL prints as the missing marker."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"[{tag}="), or_missing(c), F.lit("]")) for tag, c in fields.items()])


def recorded(text: Column, tag: str) -> Column:
    """Value of a tag in rendered text, NULL when the tag is absent."""
    value = F.regexp_extract(text, rf"\[{tag}=([^\]]*)\]", 1)
    return F.when(value != "", value)


def require_recorded(df: DataFrame, text: str, tag: str, out: str) -> DataFrame:
    parsed = df.withColumn(out, recorded(F.col(text), tag))
    if parsed.where(F.col(out).isNull()).limit(1).count():
        raise ContractError(f"a text has no {tag} field")
    return parsed


def profile_hash(*cols: str) -> Column:
    """Hash of fixed fields, each with its printed missing form."""
    return F.sha2(F.concat_ws("|", *[or_missing(F.col(c)) for c in cols]), 256)


def json_hash(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


# Texts that mean a field was not recorded.
NOT_RECORDED = ("none", "unknown", "unspecified")


def field_rows(df: DataFrame, unit: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Nested record -> ``(unit, field, value, block, provenance, missing)`` rows.

    ``fields`` maps a column to its (block, provenance).
    """
    entries = []
    for name, (block, provenance) in fields.items():
        text = F.trim(F.col(name).cast("string"))
        value = F.when((text == "") | F.lower(text).isin(*NOT_RECORDED), F.lit(None)).otherwise(text)
        entries.append(
            F.struct(
                F.lit(name).alias("field"), value.alias("value"), F.lit(block).alias("block"),
                F.lit(provenance).alias("provenance"), value.isNull().alias("missing"),
            )
        )
    return df.select(unit, F.explode(F.array(*entries)).alias("e")).select(unit, "e.*")


def render_fields(
    rows: DataFrame, unit: str, form: str, blocks: Sequence[str], provenances: Sequence[str], phrases: Mapping[str, str]
) -> DataFrame:
    """Text of the allowed fields per unit in one of three forms.

    ``typed`` lists ``field:value``, ``serialised`` joins ``field=value; ...`` and ``template``
    puts each value into its sentence (``{}`` in ``phrases``). A unit has a fixed, small number of fields.
    """
    allowed = rows.where(F.col("block").isin(*blocks) & F.col("provenance").isin(*provenances) & ~F.col("missing"))
    if form == "typed":
        piece, glue = F.concat_ws(":", "field", "value"), " "
    elif form == "serialised":
        piece, glue = F.concat_ws("=", "field", "value"), "; "
    elif form == "template":
        sentence = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv]), "field"), F.lit("{}"))
        piece, glue = F.replace(sentence, F.lit("{}"), F.col("value")), " "
    else:
        raise ValueError(form)
    packed = allowed.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("field", piece.alias("p")))).alias("v"))
    texts = packed.select(unit, F.array_join(F.transform("v", lambda e: e["p"]), glue).alias("text"))
    return rows.select(unit).distinct().join(texts, unit, "left").withColumn("text", F.coalesce("text", F.lit("")))


def levels(df: DataFrame, train: Column, col: str, out: str, at: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """low / medium / high by quantiles of the training rows."""
    edges = quantile_array(df.where(train), col, at)
    d = df.withColumn("__e", edges.select("q").scalar())
    v = F.col(col)
    level = F.when(v < F.col("__e")[0], F.lit("low")).when(v < F.col("__e")[1], F.lit("medium")).otherwise(F.lit("high"))
    return d.withColumn(out, F.when(v.isNotNull(), level)).drop("__e")


# First letter of a location code, and its second letter.
REGIONS = {"A": "anterior", "P": "posterior", "L": "lateral", "T": "tracheal"}
BODY_SIDES = {"l": "left", "r": "right", "c": "central"}


def parse_location(code: Column) -> Column:
    """``Al`` -> (anterior, left), with ``unknown`` / ``unspecified`` for letters outside the tables."""

    def lookup(values: Mapping[str, str], c: Column, default: str) -> Column:
        table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.coalesce(F.try_element_at(table, c), F.lit(default))

    return F.struct(
        lookup(REGIONS, F.substring(code, 1, 1), "unknown").alias("region"),
        lookup(BODY_SIDES, F.lower(F.substring(code, 2, 1)), "unspecified").alias("side"),
    )


#: Bytes of vocabulary that are broadcast to the encoding of the rows; a larger one is joined by a shuffle.
VOCABULARY_BYTES = 16 << 20


def encoded_nodes(rows: DataFrame, unit: str, train: DataFrame, salt: str, anonymous: bool = False) -> DataFrame:
    """Value ids per (unit, field) from the training vocabulary; unseen and missing values get 0.

    Numeric fields are binned at the training deciles (bin = number of edges below the value). Ids number the distinct
    (field, value) entries in hash order. ``anonymous`` drops the field identity from the vocabulary key.

    Training rows are reduced once, to counts per (field, value); kinds, deciles and tokens follow from those. Fields are
    columns of the study, so their kinds and deciles are literals of one expression, and rows are encoded in place.
    """
    rows = cut_lineage(rows)
    numeric = F.col("value").try_cast("double")
    fit = rows.join(train.select(unit).distinct(), unit, "left_semi").where(~F.col("missing"))
    levels = cut_lineage(fit.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("v", numeric))
    kinds = levels.groupBy("field").agg((F.count(F.lit(1)) == F.count("v")).alias("is_number")).where("is_number")
    numbers = levels.where("v IS NOT NULL").join(F.broadcast(kinds), "field", "left_semi")  # a row per field
    edges = {r["field"]: r["q"] for r in quantile_array(numbers, "v", [i / 10 for i in range(1, 10)], ["field"], "n").collect()}

    def token(d: DataFrame) -> DataFrame:
        entries = [x for f, q in sorted(edges.items()) for x in (F.lit(f), F.array(*[F.lit(float(e)) for e in q]))]
        own = F.try_element_at(F.create_map(*entries), F.col("field")) if entries else F.lit(None).cast("array<double>")
        below = F.size(F.filter(own, lambda e: e < numeric))
        value = F.when(own.isNotNull() & numeric.isNotNull(), F.concat(F.lit("q"), below.cast("string"))).otherwise(F.col("value"))
        return d.withColumn("token", value if anonymous else F.concat_ws("#", "field", value))

    vocabulary = token(levels).select("token").distinct().withColumn("__h", salted_sha(salt, "token"))
    ids = cut_lineage(ranked(vocabulary, [], "__h", "value_id").drop("__h"))
    size = ids.agg(F.coalesce(F.sum(F.octet_length("token") + F.lit(24)), F.lit(0))).first()[0]
    keyed = token(rows).withColumn("token", F.when(~F.col("missing"), F.col("token")))
    return keyed.join(F.broadcast(ids) if size <= VOCABULARY_BYTES else ids, "token", "left").select(
        unit, "field", F.coalesce("value_id", F.lit(0)).alias("value_id"), F.col("missing").cast("int").alias("missing")
    )


def one_hot(df: DataFrame, unit: str, fields: Sequence[str], train: Column, limit: int = 1000) -> DataFrame:
    """Training-vocabulary one-hot in long form, with an UNSEEN level per field.

    Output ``(unit, field, level)``: the one active column per field. Levels outside the training
    vocabulary are UNSEEN, NULL is its own level.
    """
    cells = lambda d: d.select(unit, *[or_missing(F.col(f)).alias(f) for f in fields]).unpivot([unit], list(fields), "field", "level")
    known = cells(df.where(train)).select("field", "level").distinct().withColumn("__k", F.lit(True))
    return same_key_join(cells(df), known, ["field", "level"], "left").select(
        unit, "field", F.when(F.col("__k"), F.col("level")).otherwise(F.lit("UNSEEN")).alias("level")
    )


def one_hot_array(df: DataFrame, fields: Sequence[str], train: Column, out: str, limit: int = 1000) -> tuple[DataFrame, list[str]]:
    """One-hot as an array column and the names of its positions. The vocabulary size is checked."""
    cells = df.where(train).select(*[or_missing(F.col(f)).alias(f) for f in fields]).unpivot([], list(fields), "field", "level")
    found = cells.distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ContractError(f"more than {limit} training levels; use the long form")
    names, columns = [], []
    for f in fields:
        seen = sorted(r["level"] for r in found if r["field"] == f)
        text = or_missing(F.col(f))
        for level in seen:
            names.append(f"{f}={level}")
            columns.append((text == level).cast("double"))
        names.append(f"{f}=UNSEEN")
        columns.append((~text.isin(*seen)).cast("double") if seen else F.lit(1.0))
    return df.withColumn(out, F.array(*columns)), names


def probe_targets(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Binary probe targets; a rule over a NULL source stays NULL."""
    return df.withColumns({name: rule.cast("int") for name, rule in rules.items()})


def above_median(df: DataFrame, col: str) -> Column:
    """Median split as a column (the median of all stated rows is a scalar subquery)."""
    median = exact_quantile(df, col, [0.5])
    return F.col(col) > median.select("quantile").scalar()


def public_columns(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Allow-list projection for reports that leave the site."""
    return df.select(*[c for c in allowed if c in df.columns])
