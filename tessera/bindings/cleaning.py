"""Sources, cleaning rules, joins with contracts, set operations and encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.bindings.base import CUST, UNITS, count_n, query, r, rounded
from tessera.bindings.splits_balance import SPLIT_U, derange_sql, frozen_split
from tessera.operators import encode, joins, pairing, profile, sampling, setops, splits, validate
from tessera.sources import recordings, tables


# ---- scans and sources ----


@query("s1_delimiter_detection", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(t):
    out = t.scratch()
    t("customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(out, sep=";", header=True)
    df = tables.read_table(t.spark, out)
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        count_n(), F.round(F.sum(F.col("c_acctbal").try_cast("double")), 2).alias("balance")
    )


@query("s2_column_aliases", "SELECT c_mktsegment AS segment, count(*) AS n, NULL::VARCHAR AS note FROM customer GROUP BY 1")
def _(t):
    raw = t("customer").withColumnsRenamed({"c_mktsegment": " Segment ", "c_custkey": "UID"})
    got = tables.resolve_columns(raw, {"uid": ["participant", "uid"], "segment": ["segment"], "note": ["remark"]}, ["uid", "segment"])
    return got.groupBy("segment").agg(count_n(), F.max("note").alias("note"))


@query(
    "s3_platform_union",
    """SELECT CASE c_nationkey % 2 WHEN 0 THEN 'ANDROID' ELSE 'IOS' END AS platform, count(*) AS n,
      count(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END) AS n_segment, 1 AS n_skipped FROM customer GROUP BY 1""",
)
def _(t):
    root, c = t.scratch(), t("customer")
    even = F.col("c_nationkey") % 2 == 0
    one = lambda df, name: df.coalesce(1).write.csv(f"{root}/{name}", header=True)
    one(c.where(even).select(F.col("c_custkey").alias("Uid"), F.col("c_mktsegment").alias("Segment")), "android")
    one(c.where(~even).select(F.col("c_custkey").alias("USER_ID")), "ios")
    one(t("region").select("r_name"), "web")
    merged, skipped = tables.read_many(t.spark, root, "*.csv", {"uid": ["uid", "user_id"], "segment": ["segment"]}, "uid")
    return merged.groupBy("platform").agg(count_n(), F.count("segment").alias("n_segment"), F.lit(skipped).alias("n_skipped"))


@query("s4_unique_key_table", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    out = t.scratch()
    t("orders").select("o_orderkey", "o_orderstatus").write.csv(out, header=True)
    return tables.read_unique(t.spark, out, "o_orderkey").groupBy(F.col("o_orderstatus").alias("status")).agg(count_n())


@query("s5_quality_ratings", "SELECT (quality + toxic) AS quality, count(*) AS n, min(doc_id)::VARCHAR AS first_id FROM labels GROUP BY 1")
def _(t):
    out = t.scratch()
    rows = t("labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_rated")).alias("FILENAME"), (F.col("quality") + F.col("toxic")).alias("QUALITY")
    )
    rows.write.csv(out, header=True)
    rated = tables.read_ratings(t.spark, out, "_rated")
    return rated.groupBy("quality").agg(count_n(), F.min(F.col("unit_id").cast("long")).cast("string").alias("first_id"))


@query(
    "s6_manifest_discovery",
    f"WITH {CUST} SELECT o_custkey AS unit_id, count(*) AS n_files, min('audio/' || o_orderkey) AS first_file FROM orders WHERE o_custkey IN (SELECT unit_id FROM cust WHERE y = 0) AND o_orderstatus <> 'P' GROUP BY 1",
)
def _(t):
    kind = F.when(F.col("o_orderstatus") == "F", "Cough").when(F.col("o_orderstatus") == "O", "BREATH").otherwise("voice")
    manifest = t("orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("path"), kind.alias("modality"))
    found = recordings.discover(t.spark, "audio", t.customers().where("y = 0"), "unit_id", manifest, modalities=("cough", "breath"))
    return found.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_file"))


@query(
    "s6_tree_layouts",
    """WITH p AS (SELECT o_orderkey % 5 AS k, o_custkey, o_orderkey, o_orderstatus, ['_cough.wav', '_COUGH.FLAC', '_breath.wav', '_cough.txt'][1 + o_orderkey % 4] AS tail FROM orders),
    f AS (SELECT o_custkey::VARCHAR AS unit_id, CASE WHEN lower(tail) LIKE '%cough%' THEN 'cough' ELSE 'breath' END AS modality FROM p WHERE k IN (0, 1, 2) AND tail <> '_cough.txt')
    SELECT unit_id, modality, count(*) AS n_files FROM f GROUP BY 1, 2""",
)
def _(t):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("_cough.wav", "_COUGH.FLAC", "_breath.wav", "_cough.txt")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    name, k, unit = F.concat(F.col("o_orderkey").cast("string"), tail), F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    path = (
        F.when(k == 0, F.concat_ws("/", unit, "o_orderstatus", name))
        .when(k == 1, F.concat_ws("/", F.lit("form-app-users"), unit, name))
        .when(k == 2, F.concat_ws("/", F.lit("form-app-users"), unit, F.lit("2020"), F.lit("05"), name))
        .when(k == 3, F.concat_ws("/", unit, F.concat(F.lit("._"), name)))
        .otherwise(name)
    )
    found = recordings.in_layout(t("orders").select(path.alias("path")), "path", "unit_id", "form-app-users", ("cough", "breath"))
    return found.groupBy("unit_id", "modality").agg(F.count(F.lit(1)).alias("n_files"))


def release_paths(t) -> DataFrame:
    """Release-like relative paths of orders: shared web folder, 10- and 12-character subjects, loose files."""
    pad = lambda w: F.lpad(F.col("o_custkey").cast("string"), w, "0")
    name = F.concat(F.col("o_orderkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("_cough", "_Breath", "_read", "_x")]), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(".wav"))
    kind = F.col("o_custkey") % 4
    path = (
        F.when(kind == 0, F.concat_ws("/", F.lit("set/form-app-users"), pad(8), name))
        .when(kind == 1, F.concat_ws("/", F.lit("set"), pad(10), F.col("o_orderstatus"), name))
        .when(kind == 2, F.concat_ws("/", pad(12), F.col("o_orderstatus"), name))
        .otherwise(F.concat_ws("/", F.lit("loose"), name))
    )
    return t("orders").select(path.alias("path"))


RELEASE = """rel AS (SELECT o_custkey, o_orderkey, o_custkey % 4 AS kind, CASE WHEN o_custkey % 4 = 0 THEN o_custkey::VARCHAR ELSE o_orderstatus END AS sample,
  CASE o_orderkey % 4 WHEN 0 THEN 'cough' WHEN 1 THEN 'breath' WHEN 2 THEN 'voice_or_read' ELSE 'other_audio' END AS modality FROM orders),
ps AS (SELECT o_custkey, kind, count(*) AS rec, count(DISTINCT sample) AS sam FROM rel WHERE kind < 3 GROUP BY 1, 2)"""


@query(
    "s7_release_inventory",
    f"""WITH {RELEASE} SELECT 'recordings_per_subject' AS section, rec::VARCHAR AS item, count(*) AS n FROM ps GROUP BY 2
    UNION ALL SELECT 'samples_per_subject', sam::VARCHAR, count(*) FROM ps GROUP BY 2
    UNION ALL SELECT 'platform', CASE kind WHEN 0 THEN 'WEB' WHEN 1 THEN 'ANDROID' ELSE 'IOS' END, count(*) FROM ps GROUP BY 2
    UNION ALL SELECT 'modality', modality, count(*) FROM rel WHERE kind < 3 GROUP BY 2
    UNION ALL SELECT 'check', 'subject_on_several_platforms', 0 UNION ALL SELECT 'check', 'unparsed', count(*) FROM rel WHERE kind = 3""",
)
def _(t):
    return recordings.inventory(recordings.parse_release_path(release_paths(t), "path", "form-app-users"))


@query(
    "s7_recordings_per_subject",
    f"""WITH {RELEASE} SELECT count(*) AS n_finite, {r('avg(rec)')} AS mean, min(rec)::DOUBLE AS min, quantile_cont(rec, 0.25) AS q25, quantile_cont(rec, 0.5) AS median,
      quantile_cont(rec, 0.75) AS q75, max(rec)::DOUBLE AS max FROM ps""",
)
def _(t):
    return rounded(recordings.per_subject_summary(recordings.parse_release_path(release_paths(t), "path", "form-app-users")), "mean")


@query(
    "s8_segment_names",
    """SELECT o_custkey::VARCHAR AS patient, count(DISTINCT o_custkey || '_' || o_orderstatus || '_Al_sc_Unit') AS n_recordings, count(*) AS n_segments FROM orders GROUP BY 1""",
)
def _(t):
    seg = F.concat_ws("_", F.lit("x/"), F.col("o_custkey"))
    seg = F.concat(F.lit("set/"), F.concat_ws("_", F.col("o_custkey"), F.col("o_orderstatus"), F.lit("Al"), F.lit("sc"), F.lit("Unit"), F.concat(F.lit("cycle"), F.col("o_orderkey")), F.lit("normal")), F.lit(".wav"))
    named = t("orders").select(recordings.patient_of(seg).alias("patient"), recordings.recording_of(seg).alias("rec"))
    per = named.groupBy("patient", "rec").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("patient").agg(F.count(F.lit(1)).alias("n_recordings"), F.sum("c").alias("n_segments"))


@query(
    "s8_filter_names",
    """SELECT CASE p_size % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'D' ELSE 'E' END AS filter, lower(p_type) AS diagnosis, count(*) AS n, sum(p_size)::BIGINT AS age_sum FROM part GROUP BY 1, 2""",
)
def _(t):
    letter = F.element_at(F.array(F.lit("B"), F.lit("D"), F.lit("E")), (F.col("p_size") % 3 + 1).cast("int"))
    name = F.concat(letter, F.lit("P"), F.col("p_partkey"), F.lit("_"), F.col("p_type"), F.lit(" ,E  W,P L L,"), F.col("p_size"), F.lit(",m.wav"))
    d = t("part").select(recordings.parse_filter_name(name).alias("x")).select("x.*")
    return d.groupBy("filter", "diagnosis").agg(count_n(), F.sum("age").alias("age_sum"))


@query("s9_split_file", "SELECT CASE WHEN toxic = 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM labels GROUP BY 1")
def _(t):
    out = t.scratch()
    line = F.concat_ws("  ", F.concat(F.lit(" rec"), F.col("doc_id")), F.when(F.col("toxic") == 1, F.lit("TEST")).otherwise(F.lit("Train")))
    t("labels").select(line.alias("value")).unionByName(t("region").select(F.lit("#comment").alias("value"))).write.text(out)
    return tables.read_split_file(t.spark, out).groupBy("split").agg(count_n())


@query(
    "s10_nested_json_rows",
    """SELECT event_type, 'k' AS field, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1""",
)
def _(t):
    rec = t("events").select("event_id", "event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    rows = tables.map_to_rows(rec, "event_type", "m")
    return rows.groupBy("event_type", "field").agg(count_n(), F.sum("value").alias("total"))


@query("s10_json_manifest", "SELECT r_name AS region, count(*) AS n_nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    out = t.scratch()
    nested = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(
        F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations")
    )
    nested.write.json(out)
    man = t.spark.read.json(out)
    return man.select(F.col("r_name").alias("region"), F.explode("nations").alias("x")).groupBy("region").agg(F.count(F.lit(1)).alias("n_nations"))


@query(
    "s13_manifest_agreement",
    f"""WITH a AS (SELECT o_orderkey AS k, (o_custkey % 50)::DOUBLE AS c FROM orders), b AS (SELECT l_orderkey AS k, CASE WHEN count(*) > 6 THEN NULL ELSE sum(l_quantity) END AS d FROM lineitem GROUP BY 1),
    j AS (SELECT a.k AS ak, b.k AS bk, c, d FROM a FULL JOIN b ON a.k = b.k)
    SELECT sum((ak IS NOT NULL AND bk IS NOT NULL)::INT)::BIGINT AS n_checked, sum((bk IS NULL)::INT)::BIGINT AS n_missing, sum((ak IS NULL)::INT)::BIGINT AS n_extra,
      sum((ak IS NOT NULL AND bk IS NOT NULL AND d IS NULL)::INT)::BIGINT AS n_undecodable, sum((coalesce(abs(d-c) > 0.01, false))::INT)::BIGINT AS n_duration_mismatch,
      {r('max(abs(d-c))')} AS max_duration_gap FROM j""",
)
def _(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).cast("double").alias("claimed"))
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))
    b = g.select("k", F.when(F.col("c") <= 6, F.col("q")).alias("decoded"))
    return rounded(recordings.manifest_agreement(a, b, "k", "claimed", "decoded"), "max_duration_gap")


WIN = 512


@query(
    "s14_window_plan",
    f"""WITH p AS (SELECT doc_id, n_chars AS n, greatest(ceil(n_chars / {WIN}.0::DOUBLE), 1)::BIGINT AS c FROM documents),
    w AS (SELECT doc_id, n, c, unnest(range(c)) AS i FROM p)
    SELECT doc_id, i::INT AS "window", (CASE WHEN c = 1 THEN 0 ELSE round_even(i * (n - {WIN})::DOUBLE / (c - 1), 0) END)::BIGINT AS start FROM w""",
)
def _(t):
    return sampling.window_plan(t("documents").select("doc_id", "n_chars"), "n_chars", WIN).select("doc_id", "window", "start")


@query(
    "s15_seed_replication",
    """SELECT l_returnflag AS arm, s.seed, count(*) AS n FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber % 3 END AS sd FROM lineitem) l
      JOIN (VALUES (0), (1), (2)) s(seed) ON l_returnflag = 'N' OR s.seed = l.sd GROUP BY 1, 2""",
)
def _(t):
    flag = F.col("l_returnflag")
    pred = t("lineitem").select(flag.alias("arm"), F.when(flag == "N", 0).otherwise(F.col("l_linenumber") % 3).alias("seed"), "l_orderkey")
    return tables.replicate_single_seed(pred, [0, 1, 2]).groupBy("arm", "seed").agg(count_n())


# ---- projections, filters, validation ----


@query(
    "p1_canonical_text",
    """SELECT lang, count(*) AS n, count(CASE WHEN trim(text) = '' OR lower(trim(text)) = 'nan' THEN NULL ELSE 1 END) AS n_stated, sum(length(trim(text)))::BIGINT AS n_kept_chars FROM documents GROUP BY 1""",
)
def _(t):
    c = fn.canonical(F.col("text"))
    return t("documents").select("lang", c.alias("c")).groupBy("lang").agg(count_n(), F.count("c").alias("n_stated"), F.sum(F.length("c")).alias("n_kept_chars"))


@query(
    "p2_unsafe_values",
    r"""SELECT 'text' AS "column", sum((trim(text) = '' OR regexp_matches(text, '[\[\]\n\r]'))::INT)::BIGINT AS n_unsafe FROM documents
    UNION ALL SELECT 'lang', 0::BIGINT UNION ALL SELECT 'source', 0::BIGINT""",
)
def _(t):
    return validate.unsafe_values(t("documents"), ["text", "lang", "source"])


@query("p3_code_normalisation", "SELECT regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9+]', '', 'g') AS code, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(fn.normalise_code(F.col("o_orderpriority")).alias("code")).agg(count_n())


STATUS = {"o": "OPEN", "f": "FINISHED", "p": "PENDING"}


@query("p4_category_map", "SELECT CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FINISHED' ELSE 'PENDING' END AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return validate.map_strict(t("orders"), "o_orderstatus", STATUS, "status").groupBy("status").agg(count_n())


@query("p4_unknown_values", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def _(t):
    return validate.unknown_values(t("events"), "event_type", {"Click": "C", "view ": "V"})


@query(
    "p5_age_band",
    """WITH a AS (SELECT p_partkey % 7 AS k, p_size * 2.5 AS v FROM part)
    SELECT CASE WHEN k IN (0, 3) THEN '[MISSING]' WHEN k = 1 THEN '30-39' WHEN k = 2 THEN '00-19' WHEN v < 20 THEN '00-19' WHEN v >= 121 THEN NULL WHEN v >= 90 THEN '90+'
      ELSE (floor(v / 10) * 10)::INT || '-' || (floor(v / 10) * 10 + 9)::INT END AS band, count(*) AS n FROM a GROUP BY 1""",
)
def _(t):
    k = F.col("p_partkey") % 7
    raw = F.when(k == 0, F.lit("prefer not to say")).when(k == 1, F.lit("30-29")).when(k == 2, F.lit("16-19"))
    raw = raw.when(k != 3, (F.col("p_size") * 2.5).cast("string"))  # a blank that the reader turned into NULL
    return t("part").groupBy(fn.age_band(raw).alias("band")).agg(count_n())


@query(
    "p6_number_validation",
    """WITH c AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN 'Infinity' ELSE o_totalprice::VARCHAR END AS raw, o_orderkey % 5 AS k, o_totalprice AS v FROM orders)
    SELECT coalesce(CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'not_a_number' WHEN k = 2 THEN 'not_finite' WHEN v < 1000 OR v > 400000 THEN 'out_of_range' END, 'ok') AS problem, count(*) AS n FROM c GROUP BY 1""",
)
def _(t):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.lit("")).when(k == 1, F.lit("n/a")).when(k == 2, F.lit("Infinity")).otherwise(F.col("o_totalprice").cast("string"))
    p = validate.number_problem(raw, 1000, 400000, allow_missing=False)
    return t("orders").groupBy(F.coalesce(p, F.lit("ok")).alias("problem")).agg(count_n())


@query(
    "p7_booleans_and_checkboxes",
    """SELECT CASE l_returnflag WHEN 'R' THEN 'YES' WHEN 'A' THEN 'NO' END AS returned, CASE WHEN l_linestatus = 'O' OR l_discount = 0.05 THEN 'YES' ELSE 'NO' END AS ticked, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    flag = fn.tri_boolean(F.col("l_returnflag"), ["r", "true"], ["a", "false"])
    boxes = [F.col("l_linestatus"), F.when(F.col("l_discount") == 0.05, F.lit("o"))]
    return t("lineitem").groupBy(flag.alias("returned"), fn.checkbox_union(boxes, ["o"]).alias("ticked")).agg(count_n())


@query(
    "p8_label_map",
    "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority = '5-LOW' THEN 0 ELSE -1 END AS y, count(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    y = fn.label_map(F.col("o_orderpriority"), ["1-urgent", "2-HIGH"], ["5-LOW"])
    return t("orders").groupBy(F.coalesce(y, F.lit(-1)).alias("y")).agg(count_n())


@query(
    "p9_split_names_and_language",
    "SELECT CASE WHEN source IN ('src1', 'src2') THEN 'validation' WHEN source = 'src3' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1",
)
def _(t):
    low = F.lower("source")
    name = F.when(low.isin("src1", "src2"), "validation").when(low == "src3", "test").otherwise("train")
    return t("documents").where(F.lower(F.trim("lang")) == "en").groupBy(name.alias("split")).agg(count_n())


@query(
    "p10_platform",
    """WITH u AS (SELECT lpad(c_custkey::VARCHAR, CASE c_nationkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 12 ELSE 8 END, '1') AS uid, CASE c_nationkey % 3 WHEN 0 THEN 'x/Android/a' WHEN 1 THEN 'x/iOS/a' ELSE 'q' END AS p FROM customer)
    SELECT CASE WHEN contains(uid, '202') THEN 'WEB' WHEN length(uid) = 10 THEN 'ANDROID' WHEN length(uid) = 12 THEN 'IOS' ELSE '[MISSING]' END AS by_id,
      CASE WHEN contains(p, 'Android') THEN 'ANDROID' WHEN contains(p, 'iOS') THEN 'IOS' ELSE '[MISSING]' END AS by_path, count(*) AS n FROM u GROUP BY 1, 2""",
)
def _(t):
    k = F.col("c_nationkey") % 3
    key = F.col("c_custkey").cast("string")
    uid = F.when(k == 0, F.lpad(key, 10, "1")).when(k == 1, F.lpad(key, 12, "1")).otherwise(F.lpad(key, 8, "1"))
    path = F.when(k == 0, F.lit("x/Android/a")).when(k == 1, F.lit("x/iOS/a")).otherwise(F.lit("q"))
    return t("customer").groupBy(fn.platform_from_id(uid).alias("by_id"), fn.platform_from_path(path).alias("by_path")).agg(count_n())


@query(
    "p11_half_year",
    "SELECT strftime(o_orderdate, '%Y') || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS half, count(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    return t("orders").groupBy(fn.half_year(F.col("o_orderdate")).alias("half")).agg(count_n())


@query(
    "p11_rare_levels",
    """WITH c AS (SELECT source || '/' || lang AS cell FROM documents), k AS (SELECT cell, count(*) AS m FROM c GROUP BY 1)
    SELECT CASE WHEN m >= 10 THEN c.cell ELSE 'OTHER' END AS cell, count(*) AS n FROM c JOIN k ON k.cell = c.cell GROUP BY 1""",
)
def _(t):
    d = t("documents").select(F.concat_ws("/", "source", "lang").alias("raw"))
    return validate.rare_to_other(d, "raw", 10, "cell").groupBy("cell").agg(count_n())


@query(
    "p12_multiselect_state",
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'pnts' WHEN 'view' THEN '' ELSE event_type || ', other' END AS cell, event_type FROM events)
    SELECT user_id, CASE WHEN bool_or(event_type = 'signup') THEN 'YES' WHEN bool_or(event_type IN ('click', 'purchase', 'signup')) THEN 'NO' END AS state FROM e GROUP BY 1""",
)
def _(t):
    ty = F.col("event_type")
    cell = F.when(ty == "error", F.lit("PNTS")).when(ty == "view", F.lit("")).otherwise(F.concat(ty, F.lit(", other")))
    d = t("events").select("user_id", cell.alias("cell"))
    return validate.multiselect_state(d, "user_id", "cell", ["signup"])


@query("p13_identity_repair", "SELECT count(DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name ELSE c_nationkey::VARCHAR END) AS n_units, count(*) AS n FROM customer")
def _(t):
    d = t("customer").select(F.col("c_nationkey").cast("string").alias("uid"), F.col("c_name").alias("folder"), F.col("c_mktsegment").alias("platform"))
    per = validate.repair_identity(d, "uid", "folder", "platform", "MACHINERY").groupBy("uid").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("n_units"), F.sum("c").alias("n"))


@query(
    "p14_exclusion_waterfall",
    """SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN quality IS NULL THEN 'unlabelled' ELSE 'kept' END AS reason, count(*) AS n
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""",
)
def _(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    rules = [
        ("blank", fn.canonical(F.col("text")).isNull()),
        ("short", F.col("n_chars") < 200),
        ("language", F.col("lang") != "en"),
        ("unlabelled", F.col("quality").isNull()),
    ]
    return validate.exclusion_counts(validate.waterfall(d, rules))


@query(
    "p15_value_audit",
    """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct, 0::BIGINT AS n_missing, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)) AS top_count FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 0, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority)) FROM orders
    UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 0, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)) FROM orders""",
)
def _(t):
    return validate.value_audit(t("orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("p16_prefix_columns", "SELECT 'l_linenumber' AS feature, avg(l_linenumber)::DOUBLE AS mean FROM lineitem UNION ALL SELECT 'l_linestatus_o', avg((l_linestatus = 'O')::INT) FROM lineitem")
def _(t):
    d = t("lineitem").withColumn("l_linestatus_o", (F.col("l_linestatus") == "O").cast("int")).drop("l_linestatus")
    cols = validate.columns_with_prefix(d, "l_line", forbidden=["l_quantity"])
    return d.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], cols, "feature", "mean")


@query(
    "p17_rendered_record",
    f"""WITH {UNITS} SELECT unit_id, '[LANG=' || lang || '] [SOURCE=' || CASE WHEN source = 'src0' THEN '[MISSING]' ELSE source END || '] [SHARE=' || CASE WHEN n_chars % 4 = 0 THEN '0.25' WHEN n_chars % 4 = 1 THEN '12.5' WHEN n_chars % 4 = 2 THEN '3' ELSE '150' END || ']' AS text FROM units""",
)
def _(t):
    k = F.col("n_chars") % 4
    share = F.when(k == 0, 0.25).when(k == 1, 12.5).when(k == 2, 3.0).otherwise(150.0)
    source = F.when(F.col("source") != "src0", F.col("source"))
    return t.units().select("unit_id", encode.render({"LANG": F.col("lang"), "SOURCE": source, "SHARE": encode.three_digits(share)}).alias("text"))


@query("p18_field_from_text", f"WITH {UNITS} SELECT source AS recorded, count(*) AS n FROM units GROUP BY 1")
def _(t):
    d = t.units().select(encode.render({"LANG": F.col("lang"), "SOURCE": F.col("source")}).alias("text"))
    return encode.require_recorded(d, "text", "SOURCE", "recorded").groupBy("recorded").agg(count_n())


@query("p19_profile_hash", f"WITH {UNITS} SELECT sha256(lang || '|' || source || '|' || toxic) AS profile, count(*) AS n FROM units GROUP BY 1")
def _(t):
    return t.units().groupBy(encode.profile_hash("lang", "source", "toxic").alias("profile")).agg(count_n())


FIELDS20 = {"lang": ("context", "dataset"), "source": ("context", "model"), "toxic": ("signal", "dataset")}


def nested_rows(t):
    d = t.units().withColumn("source", F.when(F.col("source").isin("src1", "src2"), F.lit("Unknown")).otherwise(F.col("source")))
    return encode.field_rows(d, "unit_id", FIELDS20)


@query(
    "p20_field_rows",
    f"""WITH {UNITS}, f AS (SELECT 'lang' AS field, lang AS value, 'context' AS block, 'dataset' AS provenance FROM units UNION ALL SELECT 'source', CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE source END, 'context', 'model' FROM units
      UNION ALL SELECT 'toxic', toxic::VARCHAR, 'signal', 'dataset' FROM units)
    SELECT field, block, provenance, count(*) AS n, sum((value IS NULL)::INT)::BIGINT AS n_missing FROM f GROUP BY 1, 2, 3""",
)
def _(t):
    return nested_rows(t).groupBy("field", "block", "provenance").agg(count_n(), F.sum(F.col("missing").cast("long")).alias("n_missing"))


@query(
    "p21_provenance_rendering",
    f"""WITH {UNITS}, s AS (SELECT unit_id, lang, toxic, CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE source END AS source FROM units)
    SELECT unit_id, 'typed' AS form, 'lang:' || lang || ' toxic:' || toxic AS text FROM s
    UNION ALL SELECT unit_id, 'serialised', 'lang=' || lang || coalesce('; source=' || source, '') FROM s
    UNION ALL SELECT unit_id, 'template', 'Written in ' || lang || '.' || coalesce(' Taken from ' || source || '.', '') FROM s""",
)
def _(t):
    rows, words = nested_rows(t), {"lang": "Written in {}.", "source": "Taken from {}."}
    parts = [
        encode.render_fields(rows, "unit_id", "typed", ["context", "signal"], ["dataset"], words),
        encode.render_fields(rows, "unit_id", "serialised", ["context"], ["dataset", "model"], words),
        encode.render_fields(rows, "unit_id", "template", ["context"], ["dataset", "model"], words),
    ]
    named = [p.withColumn("form", F.lit(n)) for p, n in zip(parts, ("typed", "serialised", "template"))]
    return reduce(DataFrame.unionByName, named).select("unit_id", "form", "text")


@query(
    "p22_train_levels",
    f"""WITH {UNITS}, s AS ({SPLIT_U}), e AS (SELECT quantile_cont(n_chars, 0.33) AS a, quantile_cont(n_chars, 0.66) AS b FROM s WHERE split = 'train')
    SELECT split, CASE WHEN n_chars < a THEN 'low' WHEN n_chars < b THEN 'medium' ELSE 'high' END AS level, count(*) AS n FROM s, e GROUP BY 1, 2""",
)
def _(t):
    s = frozen_split(t)
    return encode.levels(s, F.col("split") == "train", "n_chars", "level").groupBy("split", "level").agg(count_n())


@query(
    "p23_location_code",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'anterior' ELSE 'unknown' END AS region, CASE WHEN l_linestatus = 'F' THEN 'right' ELSE 'unspecified' END AS side, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    code = F.concat(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "F", F.lit("r")).otherwise(F.lit("?")))
    d = t("lineitem").select(encode.parse_location(code).alias("x")).select("x.*")
    return d.groupBy("region", "side").agg(count_n())


ENC = f"""{UNITS}, s AS ({SPLIT_U}), f AS (SELECT unit_id, split, 'lang' AS field, lang AS value FROM s UNION ALL SELECT unit_id, split, 'n_chars', n_chars::VARCHAR FROM s),
e AS (SELECT quantile_cont(n_chars, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS ed FROM s WHERE split = 'train'),
tk AS (SELECT unit_id, split, field, CASE WHEN field = 'n_chars' THEN field || '#q' || len(list_filter(ed, lambda z: z < value::DOUBLE)) ELSE field || '#' || value END AS token FROM f, e),
vo AS (SELECT token, row_number() OVER (ORDER BY sha256('vocab|' || token)) AS value_id FROM (SELECT DISTINCT token FROM tk WHERE split = 'train'))"""


@query("p24_vocabulary_encoding", f"WITH {ENC} SELECT unit_id, field, coalesce(value_id, 0)::BIGINT AS value_id, 0 AS missing FROM tk LEFT JOIN vo ON vo.token = tk.token")
def _(t):
    s = frozen_split(t)
    rows = encode.field_rows(s, "unit_id", {"lang": ("a", "d"), "n_chars": ("a", "d")})
    return encode.encoded_nodes(rows, "unit_id", s.where("split = 'train'"), "vocab")


@query(
    "p25_one_hot_unseen",
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, o_orderdate < '1997-01-01' AS tr FROM orders),
    k AS (SELECT DISTINCT month FROM o WHERE tr)
    SELECT 'month' AS field, CASE WHEN month IN (SELECT month FROM k) THEN month ELSE 'UNSEEN' END AS level, count(*) AS n FROM o GROUP BY 1, 2
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM o GROUP BY 2""",
)
def _(t):
    d = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus", "o_orderdate")
    hot = encode.one_hot(d, "o_orderkey", ["month", "o_orderstatus"], F.col("o_orderdate") < "1997-01-01")
    return hot.groupBy("field", "level").agg(count_n())


@query(
    "p26_probe_targets",
    f"""WITH {UNITS}, m AS (SELECT quantile_cont(n_chars, 0.5) AS md FROM units)
    SELECT unit_id, (n_chars > md)::INT AS is_long, CASE WHEN source <> 'src0' THEN (source IN ('src1', 'src2'))::INT ELSE -1 END AS member, (n_chars >= 1000)::INT AS over_1000 FROM units, m""",
)
def _(t):
    u = t.units().withColumn("source", F.when(F.col("source") != "src0", F.col("source")))
    out = encode.probe_targets(
        u, {"is_long": encode.above_median(u, "n_chars"), "member": F.col("source").isin("src1", "src2"), "over_1000": F.col("n_chars") >= 1000}
    )
    return out.select("unit_id", "is_long", F.coalesce("member", F.lit(-1)).alias("member"), "over_1000")


@query("p27_log_covariate", f"SELECT c_mktsegment AS segment, {r('avg(ln(1 + greatest(c_acctbal, 0)))')} AS mean_log FROM customer GROUP BY 1")
def _(t):
    v = F.log1p(F.greatest(F.col("c_acctbal"), F.lit(0.0)))
    return rounded(t("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.avg(v).alias("mean_log")), "mean_log")


@query("p28_public_projection", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def _(t):
    shown = encode.public_columns(t("customer"), ["c_mktsegment", "c_nationkey", "not_there"])
    return shown.groupBy(*shown.columns).agg(count_n())


P29 = {
    "record": f"""WITH {UNITS}, rk AS (SELECT *, row_number() OVER (ORDER BY sha256('ctl|0|' || unit_id)) AS rr, count(*) OVER () AS nn FROM units),
      pr AS (SELECT a.unit_id, b.lang, b.source FROM rk a JOIN rk b ON b.rr = a.rr % a.nn + 1)
      SELECT unit_id, 'lang' AS field, lang AS value FROM pr UNION ALL SELECT unit_id, 'source', source FROM pr""",
    "field": f"""WITH {UNITS}, c AS (SELECT unit_id, 'lang' AS field, lang AS value FROM units UNION ALL SELECT unit_id, 'source', source FROM units),
      rk AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY sha256('ctl|' || field || '|' || unit_id)) AS rr, count(*) OVER (PARTITION BY field) AS nn FROM c)
      SELECT a.unit_id, a.field, b.value FROM rk a JOIN rk b ON b.field = a.field AND b.rr = a.rr % a.nn + 1""",
    "constant": f"""WITH {UNITS}, k AS (SELECT lang, source FROM units ORDER BY sha256('ctl|' || unit_id) LIMIT 1)
      SELECT unit_id, 'lang' AS field, k.lang AS value FROM units, k UNION ALL SELECT unit_id, 'source', k.source FROM units, k""",
    "anonymous": f"WITH {UNITS} SELECT unit_id, 'value' AS field, lang AS value FROM units UNION ALL SELECT unit_id, 'value', source FROM units",
}


def _p29(mode: str) -> None:
    @query(f"p29_shuffle_{mode}", P29[mode])
    def _(t):
        return pairing.shuffled_records(t.units(), "unit_id", ["lang", "source"], mode, "ctl")


for _mode in P29:
    _p29(_mode)

# ---- joins ----


@query("j1_validated_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    n = t("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.validated_join(t("customer"), n, ["c_nationkey"], "many_to_one").groupBy("n_name").agg(count_n())


@query(
    "j2_cohort_assembly",
    """SELECT lang, coalesce(quality, -1) AS quality, count(*) AS n, coalesce(sum(n_user), 0)::BIGINT AS n_turns FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
      LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n_user FROM conversations WHERE role = 'user' GROUP BY 1) c ON c.doc_id = d.doc_id GROUP BY 1, 2""",
)
def _(t):
    turns = t("conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_user"))
    out = joins.assemble(t("documents").select("doc_id", "lang"), "doc_id", [(t("labels"), ["quality"]), (turns, ["n_user"])])
    known = out.withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return known.groupBy("lang", "quality").agg(count_n(), F.coalesce(F.sum("n_user"), F.lit(0)).alias("n_turns"))


@query(
    "j3_membership_status",
    """WITH f AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY 1)
    SELECT CASE WHEN n IS NULL THEN 'not_found' WHEN d > 1 THEN 'conflict' ELSE 'found' END AS status, count(*) AS n, coalesce(sum(f.n), 0)::BIGINT AS n_records FROM customer LEFT JOIN f ON k = c_custkey GROUP BY 1""",
)
def _(t):
    rec = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    out = joins.membership(t("customer"), rec, "c_custkey", "o_orderstatus")
    return out.groupBy("status").agg(count_n(), F.sum("n_records").alias("n_records"))


@query(
    "j4_semi_anti",
    """WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT 'missing' AS gap, count(*) AS n FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'extra', count(*) FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def _(t):
    want = t("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    have = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.coverage_gaps(want, have, ["c_custkey"]).groupBy("gap").agg(count_n())


@query(
    "j5_session_linkage",
    """WITH s AS (SELECT o_custkey AS uid, o_orderkey AS folder, CASE WHEN o_orderstatus = 'O' THEN 'web' ELSE 'android' END AS platform FROM orders)
    SELECT platform, count(*) AS n_rows, count(l_linenumber) AS n_files, coalesce(sum((l_linenumber = 1)::INT), 0)::BIGINT AS n_listed
    FROM s LEFT JOIN lineitem ON l_orderkey = folder AND l_linestatus = 'O' GROUP BY 1""",
)
def _(t):
    web = F.col("o_orderstatus") == "O"
    s = t("orders").select(
        F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderkey").cast("string").alias("folder"),
        F.when(web, F.lit("web")).otherwise(F.lit("android")).alias("platform"), F.lit("1_cough.wav").alias("listed_name"),
    )
    owner = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(web, F.lit("form-app-users")).otherwise(F.col("o_custkey").cast("string")).alias("uid"))
    kind = F.when(F.col("l_linestatus") == "O", F.lit("_cough.wav")).otherwise(F.lit("_voice.wav"))
    files = t("lineitem").join(owner, "l_orderkey").select(
        "uid", F.col("l_orderkey").cast("string").alias("folder"), F.concat(F.col("l_linenumber").cast("string"), kind).alias("file_name")
    ).withColumn("path", F.concat_ws("/", "uid", "folder", "file_name"))
    out = joins.link_sessions(s, files, "web", "form-app-users", "cough")
    return out.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("path").alias("n_files"), F.sum(F.col("listed").cast("long")).alias("n_listed")
    )


@query(
    "j12_donor_columns",
    f"""WITH {UNITS}, {derange_sql('units', 'y', 'pair', '(VALUES (0))')} SELECT a.lang, b.lang AS donor_lang, count(*) AS n FROM pr p JOIN units a ON a.unit_id = p.unit_id JOIN units b ON b.unit_id = p.donor_id GROUP BY 1, 2""",
)
def _(t):
    p = pairing.derangement(t.units(), "unit_id", ["y"], "pair")
    return joins.apply_donor(t.units(), p, "unit_id", ["lang"]).groupBy("lang", "donor_lang").agg(count_n())


@query("j15_once_per_distinct", "SELECT doc_id, len(regexp_split_to_array(text, '\\s+'))::INT AS n_words FROM documents")
def _(t):
    out = joins.per_distinct(t("documents").select("doc_id", "text"), "text", "n_words", lambda c: F.size(F.split(c, r"\s+")))
    return out.select("doc_id", "n_words")


# ---- consistency aggregates and set operations ----


@query(
    "a1_static_collapse",
    """WITH g AS (SELECT user_id, min(event_type) AS a, max(event_type) AS b FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN a = b THEN a END AS event_type, CASE WHEN a <> b THEN 'conflicting_event_type' END AS reason FROM g""",
)
def _(t):
    return validate.collapse_static(t("events"), "user_id", ["event_type"])


@query(
    "x4_field_normaliser",
    """WITH e AS (SELECT o_custkey, regexp_replace(lower(trim(split_part(o_orderpriority, '-', 2))), '[^a-z0-9+]', '', 'g') AS p FROM orders),
    g AS (SELECT o_custkey, min(p) AS a, max(p) AS b FROM e GROUP BY 1) SELECT o_custkey, CASE WHEN a = b THEN a END AS priority, CASE WHEN a <> b THEN 'conflicting_priority' END AS reason FROM g""",
)
def _(t):
    word = F.regexp_extract("o_orderpriority", r"^\d-(.*)$", 1)
    d = t("orders").select("o_custkey", word.alias("priority"))
    return validate.collapse_static(d, "o_custkey", ["priority"], lambda c: fn.normalise_code(c))


@query(
    "a2_label_conflicts",
    """WITH e AS (SELECT user_id AS u, ts::DATE AS s, event_type AS st, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS l FROM events),
    s AS (SELECT u, s, min(l) <> max(l) AS w FROM e GROUP BY 1, 2),
    p AS (SELECT e.u, count(DISTINCT st) > 1 AS raw, count(DISTINCT l) > 1 AS strict FROM e GROUP BY 1),
    x AS (SELECT p.*, (SELECT coalesce(bool_or(w), false) FROM s WHERE s.u = p.u) AS wi FROM p)
    SELECT count(*) AS n_units, sum(raw::INT)::BIGINT AS n_raw_conflict, sum(strict::INT)::BIGINT AS n_label_conflict, sum(wi::INT)::BIGINT AS n_within_session, sum((strict AND NOT wi)::INT)::BIGINT AS n_across_sessions_only FROM x""",
)
def _(t):
    e = t("events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("label", fn.label_map(F.col("event_type"), ["purchase"], ["error"]))
    return validate.label_conflicts(e, "user_id", "day", "event_type", "label")


@query(
    "u1_heterogeneous_union",
    "SELECT kind, count(*) AS n, count(acct) AS n_acct, count(size) AS n_size FROM (SELECT 'c' AS kind, c_acctbal AS acct, NULL AS size FROM customer UNION ALL SELECT 'p', NULL, p_size FROM part) GROUP BY 1",
)
def _(t):
    c = t("customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("acct"))
    p = t("part").select(F.lit("p").alias("kind"), F.col("p_size").alias("size"))
    return setops.union_all([c, p]).groupBy("kind").agg(count_n(), F.count("acct").alias("n_acct"), F.count("size").alias("n_size"))


@query(
    "u2_overlap_matrix",
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n_common FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""",
)
def _(t):
    return profile.overlap_matrix(t("events"), "user_id", "event_type")


@query(
    "u3_set_relation",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
    SELECT (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_only_b,
      (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) + (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS equal""",
)
def _(t):
    o = t("orders")
    return setops.set_relation(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey")


@query(
    "u4_shard_merge",
    """SELECT * FROM (VALUES ('not_covered', 0::BIGINT), ('unexpected', 0), ('covered_twice', 0), ('version_differs', 0)) v("check", n_violations)""",
)
def _(t):
    o = t("orders").select("o_orderkey", F.lit("v1").alias("version"))
    shards = [o.where(F.pmod("o_orderkey", F.lit(3)) == k) for k in range(3)]
    return setops.merge_parts(shards, ["o_orderkey"], o, ["version"])[1]


# ---- scalar functions ----


@query(
    "f1_string_functions",
    """SELECT upper(split_part(o_orderpriority, '-', 2)) AS word, max(length(o_orderpriority)) AS longest, count(*) AS n, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1""",
)
def _(t):
    word = F.upper(F.regexp_extract("o_orderpriority", r"^\d-(.*)$", 1))
    return t("orders").groupBy(word.alias("word")).agg(
        F.max(F.length("o_orderpriority")).cast("long").alias("longest"), count_n(), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses")
    )


@query(
    "f2_hash_functions",
    "SELECT substr(sha256('id|' || c_custkey), 1, 16) AS short_id, round((('0x' || substr(sha256('id|' || c_custkey), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0::DOUBLE, 9) AS unit FROM customer",
)
def _(t):
    h = fn.salted_sha("id", "c_custkey")
    return t("customer").select(F.substring(h, 1, 16).alias("short_id"), F.round(fn.hash_unit(h), 9).alias("unit"))


@query(
    "f3_math_functions",
    f"""WITH p AS (SELECT greatest(least(l_discount * 10, 0.99::DOUBLE), 0.01::DOUBLE) AS p FROM lineitem)
    SELECT p, count(*) AS n, {r('avg(ln(p) - ln(1-p))')} AS logit, {r('avg(1/(1+exp(-(ln(p) - ln(1-p)))))')} AS back, {r('avg(-(p*ln(p) + (1-p)*ln(1-p)))')} AS entropy FROM (SELECT round(p, 4) AS p FROM p) GROUP BY 1""",
)
def _(t):
    p = F.round(fn.clip(F.col("l_discount") * 10, 0.01, 0.99), 4)
    z = fn.logit(F.col("p"))
    d = t("lineitem").select(p.alias("p"))
    e = -(F.col("p") * F.log("p") + (1 - F.col("p")) * F.log(1 - F.col("p")))
    out = d.groupBy("p").agg(count_n(), F.avg(z).alias("logit"), F.avg(fn.sigmoid(z)).alias("back"), F.avg(e).alias("entropy"))
    return rounded(out, "logit", "back", "entropy")


@query(
    "f4_date_functions",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y%m%d') AS tag, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").groupBy(day.alias("day"), F.replace(day, F.lit("-"), F.lit("")).alias("tag")).agg(count_n())


@query(
    "f5_array_functions",
    f"""SELECT label, {r('avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))')} AS mean_norm, {r('avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE)))')} AS mean_sum, max(len(embedding) * 2)::INT AS fused FROM embeddings GROUP BY 1""",
)
def _(t):
    e = F.col("embedding")
    total = F.aggregate(e.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    out = t("embeddings").groupBy("label").agg(
        F.avg(fn.l2_norm(e)).alias("mean_norm"), F.avg(total).alias("mean_sum"), F.max(F.size(F.concat(e, e))).alias("fused")
    )
    return rounded(out, "mean_norm", "mean_sum")


@query("f6_json_functions", """SELECT (props->>'k')::BIGINT AS k, count(*) AS n, min(sha256('{"k":' || (props->>'k') || '}')) AS digest FROM events GROUP BY 1""")
def _(t):
    s = F.from_json("props", "k bigint")
    d = t("events").select(s.alias("s"))
    return d.groupBy(F.col("s.k").alias("k")).agg(count_n(), F.min(F.sha2(F.to_json("s"), 256)).alias("digest"))

