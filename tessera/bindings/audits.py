"""Descriptive audits, waveform jobs, sampling, gates, sinks and the incremental job."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.bindings.base import CUST, UNITS, count_n, query, r, rounded
from tessera.bindings.splits_balance import PAIRS_C, SMD_CONT, SPLIT_U, cust_pairs, frozen_split, smd_sql
from tessera.operators import gates, joins, profile, quantiles, sampling, setops, splits
from tessera.plans.cohort import data_gate
from tessera.sinks import tables as sinks
from tessera.sources import waveform
from tessera.streaming import ingest



@query(
    "a3_split_label_counts",
    f"WITH {UNITS}, s AS ({SPLIT_U}) SELECT split, sum((y=0)::INT)::BIGINT AS n_0, sum((y=1)::INT)::BIGINT AS n_1, count(*) AS n FROM s GROUP BY 1",
)
def _(t):
    s = frozen_split(t)
    return splits.split_by_label(s, "split", "y")


@query(
    "a3_contingency",
    f"""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT *, {r('n / sum(n) OVER (PARTITION BY o_orderstatus)')} AS row_share, {r('n / sum(n) OVER (PARTITION BY o_orderpriority)')} AS column_share FROM c""",
)
def _(t):
    return rounded(profile.contingency(t("orders"), "o_orderstatus", "o_orderpriority"), "row_share", "column_share")


MISS = """c AS (SELECT d.lang, (n_chars > 1000)::INT AS long, 'quality' AS field, l.quality IS NULL AS m FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id
  UNION ALL SELECT d.lang, (n_chars > 1000)::INT, 'source', d.source IS NULL FROM documents d)"""


@query(
    "a4_missingness",
    f"""WITH {MISS} SELECT field, 'overall' AS scope, 'ALL' AS level, {r('avg(m::INT)')} AS missing_fraction FROM c GROUP BY 1
    UNION ALL SELECT field, 'long', long::VARCHAR, {r('avg(m::INT)')} FROM c GROUP BY 1, 3 UNION ALL SELECT field, 'lang', lang, {r('avg(m::INT)')} FROM c GROUP BY 1, 3""",
)
def _(t):
    d = t("documents").drop("text").join(t("labels"), "doc_id", "left").withColumn("long", (F.col("n_chars") > 1000).cast("int"))
    return rounded(profile.missingness(d, ["quality", "source"], "long", "lang"), "missing_fraction")


DIV = f"""sum(c)::BIGINT AS n, count(*) AS n_unique, {r('max(c)/sum(c)')} AS modal_share, {r('sum(CASE WHEN c>1 THEN c ELSE 0 END)/sum(c)')} AS shared_fraction,
  {r('exp(ln(sum(c)) - sum(c*ln(c))/sum(c))', 4)} AS effective_number"""


@query("a5_profile_diversity", f"WITH g AS (SELECT lang, text, count(*)::DOUBLE AS c FROM documents GROUP BY 1, 2) SELECT lang, {DIV} FROM g GROUP BY 1")
def _(t):
    out = profile.profile_diversity(t("documents"), "text", ["lang"])
    return rounded(rounded(out, "modal_share", "shared_fraction"), "effective_number", places=4)


@query(
    "a6_population_coverage",
    f"""WITH {UNITS}, p AS (SELECT 'standard' AS population, y FROM units UNION ALL SELECT 'matched', y FROM units WHERE lang <> 'en' UNION ALL SELECT 'long', y FROM units WHERE n_chars > 1000)
    SELECT population, count(*) AS n, {r('avg(y)')} AS positive_rate, {r('count(*) / (SELECT count(*) FROM units)')} AS retained FROM p GROUP BY 1""",
)
def _(t):
    pops = {"standard": F.lit(True), "matched": F.col("lang") != "en", "long": F.col("n_chars") > 1000}
    return rounded(profile.population_coverage(t.units().drop("text"), "y", pops), "positive_rate", "retained")


@query(
    "a7_duplicate_signatures",
    """SELECT 'same_key' AS signature, sum(c)::BIGINT AS n, count(*) AS n_distinct, sum(c-1)::BIGINT AS n_duplicate FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'same_measures', sum(c)::BIGINT, count(*), sum(c-1)::BIGINT FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax)""",
)
def _(t):
    return profile.duplicate_signatures(
        t("lineitem"), {"same_key": ["l_orderkey", "l_linenumber"], "same_measures": ["l_quantity", "l_discount", "l_tax"]}
    )


@query(
    "a8_recording_totals",
    "SELECT o_custkey, count(*) AS n_recordings, round(sum(o_totalprice), 2) AS total_duration, min(o_totalprice) AS min_duration, max(o_totalprice) AS max_duration FROM orders GROUP BY 1",
)
def _(t):
    return rounded(profile.recording_totals(t("orders"), "o_custkey", "o_totalprice"), "total_duration", places=2)


@query(
    "a8_recording_lists",
    """WITH k AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('files|' || o_orderkey)) - 1) // 8 AS part FROM orders)
    SELECT o_custkey, part, count(*) AS n_files, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR) AS files FROM k GROUP BY 1, 2""",
)
def _(t):
    return profile.recording_lists(t("orders"), "o_custkey", "o_orderkey", at_most=8)


@query(
    "a10_quantile_summary",
    f"""SELECT l_returnflag, count(*) AS n_finite, {r('avg(l_extendedprice)', 2)} AS mean, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
    round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem GROUP BY 1""",
)
def _(t):
    out = quantiles.quantile_summary(t("lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(out, "mean", places=2), "q25", "median", "q75", places=4)


@query(
    "a10_exact_quantiles_by_range",
    """SELECT l_returnflag, p AS probability, round(CASE p WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.9) END, 4) AS quantile
    FROM lineitem, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(p) GROUP BY 1, 2""",
)
def _(t):
    return rounded(quantiles.exact_quantile(t("lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"]), "quantile", places=4)


@query(
    "a11_domains_with_both_labels",
    f"WITH {UNITS} SELECT source, sum((toxic=0)::INT)::BIGINT AS n_0, sum((toxic=1)::INT)::BIGINT AS n_1, count(DISTINCT toxic) = 2 AS has_both FROM units GROUP BY 1",
)
def _(t):
    return profile.domains_with_both(t.units(), "source", "toxic")


LEAK = ["license", "the", "@", "copyright"]


@query("a12_text_leaks", " UNION ALL ".join(f"SELECT '{w}' AS token, sum(contains(lower(text), '{w}')::INT)::BIGINT AS n_texts FROM documents" for w in LEAK))
def _(t):
    return profile.leaked_texts(t("documents"), "text", LEAK)


@query("a13_text_resolution", "SELECT lang, count(DISTINCT text) AS n_texts, count(*) AS n_rows FROM documents GROUP BY 1")
def _(t):
    return profile.text_resolution(t("documents"), "lang", "text")


@query(
    "a19_batch_collision_floor",
    f"""WITH e AS (SELECT unnest(range(3)) AS epoch), rk AS (SELECT epoch, lang || source AS txt, (row_number() OVER (PARTITION BY epoch ORDER BY sha256('ep|' || epoch || '|' || doc_id)) - 1) // 64 AS batch FROM documents, e),
    c AS (SELECT epoch, batch, txt, count(*)::DOUBLE AS c FROM rk GROUP BY ALL)
    SELECT epoch::INT AS epoch, {r('sum(c*ln(c))/sum(c)')} AS mean_log_k, sum(c)::BIGINT AS n, (max(batch)+1)::BIGINT AS n_batches FROM c GROUP BY 1""",
)
def _(t):
    d = t("documents").select("doc_id", F.concat("lang", "source").alias("txt"))
    return rounded(profile.batch_collision_floor(d, "doc_id", "txt", 64, 3, "ep"), "mean_log_k")


@query(
    "a19_expected_collision",
    f"""WITH g AS (SELECT o_orderpriority AS k, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1),
    t AS (SELECT p, unnest(range(64)) AS j FROM g),
    m AS (SELECT p, j, exp(lgamma(64) - lgamma(j+1) - lgamma(64-j) + j*ln(p) + (63-j)*ln(1-p)) AS q FROM t)
    SELECT {r('sum(p*q*ln(j+1))')} AS expected_log_k, {r('sum(p*q*(j+1))')} AS expected_k FROM m""",
)
def _(t):
    return rounded(profile.expected_collision(t("orders"), "o_orderpriority", 64), "expected_log_k", "expected_k")


@query(
    "a20_pairing_collision",
    f"""WITH {UNITS}, x AS (SELECT unit_id, y, lang || source AS txt FROM units), rk AS (SELECT *, row_number() OVER (ORDER BY sha256('pair|0|' || unit_id)) AS rr, count(*) OVER () AS nn FROM x)
    SELECT 0 AS seed, count(*) AS n, {r('avg((a.txt=b.txt)::INT)')} AS collision_rate FROM rk a JOIN rk b ON b.rr = a.rr % a.nn + 1""",
)
def _(t):
    from tessera.operators import pairing

    d = t.units().select("unit_id", F.concat("lang", "source").alias("txt"))
    return rounded(pairing.collision_rate(pairing.derangement(d, "unit_id", [], "pair"), d, "unit_id", "txt"), "collision_rate")


NORMS = "nm AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) AS nrm, len(embedding) AS d FROM embeddings)"


@query(
    "a21_embedding_audit",
    f"""WITH {NORMS} SELECT count(*) AS n, min(d)::INT AS min_dim, max(d)::INT AS max_dim,
      (SELECT count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS n_not_finite, sum((nrm=0)::INT)::BIGINT AS n_zero,
      {r('min(nrm)')} AS min_norm, {r('avg(nrm)')} AS mean_norm, {r('max(nrm)')} AS max_norm, {r('quantile_cont(nrm, 0.5)')} AS median_norm FROM nm""",
)
def _(t):
    return rounded(profile.embedding_audit(t("embeddings"), "embedding"), "min_norm", "mean_norm", "max_norm", "median_norm")


@query("a21_window_histogram", "SELECT greatest(1, ceil(n_chars / 500.0))::BIGINT AS n_windows, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    windows = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 500.0)).cast("long")
    return profile.window_histogram(t("documents").select(windows.alias("n_windows")), "n_windows")


POOL = """e AS (SELECT vec_id, vec_id % 40 AS unit, vec_id % 120 AS rec, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


@query(
    "a22_pooled_vectors",
    f"""WITH {POOL}, rc AS (SELECT unit, rec, pos, avg(x) AS x FROM e GROUP BY 1, 2, 3), u AS (SELECT unit, pos, avg(x) AS x FROM rc GROUP BY 1, 2)
    SELECT unit, pos::INT - 1 AS pos, {r('x')} AS x FROM u""",
)
def _(t):
    d = t("embeddings").withColumns({"unit": F.col("vec_id") % 40, "rec": F.col("vec_id") % 120})
    v = profile.pooled_vectors(d, "unit", "rec", "embedding")
    return rounded(v.select("unit", F.posexplode("vector").alias("pos", "x")), "x")


@query("a22_max_pooling", f"WITH {POOL} SELECT unit, pos::INT - 1 AS pos, {r('max(x)')} AS x FROM e GROUP BY 1, 2")
def _(t):
    d = t("embeddings").withColumn("unit", F.col("vec_id") % 40)
    return rounded(profile.max_vectors(d, ["unit"], "embedding").select("unit", F.posexplode("vector").alias("pos", "x")), "x")


@query("a23_class_prototypes", f"WITH {POOL} SELECT label, pos::INT - 1 AS pos, {r('avg(x)')} AS x FROM e WHERE vec_id % 10 < 7 GROUP BY 1, 2")
def _(t):
    train = t("embeddings").where("vec_id % 10 < 7")
    return rounded(profile.mean_vectors(train, ["label"], "embedding").select("label", F.posexplode("vector").alias("pos", "x")), "x")


@query(
    "a24_seed_summary",
    f"""WITH g AS (SELECT l_returnflag AS arm, l_linenumber AS seed, avg(l_discount) - 0.05 AS v FROM lineitem GROUP BY 1, 2)
    SELECT arm, count(*) AS n_seeds, {r('avg(v)', 7)} AS mean, {r('stddev_pop(v)', 7)} AS sd, min(sign(v)) = max(sign(v)) AS same_sign FROM g GROUP BY 1""",
)
def _(t):
    g = t("lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed")).agg((F.avg("l_discount") - 0.05).alias("v"))
    return rounded(profile.seed_summary(g, ["arm"], "v"), "mean", "sd", places=7)


@query(
    "a25_comparison_table",
    f"""WITH m AS (SELECT l_returnflag AS arm, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1), b AS (SELECT q AS bq, d AS bd FROM m WHERE arm = 'N')
    SELECT arm, {r('q')} AS quantity, {r('d')} AS discount, {r('q-bq')} AS delta_quantity, {r('d-bd')} AS delta_discount FROM m, b""",
)
def _(t):
    long = t("lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")).unpivot(
        ["arm"], ["quantity", "discount"], "metric", "value"
    )
    out = profile.comparison_table(long, "arm", "metric", "value", "N", ["quantity", "discount"])
    return rounded(out, "quantity", "discount", "delta_quantity", "delta_discount")


@query(
    "a26_grid_deltas",
    f"""WITH g AS (SELECT l_tax AS rho, l_linenumber AS seed, avg(l_quantity) FILTER (l_linestatus='O') - avg(l_quantity) FILTER (l_linestatus='F') AS d FROM lineitem GROUP BY 1, 2)
    SELECT rho, count(*) AS n_seeds, {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS sd, min(sign(d)) = max(sign(d)) AS same_sign FROM g GROUP BY 1""",
)
def _(t):
    d = t("lineitem").select(F.col("l_tax").alias("rho"), F.col("l_linenumber").alias("seed"), F.col("l_linestatus").alias("arm"), "l_quantity")
    return rounded(profile.grid_deltas(d, ["rho"], "arm", "l_quantity", "O", "F"), "mean", "sd")


@query(
    "a27_acquisition_medians",
    f"SELECT l_linestatus, count(*) AS n, quantile_cont(l_quantity, 0.5) AS median_l_quantity, {r('quantile_cont(l_discount, 0.5)')} AS median_l_discount, {r('avg((l_tax > 0)::INT)')} AS clipping_rate FROM lineitem GROUP BY 1",
)
def _(t):
    out = profile.acquisition_medians(t("lineitem"), "l_linestatus", ["l_quantity", "l_discount"], "l_tax")
    return rounded(out, "clipping_rate", "median_l_discount")


@query(
    "a28_shared_hashes",
    "SELECT count(*) AS n_hashes, sum((n>1)::INT)::BIGINT AS n_repeated, sum((m>1)::INT)::BIGINT AS n_shared FROM (SELECT text, count(*) AS n, count(DISTINCT source) AS m FROM documents GROUP BY 1)",
)
def _(t):
    return profile.shared_hashes(t("documents").select(F.sha2("text", 256).alias("h"), "source"), "h", "source")


# ---- waveforms built from the embedding table ----


def wav_table(t):
    """Embeddings as one-second 16-bit recordings, with silent, short and broken ones among them."""
    from collections.abc import Iterator

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, v, label in zip(b["vec_id"], b["embedding"], b["label"]):
                x = np.trunc(np.asarray(v, dtype=np.float64) * 32767).astype("<i2")
                buf = io.BytesIO()
                with wave.open(buf, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(256 if label == 1 else 64)
                    w.writeframes((x * 0 if label == 0 else x).tobytes())
                content = buf.getvalue()
                out.append((f"rec/{k}.wav", content[:60] if label == 2 else content))
            d = pd.DataFrame(out, columns=["path", "content"])
            yield d.assign(length=d["content"].map(len))[["path", "length", "content"]]

    return t("embeddings").mapInPandas(encode, "path string, length long, content binary")


WAV = """w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE trunc(x::DOUBLE * 32767) END) AS v FROM embeddings WHERE label <> 2)"""


@query(
    "s11_waveform_qc",
    f"""WITH {WAV} SELECT 'rec/' || vec_id || '.wav' AS path, CASE label WHEN 0 THEN 'all_zero' WHEN 1 THEN 'too_short' ELSE '' END AS failure, label > 1 AS qc_pass,
      {r('CASE label WHEN 1 THEN 0.25 ELSE 1 END')} AS duration_s, {r('sqrt(list_sum(list_transform(v, lambda x: (x/32768)*(x/32768)))/64)')} AS rms, {r('list_max(list_transform(v, lambda x: abs(x)))/32768')} AS peak,
      {r('len(list_filter(v, lambda x: x=0))/64')} AS zero_fraction FROM w
    UNION ALL SELECT 'rec/' || vec_id || '.wav', 'frame_count_mismatch', false, 1.0, NULL, NULL, NULL FROM embeddings WHERE label = 2""",
)
def _(t):
    qc = waveform.measure_waveforms(wav_table(t))
    out = qc.select("path", F.coalesce("failure", F.lit("")).alias("failure"), "qc_pass", "duration_s", "rms", "peak", "zero_fraction")
    return rounded(out, "duration_s", "rms", "peak", "zero_fraction")


@query(
    "s12_artefact_features",
    f"""WITH {WAV}, a AS (SELECT vec_id, label, sqrt(list_sum(list_transform(v, lambda x: x*x))/64) AS rms, list_max(list_transform(v, lambda x: abs(x))) AS peak, len(list_filter(v, lambda x: abs(x) < 32))/64.0::DOUBLE AS ns FROM w)
    SELECT 'rec/' || vec_id || '.wav' AS path, {r('rms')} AS rms, peak, {r('ns')} AS near_silence_frac, 172.0::DOUBLE AS size_bytes, {r('ln(1+rms)')} AS log_rms, {r('peak/(rms+1e-9::DOUBLE)')} AS crest_factor FROM a""",
)
def _(t):
    f = waveform.artefact_features(waveform.measure_waveforms(wav_table(t)))
    return rounded(f.select("path", "rms", "peak", "near_silence_frac", "size_bytes", "log_rms", "crest_factor"), "rms", "near_silence_frac", "log_rms", "crest_factor")


@query(
    "x3_encoder_hook",
    """SELECT 'rec/' || vec_id || '.wav' AS path, CASE WHEN label = 2 THEN 60 ELSE 172 END AS n_bytes FROM embeddings""",
)
def _(t):
    encode = lambda b: pd.DataFrame({"path": b["path"], "n_bytes": b["content"].map(len).astype("int32")})
    return waveform.encode_recordings(wav_table(t), encode, "path string, n_bytes int")


# ---- sampling ----

CELLS = [("german", "lang = 'de'", 8), ("long", "n_chars > 5000", 8), ("toxic_source", "source = 'src1'", 6), ("filler", "true", 20)]


def _check_sql() -> str:
    ctes, taken = [], []
    for i, (name, cond, quota) in enumerate(CELLS):
        skip = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM c{j})" for j in range(i))
        ctes.append(f"c{i} AS (SELECT doc_id, '{name}' AS cell, {i} AS priority FROM documents WHERE {cond}{skip} ORDER BY sha256('check|' || doc_id) LIMIT {quota})")
        taken.append(f"SELECT * FROM c{i}")
    return f"WITH {', '.join(ctes)} SELECT doc_id, cell FROM ({' UNION ALL '.join(taken)}) ORDER BY priority, sha256('check|' || doc_id) LIMIT 40"


@query("o1_priority_check_set", _check_sql())
def _(t):
    cells = [(n, F.expr(c), q) for n, c, q in CELLS]
    return sampling.check_set(t("documents").drop("text"), "doc_id", cells, 40, "check").select("doc_id", "cell")


@query("o1_stratified_heads", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('head|' || doc_id)) AS r FROM documents) WHERE r <= 2")
def _(t):
    return sampling.stratified_heads(t("documents").drop("text"), "doc_id", ["lang", "source"], 2, "head").select("doc_id", "lang")


@query(
    "o2_extremes",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{f}' AS field, '{s}' AS side, o_orderkey, {f}::DOUBLE AS value FROM orders ORDER BY {f} {o}, o_orderkey LIMIT 5)"
        for f in ("o_totalprice", "o_custkey")
        for s, o in (("smallest", "ASC"), ("largest", "DESC"))
    ),
)
def _(t):
    return sampling.extremes(t("orders"), "o_orderkey", ["o_totalprice", "o_custkey"], 5)


@query("o3_best_family", f"WITH g AS (SELECT p_brand AS family, avg(p_retailprice) AS v FROM part GROUP BY 1) SELECT arg_max(family, v) AS family, {r('max(v)')} AS v FROM g")
def _(t):
    from tessera.operators import heads

    g = t("part").groupBy(F.col("p_brand").alias("family")).agg(F.avg("p_retailprice").alias("v"))
    return rounded(heads.best_family(g, "family", "v"), "v")


@query("o4_ordered_output", f"WITH {PAIRS_C} SELECT pair_id, negative_id, positive_id FROM pairs ORDER BY pair_id")
def _(t):
    out = t.scratch()
    sinks.write_manifest(cust_pairs(t)[1].select("pair_id", "negative_id", "positive_id"), out, order=["pair_id"])
    return t.spark.read.parquet(out)


# ---- gates ----


@query(
    "g1_overlap_guard",
    f"""WITH {UNITS}, s AS ({SPLIT_U}) SELECT 'train_and_test' AS guard, 0::BIGINT AS n_overlap UNION ALL SELECT 'train_and_matched', sum((split='train' AND lang<>'en')::INT)::BIGINT FROM s""",
)
def _(t):
    s = frozen_split(t)
    train = F.col("split") == "train"
    return gates.overlap_guard(s, {"train_and_test": (train, F.col("split") == "test"), "train_and_matched": (train, F.col("lang") != "en")})


GATE = f"""{PAIRS_C}, m AS (SELECT c.*, side FROM cust c JOIN (SELECT negative_id AS u, 0 AS side FROM pairs UNION ALL SELECT positive_id, 1 FROM pairs) x ON u=unit_id),
tot AS (SELECT sum((side=0)::INT)::DOUBLE AS n0, sum((side=1)::INT)::DOUBLE AS n1 FROM m),
p AS (SELECT level, sum((side=0)::INT)/any_value(n0) AS p0, sum((side=1)::INT)/any_value(n1) AS p1 FROM (SELECT side, 'n' || nation AS level FROM m UNION ALL SELECT side, segment FROM m), tot GROUP BY 1),
c AS (SELECT avg(balance) FILTER (side=0) AS m0, avg(balance) FILTER (side=1) AS m1, var_samp(balance) FILTER (side=0) AS v0, var_samp(balance) FILTER (side=1) AS v1 FROM m),
sm AS (SELECT max(abs(s)) AS a FROM (SELECT {smd_sql('p0', 'p1')} AS s FROM p UNION ALL SELECT {SMD_CONT} FROM c)),
ck AS (SELECT 'unit_keys_unique' AS "check", 0::DOUBLE AS o, 0::DOUBLE AS threshold, true AS passed
 UNION ALL SELECT 'enough_pairs', (SELECT count(*) FROM pairs), 100, (SELECT count(*) FROM pairs) >= 100 UNION ALL SELECT 'pair_labels_agree', 0, 0, true
 UNION ALL SELECT 'max_abs_smd', a, 0.12, a <= 0.12 FROM sm UNION ALL SELECT 'max_level_difference', max(abs(p0-p1)), 0.08, max(abs(p0-p1)) <= 0.08 FROM p)"""


@query("g2_data_gate_checks", f"""WITH {GATE} SELECT "check", {r('o')} AS observed, threshold, passed FROM ck""")
def _(t):
    c, pairs = cust_pairs(t)
    return rounded(data_gate(c, pairs, "unit_id", "y", ["balance"], ["segment", "nation"], 100, 0.12, 0.08), "observed")


@query("g2_verdict", f"WITH {GATE} SELECT count(*) AS n_checks, sum((NOT passed)::INT)::BIGINT AS n_failed, CASE WHEN bool_and(passed) THEN 'GO' ELSE 'NO_GO' END AS verdict FROM ck")
def _(t):
    c, pairs = cust_pairs(t)
    return gates.verdict(data_gate(c, pairs, "unit_id", "y", ["balance"], ["segment", "nation"], 100, 0.12, 0.08))


@query(
    "g7_overlap_audit",
    """WITH a AS (SELECT DISTINCT text FROM documents WHERE lang='en'), b AS (SELECT DISTINCT text FROM documents WHERE lang<>'en'), s AS (SELECT count(*) AS v FROM (SELECT text FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1))
    SELECT 'no_common_text' AS "check", (SELECT count(*) FROM a JOIN b ON a.text=b.text)::DOUBLE AS observed, 0::DOUBLE AS threshold, (SELECT count(*) FROM a JOIN b ON a.text=b.text) = 0 AS passed
    UNION ALL SELECT 'no_shared_hash', v, 0, v = 0 FROM s""",
)
def _(t):
    d = t("documents").select(F.sha2("text", 256).alias("h"), "lang", "source")
    rel = setops.set_relation(d.where("lang = 'en'"), d.where("lang <> 'en'"), "h")
    shared = profile.shared_hashes(d, "h", "source")
    return gates.checks_table([("no_common_text", rel.select("n_both"), 0, "=="), ("no_shared_hash", shared.select("n_shared"), 0, "==")])


@query(
    "g8_run_manifest_audit",
    """WITH r AS (SELECT l_returnflag AS arm, l_linenumber AS seed, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
    SELECT * FROM (VALUES ('run_missing', 7::BIGINT), ('run_unexpected', 0), ('run_repeated', 0), ('init_differs_between_arms', 0), ('order_differs_between_arms', (SELECT count(DISTINCT seed) FROM r)), ('schedule_differs', 0), ('loss_not_decreased', 0)) v("check", n_violations)""",
)
def _(t):
    runs = t("lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed")).agg(F.sum("l_quantity").alias("q"))
    runs = runs.select(
        "arm", "seed", F.sha2(F.col("seed").cast("string"), 256).alias("init_hash"), F.sha2(F.concat("arm", "seed"), 256).alias("order_hash"),
        F.col("q").alias("first_loss"), (F.col("q") / 2).alias("last_loss"), F.lit(1000).alias("n_steps"),
    )
    return gates.run_manifest_audit(runs, ["A", "N", "R", "X"], list(range(1, 8)), 1000)


@query(
    "g10_frozen_comparison",
    """SELECT count(*) FILTER (l_orderkey IS NULL) AS n_unmatched, 0.0::DOUBLE AS max_difference, count(*) FILTER (l_orderkey IS NULL) = 0 AS equal
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""",
)
def _(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    frozen = o.join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    return gates.frozen_difference(o, frozen, ["o_orderkey"], ["o_totalprice"])


@query(
    "g11_group_mean_report",
    " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {r(f'avg({a}) FILTER (l_linestatus=$$O$$)')} AS mean_a, {r(f'stddev_pop({a}) FILTER (l_linestatus=$$O$$)')} AS sd_a, {r(f'avg({a}) FILTER (l_linestatus=$$F$$)')} AS mean_b, {r(f'stddev_pop({a}) FILTER (l_linestatus=$$F$$)')} AS sd_b, {r(f'avg({a}) FILTER (l_linestatus=$$O$$) - avg({a}) FILTER (l_linestatus=$$F$$)')} AS delta FROM lineitem"
        for a in ("l_quantity", "l_discount")
    ),
)
def _(t):
    out = gates.group_mean_report(t("lineitem"), "l_linestatus", "O", "F", ["l_quantity", "l_discount"])
    return rounded(out, "mean_a", "sd_a", "mean_b", "sd_b", "delta")


# ---- sinks and the incremental job ----


@query("k1_private_manifest", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    out = t.scratch()
    sinks.write_manifest(t("customer"), out, "csv")
    return t.spark.read.csv(out, header=True).groupBy(F.col("c_mktsegment").alias("segment")).agg(count_n())


@query("k2_public_report", f"WITH {CUST} SELECT segment, count(*) AS n FROM cust GROUP BY 1")
def _(t):
    out = t.scratch()
    report = t.customers().groupBy("segment").agg(count_n()).withColumn("secret", F.lit("x"))
    ids = t("customer").select("c_name")
    sinks.write_public_report(report, ["segment", "n"], out, ids, "c_name")
    return t.spark.read.json(out)


@query("k2_identifier_leaks", """SELECT 'c_name' AS "column", count(*) AS n_cells FROM customer""")
def _(t):
    return sinks.identifier_leaks(t("customer").select("c_name", "c_mktsegment"), t("customer"), "c_name")


@query(
    "k2_contained_identifiers",
    """WITH n AS (SELECT c_mktsegment, 'members: ' || coalesce(string_agg(c_name, ', ') FILTER (c_custkey % 7 = 0), '') AS note FROM customer GROUP BY 1),
    l AS (SELECT 'note' AS "column", n.c_mktsegment FROM n JOIN customer c ON contains(lower(note), lower(c_name)) UNION SELECT 'segment', n.c_mktsegment FROM n JOIN customer c ON contains(lower(n.c_mktsegment), lower(c_name)))
    SELECT "column", count(*) AS n_cells FROM l GROUP BY 1""",
)
def _(t):
    c = t("customer")
    notes = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("largest"), F.concat(F.lit("members: "), F.array_join(F.array_sort(F.collect_set(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")))), ", ")).alias("note")
    )
    return sinks.identifier_leaks(notes, c, "c_name")


@query("k3_no_clobber", "SELECT 'written' AS first, 'identical' AS second")
def _(t):
    out = t.scratch()
    first = sinks.write_if_same(t("orders"), out)
    second = sinks.write_if_same(t("orders").repartition(7, "o_custkey"), out)
    return t("region").limit(1).select(F.lit(first).alias("first"), F.lit(second).alias("second"))


DIGEST = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::VARCHAR" for i in range(4))


@query(
    "k4_content_digest",
    f"""WITH x AS (SELECT sha256('{{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}}') AS h FROM customer)
    SELECT count(*) AS n_rows, sha256(concat_ws('|', count(*)::VARCHAR, {DIGEST})) AS digest FROM x""",
)
def _(t):
    return sinks.content_digest(t("customer").select("c_nationkey", "c_mktsegment"))


@query("k5_two_phase_freeze", f"WITH {UNITS} SELECT count(*) AS n, sum(y)::BIGINT AS n_positive FROM units")
def _(t):
    out = t.scratch()
    sinks.freeze_predictions(t.units().select("unit_id", "y"), out)
    return sinks.open_frozen(t.spark, out).agg(count_n(), F.sum("y").alias("n_positive"))


@query(
    "t1_incremental_job",
    """SELECT 'done' AS state, count(*) AS n FROM documents UNION ALL SELECT * FROM (VALUES ('open', 0::BIGINT), ('unexpected', 0), ('repeated', 0)) v""",
)
def _(t):
    root, out, mark = t.scratch(), t.scratch(), t.scratch()
    t("documents").select("doc_id", "text").where("doc_id % 2 = 0").write.mode("append").parquet(root)
    step = lambda df: df.select("doc_id", F.sha2("text", 256).alias("digest"))
    ingest.stream_table(t.spark, root, step, out, mark)
    t("documents").select("doc_id", "text").where("doc_id % 2 <> 0").write.mode("append").parquet(root)
    done = ingest.stream_table(t.spark, root, step, out, mark)
    return ingest.progress(t("documents"), done, "doc_id")


@query(
    "j8_violations",
    """SELECT 'negative_balance' AS "check", sum((c_acctbal < 0)::INT)::BIGINT AS n_violations FROM customer UNION ALL SELECT 'unknown_nation', 0""",
)
def _(t):
    c = t("customer")
    orphan = c.join(t("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left_anti")
    return joins.violations([("negative_balance", c, F.col("c_acctbal") < 0), ("unknown_nation", orphan, F.lit(True))])

