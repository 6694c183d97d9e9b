"""Splits, folds, pairings, balance and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.bindings.base import CUST, HU, UNITS, query, r, rounded
from tessera.operators import balance, gates, joins, matching, pairing, profile, splits
from tessera.plans.cohort import match_first, split_and_balance, split_first
from tessera.session import cut_lineage

QUOTAS = [("train", 0.70), ("validation", 0.15)]


def split_sql(src: str, strata: str, salt: str, quotas=((0.7, "train"), (0.15, "validation")), rest="test", unit="unit_id") -> str:
    """Reference text of the salted-hash split."""
    taken, cases = [], []
    for q, name in quotas:
        taken.append(f"floor({q}::DOUBLE * n)")
        cases.append(f"WHEN r - 1 < {' + '.join(taken)} THEN '{name}'")
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""SELECT *, CASE {' '.join(cases)} ELSE '{rest}' END AS split FROM (
      SELECT *, row_number() OVER ({part} ORDER BY sha256('{salt}|' || {unit})) AS r, count(*) OVER ({part}) AS n FROM {src})"""


def smd_sql(pa: str, pb: str) -> str:
    scale = f"sqrt(({pa}*(1-{pa}) + {pb}*(1-{pb})) / 2.0::DOUBLE)"
    return f"CASE WHEN {scale} > 0 THEN ({pa}-{pb})/{scale} WHEN {pa}={pb} THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END"


def frozen_split(t):
    """Labelled documents with their split, frozen once and then read by everything that follows."""
    s = splits.stratified_split(t.units().drop("text"), "unit_id", ["y", "lang"], "cohort-v1", QUOTAS, "test")
    return cut_lineage(s)


SPLIT_U = split_sql("units", "y, lang", "cohort-v1")
LEVELS_U = """cells AS (SELECT split, y, 'lang' AS field, lang AS level FROM s UNION ALL
    SELECT split, y, 'toxic', toxic::VARCHAR FROM s),
  tot AS (SELECT split, sum((y=0)::INT) AS n0, sum((y=1)::INT) AS n1 FROM s GROUP BY split),
  lv AS (SELECT split, field, level, sum((y=0)::INT) AS c0, sum((y=1)::INT) AS c1 FROM cells GROUP BY 1, 2, 3),
  p AS (SELECT lv.split, field, level, n0::BIGINT AS n0, n1::BIGINT AS n1, c0/n0::DOUBLE AS p0, c1/n1::DOUBLE AS p1
    FROM lv JOIN tot ON lv.split = tot.split)"""


@query(
    "flagship_split_balance",
    f"""WITH {UNITS}, s AS ({SPLIT_U}), {LEVELS_U},
  g AS (SELECT sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS n_overlap FROM (SELECT unit_id, count(*) AS k FROM s GROUP BY 1))
  SELECT split, field, level, n0, n1, {r('p0')} AS p0, {r('p1')} AS p1, {r(smd_sql('p0', 'p1'))} AS smd,
    {r('p0-p1')} AS difference, n_overlap FROM p, g""",
)
def _(t):
    out = split_and_balance(t.units(), "unit_id", "y", ["y", "lang"], ["lang", "toxic"], "cohort-v1", QUOTAS, "test")
    return rounded(out, "p0", "p1", "smd", "difference")


@query("w1_stratified_split", f"WITH {UNITS} SELECT unit_id, split FROM ({SPLIT_U})")
def _(t):
    return splits.stratified_split(t.units(), "unit_id", ["y", "lang"], "cohort-v1", QUOTAS, "test").select("unit_id", "split")


@query(
    "w1_large_split_counts",
    f"WITH {CUST}, s AS ({split_sql('cust', 'y, segment', 'cust-v1')}) SELECT segment, split, y, count(*) AS n FROM s GROUP BY ALL",
)
def _(t):
    s = splits.stratified_split(t.customers(), "unit_id", ["y", "segment"], "cust-v1", QUOTAS, "test")
    return s.groupBy("segment", "split", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w1_two_part_keep_both",
    f"""WITH {UNITS} SELECT unit_id, CASE WHEN r - 1 < (CASE WHEN n >= 2 THEN
      least(greatest(floor(0.6::DOUBLE * n), 1), n - 1) ELSE floor(0.6::DOUBLE * n) END) THEN 'development' ELSE 'target' END AS split
    FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY y, source, toxic) AS n FROM units
      WINDOW w AS (PARTITION BY y, source, toxic ORDER BY sha256('outer-v1|' || unit_id)))""",
)
def _(t):
    s = splits.stratified_split(
        t.units(), "unit_id", ["y", "source", "toxic"], "outer-v1", [("development", 0.6)], "target", keep_both=True
    )
    return s.select("unit_id", "split")


@query(
    "w2_rounded_signature_split",
    """WITH sig AS (SELECT l_orderkey AS unit_id, string_agg(DISTINCT l_linestatus || ':' || l_returnflag, '|' ORDER BY l_linestatus || ':' || l_returnflag) AS signature
      FROM lineitem GROUP BY 1),
    c AS (SELECT *, count(*) OVER (PARTITION BY signature) AS k FROM sig),
    s AS (SELECT unit_id, CASE WHEN k < 2 THEN 'RARE' ELSE signature END AS stratum FROM c),
    q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('dev|' || unit_id)) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s)
    SELECT stratum, CASE WHEN r - 1 < round_even(0.3::DOUBLE * n, 0) THEN 'dev' ELSE 'report' END AS split, count(*) AS n FROM q GROUP BY 1, 2""",
)
def _(t):
    sig = splits.signature_of(t("lineitem"), "l_orderkey", "l_linestatus", "l_returnflag").withColumnRenamed("l_orderkey", "unit_id")
    s = splits.rounded_split(sig, "unit_id", "signature", "dev", 0.3, ("dev", "report"))
    return s.groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w3_stratified_folds",
    f"""WITH {UNITS}, a AS (SELECT unit_id, y, y || '|' || coalesce(source, 'NA') AS s0 FROM units),
    b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s0) < 5 THEN y || '|RARE' ELSE s0 END AS s FROM a),
    m AS (SELECT min(c) AS least_n FROM (SELECT count(*) AS c FROM units GROUP BY y))
    SELECT unit_id, (CASE WHEN least_n >= 5 THEN (row_number() OVER (PARTITION BY s ORDER BY sha256('fold|' || unit_id)) - 1) % 5 ELSE -1 END)::INT AS fold
    FROM b, m""",
)
def _(t):
    return splits.stratified_folds(t.units(), "unit_id", "y", "source", 5, "fold", required=True).select("unit_id", "fold")


@query(
    "w4_group_split",
    """WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders),
    s AS (SELECT k, CASE WHEN row_number() OVER (ORDER BY sha256('patient|' || k)) - 1 < floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM g)
    SELECT split, count(*) AS n_rows, count(DISTINCT k) AS n_groups FROM orders JOIN s ON k = o_custkey GROUP BY 1""",
)
def _(t):
    s = splits.group_split(t("orders"), "o_custkey", "patient", 0.8, ("train", "test"))
    per = s.groupBy("split", "o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("split").agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


def _row_split(t):
    side = F.when(F.col("o_orderpriority") < "3", "train").otherwise("test")
    return t("orders").select("o_orderkey", "o_custkey", side.alias("split"))


@query(
    "w4_strict_removal",
    """WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority < '3' THEN 'train' ELSE 'test' END AS split FROM orders),
    bad AS (SELECT o_custkey FROM s GROUP BY 1 HAVING min(split) <> max(split))
    SELECT split, count(*) AS n FROM s WHERE o_custkey NOT IN (SELECT o_custkey FROM bad) GROUP BY 1""",
)
def _(t):
    return splits.drop_straddling(_row_split(t), "o_custkey", "split").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w4_split_agreement",
    f"""WITH {CUST}, a AS ({split_sql('cust', 'segment', 'one', ((0.7, 'train'),))}), b AS ({split_sql('cust', 'segment', 'two', ((0.7, 'train'),))})
    SELECT count(*) AS n, {r('avg((a.split = b.split)::INT)')} AS agreement FROM a JOIN b ON a.unit_id = b.unit_id""",
)
def _(t):
    a, b = (splits.stratified_split(t.customers(), "unit_id", ["segment"], s, [("train", 0.7)], "test") for s in ("one", "two"))
    return rounded(splits.split_agreement(a, b, "unit_id", "split"), "agreement")


def derange_sql(src: str, strata: str, salt: str, seeds: str = "(VALUES (0), (1))") -> str:
    part = f"s.seed, {strata}" if strata else "s.seed"
    on = "".join(f" AND a.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}" for c in strata.split(",") if c.strip())
    return f"""rk AS (SELECT s.seed, u.*, row_number() OVER (PARTITION BY {part} ORDER BY sha256('{salt}|' || s.seed || '|' || unit_id)) AS rr,
      count(*) OVER (PARTITION BY {part}) AS nn FROM {src} u, {seeds} s(seed)),
    pr AS (SELECT a.seed, a.unit_id, b.unit_id AS donor_id FROM rk a JOIN rk b ON a.seed = b.seed AND b.rr = a.rr % a.nn + 1{on})"""


@query("w5_derangement_within_label_language", f"WITH {UNITS}, {derange_sql('units', 'y, lang', 'pair')} SELECT * FROM pr")
def _(t):
    return pairing.derangement(t.units(), "unit_id", ["y", "lang"], "pair", (0, 1))


@query("w5_derangement_global", f"WITH {CUST}, {derange_sql('cust', '', 'pair')} SELECT * FROM pr")
def _(t):
    return pairing.derangement(t.customers(), "unit_id", [], "pair", (0, 1))


@query(
    "w6_singleton_strata",
    f"""WITH {UNITS}, g AS (SELECT source, y, toxic, count(*) AS n FROM units GROUP BY ALL)
    SELECT source, y, toxic, n, n = 1 AS singleton FROM g""",
)
def _(t):
    return splits.stratum_support(t.units(), ["source", "y", "toxic"])


@query(
    "w6_pairing_without_singletons",
    f"""WITH {UNITS}, keep AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source, y, toxic) AS k FROM units) WHERE k > 1),
    {derange_sql('keep', 'source, y, toxic', 'drop', '(VALUES (0))')} SELECT * FROM pr""",
)
def _(t):
    return pairing.derangement(t.units(), "unit_id", ["source", "y", "toxic"], "drop", singletons="drop")


@query(
    "w7_pairing_audit",
    f"""WITH {UNITS}, {derange_sql('units', 'y', 'pair')}
    SELECT p.seed, count(*) AS n, sum((p.unit_id = p.donor_id)::INT)::BIGINT AS n_fixed, sum((a.y <> b.y)::INT)::BIGINT AS n_cross_y,
      sum((a.lang <> b.lang)::INT)::BIGINT AS n_cross_lang, count(DISTINCT p.donor_id) AS n_donors, 1::BIGINT AS max_use, true AS bijective
    FROM pr p JOIN units a ON a.unit_id = p.unit_id JOIN units b ON b.unit_id = p.donor_id GROUP BY 1""",
)
def _(t):
    p = pairing.derangement(t.units(), "unit_id", ["y"], "pair", (0, 1))
    return pairing.audit_pairing(p, t.units(), "unit_id", ["y", "lang"])


@query("w7_same_pairing_across_runs", "SELECT 0::BIGINT AS n_different")
def _(t):
    base = t.customers()
    a = pairing.derangement(base, "unit_id", ["y"], "pair")
    b = pairing.derangement(base.repartition(5, "balance"), "unit_id", ["y"], "pair")
    return pairing.pairing_difference(a, b).agg(F.count(F.lit(1)).alias("n_different"))


@query(
    "w8_index_session",
    "SELECT user_id, arg_min(day, sha256('index|' || user_id || '|' || day)) AS day FROM (SELECT DISTINCT user_id, ts::DATE::VARCHAR AS day FROM events) GROUP BY 1",
)
def _(t):
    s = t("events").select("user_id", F.to_date("ts").cast("string").alias("day"))
    return splits.index_session(s, "user_id", "day", "index")


DOCS_HASHED = "h AS (SELECT doc_id, source, lang, sha256(text) AS digest FROM documents)"


@query(
    "w9_keep_one_owner",
    f"""WITH {DOCS_HASHED}, k AS (SELECT digest, arg_min(source, sha256('dedup|' || source)) AS own, count(DISTINCT source) AS m FROM h GROUP BY 1),
    f AS (SELECT digest, source, min(doc_id) AS first_doc FROM h GROUP BY 1, 2)
    SELECT h.doc_id, (m > 1 AND h.source <> own) AS owner_excluded, h.doc_id <> first_doc AS "repeat"
    FROM h JOIN k ON h.digest = k.digest JOIN f ON f.digest = h.digest AND f.source = h.source""",
)
def _(t):
    d = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return profile.keep_one_owner(d, "digest", "source", "doc_id", "dedup").select("doc_id", "owner_excluded", "repeat")


@query(
    "w10_duplicate_flags",
    f"""WITH {DOCS_HASHED}, k AS (SELECT digest, count(DISTINCT source) > 1 AS e FROM h GROUP BY 1),
    n AS (SELECT source, count(*) AS n_recordings FROM h GROUP BY 1)
    SELECT h.doc_id, e AS digest_elsewhere, n_recordings FROM h JOIN k ON h.digest = k.digest JOIN n ON n.source = h.source""",
)
def _(t):
    d = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return profile.duplicate_flags(d, ["digest"], "source").select("doc_id", "digest_elsewhere", "n_recordings")


ONE_APART = "\n    UNION ALL ".join(
    f"""SELECT '{f}' AS field, count(*) AS n_pairs FROM (SELECT {f} AS v, lag({f}) OVER (PARTITION BY {', '.join(x for x in ('p_brand', 'p_type', 'p_size') if x != f)} ORDER BY h) AS p FROM rec) WHERE p <> v"""
    for f in ("p_brand", "p_type", "p_size")
)


@query(
    "w11_one_field_apart",
    f"""WITH rec AS (SELECT p_brand, p_type, p_size::VARCHAR AS p_size, sha256(p_brand || '|' || p_type || '|' || p_size) AS h
    FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)), a AS ({ONE_APART}) SELECT * FROM a WHERE n_pairs >= 20""",
)
def _(t):
    rec = t("part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size")).distinct()
    rec = rec.withColumn("h", F.sha2(F.concat_ws("|", "p_brand", "p_type", "p_size"), 256))
    return profile.one_field_apart(rec, ["p_brand", "p_type", "p_size"], "h", at_least=20)


@query(
    "w12_monotone_dose",
    f"""WITH g AS (SELECT l_returnflag AS flag, l_discount AS dose, sum(l_quantity * l_discount) AS v FROM lineitem GROUP BY 1, 2),
    s AS (SELECT flag, v - lag(v) OVER (PARTITION BY flag ORDER BY dose) AS d FROM g)
    SELECT flag, {r('min(d)', 4)} AS min_step, coalesce(min(d) >= 0, true) AS non_decreasing FROM s GROUP BY 1""",
)
def _(t):
    g = t("lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("dose")).agg(
        F.sum(F.col("l_quantity") * F.col("l_discount")).alias("v")
    )
    return rounded(profile.monotone_check(g, ["flag"], "dose", "v"), "min_step", places=4)


@query(
    "w13_tercile_buckets",
    """WITH e AS (SELECT quantile_cont(o_totalprice, 1/3.0::DOUBLE) AS a, quantile_cont(o_totalprice, 2/3.0::DOUBLE) AS b FROM orders)
    SELECT CASE WHEN o_totalprice <= a THEN 't1' WHEN o_totalprice <= b THEN 't2' ELSE 't3' END AS tercile, count(*) AS n,
      min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, e GROUP BY 1""",
)
def _(t):
    q = profile.quantile_bucket(t("orders"), "o_totalprice", ["t1", "t2", "t3"], "tercile")
    return q.groupBy("tercile").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )


# ---- balance ----

SMD_CONT = "CASE WHEN sqrt((v0+v1)/2) > 0 THEN (m0-m1)/sqrt((v0+v1)/2) WHEN m0=m1 THEN 0.0::DOUBLE WHEN m0-m1 IS NOT NULL THEN 'inf'::DOUBLE END"


@query(
    "a14_continuous_smd",
    f"""WITH {UNITS}, c AS (SELECT lang, y, 'n_chars' AS field, n_chars::DOUBLE AS v FROM units UNION ALL SELECT lang, y, 'toxic', toxic FROM units),
    g AS (SELECT lang, field, count(v) FILTER (y=0) AS n0, count(v) FILTER (y=1) AS n1, avg(v) FILTER (y=0) AS m0, avg(v) FILTER (y=1) AS m1,
      var_samp(v) FILTER (y=0) AS v0, var_samp(v) FILTER (y=1) AS v1 FROM c GROUP BY 1, 2)
    SELECT lang, field, n0, n1, {r('m0', 4)} AS m0, {r('m1', 4)} AS m1, {r(SMD_CONT)} AS smd FROM g""",
)
def _(t):
    out = balance.continuous_smd(t.units(), "y", ["n_chars", "toxic"], ["lang"])
    return rounded(rounded(out, "smd"), "m0", "m1", places=4)


@query(
    "a15_level_smd",
    f"""WITH {CUST}, cells AS (SELECT y, 'segment' AS field, segment AS level FROM cust UNION ALL SELECT y, 'nation', nation::VARCHAR FROM cust),
    tot AS (SELECT sum((y=0)::INT)::BIGINT AS n0, sum((y=1)::INT)::BIGINT AS n1 FROM cust),
    p AS (SELECT field, level, n0, n1, sum((y=0)::INT)/any_value(n0)::DOUBLE AS p0, sum((y=1)::INT)/any_value(n1)::DOUBLE AS p1 FROM cells, tot GROUP BY field, level, n0, n1)
    SELECT field, level, n0, n1, {r('p0')} AS p0, {r('p1')} AS p1, {r(smd_sql('p1', 'p0'))} AS smd, {r('p1-p0')} AS difference FROM p""",
)
def _(t):
    out = balance.level_smd(t.customers(), "y", ["segment", "nation"], direction="positive-negative")
    return rounded(out, "p0", "p1", "smd", "difference")


@query(
    "a16_balance_summary",
    f"""WITH {UNITS}, s AS ({SPLIT_U}), {LEVELS_U}, l AS (SELECT split, {smd_sql('p0', 'p1')} AS smd, p0-p1 AS d FROM p),
    c AS (SELECT split, avg(n_chars) FILTER (y=0) AS m0, avg(n_chars) FILTER (y=1) AS m1, var_samp(n_chars) FILTER (y=0) AS v0, var_samp(n_chars) FILTER (y=1) AS v1 FROM s GROUP BY 1),
    u AS (SELECT * FROM l UNION ALL SELECT split, {SMD_CONT}, 0 FROM c),
    g AS (SELECT split, max(abs(smd)) AS a, max(abs(d)) AS b FROM u GROUP BY 1)
    SELECT split, {r('a')} AS max_abs_smd, {r('b')} AS max_difference, {r('greatest(a/0.12::DOUBLE, b/0.08::DOUBLE)')} AS objective,
      greatest(a/0.12::DOUBLE, b/0.08::DOUBLE) <= 1 AS passed FROM g""",
)
def _(t):
    s = splits.stratified_split(t.units(), "unit_id", ["y", "lang"], "cohort-v1", QUOTAS, "test")
    out = balance.balance_summary(s, "y", ["n_chars"], ["lang", "toxic"], ["split"])
    return rounded(out, "max_abs_smd", "max_difference", "objective")


# ---- matching ----

TIERS_C = [["segment", "nation", "band"], ["segment", "nation"], ["segment"]]


def tiers_sql(src: str, tiers: list[list[str]], salt: str) -> str:
    ctes, left = [], src
    for i, keys in enumerate(tiers):
        k = ", ".join(keys)
        ctes.append(f"""t{i} AS (SELECT *, row_number() OVER (PARTITION BY {k}, y ORDER BY sha256('{salt}|' || unit_id)) AS r{i},
          least(sum((y=0)::INT) OVER (PARTITION BY {k}), sum((y=1)::INT) OVER (PARTITION BY {k})) AS m{i} FROM {left})""")
        ctes.append(f"""p{i} AS (SELECT a.unit_id AS negative_id, b.unit_id AS positive_id, {i} AS tier FROM t{i} a JOIN t{i} b
          ON a.y=0 AND b.y=1 AND a.r{i}=b.r{i} AND a.r{i}<=a.m{i} AND {' AND '.join(f'a.{x}=b.{x}' for x in keys)})""")
        ctes.append(f"l{i} AS (SELECT * FROM t{i} WHERE r{i} > m{i})")
        left = f"l{i}"
    union = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(tiers)))
    ctes.append(f"""pairs AS (SELECT substr(sha256('{salt}-pair|' || negative_id || '|' || positive_id), 1, 16) AS pair_id, * FROM ({union}))""")
    return ", ".join(ctes)


BANDED = "banded AS (SELECT *, floor(balance / 2500)::BIGINT AS band FROM cust)"
PAIRS_C = f"{CUST}, {BANDED}, {tiers_sql('banded', TIERS_C, 'match-v1')}"


def cust_pairs(t):
    c = t.customers().withColumn("band", F.floor(F.col("balance") / 2500))
    return c, matching.match_in_tiers(c, "unit_id", "y", TIERS_C, "match-v1")


@query("j7_matched_pairs", f"WITH {PAIRS_C} SELECT * FROM pairs")
def _(t):
    return cust_pairs(t)[1]


COST_SQL = f"""1.0::DOUBLE * abs(n.balance - p.balance) / 1000.0::DOUBLE + 0.5::DOUBLE * (n.nation <> p.nation)::INT
  + {HU("'tie|' || negative_id || '|' || positive_id")} * 1e-9::DOUBLE"""


@query(
    "j6_pair_cost",
    f"WITH {PAIRS_C} SELECT pair_id, {r(f'({COST_SQL})', 8)} AS cost FROM pairs JOIN cust n ON n.unit_id=negative_id JOIN cust p ON p.unit_id=positive_id",
)
def _(t):
    c, pairs = cust_pairs(t)
    wide = balance.pair_values(pairs, c, "unit_id", ["balance", "nation"])
    cost = matching.pair_cost({"balance": (1.0, 1000.0, 2.0)}, {"nation": 0.5}, matching.pair_tie("tie"))
    return rounded(wide.select("pair_id", cost.alias("cost")), "cost", places=8)


U_CELLS = f"""{UNITS}, uc AS (SELECT unit_id, y, lang, source, toxic, floor(n_chars / 100.0::DOUBLE)::BIGINT AS size, (unit_id % 3) AS grp FROM units)"""


def unit_cells(t):
    return t.units().select(
        "unit_id", "y", "lang", "source", "toxic", F.floor(F.col("n_chars") / 100).alias("size"), (F.col("unit_id") % 3).alias("grp")
    )


SPEC = matching.MatchSpec(equal=("lang",), hamming=("toxic", "source", "grp"), max_hamming=2, numeric="size", caliper=10.0)
HAM = "((a.toxic<>b.toxic)::INT + (a.source<>b.source)::INT + (a.grp<>b.grp)::INT)"


@query(
    "j9_strict_negative_counts",
    f"""WITH {U_CELLS} SELECT a.unit_id, count(b.unit_id) AS n_partner FROM uc a LEFT JOIN uc b
      ON a.lang=b.lang AND a.y<>b.y AND abs(a.size-b.size) <= 10 AND {HAM} <= 2 GROUP BY 1""",
)
def _(t):
    return matching.partner_counts(unit_cells(t), "y", SPEC).select("unit_id", "n_partner")


@query(
    "j9_exact_negative_counts",
    f"""WITH {CUST} SELECT a.unit_id, count(b.unit_id) AS n_partner FROM cust a LEFT JOIN cust b
      ON a.segment=b.segment AND a.nation=b.nation AND a.y<>b.y GROUP BY 1""",
)
def _(t):
    return matching.partner_counts(t.customers(), "y", matching.MatchSpec(equal=("segment", "nation"))).select("unit_id", "n_partner")


@query(
    "x2_exact_match_rule",
    f"""WITH {U_CELLS} SELECT a.unit_id, count(b.unit_id) AS n_partner FROM uc a LEFT JOIN uc b
      ON a.y<>b.y AND a.lang=b.lang AND (a.toxic<>b.toxic)::INT + (a.grp<>b.grp)::INT <= 1 GROUP BY 1""",
)
def _(t):
    rule = matching.MatchSpec(equal=("lang",), hamming=("toxic", "grp"), max_hamming=1)
    return matching.partner_counts(unit_cells(t), "y", rule).select("unit_id", "n_partner")


@query(
    "j10_cross_domain_positives",
    f"""WITH {UNITS}, d AS (SELECT y, source, count(*) AS c FROM units GROUP BY 1, 2), l AS (SELECT y, sum(c) AS c FROM d GROUP BY 1)
    SELECT unit_id, (l.c - d.c)::BIGINT AS n_positive FROM units u JOIN d ON d.y=u.y AND d.source=u.source JOIN l ON l.y=u.y""",
)
def _(t):
    return matching.cross_domain_positives(t.units(), "y", "source").select("unit_id", "n_positive")


@query(
    "j11_nearest_partner",
    f"""WITH {U_CELLS}, d AS (SELECT a.unit_id, round(abs(a.size-b.size)/10.0::DOUBLE + {HAM}, 9) AS tt, {HAM} AS h, abs(a.size-b.size)::DOUBLE AS g
      FROM uc a JOIN uc b ON a.lang=b.lang AND a.y<>b.y),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY tt, h, g) AS rn FROM d)
    SELECT u.unit_id, g AS nearest_gap, coalesce(h, -1) AS nearest_hamming, tt AS nearest_total FROM units u LEFT JOIN k ON k.unit_id=u.unit_id AND rn=1""",
)
def _(t):
    out = matching.nearest_partner(unit_cells(t), "y", SPEC, 10.0)
    return out.select("unit_id", "nearest_gap", F.coalesce("nearest_hamming", F.lit(-1)).alias("nearest_hamming"), "nearest_total")


@query(
    "j11_nearest_mismatches",
    f"""WITH {U_CELLS}, d AS (SELECT a.unit_id, {HAM} AS h, (a.size < 5) = (b.size < 5) AS same FROM uc a JOIN uc b ON a.lang=b.lang AND a.y<>b.y)
    SELECT u.unit_id, coalesce(min(h), -1) AS nearest_mismatches, {r('avg(same::INT) FILTER (h = 0)')} AS strict_agreement
    FROM units u LEFT JOIN d ON d.unit_id=u.unit_id GROUP BY 1""",
)
def _(t):
    u = unit_cells(t).withColumn("short", F.col("size") < 5)
    spec = matching.MatchSpec(equal=("lang",), hamming=("toxic", "source", "grp"))
    out = matching.nearest_mismatches(u, "y", spec, "short")
    known = F.coalesce("nearest_mismatches", F.lit(-1)).alias("nearest_mismatches")
    return rounded(out.select("unit_id", known, "strict_agreement"), "strict_agreement")


EIGHT = ("toxic", "source", "third", "odd", "fifth", "big", "seventh", "eleventh")
EIGHT_SQL = """e8 AS (SELECT unit_id, y, lang, toxic, source, unit_id % 3 AS third, n_chars % 2 AS odd, n_chars % 5 AS fifth, (n_chars > 1500)::INT AS big, unit_id % 7 AS seventh, n_chars % 11 AS eleventh,
  floor(n_chars / 100)::BIGINT AS size FROM units)"""
HAM8 = "(" + " + ".join(f"(a.{f}<>b.{f})::INT" for f in EIGHT) + ")"


def eight_fields(t):
    n, u = F.col("n_chars"), F.col("unit_id")
    return t.units().select(
        "unit_id", "y", "lang", "toxic", "source", (u % 3).alias("third"), (n % 2).alias("odd"), (n % 5).alias("fifth"),
        (n > 1500).cast("int").alias("big"), (u % 7).alias("seventh"), (n % 11).alias("eleventh"), F.floor(n / 100).alias("size"),
    )


@query(
    "j11_nearest_of_eight_fields",
    f"""WITH {UNITS}, {EIGHT_SQL}, d AS (SELECT a.unit_id, {HAM8} AS h, (a.size < 5) = (b.size < 5) AS same FROM e8 a JOIN e8 b ON a.lang=b.lang AND a.y<>b.y)
    SELECT u.unit_id, coalesce(min(h), -1) AS nearest_mismatches, {r('avg(same::INT) FILTER (h = 0)')} AS strict_agreement FROM e8 u LEFT JOIN d ON d.unit_id=u.unit_id GROUP BY 1""",
)
def _(t):
    u = eight_fields(t).withColumn("short", F.col("size") < 5)
    out = matching.nearest_mismatches(u, "y", matching.MatchSpec(equal=("lang",), hamming=EIGHT), "short")
    return rounded(out.select("unit_id", F.coalesce("nearest_mismatches", F.lit(-1)).alias("nearest_mismatches"), "strict_agreement"), "strict_agreement")


@query(
    "j11_nearest_partner_of_eight_fields",
    f"""WITH {UNITS}, {EIGHT_SQL}, d AS (SELECT a.unit_id, round(abs(a.size-b.size)/10.0::DOUBLE + {HAM8}, 9) AS tt, {HAM8} AS h, abs(a.size-b.size)::DOUBLE AS g FROM e8 a JOIN e8 b ON a.lang=b.lang AND a.y<>b.y),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY tt, h, g) AS rn FROM d)
    SELECT u.unit_id, g AS nearest_gap, coalesce(h, -1) AS nearest_hamming, tt AS nearest_total FROM e8 u LEFT JOIN k ON k.unit_id=u.unit_id AND rn=1""",
)
def _(t):
    out = matching.nearest_partner(eight_fields(t), "y", matching.MatchSpec(equal=("lang",), hamming=EIGHT, numeric="size"), 10.0)
    return out.select("unit_id", "nearest_gap", F.coalesce("nearest_hamming", F.lit(-1)).alias("nearest_hamming"), "nearest_total")


TIER_COUNTS = f"""{UNITS}, pt AS (SELECT a.unit_id, a.y, a.source, a.lang, a.toxic,
  count(b.unit_id) AS n_other_source,
  coalesce(sum(((a.lang<>b.lang)::INT + (a.toxic<>b.toxic)::INT = 2)::INT), 0)::BIGINT AS n_differ_2,
  coalesce(sum(((a.lang<>b.lang)::INT + (a.toxic<>b.toxic)::INT = 1)::INT), 0)::BIGINT AS n_differ_1,
  coalesce(sum(((a.lang<>b.lang)::INT + (a.toxic<>b.toxic)::INT = 0)::INT), 0)::BIGINT AS n_differ_0
  FROM units a LEFT JOIN units b ON a.y=b.y AND a.source<>b.source GROUP BY ALL),
ps AS (SELECT *, CASE WHEN n_differ_2>=2 THEN n_differ_2 WHEN n_differ_1>=2 THEN n_differ_1 WHEN n_differ_0>=2 THEN n_differ_0 ELSE 0 END AS n_best FROM pt),
ng AS (SELECT a.unit_id, count(b.unit_id) AS n_partner FROM units a LEFT JOIN units b ON a.source=b.source AND a.lang=b.lang AND a.y<>b.y GROUP BY 1),
jd AS (SELECT ps.*, n_partner FROM ps JOIN ng ON ng.unit_id=ps.unit_id)"""


@query("a9_positive_tiers", f"WITH {TIER_COUNTS} SELECT unit_id, n_other_source, n_differ_2, n_differ_1, n_differ_0, n_best FROM ps")
def _(t):
    out = matching.positive_tiers(t.units(), "y", "source", "lang", "toxic")
    return out.select("unit_id", "n_other_source", "n_differ_2", "n_differ_1", "n_differ_0", "n_best")


def judged_units(t):
    base = t.units().select("unit_id", "y", "source", "lang", "toxic")
    pos = matching.positive_tiers(base, "y", "source", "lang", "toxic")
    neg = matching.partner_counts(base, "y", matching.MatchSpec(equal=("source", "lang"))).select("unit_id", "n_partner")
    return pos.join(neg, "unit_id")


@query(
    "a10_support_quantiles",
    f"""WITH {TIER_COUNTS}, l AS (SELECT unnest(['ALL', y::VARCHAR]) AS scope, n_best, n_partner FROM jd),
    v AS (SELECT scope, 'n_best' AS "count", n_best AS value FROM l UNION ALL SELECT scope, 'n_partner', n_partner FROM l)
    SELECT scope, "count", count(*) AS n_finite, {r('avg(value)')} AS mean, min(value)::DOUBLE AS min, quantile_cont(value, 0.25) AS q25,
      quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, max(value)::DOUBLE AS max FROM v GROUP BY 1, 2""",
)
def _(t):
    return rounded(gates.support_quantiles(judged_units(t), "y", ["n_best", "n_partner"]), "mean")


@query(
    "g4_pair_support",
    f"""WITH {TIER_COUNTS}, l AS (SELECT unnest(['ALL', y::VARCHAR]) AS scope, n_best >= 2 AS p, n_partner >= 1 AS n FROM jd)
    SELECT scope, count(*) AS n_units, {r('avg(p::INT)')} AS positive_ok, {r('avg(n::INT)')} AS negative_ok, {r('avg((p AND n)::INT)')} AS eligible FROM l GROUP BY 1""",
)
def _(t):
    return rounded(gates.pair_support(judged_units(t), "y", "n_best", "n_partner"), "positive_ok", "negative_ok", "eligible")


@query(
    "g4_pair_support_gate",
    f"""WITH {TIER_COUNTS}, e AS (SELECT y, source, (n_best >= 2 AND n_partner >= 1)::INT AS ok FROM jd),
    v AS (SELECT 'overall_coverage' AS "check", avg(ok) AS o, 0.8::DOUBLE AS th FROM e
      UNION ALL SELECT 'each_label_coverage', (SELECT min(a) FROM (SELECT avg(ok) AS a FROM e GROUP BY y)), 0.8
      UNION ALL SELECT 'each_domain_has_both_labels', (SELECT min(b) FROM (SELECT (count(DISTINCT y)=2)::INT AS b FROM e GROUP BY source)), 1)
    SELECT "check", {r('o')} AS observed, th AS threshold, CASE WHEN th = 1 THEN o = 1 ELSE o >= th END AS passed FROM v""",
)
def _(t):
    return rounded(gates.pair_support_gate(judged_units(t), "y", "source", "n_best", "n_partner"), "observed")


@query(
    "a16_exact_mismatches",
    f"""WITH {PAIRS_C}, w AS (SELECT n.segment<>p.segment AS a, n.nation<>p.nation AS b FROM pairs JOIN cust n ON n.unit_id=negative_id JOIN cust p ON p.unit_id=positive_id)
    SELECT 'segment' AS field, sum(a::INT)::BIGINT AS n_mismatch FROM w UNION ALL SELECT 'nation', sum(b::INT)::BIGINT FROM w""",
)
def _(t):
    c, pairs = cust_pairs(t)
    return balance.exact_mismatches(balance.pair_values(pairs, c, "unit_id", ["segment", "nation"]), ["segment", "nation"])


LOO = f"""{PAIRS_C}, w AS (SELECT pair_id, n.balance AS a, p.balance AS b, n.nation AS na, p.nation AS nb FROM pairs JOIN cust n ON n.unit_id=negative_id JOIN cust p ON p.unit_id=positive_id),
lo AS (SELECT x.pair_id AS gone, q.* FROM w x JOIN w q ON q.pair_id <> x.pair_id),
co AS (SELECT gone, avg(a) AS m0, avg(b) AS m1, var_samp(a) AS v0, var_samp(b) AS v1, count(*) AS k FROM lo GROUP BY 1),
cl AS (SELECT gone, level, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT gone, na AS level, 1 AS ca, 0 AS cb FROM lo UNION ALL SELECT gone, nb, 0, 1 FROM lo) GROUP BY 1, 2),
cp AS (SELECT cl.gone, ca/k::DOUBLE AS pa, cb/k::DOUBLE AS pb FROM cl JOIN co ON co.gone=cl.gone),
cm AS (SELECT gone, max(greatest(abs({smd_sql('pa', 'pb')})/0.12::DOUBLE, abs(pa-pb)/0.08::DOUBLE)) AS o FROM cp GROUP BY 1)
SELECT co.gone AS pair_id, {r(f'greatest(abs({SMD_CONT})/0.12::DOUBLE, o)', 5)} AS objective_without FROM co JOIN cm ON cm.gone=co.gone"""


@query("a17_removal_objectives", f"WITH {LOO}")
def _(t):
    c, pairs = cust_pairs(t)
    wide = balance.pair_values(pairs, c, "unit_id", ["balance", "nation"])
    out = balance.removal_objectives(wide, ["balance"], ["nation"]).select("pair_id", "objective_without")
    return rounded(out, "objective_without", places=5)


def trim_sql(minimum: str, to_minimum: bool) -> str:
    """CTE ``walk``: the pairs left after r greedy removals, one round of the recursion for each."""
    gap = lambda pa, pb: f"greatest(abs({smd_sql(pa, pb)})/0.12::DOUBLE, abs({pa}-{pb})/0.08::DOUBLE)"

    def numeric(less: bool) -> str:
        k, cut = ("(n - 1)", lambda s, v: f"({s} - {v})") if less else ("n", lambda s, v: s)
        mean = {v: f"({cut('s' + v, v)} / {k})" for v in "ab"}
        var = {v: f"(({cut('s' + v + v, f'{v}*{v}')} - {cut('s' + v, v)} * {cut('s' + v, v)} / {k}) / ({k} - 1))" for v in "ab"}
        return f"abs(({mean['a']} - {mean['b']}) / sqrt(({var['a']} + {var['b']}) / 2)) / 0.12::DOUBLE"

    over = "OVER (PARTITION BY l)"
    return f"""lv AS (SELECT DISTINCT nation AS l FROM cust),
    walk AS (
      SELECT pair_id, n.balance AS a, p.balance AS b, n.nation AS na, p.nation AS nb, 0 AS r
      FROM pairs JOIN cust n ON n.unit_id=negative_id JOIN cust p ON p.unit_id=positive_id
      UNION ALL
      SELECT pair_id, a, b, na, nb, r + 1 FROM (
        SELECT *, row_number() OVER (ORDER BY greatest(cat, {numeric(True)}), pair_id) AS place, greatest(cat_now, {numeric(False)}) AS now FROM (
          SELECT pair_id, a, b, na, nb, r, n, sa, sb, saa, sbb, max({gap('pa', 'pb')}) AS cat, max({gap('pa0', 'pb0')}) AS cat_now FROM (
            SELECT *, (ca - (na = l)::INT) / (n - 1)::DOUBLE AS pa, (cb - (nb = l)::INT) / (n - 1)::DOUBLE AS pb, ca / n::DOUBLE AS pa0, cb / n::DOUBLE AS pb0 FROM (
              SELECT *, count(*) {over} AS n, sum((na = l)::INT) {over} AS ca, sum((nb = l)::INT) {over} AS cb,
                sum(a) {over} AS sa, sum(b) {over} AS sb, sum(a*a) {over} AS saa, sum(b*b) {over} AS sbb
              FROM walk, lv))
          GROUP BY ALL))
      WHERE place > 1 AND n > ({minimum}){'' if to_minimum else ' AND now > 1'})"""


@query(
    "a18_trim_to_balance",
    f"WITH RECURSIVE {PAIRS_C}, {trim_sql('SELECT count(*) // 2 FROM pairs', False)} SELECT pair_id FROM walk WHERE r = (SELECT max(r) FROM walk)",
)
def _(t):
    c, pairs = cust_pairs(t)
    wide = balance.pair_values(pairs, c, "unit_id", ["balance", "nation"])
    return balance.trim_pairs(wide, ["balance"], ["nation"], pairs.count() // 2).select("pair_id")


@query(
    "j14_pair_members",
    f"""WITH {PAIRS_C} SELECT c.unit_id, pair_id FROM cust c LEFT JOIN
      (SELECT pair_id, negative_id AS unit_id FROM pairs UNION ALL SELECT pair_id, positive_id FROM pairs) m ON m.unit_id=c.unit_id""",
)
def _(t):
    c, pairs = cust_pairs(t)
    return joins.attach_pair(c, pairs, "unit_id").select("unit_id", "pair_id")


@query(
    "j8_key_contract",
    """SELECT * FROM (VALUES ('unit_repeated', 0::BIGINT), ('unit_blank', 0), ('member_unknown', 0), ('member_label_disagrees', 0),
      ('member_outside_target', 0), ('member_in_several_pairs', 0)) v("check", n_violations)""",
)
def _(t):
    c, pairs = cust_pairs(t)
    ids = joins.pair_members(pairs).select(F.col("member_id").alias("unit_id")).withColumn("target", F.lit("matched_target"))
    flagged = c.join(ids, "unit_id", "left").withColumn("split", F.coalesce("target", F.lit("train")))
    return joins.key_contract(flagged, pairs, "unit_id", "y", "split", "matched_target")


@query(
    "g3_split_first",
    f"""WITH {CUST}, s AS ({split_sql('cust', 'y, segment', 'sf')}), banded AS (SELECT *, floor(balance/2500)::BIGINT AS band FROM s WHERE split='test'),
    {tiers_sql('banded', TIERS_C, 'sf-match')} SELECT (SELECT count(*) FROM pairs) AS n_pairs, split, count(*) AS n FROM s GROUP BY split""",
)
def _(t):
    c = t.customers().withColumn("band", F.floor(F.col("balance") / 2500))
    return split_first(c, "unit_id", "y", ["y", "segment"], TIERS_C, "sf", QUOTAS, "test")


@query(
    "g3_match_first",
    f"""WITH {PAIRS_C.replace('match-v1', 'mf-match')}, mem AS (SELECT negative_id AS unit_id FROM pairs UNION ALL SELECT positive_id FROM pairs),
    rest AS (SELECT * FROM cust WHERE unit_id NOT IN (SELECT unit_id FROM mem)), s AS ({split_sql('rest', 'y, segment', 'mf')})
    SELECT (SELECT count(*) FROM pairs) AS n_pairs, split, count(*) AS n FROM s GROUP BY split
    UNION ALL SELECT (SELECT count(*) FROM pairs), 'matched_target', count(*) FROM mem""",
)
def _(t):
    c = t.customers().withColumn("band", F.floor(F.col("balance") / 2500))
    return match_first(c, "unit_id", "y", ["y", "segment"], TIERS_C, "mf", QUOTAS, "test")


@query(
    "g3_match_first_exact_size",
    f"""WITH RECURSIVE {PAIRS_C.replace('match-v1', 'mf-match')}, {trim_sql('SELECT count(*) // 50 FROM cust', True)},
    kept AS (SELECT * FROM pairs WHERE pair_id IN (SELECT pair_id FROM walk WHERE r = (SELECT max(r) FROM walk))),
    mem AS (SELECT negative_id AS unit_id FROM kept UNION ALL SELECT positive_id FROM kept),
    rest AS (SELECT * FROM cust WHERE unit_id NOT IN (SELECT unit_id FROM mem)), s AS ({split_sql('rest', 'y, segment', 'mf')})
    SELECT (SELECT count(*) FROM kept) AS n_pairs, split, count(*) AS n FROM s GROUP BY split
    UNION ALL SELECT (SELECT count(*) FROM kept), 'matched_target', count(*) FROM mem""",
)
def _(t):
    c = t.customers().withColumn("band", F.floor(F.col("balance") / 2500))
    size = c.count() // 50
    return match_first(c, "unit_id", "y", ["y", "segment"], TIERS_C, "mf", QUOTAS, "test", size, ["balance"], ["nation"])


J13 = f"""{UNITS}, rk AS (SELECT *, (row_number() OVER (ORDER BY sha256('batch|' || unit_id)) - 1) // 64 AS batch FROM units),
rec AS (SELECT batch, lang, source, toxic, count(*) AS n FROM rk GROUP BY ALL),
pr AS (SELECT a.batch, a.lang, a.source, a.toxic, a.n, b.n AS bn, ((a.lang=b.lang)::INT + (a.source=b.source)::INT + (a.toxic=b.toxic)::INT)/3.0::DOUBLE AS s,
  a.lang=b.lang AND a.source=b.source AND a.toxic=b.toxic AS same FROM rec a JOIN rec b ON a.batch=b.batch)
SELECT batch, lang, source, toxic, n, {r('sum(CASE WHEN same THEN bn ELSE 0 END)')} AS exact_total, {r('sum(s*bn)')} AS soft_total,
  {r('sum(CASE WHEN s >= 0.75 THEN s*s*s*s*bn ELSE 0 END)')} AS sharp_total FROM pr GROUP BY 1, 2, 3, 4, 5"""


@query("j13_batch_agreement_targets", f"WITH {J13}")
def _(t):
    from tessera.functions import salted_sha
    from tessera.operators.ranked import ranked

    u = t.units().select("unit_id", "lang", "source", "toxic").withColumn("h", salted_sha("batch", "unit_id"))
    b = ranked(u, [], "h").withColumn("batch", F.floor((F.col("rank") - 1) / 64))
    out = matching.agreement_targets(b, "batch", ["lang", "source", "toxic"])
    return rounded(out, "exact_total", "soft_total", "sharp_total")



@query(
    "j13_pair_agreement",
    f"""WITH {UNITS}, {derange_sql('units', 'y', 'agree', '(VALUES (0))')}
    SELECT p.unit_id, {r('((a.lang=b.lang)::INT + (a.source=b.source)::INT + (a.toxic=b.toxic)::INT)/3.0::DOUBLE')} AS share
    FROM pr p JOIN units a ON a.unit_id=p.unit_id JOIN units b ON b.unit_id=p.donor_id""",
)
def _(t):
    u = t.units().drop("text")
    fields = ["lang", "source", "toxic"]
    pairs = joins.apply_donor(u, pairing.derangement(u, "unit_id", ["y"], "agree"), "unit_id", fields)
    return rounded(pairs.select("unit_id", matching.agreement_share(fields).alias("share")), "share")
