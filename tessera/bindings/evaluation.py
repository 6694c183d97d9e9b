"""Metrics, calibration, bootstrap intervals, retrieval and linear readouts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hash_unit, salted_sha
from tessera.bindings.base import H, HU, PREDS, UNITS, query, r, rounded
from tessera.bindings.splits_balance import SPLIT_U, frozen_split, split_sql
from tessera.operators import bootstrap, calibrate, gates, heads, metrics, profile, readouts, retrieval, splits
from tessera.plans.evaluation import compare_arms
from tessera.session import cut_lineage

CELL = ["arm", "seed"]
BASE = f"WITH {UNITS}, {PREDS}"
EPS = "1e-6::DOUBLE"


def auc_sql(src: str, cell: str, score: str = "logit", label: str = "y", weight: str = "1") -> str:
    """AUROC with average-rank ties in SQL: cumulative negatives over distinct scores."""
    return f"""SELECT {cell}, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg,
      CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (cn - n + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)) END AS auroc FROM (
      SELECT *, sum(n) OVER (PARTITION BY {cell} ORDER BY s) AS cn FROM (
        SELECT {cell}, {score} AS s, sum(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN {label} = 0 THEN {weight} ELSE 0 END)::DOUBLE AS n
        FROM {src} GROUP BY {cell}, {score})) GROUP BY {cell}"""


CP = f"greatest(least(prob, 1 - {EPS}), {EPS})"
LOSS = f"(CASE WHEN y = 1 THEN -ln({CP}) ELSE -ln(1 - {CP}) END)"
Z = f"(ln({CP}) - ln(1 - {CP}))"


@query("m1_auroc", f"{BASE} SELECT arm, seed, n_pos, n_neg, {r('auroc')} AS auroc FROM ({auc_sql('preds', 'arm, seed')})")
def _(t):
    return rounded(metrics.auroc(t.predictions(), CELL, "logit", "y"), "auroc")


@query(
    "m1_auroc_large_cells",
    f"WITH x AS (SELECT l_returnflag AS flag, round(l_extendedprice, 0) AS s, (l_linestatus = 'O')::INT AS y FROM lineitem) SELECT flag, n_pos, n_neg, {r('auroc')} AS auroc FROM ({auc_sql('x', 'flag', 's')})",
)
def _(t):
    d = t("lineitem").select(F.col("l_returnflag").alias("flag"), F.round("l_extendedprice", 0).alias("s"), (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return rounded(metrics.auroc(d, ["flag"], "s", "y"), "auroc")


PM = f"""count(*) AS n, {r('avg(y)')} AS prevalence, {r(f'avg({LOSS})')} AS nll, {r(f'avg({LOSS}) FILTER (y=1)')} AS nll_positive, {r(f'avg({LOSS}) FILTER (y=0)')} AS nll_negative"""


@query("m2_log_loss", f"{BASE} SELECT arm, seed, {PM}, {r(f'avg({LOSS}) - ln(2.0::DOUBLE)')} AS excess_nll FROM preds GROUP BY 1, 2")
def _(t):
    out = metrics.probability_metrics(t.predictions(), CELL, "y", "prob")
    cols = ["prevalence", "nll", "nll_positive", "nll_negative", "excess_nll"]
    return rounded(out, *cols).select(*CELL, "n", *cols)


@query(
    "m3_brier_entropy_spread",
    f"""{BASE}, z0 AS (SELECT arm, seed, ln(avg(y)/(1-avg(y))) AS p0 FROM preds GROUP BY 1, 2)
    SELECT p.arm, p.seed, {r(f'avg(({CP}-y)*({CP}-y))')} AS brier, {r(f'1 - avg(({CP}-y)*({CP}-y))/0.25')} AS brier_skill, {r(f'avg(-({CP}*ln({CP}) + (1-{CP})*ln(1-{CP})))')} AS entropy,
      {r(f'stddev_pop({Z})')} AS logit_sd, {r(f'avg(abs({Z} - p0))')} AS mean_abs_logit FROM preds p JOIN z0 ON z0.arm=p.arm AND z0.seed=p.seed GROUP BY 1, 2""",
)
def _(t):
    p = t.predictions()
    out = metrics.probability_metrics(p, CELL, "y", "prob").select(*CELL, "brier", "brier_skill", "entropy", "logit_sd")
    out = out.join(metrics.prior_centred_logit(p, CELL, "y", "prob"), CELL)
    return rounded(out, "brier", "brier_skill", "entropy", "logit_sd", "mean_abs_logit")


def newton_sql(src: str, cell: str, x: str, steps: int = 9, l2: float = 0.0, fixed: bool = False, weight: str = "1") -> str:
    """Unrolled Newton steps of the two-parameter logistic fit, as CTEs ending in ``fit``."""
    on = " AND ".join(f"d.{c.strip()} IS NOT DISTINCT FROM b.{c.strip()}" for c in cell.split(","))
    dc = ", ".join(f"d.{c.strip()}" for c in cell.split(","))
    start = "ln(my) - ln(1 - my)" + (" - mx" if fixed else "")
    out = [
        f"da AS (SELECT {cell}, {x} AS x, y::DOUBLE AS y, sum({weight})::DOUBLE AS w FROM {src} GROUP BY ALL)",
        f"b0 AS (SELECT {cell}, {start} AS a, {1.0 if fixed else 0.0}::DOUBLE AS s FROM (SELECT {cell}, sum(w*y)/sum(w) AS my, sum(w*x)/sum(w) AS mx FROM da GROUP BY {cell}))",
    ]
    for i in range(steps):
        step = (
            "least(greatest(a - g0/h00, -100), 100) AS a, s"
            if fixed
            else f"least(greatest(a - ((h11+{l2})*g0 - h01*(g1+{l2}*s))/(h00*(h11+{l2}) - h01*h01), -100), 100) AS a, least(greatest(s - (h00*(g1+{l2}*s) - h01*g0)/(h00*(h11+{l2}) - h01*h01), -100), 100) AS s"
        )
        out.append(f"""q{i} AS (SELECT {dc}, b.a, b.s, d.x, d.y, d.w, 1/(1+exp(-least(greatest(b.a + b.s*d.x, -40), 40))) AS p FROM da d JOIN b{i} b ON {on}),
        g{i} AS (SELECT {cell}, any_value(a) AS a, any_value(s) AS s, sum(w*(p-y)) AS g0, sum(w*(p-y)*x) AS g1, sum(w*greatest(p*(1-p), 1e-9::DOUBLE)) AS h00, sum(w*greatest(p*(1-p), 1e-9::DOUBLE)*x) AS h01, sum(w*greatest(p*(1-p), 1e-9::DOUBLE)*x*x) AS h11 FROM q{i} GROUP BY {cell}),
        b{i + 1} AS (SELECT {cell}, {step} FROM g{i})""")
    last = f"b{steps} d JOIN b{steps - 1} b ON {on}"
    out.append(f"fit AS (SELECT {dc}, d.a AS intercept, d.s AS slope, greatest(abs(d.a - b.a), abs(d.s - b.s)) < 1e-8 AS converged FROM {last})")
    return ", ".join(out)


@query(
    "m4_calibration_slope",
    f"{BASE}, {newton_sql('preds', 'arm, seed', 'logit', l2=1.0)} SELECT arm, seed, {r('intercept')} AS intercept, {r('slope')} AS slope, converged FROM fit",
)
def _(t):
    return rounded(calibrate.fit_cells(t.predictions(), CELL, "logit", "y", l2=1.0), "intercept", "slope")


@query(
    "m4_calibration_in_the_large",
    f"{BASE}, {newton_sql('preds', 'arm, seed', 'logit', fixed=True)} SELECT arm, seed, {r('intercept')} AS intercept, converged FROM fit",
)
def _(t):
    return rounded(calibrate.fit_cells(t.predictions(), CELL, "logit", "y", fixed_slope=True).drop("slope"), "intercept")


@query(
    "m5_confusion_metrics",
    f"""{BASE}, c AS (SELECT arm, seed, quantile_cont(logit, 0.5) AS cut FROM preds GROUP BY 1, 2), k AS (SELECT p.arm, p.seed, sum((logit>cut AND y=1)::INT)::DOUBLE AS tp, sum((logit>cut AND y=0)::INT)::DOUBLE AS fp, sum((logit<=cut AND y=1)::INT)::DOUBLE AS fn, sum((logit<=cut AND y=0)::INT)::DOUBLE AS tn
      FROM preds p JOIN c ON c.arm=p.arm AND c.seed=p.seed GROUP BY 1, 2)
    SELECT arm, seed, {r('(tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))')} AS mcc, {r('(2*tp/(2*tp+fp+fn) + 2*tn/(2*tn+fp+fn))/2')} AS macro_f1, {r('(tp/(tp+fn) + tn/(tn+fp))/2')} AS balanced_accuracy, {r('(tp+fp)/(tp+fp+fn+tn)')} AS positive_rate, false AS degenerate FROM k""",
)
def _(t):
    out = metrics.confusion_metrics(t.predictions(), CELL, "y", "logit")
    return rounded(out, "mcc", "macro_f1", "balanced_accuracy", "positive_rate")


RES = f"""res AS (SELECT a.arm, a.seed, auroc, nll, brier FROM ({auc_sql('preds', 'arm, seed')}) a JOIN (SELECT arm, seed, avg({LOSS}) AS nll, avg(({CP}-y)*({CP}-y)) AS brier FROM preds GROUP BY 1, 2) b ON a.arm=b.arm AND a.seed=b.seed)"""


@query(
    "m6_paired_differences",
    f"{BASE}, {RES} SELECT a.seed, {r('a.auroc-b.auroc')} AS delta_auroc, {r('b.nll-a.nll')} AS delta_neg_nll, {r('b.brier-a.brier')} AS delta_neg_brier FROM res a JOIN res b ON a.seed=b.seed AND a.arm='fusion' AND b.arm='audio'",
)
def _(t):
    res = metrics.absolute_results(t.predictions(), CELL, "logit", "prob", "y")
    out = metrics.paired_differences(res, "arm", "fusion", "audio", ["seed"])
    return rounded(out, "delta_auroc", "delta_neg_nll", "delta_neg_brier")


POPS = """pp AS (SELECT *, 'standard' AS population FROM preds UNION ALL SELECT *, 'matched' FROM preds WHERE lang <> 'en')"""


def populations(t) -> DataFrame:
    names = F.array_compact(F.array(F.lit("standard"), F.when(F.col("lang") != "en", F.lit("matched"))))
    return t.predictions().withColumn("population", F.explode(names))


@query(
    "m7_sensitivity_gap",
    f"""{BASE}, {POPS}, a AS ({auc_sql('pp', 'arm, seed, population')}), g AS (SELECT arm, seed, max(auroc) FILTER (population='standard') AS s, max(auroc) FILTER (population='matched') AS m FROM a GROUP BY 1, 2)
    SELECT arm, seed, {r('s')} AS standard, {r('m')} AS matched, {r('s-m')} AS gap FROM g""",
)
def _(t):
    a = metrics.auroc(populations(t), [*CELL, "population"], "logit", "y")
    return rounded(metrics.sensitivity_gap(a, CELL, "auroc", "standard", "matched"), "standard", "matched", "gap")


RATED = "x AS (SELECT l_returnflag AS grp, l_suppkey AS rater, l_extendedprice AS s, (l_discount > 0.05)::INT AS y FROM lineitem)"


def rated(t) -> DataFrame:
    return t("lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("rater"), F.col("l_extendedprice").alias("s"), (F.col("l_discount") > 0.05).cast("int").alias("y")
    )


@query("m8_macro_auroc", f"WITH {RATED}, a AS ({auc_sql('x', 'grp, rater', 's')}) SELECT grp, {r('avg(auroc)')} AS macro_auroc, count(auroc) AS n_valid FROM a GROUP BY 1")
def _(t):
    return rounded(metrics.macro_auroc(rated(t), ["grp"], "rater", "s", "y"), "macro_auroc")


@query(
    "m9_symmetrised_log_odds",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber % 2 = 0 AS sw, l_discount AS pa, l_tax AS pb FROM lineitem), x AS (SELECT l_orderkey, sw, CASE WHEN sw THEN pa ELSE pb END AS w, CASE WHEN sw THEN pb ELSE pa END AS o FROM s)
    SELECT l_orderkey, {r('avg(ln(greatest(w, 1e-9::DOUBLE)) - ln(greatest(o, 1e-9::DOUBLE)))')} AS z, min(sw) <> max(sw) AS complete FROM x GROUP BY 1""",
)
def _(t):
    s = t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("swap"), F.col("l_discount").alias("p_a"), F.col("l_tax").alias("p_b"))
    return rounded(metrics.symmetrised_log_odds(s, ["l_orderkey"]), "z")


@query(
    "m10_one_vs_rest",
    f"""WITH x AS (SELECT l_returnflag AS truth, unnest([struct_pack(c := 'A', s := l_quantity), struct_pack(c := 'N', s := l_discount), struct_pack(c := 'R', s := l_tax)]) AS e FROM lineitem),
    y AS (SELECT e.c AS class, e.s AS s, (truth = e.c)::INT AS y FROM x), a AS ({auc_sql('y', 'class', 's')}) SELECT class, n_pos, n_neg, {r('auroc')} AS auroc FROM a""",
)
def _(t):
    long = metrics.one_vs_rest(t("lineitem"), "l_returnflag", ["A", "N", "R"], {"A": "l_quantity", "N": "l_discount", "R": "l_tax"})
    return rounded(metrics.auroc(long, ["class"], "score", "y_class"), "auroc")


@query(
    "m11_counterfactual_change",
    f"""{BASE}, d AS (SELECT a.seed, a.y, a.logit - b.logit AS d FROM preds a JOIN preds b ON a.unit_id=b.unit_id AND a.seed=b.seed AND a.arm='fusion' AND b.arm='audio')
    SELECT seed, {r('avg(abs(d))')} AS mean_abs_change, {r('sqrt(avg(d*d))')} AS rms_change, {r('avg((2*y-1)*d)')} AS label_support_removed, {r('avg((abs(d) > 0.1)::INT)')} AS fraction_above FROM d GROUP BY 1""",
)
def _(t):
    p = t.predictions()
    a, b = p.where("arm = 'fusion'"), p.where("arm = 'audio'")
    out = metrics.counterfactual_change(a.select("unit_id", "seed", "y", "logit"), b, ["unit_id", "seed"], "logit", "y", ["seed"])
    return rounded(out, "mean_abs_change", "rms_change", "label_support_removed", "fraction_above")


@query(
    "m12_region_choice",
    f"""WITH g AS (SELECT l_orderkey AS clip, avg(l_quantity) FILTER (l_returnflag='A') AS q, avg(l_quantity) FILTER (l_returnflag='R') AS d,
      first(l_returnflag='A' ORDER BY l_quantity DESC, l_linenumber, l_partkey) FILTER (l_linestatus='O') AS h FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1) GROUP BY 1),
    w AS (SELECT CASE WHEN abs(coalesce(q,0)-coalesce(d,0)) < 1e-9 THEN 0.5::DOUBLE WHEN coalesce(q,0) > coalesce(d,0) THEN 1 ELSE 0 END AS win, coalesce(h, false)::INT AS hit FROM g)
    SELECT count(*) AS n, {r('avg(win)')} AS win_rate, {r('avg(hit)')} AS hit_rate FROM w""",
)
def _(t):
    cell = F.struct(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"))
    one = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_quantity", "l_returnflag", "l_linestatus"), cell).alias("x"))
    grid = one.select(
        "l_orderkey", "l_linenumber", F.col("x.l_quantity").alias("s"), (F.col("x.l_returnflag") == "A").alias("q"),
        (F.col("x.l_returnflag") == "R").alias("d"), (F.col("x.l_linestatus") == "O").alias("v"),
    )
    w = metrics.region_choice(grid, "l_orderkey", "s", "q", "d", "v", "l_linenumber")
    return rounded(w.agg(F.count(F.lit(1)).alias("n"), F.avg("win").alias("win_rate"), F.avg("hit").alias("hit_rate")), "win_rate", "hit_rate")


PROBES = """pb AS (SELECT arm, seed, 'toxic' AS target, logit, toxic AS t FROM preds UNION ALL SELECT arm, seed, 'english', logit, (lang='en')::INT FROM preds UNION ALL SELECT arm, seed, 'long', logit, (n_chars > 1000)::INT FROM preds)"""


@query(
    "m13_probe_change",
    f"""{BASE}, {PROBES}, a AS ({auc_sql('pb', 'arm, seed, target', label='t')}), d AS (SELECT target, avg(dd) AS delta FROM (SELECT target, seed, max(auroc) FILTER (arm='fusion') - max(auroc) FILTER (arm='audio') AS dd FROM a GROUP BY 1, 2) GROUP BY 1)
    SELECT {r('avg(delta)')} AS macro_change, sum((delta <= 0)::INT)::BIGINT AS n_not_increased, count(*) AS n_targets FROM d""",
)
def _(t):
    p = t.predictions().withColumns({"english": (F.col("lang") == "en").cast("int"), "long": (F.col("n_chars") > 1000).cast("int")})
    long = p.unpivot(["arm", "seed", "logit"], ["toxic", "english", "long"], "target", "t")
    res = metrics.auroc(long, ["arm", "seed", "target"], "logit", "t")
    return rounded(metrics.probe_change(res, "arm", "fusion", "audio", "target"), "macro_change")


@query(
    "m14_absolute_results",
    f"""{BASE}, {POPS}, a AS ({auc_sql('pp', 'arm, seed, population')}), b AS (SELECT arm, seed, population, count(*) AS n, avg({LOSS}) AS nll, avg(({CP}-y)*({CP}-y)) AS brier FROM pp GROUP BY 1, 2, 3)
    SELECT a.arm, a.seed, a.population, n_pos, n_neg, {r('auroc')} AS auroc, n, {r('nll')} AS nll, {r('brier')} AS brier FROM a JOIN b ON a.arm=b.arm AND a.seed=b.seed AND a.population=b.population""",
)
def _(t):
    return rounded(metrics.absolute_results(populations(t), [*CELL, "population"], "logit", "prob", "y"), "auroc", "nll", "brier")


# ---- bootstrap ----

REPS = 200


def draws_sql(src: str, unit: str, salt: str, reps: int = REPS, by: str = "", name: str = "dr") -> str:
    part = f"PARTITION BY {by}" if by else ""
    pre, on = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    text = f"'{salt}|' || " + (f"k.{by} || '|' || " if by else "") + "rep || '|' || rr"
    return f"""{name}_u AS (SELECT *, row_number() OVER ({part} ORDER BY sha256('{salt}|' || {unit})) AS rr, count(*) OVER ({part}) AS nn FROM (SELECT DISTINCT {pre}{unit} FROM {src})),
    {name}_s AS (SELECT {'k.' + by + ', ' if by else ''}rep, 1 + {H(text)} % nn AS hit FROM {name}_u k, (SELECT unnest(range({reps})) AS rep)),
    {name} AS (SELECT {'b.' + by + ', ' if by else ''}a.rep, b.{unit}, count(*) AS times FROM {name}_s a JOIN {name}_u b ON {on}a.hit = b.rr GROUP BY ALL)"""


def ci_sql(src: str, by: str, reps: int = REPS) -> str:
    pre = f"{by}, " if by else ""
    return f"SELECT {pre}{r('quantile_cont(value, 0.025)')} AS ci_low, {r('quantile_cont(value, 0.975)')} AS ci_high, count(value) AS n_valid, {reps} - count(value) AS n_discarded FROM {src}" + (f" GROUP BY {by}" if by else "")


def ci(df: DataFrame, by: list[str], reps: int = REPS) -> DataFrame:
    return rounded(bootstrap.interval(df, by, reps=reps), "ci_low", "ci_high")


@query(
    "b1_mean_bootstrap",
    f"""WITH v AS (SELECT l_returnflag AS cell, l_suppkey AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), {draws_sql('v', 'k', 'b1')},
    rp AS (SELECT cell, rep, sum(times*v)/sum(times) AS value FROM v JOIN dr ON dr.k=v.k GROUP BY 1, 2) {ci_sql('rp', 'cell')}""",
)
def _(t):
    v = t("lineitem").groupBy(F.col("l_returnflag").alias("cell"), F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("v"))
    return ci(bootstrap.replicate_means(v, ["cell"], "k", "v", REPS, "b1"), ["cell"])


SEEDDRAW = draws_sql("preds", "seed", "hb-seed", name="sd")
HB = f"""{BASE}, {draws_sql('preds', 'unit_id', 'hb')}, {SEEDDRAW},
 rw AS (SELECT p.arm, p.seed, p.y, p.logit, rep, times FROM preds p JOIN dr ON dr.unit_id=p.unit_id),
 au AS ({auc_sql('rw', 'arm, seed, rep', weight='times')}),
 hv AS (SELECT a.arm, a.rep, CASE WHEN count(*) = count(auroc) THEN sum(times*auroc)/sum(times) END AS value FROM au a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2)"""


def auroc_replicates(t, scheme: str = "multinomial"):
    return bootstrap.replicate_metric(t.predictions(), ["arm"], "unit_id", "auroc", "y", "logit", "prob", REPS, "hb", "seed", scheme)


@query("b2_hierarchical_auroc_interval", f"{HB} {ci_sql('hv', 'arm')}")
def _(t):
    return ci(auroc_replicates(t), ["arm"])


@query(
    "b3_paired_auroc_interval",
    f"{HB}, pv AS (SELECT a.rep, a.value-b.value AS value FROM hv a JOIN hv b ON a.rep=b.rep AND a.arm='fusion' AND b.arm='audio') {ci_sql('pv', '')}",
)
def _(t):
    return ci(bootstrap.paired_replicates(auroc_replicates(t), "arm", "fusion", "audio"), [])


def additive_sql(salt: str, loss: str, cluster: str = "unit_id") -> str:
    return f"""{BASE}, {draws_sql('preds', cluster, salt)}, {draws_sql('preds', 'seed', f'{salt}-seed', name='sd')},
    rr AS (SELECT p.arm, p.seed, rep, CASE WHEN sum(times*y) > 0 AND sum(times*(1-y)) > 0 THEN sum(times*{loss})/sum(times) END AS v FROM preds p JOIN dr ON dr.{cluster}=p.{cluster} GROUP BY 1, 2, 3),
    hv AS (SELECT a.arm, a.rep, CASE WHEN count(*) = count(v) THEN sum(times*v)/sum(times) END AS value FROM rr a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2)"""


@query("b2_hierarchical_nll_interval", f"{additive_sql('hn', f'(-{LOSS})')} {ci_sql('hv', 'arm')}")
def _(t):
    v = bootstrap.replicate_metric(t.predictions(), ["arm"], "unit_id", "neg_nll", "y", "logit", "prob", REPS, "hn", "seed")
    return ci(v, ["arm"])


CUMULATIVE = accumulate(math.exp(-1) / math.factorial(k) for k in range(12))
POIS = "CASE " + " ".join(f"WHEN u < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(CUMULATIVE)) + " ELSE 12 END"


@query(
    "b2_poisson_brier_interval",
    f"""{BASE}, pu AS (SELECT unit_id, rep, {HU("'po|' || rep || '|' || unit_id")} AS u FROM (SELECT DISTINCT unit_id FROM preds), (SELECT unnest(range({REPS})) AS rep)),
    dr AS (SELECT unit_id, rep, {POIS} AS times FROM pu), rp AS (SELECT arm, seed, rep, sum(times * -(prob-y)*(prob-y))/sum(times) AS value FROM preds p JOIN dr ON dr.unit_id=p.unit_id GROUP BY 1, 2, 3) {ci_sql('rp', 'arm, seed')}""",
)
def _(t):
    v = bootstrap.replicate_metric(t.predictions(), CELL, "unit_id", "neg_brier", "y", "logit", "prob", REPS, "po", scheme="poisson")
    return ci(v, CELL)


@query(
    "b4_pair_cluster_interval",
    f"""WITH {UNITS}, rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('pc|' || unit_id)) AS rr FROM units), mm AS (SELECT unit_id, y, rr AS pair FROM rk WHERE rr <= (SELECT count(*) FROM units WHERE y=0)),
    {PREDS}, pp AS (SELECT p.*, pair FROM preds p JOIN mm ON mm.unit_id=p.unit_id), {draws_sql('pp', 'pair', 'pcb')},
    rw AS (SELECT arm, seed, y, logit, rep, times FROM pp JOIN dr ON dr.pair=pp.pair), au AS (SELECT arm, seed, rep, auroc AS value FROM ({auc_sql('rw', 'arm, seed, rep', weight='times')})) {ci_sql('au', 'arm, seed')}""",
)
def _(t):
    from tessera.functions import salted_sha
    from tessera.operators.ranked import ranked_sides

    placed = ranked_sides(t.units().select("unit_id", "y").withColumn("h", salted_sha("pc", "unit_id")), [], "y", "h")
    pairs = placed.where(F.col("rank") <= F.least("n0", "n1")).select("unit_id", F.col("rank").alias("pair"))
    pred = bootstrap.require_pair_clusters(t.predictions().join(pairs, "unit_id"), "pair", CELL)
    v = bootstrap.replicate_metric(pred, CELL, "pair", "auroc", "y", "logit", "prob", REPS, "pcb")
    return ci(v, CELL)


@query("b5_stratum_cluster_interval", f"{additive_sql('st', f'(-{LOSS})', 'source')} {ci_sql('hv', 'arm')}")
def _(t):
    v = bootstrap.replicate_metric(t.predictions(), ["arm"], "source", "neg_nll", "y", "logit", "prob", REPS, "st", "seed")
    return ci(v, ["arm"])


@query(
    "b5_cluster_sizes",
    f"WITH {UNITS}, g AS (SELECT lang || source AS k, count(*) AS n FROM units GROUP BY 1) SELECT count(*) AS n_clusters, sum((n=1)::INT)::BIGINT AS n_singletons, max(n) AS largest FROM g",
)
def _(t):
    return bootstrap.cluster_sizes(t.units().select(F.concat("lang", "source").alias("k")), "k")


@query(
    "b6_patient_win_interval",
    f"""WITH w AS (SELECT l_returnflag AS arm, l_suppkey AS patient, l_linenumber AS seed, (l_discount > l_tax)::INT AS win FROM lineitem), {draws_sql('w', 'patient', 'wb')}, {draws_sql('w', 'seed', 'wb-seed', name='sd')},
    rr AS (SELECT arm, seed, rep, sum(times*win)/sum(times) AS v FROM w JOIN dr ON dr.patient=w.patient GROUP BY 1, 2, 3),
    hv AS (SELECT a.arm, a.rep, sum(times*v)/sum(times) AS value FROM rr a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2) {ci_sql('hv', 'arm')}""",
)
def _(t):
    w = t("lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("patient"), F.col("l_linenumber").alias("seed"), (F.col("l_discount") > F.col("l_tax")).cast("double").alias("win"))
    return ci(bootstrap.replicate_means(w, ["arm"], "patient", "win", REPS, "wb", "seed"), ["arm"])


@query(
    "b7_matrix_interval",
    f"""WITH v AS (SELECT l_linenumber AS seed, l_suppkey AS unit, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), {draws_sql('v', 'unit', 'mx')}, {draws_sql('v', 'seed', 'mx-seed', name='sd')},
    rr AS (SELECT seed, rep, sum(times*x)/sum(times) AS q FROM v JOIN dr ON dr.unit=v.unit GROUP BY 1, 2), hv AS (SELECT a.rep, sum(times*q)/sum(times) AS value FROM rr a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1) {ci_sql('hv', '')}""",
)
def _(t):
    v = t("lineitem").groupBy(F.col("l_linenumber").alias("seed"), F.col("l_suppkey").alias("unit")).agg(F.avg("l_quantity").alias("x"))
    return ci(bootstrap.replicate_means(v, [], "unit", "x", REPS, "mx", "seed"), [])


@query(
    "b7_paired_matrix_interval",
    f"""WITH v AS (SELECT l_linenumber AS seed, l_suppkey AS unit, avg(l_quantity*l_discount) - avg(l_quantity*l_tax) AS x FROM lineitem GROUP BY 1, 2), {draws_sql('v', 'unit', 'pm')}, {draws_sql('v', 'seed', 'pm-seed', name='sd')},
    hv AS (SELECT d.rep, sum(d.times*s.times*x)/sum(d.times*s.times) AS value FROM v JOIN dr d ON d.unit=v.unit JOIN sd s ON s.rep=d.rep AND s.seed=v.seed GROUP BY 1), i AS ({ci_sql('hv', '')}),
    ps AS (SELECT seed, avg(x) AS m FROM v GROUP BY 1)
    SELECT (SELECT {r('avg(x)')} FROM v) AS observed, ci_low, ci_high, n_valid, (SELECT count(DISTINCT unit) FROM v) AS n_units, (SELECT count(*) FROM ps) AS n_seeds,
      (SELECT count(*) FROM ps WHERE m > 0) AS n_positive, (SELECT count(*) FROM ps WHERE m < 0) AS n_negative, (SELECT count(*) FROM ps WHERE m = 0) AS n_zero FROM i""",
)
def _(t):
    product = lambda c: F.avg(F.col("l_quantity") * F.col(c)).alias(c)
    v = t("lineitem").groupBy(F.col("l_linenumber").alias("seed"), F.col("l_suppkey").alias("unit")).agg(product("l_discount"), product("l_tax"))
    long = v.unpivot(["seed", "unit"], ["l_discount", "l_tax"], "arm", "x")
    return rounded(bootstrap.paired_matrix_interval(long, "arm", "l_discount", "l_tax", "seed", "unit", "x", REPS, "pm"), "observed", "ci_low", "ci_high")


@query(
    "m14_absolute_intervals",
    f"""{BASE}, {POPS}, {draws_sql('pp', 'unit_id', 'ai', by='population')}, {draws_sql('pp', 'seed', 'ai-seed', name='sd')},
    rw AS (SELECT p.arm, p.seed, p.population, p.y, p.logit, p.prob, rep, times FROM pp p JOIN dr ON dr.population=p.population AND dr.unit_id=p.unit_id), au AS ({auc_sql('rw', 'arm, seed, population, rep', weight='times')}),
    lo AS (SELECT arm, seed, population, rep, sum(times*{LOSS})/sum(times) AS nll, sum(times*(prob-y)*(prob-y))/sum(times) AS brier FROM rw GROUP BY 1, 2, 3, 4),
    al AS (SELECT arm, seed, population, rep, 'auroc' AS metric, auroc AS v FROM au UNION ALL SELECT l.arm, l.seed, l.population, l.rep, m, CASE WHEN a.auroc IS NULL THEN NULL WHEN m = 'nll' THEN nll ELSE brier END
      FROM lo l JOIN au a ON a.arm=l.arm AND a.seed=l.seed AND a.population=l.population AND a.rep=l.rep, (SELECT unnest(['nll', 'brier']) AS m)),
    hv AS (SELECT arm, population, metric, a.rep, CASE WHEN count(*) = count(v) THEN sum(times*v)/sum(times) END AS value FROM al a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2, 3, 4),
    i AS ({ci_sql('hv', 'arm, population, metric')}),
    ob AS (SELECT arm, population, 'auroc' AS metric, avg(auroc) AS o FROM ({auc_sql('pp', 'arm, seed, population')}) GROUP BY 1, 2
      UNION ALL SELECT arm, population, 'nll', avg({LOSS}) FROM pp GROUP BY 1, 2 UNION ALL SELECT arm, population, 'brier', avg((prob-y)*(prob-y)) FROM pp GROUP BY 1, 2)
    SELECT i.arm, i.population, i.metric, {r('o')} AS observed, ci_low, ci_high, n_valid FROM i JOIN ob ON ob.arm=i.arm AND ob.population=i.population AND ob.metric=i.metric""",
)
def _(t):
    out = bootstrap.absolute_intervals(populations(t), ["arm", "population"], "seed", "unit_id", "y", "logit", "prob", REPS, "ai", by=["population"])
    flat = out.select("arm", "population", "metric", "observed", F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"), "n_valid")
    return rounded(flat, "observed", "ci_low", "ci_high")


@query(
    "a26_grid_delta_intervals",
    f"""WITH g AS (SELECT l_tax AS rho, l_linenumber AS seed, avg(l_quantity) FILTER (l_linestatus='O') - avg(l_quantity) FILTER (l_linestatus='F') AS d FROM lineitem GROUP BY 1, 2), v AS (SELECT * FROM g WHERE d IS NOT NULL), {draws_sql('v', 'seed', 'gd')},
    hv AS (SELECT rho, rep, sum(times*d)/sum(times) AS value FROM v JOIN dr ON dr.seed=v.seed GROUP BY 1, 2), i AS ({ci_sql('hv', 'rho')})
    SELECT v.rho, count(*) AS n_seeds, {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS sd, min(sign(d)) = max(sign(d)) AS same_sign, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM v JOIN i ON i.rho=v.rho GROUP BY 1""",
)
def _(t):
    d = t("lineitem").select(F.col("l_tax").alias("rho"), F.col("l_linenumber").alias("seed"), F.col("l_linestatus").alias("arm"), "l_quantity")
    out = profile.grid_delta_intervals(d, ["rho"], "arm", "l_quantity", "O", "F", REPS, "gd")
    return rounded(out.select("rho", "n_seeds", "mean", "sd", "same_sign", F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high")), "mean", "sd", "ci_low", "ci_high")


OVR = f"""{BASE}, ov AS (SELECT p.arm, p.seed, p.unit_id, e.c AS class, (p.lang = e.c)::INT AS y,
  p.logit + (p.lang = e.c)::INT * 0.5::DOUBLE + 2.0::DOUBLE * {HU("'ovr|' || e.c || '|' || p.unit_id")} AS s FROM preds p, (SELECT DISTINCT lang AS c FROM units) e)"""


def class_scores(t) -> DataFrame:
    """Predictions with one row per language: is the document in it, and a score for it."""
    p = t.predictions().select("arm", "seed", "unit_id", "lang", "logit")
    classes = p.agg(F.array_sort(F.collect_set("lang"))).scalar()  # a handful of languages
    long = p.withColumn("class", F.explode(classes)).withColumn("y", (F.col("lang") == F.col("class")).cast("int"))
    noise = hash_unit(salted_sha("ovr", "class", "unit_id"))
    return long.select("arm", "seed", "unit_id", "class", "y", (F.col("logit") + F.col("y") * 0.5 + 2.0 * noise).alias("s"))


@query(
    "m10_macro_interval",
    f"""{OVR}, {draws_sql('ov', 'unit_id', 'ovr')}, {draws_sql('ov', 'seed', 'ovr-seed', name='sd')},
    rw AS (SELECT o.*, rep, times FROM ov o JOIN dr ON dr.unit_id=o.unit_id), pc AS ({auc_sql('rw', 'arm, seed, class, rep', 's', weight='times')}),
    ma AS (SELECT arm, seed, rep, avg(auroc) AS v FROM pc GROUP BY 1, 2, 3), hv AS (SELECT arm, a.rep, sum(times*v)/sum(times) AS value FROM ma a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2),
    ct AS (SELECT arm AS contrast, rep, value FROM hv UNION ALL SELECT 'difference', a.rep, a.value-b.value FROM hv a JOIN hv b ON a.rep=b.rep AND a.arm='fusion' AND b.arm='audio'),
    ob AS (SELECT arm, avg(auroc) AS o FROM ({auc_sql('ov', 'arm, seed, class', 's')}) GROUP BY 1), oc AS (SELECT arm AS contrast, o FROM ob UNION ALL SELECT 'difference', max(o) FILTER (arm='fusion') - max(o) FILTER (arm='audio') FROM ob),
    i AS ({ci_sql('ct', 'contrast')}) SELECT i.*, {r('o')} AS observed FROM i JOIN oc ON oc.contrast=i.contrast""",
)
def _(t):
    long = class_scores(t)
    v = bootstrap.replicate_one_vs_rest(long, ["arm"], "class", "unit_id", "s", "y", REPS, "ovr", "seed")
    both = bootstrap.paired_replicates(v, "arm", "fusion", "audio").withColumn("contrast", F.lit("difference"))
    i = ci(v.withColumnRenamed("arm", "contrast").unionByName(both), ["contrast"])
    point = metrics.macro_auroc(long, ["arm", "seed"], "class", "s", "y").groupBy("arm").agg(F.avg("macro_auroc").alias("observed"))
    gap = point.agg((F.max(F.when(F.col("arm") == "fusion", F.col("observed"))) - F.max(F.when(F.col("arm") == "audio", F.col("observed")))).alias("observed"))
    every = point.withColumnRenamed("arm", "contrast").unionByName(gap.withColumn("contrast", F.lit("difference")))
    return rounded(i.join(every, "contrast"), "observed")


@query(
    "b8_profile_macro_interval",
    f"""{BASE}, pm AS (SELECT arm, seed, source AS profile, avg(prob) AS x FROM preds GROUP BY 1, 2, 3), {draws_sql('pm', 'profile', 'pf')}, {draws_sql('pm', 'seed', 'pf-seed', name='sd')},
    rr AS (SELECT arm, seed, rep, sum(times*x)/sum(times) AS q FROM pm JOIN dr ON dr.profile=pm.profile GROUP BY 1, 2, 3), hv AS (SELECT arm, a.rep, sum(times*q)/sum(times) AS value FROM rr a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2) {ci_sql('hv', 'arm')}""",
)
def _(t):
    m = bootstrap.profile_macro(t.predictions().withColumnRenamed("source", "profile"), ["arm"], "seed", "profile", "prob")
    return ci(bootstrap.replicate_means(m, ["arm"], "profile", "prob", REPS, "pf", "seed"), ["arm"])


@query(
    "b9_within_rater_interval",
    f"""{BASE}, {draws_sql('preds', 'unit_id', 'wr', by='lang')}, rw AS (SELECT p.arm, p.lang, p.y, p.logit, rep, times FROM preds p JOIN dr ON dr.lang=p.lang AND dr.unit_id=p.unit_id),
    au AS ({auc_sql('rw', 'arm, lang, rep', weight='times')}), hv AS (SELECT arm, rep, avg(auroc) AS value FROM au GROUP BY 1, 2) {ci_sql('hv', 'arm')}""",
)
def _(t):
    v = bootstrap.replicate_macro_auroc(t.predictions(), ["arm"], "lang", "unit_id", "logit", "y", REPS, "wr")
    return ci(v, ["arm"])


@query(
    "b10_transport_interval",
    f"""{BASE}, sp AS ({split_sql('units', 'y', 'cal', ((0.5, 'cal'),), 'eval')}), pc AS (SELECT p.*, split FROM preds p JOIN sp ON sp.unit_id=p.unit_id), ca AS (SELECT * FROM pc WHERE split='cal'), ev AS (SELECT * FROM pc WHERE split='eval'),
    {draws_sql('ca', 'unit_id', 'tb-cal', name='dc')}, {draws_sql('ev', 'unit_id', 'tb-eval', name='de')}, {draws_sql('pc', 'seed', 'tb-seed', name='sd')},
    cw AS (SELECT arm, seed, rep, y, logit, times FROM ca JOIN dc ON dc.unit_id=ca.unit_id), {newton_sql('cw', 'arm, seed, rep', 'logit', weight='times')},
    rt AS (SELECT arm, seed, rep, sum(times*y)/sum(times) AS rate FROM cw GROUP BY 1, 2, 3),
    bf AS (SELECT f.arm, f.seed, f.rep, CASE WHEN slope <= 0 THEN ln(rate) - ln(1 - rate) ELSE intercept END AS intercept, greatest(slope, 1e-12) AS slope
      FROM fit f JOIN rt ON rt.arm=f.arm AND rt.seed=f.seed AND rt.rep=f.rep),
    ew AS (SELECT e.arm, e.seed, d.rep, e.y, e.logit, times, 1/(1+exp(-(intercept + slope*logit))) AS prob FROM ev e JOIN de d ON d.unit_id=e.unit_id JOIN bf f ON f.arm=e.arm AND f.seed=e.seed AND f.rep=d.rep),
    rr AS (SELECT arm, seed, rep, 'neg_nll' AS metric, sum(times * -{LOSS})/sum(times) AS v FROM ew GROUP BY 1, 2, 3
      UNION ALL SELECT arm, seed, rep, 'neg_brier', sum(times * -(prob-y)*(prob-y))/sum(times) FROM ew GROUP BY 1, 2, 3
      UNION ALL SELECT arm, seed, rep, 'auroc', auroc FROM ({auc_sql('ew', 'arm, seed, rep', weight='times')})),
    hv AS (SELECT arm, metric, a.rep, sum(times*v)/sum(times) AS value FROM rr a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2, 3),
    pv AS (SELECT a.metric, a.rep, a.value-b.value AS value FROM hv a JOIN hv b ON a.rep=b.rep AND a.metric=b.metric AND a.arm='fusion' AND b.arm='audio') {ci_sql('pv', 'metric')}""",
)
def _(t):
    from tessera.plans.evaluation import transport_replicates

    s = splits.stratified_split(t.units().select("unit_id", "y"), "unit_id", ["y"], "cal", [("cal", 0.5)], "eval").select("unit_id", "split")
    p = t.predictions().join(s, "unit_id")
    v = transport_replicates(p.where("split = 'cal'"), p.where("split = 'eval'"), ["arm"], "seed", "unit_id", "y", "logit", REPS, "tb")
    return ci(bootstrap.paired_replicates(v, "arm", "fusion", "audio", ["metric"]), ["metric"])


# ---- retrieval ----

VEC = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), po AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e), bk AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM po GROUP BY 1, 2) GROUP BY 1),
sc AS (SELECT e.vec_id, e.label AS gold, e.vec_id % 3 AS grp, bk.label AS cand, list_cosine_similarity(v, c) AS s FROM e, bk),
gs AS (SELECT vec_id, s AS g FROM sc WHERE cand = gold), mem AS (SELECT DISTINCT vec_id % 3 AS grp, label AS cand FROM embeddings WHERE label % 3 <> vec_id % 3 OR label < 5)"""


def bank(t) -> DataFrame:
    return profile.mean_vectors(t("embeddings"), ["label"], "embedding", "centre")


RANKS = "rk AS (SELECT sc.vec_id, gold, 1 + sum((cand<>gold AND s > g+1e-12)::INT)::BIGINT + sum((cand<>gold AND abs(s-g)<=1e-12 AND cand<gold)::INT)::BIGINT AS rank, 1 + sum((cand<>gold AND s > g+1e-12)::INT) + 0.5::DOUBLE*sum((cand<>gold AND abs(s-g)<=1e-12)::INT) AS average_rank, count(*) AS n_candidates FROM sc JOIN gs ON gs.vec_id=sc.vec_id GROUP BY 1, 2)"


@query("r1_candidate_bank", "SELECT sha256(txt) AS profile_id, txt, count(*) AS n_rows FROM (SELECT lang || '/' || source AS txt FROM documents) GROUP BY 1, 2")
def _(t):
    return retrieval.candidate_bank(t("documents").select(F.concat_ws("/", "lang", "source").alias("txt")), "txt")


@query("r2_cosine_ranks", f"WITH {VEC}, {RANKS} SELECT vec_id, gold, 'unrestricted' AS condition, rank, n_candidates FROM rk")
def _(t):
    out = retrieval.cosine_ranks(t("embeddings"), bank(t), "vec_id", "embedding", "label", "label", "centre")
    return out.drop("average_rank")


@query("r2_cosine_ranks_blocked", f"WITH {VEC}, {RANKS} SELECT vec_id, gold, 'unrestricted' AS condition, rank, n_candidates FROM rk")
def _(t):
    out = retrieval.cosine_ranks(t("embeddings"), bank(t), "vec_id", "embedding", "label", "label", "centre", broadcast_bytes=0)
    return out.drop("average_rank")


@query("r3_average_tie_ranks", f"WITH {VEC}, {RANKS} SELECT vec_id, average_rank FROM rk")
def _(t):
    out = retrieval.cosine_ranks(t("embeddings"), bank(t), "vec_id", "embedding", "label", "label", "centre")
    return out.select("vec_id", "average_rank")


COND = "mc AS (SELECT DISTINCT vec_id % 7 AS grp, label AS cand FROM embeddings), rc AS (SELECT sc.vec_id, 1 + sum((sc.cand<>gold AND s > g+1e-12)::INT)::BIGINT + sum((sc.cand<>gold AND abs(s-g)<=1e-12 AND sc.cand<gold)::INT)::BIGINT AS rank, count(*) AS n_candidates FROM sc JOIN gs ON gs.vec_id=sc.vec_id JOIN mc ON mc.cand=sc.cand AND mc.grp=sc.vec_id % 7 GROUP BY 1)"


def conditioned(t) -> DataFrame:
    q = t("embeddings").withColumn("grp", F.col("vec_id") % 7)
    return retrieval.cosine_ranks(q, bank(t), "vec_id", "embedding", "label", "label", "centre", ["grp"])


@query("r4_conditioned_ranks", f"WITH {VEC}, {COND} SELECT vec_id, rank, n_candidates FROM rc")
def _(t):
    return conditioned(t).where("condition = 'grp'").select("vec_id", "rank", "n_candidates")


@query(
    "r5_pair_cosine",
    f"""WITH x AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.label, count(*) AS n, {r('avg(list_cosine_similarity(a.v, b.v))')} AS mean_cosine FROM x a JOIN x b ON a.label=b.label AND b.k=a.k+1 GROUP BY 1""",
)
def _(t):
    from tessera.operators.ranked import ranked_by_value

    e = t("embeddings").withColumn("h", F.sha2(F.col("vec_id").cast("string"), 256))
    k = ranked_by_value(e.select("vec_id", "label", "h"), ["label"], "vec_id", "h", "k").select("vec_id", "label", "k")
    nxt = k.select("label", (F.col("k") - 1).alias("k"), F.col("vec_id").alias("b"))
    pairs = k.select(F.col("vec_id").alias("a"), "label", "k").join(nxt, ["label", "k"])
    out = retrieval.pair_cosines(pairs, t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return rounded(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("mean_cosine")), "mean_cosine")


@query(
    "r6_retrieval_metrics",
    f"""WITH {VEC}, {RANKS}, p AS (SELECT gold, count(*) AS n, sum(1.0::DOUBLE/rank) AS m, sum((rank<=1)::INT) AS a, sum((rank<=10)::INT) AS b FROM rk GROUP BY 1)
    SELECT 'unrestricted' AS condition, sum(n)::BIGINT AS n_queries, count(*) AS n_profiles, {r('sum(m)/sum(n)')} AS micro_mrr, {r('sum(a)/sum(n)')} AS micro_r1, {r('sum(b)/sum(n)')} AS micro_r10, {r('avg(m/n)')} AS macro_mrr, {r('avg(a/n)')} AS macro_r1, {r('avg(b/n)')} AS macro_r10 FROM p""",
)
def _(t):
    ranks = retrieval.cosine_ranks(t("embeddings"), bank(t), "vec_id", "embedding", "label", "label", "centre")
    out = retrieval.retrieval_metrics(ranks, ["condition"])
    return rounded(out, *[f"{a}_{b}" for a in ("micro", "macro") for b in ("mrr", "r1", "r10")])


@query(
    "r7_random_ranking_baseline",
    f"""WITH {VEC}, {COND}, h AS (SELECT n_candidates AS n, list_sum(list_transform(range(1, n_candidates+1), lambda i: 1.0::DOUBLE/i))/n_candidates AS m FROM rc)
    SELECT 'grp' AS condition, count(*) AS n_queries, min(n) AS min_candidates, max(n) AS max_candidates, {r('avg(m)')} AS random_mrr, {r('avg(1.0/n)')} AS random_r1, {r('avg(least(10, n)/n::DOUBLE)')} AS random_r10 FROM h""",
)
def _(t):
    out = retrieval.random_ranking(conditioned(t).where("condition = 'grp'"), ["condition"])
    return rounded(out, "random_mrr", "random_r1", "random_r10")


@query(
    "r8_frequency_prior_ranks",
    """WITH tr AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus='O' GROUP BY 1), q AS (SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderstatus='F'),
    b AS (SELECT p, row_number() OVER (ORDER BY coalesce(n, 0) DESC, sha256(p)) AS rank FROM (SELECT DISTINCT p FROM q) LEFT JOIN tr USING (p)) SELECT q.p AS profile, rank, count(*) AS n FROM q JOIN b ON b.p=q.p GROUP BY 1, 2""",
)
def _(t):
    o = t("orders").withColumnRenamed("o_orderpriority", "profile")
    out = retrieval.frequency_ranks(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_orderkey", "profile")
    return out.groupBy("profile", "rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r9_prototype_scores",
    f"""WITH x AS (SELECT vec_id, (label < 5)::INT AS y, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT y, pos, avg(x) AS x FROM (SELECT y, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM x) GROUP BY 1, 2),
    q AS (SELECT y, list(x ORDER BY pos) AS c FROM p GROUP BY 1) SELECT vec_id, {r('list_cosine_similarity(v, (SELECT c FROM q WHERE y=1)) - list_cosine_similarity(v, (SELECT c FROM q WHERE y=0))')} AS score FROM x""",
)
def _(t):
    e = t("embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    proto = profile.mean_vectors(e, ["y"], "embedding", "centre")
    return rounded(retrieval.prototype_scores(e, "embedding", proto, "y", "centre").select("vec_id", "score"), "score")


@query(
    "r10_linear_cka",
    f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM x),
    a AS (SELECT vec_id, i, v FROM c WHERE i <= 32), b AS (SELECT vec_id, i, v FROM c WHERE i > 32),
    ab AS (SELECT a.i, b.i AS j, sum(a.v*b.v) AS g FROM a JOIN b ON a.vec_id=b.vec_id GROUP BY 1, 2), aa AS (SELECT a.i, b.i AS j, sum(a.v*b.v) AS g FROM a JOIN a b ON a.vec_id=b.vec_id GROUP BY 1, 2), bb AS (SELECT a.i, b.i AS j, sum(a.v*b.v) AS g FROM b a JOIN b ON a.vec_id=b.vec_id GROUP BY 1, 2)
    SELECT {r('(SELECT sum(g*g) FROM ab)/(sqrt((SELECT sum(g*g) FROM aa))*sqrt((SELECT sum(g*g) FROM bb)))')} AS cka""",
)
def _(t):
    e = t("embeddings").select(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return rounded(retrieval.linear_cka(e, "a", "b"), "cka")


@query("r10_effective_rank")
def _(t):
    return retrieval.effective_rank(t("embeddings"), "embedding")


@query(
    "r11_representation_check",
    "SELECT count(*) AS n, 0::BIGINT AS n_unmatched, 0::BIGINT AS n_wrong_shape, 0.0::DOUBLE AS max_norm_error, 0.0::DOUBLE AS max_difference FROM embeddings",
)
def _(t):
    from tessera.functions import normalised

    raw = t("embeddings").select("vec_id", F.col("embedding").alias("raw"))
    stored = t("embeddings").select("vec_id", normalised(F.col("embedding")).cast("array<float>").alias("unit"))
    return rounded(retrieval.representation_check(stored, raw, "vec_id", "unit", "raw", 64), "max_norm_error", "max_difference", places=5)


# ---- readouts ----


@query(
    "l1_train_standardisation",
    f"""WITH {UNITS}, s AS ({SPLIT_U}), f AS (SELECT unit_id, split, 'n_chars' AS feature, n_chars::DOUBLE AS v FROM s UNION ALL SELECT unit_id, split, 'toxic', toxic FROM s),
    m AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS d FROM f WHERE split='train' GROUP BY 1) SELECT unit_id, f.feature, {r('(v-m)/d')} AS z FROM f JOIN m ON m.feature=f.feature""",
)
def _(t):
    s = study(t)
    stats = heads.scaled_stats(s.where("split = 'train'"), ["n_chars", "toxic"])
    return rounded(heads.z_scores(s, ["unit_id"], stats, ["n_chars", "toxic"]), "z")


def study(t) -> DataFrame:
    """Labelled documents with the cohort split."""
    return frozen_split(t)


def vectors(t) -> DataFrame:
    """Embedding table as a readout problem: label below 5, split and folds by hash."""
    e = t("embeddings").select(F.col("vec_id").alias("unit_id"), (F.col("label") < 5).cast("int").alias("y"), "label", "embedding")
    s = splits.stratified_split(e, "unit_id", ["y"], "vec", [("train", 0.6), ("validation", 0.25)], "test")
    val = splits.stratified_folds(s.where("split = 'validation'").select("unit_id", "y"), "unit_id", "y", None, 5, "vf").select("unit_id", "fold")
    return s.join(val, "unit_id", "left").fillna(-1, ["fold"])


@query("l2_logistic_head")
def _(t):
    d = cut_lineage(heads.assemble_features(vectors(t), [F.col("embedding")]))
    train = d.where("split = 'train'")
    model = heads.fit_head(train, "features", "y", 1.0, train.count())
    return metrics.auroc(heads.head_logits(d, model, "features"), ["split"], "logit", "y")


@query("l3_one_se_selection")
def _(t):
    d = heads.assemble_features(vectors(t), [F.col("embedding")])
    return heads.select_head(d, "features", "y", "split", "fold", (0.01, 0.1, 1.0))[1]


CHOICE = """g AS (SELECT o_orderpriority AS c0, o_orderstatus AS fold, avg(o_totalprice) AS auroc FROM orders GROUP BY 1, 2), h AS (SELECT substr(c0, 1, 1)::INT AS c, fold, auroc FROM g),
p AS (SELECT c, avg(auroc) AS mean, stddev_samp(auroc)/sqrt(count(*)) AS se FROM h GROUP BY 1), b AS (SELECT mean - se AS th FROM p ORDER BY mean DESC, c LIMIT 1)"""


@query("l3_one_se_rule", f"WITH {CHOICE} SELECT c, {r('mean', 3)} AS mean, {r('se', 3)} AS se, {r('th', 3)} AS threshold, c = (SELECT min(c) FROM p, b WHERE mean >= th) AS chosen FROM p, b")
def _(t):
    g = t("orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("c"), F.col("o_orderstatus").alias("fold")).agg(F.avg("o_totalprice").alias("auroc"))
    return rounded(heads.one_se_choice(g), "mean", "se", "threshold", places=3)


VALF = f"""{UNITS}, sp AS ({split_sql('units', 'y', 'pl', ((0.5, 'validation'),), 'test')}), va AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY sha256('pf|' || unit_id)) - 1) % 5 AS fold FROM sp WHERE split='validation'),
{PREDS}, pv AS (SELECT p.unit_id, p.y, p.logit, split FROM preds p JOIN sp ON sp.unit_id=p.unit_id WHERE arm='audio' AND seed=0),
hl AS (SELECT h.held, p.y, p.logit FROM pv p JOIN va ON va.unit_id=p.unit_id, (SELECT unnest([-1,0,1,2,3,4]) AS held) h WHERE h.held <> va.fold)"""


@query(
    "l4_platt_calibration",
    f"""WITH {VALF}, {newton_sql('hl', 'held', 'logit', l2=1.0)}
    SELECT p.unit_id, {r('1/(1+exp(-(f.intercept + f.slope*logit)))')} AS prob, {r('CASE WHEN o.held IS NOT NULL THEN 1/(1+exp(-(o.intercept + o.slope*logit))) END')} AS oof_prob
    FROM pv p JOIN fit f ON f.held = -1 LEFT JOIN va ON va.unit_id=p.unit_id LEFT JOIN fit o ON o.held = va.fold""",
)
def _(t):
    p = t.predictions().where("arm = 'audio' AND seed = 0").select("unit_id", "y", "logit")
    s = splits.stratified_split(t.units().select("unit_id", "y"), "unit_id", ["y"], "pl", [("validation", 0.5)], "test").select("unit_id", "y", "split")
    f = splits.stratified_folds(s.where("split = 'validation'"), "unit_id", "y", None, 5, "pf").select("unit_id", "fold")
    d = p.join(s.drop("y"), "unit_id").join(f, "unit_id", "left").fillna(-1, ["fold"])
    return rounded(heads.platt_scores(d, "y", "split", "fold").select("unit_id", "prob", "oof_prob"), "prob", "oof_prob")


@query("l5_probe_head")
def _(t):
    d = heads.assemble_features(vectors(t).withColumn("target", F.when(F.col("label") != 9, (F.col("label") % 2))), [F.col("embedding")])
    return heads.probe(d, "features", "target", "split", "fold", (0.1, 1.0))


@query(
    "l5_balanced_weights",
    f"WITH {UNITS}, g AS (SELECT y, count(*) AS c FROM units GROUP BY 1) SELECT y, {r('(SELECT sum(c) FROM g)/(2.0::DOUBLE*c)')} AS weight FROM g",
)
def _(t):
    return rounded(heads.balanced_weights(t.units().select("y"), "y").groupBy("y").agg(F.max("weight").alias("weight")), "weight")


@query("l6_cross_fitted_head")
def _(t):
    e = t("embeddings").select(F.col("vec_id").alias("unit_id"), (F.col("label") < 5).cast("int").alias("y"), "embedding")
    d = splits.stratified_folds(e, "unit_id", "y", None, 3, "tf")
    out = heads.cross_fitted(heads.assemble_features(d, [F.col("embedding")]), "features", "y", "fold")
    return metrics.auroc(out, ["fold"], "prob", "y")


@query("l7_metadata_reference")
def _(t):
    d = heads.assemble_features(study(t), [heads.as_array("toxic", "n_chars")])
    out = heads.metadata_reference(d, "features", "y", "split")
    return metrics.auroc(out, ["family", "split"], "score", "y")


@query("l8_fusion_arms")
def _(t):
    d = vectors(t).withColumn("extra", heads.as_array("unit_id"))
    arms = {"audio": [F.col("embedding")], "audio_plus_metadata": [F.col("embedding"), F.col("extra")]}
    return heads.fusion_results(d, arms, "y", "split")


@query("l9_nuisance_eraser")
def _(t):
    e = t("embeddings").select((F.col("label") % 2).alias("n1"), (F.col("label") < 3).cast("int").alias("n2"), "embedding")
    d = heads.assemble_features(e, [F.col("embedding")])
    basis = heads.nuisance_basis(d, "features", ["n1", "n2"])
    out = heads.erase(d, "features", basis)
    return out.select(vector_to_array("features").alias("x"), "erased").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("erased", lambda v: F.abs(v)))).alias("max_abs")
    )


def readout_sql(src: str, cell: str, grid: Sequence[float] = heads.C_GRID, steps: int = 10, name: str = "rf") -> str:
    """Unrolled Newton steps of penalised fits on two standardised features x1, x2, one per cell and strength; ends in ``name``
    (cell..., c, a, b1, b2), for features as they are."""
    d = name
    on = " AND ".join(f"x.{c.strip()} = b.{c.strip()}" for c in cell.split(","))
    sd = lambda x: f"CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1 END"
    out = [
        f"{d}_st AS (SELECT {cell}, avg(x1) AS m1, {sd('x1')} AS s1, avg(x2) AS m2, {sd('x2')} AS s2 FROM {src} GROUP BY {cell})",
        f"{d}_rd AS (SELECT x.*, g.c, (x1 - m1)/s1 AS u, (x2 - m2)/s2 AS v FROM {src} x JOIN {d}_st b ON {on}, (SELECT unnest([{', '.join(f'{c!r}::DOUBLE' for c in grid)}]) AS c) g)",
        f"{d}_0 AS (SELECT {cell}, c, ln(avg(y)) - ln(1 - avg(y)) AS a, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q FROM {d}_rd GROUP BY {cell}, c)",
    ]
    det = "(h00*(h11*h22 - h12*h12) - h01*(h01*h22 - h12*h02) + h02*(h01*h12 - h11*h02))"
    for i in range(steps):
        out.append(f"""{d}_g{i} AS (SELECT {cell}, c, any_value(a) AS a, any_value(p) AS p, any_value(q) AS q, sum(e) AS g0, sum(e*u) + any_value(p)/c AS g1, sum(e*v) + any_value(q)/c AS g2,
          sum(h) AS h00, sum(h*u) AS h01, sum(h*v) AS h02, sum(h*u*u) + 1/c AS h11, sum(h*u*v) AS h12, sum(h*v*v) + 1/c AS h22 FROM (
            SELECT *, pr - y AS e, pr*(1 - pr) AS h FROM (SELECT x.*, b.a, b.p, b.q, 1/(1 + exp(-(b.a + b.p*x.u + b.q*x.v))) AS pr FROM {d}_rd x JOIN {d}_{i} b ON {on} AND x.c = b.c)) GROUP BY {cell}, c),
        {d}_{i + 1} AS (SELECT {cell}, c, a - (g0*(h11*h22 - h12*h12) - h01*(g1*h22 - h12*g2) + h02*(g1*h12 - h11*g2))/{det} AS a,
          p - (h00*(g1*h22 - g2*h12) - g0*(h01*h22 - h12*h02) + h02*(h01*g2 - g1*h02))/{det} AS p, q - (h00*(h11*g2 - h12*g1) - h01*(h01*g2 - g1*h02) + g0*(h01*h12 - h11*h02))/{det} AS q FROM {d}_g{i})""")
    out.append(f"{name} AS (SELECT x.*, x.a0 - x.b1*m1 - x.b2*m2 AS a FROM (SELECT {', '.join('x.' + c.strip() for c in cell.split(','))}, x.c, x.a AS a0, x.p/s1 AS b1, x.q/s2 AS b2, m1, m2 FROM {d}_{steps} x JOIN {d}_st b ON {on}) x)")
    return ", ".join(out)


def one_se_sql(src: str, by: str = "") -> str:
    """CTEs ``ps`` and ``pick``: per (by, c) the mean fold AUROC of ``src`` (by, c, fold, auroc), and the strength chosen."""
    pre, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    on = f"WHERE {' AND '.join(f'p.{b.strip()} = t.{b.strip()}' for b in by.split(','))}" if by else ""
    return f"""ps AS (SELECT {pre}c, avg(auroc) AS mean, stddev_samp(auroc)/sqrt(count(auroc)) AS se FROM {src} GROUP BY {pre}c),
    th AS (SELECT * FROM (SELECT {pre}mean - se AS threshold, row_number() OVER ({part}ORDER BY mean DESC, c) AS k FROM ps) WHERE k = 1),
    pick AS (SELECT {pre}min(c) AS chosen, any_value(threshold) AS threshold FROM (SELECT p.*, t.threshold FROM ps p, th t {on}) WHERE mean >= threshold{f' GROUP BY {by}' if by else ''})"""


TARGET = f"""{UNITS}, fo AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY sha256('tgt|' || unit_id)) - 1) % 5 AS fold, ln(1 + n_chars) AS x1, toxic::DOUBLE AS x2 FROM units),
fr AS (SELECT h.held, f.y, f.x1, f.x2 FROM fo f, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS held) h WHERE h.held <> f.fold), {readout_sql('fr', 'held')},
oo AS (SELECT f.unit_id, f.fold, f.y, r.c, round(r.a + r.b1*f.x1 + r.b2*f.x2, 10) AS logit FROM fo f JOIN rf r ON r.held = f.fold), oa AS ({auc_sql('oo', 'c, fold')}), {one_se_sql('oa')}"""


def target_rows(t) -> DataFrame:
    u = splits.stratified_folds(t.units(), "unit_id", "y", None, 5, "tgt")
    return u.select("unit_id", "y", "fold", F.array(F.log(1 + F.col("n_chars")), F.col("toxic").cast("double")).alias("x"))


@query(
    "l6_target_head",
    f"""WITH {TARGET}, po AS (SELECT 0 AS one, y, logit FROM oo, pick WHERE c = chosen), {newton_sql('po', 'one', 'logit', l2=1.0)}
    SELECT f.unit_id, chosen AS c, {r('o.logit', 4)} AS oof_logit, {r('r.a + r.b1*f.x1 + r.b2*f.x2', 4)} AS logit, {r('1/(1+exp(-(intercept + slope*(r.a + r.b1*f.x1 + r.b2*f.x2))))', 5)} AS prob
    FROM fo f, pick, fit, rf r, oo o WHERE r.held = -1 AND r.c = chosen AND o.unit_id = f.unit_id AND o.c = chosen""",
)
def _(t):
    head = readouts.target_head(target_rows(t), "x", "y", "fold")
    out = head.scores.select("unit_id", F.lit(head.c).alias("c"), "oof_logit", "logit", "prob")
    return rounded(rounded(out, "oof_logit", "logit", places=4), "prob", places=5)


@query("l6_target_selection", f"WITH {TARGET} SELECT c, {r('mean', 5)} AS mean, {r('se', 5)} AS se, {r('threshold', 5)} AS threshold, c = chosen AS chosen FROM ps, pick")
def _(t):
    head = readouts.target_head(target_rows(t), "x", "y", "fold")
    return rounded(head.selection.select("c", "mean", "se", "threshold", "chosen"), "mean", "se", "threshold", places=5)


COHORT = f"""{UNITS}, s0 AS ({SPLIT_U}), vf AS (SELECT unit_id, (row_number() OVER (PARTITION BY y ORDER BY sha256('chf|' || unit_id)) - 1) % 5 AS fold FROM s0 WHERE split='validation'),
ch AS (SELECT s.*, coalesce(fold, -1) AS fold FROM (SELECT unit_id, y, split, ln(1 + n_chars) AS z1, toxic::DOUBLE AS z2 FROM s0) s LEFT JOIN vf ON vf.unit_id = s.unit_id),
ar AS (SELECT unnest(['text', 'metadata', 'text_plus_metadata']) AS arm), ca AS (SELECT arm, ch.*, CASE WHEN arm <> 'metadata' THEN z1 ELSE 0 END AS x1, CASE WHEN arm <> 'text' THEN z2 ELSE 0 END AS x2 FROM ch, ar),
tr AS (SELECT arm, y, x1, x2 FROM ca WHERE split='train'), {readout_sql('tr', 'arm')},
sc AS (SELECT x.*, r.c, round(r.a + r.b1*x1 + r.b2*x2, 10) AS logit FROM ca x JOIN rf r ON r.arm = x.arm), va AS ({auc_sql("(SELECT * FROM sc WHERE fold >= 0)", 'arm, c, fold')}), {one_se_sql('va', 'arm')}"""


def cohort_rows(t) -> DataFrame:
    s = study(t).select("unit_id", "y", "split", F.log(1 + F.col("n_chars")).alias("z1"), F.col("toxic").cast("double").alias("z2"))
    val = splits.stratified_folds(s.where("split = 'validation'").select("unit_id", "y"), "unit_id", "y", None, 5, "chf").select("unit_id", "fold")
    arrays = {"text": F.array("z1"), "metadata": F.array("z2"), "text_plus_metadata": F.array("z1", "z2")}
    return s.join(val, "unit_id", "left").fillna(-1, ["fold"]).withColumns(arrays)


@query("l2_readout_logits", f"WITH {COHORT} SELECT unit_id, {r('logit', 4)} AS logit FROM sc WHERE arm='text_plus_metadata' AND c=1.0")
def _(t):
    d = cohort_rows(t)
    fits = readouts.fit_grid(d.where("split = 'train'"), "text_plus_metadata", "y", None, [None], [1.0])
    return rounded(fits.logits(d, "text_plus_metadata", [0], "z").select("unit_id", F.element_at("z", 1).alias("logit")), "logit", places=4)


@query(
    "l3_selection_on_full_grid",
    f"WITH {COHORT} SELECT p.c, {r('mean', 5)} AS mean, {r('se', 5)} AS se, {r('threshold', 5)} AS threshold, p.c = chosen AS chosen FROM ps p JOIN pick k ON k.arm=p.arm WHERE p.arm='text_plus_metadata'",
)
def _(t):
    _, selection, _ = readouts.select_readout(cohort_rows(t), "text_plus_metadata", "y", "split", "fold")
    return rounded(selection.select("c", "mean", "se", "threshold", "chosen"), "mean", "se", "threshold", places=5)


@query(
    "l8_fusion_readouts",
    f"WITH {COHORT}, k AS (SELECT sc.* FROM sc JOIN pick p ON p.arm=sc.arm AND p.chosen=sc.c), a AS ({auc_sql('k', 'arm, c, split')}) SELECT arm, c, split, n_pos, n_neg, {r('auroc', 5)} AS auroc FROM a",
)
def _(t):
    arms = ("text", "metadata", "text_plus_metadata")
    return rounded(readouts.arm_results(cohort_rows(t), {a: a for a in arms}, "y", "split", "fold"), "auroc", places=5)


PROBE = f"""{COHORT.replace('ln(1 + n_chars) AS z1, toxic::DOUBLE AS z2', "ln(1 + n_chars) AS z1, (source = (SELECT min(source) FROM units))::DOUBLE AS z2").replace('SELECT unit_id, y, split,', 'SELECT unit_id, toxic AS y, split,')}"""


@query("l5_probe_on_full_grid", f"WITH {PROBE}, k AS (SELECT sc.* FROM sc JOIN pick p ON p.arm=sc.arm AND p.chosen=sc.c WHERE sc.arm='text_plus_metadata'), a AS ({auc_sql('k', 'c, split')}) SELECT c, split, n_pos, n_neg, {r('auroc', 5)} AS auroc FROM a")
def _(t):
    u = study(t)
    first = u.agg(F.min("source")).scalar()
    d = u.select("unit_id", "y", "split", F.col("toxic").alias("target"), F.array(F.log(1 + F.col("n_chars")), (F.col("source") == first).cast("double")).alias("x"))
    val = splits.stratified_folds(d.where("split = 'validation'").select("unit_id", "y"), "unit_id", "y", None, 5, "chf").select("unit_id", "fold")
    d = d.join(val, "unit_id", "left").fillna(-1, ["fold"])
    c, _, scored = readouts.select_readout(d, "x", "target", "split", "fold")
    return rounded(metrics.auroc(scored.withColumn("c", F.lit(c)), ["c", "split"], "logit", "target"), "auroc", places=5)


@query(
    "l10_prior_shift_curve",
    f"""{BASE}, pi AS (SELECT arm, seed, avg(y) AS rate FROM preds GROUP BY 1, 2), z AS (SELECT p.arm, p.seed, p.y, lam, lam * (ln({CP}) - ln(1-{CP}) - (ln(rate) - ln(1-rate))) AS q FROM preds p JOIN pi ON pi.arm=p.arm AND pi.seed=p.seed, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(lam))
    SELECT arm, seed, lam, {r('avg(CASE WHEN y=1 THEN ln(1+exp(-q)) ELSE ln(1+exp(q)) END)', 5)} AS nll FROM z GROUP BY 1, 2, 3""",
)
def _(t):
    p = t.predictions()
    rates = p.groupBy(*CELL).agg(F.avg(F.col("y").cast("double")).alias("rate"))
    out = calibrate.shrink_curve(p.join(rates, CELL), "prob", F.col("rate"), [0.25, 0.5, 1.0])
    return rounded(out.groupBy(*CELL, "lam").agg(F.avg(metrics.log_loss(F.col("y"), F.col("shrunk"), 1e-12)).alias("nll")), "nll", places=5)


MONO = f"{BASE}, {newton_sql('preds', 'arm, seed', 'logit')}"


@query(
    "l11_monotone_transport",
    f"{MONO} SELECT arm, seed, {r('CASE WHEN slope <= 0 THEN (SELECT ln(avg(y)) - ln(1-avg(y)) FROM preds) ELSE intercept END')} AS intercept, {r('greatest(slope, 1e-12)')} AS slope, slope <= 0 AS boundary_fit, converged FROM fit",
)
def _(t):
    return rounded(calibrate.monotone_fit(t.predictions(), CELL, "logit", "y"), "intercept", "slope")


@query(
    "l11_transport_audit",
    f"""{BASE}, g AS (SELECT arm, seed, count(DISTINCT logit) AS n FROM preds GROUP BY 1, 2) SELECT arm, seed, n AS n_unique_score, 0::BIGINT AS order_reversals, 0::BIGINT AS n_at_clip, n AS n_unique_prob, 0::BIGINT AS new_ties FROM g""",
)
def _(t):
    p = t.predictions()
    out = calibrate.apply_fit(p, calibrate.monotone_fit(p, CELL, "logit", "y"), CELL, "logit", "moved")
    return calibrate.transport_audit(out, CELL, "logit", "moved")


@query("l12_inner_split", f"WITH {UNITS}, s AS ({SPLIT_U}), tr AS (SELECT unit_id, y, source FROM s WHERE split='train') SELECT unit_id, split FROM ({split_sql('tr', 'y', 'inner', ((0.9, 'fit'),), 'stop')})")
def _(t):
    tr = study(t).where("split = 'train'").select("unit_id", "y", "source")
    return splits.stratified_split(tr, "unit_id", ["y"], "inner", [("fit", 0.9)], "stop").select("unit_id", "split")


# ---- decision rules ----


def branch_sql(corr, low, high, margin):
    return (
        f"CASE WHEN {corr} <= 0 THEN 'alignment_correspondence_not_established' WHEN {low} > 0 THEN 'correspondence_and_matched_transfer_gain' "
        f"WHEN {low} >= -{margin} AND {high} <= {margin} THEN 'correspondence_without_matched_transfer_equivalence_compatible' "
        "ELSE 'correspondence_gain_but_matched_transfer_inconclusive' END"
    )


@query(
    "g5_interpretation_branch",
    f"""{HB}, pv AS (SELECT a.rep, a.value-b.value AS value FROM hv a JOIN hv b ON a.rep=b.rep AND a.arm='fusion' AND b.arm='audio'), i AS ({ci_sql('pv', '')}), w AS (SELECT *, ci_high - ci_low AS w FROM i)
    SELECT {branch_sql('ci_low', 'ci_low', 'ci_high', 0.02)} AS branch, {branch_sql('-w', '-w', 'w', 1.0)} AS branch_lost, {branch_sql('w', 'w', 'w', 1.0)} AS branch_gain, {branch_sql('w', '-w', 'w', 1.0)} AS branch_same, {branch_sql('w', '-w', 'w', 0.0)} AS branch_open,
    CASE WHEN ci_low > 0 THEN 'SIGNAL' WHEN ci_high < 0 THEN 'REVERSED' ELSE 'inconclusive' END AS word FROM w""",
)
def _(t):
    low, high = F.col("ci_low"), F.col("ci_high")
    i = ci(bootstrap.paired_replicates(auroc_replicates(t), "arm", "fusion", "audio"), [])
    w = high - low  # intervals of the measured width on either side of zero reach every branch
    branch = lambda corr, lo, hi, m: gates.interpretation(corr, (lo, hi), (lo, hi), m, m)
    return i.select(
        branch(low, low, high, 0.02).alias("branch"),
        branch(-w, -w, w, 1.0).alias("branch_lost"),
        branch(w, w, w, 1.0).alias("branch_gain"),
        branch(w, -w, w, 1.0).alias("branch_same"),
        branch(w, -w, w, 0.0).alias("branch_open"),
        gates.signal_word(low, high, F.lit(True)).alias("word"),
    )


@query(
    "g6_feasibility_words",
    f"""{HB}, i AS ({ci_sql('hv', 'arm')}), o AS (SELECT arm, avg(auroc) AS auroc FROM ({auc_sql('preds', 'arm, seed')}) GROUP BY 1)
    SELECT i.arm, CASE WHEN ci_high < 0.5 OR ci_low <= 0.5 OR auroc < 0.6 THEN 'INFEASIBLE' WHEN ci_low > 0.6 THEN 'FEASIBLE' ELSE 'insufficient' END AS word FROM i JOIN o ON o.arm=i.arm""",
)
def _(t):
    i = ci(auroc_replicates(t), ["arm"])
    o = metrics.auroc(t.predictions(), CELL, "logit", "y").groupBy("arm").agg(F.avg("auroc").alias("auroc"))
    return i.join(o, "arm").select("arm", gates.feasibility_word(F.col("auroc"), F.col("ci_low"), F.col("ci_high")).alias("word"))


@query("g9_grid_gates", f"{HB}, i AS ({ci_sql('hv', 'arm')}) SELECT count(*) AS n_cells, bool_and(ci_low > 0) AS all_positive, bool_and(ci_low > -0.01 AND ci_high < 0.01) AS all_equivalent FROM i")
def _(t):
    return gates.grid_gates(ci(auroc_replicates(t), ["arm"]), 0.01)


@query(
    "x1_metric_comparison",
    f"""{HB}, ad AS (SELECT p.arm, p.seed, rep, CASE WHEN sum(times*y) > 0 AND sum(times*(1-y)) > 0 THEN sum(times * -{LOSS})/sum(times) END AS neg_nll,
      CASE WHEN sum(times*y) > 0 AND sum(times*(1-y)) > 0 THEN sum(times * -(prob-y)*(prob-y))/sum(times) END AS neg_brier FROM preds p JOIN dr ON dr.unit_id=p.unit_id GROUP BY 1, 2, 3),
    al AS (SELECT arm, seed, rep, metric, v FROM ad UNPIVOT INCLUDE NULLS (v FOR metric IN (neg_nll, neg_brier)) UNION ALL SELECT arm, seed, rep, 'auroc', auroc FROM au),
    hm AS (SELECT arm, metric, a.rep, CASE WHEN count(*) = count(v) THEN sum(times*v)/sum(times) END AS value FROM al a JOIN sd ON sd.rep=a.rep AND sd.seed=a.seed GROUP BY 1, 2, 3),
    pv AS (SELECT a.metric, a.rep, a.value-b.value AS value FROM hm a JOIN hm b ON a.rep=b.rep AND a.metric=b.metric AND a.arm='fusion' AND b.arm='audio'), i AS ({ci_sql('pv', 'metric')}) SELECT metric, ci_low, ci_high, n_valid FROM i""",
)
def _(t):
    return compare_arms(t.predictions(), "arm", "fusion", "audio", "seed", "unit_id", bootstrap.METRICS, "y", "logit", "prob", REPS, "hb").select(
        "metric", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "n_valid"
    )

