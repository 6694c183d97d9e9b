"""Exact retrieval ranks by counting, and comparisons of embedding tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cosine, dot, normalised
from tessera.operators.joins import ContractError, require_unique
from tessera.operators.ranked import ranked_by_value
from tessera.session import cut_lineage

TIE = 1e-12
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 2048
SLICE_ROWS = 512


def candidate_bank(df: DataFrame, profile: str, vector: str | None = None) -> DataFrame:
    """Distinct profiles with their id (SHA-256) and, if given, the vector all their rows share.

    ``one_vector`` is false for a profile whose rows carry different vectors.
    """
    key = F.sha2(F.col(profile), 256)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if vector:
        seen = F.sha2(F.to_json(F.struct(vector)), 256)
        aggs += [F.first(vector).alias(vector), (F.min(seen) == F.max(seen)).alias("one_vector")]
    return df.groupBy(key.alias("profile_id"), profile).agg(*aggs)


def _no_direction(vector: str) -> Column:
    """1 for a vector that is NULL, of length zero or not finite, else 0."""
    length = dot(F.col(vector), F.col(vector))
    return 1 - F.coalesce((length > 0) & (length < float("inf")), F.lit(False)).cast("long")


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.asarray(vectors.tolist(), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _partial_counts(q: pd.DataFrame, c: pd.DataFrame, conditions: Sequence[str]) -> pd.DataFrame:
    """Counts of better and tied candidates of one query block against one candidate block."""
    scores = _unit_rows(q["qv"]) @ _unit_rows(c["cv"]).T
    gold_score = q["gold_score"].to_numpy()[:, None]
    ids, gold = c["cid"].to_numpy(), q["gold"].to_numpy()
    own = gold[:, None] == ids[None, :]
    better = (scores > gold_score + TIE) & ~own
    tied = (np.abs(scores - gold_score) <= TIE) & ~own
    earlier = tied & (ids[None, :] < gold[:, None])
    parts = []
    for name in ["unrestricted", *conditions]:
        if name == "unrestricted":
            ok = np.ones_like(own)
        else:
            groups, code = np.unique(q[name].to_numpy(), return_inverse=True)
            member = np.array([[g in held for held in c[name]] for g in groups], dtype=bool)
            ok = member[code]
        parts.append(
            pd.DataFrame(
                {
                    "qid": q["qid"].to_numpy(),
                    "condition": name,
                    "better": (better & ok).sum(1),
                    "earlier": (earlier & ok).sum(1),
                    "tied": (tied & ok).sum(1),
                    "candidates": ok.sum(1),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def cosine_ranks(
    queries: DataFrame,
    bank: DataFrame,
    query_id: str,
    vector: str,
    gold: str,
    bank_id: str,
    bank_vector: str,
    conditions: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rank of the gold candidate per query and condition: ``(query_id, gold, condition, rank, average_rank, n_candidates)``.

    ``rank`` counts a tied candidate with a smaller id as better; ``average_rank`` counts half of
    all ties. Query and bank ids must be unique, every gold must be in the bank and every vector must have a finite length
    above zero, else ``ContractError``. Under condition ``g`` (a column of ``queries``) the candidates are those that are gold
    for some query with the same value. A bank within ``broadcast_bytes`` is broadcast and scored by
    matrix products per Arrow batch. A larger one is cut into blocks; query blocks meet candidate
    blocks in a co-group of bounded size and the partial counts are added up.
    """
    qtype = dict(queries.dtypes)[query_id]
    gtype = dict(bank.dtypes)[bank_id]
    schema = f"qid {qtype}, condition string, better long, earlier long, tied long, candidates long"
    held = bank.select(F.col(bank_id).alias("cid"), F.col(bank_vector).cast("array<double>").alias("cv"))
    for name in conditions:
        # which groups name a candidate as gold; groups are category levels
        members = queries.groupBy(F.col(gold).alias("cid")).agg(F.collect_set(F.col(name).cast("string")).alias(name))
        held = held.join(members, "cid", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    asks = queries.select(
        F.col(query_id).alias("qid"),
        F.col(gold).cast(gtype).alias("gold"),
        F.col(vector).cast("array<double>").alias("qv"),
        *[F.col(n).cast("string").alias(n) for n in conditions],
    )
    require_unique(queries, [query_id], "queries")
    require_unique(bank, [bank_id], "bank")
    golds = bank.select(F.col(bank_id).alias("gold"), F.col(bank_vector).alias("__gv"))
    asks = asks.join(golds, "gold", "left")
    state = asks.agg(F.sum(F.col("__gv").isNull().cast("long")).alias("no_gold"), F.sum(_no_direction("qv")).alias("flat")).first()
    asks = asks.withColumn("gold_score", cosine(F.col("qv"), F.col("__gv"))).drop("__gv")
    held = cut_lineage(held)
    size = held.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("cv")).alias("d"), F.sum(_no_direction("cv")).alias("flat")
    ).first()
    if state["no_gold"]:
        raise ContractError(f"{state['no_gold']} queries have a gold candidate that is not in the bank")
    if state["flat"] or size["flat"]:
        raise ContractError("a vector is missing, has no length, or is not finite")
    names = list(conditions)
    if (size["n"] or 0) * (size["d"] or 0) * 8 <= broadcast_bytes:
        whole = queries.sparkSession.sparkContext.broadcast(held.toPandas())

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for q in batches:
                for start in range(0, len(q), SLICE_ROWS):
                    yield _partial_counts(q.iloc[start : start + SLICE_ROWS], whole.value, names)

        partial = asks.mapInPandas(score, schema)
    else:
        n_chunks = -(-size["n"] // BLOCK_ROWS)
        n_blocks = max(1, -(-asks.count() // BLOCK_ROWS))
        blocks, chunks = (F.explode(F.expr(f"sequence(0L, {n - 1}L)")) for n in (n_blocks, n_chunks))
        left = asks.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_blocks).cast("long"))).withColumn("cb", chunks)
        right = held.withColumn("cb", F.pmod(F.xxhash64("cid"), F.lit(n_chunks).cast("long"))).withColumn("qb", blocks)

        def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if len(q) and len(c):
                return _partial_counts(q, c, names)
            return pd.DataFrame({k: [] for k in ("qid", "condition", "better", "earlier", "tied", "candidates")})

        partial = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(block, schema)
    total = partial.groupBy("qid", "condition").agg(
        *[F.sum(c).alias(c) for c in ("better", "earlier", "tied", "candidates")]
    )
    return total.join(asks.select("qid", "gold"), "qid").select(
        F.col("qid").alias(query_id),
        "gold",
        "condition",
        (1 + F.col("better") + F.col("earlier")).alias("rank"),
        (1 + F.col("better") + 0.5 * F.col("tied")).alias("average_rank"),
        F.col("candidates").alias("n_candidates"),
    )


def retrieval_metrics(ranks: DataFrame, by: Sequence[str], rank: str = "rank", profile: str = "gold") -> DataFrame:
    """MRR, R@1, R@10 over queries (micro) and with equal weight per profile (macro)."""
    r = F.col(rank).cast("double")
    score = {"mrr": 1.0 / r, "r1": (r <= 1).cast("double"), "r10": (r <= 10).cast("double")}
    per = ranks.groupBy(*by, profile).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in score.items()]
    )
    return per.groupBy(*by).agg(
        F.sum("n").alias("n_queries"),
        F.count(F.lit(1)).alias("n_profiles"),
        *[(F.sum(k) / F.sum("n")).alias(f"micro_{k}") for k in score],
        *[F.avg(F.col(k) / F.col("n")).alias(f"macro_{k}") for k in score],
    )


def random_ranking(ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a random order of the same candidates would score, and the candidate counts.

    The harmonic number is computed once per distinct candidate count.
    """
    sizes = ranks.groupBy(*by, "n_candidates").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n_candidates")
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda a, i: a + 1.0 / i)
    s = sizes.withColumns({"mrr": harmonic / n, "r1": 1.0 / n, "r10": F.least(F.lit(10), n) / n})
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n"))
    return s.groupBy(*by).agg(
        F.sum("n").alias("n_queries"),
        F.min("n_candidates").alias("min_candidates"),
        F.max("n_candidates").alias("max_candidates"),
        *[mean(c).alias(f"random_{c}") for c in ("mrr", "r1", "r10")],
    )


def frequency_ranks(train: DataFrame, queries: DataFrame, query_id: str, profile: str) -> DataFrame:
    """Rank of each query's profile when candidates are ordered by their training frequency only."""
    counts = train.groupBy(profile).agg(F.count(F.lit(1)).alias("n"))
    bank = queries.select(profile).distinct().join(counts, profile, "left").fillna(0, ["n"])
    placed = ranked_by_value(bank.withColumn("__h", F.sha2(F.col(profile).cast("string"), 256)), [], "n", "__h", "rank", descending=True)
    return queries.select(query_id, profile).join(placed.select(profile, "rank"), profile)


def pair_cosines(pairs: DataFrame, vectors: DataFrame, key: str, vector: str, a: str = "a", b: str = "b") -> DataFrame:
    left = vectors.select(F.col(key).alias(a), F.col(vector).alias("__a"))
    right = vectors.select(F.col(key).alias(b), F.col(vector).alias("__b"))
    return pairs.join(left, a).join(right, b).withColumn("cosine", cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def prototype_scores(df: DataFrame, vector: str, prototypes: DataFrame, label: str, proto: str) -> DataFrame:
    """cos(x, positive prototype) - cos(x, negative prototype); the two prototypes are one attached row."""
    both = prototypes.agg(
        F.max(F.when(F.col(label) == 1, F.col(proto))).alias("p"), F.max(F.when(F.col(label) == 0, F.col(proto))).alias("n")
    ).select(F.struct("p", "n"))
    d = df.withColumn("__p", both.scalar())
    return d.withColumn("score", cosine(F.col(vector), F.col("__p.p")) - cosine(F.col(vector), F.col("__p.n"))).drop("__p")


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, j, v, width)`` of Z'Z with Z = [vectors side by side, 1], in one pass.

    Every task adds up its own matrix with matrix products; only those sums are shuffled, one
    matrix per task. The constant column carries the column sums and the row count.
    """
    names = [f"v{k}" for k in range(len(cols))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, width = None, 0
        for b in batches:
            if not len(b):
                continue
            parts = [np.asarray(b[n].tolist(), dtype=np.float64) for n in names]
            width = parts[0].shape[1]
            z = np.hstack([*parts, np.ones((len(b), 1))])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel(), "width": width})

    tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*[F.col(c).cast("array<double>").alias(n) for c, n in zip(cols, names)]).coalesce(tasks)
    sums = rows.mapInPandas(partial, "i long, j long, v double, width long")
    return sums.groupBy("i", "j").agg(F.sum("v").alias("v"), F.max("width").alias("width"))


def _centred(m: pd.DataFrame) -> np.ndarray:
    """Centred cross products from the moment table."""
    d = int(m["i"].max()) + 1
    z = np.zeros((d, d))
    z[m["i"], m["j"]] = m["v"]
    return z[:-1, :-1] - np.outer(z[-1, :-1], z[-1, :-1]) / z[-1, -1]


def linear_cka(df: DataFrame, left: str, right: str) -> DataFrame:
    """Centred linear CKA of two aligned representations.

    The last step works on the moment table, whose size depends on the vector widths only.
    """

    def ratio(m: pd.DataFrame) -> pd.DataFrame:
        g, p = _centred(m), int(m["width"].iloc[0])
        scale = np.linalg.norm(g[:p, :p]) * np.linalg.norm(g[p:, p:])
        return pd.DataFrame({"cka": [float(np.linalg.norm(g[:p, p:]) ** 2 / max(scale, 1e-30))]})

    return _moments(df, [left, right]).groupBy().applyInPandas(ratio, "cka double")


def effective_rank(df: DataFrame, vector: str) -> DataFrame:
    """exp(entropy) of the normalised singular values of the centred matrix."""

    def spectrum(m: pd.DataFrame) -> pd.DataFrame:
        g = _centred(m)
        s = np.sqrt(np.clip(np.linalg.eigvalsh(g), 0.0, None))
        p = s / max(s.sum(), 1e-12)
        p = p[p > 0]
        return pd.DataFrame({"effective_rank": [float(np.exp(-(p * np.log(p)).sum()))], "dim": [len(g)]})

    return _moments(df, [vector]).groupBy().applyInPandas(spectrum, "effective_rank double, dim long")


def representation_check(stored: DataFrame, raw: DataFrame, key: str, vector: str, raw_vector: str, dim: int) -> DataFrame:
    """Stored normalised vectors against recomputed ones: shape, unit norm, largest difference."""
    j = stored.select(key, F.col(vector).alias("s")).join(raw.select(key, normalised(F.col(raw_vector)).alias("r")), key, "full")
    gap = F.array_max(F.zip_with(F.col("s").cast("array<double>"), "r", lambda a, b: F.abs(a - b)))
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("s").isNull() | F.col("r").isNull()).cast("long")).alias("n_unmatched"),
        F.sum((F.size("s") != dim).cast("long")).alias("n_wrong_shape"),
        F.max(F.abs(F.sqrt(dot(F.col("s"), F.col("s"))) - 1.0)).alias("max_norm_error"),
        F.max(gap).alias("max_difference"),
    )
