"""Reference SQL (DuckDB) of the queries that SQL can express: substring dedup, stupid backoff and the n-gram Jaccard join.

The SQL takes the plain way over all words or all pairs that share an n-gram. It is for comparison on small tables only.
"""

from __future__ import annotations

import string

from tessera.llm.common import ORACLE

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _words(text: str) -> str:
    """CTEs ``listed`` (doc_id, words) and ``words`` (doc_id, i from 1, word)."""
    return f"""listed AS (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed)"""


def _run(n: int) -> str:
    """The word and its n - 1 successors in the same document."""
    return "concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) OVER d" for k in range(1, n)) + ")"


ORACLE["op1_substring_dedup"] = f"""
    WITH {_words("coalesce(text, '')")},
    runs AS (
        SELECT doc_id, i, word, {_run(20)} AS run, count(*) OVER (PARTITION BY doc_id) AS n
        FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    later AS (
        SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM runs WHERE i <= n - 19)
        WHERE k > 1),
    judged AS (
        SELECT doc_id, i, word, max(CASE WHEN later.i IS NULL THEN 0 ELSE 1 END) OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
        FROM words LEFT JOIN later USING (doc_id, i)),
    kept AS (
        SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
            string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
        FROM judged GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM listed LEFT JOIN kept USING (doc_id)"""

ORACLE["op4_stupid_backoff"] = f"""
    WITH {_words(_LOWER)},
    pairs AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words),
    ones AS (SELECT word, count(*) AS c FROM words GROUP BY word),
    twos AS (SELECT before, word, count(*) AS c FROM pairs WHERE before IS NOT NULL GROUP BY before, word HAVING count(*) >= 2),
    scored AS (
        SELECT doc_id, count(*) AS n_words, sum(CASE
            WHEN twos.c IS NOT NULL THEN ln(twos.c) - ln(context.c)
            ELSE ln(0.4) + ln(own.c) - ln((SELECT count(*) FROM words)) END) AS score
        FROM pairs JOIN ones AS own USING (word)
        LEFT JOIN ones AS context ON context.word = pairs.before
        LEFT JOIN twos ON twos.before = pairs.before AND twos.word = pairs.word
        GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(score, 0.0) AS score, score / n_words AS mean_score
    FROM listed LEFT JOIN scored USING (doc_id)"""

ORACLE["op9_ngram_jaccard_join"] = f"""
    WITH RECURSIVE {_words(_LOWER)},
    runs AS (
        SELECT doc_id, i, {_run(5)} AS run, count(*) OVER (PARTITION BY doc_id) AS n
        FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    grams AS (SELECT DISTINCT doc_id, run FROM runs WHERE i <= greatest(n - 4, 1)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    links AS (
        SELECT x.doc_id AS a, y.doc_id AS b
        FROM grams AS x JOIN grams AS y ON x.run = y.run AND x.doc_id != y.doc_id
        JOIN sizes AS sx ON sx.doc_id = x.doc_id JOIN sizes AS sy ON sy.doc_id = y.doc_id
        GROUP BY x.doc_id, y.doc_id, sx.n, sy.n
        HAVING 100 * count(*) >= 80 * (sx.n + sy.n - count(*))),
    reached AS (
        SELECT doc_id, doc_id AS other FROM listed
        UNION
        SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
    FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""
