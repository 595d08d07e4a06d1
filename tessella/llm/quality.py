"""Quality rules with host verdicts.

Each document gets plain rules. The failures are summed by host (the source column); a beta prior is
fitted to the hosts' failure rates by the method of moments (weights: the hosts' documents), each
host's rate is shrunk towards it, and the verdicts are joined back:

    host's posterior mean      verdict on its documents (all that pass the base rules)
    <= bad_rate                dropped when they fail 2 soft rules or more
    >  bad_rate                dropped when they fail 1 soft rule or more
    >  ban_rate                all dropped

Small hosts need no rule of their own: the prior outweighs their few documents. Hosts that differ no
more than chance would make them all get the overall rate.

Base rules: under 50 words, or over half of the words in 3-word windows that occur twice or more.
Soft rules: symbols, repeated lines, mean word length. A document without failures on a host that is
not banned always stays.

Scale: one pass over the texts gives a narrow table, which is stored; the sums by host are
pre-aggregated, and the verdicts (a row a host) are joined under adaptive execution, which broadcasts
the table if it turns out small and splits a hot host's rows if not.

Defined cases: null text has no words and fails the base rule; null hosts form one host; rows of the same identifier
are judged each on its own; very long texts are measured whole, one at a time; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, rowwise, texts

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of size words which occurs twice or more, its first place included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, size):
        key = key * len(number) + ids[k : k + n]
        if len(number) > 1 << 20:  # pairs renumbered, else the key may overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = text.split()
    bare = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (
        len(words),
        len(bare.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), *[(m, pa.int64()) for m in MEASURES]])

    def kernel(ids, bodies, hosts):
        return ((i, h, *measures(b)) for i, b, h in zip(ids, bodies, hosts, strict=True))

    rows = texts(df, id_col, text_col, F.col(host_col).cast("string"))
    return rows.mapInArrow(rowwise(kernel, schema), f"id long, host string, {', '.join(f'{m} long' for m in MEASURES)}")


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", bad_rate: float = 0.5, ban_rate: float = 0.9) -> DataFrame:
    """A row per document: id, the measures, base_failed, soft_failed, host_rate and kept."""
    n = F.col("n_words")
    soft = [
        10 * F.col("n_symbols") > n,
        10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    ]
    rows = measured(df, id_col, text_col, host_col).withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    rows = durable(rows.withColumn("soft_failed", sum((s.cast("int") for s in soft), F.lit(0))))

    failed = F.col("base_failed") | (F.col("soft_failed") > 0)
    hosts = durable(rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(failed.cast("long")).alias("failures")))
    rate = F.col("failures") / F.col("docs")
    total = hosts.agg(F.sum("docs"), F.sum("failures"), F.sum(rate * F.col("failures")), F.count(F.lit(1))).first()
    mean, strength = beta_prior(*total)
    shrunk = F.lit(mean) if strength is None else (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    verdict = hosts.select(F.col("host").alias("_host"), F.round(shrunk, 9).alias("host_rate"))
    joined = rows.join(verdict, F.col("host").eqNullSafe(F.col("_host")))
    most = F.when(F.col("host_rate") > bad_rate, 0).otherwise(1)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= ban_rate) & (F.col("soft_failed") <= most))


def beta_prior(docs: int | None, failures: int | None, squares: float | None, hosts: int) -> tuple[float, float | None]:
    """Mean and strength (the sum of the shape parameters) of the beta law with the mean and variance of the hosts' rates, less the sampling variance.

    squares: the sum of docs * rate^2. No variance is left: an infinite strength, given as None.
    """
    if not docs:
        return 0.0, None
    mean = failures / docs
    spread = mean * (1 - mean)
    between = squares / docs - mean * mean - spread / (docs / hosts)
    return mean, spread / between - 1 if spread > 0 and between > 0 else None


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(documents(spark, sf_dir))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "soft_failed", "host_rate",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, s, ws[s:s + 2] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS s FROM d WHERE len(ws) >= 3)),
again AS (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM (SELECT r, s, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM again GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(w) FOR w IN ws]), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
             coalesce(lines.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN lines ON d.r = lines.r LEFT JOIN rep ON d.r = rep.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CAST(10 * n_symbols > n_words AS INT) + CAST(10 * n_dup_lines > 3 * n_lines AS INT) + CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT) AS soft_failed FROM m),
h AS (SELECT host, count(*) AS docs, sum(CAST(base_failed OR soft_failed > 0 AS INT)) AS failures FROM v GROUP BY host),
s AS (SELECT sum(failures) / sum(docs)::DOUBLE AS mean, sum(failures / docs::DOUBLE * failures) / sum(docs)::DOUBLE AS square, sum(docs)::DOUBLE / count(*) AS size FROM h),
b AS (SELECT mean, mean * (1 - mean) AS spread, square - mean * mean - mean * (1 - mean) / size AS between_hosts FROM s),
p AS (SELECT mean, CASE WHEN spread > 0 AND between_hosts > 0 THEN spread / between_hosts - 1 END AS strength FROM b),
rate AS (SELECT host, round(CASE WHEN strength IS NULL THEN mean ELSE (failures + mean * strength) / (docs + strength) END, 9) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= 0.9 AND soft_failed <= CASE WHEN host_rate > 0.5 THEN 0 ELSE 1 END AS kept, soft_failed, host_rate
FROM v JOIN rate ON v.host IS NOT DISTINCT FROM rate.host
"""
