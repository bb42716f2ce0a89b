"""Quality rules with host verdicts, by DataFrame functions alone.

Each document's counts come from one pass over its text. A host is a document's source. Failures of each of `RULES`
are summed by host; a rule's failure rates are shrunk towards that of all hosts by a beta prior whose mean and strength
come from the hosts' own rates (moments, sampling noise taken off); hosts that any rule gives a shrunk rate above `most`
lose all their documents. Host sums are pre-aggregated, the host table joins back by its known size.

Defined results: null and empty text have no words and fail; repeated rows count as rows; a document without a
host is judged by its own counts; null ids are kept; an empty table gives no rows; other columns are kept, but for those named like a result.
Windows are compared by 64-bit hashes of their five words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, columns, store, table

#: What a document can fail, in SQL: too few words, repeated windows, symbols for words, repeated lines, words of odd length.
RULES = ("n_words < 10", "100 * n_repeat_words > 20 * n_words", "10 * n_symbols > n_words", "n_dup_lines >= 3", "word_chars < 3 * n_words OR word_chars > 10 * n_words")
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
#: A host whose shrunk failure rate is above this is rejected.
MOST = 0.5
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    others = [c for c in docs.columns if c != text and c not in MADE]
    out = docs.select(*others, text).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_w", F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    out = out.withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    out = out.withColumn("_h", F.expr("CASE WHEN size(_w) < 5 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4])) END"))
    out = out.select(
        *others,
        F.expr("CAST(size(_w) AS BIGINT)").alias("n_words"),
        F.char_length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        F.expr("CAST(char_length(_t) - char_length(translate(_t, '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)").alias("n_dup_lines"),
        F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (h, i) -> struct(h AS h, i AS i))) END").alias("_s"),
    )
    out = out.withColumn("_p", F.expr("sort_array(transform(filter(sequence(0, size(_s) - 1), k -> (k > 0 AND _s[greatest(k - 1, 0)].h = _s[k].h) OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].h = _s[k].h)), k -> _s[k].i))"))
    out = out.withColumn("n_repeat_words", F.expr("CASE WHEN _s IS NULL THEN 0L ELSE aggregate(sequence(0, size(_p) - 1), 0L, (n, k) -> n + IF(k = size(_p) - 1, 5, least(5, _p[least(k + 1, size(_p) - 1)] - _p[k]))) END"))
    return out.drop("_s", "_p").withColumn("base_failed", F.expr(f"{RULES[0]} OR {RULES[1]}"))


def hosts(judged: DataFrame, host: str = "source", most: float = MOST) -> DataFrame:
    """host, n, shrunk (the highest of the rules' shrunk rates), rejected from rows with counts."""
    failed = [F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"f{i}") for i, rule in enumerate(RULES)]
    sums = store(judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *failed), "hosts")
    all_ = sums.agg(F.sum("n").alias("n"), F.count("*").alias("h"), F.sum(1 / F.col("n")).alias("inverse"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(RULES))]).first()
    n, h = all_.n or 1, all_.h or 1
    mean = [(all_[f"f{i}"] or 0) / n for i in range(len(RULES))]
    far = sums.agg(*[F.sum(F.pow(F.col(f"f{i}") / F.col("n") - F.lit(m), 2)) for i, m in enumerate(mean)]).first()
    rates = []
    for i, m in enumerate(mean):
        spread = (far[i] or 0) / max(h - 1, 1) - m * (1 - m) * (all_.inverse or 0) / h
        strength = min(STRONGEST, max(WEAKEST, m * (1 - m) / spread - 1)) if spread > 0 else STRONGEST
        rates.append((F.col(f"f{i}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))
    return sums.withColumn("shrunk", F.greatest(*rates)).withColumn("rejected", F.col("shrunk") > most).select("host", "n", "shrunk", "rejected")


def judge(docs: DataFrame, host: str = "source", most: float = MOST) -> DataFrame:
    judged = store(measure(docs), "measured")
    bad = store(hosts(judged, host, most), "verdicts").select(F.col("host").alias("_host"), "shrunk", "rejected")
    return judged.join(bad, F.col(host) == F.col("_host"), "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).drop("_host", "rejected").withColumnRenamed("shrunk", "host_rate")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
z5 AS (SELECT rid, i, a, lead(a, 1) OVER z AS b, lead(a, 2) OVER z AS c, lead(a, 3) OVER z AS d, lead(a, 4) OVER z AS e FROM u WINDOW z AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c, d, e) AS n FROM z5 WHERE e IS NOT NULL),
p AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS more FROM k WHERE n > 1),
r AS (SELECT rid, sum(more) AS n FROM p GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum((n_words < 10)::INT) AS f1, sum((100 * n_repeat_words > 20 * n_words)::INT) AS f2, sum((10 * n_symbols > n_words)::INT) AS f3, sum((n_dup_lines >= 3)::INT) AS f4,
  sum((word_chars < 3 * n_words OR word_chars > 10 * n_words)::INT) AS f5 FROM b WHERE source IS NOT NULL GROUP BY source),
e AS (SELECT source, n, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5])::DOUBLE AS f FROM h),
g AS (SELECT rule, sum(f) / sum(n) AS mean, count(*) AS hn, sum(1 / n::DOUBLE) AS inv FROM e GROUP BY rule),
s AS (SELECT rule, any_value(mean) AS mean, sum((f / n - mean) ** 2) / greatest(any_value(hn) - 1, 1) - any_value(mean) * (1 - any_value(mean)) * any_value(inv) / any_value(hn) AS spread FROM e JOIN g USING (rule) GROUP BY rule),
a AS (SELECT rule, mean, CASE WHEN spread > 0 THEN least(1000, greatest(2, mean * (1 - mean) / spread - 1)) ELSE 1000 END AS strength FROM s),
v AS (SELECT source, max((f + mean * strength) / (n + strength)) AS rate FROM e JOIN a USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate <= 0.5, true) AS kept FROM b LEFT JOIN v USING (source)
"""
