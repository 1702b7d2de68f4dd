"""Registered queries of the training-data operators (thin digests) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import (
    conv_repair,
    decontam,
    embed_dedup,
    html_extract,
    license_scan,
    line_dedup,
    lm_score,
    packing,
    quality,
    resample,
    simhash,
    toxicity,
    url_filter,
)
from bazaar.llm.common import table
from bazaar.session import ensure_checkpoint_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_extract.main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores; the sum is rounded to 3 decimals (its order of addition is free)."""
    return lm_score.score(table(spark, sf_dir, "documents"), order=2).withColumn("score", F.round("score", 3) + F.lit(0.0))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return g.select(g.id.alias("doc_id"), simhash.hex64(g.fp).alias("fingerprint"), g.component.alias("component_id"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words; near copies (SimHash components) never share one."""
    docs = table(spark, sf_dir, "documents")
    g = simhash.simhash_groups(docs)
    return packing.pack(docs, clusters=g.select(g.id.alias("doc_id"), g.component.alias("cluster")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))
    return g.select(g.id.alias("vec_id"), "n_links", g.component.alias("component_id"), "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards ``benchmark`` by word gains and Gumbel noise; every row with its score."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: counts of faults, cheapest edits (audit) and the hash of the repaired text, per conv_id."""
    conversations = table(spark, sf_dir, "conversations")
    fixed = conv_repair.repair(conv_repair.damage(conversations))
    hashes = conv_repair.repaired_hashes(fixed.rows).withColumnRenamed("conv", "h")
    ids = conversations.select("conv_id").distinct()
    out = (ids.join(fixed.summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
           .join(hashes, F.col("conv_id").eqNullSafe(F.col("h")) & F.col("audit").isNotNull(), "left"))
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Rules of ``op13_url_filters`` (fixed by its contract): (verdict, host/path).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Registrants of the page tables sit under these.
URL_SUFFIXES = (*url_filter.SUFFIXES, "example.com", "example.net", "example.org")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else host reputation; a page is bad where the label of its id says low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES, suffixes=URL_SUFFIXES)


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _prepared(f) for f in (
        op1_toxicity, op2_html_extraction, op3_lm_scoring, op4_simhash, op5_line_dedup, op6_quality, op7_best_fit_packing,
        op8_license_scan, op9_embedding_dedup, op10_decontamination, op11_importance_resampling, op12_conversation_repair,
        op13_url_filters)
}

_LM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
t AS (SELECT rid, len(ws) AS size, unnest(ws) AS w, unnest([NULL] || ws[:-2]) AS p FROM d WHERE len(ws) > 0),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w), o1 AS (SELECT rid, w, count(*) AS n FROM t GROUP BY rid, w),
c2 AS (SELECT p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY p, w),
o2 AS (SELECT rid, p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY rid, p, w),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.rid, t.p, total.n - t.size AS rest, c1.n - o1.n AS one, cp.n - op.n AS ctx, c2.n - o2.n AS two
  FROM t CROSS JOIN total JOIN c1 ON c1.w = t.w JOIN o1 ON o1.rid = t.rid AND o1.w = t.w
  LEFT JOIN c1 AS cp ON cp.w = t.p LEFT JOIN o1 AS op ON op.rid = t.rid AND op.w = t.p
  LEFT JOIN c2 ON c2.p = t.p AND c2.w = t.w LEFT JOIN o2 ON o2.rid = t.rid AND o2.p = t.p AND o2.w = t.w),
r AS (
  SELECT rid, sum(CASE WHEN two > 0 THEN ln(two::DOUBLE / ctx)
                       WHEN one > 0 THEN ln(CASE WHEN p IS NULL THEN 1 ELSE 0.4 END * one::DOUBLE / rest)
                       ELSE ln(CASE WHEN p IS NULL THEN 0.4 ELSE 0.4 * 0.4 END / (rest + 1)::DOUBLE) END) AS score
  FROM s GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_tokens, round(coalesce(r.score, 0.0), 3) + 0.0 AS score
FROM d LEFT JOIN r USING (rid)
"""

#: crc32 in SQL: the 256-entry table by its rule, then a fold over the bytes of ``{text}`` (``crc`` holds the table).
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"""
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, 1 + octet_length(encode({text}))),
         lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT),
         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""

_RESAMPLE_SQL = r"""
WITH crc AS MATERIALIZED (""" + _CRC_TABLE + r"""),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
o AS MATERIALIZED (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w),
x AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
k AS MATERIALIZED (SELECT w, (""" + _CRC.format(text="w") + r""" % 10000) AS bucket FROM (SELECT w FROM o UNION SELECT w FROM x), crc),
sb AS (SELECT bucket, sum(n) AS n FROM o JOIN k USING (w) GROUP BY bucket),
tb AS (SELECT bucket, sum(n) AS n FROM x JOIN k USING (w) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln(((coalesce(tb.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM sb)::DOUBLE + 10000))
                                       / ((coalesce(sb.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM tb)::DOUBLE + 10000))))::BIGINT AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN sb USING (bucket) LEFT JOIN tb USING (bucket)),
w AS (SELECT rid, sum(o.n * gain)::BIGINT AS weight FROM o JOIN k USING (w) JOIN g USING (bucket) GROUP BY rid),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE
                                                        / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w USING (rid)),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
             (SELECT count(*) FROM s WHERE n_features >= 20) * 10 // 100 AS drawn FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM p
"""

_URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS rid, page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
named AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') THEN host ELSE regexp_extract(host, '(?:^|\.)(__S__)$', 1) END AS suffix,
                 CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') OR regexp_extract(host, '(?:^|\.)([^.]*\.(?:__S__))$', 1) = '' THEN host
                      ELSE regexp_extract(host, '(?:^|\.)([^.]*\.(?:__S__))$', 1) END AS domain FROM p),
o AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM named JOIN o ON doc_id = page_id
      WHERE host <> '' AND bad IS NOT NULL GROUP BY ALL),
a AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS p FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(a.p) AS p FROM h, a GROUP BY suffix),
sm AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.5), 0.0001::DOUBLE), 0.5::DOUBLE) - 1 AS m FROM s),
sp AS (SELECT suffix, (bad + m * p) / (n + m) AS mean FROM s, sm),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS p FROM h JOIN sp USING (suffix) GROUP BY domain, suffix),
dm AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.5), 0.0001::DOUBLE), 0.5::DOUBLE) - 1 AS m FROM d),
dp AS (SELECT domain, (bad + m * p) / (n + m) AS mean FROM d, dm),
hh AS (SELECT host, n, bad, mean AS p FROM h JOIN dp USING (domain)),
hm AS (SELECT 1 / least(greatest(coalesce(sum((bad - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.5), 0.0001::DOUBLE), 0.5::DOUBLE) - 1 AS m FROM hh),
hp AS (SELECT host, n, (bad + m * p) / (n + m) AS mean FROM hh, hm),
j AS (SELECT named.*, hm.m, coalesce(hp.n, 0.0) AS n, coalesce(hp.mean, dp.mean, sp.mean, a.p) AS mean
      FROM named CROSS JOIN hm CROSS JOIN a LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix)),
rules(verdict, host, path) AS (VALUES __R__),
r AS (SELECT rid, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
             arg_max(verdict, length(rules.host || rules.path)) AS verdict
      FROM p JOIN rules ON (p.host = rules.host OR suffix(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY rid)
SELECT page_id, host, path, r.rule, coalesce(r.verdict, CASE WHEN host <> '' AND mean - 1.645 * sqrt(mean * (1 - mean) / (n + m + 1)) > 0.2
       THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN r USING (rid)
""".replace("__S__", "|".join(s.replace(".", r"\.") for s in URL_SUFFIXES) + "|[^.]*").replace(
    "__R__", ", ".join(f"('{v}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in URL_RULES))

#: Repair in SQL: each conversation is walked from its last row to its first, carrying for each of the four states of the
#: pattern (nothing yet, after s, after u, after a) the cheapest rest as (cost, letters, text); structs compare in that order.
_REPAIR_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (""" + _CRC_TABLE + r"""),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT k.*, """ + _CRC.format(text="key") + r""" % 20 AS kind FROM k, crc),
m AS (SELECT conv_id AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS z, lag(substr(role, 1, 1)) OVER w AS zb,
             row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen
      FROM m WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
s AS MATERIALIZED (
  SELECT conv, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (zb IS NOT NULL AND zb || z NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
walk AS (
  SELECT conv, n AS pos, {'c': 0::BIGINT, 'a': '', 't': ''} AS b0, {'c': 10::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS b1,
         {'c': 5::BIGINT, 'a': 'I', 't': 'assistant:'} AS b2, {'c': 0::BIGINT, 'a': '', 't': ''} AS b3 FROM s
  UNION ALL
  SELECT conv, pos,
    list_sort([e0, {'c': e2.c + 5, 'a': 'I' || e2.a, 't': __U2__}, {'c': e3.c + 10, 'a': 'II' || e3.a, 't': __UA3__}])[1],
    list_sort([e1, {'c': e2.c + 5, 'a': 'I' || e2.a, 't': __U2__}, {'c': e3.c + 10, 'a': 'II' || e3.a, 't': __UA3__}])[1],
    list_sort([e2, {'c': e3.c + 5, 'a': 'I' || e3.a, 't': __A3__}])[1],
    list_sort([e3, {'c': e2.c + 5, 'a': 'I' || e2.a, 't': __U2__}])[1]
  FROM (
    SELECT w.conv, w.pos - 1 AS pos, __E__
    FROM walk w JOIN f ON f.conv IS NOT DISTINCT FROM w.conv AND f.pos = w.pos)),
done AS (SELECT conv, b0 FROM walk WHERE pos = 0)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.c, 0)::BIGINT AS cost,
       coalesce(b0.a, '') AS audit, sha256(coalesce(b0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN s ON s.conv IS NOT DISTINCT FROM i.conv_id
LEFT JOIN done d ON d.conv IS NOT DISTINCT FROM s.conv AND s.n IS NOT NULL
"""


def _repair_sql() -> str:
    def led(line: str, rest: str) -> str:
        return f"{line} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"

    def option(state: int, cost: str, letter: str, line: str | None) -> str:
        rest = f"w.b{state}.t"
        return f"{{'c': w.b{state}.c + {cost}, 'a': '{letter}' || w.b{state}.a, 't': {led(line, rest) if line else rest}}}"

    def edits(state: int, call: str, to: int, keeps: dict[str, int]) -> str:
        more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
        keep = " ".join(f"WHEN z = '{z}' THEN [{option(q, more, 'K', 'role || chr(58) || text')}]" for z, q in keeps.items())
        renamed = option(to, f"1 + {more}", "R", f"'{call}:' || text")
        return (f"list_sort([{option(state, '2', 'D', None)}] || CASE WHEN fault IN ('blank', 'duplicate') THEN [] "
                f"ELSE [{renamed}] || CASE {keep} ELSE [] END END)[1] AS e{state}")

    rows = [edits(0, "user", 2, {"s": 1, "u": 2}), edits(1, "user", 2, {"u": 2}), edits(2, "assistant", 3, {"a": 3}), edits(3, "user", 2, {"u": 2})]
    return (_REPAIR_SQL.replace("__E__", ",\n           ".join(rows)).replace("__U2__", led("'user:'", "e2.t"))
            .replace("__A3__", led("'assistant:'", "e3.t")).replace("__UA3__", led("'user:' || chr(10) || 'assistant:'", "e3.t")))


ORACLE_SQL: dict[str, str] = {
    "op3_lm_scoring": _LM_SQL, "op11_importance_resampling": _RESAMPLE_SQL, "op12_conversation_repair": _repair_sql(), "op13_url_filters": _URL_SQL}
