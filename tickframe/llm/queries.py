"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import bpe_chunks, classifier, katz, near_dups, packing, passages, phrase_index, quality_rules, sentence_pieces, source_audit, token_files, top_k, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


# The windows are numbered rows here; an element list per text would be as slow as it is long.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
g AS (SELECT r, i, array_to_string(list_slice(words, i, i + 4), chr(10)) AS win FROM p),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
m AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines,
             (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ', '')))::BIGINT AS n_capitals,
             (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks
      FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
                 + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
                 + 32 * (word_chars > 30 * n_words)::INT + 64 * (n_words >= 10 AND 2 * n_capitals > word_chars)::INT
                 + 128 * (n_words >= 10 AND 2 * n_marks > n_words)::INT)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks, failed_rules,
       'v1' AS policy, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept FROM b
"""
ORACLES["op2_quality_rules"] = QUALITY_SQL


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.round_trip(table(spark, sf_dir, "documents"))


@_query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


ORACLES["op5_url_filter"] = """
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/'))
SELECT page_id, host, path,
       (SELECT rule FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ORDER BY length(rule) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""


@_query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top_k.search(docs, docs.where(F.col("doc_id") % 20 == 0))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


@_query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("vertex")


@_query
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


@_query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
g AS (SELECT d.lang, d.source, coalesce(total, 0) AS total, v, lang_total
      FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
             1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
      FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.collocations(table(spark, sf_dir, "documents"))


# Phrases of each length are joined from numbered words; a long list per text would be slow.
ORACLES["op12_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS piece, lang, s FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d)),
l AS (SELECT piece, lang, regexp_extract_all(s, '[^\x20\x09]+') AS words FROM p),
w AS (SELECT piece, lang, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
g AS (SELECT lang, word AS w1, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3, lead(word, 3) OVER s AS w4
      FROM w WINDOW s AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, list_value(w1) AS ws, count(*) AS f FROM g GROUP BY lang, w1 HAVING count(*) >= 30
      UNION ALL SELECT lang, list_value(w1, w2), count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
      UNION ALL SELECT lang, list_value(w1, w2, w3), count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
      UNION ALL SELECT lang, list_value(w1, w2, w3, w4), count(*) FROM g WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
c AS (SELECT *, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
cut AS (SELECT c.lang, c.ws, c.f AS a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f))::BIGINT AS score
        FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (SELECT lang, ws[s:s + n - 1] AS ws, max(f) AS around
           FROM (SELECT lang, ws, f, n, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT lang, ws, f, unnest(range(2, len(ws))) AS n FROM f WHERE len(ws) > 2))
           GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.ws, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, ws)
         WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@_query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"))
