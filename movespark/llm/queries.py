"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .embeddings import op5_embedding_near_dedup
from .mixing import op1_mix_sources
from .ngram_join import op8_ngram_jaccard
from .pii import op4_pii
from .quality import op10_quality_rules
from .scoring import op2_lm_scores
from .secrets import op9_secret_scan
from .toxicity import op6_toxicity
from .urls import DAMPING, RULES, STEPS, op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_lm_scores": op2_lm_scores,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Rows (d, c): every node with the smallest node reachable over links (a, b) from nodes (id).
_REACH = """both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT id AS d, id AS c FROM node UNION SELECT b, c FROM reach JOIN both_ways ON a = d WHERE c < b)"""


def _url_sql() -> str:
    """Propagation step by step, as many common table expressions as there are steps."""
    rule = verdict = "NULL"
    for text, what in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        fits = f"(h = '{host}' OR ends_with(h, '.{host}')) AND starts_with(p, '{slash}{rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    host_of = "translate(coalesce(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), ''), " + _AZ + ")"
    href = r"""(?i)\bhref\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]*)"""
    parts = [f"WITH u AS (SELECT page_id, html, {host_of.format('url')} AS h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS p FROM pages)",
             f"r AS (SELECT *, {rule} AS rule, {verdict} AS rv FROM u)",
             f"lk AS (SELECT h AS src, {host_of.format('l')} AS dst FROM (SELECT h, unnest(regexp_extract_all(html, '{href}', 1)) AS l FROM u))",
             "lab AS (SELECT DISTINCT string_split(h, '.') AS s FROM u)",
             "tree AS (SELECT array_to_string(s[k:], '.') AS src, array_to_string(s[k + 1:], '.') AS dst FROM lab, range(1, 64) t(k) WHERE k <= len(s) - 2)",
             "e1 AS (SELECT src, dst, count(*) AS n FROM (SELECT * FROM lk UNION ALL SELECT * FROM tree) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
             "e2 AS (SELECT dst AS src, src AS dst, n FROM e1)"]
    for k, what in ((1, "allow"), (2, "block")):
        seeds = f"FROM r WHERE rv = '{what}' AND h <> ''"
        parts.append(f"f{k} AS (SELECT src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY src) AS share FROM e{k})")
        parts.append(f"s{k} AS (SELECT h, count(*) / (SELECT count(*) {seeds}) AS m {seeds} GROUP BY h)")
        last = f"s{k}"
        for step in range(STEPS):
            parts.append(f"m{k}_{step} AS (SELECT h, sum(m) AS m FROM (SELECT dst AS h, m * share AS m FROM {last} x JOIN f{k} ON x.h = src UNION ALL SELECT h, {1 - DAMPING} * m FROM s{k}) GROUP BY h)")
            last = f"m{k}_{step}"
    good, bad = (f"coalesce(round(m{k}_{STEPS - 1}.m, 12), 0)" for k in (1, 2))
    ends = " ".join(f"LEFT JOIN m{k}_{STEPS - 1} ON m{k}_{STEPS - 1}.h = r.h" for k in (1, 2))
    return ", ".join(parts) + f" SELECT page_id, r.h AS host, p AS path, rule, coalesce(rv, CASE WHEN {bad} > {good} THEN 'block' ELSE 'allow' END) AS verdict, round({good}, 9) AS trust, round({bad}, 9) AS distrust FROM r {ends}"


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": _url_sql(),
    "op5_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
node AS (SELECT id FROM v), link AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.id < b.id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93), {_REACH}
SELECT d AS vec_id, (SELECT count(*) FROM both_ways WHERE a = d) AS n_links, min(c) AS component_id, d = min(c) AS kept FROM reach GROUP BY d""",
    "op8_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), {_AZ})")} AS ws FROM documents),
s AS (SELECT doc_id AS id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
node AS (SELECT id, len(sh) AS n FROM s), e AS (SELECT id, unnest(sh) AS x FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN node m ON m.id = a JOIN node o ON o.id = b WHERE 100 * c >= 75 * (m.n + o.n - c)), {_REACH}
SELECT d AS doc_id, any_value(n) AS n_shingles, min(c) AS component_id FROM reach JOIN node ON id = d GROUP BY d""",
    "op10_quality_rules": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {_WORDS.format("text")} AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words OR 100 * n_letter_words < 70 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept FROM b""",
}
