"""DuckDB SQL for the operators that SQL can express."""

from .mixing import CAP, SEED, SHARE
from .rules import DEVIATIONS, MAX_DUP_LINE_PERCENT, MAX_HOST_RATE, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MIN_WORDS, STRENGTH, TIMES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH slim AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents
), classed AS (
  SELECT *, length(bin(size)) AS class FROM slim
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM slim GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, {CAP} * source_size AS full_size FROM sources
), levels AS (
  SELECT *, full_size / weight AS ratio,
    (sum(source_size) OVER () * {SHARE} - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
    coalesce(least(full_size::DOUBLE, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)), full_size::DOUBLE) AS target
  FROM levels
), classes AS (
  SELECT c.source, c.class, c.words, t.target FROM (SELECT source, class, sum(size) AS words FROM classed GROUP BY source, class) c
  JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
), scales AS (
  SELECT *, words * class AS mass,
    sum(words * class) OVER (PARTITION BY source) - coalesce(sum(words * class) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    {CAP} * coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
  FROM classes
), fits AS (
  SELECT *, CASE WHEN rest > 0 THEN (target - over) / rest END AS scale FROM scales
), rates AS (
  SELECT source, class, target,
    CASE WHEN max(CASE WHEN scale * class < {CAP} THEN class END) OVER (PARTITION BY source) IS NULL THEN {CAP}::DOUBLE
      ELSE least({CAP}::DOUBLE, class * greatest(0.0, arg_max(scale, CASE WHEN scale * class < {CAP} THEN class END) OVER (PARTITION BY source))) END AS copies
  FROM fits
), drawn AS (
  SELECT c.*, r.target, r.copies, floor(r.copies)::BIGINT AS certain,
    CASE WHEN r.copies - floor(r.copies) > 1e-12 THEN r.copies - floor(r.copies) END AS p,
    (('0x' || substr(md5('{SEED}' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || size::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM classed c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source AND c.class = r.class
), ordered AS (
  SELECT *, CASE WHEN p IS NOT NULL THEN u / (1 - u) * (1 - p) / p END AS q,
    target - sum(size * certain) OVER (PARTITION BY source) AS remaining
  FROM drawn
), cutoff AS (
  SELECT *, CASE WHEN p IS NULL THEN 0
    WHEN coalesce(sum(size) OVER (PARTITION BY source, p IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= remaining THEN 1 ELSE 0 END AS extra
  FROM ordered
)
SELECT c.doc_id, c.size, t.source_size, t.target, (c.size * (c.certain + c.extra))::BIGINT AS taken, c.source, (c.certain + c.extra)::BIGINT AS copies
FROM cutoff c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
"""

# Rules as (column, failure), then for each the host counts, the moments, the prior, the shrunk rates and the limit.
_FAILS = {
    "short": f"n_words < {MIN_WORDS}", "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars", "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
}
_HOSTS = " UNION ALL ".join(f"SELECT source, '{r}' AS rule, count(*)::DOUBLE AS n, sum(({f})::INT)::DOUBLE AS f FROM m GROUP BY source" for r, f in _FAILS.items())

OP6 = rf"""
WITH w AS (
  SELECT doc_id, source, row_number() OVER () AS rid, coalesce(text, '') AS t, {_WORDS} AS words FROM documents
), windows AS (
  SELECT rid, i, words[i:i+4] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, count(*)::BIGINT AS lines, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(l.lines, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)
), hosts AS (
  {_HOSTS}
), moments AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS total, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS squares FROM hosts GROUP BY rule
), spread AS (
  SELECT rule, mean, mean * (1 - mean) AS chance,
    greatest(0.0, squares - total * mean * mean - (k - 1) * mean * (1 - mean)) / greatest(1.0, total - nn / total) AS between_hosts FROM moments
), priors AS (
  SELECT *, least({STRENGTH[1]}, greatest({STRENGTH[0]}, chance / greatest(between_hosts, 1e-9) - 1)) AS strength FROM spread
), limits AS (
  SELECT *, least({MAX_HOST_RATE}, greatest({TIMES} * mean, mean + {DEVIATIONS} * sqrt(chance / (strength + 1)))) AS most FROM priors
), verdicts AS (
  SELECT source, bool_or((f + strength * mean) / (n + strength) > most) AS host_failed FROM hosts JOIN limits USING (rule) GROUP BY source
), judged AS (
  SELECT m.*, (({_FAILS['short']}) OR ({_FAILS['repeats']})) AS base_failed, host_failed FROM m JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT host_failed) AS kept FROM judged
"""

ORACLE: dict[str, str] = {"op1_pareto_mix": OP1, "op6_host_rules": OP6}
