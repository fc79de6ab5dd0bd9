"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT r, doc_id, pos, lines[pos] AS line, {ASCII_LOWER.format(f"trim(lines[pos], {STRIP})")} AS key
    FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM docs)),
shared AS (
    SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
    SELECT r, lines.doc_id, pos, line, coalesce(lines.doc_id <> first_id, false) AS gone
    FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

SITE_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

ORACLES["op4_url_rules"] = f"""
WITH split AS (
    SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
        {ASCII_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in SITE_RULES.items())}),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, rule[strpos(rule, '/'):] AS rule_path FROM rules),
best AS (
    SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM split JOIN parts ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY r)
SELECT page_id, host, path, rule,
    CASE WHEN rule IS NOT NULL THEN verdict
         WHEN contains({ASCII_LOWER.format("url")}, '?utm_source=') THEN 'block'
         WHEN regexp_matches({ASCII_LOWER.format("url")}, '[?]page=.*&ref=', 's') THEN 'block'
         ELSE 'allow' END AS verdict
FROM split LEFT JOIN best USING (r)
"""

ORACLES["op5_domain_quality"] = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT r, i FROM windows JOIN (SELECT r, win FROM windows GROUP BY ALL HAVING count(*) > 1) USING (r, win)),
repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS t(k) GROUP BY r),
lines AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (
    SELECT r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
failures AS (
    SELECT *, base_failed OR 100 * n_symbols > 10 * n_words AS hard,
        100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS soft
    FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)),
domains AS (SELECT source, count(*)::DOUBLE AS documents, (count(*) FILTER (hard))::DOUBLE AS failed FROM failures GROUP BY source),
sums AS (
    SELECT sum(documents) AS n, sum(failed) / sum(documents) AS mean, sum(failed * failed / documents) AS ff,
        sum(documents * documents) AS nn, count(*) AS k FROM domains),
spread AS (
    SELECT n, mean, CASE WHEN n > nn / n THEN greatest(0, (ff - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - nn / n)) ELSE 0 END AS between_domains FROM sums),
prior AS (
    SELECT mean, CASE WHEN between_domains > 0 AND mean > 0 AND mean < 1
        THEN greatest(1, mean * (1 - mean) / between_domains - 1) ELSE greatest(1, n) END AS strength FROM spread),
rates AS (
    SELECT source, documents, mean, strength, (failed + mean * strength) / (documents + strength) AS rate FROM domains, prior),
verdicts AS (
    SELECT source, rate - mean > 3 * sqrt(rate * (1 - rate) / (documents + strength + 1))
        AND rate - mean > sqrt(mean * (1 - mean) / (strength + 1)) AS strict FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT hard AND NOT (strict AND soft) AS kept, strict AS domain_strict
FROM failures JOIN verdicts ON failures.source IS NOT DISTINCT FROM verdicts.source
"""

ORACLES["op1_preference_pairs"] = """
WITH turns AS (
    SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
replies AS (SELECT conv_id, max(turn) AS turn, max(text) FILTER (late) AS text FROM (
    SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS late FROM turns WHERE role = 'assistant') GROUP BY conv_id),
rejected AS (
    SELECT t.* FROM turns t LEFT JOIN replies r USING (conv_id) WHERE r.turn IS NULL OR t.turn < r.turn
    UNION ALL
    SELECT own.conv_id, own.turn, 'assistant', other.text FROM replies own JOIN replies other ON other.conv_id = xor(own.conv_id, 1)),
sides AS (SELECT 'c' AS side, * FROM turns UNION ALL SELECT 'r', * FROM rejected),
by_turn AS (
    SELECT conv_id, turn, coalesce(list([role, text] ORDER BY role, text) FILTER (side = 'c'), []) AS c,
        coalesce(list([role, text] ORDER BY role, text) FILTER (side = 'r'), []) AS r
    FROM sides GROUP BY conv_id, turn),
ends AS (SELECT conv_id, min(turn) FILTER (c <> r) AS differs FROM by_turn GROUP BY conv_id),
parts AS (
    SELECT conv_id, CASE WHEN differs IS NULL OR turn < differs THEN 'p' ELSE side END AS part, turn, role, text
    FROM sides JOIN ends USING (conv_id) WHERE side = 'c' OR NOT (differs IS NULL OR turn < differs)),
rendered AS (
    SELECT conv_id, part, count(DISTINCT turn) AS n,
        string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS whole,
        string_agg(text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) FILTER (role = 'assistant') AS trained
    FROM parts GROUP BY conv_id, part)
SELECT conv_id, coalesce(max(n) FILTER (part = 'p'), 0) AS prompt_turns,
    md5(coalesce(max(whole) FILTER (part = 'p'), '')) AS prompt_md5,
    md5(coalesce(max(whole) FILTER (part = 'c'), '')) AS chosen_md5, md5(coalesce(max(whole) FILTER (part = 'r'), '')) AS rejected_md5,
    length(coalesce(max(trained) FILTER (part = 'c'), '')) AS chosen_trained, length(coalesce(max(trained) FILTER (part = 'r'), '')) AS rejected_trained,
    md5(coalesce(max(trained) FILTER (part = 'c'), '')) AS chosen_trained_md5, md5(coalesce(max(trained) FILTER (part = 'r'), '')) AS rejected_trained_md5
FROM rendered GROUP BY conv_id
"""


def centroid_sql(rounds: int = 10, clusters: int = 8) -> str:
    """Exact Lloyd rounds, one after another."""
    steps = [
        f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
vectors AS MATERIALIZED (
    SELECT r, d, floor(1024 * embedding[d]::DOUBLE)::HUGEINT AS v FROM (SELECT r, embedding, unnest(range(1, 65)) AS d FROM kept)),
seeds AS (
    SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS c
    FROM kept ORDER BY c LIMIT {clusters}),
c0 AS MATERIALIZED (SELECT c, d, v FROM seeds JOIN vectors USING (r))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
apart{i} AS (SELECT r, c, sum((a.v - b.v) * (a.v - b.v)) AS distance FROM vectors a JOIN c{i} b USING (d) GROUP BY r, c),
near{i} AS MATERIALIZED (
    SELECT r, c, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, c) AS k FROM apart{i}) WHERE k = 1)""")
        if i < rounds:
            steps.append(f"""
moved{i} AS (
    SELECT c, d, (s - ((s % n) + n) % n) // n AS v
    FROM (SELECT c, d, sum(v) AS s, count(*) AS n FROM near{i} JOIN vectors USING (r) GROUP BY c, d)),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(moved{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN moved{i} USING (c, d))""")
    return ",".join(steps) + f""",
digests AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN digests USING (c)
"""


ORACLES["op11_subvector_centroids"] = centroid_sql()

ORACLES["op13_divergence_audit"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (
    SELECT r, lang, source, unnest(regexp_extract_all({ASCII_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
shares AS MATERIALIZED (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (l.total + l.v)::HUGEINT AS q
    FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
    UNION ALL
    SELECT a.lang, a.source, b.source, 0 FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
    WHERE a.lang NOT IN (SELECT lang FROM langs)),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 200
"""
