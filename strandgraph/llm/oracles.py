"""DuckDB SQL for those operators of the subpackage that SQL can express."""

from __future__ import annotations

from strandgraph.llm import licences, quality

GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, gap: str = GAP) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{gap}'), lambda x: x <> '')"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


WARC = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM p LEFT JOIN f ON f.digest = p.digest
"""

_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES))
QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_words("text")} AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
m AS (
    SELECT l.doc_id, len(words) AS n_words, length(regexp_replace(text, '{GAP}', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letters, length(text) - length(replace(text, '!', '')) AS n_exclaims
    FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id),
b AS (SELECT *, {_BITS} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {quality.policy_mask(1)}) <> 0 AS base_failed, (failures & {quality.policy_mask(1) | quality.policy_mask(max(quality.POLICIES))}) = 0 AS kept, failures FROM b
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.comp FROM r JOIN links l ON l.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.comp) AS component_id FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {_words("text")} AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
late AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
x AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, string_agg(words[x.p], ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

_ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAKS = f"""
WITH d AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"), _ALNUM_GAP)} AS words FROM documents),
b AS (SELECT item_id, row_number() OVER () AS item, {_words(_lower("text"), _ALNUM_GAP)} AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, item, i AS pos, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS t FROM (SELECT item_id, item, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT doc_id, i, bw.n, item_id, item, pos FROM dw JOIN bw ON bw.n = dw.n AND bw.t = dw.t),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1),
run AS (SELECT doc_id, min(i) AS i, count(*) + any_value(n) - 1 AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - pos ORDER BY i) AS g FROM h) GROUP BY doc_id, item, i - pos, g),
best AS (SELECT doc_id, len, i - 1 AS start FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, i) = 1)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(best.len, 0) AS longest_match, best.start AS longest_match_start
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id
"""

ORACLE = {
    "op1_warc": WARC,
    "op2_quality_rules": QUALITY,
    "op4_ngram_jaccard_join": JACCARD,
    "op5_substring_dedup": REPEATS,
    "op7_license_scans": licences.ORACLE_SQL,
    "op9_benchmark_decontamination": LEAKS,
}
