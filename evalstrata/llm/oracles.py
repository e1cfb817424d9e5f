"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import words
from .license_scan import BLOCK_WORDS, PHRASES, TEMPLATES
from .web_archives import LEAST


def words_of(text: str) -> str:
    """SQL for the list of words of a text: A-Z lowered, then runs of other than ASCII signs."""
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {words_of("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, least(len(w), i + 9)) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {words_of("text")} AS w FROM documents),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
marked AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
first AS (SELECT digest, min(page_id) AS first_id FROM page WHERE n >= {LEAST} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM page LEFT JOIN first USING (digest)
"""

LM_SCORING = f"""
WITH doc AS (SELECT doc_id, {words_of("text")} AS w FROM documents),
word AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc)),
one_in AS (SELECT doc_id, b, count(*) AS n FROM word GROUP BY ALL),
one AS (SELECT b, sum(n) AS n FROM one_in GROUP BY b),
two_in AS (SELECT doc_id, a, b, count(*) AS n FROM word WHERE a IS NOT NULL GROUP BY ALL),
two AS (SELECT a, b, sum(n) AS n FROM two_in GROUP BY a, b),
total AS (SELECT count(*) AS n FROM word),
counted AS (
  SELECT word.doc_id, word.i, one.n - one_in.n AS c1, two.n - two_in.n AS c2, ctx.n - ctx_in.n AS c0,
    greatest(1, total.n - len(doc.w)) AS rest
  FROM word JOIN doc USING (doc_id) CROSS JOIN total
  JOIN one ON one.b = word.b JOIN one_in ON one_in.doc_id = word.doc_id AND one_in.b = word.b
  LEFT JOIN two ON two.a = word.a AND two.b = word.b
  LEFT JOIN two_in ON two_in.doc_id = word.doc_id AND two_in.a = word.a AND two_in.b = word.b
  LEFT JOIN one ctx ON ctx.b = word.a LEFT JOIN one_in ctx_in ON ctx_in.doc_id = word.doc_id AND ctx_in.b = word.a),
scored AS (
  SELECT doc_id, sum(CASE WHEN c2 > 0 THEN ln(CAST(c2 AS DOUBLE)) - ln(CAST(c0 AS DOUBLE))
    ELSE ln(CAST(greatest(c1, 1) AS DOUBLE)) - ln(CAST(rest AS DOUBLE)) + CASE WHEN c2 IS NULL THEN 0 ELSE ln(0.4) END END) AS s
  FROM counted GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score,
  CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log_score
FROM doc LEFT JOIN scored USING (doc_id)
"""



def license_scan(threshold: int = 900) -> str:
    """All blocks against all templates; threshold in thousandths."""
    phrases = ", ".join(f"([{', '.join(repr(w) for w in k.split())}], '{v}')" for k, v in PHRASES.items())
    rows = []
    for label, text in TEMPLATES.items():
        own = sorted({w.decode() for w in words(text)})
        rows.append(f"('{label}', [{', '.join(repr(w) for w in own)}], {-(-len(own) * threshold // 1000)})")
    step = BLOCK_WORDS // 2
    return f"""
WITH doc AS (SELECT doc_id, text, {words_of("text")} AS w FROM documents),
phrase(ws, label) AS (VALUES {phrases}),
template(label, ws, need) AS (VALUES {", ".join(rows)}),
place AS (
  SELECT doc_id, i - 1 AS pos, label
  FROM (SELECT doc_id, w, label, ws, unnest(range(1, len(w) - len(ws) + 2)) AS i FROM doc, phrase WHERE len(w) >= len(ws))
  WHERE list_slice(w, i, i + len(ws) - 1) = ws),
line AS (SELECT doc_id, {words_of("line")} AS lw FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
block AS (
  SELECT doc_id, lw AS b FROM line WHERE len(lw) BETWEEN 1 AND {BLOCK_WORDS}
  UNION ALL
  SELECT doc_id, list_slice(lw, i + 1, i + {BLOCK_WORDS})
  FROM (SELECT doc_id, lw, unnest(range(0, greatest(1, len(lw) - {step}), {step})) AS i FROM line WHERE len(lw) > {BLOCK_WORDS})),
compared AS (SELECT doc_id, label, need, len(ws) AS n, len(list_filter(ws, lambda x: list_contains(b, x))) AS common FROM block, template),
match AS (SELECT doc_id, label, max(CAST(common AS DOUBLE) / n) AS share FROM compared WHERE common >= need GROUP BY doc_id, label),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM match) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM match GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op5_license_scan": license_scan(),
    "op6_warc": WARC,
    "op10_lm_scoring": LM_SCORING,
}
