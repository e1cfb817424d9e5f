"""DuckDB SQL for the driver's queries."""

from __future__ import annotations

import unicodedata

from .inputs import SQL as INPUTS
from .inputs import TROUBLED

#: The queries' own tables aren't used here: marks by their numbers, letters by the Unicode data.
TONE_MARKS = "".join(map(chr, (0x300, 0x301, 0x302, 0x304, 0x30C)))
HOOKED = "".join(map(chr, (0x253, 0x257, 0x199, 0x1B4, 0x181, 0x18A, 0x198, 0x1B3)))


def toneless(c: str) -> str:
    """A letter, decomposed step by step, without tone marks."""
    kind = unicodedata.decomposition(c)
    if not kind or kind.startswith("<"):
        return "" if c in TONE_MARKS else c
    return unicodedata.normalize("NFC", "".join(toneless(chr(int(x, 16))) for x in kind.split()))


_LETTERS = [c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.is_normalized("NFC", c) and c not in TONE_MARKS]
MARKED = "".join(c for c in _LETTERS if len(toneless(c)) == 1 and toneless(c) != c)
BARE = "".join(map(toneless, MARKED))


def norm(text: str, tones: str = "keep") -> str:
    """Normal form of a text without apostrophes."""
    x = f"lower({text})"
    if tones == "strip":
        x = f"regexp_replace(translate({x}, '{MARKED}', '{BARE}'), '[{TONE_MARKS}]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[\p{{P}}\p{{S}}]', ' ', 'g'), '\s+', ' ', 'g'))"


def answered(run: str, alias: str) -> str:
    return f"""{alias} AS (SELECT ex.*, CASE WHEN r.id IS NULL THEN 'missing' WHEN r.error IS NOT NULL THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN r.id IS NOT NULL AND r.error IS NULL THEN coalesce(r.prediction, '') ELSE '' END AS answer,
  CASE WHEN r.error IS NULL THEN r.latency_ms END AS latency_ms FROM ex LEFT JOIN {run} r ON r.id = ex.id)"""


def views(source: str, alias: str, extra: str = "id, pos, lang, status") -> str:
    return f"""{alias} AS (SELECT {extra}, 'tone_aware' AS view, {norm("answer")} AS p, {norm("reference")} AS r FROM {source}
  UNION ALL SELECT {extra}, 'tone_insensitive', {norm("answer", "strip")}, {norm("reference", "strip")} FROM {source})"""


BASE = f"WITH {INPUTS}, {answered('base', 'a')}, {views('a', 'v')}"
CANDIDATE = f"WITH {INPUTS}, {answered('candidate', 'a')}, {views('a', 'v')}"
BOTH_VIEWS = f"""WITH {INPUTS}, {answered('base', 'ab')}, {answered('candidate', 'ac')}, {views('ab', 'vb')}, {views('ac', 'vc')}"""
BOTH = f"""WITH {INPUTS}, {answered('base', 'ab')}, {answered('candidate', 'ac')}, {views('ab', 'vb')}, {views('ac', 'vc')},
pair AS (SELECT vb.id, vb.view, CAST(vb.p = vb.r AS INTEGER) AS b, CAST(vc.p = vc.r AS INTEGER) AS c FROM vb JOIN vc ON vb.id = vc.id AND vb.view = vc.view)"""


def middles(source: str, keep: str) -> str:
    """Lists a and b without what both start with, and then, reversed, without what both end with: ma, mb."""
    start = lambda x, y: f"coalesce(nullif(list_position(list_transform(list_zip({x}[1:least(len({x}), len({y}))], {y}[1:least(len({x}), len({y}))]), lambda z: z[1] <> z[2]), true), 0) - 1, least(len({x}), len({y})))"
    return f"""
h AS (SELECT {keep}, a, b, {start("a", "b")} AS k FROM {source}),
t AS (SELECT {keep}, list_reverse(a[k + 1:]) AS ra, list_reverse(b[k + 1:]) AS rb FROM h),
tk AS (SELECT *, {start("ra", "rb")} AS k FROM t),
mid AS (SELECT {keep}, ra[k + 1:] AS ma, rb[k + 1:] AS mb FROM tk),
voc AS (SELECT *, list_distinct(list_concat(ma, mb)) AS voc FROM mid),
coded AS (SELECT {keep}, len(ma) AS na, len(mb) AS nb, array_to_string(list_transform(ma, lambda x: chr(CAST(list_position(voc, x) AS INTEGER))), '') AS ca,
  array_to_string(list_transform(mb, lambda x: chr(CAST(list_position(voc, x) AS INTEGER))), '') AS cb FROM voc)"""


#: Between common ends, signs or words as numbers 1 to 127, as the built-in distance counts bytes.
CODED = f"""
lists AS (SELECT id, view, p, r, CASE WHEN p = '' THEN [] ELSE string_split(p, '') END AS a, CASE WHEN r = '' THEN [] ELSE string_split(r, '') END AS b FROM v),
{middles("lists", "id, view, p, r")},
e AS (SELECT id, view, p, r, CASE WHEN na = 0 THEN nb WHEN nb = 0 THEN na ELSE levenshtein(ca, cb) END AS d, length(r) AS n FROM coded)"""
WORDS = f"""
ws AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS a, list_filter(string_split(r, ' '), lambda x: x <> '') AS b FROM v),
wn AS (SELECT *, len(b) AS n FROM ws),
{middles("wn", "id, view, status, p, n")},
e AS (SELECT *, CASE WHEN na = 0 THEN nb WHEN nb = 0 THEN na ELSE levenshtein(ca, cb) END AS d FROM coded)"""
GRAMS = """
t AS (SELECT id, view, replace(p, ' ', '') AS hp, replace(r, ' ', '') AS hr, p, r FROM v),
orders AS (SELECT unnest(range(1, 7)) AS n),
gp AS (SELECT id, view, n, substr(hp, i, n) AS g, count(*) AS c FROM (SELECT id, view, hp, n, unnest(range(1, length(hp) - n + 2)) AS i FROM t, orders WHERE length(hp) >= n AND hp <> hr) GROUP BY ALL),
gr AS (SELECT id, view, n, substr(hr, i, n) AS g, count(*) AS c FROM (SELECT id, view, hr, n, unnest(range(1, length(hr) - n + 2)) AS i FROM t, orders WHERE length(hr) >= n AND hp <> hr) GROUP BY ALL),
m AS (SELECT gp.id, gp.view, gp.n, sum(least(gp.c, gr.c)) AS both_n FROM gp JOIN gr ON gp.id = gr.id AND gp.view = gr.view AND gp.n = gr.n AND gp.g = gr.g GROUP BY ALL
  UNION ALL SELECT id, view, n, length(hp) - n + 1 FROM t, orders WHERE hp = hr AND length(hp) >= n),
s AS (SELECT t.id, t.view, orders.n, CASE WHEN length(hr) >= orders.n THEN greatest(length(hp) - orders.n + 1, 0) ELSE 0 END AS hn, greatest(length(hr) - orders.n + 1, 0) AS rn, coalesce(both_n, 0) AS both_n
  FROM t CROSS JOIN orders LEFT JOIN m ON m.id = t.id AND m.view = t.view AND m.n = orders.n)"""
#: F with beta 2 of averages pr and rc.
F2 = "CASE WHEN pr + rc > 0 THEN 100.0 * 5 * pr * rc / (4 * pr + rc) ELSE 0.0 END"
GRADED = f"""WITH g AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS r,
  CASE WHEN doc_id % 6 = 0 THEN 'bad' WHEN doc_id % 6 = 1 THEN 'good' ELSE 'the answer is good' END AS p FROM labels WHERE quality IS NOT NULL),
l AS (SELECT DISTINCT r AS label FROM g),
found AS (SELECT g.id, g.r, g.p, min(CASE WHEN strpos(' ' || p || ' ', ' ' || label || ' ') > 0 THEN lpad(CAST(strpos(' ' || p || ' ', ' ' || label || ' ') AS VARCHAR), 9, '0') || label END) AS hit,
  max(CASE WHEN p = label THEN label END) AS strict FROM g CROSS JOIN l GROUP BY g.id, g.r, g.p),
graded AS (SELECT id, r, substr(hit, 10) AS loose, strict FROM found),
view_names AS (SELECT unnest(['tone_aware', 'tone_insensitive']) AS view)"""


def f1(column: str) -> str:
    return f"""SELECT avg(f) FROM (SELECT 2.0 * count(*) FILTER (r = {column}) / (count(*) + (SELECT count(*) FROM graded x WHERE x.{column} = graded.r)) AS f FROM graded GROUP BY r)"""


SLICES = f"""{BOTH},
sliced AS (SELECT pair.*, ex.lang, ex.domain, ex.reference FROM pair JOIN ex ON ex.id = pair.id WHERE view = 'tone_aware'),
cut AS (SELECT 'lang' AS field, lang AS bucket, b, c FROM sliced UNION ALL SELECT 'domain', domain, b, c FROM sliced
  UNION ALL SELECT 'has_number', CASE WHEN regexp_matches(reference, '\\p{{Nd}}') THEN 'yes' ELSE 'no' END, b, c FROM sliced
  UNION ALL SELECT 'length', CASE WHEN n <= 5 THEN 'short (<=5 words)' WHEN n <= 15 THEN 'medium (6-15 words)' ELSE 'long (>15 words)' END, b, c
    FROM (SELECT *, len(list_filter(string_split(reference, ' '), lambda x: x <> '')) AS n FROM sliced))"""
KEYED = f"WITH {INPUTS}, k AS (SELECT *, {norm('text', 'strip')} AS ik, {norm('reference', 'strip')} AS rk FROM ex)"
NUMBERS = r"list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace({0}, '(\p{{Nd}}),(\p{{Nd}})', '\1\2', 'g'), '(\p{{Nd}}),(\p{{Nd}})', '\1\2', 'g'), '\p{{Nd}}+(?:\.\p{{Nd}}+)?')))"


CER = f"""WITH {CODED} SELECT id, view, CASE WHEN n > 0 THEN CAST(d AS DOUBLE) / n WHEN p = '' THEN 0 ELSE 1 END AS value FROM e"""

SQL: dict[str, str] = {
    "normalize_tone_aware": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "normalize_tone_insensitive": f"SELECT doc_id, {norm('text', 'strip')} AS norm FROM documents",
    "exact_match_by_lang": f"{BASE} SELECT lang, view, count(*) AS n, round(avg(CAST(p = r AS INTEGER)), 6) AS exact_match FROM v GROUP BY lang, view",
    "score_counts": f"{BASE} SELECT count(*) AS n_total, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'missing') AS n_missing FROM a",
    "latency_stats": f"{BASE} SELECT round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(max(latency_ms), 6) AS max FROM a",
    "cer_pooled": f"""{BASE}, {CODED}
SELECT view, round(CAST(sum(d) FILTER (n > 0) AS DOUBLE) / sum(n) FILTER (n > 0), 6) AS cer, round(avg(CASE WHEN n > 0 THEN CAST(d AS DOUBLE) / n WHEN p = '' THEN 0 ELSE 1 END), 6) AS mean_cer FROM e GROUP BY view""",
    "wer_pooled": f"""{BASE}, {WORDS} SELECT view, round(CAST(sum(d) FILTER (n > 0) AS DOUBLE) / sum(n) FILTER (n > 0), 6) AS wer,
  round(avg(CASE WHEN n > 0 THEN CAST(d AS DOUBLE) / n WHEN p = '' THEN 0 ELSE 1 END), 6) AS mean_wer FROM e GROUP BY view""",
    "wer_by_length_bucket": f"""{CANDIDATE}, {WORDS} SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' ELSE '31+' END AS bucket,
  count(*) AS n, round(CAST(sum(d) AS DOUBLE) / sum(n), 6) AS wer FROM e WHERE view = 'tone_aware' AND n > 0 GROUP BY 1""",
    "chrf_corpus": f"""{BASE}, {GRAMS}, total AS (SELECT view, n, sum(hn) AS hn, sum(rn) AS rn, sum(both_n) AS both_n FROM s GROUP BY view, n),
x AS (SELECT view, avg(CAST(both_n AS DOUBLE) / hn) AS pr, avg(CAST(both_n AS DOUBLE) / rn) AS rc FROM total WHERE hn > 0 AND rn > 0 GROUP BY view)
SELECT view, round({F2}, 6) AS chrf FROM x""",
    "chrf_sentence_mean": f"""{BASE}, {GRAMS}, x AS (SELECT id, view, avg(CAST(both_n AS DOUBLE) / hn) AS pr, avg(CAST(both_n AS DOUBLE) / rn) AS rc FROM s WHERE hn > 0 AND rn > 0 GROUP BY id, view)
SELECT t.view, round(avg(CASE WHEN t.p = '' AND t.r = '' THEN 100.0 WHEN pr IS NULL THEN 0.0 ELSE {F2} END), 6) AS chrf FROM t LEFT JOIN x ON x.id = t.id AND x.view = t.view GROUP BY t.view""",
    "accuracy": f"{GRADED} SELECT view, count(*) AS n, round(avg(CAST(coalesce(loose = r, false) AS INTEGER)), 6) AS accuracy FROM graded CROSS JOIN view_names GROUP BY view",
    "accuracy_strict": f"{GRADED} SELECT view, round(avg(CAST(coalesce(strict = r, false) AS INTEGER)), 6) AS accuracy FROM graded CROSS JOIN view_names GROUP BY view",
    "macro_f1": f"""{GRADED} SELECT view, 'macro_f1' AS metric, round(({f1("loose")}), 6) AS corpus FROM view_names
UNION ALL SELECT view, 'macro_f1_strict', round(({f1("strict")}), 6) FROM view_names""",
    "paired_wtl": f"""{BOTH} SELECT view, count(*) AS n, count(*) FILTER (c > b) AS wins, count(*) FILTER (c = b) AS ties, count(*) FILTER (c < b) AS losses,
  round(avg(b), 6) AS base_mean, round(avg(c), 6) AS candidate_mean, round(avg(c - b), 6) AS delta FROM pair GROUP BY view""",
    "mcnemar": f"""{BOTH}, d AS (SELECT view, count(*) FILTER (b = 1 AND c = 0) AS base_only, count(*) FILTER (b = 0 AND c = 1) AS candidate_only FROM pair GROUP BY view),
k AS (SELECT d.*, unnest(range(0, least(base_only, candidate_only) + 1)) AS i FROM d)
SELECT view, base_only, candidate_only, round(least(1.0, 2 * sum(exp(lgamma(base_only + candidate_only + 1) - lgamma(i + 1) - lgamma(base_only + candidate_only - i + 1) - (base_only + candidate_only) * ln(2)))), 8) AS p_value
FROM k GROUP BY view, base_only, candidate_only""",
    "slice_means": f"{SLICES} SELECT field, bucket, count(*) AS n, round(avg(b), 6) AS base_mean, round(avg(c), 6) AS candidate_mean, count(*) >= 30 AS judged FROM cut GROUP BY field, bucket",
    "group_counts": f"""WITH {INPUTS}, cut AS (SELECT 'lang' AS field, lang AS bucket FROM ex UNION ALL SELECT 'domain', domain FROM ex
  UNION ALL SELECT 'has_number', CASE WHEN regexp_matches(reference, '\\p{{Nd}}') THEN 'yes' ELSE 'no' END FROM ex
  UNION ALL SELECT 'length', CASE WHEN n <= 5 THEN 'short (<=5 words)' WHEN n <= 15 THEN 'medium (6-15 words)' ELSE 'long (>15 words)' END
    FROM (SELECT len(list_filter(string_split(reference, ' '), lambda x: x <> '')) AS n FROM ex))
SELECT field, bucket, count(*) AS n FROM cut GROUP BY field, bucket""",
    "text_rules": rf"""WITH k AS (SELECT doc_id, text, regexp_extract_all({norm("text", "strip")}, '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
one AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM k) GROUP BY ALL) GROUP BY doc_id),
four AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM k WHERE len(w) >= 4)) GROUP BY ALL) GROUP BY doc_id)
SELECT k.doc_id, (len(w) >= 8 AND one.most >= 0.5 * len(w)) OR (len(w) >= 12 AND coalesce(four.most, 0) >= 3) AS repeated,
  CAST(len({NUMBERS.format("text")}) AS BIGINT) AS n_numbers
FROM k LEFT JOIN one USING (doc_id) LEFT JOIN four USING (doc_id)""",
    "flag_rules": rf"""WITH {INPUTS}, {answered("candidate", "a")},
k AS (SELECT id, reference AS r, answer AS p, regexp_extract_all({norm("answer", "strip")}, '[\p{{L}}\p{{N}}_]+') AS w,
  regexp_replace(regexp_replace(regexp_replace(answer, '\s+$', ''), '["''”’)\]}}]+$', ''), '\s+$', '') AS bare FROM a WHERE status = 'ok'),
one AS (SELECT id, max(c) AS most FROM (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(w) AS x FROM k) GROUP BY ALL) GROUP BY id),
four AS (SELECT id, max(c) AS most FROM (SELECT id, g, count(*) AS c FROM (SELECT id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM k WHERE len(w) >= 4)) GROUP BY ALL) GROUP BY id)
SELECT k.id, {NUMBERS.format("r")} <> {NUMBERS.format("p")} AS number_mismatch,
  regexp_matches(r, '[.!?…]\s*$') AND bare <> '' AND NOT regexp_matches(bare, '[.!?…]$') AND len(w) >= 5 AS truncated,
  (len(w) >= 8 AND one.most >= 0.5 * len(w)) OR (len(w) >= 12 AND coalesce(four.most, 0) >= 3) AS repeated,
  length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) >= 10 AND length(regexp_replace(p, '[^\p{{L}}]|\p{{Latin}}', '', 'g')) >= 0.2 * length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) AS non_latin,
  trim(p) = '' AS blank
FROM k LEFT JOIN one USING (id) LEFT JOIN four USING (id)""",
    "duplicates": f"{KEYED}, f AS (SELECT ik, rk, min(pos) AS first_pos FROM k GROUP BY ik, rk HAVING count(*) > 1) SELECT id, first_pos FROM k JOIN f USING (ik, rk) WHERE pos > first_pos",
    "conflicts": f"""WITH {INPUTS}, k AS (SELECT id, pos, domain || ' ' || lang AS ik, {norm("reference", "strip")} AS rk FROM ex),
refs AS (SELECT ik, rk, min(pos) AS pos FROM k GROUP BY ik, rk), several AS (SELECT ik, count(*) AS n FROM refs GROUP BY ik HAVING count(*) > 1)
SELECT pos AS id, pos, n AS "references" FROM refs JOIN several USING (ik)""",
    "leakage": f"""{KEYED} SELECT identical, count(*) AS n FROM (SELECT id, text IN (SELECT text FROM ex WHERE id % 2 = 1) AS identical FROM k WHERE id % 2 = 0 AND ik IN (SELECT ik FROM k WHERE id % 2 = 1)) GROUP BY identical""",
    "text_health": f"""WITH {INPUTS}, {TROUBLED}, k AS (SELECT *, {norm("text", "strip")} AS ik, {norm("reference", "strip")} AS rk FROM troubled),
t AS (SELECT id, text AS x FROM troubled UNION ALL SELECT id, reference FROM troubled),
p AS (SELECT DISTINCT id, 'padded' AS problem FROM t WHERE x <> regexp_replace(x, '^\\s+|\\s+$', '', 'g') UNION ALL SELECT DISTINCT id, 'replacement' FROM t WHERE contains(x, chr(65533))
  UNION ALL SELECT DISTINCT id, 'controls' FROM t WHERE regexp_matches(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') UNION ALL SELECT DISTINCT id, 'non_nfc' FROM t WHERE nfc_normalize(x) <> x
  UNION ALL SELECT id, 'empty_inputs' FROM k WHERE ik = '' UNION ALL SELECT id, 'empty_refs' FROM k WHERE rk = '')
SELECT problem, count(*) AS n FROM p GROUP BY problem""",
    "diacritic_rates": f"""WITH {INPUTS}, t AS (SELECT CASE lang WHEN 'fr' THEN 'yo' WHEN 'es' THEN 'ig' WHEN 'de' THEN 'ha' END AS lang, unnest([text, reference]) AS x FROM ex WHERE lang IN ('fr', 'es', 'de'))
SELECT lang, count(*) AS texts, round(avg(CAST(regexp_matches(x, '[{MARKED}{TONE_MARKS}]') AS INTEGER)), 6) AS tone_rate,
  round(avg(CAST(regexp_matches(x, '[ạẹịọụẠẸỊỌỤṣṢ]') AS INTEGER)), 6) AS underdot_rate, round(avg(CAST(regexp_matches(x, '[{HOOKED}]') AS INTEGER)), 6) AS hooked_rate FROM t GROUP BY lang""",
    "label_balance": """WITH c AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, count(*) AS n, min(doc_id) AS f FROM labels WHERE quality IS NOT NULL GROUP BY 1),
o AS (SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS total FROM c), top AS (SELECT label, n FROM c ORDER BY n DESC, f LIMIT 1), low AS (SELECT label, n FROM c ORDER BY n, f DESC LIMIT 1)
SELECT classes, total, top.label AS top_label, top.n AS top_n, low.label AS low_label, low.n AS low_n,
  CASE WHEN classes = 1 THEN 'single-class' WHEN top.n > 0.8 * total THEN 'majority' WHEN low.n < 0.1 * total THEN 'minority' END AS issue FROM o, top, low""",
    "dataset_stats": rf"""WITH {INPUTS}, c AS (SELECT 'input_words' AS field, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM ex
  UNION ALL SELECT 'reference_words', len(list_filter(string_split(reference, ' '), lambda x: x <> '')) FROM ex)
SELECT field, count(*) AS n_texts, CAST(min(n) AS INTEGER) AS min, CAST(median(n) AS DOUBLE) AS median, CAST(max(n) AS INTEGER) AS max FROM c GROUP BY field""",
    "dataset_languages": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "latest_record_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "failure_streak": """WITH e AS (SELECT *, CAST(event_type = 'error' AS INTEGER) AS f FROM events),
g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
s AS (SELECT user_id, grp, sum(f) AS n FROM g GROUP BY user_id, grp)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest, count(*) FILTER (n > 0) AS runs FROM s GROUP BY user_id""",
    "resume_pending": f"WITH {INPUTS} SELECT id FROM ex WHERE id NOT IN (SELECT id FROM base WHERE error IS NULL)",
    "run_summary": f"""WITH {INPUTS} SELECT (SELECT count(*) FROM ex) AS total, (SELECT count(*) FROM base WHERE error IS NULL) AS skipped,
  (SELECT count(*) FROM candidate WHERE error IS NULL) AS ok, (SELECT count(*) FROM candidate WHERE error IS NOT NULL) AS failed""",
    "conversation_examples": """SELECT a.conv_id, a.turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS n_messages, CAST(length(a.text) AS BIGINT) AS n_chars
FROM conversations a WHERE a.role = 'assistant'""",
    "training_plan": r"""WITH t AS (SELECT conv_id, turn, role, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM conversations),
c AS (SELECT sum(w) OVER (PARTITION BY conv_id ORDER BY turn) AS w, role FROM t), n AS (SELECT count(*) AS n, CAST(median(w) AS DOUBLE) AS m FROM c WHERE role = 'assistant')
SELECT n AS n_examples, m AS median_words, CAST(ceil(n / 16.0) AS BIGINT) AS steps_per_epoch, CAST(ceil(n / 16.0) AS BIGINT) * 3 AS total_steps FROM n""",
    "asr_windows": """WITH d AS (SELECT doc_id, n_chars * 160 AS s FROM documents WHERE n_chars > 0),
w AS (SELECT doc_id, s, unnest(range(0, CAST(greatest(ceil((s - 448000) / 416000.0), 0) AS BIGINT) + 1)) AS k FROM d)
SELECT doc_id, k AS "window", k * 416000 AS start, least(k * 416000 + 448000, s) AS "end" FROM w""",
    "alignment_errors": f"{BASE}, {WORDS} SELECT CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS reference_words FROM e WHERE view = 'tone_aware' AND n > 0",
    "label_lookup": f"""WITH d AS (SELECT doc_id, ' ' || {norm("text")} || ' ' AS p FROM documents),
l AS (SELECT unnest(['the', 'der', 'de', 'la', 'de la', 'and']) AS label),
h AS (SELECT doc_id, label, strpos(p, ' ' || label || ' ') AS pos FROM d CROSS JOIN l),
b AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY pos, length(label) DESC, label) AS k FROM h WHERE pos > 0)
SELECT d.doc_id, b.label FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1""",
    "events_per_window": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
    "compare_outcomes": f"""{BOTH_VIEWS}, x AS (SELECT 'base' AS run, * FROM vb UNION ALL SELECT 'candidate', * FROM vc),
v AS (SELECT run || ' ' || CAST(id AS VARCHAR) AS id, view, status, p, r FROM x), {WORDS.replace("e AS (", "we AS (")},
c AS (SELECT id, view, 'wer' AS metric, CASE WHEN n > 0 THEN CAST(d AS DOUBLE) / n WHEN p = '' THEN 0 ELSE 1 END AS value FROM we UNION ALL SELECT id, view, 'exact_match', CAST(p = r AS INTEGER) FROM v
  UNION ALL SELECT id, view, 'cer', value FROM ({CER})),
b AS (SELECT c.metric, c.view, b.value AS base, c.value AS candidate FROM c JOIN c b ON b.id = 'base ' || substr(c.id, 11) AND b.view = c.view AND b.metric = c.metric WHERE c.id LIKE 'candidate %')
SELECT metric, view, count(*) AS n, count(*) FILTER (candidate - base > 1e-12 ) AS wins, count(*) FILTER (abs(candidate - base) <= 1e-12) AS ties, count(*) FILTER (candidate - base < -1e-12) AS losses,
  round(avg(base), 6) AS base_mean, round(avg(candidate), 6) AS candidate_mean, round(avg(candidate - base), 6) AS delta FROM b GROUP BY metric, view""",
    "top_substitutions": f"""{BASE}, {WORDS}, o AS (SELECT unnest(b) AS ref, unnest(a) AS hyp FROM wn WHERE view = 'tone_aware' AND status = 'ok' AND len(a) = len(b) AND n > 0)
SELECT ref, hyp, count(*) AS n, {norm("ref", "strip")} = {norm("hyp", "strip")} AS tone_only FROM o WHERE ref <> hyp GROUP BY ref, hyp ORDER BY n DESC, ref, hyp LIMIT 10""",
}
