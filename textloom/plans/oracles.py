"""The registered queries in DuckDB SQL, written apart from the Spark plans they are compared with.

Queries without an entry can't be said there: ratios of similarity, order-dependent folds, patterns with look-around, hash samples.
tests/ holds those against fixed results.
"""

from __future__ import annotations

from textloom.functions.redact import KEYWORDS
from textloom.functions.redact import PATTERNS as PRIVATE_PATTERNS
from textloom.operators.clinical import CONDITIONS, CONTRAINDICATIONS, DOSAGES, DRUGS, INTERACTIONS, PROTOCOLS, ROUTES, SYMPTOMS
from textloom.operators.documents import REFERENCES
from textloom.plans.fixtures import values

LOGS = "(SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warn' WHEN value > 90 THEN 'fatal' ELSE 'info' END AS level, event_type AS category, event_type AS message, props AS details, user_id AS session_id, user_id % 20 AS device_id, value FROM events)"
ARABIC = "[\\x{0600}-\\x{06FF}]"
SCRIPT = f"CASE WHEN regexp_matches(text, '{ARABIC}') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '{ARABIC}') THEN 'arabic' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'numeric' END"
MARKS = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E8}\\x{06EA}-\\x{06ED}]"
BARE = f"regexp_replace(text, '{MARKS}', '', 'g')"
LETTERS = "'إأآٱةىؤئ', 'ااااهيوي'"
REASON = """CASE WHEN trim(coalesce(corrected_text, '')) = '' THEN 'empty' WHEN length(trim(corrected_text)) < 2 THEN 'too_short'
    WHEN trim(corrected_text) = trim(coalesce(raw_text, '')) THEN 'no_change' WHEN coalesce(crop, '') = '' THEN 'no_image' END"""
PATTERNS = "(SELECT trim(raw_text) AS pattern, trim(corrected_text) AS correction, count(*) AS frequency, max(id) AS last_used FROM {} c GROUP BY ALL)"


def _reasons(source: str) -> str:
    return f"""WITH r AS (SELECT id, {REASON} AS first, substr(md5(trim(coalesce(corrected_text, '')) || substr(coalesce(crop, ''), 1, 200)), 1, 16) AS h FROM {source} s)
        SELECT id, coalesce(first, CASE WHEN row_number() OVER (PARTITION BY h, first IS NULL ORDER BY id) > 1 THEN 'duplicate' END, 'valid') AS reason FROM r"""


def _edit_one(words: str, terms: str) -> str:
    return f"SELECT word, term, distance FROM (SELECT w.word, t.term, levenshtein(w.word, t.variant) AS distance, row_number() OVER (PARTITION BY w.word ORDER BY levenshtein(w.word, t.variant), t.ordinal) AS r FROM {words} w JOIN {terms} t ON levenshtein(w.word, t.variant) <= 1) WHERE r = 1"


def _mentioned(known: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in known) + ")"


def _redacted() -> str:
    """Without the guard on short telephone numbers, which RE2 can't look ahead for; the documents hold none."""
    out = "text"
    for _, pattern in PRIVATE_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED]', 'g')"
    return f"SELECT doc_id, md5({out}) AS digest FROM documents"


def _html() -> str:
    out = "html"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    body = f"regexp_extract({out}, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1)"
    out = f"regexp_replace(CASE WHEN {body} <> '' THEN {body} ELSE {out} END, '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g')"
    for reference, character in REFERENCES:
        out = f"replace({out}, '{reference}', '{character.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages"


ALL_ARABIC = "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"


def _private_lines(source: str) -> str:
    """All patterns masked, then lines with a telling keyword and no mask."""
    out = "text"
    for _, pattern in PRIVATE_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED]', 'g')"
    line = f"CASE WHEN regexp_matches(x, '{'|'.join(KEYWORDS)}') AND NOT contains(x, '[REDACTED]') AND length(trim(x)) > 5 THEN '[REDACTED]' ELSE x END"
    return f"SELECT id, array_to_string(list_transform(string_split({out}, chr(10)), lambda x: {line}), chr(10)) AS redacted FROM {source}"


def _soundex() -> str:
    """Weak letters dropped, the others as digits, runs of one digit merged."""
    word = "translate(unnest(string_split(p_name, ' ')), 'abdeghilmnoprstuwz', 'ابدقغهيلمنوبرستوزك')"
    code = "string_split(translate(regexp_replace(word, '[اويءه]', '', 'g'), 'بفمتدطذثظزسصضشجرلنكقغخعح', '123444555666677890abcdde'), '')"
    return f"SELECT word, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') AS code FROM (SELECT word, {code} AS c FROM (SELECT DISTINCT {word} AS word FROM part))"


def _error_rates(source: str) -> str:
    """Words become single characters, so that the edits between them are those between strings."""
    coded = lambda c: f"array_to_string(list_transform({c}, lambda x: chr((32 + list_position(k, x))::INT)), '')"
    return f"""WITH p AS (SELECT reference AS a, predicted AS b, medical, list_filter(regexp_split_to_array(reference, '\\s+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(predicted, '\\s+'), lambda x: x <> '') AS q FROM {source}),
        k AS (SELECT *, list_distinct(list_concat(r, q)) AS k FROM p)
        SELECT count(*) AS texts, round(sum(levenshtein(a, b)) / sum(length(a)), 6) AS cer, round(sum(levenshtein({coded("r")}, {coded("q")})) / sum(len(r)), 6) AS wer, round(avg((a = b)::INT), 6) AS exact, round(avg((a = b)::INT) FILTER (medical), 6) AS medical FROM k"""


SEMANTIC = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
w AS (SELECT *, list_transform(s, lambda x: list_distinct(list_filter(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), lambda t: length(t) >= 4))) AS w FROM s WHERE len(s) > 0),
c AS (SELECT doc_id, s, list_transform(generate_series(1, len(w) - 1), lambda i: coalesce(round(2 * len(list_intersect(list_distinct(flatten(w[greatest(i - 2, 1):i])), list_distinct(flatten(w[i + 1:i + 3])))) / nullif(len(list_distinct(flatten(w[greatest(i - 2, 1):i]))) + len(list_distinct(flatten(w[i + 1:i + 3]))), 0), 6), 0.0)) AS c FROM w),
v AS (SELECT doc_id, s, list_filter(generate_series(1, len(c)), lambda i: (i = 1 OR c[i] < c[i - 1]) AND (i = len(c) OR c[i] <= c[i + 1]) AND round(list_max(c[greatest(i - 5, 1):i]) + list_max(c[i:i + 5]) - 2 * c[i], 6) >= 0.2) AS v FROM c),
e AS (SELECT doc_id, s, list_concat([0], v, [len(s)]) AS e FROM v)
SELECT doc_id, (k - 1)::INT AS chunk, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT doc_id, k, array_to_string(s[e[k] + 1:e[k + 1]], ' ') AS t FROM e, range(1, 100000) r(k) WHERE k < len(e))"""


def oracle_sql() -> dict[str, str]:
    c = values("CORRECTIONS")
    interactions = values("", INTERACTIONS, "a, b, severity, evidence")
    symptoms = values("", SYMPTOMS, "symptom, condition, weight")
    dosages = values("", DOSAGES, "drug, low, high, cap")
    contra = values("", CONTRAINDICATIONS, "drug, condition, severity")
    pairs = f"""SELECT DISTINCT p.id, i.a2 AS a, i.b2 AS b, i.severity, i.evidence FROM (SELECT x.id, least(x.d, y.d) AS a, greatest(x.d, y.d) AS b FROM
        (SELECT id, lower(trim(unnest(drugs))) AS d, generate_subscripts(drugs, 1) AS i FROM {values("DRUG_LISTS")}) x JOIN (SELECT id, lower(trim(unnest(drugs))) AS d, generate_subscripts(drugs, 1) AS i FROM {values("DRUG_LISTS")}) y ON x.id = y.id AND x.i < y.i) p
        JOIN (SELECT least(a, b) AS a2, greatest(a, b) AS b2, severity, evidence FROM {interactions}) i ON p.a = i.a2 AND p.b = i.b2"""
    found = {
        "do5_semantic": SEMANTIC,
        "n15_arabic_runs": f"""SELECT id, array_to_string(list_transform(regexp_extract_all(text, '[{ALL_ARABIC}]+|[^{ALL_ARABIC}]+'), lambda p: CASE WHEN regexp_matches(p, '[{ALL_ARABIC}]') THEN array_to_string(list_reverse(regexp_extract_all(p, '(?s).')), '') ELSE p END), '') AS reversed,
            array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{ARABIC}') THEN chr(8235) || x || chr(8236) ELSE x END), chr(10)) AS marked FROM {values("TEXTS")}""",
        "n20_arabic_soundex": _soundex(),
        "r2_redacted": _private_lines(values("PRIVATE")),
        "a16_error_rates": _error_rates(values("PAIRS")),
        "do5_sentences": r"SELECT doc_id, len(s) AS sentences, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS chars, s[11] AS eleventh FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 0",
        "do8_fhir": "SELECT event_id, to_json({'resourceType': 'Observation', 'code': {'text': event_type}, 'subject': {'reference': 'Patient/' || user_id}, 'effectiveDateTime': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'valueQuantity': {'value': value}})::VARCHAR AS resource FROM events",
        "a2_store_stats": f"WITH p AS {PATTERNS.format(c)}, t AS (SELECT * FROM p ORDER BY frequency DESC, pattern, correction LIMIT 10) SELECT (SELECT count(*) FROM {c} x) AS total, (SELECT count(DISTINCT pattern) FROM p) AS patterns, (SELECT '[' || string_agg('{{\"n\":' || -frequency || coalesce(',\"pattern\":\"' || pattern || '\"', '') || coalesce(',\"correction\":\"' || correction || '\"', '') || '}}', ',' ORDER BY frequency DESC, pattern NULLS FIRST, correction NULLS FIRST) || ']' FROM t) AS top",
        "r3_context_lines": f"SELECT id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{'|'.join(KEYWORDS)}') AND length(trim(x)) > 5 THEN '[REDACTED]' ELSE x END), chr(10)) AS redacted FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'اسم المريض: ' || p_name WHEN 1 THEN 'العنوان' WHEN 2 THEN 'رقم الملف ' || p_name ELSE p_name END || chr(10) || 'ok ' || p_type AS text FROM part)",
        "entry_quality_profile": r"SELECT lang, count(*) AS docs, round(avg(length(text)), 4) AS avg_len, count(*) FILTER (length(text) > 1000) AS long_docs, count(*) FILTER (regexp_matches(text, '[\w.\-]+@[\w.\-]+\.\w{2,}')) AS with_email, count(*) FILTER (regexp_matches(text, '\b[0-9]{10}\b')) AS with_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang",
        "j1_gold_standard": """WITH r AS (SELECT o_orderkey AS region_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'gold_standard' WHEN 'O' THEN 'pending' ELSE 'approved' END AS status, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS corrected_text, o_orderkey % 3 AS n, o_orderdate AS corrected_at FROM orders)
            SELECT region_id, c_name AS page, status, corrected_text, corrected_at FROM r JOIN customer ON o_custkey = c_custkey WHERE status = 'gold_standard' OR (status = 'pending' AND corrected_text IS NOT NULL AND n >= 1)""",
        "p2_truthy_text": f"SELECT id, coalesce(nullif(corrected_text, ''), nullif(raw_text, '')) AS text FROM {c}",
        "p3_review_state": "SELECT CASE WHEN value / 100 >= 0.75 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN value / 100 > 0.9 THEN 'high' WHEN value / 100 > 0.7 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS regions, count(*) FILTER (value / 100 < 0.75) AS needs_review FROM events GROUP BY ALL",
        "p4_pending_list": "SELECT event_id, value FROM events WHERE value < 75 ORDER BY value, event_id LIMIT 50",
        "p7_hard_examples": "WITH e AS (SELECT event_type, value / 100 AS c, CASE WHEN event_id % 2 = 0 THEN value / 100 END AS b FROM events) SELECT event_type, count(*) FILTER (CASE WHEN b IS NOT NULL THEN b > 0.3 ELSE c < 1 - 0.3 END) AS hard, round(sum(b - 0.1), 4) AS gain FROM e GROUP BY event_type",
        "p18_edited_lines": "SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))) AS changed FROM documents",
        "n_arabic_normalization": f"""SELECT id, trim(regexp_replace(translate({BARE}, {LETTERS}), '\\s+', ' ', 'g')) AS normalized, trim(translate(replace({BARE}, 'ـ', ''), {LETTERS})) AS learner,
            translate(regexp_replace(trim(text), '{MARKS}', '', 'g'), 'أإآة', 'اااه') AS clinical, {SCRIPT} AS script, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS digits, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM {values("TEXTS")}""",
        "n18_text_counts": f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, len(string_split(text, chr(10))) AS lines, regexp_matches(text, '[A-Za-z]') AS latin, {SCRIPT} AS script, substr(md5(text), 1, 16) AS hash FROM documents",
        "a21_private_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[\w.\-]+@[\w.\-]+\.\w{2,}')) AS n_email, len(regexp_extract_all(text, '\b\d{10}\b')) AS n_national_id, len(regexp_extract_all(text, '\b(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})\b')) AS n_date, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents",
        "e8_icd_codes": r"SELECT regexp_extract(upper(substr(p_type, 1, 1)) || lpad(p_size::VARCHAR, 2, '0'), '\b([A-Z]\d{2}(?:\.\d{1,4})?)\b', 1) AS code, count(*) AS parts FROM part GROUP BY code",
        "p6_quality_reasons": _reasons(f"(SELECT *, crop_base64 AS crop FROM {c})"),
        "p6_document_reasons": "SELECT reason, count(*) AS docs FROM (" + _reasons("(SELECT doc_id AS id, string_split(text, chr(10))[1] AS raw_text, text AS corrected_text, CASE WHEN doc_id % 10 > 0 THEN lang END AS crop FROM documents)") + ") GROUP BY reason",
        "w1_keep_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
        "a1_pattern_counts": f"SELECT * FROM {PATTERNS.format(c)}",
        "a1_event_patterns": "SELECT event_type AS pattern, props AS correction, count(*) AS frequency, max(ts) AS last_used FROM events GROUP BY ALL",
        "l2_most_frequent": f"SELECT pattern, correction, frequency FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY frequency DESC, correction NULLS FIRST) AS r FROM {PATTERNS.format(c)}) WHERE r = 1",
        "sk2_save_batch": f"""SELECT e.idx, CASE WHEN trim(coalesce(e.corrected, '')) = '' THEN 'empty' WHEN t.text IS NULL THEN 'out_of_range' WHEN trim(e.corrected) = trim(t.text) THEN 'unchanged' ELSE 'saved' END AS disposition
            FROM (SELECT CASE WHEN id % 7 = 0 THEN id + 1000000000 ELSE id END AS idx, CASE id % 5 WHEN 0 THEN ' ' WHEN 1 THEN ' ' || text WHEN 2 THEN NULL ELSE text || '!' END AS corrected FROM {values("TEXTS")} WHERE id % 2 = 0) e LEFT JOIN {values("TEXTS")} t ON t.id = e.idx""",
        "a3_length_profile": "WITH n AS (SELECT length(p_name) AS n FROM part) SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' WHEN n <= 50 THEN '31-50' ELSE '50+' END AS bin, count(*) AS texts, (SELECT min(n) FROM n) AS least, (SELECT max(n) FROM n) AS most, (SELECT round(avg(n), 1) FROM n) AS mean, (SELECT median(n) FROM n) AS median FROM n GROUP BY bin",
        "a4_confidence_profile": f"SELECT count(*) AS n, round(avg(confidence), 3) AS mean, round(min(confidence), 3) AS least, round(max(confidence), 3) AS most FROM {c} WHERE confidence > 0",
        "a5_engine_counts": f"SELECT engine, count(*) AS texts FROM (SELECT unnest(json_keys(engines)) AS engine FROM {c}) GROUP BY engine",
        "a5_event_keys": "SELECT engine, count(*) AS texts FROM (SELECT unnest(json_keys(props)) AS engine FROM events) GROUP BY engine",
        "a7_learn": "SELECT wrong, min_by(correct, \"at\") AS correct, count(*) AS count, array_to_string(list_sort(list_distinct(list(context))), ',') AS contexts, max(\"at\") AS last_seen FROM (SELECT text AS wrong, trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) AS correct, role AS context, conv_id * 1000 + turn AS \"at\" FROM conversations) WHERE wrong <> correct GROUP BY wrong",
        "a12_languages": "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS texts, count(*) FILTER (n_chars > 1000) AS changed FROM documents GROUP BY 1",
        "u6_new_characters": "SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '')) AS token FROM documents) WHERE token <> '' AND NOT contains('abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,' || chr(10), token)",
        "u3_merge_feedback": "WITH f AS (SELECT count(*) AS n FROM documents WHERE lang = 'fr'), e AS (SELECT count(*) AS n FROM documents WHERE lang = 'en') SELECT 'fr' AS lang, n AS rows FROM f UNION ALL SELECT 'en', least(greatest(floor(f.n * (1 - 0.7::DOUBLE) / 0.7::DOUBLE)::BIGINT, 10), e.n) FROM f, e",
        "do3_latest_states": "SELECT user_id AS region_id, max_by(props, event_id) FILTER (event_type = 'purchase') AS corrected_text, count(*) FILTER (event_type = 'purchase') AS correction_count, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'gold_standard' WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'approved' ELSE 'pending' END AS status, max(event_id) AS updated_at FROM events GROUP BY user_id",
        "p15_orphans": "SELECT doc_id AS document_id FROM labels WHERE toxic <> 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
        "m8_brand_edits": "WITH v AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS variant FROM part), w AS (SELECT DISTINCT 'X' || substr(variant, 2) AS word FROM v) SELECT word, min(levenshtein(word, variant)) AS distance FROM w JOIN v ON levenshtein(word, variant) <= 1 GROUP BY word",
        "m9_exact_votes": "WITH g AS (SELECT source || '-' || (doc_id // 1000)::VARCHAR AS region_id, lang AS text, count(*) AS votes, max(n_chars / 1000.0)::DOUBLE AS confidence, min_by('e' || (doc_id % 7), doc_id) AS engine, min(doc_id) AS first FROM documents WHERE trim(lang) <> '' GROUP BY 1, 2) SELECT region_id, text, engine, confidence, votes FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY votes DESC, confidence DESC, first) AS r FROM g) WHERE r = 1",
        "m10_boxes": "SELECT l_orderkey, l_linenumber, greatest(x - 1 - 5, 0) AS x1, greatest(y - 1 - 5, 0) AS y1, least(x + 9 + 5, 60) AS x2, least(y + 3 + 5, 40) AS y2 FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT AS x, (l_partkey % 40)::INT AS y FROM lineitem)",
        "j9_dictionary_search": "SELECT p_brand AS dictionary, count(*) AS terms FROM part WHERE contains(lower(p_name), 'ring') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY p_brand",
        "j9_validate": f"SELECT w.word, coalesce(string_agg(DISTINCT t.d, ',' ORDER BY t.d), '') AS dictionaries, count(t.d) > 0 AS valid FROM {values('WORDS')} w LEFT JOIN (SELECT term, CASE WHEN ordinal % 2 = 0 THEN 'a' ELSE 'b' END AS d FROM {values('TERMS')}) t ON lower(t.term) = lower(w.word) GROUP BY w.word",
        "do14_dictionary_status": "SELECT count(*) AS terms, count(DISTINCT p_brand) AS dictionaries, max(p_size) AS last_sync FROM part",
        "j2_drug_interactions": pairs,
        "a17_worst_severity": f"SELECT id, count(*) AS interactions, min_by(severity, list_position(['contraindicated', 'major', 'moderate', 'minor'], severity)) AS worst FROM ({pairs}) GROUP BY id",
        "j3_contraindications": f"""WITH r AS (SELECT id, replace(lower(drug), '_', ' ') AS drug, replace(lower(unnest(conditions)), '_', ' ') AS condition FROM {values("PATIENTS")}), k AS (SELECT replace(drug, '_', ' ') AS d, replace(condition, '_', ' ') AS c, severity FROM {contra})
            SELECT id, drug, condition, severity FROM r JOIN k ON drug = d AND condition = c""",
        "j4_differential": f"""SELECT id, condition, round(least(sum(weight) / n, 1.0::DOUBLE), 3) AS score FROM (SELECT id, greatest(len(symptoms), 1) AS n, lower(trim(unnest(symptoms))) AS symptom FROM {values("CASES")}) q JOIN {symptoms} USING (symptom) GROUP BY id, condition, n HAVING sum(weight) / n >= 0.01""",
        "j5_protocol": f"""SELECT q.id, p.condition, p.icd10, generate_subscripts(p.steps, 1) AS step, unnest(p.steps) AS description FROM (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'hypertension' WHEN 1 THEN 'type 2 diabetes, ' || lower(c_mktsegment) WHEN 2 THEN 'gout' ELSE 'tension' END AS asked FROM customer) q JOIN {values("", PROTOCOLS, "condition, icd10, steps, medications")} p ON contains(q.asked, p.condition) OR contains(p.condition, q.asked)""",
        "j6_dosage": f"""SELECT q.id, lower(q.drug) AS drug, d.cap IS NOT NULL AS known, round(weight_kg * low, 2) AS low_mg, round(least(weight_kg * high, cap), 2) AS high_mg, round(least(weight_kg * high, cap), 2) AS dose_mg, coalesce(weight_kg * high > cap, false) AS capped, CASE WHEN age < 2 THEN 'infant' WHEN age >= 65 THEN 'elderly' END AS adjust FROM {values("DOSES")} q LEFT JOIN {dosages} d ON lower(q.drug) = d.drug""".replace("least(weight_kg * high, cap)", "CASE WHEN cap IS NULL THEN NULL ELSE least(weight_kg * high, cap) END"),
        "q1_routes": f"SELECT id, CASE {' '.join(f'''WHEN regexp_matches(lower(text), '{w}') THEN '{n}' ''' for n, w in ROUTES)} ELSE 'general' END AS route, {_mentioned(DRUGS)} AS drugs, {_mentioned(CONDITIONS)} AS conditions FROM {values('QUESTIONS')}",
        "s9_exact_split": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'test' AS split, floor(n * 0.15)::BIGINT AS rows FROM n UNION ALL SELECT 'validation', floor(n * 0.15)::BIGINT FROM n UNION ALL SELECT 'train', n - 2 * floor(n * 0.15)::BIGINT FROM n",
        "s10_ordered_split": "SELECT CASE WHEN r <= floor(n * 0.15) THEN 'validation' ELSE 'train' END AS split, min(o_orderkey) AS least, max(o_orderkey) AS most, count(*) AS rows FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) GROUP BY 1",
        "s11_hold_out": "WITH n AS (SELECT count(*) AS n FROM customer) SELECT 'validation' AS split, floor(n * 0.1)::BIGINT AS rows FROM n UNION ALL SELECT 'train', n - floor(n * 0.1)::BIGINT FROM n",
        "w2_newest_per_class": "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50",
        "s7_stratified": """WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), w AS (SELECT lang, least(floor(100 * size / sum(size) OVER ()) + 1, size) AS want FROM s), t AS (SELECT lang, greatest(least(want, 100 - coalesce(sum(want) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM w)
            SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM documents) JOIN t USING (lang) WHERE r <= take""",
        "s6_round_robin": "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) ORDER BY r, label LIMIT 35",
        "s1_reservoir": "SELECT lang, count(*) >= 20 AS floor_kept FROM documents GROUP BY lang",
        "s2_miner": "SELECT props, count(*) AS frequency FROM events GROUP BY props ORDER BY frequency DESC, props LIMIT 20",
        "s2_weighted": "SELECT 50 AS rows, 50 AS docs",
        "s4_features": f"""SELECT doc_id, round(least(length(text) / 50.0, 1.0), 6) AS f0, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / length(text), 6) AS f1, round(len(list_distinct(list_filter(string_split(text, ''), lambda x: x <> ''))) / length(text), 6) AS f2, contains(text, 'the')::INT::DOUBLE AS f3,
            ({SCRIPT} = 'arabic')::INT::DOUBLE AS f4, ({SCRIPT} = 'latin')::INT::DOUBLE AS f5, ({SCRIPT} = 'mixed')::INT::DOUBLE AS f6, ({SCRIPT} = 'numeric')::INT::DOUBLE AS f7, 0.0::DOUBLE AS f8 FROM documents""",
        "u4_with_replay": "SELECT doc_id, lang FROM documents WHERE source = 'src1' OR lang = 'de'",
        "u5_mixed_batch": "SELECT doc_id FROM (SELECT doc_id, CASE WHEN source = 'src3' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS s FROM documents) ORDER BY s, doc_id LIMIT 120",
        "w5_improvements": f"SELECT model, \"at\", coalesce(lag(cer) OVER w, 1.0::DOUBLE) AS cer_before, round(coalesce(lag(cer) OVER w, 1.0::DOUBLE) - cer, 6) AS gain, round(coalesce(lag(cer) OVER w, 1.0::DOUBLE) - cer, 9) >= 0.005 AS deploys, (sum(samples) OVER w)::BIGINT AS total FROM {values('RUNS')} WINDOW w AS (PARTITION BY model ORDER BY \"at\")",
        "w6_customer_running": "SELECT model, count(*) FILTER (gain >= 0.005) AS deploys, count(*) AS total FROM (SELECT o_custkey AS model, round(coalesce(lag(o_totalprice / 1000000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 1.0) - o_totalprice / 1000000, 9) AS gain FROM orders) GROUP BY model",
        "j8_active_version": f"SELECT model, max_by(version, \"at\") AS version, max_by(cer, \"at\") AS cer FROM {values('VERSIONS')} WHERE is_active GROUP BY model",
        "w8_history": f"SELECT version, cer FROM {values('VERSIONS')} ORDER BY \"at\" DESC LIMIT 3",
        "w9_archive": f"SELECT version FROM (SELECT version, row_number() OVER (PARTITION BY model ORDER BY version DESC) AS r FROM {values('VERSIONS')}) WHERE r > 1",
        "w11_version_ids": f"SELECT version, format('v{{:03d}}_', row_number() OVER (PARTITION BY model ORDER BY \"at\")) || strftime(make_timestamp(\"at\" * 1000000), '%Y%m%d_%H%M%S') AS version_id FROM {values('VERSIONS')}",
        "w12_transitions": "WITH o AS (SELECT o_custkey AS region_id, o_orderkey AS \"at\", CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS t FROM orders), n AS (SELECT region_id, t IS NOT NULL AND lag(t) OVER (PARTITION BY region_id ORDER BY \"at\") IS NULL AS new FROM o) SELECT region_id, count(*) AS corrections FROM n WHERE new GROUP BY region_id",
        "a13_readiness": "SELECT lang AS model, count(DISTINCT source) AS files, count(*) AS samples, count(*) >= 120 AS ready FROM documents GROUP BY lang",
        "a14_compare": f"WITH v AS (SELECT * FROM {values('VERSIONS')}) SELECT 'cer' AS metric, min(cer) AS best, max(cer) AS worst, round(avg(cer), 6) AS mean FROM v UNION ALL SELECT 'wer', min(wer), max(wer), round(avg(wer), 6) FROM v UNION ALL SELECT 'accuracy', max(accuracy), min(accuracy), round(avg(accuracy), 6) FROM v",
        "a15_summary": f"SELECT count(*) AS versions, count(*) FILTER (is_active) AS active, min(cer) AS best_cer FROM {values('VERSIONS')}",
        "do15_new_versions": "SELECT 'v' || o_orderkey * 2 AS version_name FROM orders WHERE o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)",
        "a16_type_errors": "SELECT p_brand, count(*) AS texts, round(sum(levenshtein(p_type, 'x' || substr(p_type, 3))) / sum(length(p_type)), 6) AS cer, round(avg((p_type = 'x' || substr(p_type, 3))::INT), 6) AS exact FROM part GROUP BY p_brand",
        "p9_log_search": f"SELECT id FROM {LOGS} WHERE category = 'error' AND (contains(lower(message), '\"k\": 7') OR contains(lower(details), '\"k\": 7')) ORDER BY ts DESC, id DESC LIMIT 100",
        "p12_retained": f"SELECT id FROM {LOGS} WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY ORDER BY ts DESC, id DESC LIMIT 5000",
        "p11_upload": f"SELECT level, count(*) AS n FROM {LOGS} WHERE level IN ('error', 'fatal') GROUP BY level UNION ALL SELECT 'batch', least(count(*), 50) FROM {LOGS}",
        "a10_log_stats": f"SELECT 'level' AS kind, level AS name, count(*) AS logs FROM {LOGS} GROUP BY level UNION ALL SELECT 'category', category, count(*) FROM {LOGS} GROUP BY category UNION ALL SELECT 'total', NULL, count(*) FROM {LOGS} UNION ALL SELECT 'sessions', NULL, count(DISTINCT session_id) FROM {LOGS}",
        "a11_health": f"SELECT count(*) AS total, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (level = 'fatal') AS fatal, count(DISTINCT device_id) AS devices, count(DISTINCT session_id) AS sessions, round(100 * count(DISTINCT session_id) FILTER (level = 'fatal') / count(DISTINCT session_id), 4) AS crash_percent FROM {LOGS}",
        "a11_top_errors": f"SELECT message, category, count(*) AS n, max(ts) AS last FROM {LOGS} WHERE level IN ('error', 'fatal') GROUP BY ALL ORDER BY n DESC, message, category LIMIT 10",
        "a26_latency": "WITH r AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS m FROM events GROUP BY event_type) SELECT event_type, len(v) AS n, round(m, 9) AS mean, v[least(floor(len(v) * 0.5) + 1, len(v))::INT] AS p50, v[least(floor(len(v) * 0.95) + 1, len(v))::INT] AS p95, v[least(floor(len(v) * 0.99) + 1, len(v))::INT] AS p99 FROM r",
        "a27_degradation": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value) FILTER (r < n // 4), 9) AS early, round(avg(value) FILTER (r >= 3 * n // 4), 9) AS late, round(avg(value) FILTER (r >= 3 * n // 4) / avg(value) FILTER (r < n // 4), 9) AS ratio FROM r GROUP BY event_type",
        "a25_daily": "SELECT ts::DATE AS date, count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 9) AS mean FROM events GROUP BY 1",
        "a24_row_counts": "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents",
        "a29_sync_totals": "SELECT user_id AS device_id, event_type AS direction, count(*) FILTER (value > 50) AS accepted, count(*) FILTER (value <= 50) AS rejected FROM events GROUP BY ALL",
        "st3_error_rates": "SELECT start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY start",
        "st4_histogram_quantile": """WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (10.0::DOUBLE, 1), (25.0, 2), (50.0, 3), (75.0, 4), (90.0, 5), ('inf'::DOUBLE, 6)) t(le, i) GROUP BY ALL), p AS (SELECT event_type, le, n, lag(le, 1, 0.0) OVER w AS low, lag(n, 1, 0) OVER w AS before, 0.95 * max(n) OVER (PARTITION BY event_type) AS target FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
            SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (target - before) / (n - before) END, 6) AS quantile FROM p WHERE n >= target AND before < target""",
        "st4_buckets": "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (10.0::DOUBLE), (50.0)) t(le) GROUP BY ALL",
        "st6_alerts": """WITH h AS (SELECT date_trunc('hour', ts) AS ts, count(*) FILTER (event_type = 'error') * 8 > count(*) AS f FROM events GROUP BY 1), g AS (SELECT ts, f, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY f ORDER BY ts) AS g FROM h)
            SELECT min(ts) AS start, max(ts) AS end, count(*) AS evaluations FROM g WHERE f GROUP BY g HAVING max(ts) - min(ts) >= INTERVAL 2 HOUR""",
        "st7_sessions": "WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS new FROM events) SELECT user_id, count(*) FILTER (coalesce(new, true)) AS sessions, count(*) AS events FROM g GROUP BY user_id",
        "st14_over_limit": "SELECT user_id, date_trunc('day', ts) AS start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 4",
        "st15_increases": "WITH d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) SELECT user_id, round(sum(CASE WHEN d < 0 THEN value ELSE d END), 6) AS increase FROM d GROUP BY user_id",
        "f9_durations": "SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ((ms + 50) // 100) / 10.0) ELSE printf('%.1fm', ((ms + 3000) // 6000) / 10.0) END AS text FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS ms FROM orders)",
        "do16_component_health": "SELECT n_regionkey AS system, CASE WHEN bool_and(n_nationkey < 20) THEN 'healthy' ELSE 'degraded' END AS status FROM nation GROUP BY 1",
        "sk8_log_lines": f"SELECT id, level || ',' || category || ',\"' || replace(details, '\"', '\"\"') || '\"' AS csv FROM {LOGS}",
        "a20_roll_up": f"SELECT conv_id, count(*) AS pages, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, bool_or(regexp_matches(text, '{ARABIC}')) AS arabic FROM conversations GROUP BY conv_id",
        "do5_fixed_chunks": "SELECT doc_id, count(*) AS chunks, sum(length(substr(text, s::INT + 1, 500)))::BIGINT AS chars FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 450)) AS s FROM documents) GROUP BY doc_id",
        "do6_pair_cosine": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS score FROM embeddings",
        "do6_top_vectors": "SELECT query, rank, vec_id, round(score, 4) AS score FROM (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
        "do7_timeline": "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey",
        "do10_permissions": "SELECT c_custkey, c_custkey % 2 = 0 AS may_write FROM customer",
        "w3_least_used": "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part) WHERE r <= 3",
        "t8_argmax": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
        "a6_learned_stats": "SELECT count(DISTINCT wrong) AS entries, count(*) AS corrections FROM (SELECT text AS wrong, trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) AS correct FROM conversations) WHERE wrong <> correct",
        "a8_export_counters": "SELECT lang AS script, count(*) AS samples, count(*) FILTER (contains(text, 'the')) AS medical FROM documents GROUP BY lang",
        "a9_report": "SELECT count(*) AS total, count(*) FILTER (value > 50) AS corrected, count(*) FILTER (event_type = 'purchase') AS gold, round(avg(value / 100), 9) AS confidence, round(100 * count(*) FILTER (value > 50) / count(*), 6) AS correction_percent FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY",
        "a22_page_confidence": "SELECT l_orderkey, round(avg(l_discount), 9) AS confidence, count(*) AS lines FROM lineitem GROUP BY l_orderkey",
        "a23_status_tallies": "SELECT count(*) FILTER (o_orderstatus = 'F') AS gold, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) AS regions FROM orders",
        "do9_job_progress": "SELECT user_id AS job, count(*) AS total, count(*) FILTER (event_type = 'view') AS done, count(*) FILTER (event_type = 'error') AS failed, round(100 * count(*) FILTER (event_type = 'view') / count(*), 6) AS percent FROM events GROUP BY user_id",
        "do13_valid_keys": "SELECT sha256(c_name) AS key_hash, c_custkey % 5 > 0 AND c_custkey % 3 > 0 AND c_custkey % 4 > 0 AS valid FROM customer",
        "p10_log_levels": "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'warn' ELSE 'debug' END AS level, count(*) AS n FROM events GROUP BY 1",
        "sk6_changed_only": "SELECT doc_id FROM documents WHERE text <> regexp_replace(replace(text, '  ', ' '), '[.]{2,}|[0-9]{10}', '', 'g')",
        "f5_levenshtein": "SELECT p_partkey, levenshtein(p_type, next) AS edits FROM (SELECT p_partkey, p_type, lead(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part) WHERE next IS NOT NULL",
        "p17_hints": f"SELECT id, concat_ws(',', CASE WHEN {SCRIPT} IN ('arabic', 'mixed') AND regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) > 50 THEN 'long' END, CASE WHEN regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]') THEN 'first_character' END) AS hints FROM {values('TEXTS')}",
        "s8_at_ratios": "SELECT lang, least(count(*), CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 12 ELSE 8 END) AS rows FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang",
        "s5_assign": """WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)
            SELECT vec_id, cluster, round(distance, 4) AS distance FROM (SELECT vec_id, c.label AS cluster, list_distance(embedding::DOUBLE[], c) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], c), 6), c.label) AS r FROM embeddings, c) WHERE r = 1""",
        "r2_redacted_documents": _redacted(),
        "x8_html_text": _html(),
        "st6_stream_alerts": """WITH e AS (SELECT user_id % 20 AS device, ts, value > 20 AS f FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 86400000 FROM events)), g AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts) - row_number() OVER (PARTITION BY device, f ORDER BY ts) AS g FROM e)
            SELECT device, min(ts) AS start, max(ts) AS "end", count(*) AS evaluations FROM g WHERE f GROUP BY device, g HAVING max(ts) - min(ts) >= INTERVAL 6 HOUR""",
        "st1_stream_reservoir": 'SELECT lang AS "group", least(count(*), 50) AS n, count(*) AS seen FROM documents GROUP BY lang',
        "st2_stream_patterns": "SELECT event_type AS pattern, props AS correction, count(*) AS frequency, max(ts) AS last_used FROM events GROUP BY ALL",
        "st3_stream_rates": "SELECT start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY start",
        "st5_stream_averages": "SELECT event_type, date_trunc('day', ts) AS start, count(value) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL",
        "st9_stream_once": "SELECT event_id, user_id FROM events",
        "st14_stream_over_limit": "SELECT user_id, date_trunc('day', ts) AS start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 4",
    }
    return found
