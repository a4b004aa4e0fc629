"""DuckDB oracles of the queries: independent SQL over the same tables."""

from __future__ import annotations

NS = r"[^\s\x0b\x1c-\x1f\x{85}\pZ]"
SP = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{0900}-\x{0dff}]"


def n_words(text: str) -> str:
    return f"(len(regexp_extract_all({text}, '{CJK}')) + len(regexp_extract_all(regexp_replace({text}, '{CJK}', ' ', 'g'), '{NS}+')))::INTEGER"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SP}+|{SP}+$', '', 'g')"


def stamp(ms: str) -> str:
    m = f"greatest(0, {ms})"
    return f"printf('%02d:%02d:%02d,%03d', {m} // 3600000, ({m} // 60000) % 60, ({m} // 1000) % 60, {m} % 1000)"


def vtt(ms: str) -> str:
    return f"trunc(({ms}) // 3600000 * 3600000.0::DOUBLE + ({ms}) // 60000 % 60 * 60000.0::DOUBLE + (({ms}) % 60000 / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT"


WORDS = f"""
toks AS (SELECT doc_id, regexp_extract_all(text, '{NS}+') AS t FROM documents),
words AS (SELECT doc_id, unnest(range(0, len(t)))::INTEGER AS ord, unnest(t) AS text FROM toks)"""
SENTENCES = f"""{WORDS},
ended AS (SELECT *, ord * 300::BIGINT AS start_ms, ord * 300::BIGINT + 250 AS end_ms, regexp_matches(text, '[?!.？！。]+$') AS fin FROM words),
placed AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS sentence_index FROM ended),
sentences AS (SELECT doc_id, sentence_index, string_agg(text, ' ' ORDER BY ord) AS text, count(*)::INTEGER AS n_words, min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms FROM placed GROUP BY ALL)"""
LINES = f"""{SENTENCES},
inside AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY ord) - 1 AS k FROM placed),
cut AS (SELECT doc_id, sentence_index, (k // 8)::INTEGER AS split_index, string_agg(text, ' ' ORDER BY ord) AS text, min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms FROM inside GROUP BY ALL),
lines AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index, split_index) - 1)::INTEGER AS line_index FROM cut)"""
TOKENS = f"""{WORDS},
normed AS (SELECT doc_id, ord, text AS raw, nullif(regexp_extract(lower(text), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)*'), '') AS norm FROM words),
tokens AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INTEGER AS i, raw, norm, ord * 300 / 1000.0::DOUBLE AS start, (ord * 300 + 250) / 1000.0::DOUBLE AS "end" FROM normed WHERE norm IS NOT NULL)"""
RUNS = f"""{TOKENS},
periods AS (SELECT unnest([1, 2, 3, 4]) AS p),
shifted AS (SELECT *, lead(norm, 1) OVER w AS n1, lead(norm, 2) OVER w AS n2, lead(norm, 3) OVER w AS n3, lead(norm, 4) OVER w AS n4 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
same AS (SELECT doc_id, p, i FROM shifted, periods WHERE norm = CASE p WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END),
islands AS (SELECT doc_id, p, min(i) AS st, count(*)::INTEGER AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same) GROUP BY doc_id, p, g),
listed AS (SELECT doc_id, p, list({{'st': st, 'len': len}} ORDER BY st) AS isl FROM islands GROUP BY doc_id, p),
folded AS (
  SELECT doc_id, p, list_reduce(isl, lambda acc, x:
    CASE WHEN x.st + x.len > acc.prev AND (x.st + x.len - greatest(x.st, acc.prev)) // p + 1 >= CASE WHEN p = 1 THEN 5 ELSE 4 END
    THEN {{'prev': (greatest(x.st, acc.prev) + p * ((x.st + x.len - greatest(x.st, acc.prev)) // p + 1))::INTEGER,
          'hits': list_append(acc.hits, {{'st': greatest(x.st, acc.prev)::INTEGER, 'k': ((x.st + x.len - greatest(x.st, acc.prev)) // p + 1)::INTEGER}}), 'st': 0, 'len': 0}}
    ELSE acc END, {{'prev': 0::INTEGER, 'hits': []::STRUCT(st INTEGER, k INTEGER)[], 'st': 0, 'len': 0}}) AS f
  FROM (SELECT doc_id, p, list_transform(isl, lambda y: {{'prev': 0::INTEGER, 'hits': []::STRUCT(st INTEGER, k INTEGER)[], 'st': y.st, 'len': y.len}}) AS isl FROM listed)),
runs AS (SELECT doc_id, 0 AS segment_index, p AS phrase_len, h.st AS start_token, h.st + p * h.k AS end_token, h.k AS repeat_count FROM (SELECT doc_id, p, unnest(f.hits) AS h FROM folded))"""
CHOSEN = f"""{RUNS},
ranked AS (SELECT doc_id, list({{'st': start_token, 'en': end_token, 'p': phrase_len, 'k': repeat_count}} ORDER BY end_token - start_token DESC, phrase_len DESC, repeat_count DESC, start_token) AS h FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, list_reduce(list_transform(h, lambda y: [y]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda y: y.en > x[1].st AND x[1].en > y.st)) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS h FROM ranked),
chosen AS (SELECT doc_id, 0 AS segment_index, x.p AS phrase_len, x.st AS start_token, x.en AS end_token, x.k AS repeat_count FROM (SELECT doc_id, unnest(h) AS x FROM kept))"""
DESCRIBED = f"""{CHOSEN},
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
around AS (
  SELECT c.*, s.n, t.i, t.raw, t.norm, t.start, t."end" FROM chosen c JOIN sizes s USING (doc_id) JOIN tokens t ON t.doc_id = c.doc_id AND t.i >= c.start_token - 6 AND t.i < c.end_token + 6),
described AS (
  SELECT doc_id, segment_index, phrase_len, start_token, end_token, repeat_count,
    string_agg(norm, ' ' ORDER BY i) FILTER (WHERE i >= start_token AND i < start_token + phrase_len) AS phrase,
    end_token - start_token AS token_count, max(start) FILTER (WHERE i = start_token) AS start, max("end") FILTER (WHERE i = end_token - 1) AS "end",
    (CASE WHEN start_token > 6 THEN '... ' ELSE '' END) || string_agg(raw, ' ' ORDER BY i) || (CASE WHEN end_token + 6 < n THEN ' ...' ELSE '' END) AS text_excerpt
  FROM around GROUP BY doc_id, segment_index, phrase_len, start_token, end_token, repeat_count, n)"""
SRT = f"""{LINES},
srts AS (SELECT doc_id, string_agg((line_index + 1) || chr(10) || {stamp('start_ms')} || ' --> ' || {stamp('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY line_index) || chr(10) AS srt FROM lines GROUP BY doc_id)"""
USER_BATCHES = """
cues AS (SELECT user_id AS doc_id, event_id AS cue_ord, CASE WHEN value > 10 THEN event_type END AS text, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1000 AS end_ms FROM events),
batches AS (SELECT doc_id, (cue_ord // 500)::INTEGER AS batch_id, min(start_ms)::BIGINT AS start_ms, min(end_ms)::BIGINT AS end_ms FROM cues GROUP BY ALL)"""
KEY_SETS = """
sets AS (SELECT conv_id, list_sort(list_distinct(list(turn::VARCHAR))) AS expected, list_sort(list_distinct(list(CASE WHEN role = 'user' THEN turn + 1 ELSE turn END::VARCHAR))) AS actual FROM conversations GROUP BY conv_id),
diff AS (SELECT conv_id, expected, actual, list_sort(list_filter(expected, lambda x: NOT list_contains(actual, x))) AS missing, list_sort(list_filter(actual, lambda x: NOT list_contains(expected, x))) AS extra FROM sets)"""
CACHE = """
entries AS (SELECT user_id::VARCHAR AS cache_key, event_id::VARCHAR AS value, ts AS created_at, ts + INTERVAL 2 DAY AS expires_at FROM events),
alive AS (SELECT * FROM entries WHERE expires_at > TIMESTAMP '2024-01-31 06:00:00'),
requests AS (SELECT DISTINCT unnest([user_id::VARCHAR, 'new-' || user_id]) AS cache_key FROM events)"""

#: Turns of numbered words ``w`` (``n`` of them), an edit after the first ``at``, and the words that stay on both sides.
EDITED = f"""
numbered AS (SELECT conv_id, turn, turn % 4 AS kind, list_transform(regexp_extract_all(text, '{NS}+'), lambda x, i: x || '#' || (i - 1)) AS w FROM conversations),
edited AS (
  SELECT *, len(w) AS n, len(w) // 2 AS mid, len(w) > 0 AND kind IN (1, 3) AS gone, kind IN (1, 2) AS fresh,
         w[1:len(w) // 2] AS a, CASE WHEN kind IN (1, 3) THEN w[len(w) // 2 + 2:] ELSE w[len(w) // 2 + 1:] END AS z FROM numbered),
spans AS (SELECT *, len(a) AS p, len(z) AS r, mid + gone::INT AS q, mid + fresh::INT AS v FROM edited)"""
RATIO = "CASE WHEN kind = 0 THEN 1.0 ELSE 2.0 * (p + r) / (n + p + r + fresh::INT) END::DOUBLE"
CAPTIONS = f"""{SENTENCES},
profiles AS (SELECT doc_id, CASE WHEN sum(len(regexp_extract_all(text, '{CJK}'))) / sum(length(regexp_replace(text, '{SP}', '', 'g'))) > 0.5 THEN 16 ELSE 18 END AS most FROM sentences GROUP BY doc_id),
sized AS (SELECT doc_id, sentence_index, CASE WHEN {n_words('text')} > most THEN 12 ELSE 1000000000 END AS step FROM sentences JOIN profiles USING (doc_id)),
inside AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY ord) - 1 AS k FROM placed JOIN sized USING (doc_id, sentence_index)),
cut AS (SELECT doc_id, sentence_index, (k // step)::INTEGER AS split_index, string_agg(text, ' ' ORDER BY ord) AS text, min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms FROM inside GROUP BY ALL),
lines AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index, split_index) - 1)::INTEGER AS line_index FROM cut)"""
TURNS = f"""
turns AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n, regexp_extract_all(text, '{NS}+') AS w FROM conversations)"""

#: Expected codes, written out: the engine's table is not read here.
CODES = """
  ('SIMPLIFIED_CHINESE', 'google', 'zh-CN'), ('SIMPLIFIED_CHINESE', 'bing', 'zh-Hans'), ('SIMPLIFIED_CHINESE', 'deeplx', 'zh-Hans'), ('TRADITIONAL_CHINESE', 'google', 'zh-TW'), ('TRADITIONAL_CHINESE', 'bing', 'zh-Hant'), ('TRADITIONAL_CHINESE', 'deeplx', 'zh-Hant'),
  ('ENGLISH', 'google', 'en'), ('ENGLISH', 'bing', 'en'), ('ENGLISH', 'deeplx', 'en'), ('ENGLISH_US', 'google', 'en'), ('ENGLISH_US', 'bing', 'en'), ('ENGLISH_US', 'deeplx', 'en-US'),
  ('ENGLISH_UK', 'google', 'en'), ('ENGLISH_UK', 'bing', 'en'), ('ENGLISH_UK', 'deeplx', 'en-GB'), ('JAPANESE', 'google', 'ja'), ('JAPANESE', 'bing', 'ja'), ('JAPANESE', 'deeplx', 'ja'),
  ('KOREAN', 'google', 'ko'), ('KOREAN', 'bing', 'ko'), ('KOREAN', 'deeplx', 'ko'), ('CANTONESE', 'google', 'yue'), ('CANTONESE', 'bing', 'yue'), ('THAI', 'google', 'th'),
  ('THAI', 'bing', 'th'), ('VIETNAMESE', 'google', 'vi'), ('VIETNAMESE', 'bing', 'vi'), ('INDONESIAN', 'google', 'id'), ('INDONESIAN', 'bing', 'id'), ('INDONESIAN', 'deeplx', 'id'),
  ('MALAY', 'google', 'ms'), ('MALAY', 'bing', 'ms'), ('TAGALOG', 'google', 'tl'), ('TAGALOG', 'bing', 'fil'), ('FRENCH', 'google', 'fr'), ('FRENCH', 'bing', 'fr'),
  ('FRENCH', 'deeplx', 'fr'), ('GERMAN', 'google', 'de'), ('GERMAN', 'bing', 'de'), ('GERMAN', 'deeplx', 'de'), ('SPANISH', 'google', 'es'), ('SPANISH', 'bing', 'es'),
  ('SPANISH', 'deeplx', 'es'), ('SPANISH_LATAM', 'google', 'es'), ('SPANISH_LATAM', 'bing', 'es'), ('RUSSIAN', 'google', 'ru'), ('RUSSIAN', 'bing', 'ru'), ('RUSSIAN', 'deeplx', 'ru'),
  ('PORTUGUESE', 'google', 'pt'), ('PORTUGUESE', 'bing', 'pt'), ('PORTUGUESE', 'deeplx', 'pt'), ('PORTUGUESE_BR', 'google', 'pt'), ('PORTUGUESE_BR', 'bing', 'pt'), ('PORTUGUESE_BR', 'deeplx', 'pt-BR'),
  ('PORTUGUESE_PT', 'google', 'pt'), ('PORTUGUESE_PT', 'bing', 'pt-PT'), ('PORTUGUESE_PT', 'deeplx', 'pt-PT'), ('ITALIAN', 'google', 'it'), ('ITALIAN', 'bing', 'it'), ('ITALIAN', 'deeplx', 'it'),
  ('DUTCH', 'google', 'nl'), ('DUTCH', 'bing', 'nl'), ('DUTCH', 'deeplx', 'nl'), ('POLISH', 'google', 'pl'), ('POLISH', 'bing', 'pl'), ('POLISH', 'deeplx', 'pl'),
  ('TURKISH', 'google', 'tr'), ('TURKISH', 'bing', 'tr'), ('TURKISH', 'deeplx', 'tr'), ('GREEK', 'google', 'el'), ('GREEK', 'bing', 'el'), ('GREEK', 'deeplx', 'el'),
  ('CZECH', 'google', 'cs'), ('CZECH', 'bing', 'cs'), ('CZECH', 'deeplx', 'cs'), ('SWEDISH', 'google', 'sv'), ('SWEDISH', 'bing', 'sv'), ('SWEDISH', 'deeplx', 'sv'),
  ('DANISH', 'google', 'da'), ('DANISH', 'bing', 'da'), ('DANISH', 'deeplx', 'da'), ('FINNISH', 'google', 'fi'), ('FINNISH', 'bing', 'fi'), ('FINNISH', 'deeplx', 'fi'),
  ('NORWEGIAN', 'google', 'no'), ('NORWEGIAN', 'bing', 'nb'), ('NORWEGIAN', 'deeplx', 'nb'), ('HUNGARIAN', 'google', 'hu'), ('HUNGARIAN', 'bing', 'hu'), ('HUNGARIAN', 'deeplx', 'hu'),
  ('ROMANIAN', 'google', 'ro'), ('ROMANIAN', 'bing', 'ro'), ('ROMANIAN', 'deeplx', 'ro'), ('BULGARIAN', 'google', 'bg'), ('BULGARIAN', 'bing', 'bg'), ('BULGARIAN', 'deeplx', 'bg'),
  ('UKRAINIAN', 'google', 'uk'), ('UKRAINIAN', 'bing', 'uk'), ('UKRAINIAN', 'deeplx', 'uk'), ('ARABIC', 'google', 'ar'), ('ARABIC', 'bing', 'ar'), ('ARABIC', 'deeplx', 'ar'),
  ('HEBREW', 'google', 'he'), ('HEBREW', 'bing', 'he'), ('PERSIAN', 'google', 'fa'), ('PERSIAN', 'bing', 'fa')"""

RECORDING = """
cues AS (SELECT event_id, event_type || CASE WHEN value > 15 THEN '.' ELSE '' END AS text, (epoch_us(ts) // 1000)::BIGINT AS start_ms, (epoch_us(ts) // 1000 + 900)::BIGINT AS end_ms FROM events),
words AS (SELECT *, (row_number() OVER (ORDER BY start_ms, end_ms, event_id) - 1)::INTEGER AS ord FROM cues),
placed AS (SELECT *, coalesce(sum(text LIKE '%.') OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS sentence_index FROM words),
inside AS (SELECT *, row_number() OVER (PARTITION BY sentence_index ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY sentence_index) AS n FROM placed)"""
ORACLES: dict[str, str] = {
    "language_codes": f"""
WITH d(language, service, code) AS (VALUES {CODES}),
langs AS (SELECT lang AS code, count(*) AS n_docs FROM documents GROUP BY lang),
asked AS (SELECT d.language, l.n_docs, s.service FROM langs l JOIN d ON d.service = 'google' AND d.code = l.code, (VALUES ('google'), ('bing'), ('deeplx'), ('other')) s(service))
SELECT a.language, a.n_docs, a.service, coalesce(d.code, f.code, 'zh-CN') AS code FROM asked a LEFT JOIN d USING (language, service)
LEFT JOIN d f ON f.service = a.service AND f.language = 'SIMPLIFIED_CHINESE'""",
    "word_stream": f"WITH {WORDS} SELECT doc_id, ord, text, ord * 300::BIGINT AS start_ms, ord * 300::BIGINT + 250 AS end_ms FROM words",
    "ordered_segments": """
WITH e AS (SELECT user_id AS doc_id, event_id AS src, value, epoch_us(ts) // 1000 AS ms FROM events),
c AS (SELECT doc_id, src, ms - ms % 60000 AS start_ms, ms - ms % 1000 AS end_ms FROM e WHERE value > 20)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, src) - 1)::INTEGER AS ord, src, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms FROM c""",
    "recording_lines": f"""
WITH {RECORDING},
lines AS (SELECT sentence_index, (k // 4)::INTEGER AS split_index, string_agg(text, ' ' ORDER BY ord) AS text, min_by(start_ms, ord) AS start_ms, max_by(end_ms, ord) AS end_ms FROM inside GROUP BY sentence_index, k // 4)
SELECT *, (row_number() OVER (ORDER BY sentence_index, split_index) - 1)::INTEGER AS line_index, ((dense_rank() OVER (ORDER BY sentence_index) - 1) // 20)::INTEGER AS batch_id FROM lines""",
    "recording_batches": f"""
WITH {RECORDING},
long AS (SELECT sentence_index, string_agg(text, ' ' ORDER BY ord) AS text, min_by(start_ms, ord) AS start_ms, max_by(end_ms, ord) AS end_ms FROM inside WHERE n > 4 GROUP BY sentence_index),
numbered AS (SELECT *, ((row_number() OVER (ORDER BY sentence_index) - 1) // 20)::INTEGER AS batch_id FROM long)
SELECT batch_id, min_by(start_ms, sentence_index) AS start_ms, max_by(end_ms, sentence_index) AS end_ms, count(*)::INTEGER AS n_sentences, md5(string_agg(text, chr(10) ORDER BY sentence_index)) AS texts_md5
FROM numbered GROUP BY batch_id""",
    "recording_words": f"WITH {RECORDING} SELECT ord, text, start_ms, end_ms FROM words",
    "merged_status": """
WITH cut AS (SELECT conv_id, coalesce(max(turn) FILTER (WHERE turn % 7 = 5), -1) AS since FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS h FROM conversations JOIN cut USING (conv_id) WHERE turn >= since)
SELECT conv_id, max(turn)::BIGINT AS turn, arg_max(h, turn) FILTER (WHERE role = 'user') AS user_md5, arg_max(h, turn) FILTER (WHERE role = 'assistant') AS assistant_md5,
       count(DISTINCT turn)::INTEGER AS n_seen, count(*)::INTEGER AS n_updates FROM c GROUP BY conv_id""",
    "sentence_groups": f"WITH {SENTENCES} SELECT * FROM sentences",
    "regrouped_words": f"WITH {WORDS} SELECT doc_id, count(*) AS n_words, max(ord)::BIGINT AS last_ord, sum(ord * 300::BIGINT)::BIGINT AS start_sum FROM words GROUP BY doc_id",
    "long_sentences": f"WITH {SENTENCES} SELECT doc_id, sentence_index, {n_words('text')} AS n_words FROM sentences WHERE {n_words('text')} > 18",
    "sentence_batches": f"""
WITH {SENTENCES}, b AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) - 1) // 20)::INTEGER AS batch_id FROM sentences)
SELECT doc_id, batch_id, min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms, count(*)::INTEGER AS n_sentences,
       string_agg(sentence_index::VARCHAR, ',' ORDER BY sentence_index) AS keys, md5(string_agg(text, chr(10) ORDER BY sentence_index)) AS texts_md5 FROM b GROUP BY doc_id, batch_id""",
    "split_request_batches": f"WITH {SENTENCES} SELECT doc_id, sentence_index, ((row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) - 1) // 20)::INTEGER AS batch_id FROM sentences WHERE {n_words('text')} > 18",
    "line_numbers": f"WITH {LINES} SELECT doc_id, sentence_index, split_index, line_index, text, start_ms, end_ms FROM lines",
    "line_batches": f"""
WITH {LINES}, b AS (SELECT *, ((dense_rank() OVER (PARTITION BY doc_id ORDER BY sentence_index) - 1) // 20)::INTEGER AS batch_id FROM lines)
SELECT doc_id, batch_id, count(*) AS n_lines, count(DISTINCT sentence_index) AS n_sentences FROM b GROUP BY doc_id, batch_id""",
    "count_words": f"SELECT doc_id, {n_words('text')} AS n_words FROM documents",
    "script_ratio": f"""
WITH s AS (SELECT doc_id, sum(len(regexp_extract_all(text, '{CJK}')))::BIGINT AS no_space_chars, sum(length(regexp_replace(text, '{SP}', '', 'g')))::BIGINT AS visible_chars FROM documents GROUP BY doc_id)
SELECT *, CASE WHEN visible_chars > 0 THEN no_space_chars / visible_chars > 0.5 ELSE false END AS mainly_cjk,
       CASE WHEN visible_chars > 0 AND no_space_chars / visible_chars > 0.5 THEN 16 ELSE 18 END AS max_word_count FROM s""",
    "script_flags": rf"""
WITH {WORDS}, w AS (SELECT DISTINCT text FROM words)
SELECT text, regexp_matches(text, '^[a-zA-Z0-9''\x{{0400}}-\x{{04ff}}\x{{0370}}-\x{{03ff}}\x{{0600}}-\x{{06ff}}\x{{0590}}-\x{{05ff}}\x{{0e00}}-\x{{0e7f}}]+$') AS space_separated,
       NOT regexp_matches(text, '[\pL\pN_]') AS pure_punctuation, len(regexp_extract_all(text, '{CJK}')) / length(text) > 0.5 AS mainly_cjk, regexp_matches(text, '[?!.？！。]+$') AS ends_sentence FROM w""",
    "token_bases": rf"WITH {WORDS} SELECT lower(regexp_replace(text, '^[^\pL\pN_]+|[^\pL\pN_]+$', '', 'g')) AS base, count(*) AS n FROM words GROUP BY 1",
    "normalized_tokens": f"WITH {TOKENS} SELECT norm, count(*) AS n FROM normed GROUP BY norm",
    "token_parts": rf"""
WITH {WORDS}, w AS (SELECT DISTINCT text AS original FROM words)
SELECT original, regexp_replace(original, '[^\pL\pN_]+$', '') AS base, regexp_extract(original, '[^\pL\pN_]+$') AS trailing_punctuation FROM w""",
    "compact_lines": f"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '{NS}+'), ' ') AS text, len(regexp_extract_all(text, '{NS}+'))::INTEGER AS n_tokens FROM conversations",
    "safe_names": rf"""
WITH t AS (SELECT url AS title FROM pages UNION SELECT ' .. ' || p_name || '?* / ' || chr(9) || ' x. ' FROM part)
SELECT title, trim(array_to_string(regexp_extract_all(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '{NS}+'), ' '), ' .') AS name FROM t""",
    "timestamps": f"""
WITH e AS (SELECT event_id, value, (event_id * 7919 - 5000)::BIGINT AS ms FROM events)
SELECT event_id, {stamp('ms')} AS srt, trunc(value * 1000)::BIGINT AS truncated, greatest(0, round_even(value * 1000, 0))::BIGINT AS rounded,
       CASE WHEN event_id % 5 > 0 THEN printf('%.3fs', value) ELSE '?' END AS report, {vtt('greatest(0, ms)')} AS vtt_ms FROM e""",
    "shanghai_times": "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "even_time_split": """
WITH e AS (SELECT event_id, event_id AS a, event_id * 3 - 7000 AS b, (event_id % 7)::INTEGER AS n FROM events),
x AS (SELECT *, unnest(range(0, n)) AS i FROM e WHERE n > 0)
SELECT event_id, i::INTEGER AS i, (a + floor(((b - a) * i)::DOUBLE / n))::BIGINT AS start_ms, (a + floor(((b - a) * (i + 1))::DOUBLE / n))::BIGINT AS end_ms FROM x""",
    "repeat_word_runs": f"WITH {RUNS} SELECT doc_id, segment_index, phrase_len, start_token, end_token, repeat_count FROM runs WHERE phrase_len = 1",
    "repeat_phrase_runs": f"WITH {RUNS} SELECT * FROM runs",
    "repeat_hits": f"WITH {CHOSEN} SELECT * FROM chosen",
    "described_hits": f"WITH {DESCRIBED} SELECT * FROM described",
    "scan_summary": f"""
WITH {CHOSEN}, t AS (SELECT doc_id, count(*) AS total_tokens FROM tokens GROUP BY doc_id),
h AS (SELECT doc_id, count(DISTINCT segment_index) AS flagged_segments, count(*) AS total_hits, sum(end_token - start_token)::BIGINT AS flagged_tokens FROM chosen GROUP BY doc_id)
SELECT d.doc_id, 1::BIGINT AS total_segments, coalesce(total_tokens, 0) AS total_tokens, coalesce(flagged_segments, 0) AS flagged_segments, coalesce(total_hits, 0) AS total_hits,
       coalesce(flagged_tokens, 0) AS flagged_tokens, CASE WHEN total_tokens > 0 THEN coalesce(flagged_tokens, 0) / total_tokens ELSE 0.0 END::DOUBLE AS flagged_token_ratio, coalesce(total_hits, 0) > 0 AS has_repeats
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN h USING (doc_id)""",
    "top_phrases": f"""
WITH {DESCRIBED}, s AS (SELECT *, row_number() OVER (ORDER BY doc_id, segment_index, start_token, end_token, phrase_len) AS o FROM described)
SELECT phrase, count(*) AS count FROM s GROUP BY phrase ORDER BY count(*) DESC, min(o) LIMIT 10""",
    "top_hits": f"""
WITH {DESCRIBED} SELECT doc_id, segment_index, phrase, repeat_count, token_count, coalesce(printf('%.3fs', start), '?') AS from_time, coalesce(printf('%.3fs', "end"), '?') AS to_time, text_excerpt
FROM described ORDER BY token_count DESC, phrase_len DESC, repeat_count DESC, doc_id, segment_index, start_token LIMIT 30""",
    "hit_records": f"""
WITH {DESCRIBED} SELECT doc_id, start_token, '{{"segment_index":' || segment_index || ',"phrase":"' || phrase || '","phrase_len":' || phrase_len || ',"repeat_count":' || repeat_count || ',"token_count":' || token_count || '}}' AS record FROM described""",
    "reference_context": f"""
WITH {USER_BATCHES} SELECT b.doc_id, b.batch_id, b.start_ms, b.end_ms, coalesce(string_agg(c.text, ' ' ORDER BY c.cue_ord), '') AS reference_text
FROM batches b LEFT JOIN cues c ON c.doc_id = b.doc_id AND c.text IS NOT NULL AND c.start_ms <= b.end_ms + 3600000 AND c.end_ms >= b.start_ms - 3600000 GROUP BY ALL""",
    "lookup_defaults": "SELECT doc_id, lang, coalesce(q, -1)::INTEGER AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)",
    "write_back": "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '* ' || text ELSE text END AS text FROM conversations",
    "split_parts": f"""
WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(' <br>' || replace(text, ' ', '<br> ') || '<br>', '<br>'), lambda x: {strip('x')}), lambda x: x <> '') AS parts FROM conversations)
SELECT conv_id, turn, len(parts)::INTEGER AS n_parts, coalesce(array_to_string(parts, ' '), '') AS joined FROM p""",
    "length_violations": f"""
WITH {LINES} SELECT doc_id, sentence_index, 'text ' || sentence_index || ': more than 7 words in part ' || string_agg((split_index + 1) || ' (' || {n_words('text')} || ')', ', ' ORDER BY split_index) AS violations
FROM lines WHERE {n_words('text')} > 7 GROUP BY doc_id, sentence_index""",
    "key_diff": f"WITH {KEY_SETS} SELECT conv_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, expected = actual AS same FROM diff",
    "key_messages": f"""
WITH {KEY_SETS} SELECT conv_id, nullif(concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'Missing keys [''' || array_to_string(missing, ''', ''') || ''']' END,
       CASE WHEN len(extra) > 0 THEN 'Extra keys [''' || array_to_string(extra, ''', ''') || ''']' END), '') AS message FROM diff""",
    "fail_rate_gate": """
WITH c AS (SELECT conv_id AS doc_id, length(text)::BIGINT AS n, turn % 3 = 1 AS failed FROM conversations),
s AS (SELECT doc_id, sum(CASE WHEN failed THEN n ELSE 0 END)::BIGINT AS failed_lines, sum(n)::BIGINT AS total_lines FROM c GROUP BY doc_id)
SELECT *, CASE WHEN total_lines > 0 THEN failed_lines / total_lines ELSE 0.0 END::DOUBLE AS fail_rate,
       CASE WHEN failed_lines > 0 AND failed_lines / total_lines >= 0.5 THEN 'fail' WHEN failed_lines > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM s""",
    "cache_hits": f"WITH {CACHE} SELECT cache_key, max_by(value, (created_at, expires_at, value)) AS value FROM requests JOIN alive USING (cache_key) GROUP BY cache_key",
    "cache_misses": f"WITH {CACHE} SELECT cache_key FROM requests WHERE cache_key NOT IN (SELECT cache_key FROM alive)",
    "cache_keys": """SELECT conv_id, turn, sha256('{"p0":"' || conv_id || '","p1":"' || turn || '"}') AS cache_key FROM conversations""",
    "srt_render": f"WITH {SRT} SELECT doc_id, length(srt)::INTEGER AS n_chars, md5(srt) AS srt_md5 FROM srts",
    "srt_translated": f"""
WITH {LINES} SELECT doc_id, md5(coalesce(string_agg((line_index + 1) || chr(10) || {stamp('start_ms')} || ' --> ' || {stamp('end_ms')} || chr(10) || '* ' || text, chr(10) || chr(10) ORDER BY line_index)
  FILTER (WHERE line_index % 3 <> 0) || chr(10), '')) AS srt_md5 FROM lines GROUP BY doc_id""",
    "srt_roundtrip": f"WITH {LINES} SELECT doc_id, line_index AS ord, text, start_ms, end_ms FROM lines",
    "segment_srt_entries": """
WITH s AS (SELECT user_id AS doc_id, event_id AS ord, event_type AS text, (event_id - 50) / 16000.0::DOUBLE AS a, (event_id + 8) / 16000.0::DOUBLE AS b FROM events WHERE event_id % 4 <> 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INTEGER AS number, greatest(0, round_even(a * 1000, 0))::BIGINT AS start_ms, greatest(0, round_even(b * 1000, 0))::BIGINT AS end_ms, text FROM s""",
    "sentence_report": f"""
WITH {SENTENCES} SELECT doc_id, md5(string_agg(sentence_index || '. ' || CASE WHEN sentence_index % 5 = 1 THEN 'log' WHEN sentence_index % 2 = 1 THEN '* ' || text ELSE text END, chr(10) ORDER BY sentence_index)) AS report_md5
FROM sentences GROUP BY doc_id""",
    "line_report": f"""
WITH {LINES}, g AS (
  SELECT doc_id, sentence_index, CASE WHEN count(*) = 1 THEN sentence_index || '. ' || any_value(text)
    ELSE sentence_index || '. ' || chr(10) || string_agg('【' || {n_words('text')} || '】' || text, chr(10) ORDER BY line_index) END AS part FROM lines GROUP BY doc_id, sentence_index)
SELECT doc_id, md5(string_agg(part, chr(10) ORDER BY sentence_index)) AS report_md5 FROM g GROUP BY doc_id""",
    "segments_text": f"WITH {WORDS} SELECT doc_id, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5 FROM words GROUP BY doc_id",
    "word_json_scan": f"""
WITH {WORDS} SELECT doc_id, count(*) AS n_words, (count(*) - 1)::BIGINT AS last_ord, min(trunc(ord * 300 / 1000.0::DOUBLE * 1000))::BIGINT AS first_ms, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5
FROM words WHERE ord % 10 > 0 GROUP BY doc_id""",
    "scan_json_tokens": f"""
WITH {SENTENCES}, n AS (SELECT *, regexp_extract(lower(text), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)*') AS norm FROM placed)
SELECT doc_id, sentence_index AS segment_index, count(*) AS n_tokens, min(start_ms / 1000.0::DOUBLE) AS start, max(end_ms / 1000.0::DOUBLE) AS "end" FROM n WHERE norm <> '' GROUP BY ALL""",
    "vtt_cues": f"""
WITH {LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_index) - 1)::INTEGER AS ord, translate(text, '<>', '()') AS text, start_ms, end_ms FROM lines""",
    "word_vtt_words": f"""
WITH {LINES}, l AS (SELECT doc_id, start_ms, end_ms, len(string_split(text, ' ')) AS n FROM lines),
w AS (SELECT doc_id, start_ms, end_ms, n, unnest(range(0, n)) AS i FROM l WHERE n > 1)
SELECT doc_id, count(*) AS n_words, sum({vtt('start_ms + i * 300')})::BIGINT AS start_sum, sum(CASE WHEN i = n - 1 THEN {vtt('end_ms')} ELSE {vtt('start_ms + (i + 1) * 300')} END)::BIGINT AS end_sum FROM w GROUP BY doc_id""",
    "inline_diff": """
WITH """ + EDITED + """, shown AS (
  SELECT *, array_to_string(list_concat(a, CASE WHEN fresh THEN ['new'] ELSE [] END, z), ' ') AS new,
         CASE WHEN gone OR fresh THEN ['【' || CASE WHEN gone THEN w[mid + 1] ELSE '∅' END || '/' || CASE WHEN fresh THEN 'new' ELSE '∅' END || '】'] ELSE [] END AS edit FROM spans)
SELECT conv_id, turn, coalesce(array_to_string(list_concat(a, edit, z), ' '), '') AS diff, CASE WHEN gone OR fresh THEN array_to_string(list_concat(a, edit, z), ' ') ELSE '' END AS log FROM shown""",
    "token_opcodes": f"""
WITH {EDITED}, ops AS (
  SELECT conv_id, turn, unnest([{{'tag': CASE WHEN gone OR fresh THEN 'equal' END, 'i1': 0, 'i2': p, 'j1': 0, 'j2': p}},
    {{'tag': CASE WHEN gone AND fresh THEN 'replace' WHEN gone THEN 'delete' WHEN fresh THEN 'insert' END, 'i1': mid, 'i2': q, 'j1': mid, 'j2': v}},
    {{'tag': 'equal', 'i1': CASE WHEN gone OR fresh THEN q ELSE 0 END, 'i2': n, 'j1': CASE WHEN gone OR fresh THEN v ELSE 0 END, 'j2': p + r + fresh::INT}}]) AS o FROM spans)
SELECT conv_id, turn, o.tag AS tag, o.i1::INTEGER AS i1, o.i2::INTEGER AS i2, o.j1::INTEGER AS j1, o.j2::INTEGER AS j2 FROM ops WHERE o.tag IS NOT NULL AND (o.i1 < o.i2 OR o.j1 < o.j2)""",
    "text_similarity": f"WITH {EDITED} SELECT conv_id, turn, {RATIO} AS similarity FROM spans",
    "correction_gate": f"""
WITH {EDITED}, judged AS (SELECT *, CASE WHEN (conv_id + turn) % 5 = 0 THEN 0.0 ELSE {RATIO} END AS ratio, CASE WHEN n <= 10 THEN 0.3 ELSE 0.6 END AS least FROM spans)
SELECT conv_id, turn, CASE WHEN ratio < least THEN 'text 0 is only ' || printf('%.2f', ratio) || ' alike, ' || least || ' is needed: keep closer to <' || array_to_string(w, ' ') || '>' ELSE '' END AS fault FROM judged""",
    "rewrite_timestamps": f"""
WITH {SENTENCES}, spot AS (
  SELECT doc_id, sentence_index, sentence_index % 4 AS kind, row_number() OVER s - 1 AS k, count(*) OVER (PARTITION BY doc_id, sentence_index) // 2 AS mid, text || '#' || (row_number() OVER s - 1) AS text, start_ms, end_ms,
         lag(end_ms) OVER s AS before FROM placed WINDOW s AS (PARTITION BY doc_id, sentence_index ORDER BY ord)),
moved AS (
  SELECT doc_id, sentence_index, kind, k, mid, unnest(CASE WHEN k <> mid OR kind = 0 THEN [{{'t': text, 's': start_ms, 'e': end_ms}}] WHEN kind = 1 THEN [{{'t': 'new', 's': start_ms, 'e': end_ms}}]
    WHEN kind = 2 THEN [{{'t': 'new', 's': coalesce(before, start_ms), 'e': start_ms}}, {{'t': text, 's': start_ms, 'e': end_ms}}]
    ELSE [{{'t': 'new1', 's': start_ms, 'e': start_ms + (end_ms - start_ms) // 2}}, {{'t': 'new2', 's': start_ms + (end_ms - start_ms) // 2, 'e': end_ms}}] END) AS x FROM spot)
SELECT doc_id, sentence_index, (row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY k, x.s, x.e) - 1)::INTEGER AS i, x.t AS text, x.s::BIGINT AS start_ms, x.e::BIGINT AS end_ms FROM moved""",
    "part_alignment": f"""
WITH {SENTENCES}, inside AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY ord) - 1 AS k FROM placed SEMI JOIN (SELECT doc_id, sentence_index FROM sentences WHERE {n_words('text')} > 18) USING (doc_id, sentence_index))
SELECT doc_id, sentence_index, (k // 10)::INTEGER AS split_index, string_agg(text, ' ' ORDER BY ord) AS text, min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms FROM inside GROUP BY ALL""",
    "caption_lines": f"WITH {CAPTIONS} SELECT doc_id, sentence_index, split_index, line_index, text, text AS translate_text, start_ms, end_ms FROM lines",
    "corrected_captions": f"""
WITH {CAPTIONS},
capitals AS (SELECT doc_id, sentence_index, sentence_index % 3 = 0 AND regexp_matches(text, '[a-z]') AS logged FROM sentences)
SELECT doc_id, sentence_index, split_index, line_index, CASE WHEN sentence_index % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text, start_ms, end_ms, logged
FROM lines JOIN capitals USING (doc_id, sentence_index)""",
    "caption_gate": f"WITH {CAPTIONS} SELECT doc_id, 0::BIGINT AS failed_lines, count(*) AS total_lines, 0.0::DOUBLE AS fail_rate, 'ok' AS verdict FROM lines GROUP BY doc_id",
    "correction_loop": f"""
WITH {TURNS} SELECT conv_id, turn, CASE n % 5 WHEN 3 THEN 'exhausted' WHEN 4 THEN 'error' ELSE 'ok' END AS status, CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 3 END::INTEGER AS attempts,
  CASE WHEN n % 5 IN (1, 2) THEN text || ' !' ELSE text END AS text FROM turns WHERE n % 5 <> 3 OR place > 1""",
    "split_loop": f"""
WITH {TURNS}, fits AS (SELECT *, bool_and(len(w) <= 15) OVER c AS whole, bool_and(len(w) <= 30) OVER c AS half FROM turns WINDOW c AS (PARTITION BY conv_id)),
judged AS (
  SELECT conv_id, turn, w, text, CASE WHEN n % 4 = 2 THEN 'error' WHEN half OR (n % 4 = 0 AND whole) THEN 'ok' ELSE 'exhausted' END AS status,
    CASE WHEN n % 4 = 2 THEN 0 WHEN NOT half THEN 3 WHEN n % 4 = 3 OR (n % 4 = 0 AND whole) THEN 1 ELSE 2 END::INTEGER AS attempts, n % 4 = 2 OR (n % 4 = 0 AND whole) AS one FROM fits),
pieces AS (SELECT *, CASE WHEN one THEN [text] ELSE list_filter([array_to_string(w[1:len(w) // 2], ' '), array_to_string(w[len(w) // 2 + 1:], ' ')], lambda x: x <> '') END AS parts FROM judged)
SELECT conv_id, turn, status, attempts, generate_subscripts(parts, 1)::INTEGER - 1 AS part, unnest(parts) AS text FROM pieces""",
    "translation_loop": f"""
WITH {TURNS} SELECT conv_id, turn, CASE n % 4 WHEN 3 THEN 'exhausted' ELSE 'ok' END AS status, CASE n % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::INTEGER AS attempts,
  CASE n % 4 WHEN 1 THEN text || ' !' ELSE text END AS text FROM turns WHERE n % 4 <> 2""",
    "call_log": """
WITH c AS (SELECT conv_id, count(*) % 5 AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE k WHEN 0 THEN 'success' WHEN 1 THEN 'error,success' WHEN 4 THEN 'error' ELSE 'success,success,success' END AS calls,
  CASE k WHEN 1 THEN 'the response is blank' WHEN 4 THEN 'ConnectionError: no service' ELSE '' END AS errors FROM c""",
    "lenient_answers": """SELECT conv_id, turn, text AS summary, '[{"src":"a","tgt":"b"}]' AS terms FROM conversations""",
    "call_log_table": """
WITH c AS (SELECT conv_id, count(*) % 5 AS k FROM conversations GROUP BY conv_id),
calls AS (SELECT unnest(CASE k WHEN 0 THEN [['success', '']] WHEN 1 THEN [['error', 'the response is blank'], ['success', '']] WHEN 4 THEN [['error', 'ConnectionError: no service']]
  ELSE [['success', ''], ['success', ''], ['success', '']] END) AS x FROM c)
SELECT x[1] AS status, x[2] AS error, count(*) AS n FROM calls GROUP BY ALL""",
    "conversation_summaries": """
WITH c AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, string_split(text, chr(10))[1] AS summary, '[{"src":"a","tgt":"b"}]' AS terms FROM c""",
    "plain_log_texts": """
SELECT conv_id, turn, len(string_split(regexp_replace(coalesce(text, ''), '[ \n]', chr(10), 'g'), chr(10)))::INTEGER AS n_lines, md5(regexp_replace(coalesce(text, ''), '[ \n]', chr(10), 'g')) AS text_md5 FROM conversations""",
}
ORACLES["remembered_corrections"] = ORACLES["correction_loop"]
ORACLES["subtitle_files"] = ORACLES["srt_roundtrip"]
