"""DuckDB SQL for the queries, on the same tables; written apart from the DataFrame code, sharing only the fixed lists."""

from __future__ import annotations

from feedlens import adapters as A
from feedlens import config as C

ORACLE_SQL: dict[str, str] = {}


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def pick(values, at: str) -> str:
    return f"([{', '.join(q(v) if isinstance(v, str) or v is None else str(v) for v in values)}])[1 + ({at}) % {len(values)}]"


def rx(col: str, patterns) -> str:
    return f"regexp_matches({col}, {q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def first(col: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q('(?i)' + p)}) THEN {q(p)}" for p in patterns) + " END"


def has(col: str, words, fold: bool = False) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {q(w.lower())})" if fold else f"contains({col}, {q(w)})" for w in words) + ")"


def kept(items) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def rank(col: str, values: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in values.items()) + " END"


E0 = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms, TRY_CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)"
M0 = f"""m AS (SELECT event_id, 'e' || event_id AS feedback_id, CASE WHEN user_id % 29 <> 3 THEN 'u' || user_id END AS user_vid, ts_ms, k, 'app' AS channel,
  {pick(A.PLATFORMS, 'user_id')} AS platform, {pick(A.DEVICES, 'user_id')} AS device_name, CASE WHEN k % 11 <> 0 THEN 10000 END AS service_vid,
  CASE WHEN k % 7 = 6 THEN '' ELSE (k % 3 + 3) || '.' || (k % 4) || '.' || (k % 5) END AS appversion, {pick(A.PHRASES, 'event_id')} AS text FROM ev)"""


def sessions(gap: int) -> str:
    return f"""s1 AS (SELECT *, COALESCE(user_vid, 'anon_' || substr(sha1('anon:' || feedback_id), 1, 12)) AS ukey FROM m),
 s2 AS (SELECT *, lag(ts_ms) OVER (PARTITION BY ukey ORDER BY ts_ms, feedback_id) AS prev FROM s1),
 s3 AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_ms - prev > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY ukey ORDER BY ts_ms, feedback_id ROWS UNBOUNDED PRECEDING) AS n FROM s2),
 f AS (SELECT *, substr(sha1(ukey || ':' || min(ts_ms) OVER (PARTITION BY ukey, n)), 1, 12) AS conversation_id, row_number() OVER (PARTITION BY ukey, n ORDER BY ts_ms, feedback_id) - 1 AS msg_seq FROM s3)"""


_RULE = f"""CASE WHEN s = '' THEN 'empty' WHEN length(s) <= 1 THEN 'too_short'
  WHEN regexp_replace(regexp_replace(s, '[\\x{{1F300}}-\\x{{1F6FF}}\\x{{1F900}}-\\x{{1F9FF}}\\x{{1FA70}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]', '', 'g'), {q('[' + C.PUNCTUATION + ']+')}, '', 'g') = '' THEN 'pure_emoji'
  WHEN {rx('s', C.INVALID_PATTERNS)} THEN 'invalid_kw' WHEN length(s) <= 8 AND {rx('s', C.EMOTION_POS_PATTERNS)} THEN 'emotion_pos' WHEN length(s) <= 8 AND {rx('s', C.EMOTION_NEG_PATTERNS)} THEN 'emotion_neg'
  WHEN {rx('s', C.P0_PATTERNS)} THEN 'bug_p0' WHEN {rx('s', C.SUGGEST_PATTERNS)} THEN 'suggest'
  WHEN {rx('s', C.QUESTION_PATTERNS)} AND (contains(s, '?') OR contains(s, '？') OR length(s) <= 30) THEN 'question' WHEN {rx('s', C.BUG_PATTERNS)} THEN 'bug_general' ELSE 'none' END"""
_TAGS = kept(f"CASE WHEN {has('s', words)} THEN {q(tag)} END" for tag, words in C.L2_KEYWORDS.items())


def labels(source: str) -> str:
    confidence = rank("rule", C.CONFIDENCE | {"none": 0.0})
    return f"""l1 AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM {source}), l2 AS (SELECT *, {_RULE} AS rule, {_TAGS} AS tags FROM l1),
 l AS (SELECT *, CASE WHEN rule IN ('empty','too_short','pure_emoji','invalid_kw') THEN 'E.无效' WHEN rule LIKE 'emotion%' THEN 'D.情绪' WHEN rule LIKE 'bug%' THEN 'A.Bug' WHEN rule = 'suggest' THEN 'B.建议' WHEN rule = 'question' THEN 'C.咨询' ELSE '待定' END AS L1,
  CASE WHEN rule IN ('empty','too_short','invalid_kw') THEN ['其他'] WHEN rule = 'pure_emoji' THEN ['符号表情'] WHEN rule LIKE 'emotion%' OR rule = 'none' THEN []::VARCHAR[] WHEN len(tags) = 0 THEN ['其他'] ELSE tags END AS L2,
  CASE WHEN rule = 'bug_p0' THEN 'P0' WHEN rule = 'bug_general' AND regexp_matches(s, {q(C.UPLIFT_PATTERN)}) THEN 'P1' WHEN rule = 'bug_general' THEN 'P2' ELSE 'P3' END AS severity, CAST({confidence} AS DOUBLE) AS confidence,
  CASE rule WHEN 'empty' THEN '空文本' WHEN 'too_short' THEN '单字符无效内容' WHEN 'pure_emoji' THEN '纯表情或标点' WHEN 'invalid_kw' THEN '命中无效模式 ' || {first('s', C.INVALID_PATTERNS)} WHEN 'emotion_pos' THEN '短句正向情绪' WHEN 'emotion_neg' THEN '短句负向情绪'
   WHEN 'bug_p0' THEN 'P0 关键词 ' || {first('s', C.P0_PATTERNS)} WHEN 'suggest' THEN '建议关键词 ' || {first('s', C.SUGGEST_PATTERNS)} WHEN 'question' THEN '咨询句式 ' || {first('s', C.QUESTION_PATTERNS)} WHEN 'bug_general' THEN 'Bug 关键词 ' || {first('s', C.BUG_PATTERNS)} ELSE 'parse_error: no_json_found' END AS reason,
  CASE WHEN rule <> 'none' THEN 'rule:' || rule END AS rule_name FROM l2)"""


CONV = f"""c AS (SELECT conversation_id, first(L1 ORDER BY {rank('L1', C.L1_PRIORITY)} DESC, confidence DESC, msg_seq) AS L1, first(confidence ORDER BY {rank('L1', C.L1_PRIORITY)} DESC, confidence DESC, msg_seq) AS confidence,
  first(reason ORDER BY {rank('L1', C.L1_PRIORITY)} DESC, confidence DESC, msg_seq) AS reason, first(severity ORDER BY {rank('severity', C.SEVERITY_PRIORITY)} DESC) AS severity,
  COALESCE(array_to_string(list_sort(list_distinct(flatten(list(L2)))), '|'), '') AS L2, count(*) AS msg_count, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms, first(user_vid ORDER BY msg_seq) AS user_vid, first(appversion ORDER BY msg_seq) AS appversion,
  first(platform ORDER BY msg_seq) AS platform, first(service_vid ORDER BY msg_seq) AS service_vid, first(text ORDER BY msg_seq) AS first_text, first(channel ORDER BY msg_seq) AS channel FROM l GROUP BY conversation_id)"""

MSG = f"WITH {E0}, {M0}"
SESS = f"{MSG}, {sessions(A.LONG_GAP_MS)}"
LAB = f"{SESS}, {labels('f')}"
CON = f"{LAB}, {CONV}"
#: LIKE as the domain means it: ASCII letters without case.
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def said(term: str, col: str = "text") -> str:
    return f"contains({_FOLD.format(col)}, {q(term.lower())})"


def some(condition: str, table: str = "f") -> str:
    return f"conversation_id IN (SELECT conversation_id FROM {table} WHERE {condition})"


def add(name: str, sql: str) -> None:
    ORACLE_SQL[name] = sql


# --- messages and sessions ---------------------------------------------------
add("sessionize_events", f"WITH {E0}, m AS (SELECT 'e' || event_id AS feedback_id, 'u' || user_id AS user_vid, ts_ms FROM ev), {sessions(C.GAP_MS)} SELECT conversation_id, min(user_vid) AS user_vid, count(*) AS msg_count, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM f GROUP BY conversation_id")
add("sessionize_by_span", f"{SESS} SELECT feedback_id, conversation_id, msg_seq FROM f")
add("session_anonymous", f"{SESS} SELECT feedback_id, conversation_id, msg_seq FROM f WHERE user_vid IS NULL")
_CODES = {1: "iOS", 2: "Android", 7: "Win", 9: "Mac", 11: "小程序"}


def _platform(code: str, device: str) -> str:
    d = f"lower(COALESCE({device}, ''))"
    return f"CASE {' '.join(f'WHEN {code} = {k} THEN {q(v)}' for k, v in _CODES.items())} WHEN {has(d, ('iphone', 'ipad', 'ios'))} THEN 'iOS' WHEN contains({d}, 'android') THEN 'Android' WHEN {has(d, ('windows', 'win64'))} THEN 'Win' WHEN {has(d, ('mac os', 'macintosh', 'macos'))} THEN 'Mac' ELSE '未知(p=' || COALESCE(CAST({code} AS VARCHAR), 'None') || ')' END"


_RAW = f"""WITH {E0}, r AS (SELECT *, {pick((1, 2, 7, 9, 11, 5), 'k')} AS code, {pick(("iPhone 15", "android-14", "Windows 11", "Mac OS X", "", "fridge"), 'event_id')} AS device, CASE WHEN k % 13 <> 0 THEN 'e' || event_id END AS fid,
 COALESCE(CASE WHEN user_id % 29 <> 3 THEN 'u' || user_id END, 's' || user_id) AS uv, CAST(CASE WHEN k % 11 <> 0 AND k <> 0 THEN k ELSE 10000 END AS BIGINT) AS sv FROM ev)"""
add("flatten_messages", f"""{_RAW} SELECT fid AS feedback_id, ts_ms, {_platform('code', 'device')} AS platform, '5.' || (k % 4) AS appversion, uv AS user_vid, sv AS service_vid, 'chat?channel=app&serviceVid=' || sv || '&userVid=' || uv AS external_chat_url,
 {pick(A.DEVICES, 'user_id')} AS device_name, regexp_replace({pick(A.PHRASES, 'event_id')}, '^\\s+|\\s+$', '', 'g') AS text, 'x|' || event_type AS tags FROM r WHERE fid IS NOT NULL AND ts_ms BETWEEN 1704844800000 AND 1705449600000""")
add("ingest_counters", f"WITH {E0} SELECT count(*) AS session_count, 3 * count(*) AS msg_count, count(*) AS user_msg_count, count(*) FILTER (WHERE ts_ms BETWEEN 1704844800000 AND 1705449600000) AS in_window_count FROM ev")
add("platform_decode", f"WITH {E0}, r AS (SELECT {pick((1, 2, 7, 9, 11, 5, None), 'k')} AS code, {pick(('my iPad', 'ANDROID 14', 'win64 box', 'macOS 14', '', None), 'event_id')} AS device FROM ev) SELECT {_platform('code', 'device')} AS platform, count(*) AS n FROM r GROUP BY 1")
add("incremental_scan", f"{MSG} SELECT feedback_id, ts_ms FROM m WHERE ts_ms >= {A.NOW_MS - 7 * C.DAY_MS}")
add("high_water_mark", "SELECT event_id, event_type FROM events WHERE event_id > (SELECT COALESCE(max(event_id), 0) FROM events WHERE event_type = 'purchase')")
_DAY = "1704816000000 AND {0} < 1704902400000"  # 10 January in UTC+8
add("daily_export_utc8", f"{CON} SELECT 'feedback' AS \"table\", feedback_id AS id FROM f WHERE ts_ms >= {_DAY.format('ts_ms')} UNION ALL SELECT 'message_label', feedback_id FROM l WHERE ts_ms >= {_DAY.format('ts_ms')} UNION ALL SELECT 'conversation_label', conversation_id FROM c WHERE last_ts_ms >= {_DAY.format('last_ts_ms')}")
add("point_lookup", f"{MSG} SELECT feedback_id, text, platform FROM m WHERE feedback_id = 'e77'")
add("backfill_columns", f"{MSG}, b AS (SELECT *, CAST(COALESCE(service_vid, k + 20000) AS BIGINT) AS sv FROM m) SELECT feedback_id, sv AS service_vid, 'chat?channel=app&serviceVid=' || sv || '&userVid=' || user_vid AS external_chat_url FROM b")
add("messages_per_conversation", f"{SESS} SELECT count(*) AS messages, count(DISTINCT conversation_id) AS conversations, count(*) / count(DISTINCT conversation_id) AS ratio FROM f")

# --- merges ------------------------------------------------------------------
add("insert_ignore", f"{MSG} SELECT feedback_id, text FROM m JOIN events USING (event_id) WHERE event_type <> 'purchase'")
add("insert_counts", "SELECT count(*) FILTER (WHERE event_type <> 'purchase') AS inserted, 2 * count(*) - count(*) FILTER (WHERE event_type <> 'purchase') AS skipped FROM events")
add("upsert_latest", f"WITH {E0}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END DESC) AS rn FROM ev) SELECT user_id, event_id, event_type, ts_ms FROM r WHERE rn = 1")
add("quarantine_rows", "SELECT CASE WHEN event_id % 101 = 0 THEN 'L1' WHEN event_id % 103 = 0 THEN 'confidence' ELSE '' END AS problem, count(*) AS n FROM events GROUP BY 1")
add("integrity_orphans", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")

# --- labels ------------------------------------------------------------------
add("rule_tagger", f"{MSG}, {labels('m')} SELECT feedback_id, L1, COALESCE(array_to_string(L2, '|'), '') AS L2, severity, confidence, reason, rule_name FROM l WHERE rule <> 'none'")
add("tag_run_stats", f"{MSG}, {labels('m')} SELECT count(*) FILTER (WHERE rule <> 'none') AS by_rule, count(*) FILTER (WHERE rule = 'none' AND event_id % 7 IN (0, 3, 4)) AS by_llm, count(*) FILTER (WHERE rule = 'none' AND event_id % 7 NOT IN (0, 3, 4)) AS pending FROM l")
_REPLIES = [("A.Bug", "性能", "P1", 1.0, "卡"), ("待定", "", "P3", 0.5, "llm"), ("待定", "", "P3", 0.0, "parse_error: no_json_found"), ("C.咨询", "", "P3", 0.25, "llm"), ("B.建议", "皮肤", "P3", 0.0, "想要皮肤"), ("待定", "", "P3", 0.0, "parse_error: no_json_found"), ("待定", "", "P3", 0.0, "parse_error: no_json_found")]
add("llm_reply_parse", "WITH v(i, L1, L2, severity, confidence, reason) AS (VALUES " + ", ".join(f"({i}, {q(a)}, {q(b)}, {q(c)}, CAST({x} AS DOUBLE), {q(r)})" for i, (a, b, c, x, r) in enumerate(_REPLIES)) + ") SELECT event_id, L1, L2, severity, confidence, reason FROM events JOIN v ON i = event_id % 7")
add("untagged_messages", f"{MSG}, {labels('m')} SELECT feedback_id, ts_ms FROM l WHERE rule = 'none' ORDER BY ts_ms, feedback_id")
add("conversation_labels", f"{CON} SELECT conversation_id, L1, L2, severity, confidence, reason, msg_count, first_ts_ms, last_ts_ms, user_vid, appversion FROM c")

# --- lists and filters -------------------------------------------------------
_URL = "'chat?channel=app&serviceVid=' || COALESCE(service_vid, 10000) || '&userVid=' || user_vid"
_ITEM = f"conversation_id, L1, L2, severity, msg_count, last_ts_ms, CAST(COALESCE(service_vid, 10000) AS BIGINT) AS service_vid, {_URL} AS external_chat_url, platform, substr(first_text, 1, 80) AS preview_text"
add("conversation_list_filtered", f"{CON} SELECT {_ITEM} FROM c WHERE last_ts_ms >= 1704412800000 AND last_ts_ms <= 1706227199000 AND L1 = 'A.Bug' AND list_contains(string_split(L2, '|'), '性能') AND {some(chr(112) + 'latform IN (' + q('iOS') + ', ' + q('Android') + ')')} ORDER BY last_ts_ms DESC, conversation_id LIMIT 50 OFFSET 5")
add("conversation_list_text", f"{CON} SELECT {_ITEM} FROM c WHERE severity = 'P0' AND {some(said('crash'))} ORDER BY last_ts_ms DESC, conversation_id LIMIT 100")
add("conversation_detail", f"{LAB} SELECT feedback_id, msg_seq, ts_ms, text, platform, L1, COALESCE(array_to_string(L2, '|'), '') AS L2, severity, confidence, rule_name FROM l WHERE conversation_id = (SELECT conversation_id FROM f WHERE feedback_id = 'e77')")
add("metadata_filters", f"{CON} SELECT conversation_id, appversion, last_ts_ms FROM c WHERE (starts_with(appversion, '3.1') OR starts_with(appversion, '5')) AND {some('contains(lower(device_name), ' + q('pixel') + ') OR contains(lower(device_name), ' + q('thinkpad') + ')')}")
_ISO = "strftime(make_timestamp(({0} // 1000) * 1000000), '%Y-%m-%dT%H:%M:%S')"
add("csv_export", f"{CON} SELECT conversation_id, L1, L2, severity, confidence, reason, msg_count, {_ISO.format('first_ts_ms')} AS first_ts_human, {_ISO.format('last_ts_ms')} AS last_ts_human, COALESCE(user_vid, '') AS user_vid, COALESCE(appversion, '') AS appversion, platform, channel, substr(first_text, 1, 80) AS preview_text FROM c WHERE L1 = 'A.Bug' ORDER BY last_ts_ms DESC, conversation_id LIMIT 5000")
add("latest_conversations", f"{CON} SELECT conversation_id, last_ts_ms, substr(first_text, 1, 80) AS preview_text FROM c WHERE L1 = '待定' ORDER BY last_ts_ms DESC, conversation_id LIMIT 10")

# --- search ------------------------------------------------------------------
_ID = f"{CON} SELECT conversation_id, L1, last_ts_ms FROM c WHERE "
add("keyword_search_and_or", _ID + some(f"({said('键盘')} AND {said('卡顿')}) OR {said('crash')} OR {said('白屏')}"))
add("keyword_search_exclude", _ID + some(f"{said('闪退')} OR {said('乱码')}") + " AND NOT " + some(f"{said('好用')} OR {said('bug')}"))
add("intent_search", _ID + some(f"({said('语音')} OR {said('麦克风')}) AND ({said('用不了')} OR {said('不准')})") + " AND NOT " + some(said("垃圾")))
add("intent_search_should", _ID + some(" OR ".join(map(said, ("皮肤", "主题", "壁纸")))))
add("regex_search_guarded", _ID + some("length(text) < 2000 AND ((regexp_matches(text, '(?i)语音.*用不了') OR regexp_matches(text, '(?i)crash|闪退')) OR regexp_matches(text, '(?i)UPDATE'))"))
add("fallback_keywords", "SELECT doc_id, COALESCE(array_to_string(list_slice(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+|[a-zA-Z]+'), 1, 5), '|'), '') AS words FROM documents")
_VOICE, _INPUT, _PROBLEM = (" OR ".join(map(said, words)) for words in (C.TOPICS["语音"], C.TOPICS["输入核心"], C.PROBLEM_TEXT))
add("canonical_plan_search", _ID + some(f"({_VOICE}) AND ({_INPUT}) AND ({_PROBLEM})") + " AND " + some("platform = 'Android'"))
add("smart_search_metadata", _ID + "starts_with(appversion, '4.1') AND " + some("platform = 'iOS'"))
_USER = "SELECT conv_id FROM conversations WHERE role = 'user'"
add("chat_keyword_search", f"SELECT DISTINCT conv_id AS conversation_id FROM conversations WHERE role = 'user' AND {said('the')} AND {said('ing')} AND conv_id NOT IN ({_USER} AND {said('zz')})")
add("indexed_keyword_search", _ID + "(" + some(f"({said('键盘')} AND {said('卡顿')}) OR {said('crash')} OR {said('白屏')}") + ") AND NOT " + some(said("bug")))
add("indexed_document_search", f"SELECT doc_id, lang, n_chars FROM documents WHERE ({said('license')} AND {said('©')}) OR {said('zq')} OR {said('the of')} OR ({said('@')} AND {said('http')})")
add("document_search", f"SELECT doc_id, lang, n_chars FROM documents WHERE {said('license')} OR {said('the of')}")
add("document_regex_search", "SELECT doc_id, lang FROM documents WHERE length(text) < 2000 AND regexp_matches(text, '(?i)(^|[^\\pL\\pN_])THE\\s+[\\pL\\pN_]+ing($|[^\\pL\\pN_])')")

# --- statistics --------------------------------------------------------------
add("dist_l1", f"{CON} SELECT L1, count(*) AS n FROM c GROUP BY L1")
add("dist_severity", f"{CON} SELECT severity, count(*) AS n FROM c GROUP BY severity")
_TAG = "tags1 AS (SELECT unnest(string_split(L2, '|')) AS L2 FROM c)"
add("dist_l2_exploded", f"{CON}, {_TAG} SELECT L2, count(*) AS n FROM tags1 WHERE L2 <> '' GROUP BY L2")
add("top_tags", f"{CON}, {_TAG} SELECT L2 AS tag, count(*) AS n FROM tags1 WHERE L2 <> '' GROUP BY L2 ORDER BY n DESC, tag LIMIT 10")
_AT = "strftime(make_timestamp({0} * 1000), {1})"
add("trend_day", f"{CON} SELECT {_AT.format('last_ts_ms', q('%Y-%m-%d'))} AS bucket, L1, count(*) AS n FROM c GROUP BY 1, 2")
add("trend_hour", f"{CON} SELECT {_AT.format('last_ts_ms', q('%Y-%m-%d %H:00'))} AS bucket, L1, count(*) AS n FROM c GROUP BY 1, 2")
add("trend_dense", f"{CON} SELECT {_AT.format('last_ts_ms', q('%Y-%m-%d'))} AS bucket, " + ", ".join(f"count(*) FILTER (WHERE L1 = {q(v)}) AS c{i}" for i, v in enumerate(C.L1_VALUES)) + " FROM c GROUP BY 1")
add("kpi_rates", f"{CON} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'P0') AS p0, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (WHERE L1 <> '待定') / count(*)) AS classified, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (WHERE L1 = '待定') / count(*)) AS pending FROM c")

# --- ranking -----------------------------------------------------------------
_CAND = f"""{CON}, bug AS (SELECT * FROM c WHERE L1 = 'A.Bug' AND severity IN ('P0', 'P1') AND confidence >= 0.7 AND last_ts_ms >= {A.NOW_MS - 7 * C.DAY_MS}),
 txt AS (SELECT conversation_id, string_agg(text, ' || ' ORDER BY msg_seq) AS full_text, first(text ORDER BY confidence DESC, msg_seq) AS top_conf_text, first(feedback_id ORDER BY confidence DESC, msg_seq) AS top_conf_feedback_id FROM l WHERE conversation_id IN (SELECT conversation_id FROM bug) GROUP BY 1),
 cand AS (SELECT bug.conversation_id, L1, L2, severity, confidence, appversion, last_ts_ms, full_text, top_conf_text, top_conf_feedback_id FROM bug JOIN txt USING (conversation_id))"""
_GROUP = "CASE " + " ".join(f"WHEN {has('full_text', C.SIGNATURE_GROUPS[g])} THEN {q(g)}" for g in C.SIGNATURE_PRIORITY) + " END"
_SIG = f"""{_CAND}, sg AS (SELECT *, {_GROUP} AS group_id, CASE WHEN string_split(L2, '|')[1] = '' THEN '_unknown' ELSE string_split(L2, '|')[1] END AS primary_l2,
  CASE WHEN COALESCE(appversion, '') = '' THEN '_unknown' ELSE regexp_replace(appversion, '\\.[^.]*$', '') END AS major_version, COALESCE(NULLIF(appversion, ''), '_unknown') AS v FROM cand),
 g AS (SELECT group_id || '|' || primary_l2 || '|' || major_version AS signature, group_id, primary_l2, major_version, count(*) AS dup_count, count(*) FILTER (WHERE severity = 'P0') AS p0_count, CAST(count(DISTINCT NULLIF(v, '_unknown')) > 1 AS INTEGER) AS cross_version,
  CAST(max(last_ts_ms) >= {A.NOW_MS - C.DAY_MS} AS INTEGER) AS recent_24h, max(last_ts_ms) AS last_ts_ms, first(CASE WHEN top_conf_text <> '' THEN top_conf_text ELSE substr(full_text, 1, 100) END ORDER BY confidence DESC, last_ts_ms DESC, conversation_id DESC) AS representative_text,
  first(conversation_id ORDER BY confidence DESC, last_ts_ms DESC, conversation_id DESC) AS representative_conversation_id, first(top_conf_feedback_id ORDER BY confidence DESC, last_ts_ms DESC, conversation_id DESC) AS representative_feedback_id FROM sg WHERE group_id IS NOT NULL GROUP BY group_id, primary_l2, major_version),
 sc AS (SELECT *, CAST(3 * dup_count + 2 * p0_count + 5 * cross_version + 2 * recent_24h AS DOUBLE) AS score FROM g), vc AS (SELECT group_id || '|' || primary_l2 || '|' || major_version AS signature, v, count(*) AS n FROM sg WHERE group_id IS NOT NULL GROUP BY 1, 2),
 vh AS (SELECT signature, string_agg(v || ':' || n, '|' ORDER BY n DESC, v) AS versions, string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) AS shown FROM vc GROUP BY 1),
 top AS (SELECT *, row_number() OVER (ORDER BY score DESC, last_ts_ms DESC, signature) AS rank FROM sc JOIN vh USING (signature) ORDER BY rank LIMIT 5)"""
add("candidate_conversations", f"{_CAND} SELECT * FROM cand")
add("signature_scores", f"{_SIG} SELECT signature, group_id, primary_l2, major_version, score, dup_count, p0_count, cross_version, recent_24h, representative_text, representative_conversation_id, representative_feedback_id FROM sc")
add("top5_signatures", f"{_SIG} SELECT rank, signature, score, representative_conversation_id FROM top")
add("version_histogram", f"{_SIG} SELECT signature, versions FROM vh")
add("push_log", f"{_SIG} SELECT '2024-01-30' AS push_date, rank, signature, score, versions AS affected_versions, representative_text, CAST(0 AS INTEGER) AS is_empty FROM top UNION ALL SELECT '2024-01-30', 0, NULL, NULL, NULL, NULL, 1 WHERE NOT EXISTS (SELECT 1 FROM top)")
_BLOCK = f"'**' || rank || '. ' || CASE WHEN p0_count > 0 THEN '[P0]' ELSE '[P1]' END || ' ' || {rank('group_id', {k: q(v) for k, v in C.DISPLAY_NAMES.items()})} || ' · ' || primary_l2 || ' · ' || CASE WHEN cross_version = 1 THEN '跨版本' ELSE major_version || ' 版本' END || '** · 重复 ' || dup_count || ' 次' || chr(10) || '> \"' || COALESCE(NULLIF(representative_text, ''), '（无代表文本）') || '\"' || chr(10) || '> 涉及版本：' || shown"
_WINDOW = "'> 数据窗口：过去 7 天 · 扫描 ' || (SELECT count(*) FROM cand) || ' 个 Bug 会话'"
add("push_markdown", f"{_SIG} SELECT CASE WHEN count(*) = 0 THEN '## 📊 今日无 Top Bug · 2024-01-30' || chr(10) || chr(10) || {_WINDOW} ELSE '## 📊 今日 Top Bug 候选 · 2024-01-30' || chr(10) || chr(10) || {_WINDOW} || ' · 命中 ' || (SELECT count(*) FROM sc) || ' 个签名' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) END AS markdown FROM top")

# --- posts -------------------------------------------------------------------
_LOCAL = "(TIMESTAMP '1970-01-01' + to_seconds(searched_at) + INTERVAL 8 HOUR)"


def _ms(local: str) -> str:
    return f"epoch_us({local} - INTERVAL 8 HOUR) // 1000"


def _day(text: str) -> str:
    """A day and time of the year seen, or of the year before if that is more than a day ahead."""
    this, before = (f"strptime(CAST(year({_LOCAL}) - {k} AS VARCHAR) || {q('-' + text)}, '%Y-%m-%d %H:%M')" for k in (0, 1))
    return f"CASE WHEN {this} > {_LOCAL} + INTERVAL 1 DAY THEN {_ms(before)} ELSE {_ms(this)} END"


_WRITTEN = f"""CASE created_at_raw WHEN '今天16:00' THEN {_ms(f"date_trunc('day', {_LOCAL}) + INTERVAL 16 HOUR")} WHEN '20分钟前' THEN searched_at * 1000 - 1200000 WHEN '06月22日 21:49' THEN {_day('06-22 21:49')} WHEN '01月31日 09:05' THEN {_day('01-31 09:05')}
 WHEN '2025年11月03日 16:11' THEN 1762157460000 WHEN '2024-01-05 08:30' THEN {_ms("TIMESTAMP '2024-01-05 08:30:00'")} WHEN '2024-01-05 08:30:15' THEN {_ms("TIMESTAMP '2024-01-05 08:30:15'")} END"""
_B = C.Brands()
_OWN = f"({has('text', _B.own, True)} OR regexp_matches(text, {q(_B.own_near + '.{0,12}(?:' + '|'.join(_B.own_what) + ')')}))"
_RIVAL = f"({has('text', _B.rival, True)} AND {has('text', _B.rival_context, True)})"
_BAD, _GOOD = has("text", C.NEGATIVE_TERMS, True), has("text", C.POSITIVE_TERMS, True)
_TOPICS = kept(f"CASE WHEN {has('text', w, True)}{f' OR ({_OWN} AND {_RIVAL})' if t == 'feature_comparison' else ''} THEN {q(t)} END" for t, w in C.TOPIC_TERMS.items())
_TYPE = "CASE " + " ".join(f"WHEN {has('text', w, True)} THEN {q(t)}" for t, w in C.POST_TYPE_TERMS.items()) + f" WHEN {_BAD} AND NOT {_GOOD} THEN 'complaint' ELSE 'other' END"


def _classify(source: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN {_OWN} AND {_RIVAL} THEN 'comparison' WHEN {_RIVAL} THEN 'rival' WHEN {_OWN} THEN 'own' ELSE 'other' END AS brand_focus, CASE WHEN {_GOOD} AND {_BAD} THEN 'mixed' WHEN {_GOOD} THEN 'positive' WHEN {_BAD} THEN 'negative' ELSE 'neutral' END AS sentiment,
  {_TOPICS} AS t0, {_TYPE} AS post_type FROM {source}),
 {name} AS (SELECT *, CASE WHEN len(t0) = 0 THEN ['other'] ELSE t0 END AS topics, CASE WHEN {has('text', C.HIGH_RISK_TERMS, True)} THEN 'high' WHEN sentiment = 'negative' AND list_has_any(t0, ['privacy', 'ads', 'bug']) THEN 'watch' ELSE 'normal' END AS risk_level FROM {name}0)"""


_HITS = f"""WITH {E0}, h0 AS (SELECT 'p' || (event_id // 3) AS post_id, CAST(user_id AS VARCHAR) AS author_id, k % 2 = 0 AS author_verified, {pick(A.RAW_TIMES, 'event_id // 3')} AS created_at_raw, {pick(A.POST_TEXTS, 'event_id // 3')} AS text, k AS reposts_count,
 'q' || (event_id % 3) AS keyword, {pick(A.QUERY_NAMES, 'k')} AS query_name, ts_ms // 1000 AS searched_at, CAST(event_id % 20 + 1 AS INTEGER) AS search_rank FROM ev), h AS (SELECT *, {_WRITTEN} AS created_at_ms FROM h0)"""
_POSTS = f"""{_HITS}, pa AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY searched_at DESC, author_id DESC, author_verified DESC, reposts_count DESC) AS rn, min(searched_at) OVER (PARTITION BY post_id) AS first_seen_at, max(searched_at) OVER (PARTITION BY post_id) AS last_seen_at FROM h WHERE {_OWN} OR {_RIVAL}),
 p1 AS (SELECT post_id, author_id, author_verified, created_at_raw, created_at_ms, text, reposts_count, first_seen_at, last_seen_at, COALESCE(created_at_ms, last_seen_at * 1000) AS event_ms FROM pa WHERE rn = 1), {_classify('p1', 'p')},
 kf AS (SELECT post_id, query_name, min(searched_at) AS first_at FROM h GROUP BY 1, 2), kw AS (SELECT post_id, string_agg(query_name, '|' ORDER BY first_at, query_name) AS keywords FROM kf GROUP BY 1)"""
add("post_classify", f"{_HITS}, {_classify('h', 'x')} SELECT post_id || '-' || searched_at || '-' || search_rank AS post_id, brand_focus, sentiment, array_to_string(topics, '|') AS topics, post_type, risk_level FROM x")
add("post_relevance", f"{_HITS} SELECT text, bool_or({_OWN} OR {_RIVAL}) AS relevant, count(*) AS n FROM h GROUP BY text")
add("post_upsert", f"{_POSTS} SELECT post_id, author_id, author_verified, created_at_raw, text, reposts_count, first_seen_at, last_seen_at FROM p1")
add("post_time_parse", f"{_HITS} SELECT post_id, search_rank, searched_at, created_at_raw, created_at_ms FROM h")
add("post_keywords", f"{_POSTS} SELECT post_id, keywords FROM kw")
_INSIDE = "event_ms >= 1704153600000 AND event_ms <= 1706486399000"
add("post_list", f"{_POSTS} SELECT post_id, brand_focus, sentiment, array_to_string(topics, '|') AS topics, event_ms, keywords FROM p JOIN kw USING (post_id) WHERE {_INSIDE} AND contains(text, '输入法') AND post_id IN (SELECT post_id FROM h WHERE query_name = '甲牌') ORDER BY event_ms DESC, post_id DESC LIMIT 100")
add("post_stats_dims", f"{_POSTS}, w AS (SELECT * FROM p WHERE {_INSIDE}) SELECT 'total' AS dim, 'posts' AS value, count(*) AS n FROM w HAVING count(*) > 0 UNION ALL SELECT 'brand_focus', brand_focus, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'risk_level', risk_level, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'topic', t, count(*) FROM (SELECT unnest(topics) AS t FROM w) GROUP BY 2")
add("post_trend", f"{_POSTS} SELECT {_AT.format('event_ms', q('%Y-%m-%d'))} AS bucket, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE brand_focus = '{x}') AS {x}" for x in ("own", "rival", "comparison")) + " FROM p GROUP BY 1")
add("post_negative_rate", f"{_POSTS} SELECT count(*) AS posts, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'negative') / count(*)) AS negative FROM p")
add("post_high_risk", f"{_POSTS} SELECT post_id, risk_level, event_ms, keywords FROM p JOIN kw USING (post_id) WHERE risk_level = 'high' ORDER BY event_ms DESC, post_id DESC LIMIT 10")
add("post_reply_labels", "WITH v(i, brand_focus, sentiment, topics, post_type, risk_level, confidence, reason, label_source) AS (VALUES (0, 'own', 'negative', 'bug', 'complaint', 'watch', 0.9::DOUBLE, '卡' || chr(10) || chr(10) || '崩溃', 'llm'), (1, 'other', 'neutral', 'other', 'other', 'normal', 1.0::DOUBLE, '无关', 'llm_hidden')) SELECT 'p' || event_id AS post_id, brand_focus, sentiment, topics, post_type, risk_level, confidence, reason, label_source FROM events JOIN v ON i = event_id % 5")
add("post_reply_counts", "SELECT count(*) AS seen, count(*) FILTER (WHERE event_id % 5 < 2) AS labeled, count(*) FILTER (WHERE event_id % 5 = 1) AS hidden, count(*) FILTER (WHERE event_id % 5 > 1) AS failed FROM events")
add("posts_to_label", f"{_POSTS} SELECT post_id, text FROM p WHERE CAST(substr(post_id, 2) AS BIGINT) % 3 = 2 ORDER BY event_ms DESC, post_id DESC LIMIT 50")
add("latest_run", f"WITH {E0} SELECT 'r' || event_id AS run_id, ts_ms * 1000 + event_id % 1000 AS started_at, CAST(k AS BIGINT) AS posts_found FROM ev WHERE event_type = 'purchase' ORDER BY started_at DESC LIMIT 1")

# --- reports -----------------------------------------------------------------
_SAMPLES = f"""{CON}, tx AS (SELECT conversation_id, substr(string_agg(text, ' | ' ORDER BY msg_seq), 1, 500) AS text FROM f GROUP BY 1),
 o AS (SELECT *, CAST(('0x' || substr(conversation_id, 1, 8)) AS BIGINT) AS snapshot_order FROM c WHERE L1 = 'A.Bug'),
 sa AS (SELECT conversation_id, tx.text, platform, COALESCE(appversion, '') AS appversion, L1, L2, severity, last_ts_ms, CASE WHEN snapshot_order % 5 IN (1, 2, 3) THEN snapshot_order % 5 ELSE 0 END AS ai_score, snapshot_order FROM o JOIN tx USING (conversation_id)),
 best AS (SELECT * FROM sa ORDER BY ai_score DESC, last_ts_ms DESC, snapshot_order LIMIT 80)"""
add("report_samples", f"{_SAMPLES} SELECT conversation_id, text, platform, appversion, L1, L2, severity, last_ts_ms, ai_score FROM best")
add("report_stats", f"{_SAMPLES}, u AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dim, COALESCE(NULLIF({d}, ''), '未知') AS value FROM sa" for d in ("platform", "appversion", "severity", "L1", "L2")) + " UNION ALL SELECT 'ai_score', CASE WHEN ai_score > 0 THEN CAST(ai_score AS VARCHAR) ELSE '未精筛' END FROM sa) SELECT dim, value, count(*) AS n FROM u GROUP BY 1, 2")
add("report_range", f"{_SAMPLES} SELECT count(*) AS sample_count, min(last_ts_ms) AS from_ms, max(last_ts_ms) AS to_ms FROM sa")
add("report_lines", f"{_SAMPLES} SELECT '- 会话 ' || conversation_id || ' | AI相关性 ' || CASE WHEN ai_score > 0 THEN CAST(ai_score AS VARCHAR) ELSE '未精筛' END || ' | 平台 ' || platform || ' | 版本 ' || COALESCE(NULLIF(appversion, ''), '未知') || ' | 标签弱参考 ' || L1 || ' / ' || COALESCE(NULLIF(L2, ''), '-') || ' / ' || severity || chr(10) || '  原文：' || text AS line FROM best")
add("score_sort", f"{_SAMPLES} SELECT conversation_id, last_ts_ms, ai_score FROM sa ORDER BY ai_score DESC, last_ts_ms DESC, conversation_id")
add("relevance_batches", f"{SESS}, tx AS (SELECT conversation_id, substr(string_agg(text, ' | ' ORDER BY msg_seq), 1, 500) AS text FROM f GROUP BY 1) SELECT conversation_id, CASE WHEN contains(text, '卡顿') THEN 3 WHEN contains(text, '卡') OR contains(text, '顿') THEN 2 ELSE 1 END::BIGINT AS score, 'overlap' AS reason FROM tx")

# --- streams -----------------------------------------------------------------
add("stream_trend", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_dedup_late", "SELECT DISTINCT event_id, user_id, event_type FROM events")
add("stream_sessions", """WITH a AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
 b AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM a)
 SELECT user_id, min(us) AS session_start_us, count(*) AS msg_count FROM b GROUP BY user_id, n""")
