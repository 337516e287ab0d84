"""DuckDB SQL for the queries of upkeep."""

from __future__ import annotations

from feedlens import adapters as A
from feedlens import config as C
from feedlens import upkeep as U
from feedlens.oracles import _AT, _ID, _POSTS, _SAMPLES, _SIG, CON, E0, M0, MSG, ORACLE_SQL, SESS, add, labels, pick, q, said, sessions, some

add("late_recompute", ORACLE_SQL["conversation_labels"])
add("replace_users", f"""WITH a AS ({SESS} SELECT * FROM f), b AS (WITH {E0}, {M0}, {sessions(C.GAP_MS)} SELECT * FROM f), u AS (SELECT DISTINCT 'u' || user_id AS user_vid FROM events WHERE event_type = 'error')
 SELECT feedback_id, conversation_id FROM a WHERE user_vid IS NULL OR user_vid NOT IN (SELECT user_vid FROM u) UNION ALL SELECT feedback_id, conversation_id FROM b WHERE user_vid IN (SELECT user_vid FROM u)""")
add("backfill_conversations", f"""{CON}, z AS (SELECT *, CAST(COALESCE(service_vid, 10000) AS BIGINT) AS sv FROM c) SELECT conversation_id, sv AS service_vid, CASE WHEN platform = 'iOS' AND user_vid IS NOT NULL THEN 'kept:' || user_vid ELSE 'chat?channel=app&serviceVid=' || sv || '&userVid=' || user_vid END AS external_chat_url FROM z""")
add("json_round_trip", ORACLE_SQL["flatten_messages"])
add("import_isolated", f"""{MSG}, {labels('m')} SELECT 'message_label' AS "table", count(*) FILTER (WHERE rule <> 'suggest') AS written, count(*) FILTER (WHERE rule = 'suggest') AS refused, false AS failed FROM l UNION ALL SELECT 'post', 0, 0, true UNION ALL SELECT 'post_hit', count(*), 0, false FROM m""")
add("mirror_tables", f"WITH {E0} SELECT 'p' || (event_id // 3) AS post_id, 'q' || (event_id % 3) AS keyword, {pick(A.QUERY_NAMES, 'k')} AS query_name, ts_ms // 1000 AS searched_at, event_id % 20 + 1 AS search_rank FROM ev")
add("window_scan", f"{MSG} SELECT feedback_id, ts_ms FROM m WHERE ts_ms BETWEEN {A.NOW_MS - 2 * C.DAY_MS} AND {A.NOW_MS}")
_SHAPES = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M', '%Y-%m-%d']"
add("time_columns", f"WITH t AS (SELECT event_id, trim({pick(U.TIMES, 'event_id')}) AS s FROM events), p AS (SELECT *, epoch_ms(try_strptime(s, {_SHAPES})) AS x FROM t) SELECT event_id, x AS from_ms, CASE WHEN length(s) = 10 THEN x + 86399000 ELSE x END AS to_ms FROM p")
add("short_texts", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS short FROM documents")
add("search_description", f"{MSG} SELECT '包含''键盘'' 和 ''卡顿''，包含''闪退'' 或 ''白屏''，排除''好用''' AS said, count(*) AS n FROM m WHERE ({said('键盘')} AND {said('卡顿')}) OR {said('闪退')} OR {said('白屏')}")
add("job_moves", f"""WITH {E0}, j AS (SELECT *, 'j' || event_id AS job_id, {pick(U.STATES, 'k')} AS a, {pick(U.TARGETS, 'event_id')} AS b FROM ev), o AS (SELECT *, a || '>' || b IN ('pending>running', 'running>succeeded', 'running>failed', 'failed>pending') AS ok FROM j)
 SELECT job_id, CASE WHEN ok THEN b ELSE a END AS status, CASE WHEN NOT ok THEN 'old' WHEN b = 'failed' THEN 'new' END AS error_message, CAST(CASE WHEN ok AND b = 'succeeded' THEN k WHEN ok AND b = 'pending' THEN 0 ELSE 5 END AS BIGINT) AS sample_count,
 CASE WHEN NOT ok THEN 1 WHEN b = 'running' THEN ts_ms WHEN b <> 'pending' THEN 1 END AS started_at, CASE WHEN NOT ok THEN 2 WHEN b IN ('succeeded', 'failed') THEN ts_ms END AS finished_at, NOT ok AS refused FROM o""")
add("newest_jobs", f"WITH {E0} SELECT 'j' || event_id AS job_id, ts_ms AS created_at, {pick(U.STATES, 'k')} AS status FROM ev ORDER BY created_at DESC, job_id LIMIT 30")
_RUNS = f"WITH {E0}, r AS (SELECT 'r' || event_id AS run_id, ts_ms * 1000 + event_id % 1000 AS started_at, CAST(CASE WHEN event_type = 'purchase' OR k % 2 = 0 THEN k ELSE 0 END AS BIGINT) AS posts_found, CASE WHEN event_type = 'error' THEN 500 END AS error_chars FROM ev WHERE event_type IN ('error', 'purchase'))"
add("crawl_runs", f"{_RUNS} SELECT * FROM r")
add("newest_runs", f"{_RUNS} SELECT run_id, started_at FROM r ORDER BY started_at DESC, run_id LIMIT 100")
_DAYS = f"WITH {E0}, done AS (SELECT {_AT.format('ts_ms', q('%Y-%m-%d'))} AS day FROM ev WHERE event_type = 'purchase' AND value > 95), d AS (SELECT strftime(DATE '2024-02-10' - CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM (SELECT unnest(range(1, 41)) AS i)), o AS (SELECT day FROM d WHERE day NOT IN (SELECT day FROM done))"
add("open_days", f"{_DAYS} SELECT day FROM o")
add("replay_days", f"{_DAYS} SELECT day, CASE WHEN day LIKE '%5' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN day LIKE '%5' THEN 'TimeoutError: ' || day END AS error, CAST(CASE WHEN day LIKE '%5' THEN 3 ELSE 1 END AS BIGINT) AS tries FROM o")
add("model_labels", f"""{MSG}, {labels('m')} SELECT feedback_id, CASE WHEN contains(text, '书') THEN 'C.咨询' ELSE '待定' END AS L1, CAST(CASE WHEN contains(text, '书') THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN contains(text, '书') THEN 'read' ELSE 'parse_error: no_json_found' END AS reason FROM l WHERE rule = 'none'""")
add("post_model_labels", f"""{_POSTS} SELECT post_id, CASE WHEN contains(text, '卡') THEN 'own' WHEN contains(text, '甜') THEN 'other' END AS brand_focus, CASE WHEN contains(text, '卡') THEN 'llm' WHEN contains(text, '甜') THEN 'llm_hidden' ELSE 'failed' END AS label_source, CAST(CASE WHEN contains(text, '卡') THEN 0.9 WHEN contains(text, '甜') THEN 1 END AS DOUBLE) AS confidence FROM p1""")
add("progressive_scores", ORACLE_SQL["relevance_batches"])
_COMPLAINT = " OR ".join(map(said, C.COMPLAINT_TEXT))
add("complaint_search", f"SELECT *, 'structured_intent' AS way FROM ({_ID}{some(f'({_COMPLAINT}) AND ({said(chr(22238) + chr(22797))})')})")
add("model_pattern_search", f"SELECT *, 'regex' AS way FROM ({_ID}" + some("length(text) < 2000 AND (regexp_matches(text, '(?i)频繁.*延迟') OR regexp_matches(text, '(?i)^GIF') OR regexp_matches(text, '(?i)次都'))") + ")")
_SKIN = " OR ".join(map(said, C.TOPICS["皮肤"]))
add("topic_question_search", _ID + f"severity = 'P3' AND {some(_SKIN)} AND " + some("platform = 'iOS'"))
add("post_list_topic", f"{_POSTS} SELECT post_id, array_to_string(topics, '|') AS topics, event_ms FROM p WHERE list_contains(topics, 'bug') AND sentiment = 'negative' ORDER BY event_ms DESC, post_id DESC LIMIT 100")
_LISTS = ["a|b", "", "", "", "", "ads"]
add("stored_posts", f"SELECT event_id AS post_id, {pick(_LISTS, 'event_id')} AS pic_urls, {pick([x or 'other' for x in _LISTS], 'event_id + 1')} AS topics FROM events")
add("stream_sliding", f"WITH {E0}, w AS (SELECT strftime(make_timestamp((ts_ms // 86400000 - i) * 86400000000), '%Y-%m-%d') AS bucket, event_type FROM ev, (SELECT unnest(range(7)) AS i)) SELECT bucket, event_type, count(*) AS n FROM w GROUP BY ALL")
add("rules_from_file", f"""{MSG}, {labels('m')} SELECT feedback_id, 'P0' AS severity, 'P0 关键词 ' || CASE WHEN contains(s, '闪退') THEN '闪退' ELSE '^顶$' END AS reason FROM l WHERE rule NOT IN ('empty', 'too_short', 'pure_emoji', 'invalid_kw', 'emotion_pos', 'emotion_neg') AND (contains(s, '闪退') OR s = '顶')
 UNION ALL SELECT feedback_id, CASE WHEN regexp_matches(s, {q(C.UPLIFT_PATTERN)}) THEN 'P1' ELSE 'P2' END, 'Bug 关键词 卡.?顿' FROM l WHERE NOT contains(s, '闪退') AND regexp_matches(s, '卡.?顿') AND rule NOT IN ('suggest', 'question', 'empty', 'too_short', 'pure_emoji', 'invalid_kw', 'emotion_pos', 'emotion_neg')""")

add("page_by_key", f"""{CON}, b AS (SELECT *, row_number() OVER (ORDER BY last_ts_ms DESC, conversation_id) AS k, count(*) OVER () AS n FROM c WHERE L1 = 'A.Bug')
 SELECT conversation_id, L1, last_ts_ms, platform, substr(first_text, 1, 80) AS preview_text FROM b WHERE k > 40 * LEAST(2, n // 40) AND k <= 40 * LEAST(2, n // 40) + 40""")
for name in ("change_feed", "stream_labels"):
    add(name, ORACLE_SQL["conversation_labels"])
add("relevance_once", ORACLE_SQL["relevance_batches"])


def _as_of(back: int) -> str:
    """The SQL of signatures with a time that is some days earlier."""
    out = _SIG
    for days in (7, 1):
        out = out.replace(str(A.NOW_MS - days * C.DAY_MS), str(A.NOW_MS - (days + back) * C.DAY_MS))
    return f"SELECT CAST({back} AS INTEGER) AS days_back, * FROM ({out} SELECT signature, score, dup_count, p0_count, cross_version, recent_24h, representative_conversation_id FROM sc)"


add("pane_signatures", " UNION ALL ".join(map(_as_of, U.PANE_DAYS)))
add("pane_trend", ORACLE_SQL["trend_day"])
add("pane_sliding", f"""{CON}, dd AS (SELECT last_ts_ms // {C.DAY_MS} AS d, L1, count(*) AS n FROM c GROUP BY 1, 2), e AS (SELECT DISTINCT d AS e FROM dd)
 SELECT strftime(make_timestamp(e * {C.DAY_MS * 1000}), '%Y-%m-%d') AS bucket, L1, CAST(sum(n) AS BIGINT) AS n FROM dd JOIN e ON d <= e AND d > e - 7 GROUP BY 1, 2""")
add("csv_file", f"SELECT conversation_id, L1, L2, severity, msg_count, first_ts_human, user_vid, appversion, preview_text FROM ({ORACLE_SQL['csv_export']})")
add("push_delivered", f"{_SIG}, pl AS (SELECT rank, signature FROM top UNION ALL SELECT 0, NULL WHERE NOT EXISTS (SELECT 1 FROM top)) SELECT day AS push_date, rank, signature, CASE WHEN day = '2024-01-30' THEN CAST(77 AS BIGINT) END AS delivered_at FROM pl, (SELECT unnest(['2024-01-29', '2024-01-30']) AS day)")
_SCORES = "[[{'s': 3, 'r': 'a'}, {'s': 2, 'r': ''}], [{'s': 2, 'r': 'b'}], NULL, NULL, [], [{'s': 1, 'r': ''}]]"
add("score_replies", f"""WITH p AS (SELECT event_id, {_SCORES}[event_id % 6 + 1] AS x FROM events), n AS (SELECT event_id, x, unnest(CASE WHEN len(x) > 0 THEN range(len(x)) ELSE [NULL] END) AS place FROM p)
 SELECT event_id, place, CAST(x[place + 1].s AS BIGINT) AS score, x[place + 1].r AS reason FROM n""")


def _said(title: str, c: str) -> str:
    counts = f"SELECT COALESCE(NULLIF({c}, ''), '未知') AS v, count(*) AS n FROM sa GROUP BY 1 ORDER BY n DESC, v LIMIT 10"
    return f"chr(10) || '{title}：' || COALESCE((SELECT string_agg(v || ' ' || n, '，' ORDER BY n DESC, v) FROM ({counts})), '无')"


_LINES = ORACLE_SQL["report_lines"].split(" SELECT '- ", 1)[1].rsplit(" AS line FROM best", 1)[0]
add("report_prompt", f"""{_SAMPLES} SELECT '# 用户反馈分析：闪退' || chr(10) || chr(10) || '样本数：' || (SELECT count(*) FROM sa) || {_said('分类', 'L1')} || {_said('严重度', 'severity')} || {_said('平台', 'platform')} || chr(10) || chr(10) || (SELECT string_agg('- {_LINES}, chr(10) ORDER BY snapshot_order) FROM best) AS prompt""")
