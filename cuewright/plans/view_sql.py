"""views.py in SQL, for the side that checks: name -> (views it reads, query)."""

_STEP = "CASE event_type WHEN 'view' THEN 'download' WHEN 'click' THEN 'extract' WHEN 'signup' THEN 'transcribe' WHEN 'purchase' THEN 'translate' WHEN 'error' THEN 'synthesize' END"

VIEW_SQL: dict[str, tuple[str, str]] = {
    "segments0": ("", "SELECT conv_id AS track_id, turn AS seg_idx, role AS speaker, text, coalesce(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), []::VARCHAR[]) AS toks FROM conversations"),
    "segments1": ("segments0", "SELECT *, len(toks) AS n, 200 * ((track_id + seg_idx) % 5) AS gap_ms, 400 * len(toks) AS dur_ms FROM segments0"),
    "segments2": ("segments1", "SELECT *, coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM segments1"),
    "segments": ("segments2", "SELECT *, start_ms + dur_ms AS end_ms FROM segments2"),
    "words0": ("segments", "SELECT track_id, seg_idx, speaker, start_ms AS s, unnest(range(len(toks))) AS pos, unnest(toks) AS text FROM segments"),
    "words": ("words0", "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx, pos) - 1 AS word_idx, seg_idx, pos, text, s + 400 * pos AS start_ms, s + 400 * pos + 350 AS end_ms, speaker FROM words0"),
    "words_alt": ("words", "SELECT * REPLACE (start_ms + 60 * (pos % 4) AS start_ms, end_ms + 60 * (pos % 4) AS end_ms) FROM words WHERE word_idx % 11 <> 10"),
    "clips": ("segments", "SELECT track_id, seg_idx, start_ms, end_ms, text, speaker, dur_ms AS slot_ms, (dur_ms * (70 + (31 * track_id + 17 * seg_idx) % 80)) // 100 AS tts_ms, seg_idx % 4 AS rerender_count, seg_idx % 4 = 3 AS manual_review, seg_idx % 4 = 0 AS qc_ok FROM segments"),
    "durations": ("segments", "SELECT track_id, max(end_ms) AS duration_ms FROM segments GROUP BY track_id"),
    "ref_segments": ("segments", "SELECT track_id, seg_idx AS ref_idx, start_ms + 300 AS start_ms, end_ms + 300 AS end_ms, text FROM segments WHERE seg_idx % 5 <> 4"),
    "speaker_ranges": ("segments", "SELECT track_id, speaker, greatest(start_ms - 500, 0) AS start_ms, end_ms - 500 AS end_ms FROM segments"),
    "frame_texts0": ("words", "SELECT track_id, text, ceil(start_ms / 1000.0)::BIGINT AS a, ceil(coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY word_idx), end_ms) / 1000.0)::BIGINT AS b FROM words"),
    "frame_texts": ("frame_texts0", "SELECT track_id, 1000 * unnest(range(a, b)) AS ts_ms, text FROM frame_texts0 WHERE a < b"),
    "silence0": ("segments", "SELECT track_id, seg_idx, end_ms, lead(start_ms) OVER (PARTITION BY track_id ORDER BY seg_idx) AS nxt FROM segments"),
    "silence_events": ("silence0", "SELECT track_id, seg_idx * 2 AS ord, 'start' AS kind, end_ms AS t_ms FROM silence0 WHERE nxt - end_ms >= 500 UNION ALL SELECT track_id, seg_idx * 2 + 1, 'end', nxt FROM silence0 WHERE nxt - end_ms >= 500"),
    "glossary0": ("", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark) WHERE regexp_matches(w, '^[A-Z][a-z]{2,}$') GROUP BY w ORDER BY n DESC, w LIMIT 40"),
    "glossary1": ("glossary0", "SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS ord FROM glossary0"),
    "glossary": ("glossary1", "SELECT ord, w AS canonical, upper(w) AS target_spelling, CASE WHEN ord % 2 = 0 THEN 'keep' ELSE 'fixed_translation' END AS action, CASE WHEN ord % 3 = 0 THEN lower(w) ELSE '' END AS pronunciation FROM glossary1"),
    "translations": ("segments", "SELECT track_id, seg_idx, 'e1' AS engine, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text_translated FROM segments UNION ALL SELECT track_id, seg_idx, 'e2', array_to_string(toks[1:n // 2], ' ') FROM segments UNION ALL SELECT track_id, seg_idx, 'e3', CASE WHEN seg_idx % 7 = 0 THEN '' ELSE text END FROM segments"),
    "cues": ("segments clips", "SELECT s.track_id, s.seg_idx, s.speaker, s.text, s.start_ms, s.end_ms, c.tts_ms, translate(s.text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text_translated, s.toks, s.n FROM segments s JOIN clips c USING (track_id, seg_idx)"),
    "job_events": ("", f"SELECT user_id AS job_id, event_id AS seq, ts, {_STEP} AS step, (event_id % 101) / 100.0::DOUBLE AS progress, CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'error' ELSE 'running' END AS state FROM events"),
    "provider_results": ("", "SELECT 'p' || (user_id % 3) AS engine, ts, event_type <> 'error' AS ok FROM events"),
    "usage": ("", "SELECT 'c' || (user_id % 4) AS credential, ts, floor(value * 1000)::BIGINT AS chars FROM events"),
    "jobs": ("", "SELECT o_orderkey AS id, 'https://video.example/' || (o_custkey % 50) AS source_url, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS state, o_orderdate AS created_at, o_orderpriority AS target_language, coalesce(c_mktsegment, 'none') AS tts_engine FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "job_segments": ("", "SELECT l_orderkey AS job_id, l_linenumber AS segment_idx, (l_quantity * 1000)::BIGINT AS expected_ms, floor((l_quantity * 1000)::BIGINT * (1 + l_discount) + 0.5)::BIGINT AS tts_ms, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'error' ELSE 'manual_review' END AS qc_status, l_shipdate AS updated_at, l_partkey AS part FROM lineitem"),
    "links": ("", "SELECT page_id AS id, url, page_id AS added_at, NULL::VARCHAR AS preset FROM pages UNION ALL SELECT page_id + 1000000000, url, page_id + 1000000000, 'again' FROM pages WHERE page_id % 5 = 0"),
    "completed": ("", "SELECT url FROM pages WHERE page_id % 3 = 0"),
    "samples": ("", "SELECT vec_id, embedding AS samples FROM embeddings"),
}


#: New slots of the view cues, under the rule of the operator's capped mode.
SLOTS_SQL = """
    WITH a AS (SELECT *, (end_ms - start_ms)::DOUBLE AS slot, CASE WHEN tts_ms > end_ms - start_ms AND end_ms > start_ms THEN round(least(tts_ms / (end_ms - start_ms), 1.3), 4) ELSE 1 END AS sp FROM cues),
    b AS (SELECT *, round(tts_ms / sp, 1) AS t FROM a),
    c AS (SELECT *, sum(t) OVER (PARTITION BY track_id) - sum(slot) OVER (PARTITION BY track_id) > 10 AS mv, greatest(coalesce(start_ms - lag(end_ms) OVER w, 0), 0) AS g FROM b WINDOW w AS (PARTITION BY track_id ORDER BY seg_idx)),
    d AS (SELECT *, CASE WHEN mv THEN t ELSE slot END AS nw FROM c),
    e AS (SELECT *, round(CASE WHEN mv THEN first(start_ms) OVER w + coalesce(sum(nw) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(g) OVER w ELSE start_ms END, 1) AS ns FROM d WINDOW w AS (PARTITION BY track_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING))
    SELECT track_id, seg_idx, start_ms, end_ms, n, t AS spoken_ms, ns AS new_start_ms, round(ns + nw, 1) AS new_end_ms, sp AS audio_speedup,
        CASE WHEN NOT mv OR slot <= 0 THEN 1 ELSE greatest(round(slot / nw, 4), 0.7) END AS video_speed, round(nw - t, 1) AS drift_ms,
        CASE WHEN abs(round(nw - t, 1)) < 50 THEN 'ok' WHEN abs(round(nw - t, 1)) < 200 THEN 'warn' ELSE 'fail' END AS status FROM e"""


def with_views(names: str, sql: str) -> str:
    """The query behind the definitions of the views it reads, in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEW_SQL[name][0].split():
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({VIEW_SQL[n][1]})" for n in needed]
    sql = sql.strip()
    if not parts:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + sql[15:]
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql
