"""The registered queries in plain SQL, for an independent engine over the same tables."""

from __future__ import annotations

from gleanery.checks.catalog import PROMPTS, PROVIDERS, REFUSAL_OPENINGS
from gleanery.checks.inputs import BLOCK_TYPES, POLICY
from gleanery.checks.sqlparts import (
    AS_OF,
    ATTENTION,
    CLIPS,
    CSUB,
    DUE,
    GATED,
    ITEMS,
    MEDIA,
    MODEL_TEXTS,
    NOTE,
    NUL,
    REPLAY,
    START,
    STATE,
    STATE_SHOWN,
    SUB,
    TITLE,
    canon,
    gate,
    gate_error,
    in_list,
    iso,
    judged,
    listed,
    lit,
    main_text,
    private_ctes,
    q,
    quoted,
    reason_sql,
    rx,
    slug,
    state_change,
    strip,
    under,
)
from gleanery.operators import answers as A
from gleanery.operators.answers import CACHE_BOUNDARY
from gleanery.operators.blocks import DATABASE_TYPES, FILE_TYPES, UNTITLED
from gleanery.operators.captures import BINARY_NOTE
from gleanery.operators.lifecycle import STEPS
from gleanery.policy import (
    BLOCK_PAGE_DOMAINS,
    CODE_DOMAINS,
    FAILED_STATUSES,
    FILE_DOMAINS,
    GALLERY_DOMAINS,
    TERMINAL_STATUSES,
    Policy,
)

O: dict[str, str] = {}
SUBS = (SUB, CSUB)

# --- URLs ---------------------------------------------------------------------------------

O["canonical_urls"] = q(*SUBS, final="SELECT seq, normalized_url FROM csub")
O["content_ids"] = q(*SUBS, final="SELECT seq, content_id FROM csub")
O["hosts_and_domains"] = q(*SUBS, final="SELECT seq, host, domain FROM csub")
O["url_verdicts"] = q(
    *SUBS,
    judged(),
    final="SELECT seq, ok, CASE WHEN shaped THEN normalized_url ELSE '' END AS normalized_url, "
    "CASE WHEN shaped THEN content_id ELSE '' END AS content_id, reason, blocked FROM judged",
)
O["url_kinds"] = q(*SUBS, judged(), final="SELECT seq, kind FROM judged")
O["probed_kinds"] = q(*SUBS, judged(probes=True), final="SELECT seq, kind FROM judged")
O["listed_hosts"] = q(
    *SUBS,
    r"domains AS (SELECT DISTINCT regexp_replace(host, '^(m|blog)\.', '') AS d FROM csub WHERE v = 0 AND page_id % 5 = 0)",
    "hosts AS (SELECT DISTINCT host FROM csub)",
    "hits AS (SELECT DISTINCT host FROM hosts, domains WHERE host = d OR ends_with(host, '.' || d))",
    final="SELECT seq, host, host IN (SELECT host FROM hits) AS listed FROM csub",
)
O["private_hosts"] = q(
    """addr AS (
  SELECT page_id, (page_id * 7 % 256) || '.' || CASE page_id % 3 WHEN 0 THEN 168 WHEN 1 THEN 16 + page_id % 20
    ELSE page_id % 256 END || '.' || (page_id % 3) || '.' || CASE WHEN page_id % 11 = 0 THEN '007'
    ELSE CAST(page_id % 300 AS VARCHAR) END AS host FROM pages)""",
    private_ctes("addr", "priv"),
    final="SELECT page_id, host, is_private FROM priv",
)
O["source_refs"] = q(
    *SUBS,
    r"""pieces AS (
  SELECT *, list_filter(string_split(upath, '/'), lambda p: p <> '') AS parts,
    regexp_extract(url, '([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})', 0) AS page
  FROM csub)""",
    final=r"""SELECT seq, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner, CASE WHEN len(parts) >= 2 THEN parts[2] END AS repo,
  CASE WHEN len(parts) > 3 AND parts[3] = 'blob' THEN parts[4] END AS ref,
  CASE WHEN len(parts) > 4 AND parts[3] = 'blob' THEN array_to_string(parts[5:], '/') END AS file_path,
  CASE WHEN page <> '' THEN lower(regexp_replace(replace(page, '-', ''), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5')) END AS page_id,
  nullif(regexp_extract(url, '(?:/file/d/|[?&]id=)([\w-]{6,})', 1), '') AS file_id,
  TRY_CAST(nullif(regexp_extract(url, '[?&]img_index=([0-9]+)', 1), '') AS INTEGER) AS img_index FROM pieces""",
)
O["actionable_items"] = q(STATE, final=f"SELECT {STATE_SHOWN} FROM state WHERE {DUE}")

# --- Registration and state ---------------------------------------------------------------

O["first_submissions"] = q(
    *SUBS,
    final=f"""SELECT content_id, seq, url, source, {iso('submitted_at')} AS submitted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY submitted_at, seq) AS rn FROM csub) WHERE rn = 1""",
)


def registered(probes: bool, now: str = AS_OF) -> tuple[str, ...]:
    return (
        *SUBS,
        judged(probes=probes),
        STATE,
        f"""firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY submitted_at, seq) AS rn FROM judged)
  WHERE rn = 1 AND state_key NOT IN (SELECT content_id FROM state)),
registered AS (
  SELECT state_key AS content_id, url, CASE WHEN shaped THEN normalized_url ELSE '' END AS normalized_url, source,
    CASE WHEN accepted THEN 'pending' ELSE 'blocked' END AS status,
    CASE WHEN accepted THEN coalesce(kind, 'media') ELSE 'media' END AS content_kind,
    {now} AS added_at, {now} AS updated_at, CASE WHEN NOT accepted THEN reason END AS error,
    {NUL} AS note_path, {NUL} AS skill_path, CAST(0 AS INTEGER) AS attempt_count,
    CAST(NULL AS TIMESTAMP) AS next_retry_at, {NUL} AS last_completed_stage, {NUL} AS skill_error
  FROM firsts)""",
    )


O["registered_rows"] = q(*registered(True), final=f"SELECT {STATE_SHOWN} FROM registered")
O["streamed_registration"] = q(
    *registered(False), final=f"SELECT {STATE_SHOWN.replace('source,', chr(39) + 'webhook' + chr(39) + ' AS source,')} FROM registered"
)
O["registration_attention"] = q(
    *registered(True),
    final=f"SELECT {iso(AS_OF)} AS ts, url, error AS reason FROM registered WHERE status = 'blocked'",
)
O["newly_registered"] = q(*registered(True), final="SELECT content_id, status, url FROM registered")
O["resolved_submissions"] = q(
    *SUBS,
    judged(),
    STATE,
    final="SELECT j.seq, j.url AS submitted_url, j.state_key AS content_id, s.status, s.url "
    "FROM judged j LEFT JOIN state s ON s.content_id = j.state_key",
)
WAITING = f"status = 'failed' AND coalesce(next_retry_at > {AS_OF}, false)"
O["submission_answers"] = q(
    *registered(False),
    "after_all AS (SELECT content_id, status, error, next_retry_at FROM state UNION ALL "
    "SELECT content_id, status, error, next_retry_at FROM registered)",
    final=f"""SELECT j.seq, a.content_id, status, status NOT IN ('blocked', 'failed_permanent') AS accepted,
  status NOT IN {in_list(TERMINAL_STATUSES)} AND NOT ({WAITING}) AS should_run,
  CASE WHEN {WAITING} THEN 'still waiting on retry backoff until ' || {iso('next_retry_at')}
    || ' (last error: ' || coalesce(error, 'None') || ')' ELSE error END AS reason
FROM judged j JOIN after_all a ON a.content_id = j.state_key""",
)
UPSERTED = f"""changes AS (
  {state_change('state', status="'pending'", updated_at=AS_OF)} WHERE n % 3 = 0
  UNION ALL {state_change('state', content_id="'new-' || content_id", updated_at=AS_OF)} WHERE n % 5 = 0),
upserted AS (
  {state_change('state')} WHERE content_id NOT IN (SELECT content_id FROM changes)
  UNION ALL SELECT * FROM changes)"""
O["upserted_state"] = q(STATE, UPSERTED, final=f"SELECT {STATE_SHOWN} FROM upserted")
O["state_snapshots"] = O["upserted_state"]
STUCK = "status IN ('downloading', 'transcribing') AND attempt_count > 1"
O["updated_state_where"] = q(
    STATE,
    "changed AS ("
    + state_change(
        "state",
        status=f"CASE WHEN {STUCK} THEN 'failed' ELSE status END",
        error=f"CASE WHEN {STUCK} THEN 'stuck after ' || attempt_count ELSE error END",
        updated_at=f"CASE WHEN {STUCK} THEN {AS_OF} ELSE updated_at END",
    )
    + ")",
    final=f"SELECT {STATE_SHOWN} FROM changed",
)
O["resume_plan"] = q(
    STATE,
    final="""SELECT content_id, content_kind, last_completed_stage, CASE
  WHEN last_completed_stage = 'enriched' AND n % 2 = 0 AND n % 3 = 0 THEN 'write_note'
  WHEN last_completed_stage IN ('transcribed', 'enriched') AND n % 2 = 0 THEN 'enrich'
  WHEN content_kind = 'text' THEN 'capture'
  WHEN last_completed_stage IN ('downloaded', 'transcribed', 'enriched') AND n % 5 < 3 THEN 'transcribe'
  ELSE 'download' END AS resume_at FROM state""",
)

# --- Life cycle ---------------------------------------------------------------------------

DEFAULT = Policy()
FAILED = f"""fails AS (
  SELECT *, error AS before, CASE WHEN n % 4 = 0 THEN 'TimeoutError()' ELSE 'e' || (n % 3) END AS now,
    attempt_count + 1 AS tries FROM state WHERE {DUE}),
fails2 AS (SELECT *, CASE WHEN tries >= {DEFAULT.max_attempts} THEN 'failed_permanent' ELSE 'failed' END AS after FROM fails),
failed AS ({state_change(
    "fails2",
    status="after",
    error="now",
    attempt_count="CAST(tries AS INTEGER)",
    updated_at=AS_OF,
    next_retry_at=f"CASE WHEN after = 'failed' THEN {AS_OF} + to_minutes("
    f"{list(DEFAULT.backoff_minutes)}[least(tries, {len(DEFAULT.backoff_minutes)})]) END",
)})"""
O["applied_failures"] = q(STATE, FAILED, final=f"SELECT {STATE_SHOWN} FROM failed")
O["failure_attention"] = q(
    STATE,
    FAILED,
    final=f"SELECT {iso(AS_OF)} AS ts, url, {reason_sql('after', 'tries', 'now')} AS reason FROM fails2 "
    "WHERE after = 'failed_permanent' OR now IS DISTINCT FROM before",
)
O["applied_success"] = q(
    STATE,
    "won AS ("
    + state_change(
        "state",
        status="'done'",
        note_path="'vault/' || content_id || '.md'",
        skill_path="CASE WHEN n % 3 = 0 THEN 'skills/' || content_id || '/SKILL.md' END",
        skill_error="CASE WHEN n % 3 = 1 THEN 'model was away' END",
        error=NUL,
        attempt_count="CAST(0 AS INTEGER)",
        next_retry_at="CAST(NULL AS TIMESTAMP)",
        last_completed_stage="'note_written'",
        updated_at=AS_OF,
    )
    + f" WHERE {DUE})",
    final=f"SELECT {STATE_SHOWN} FROM won",
)


def resets(where: str) -> str:
    changed = state_change(
        "state",
        status="'pending'",
        attempt_count="CAST(0 AS INTEGER)",
        next_retry_at="CAST(NULL AS TIMESTAMP)",
        error=NUL,
        updated_at=AS_OF,
    )
    return q(
        STATE,
        f"back AS ({changed} WHERE status = 'failed_permanent' AND {where})",
        final=f"SELECT {STATE_SHOWN} FROM back",
    )


O["retry_resets"] = resets("n % 2 = 0")
O["retry_resets_all"] = resets("true")
O["advanced_stages"] = q(
    STATE,
    "moved AS ("
    + state_change(
        "state",
        status=f"CASE WHEN n % 5 = 4 AND n % 2 = 0 THEN 'done' ELSE {listed(s[1] for s in STEPS)}[n % 5 + 1] END",
        last_completed_stage=f"CASE WHEN n % 2 = 0 THEN {listed(s[2] for s in STEPS)}[n % 5 + 1] ELSE last_completed_stage END",
        updated_at=AS_OF,
    )
    + ")",
    final=f"SELECT {STATE_SHOWN} FROM moved",
)
O["attempt_replay"] = q(
    REPLAY,
    final=f"SELECT content_id, attempt_id, kind, status, CAST(streak AS INTEGER) AS attempt_count, "
    f"{iso('next_retry_at')} AS next_retry_at FROM replayed",
)
O["attention_events"] = q(
    REPLAY,
    final=f"SELECT content_id, attempt_id, {iso('attempt_ts')} AS ts, {reason_sql('status', 'streak', 'error')} AS reason "
    "FROM replayed WHERE status = 'failed_permanent' OR (status = 'failed' AND error IS DISTINCT FROM previous_error)",
)
O["streamed_retries"] = q(
    REPLAY,
    "alive AS (SELECT *, lead(attempt_ts) OVER (PARTITION BY content_id ORDER BY i) AS next_ts FROM replayed)",
    final=f"""SELECT content_id, 'gave_up' AS event, CAST(streak AS INTEGER) AS attempt_count, {iso('attempt_ts')} AS at, error
FROM replayed WHERE status = 'failed_permanent'
UNION ALL
SELECT content_id, 'retry', CAST(streak AS INTEGER), {iso('next_retry_at')}, error
FROM alive WHERE status = 'failed' AND next_retry_at <= coalesce(next_ts, {AS_OF})""",
)
GAPS = " ".join(f"WHEN {lit(p)} THEN {round(s * 1_000_000)}" for p, s in POLICY.call_intervals.items())
O["call_schedule"] = q(
    f"c AS (SELECT event_id, event_type, epoch_us(ts) AS a, CASE event_type {GAPS} ELSE 0 END AS d, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)",
    "s AS (SELECT *, CASE WHEN d = 0 THEN a ELSE max(a - i * d) OVER (PARTITION BY event_type ORDER BY i "
    "ROWS UNBOUNDED PRECEDING) + i * d END AS start FROM c)",
    final=f"SELECT event_id AS call_id, event_type AS provider, start - a AS wait_us, "
    f"{iso('make_timestamp(start)')} AS starts_at FROM s",
)
O["attention_log"] = q(ATTENTION, final=f"SELECT {iso('seen')} AS ts, url, reason, line FROM attention")
CUTOFF = "TIMESTAMP '2024-02-14 00:00:00' - to_days(30)"
O["pruned_attention"] = q(
    ATTENTION, final=f"SELECT url, line FROM attention WHERE seen IS NULL OR seen >= {CUTOFF}"
)
O["pruned_attention_count"] = q(
    ATTENTION, final=f"SELECT count(*) AS removed FROM attention WHERE seen < {CUTOFF}"
)
O["health"] = q(
    STATE,
    final=f"""SELECT 'ok' AS status, count(*) FILTER (WHERE status NOT IN {in_list(TERMINAL_STATUSES)}) AS queue_depth,
  count(*) FILTER (WHERE status IN {in_list(FAILED_STATUSES)}) AS failed_count,
  {iso("max(updated_at) FILTER (WHERE status = 'done')")} AS last_success_at FROM state""",
)
FINISHED = f"""finished AS ({state_change('state', status="'done'", updated_at=AS_OF)} WHERE n % 7 = 0),
written AS (
  SELECT * FROM upserted WHERE content_id NOT IN (SELECT content_id FROM finished) UNION ALL SELECT * FROM finished)"""
O["state_changes_written"] = q(STATE, UPSERTED, FINISHED, final=f"SELECT {STATE_SHOWN} FROM written")
O["streamed_health"] = q(
    STATE,
    UPSERTED,
    FINISHED,
    "told AS (SELECT status, updated_at FROM state UNION ALL SELECT status, updated_at FROM changes "
    "UNION ALL SELECT status, updated_at FROM finished)",
    final=f"""SELECT 'ok' AS status, count(*) FILTER (WHERE status NOT IN {in_list(TERMINAL_STATUSES)}) AS queue_depth,
  count(*) FILTER (WHERE status IN {in_list(FAILED_STATUSES)}) AS failed_count,
  (SELECT {iso("max(updated_at) FILTER (WHERE status = 'done')")} FROM told) AS last_success_at FROM written""",
)
O["run_summary"] = q(
    STATE,
    final="""SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'done') AS done,
  count(*) FILTER (WHERE status <> 'done') AS failed,
  count(*) FILTER (WHERE status = 'done' AND note_path <> '') AS notes,
  count(*) FILTER (WHERE status = 'done' AND skill_path <> '') AS skills,
  count(*) FILTER (WHERE status <> 'done' AND error <> '') AS errors FROM state""",
)
O["run_outputs"] = q(
    STATE,
    final="""SELECT content_id, 'note' AS kind, note_path AS value FROM state WHERE status = 'done' AND note_path <> ''
UNION ALL SELECT content_id, 'skill', skill_path FROM state WHERE status = 'done' AND skill_path <> ''
UNION ALL SELECT content_id, 'error', content_id || ': ' || error FROM state WHERE status <> 'done' AND error <> ''""",
)
O["state_size"] = q(
    STATE,
    final="SELECT count(*) AS item_count, CAST(100 AS INTEGER) AS threshold, count(*) >= 100 AS warn FROM state",
)
O["stale_outputs"] = q(
    STATE,
    final="""SELECT content_id, 'note' AS kind, note_path AS path FROM state WHERE note_path IS NOT NULL AND n % 3 = 0
UNION ALL SELECT content_id, 'skill', regexp_replace(skill_path, '/[^/]*$', '') FROM state
WHERE skill_path IS NOT NULL AND n % 2 = 1""",
)
O["orphan_artifacts"] = q(
    *SUBS,
    STATE,
    f"made AS (SELECT content_id, 'tmp/' || seq AS path, {START} + to_seconds(seq * 97 % 2000000) AS seen FROM csub)",
    final=f"SELECT m.content_id, path, {iso('seen')} AS modified_at, status FROM made m LEFT JOIN state s "
    f"ON s.content_id = m.content_id WHERE seen < {AS_OF} - to_days(20)",
)

# --- Media --------------------------------------------------------------------------------

SILENT = "suffix IN ('.mp4', '.mov', '.webm') AND NOT coalesce(has_audio, true)"
O["silent_videos"] = q(MEDIA, final=f"SELECT content_id, path FROM media WHERE {SILENT}")
O["media_groups"] = q(MEDIA, final="SELECT content_id, media_type, pos, path, error FROM grouped")
O["images_and_frames"] = q(
    MEDIA,
    final="SELECT content_id, CAST(0 AS INTEGER) AS part, path FROM media WHERE rank = 2 UNION ALL "
    f"SELECT content_id, CAST(1 AS INTEGER), frame_path FROM media WHERE {SILENT} AND frame_path IS NOT NULL",
)
O["carousel_items"] = q(
    MEDIA,
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY path) AS item_no FROM media)",
    final="SELECT content_id, item_no, path FROM numbered WHERE conv_id % 3 = 0 OR item_no = conv_id % 3 + 1",
)
O["media_captures"] = q(
    MEDIA,
    "pictures AS (SELECT content_id, count(*) AS n, string_agg(path, ', ' ORDER BY pos) AS paths FROM grouped "
    "WHERE media_type = 'image' GROUP BY content_id)",
    """films AS (
  SELECT content_id, count(*) AS n, min(path) AS one, arg_min(path, pos) FILTER (WHERE path LIKE '%.webm') AS bad,
    string_agg('[Clip ' || i || '/' || total || '] heard ' || path, chr(10) || chr(10) ORDER BY pos) AS said
  FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY content_id) AS total
    FROM grouped WHERE media_type = 'video') GROUP BY content_id)""",
    final="""SELECT content_id, CAST(0 AS BIGINT) AS part_no, CAST(NULL AS VARCHAR) AS text, error FROM grouped WHERE error IS NOT NULL
UNION ALL SELECT content_id, 0, CASE WHEN n % 4 <> 0 THEN n || ' pictures: ' || paths END,
  CASE WHEN n % 4 = 0 THEN 'the vision model refused to describe the image(s) rather than returning a description: '
    || '''Sorry, I cannot view the images.''' END FROM pictures
UNION ALL SELECT content_id, 0, CASE WHEN bad IS NULL THEN CASE WHEN n = 1 THEN 'heard ' || one ELSE said END END,
  'cannot decode ' || bad FROM films""",
)
O["combined_clips"] = q(
    CLIPS,
    """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY clip_no) AS i, count(*) OVER (PARTITION BY content_id) AS n
  FROM clips)""",
    final="""SELECT content_id, CAST(0 AS BIGINT) AS part_no,
  CASE WHEN max(n) = 1 THEN max(text) ELSE string_agg('[Clip ' || i || '/' || n || '] ' || text, chr(10) || chr(10) ORDER BY i) END AS text,
  CASE WHEN max(n) = 1 THEN max(duration_seconds) ELSE nullif(sum(coalesce(duration_seconds, 0)), 0) END AS duration_seconds,
  CASE WHEN max(n) = 1 THEN max(language) ELSE arg_min(language, i) FILTER (WHERE language <> '') END AS language,
  arg_min(backend, i) AS backend FROM numbered GROUP BY content_id""",
)
O["joined_segments"] = q(
    rf"""lines AS (
  SELECT CAST(conv_id AS VARCHAR) AS content_id, turn AS clip_no, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)""",
    f"joined AS (SELECT content_id, clip_no, {strip('string_agg(' + strip('line') + chr(44) + ' ' + chr(39) + ' ' + chr(39) + ' ORDER BY i)')} AS text FROM lines GROUP BY ALL)",
    final="SELECT content_id, clip_no, CAST(0 AS BIGINT) AS part_no, text, text = '' AS empty FROM joined",
)

# --- Text captures ------------------------------------------------------------------------

O["page_responses"] = (
    "SELECT CAST(page_id AS VARCHAR) AS content_id, url, CAST(200 AS INTEGER) AS status, 'text/html' AS content_type, "
    "md5(html) AS body_md5 FROM pages"
)
O["main_text"] = q(main_text("pages", "html", "mt"), final="SELECT page_id, text FROM mt")
O["gated_captures"] = q(GATED, final="SELECT page_id, gate FROM gated")
O["routed_captures"] = q(GATED, final="SELECT page_id, gate, route, error FROM routed")
O["merged_captures"] = q(
    GATED,
    main_text("pages", "html", "orig"),
    f"settled AS (SELECT page_id, url, text, {gate('text')} AS gate FROM orig)",
    f"""final_pass AS (SELECT page_id, text, CASE WHEN gate = 'ok' THEN 'captured' ELSE 'failed' END AS route,
  CASE WHEN gate <> 'ok' THEN {gate_error('url', True)} END AS error FROM settled)""",
    final="""SELECT r.page_id, CASE WHEN w THEN f.route ELSE r.route END AS route,
  CASE WHEN w THEN 'playwright-render' ELSE 'html-fetch' END AS backend,
  CASE WHEN w THEN f.error ELSE r.error END AS error, md5(CASE WHEN w THEN f.text ELSE r.text END) AS text_md5
FROM (SELECT *, route = 'needs_render' AS w FROM routed) r JOIN final_pass f ON f.page_id = r.page_id""",
)
O["page_text_by_host"] = q(
    canon("pages", "cp"),
    "firsts AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY page_id) = 1)",
    main_text("firsts", "html", "ft"),
    final=f"SELECT host, count(*) AS pages, count(*) FILTER (WHERE {gate('text')} = 'ok') AS captured, "
    "CAST(sum(length(text)) AS BIGINT) AS chars FROM ft GROUP BY host",
)
O["repo_captures"] = q(
    "r AS (SELECT *, 'own' || (doc_id % 7) || '/repo' || doc_id AS name, "
    "CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'main' END AS branch FROM documents)",
    final=f"""SELECT CAST(doc_id AS VARCHAR) AS content_id, {strip('''
  '# ' || name || CASE WHEN doc_id % 2 = 1 THEN ' - docs/' || doc_id || '.md' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 3 > 0 THEN 'About ' || doc_id ELSE '' END || chr(10)
  || 'Stars: ' || (doc_id * 3) || ' | Language: ' || CASE WHEN doc_id % 4 > 0 THEN lang ELSE 'unknown' END
  || ' | Topics: ' || CASE WHEN doc_id % 5 > 0 THEN lang || ', ' || source ELSE '' END || chr(10) || chr(10)
  || '[guide](https://github.com/' || name || '/blob/' || branch || '/docs/g.md) ' || text''')} AS text,
  'github-api' AS backend FROM r""",
)
O["absolute_links"] = q(
    "r AS (SELECT *, 'own' || (doc_id % 7) || '/repo' || doc_id AS name, "
    "CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'main' END AS b FROM documents)",
    "h AS (SELECT *, 'https://github.com/' || name || '/blob/' || b || '/' AS page, "
    "'https://raw.githubusercontent.com/' || name || '/' || b || '/' AS raw FROM r)",
    final="""SELECT doc_id, '[a](' || page || 'docs/' || doc_id || '.md "T") ![b](' || raw || 'img/' || doc_id
  || '.png) [c](https://x.org/' || doc_id || ') [d](#s) [e](mailto:a@b.c) [![f](' || page || 'badge.svg)](ci/' || doc_id
  || ') [g](' || page || doc_id || ') ' || text AS text FROM h""",
)
O["block_page_text"] = q(
    """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
  FROM documents)""",
    f"typed AS (SELECT *, {listed(BLOCK_TYPES)}[n % 7 + 1] AS type FROM lines)",
    """walk AS (
  SELECT doc_id, n, CAST([] AS BIGINT[]) AS path FROM typed WHERE n = 0
  UNION ALL
  SELECT t.doc_id, t.n, list_append(w.path, (t.n - 1) % 2 + 1) FROM walk w
  JOIN typed t ON t.doc_id = w.doc_id AND t.n > 0 AND (t.n - 1) // 2 = w.n)""",
    f"""said AS (
  SELECT doc_id, path, CASE
    WHEN n = 0 THEN CASE WHEN title = '' OR doc_id % 9 = 0 THEN {lit(UNTITLED)} ELSE '# ' || title END
    ELSE concat_ws(chr(10), CASE WHEN title <> '' AND type NOT IN {in_list(FILE_TYPES)} THEN title END,
      CASE WHEN type IN {in_list(DATABASE_TYPES)} THEN '[linked database: ' || CASE WHEN title = '' THEN 'untitled' ELSE title END
        || ' - contents not included]' END) END AS line
  FROM walk JOIN typed USING (doc_id, n))""",
    final="SELECT 'p' || doc_id AS page_id, CAST(0 AS BIGINT) AS part_no, string_agg(line, chr(10) ORDER BY path) AS text "
    "FROM said WHERE line <> '' GROUP BY doc_id",
)
O["block_rows"] = """
SELECT 't' || conv_id || '-' || turn AS page_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(0 AS INTEGER) AS pos,
  't' || conv_id || '-' || turn AS block_id, 'page' AS type, role AS title FROM conversations
UNION ALL
SELECT 't' || conv_id || '-' || turn, 't' || conv_id || '-' || turn, CAST(1 AS INTEGER),
  't' || conv_id || '-' || turn || '-c', 'text', text FROM conversations"""
O["decoded_documents"] = q(
    "shelled AS (SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN "
    "'<html><body><script>x()</script></body></html>' ELSE html END AS html FROM pages)",
    main_text("shelled", "html", "pt"),
    f"""docs AS (SELECT doc_id, 'https://drive.google.com/file/d/' || doc_id AS url, {strip('text')} AS text FROM documents)""",
    final=f"""SELECT 'd' || doc_id AS content_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS text,
  CASE WHEN doc_id % 13 = 0 THEN 'file ' || {quoted('url')} || {lit(BINARY_NOTE)} END AS error FROM docs
UNION ALL
SELECT 'p' || page_id, nullif(text, ''), CASE WHEN text = '' THEN 'file ' || {quoted('url')} || ' produced no usable text' END
FROM pt""",
)
O["fetch_outcomes"] = q(
    """r AS (
  SELECT event_id, 'https://h/' || event_id AS url, [200, 403, 404, 500, 302][event_id % 5 + 1] AS status,
    CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 2 = 0 THEN '0' ELSE '17' END END AS quota,
    ['repo', 'blocks', 'file', 'html'][event_id % 4 + 1] AS kind FROM events)""",
    """o AS (
  SELECT *, CASE WHEN kind = 'repo' AND status = 403 AND quota = '0' THEN 'rate_limited'
    WHEN kind = 'repo' AND status = 404 THEN 'not_found'
    WHEN CASE WHEN kind IN ('file', 'html') THEN status <> 200 ELSE status >= 400 END THEN 'http_error'
    ELSE 'ok' END AS outcome FROM r)""",
    final=f"""SELECT event_id, outcome, CASE outcome
  WHEN 'rate_limited' THEN 'API rate limit exceeded fetching ' || {quoted('url')} || '; resets at epoch ' || event_id
  WHEN 'not_found' THEN '404 for ' || {quoted('url')} || ' - private or nonexistent'
  WHEN 'http_error' THEN kind || ' ' || {quoted('url')} || ' returned HTTP ' || status END AS error FROM o""",
)
O["source_routes"] = q(
    *SUBS,
    judged(),
    f"""routed AS (
  SELECT seq, kind, CASE WHEN kind = 'media' THEN CASE WHEN {under('host', GALLERY_DOMAINS)} THEN 'gallery' ELSE 'video' END
    WHEN {under('host', CODE_DOMAINS)} THEN 'repo' WHEN {under('host', BLOCK_PAGE_DOMAINS)} THEN 'blocks'
    WHEN {under('host', FILE_DOMAINS)} THEN 'file' ELSE 'html' END AS route FROM judged WHERE kind IS NOT NULL)""",
    final="""SELECT *, CASE route WHEN 'repo' THEN 'github-api' WHEN 'blocks' THEN 'notion-api'
  WHEN 'file' THEN 'drive-download' WHEN 'html' THEN 'html-fetch' END AS backend FROM routed""",
)

# --- Model answers ------------------------------------------------------------------------


def split_prompt(filled: str) -> str:
    """static_prefix and prompt columns of a filled template."""
    b = lit(CACHE_BOUNDARY)
    at = f"instr({filled}, {b})"
    return (
        f"CASE WHEN {at} = 0 THEN '' ELSE {strip(f'substr({filled}, 1, {at} - 1)')} END AS static_prefix, "
        f"CASE WHEN {at} = 0 THEN {filled} ELSE {strip(f'substr({filled}, {at} + {len(CACHE_BOUNDARY)})')} END AS prompt"
    )


FILLED = f"""filled AS (
  SELECT doc_id, replace(replace(CASE WHEN doc_id % 2 = 0 THEN {lit(PROMPTS['text'])} ELSE {lit(PROMPTS['media'])} END,
    '{{{{source_url}}}}', 'https://e/' || doc_id), '{{{{transcript}}}}', text) AS f FROM documents),
prompts AS (SELECT doc_id, {split_prompt('f')} FROM filled)"""
O["rendered_prompts"] = q(FILLED, final="SELECT doc_id, static_prefix, prompt FROM prompts")
SKILL_FILLED = lit(PROMPTS["skill"])
for _name, _value in (
    ("title", "title"),
    ("summary", "summary"),
    ("skill_candidate_reason", "coalesce(why, '')"),
    ("key_takeaways", "CASE WHEN doc_id % 3 = 0 THEN '- (none)' ELSE '- first ' || doc_id || chr(10) || '- second' END"),
    ("transcript", "text"),
):
    SKILL_FILLED = f"replace({SKILL_FILLED}, '{{{{{_name}}}}}', {_value})"
O["skill_prompts"] = q(
    ITEMS,
    f"filled AS (SELECT content_id, {SKILL_FILLED} AS f FROM items)",
    final=f"SELECT content_id, {split_prompt('f')} FROM filled",
)
O["image_prompts"] = q(
    MEDIA,
    final="SELECT content_id, 'Describe.' AS static_prefix, count(*) || ' image(s)' AS prompt FROM grouped "
    "WHERE media_type = 'image' GROUP BY content_id",
)
JOINED = "CASE WHEN static_prefix <> '' THEN static_prefix || chr(10) || chr(10) || prompt ELSE prompt END"


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def chat(content: str) -> str:
    head = '{"model":"model-x","max_tokens":4096,"messages":[{"role":"user","content":'
    return f"{lit(head)} || {content} || '}}]'"


O["model_requests"] = q(
    FILLED,
    f"asked AS (SELECT *, {listed(PROVIDERS)}[doc_id % 5 + 1] AS provider, {JOINED} AS joined FROM prompts)",
    final=f"""SELECT doc_id, provider, CASE provider
  WHEN 'anthropic' THEN {chat(js('prompt'))} || CASE WHEN static_prefix <> '' THEN ',"system":[{{"type":"text","text":'
    || {js('static_prefix')} || ',"cache_control":{{"type":"ephemeral"}}}}]' ELSE '' END || '}}'
  WHEN 'ollama' THEN '{{"model":"model-x","prompt":' || {js('joined')} || ',"stream":false,"options":{{"num_predict":4096,"num_ctx":16384}}}}'
  WHEN 'gemini' THEN '{{"contents":[{{"parts":[{{"text":' || {js('joined')}
    || '}}]}}],"generationConfig":{{"maxOutputTokens":4096,"response_mime_type":"application/json"}}}}'
  ELSE {chat(js('joined'))} || ',"response_format":{{"type":"json_object"}}}}' END AS request FROM asked""",
)
O["model_answers"] = q(
    f"""r AS (
  SELECT doc_id, {listed(PROVIDERS)}[doc_id % 5 + 1] AS provider, doc_id % 12 = 0 AS none,
    CASE WHEN doc_id % 12 = 1 THEN '<think>x</think> ' || text ELSE text END AS said, text FROM documents)""",
    final=f"""SELECT doc_id, provider, CASE WHEN none THEN NULL WHEN provider IN ('anthropic', 'gemini') THEN said || said
    WHEN provider = 'groq' THEN {strip('text')} ELSE said END AS text,
  CASE WHEN none THEN CASE provider
    WHEN 'anthropic' THEN 'Claude API response had no text content: {{"content":[{{"type":"tool","text":""}},{{"type":"tool","text":""}}]}}'
    WHEN 'ollama' THEN 'Ollama response had no text content: {{"response":""}}'
    WHEN 'groq' THEN 'Groq API response had no text content: {{"choices":[{{"message":{{"content":""}}}}]}}'
    WHEN 'cerebras' THEN 'Cerebras API response had no text content: {{"choices":[{{"message":{{"content":""}}}}]}}'
    ELSE CASE WHEN doc_id % 24 = 0 THEN {lit(A.EXHAUSTED)} ELSE 'Gemini API response had no text content: '
      || '{{"candidates":[{{"content":{{"parts":[{{"text":""}},{{"text":""}}]}},"finishReason":"STOP"}}]}}' END
    END END AS error FROM r""",
)
O["reasoning_stripped"] = q(MODEL_TEXTS, final="SELECT doc_id, text FROM plain")
O["enrichments"] = q(
    MODEL_TEXTS,
    f"""errs AS (
  SELECT *, CASE
    WHEN doc_id % 30 IN (5, 11) THEN 'Could not parse JSON from model output: ' || {quoted('text')}
    WHEN doc_id % 30 = 17 THEN 'model output is not a JSON object'
    WHEN doc_id % 17 = 5 THEN 'title: not a string'
    WHEN doc_id % 19 IN (3, 4) THEN 'tags: not a list of strings'
    WHEN doc_id % 11 = 3 THEN 'high_signal: not a boolean' END AS error FROM plain)""",
    final="""SELECT doc_id, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN body END AS summary,
  CASE WHEN error IS NULL THEN CASE WHEN doc_id % 19 IN (5, 6) THEN '' ELSE lang || '|t' || (doc_id % 5) END END AS tags,
  CASE WHEN error IS NULL THEN '' END AS tools_mentioned,
  CASE WHEN error IS NULL THEN 'keep ' || doc_id END AS key_takeaways,
  CASE WHEN error IS NULL THEN doc_id % 11 <= 2 END AS high_signal,
  CASE WHEN error IS NULL AND doc_id % 3 = 0 THEN 'why ' || doc_id END AS skill_candidate_reason, error FROM errs""",
)
O["refusals"] = q(
    f"""said AS (SELECT doc_id, {strip(f'({listed(REFUSAL_OPENINGS)}[doc_id % 7 + 1] || text)')} AS s FROM documents),
plain AS (SELECT *, replace(replace(s, '‘', ''''), '’', '''') AS p FROM said),
judged AS (SELECT *, regexp_matches(p, {rx(A.REFUSAL)}) OR regexp_matches(p, {rx(A.ASKS_FOR_IMAGES)}) AS refused FROM plain),
cut AS (SELECT *, substr(s, 1, 200) AS opening FROM judged)""",
    final=f"""SELECT doc_id, refused, CASE WHEN refused THEN
  'the vision model refused to describe the image(s) rather than returning a description: ' || {quoted('opening')} END AS error FROM cut""",
)
O["rate_limit_waits"] = q(
    """r AS (
  SELECT event_id, event_id % 3 <> 0 AS limited, event_id % 4 AS attempt,
    CASE event_id % 5 WHEN 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN 2 THEN 0.0 WHEN 3 THEN 7.5 END AS asked FROM events)""",
    "w AS (SELECT *, CASE WHEN limited THEN coalesce(asked, 5.0 * pow(2, attempt)) END AS wait_seconds FROM r)",
    final="""SELECT event_id, wait_seconds, CASE WHEN NOT limited THEN 'ok' WHEN wait_seconds > 60 OR attempt >= 3 THEN 'give_up'
  ELSE 'retry' END AS action FROM w""",
)
O["model_plug"] = """
SELECT doc_id, CASE WHEN doc_id % 97 <> 3 THEN len(string_split(text, ' ')) END AS words,
  CASE WHEN doc_id % 97 = 3 THEN 'cannot read document ' || doc_id END AS error FROM documents"""

# --- Publishing ---------------------------------------------------------------------------

O["slugs"] = q(
    f"t AS (SELECT doc_id, {TITLE} AS title FROM documents)",
    final=f"SELECT doc_id, title, {slug('title')} AS slug FROM t",
)
O["note_names"] = q(
    f"t AS (SELECT *, split_part({TITLE}, ' ', 1) || ' ' || lang AS words FROM documents)",
    f"""items AS (
  SELECT CAST(doc_id AS VARCHAR) AS content_id, 'd' || (doc_id % 2) || '/' AS folder,
    {slug("CASE WHEN doc_id % 50 = 7 THEN '***' ELSE words END")} AS slug,
    {START} + to_seconds((doc_id * 37) % 101) AS added_at FROM t)""",
    """present AS (
  SELECT 'd' || (doc_id % 2) || '/' AS folder, regexp_replace(lower(words), '[^a-z0-9]+', '-', 'g') AS stem,
    CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 7 + 2 END AS num,
    max(CASE WHEN doc_id % 4 > 0 THEN 'other-' || doc_id END) AS owner
  FROM t WHERE doc_id % 5 = 0 GROUP BY ALL)""",
    "taken AS (SELECT * FROM present WHERE owner IS NOT NULL)",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, slug ORDER BY added_at, content_id) AS r FROM items)""",
    """sizes AS (SELECT folder, slug, count(*) + 20 AS top FROM items GROUP BY ALL)""",
    """numbers AS (SELECT folder, slug, unnest(range(1, top + 1)) AS num FROM sizes)""",
    """free AS (
  SELECT n.*, row_number() OVER (PARTITION BY n.folder, slug ORDER BY n.num) AS r FROM numbers n
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.folder = n.folder AND t.stem = n.slug AND t.num = n.num))""",
    final="""SELECT content_id, folder, slug || CASE WHEN num = 1 THEN '' ELSE '-' || num END || '.md' AS note_name
FROM ranked JOIN free USING (folder, slug, r)""",
)
O["rendered_notes"] = q(ITEMS, NOTE, final="SELECT content_id, content FROM notes")
O["note_front_matter"] = q(
    ITEMS,
    final="SELECT content_id, CASE WHEN doc_id % 10 > 0 THEN content_id END AS owner, "
    "CASE WHEN doc_id % 10 > 0 THEN nullif(title, '') END AS title FROM items",
)
O["skill_candidates"] = q(
    ITEMS, final=f"SELECT content_id, {slug('title')} || '/SKILL.md' AS skill_path FROM items WHERE doc_id % 8 = 0"
)
WORD = "split_part(title, ' ', 1)"
O["last_skills"] = q(
    ITEMS,
    f"p AS (SELECT *, {slug(WORD)} || '/SKILL.md' AS skill_path FROM items)",
    final=f"SELECT skill_path, content_id, {strip('summary')} || chr(10) AS content FROM p "
    "QUALIFY row_number() OVER (PARTITION BY skill_path ORDER BY created_at DESC, content_id DESC) = 1",
)
VAULT = """vault AS (
  SELECT *, CASE WHEN n % 7 = 0 THEN 'someone-else' WHEN n % 7 > 1 THEN content_id END AS owner,
    CASE WHEN n % 5 > 0 THEN 'Title ' || ['a', 'b', 'c'][n % 3 + 1] END AS file_title
  FROM state WHERE note_path IS NOT NULL AND n % 11 > 0)"""
O["note_owner_check"] = q(
    STATE,
    VAULT,
    final="SELECT content_id, note_path, owner, file_title, owner IS NULL OR owner = content_id AS owner_ok FROM vault",
)
O["organized_notes"] = q(
    STATE,
    VAULT,
    """mine AS (
  SELECT *, regexp_extract(note_path, '^(.*/)', 1) AS folder, 'title-' || ['a', 'b', 'c'][n % 3 + 1] AS slug
  FROM vault WHERE (owner IS NULL OR owner = content_id) AND file_title IS NOT NULL)""",
    """placed AS (
  SELECT *, row_number() OVER (PARTITION BY folder, slug ORDER BY added_at, content_id) AS r FROM mine),
targets AS (SELECT *, folder || slug || CASE WHEN r = 1 THEN '' ELSE '-' || r END || '.md' AS target FROM placed)""",
    final=f"""SELECT content_id, note_path, target AS new_path, 'moved ' || note_path || ' -> ' || target AS change FROM targets
UNION ALL
SELECT content_id, note_path, NULL, 'skipped ' || note_path || ': frontmatter content_id ' || {quoted('owner')}
  || ' != state record ' || {quoted('content_id')} || ' (stale note_path)' FROM vault WHERE owner <> content_id""",
)

# --- Sources and sinks --------------------------------------------------------------------

O["inbox_submissions"] = q(
    SUB, final=f"SELECT {strip('url')} AS url, 'queue_file' AS source FROM sub"
)
O["state_document"] = q(
    STATE,
    "old AS ("
    + state_change(
        "state",
        content_kind="'media'",
        error=NUL,
        note_path=NUL,
        skill_path=NUL,
        attempt_count="CAST(0 AS INTEGER)",
        next_retry_at="CAST(NULL AS TIMESTAMP)",
        last_completed_stage=NUL,
    )
    + ")",
    final=f"SELECT {STATE_SHOWN} FROM old",
)
O["stage_artifacts"] = q(
    MODEL_TEXTS,
    final="""SELECT CAST(doc_id AS VARCHAR) AS content_id,
  CASE WHEN doc_id % 17 = 5 THEN CAST(doc_id AS VARCHAR) ELSE title END AS title, body AS summary FROM said
WHERE doc_id % 6 IN (0, 4) OR doc_id % 30 IN (23, 29)""",
)
O["media_listing"] = (
    "SELECT DISTINCT 'content_id=' || role AS content_id, '.json' AS suffix, true AS present FROM conversations"
)
O["log_lines"] = f"""
SELECT '{{"timestamp":"' || {iso('ts')} || '","level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END
  || '","logger":"worker.' || event_type || '","message":"event \\"' || event_id || '\\""'
  || CASE WHEN event_id % 2 = 0 THEN ',"context":{{"user":"' || user_id || '"}}' ELSE '' END
  || CASE WHEN event_type = 'error' THEN ',"exc_info":"Traceback\\n  ' || event_id || '"' ELSE '' END || '}}' AS value FROM events"""
O["parsed_logs"] = f"""
SELECT {iso('ts')} AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'worker.' || event_type AS logger, 'event "' || event_id || '"' AS message,
  CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS user,
  CASE WHEN event_type = 'error' THEN 'Traceback' || chr(10) || '  ' || event_id END AS exc_info FROM events"""

# --- The whole batch ----------------------------------------------------------------------

LATER = f"({AS_OF} + to_hours(1))"
O["full_batch"] = q(
    *registered(False, LATER),
    f"known AS ({state_change('state')} UNION ALL {state_change('registered')})",
    f"due AS (SELECT * FROM known WHERE status NOT IN {in_list(TERMINAL_STATUSES)} "
    f"AND (next_retry_at IS NULL OR next_retry_at <= {LATER}))",
    canon("pages", "rp"),
    "responses AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY page_id) = 1)",
    "fetched AS (SELECT d.content_id, d.url, d.added_at, r.html FROM due d JOIN responses r "
    "ON r.content_id = d.content_id WHERE d.content_kind = 'text')",
    main_text("fetched", "html", "read"),
    f"gated AS (SELECT *, {gate('text')} AS gate FROM read)",
    f"""captured AS (
  SELECT *, CASE WHEN gate = 'app_shell' THEN 'page needs rendering' WHEN gate <> 'ok' THEN {gate_error('url', False)} END AS problem,
    length({strip("('From ' || url || ':' || chr(10) || text)")}) AS size FROM gated)""",
    """named AS (
  SELECT *, row_number() OVER (PARTITION BY size ORDER BY added_at, content_id) AS turn FROM captured WHERE problem IS NULL)""",
    f"""outcome AS (
  SELECT d.*, d.attempt_count + 1 AS tries, n.content_id IS NOT NULL AS won,
    'page-' || n.size || CASE WHEN turn = 1 THEN '' ELSE '-' || turn END || '.md' AS note,
    coalesce(c.problem, 'nothing was fetched for this item') AS problem
  FROM due d LEFT JOIN captured c ON c.content_id = d.content_id LEFT JOIN named n ON n.content_id = d.content_id)""",
    f"dead AS (SELECT *, NOT won AND tries >= {POLICY.max_attempts} AS gone FROM outcome)",
    "changed AS ("
    + state_change(
        "dead",
        status="CASE WHEN won THEN 'done' WHEN gone THEN 'failed_permanent' ELSE 'failed' END",
        updated_at=LATER,
        error="CASE WHEN NOT won THEN problem END",
        note_path="CASE WHEN won THEN note ELSE note_path END",
        skill_path="CASE WHEN NOT won THEN skill_path END",
        attempt_count="CAST(CASE WHEN won THEN 0 ELSE tries END AS INTEGER)",
        next_retry_at=f"CASE WHEN NOT won AND NOT gone THEN {LATER} + to_minutes("
        f"{list(POLICY.backoff_minutes)}[least(tries, {len(POLICY.backoff_minutes)})]) END",
        last_completed_stage="CASE WHEN won THEN 'note_written' ELSE last_completed_stage END",
        skill_error="CASE WHEN NOT won THEN skill_error END",
    )
    + ")",
    f"final_state AS ({state_change('known')} WHERE content_id NOT IN (SELECT content_id FROM due) "
    "UNION ALL SELECT * FROM changed)",
    final=f"SELECT {STATE_SHOWN} FROM final_state",
)

O["notes_written"] = """
SELECT 'd' || doc_id AS content_id, 'n' || doc_id || '.md' AS note_path,
  md5(CASE WHEN doc_id % 3 = 0 THEN '# again' || chr(10) ELSE '' END || coalesce(text, '')) AS content_md5
FROM documents"""

ORACLES = O
