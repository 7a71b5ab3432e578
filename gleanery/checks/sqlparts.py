"""Shared pieces of the SQL forms: the derived input tables and text functions."""

from __future__ import annotations

from gleanery.checks.inputs import BLOCK_TYPES, POLICY, STAGES, SUFFIXES
from gleanery.functions.urls import LOCAL_RANGES, PUBLIC_EXCEPTIONS, URL_SHAPE
from gleanery.operators import captures as C
from gleanery.operators.urls import BLOCKED_NOTE
from gleanery.policy import STATUSES, TERMINAL_STATUSES, TRACKING_KEYS

AS_OF = "TIMESTAMP '2026-02-01 00:00:00'"
START = "TIMESTAMP '2026-01-01 00:00:00'"
NUL = "CAST(NULL AS VARCHAR)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def iso(x: str) -> str:
    return (
        f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({x}) % 1000000 = 0 THEN '' "
        f"ELSE '.' || lpad(CAST(epoch_us({x}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00')"
    )


def quoted(x: str) -> str:
    e = rf"replace(replace(replace(replace({x}, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
    return (
        f"(CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {e} || '\"' "
        f"ELSE '''' || replace({e}, '''', '\\''') || '''' END)"
    )


def under(host: str, domains) -> str:
    """The host is one of the domains or lies under one."""
    tests = [f"{host} = {lit(d)} OR {host} LIKE {lit('%.' + d)}" for d in domains]
    return "(" + " OR ".join(tests or ["false"]) + ")"


def first_domain(host: str) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.')"


def q(*ctes: str, final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


# --- Inputs -------------------------------------------------------------------------------

SUB = r"""
variants AS (SELECT page_id, url, unnest([0, 1, 2, 3]) AS v FROM pages),
sub AS (
  SELECT page_id * 4 + v AS seq, page_id, v,
    CASE v
      WHEN 0 THEN url
      WHEN 1 THEN replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'http://www.')
      WHEN 2 THEN split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
        || 'fbclid=' || (page_id % 7) || '&b=2&a=%201+x~*&empty=&c;d=%C3%A9'
      ELSE CASE page_id % 10
        WHEN 0 THEN 'not a url ' || page_id
        WHEN 1 THEN 'ftp://files.example.net/' || page_id
        WHEN 2 THEN 'http://127.0.0.1:11434/' || page_id
        WHEN 3 THEN '  http://localhost:8080/' || page_id || '  '
        WHEN 4 THEN 'http://192.168.1.' || (page_id % 256) || '/x'
        WHEN 5 THEN 'https://github.com/own' || (page_id % 13) || '/repo' || page_id || '/blob/main/docs/a b.md'
        WHEN 6 THEN 'https://www.notion.so/Some-Title-' || md5(CAST(page_id AS VARCHAR)) || '?pvs=4'
        WHEN 7 THEN 'https://drive.google.com/file/d/file_' || page_id || '-x/view?usp=sharing'
        WHEN 8 THEN 'https://m.youtube.com/watch?v=' || page_id || '&si=abc'
        ELSE 'https://www.instagram.com/p/' || page_id || '/?img_index=' || (page_id % 4)
      END
    END AS url,
    CASE WHEN page_id % 2 = 0 THEN 'queue_file' ELSE 'webhook' END AS source,
    TIMESTAMP '2026-01-01 00:00:00' + to_seconds((page_id * 7 + v * 3) % 11) AS submitted_at
  FROM variants
)""".strip()


def canon(src: str, out: str) -> str:
    """CTEs that add the parts, host, canonical text and id of ``url``."""
    shape = lit(URL_SHAPE.replace(r"\A", "^").replace(r"\z", "$").replace(r"[\s\S]", r"(?s:.)"))
    dec = "url_decode(replace({0}, '+', '%20'))".format
    enc = "replace(url_encode({0}), '%20', '+')".format
    return rf"""
{out}_1 AS (SELECT *, {strip('url')} AS utext, regexp_replace({strip('url')}, '[\t\r\n]', '', 'g') AS u0 FROM {src}),
{out}_2 AS (
  SELECT *, lower(regexp_extract(u0, {shape}, 1)) AS scheme, regexp_extract(u0, {shape}, 2) AS netloc,
    regexp_replace(regexp_extract(u0, {shape}, 3), ';[^/]*$', '') AS upath,
    regexp_extract(u0, {shape}, 4) AS uquery
  FROM {out}_1),
{out}_3 AS (
  SELECT *, list_sort(list_filter(list_transform(
      list_filter(string_split(uquery, '&'), lambda p: regexp_matches(p, '=(?s:.)')),
      lambda p: {{'k': {dec("split_part(p, '=', 1)")}, 'v': {dec("regexp_replace(p, '^[^=]*=', '')")}}}),
      lambda s: NOT list_contains({listed(TRACKING_KEYS)}, lower(s.k)))) AS pairs,
    regexp_replace(lower(netloc), '^www\.', '') AS place,
    regexp_replace(upath, '/+$', '') AS cpath,
    regexp_replace(regexp_extract(regexp_replace(lower(netloc), '^.*@', ''), '^(\[[^\]]*\]|[^:]*)', 1), '^www\.', '') AS host
  FROM {out}_2),
{out}_4 AS (
  SELECT *, CASE WHEN scheme = '' THEN 'https' ELSE scheme END || ':'
    || CASE WHEN place <> '' THEN '//' || place ELSE '' END || cpath
    || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(
         list_transform(pairs, lambda s: {enc("s.k")} || '=' || {enc("s.v")}), '&') ELSE '' END AS normalized_url
  FROM {out}_3),
{out} AS (
  SELECT *, substr(sha256(normalized_url), 1, 16) AS content_id, {first_domain('host')} AS domain,
    scheme IN ('http', 'https') AND netloc <> '' AS web
  FROM {out}_4)""".strip()


CSUB = canon("sub", "csub")


def eval_ip(a: str) -> int:
    n = 0
    for x in a.split("."):
        n = n * 256 + int(x)
    return n


_PLAIN_IP = r"^((0|[1-9][0-9]?[0-9]?)\.){3}(0|[1-9][0-9]?[0-9]?)$"


def private_ctes(src: str, out: str) -> str:
    """CTEs that add ``is_private`` for ``host``."""
    spans = []
    for r in LOCAL_RANGES:
        net, bits = r.split("/")
        lo = eval_ip(net)
        spans.append(f"n BETWEEN {lo} AND {lo + 2 ** (32 - int(bits)) - 1}")
    public = ", ".join(str(eval_ip(a)) for a in PUBLIC_EXCEPTIONS)
    octets = "list_transform(string_split(host, '.'), lambda o: TRY_CAST(o AS BIGINT))"
    return rf"""
{out}_o AS (SELECT *, CASE WHEN regexp_matches(host, {lit(_PLAIN_IP)}) THEN {octets} END AS octets FROM {src}),
{out}_n AS (
  SELECT *, CASE WHEN list_max(octets) <= 255
    THEN octets[1] * 16777216 + octets[2] * 65536 + octets[3] * 256 + octets[4] END AS n
  FROM {out}_o),
{out} AS (
  SELECT *, coalesce(({" OR ".join(spans)}) AND n NOT IN ({public}), false) OR starts_with(host, '[') AS is_private
  FROM {out}_n)""".strip()


def judged(src: str = "csub", out: str = "judged", probes: bool = False) -> str:
    """CTEs that add verdict, kind and state key under the shared policy."""
    yes = "seq % 8 = 3" if probes else "false"
    return rf"""
{private_ctes(src, out + "_p")},
{out}_v AS (
  SELECT *, CASE WHEN utext = '' THEN 'empty' WHEN NOT web THEN 'malformed'
      WHEN {under('domain', POLICY.blocked_domains)} THEN 'blocked'
      WHEN NOT {under('host', POLICY.allowed_domains)} THEN 'unlisted' ELSE 'ok' END AS verdict,
    CASE WHEN NOT web THEN NULL
      WHEN {under('host', POLICY.allowed_domains)} THEN
        CASE WHEN host <> 'drive.google.com' OR ({yes}) THEN 'media' ELSE 'text' END
      WHEN {under('host', POLICY.text_blocked_domains)} OR host = 'localhost' OR is_private THEN NULL
      ELSE 'text' END AS kind
  FROM {out}_p),
{out}_r AS (
  SELECT *, verdict = 'ok' AS ok, verdict = 'blocked' AS blocked,
    verdict NOT IN ('empty', 'malformed') AS shaped,
    CASE verdict WHEN 'empty' THEN 'empty URL'
      WHEN 'malformed' THEN 'not a valid http(s) URL: ' || {quoted('utext')}
      WHEN 'blocked' THEN 'domain ''' || domain || ''' ' || {lit(BLOCKED_NOTE)}
      WHEN 'unlisted' THEN 'domain ''' || domain || ''' is not in the configured allow-list' END AS reason
  FROM {out}_v),
{out} AS (
  SELECT *, ok OR (verdict = 'unlisted' AND coalesce(kind = 'text', false)) AS accepted,
    CASE WHEN shaped THEN content_id ELSE url END AS state_key
  FROM {out}_r)""".strip()


STATE = (
    canon("(SELECT page_id, url FROM pages WHERE page_id % 2 = 0)", "cpage")
    + rf""",
state0 AS (
  SELECT *, page_id // 2 AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY page_id) AS rn FROM cpage) WHERE rn = 1),
state1 AS (SELECT *, {listed(STATUSES)}[k % 9 + 1] AS status FROM state0),
state AS (
  SELECT content_id, url, normalized_url, 'queue_file' AS source, status,
    CASE WHEN k % 3 = 0 THEN 'media' ELSE 'text' END AS content_kind,
    {START} + to_seconds(k * 60) AS added_at, {START} + to_seconds(k * 60 + 3600) AS updated_at,
    CASE WHEN starts_with(status, 'failed') THEN 'e' || (k % 3) END AS error,
    CASE WHEN status = 'done' THEN 'vault/d' || (k % 4) || '/note-' || k || '.md' END AS note_path,
    CASE WHEN status = 'done' AND k % 4 = 0 THEN 'skills/s' || k || '/SKILL.md' END AS skill_path,
    CAST(k % 5 AS INTEGER) AS attempt_count,
    CASE WHEN status = 'failed' THEN {AS_OF} + to_hours(CAST(k % 7 - 3 AS INTEGER)) END AS next_retry_at,
    CASE k % 5 WHEN 0 THEN NULL ELSE {listed(STAGES)}[k % 5] END AS last_completed_stage,
    {NUL} AS skill_error,
    CAST('0x' || substr(content_id, 1, 4) AS BIGINT) AS n
  FROM state1)"""
)

STATE_SHOWN = (
    f"content_id, url, normalized_url, source, status, content_kind, {iso('added_at')} AS added_at, "
    f"{iso('updated_at')} AS updated_at, error, note_path, skill_path, attempt_count, "
    f"{iso('next_retry_at')} AS next_retry_at, last_completed_stage, skill_error"
)


def state_change(src: str, **new: str) -> str:
    """All state columns of ``src`` with some replaced."""
    names = [c.strip() for c in STATE_COLUMNS.split(",")]
    return "SELECT " + ", ".join(f"{new[c]} AS {c}" if c in new else c for c in names) + f" FROM {src}"


STATE_COLUMNS = (
    "content_id, url, normalized_url, source, status, content_kind, added_at, updated_at, error, "
    "note_path, skill_path, attempt_count, next_retry_at, last_completed_stage, skill_error"
)
DUE = f"status NOT IN {in_list(TERMINAL_STATUSES)} AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF})"

ATTEMPTS = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
att AS (
  SELECT 'item-' || user_id AS content_id, event_id AS attempt_id, ts AS attempt_ts,
    CASE WHEN event_type = 'signup' AND k < 20 THEN 'reset' ELSE 'attempt' END AS kind,
    event_type NOT IN ('error', 'click') AS ok,
    CASE WHEN event_type IN ('error', 'click') THEN 'e' || (k % 3) END AS error
  FROM ev)""".strip()

# Replays each log row by row: failures in a row and whether the item is given up.
REPLAY = rf"""
{ATTEMPTS},
seqd AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY attempt_ts, attempt_id) AS i FROM att),
walk AS (
  SELECT content_id, attempt_id, attempt_ts, kind, ok, error, i,
    CASE WHEN kind = 'attempt' AND NOT ok THEN 1 ELSE 0 END AS streak,
    kind = 'attempt' AND NOT ok AND 1 >= {POLICY.max_attempts} AS dead, true AS ran, {NUL} AS previous_error
  FROM seqd WHERE i = 1
  UNION ALL
  SELECT s.content_id, s.attempt_id, s.attempt_ts, s.kind, s.ok, s.error, s.i,
    CASE WHEN s.kind = 'reset' THEN 0 WHEN w.dead THEN w.streak WHEN s.ok THEN 0 ELSE w.streak + 1 END,
    CASE WHEN s.kind = 'reset' THEN false WHEN w.dead THEN true
      ELSE NOT s.ok AND w.streak + 1 >= {POLICY.max_attempts} END,
    s.kind = 'reset' OR NOT w.dead,
    CASE WHEN w.kind = 'attempt' AND NOT w.ok THEN w.error END
  FROM walk w JOIN seqd s ON s.content_id = w.content_id AND s.i = w.i + 1),
replayed AS (
  SELECT *, CASE WHEN kind = 'reset' THEN 'pending' WHEN ok THEN 'done' WHEN dead THEN 'failed_permanent'
      ELSE 'failed' END AS status,
    CASE WHEN kind = 'attempt' AND NOT ok AND NOT dead
      THEN attempt_ts + to_minutes([{", ".join(str(m) for m in POLICY.backoff_minutes)}][least(streak, {len(POLICY.backoff_minutes)})]) END AS next_retry_at
  FROM walk WHERE ran)""".strip()


def reason_sql(status: str, count: str, error: str) -> str:
    return (
        f"CASE WHEN {status} = 'failed_permanent' THEN 'giving up after ' || {count} || "
        f"' attempts (permanent failure): ' || {error} ELSE 'processing failed: ' || {error} END"
    )


ATTENTION = rf"""
att_raw AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'yesterday' ELSE {iso('ts')} END AS stamp,
    CASE WHEN event_id % 50 <> 0 THEN ts END AS seen, 'https://e/' || event_id AS url, event_type AS reason
  FROM events),
attention AS (SELECT *, stamp || chr(9) || url || chr(9) || reason AS line FROM att_raw)""".strip()

CLIPS = """
clips AS (
  SELECT CAST(conv_id AS VARCHAR) AS content_id, turn AS clip_no, text,
    CASE WHEN role = 'assistant' THEN 'en' ELSE '' END AS language, 'backend-' || role AS backend,
    CASE WHEN turn % 3 > 0 THEN (turn % 3) * CAST(0.5 AS DOUBLE) END AS duration_seconds
  FROM conversations)""".strip()

MEDIA = rf"""
files0 AS (
  SELECT *, (conv_id * 5 + turn * CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END) % 8 AS kind FROM conversations),
files1 AS (
  SELECT CAST(conv_id AS VARCHAR) AS content_id, conv_id, turn,
    'tmp/' || conv_id || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') || {listed(SUFFIXES)}[kind + 1] AS path,
    lower({listed(SUFFIXES)}[kind + 1]) AS suffix,
    CASE (conv_id + turn) % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS has_audio
  FROM files0),
media AS (
  SELECT *, CASE WHEN conv_id % 4 > 0 THEN path || '.frame.jpg' END AS frame_path,
    CASE WHEN suffix = '.mp3' THEN 0
      WHEN suffix IN ('.mp4', '.mov', '.webm') THEN CASE WHEN coalesce(has_audio, true) THEN 1
        WHEN conv_id % 4 > 0 THEN 3 END
      WHEN suffix IN ('.jpg', '.jpeg', '.png') THEN 2 END AS rank
  FROM files1),
best AS (SELECT content_id, min(rank) AS best FROM media GROUP BY content_id),
grouped AS (
  SELECT m.content_id, CASE WHEN best <= 1 THEN 'video' ELSE 'image' END AS media_type,
    row_number() OVER (PARTITION BY m.content_id ORDER BY rank, path) AS pos,
    CASE WHEN rank = 3 THEN frame_path ELSE path END AS path, {NUL} AS error
  FROM media m JOIN best b ON m.content_id = b.content_id
  WHERE rank IS NOT NULL AND (best <= 1) = (rank <= 1)
  UNION ALL
  SELECT content_id, NULL, 0, NULL, 'no video or image files' FROM best WHERE best IS NULL)""".strip()


def rx(pattern: str) -> str:
    """A Java pattern in RE2 spelling."""
    return lit(pattern.replace(r"\A", "^"))


BLOCK_TAGS = (
    "address article blockquote body dd div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr li main "
    "ol p pre section table tbody td tfoot th thead title tr ul noscript br"
)


def main_text(src: str, html: str, out: str) -> str:
    """CTEs that add ``text``, the main text of the column (for pages whose tags are all closed)."""
    dropped = ["<!--.*?-->"]
    dropped += [rf"<{t}\b[^<>]*>.*?</{t}\s*>" for t in "script style nav footer aside header".split()]
    ads = [
        rf"<{t}\b[^<>]*\bclass\s*=\s*[\"']?ad[\"']?[\s>][^<>]*?>?.*?</{t}\s*>"
        for t in "div section span p aside ins".split()
    ]
    region = "clean"
    for tag in ("body", "main", "article"):
        content = lit(rf"(?is)<{tag}\b[^<>]*>(.*?)(?:</{tag}\s*>|\z)")
        region = (
            f"CASE WHEN regexp_matches(clean, {lit(rf'(?i)<{tag}\b[^<>]*>')}) "
            f"THEN regexp_extract(clean, {content}, 1) ELSE {region} END"
        )
    entities = "numbered"
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("copy", "©"), ("amp", "&")):
        entities = f"replace({entities}, {lit(f'&{name};')}, {lit(char)})"
    noise, ad = lit("(?is)" + "|".join(dropped)), lit("(?is)" + "|".join(ads))
    breaks = lit(rf"(?i)</?(?:{BLOCK_TAGS.replace(' ', '|')})\b[^<>]*>")
    tags = lit("<[!/?a-zA-Z][^<>]*>")
    return rf"""
{out}_1 AS (SELECT *, regexp_replace(regexp_replace(coalesce({html}, ''), {noise}, ' ', 'g'), {ad}, ' ', 'g') AS clean FROM {src}),
{out}_2 AS (SELECT * EXCLUDE (clean), {region} AS region FROM {out}_1),
{out}_3 AS (SELECT * EXCLUDE (region), regexp_replace(regexp_replace(region, {breaks}, chr(10), 'g'), {tags}, '', 'g') AS numbered FROM {out}_2),
{out}_4 AS (SELECT * EXCLUDE (numbered), {entities} AS named FROM {out}_3),
{out} AS (
  SELECT * EXCLUDE (named), {strip(r"regexp_replace(regexp_replace(named, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')")} AS text
  FROM {out}_4)""".strip()


def any_of(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def gate(text: str) -> str:
    opening = f"lower(substr({text}, 1, {C.OPENING}))"
    return (
        f"CASE WHEN {any_of(opening, C.CHALLENGE_MARKERS)} THEN 'bot_challenge' "
        f"WHEN {any_of(opening, C.LOGIN_MARKERS)} THEN 'login_wall' "
        f"WHEN length({text}) < {C.SHORTEST_PAGE} OR {any_of(f'lower({text})', C.SHELL_MARKERS)} THEN 'app_shell' "
        "ELSE 'ok' END"
    )


def gate_error(url: str, rendered: bool) -> str:
    empty = (
        " produced no usable text even after rendering"
        if rendered
        else " produced no usable text and the browser-render fallback is disabled"
    )
    page = f"'page ' || {quoted(url)} || "
    return (
        f"CASE gate WHEN 'bot_challenge' THEN {page}' is behind a bot-detection challenge, which is not bypassed' "
        f"WHEN 'login_wall' THEN {page}' requires login - no credentials are used' "
        f"WHEN 'app_shell' THEN {page}{lit(empty)} END"
    )


GATED = (
    """
gp AS (
  SELECT page_id, url, CASE WHEN page_id % 10 = 6 THEN '<html><body><div id=root></div></body></html>'
    ELSE replace(replace(html, '<article>', '<article>' || CASE page_id % 10
        WHEN 3 THEN '<p>Just a moment...</p>' WHEN 4 THEN '<p>Please log in to go on.</p>'
        WHEN 5 THEN '<noscript>Please enable JavaScript to see this page.</noscript>' ELSE '' END),
      '</article>', '<p>just a moment, please log in</p></article>') END AS html
  FROM pages),
""".strip()
    + "\n"
    + main_text("gp", "html", "gtext")
    + f""",
gated AS (SELECT page_id, url, text, {gate('text')} AS gate FROM gtext),
routed AS (
  SELECT *, CASE gate WHEN 'ok' THEN 'captured' WHEN 'app_shell' THEN 'needs_render' ELSE 'failed' END AS route,
    CASE WHEN gate NOT IN ('ok', 'app_shell') THEN {gate_error('url', False)} END AS error
  FROM gated)"""
)

TITLE = r"array_to_string(list_slice(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 12), ' ')"


def esc_json(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    out = f"replace({out}, '\"', '\\\"')"
    for code, shown in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        out = f"replace({out}, chr({code}), '{shown}')"
    return out


MODEL_TEXTS = rf"""
titled AS (SELECT *, {TITLE} AS title FROM documents),
records AS (
  SELECT *, '{{"title": ' || CASE WHEN doc_id % 17 = 5 THEN CAST(doc_id AS VARCHAR) ELSE '"' || {esc_json('title')} || '"' END
    || ', "summary": "' || {esc_json('text')} || '"'
    || CASE doc_id % 19 WHEN 3 THEN ', "tags": null' WHEN 4 THEN ', "tags": ["a", ' || doc_id || ']'
       WHEN 5 THEN ', "tags": []' WHEN 6 THEN '' ELSE ', "tags": ["' || lang || '", "t' || (doc_id % 5) || '"]' END
    || ', "key_takeaways": ["keep ' || doc_id || '"]'
    || CASE doc_id % 11 WHEN 0 THEN ', "high_signal": true' WHEN 1 THEN ', "high_signal": "yes"'
       WHEN 2 THEN ', "high_signal": 1' WHEN 3 THEN ', "high_signal": 2' WHEN 4 THEN ', "high_signal": "off"' ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN ', "skill_candidate_reason": "why ' || doc_id || '"' ELSE '' END
    || ', "extra": {{"x": [1, 2]}}}}' AS record
  FROM titled),
said AS (
  SELECT doc_id, lang, title, text AS body, CASE
    WHEN doc_id % 6 = 1 THEN '```json' || chr(10) || record || chr(10) || '```'
    WHEN doc_id % 6 = 2 THEN 'Here it is: ' || record || ' Done.'
    WHEN doc_id % 6 = 3 THEN '<think>hm {{' || doc_id || '</think>' || chr(10) || record
    WHEN doc_id % 6 = 4 THEN '  ' || record || chr(10)
    WHEN doc_id % 30 = 5 THEN 'no record ' || doc_id || ' {{here'
    WHEN doc_id % 30 = 11 THEN '<think>cut off ' || record
    WHEN doc_id % 30 = 17 THEN '[1, 2]'
    ELSE record END AS said
  FROM records),
plain AS (
  SELECT *, CASE WHEN contains(said, '</think>') THEN {strip("string_split(said, '</think>')[-1]")}
    WHEN contains(said, '<think>') THEN '' ELSE {strip('said')} END AS text
  FROM said)""".strip()

ITEMS = rf"""
items AS (
  SELECT CAST(doc_id AS VARCHAR) AS content_id, doc_id, 'https://example.com/doc/' || doc_id AS source_url,
    {START} + to_microseconds(doc_id * 1500000) AS created_at, {TITLE} AS title,
    'About ' || lang || ' "' || doc_id || '"' AS summary, lang, source, text,
    ['first ' || doc_id, 'second'] AS takeaways,
    CASE WHEN doc_id % 8 = 0 THEN 'reason ' || doc_id WHEN doc_id % 8 = 4 THEN '' END AS why
  FROM documents)""".strip()


def slug(x: str) -> str:
    dashed = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif(rtrim(substr({dashed}, 1, 60), '-'), ''), 'untitled')"


NOTE = rf"""
notes AS (
  SELECT content_id, doc_id, title, '---' || chr(10) || 'title: ' || CAST(to_json(title) AS VARCHAR) || chr(10)
    || 'source_url: "' || source_url || '"' || chr(10) || 'content_id: "' || content_id || '"' || chr(10)
    || 'created_at: "' || {iso('created_at')} || '"' || chr(10)
    || 'tags: ["' || lang || '","n' || (doc_id % 5) || '"]' || chr(10)
    || 'tools_mentioned: ' || CASE WHEN doc_id % 2 = 0 THEN '["' || source || '"]' ELSE '[]' END || chr(10)
    || 'high_signal: ' || CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END || chr(10) || '---' || chr(10) || chr(10)
    || '# ' || title || chr(10) || chr(10) || '## Summary' || chr(10) || summary || chr(10) || chr(10)
    || '## Key Takeaways' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '- (none extracted)'
       ELSE '- first ' || doc_id || chr(10) || '- second' END || chr(10) || chr(10)
    || '## Tools Mentioned' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- ' || source ELSE '- (none mentioned)' END
    || chr(10) || chr(10)
    || CASE WHEN doc_id % 8 = 0 THEN '## Skill Candidate' || chr(10) || why || chr(10) || chr(10) ELSE '' END
    || '## Transcript' || chr(10) || chr(10) || text || chr(10) AS content
  FROM items)""".strip()
