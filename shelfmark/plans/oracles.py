"""DuckDB SQL for the registered queries, written over the given tables.

``_TABLES`` repeats the rules of ``tables.py`` as common table expressions; every query
names the ones it needs.
"""

from __future__ import annotations

from shelfmark.plans.tables import QUERIES

_LISTS = {
    "tags": "'[\"' || source || '\", \"lang:' || lang || '\"]'",
    "modalities": "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 3 = 0 "
                  "THEN '[\"image\", \"text\"]' ELSE '[\"text\"]' END",
    "languages": "'[\"' || lang || '\"]'",
}


def _choose(column: str, *options: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {column} % {len(options)} {cases} END"


def _lit(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


_Q = ",\n".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in QUERIES)
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_SIZES = "['n<1K','1K<n<10K','10K<n<100K','100K<n<1M','1M<n<10M','10M<n<100M','n>100M']"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"

_DATASETS = f"""
datasets0 AS (
  SELECT *, 'ds/' || doc_id AS id, CAST(doc_id AS VARCHAR) AS ns_local_id,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
    nullif(split_part(text, chr(10), 2), '') AS description,
    {_LISTS['tags']} AS tags, {_LISTS['modalities']} AS modalities, {_LISTS['languages']} AS languages,
    {_choose('doc_id', "'mit'", "'apache-2.0'", "'cc-by-4.0'", "'proprietary'", 'NULL')} AS license_class,
    CASE WHEN doc_id % 7 = 0 THEN 'private' ELSE 'public' END AS access_class,
    CASE WHEN n_chars < 200 THEN 'n<1K' WHEN n_chars < 500 THEN '1K<n<10K'
         WHEN n_chars < 1000 THEN '10K<n<100K' WHEN n_chars < 2000 THEN '100K<n<1M'
         WHEN n_chars < 4000 THEN '1M<n<10M' WHEN n_chars < 8000 THEN '10M<n<100M'
         ELSE 'n>100M' END AS size_class,
    CASE WHEN doc_id % 11 <> 0 THEN {_AS_OF} - to_hours(CAST(doc_id % 500 AS INT)) END AS last_seen_lm,
    {_AS_OF} - to_hours(CAST(doc_id % 72 AS INT)) AS indexed_at,
    CAST(len({_WORDS.format('text')}) AS INT) AS readme_tokens,
    '{{"downloads":' || {_choose('doc_id',
        "CAST(doc_id * 37 % 1000 AS VARCHAR)", "'\"' || (doc_id % 90) || '\"'",
        "(doc_id % 70) || '.5'", "'true'", "'null'", "CAST(doc_id * 37 % 1000 AS VARCHAR)",
        "CAST(doc_id % 333 AS VARCHAR)")} || ',"likes":' || (doc_id % 50) || '}}' AS quality_signals
  FROM documents
),
datasets AS (
  SELECT *, least(1.0, ln(1 + readme_tokens) / ln(401)) AS readme_score,
    TRY_CAST(json_extract(quality_signals, '$.downloads') AS BIGINT) AS downloads,
    sha256(source || '|' || ns_local_id || '|' || sha256(text) || '|' ||
      coalesce({_ISO.format('last_seen_lm')} || '+00:00', '') || '|' || size_class || '|' ||
      coalesce(license_class, '')) AS fingerprint,
    lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), text,
      coalesce(tags, ''), coalesce(modalities, ''), coalesce(languages, ''))) AS content
  FROM datasets0
)"""

_LISTED_CONTENT = "lower(concat_ws(' ', coalesce(title, ''), '', '', tags, '', ''))"

_TABLES = {
    "datasets": ((), _DATASETS),
    "artifacts": ((), f"""
artifacts AS (
  SELECT 'ds/' || doc_id AS dataset_id, kind,
    CASE WHEN doc_id % 5 <> 0 THEN '{{"dataset_id":"ds/' || doc_id || '","kind":"' || kind || '"}}' END AS payload,
    {_AS_OF} - to_hours(CAST(doc_id % 30 * 24 AS INT)) AS created_at,
    CASE WHEN doc_id % 19 <> 0 THEN toxic = 1 END AS stale, doc_id
  FROM labels, (VALUES ('schema'), ('snips')) k(kind) WHERE kind = 'schema' OR quality = 0
)"""),
    "jobs": ((), f"""
jobs0 AS (
  SELECT *, 'job-' || event_id AS id, 'ds/' || user_id AS dataset_id,
    {_choose('event_id', "'schema'", "'schema'", "'schema'", "'snips'")} AS kind,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'error'
      WHEN 'click' THEN 'queued' ELSE 'running' END AS state
  FROM events
),
jobs AS (
  SELECT id, dataset_id, kind, state, CAST(event_id % 4 AS INT) AS attempts,
    CASE WHEN state = 'error' THEN {_choose('event_id', "'timeout'", "'rate_limited'", "'network'", "'parse_error'", "'unknown'")} END AS error_class,
    CASE WHEN state = 'error' THEN props END AS error_detail,
    1500 AS budget_ms, 200 AS row_cap, ts AS enqueued_at,
    CASE WHEN state <> 'queued' THEN ts + INTERVAL 1 SECOND END AS started_at,
    CASE WHEN state IN ('done', 'error')
      THEN ts + INTERVAL 1 SECOND + to_microseconds(CAST(round(value * 100000) AS BIGINT)) END AS finished_at,
    event_id
  FROM jobs0
)"""),
    "signals": ((), """
signals0 AS (
  SELECT 'sig-' || event_id AS id, 'u' || user_id AS session_id, CAST(user_id AS VARCHAR) AS user_id,
    event_type AS event, 'ds/' || user_id AS dataset_id,
    CASE WHEN event_type = 'view' THEN props END AS query,
    CAST(json_extract(props, '$.k') AS INT) AS rank, ts AS created_at
  FROM events
),
signals AS (SELECT * FROM signals0 WHERE event IN ('view', 'click'))"""),
    "listing": ((), f"""
listing AS (
  SELECT CASE WHEN doc_id % 9 = 0 THEN 'doc-' ELSE 'ds/' END || doc_id AS id,
    CASE WHEN doc_id % 29 = 0 THEN 'not a date' WHEN doc_id % 31 = 0 THEN NULL
      ELSE strftime({_AS_OF} - to_hours(CAST(doc_id * 7 % 700 AS INT)), '%Y-%m-%dT%H:%M:%S') ||
        {_choose('doc_id', "'.250Z'", "'+02:00'", "''", "'Z'")} END AS last_modified,
    CASE WHEN doc_id % 29 = 0 OR doc_id % 31 = 0 THEN NULL ELSE
      {_AS_OF} - to_hours(CAST(doc_id * 7 % 700 AS INT)) +
        {_choose('doc_id', "INTERVAL 250 MILLISECOND", "INTERVAL (-2) HOUR", "INTERVAL 0 HOUR", "INTERVAL 0 HOUR")} END AS lm,
    '["' || source || '"]' AS tags, {_choose('doc_id', "'mit'", "''", 'NULL', "'proprietary'")} AS license,
    doc_id % 7 = 0 AS private, doc_id * 37 % 1000 AS downloads,
    CASE WHEN doc_id % 6 <> 0 THEN doc_id % 50 END AS likes, doc_id % 5 = 0 AS gated,
    split_part(text, chr(10), 1) AS card_title, doc_id % 2 = 0 AS has_card
  FROM documents
  UNION ALL BY NAME
  SELECT 'page-' || page_id AS id,
    strftime({_AS_OF} - to_hours(CAST(page_id % 24 AS INT)), '%Y-%m-%dT%H:%M:%SZ') AS last_modified,
    {_AS_OF} - to_hours(CAST(page_id % 24 AS INT)) AS lm
  FROM pages
),
timed AS (SELECT * FROM listing WHERE lm IS NOT NULL),
listed AS (
  SELECT id, 'hf' AS source, CASE WHEN contains(id, '/') THEN substr(id, strpos(id, '/') + 1) ELSE id END AS ns_local_id,
    CASE WHEN has_card THEN card_title ELSE id END AS title, coalesce(tags, '[]') AS tags,
    nullif(license, '') AS license_class,
    CASE WHEN private THEN 'private' ELSE 'public' END AS access_class, lm AS last_seen_lm,
    sha256('hf|' || CASE WHEN contains(id, '/') THEN substr(id, strpos(id, '/') + 1) ELSE id END || '||' ||
      strftime(lm, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(lm) % 1000000 = 0 THEN '' ELSE strftime(lm, '.%f') END ||
      '+00:00||' || coalesce(license, '')) AS fingerprint,
    {_AS_OF} AS indexed_at, 0 AS readme_tokens, 0.0::DOUBLE AS readme_score, downloads, likes,
    CAST(gated AS VARCHAR) AS gated
  FROM timed
)"""),
    "batch": (("datasets",), f"""
stored AS (
  SELECT * REPLACE (CASE WHEN doc_id % 23 <> 0 THEN fingerprint END AS fingerprint) FROM datasets
),
batch0 AS (
  SELECT d.id, d.source, coalesce(d.title, '') || ' v' || turn AS title,
    CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN sha256(d.fingerprint || 'v2') ELSE d.fingerprint END AS fingerprint,
    d.license_class, d.readme_tokens, d.last_seen_lm, md5(d.text) AS readme_md5, d.doc_id * 2 + turn AS batch_pos
  FROM datasets d JOIN labels l ON l.doc_id = d.doc_id, (VALUES (0), (1)) t(turn)
  WHERE turn = 0 OR toxic = 1
  UNION ALL BY NAME
  SELECT 'page/' || page_id AS id, 'web' AS source, url AS title, md5(html) AS fingerprint,
    -page_id - 1 AS batch_pos
  FROM pages
),
compared AS (
  SELECT b.*, s.fingerprint AS old_fp,
    CASE WHEN s.fingerprint IS NULL THEN 'dataset.discovered'
         WHEN b.fingerprint IS DISTINCT FROM s.fingerprint THEN 'dataset.changed' END AS type
  FROM batch0 b LEFT JOIN stored s USING (id)
),
latest AS (
  SELECT * FROM batch0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_pos DESC) = 1
),
merged AS (
  SELECT id, source, title, fingerprint, license_class, readme_tokens, last_seen_lm, md5(text) AS readme_md5
  FROM stored WHERE id NOT IN (SELECT id FROM latest)
  UNION ALL BY NAME SELECT * EXCLUDE (batch_pos) FROM latest
)"""),
    "requests": (("datasets", "artifacts"), f"""
requests AS (
  SELECT 'req-' || event_id AS request_id, 'ds/' || event_id AS dataset_id,
    CASE WHEN event_type = 'view' THEN 'snips' ELSE 'schema' END AS kind,
    {_choose('event_id', '1000', '2000', 'NULL', '0')} AS budget_ms,
    {_choose('event_id', '100', 'NULL', '0', '150', '300')} AS row_cap
  FROM events
),
joined AS (
  SELECT r.request_id, r.dataset_id, r.kind,
    coalesce(nullif(r.budget_ms, 0), 1500) AS budget_ms, coalesce(nullif(r.row_cap, 0), 200) AS row_cap,
    a.stale, CASE WHEN a.dataset_id IS NOT NULL THEN true END AS has_artifact,
    CASE WHEN d.id IS NOT NULL THEN true END AS known, d.access_class, d.license_class, d.size_class
  FROM requests r LEFT JOIN artifacts a ON a.dataset_id = r.dataset_id AND a.kind = r.kind
  LEFT JOIN datasets d ON d.id = r.dataset_id
),
judged AS (
  SELECT *,
    CASE WHEN known IS NULL THEN 'not_applicable' WHEN access_class <> 'public' THEN 'gated_private'
      WHEN license_class = 'proprietary' THEN 'license_denied'
      WHEN list_position({_SIZES}, size_class) > 5 THEN 'size_exceeded'
      WHEN budget_ms > 1500 OR row_cap > 200 THEN 'time_budget_exceeded' END AS reason_ceiling,
    CASE WHEN known IS NULL THEN 'not_applicable' WHEN access_class <> 'public' THEN 'gated_private'
      WHEN license_class = 'proprietary' THEN 'license_denied'
      WHEN budget_ms > 1500 OR row_cap > 200 THEN 'time_budget_exceeded' END AS reason
  FROM joined
),
routed AS (
  SELECT *, CASE WHEN has_artifact AND NOT coalesce(stale, false) THEN 'cached'
    WHEN reason IS NULL THEN 'queued' ELSE 'blocked' END AS route FROM judged
)"""),
    "sample": ((), """
sample AS (
  SELECT event_type AS dataset_id, event_id AS row_idx,
    '{"event_id":' || event_id ||
    CASE WHEN event_id % 3 = 0 THEN ',"user":"u' || user_id || '"' ELSE '' END || ',"value":' ||
    CASE WHEN event_id % 10 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN '"' || value || '"' ELSE CAST(value AS VARCHAR) END ||
    ',"flag":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ||
    ',"list":[' || event_id || ',1],"props":' || props || '}' AS body
  FROM events WHERE event_id % 23 <> 0
),
fields AS (
  SELECT s.dataset_id, s.row_idx, k.key AS name,
    json_extract(s.body, '$.' || k.key) AS v,
    list_position(json_keys(s.body), k.key) AS pos
  FROM sample s, unnest(json_keys(s.body)) k(key)
),
typed AS (
  SELECT *, CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int64'
    WHEN 'BIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' WHEN 'VARCHAR' THEN 'string'
    WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'struct' ELSE 'unknown' END AS dtype,
    row_number() OVER (PARTITION BY dataset_id, name ORDER BY row_idx) AS rn
  FROM fields
)"""),
    "queries": (("datasets",), f"""
queries(query_id, query, modality, license_class, size_class, language, page_limit, page_offset) AS (VALUES
{_Q}
),
words AS (
  SELECT query_id, token, count(*) AS weight
  FROM (SELECT query_id, unnest({_WORDS.format('lower(query)')}) AS token FROM queries) GROUP BY ALL
),
like_pairs AS (
  SELECT w.query_id, w.token, w.weight, d.id FROM words w JOIN datasets d ON d.content LIKE '%' || w.token || '%'
),
like_scored AS (SELECT query_id, id, sum(weight)::BIGINT AS score FROM like_pairs GROUP BY ALL)"""),
    "index": (("datasets",), r"""
termed AS (SELECT id, regexp_extract_all(content, '[\p{L}\p{N}]+') AS terms FROM datasets),
sized AS (SELECT id, CAST(len(terms) AS INT) AS dl FROM termed),
postings AS (
  SELECT term, id, CAST(count(*) AS INT) AS tf, any_value(dl) AS dl
  FROM (SELECT id, unnest(terms) AS term FROM termed) JOIN sized USING (id) GROUP BY term, id
),
corpus AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM sized)"""),
    "bm25": (("index", "queries"), r"""
query_terms AS (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM queries
),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
ranked AS (
  SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 /
    (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM query_terms JOIN postings USING (term) JOIN frequency USING (term), corpus GROUP BY ALL
)"""),
    "hits": (("datasets",), """
hits AS (
  SELECT id, (CASE WHEN content LIKE '%tion%' THEN 1 ELSE 0 END + CASE WHEN content LIKE '%der%' THEN 1 ELSE 0 END) AS score
  FROM datasets WHERE content LIKE '%tion%' OR content LIKE '%der%'
)"""),
    "fresh": (("artifacts",), """
fresh AS (SELECT DISTINCT dataset_id FROM artifacts WHERE kind = 'schema' AND stale = FALSE)"""),
    "metrics": (("datasets", "artifacts", "jobs", "fresh"), f"""
durations AS (
  SELECT epoch_us(finished_at) - epoch_us(started_at) AS us,
    row_number() OVER (ORDER BY epoch_us(finished_at) - epoch_us(started_at)) AS rn, count(*) OVER () AS n
  FROM jobs WHERE state = 'done' AND finished_at IS NOT NULL AND started_at IS NOT NULL
),
p95 AS (
  SELECT coalesce(max(us) / 1000.0::DOUBLE, 0.0) AS resolve_p95_ms FROM durations
  WHERE rn = greatest(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), 1)
),
cover AS (
  SELECT count(*) AS public_total, count(f.dataset_id) AS covered
  FROM datasets d LEFT JOIN fresh f ON f.dataset_id = d.id WHERE access_class = 'public'
),
report AS (
  SELECT
    (SELECT round(count(*) FILTER (indexed_at >= {_AS_OF} - INTERVAL 1 DAY) / count(*) * 100, 6) FROM datasets) AS freshness_pct,
    (SELECT round(count(*) FILTER (readme_tokens IS NULL OR readme_tokens < 50 OR readme_score < 0.35) / count(*) * 100, 6) FROM datasets) AS thin_readme_pct,
    (SELECT round(resolve_p95_ms, 6) FROM p95) AS resolve_p95_ms,
    (SELECT count(*) FROM jobs WHERE state = 'queued') AS queue_depth,
    (SELECT greatest(public_total - covered, 0) FROM cover) AS public_no_schema_count,
    (SELECT round(covered / public_total * 100, 6) FROM cover) AS public_with_schema_pct,
    (SELECT '{{' || string_agg('"' || state || '":' || n, ',' ORDER BY state) || '}}' FROM (SELECT state, count(*) AS n FROM jobs GROUP BY state)) AS jobs_by_state,
    (SELECT '{{' || string_agg('"' || error_class || '":' || n, ',' ORDER BY error_class) || '}}'
     FROM (SELECT error_class, count(*) AS n FROM jobs WHERE error_class IS NOT NULL GROUP BY error_class)) AS error_taxonomy
)"""),
    "sig": (("signals",), f"""
sig AS (
  SELECT dataset_id, count(*) AS sig_score FROM signals
  WHERE created_at >= {_AS_OF} - INTERVAL 7 DAY GROUP BY dataset_id
)"""),
    "candidates": (("datasets", "fresh", "sig"), """
candidates AS (
  SELECT d.id, coalesce(sig_score, 0) AS sig_score, d.downloads, d.last_seen_lm
  FROM datasets d LEFT JOIN sig ON sig.dataset_id = d.id
  WHERE d.access_class = 'public' AND (readme_tokens IS NULL OR readme_tokens < 50 OR readme_score < 0.35)
    AND d.id NOT IN (SELECT dataset_id FROM fresh)
  ORDER BY sig_score DESC, d.downloads DESC NULLS LAST, d.last_seen_lm DESC NULLS LAST, d.id
)"""),
    "failures": ((), """
failures AS (
  SELECT *, CASE event_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_status' WHEN 2 THEN 'http_status'
      WHEN 3 THEN 'connection' WHEN 4 THEN 'value' ELSE 'other' END AS failure,
    CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 600 END AS status
  FROM events
),
classified AS (
  SELECT *, CASE WHEN failure = 'timeout' THEN 'timeout' WHEN failure = 'http_status' AND status = 429 THEN 'rate_limited'
    WHEN failure = 'http_status' AND status >= 500 AND status < 600 THEN 'network' WHEN failure = 'connection' THEN 'network'
    WHEN failure = 'value' THEN 'parse_error' ELSE 'unknown' END AS new_class
  FROM failures
)"""),
}


def _with(names: str, body: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for needed in _TABLES[name][0]:
                add(needed)
            done.append(name)

    for name in names.split():
        add(name)
    if not done:
        return body
    return "WITH " + ",".join(_TABLES[n][1] for n in done) + "\n" + body


_WHY = "array_to_string(list_filter({tokens}, lambda t: contains(content, t)), '|')"


def _json_why(tokens: str) -> str:
    kept = f"list_filter({tokens}, lambda t: contains(content, t))"
    return (
        f"CASE WHEN len({kept}) = 0 THEN '[]' ELSE '[\"' || array_to_string({kept}, '\", \"') || '\"]' END"
    )


_HIT = """d.id, title, description, md5(text) AS readme_text, license_class, access_class, size_class,
  coalesce(modalities, '[]') AS modalities, coalesce(languages, '[]') AS languages, coalesce(tags, '[]') AS tags,
  json_extract_string(quality_signals, '$.downloads') AS downloads,
  json_extract_string(quality_signals, '$.likes') AS likes, CAST(NULL AS VARCHAR) AS blocked_reason"""

_ELIGIBLE = """
  JOIN queries q USING (query_id) JOIN datasets d USING (id)
  WHERE (coalesce(q.license_class, '') = '' OR d.license_class = q.license_class)
    AND (coalesce(q.size_class, '') = '' OR d.size_class = q.size_class)
    AND (coalesce(q.modality, '') = '' OR d.modalities LIKE '%' || lower(q.modality) || '%')
    AND (coalesce(q.language, '') = '' OR d.languages LIKE '%' || lower(q.language) || '%')"""

_BATCH_RESULT = f"""
page AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn,
    count(*) OVER (PARTITION BY query_id) AS total FROM eligible
  QUALIFY rn > page_offset AND rn <= page_offset + page_limit
)
SELECT query_id, CAST(rn AS INT) AS rn, total, p.id, d.title, score, {_json_why(_WORDS.format('lower(query)'))} AS why,
  CASE WHEN f.dataset_id IS NULL THEN 0 ELSE 1 END AS has_schema, d.license_class, d.access_class, d.size_class,
  d.modalities, d.languages, d.tags
FROM page p JOIN datasets d USING (id) LEFT JOIN fresh f ON f.dataset_id = p.id"""


def _search_single(scored: str, tokens: str, where: str, limit: int, offset: int) -> str:
    return f"""
, eligible AS (SELECT s.id, s.score FROM ({scored}) s JOIN datasets d USING (id) {where})
SELECT {_HIT}, CASE WHEN f.dataset_id IS NULL THEN 0 ELSE 1 END AS has_schema, e.score,
  {_json_why(tokens)} AS why, (SELECT count(*) FROM eligible) AS total
FROM (SELECT * FROM eligible ORDER BY score DESC, id LIMIT {limit} OFFSET {offset}) e
JOIN datasets d USING (id) LEFT JOIN fresh f ON f.dataset_id = d.id"""


def _doc_score(expression: str) -> str:
    return (
        f"SELECT doc_id, round({expression}, 9) AS score FROM "
        f"(SELECT doc_id, len({_WORDS.format('text')}) AS n FROM documents)"
    )


_INFO = """
WITH info AS (
  SELECT doc_id, 'ds/' || doc_id AS dataset_id,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN '[{"name":"f' || doc_id || '","dtype":"string"}]'
      WHEN doc_id % 6 = 1 THEN '[{"name":"top"}]' END AS features,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'c' || (doc_id % 3)
      WHEN doc_id % 5 = 0 THEN 'main' ELSE 'c0' END AS config,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'train' ELSE 'test' END AS split
  FROM labels
),
cards AS (
  SELECT 'ds/' || doc_id AS dataset_id,
    CASE doc_id % 3 WHEN 0 THEN '[{"name":"text","dtype":"string"},{"name":"label","dtype":"int64"}]'
      WHEN 1 THEN '[{"name":"c' || doc_id || '"}]' END AS features
  FROM labels
)"""

_LINES = r"""
WITH readmes AS (
  SELECT doc_id, CASE lang WHEN 'de' THEN chr(10) || '## Titel #' || source || ' ' || chr(13) || chr(10) || text
    WHEN 'fr' THEN '###' || chr(10) || replace(text, chr(10), chr(10) || '# ') ELSE text END AS readme
  FROM documents
),
lines AS (
  SELECT doc_id, i, trim(line, E' \t\r\n') AS line
  FROM (SELECT doc_id, unnest(str_split(readme, chr(10))) AS line, generate_subscripts(str_split(readme, chr(10)), 1) AS i FROM readmes)
),
marked AS (
  SELECT *, starts_with(line, '#') AS heading,
    CASE WHEN starts_with(line, '#') THEN nullif(trim(ltrim(line, '#'), E' \t\r\n'), '') END AS heading_text,
    max(CASE WHEN starts_with(line, '#') THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last_heading
  FROM lines WHERE line <> ''
),
titled AS (
  SELECT m.*, h.heading_text AS title_above FROM marked m
  LEFT JOIN marked h ON h.doc_id = m.doc_id AND h.i = m.last_heading
),
ends AS (
  SELECT doc_id, coalesce(min(CASE WHEN NOT heading AND title_above IS NOT NULL THEN i END), max(i)) AS stop
  FROM titled GROUP BY doc_id
)
SELECT d.doc_id, max(CASE WHEN t.i = e.stop THEN t.title_above END) AS title,
  arg_min(t.line, t.i) FILTER (NOT t.heading AND t.i <= e.stop) AS description
FROM documents d LEFT JOIN ends e USING (doc_id) LEFT JOIN titled t USING (doc_id) GROUP BY d.doc_id"""


_FIRST = "ORDER BY last_seen_lm, id LIMIT 500"


def _last(days: int) -> str:
    return f"AND last_seen_lm >= {_AS_OF} - INTERVAL {days} DAY"


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(key: str, names: str, body: str) -> None:
        sql[key] = _with(names, body)

    # Sources and sinks
    add("load_catalog", "datasets artifacts", f"""
SELECT id, source, id AS ns_local_id, access_class, 'fixture:' || id AS fingerprint, {_AS_OF} AS indexed_at,
  readme_tokens, round(least(readme_tokens / 50.0::DOUBLE, 1.0), 9) AS readme_score,
  id IN (SELECT dataset_id FROM artifacts WHERE kind = 'schema') AS has_schema,
  CASE WHEN id IN (SELECT dataset_id FROM artifacts WHERE kind = 'schema') THEN coalesce(
    (SELECT string_agg(payload, '|' ORDER BY payload) FROM artifacts a WHERE a.dataset_id = datasets.id), '') END AS payloads, md5(text) AS readme_md5
FROM datasets""")
    sql["conform_schema"] = """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS dataset_id, CAST(NULL AS VARCHAR) AS kind,
  event_type AS state, CAST(trunc(value) AS INT) AS attempts, CAST(NULL AS VARCHAR) AS error_class,
  CAST(NULL AS VARCHAR) AS error_detail, CAST(NULL AS INT) AS budget_ms, CAST(NULL AS INT) AS row_cap,
  ts AS enqueued_at, CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at
FROM events"""
    for key, window, limit in (
        ("ingest_listing", "", _FIRST), ("ingest_listing_all", "", ""), ("ingest_backfill", _last(3), ""),
    ):
        add(key, "listing", f"""
, top AS (
  SELECT l.* FROM listed l
  WHERE (last_seen_lm > TIMESTAMP '2024-01-21' OR (last_seen_lm = TIMESTAMP '2024-01-21' AND id > 'ds/5')) {window}
  {limit}
)
SELECT id, title, fingerprint, last_seen_lm, access_class, license_class,
  (SELECT last_seen_lm FROM top ORDER BY last_seen_lm DESC, id DESC LIMIT 1) AS cursor_lm,
  (SELECT id FROM top ORDER BY last_seen_lm DESC, id DESC LIMIT 1) AS cursor_id
FROM top""")
    for key, window, limit in (
        ("discovery_job", "", _FIRST), ("discovery_full", "", ""), ("discovery_backfill", _last(7), ""),
    ):
        add(key, "listing datasets artifacts", f"""
, top AS (
  SELECT l.* FROM listed l
  WHERE (last_seen_lm > TIMESTAMP '2024-01-21' OR (last_seen_lm = TIMESTAMP '2024-01-21' AND id > 'ds/5')) {window}
  {limit}
)
SELECT 'doc' AS part, id, md5(content) AS detail FROM datasets WHERE id NOT IN (SELECT id FROM top)
UNION ALL SELECT 'doc', id, md5({_LISTED_CONTENT}) FROM top
UNION ALL SELECT 'event', t.id, CASE WHEN d.fingerprint IS NULL THEN 'dataset.discovered' ELSE 'dataset.changed' END
FROM top t LEFT JOIN datasets d USING (id) WHERE t.fingerprint IS DISTINCT FROM d.fingerprint
UNION ALL SELECT 'stale', dataset_id, kind FROM artifacts
WHERE stale OR dataset_id IN (SELECT id FROM top JOIN datasets d USING (id) WHERE top.fingerprint <> d.fingerprint)
UNION ALL SELECT 'dataset', id, fingerprint FROM datasets WHERE id NOT IN (SELECT id FROM top)
UNION ALL SELECT 'dataset', id, fingerprint FROM top
UNION ALL SELECT 'cursor', arg_max(id, (last_seen_lm, id)), strftime(max(last_seen_lm), '%Y-%m-%d %H:%M:%S') FROM top""")
    for key, window, limit in (("update_index", "", _FIRST), ("index_after_updates", "", "")):
        add(key, "listing datasets", rf"""
, top AS (
  SELECT l.* FROM listed l
  WHERE (last_seen_lm > TIMESTAMP '2024-01-21' OR (last_seen_lm = TIMESTAMP '2024-01-21' AND id > 'ds/5')) {window}
  {limit}
),
after AS (
  SELECT id, content FROM datasets WHERE id NOT IN (SELECT id FROM top) UNION ALL SELECT id, {_LISTED_CONTENT} FROM top
),
termed AS (SELECT id, regexp_extract_all(content, '[\p{{L}}\p{{N}}]+') AS terms FROM after),
posted AS (
  SELECT term, id, CAST(count(*) AS INT) AS tf, CAST(any_value(dl) AS INT) AS dl
  FROM (SELECT id, unnest(terms) AS term, len(terms) AS dl FROM termed) GROUP BY term, id
)
SELECT term, id AS dataset_id, tf, dl, count(*) OVER (PARTITION BY term) AS df, CAST(NULL AS DOUBLE) AS avgdl FROM posted
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*), round(avg(len(terms)), 6) FROM termed""")
    add("index_terms", "index", """
SELECT term, count(*) AS df, CAST(NULL AS DOUBLE) AS avgdl FROM postings GROUP BY term
UNION ALL SELECT NULL, docs, round(avgdl, 6) FROM corpus""")
    add("like_match_many", "datasets", f"""
, tokens AS (SELECT DISTINCT unnest({_WORDS.format('lower(text)')}) AS token FROM benchmark)
SELECT token, id AS dataset_id FROM tokens JOIN datasets ON content LIKE '%' || token || '%'""")
    sql["append_events"] = f"""
SELECT 'old-' || event_id AS id, event_type AS type, CAST(NULL AS VARCHAR) AS dataset_id, '{{}}' AS payload, ts AS created_at FROM events
UNION ALL
SELECT 'new-' || event_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END, 'ds/' || user_id,
  '{{"user_id":' || user_id || ',"rank":' || CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) ELSE 'null' END || '}}',
  CASE WHEN user_id > 50 THEN ts ELSE {_AS_OF} END FROM events"""
    add("append_signals", "signals", f"""
SELECT * FROM signals UNION ALL
SELECT * REPLACE (CASE WHEN event = 'error' THEN {_AS_OF} ELSE created_at END AS created_at)
FROM signals0 WHERE id NOT IN (SELECT id FROM signals)""")

    # Filters, lookups, projections
    add("filter_license", "datasets", "SELECT id, license_class FROM datasets WHERE license_class = 'mit'")
    add("filter_size", "datasets", "SELECT id, size_class FROM datasets WHERE size_class = '1M<n<10M'")
    add("filter_modality", "datasets", "SELECT id, modalities FROM datasets WHERE modalities LIKE '%mage%'")
    add("filter_language", "datasets", """
SELECT id, languages, 'like' AS mode FROM datasets WHERE languages LIKE '%e%'
UNION ALL SELECT id, languages, 'exact' FROM datasets WHERE lang = 'en'""")
    add("lookup_datasets", "requests", """
SELECT id, title, license_class, readme_tokens, last_seen_lm FROM datasets
WHERE id IN (SELECT dataset_id FROM requests)""")
    add("lookup_artifacts", "requests", """
SELECT dataset_id, kind, coalesce(payload, '{}') AS payload, created_at, stale FROM artifacts
WHERE NOT coalesce(stale, false) AND (dataset_id, kind) IN (SELECT dataset_id, kind FROM requests)""")
    add("thin_readme", "datasets", """
SELECT id, readme_tokens FROM datasets WHERE readme_tokens IS NULL OR readme_tokens < 50
  OR CASE WHEN doc_id % 6 <> 0 THEN readme_score END < 0.35""")
    add("fresh_artifacts", "artifacts", """
SELECT dataset_id, kind, created_at FROM artifacts WHERE kind = 'schema' AND stale = FALSE""")
    sql["recency_filter"] = f"""
SELECT event_id, ts > {_AS_OF} - INTERVAL 1 DAY AS last_day FROM events WHERE ts >= {_AS_OF} - INTERVAL 7 DAY"""
    add("search_hit_projection", "datasets", f"SELECT {_HIT} FROM datasets d")
    add("display_description", "datasets", """
SELECT id, coalesce(nullif(title, ''), id) AS shown_title,
  coalesce(nullif(description, ''), CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE nullif(text, '') END, 'No description') AS shown_text,
  source || ', lang:' || lang AS shown_tags FROM datasets""")
    add("size_label", "datasets", """
SELECT id, CASE size_class WHEN 'n<1K' THEN '< 1K rows' WHEN '1K<n<10K' THEN '1K–10K rows'
  WHEN '10K<n<100K' THEN '10K–100K rows' WHEN '100K<n<1M' THEN '100K–1M rows' WHEN '1M<n<10M' THEN '1M–10M rows'
  WHEN '10M<n<100M' THEN '10M–100M rows' WHEN 'n>100M' THEN '> 100M rows' ELSE size_class END AS label FROM datasets""")

    # Joins
    add("join_search_catalog", "datasets", "SELECT id, title, CAST(length(content) AS INT) AS content_chars FROM datasets")
    add("schema_flag", "datasets fresh", """
SELECT id, CASE WHEN f.dataset_id IS NULL THEN 0 ELSE 1 END AS has_schema FROM datasets d LEFT JOIN fresh f ON f.dataset_id = d.id""")
    state = f"""
SELECT d.id, max(CASE WHEN a.kind = 'schema' AND NOT a.stale THEN 1 ELSE 0 END) AS has_schema,
  max(CASE WHEN a.kind = 'snips' AND NOT a.stale THEN 1 ELSE 0 END) AS has_snips,
  max(CASE WHEN j.state = 'error' THEN 1 ELSE 0 END) AS recent_errors, {{extra}}
FROM datasets d LEFT JOIN artifacts a ON a.dataset_id = d.id
LEFT JOIN jobs j ON j.dataset_id = d.id AND j.enqueued_at > {_AS_OF} - INTERVAL 7 DAY GROUP BY d.id"""
    add("state_view_join", "datasets artifacts jobs", state.format(
        extra="count(DISTINCT a.kind) AS artifacts, count(DISTINCT j.id) AS recent_jobs"))
    add("dataset_state", "datasets artifacts jobs", state.format(extra=f"{_AS_OF} AS last_refreshed_at"))
    add("anti_no_schema", "datasets fresh", """
SELECT d.id FROM datasets d LEFT JOIN fresh f ON f.dataset_id = d.id WHERE f.dataset_id IS NULL""")
    add("signal_score_join", "datasets sig", """
SELECT d.id, coalesce(sig_score, 0) AS sig_score FROM datasets d LEFT JOIN sig ON sig.dataset_id = d.id""")
    add("fts_join", "bm25", "SELECT query_id, term, id AS dataset_id, tf FROM query_terms JOIN postings USING (term)")
    add("like_match_join", "queries", """
SELECT DISTINCT token, d.id AS dataset_id FROM words JOIN datasets d ON d.content LIKE '%' || token || '%'""")
    add("covered_public_join", "datasets fresh", """
SELECT id FROM datasets JOIN fresh ON dataset_id = id WHERE access_class = 'public'""")
    add("request_planning_join", "requests", """
SELECT request_id, dataset_id, kind, stale, has_artifact, known, license_class FROM joined""")

    # Aggregations
    add("job_counts_by_state", "jobs", "SELECT state, count(*) AS n FROM jobs GROUP BY state")
    add("error_taxonomy", "jobs", "SELECT error_class, count(*) AS n FROM jobs WHERE error_class IS NOT NULL GROUP BY error_class")
    for name in ("freshness_pct", "thin_readme_pct", "queue_depth", "resolve_p95_ms"):
        add(name, "metrics", f"SELECT {name} FROM report")
    add("schema_coverage", "metrics", """
SELECT public_total, covered AS public_with_schema, greatest(public_total - covered, 0) AS public_no_schema_count,
  round(covered / public_total * 100, 6) AS public_with_schema_pct FROM cover""")
    pause = """CASE WHEN resolve_p95_ms > 3000 THEN 'resolve_slow' WHEN queue_depth > {0} THEN 'queue_depth' END"""
    add("admin_metrics", "metrics", f"""
SELECT *, {pause.format(500)} AS prefetch_reason, {pause.format(500)} IS NOT NULL AS prefetch_paused FROM report""")
    add("signal_popularity", "sig", "SELECT * FROM sig")
    add("search_total", "hits", "SELECT count(*) AS total FROM hits")
    add("page_stats", "hits fresh", """
SELECT count(*) AS page_size, count(*) FILTER (coalesce(description, '') <> '') AS with_description,
  count(*) FILTER (text <> '') AS with_readme, count(*) FILTER (access_class = 'public') AS public,
  count(*) FILTER (access_class <> 'public' AND access_class <> '') AS gated, count(f.dataset_id) AS with_schema
FROM datasets d SEMI JOIN hits h ON h.id = d.id LEFT JOIN fresh f ON f.dataset_id = d.id""")
    add("facet_values", "hits", """
, found AS (SELECT d.* FROM datasets d SEMI JOIN hits h ON h.id = d.id)
SELECT 'license' AS facet, license_class AS value, count(*) AS n FROM found WHERE license_class IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'size', size_class, count(*) FROM found GROUP BY ALL
UNION ALL SELECT 'language', lang, count(*) FROM found GROUP BY ALL
UNION ALL SELECT 'modality', m, count(*) FROM (SELECT unnest(from_json(modalities, '["VARCHAR"]')) AS m FROM found) GROUP BY ALL""")
    add("distinct_schema_ids", "fresh", "SELECT dataset_id FROM fresh")

    # Ordering
    add("assign_docid", "datasets", """
SELECT id, row_number() OVER (ORDER BY substr(md5(id), 1, 3), id) AS docid FROM datasets""")
    add("rank_hits", "hits", "SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 30 OFFSET 10")
    add("rank_hits_batch", "queries", """
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rn
FROM like_scored JOIN queries USING (query_id) QUALIFY rn > page_offset AND rn <= page_offset + page_limit""")
    add("prefetch_order", "datasets sig", """
SELECT d.id, last_seen_lm, downloads, coalesce(sig_score, 0) AS sig_score
FROM datasets d LEFT JOIN sig ON sig.dataset_id = d.id
ORDER BY coalesce(sig_score, 0) DESC, downloads DESC NULLS LAST, last_seen_lm DESC NULLS LAST, d.id LIMIT 50""")
    add("due_jobs", "jobs", "SELECT id, enqueued_at FROM jobs WHERE state = 'queued' ORDER BY enqueued_at, id LIMIT 100")

    # Scalar functions
    add("search_content", "datasets", "SELECT id, md5(content) AS content_md5 FROM datasets")
    sql["query_tokens"] = f"""
SELECT conv_id, turn, array_to_string({_WORDS.format('lower(text)')}, '|') AS tokens FROM conversations"""
    sql["token_count"] = f"SELECT doc_id, CAST(len({_WORDS.format('text')}) AS INT) AS tokens FROM documents"
    sql["readme_score_log"] = _doc_score("least(1.0, ln(1 + n) / ln(401))")
    sql["readme_score_linear"] = _doc_score("least(1.0, n / 50.0::DOUBLE)")
    sql["readme_headings"] = _LINES
    add("fingerprint", "datasets", "SELECT id, fingerprint FROM datasets")
    odd = r"""[lang, 'say \"hi\"', 'a\\b\té']"""
    sql["json_text_list"] = rf"""
SELECT doc_id, md5('["' || array_to_string(list_transform(list_concat(str_split(text, chr(10)), [lang, 'say "hi"', 'a\b' || chr(9) || 'é']),
    lambda s: substr(CAST(to_json(s) AS VARCHAR), 2, length(CAST(to_json(s) AS VARCHAR)) - 2)), '", "') || '"]') AS listed_md5,
  CASE WHEN doc_id % 3 > 0 THEN '["' || array_to_string({odd}, '", "') || '"]' END AS listed
FROM documents"""
    add("json_parse_list", "datasets", """
SELECT id, CASE WHEN access_class = 'public' AND coalesce(license_class, '') <> 'mit' THEN 2 END::BIGINT AS items,
  CASE WHEN access_class = 'public' AND coalesce(license_class, '') <> 'mit' THEN source || '|lang:' || lang END AS joined FROM datasets""")
    add("json_get_bigint", "datasets", """
SELECT id, downloads, TRY_CAST(json_extract(quality_signals, '$.likes') AS BIGINT) AS likes FROM datasets""")
    add("why_tokens", "datasets", f"""
SELECT id, {_WHY.format(tokens="['tion','der','the','tion','lang:en','zzz']")} AS why FROM datasets""")
    add("parse_last_modified", "listing", "SELECT id, lm FROM listing")
    sql["iso_format"] = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso,
  strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso_hour FROM events"""
    add("ns_local_id", "listing", """
SELECT id, CASE WHEN contains(id, '/') THEN substr(id, strpos(id, '/') + 1) ELSE id END AS local_id FROM listing""")
    add("size_rank", "datasets", f"""
SELECT id, CAST(CASE WHEN coalesce(license_class, '') = 'mit' OR access_class <> 'public' THEN -1
  ELSE list_position({_SIZES}, size_class) - 1 END AS INT) AS rank FROM datasets""")
    sql["truncate_detail"] = """
SELECT conv_id, turn, substr(text, 1, 500) AS event_detail, md5(substr(text, 1, 2000)) AS job_detail_md5 FROM conversations"""
    add("budget_flags", "requests", """
SELECT request_id, CAST(CASE WHEN greatest(coalesce(row_cap - 100, 0), 0) = 0 THEN 200 ELSE row_cap - 100 END AS INT) AS row_cap_applied,
  CAST(greatest(coalesce(budget_ms, 0), 0) AS INT) AS budget_ms_requested,
  coalesce(budget_ms, 0) > 0 AND length(request_id) * 150 > budget_ms AS budget_exhausted FROM requests""")
    add("access_class", "listing", """
SELECT id, CASE WHEN private THEN 'private' ELSE 'public' END AS access_class FROM listing""")

    # Search
    add("build_search_docs", "datasets", "SELECT id AS dataset_id, md5(content) AS content_md5 FROM datasets")
    add("search_like", "datasets hits fresh", _search_single("SELECT * FROM hits", "['tion','der']", "", 30, 0))
    add("search_bm25", "index fresh", r"""
, frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term)""" + _search_single("""
  SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 /
    (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN frequency USING (term), corpus WHERE term IN ('tion', 'der') GROUP BY id""",
        "['tion','der']", "WHERE d.modalities LIKE '%image%'", 20, 3))
    add("search_batch", "queries fresh", f"""
, eligible AS (SELECT query_id, id, score, page_limit, page_offset, query FROM like_scored {_ELIGIBLE}),
{_BATCH_RESULT}""")
    add("search_with_fallback", "bm25 fresh", f"""
, ranked_ok AS (SELECT query_id, id, score, page_limit, page_offset, query FROM ranked {_ELIGIBLE}),
eligible AS (
  SELECT * FROM ranked_ok UNION ALL
  SELECT query_id, id, CAST(score AS DOUBLE), page_limit, page_offset, query FROM like_scored {_ELIGIBLE}
    AND query_id NOT IN (SELECT query_id FROM ranked_ok)
),
{_BATCH_RESULT}""")
    add("build_inverted_index", "index", "SELECT term, id AS dataset_id, tf, dl FROM postings")

    # Ingest and upsert
    add("cursor_filter", "listing", """
SELECT id, lm FROM timed WHERE lm > TIMESTAMP '2024-01-21' OR (lm = TIMESTAMP '2024-01-21' AND id > 'ds/5')""")
    add("backfill_filter", "listing", f"SELECT id, lm FROM timed WHERE lm >= {_AS_OF} - INTERVAL 3 DAY")
    add("listing_top_n", "listing", "SELECT id, lm FROM timed ORDER BY lm DESC, id DESC LIMIT 500")
    add("listing_to_dataset", "listing", "SELECT * FROM listed")
    add("next_cursor", "listing", "SELECT lm, id FROM timed ORDER BY lm DESC, id DESC LIMIT 1")
    add("upsert_datasets", "batch", "SELECT * FROM merged")
    add("detect_changes", "batch", f"""
SELECT type, id AS dataset_id, {_AS_OF} AS created_at,
  CASE WHEN type = 'dataset.changed' THEN old_fp END AS fingerprint_old, fingerprint AS fingerprint_new
FROM compared WHERE type IS NOT NULL""")
    add("mark_stale", "batch artifacts", """
SELECT dataset_id, kind, CASE WHEN dataset_id IN (SELECT id FROM compared WHERE type = 'dataset.changed') THEN true ELSE stale END AS stale
FROM artifacts""")
    add("upsert_artifacts", "artifacts jobs", """
, newest AS (
  SELECT dataset_id, kind, '{"job":"' || id || '"}' AS payload, started_at AS created_at, false AS stale FROM jobs
  WHERE state = 'done' QUALIFY row_number() OVER (PARTITION BY dataset_id, kind ORDER BY event_id DESC) = 1
)
SELECT dataset_id, kind, payload, created_at, stale FROM artifacts
WHERE (dataset_id, kind) NOT IN (SELECT dataset_id, kind FROM newest) UNION ALL SELECT * FROM newest""")
    add("merge_connector_state", "datasets artifacts", """
, seen AS (SELECT * FROM datasets WHERE last_seen_lm IS NOT NULL),
old AS (
  SELECT source, max({'lm': last_seen_lm, 'id': id}) AS c, max(readme_tokens) AS qps_limit FROM seen GROUP BY source
),
new AS (
  SELECT source || CASE WHEN access_class = 'private' THEN '-p' ELSE '' END AS source, max({'lm': last_seen_lm, 'id': id}) AS c,
    CASE WHEN count(description) > 2 THEN 5 END AS qps_limit
  FROM seen WHERE license_class = 'mit' AND id IN (SELECT dataset_id FROM artifacts) GROUP BY 1
)
SELECT coalesce(n.source, o.source) AS source, coalesce(n.c, o.c).lm AS lm, coalesce(n.c, o.c).id AS seen_id,
  CAST(coalesce(n.qps_limit, o.qps_limit) AS INT) AS qps_limit,
  CASE WHEN o.source IS NOT NULL THEN '{"wait":1}' END AS backoff_state
FROM old o FULL JOIN new n ON n.source = o.source""")

    # Policy, resolve, jobs
    add("policy_eval", "requests", "SELECT request_id, reason_ceiling IS NULL AS allow, reason_ceiling AS reason_code FROM judged")
    add("effective_budget", "requests", """
SELECT request_id, CAST(coalesce(nullif(budget_ms, 0), 1500) AS INT) AS budget_ms, CAST(coalesce(nullif(row_cap, 0), 200) AS INT) AS row_cap FROM requests""")
    add("plan_resolves", "requests", """
SELECT 'cached' AS part, request_id AS id, CAST(NULL AS VARCHAR) AS dataset_id, 'cached-' || dataset_id AS detail, CAST(NULL AS INT) AS budget_ms
FROM routed WHERE route = 'cached'
UNION ALL SELECT 'blocked', request_id, dataset_id, reason, NULL FROM routed WHERE route = 'blocked'
UNION ALL SELECT 'job', request_id, dataset_id, 'queued', budget_ms FROM routed WHERE route = 'queued'
UNION ALL SELECT 'event', request_id, dataset_id, 'dataset.requested', budget_ms FROM routed WHERE route = 'queued'""")
    add("infer_schema", "sample", """
SELECT dataset_id,
  CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY min(row_idx), arg_min(pos, row_idx)) - 1 AS INT) AS pos, name,
  arg_min(dtype, row_idx) AS dtype, bool_or(dtype = 'null') AS nullable,
  string_agg(CAST(v AS VARCHAR), ';' ORDER BY row_idx) FILTER (rn <= 3) AS examples
FROM typed GROUP BY dataset_id, name""")
    sql["features_from_info"] = _INFO + " SELECT dataset_id, features, config, split FROM info"
    sql["features_from_card"] = _INFO + " SELECT dataset_id, features FROM cards"
    sql["resolve_schemas"] = _INFO + """
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events
),
sampled AS (
  SELECT user_id, cap, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY rn) AS ids,
    string_agg(CAST(json(props) AS VARCHAR), ',' ORDER BY rn) AS objects
  FROM numbered, (SELECT unnest([2, 200]) AS cap) WHERE rn <= least(cap, 3) GROUP BY user_id, cap
),
asked AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 200 END AS cap FROM events),
solved AS (
  SELECT e.*, i.config, i.split, CASE WHEN i.features IS NOT NULL THEN i.features
    WHEN i.config IS NOT NULL THEN '[{"name":"id","dtype":"int64","nullable":false,"examples":[' || s.ids
      || ']},{"name":"props","dtype":"struct","nullable":false,"examples":[' || s.objects || ']}]'
    ELSE c.features END AS found
  FROM asked e JOIN sampled s USING (user_id, cap)
  LEFT JOIN info i ON i.dataset_id = 'ds/' || e.user_id LEFT JOIN cards c ON c.dataset_id = 'ds/' || e.user_id
)
SELECT 'job-' || event_id AS job_id, 'ds/' || user_id AS dataset_id,
  CASE WHEN found IS NOT NULL THEN config END AS config, CASE WHEN found IS NOT NULL THEN split END AS split,
  CASE WHEN found IS NULL THEN 'schema_not_available' END AS note, 'hf_connector' AS source,
  CASE WHEN event_id % 4 = 3 THEN 'snips' ELSE 'schema' END AS kind, coalesce(found, '[]') AS schema,
  cap AS row_cap_applied, 0 AS fetched_ms, 1500 AS budget_ms_requested, false AS budget_exhausted
FROM solved"""
    add("classify_error", "failures", "SELECT event_id, new_class AS error_class FROM classified")
    add("apply_outcomes", "jobs failures", f"""
, outcomes AS (
  SELECT 'job-' || event_id AS id, event_id % 3 > 0 AS ok, props AS payload, new_class, repeat(props, 300) AS detail
  FROM classified WHERE event_type = 'view'
),
ended AS (SELECT j.*, o.ok, o.payload, o.new_class, o.detail FROM jobs j LEFT JOIN outcomes o USING (id))
SELECT 'job' AS part, id, CASE WHEN ok THEN 'done' WHEN NOT ok THEN 'error' ELSE state END AS kind,
  CAST(attempts + CASE WHEN NOT ok THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN NOT ok THEN new_class ELSE error_class END AS text,
  CAST(length(CASE WHEN NOT ok THEN substr(detail, 1, 2000) ELSE error_detail END) AS INT) AS chars,
  CASE WHEN ok IS NULL THEN finished_at ELSE {_AS_OF} END AS at FROM ended
UNION ALL SELECT 'artifact', dataset_id, kind, NULL, payload, NULL, started_at FROM ended WHERE ok
UNION ALL SELECT 'event', id, CASE WHEN ok THEN 'dataset.resolved_ok' ELSE 'dataset.resolved_err' END, NULL,
  CASE WHEN NOT ok THEN new_class END, CASE WHEN NOT ok THEN CAST(least(length(detail), 500) AS INT) END, {_AS_OF} FROM ended WHERE ok IS NOT NULL""")
    add("upsert_jobs", "jobs", """
SELECT id, CASE WHEN state = 'error' THEN 'queued' ELSE state END AS state, CASE WHEN state <> 'error' THEN error_class END AS error_class,
  attempts, started_at FROM jobs""")
    add("reclaim_stale", "jobs", """
, marked AS (
  SELECT *, coalesce(state = 'running' AND started_at < TIMESTAMP '2024-01-19 23:59:30' AND attempts < 3, false) AS hit FROM jobs
)
SELECT id, CASE WHEN hit THEN 'queued' ELSE state END AS state, CASE WHEN NOT hit THEN started_at END AS started_at,
  CASE WHEN NOT hit THEN finished_at END AS finished_at FROM marked""")
    add("start_jobs", "jobs", f"""
, due AS (SELECT id FROM jobs WHERE state = 'queued' ORDER BY enqueued_at, id LIMIT 150)
SELECT id, CASE WHEN id IN (SELECT id FROM due) THEN 'running' ELSE state END AS state,
  CASE WHEN id IN (SELECT id FROM due) THEN {_AS_OF} ELSE started_at END AS started_at FROM jobs""")
    add("pause_reason", "metrics", f"""
SELECT queue_depth, {pause.format(1000)} IS NOT NULL AS prefetch_paused, {pause.format(1000)} AS prefetch_reason FROM report""")
    add("prefetch_candidates", "candidates", "SELECT * FROM candidates LIMIT 100")
    add("prefetch_jobs", "candidates jobs", f"""
SELECT id, dataset_id, kind, state, budget_ms, enqueued_at FROM jobs
UNION ALL SELECT 'prefetch-' || id, id, 'schema', 'queued', 1500, {_AS_OF} FROM (SELECT id FROM candidates LIMIT 20)""")

    # Streams
    add("stream_signals", "signals", "SELECT * FROM signals0")
    add("stream_signals_shuffled", "signals", "SELECT * FROM signals0")
    sql["stream_popularity"] = """
WITH starts AS (
  SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 6 DAY, date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS window_start,
    max(ts) AS latest FROM events
),
shifted AS (
  SELECT CAST(window_start AS TIMESTAMP) AS window_start, latest FROM starts
)
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, 'ds/' || user_id AS dataset_id, count(*) AS sig_score
FROM events JOIN shifted ON ts >= window_start AND ts < window_start + INTERVAL 7 DAY
WHERE window_start + INTERVAL 7 DAY <= latest - INTERVAL 1 DAY GROUP BY ALL"""
    add("stream_upsert_datasets", "batch", "SELECT id, title, fingerprint, readme_tokens FROM merged")
    add("stream_upsert_effects", "batch artifacts", """
SELECT 'artifact' AS part, dataset_id, kind AS what,
  CASE WHEN dataset_id IN (SELECT id FROM compared WHERE type = 'dataset.changed') THEN true ELSE stale END AS stale
FROM artifacts UNION ALL
SELECT 'event', id, type, CAST(NULL AS BOOLEAN) FROM compared WHERE type IS NOT NULL""")
    sql["stream_job_state"] = """
SELECT 'job-' || user_id AS id, event_type AS state, ts AS at FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
    return sql
