"""DuckDB SQL for the queries of :mod:`skerry.plans.stored`."""

from __future__ import annotations

from skerry.plans.oracle import FILES, PLANNED, REFINED, SNAPSHOTS, TREE, _direction

NOW = 1_700_001_500
DIRS = ", dirs AS (SELECT DISTINCT dir AS path, 'D' || dir AS dir_id, 'root' AS parent_id FROM d)"
DONE = """, done AS (SELECT path, id AS file_id, mtime, cloud_hash, CASE WHEN mtime % 4 = 0 THEN 'download' END AS action FROM remote WHERE mtime % 2 = 0)"""
KINDS = "(CASE WHEN doc_id % 3 = 1 THEN 'pipe-text' WHEN doc_id % 3 = 0 THEN 'native-table' ELSE 'no-table' END)"
INSPECTED = SNAPSHOTS + f""", inspected AS (SELECT d.path, doc_id, CASE WHEN coalesce(file_id, '') = '' THEN 'miss' WHEN domain <> 0 THEN 'skip' WHEN doc_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
CASE WHEN file_id <> '' AND domain = 0 AND doc_id % 5 <> 0 THEN {KINDS} END AS shape FROM d LEFT JOIN base USING (path))"""
EXT = "['.note', '.clip', '', '.md', '.PNG'][p_partkey % 5 + 1]"

STORED: dict[str, str] = {
    "cached_listing": SNAPSHOTS + DIRS + """, f AS (SELECT path, file_id, CASE WHEN domain = 0 THEN regexp_replace(split_part(path, '/', -1), '[.]md$', '.note') ELSE split_part(path, '/', -1) END AS name FROM base WHERE file_id <> '' AND cloud_mtime % 7 <> 0)
SELECT path, file_id AS id, name, false AS is_dir FROM f UNION ALL SELECT path, dir_id, split_part(path, '/', -1), true FROM dirs""",
    "scan_phase": SNAPSHOTS + DIRS + " SELECT path, false AS is_dir FROM base WHERE file_id <> '' AND path NOT LIKE 'src1/%' UNION ALL SELECT path, true FROM dirs",
    "live_listing": SNAPSHOTS + " SELECT path, id FROM remote",
    "dirs_upsert": FILES + DIRS + " SELECT path, CASE WHEN path LIKE '%/en' AND path NOT LIKE 'src1/%' THEN 'N' || path ELSE dir_id END AS dir_id, CASE WHEN path LIKE '%/en' AND path NOT LIKE 'src1/%' THEN 'other' ELSE parent_id END AS parent_id FROM dirs",
    "dirs_calibrate": FILES + DIRS + " SELECT * FROM dirs WHERE path LIKE '%/en'",
    "base_contents": FILES + " SELECT path, CASE WHEN doc_id % 5 = 0 THEN md5('new') WHEN doc_id % 3 <> 0 THEN md5(text) END AS content_hash FROM d",
    "sync_recorded": SNAPSHOTS + DONE + f""" SELECT path, CASE WHEN e.path IS NULL THEN b.file_id ELSE e.file_id END AS file_id, CASE WHEN e.path IS NULL THEN b.cloud_mtime ELSE e.mtime END AS cloud_mtime,
CASE WHEN e.path IS NULL THEN b.last_sync_at ELSE {NOW} END AS last_sync_at, coalesce(e.cloud_hash, b.content_hash) AS content_hash FROM base b FULL JOIN done e USING (path)""",
    "sync_recorded_log": SNAPSHOTS + DONE + f" SELECT {NOW}::BIGINT AS timestamp, path, action, 'pull' AS direction, cloud_hash AS new_hash, file_id AS cloud_id FROM done WHERE action IS NOT NULL",
    "scan_saved_files": SNAPSHOTS + """ SELECT path, coalesce(r.id, b.file_id) AS file_id, CASE WHEN r.path IS NULL OR (b.path IS NOT NULL AND b.last_sync_at > 0 AND b.file_id = r.id) THEN b.cloud_mtime ELSE r.mtime END AS cloud_mtime FROM base b FULL JOIN remote r USING (path)""",
    "scan_saved_dirs": FILES + DIRS + " SELECT * FROM dirs",
    "scan_saved_state": f"SELECT * FROM (VALUES ('cloud_version', '77'), ('last_scan_time', '{NOW}'), ('last_full_scan', '{NOW}'), ('other', 'x')) t(key, value)",
    "point_updates": SNAPSHOTS + f""" SELECT path, CASE WHEN cloud_mtime % 3 = 0 THEN {NOW} ELSE last_sync_at END AS last_sync_at, CASE WHEN cloud_mtime % 3 = 0 THEN 'c' ELSE cloud_content_hash END AS cloud_content_hash,
CASE WHEN cloud_mtime % 3 = 0 THEN 9 ELSE local_mtime END AS local_mtime, content_hash FROM base""",
    "original_domains": SNAPSHOTS + " SELECT path, CASE WHEN cloud_mtime % 2 = 0 THEN 7 ELSE domain END AS original_domain FROM base",
    "hash_cache_version": SNAPSHOTS + " SELECT path, local_hash FROM local",
    "hash_cache_upsert": SNAPSHOTS + " SELECT path, CASE WHEN mtime % 2 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN mtime % 2 = 0 THEN 'new' ELSE local_hash END AS cached FROM local",
    "refs_replaced": FILES + " SELECT path AS source_path, CASE WHEN doc_id % 5 = 3 THEN 'img/new' ELSE 'img/' || doc_id % 5 END AS ref_path FROM d",
    "refs_cache": SNAPSHOTS + " SELECT path, size % 3 <> 0 AND mtime % 5 <> 0 AS use_cache FROM local",
    "linked_twins": SNAPSHOTS + """ SELECT a.path, min(b.path) AS twin FROM base a JOIN base b ON a.content_hash = b.content_hash AND b.file_id <> '' AND a.path <> b.path WHERE a.content_hash <> '' GROUP BY a.path""",
    "wanted_merged": SNAPSHOTS + """, later AS (SELECT path, CASE WHEN mtime % 4 = 0 THEN 'N' || id ELSE id END AS id, name, mtime + mtime % 3 - 1 AS mtime FROM remote WHERE path IN (SELECT path FROM local)),
stored AS (SELECT path, id, name, mtime FROM remote WHERE mtime % 10 <> 0)
SELECT path, l.id FROM later l LEFT JOIN stored s USING (path) WHERE s.path IS NULL OR (l.id <> s.id AND (l.mtime > s.mtime OR (l.mtime = s.mtime AND l.id > s.id)))""",
    "fallback_deletes": FILES + " SELECT path AS old_path, 'F' || doc_id AS file_id FROM d WHERE doc_id % 3 = 0",
    "merge_retries": FILES + " SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'before' ELSE md5(text) END AS content_hash, CASE WHEN doc_id % 4 = 0 THEN 'merge-upload-deferred' ELSE 'merge' END AS action FROM d",
    "local_collisions": FILES + " SELECT dir || '/n' || doc_id || '.md' AS path, 'n' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.note' END AS name, doc_id AS mtime FROM d",
    "imported_folders": TREE + " SELECT w.path, w.id AS dir_id, coalesce(n.parent_id, '') AS parent_id FROM walk w JOIN nodes n USING (id)",
    "imported_notes": TREE + """ SELECT w.path || '/' || replace(s_name, '#', '') || CASE WHEN contains(s_name, '.') THEN '' ELSE '.md' END AS path, 's' || s_suppkey AS file_id, (s_suppkey + 1700000000000) // 1000 AS cloud_mtime, s_suppkey::BIGINT AS create_time
FROM supplier JOIN walk w ON w.id = 'n' || s_nationkey WHERE s_suppkey % 5 <> 0""",
    "richest_versions": "WITH r AS (SELECT user_id, event_id AS version, event_id % 7 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 DESC, event_id) AS n FROM events) SELECT user_id, version, size FROM r WHERE n = 1",
    "live_mtimes": SNAPSHOTS + " SELECT path, CASE WHEN mtime % 3 = 0 THEN mtime + 500 ELSE mtime END AS mtime FROM remote",
    "listing_pages": FILES + " SELECT 'F' || doc_id AS id, 'base/n' || doc_id || '.md' AS path, dir AS parent_id FROM d WHERE doc_id % 9 <> 0",
    "usable_listings": FILES + " SELECT dir, count(*) FILTER (doc_id % 2 = 0) > 0 AND 2 * count(*) FILTER (doc_id % 2 = 0) >= count(*) AS usable FROM d GROUP BY dir",
    "download_tasks": TREE + " SELECT id, path FROM walk WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)",
    "refinement_changes": REFINED + " SELECT path, s.state, r.state AS refined FROM states s JOIN refined r USING (path) WHERE s.state <> r.state",
    "name_rules": f"""WITH p AS (SELECT p_partkey AS k, {EXT} AS e, 'n' || p_partkey || {EXT} AS name, p_partkey FROM part)
SELECT p_partkey, CAST(CASE WHEN e IN ('.note', '.clip', '') THEN 0 ELSE 1 END AS INT) AS domain, CASE WHEN k % 3 = 0 THEN '' ELSE '' END || CASE WHEN k % 2 = 0 AND e = '.md' THEN 'n' || k || '.note' ELSE name END AS cached,
CASE WHEN e = '.md' THEN 'n' || k || '.note' END AS sibling, 'd/x' || e || CASE WHEN e = '' THEN '' ELSE '' END AS trimmed, name || '.media' AS media,
'f/' || CASE WHEN e IN ('.note', '.clip', '') THEN 'n' || k || '.md' ELSE name END AS mapped, e IN ('.md', '.note') AS watched,
CASE e WHEN '.md' THEN 'text/markdown' WHEN '.PNG' THEN 'image/png' ELSE 'application/octet-stream' END AS mime, k % 4 = 0 AS conflict, k % 3 <> 0 AS root,
CASE WHEN k % 3 = 0 THEN 'a/b/' ELSE '' END || name AS separators, 'y/' || name || ':' || k AS location FROM p""",
    "diary_names": FILES + """, n AS (SELECT *, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS t FROM d)
SELECT doc_id, doc_id % 7 <> 0 AS diary, CASE WHEN doc_id % 7 <> 0 THEN printf('%d-%02d-%02d', 2000 + doc_id % 30, doc_id % 12 + 1, doc_id % 28 + 1) END AS day,
'.trash/' || strftime(t, '%Y-%m-%d') || '/' || path AS trash, 'mark-' || strftime(t, '%Y-%m-%d') AS marker FROM n""",
    "value_formats": """WITH v AS (SELECT doc_id, doc_id * 10 AS ms, doc_id * 10000 AS us, doc_id % 5 AS t FROM documents)
SELECT doc_id, CASE WHEN ms < 1 THEN printf('%.0fµs', ms::DOUBLE * 1000) WHEN ms < 1000 THEN printf('%.1fms', round(CAST(ms AS DECIMAL(18, 4)), 1)::DOUBLE) ELSE printf('%.2fs', round(CAST(ms AS DECIMAL(18, 4)) / 1000, 2)::DOUBLE) END AS ms,
CASE WHEN us < 1000 THEN us || 'µs' WHEN us < 1000000 THEN printf('%.1fms', round(us::DECIMAL(18, 4) / 1000, 1)::DOUBLE) ELSE printf('%.2fs', round(us::DECIMAL(18, 4) / 1000000, 2)::DOUBLE) END AS us,
CASE WHEN t > 0 THEN printf('%.1f%%', round(doc_id * 100.0 / t, 1)::DOUBLE) ELSE '-' END AS share, CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE doc_id::DOUBLE END AS number,
CASE WHEN doc_id % 2 = 0 THEN (doc_id + 1700000000000) // 1000 ELSE doc_id END AS seconds, CASE WHEN doc_id % 7 = 0 THEN '-' ELSE strftime(make_timestamp(doc_id % 7 * 1000000000), '%Y-%m-%d %H:%M') END AS listed,
'/' || doc_id || '/x/z/' || doc_id AS url FROM v""",
    "commit_messages": """WITH p AS (SELECT n_nationkey AS k, array_to_string(list_filter([CASE WHEN n_nationkey % 2 <> 0 THEN '↓' || n_nationkey % 2 END, CASE WHEN n_nationkey % 3 <> 0 THEN '↑' || n_nationkey % 3 END, CASE WHEN n_nationkey % 5 <> 0 THEN '⚡' || n_nationkey % 5 END], lambda x: x IS NOT NULL), ' ') AS s FROM nation)
SELECT k AS n_nationkey, CASE WHEN k = 7 THEN 'own' ELSE 'sync: ' || CASE WHEN s <> '' THEN s ELSE 'auto-commit' END || ' (2024-05-06 07:08:09)' END AS message FROM p""",
    "clip_names": "SELECT doc_id, CASE WHEN doc_id % 1200 < 1000 THEN lpad((doc_id % 1200)::VARCHAR, 3, '0') ELSE (doc_id % 1200)::VARCHAR END || '-rec' || ['.ogg', '.mp3', '.aac', '.bin'][doc_id % 4 + 1] AS name, doc_id % 1200 < 1000 AS own FROM documents",
    "denied_commands": r"SELECT p_partkey, regexp_matches(p_name, '\b(a|b)[a-z]+') AS denied FROM part",
    "markdown_tables": r"""WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) WHEN 1 THEN text || chr(10) || '| a | b |' || chr(10) ELSE 'x|y' || chr(10) || '| -- |' || chr(10) || text END AS body FROM documents),
l AS (SELECT doc_id, string_split(body, chr(10)) AS lines FROM b)
SELECT doc_id, len(list_filter(range(1, len(lines)), lambda k: contains(lines[k], '|') AND regexp_full_match(lines[k + 1], '\|[\t :|-]+\|'))) > 0 AS "table" FROM l""",
    "bloom_sizes": """WITH c AS (SELECT coalesce(source, 'none') AS of, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT coalesce(lang, 'none'), 1000 * count(*) FROM documents GROUP BY 1)
SELECT of, n, greatest(floor(-n * ln(0.01) / pow(ln(2), 2)), 1)::BIGINT AS bits, greatest(floor(floor(-n * ln(0.01) / pow(ln(2), 2)) * ln(2) / n), 1)::BIGINT AS hashes FROM c""",
    "note_contents": f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '| a |/' ELSE 'p' || doc_id || '/!/' END || 'q' || doc_id || '/!' AS texts,
CASE doc_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '| a |/' ELSE 'p' || doc_id || '!/' END || 'q' || doc_id || '!' AS paragraphs, CASE WHEN doc_id % 3 = 0 THEN 'rh' ELSE '' END AS missing, {KINDS} AS shape FROM documents""",
    "note_comparison": f"SELECT doc_id, doc_id % 2 = 0 AS same, {KINDS} || '/' || {KINDS} AS shapes, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'title' END AS attributes FROM documents",
    "note_tables": INSPECTED + " SELECT path, status, shape FROM inspected",
    "notes_verified": _direction("'upload'").split("\nSELECT path, state", 1)[0] + ", " + INSPECTED[len(SNAPSHOTS) + 2 :]
    + " SELECT path, coalesce(shape = 'native-table' AND state IN ('synced', 'cloudModifiedMtimeOnly'), false) AS verified FROM inspected LEFT JOIN filtered USING (path)",
    "note_table_candidates": SNAPSHOTS + " SELECT path, file_id FROM base JOIN d USING (path) WHERE domain = 0 AND file_id <> '' AND doc_id % 3 = 0 AND path LIKE 'src%'",
    "note_table_targets": INSPECTED + " SELECT path FROM inspected WHERE shape = 'pipe-text' ORDER BY path COLLATE en, path LIMIT 10",
    "xml_to_md": r"""SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, '## h' || p_partkey, '1. i', '- [ ] t', '---', '![s](u)', '| a\_b | c\#d |' || chr(10) || '| - | - |' || chr(10) || '| x |   |' || chr(10)) AS markdown FROM part""",
    "mermaid_to_puml": """SELECT p_partkey, concat_ws(chr(10), ''' @source:mermaid', '@startuml', 'left to right direction', 'rectangle "' || p_name || '" as A #f00;text:fff', 'rectangle "E' || p_partkey || '" as B', 'rectangle "C" as C', 'rectangle "D" as D', 'A --> B', 'B ..> C', 'C --> A : yes', 'C -[hidden]- D', 'D ==> A', '@enduml') AS plantuml FROM part""",
    "puml_to_mermaid": """SELECT p_partkey, concat_ws(chr(10), 'graph LR', '    A["' || p_name || '"]', '    B["E' || p_partkey || '"]', '    C["C"]', '    D["D"]', '    A --> B', '    B -.-> C', '    C -->|yes| A', '    C ~~~ D', '    D ==> A', '    style A fill:#f00,color:#fff') AS mermaid FROM part""",
    "html_built": """SELECT p_partkey, replace('## ' || p_name || '~~a **b** *c* !!d!! `e` [l](u?x=1&y)~z~~- one~- two~~> q~> r~```~k~```~~| A | B |~| --- | --- |~| 1 | ' || p_partkey || ' |~![t](s)~---~<AB', '~', chr(10)).replace('!!', '~~') AS markdown FROM part""",
    "note_json_built": """WITH t AS (SELECT '{"2":"2","3":"","7":[' AS a, ']}' AS z) SELECT p_partkey, '{"2":"1","3":"","4":{"version":1,"incompatibleVersion":0,"fv":"0"},"5":[{"3":"","4":{"l":"h1"},"5":[' || a || '{"8":"' || p_name || '"}' || z || '],"6":"h"},{"3":"","4":{"lt":"unordered","ll":1},"5":[' || a || '{"8":"b","9":[{"2":"b"}]},{"8":" x"}' || z || '],"6":"l"},{"3":"","5":[{"3":"","5":[' || a || '{"8":"q"}' || z || ']}],"6":"q"},{"3":"","4":{"la":"py"},"5":[{"3":"","5":[' || a || '{"8":"c"}' || z || ']}],"6":"cd"},{"3":"","5":[{"3":"","4":{"hf":"u"},"5":[' || a || '{"8":"l"}' || z || '],"6":"li"}]}],"title":"","__compress__":true}' AS note FROM part, t""",
    "any_to_markdown": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'h' || doc_id WHEN 1 THEN 'p' || doc_id || '!' || chr(10) || chr(10) || 'q' || doc_id || '!' WHEN 2 THEN 'x' || doc_id ELSE '# ' || doc_id END AS markdown FROM documents",
    "content_anomalies": """WITH t AS (SELECT 'p' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'd', doc_id, text FROM documents WHERE doc_id % 5 > 1),
k AS (SELECT kind, id, ltrim(substring(text, 1, 50), ' ' || chr(9) || chr(10) || chr(13)) AS x FROM t)
SELECT kind, id, 'HTML' AS anomaly FROM k WHERE regexp_matches(x, '(?i)^<(!DOCTYPE\\s+html|html)') UNION ALL SELECT 'd', doc_id, CASE WHEN doc_id % 5 = 0 THEN 'JSON' ELSE 'XML' END FROM documents WHERE doc_id % 5 < 2""",
    "content_hashes_by_kind": "SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN md5(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) ELSE md5(chr(65279) || replace(text, chr(10), chr(13) || chr(10))) END AS hash FROM documents",
    "line_differences": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(CASE WHEN doc_id % 2 = 0 THEN 'top' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'end' ELSE '' END, chr(10)) AS b FROM documents),
e AS (SELECT doc_id, i, coalesce(a[i], '(missing)') AS l, coalesce(b[i], '(missing)') AS r FROM d, unnest(range(1, greatest(len(a), len(b)) + 1)) AS u(i)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e WHERE l <> r)
SELECT doc_id, CAST(i AS INT) AS line, l AS "left", r AS "right" FROM n WHERE n <= 3""",
    "timing_report": """WITH p AS (SELECT event_type AS phase, sum(event_id % 100)::BIGINT AS ms FROM events GROUP BY 1), t AS (SELECT sum(ms) AS total FROM p)
SELECT phase, ms, CASE WHEN ms < 1000 THEN printf('%.1fms', ms::DOUBLE) ELSE printf('%.2fs', round(ms::DECIMAL(18, 4) / 1000, 2)::DOUBLE) END AS time, printf('%.1f%%', ms * 100.0 / total) AS share FROM p, t""",
    "hash_repairs": SNAPSHOTS + " SELECT path, CASE WHEN l.path IS NULL THEN 'missing' WHEN l.local_hash IS NOT DISTINCT FROM b.content_hash THEN 'same' ELSE 'mismatched' END AS status, l.local_hash AS hash FROM base b LEFT JOIN local l USING (path) WHERE path LIKE 'src%'",
    "hash_repair_counts": SNAPSHOTS + " SELECT count(*) AS scanned, count(*) FILTER (l.path IS NOT NULL AND l.local_hash IS DISTINCT FROM b.content_hash) AS mismatched, 0::BIGINT AS fixed, count(*) FILTER (l.path IS NULL) AS missing FROM base b LEFT JOIN local l USING (path)",
    "listing_summary": FILES + " SELECT 'file' AS type, count(*) AS n, sum(length(text))::BIGINT AS bytes FROM d UNION ALL SELECT 'folder', count(DISTINCT dir), 0 FROM d",
    "task_counts": "SELECT count(*) AS total, count(*) FILTER (doc_id % 9 <> 0) AS succeeded, count(*) FILTER (doc_id % 9 = 0) AS failed FROM documents",
    "action_counters": PLANNED + ", a AS (SELECT action, path NOT LIKE '%3.md' AS ok FROM planned) SELECT " + ", ".join(f"count(*) FILTER (ok AND action = '{a}') AS {n}" for n, a in {"downloaded": "download", "uploaded": "upload", "moved": "move", "conflicts": "conflict", "deleted_cloud": "deleteCloud", "deleted_local": "deleteLocal", "skipped": "skip"}.items()) + ", count(*) FILTER (NOT ok) AS errors FROM a",
    "recovery_verdicts": FILES + " SELECT name, CASE WHEN doc_id % 2 <> 0 THEN 'desktop_checked_no_matching_rows' WHEN doc_id % 4 <> 0 THEN 'desktop_rows_no_backup_versions' ELSE 'backup_versions_exist' END AS verdict FROM d",
    "empty_groups": FILES + " SELECT 'h' || doc_id % 11 AS hash, arg_min(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END, path) = 0 AS skip FROM d GROUP BY 1",
    "log_retention": "SELECT event_type AS action, count(*) AS n FROM events WHERE floor(epoch(ts)) >= 1704067200 + 86400 * 3 GROUP BY 1",
    "stored_dirs": FILES + DIRS + " SELECT path, dir_id FROM dirs",
    "log_appended": FILES + ", l AS (SELECT max(event_id) AS m FROM events WHERE event_id % 4 = 0) SELECT m + row_number() OVER (ORDER BY path) AS id, path FROM d, l",
    "rows_removed": SNAPSHOTS + " SELECT path FROM base WHERE path NOT IN (SELECT path FROM local)",
    "paths_rewritten": FILES + " SELECT path, CASE WHEN doc_id % 6 = 0 THEN -doc_id ELSE doc_id END AS v FROM d",
    "paths_rewritten_counts": "SELECT count(*) FILTER (doc_id % 3 = 0) AS renamed, true AS restart FROM documents",
    "listing_filtered": FILES + DIRS + " SELECT path, false AS is_dir FROM d WHERE doc_id % 7 <> 0 AND path NOT LIKE 'src1/%' UNION ALL SELECT path, true FROM dirs",
    "parents_confirmed": "SELECT c_name AS path, c_custkey % 3 <> 0 AS confirmed FROM customer",
    "dedup_inputs": SNAPSHOTS + " SELECT path, CASE WHEN mtime % 2 = 0 THEN local_hash ELSE '' END AS hash, size, coalesce(file_id, '') AS file_id, coalesce(create_time, 0) AS create_time FROM local LEFT JOIN base USING (path)",
    "recent_page": "SELECT event_id AS version, user_id FROM events ORDER BY event_id DESC LIMIT 30",
    "scans_due": "SELECT event_id AS key, event_id % 5 <= 0 OR event_id % 3 - 1 > 0 OR event_id * 7 >= 3600 AS due, event_id * 7 < 60 AND event_id % 2 = 0 AS fresh FROM events",
    "gc_removed": SNAPSHOTS + """, now AS (SELECT 1706600000 + 60 * 86400 AS n)
SELECT 'file' AS kind, path AS key FROM base, now WHERE last_sync_at > 0 AND last_sync_at < n - 30 * 86400 AND path NOT IN (SELECT path FROM local)
UNION ALL SELECT 'log', event_id::VARCHAR FROM events, now WHERE floor(epoch(ts)) < n - 90 * 86400 UNION ALL SELECT 'reference', path FROM base WHERE path NOT IN (SELECT path FROM local)""",
    "top_extensions": "SELECT (p_partkey % 13)::VARCHAR AS ext, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, ext LIMIT 10",
    "duplicate_summary": """WITH g AS (SELECT 'g' || doc_id % 40 AS name, doc_id % 40 AS k, count(*) AS n FROM documents GROUP BY ALL),
c AS (SELECT name, n, ['identical', 'crlf_only', 'real_diff'][k % 3 + 1] AS category FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, name) AS i FROM c) SELECT name, n, category FROM r WHERE i <= 5""",
    "dry_run_report": PLANNED + " SELECT CASE action WHEN 'download' THEN 1 WHEN 'upload' THEN 2 ELSE 3 END AS phase, action, '- ' || path || ' (' || state || ')' AS line FROM planned WHERE action <> 'skip'",
    "audio_notes": "SELECT doc_id, doc_id % 3 < 2 AND doc_id % 5 <> 0 AS audio FROM documents",
    "watched_changes": "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0",
    "local_files": "WITH n AS (SELECT 'lang=' || lang AS folder, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes FROM documents GROUP BY 1) SELECT folder, bytes, bytes AS read FROM n",
    "cpu_profile": """WITH p AS (SELECT p_partkey AS id, p_name AS function, p_partkey % 50 AS d FROM part), t AS (SELECT sum(d) AS total FROM p)
SELECT id, function, d::BIGINT AS self_time, round(100.0 * d / total, 4) AS pct FROM p, t""",
}
