"""DuckDB SQL that computes the same rows as the queries, for comparison.

Written independently of the engine: one statement per query over the driver's
tables, with the snapshots derived in common table expressions.
"""

from __future__ import annotations

SNAPSHOTS = """
WITH d AS (
  SELECT doc_id, source || '/' || lang AS dir, 'doc_' || doc_id || '.md' AS name,
         source || '/' || lang || '/doc_' || doc_id || '.md' AS path, text FROM documents
), base AS (
  SELECT path, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'F' || doc_id END AS file_id,
         CASE WHEN doc_id % 19 = 0 THEN 0 ELSE 1700000000 + doc_id END AS cloud_mtime,
         CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 1700000100 + doc_id END AS local_mtime,
         CASE WHEN doc_id % 6 <> 0 THEN md5(text) END AS content_hash, md5(text) AS cloud_content_hash,
         CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1700000500 END AS last_sync_at,
         dir AS parent_id, CAST(doc_id % 2 AS INT) AS domain, 1700000000 - 1000 + doc_id % 100 AS create_time
  FROM d WHERE doc_id % 10 <> 0
), local AS (
  SELECT path, 1700000100 + doc_id + CASE WHEN doc_id % 4 = 0 THEN 60 ELSE 0 END AS mtime, length(text) AS size,
         CASE WHEN doc_id % 5 IN (0, 1) THEN md5(text || '#edited') ELSE md5(text) END AS local_hash
  FROM d WHERE doc_id % 7 <> 0
), remote AS (
  SELECT path, 'F' || doc_id AS id, dir AS parent_id, name, 1700000000 + doc_id + CASE WHEN doc_id % 3 = 0 THEN 60 ELSE 0 END AS mtime,
         1700000000 - 1000 + doc_id % 100 AS ctime, CAST(doc_id % 2 AS INT) AS domain,
         CASE WHEN doc_id % 15 IN (6, 10) THEN md5(text || '#edited') WHEN doc_id % 3 = 0 AND doc_id % 4 IN (0, 3) THEN md5(text || '#cloud') ELSE md5(text) END AS cloud_hash
  FROM d WHERE doc_id % 11 <> 0
)"""

CONDITIONS = (
    SNAPSHOTS
    + """, keys AS (SELECT path FROM remote UNION SELECT path FROM local UNION SELECT path FROM base),
conditions AS (
  SELECT k.path, l.path IS NOT NULL AS local_exists, r.path IS NOT NULL AS cloud_exists,
         b.path IS NOT NULL AND b.file_id <> '' AND b.last_sync_at > 0 AS previously_synced,
         nullif(l.local_hash, '') <> nullif(b.content_hash, '') AS local_hash_changed,
         CASE WHEN r.path IS NULL OR b.path IS NULL OR b.last_sync_at <= 0 THEN NULL
              WHEN b.cloud_mtime > 0 THEN r.mtime > b.cloud_mtime WHEN b.cloud_mtime = 0 THEN true END AS cloud_mtime_changed,
         CASE WHEN l.path IS NULL OR b.path IS NULL THEN NULL WHEN b.local_mtime > 0 THEN l.mtime > b.local_mtime ELSE true END AS local_mtime_changed,
         l.local_hash, r.cloud_hash, b.content_hash, b.cloud_content_hash, b.file_id, b.path IS NOT NULL AS known
  FROM keys k LEFT JOIN remote r USING (path) LEFT JOIN local l USING (path) LEFT JOIN base b USING (path)
)"""
)

_STATE = """
  CASE WHEN NOT local_exists AND NOT cloud_exists THEN 'gone'
       WHEN NOT cloud_exists AND NOT previously_synced THEN 'localNew'
       WHEN NOT cloud_exists AND local_mtime_changed THEN 'cloudDeletedLocalModified'
       WHEN NOT cloud_exists THEN 'cloudDeleted'
       WHEN NOT local_exists AND NOT previously_synced THEN 'cloudNew'
       WHEN NOT local_exists AND cloud_mtime_changed THEN 'localDeletedCloudModified'
       WHEN NOT local_exists THEN 'localDeleted'
       WHEN local_hash_changed AND cloud_mtime_changed THEN 'conflict'
       WHEN local_hash_changed AND cloud_mtime_changed IS NULL THEN 'cloudModifiedContent'
       WHEN local_hash_changed THEN 'localModified'
       WHEN cloud_mtime_changed THEN 'cloudModifiedContent'
       ELSE 'synced' END"""

_RULE = """
  CASE WHEN NOT local_exists AND NOT cloud_exists THEN 0
       WHEN NOT cloud_exists AND NOT previously_synced THEN 1
       WHEN NOT cloud_exists THEN CASE local_mtime_changed WHEN true THEN 2 WHEN false THEN 3 ELSE 4 END
       WHEN NOT local_exists AND NOT previously_synced THEN 5
       WHEN NOT local_exists THEN CASE cloud_mtime_changed WHEN true THEN 6 WHEN false THEN 7 ELSE 8 END
       WHEN local_hash_changed IS NULL THEN CASE cloud_mtime_changed WHEN false THEN 15 WHEN true THEN 16 ELSE 17 END
       WHEN NOT local_hash_changed THEN CASE cloud_mtime_changed WHEN false THEN 9 WHEN true THEN 10 ELSE 13 END
       ELSE CASE cloud_mtime_changed WHEN false THEN 11 WHEN true THEN 12 ELSE 14 END END"""

STATES = CONDITIONS + f", states AS (SELECT *, {_STATE} AS state FROM conditions)"

REFINED = (
    STATES
    + """, refined AS (
  SELECT * REPLACE (CASE
    WHEN state NOT IN ('cloudModifiedContent', 'conflict') OR local_hash IS NULL OR cloud_hash IS NULL THEN state
    WHEN cloud_hash = local_hash THEN CASE WHEN coalesce(local_hash <> content_hash, false) THEN 'bothModifiedConverged' ELSE 'cloudModifiedMtimeOnly' END
    WHEN NOT coalesce(local_hash <> content_hash, false) THEN 'cloudModifiedContent'
    WHEN coalesce(cloud_hash = cloud_content_hash, false) THEN 'localModified' ELSE 'conflict' END AS state) FROM states
)"""
)

_ACTION = """CASE WHEN state IN ('localNew', 'localModified', 'cloudDeletedLocalModified') THEN 'upload'
  WHEN state IN ('cloudNew', 'cloudModifiedContent', 'localDeletedCloudModified') THEN 'download'
  WHEN state = 'conflict' THEN 'conflict' WHEN state = 'moved' THEN 'move' ELSE 'skip' END"""

_DELETING = f"CASE state WHEN 'localDeleted' THEN 'deleteCloud' WHEN 'cloudDeleted' THEN 'deleteLocal' ELSE {_ACTION} END"

PLANNED = REFINED + f", planned AS (SELECT path, state, {_DELETING} AS action FROM refined)"


def _direction(kept: str) -> str:
    return REFINED + f""", filtered AS (SELECT path, CASE WHEN {_ACTION} IN ('skip', 'move', {kept}) THEN state ELSE 'gone' END AS state FROM refined)
SELECT path, state, {_ACTION} AS action FROM filtered"""


FILES = "WITH d AS (SELECT doc_id, source || '/' || lang AS dir, 'doc_' || doc_id || '.md' AS name, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, text FROM documents)"

SIDES = FILES + """, old AS (
  SELECT path, name, CASE WHEN doc_id % 4 = 0 THEN 'F' || (doc_id - doc_id % 8) ELSE '' END AS file_id, CASE WHEN doc_id % 4 = 1 THEN md5(text) ELSE '' END AS hash FROM d
), new AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN dir ELSE split_part(dir, '/', 1) END || '/archive/' || name AS path, name, CASE WHEN doc_id % 4 = 0 THEN 'F' || (doc_id - doc_id % 8) ELSE 'F' || doc_id END AS file_id,
         CASE WHEN doc_id % 8 = 5 THEN md5(text || '#other') ELSE md5(text) END AS hash FROM d
)"""


def _ranked(name: str, old: str, new: str, key: str) -> str:
    """A common table expression: the nth old path of a key with its nth new one."""
    side = lambda t: f"(SELECT path, {key}, row_number() OVER (PARTITION BY {key} ORDER BY path) AS n FROM {t} WHERE {key} <> '')"
    return f", {name} AS (SELECT a.path AS old_path, b.path AS new_path FROM {side(old)} a JOIN {side(new)} b USING ({key}, n))"


def _left(name: str, table: str, *pairs: str) -> str:
    taken = " UNION ALL ".join(f"SELECT old_path AS path FROM {p} UNION ALL SELECT new_path FROM {p}" for p in pairs)
    return f", {name} AS (SELECT * FROM {table} WHERE path NOT IN ({taken}))"


_NAMED = "SELECT a.path AS old_path, b.path AS new_path FROM {0} a JOIN {1} b USING (name) WHERE a.hash = '' OR a.hash = b.hash OR a.file_id <> ''"
BY_ID, BY_HASH = SIDES + _ranked("p", "old", "new", "file_id"), SIDES + _ranked("p", "old", "new", "hash")
CASCADE = (
    BY_ID.replace(", p AS", ", p1 AS") + _left("o1", "old", "p1") + _left("n1", "new", "p1") + _ranked("p2", "o1", "n1", "hash") + _left("o2", "o1", "p2") + _left("n2", "n1", "p2")
    + f", p3 AS ({_NAMED.format('o2', 'n2')}) SELECT *, 'id' AS stage FROM p1 UNION ALL SELECT *, 'hash' FROM p2 UNION ALL SELECT *, 'name' FROM p3"
)

SPACES = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sanitized(x: str) -> str:
    x = rf"regexp_replace(replace({x}, '<', '_'), '[\\/\":|*?#>\n\r]', '', 'g')"
    x = f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"
    x = f"regexp_replace({x}, '{SPACES}+', ' ', 'g')"
    return f"regexp_replace({x}, '([^ ]) +(\\.[^.]*)$', '\\1\\2')"


BLOCKS = """SELECT doc_id, CAST(k AS INT) AS block, CAST(k * 4096 AS INT) AS "offset", CAST(length(substring(text, k * 4096 + 1, 4096)) AS INT) AS length, md5(substring(text, k * 4096 + 1, 4096)) AS hash
FROM {0}, unnest(range(0, CAST(ceil(length(text) / 4096.0) AS BIGINT))) AS u(k)"""

MERKLE = FILES + """, leaves AS (SELECT dir, name, name || ':' || md5(text) AS line FROM d),
two AS (SELECT dir, md5(string_agg(line, '|' ORDER BY name COLLATE en, name)) AS tree_hash FROM leaves GROUP BY dir),
one AS (SELECT split_part(dir, '/', 1) AS dir, md5(string_agg(split_part(dir, '/', 2) || ':' || tree_hash, '|' ORDER BY split_part(dir, '/', 2) COLLATE en)) AS tree_hash FROM two GROUP BY 1),
root AS (SELECT '' AS dir, md5(string_agg(dir || ':' || tree_hash, '|' ORDER BY dir COLLATE en)) AS tree_hash FROM one)
SELECT * FROM two UNION ALL SELECT * FROM one UNION ALL SELECT * FROM root"""

TREE = """WITH RECURSIVE nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
), walk AS (
  SELECT id, name AS path, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, w.path || '/' || n.name, w.depth + 1 FROM walk w JOIN nodes n ON n.parent_id = w.id
)"""

DUP_ACTIONS = FILES + """, files AS (
  SELECT path, md5(text) AS hash, length(text) AS size, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'F' || doc_id END AS file_id, 1000 - doc_id % 10 AS create_time, length(name) AS w FROM d
), g AS (
  SELECT *, count(*) OVER s AS n, count(*) FILTER (file_id <> '') OVER s AS k,
         min(CASE WHEN file_id <> '' THEN path END) OVER s AS first_linked,
         first_value(path) OVER (PARTITION BY hash, size ORDER BY file_id = '', w, create_time, path) AS best
  FROM files WINDOW s AS (PARTITION BY hash, size)
), acts AS (
SELECT path, CASE WHEN k > 0 AND k < n THEN first_linked WHEN k = n THEN best END AS keep,
       CASE WHEN k > 0 AND k < n THEN file_id = '' WHEN k = n THEN path <> best ELSE false END AS remove,
       CASE WHEN k > 0 AND k < n THEN 'mixed' WHEN k = n THEN 'best' ELSE 'unlinked' END AS reason
FROM g WHERE n > 1 AND size > 0)
"""

#: The same words, written as they should come out.
MD_NORMALIZE = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS words, coalesce(regexp_extract_all(text, '[A-Za-z]+')[1], 'none') AS w FROM documents)
SELECT doc_id, md5(concat_ws(chr(10), trim('- ' || array_to_string(words, ' ')), '---', '---', '---fence---', '|' || w || '|x|', '|---|---|', '12. ' || w, w, '> - ' || w, 'a * [' || w || '] c https://x.y/' || w)) AS md5 FROM w"""

#: Every fifth remote file under another folder; moves by id, hash and hash again.
WITH_MOVES = (
    REFINED.replace(")\nAS", ")AS").replace("remote AS (\n  SELECT path,", "remote AS (\n  SELECT CASE WHEN doc_id % 5 = 0 THEN 'new/' || path ELSE path END AS path,")
    .replace("b.path IS NOT NULL AS known", "b.path IS NOT NULL AS known, coalesce(r.id, b.file_id, '') AS id, coalesce(nullif(l.local_hash, ''), nullif(b.content_hash, ''), nullif(b.cloud_content_hash, ''), r.cloud_hash, '') AS hash")
    + "".join(f", {n} AS (SELECT path, id, hash FROM states WHERE state = '{s}')" for n, s in (("ln", "localNew"), ("cn", "cloudNew"), ("cd", "cloudDeleted"), ("ld", "localDeleted")))
    + _ranked("p1", "ln", "cn", "id") + _left("ln1", "ln", "p1") + _left("cn1", "cn", "p1") + _ranked("p2", "cd", "ln1", "id") + _left("cd2", "cd", "p2") + _left("ln2", "ln1", "p2")
    + _ranked("p3", "cd2", "cn1", "id") + _left("cd3", "cd2", "p3") + _left("cn3", "cn1", "p3") + _ranked("p4", "cd3", "cn3", "hash") + _left("cn4", "cn3", "p4")
    + _ranked("p5", "ld", "ln2", "hash") + _left("ln5", "ln2", "p5") + _ranked("p6", "cn4", "ln5", "hash")
    + """, pairs AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5 UNION ALL SELECT * FROM p6),
both_sides AS (SELECT split_part(path, '/', -1) AS name, local_hash FROM local WHERE path IN (SELECT path FROM remote)),
loose AS (SELECT path FROM local l WHERE path NOT IN (SELECT path FROM remote) AND EXISTS (SELECT 1 FROM both_sides s WHERE s.name = split_part(l.path, '/', -1) AND s.local_hash = l.local_hash)),
moved AS (SELECT path, p.old_path, CASE WHEN p.new_path IS NOT NULL THEN 'moved' WHEN path IN (SELECT old_path FROM pairs) THEN 'gone' WHEN r.state = 'localNew' AND path IN (SELECT path FROM loose) THEN 'gone' ELSE r.state END AS state
  FROM refined r LEFT JOIN pairs p ON p.new_path = r.path)
"""
    + f"SELECT path, state, {_ACTION} AS action, old_path FROM moved"
)

FEED = "WITH f AS (SELECT user_id AS id, event_id AS version, event_type AS name FROM events)"

ORACLE: dict[str, str] = {
    "recon_states": STATES + " SELECT path, state FROM states",
    "recon_state_counts": STATES + " SELECT state, count(*) AS n FROM states GROUP BY state",
    "recon_decision_reason": STATES + f" SELECT 'rule_' || ({_RULE}) || '_' || state AS decision_reason, '1.0' AS policy_version, count(*) AS n FROM states GROUP BY ALL",
    "recon_conditions": CONDITIONS + " SELECT path, local_exists, cloud_exists, coalesce(previously_synced, false) AS previously_synced, local_hash_changed, cloud_mtime_changed, local_mtime_changed FROM conditions",
    "recon_refined": REFINED + " SELECT path, state FROM refined",
    "recon_action_plan": PLANNED + " SELECT path, state, action, CASE action WHEN 'download' THEN 1 WHEN 'upload' THEN 2 ELSE 3 END AS phase FROM planned",
    "recon_pull_plan": _direction("'download', 'conflict'"),
    "recon_push_plan": _direction("'upload'"),
    "rule_exhaustiveness": STATES + " SELECT state, 1 AS matches, count(*) AS n FROM states GROUP BY state",
    "dryrun_stats": PLANNED + """ SELECT count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'upload') AS uploads, count(*) FILTER (action = 'download') AS downloads,
count(*) FILTER (action = 'conflict') AS conflicts, count(*) FILTER (action = 'move') AS moves, count(*) FILTER (action = 'deleteCloud') AS cloud_deletes,
count(*) FILTER (action = 'deleteLocal') AS local_deletes, count(*) FILTER (action <> 'skip') AS changes FROM planned""",
    "guardrail_status": PLANNED + """, c AS (SELECT (SELECT count(*) FROM remote) AS cloud_files, (SELECT count(*) FROM local) AS local_files, (SELECT count(*) FROM base WHERE file_id <> '') AS linked,
(SELECT count(*) FROM planned WHERE action LIKE 'delete%') AS pending_deletes)
SELECT *, CASE WHEN cloud_files = 0 AND local_files > 0 AND linked > 5 THEN 'aborted' WHEN pending_deletes > 5 THEN 'suspended' ELSE 'ok' END AS status FROM c""",
    "edit_warnings": REFINED + f""" SELECT path, array_to_string(list_filter([CASE WHEN NOT known THEN 'no baseline' END, CASE WHEN local_hash IS NULL THEN 'no local hash' END,
CASE WHEN known AND file_id = '' THEN 'not linked' END, CASE WHEN local_hash = content_hash THEN 'content unchanged' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM refined WHERE {_ACTION} = 'upload'""",
    "actions_grouped": REFINED + f" SELECT {_ACTION} AS action, count(*) AS n, CAST(sum(('0x' || substring(md5(path), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM refined GROUP BY 1",
    "excluded_gone": STATES + " SELECT CASE WHEN path LIKE 'src1/%' OR path LIKE '%/fr/%' THEN 'gone' ELSE state END AS state, count(*) AS n FROM states GROUP BY 1",
    "conflict_candidates": STATES + " SELECT path, state FROM states WHERE state IN ('cloudModifiedContent', 'conflict') AND cloud_exists",
    "calibrate_delta": SNAPSHOTS + """, j AS (
  SELECT path, r.id, r.mtime AS rm, l.mtime AS lm, l.local_hash, b.*,
    coalesce(b.file_id <> '' AND b.local_mtime > 0 AND b.cloud_mtime = 0, false) AS fills,
    coalesce(b.content_hash IS NOT NULL OR b.last_sync_at > 0, false) AS settled, coalesce(b.file_id <> '', false) AS linked
  FROM remote r JOIN local l USING (path) LEFT JOIN base b USING (path)
), k AS (SELECT *, CASE WHEN fills THEN NOT settled ELSE NOT (linked AND settled) END AS links FROM j)
SELECT path, CASE WHEN links THEN id ELSE file_id END AS file_id, rm AS cloud_mtime, CASE WHEN links THEN lm ELSE local_mtime END AS local_mtime,
  CASE WHEN links THEN local_hash ELSE content_hash END AS content_hash, fills::INT + links::INT AS calibrated FROM k WHERE fills OR links""",
    "baseline_heal": SNAPSHOTS.replace("), remote AS (", "), listing AS (") + """, remote AS (SELECT path, CASE WHEN mtime % 5 = 0 THEN 'N' ELSE '' END || id AS id, mtime - CASE WHEN mtime % 7 = 0 THEN 200 ELSE 0 END AS mtime FROM listing)
SELECT path, CASE WHEN b.file_id <> '' AND b.file_id <> r.id THEN 'relink' ELSE 'ahead' END AS issue,
CASE WHEN b.file_id <> '' AND b.file_id <> r.id THEN r.id ELSE b.file_id END AS file_id, r.mtime AS cloud_mtime
FROM base b JOIN remote r USING (path) WHERE last_sync_at > 0 AND ((b.file_id <> '' AND b.file_id <> r.id) OR b.cloud_mtime > r.mtime)""",
    "rebuild_plan": SNAPSHOTS + """ SELECT path, coalesce(r.id, '') AS file_id, coalesce(r.mtime, 0) AS cloud_mtime, coalesce(l.mtime, 0) AS local_mtime,
CASE WHEN b.cloud_mtime = r.mtime AND b.local_mtime = l.mtime THEN b.content_hash END AS content_hash, coalesce(b.cloud_mtime = r.mtime AND b.local_mtime = l.mtime, false) AS reused
FROM remote r FULL JOIN local l USING (path) LEFT JOIN base b USING (path)""",
    "upsert_files": SNAPSHOTS + """ SELECT path, CASE WHEN r.path IS NULL THEN b.file_id ELSE r.id END AS file_id, CASE WHEN r.path IS NULL THEN b.cloud_mtime ELSE r.mtime END AS cloud_mtime,
CASE WHEN r.path IS NULL THEN b.local_mtime ELSE 0 END AS local_mtime, coalesce(CASE WHEN r.mtime % 2 = 0 THEN r.cloud_hash END, b.content_hash) AS content_hash, b.cloud_content_hash,
coalesce(b.last_sync_at, 0) AS last_sync_at, coalesce(r.parent_id, b.parent_id) AS parent_id, coalesce(b.domain, 1) AS domain, coalesce(r.ctime, b.create_time) AS create_time
FROM base b FULL JOIN remote r USING (path)""",
    "cache_cloud_info": SNAPSHOTS + """ SELECT path, coalesce(r.id, b.file_id) AS file_id,
CASE WHEN r.path IS NULL OR (b.path IS NOT NULL AND b.last_sync_at > 0 AND b.file_id = r.id) THEN b.cloud_mtime ELSE r.mtime END AS cloud_mtime,
coalesce(b.local_mtime, 0) AS local_mtime, b.content_hash, b.cloud_content_hash, coalesce(b.last_sync_at, 0) AS last_sync_at,
coalesce(r.parent_id, b.parent_id) AS parent_id, coalesce(r.domain, b.domain) AS domain, coalesce(r.ctime, b.create_time) AS create_time
FROM base b FULL JOIN remote r USING (path)""",
    "rename_cascade": SNAPSHOTS + " SELECT CASE WHEN cloud_mtime % 4 = 0 THEN 'moved/' || path ELSE path END AS path, file_id FROM base",
    "stale_paths": SNAPSHOTS + " SELECT path FROM base WHERE last_sync_at > 0 AND last_sync_at < 1700000501",
    "inactive_paths": SNAPSHOTS + " SELECT path FROM base WHERE path NOT IN (SELECT path FROM remote) AND path NOT IN (SELECT path FROM local)",
    "stale_cloud_paths": SNAPSHOTS + " SELECT path FROM base WHERE file_id <> '' AND path NOT IN (SELECT path FROM remote)",
    "local_only": SNAPSHOTS + " SELECT path FROM local WHERE path NOT IN (SELECT path FROM remote)",
    "verify_issues": SNAPSHOTS + """, i AS (SELECT path, CASE WHEN l.path IS NULL AND b.file_id <> '' THEN 'missing_file' WHEN b.content_hash <> l.local_hash THEN 'hash_mismatch' END AS issue FROM base b LEFT JOIN local l USING (path))
SELECT path, issue, CASE issue WHEN 'hash_mismatch' THEN 'rehash' ELSE 'remove_row' END AS fix FROM i WHERE issue IS NOT NULL""",
    "heal_drift": SNAPSHOTS + """, i AS (SELECT path, CASE WHEN l.path IS NULL AND b.file_id = '' THEN 'orphan' WHEN l.mtime <> b.local_mtime AND l.local_hash = b.content_hash THEN 'mtime'
WHEN l.mtime = b.local_mtime AND b.file_id <> '' AND b.content_hash IS NULL THEN 'hash' END AS repair FROM base b LEFT JOIN local l USING (path))
SELECT path, repair FROM i WHERE repair IS NOT NULL""",
    "cache_health": SNAPSHOTS + """ SELECT count(*) AS total, count(*) FILTER (file_id <> '') AS linked, count(*) FILTER (file_id = '') AS unlinked, count(*) FILTER (content_hash IS NULL) AS without_hash,
count(*) FILTER (cloud_mtime = 0) AS zero_cloud_mtime, count(*) FILTER (path NOT IN (SELECT path FROM local)) AS not_on_disk FROM base""",
    "gc_counts": SNAPSHOTS + """, t AS (SELECT floor(epoch(ts))::BIGINT AS s FROM events), now AS (SELECT max(s) + 60 * 86400 AS n FROM t)
SELECT (SELECT count(*) FROM base, now WHERE last_sync_at > 0 AND last_sync_at < n - 30 * 86400 AND path NOT IN (SELECT path FROM local)) AS files,
(SELECT count(*) FROM t, now WHERE s < n - 90 * 86400) AS log_rows, (SELECT count(*) FROM base WHERE path NOT IN (SELECT path FROM local)) AS refs""",
    "hash_cache_hits": SNAPSHOTS + " SELECT count(*) FILTER (size % 3 <> 0 AND mtime % 5 <> 0) AS hits, count(*) FILTER (size % 3 = 0 OR mtime % 5 = 0) AS to_compute FROM local",
    "moves_by_id": BY_ID + " SELECT * FROM p",
    "moves_by_hash": BY_HASH + " SELECT * FROM p",
    "moves_by_name": SIDES + " " + _NAMED.format("old", "new"),
    "moves_cascade": CASCADE,
    "deleted_move_hashes": SNAPSHOTS + """ SELECT path, CASE WHEN cloud_mtime % 4 = 1 AND content_hash IS NOT NULL OR cloud_mtime % 8 < 6 AND content_hash IS NOT NULL THEN content_hash
ELSE cloud_content_hash || CASE WHEN content_hash <> cloud_content_hash THEN ',' || content_hash ELSE '' END END AS hashes FROM base""",
    "sync_with_moves": WITH_MOVES,
    "moves_by_sibling_name": SIDES + " SELECT path AS old_path, replace(path, '_', '_?') AS new_path FROM new",
    "ancestor_depth": FILES + " SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS depth FROM d",
    "dup_groups": FILES + " SELECT md5(text) AS hash, length(text) AS size, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1",
    "dup_keep_newest": SNAPSHOTS + ", r AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY last_sync_at DESC, path) AS n FROM base WHERE content_hash IS NOT NULL) SELECT path, content_hash FROM r WHERE n > 1",
    "dup_actions": DUP_ACTIONS + " SELECT * FROM acts",
    "dup_action_counts": DUP_ACTIONS + " SELECT reason, count(*) FILTER (remove) AS removed, count(*) AS files FROM acts GROUP BY reason",
    "dup_categories": FILES + """, c AS (SELECT name, text AS a, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text || '!' END AS b FROM d)
SELECT name, 2 AS n, CASE WHEN a = b THEN 'identical' WHEN replace(a, chr(13) || chr(10), chr(10)) = replace(b, chr(13) || chr(10), chr(10)) THEN 'crlf_only' ELSE 'real_diff' END AS category FROM c""",
    "dir_pairs": "WITH o AS (SELECT DISTINCT 'x' || doc_id % 7 AS dir, md5(text) AS hash FROM documents) SELECT a.dir AS dir_a, b.dir AS dir_b, count(*) AS shared FROM o a JOIN o b USING (hash) WHERE a.dir < b.dir GROUP BY ALL HAVING count(*) >= 2",
    "orphan_discard": SNAPSHOTS + """, every AS (SELECT path, local_hash, split_part(path, '/', 3) AS name FROM local UNION ALL SELECT 'copy/' || path, local_hash, split_part(path, '/', 3) FROM local),
synced AS (SELECT name, local_hash FROM every WHERE path IN (SELECT path FROM remote))
SELECT path FROM every e WHERE path NOT IN (SELECT path FROM remote) AND EXISTS (SELECT 1 FROM synced b WHERE b.name = e.name AND b.local_hash = e.local_hash)""",
    "sanitize_names": "SELECT p_partkey, " + _sanitized("'  a<' || p_name || '?:' || chr(10) || '  #' || p_partkey || '  .md '") + " AS name FROM part",
    "map_names": f"""WITH n AS (SELECT p_partkey, {_sanitized("p_name || ['.note', '.clip', '', '.md', '.PNG'][p_partkey % 5 + 1]")} AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^.+\\.(note|clip)$') THEN regexp_replace(name, '\\.[^.]*$', '.md') WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN name ELSE name || '.md' END AS name FROM n""",
    "ext_counts": """WITH p AS (SELECT lower(regexp_extract(split_part(regexp_extract(url, '^[a-z]+://[^/]+/?([^?#]*)', 1), '/', -1), '[^.]\\.([^.]+)$', 1)) AS e FROM pages)
SELECT CASE WHEN e = '' THEN '(no ext)' ELSE e END AS ext, count(*) AS n FROM p GROUP BY 1""",
    "local_stats": "SELECT ['md', 'note', 'other', 'images'][doc_id % 4 + 1] AS category, count(*) AS n, sum(length(text))::BIGINT AS bytes FROM documents GROUP BY 1",
    "name_search": FILES + " SELECT path FROM d WHERE contains(lower(name), 'doc_1')",
    "path_lookup": FILES + " SELECT path FROM d WHERE contains(path, 'doc_12') ORDER BY path LIMIT 5",
    "file_sizes": """WITH b AS (SELECT doc_id, CAST(pow(2, doc_id % 36) AS BIGINT) + doc_id AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM b""",
    "content_hashes": FILES + " SELECT path, md5(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM d",
    "file_type_sniff": """WITH t AS (SELECT 'p' AS kind, page_id AS id, html AS text, '' AS ext FROM pages UNION ALL SELECT 'd', doc_id, text, 'md' FROM documents),
s AS (SELECT *, ltrim(substring(text, 1, 50), ' ' || chr(9) || chr(10) || chr(13)) AS x FROM t)
SELECT kind, id, CASE WHEN contains(substring(text, 1, 120), '"recordList"') THEN 'binary' WHEN starts_with(x, '<?xml') THEN 'xml' WHEN starts_with(x, '{"') THEN 'json'
WHEN regexp_matches(x, '(?i)^<!DOCTYPE\\s+html') OR regexp_matches(x, '(?i)^<html') THEN 'html' WHEN ext = 'md' THEN 'markdown' ELSE 'binary' END AS type FROM s""",
    "diary_guard": rf"""WITH b AS (SELECT doc_id, i, regexp_replace(line, '^{SPACES}+|{SPACES}+$', '', 'g') AS s FROM
(SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN '无' ELSE text END, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i), unnest([ls[i]]) AS v(line)),
h AS (SELECT *, starts_with(s, '#') AS head, max(CASE WHEN starts_with(s, '#') THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last_head FROM b),
c AS (SELECT doc_id, CASE WHEN head OR s IN ('', '---', '***', '___', '（可选）', '(可选)', '*无*', '无', '暂无') OR starts_with(s, '>') OR regexp_matches(s, '^[-*+]\s*\[[ xX]\]') OR regexp_matches(s, '^[-*+]$') THEN 0 ELSE length(s) END AS n, last_head FROM h),
t AS (SELECT doc_id, coalesce(sum(n) FILTER (last_head IS NULL), 0)::BIGINT AS protected_chars, sum(n)::BIGINT + 0 AS body_chars FROM c GROUP BY doc_id)
SELECT doc_id, protected_chars, body_chars + CASE WHEN false THEN 1 ELSE 0 END AS body_chars, protected_chars >= 10 OR body_chars >= 8 AS written FROM t""",
    "html_strip": rf"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>', '', 'g'), '<[^>]+>', '', 'g'),
'&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACES}+|{SPACES}+$', '', 'g') AS text FROM pages""",
    "html_links": """SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a[^>]*href=["'']([^"'']*)["'']', 1), chr(10)) AS links FROM pages""",
    "html_headings": r"SELECT page_id, array_to_string(list_concat(regexp_extract_all(html, '(?i)<h1[^>]*>([\s\S]*?)</h1>', 1), regexp_extract_all(html, '(?i)<h2[^>]*>([\s\S]*?)</h2>', 1)), chr(10)) AS headings FROM pages",
    "references": FILES + """ SELECT path AS source_path, dir || '/img/' || doc_id || '.png' AS ref_path FROM d UNION ALL SELECT path, dir || '/n' || doc_id % 5 || '.md' FROM d""",
    "block_hashes": BLOCKS.format("documents"),
    "block_diff": f"""WITH a AS ({BLOCKS.format("documents")}), c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || '!' WHEN 1 THEN substring(text, 1, 4000) ELSE text END AS text FROM documents), b AS ({BLOCKS.format("c")})
SELECT doc_id, block, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id, block) WHERE a.hash IS DISTINCT FROM b.hash""",
    "md_normalize": MD_NORMALIZE,
    "md_to_json_roundtrip": r"SELECT doc_id, true AS same, md5(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS md5 FROM documents",
    "note_round_trips": """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS words, coalesce(regexp_extract_all(text, '[A-Za-z]+')[1], 'none') AS w FROM documents)
SELECT doc_id, md5(concat_ws(chr(10), '# ' || w, '', '- ' || w, '  - two', '1. ' || w, '', '> q ' || w, '> r', '', '', '```py', '# ' || array_to_string(words, ' '), '> x', '```', '', '| a | ' || w || ' |', '| -- | -- |', '| 1 |  |', '', '', '![](u)', '', '---', '', 'plain *' || w || '* and **[l](' || w || ') ***x***')) AS md5 FROM w""",
    "merge3": """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '<<<<<<< LOCAL' || chr(10) || 'ours ' || doc_id || chr(10) || '=======' || chr(10) || 'theirs ' || doc_id || chr(10) || '>>>>>>> CLOUD' ELSE 'ours ' || doc_id END
|| chr(10) || text || chr(10) || CASE doc_id % 3 WHEN 1 THEN 'theirs' ELSE 'last line' END || chr(10)) AS merged, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS conflicts FROM documents""",
    "delta_roundtrip": """WITH t AS (SELECT doc_id, encode(text) AS a, encode(text[:5000] || CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE '' END || text[5001:]) AS b FROM documents),
blocks AS (SELECT doc_id, hex(a)[8192 * k + 1 : 8192 * k + 8192] AS x, hex(b)[8192 * k + 1 : 8192 * k + 8192] AS y FROM t, unnest(range(0, CAST(ceil(octet_length(b) / 4096.0) AS BIGINT))) AS u(k)),
sums AS (SELECT doc_id, sum(CASE WHEN x = y THEN 9 ELSE 5 + length(y) // 2 END)::BIGINT AS bytes FROM blocks GROUP BY doc_id)
SELECT doc_id, md5(b) AS patched, coalesce(bytes, 0) AS bytes, (9 * ceil(octet_length(a) / 4096.0))::BIGINT AS unchanged_bytes FROM t LEFT JOIN sums USING (doc_id)""",
    "bloom_membership": "SELECT item_id, true AS found FROM benchmark",
    "merkle_dirs": MERKLE,
    "merkle_diff": FILES + ", c AS (SELECT dir FROM d WHERE doc_id % 97 IN (7, 8, 9)) SELECT dir FROM c UNION SELECT split_part(dir, '/', 1) FROM c UNION SELECT '' FROM c",
    "tree_paths": TREE + " SELECT id, path, depth FROM walk",
    "tree_list_depth": TREE + " SELECT id, path, depth FROM walk WHERE depth < 2",
    "tree_directories": FILES + " SELECT '' AS dir, 0 AS depth UNION SELECT split_part(dir, '/', 1), 1 FROM d UNION SELECT dir, 2 FROM d",
    "sync_log_tail": "SELECT event_id AS id, floor(epoch(ts))::BIGINT AS timestamp, 'u/' || user_id AS path, event_type AS action FROM events ORDER BY event_id DESC LIMIT 50",
    "sync_log_retention": "WITH l AS (SELECT floor(epoch(ts))::BIGINT AS t, event_type AS action FROM events) SELECT action, count(*) AS n FROM l WHERE t >= (SELECT floor(avg(t))::BIGINT FROM l) GROUP BY action",
    "feed_watermark": FEED + " SELECT coalesce(max(version), 0) AS version FROM f",
    "feed_latest": FEED + " SELECT id, max(version) AS version, arg_max(name, version) AS name FROM f GROUP BY id",
    "feed_overflow": FEED + ", t AS (SELECT max(version) AS m FROM f), p AS (SELECT version, m FROM f, t WHERE version > m - 30) SELECT count(*) FILTER (version > m - 10) AS fresh, count(*) FILTER (version <= m - 10) = 0 AS overflow FROM p",
    "feed_applied": FEED + " SELECT id, arg_max(name, version) AS name FROM f GROUP BY id",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY user_id""",
    "profile_hot": """WITH t AS (SELECT sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem), s AS (SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT)) AS self_time FROM lineitem GROUP BY 1)
SELECT id, p_name AS function, self_time::BIGINT AS self_time, round(100.0 * self_time / total, 4) AS pct FROM s JOIN part ON p_partkey = id, t WHERE p_partkey % 10 <> 0 ORDER BY self_time DESC, id LIMIT 20""",
    "preferred_names": FILES + """, r AS (SELECT path, 'A' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS k, doc_id % 100 AS m FROM d UNION ALL SELECT path, 'B' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END, doc_id % 90 FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k DESC, m DESC, id DESC) AS n FROM r) SELECT path, id FROM n WHERE n = 1""",
    "note_pairs": "SELECT 'doc_' || doc_id AS stem FROM documents WHERE doc_id % 3 = 0",
    "sync_full_plan": PLANNED + """, loose AS (SELECT l.path FROM local l WHERE l.path NOT IN (SELECT path FROM remote) AND EXISTS (
  SELECT 1 FROM local m WHERE m.path IN (SELECT path FROM remote) AND split_part(m.path, '/', 3) = split_part(l.path, '/', 3) AND m.local_hash = l.local_hash)),
p AS (SELECT path, CASE WHEN state = 'localNew' AND path IN (SELECT path FROM loose) THEN 'gone' ELSE state END AS state, action FROM planned),
g AS (SELECT CASE WHEN count(*) FILTER (action LIKE 'delete%') > 5 THEN 'suspended' ELSE 'ok' END AS guardrail FROM p)
SELECT path, state, action, CAST(NULL AS VARCHAR) AS old_path, CASE action WHEN 'download' THEN 1 WHEN 'upload' THEN 2 ELSE 3 END AS phase, guardrail FROM p, g""",
    "explain_decisions": REFINED + f" SELECT path, s.state, r.state AS refined, {_ACTION.replace('state', 'r.state')} AS action FROM states s JOIN refined r USING (path)",
    "audit_log": REFINED + f""" SELECT path, {_ACTION} AS action, '{{"status":"ok"}}' AS guardrail_checks FROM refined WHERE {_ACTION} <> 'skip'""",
    "cleanup_plan": SNAPSHOTS + " SELECT path, CASE WHEN path LIKE 'src3/%' THEN 'excluded' ELSE 'inactive' END AS reason FROM base WHERE path LIKE 'src3/%' OR (path NOT IN (SELECT path FROM remote) AND path NOT IN (SELECT path FROM local))",
    "incremental_paths": FILES + """, k AS (SELECT DISTINCT dir FROM d WHERE doc_id % 5 <> 0)
SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE dir || '/n' || doc_id || '.md' END AS path, 'F' || doc_id AS id, doc_id AS mtime FROM d
WHERE doc_id % 2 = 0 OR (doc_id % 7 <> 0 AND dir IN (SELECT dir FROM k))""",
    "upload_targets": SNAPSHOTS + " SELECT path, coalesce(nullif(r.id, ''), nullif(b.file_id, '')) AS file_id, coalesce(r.domain, b.domain) AS domain FROM local LEFT JOIN remote r USING (path) LEFT JOIN base b USING (path)",
    "hydrate_local_only": SNAPSHOTS + """, listed AS (SELECT 'F' || doc_id AS id, dir, name FROM d WHERE doc_id % 2 = 0), known AS (SELECT DISTINCT parent_id FROM remote),
seen AS (SELECT DISTINCT parent_id FROM remote WHERE id IN (SELECT id FROM listed)),
w AS (SELECT l.path, d.dir, d.name, d.dir IN (SELECT parent_id FROM known) AND d.dir NOT IN (SELECT parent_id FROM seen) AS blocked FROM local l JOIN d USING (path) WHERE l.path NOT IN (SELECT path FROM remote))
SELECT path, CASE WHEN NOT blocked THEN x.id END AS id, CASE WHEN blocked THEN 'blocked' WHEN x.id IS NOT NULL THEN 'found' ELSE 'absent' END AS status FROM w LEFT JOIN listed x ON x.dir = w.dir AND x.name = w.name""",
}
