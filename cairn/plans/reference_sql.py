"""The same results in DuckDB's SQL."""

from cairn.plans.found_sql import BELOW, DOCS, HASH

NS = f"""WITH RECURSIVE top AS (SELECT bucket, max(epoch) epoch FROM snapshots GROUP BY bucket),
n AS (SELECT bucket, id, gen, type, (mode & 4095)::INT AS mode, uid, gid, nlink, size, atime_ns, mtime_ns, ctime_ns, parent, target FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket, epoch, id ORDER BY loaded_at DESC) rn FROM inodes JOIN top USING (bucket, epoch)) WHERE rn = 1),
d AS (SELECT DISTINCT bucket, dir_id, name, child_id FROM dirents JOIN top USING (bucket, epoch)),
r AS (SELECT DISTINCT bucket, inode_id AS id, idx, {HASH.format(c='hash')} AS hash, size FROM chunk_refs JOIN top USING (bucket, epoch)),
f AS (SELECT doc_id, encode(text) AS b, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, i AS idx, b[i * 1024 + 1:least(i * 1024 + 1024, size)] AS data, least(size - i * 1024, 1024)::BIGINT AS size FROM f, range((size + 1023) // 1024) t(i)),
callers(c_uid, c_gid, gids) AS (VALUES (0, 0, [10, 20]), (501, 500, [501, 502]), (501, 20, [501]), (2000, 20, [201, 202]), (3000, 300, [302, 20, 301]), (4000, 400, [401, 402])),
q AS (SELECT n.*, c_uid::BIGINT AS c_uid, c_gid::BIGINT AS c_gid, c_gid = gid OR list_contains(gids, gid) AS member, c_gid = 20 OR list_contains(gids, 20) AS in20 FROM n, callers),
q2 AS (SELECT *, CASE WHEN c_uid = uid THEN (mode >> 6) & 7 WHEN member THEN (mode >> 3) & 7 ELSE mode & 7 END AS own,
  type = 2 AS dir, c_uid = 0 OR c_uid = uid AS mine FROM q),
q3 AS (SELECT *, c_uid = 0 OR own & 4 = 4 AS pr, c_uid = 0 OR own & 2 = 2 AS pw,
  CASE WHEN c_uid = 0 THEN dir OR mode & 73 <> 0 ELSE own & 1 = 1 END AS px FROM q2),
q4 AS (SELECT *, CASE WHEN dir THEN 21 WHEN pr THEN 0 WHEN type = 1 AND (c_uid = uid OR px) THEN 0 ELSE 13 END AS s_read,
  CASE WHEN dir THEN 21 WHEN pw THEN 0 WHEN type = 1 AND c_uid = uid THEN 0 ELSE 13 END AS s_write,
  CASE WHEN mine THEN 0 ELSE 1 END AS s_own, CASE WHEN mine OR pw THEN 0 ELSE 1 END AS s_times,
  CASE WHEN NOT dir THEN 20 WHEN pw AND px THEN 0 ELSE 13 END AS s_wx FROM q3),
l AS (SELECT d.bucket, d.dir_id, row_number() OVER (PARTITION BY d.bucket, d.dir_id ORDER BY d.name) + 2 AS cookie, d.name, d.child_id, n.id IS NOT NULL AS there
  FROM d LEFT JOIN n ON n.bucket = d.bucket AND n.id = d.child_id
  UNION ALL SELECT bucket, id, 1, '.', id, true FROM n WHERE type = 2
  UNION ALL SELECT bucket, id, 2, '..', CASE WHEN id = 1 THEN 1 ELSE coalesce(parent, id) END, true FROM n WHERE type = 2)
"""


def _page(after: int, budget: int, cost: int) -> str:
    return f"""pg AS (SELECT *, sum(strlen(name) + {cost}) OVER w AS u, row_number() OVER w AS rn FROM (
  SELECT *, max(cookie) OVER (PARTITION BY bucket, dir_id) AS top_cookie FROM l WHERE there) WHERE cookie > {after}
  WINDOW w AS (PARTITION BY bucket, dir_id ORDER BY cookie ROWS UNBOUNDED PRECEDING)),
pe AS (SELECT *, max(cookie) OVER (PARTITION BY bucket, dir_id) = top_cookie AS eof FROM pg WHERE u <= {budget} OR rn = 1)"""


# a file after 100 times 'a' at byte 1000 and PATCHED at 1050: its first two chunks of 1,024 bytes
PAD = "CASE WHEN size >= 1000 THEN b[1:1000] ELSE b || unhex(repeat('00', 1000 - size::INT)) END"
W0 = f"{PAD} || encode(repeat('a', 24))"
W1 = "encode(repeat('a', 26) || 'PATCHED' || repeat('a', 43)) || CASE WHEN size > 1100 THEN b[1101:least(size, 2048)] ELSE ''::BLOB END"
NAME = "CASE WHEN name IS NULL OR name IN ('', '.', '..') THEN 22 WHEN strlen(name) > 255 THEN 63 WHEN contains(name, '/') OR contains(name, chr(0)) THEN 22 ELSE 0 END"
HANDLE = "printf('%016X%016X', id, gen)"
KEY = r"regexp_replace(regexp_replace(snapshot, '^\s*(\./|/)*', ''), '\s+$', '')"

# FNV-1a over the bytes spelt in h, by its offset basis and prime
FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(length(h) // 2), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::HUGEINT)),
        lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
# a name is held if it and the names used since fit the cache together
KINDS = {"signup": 600, "purchase": 800, "error": 500, "view": 400, "click": 500}
LRU = f"""WITH e AS (SELECT user_id, ts, event_id, event_type AS k, length(event_type) * 100 AS sz, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT *, {', '.join(f"max(i) FILTER (k = '{n}') OVER p AS l_{n}" for n in KINDS)} FROM e WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE k {' '.join(f"WHEN '{n}' THEN l_{n}" for n in KINDS)} END AS own FROM l),
h AS (SELECT user_id, ts, event_id, own IS NOT NULL AND sz + {' + '.join(f"CASE WHEN l_{n} > own THEN {z} ELSE 0 END" for n, z in KINDS.items())} <= 1300 AS hit FROM o)
"""

# chunks referred to by a snapshot that is not pruned, or by a bucket's newest
KEPT = f"""WITH kept AS (SELECT bucket, epoch FROM snapshots WHERE pruned_ns IS NULL UNION SELECT bucket, max(epoch) FROM snapshots GROUP BY bucket),
m AS (SELECT DISTINCT {HASH.format(c='hash')} AS hash FROM chunk_refs SEMI JOIN kept USING (bucket, epoch))
"""

SQL = {
    "src_03_ranges": NS + "SELECT doc_id, hex(b[5:12]) AS bytes FROM f",
    "src_04_head": NS + "SELECT doc_id, size, md5(b) AS etag FROM f",
    "src_05_list": "SELECT DISTINCT 'chunks/' || lower(hash) AS key, len AS size FROM chunks WHERE 'chunks/' || lower(hash) > 'chunks/8' ORDER BY key LIMIT 100",
    "src_08_load": NS + f", h AS (SELECT h, max(len) len FROM (SELECT {HASH.format(c='hash')} h, len FROM chunks WHERE deleted_ns IS NULL UNION ALL SELECT hash, len FROM base_chunks) GROUP BY h) SELECT bucket, id, idx::BIGINT AS idx, coalesce(len, 0) AS len, CASE WHEN hash IS NULL OR len IS NOT NULL THEN 0 ELSE 5 END AS status FROM r LEFT JOIN h ON h = hash",
    "snk_04_upload": NS + ", e AS (SELECT DISTINCT sha256(encode(text)) h FROM eval_items WHERE strlen(text) <= 1024) SELECT sha256(data) AS hash, any_value(size) AS len FROM k WHERE sha256(data) NOT IN (SELECT h FROM e) GROUP BY sha256(data)",
    "snk_06_errors": "SELECT doc_id, CASE WHEN http_status = 404 OR doc_id % 3 = 1 THEN 'NotFound' WHEN http_status IN (412, 409) OR doc_id % 3 = 2 THEN 'Precondition' WHEN http_status = 501 THEN 'Unsupported' ELSE 'Other' END AS error FROM documents",
    "prj_01_getattr": NS + "SELECT bucket, id, gen, type, mode, nlink, uid, gid, size, atime_ns, mtime_ns, ctime_ns FROM n",
    "prj_02_resolve": NS + "SELECT bucket, id AS asked, CASE WHEN id % 7 = 0 THEN 10001 WHEN id % 3 = 0 THEN 70 ELSE 0 END AS status FROM n",
    "prj_03_handles": NS + f"SELECT bucket, {HANDLE} AS handle, id, gen FROM n",
    "prj_04_names": f"SELECT name, {NAME} AS status FROM (SELECT name FROM dirents UNION SELECT url FROM documents UNION SELECT repeat(bucket, 13) FROM snapshots)",
    "prj_05_readlink": NS + "SELECT bucket, id, CASE WHEN type = 5 THEN 0 ELSE 22 END AS status, CASE WHEN type = 5 THEN target END AS target FROM n",
    "prj_07_places": NS + "SELECT bucket, id, size // 65536 AS idx, size % 65536 AS off FROM n",
    "prj_08_ends": NS + "SELECT bucket, id, CASE WHEN size > 1000 THEN 1000 + least(70000, size - 1000) END AS end_at FROM n",
    "prj_09_spans": NS + ", x AS (SELECT bucket, id, 1000 + least(200000, size - 1000) AS e FROM n WHERE type = 1 AND size > 1000), y AS (SELECT bucket, id, e, i AS idx, greatest(1000, i * 65536) AS s FROM x, range(0, (e - 1) // 65536 + 1) t(i)) SELECT bucket, id, idx, s - idx * 65536 AS within, least(e, (idx + 1) * 65536) - s AS take FROM y",
    "prj_12_status": "SELECT doc_id, CASE WHEN http_status IN (0, 1, 2, 5, 13, 17, 20, 21, 22, 27, 30, 63, 66, 70, 10001, 10002, 10003, 10004, 10006) THEN http_status ELSE 5 END AS status FROM documents",
    "prj_13_etags": "SELECT doc_id, host AS etag FROM documents",
    "pol_01_checks": NS + """SELECT bucket, id, c_uid, c_gid, op, CASE op WHEN 'read' THEN s_read WHEN 'write' THEN s_write WHEN 'truncate' THEN s_write WHEN 'chmod' THEN s_own
        WHEN 'chown' THEN CASE WHEN NOT mine OR (c_uid <> 0 AND uid <> 501) THEN 1 ELSE 0 END WHEN 'chgrp' THEN CASE WHEN NOT mine OR (c_uid <> 0 AND NOT in20) THEN 1 ELSE 0 END
        WHEN 'settimes' THEN s_times WHEN 'lookup' THEN CASE WHEN NOT dir THEN 20 WHEN px THEN 0 ELSE 13 END WHEN 'readdir' THEN CASE WHEN NOT dir THEN 20 WHEN pr THEN 0 ELSE 13 END
        WHEN 'none' THEN 10006 ELSE s_wx END AS status
        FROM q4, (SELECT unnest(['read', 'write', 'truncate', 'chmod', 'chown', 'chgrp', 'settimes', 'lookup', 'readdir', 'addentry', 'removeentry', 'rename', 'none']) AS op)""",
    "pol_14_access": NS + """, b AS (SELECT *, CASE WHEN pr THEN 1 ELSE 0 END + CASE WHEN dir AND (pr OR px) THEN 2 ELSE 0 END + CASE WHEN NOT dir AND mode & 73 <> 0 AND px THEN 32 ELSE 0 END AS ro,
        CASE WHEN pw THEN 12 ELSE 0 END + CASE WHEN pw AND dir THEN 16 ELSE 0 END AS rw FROM q4) SELECT bucket, id, c_uid, c_gid, ro + rw AS bits, ro AS read_only_bits FROM b""",
    "pol_16_all": NS + "SELECT bucket, id, c_uid, c_gid, CASE WHEN s_read <> 0 THEN s_read WHEN c_uid = 4000 THEN 1 ELSE s_own END AS status FROM q4",
    "pol_18_setattr": NS + "SELECT bucket, id, c_uid, c_gid, CASE WHEN id % 2 = 0 AND s_write <> 0 THEN s_write WHEN id % 3 = 0 AND s_own <> 0 THEN s_own WHEN id % 5 = 0 AND s_times <> 0 THEN s_times ELSE 0 END AS status FROM q4",
    "ns_01_lookup": NS + """, a AS (SELECT bucket, dir_id, name, child_id FROM d UNION ALL SELECT bucket, id, '.', id FROM n UNION ALL SELECT bucket, id, '..', CASE WHEN id = 1 THEN 1 ELSE parent END FROM n UNION ALL SELECT bucket, id, 'no such name', NULL FROM n),
        s AS (SELECT a.*, CASE WHEN x.id IS NULL THEN 70 WHEN x.type <> 2 THEN 20 WHEN y.id IS NULL THEN 2 ELSE 0 END AS status FROM a LEFT JOIN n x ON x.bucket = a.bucket AND x.id = a.dir_id LEFT JOIN n y ON y.bucket = a.bucket AND y.id = a.child_id)
        SELECT bucket, dir_id, name, CASE WHEN status = 0 THEN child_id END AS child_id, status FROM s""",
    "ns_02_walk": NS + """, sp AS (SELECT * FROM d WHERE name IS NOT NULL AND name NOT IN ('', '.', '..') AND NOT contains(name, '/')),
        lk AS (SELECT *, child_id IN (SELECT dir_id FROM sp i WHERE i.bucket = sp.bucket) AS inner_ FROM sp WHERE child_id <> dir_id),
        go AS (SELECT DISTINCT bucket, 1::BIGINT AS at, '' AS path, [1::BIGINT] AS above, 0 AS st FROM sp
          UNION ALL SELECT go.bucket, lk.child_id, go.path || '/' || lk.name, list_append(go.above, lk.child_id), CASE WHEN st <> 0 THEN st WHEN x.id IS NULL THEN 70 WHEN x.type <> 2 THEN 20 WHEN y.id IS NULL THEN 2 ELSE 0 END
          FROM go JOIN lk ON lk.bucket = go.bucket AND lk.dir_id = go.at AND lk.inner_ AND NOT list_contains(go.above, lk.child_id)
          LEFT JOIN n x ON x.bucket = go.bucket AND x.id = go.at LEFT JOIN n y ON y.bucket = go.bucket AND y.id = lk.child_id),
        s AS (SELECT go.bucket, go.path || '/' || sp.name AS path, sp.child_id, CASE WHEN st <> 0 THEN st WHEN x.id IS NULL THEN 70 WHEN x.type <> 2 THEN 20 WHEN y.id IS NULL THEN 2 ELSE 0 END AS status
          FROM go JOIN sp ON sp.bucket = go.bucket AND sp.dir_id = go.at LEFT JOIN n x ON x.bucket = go.bucket AND x.id = go.at LEFT JOIN n y ON y.bucket = go.bucket AND y.id = sp.child_id)
        SELECT bucket, path, CASE WHEN status = 0 THEN child_id END AS id, status FROM s""",
    "ns_04_listing": NS + "SELECT bucket, dir_id, cookie, name, there FROM l",
    "ns_04_replies": NS + ", " + _page(2, 512, 32) + " SELECT bucket, dir_id, cookie, name, eof FROM pe",
    "ns_05_plus": NS + ", " + _page(0, 1024, 160) + f" SELECT pe.bucket, dir_id, cookie, name, {HANDLE} AS handle, type, mode, size FROM pe JOIN n ON n.bucket = pe.bucket AND n.id = pe.child_id",
    "ns_06_fsstat": NS + ", u AS (SELECT bucket, sum(size) FILTER (hash IS NOT NULL)::BIGINT s FROM r GROUP BY bucket), c AS (SELECT bucket, count(*) n FROM n GROUP BY bucket) SELECT bucket, coalesce(s, 0) AS used, coalesce(s, 0) + 1125899906842624 AS total, c.n AS files, c.n + 1073741824 AS total_files FROM c LEFT JOIN u USING (bucket)",
    "ns_08_oversize": NS + "SELECT bucket, count(*) AS n, max(size) AS largest FROM n WHERE type = 1 AND size > 1000000 GROUP BY bucket",
    "mut_08_links": NS + "SELECT n.bucket, n.id, count(DISTINCT c.id) + 2 AS links FROM n LEFT JOIN d ON d.bucket = n.bucket AND d.dir_id = n.id LEFT JOIN n c ON c.bucket = d.bucket AND c.id = d.child_id AND c.type = 2 WHERE n.type = 2 GROUP BY n.bucket, n.id",
    "dat_01_chunks": NS + "SELECT doc_id, idx, sha256(data) AS hash, size FROM k",
    "dat_03_dedup": NS + "SELECT sha256(data) AS hash, count(*) AS n_refs, max(size) AS len FROM k GROUP BY sha256(data) HAVING count(*) > 1",
    "dat_04_reads": NS + "SELECT doc_id AS req, sha256(CASE WHEN size > 500 THEN b[501:least(size, 3500)] ELSE ''::BLOB END) AS digest, size <= 3500 AS eof, 0 AS status FROM f",
    "dat_08_truncate": NS + ", c AS (SELECT bucket, id, size // 2 AS ns FROM n WHERE type = 1), z AS (SELECT c.*, coalesce(max(r.idx) + 1, 0) AS have FROM c LEFT JOIN r USING (bucket, id) GROUP BY c.bucket, c.id, c.ns) SELECT r.bucket, r.id, idx::BIGINT AS idx, hash FROM r LEFT JOIN c USING (bucket, id) WHERE ns IS NULL OR idx < (ns + 65535) // 65536 UNION ALL SELECT bucket, id, i, NULL FROM z, range(have, (ns + 65535) // 65536) t(i)",
    "dat_12_used": NS + "SELECT bucket, id, coalesce(sum(size) FILTER (hash IS NOT NULL), 0)::BIGINT AS used, count(*) FILTER (hash IS NULL) AS holes FROM r GROUP BY bucket, id",
    "dat_15_extents": NS + ", x AS (SELECT *, hash IS NULL AS hole, coalesce(sum(size) OVER (PARTITION BY bucket, id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY bucket, id ORDER BY idx) - row_number() OVER (PARTITION BY bucket, id, hole ORDER BY idx) AS g FROM x) SELECT bucket, id, min(o)::BIGINT AS off, sum(size)::BIGINT AS len, hole FROM y GROUP BY bucket, id, hole, g",
    "dat_17_clone": NS + "SELECT r.bucket, r.id + 100000 AS id, (r.idx + 1)::BIGINT AS idx, r.hash, r.size FROM r JOIN r c ON c.bucket = r.bucket AND c.id = r.id AND c.idx = 2 WHERE r.idx < 3",
    "dat_18_locate": NS + ", x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY bucket, id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM r) SELECT n.bucket, n.id, n.size // 2 AS at, idx::BIGINT AS idx, n.size // 2 - o AS within FROM n JOIN x ON x.bucket = n.bucket AND x.id = n.id AND n.size // 2 >= o AND n.size // 2 < o + x.size WHERE type = 1",
    "dat_20_pre": "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, epoch, id ORDER BY loaded_at DESC) rn FROM inodes) WHERE rn = 1) SELECT bucket, id, gen, epoch, lag(size) OVER w AS pre_size, lag(mtime_ns) OVER w AS pre_mtime_ns FROM s WINDOW w AS (PARTITION BY bucket, id, gen ORDER BY epoch)",
    "int_01_verify": NS + "SELECT CASE WHEN doc_id % 9 = 0 THEN 5 ELSE 0 END AS status, count(*) AS n FROM k GROUP BY 1",
    "int_02_missing": NS + f"SELECT bucket, id, idx::BIGINT AS idx FROM r WHERE hash IS NOT NULL AND hash NOT IN (SELECT {HASH.format(c='hash')} FROM chunks WHERE deleted_ns IS NULL UNION SELECT hash FROM base_chunks)",
    "int_06_dangling": NS + "SELECT bucket, dir_id, name FROM d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.bucket = d.bucket AND n.id = d.child_id)",
    "cmt_05_classify": f"WITH c AS (SELECT bucket, max(key) known, min(key) doubt FROM snapshots GROUP BY bucket), x AS (SELECT *, {KEY} AS k FROM roots JOIN c USING (bucket)) SELECT DISTINCT bucket, epoch, written_ns, CASE WHEN writer IS NULL THEN 'Theirs' WHEN epoch % 11 = 0 OR version <> 1 THEN 'Failed' WHEN k = doubt THEN 'Ours' WHEN k = known THEN 'Unchanged' ELSE 'Theirs' END AS verdict FROM x",
    "cmt_10_prunable": "WITH k AS (SELECT DISTINCT bucket, key FROM snapshots), x AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key DESC) rn FROM k) SELECT bucket, key FROM x WHERE rn > 4",
    "cmt_14_modes": "WITH x AS (SELECT event_id, ['Writable', 'ReadOnly', 'Diverged'][user_id % 3 + 1] AS s, event_type FROM events), y AS (SELECT event_id, s, CASE WHEN s = 'Writable' AND event_type = 'error' THEN 'Diverged' END AS next FROM x) SELECT event_id, next, CASE coalesce(next, s) WHEN 'Writable' THEN 0 WHEN 'ReadOnly' THEN 30 ELSE 70 END AS gate FROM y",
    "cmt_16_as_of": "SELECT DISTINCT bucket, epoch, dir_id, name, child_id FROM dirents JOIN (SELECT bucket, min(epoch) epoch FROM snapshots GROUP BY bucket) USING (bucket, epoch)",
    "cmt_17_mark": KEPT + "SELECT hash FROM m WHERE regexp_full_match(hash, '[0-9a-f]{64}')",
    "cmt_18_sweep": KEPT + f", s AS (SELECT {HASH.format(c='hash')} AS hash, len, stored_ns FROM chunks WHERE deleted_ns IS NULL AND stored_ns < 1745000000000000000) SELECT DISTINCT hash, len, stored_ns FROM s WHERE hash NOT IN (SELECT hash FROM m WHERE hash IS NOT NULL)",
    "fsm_02_fold": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS t FROM events),
        w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'Known' AS state, 0 AS refused FROM e
        UNION ALL SELECT e.user_id, e.i, CASE WHEN state = 'Known' AND t = 'purchase' THEN 'InDoubt' WHEN state = 'InDoubt' AND t IN ('click', 'view') THEN 'Known' ELSE state END,
          refused + CASE WHEN (state = 'Known' AND t IN ('signup', 'purchase')) OR (state = 'InDoubt' AND t IN ('click', 'view')) THEN 0 ELSE 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
        SELECT user_id, arg_max(state, i) AS state, arg_max(refused, i) AS refused FROM w GROUP BY user_id""",
    "str_01_repeats": "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) < 120000000, false) AS repeat FROM events",
    "str_02_idempotent": "SELECT event_id, event_id % 5 IN (0, 2, 4) AS idempotent FROM events",
    "src_06_namespace": DOCS + "SELECT bucket, epoch, count(DISTINCT owner_id) AS n_inodes, count(DISTINCT CASE WHEN json_extract_string(x, '$.t') = '2' THEN owner_id END) AS n_dirs, max(owner_id) AS top_id FROM o GROUP BY bucket, epoch",
    "snk_05_encode": NS + "SELECT n.bucket, count(*) AS n_inodes, max(mtime_ns) AS newest_ns, any_value(k.c) AS n_entries FROM n LEFT JOIN (SELECT bucket, count(*) c FROM d SEMI JOIN n ON n.bucket = d.bucket AND n.id = d.dir_id GROUP BY bucket) k USING (bucket) GROUP BY n.bucket",
    "ns_03_ancestors": BELOW + ", nd AS (SELECT DISTINCT bucket, dir_id, child_id FROM dirents JOIN top USING (bucket, epoch)), a AS (SELECT bucket, dir_id AS id, child_id AS below_id FROM nd UNION SELECT bucket, child_id, dir_id FROM nd) SELECT a.bucket, a.id, a.below_id, d.id IS NOT NULL OR a.id = a.below_id AS inside FROM a LEFT JOIN d ON d.bucket = a.bucket AND d.id = a.id AND d.below_id = a.below_id",
    "ns_07_stats": "SELECT bucket, max(epoch) AS epoch, count(DISTINCT (epoch, id)) AS n_inodes FROM inodes GROUP BY bucket",
    "dat_05_refs": NS + ", x AS (SELECT bucket, id, 100000 + least(300000, size - 100000) AS e FROM n WHERE type = 1 AND size > 100000), y AS (SELECT bucket, id, e, i AS idx, greatest(100000, i * 65536) AS s FROM x, range(1, (e - 1) // 65536 + 1) t(i)) SELECT bucket, id, y.idx, hash, least(e, (y.idx + 1) * 65536) - s AS take FROM y JOIN r USING (bucket, id, idx) WHERE hash IS NOT NULL",
    "dat_06_overlay": NS + "SELECT doc_id, idx, CASE WHEN idx <> 1 THEN sha256(data) END AS hash, CASE WHEN idx = 1 THEN 8 ELSE size END AS size FROM k",
    "dat_07_writes": NS + f"""SELECT doc_id, 0::BIGINT AS idx, sha256({W0}) AS hash FROM f UNION ALL SELECT doc_id, 1, sha256({W1}) FROM f""",
    "dat_09_trims": NS + ", c AS (SELECT bucket, id, size, unnest([size // 2, size // 2 - 7]) AS ns FROM n WHERE type = 1) SELECT bucket, id, idx::BIGINT AS idx, min(ns % 65536) AS to_len FROM c JOIN r USING (bucket, id) WHERE ns > 0 AND ns < c.size AND ns % 65536 <> 0 AND idx = ns // 65536 AND hash IS NOT NULL GROUP BY bucket, id, idx",
    "dat_10_flush": NS + f""", p AS (SELECT doc_id, 0::BIGINT AS idx, {W0} AS data FROM f UNION ALL SELECT doc_id, 1, {W1} FROM f)
        SELECT doc_id, idx, sha256(data) AS hash, octet_length(data)::BIGINT AS size FROM p UNION ALL SELECT doc_id, idx, sha256(data), size FROM k WHERE idx > 1""",
    "dat_13_limits": "SELECT DISTINCT bucket, chunk_size * 1048576 AS max_size FROM snapshots",
    "dat_16_punch": NS + "SELECT r.bucket, r.id, idx::BIGINT AS idx, CASE WHEN n.type = 1 AND idx IN (1, 2) THEN NULL ELSE hash END AS hash, r.size FROM r LEFT JOIN n ON n.bucket = r.bucket AND n.id = r.id",
    "dat_19_unpinned": NS + "SELECT bucket, id FROM n WHERE type <> 5 AND NOT EXISTS (SELECT 1 FROM d WHERE d.bucket = n.bucket AND d.child_id = n.id)",
    "mut_01_make": NS + ", t AS (SELECT n.bucket, max(n.id) + 1 AS nx FROM n WHERE bucket IN (SELECT bucket FROM d WHERE dir_id = 1) GROUP BY n.bucket) SELECT bucket, m.* FROM t, LATERAL (VALUES ('~new', nx, 1, 420, 1::BIGINT, 0::BIGINT), ('~dir', nx + 1, 2, 493, 2, 0), ('~link', nx + 2, 5, 511, 1, 2)) m(name, child_id, type, mode, nlink, size)",
    "mut_06_remove": NS + ", m AS (SELECT bucket, min(name) AS name, count(*) AS c FROM d WHERE dir_id = 1 GROUP BY bucket), s AS (SELECT m.*, CASE WHEN n.id IS NULL THEN 2 WHEN n.type = 2 THEN 21 ELSE 0 END AS status FROM m JOIN d ON d.bucket = m.bucket AND d.dir_id = 1 AND d.name = m.name LEFT JOIN n ON n.bucket = d.bucket AND n.id = d.child_id) SELECT bucket, status, c + 3 - CASE WHEN status = 0 THEN 1 ELSE 0 END AS n_names FROM s",
    "mut_07_rename": NS + ", m AS (SELECT bucket, min(name) AS name FROM d WHERE dir_id = 1 GROUP BY bucket) SELECT m.bucket, CASE WHEN n.id IS NULL THEN 2 ELSE 0 END AS status, n.id AS child_id FROM m JOIN d ON d.bucket = m.bucket AND d.dir_id = 1 AND d.name = m.name LEFT JOIN n ON n.bucket = d.bucket AND n.id = d.child_id",
    "mut_09_setattr": NS + "SELECT bucket, CASE WHEN uid = 501 THEN 0 ELSE 1 END AS status, CASE WHEN uid = 501 THEN 384 ELSE mode END AS mode FROM n WHERE id = 1",
    "mut_11_guard": NS + "SELECT bucket, id, CASE WHEN id % 2 <> 0 AND id % 3 = 0 AND ctime_ns <> 1 THEN 10002 ELSE 0 END AS status FROM n",
    "fsm_01_edges": "SELECT * FROM (VALUES ('Writable', 'Diverge', 'Diverged', 'mode'), ('Known', 'SwapOK', 'Known', 'rootKnowledge'), ('Known', 'SwapUnknown', 'InDoubt', 'rootKnowledge'), ('InDoubt', 'ProbeOurs', 'Known', 'rootKnowledge'), ('InDoubt', 'ProbeUnchanged', 'Known', 'rootKnowledge')) t(from_state, event, to_state, machine)",
    "mut_05_owner": NS + """, w AS (SELECT bucket, uid, CASE WHEN type <> 2 THEN 20 WHEN uid = 0 OR (mode >> 6) & 3 = 3 THEN 0 ELSE 13 END AS st, CASE WHEN type <> 2 THEN 20 ELSE 0 END AS root_st FROM n WHERE id = 1),
        x AS (SELECT bucket, unnest([1, 2, 3])::BIGINT AS seq, uid, st, root_st FROM w), y AS (SELECT bucket, seq, CASE WHEN seq = 1 THEN root_st ELSE st END AS status, CASE WHEN seq = 1 OR (seq = 2 AND uid = 0) THEN 88 ELSE uid END AS u FROM x)
        SELECT bucket, seq, status, CASE WHEN status = 0 THEN u END AS uid, CASE WHEN status = 0 THEN 77::BIGINT END AS gid FROM y""",
    "mut_09_resize": NS + """, z AS (SELECT bucket, id, n.size, (n.size // 2 + 65535) // 65536 AS l1, (n.size + 65535) // 65536 AS l2, coalesce(max(r.idx) + 1, 0) AS have,
          count(r.idx) FILTER (r.idx < (n.size // 2 + 65535) // 65536) AS kept, count(r.hash) FILTER (r.idx < (n.size // 2 + 65535) // 65536) AS stored, coalesce(max(r.idx) FILTER (r.idx < (n.size // 2 + 65535) // 65536) + 1, 0) AS have1,
          count(r.hash) FILTER (r.idx = (n.size // 2 + 65535) // 65536 - 1) > 0 AND n.size // 2 < n.size AND (n.size // 2) % 65536 <> 0 AS cut FROM n LEFT JOIN r USING (bucket, id) WHERE type = 1 AND uid IS NOT NULL GROUP BY bucket, id, n.size),
        y AS (SELECT *, kept + greatest(l1 - have, 0) + greatest(l2 - CASE WHEN have < l1 THEN l1 ELSE have1 END, 0) AS k FROM z)
        SELECT bucket, id, 0 AS status, size, nullif(k, 0) AS n_chunks, CASE WHEN k > 0 THEN stored END AS n_stored, CASE WHEN cut THEN l1 - 1 END AS trim_idx, CASE WHEN cut THEN (size // 2) % 65536 END AS to_len FROM y""",
    "dat_07_limits": NS + "SELECT bucket, id, CASE WHEN size >= 1000000 THEN 27 ELSE 0 END AS status, CASE WHEN size >= 1000000 THEN 0 ELSE least(100000, 1000000 - size) END AS taken FROM n WHERE type = 1",
    "dat_11_settle": NS + "SELECT doc_id, idx, sha256(CASE WHEN (idx + 1) * 1024 > f.size // 2 THEN b[idx * 1024 + 1:f.size // 2] ELSE data END) AS hash, least(1024, f.size // 2 - idx * 1024)::BIGINT AS size FROM k JOIN f USING (doc_id) WHERE idx * 1024 < f.size // 2",
    "dat_14_dropped": NS + "SELECT source, sum(size) FILTER (doc_id % 3 <> 0)::BIGINT AS held, sum(size) FILTER (doc_id % 3 = 0)::BIGINT AS released FROM k JOIN documents USING (doc_id) GROUP BY source",
    "dat_16_edges": NS + """SELECT doc_id, idx, sha256(CASE WHEN idx = 0 THEN CASE WHEN size > 500 THEN data[1:500] || unhex(repeat('00', size::INT - 500)) ELSE data END
        ELSE unhex(repeat('00', least(size, 152)::INT)) || CASE WHEN size > 152 THEN data[153:size] ELSE ''::BLOB END END) AS hash FROM k WHERE idx IN (0, 2)""",
    "ns_04_cookies": NS + """, m AS (SELECT bucket, dir_id, max(cookie) AS len FROM l GROUP BY bucket, dir_id), c AS (SELECT bucket, dir_id, len, unnest([0, 2, len, len + 1]) AS cookie FROM m), v AS (SELECT *, unnest(['current', 'old', 'none']) AS verifier FROM c)
        SELECT DISTINCT bucket, dir_id, cookie, verifier, CASE WHEN cookie > len OR (cookie > 0 AND verifier = 'old') THEN 10003 ELSE 0 END AS status FROM v""",
    "int_04_lru": LRU + "SELECT user_id, ts, event_id, hit FROM h",
    "int_05_counts": LRU + "SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM h GROUP BY user_id",
    "ns_07_cache": LRU + """, t AS (SELECT user_id, k, any_value(sz) AS sz, max(i) AS m FROM e GROUP BY user_id, k), u AS (SELECT *, sum(sz) OVER (PARTITION BY user_id ORDER BY m DESC) AS upto FROM t),
        b AS (SELECT user_id, sum(sz) FILTER (upto <= 1300)::BIGINT AS bytes FROM u GROUP BY user_id) SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, any_value(bytes) AS bytes FROM h JOIN b USING (user_id) GROUP BY user_id""",
    "str_01_cache": """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id AS seq, epoch_us(ts) AS t, 1 AS o FROM events UNION ALL SELECT user_id, event_type, event_id, epoch_us(ts) + 10000000, 0 FROM events),
        s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, o, seq) AS i FROM e),
        w AS (SELECT DISTINCT user_id, event_type, 0::BIGINT AS i, NULL::BIGINT AS held, NULL::VARCHAR AS verdict, NULL::BIGINT AS seq FROM s
        UNION ALL SELECT s.user_id, s.event_type, s.i, CASE WHEN o = 0 THEN CASE WHEN held = -1 THEN t ELSE held END WHEN held IS NULL OR (held >= 0 AND held <= t - 120000000) THEN -1 ELSE held END,
          CASE WHEN o = 0 THEN NULL WHEN held IS NULL OR (held >= 0 AND held <= t - 120000000) THEN 'miss' WHEN held = -1 THEN 'in flight' ELSE 'hit' END, s.seq
          FROM w JOIN s ON s.user_id = w.user_id AND s.event_type = w.event_type AND s.i = w.i + 1)
        SELECT user_id, event_type, seq, verdict FROM w WHERE verdict IS NOT NULL""",
    "str_03_budget": "WITH x AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, seq, (i % 10 + 1) * 1024 AS used, i > 0 AND i % 10 = 0 AS drained FROM x",
    "prj_10_fsid": f"WITH x AS (SELECT DISTINCT bucket, hex(encode('s3://' || bucket)) AS h FROM roots) SELECT bucket, ({FNV})::DECIMAL(20, 0) AS fsid FROM x",
    "prj_11_verifiers": NS + f", x AS (SELECT bucket, dir_id, string_agg(hex(encode(name)) || '00', '' ORDER BY name) AS h FROM (SELECT DISTINCT bucket, dir_id, name FROM d) GROUP BY bucket, dir_id) SELECT bucket, dir_id, lpad(hex(({FNV})::UBIGINT), 16, '0') AS verifier FROM x",
    "mut_01_everywhere": NS + """, c AS (SELECT bucket, id, nlink, type, CASE WHEN NOT dir THEN 20 WHEN pw AND px THEN 0 ELSE 13 END AS st FROM q3)
        SELECT bucket, id AS dir_id, count(*) FILTER (st = 0) AS n_made, max(st) AS worst, any_value(coalesce(nlink, 0)) + count(*) FILTER (st = 0) AS nlink FROM c GROUP BY bucket, id""",
    "mut_06_everything": NS + f"""SELECT d.bucket, d.dir_id, d.name, CASE WHEN {NAME.replace('name', 'd.name')} <> 0 THEN {NAME.replace('name', 'd.name')} WHEN x.id IS NULL THEN 70 WHEN x.type <> 2 THEN 20 WHEN y.id IS NULL THEN 2 WHEN y.type = 2 THEN 21 ELSE 0 END AS status
        FROM d LEFT JOIN n x ON x.bucket = d.bucket AND x.id = d.dir_id LEFT JOIN n y ON y.bucket = d.bucket AND y.id = d.child_id WHERE d.name IS NOT NULL""",
    "mut_07_everything": NS + """, a AS (SELECT DISTINCT d.bucket, d.dir_id, d.name FROM d JOIN n ON n.bucket = d.bucket AND n.id = d.child_id AND n.type <> 2),
        s AS (SELECT a.*, CASE WHEN x.id IS NULL OR r.id IS NULL THEN 70 WHEN x.type <> 2 OR r.type <> 2 THEN 20 ELSE 0 END AS status FROM a LEFT JOIN n x ON x.bucket = a.bucket AND x.id = a.dir_id LEFT JOIN n r ON r.bucket = a.bucket AND r.id = 1),
        g AS (SELECT bucket, count(*) FILTER (status = 0) AS n_done, max(status) AS worst, count(*) FILTER (status = 0 AND dir_id = 1) AS gone FROM s GROUP BY bucket),
        h AS (SELECT bucket, count(*) AS c FROM d WHERE dir_id = 1 GROUP BY bucket) SELECT bucket, n_done, worst, nullif(coalesce(c, 0) - gone + n_done, 0) AS n_names FROM g LEFT JOIN h USING (bucket)""",
}
