"""The same results in DuckDB's SQL, by plain joins."""

HASH = r"nullif(lower(regexp_replace(regexp_replace({c}, '^\s*((?i)(chunks/|sha256:))?\s*', ''), '\s+$', '')), '')"
SNAPS = "s AS (SELECT bucket, epoch, arg_max(created_ns, loaded_at) created_ns FROM snapshots GROUP BY ALL), " \
    "ix AS (SELECT *, row_number() OVER w - 1 idx, lag(epoch) OVER w prev, lead(epoch) OVER w nxt FROM s WINDOW w AS (PARTITION BY bucket ORDER BY epoch))"
STANDING = "ino AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, epoch, id ORDER BY loaded_at DESC) rn FROM inodes) WHERE rn = 1)"

P1 = f"""
WITH {SNAPS}, {STANDING},
one AS (SELECT bucket, epoch, inode_id, idx, any_value(coalesce({HASH.format(c='hash')}, '')) h FROM chunk_refs GROUP BY bucket, epoch, inode_id, idx),
lists AS (SELECT bucket, epoch, inode_id id, string_agg(idx || ':' || h, ',' ORDER BY idx) l FROM one GROUP BY ALL),
st AS (SELECT ino.bucket, ino.epoch, id, gen, idx, prev, nxt, mode & 4095 m, uid, gid, nlink, size, mtime_ns, parent, target, l
       FROM ino JOIN ix USING (bucket, epoch) LEFT JOIN lists USING (bucket, epoch, id))
SELECT a.bucket, a.epoch, a.id, a.gen, CASE WHEN b.id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM st a LEFT JOIN st b ON a.bucket = b.bucket AND a.prev = b.epoch AND a.id = b.id AND a.gen = b.gen
WHERE a.prev IS NOT NULL AND (b.id IS NULL OR (a.m, a.uid, a.gid, a.nlink, a.size, a.mtime_ns, a.parent, a.target, a.l) IS DISTINCT FROM (b.m, b.uid, b.gid, b.nlink, b.size, b.mtime_ns, b.parent, b.target, b.l))
UNION ALL
SELECT a.bucket, a.nxt, a.id, a.gen, 'removed'
FROM st a LEFT JOIN st b ON a.bucket = b.bucket AND a.nxt = b.epoch AND a.id = b.id AND a.gen = b.gen
WHERE a.nxt IS NOT NULL AND b.id IS NULL
"""

DOCS = """
WITH b AS (SELECT DISTINCT bucket, epoch, body::JSON AS j FROM snapshot_docs WHERE json_valid(body)),
s AS (SELECT bucket, epoch, CASE WHEN json_type(j, '$.snapshot') = 'OBJECT' AND json_type(j, '$.inodes') IS NULL THEN json_extract(j, '$.snapshot') ELSE j END AS j FROM b),
v AS (SELECT bucket, epoch, json_extract(j, '$.inodes') AS i FROM s WHERE json_extract_string(j, '$.version') = '1'),
n AS (SELECT bucket, epoch, unnest(json_extract(i, '$[*]')) AS x FROM v WHERE json_type(i) = 'ARRAY'
      UNION ALL SELECT bucket, epoch, unnest(json_extract(i, '$.*')) FROM v WHERE json_type(i) = 'OBJECT'),
o AS (SELECT bucket, epoch, x, json_extract_string(x, '$.id')::BIGINT AS owner_id FROM n WHERE json_type(x) = 'OBJECT'),
e AS (SELECT bucket, epoch, x, owner_id, unnest(json_keys(x, '$.e')) AS name FROM o WHERE json_type(x, '$.e') = 'OBJECT'),
c AS (SELECT bucket, epoch, owner_id, unnest(range(json_array_length(x, '$.c')::BIGINT)) AS idx, unnest(json_extract(x, '$.c[*]')) AS y FROM o WHERE json_type(x, '$.c') = 'ARRAY')
"""
P2 = DOCS + """
SELECT DISTINCT bucket, epoch, 'inode' AS rel, owner_id, '' AS item FROM o
UNION SELECT bucket, epoch, 'entry', owner_id, name FROM e UNION SELECT bucket, epoch, 'chunk', owner_id, idx::VARCHAR FROM c
"""
P2_INODES = DOCS + "SELECT DISTINCT bucket, epoch, owner_id AS id, " + ", ".join(
    f"json_extract_string(x, '$.{k}')::{'INT' if k == 't' else 'BIGINT'} AS {k}" for k in ("gen", "t", "m", "u", "g", "n", "sz", "at", "mt", "ct", "p")) + ", json_extract_string(x, '$.lt') AS lt FROM o"

P4 = f"""
WITH {SNAPS},
life AS (SELECT {HASH.format(c='hash')} h, stored_ns a, coalesce(deleted_ns, 9223372036854775807) b FROM chunks),
cr AS (SELECT DISTINCT bucket, epoch, inode_id, idx, {HASH.format(c='hash')} h FROM chunk_refs),
crt AS (SELECT cr.*, created_ns t FROM cr JOIN s USING (bucket, epoch) WHERE h IS NOT NULL AND h NOT IN (SELECT {HASH.format(c='hash')} FROM base_chunks)),
c AS (SELECT bucket, epoch, inode_id, idx, coalesce(bool_or(a <= t AND t < b), false) there, coalesce(bool_or(b <= t), false) del, coalesce(bool_or(a > t), false) late
      FROM crt LEFT JOIN life USING (h) GROUP BY ALL),
have AS (SELECT DISTINCT bucket, epoch, id FROM inodes),
dr AS (SELECT DISTINCT bucket, epoch, dir_id, name, child_id FROM dirents),
dm AS (SELECT * FROM dr WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.bucket = dr.bucket AND h.epoch = dr.epoch AND h.id = dr.child_id)),
dd AS (SELECT dm.bucket, dm.epoch, dir_id, name, coalesce(bool_or(h.epoch < dm.epoch), false) del, coalesce(bool_or(h.epoch > dm.epoch), false) late
       FROM dm LEFT JOIN have h ON h.bucket = dm.bucket AND h.id = dm.child_id GROUP BY ALL),
rr AS (SELECT DISTINCT bucket, epoch, written_ns, regexp_replace(regexp_replace(snapshot, '^\\s*(\\./|/)*', ''), '\\s+$', '') k FROM roots),
keys AS (SELECT bucket, key, arg_max(created_ns, loaded_at) a, coalesce(arg_max(pruned_ns, loaded_at), 9223372036854775807) b FROM snapshots GROUP BY bucket, key),
ro AS (SELECT rr.bucket, rr.epoch, k, CASE WHEN key IS NULL THEN 'missing' WHEN b <= written_ns THEN 'deleted' WHEN a > written_ns THEN 'late' END reason
       FROM rr LEFT JOIN keys ON keys.bucket = rr.bucket AND keys.key = k)
SELECT 'chunk_refs' AS src, bucket, epoch, inode_id AS owner_id, idx::VARCHAR AS item, CASE WHEN del THEN 'deleted' WHEN late THEN 'late' ELSE 'missing' END AS reason FROM c WHERE NOT there
UNION SELECT 'dirents', bucket, epoch, dir_id, name, CASE WHEN del THEN 'deleted' WHEN late THEN 'late' ELSE 'missing' END FROM dd
UNION SELECT 'roots', bucket, epoch, 0, k, reason FROM ro WHERE reason IS NOT NULL
"""

HISTORY = f"""
WITH {SNAPS}, {STANDING},
st AS (SELECT ino.bucket, id, gen, size, mode & 4095 AS mode, ino.epoch, idx, nxt FROM ino JOIN ix USING (bucket, epoch)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY bucket, id, gen, size, mode ORDER BY idx) run FROM st)
SELECT bucket, id, gen, size, mode, min(epoch) AS valid_from, coalesce(arg_max(nxt, idx), -1) AS valid_to FROM (SELECT *, nxt n2 FROM runs) GROUP BY bucket, id, gen, size, mode, run
"""
HISTORY = HISTORY.replace("coalesce(arg_max(nxt, idx), -1)", "coalesce(nullif(max(coalesce(nxt, 9223372036854775807)), 9223372036854775807), -1)").replace("(SELECT *, nxt n2 FROM runs)", "runs")

TREE = f"""
WITH RECURSIVE top AS (SELECT bucket, max(epoch) epoch FROM snapshots GROUP BY bucket), {STANDING},
n AS (SELECT bucket, epoch, id, parent FROM ino JOIN top USING (bucket, epoch)),
nm AS (SELECT bucket, dir_id parent, child_id id, min(name) nam FROM dirents JOIN top USING (bucket, epoch) GROUP BY ALL),
e AS (SELECT n.bucket, n.id, CASE WHEN n.id = 1 OR p.id IS NULL THEN NULL ELSE n.parent END parent, coalesce(nam, '#' || n.id) nam
      FROM n LEFT JOIN n p ON p.bucket = n.bucket AND p.id = n.parent LEFT JOIN nm ON nm.bucket = n.bucket AND nm.parent = n.parent AND nm.id = n.id),
w AS (SELECT bucket, id, id root_id, 0 AS depth, CASE WHEN id = 1 THEN '/' ELSE '#' || id END path, [id] trail FROM e WHERE parent IS NULL
      UNION ALL
      SELECT e.bucket, e.id, w.root_id, w.depth + 1, CASE WHEN w.path = '/' THEN '/' ELSE w.path || '/' END || e.nam, list_append(w.trail, e.id) FROM w JOIN e ON e.bucket = w.bucket AND e.parent = w.id)
"""
P6 = TREE + """
SELECT bucket, id, root_id, depth::BIGINT AS depth, path FROM w
UNION ALL SELECT bucket, id, -1, -1, '' FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.bucket = e.bucket AND w.id = e.id)
"""
BELOW = TREE + ", x AS (SELECT bucket, id AS below_id, depth, unnest(trail) id, generate_subscripts(trail, 1) pos FROM w), d AS (SELECT bucket, id, below_id, (depth + 1 - pos)::BIGINT AS distance FROM x WHERE id <> below_id)"

SQL = {
    "p1_found": P1,
    "p2_found": P2,
    "p2_inodes": P2_INODES,
    "p2_entries": DOCS + """SELECT DISTINCT bucket, epoch, owner_id AS dir_id, name, json_extract_string(x, '$.e."' || name || '"')::BIGINT AS child_id FROM e""",
    "p2_chunks": DOCS + "SELECT DISTINCT bucket, epoch, owner_id AS inode_id, idx::INT AS idx, json_extract_string(y, '$.h') AS h, json_extract_string(y, '$.s')::BIGINT AS s FROM c",
    "p4_found": P4,
    "p4_report": f"SELECT src, bucket, epoch, reason, count(*) AS n FROM ({P4}) GROUP BY ALL",
    "p5_history": HISTORY,
    "p5_found": f"SELECT bucket, id, gen, valid_from, valid_to FROM ({HISTORY})",
    "p6_found": P6,
    "p6_descendants": BELOW + " SELECT * FROM d",
    "p6_subtrees": BELOW + " SELECT bucket, id, count(*) AS n_below, max(distance) AS height FROM d GROUP BY ALL",
}
