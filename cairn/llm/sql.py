"""The same results in DuckDB's SQL, where it can express them."""

from cairn.plans.found_sql import HASH

FREQ = f"""
WITH r AS (SELECT DISTINCT bucket, epoch, inode_id, idx, {HASH.format(c='hash')} hash FROM chunk_refs),
g AS (SELECT hash, count(*) n_refs, count(DISTINCT (bucket, epoch, inode_id)) n_records FROM r WHERE regexp_full_match(hash, '[0-9a-f]{{64}}') GROUP BY hash)
SELECT hash, n_refs, n_records, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records >= 100 THEN 'common' END AS mark FROM g
"""

MARK = "CASE WHEN n_records = 1 THEN 'rare' WHEN n_records >= 100 THEN 'common' END AS mark"
SEQUENCES = f"""
WITH r AS (SELECT bucket, epoch, inode_id, idx, {HASH.format(c='hash')} h FROM chunk_refs),
o AS (SELECT bucket, epoch, inode_id, idx, min(CASE WHEN regexp_full_match(h, '[0-9a-f]{{64}}') THEN h END) t1 FROM r GROUP BY ALL),
w AS (SELECT *, CASE WHEN lead(idx) OVER f = idx + 1 THEN lead(t1) OVER f END t2, CASE WHEN lead(idx, 2) OVER f = idx + 2 THEN lead(t1, 2) OVER f END t3
      FROM o WINDOW f AS (PARTITION BY bucket, epoch, inode_id ORDER BY idx)),
g AS (SELECT bucket, epoch, inode_id, t1 AS terms FROM w WHERE t1 IS NOT NULL
      UNION ALL SELECT bucket, epoch, inode_id, t1 || ',' || t2 FROM w WHERE t1 IS NOT NULL AND t2 IS NOT NULL
      UNION ALL SELECT bucket, epoch, inode_id, t1 || ',' || t2 || ',' || t3 FROM w WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL),
c AS (SELECT terms, count(*) n, count(DISTINCT (bucket, epoch, inode_id)) n_records FROM g GROUP BY terms)
SELECT *, {MARK} FROM c
"""

SQL = {
    "p3_frequencies": FREQ,
    "p3_found": f"SELECT hash, mark FROM ({FREQ}) WHERE mark IS NOT NULL",
    "p3_sequences": SEQUENCES,
}
