"""Manifest audits, file-held-out splits, tiers and class subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import audit, kmers, splits
from sigspark.plans.bridge import MANIFEST_CLASSES, ROW_ORDER, manifest, reads, sequences
from sigspark.plans.registry import query, sql
from sigspark.session import scratch_path
from sigspark.sources import manifests as src
from sigspark.sources import signals as signal_files
from sigspark.sources.sinks import write_csv

ORDER = ", ".join(ROW_ORDER)
TARGETS = {"train": 90, "val": 30, "test": 30}
CAP = 20
SEED = 42


@query("manifest_read", sql(["manifest"], """
SELECT legacy_split AS split, barcode, label, read_id,
       '/data/m/' || ccf_file AS raw_chunk_path, CAST(NULL AS VARCHAR) AS preprocessing_profile_id,
       CAST(l_linenumber AS BIGINT) AS raw_chunk_start
FROM manifest WHERE legacy_split IN ('train', 'val', 'test')"""))
def _(spark, d):
    rows = manifest(spark, d).selectExpr(
        "legacy_split AS split", "'0' AS split_order", "barcode", "CAST(label AS STRING) AS label", "read_id",
        "ccf_file AS raw_chunk_path", "CAST(l_linenumber AS STRING) AS raw_chunk_start", "'4' AS raw_n_chunks",
    )
    typed = src.normalize_manifest(rows, kind="raw", base="/data/m/")
    return typed.select(
        "split", "barcode", "label", "read_id", "raw_chunk_path", "preprocessing_profile_id", "raw_chunk_start"
    )


@query("bag_manifest", sql(["manifest"], """
SELECT legacy_split AS split, CAST(l_orderkey AS BIGINT) AS split_order, barcode, label, read_id, 'p' || CAST(l_suppkey % 4 AS VARCHAR) AS part_id,
       CAST(l_linenumber AS BIGINT) AS chunk_start, CAST(1 + l_partkey % 30 AS INTEGER) AS n_chunks, ccf_file
FROM manifest WHERE legacy_split IN ('train', 'val', 'test')"""))
def _(spark, d):
    """Written as CSV, as users have them, and read back with types; unknown splits go."""
    path = scratch_path(spark, "manifest") + ".csv"
    rows = manifest(spark, d).selectExpr(
        "legacy_split AS split", "l_orderkey AS split_order", "barcode", "label", "read_id", "concat('p', l_suppkey % 4) AS part_id",
        "'parts' AS part_base", "l_linenumber AS part_read_index", "l_linenumber AS chunk_start", "1 + l_partkey % 30 AS n_chunks",
        "'c.bin' AS chunk_path", "ccf_file", "l_orderkey AS ccf_read_index",
    )
    write_csv(rows, path)
    return src.read_manifest(spark, path, kind="bag").select(
        "split", "split_order", "barcode", "label", "read_id", "part_id", "chunk_start", "n_chunks", "ccf_file"
    )


@query("assert_profile", sql(["manifest"], """
SELECT count(*) AS rows, min(label) AS min_label, max(label) AS max_label, 'mad' AS first_profile, 'mad' AS last_profile
FROM manifest"""))
def _(spark, d):
    rows = manifest(spark, d).withColumn("preprocessing_profile_id", F.lit("mad"))
    return src.assert_manifest(rows, len(MANIFEST_CLASSES), "mad")


@query("audit_manifest", sql(["manifest"], """
, r AS (SELECT read_id, count(*) AS n, count(DISTINCT legacy_split) AS s FROM manifest GROUP BY 1),
f AS (SELECT barcode, regexp_extract(ccf_file, '[^/]+$') AS file, count(DISTINCT legacy_split) AS s FROM manifest GROUP BY 1, 2)
SELECT 'fail' AS status, CAST((SELECT sum(n) FROM r) AS BIGINT) AS rows, (SELECT count(*) FROM r) AS unique_reads,
       (SELECT count(*) FROM r WHERE n > 1) AS duplicate_read_rows, (SELECT count(*) FROM r WHERE s > 1) AS read_id_split_leakage,
       (SELECT count(*) FROM f WHERE s > 1) AS ccf_file_split_leakage"""))
def _(spark, d):
    return audit.audit_manifest(manifest(spark, d), "legacy_split").summary


@query("audit_examples", sql(["manifest"], """
, r AS (SELECT read_id, count(*) AS n, count(DISTINCT legacy_split) AS s FROM manifest GROUP BY 1),
f AS (SELECT barcode, regexp_extract(ccf_file, '[^/]+$') AS file, count(DISTINCT legacy_split) AS s FROM manifest GROUP BY 1, 2),
k AS (SELECT 'duplicate_read_ids' AS kind, read_id AS example FROM r WHERE n > 1 UNION ALL
      SELECT 'read_id_leakage', read_id FROM r WHERE s > 1 UNION ALL
      SELECT 'ccf_file_leakage', barcode || '/' || file FROM f WHERE s > 1)
SELECT kind, example FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY example) <= 10"""))
def _(spark, d):
    return audit.audit_manifest(manifest(spark, d), "legacy_split").examples


@query("audit_manifest_strict", sql(["manifest", "reads"], """
SELECT CASE WHEN max(s) = 1 THEN 'pass' ELSE 'fail' END AS status, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT barcode, ccf_file, count(DISTINCT split) AS s, count(*) AS n FROM reads GROUP BY 1, 2)"""))
def _(spark, d):
    return audit.audit_manifest(reads(spark, d)).summary.select("status", "rows")


@query("audit_counts", sql(["manifest"], """
SELECT s.split, b.barcode, count(m.read_id) AS n
FROM (SELECT DISTINCT legacy_split AS split FROM manifest) s CROSS JOIN (SELECT DISTINCT barcode FROM manifest) b
LEFT JOIN manifest m ON m.legacy_split = s.split AND m.barcode = b.barcode GROUP BY 1, 2"""))
def _(spark, d):
    return audit.audit_manifest(manifest(spark, d), "legacy_split").counts


@query("audit_files", sql(["manifest"], """
SELECT barcode, ccf_file, count(*) AS read_count, CAST(count(DISTINCT legacy_split) AS INTEGER) AS split_count,
       string_agg(DISTINCT legacy_split, '|' ORDER BY legacy_split) AS splits,
       CAST(CASE WHEN count(DISTINCT legacy_split) > 1 THEN 1 ELSE 0 END AS INTEGER) AS cross_split,
       split_part(regexp_extract(ccf_file, '[^/]+$'), '_', 1) AS run_prefix
FROM manifest GROUP BY barcode, ccf_file"""))
def _(spark, d):
    return audit.audit_files(manifest(spark, d), "legacy_split")


@query("audit_species", sql(["manifest"], """
SELECT m.barcode, count(DISTINCT m.ccf_file) AS ccf_files, any_value(x.n) AS files_crossing_splits,
       round(any_value(x.n) / count(DISTINCT m.ccf_file), 6) AS crossing_fraction,
       count(*) FILTER (legacy_split = 'train') AS train_reads, count(*) FILTER (legacy_split = 'atlas') AS atlas_reads,
       count(*) FILTER (legacy_split = 'val') AS val_reads, count(*) FILTER (legacy_split = 'test') AS test_reads
FROM manifest m JOIN (
  SELECT barcode, count(*) FILTER (s > 1) AS n FROM (
    SELECT barcode, ccf_file, count(DISTINCT legacy_split) AS s FROM manifest GROUP BY 1, 2) GROUP BY 1) x
  ON x.barcode = m.barcode GROUP BY m.barcode"""))
def _(spark, d):
    return audit.audit_classes(manifest(spark, d), "legacy_split").withColumn(
        "crossing_fraction", F.round("crossing_fraction", 6)
    )


@query("audit_runs", sql(["manifest"], """
SELECT split_part(regexp_extract(ccf_file, '[^/]+$'), '_', 1) AS run_prefix,
       string_agg(DISTINCT barcode, '|' ORDER BY barcode) AS classes FROM manifest GROUP BY 1"""))
def _(spark, d):
    return audit.audit_runs(manifest(spark, d))


@query("audit_protocol", sql(["manifest"], f"""
, r AS (SELECT read_id, legacy_split, first_value(legacy_split) OVER (PARTITION BY read_id ORDER BY {ORDER}) AS f FROM manifest),
g AS (SELECT barcode, ccf_file, count(DISTINCT legacy_split) AS s FROM manifest GROUP BY 1, 2)
SELECT count(*) AS total_rows, count(DISTINCT read_id) AS unique_read_ids,
       count(*) - count(DISTINCT read_id) AS duplicate_read_rows, count(*) FILTER (legacy_split <> f) AS inconsistent_read_splits,
       (SELECT count(*) FROM g) AS files, (SELECT count(*) FROM g WHERE s > 1) AS files_crossing_splits,
       round((SELECT avg(CASE WHEN s > 1 THEN 1.0 ELSE 0.0 END) FROM g), 6) AS cross_split_fraction
FROM r"""))
def _(spark, d):
    return audit.audit_protocol(manifest(spark, d), ROW_ORDER, "legacy_split").withColumn(
        "cross_split_fraction", F.round("cross_split_fraction", 6)
    )


def _shared(key: str, a: str, b: str) -> str:
    return (f"(SELECT count(*) FROM (SELECT {key} FROM manifest WHERE legacy_split = '{a}' INTERSECT "
            f"SELECT {key} FROM manifest WHERE legacy_split = '{b}'))")


@query("split_overlap", sql(["manifest"], "\nUNION ALL\n".join(
    f"SELECT '{kind}' AS kind, " + ", ".join(
        f"{_shared(key, a, b)} AS {a}_{b}" for a, b in (("train", "val"), ("train", "test"), ("val", "test")))
    for kind, key in (("reads", "read_id"), ("files", "barcode, ccf_file")))))
def _(spark, d):
    return audit.split_overlap(manifest(spark, d), "legacy_split")


@query("duplicate_reads", sql(["manifest"], "SELECT read_id, count(*) AS n FROM manifest GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    return audit.duplicate_reads(manifest(spark, d))


@query("missing_cells", sql(["manifest"], """
, c AS (SELECT barcode, split, t, (SELECT count(*) FROM manifest m WHERE m.barcode = b.barcode AND m.legacy_split = s.split) AS n
        FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS barcode) b
        CROSS JOIN (VALUES ('train', 1), ('val', 1), ('holdout', 1)) s(split, t))
SELECT barcode, split, CAST(t - n AS BIGINT) AS missing FROM c WHERE n < t"""))
def _(spark, d):
    rows = manifest(spark, d).withColumn("split", F.col("legacy_split"))
    return audit.missing_cells(rows, [*MANIFEST_CLASSES, "X"], {"train": 1, "val": 1, "holdout": 1})


def _assign_sql() -> str:
    text = f"""
, files AS (SELECT barcode, ccf_file, count(*) AS available_reads, least(count(*), {CAP}) AS usable,
                   sha256('{SEED}|' || barcode || '|' || ccf_file) AS hk FROM manifest GROUP BY 1, 2)"""
    source = "files"
    for split, target in TARGETS.items():
        text += f""",
{split}_run AS (SELECT *, coalesce(sum(usable) OVER (PARTITION BY barcode ORDER BY hk, ccf_file
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}),
{split}_in AS (SELECT barcode, ccf_file, '{split}' AS split, available_reads,
    CAST(least(usable, {target} - before) AS BIGINT) AS selected_cap FROM {split}_run WHERE before < {target}),
{split}_rest AS (SELECT barcode, ccf_file, available_reads, usable, hk FROM {split}_run WHERE before >= {target})"""
        source = f"{split}_rest"
    return text + ",\nassigned AS (" + " UNION ALL ".join(f"SELECT * FROM {s}_in" for s in TARGETS) + ")"


@query("group_assign", sql(["manifest"], _assign_sql() + "SELECT * FROM assigned"))
def _(spark, d):
    return splits.assign_groups(manifest(spark, d), targets=TARGETS, cap=CAP, seed=SEED)


@query("group_split", sql(["manifest"], _assign_sql() + """
SELECT a.split, m.barcode, count(*) AS n_rows FROM manifest m JOIN assigned a USING (barcode, ccf_file) GROUP BY 1, 2"""))
def _(spark, d):
    rows = manifest(spark, d)
    assigned = splits.assign_groups(rows, targets=TARGETS, cap=CAP, seed=SEED).select("barcode", "ccf_file", "split")
    return (
        rows.drop("split").join(assigned, ["barcode", "ccf_file"]).groupBy("split", "barcode")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


_PICKED = f""", j AS (SELECT m.* EXCLUDE (split), a.split AS split FROM manifest m JOIN assigned a USING (barcode, ccf_file)),
once AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY {ORDER}) AS o FROM j),
capped AS (SELECT *, row_number() OVER (PARTITION BY barcode, ccf_file ORDER BY {ORDER}) AS c FROM once WHERE o = 1),
picked AS (SELECT *, row_number() OVER (PARTITION BY barcode, split ORDER BY {ORDER}) AS t FROM capped WHERE c <= {CAP}),
selected AS (SELECT split, t - 1 AS split_order, barcode, label, read_id, ccf_file FROM picked
             WHERE t <= CASE split {' '.join(f"WHEN '{s}' THEN {n}" for s, n in TARGETS.items())} END)"""


def _selected(spark, d):
    rows = manifest(spark, d)
    assigned = splits.assign_groups(rows, targets=TARGETS, cap=CAP, seed=SEED)
    return splits.group_split(
        rows, assigned, targets=TARGETS, cap=CAP, order=ROW_ORDER, n_classes=len(MANIFEST_CLASSES)
    ).select("split", "split_order", "barcode", "label", "read_id", "ccf_file")


@query("group_split_rows", sql(["manifest"], _assign_sql() + _PICKED + "SELECT * FROM selected"))
def _(spark, d):
    return _selected(spark, d)


@query("tier_summary", sql(["manifest"], _assign_sql() + _PICKED + """
SELECT split, barcode, count(*) AS n_reads, count(DISTINCT ccf_file) AS n_files FROM selected GROUP BY 1, 2"""))
def _(spark, d):
    return audit.tier_summary(_selected(spark, d))


@query("split_order", sql(["manifest"], f"""
SELECT {ORDER}, barcode, split, row_number() OVER (PARTITION BY barcode, split ORDER BY {ORDER}) - 1 AS split_order
FROM manifest"""))
def _(spark, d):
    return splits.split_order(manifest(spark, d), ROW_ORDER).select(*ROW_ORDER, "barcode", "split", "split_order")


_RR = {"train": 60, "val": 20, "test": 20}


def _round_robin_sql(targets: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {n}" for s, n in targets.items())
    return f""", h AS (SELECT *, sha256('{SEED}|group|' || ccf_file) AS gf, sha256('{SEED}|read|' || read_id) AS gr FROM reads),
lap AS (SELECT *, row_number() OVER (PARTITION BY barcode, split, ccf_file ORDER BY gr, {ORDER}) AS lap FROM h),
pick AS (SELECT *, row_number() OVER (PARTITION BY barcode, split ORDER BY lap, gf) AS r FROM lap)
SELECT read_id, barcode, split, ccf_file, r - 1 AS split_order FROM pick WHERE r <= CASE split {cases} END"""


def _rr(targets):
    def run(spark, d):
        rows = reads(spark, d).select("read_id", "barcode", "split", "ccf_file", *ROW_ORDER)
        chosen = splits.round_robin(rows, targets=targets, seed=SEED, order=ROW_ORDER)
        return chosen.select("read_id", "barcode", "split", "ccf_file", "split_order")

    return run


query("round_robin", sql(["manifest", "reads"], _round_robin_sql(_RR)))(_rr(_RR))
# a target above the map-side limit takes the distributed rank
_RR_LARGE = {"train": 1500, "val": 500, "test": 500}
query("round_robin_large", sql(["manifest", "reads"], _round_robin_sql(_RR_LARGE)))(_rr(_RR_LARGE))


@query("smoke_subset", sql(["manifest"], f"""
, f AS (SELECT *, dense_rank() OVER (PARTITION BY barcode ORDER BY ccf_file) AS fr,
               row_number() OVER (PARTITION BY barcode, ccf_file ORDER BY {ORDER}) AS rn FROM manifest WHERE split = 'train'),
e AS (SELECT *, row_number() OVER (PARTITION BY barcode, split ORDER BY {ORDER}) AS rn FROM manifest WHERE split <> 'train')
SELECT split, barcode, ccf_file, read_id, {ORDER} FROM f WHERE fr <= 2 AND rn <= 2
UNION ALL SELECT split, barcode, ccf_file, read_id, {ORDER} FROM e WHERE rn <= 2"""))
def _(spark, d):
    few = splits.first_files(manifest(spark, d), files_per_class=2, reads_per_file=2, eval_reads=2, order=ROW_ORDER)
    return few.select("split", "barcode", "ccf_file", "read_id", *ROW_ORDER)


_WANTED = "SELECT DISTINCT ccf_file, read_id FROM manifest WHERE l_quantity > 20 AND legacy_split = 'val'"


def _scanned(spark, d):
    """The manifest as a table of stored reads, and the reads that are wanted from it."""
    rows = manifest(spark, d).withColumnRenamed("ccf_file", "source_file")
    return rows, rows.where("l_quantity > 20 AND legacy_split = 'val'")


@query("select_reads", sql(["manifest"], f"""
, wanted AS ({_WANTED})
SELECT m.ccf_file, m.read_id, count(*) AS n FROM manifest m SEMI JOIN wanted w ON w.ccf_file = m.ccf_file AND w.read_id = m.read_id GROUP BY 1, 2"""))
def _(spark, d):
    rows, wanted = _scanned(spark, d)
    return signal_files.select_reads(rows, wanted).groupBy(F.col("source_file").alias("ccf_file"), "read_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("missing_reads", sql(["manifest"], f"""
, wanted AS (SELECT DISTINCT 'raw/A' || substr(ccf_file, 6) AS ccf_file, read_id FROM ({_WANTED}))
SELECT ccf_file, read_id FROM wanted EXCEPT SELECT ccf_file, read_id FROM manifest"""))
def _(spark, d):
    """Wanted reads under the file names of one class; those of other classes are in no file."""
    rows, wanted = _scanned(spark, d)
    moved = wanted.withColumn("source_file", F.concat(F.lit("raw/A"), F.expr("substr(source_file, 6)")))
    return signal_files.missing_reads(moved, rows).withColumnRenamed("source_file", "ccf_file")


@query("semi_filter", sql(["manifest"], """
SELECT barcode, ccf_file, count(*) AS n FROM manifest
WHERE read_id IN (SELECT read_id FROM manifest WHERE l_partkey % 3 = 0) GROUP BY 1, 2"""))
def _(spark, d):
    rows = manifest(spark, d)
    featured = rows.where("l_partkey % 3 = 0")
    return signal_files.select_reads(rows, featured, ["read_id"]).groupBy("barcode", "ccf_file").agg(F.count(F.lit(1)).alias("n"))


@query("union_splits", sql(["manifest"], """
SELECT split, barcode, label, read_id FROM manifest WHERE split = 'train' UNION ALL
SELECT split, barcode, label, read_id FROM manifest WHERE split = 'val' UNION ALL
SELECT split, barcode, label, read_id FROM manifest WHERE split = 'test'"""))
def _(spark, d):
    columns = ["split", "barcode", "label", "read_id"]
    parts = [manifest(spark, d).where(F.col("split") == s).select(*columns) for s in src.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("subset_relabel", sql(["manifest"], """
, ks AS (SELECT unnest([2, 3]) AS k), o AS (SELECT * FROM (VALUES ('R', 0), ('A', 1), ('N', 2)) v(barcode, pos)),
s AS (SELECT k, m.*, pos FROM manifest m JOIN o USING (barcode) JOIN ks ON pos < k)
SELECT CAST(k AS INTEGER) AS class_count, CAST(pos AS INTEGER) AS label, barcode, legacy_split AS split, count(*) AS n
FROM s GROUP BY ALL"""))
def _(spark, d):
    rows = manifest(spark, d).withColumn("split", F.col("legacy_split"))
    return splits.nested_subsets(rows, ["R", "A", "N"], 2).groupBy("class_count", "label", "barcode", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("subset_audit", sql(["manifest"], """
, ks AS (SELECT unnest([2, 3]) AS k), o AS (SELECT * FROM (VALUES ('R', 0), ('A', 1), ('N', 2)) v(barcode, pos)),
s AS (SELECT k, m.* FROM manifest m JOIN o USING (barcode) JOIN ks ON pos < k)
SELECT CAST(k AS INTEGER) AS class_count,
  (SELECT count(*) FROM (SELECT read_id FROM s t WHERE t.k = s.k GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS read_overlap,
  (SELECT count(*) FROM (SELECT barcode, ccf_file FROM s t WHERE t.k = s.k GROUP BY 1, 2 HAVING count(DISTINCT split) > 1))
    AS file_overlap,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
  count(*) FILTER (split = 'test') AS test_rows FROM s GROUP BY k"""))
def _(spark, d):
    return splits.subset_audit(manifest(spark, d), ["R", "A", "N"], 2)


def _pairs_sql() -> str:
    h = lambda text: f"CAST('0x' || substr(sha256('{SEED}|{text}|' || CAST(p AS VARCHAR)), 1, 8) AS BIGINT)"
    return f""", n AS MATERIALIZED (SELECT barcode, ccf_file, read_id,
    row_number() OVER (PARTITION BY barcode, ccf_file ORDER BY {ORDER}) - 1 AS nth FROM manifest WHERE split = 'train'),
f AS (SELECT barcode, ccf_file, count(*) AS reads, row_number() OVER (PARTITION BY barcode ORDER BY ccf_file) - 1 AS at
      FROM n GROUP BY 1, 2),
c AS (SELECT barcode, count(*) AS files, row_number() OVER (ORDER BY barcode) AS class_at FROM f GROUP BY 1),
q AS MATERIALIZED (SELECT p, barcode, files, {h('left')} % files AS a, {h('step')} % (files - 1) AS s, {h('left')} AS hl, {h('right')} AS hr
      FROM (SELECT unnest(range((SELECT count(*) // 2 FROM n))) AS p) JOIN c ON class_at = p % (SELECT count(*) FROM c) + 1),
w AS MATERIALIZED (SELECT p, q.barcode, lf.ccf_file AS lfile, rf.ccf_file AS rfile, hl % lf.reads AS ln, hr % rf.reads AS rn
  FROM q JOIN f lf ON lf.barcode = q.barcode AND lf.at = a JOIN f rf ON rf.barcode = q.barcode AND rf.at = (a + 1 + s) % files),
wl AS MATERIALIZED (SELECT w.*, l.read_id AS lread FROM w JOIN n l ON l.barcode = w.barcode AND l.ccf_file = lfile AND l.nth = ln)
SELECT p AS pair, wl.barcode, lfile AS left_file, lread AS left_read, rfile AS right_file, r.read_id AS right_read
FROM wl JOIN n r ON r.barcode = wl.barcode AND r.ccf_file = rfile AND r.nth = rn"""


@query("cross_file_pairs", sql(["manifest"], _pairs_sql()))
def _(spark, d):
    train = manifest(spark, d).where("split = 'train'")
    return splits.cross_file_pairs(train, seed=SEED, order=ROW_ORDER)


@query("kmer_match", sql(["sequences"], """
SELECT CASE WHEN d % 10 < 6 THEN 'train' WHEN d % 10 < 8 THEN 'val' ELSE 'test' END AS split,
       row_number() OVER (PARTITION BY CASE WHEN d % 10 < 6 THEN 'train' WHEN d % 10 < 8 THEN 'val' ELSE 'test' END
                          ORDER BY d) - 1 AS new_index,
       read_id, barcode, CASE d % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'atlas' WHEN 2 THEN 'val' ELSE 'test' END AS source_split,
       greatest(length(seq) - 5, 0) AS n_kmers
FROM (SELECT *, CAST(substr(read_id, 2) AS BIGINT) AS d FROM sequences)"""))
def _(spark, d):
    rows = sequences(spark, d).withColumn("d", F.expr("CAST(substr(read_id, 2) AS BIGINT)"))
    selected = rows.selectExpr(
        "CASE WHEN d % 10 < 6 THEN 'train' WHEN d % 10 < 8 THEN 'val' ELSE 'test' END AS split", "d", "read_id", "barcode"
    )
    caches = {
        name: rows.where(f"d % 4 = {i}").selectExpr(
            "read_id", "barcode", "greatest(length(seq) - 5, 0) AS n_kmers"
        )
        for i, name in enumerate(("train", "atlas", "val", "test"))
    }
    matched = kmers.match_features(selected, kmers.union_caches(caches), order=["d"])
    return matched.select("split", "new_index", "read_id", "barcode", "source_split", F.col("n_kmers").cast("long"))
