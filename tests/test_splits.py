from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigspark.operators import audit, kmers, splits
from sigspark.plans import jobs

CLASSES = [f"k{i}" for i in range(9)]
MANIFEST = "split string, split_order long, barcode string, label int, read_id string, ccf_file string"


def packaged():
    """9 classes x 3 splits x 8 reads, two files per (class, split)."""
    rows = []
    for label, c in enumerate(CLASSES):
        for split in ("train", "val", "test"):
            for i in range(8):
                rows.append((split, i, c, label, f"{c}-{split}-{i}", f"{c}/{split}{i % 2}.ccf5"))
    return rows


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def random_manifest(n, seed, classes=("a", "b"), files=25):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # one file holds a third of the rows of its class
        f = 0 if rng.random() < 1 / 3 else rng.randrange(files)
        rows.append((rng.choice(classes), f"f{f}", f"r{i}", i))
    return rows


def assign_one_by_one(rows, targets, cap, seed):
    counts = Counter((c, f) for c, f, _, _ in rows)
    out = {}
    for c in sorted({c for c, _ in counts}):
        files = sorted((sha(seed, c, f), f) for cc, f in counts if cc == c)
        at = 0
        for split, target in targets.items():
            filled = 0
            while filled < target and at < len(files):
                f = files[at][1]
                usable = min(counts[(c, f)], cap, target - filled)
                out[(c, f)] = (split, counts[(c, f)], usable)
                filled += usable
                at += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_assignment_equals_one_by_one_filling(spark, seed):
    rows = random_manifest(3000, seed)
    targets = {"train": 300, "val": 90 + seed, "test": 60}
    df = spark.createDataFrame(rows, "barcode string, ccf_file string, read_id string, at long")
    got = splits.assign_groups(df, targets=targets, cap=40, seed=seed).collect()
    expected = assign_one_by_one(rows, targets, 40, seed)
    assert {(r.barcode, r.ccf_file): (r.split, r.available_reads, r.selected_cap) for r in got} == expected


def test_row_selection_equals_one_by_one_selection(spark):
    rows = random_manifest(3000, 9)
    targets, cap = {"train": 300, "val": 90, "test": 60}, 40
    df = spark.createDataFrame(rows, "barcode string, ccf_file string, read_id string, at long").repartition(6)
    assigned = splits.assign_groups(df, targets=targets, cap=cap, seed=1)
    got = splits.group_split(df, assigned, targets=targets, cap=cap, order=["at"], n_classes=2).collect()
    where = {k: v[0] for k, v in assign_one_by_one(rows, targets, cap, 1).items()}
    per_file, per_split, expected = Counter(), Counter(), {}
    for c, f, read, _ in rows:
        split = where.get((c, f))
        if split is None or per_split[(c, split)] >= targets[split] or per_file[(c, f)] >= cap:
            continue
        expected[read] = (split, per_split[(c, split)])
        per_file[(c, f)] += 1
        per_split[(c, split)] += 1
    assert {r.read_id: (r.split, r.split_order) for r in got} == expected
    splits.require_targets(spark.createDataFrame(got), ["a", "b"], targets)


def test_split_tier_and_subset_jobs(spark, tmp_path):
    rows = [(f"k{i % 3}", i % 3, f"k{i % 3}/f{i // 3 % 12}", f"r{i}", i) for i in range(1800)]
    df = spark.createDataFrame(rows, "barcode string, label int, ccf_file string, read_id string, at long")
    classes, targets = ["k0", "k1", "k2"], {"train": 150, "val": 40, "test": 40}
    featured = df.where("at % 10 <> 0").select("read_id")
    out = str(tmp_path / "split")
    summary = jobs.build_group_split(df, out, classes, targets=targets, cap=30, seed=3, order=["at"], features=featured)
    assert {(r.barcode, r.split): r.n_reads for r in summary.collect()} == {(c, s): n for c in classes for s, n in targets.items()}
    manifest = spark.read.parquet(f"{out}/manifest")
    assert manifest.join(featured, "read_id", "left_anti").isEmpty()
    assert manifest.groupBy("barcode", "ccf_file").count().where("count > 30").isEmpty()

    small = {"train": 20, "val": 5, "test": 5}
    tier = jobs.build_tier(manifest, str(tmp_path / "tier"), classes, targets=small, seed=3, order=["at"])
    assert {r.n_reads for r in tier.where("split = 'train'").collect()} == {20}
    stored = spark.read.parquet(str(tmp_path / "tier" / "manifest"))
    old = manifest.select("read_id", F.col("split_order").alias("old"))
    assert stored.join(old, "read_id").where("old <> source_split_order").isEmpty()

    audits = jobs.build_subsets(manifest, str(tmp_path / "sub"), ["k2", "k0", "k1"], k_min=2).collect()
    assert sorted((r.class_count, r.train_rows) for r in audits) == [(2, 300), (3, 450)]
    pairs = spark.read.parquet(str(tmp_path / "sub")).select("class_count", "barcode", "label").distinct().collect()
    assert {(2, "k2", 0), (2, "k0", 1), (3, "k1", 2)} <= {tuple(p) for p in pairs} and len(pairs) == 5

    leaking = manifest.withColumn("split", F.expr("CASE (at div 3) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END"))
    leaking = leaking.withColumn("ccf_file", F.concat("barcode", F.lit("/one")))
    with pytest.raises(ValueError, match="leaks between splits"):
        jobs.build_tier(leaking, str(tmp_path / "bad"), classes, targets=small, seed=3, order=["at"])
    with pytest.raises(ValueError, match="leaks between splits"):
        jobs.build_subsets(leaking, str(tmp_path / "bad"), classes, k_min=2)
    with pytest.raises(ValueError, match="not enough reads"):
        jobs.build_tier(manifest, str(tmp_path / "bad"), classes, targets={"train": 151}, seed=3, order=["at"])


def test_missing_files_are_reported(spark):
    df = spark.createDataFrame(random_manifest(100, 0), "barcode string, ccf_file string, read_id string, at long")
    assigned = splits.assign_groups(df, targets={"train": 80, "val": 80}, cap=5, seed=0)
    picked = splits.group_split(df, assigned, targets={"train": 80, "val": 80}, cap=5, order=["at"], n_classes=2)
    with pytest.raises(ValueError, match="not enough reads"):
        splits.require_targets(picked, ["a", "b"], {"train": 80, "val": 80})


def test_round_robin_equals_taking_turns(spark):
    rows = random_manifest(900, 5, classes=("a",))
    df = spark.createDataFrame(rows, "barcode string, ccf_file string, read_id string, at long").withColumn("split", F.lit("train"))
    got = splits.round_robin(df, targets={"train": 130}, seed=7, order=["at"]).orderBy("split_order").collect()
    by_file = defaultdict(list)
    for _, f, read, _ in rows:
        by_file[f].append(read)
    files = sorted(by_file, key=lambda f: sha(7, "group", f))
    queues = [sorted(by_file[f], key=lambda r: sha(7, "read", r)) for f in files]
    expected = []
    while len(expected) < 130:
        for q in queues:
            if q and len(expected) < 130:
                expected.append(q.pop(0))
    assert [r.read_id for r in got] == expected


def test_fixture_tier(spark):
    df = spark.createDataFrame(packaged(), MANIFEST)
    tier = splits.round_robin(df, targets={"train": 2, "val": 2, "test": 2}, seed=42, order=["split_order"])
    rows = tier.collect()
    assert len(rows) == 54 and len({r.read_id for r in rows}) == 54
    assert {(r.n_reads, r.n_files) for r in audit.tier_summary(tier).collect()} == {(2, 2)}
    for r in audit.split_overlap(tier).collect():
        assert (r.train_val, r.train_test, r.val_test) == (0, 0, 0)


def test_first_files(spark):
    df = spark.createDataFrame(packaged(), MANIFEST)
    few = splits.first_files(df, files_per_class=2, reads_per_file=2, eval_reads=2, order=["split_order"])
    assert Counter((r.split, r.barcode) for r in few.collect()) == {
        **{("train", c): 4 for c in CLASSES}, **{(s, c): 2 for s in ("val", "test") for c in CLASSES}
    }


def test_manifest_audit_passes_and_fails(spark):
    good = spark.createDataFrame(packaged(), MANIFEST)
    assert audit.audit_manifest(good).summary.first().status == "pass"
    bad = good.union(spark.createDataFrame([("test", 0, "k0", 0, "k0-train-0", "elsewhere/train0.ccf5")], MANIFEST))
    result = audit.audit_manifest(bad)
    s = result.summary.first()
    assert (s.status, s.duplicate_read_rows, s.read_id_split_leakage, s.ccf_file_split_leakage) == ("fail", 1, 1, 1)
    assert {(r.kind, r.example) for r in result.examples.collect()} == {
        ("duplicate_read_ids", "k0-train-0"), ("read_id_leakage", "k0-train-0"), ("ccf_file_leakage", "k0/train0.ccf5")
    }


def test_same_file_name_in_two_classes_is_no_leak(spark):
    rows = [("train", 0, "k0", 0, "a", "k0/shared.ccf5"), ("test", 0, "k1", 1, "b", "k1/shared.ccf5")]
    assert audit.audit_manifest(spark.createDataFrame(rows, MANIFEST)).summary.first().status == "pass"


def test_duplicate_reads_raise(spark):
    df = spark.createDataFrame(packaged(), MANIFEST)
    assert audit.require_unique_reads(df, "manifest") is df
    with pytest.raises(ValueError, match="duplicate read_id in manifest"):
        audit.require_unique_reads(df.union(df.limit(1)), "manifest")


def test_subsets_are_nested_and_relabelled(spark):
    df = spark.createDataFrame(packaged(), MANIFEST)
    order = list(reversed(CLASSES))
    rows = splits.subset_classes(df, order[:5]).select("barcode", "label").distinct().collect()
    assert {r.barcode: r.label for r in rows} == {c: i for i, c in enumerate(order[:5])}
    audits = {r.class_count: r for r in splits.subset_audit(df, order, 5).collect()}
    assert sorted(audits) == [5, 6, 7, 8, 9]
    for k, r in audits.items():
        assert (r.read_overlap, r.file_overlap, r.train_rows, r.val_rows, r.test_rows) == (0, 0, 8 * k, 8 * k, 8 * k)


def test_greedy_order(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(8)]
    dist = {}
    for i, a in enumerate(names):
        for b in names[i:]:
            dist[(a, b)] = dist[(b, a)] = 0.0 if a == b else rng.choice([0.1, 0.2, 0.3, 0.4])
    df = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "src string, dst string, distance double")
    got = [r.barcode for r in splits.greedy_order(df, ("n2", "n5")).orderBy("position").collect()]
    chosen, rest = ["n2", "n5"], set(names) - {"n2", "n5"}
    while rest:
        best = max(rest, key=lambda n: (min(dist[(n, c)] for c in chosen), n))
        chosen.append(best)
        rest.remove(best)
    assert got == chosen
    with pytest.raises(ValueError, match="anchors"):
        splits.greedy_order(df, ("n1", "n1"))


def test_pairs_share_the_class_and_differ_in_the_file(spark):
    df = spark.createDataFrame(
        [(f"c{i % 3}", f"f{i % 3}_{i // 3 % 3}", f"r{i}") for i in range(18)], "barcode string, ccf_file string, read_id string"
    )
    rows = splits.cross_file_pairs(df, n_pairs=300, seed=5, order=["read_id"]).collect()
    assert len(rows) == 300 and Counter(r.barcode for r in rows) == {"c0": 100, "c1": 100, "c2": 100}
    owner = {r.read_id: (r.barcode, r.ccf_file) for r in df.collect()}
    for r in rows:
        assert r.left_file != r.right_file
        assert owner[r.left_read] == (r.barcode, r.left_file) and owner[r.right_read] == (r.barcode, r.right_file)
    assert len({(r.left_read, r.right_read) for r in rows}) > 50
    single = df.where("ccf_file <> 'f0_0' AND ccf_file <> 'f0_1'")
    with pytest.raises(Exception, match="class needs at least two files: c0"):
        splits.cross_file_pairs(single, n_pairs=3, seed=5, order=["read_id"]).collect()


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_kmers_match_counting_by_hand(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("acgt") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + ["", "acnnt", "gattaca"]
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(seqs)], "read_id string, seq string")
    flip = str.maketrans("acgt", "tgca")
    expected = Counter()
    for i, s in enumerate(seqs):
        for j in range(len(s) - k + 1):
            w = s[j : j + k]
            if set(w) <= set("acgt"):
                expected[(f"r{i}", min(w, w.translate(flip)[::-1]))] += 1
    got = {(r.read_id, r.kmer): r.n for r in kmers.read_kmers(df, k).collect()}
    assert got == expected
    assert {(r.read_id, r.kmer): r.n for r in kmers.kmer_counts(df, k, ["read_id"]).collect()} == expected
    names = kmers.canonical_rank(k)[1]
    assert len(names) == (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2
    for r in kmers.kmer_vectors(df, k).collect():
        assert [int(v) for v in r.kmers] == [expected[(r.read_id, m)] for m in names]


def test_feature_match_rejects_missing_and_mislabelled_reads(spark):
    selected = spark.createDataFrame([("train", "a", "x", 0), ("train", "b", "y", 1)], "split string, read_id string, barcode string, at int")
    good = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "read_id string, barcode string, v double")
    rows = kmers.match_features(selected, good, order=["at"]).orderBy("new_index").collect()
    assert [(r.new_index, r.read_id, r.v) for r in rows] == [(0, "a", 1.0), (1, "b", 2.0)]
    with pytest.raises(Exception, match="read has no features: b"):
        kmers.match_features(selected, good.where("read_id = 'a'"), order=["at"]).collect()
    with pytest.raises(Exception, match="label mismatch for read b"):
        kmers.match_features(selected, good.withColumn("barcode", F.lit("x")), order=["at"]).collect()


def test_round_robin_shares_name_only_the_files_that_give(spark):
    """Sizes 1 to 9 and 40, one file without a name; as if every lap were dealt by hand."""
    sizes = {("x", f"f{n}"): n for n in (1, 2, 2, 3, 5, 9, 40)} | {("x", None): 4, ("y", "g"): 3}
    rows = [(c, "train", f) for (c, f), n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "barcode string, split string, ccf_file string")
    for target in (1, 3, 7, 8, 20, 100):
        got = {(r.barcode, r.ccf_file): r.share for r in splits._shares(df, {"train": target}, 5).collect()}
        expected: dict = {}
        for c in ("x", "y"):
            at = sorted((f for k, f in sizes if k == c), key=lambda f: hashlib.sha256("|".join(["5", "group", *([f] if f else [])]).encode()).hexdigest())
            turns = [f for lap in range(1, 41) for f in at if sizes[c, f] >= lap][:target]
            expected |= {(c, f): turns.count(f) for f in turns}
        assert got == expected
