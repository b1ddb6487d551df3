"""Hard negatives, window packing and the filter audit against brute force, also on awkward rows."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from sigspark.llm import common, filter_audit, hard_negatives, tokens, window_packing

COLUMNS = "doc_id long, text string, lang string, source string, part string, mask int, start string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns whose names clash with results."""
    rng = random.Random(4)
    rows = [
        (0, None, None, None, "x", 1, "y"), (1, "", "en", "a", "x", 1, "y"), (2, "word " * 30_000, "en", "a", None, None, None),
        (None, "no id at all", "en", "b", "x", 1, "y"), (None, "no id at all", "en", "b", "x", 1, "y"), (4, "one two #", None, "b", "x", 1, "y"),
        (7, "é\n\n ß  x\r\n", "de", "a", "x", 1, "y"), (7, "é\n\n ß  x\r\n", "de", "a", "x", 1, "y"), (9, "é\n\n ß  x\r\n", "", "a", "x", 1, "y"),
        (10, "ABC " * 300, "de", "a", "x", 1, "y"), (11, "\x0b".join(f"W{i}" for i in range(250)), "en", "a", "x", 1, "y"),
    ]
    for i in range(20, 90):
        words = [rng.choice(["alpha", "Beta", "x&y", "delta", f"w{rng.randint(0, 999)}"]) for _ in range(rng.choice([3, 150, 400]))]
        rows.append((i, " ".join(words) if i % 9 else rows[-1][1], rng.choice(["en", "de", None]), "s", "x", 1, "y"))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_slices_cover_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 5], "n": range(6)})
    parts = list(common.sliced(batch, 20))
    assert [p.num_rows for p in parts] == [2, 1, 3]
    assert [v for p in parts for v in p.column("n").to_pylist()] == list(range(6))


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_gathered_ids_equal_the_library(name, blanks, monkeypatch):
    coder = tokens.encoder(tokens.vocabulary(name), blanks)
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\t", "a", "b", "É", "é", "1", "٣", "'s", "'", "$", "\x01", "\x1d", "\xa0", "Σ", "日", "<|endoftext|>"]
    batch = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    batch += ["", " ", "a ", " a", "long text " * 3000, "two  blanks " * 3000, "x" * 5000]
    expected = [e.ids for e in coder.library.encode_batch_fast(batch, add_special_tokens=False)]
    for size in (tokens.SLICE, 500):  # the second size cuts texts into sections and renews the store
        monkeypatch.setattr(tokens, "SLICE", size)
        monkeypatch.setattr(tokens, "SECTION", size)
        monkeypatch.setattr(tokens, "WORDS", 50 if size == 500 else tokens.WORDS)
        assert [ids.tolist() for ids in coder.arrays(batch)] == expected


def test_positional_counts_equal_plain_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 1000):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]
    for mask, word in enumerate(filter_audit.survival_words()):
        assert all((int(word) >> s & 1) == (mask & s == 0) for s in range(32))


def test_words_of_long_texts(monkeypatch):
    text = b" a b\x0ba  c\x85\xc2\xa0d\x1ce \n" * 40 + b"z" * 50
    expected = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "STEP", 7)
    assert filter_audit.word_counts(text) == expected == (len(text.split()), len(set(text.split())))


def _audit(rows, labels):
    """Every order applied document by document."""
    fails = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows)
        fails.append((lang or "", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text), copy,
        ], labels.get(doc_id, (0, 0))))
    out, shapley = {}, {}
    for order in itertools.permutations(range(5)):
        name = "".join("ABCDE"[f] for f in order)
        for part in {p for p, _, _ in fails}:
            alive = [d for d in fails if d[0] == part]
            whole = list(alive)
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[1][f]]
                alive = [d for d in alive if not d[1][f]]
                out[part, name, step] = (
                    len(alive), len(gone), sum(d[1][f] for d in whole) - len(gone), sum(sum(d[1]) == 1 and d[1][f] for d in whole),
                    sum(d[2][0] for d in gone), sum(d[2][1] for d in gone),
                )
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def test_filter_audit_equals_orders_applied_one_by_one(spark, awkward, empty):
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(1, 80)] + [(25, None, 1), (25, 0, None), (None, 1, 1), (30, 1, 0), (30, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    known = {i: (i % 2, int(i % 3 == 0)) for i in range(1, 80)} | {25: (1, 1), 30: (1, 1)}
    found = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.audit_query(awkward, labels).collect()}
    assert found == _audit([tuple(r) for r in awkward.collect()], known)
    assert filter_audit.audit_query(empty, labels).count() == 0
    assert filter_audit.audit_query(awkward, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(5)
    for window in (1, 7, 64, 100):
        lengths = sorted((rng.randint(1, window) for _ in range(300)), reverse=True)
        room, expected = [], []
        for need in lengths:
            fits = [(r, w) for w, r in enumerate(room) if r >= need]
            if fits:
                least = min(r for r, _ in fits)
                w = max(w for r, w in fits if r == least)
            else:
                w = len(room)
                room.append(window)
            room[w] -= need
            expected.append(least if fits else window)
        windows = window_packing.best_fit_decreasing(lengths, window)
        assert sorted(i for w in windows for i in w) == list(range(300))
        assert all(sum(lengths[i] for i in w) <= window for w in windows)
        assert len(windows) == len(room)


@pytest.mark.parametrize("least", [1, 5])
def test_closed_windows_keep_every_token(least):
    rng = random.Random(6)
    for window in (16, 64):
        lengths = sorted((rng.choice([rng.randint(1, window - 1), window // 2 + 1]) for _ in range(rng.randint(0, 60))), reverse=True)
        windows = [[(i, 0, lengths[i]) for i in w] for w in window_packing.best_fit_decreasing(lengths, window)]
        closed = window_packing.close_windows(windows, window, least)
        assert sorted((i, t) for w in closed for i, at, n in w for t in range(at, at + n)) == [(i, t) for i, n in enumerate(lengths) for t in range(n)]
        totals = [sum(n for _, _, n in w) for w in closed]
        assert all(0 < t <= window and (window - t < least or t.bit_count() == 1) for t in totals)


@pytest.mark.parametrize("window, block", [(2048, 16_384), (64, 20)])
def test_packed_windows_hold_the_library_s_ids(awkward, empty, window, block):
    path = tokens.vocabulary("word_bpe_49k.json")
    library = tokens.encoder(path, False).library
    rows = window_packing.pack_windows(awkward, path, False, 1, window, block).collect()
    sequences, covered = {}, {}
    wanted = {}
    for r in awkward.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        wanted.setdefault(r.doc_id, []).append(ids)
    for r in rows:
        ids = next(w for w in wanted[r.doc_id] if len(w) == r.doc_tokens)
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {k: sum(map(len, v)) for k, v in wanted.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at.bit_count() == 1
    assert window_packing.windows_query(empty).count() == 0


@pytest.mark.parametrize("size, dims", [(3, 4), (200, 64), (40_000, 3), (300_000_000, 5), (2, 40_000)])
def test_residue_scores_are_exact(size, dims):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, dims)), rng.integers(-size, size + 1, (9, dims))
    bound = max(int((x.astype(object) ** 2).sum(1).max()) for x in (a, b))
    primes = hard_negatives.primes_for(bound)
    assert math.prod(primes) > 2 * bound + 1
    one, other = hard_negatives.Residues(a, primes), hard_negatives.Residues(b, primes)
    assert (one.scores(other, slice(0, 7), slice(0, 9)) == (a.astype(object) @ b.T.astype(object))).all()


def _negatives(rows, k=5):
    kept = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        one = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vec])
        kept[vec_id] = min(kept.get(vec_id, one), one)
    out = set()
    for a in (i for i in kept if i % 100 == 0):
        label, vec = kept[a]
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, own) for i, (own, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            found = [(n, t) for t, n, own in scored if own != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, r, n, -s, -t) for r, (n, t) in enumerate(found, 1)}
    return out


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(-200, 700):
        vec = [float(np.float32(x)) for x in (base[rng.integers(12)] if i % 3 else rng.normal(size=6) * (0.001 if i % 5 == 0 else 1))]
        rows.append((i, vec, int(rng.integers(0, 3))))
    rows += [(800, None, 1), (900, [1.0] * 6, None), (1000, [1.0, None] + [0.0] * 4, 1), (1100, [float("nan")] + [0.0] * 5, 1),
             (1200, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (1300, [0.0] * 6, 2), (100, [0.5] * 6, 0), (100, [0.5] * 6, 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, vec string, rank int")
    expected = _negatives(rows)
    assert len(expected) > 50
    for tiles in ((8192, 4096), (70, 2)):
        found = hard_negatives.hard_negatives(table, rows_in_tile=tiles[0], anchors_in_tile=tiles[1]).collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert hard_negatives.negatives_query(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="components"):
        hard_negatives.negatives_query(spark.createDataFrame([(100, [1.0], 1), (1, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.negatives_query(spark.createDataFrame([(100, [1e20], 1)], "vec_id long, embedding array<double>, label int"))
