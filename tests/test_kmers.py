"""k-mers are counted in slices of bounded text."""

from __future__ import annotations

import tracemalloc

import numpy as np

from sigspark.operators import kmers


def _plain(seq: str, k: int) -> dict[str, int]:
    found: dict[str, int] = {}
    for i in range(len(seq) - k + 1):
        word = seq[i : i + k]
        if set(word) <= set("acgt"):
            other = word[::-1].translate(str.maketrans("acgt", "tgca"))
            found[min(word, other)] = found.get(min(word, other), 0) + 1
    return found


def test_slices_count_every_window_once(spark, monkeypatch):
    monkeypatch.setattr(kmers, "SLICE", 50)
    position, names = kmers.canonical_rank(3)
    draw = np.random.default_rng(0)
    seqs = ["".join(draw.choice(list("acgtn"), n, p=[0.24] * 4 + [0.04])) for n in (0, 2, 3, 49, 50, 51, 52, 500, 7)]
    got = {}
    for start, stop in kmers._slices(np.array([len(s) for s in seqs])):
        for row, cell, n in zip(*kmers._cells(seqs[start:stop], 3, position)):
            got.setdefault(start + int(row), {})[names[cell]] = int(n)
    assert [got.get(i, {}) for i in range(len(seqs))] == [_plain(s, 3) for s in seqs]


def test_counts_of_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([("a", "acgta"), (None, "ccc"), ("a", "acg"), ("b", None), (None, "ccca")], "barcode string, seq string")
    got = {(r.barcode, r.kmer): r.n for r in kmers.kmer_counts(rows.coalesce(1), 3, ["barcode"]).collect()}
    assert got == {("a", "acg"): 3, ("a", "gta"): 1, (None, "ccc"): 2, (None, "cca"): 1}


def test_memory_does_not_grow_with_the_text(spark):
    position, _ = kmers.canonical_rank(5)
    seqs = ["".join(np.random.default_rng(n).choice(list("acgt"), n)) for n in (20_000,) * 100 + (3_000_000,)]
    tracemalloc.start()
    for start, stop in kmers._slices(np.array([len(s) for s in seqs])):
        kmers._cells(seqs[start:stop], 5, position)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * kmers.SLICE * 4
