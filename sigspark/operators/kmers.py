"""Canonical k-mer features of sequences and distances between classes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators.prefix import with_row_number
from sigspark.session import cut_lineage

ALPHABET = "acgt"


def canonical_rank(k: int) -> tuple[np.ndarray, list[str]]:
    """Feature position of every k-mer code (base 4, first letter most significant) and the k-mer of every position.

    A k-mer and its reverse complement share the position; positions follow the alphabetical order of the smaller one.
    """
    codes = np.arange(4**k, dtype=np.int64)
    complement = np.zeros_like(codes)
    rest = codes.copy()
    for _ in range(k):
        complement = complement * 4 + (3 - rest % 4)
        rest //= 4
    kept, position = np.unique(np.minimum(codes, complement), return_inverse=True)
    letters = np.array(list(ALPHABET))
    digits = (kept[:, None] // 4 ** np.arange(k - 1, -1, -1)) % 4
    return position.astype(np.int64), ["".join(row) for row in letters[digits]]


#: Characters of sequences that are turned into windows at a time.
SLICE = 1 << 18


def _windows(seqs: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, k-mer code) of every window of a batch of sequences; windows with another letter are left out."""
    digit = np.full(256, -1, dtype=np.int8)
    for value, letter in enumerate(ALPHABET):
        digit[ord(letter)] = value
    encoded = [s.encode() for s in seqs]
    # one line for the whole batch; the separator is no letter, so no window crosses two sequences
    line = digit[np.frombuffer(b" ".join(encoded) + b" " * k, dtype=np.uint8)]
    row = np.repeat(np.arange(len(encoded)), [len(e) + 1 for e in encoded])
    n = len(line) - k + 1
    code = np.zeros(n, dtype=np.int64)
    clean = np.ones(n, dtype=bool)
    for j in range(k):
        code *= 4
        code += line[j : j + n]
        clean &= line[j : j + n] >= 0
    at = np.flatnonzero(clean)
    return row[at], code[at]


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some SLICE characters together, or one longer row alone; 512 rows at most."""
    lengths = np.maximum(lengths, SLICE >> 9)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start] - lengths[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield start, stop
        start = stop


def _cells(seqs: Sequence[str], k: int, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature position, count) of a slice; a longer sequence is read in pieces that share the letters of a window less one."""
    size = int(position.max()) + 1
    if len(seqs) > 1 or len(seqs[0]) <= SLICE:
        row, code = _windows(seqs, k)
        cell, n = np.unique(row * size + position[code], return_counts=True)
        return cell // size, cell % size, n
    total = np.zeros(size, dtype=np.int64)
    for start in range(0, len(seqs[0]), SLICE):
        _, code = _windows([seqs[0][start : start + SLICE + k - 1]], k)
        total += np.bincount(position[code], minlength=size)
    found = np.flatnonzero(total)
    return np.zeros(len(found), dtype=np.int64), found, total[found]


def kmer_vectors(sequences: DataFrame, k: int = 6, *, relative: bool = False) -> DataFrame:
    """One dense vector of canonical k-mer counts (or frequencies) per read; needs no shuffle, as a read is one row."""
    position, names = canonical_rank(k)
    size = len(names)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, batch = [], batch.fillna("")
            for start, stop in _slices(batch.str.len().to_numpy().astype(np.int64)):
                part = batch.iloc[start:stop]
                row, cell, n = _cells(part.to_list(), k, position)
                counts = np.zeros((len(part), size), dtype=np.float32)
                counts[row, cell] = n
                if relative:
                    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
                out.extend(counts)
            yield pd.Series(out, dtype=object)

    return sequences.withColumn("kmers", vectors("seq")).drop("seq")


def _batch_counts(sequences: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """(keys, kmer, n) counted inside slices of bounded text, so that memory does not grow with the batches."""
    position, names = canonical_rank(k)
    kmers = pa.array(names)
    types = dict(sequences.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "kmer string", "n long"])
    n_keys = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(n_keys)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in _slices(lengths):
                part = batch.slice(start, stop - start)
                ids = pa.RecordBatch.from_arrays(part.columns[:n_keys], names=list(keys)).to_pandas()
                group = ids.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
                row, cell, n = _cells(pc.fill_null(part.column(n_keys), "").to_pylist(), k, position)
                # the rows of a group add up; its first row has its keys
                merged, at = np.unique(group[row] * len(names) + cell, return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(merged)).astype(np.int64)
                first = np.unique(group, return_index=True)[1]
                own = pa.array(first[merged // len(names)])
                columns = [*(c.take(own) for c in part.columns[:n_keys]), kmers.take(pa.array(merged % len(names))), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "kmer", "n"])

    return sequences.select(*keys, "seq").mapInArrow(count, schema)


def read_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(read_id, kmer, n) of canonical k-mers; a read is one row, so there is nothing to shuffle."""
    return _batch_counts(sequences, k, ["read_id"])


def kmer_counts(sequences: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """(keys, kmer, n) of canonical k-mers; only the counts of each batch are shuffled."""
    return _batch_counts(sequences, k, keys).groupBy(*keys, "kmer").agg(F.sum("n").alias("n"))


def kmer_distance(sequences: DataFrame, k: int, classes: Sequence[str]) -> DataFrame:
    """Cosine distance between the k-mer profiles of all pairs of ``classes``; 1 where no k-mer is shared.

    A profile has at most 4^k entries per class, so the join on the k-mer works on a table of classes x 4^k rows, which is
    built once.
    """
    profile = cut_lineage(kmer_counts(sequences, k, ["barcode"]))
    norms = profile.groupBy("barcode").agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    left = profile.select(F.col("barcode").alias("src"), "kmer", F.col("n").alias("n_src"))
    right = profile.select(F.col("barcode").alias("dst"), "kmer", F.col("n").alias("n_dst"))
    dots = (
        left.join(right, "kmer")
        .groupBy("src", "dst")
        .agg(F.sum(F.col("n_src").cast("double") * F.col("n_dst")).alias("dot"))
    )
    a = norms.select(F.col("barcode").alias("src"), F.col("norm").alias("norm_src"))
    b = norms.select(F.col("barcode").alias("dst"), F.col("norm").alias("norm_dst"))
    # the declared pairs, as large as the result
    grid = sequences.sparkSession.createDataFrame([(x, y) for x in classes for y in classes], "src string, dst string")
    similarity = F.coalesce(F.col("dot") / (F.col("norm_src") * F.col("norm_dst")), F.lit(0.0))
    return grid.join(dots, ["src", "dst"], "left").join(a, "src", "left").join(b, "dst", "left").select(
        "src", "dst", (1 - similarity).alias("distance")
    )


def union_caches(caches: Mapping[str, DataFrame]) -> DataFrame:
    """Feature tables of several source splits as one, tagged with ``source_split``."""
    tagged = [df.withColumn("source_split", F.lit(name)) for name, df in caches.items()]
    return reduce(DataFrame.unionByName, tagged)


def match_features(selected: DataFrame, features: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """Selected reads with their features and their position inside the split.

    A read without features, or with features of another class, is an error at run time.
    """
    numbered = with_row_number(selected, ["split"], order, "new_index").withColumn("new_index", F.col("new_index") - 1)
    known = features.withColumnRenamed("barcode", "feature_class")
    joined = numbered.join(known, "read_id", "left")
    missing = F.concat(F.lit("read has no features: "), F.col("read_id"))
    mismatch = F.concat(F.lit("label mismatch for read "), F.col("read_id"))
    checked = (
        F.when(F.col("feature_class").isNull(), F.raise_error(missing).cast("string"))
        .when(F.col("feature_class") != F.col("barcode"), F.raise_error(mismatch).cast("string"))
        .otherwise(F.col("barcode"))
    )
    return joined.withColumn("barcode", checked).drop("feature_class")
