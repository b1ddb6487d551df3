"""The dealt operators against brute force, exact round trips and held-out labels, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigspark.llm import ann_tree, cosine_lsh, huffman, line_dedup, mixing, packing, quality_crf, secret_dfa, simhash, tokens, toxicity
from sigspark.llm.common import table
from sigspark.llm.components import components, local_components

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash with results."""
    rows = [
        (0, None, None, None, None, "x", "y"), (1, "", "en", "a", 0, "x", "y"), (2, "word " * 30_000, "en", "a", 1, "x", "y"),
        (None, "no id at all in this line of text", "en", "b", 3, "x", "y"), (4, "one two three", None, "b", 4, None, None),
        (5, "one two three four five six", "en", None, 5, "x", "y"), (6, "one two three four five six", "en", None, 5, "x", "y"),
        (7, "é\n\n ß  x\r\n", "de", "a", 6, "x", "y"), (7, "é\n\n ß  x\r\n", "de", "a", 6, "x", "y"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_classifiers_tell_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    quality = quality_crf.quality_query(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (quality.predicted == quality.quality).mean() > 0.98
    toxic = toxicity.toxicity_query(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (toxic.predicted[toxic.toxic == 1] == 1).mean() > 0.8
    assert (toxic.predicted[toxic.toxic == 0] == 1).mean() < 0.03
    assert toxic.score.between(0, 1).all()


def test_classifiers_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for query in (quality_crf.quality_query, toxicity.toxicity_query):
        assert query(awkward, labels).count() == awkward.count()
        assert query(empty, labels).count() == 0
    assert toxicity.keep_clean(awkward, toxicity.fit(awkward, labels)).schema == awkward.schema


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    odds, transition, lines = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([3, 4])
    marginal, _, norm = quality_crf.forward_backward(odds, transition, lines)
    total, at = 0.0, 0
    for n in lines:
        weights = np.zeros(n)
        z = 0.0
        for states in np.ndindex(*[2] * n):
            w = np.exp(sum(odds[at + i] * s for i, s in enumerate(states)) + sum(transition[a, b] for a, b in zip(states, states[1:])))
            z += w
            weights += w * np.array(states)
        assert np.allclose(marginal[at : at + n], weights / z)
        total, at = total + np.log(z), at + n
    assert np.isclose(norm, total)


def test_secrets_equal_regular_expressions():
    scanner = secret_dfa.compile_rules()
    parts = ["password", "PassWd", "secret", "token", "api_key", '"', "'", " ", ":", "=", "AKIA", "Q7", "a1b2", "deadbeef0123", "é",
             "\n", "xyz", "abcdefghijklmnopqrst", "0" * 24, "Ω", "xoxb-", "ghp_"]
    rng = random.Random(1)
    batch = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["", "a" * 200_000]
    for text, found in zip(batch, secret_dfa.spans(batch, scanner)):
        expected = []
        for k, rule in enumerate(scanner.rules[:5]):
            prefix = f"(?{'i' if rule.any_case else ''}:{rule.prefix})"
            pattern = re.compile(f"{prefix}(?P<body>{rule.body}+)", re.ASCII)
            expected += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m["body"]) >= rule.least]
        assert [f for f in found if f[1] < 5] == sorted(expected)


def test_secrets_on_awkward_rows(awkward, empty):
    rows = secret_dfa.secrets_query(awkward).collect()
    assert len(rows) == awkward.count() and all(r.spans == "" for r in rows)
    assert secret_dfa.secrets_query(empty).count() == 0


def test_local_and_distributed_components_agree(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    local = local_components(400, a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")).collect()}
    assert all(found.get(i, i) == local[i] for i in range(400))


def test_fingerprints_and_tiles(spark, awkward, empty):
    text = "The QUICK brown\tfox jumps over"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    assert simhash.fingerprint(text) == sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) > 1.5)
    assert simhash.fingerprint("  ") == 0
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64))
    values = np.unique(np.concatenate([base, near]))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    want = local_components(len(values), i, j)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for block in (1 << 17, 40):
        found = {r.node: r.component for r in components(simhash.links(frame, 4, block)).collect()}
        groups: dict = {}
        for value, group in zip(values.view(np.int64).tolist(), want.tolist()):
            groups.setdefault(group, set()).add(found.get(value, value))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set.union(*groups.values()))
    assert simhash.simhash_query(awkward).count() == awkward.count()
    kept = simhash.keep_one(awkward)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2, 4, 5, 7]
    assert simhash.simhash_query(empty).count() == 0


def test_cosine_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    rows = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.2, base[:5], base[:5]])
    data = [(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    i, j = np.nonzero(unit @ unit.T >= 0.9)
    want = local_components(len(rows), i, j)
    for block in (4096, 32):
        found = {r.vec_id: r for r in cosine_lsh.near_duplicates(frame, block=block).collect()}
        assert [found[k].component_id for k in range(len(rows))] == want.tolist()
        assert [found[k].n_links for k in range(len(rows))] == (np.bincount(i, minlength=len(rows)) - 1).tolist()
        assert all(found[k].n_links == 0 and found[k].kept for k in (900, 901, 902, 903))
    assert cosine_lsh.cosine_query(frame.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    embeddings = table(spark, "/root/testdata/sf0.1", "embeddings")
    frame = embeddings.toPandas()
    rows, ids = np.stack(frame.embedding.to_numpy()).astype(float), frame.vec_id.to_numpy()
    found = ann_tree.ann_query(embeddings).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, distance)) if k != q][:10]
        mine = found[found.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.score.is_monotonic_increasing
        hits += len(set(mine.vec_id) & set(ids[order]))
    assert hits >= 0.9 * len(found)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann_tree.ann_query(few).collect()] == [(0, 1, 1, 0.0)]
    assert ann_tree.ann_query(few.limit(0)).count() == 0


def test_visits_in_rounds_find_what_all_visits_find(spark):
    assert ann_tree.rounds(1, 6) == [(0, 1)] and ann_tree.rounds(40, 6) == [(0, 1), (1, 6), (6, 36), (36, 40)]
    rng = np.random.default_rng(2)
    rows = rng.integers(-2, 3, (600, 4)).astype(float)  # many ties and copies
    rows[:, 0] += 7
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    settings = ann_tree.TreeSettings(leaf=8, recall=1.0, growth=2, row_block=5, query_block=4)
    found = ann_tree.search(frame, F.col("vec_id") % 20 == 0, k=7, settings=settings).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    for q in range(0, 600, 20):
        distance = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(600), distance)) if i != q][:7]
        assert [got[q, n + 1][1] for n in range(7)] == [float(distance[i]) for i in order]


def test_mix_meets_targets(spark, awkward, empty):
    # 180 words dealt 5 : 2 : 1, but the second and third source cannot take more than 20 each
    assert mixing.source_targets([100, 10, 10]) == pytest.approx([140.0, 20.0, 20.0])
    documents = table(spark, SF, "documents")
    first = mixing.mixing_query(documents).toPandas().sort_values("doc_id")
    again = mixing.mixing_query(documents.repartition(5)).toPandas().sort_values("doc_id")
    assert first.taken.tolist() == again.taken.tolist() and (first.taken <= 2 * first["size"]).all()
    by = first.join(documents.toPandas().set_index("doc_id").source, "doc_id").groupby("source")
    assert (abs(by.taken.sum() - by.target.first()) <= 0.02 * by.target.first()).all()
    assert abs(by.target.first().sum() - 1.5 * first["size"].sum()) < 1e-6
    assert mixing.mixing_query(awkward).count() == awkward.count()
    assert mixing.mixing_query(empty).count() == 0
    assert mixing.apply_mix(awkward, mixing.mix(awkward)).schema["text"] == awkward.schema["text"]


def test_token_ids_equal_the_library():
    parts = ["the", "Foo", " ", "  ", "\n", " \n", "\t", "é", "é", "́", "'s", "12", "!!", "日本", " ", "Σ", "<|endoftext|>", "\r\n"]
    rng = random.Random(2)
    batch = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = tokens.encoder(tokens.vocabulary(name), blanks)
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.library.encode_batch(batch, add_special_tokens=False)]
        assert encoder.encode(batch) == want


def test_packing_is_gapless_and_tight(spark, awkward, empty):
    rows = packing.packing_query(table(spark, SF, "documents")).toPandas()
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 2048 + 1
    assert not rows.duplicated(["doc_id", "piece"]).any()
    assert packing.packing_query(awkward).where("piece = 0").count() == awkward.count()
    assert packing.packing_query(empty).count() == 0


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(4)
    length = np.sort(rng.integers(1, 900, 500))[::-1].astype(float)
    demand = np.stack([length, np.ones(500), length**2], 1)
    for rule in ("norm", "dot"):
        bins = packing.Bins(tokens=1000, documents=3, attention=700_000, rule=rule)
        chosen = packing.best_fit(demand, bins)
        for bin_ in np.unique(chosen):
            total = demand[chosen == bin_].sum(0)
            assert (total <= bins.capacity).all() or (chosen == bin_).sum() == 1


def test_huffman_refuses_ids_beyond_16_bits():
    ids = np.array([0, 7, 0xFFFF], dtype="<u4")
    assert (huffman._unsqueeze(huffman._squeeze(ids.tobytes())) == ids).all()
    assert len(huffman._unsqueeze(huffman._squeeze(b""))) == 0
    with pytest.raises(ValueError, match="65536"):
        huffman._squeeze(np.array([3, 0x10000], dtype="<u4").tobytes())


def test_huffman_round_trip(spark, awkward, empty, tmp_path):
    rng = np.random.default_rng(0)
    for n in (1, 511, 512, 513, 20_000):
        ids = np.minimum(rng.zipf(1.2, n), 60_000)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
        assert lengths.max() <= huffman.LIMIT and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        stream, checkpoints = huffman.encode_ids(ids, lengths, huffman.canonical_codes(lengths))
        assert (huffman.decode_ids(stream, checkpoints, n, huffman.decoding_table(lengths)) == ids).all()
    documents = table(spark, SF, "documents")
    library = tokens.encoder(tokens.vocabulary("word_bpe_49k.json"), False).library
    start, want = 0, []
    for doc_id, text in documents.select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in huffman.huffman_query(documents).collect()) == want
    assert huffman.huffman_query(awkward).count() == awkward.count()
    assert huffman.huffman_query(empty).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_equals_brute_force(spark, edits):
    rng = random.Random(3)
    lines = []
    for _ in range(9):
        base = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(24, 50)))
        for _ in range(5):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
            lines.append("".join(text))
    rng.shuffle(lines)
    documents = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(9)]
    places = [(i, j, line) for i, text in documents for j, line in enumerate(text.split("\n")) if len(line) >= line_dedup.SHORTEST]
    distinct = sorted({p[2] for p in places})
    left, right = zip(*[(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct)
                        if abs(len(a) - len(b)) <= edits and _distance(a, b) <= edits])
    group = dict(zip(distinct, local_components(len(distinct), np.array(left), np.array(right)).tolist()))
    first: dict = {}
    for i, j, line in sorted(places):
        first.setdefault(group[line], (i, j))
    want = {(i, j) for i, j, line in places if first[group[line]] != (i, j)}
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    assert {(r.doc_id, j) for r in line_dedup.removed_lines(frame, edits).collect() for j in r.removed} == want


def test_line_dedup_links_two_edits_by_default(spark):
    rng = random.Random(5)
    pairs = [("x" * 11 + "a long line of the corpus" + "y" * 264, "x" * 11 + "a lnog line of the corpus" + "y" * 264)]
    for k in range(300):
        base = f"{k:03d}" + "".join(rng.choice("abcdefgh é" if k % 3 else "abcdefgh ") for _ in range(rng.randint(24, 120)))
        text = list(base)
        for place in sorted(rng.sample(range(len(text)), 2) if k % 4 else [0, len(text) - 1], reverse=True):
            text[place : place + rng.randint(0, 1)] = rng.choice(["", "z", "zy"])[:1]
        pairs.append((base, "".join(text)))
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    rows = [(i, text) for i, text in rows if min(map(len, text.split("\n"))) >= line_dedup.SHORTEST]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, tuple(r.removed)) for r in line_dedup.removed_lines(frame).collect()} == {(i, (1,)) for i, _ in rows}
    assert {r.removed for r in line_dedup.line_query(frame).collect()} == {"1"}
    assert {r.text for r in line_dedup.without_duplicates(frame).collect()} == {text.split("\n")[0] for _, text in rows}


def test_line_dedup_lists_few_pairs_of_large_groups(spark, monkeypatch):
    rng = random.Random(8)
    template = [rng.choice(["other", "word", "line", "of", "the", "corpus", "thing"]) + rng.choice("abcdefgh") for _ in range(40)]
    apart, numbered = set(), [f"a line that is the same but for its number {k:04d} in the middle of it" for k in range(0, 1600, 2)]
    while len(apart) < 800:
        line = list(template)
        for place in rng.sample(range(40), 2):
            line[place] = "".join(rng.choice("ijklmnopqrstuvwxyz") for _ in range(6))
        apart.add(" ".join(line))
    twins = [line[:50] + "X" + line[50:-1] for line in sorted(apart)[:20]]
    listed = []
    pairs = line_dedup._pairs
    monkeypatch.setattr(line_dedup, "_pairs", lambda *some: listed.append(pairs(*some)) or listed[-1])
    rows = list(enumerate([*sorted(apart), *twins, *numbered]))
    found = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the numbered lines are all connected, the others but for their twins are not
    assert {r.doc_id for r in found} == {*range(800, 820), *range(821, 1620)}
    assert listed[0].count() < 2 * len(rows)


def test_line_dedup_on_awkward_rows(awkward, empty):
    cut = line_dedup.without_duplicates(awkward)
    assert cut.columns == awkward.columns
    texts = {r.doc_id: r.text for r in cut.where("doc_id is not null").collect()}
    assert texts[5] == "one two three four five six" and texts[6] == "" and texts[0] is None and texts[1] == ""
    assert line_dedup.line_query(awkward).count() == awkward.count()
    assert line_dedup.line_query(empty).count() == 0


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_word_cache_gives_the_library_ids(name, blanks):
    encoder = tokens.Encoder(tokens.vocabulary(name), blanks)
    texts = [
        "", " ", "  a", "a ", "\t\n", "abc\n\n def\n", "It's we'RE 'red '' ''s 'S' x'll", "don't'sx 's's", "a\x1cb c\x1fd",
        "\x00 \x01 \x7f", "12345 x1y2_z-9", "x" * 3000, "ÀÖØÞ Éa1ÿ ß× ÷Ü'S è'Ré", "e\u0301É É\u0301x \u0301 a\u0301b",
        "µm ªº Ÿ ½ ² Ⅳ", "İstanbul ΑΣ Σ", "ﬁ ſ K Ａ１", "a\u00a0b\u2003c\u3000d\x85e\u200bf \ufeff", "日本語 テキスト 한국어",
        "🙂👍🏽 a", "<|endoftext|> a <|ENDOFTEXT|> <|startoftext|>",
    ]
    expected = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == expected
    assert encoder.encode(texts[::-1]) == expected[::-1]  # from the cache
