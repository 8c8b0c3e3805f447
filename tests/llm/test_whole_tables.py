"""Whitening, Merkle manifest and harmonic packing on small tables, against plain versions of each."""

import hashlib
import itertools
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from segjobs.llm import base, harmonic, merkle, resampling, whitening

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, length string, digest int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, copies, equal ids, a hot source, columns that operators use
    themselves."""
    rows = [
        (k, f"text {k}\nline two\n" * (k % 5), "en", "hot" if k % 3 else f"s{k % 7}", k, 1, "x", 2) for k in range(40)
    ]
    rows += [
        (40, None, None, None, None, None, None, None),
        (None, "no id\n", "de", "hot", 6, 1, "x", 2),
        (None, "no id\n", "de", "hot", 6, 1, "x", 2),
        (41, "", "", "", 0, 1, "x", 2),
    ]
    rows += [
        (7, "other text of the same id", "en", "hot", 25, 1, "x", 2),
        (5, rows[5][1], "en", "hot", 5, 1, "x", 2),
        (42, "word " * 9000, "en", "é", 45000, 1, "x", 2),
        (43, "Ünïcode\n\n\n", "fr", "hot", 10, 1, "x", 2),
    ]
    return spark.createDataFrame(rows, DOC).repartition(3)


# Whitening --------------------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ found[:, ::-1], values[::-1]


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(3)
    good = (r.standard_normal((300, 6)) * [1, 0.5, 0.3, 0.2, 0.1, 0.05]).astype(np.float32).tolist()
    good += [good[0]] * 50 + [[v + 1e-9 for v in good[1]]]  # copies, and one that differs from another below a 256th
    ids = [*range(len(good) - 1), None]
    odd = [
        None,
        [],
        [1.0, None, 0.0, 0.0, 0.0, 0.0],
        [float("nan")] * 6,
        [float("inf"), *[0.0] * 5],
        [1e30, *[0.0] * 5],
        [0.5] * 5,
    ]
    rows = [(i, v, "a", 1) for i, v in zip(ids, good, strict=True)] + [(1000 + k, v, "a", 1) for k, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x string, component int").repartition(5)
    n, deviation, projected, values = plain_whitening(good)
    got = whitening.report(table).collect()
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-10
    by_id = defaultdict(dict)
    for row in got:
        by_id[row["vec_id"]][row["component"]] = row
    for k in range(4):
        mine = np.array([by_id[i][k + 1]["whitened"] for i in ids])
        wanted = projected[:, k] / np.sqrt(values[k])
        assert np.abs(mine * np.sign(mine @ wanted) - wanted).max() < 1e-10
        assert abs(by_id[0][k + 1]["explained"] - values[k] / values.sum()) < 1e-12
    assert [by_id[i][1]["deviation"] for i in ids] == deviation.tolist()


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.report(spark.createDataFrame([], schema)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.report(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert sorted(
        (r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same
    ) == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.report(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [1.0, 1.0, 1.0])], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(
        abs(abs(r["whitened"]) - 1) < 1e-12 and abs(r["explained"] - 1) < 1e-12 for r in line if r["component"] == 1
    )


def test_deviations_beyond_64_bits_are_exact_or_null():
    x = np.array([[1 << 20, 3], [-(1 << 40), 5]])
    model = whitening.Whitening(1 << 25, [12345, -678], np.zeros(2), np.zeros((2, 0)))
    exact = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x]
    assert model.deviations(x) == [v if v < 1 << 63 else None for v in exact]
    small = whitening.Whitening(1 << 11, [12345, -678], np.zeros(2), np.zeros((2, 0)))
    assert small.deviations(x[:1]) == [sum((small.n * int(v) - s) ** 2 for v, s in zip(x[0], small.sums, strict=True))]


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "turned", "few", "zero", "one"])
def test_bidiagonal_solver(kind):
    r = np.random.default_rng(8)
    turn = np.linalg.qr(r.standard_normal((24, 24)))[0]
    x = {
        "plain": r.standard_normal((200, 24)),
        "graded": r.standard_normal((200, 24)) * np.logspace(0, -7, 24),
        "equal": np.eye(24),
        "turned": np.eye(24) @ turn,
        "few": r.standard_normal((5, 24)),
        "zero": np.zeros((24, 24)),
        "one": r.standard_normal((9, 1)),
    }[kind]
    d = x.shape[1]
    r_ = np.linalg.qr(x, mode="r")
    r_ = np.concatenate([r_, np.zeros((d - len(r_), d))])
    values, found = whitening.principal(r_, len(x), min(d, 6))
    wanted = np.linalg.svd(r_, compute_uv=False) ** 2 / len(x)
    assert np.allclose(values, wanted, rtol=1e-11, atol=1e-14 * (wanted[0] or 1))
    k = int((values[: found.shape[1]] > 1e-14 * values[0]).sum()) if values[0] else 0
    assert np.abs(found[:, :k].T @ found[:, :k] - np.eye(k)).max(initial=0) < 1e-12
    assert np.abs(x.T @ x / len(x) @ found[:, :k] - found[:, :k] * values[:k]).max(initial=0) <= 1e-12 * (
        values[0] or 1
    )


# Merkle manifest --------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(coded(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    return [
        (level[i // 3**k // 3 * 3 : i // 3**k], level[i // 3**k + 1 : i // 3**k // 3 * 3 + 3])
        for k, level in enumerate(levels[:-1])
    ]


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    by_source = defaultdict(list)
    for row in rows:
        cut = row["text"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        text = row["text"].replace("\n", "") if cut else row["text"]
        by_source[row["source"]].append((row["doc_id"], plain_leaf(row, row["text"]), plain_leaf(row, text)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([x[1] for x in by_source[s]]))
    top, out = plain_tree([t[-1][0] for t in trees]), []
    for k, s in enumerate(sources):
        for i, (doc_id, leaf, claimed) in enumerate(by_source[s]):
            path = plain_path(trees[k], i) + plain_path(top, k)
            digest = claimed
            for before, after in path:
                digest = sha(*before, digest, *after)
            out.append(
                (
                    doc_id,
                    leaf,
                    trees[k][-1][0],
                    top[-1][0],
                    sha(*(d for step in path for side in step for d in side)),
                    digest,
                    digest == top[-1][0],
                )
            )
    return out


def manifest_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()]


def none_first(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("width", [1, 7])
def test_manifest_equals_plain_trees(spark, docs, tmp_path, monkeypatch, width):
    """Also with blocks of three leaves, so that trees take many rounds and blocks fetch from several levels."""
    monkeypatch.setattr(merkle, "LEVELS", width)
    monkeypatch.setattr(merkle, "WIDTH", 3**width)
    monkeypatch.setattr(merkle, "NEAR_ROOT", 12)
    got = manifest_rows(spark, docs, tmp_path)
    assert none_first(got) == none_first(plain_manifest(docs.collect()))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, docs, tmp_path):
    assert manifest_rows(spark, docs.where("false"), tmp_path / "none") == []
    one = docs.where("doc_id = 40")
    assert manifest_rows(spark, one, tmp_path / "one") == plain_manifest(one.collect())
    m = merkle.manifest(docs.where("false"))
    assert m.root is None and merkle.proofs(m).count() == 0


def test_proofs_of_some_leaves(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    m = merkle.manifest(docs)
    rows = merkle.proofs(m, lambda x: x["doc_id"] % 6 == 1).withColumn(
        "folded", merkle.fold(F.col("digest"), F.col("steps"))
    ).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(
        r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] % 6 == 1
    )
    wanted = {(r[0], r[1]): r[2:4] for r in plain_manifest(docs.collect())}
    for r in rows:
        assert r["folded"] == r["root"] == m.root
        assert (r["subroot"], r["root"]) == wanted[r["doc_id"], r["digest"]]


@given(st.integers(1, 200), st.data())
@settings(max_examples=60, deadline=None)
def test_missing_nodes_are_enough_and_no_more(n, data):
    present = np.array(sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1))))
    levels = plain_tree([sha(str(k)) for k in range(n)])
    found = {(level, i) for level, at in merkle.missing(present, n) for i in at.tolist()}
    known = {(0, i): levels[0][i] for i in present.tolist()} | {(k, i): levels[k][i] for k, i in found}
    root, steps = merkle.derived(dict(known), present, n)
    assert root == levels[-1][0]
    assert steps == [[("".join(a), "".join(b)) for a, b in plain_path(levels, i)] for i in present.tolist()]
    below = {(k, i // 3**k) for i in present.tolist() for k in range(len(levels))}
    assert not found & below  # nothing that the leaves derive themselves
    for left_out in found:
        with pytest.raises(KeyError):
            merkle.derived({k: v for k, v in known.items() if k != left_out}, present, n)


def test_manifest_equals_sql(spark, sf_dir, tmp_path):
    got = sorted(tuple(r) for r in merkle.op12_merkle_manifest(spark, sf_dir).collect())
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        assert sorted(connection.execute(merkle.SQL["op12_merkle_manifest"]).fetchall()) == got


# Harmonic packing -------------------------------------------------------------------------------------------------


def check_packed(rows, wanted, capacity):
    """Every id in one piece; sequences gapless and within the capacity. The share of padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        documents[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    texts = defaultdict(list)
    for doc_id, ids in wanted:
        texts[doc_id, len(ids)].append(ids)
    assert set(documents) == set(texts)
    for key, pieces in documents.items():
        copies = len(texts[key])
        by_start = defaultdict(list)
        for p in pieces:
            by_start[p["start"]].append(p)
        if copies == 1:
            flat, at = [], 0
            for start in sorted(by_start):
                assert start == at and len(by_start[start]) == 1
                flat += np.frombuffer(by_start[start][0]["ids"], "<u4").tolist()
                at += by_start[start][0]["length"]
            assert flat == texts[key][0]
        else:
            assert sum(p["length"] for p in pieces) == copies * key[1]
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(total, 1)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_harmonic_packing(docs, capacity):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    wanted = [
        (r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()
    ]
    assert check_packed(harmonic.pack(docs, path, capacity=capacity).collect(), wanted, capacity) <= 0.02
    assert harmonic.pack(docs.where("false"), path).count() == 0


def test_harmonic_padding_over_documents(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = base.table(spark, sf_dir, "documents").repartition(4)
    wanted = [
        (r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()
    ]
    assert check_packed(harmonic.pack(docs, path).collect(), wanted, 2048) <= 0.005


@pytest.mark.parametrize("capacity", [2, 3, 64, 1000, 2048])
@pytest.mark.parametrize("slack", [0, 1 / 64, 0.5])
def test_classes_are_nearly_full(capacity, slack):
    cut = harmonic.lengths(capacity, slack)
    assert len(cut) == capacity and all(sum(x) == rest for rest, x in enumerate(cut))
    assert all(capacity - capacity // s * s <= slack * capacity for x in cut for s in x)
    assert all(list(x) == sorted(x, reverse=True) for x in cut)


@given(st.lists(st.integers(1, 64), max_size=60))
def test_last_sequences_hold_everything(sizes):
    left = [(k, 5, n, bytes(range(k, k + 1)) * 4 * n, n + 9) for k, n in enumerate(sizes)]
    made = harmonic.laid_out(left, 64)
    lengths = [sum(p[2] for p in s) for s in made]
    assert all(n == 64 for n in lengths[: sum(sizes) // 64]) and sum(lengths) == sum(sizes)
    assert all(n & (n - 1) == 0 for n in lengths)
    assert b"".join(p[3] for p in itertools.chain(*made)) == b"".join(p[3] for p in left)


def test_query_digests(spark, sf_dir):
    rows = harmonic.op13_harmonic_packing(spark, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in base.table(spark, sf_dir, "documents").collect()}
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    assert os.path.exists(sf_dir) and set(ids) == {r["doc_id"] for r in rows}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


# Resampling and the pipeline's stages ------------------------------------------------------------------------------


def test_resampling_weights_tell_good_from_raw_on_texts_held_out(spark):
    """Half of the good texts are labelled; the others' weights a gram are above those of nearly all raw texts."""
    r = np.random.default_rng(13)
    good, raw = ([f"{k}{n}" for n in range(300)] for k in ("lorem", "ipsum"))
    text = lambda share: " ".join(r.choice(good if r.random() < share else raw) for _ in range(120))
    rows = [(i, text(0.7 if i % 3 == 0 else 0.3)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 600, 6)], "doc_id bigint, quality int")
    weights = {
        x["doc_id"]: x["log_weight"] / x["n_grams"] for x in resampling.resampled(docs, labels, keep=0.3).collect()
    }
    held_out = [i for i in range(600) if i % 6]
    wanted = np.array([i % 3 == 0 for i in held_out])
    order = np.argsort(np.argsort([weights[i] for i in held_out]))
    n, m = int(wanted.sum()), int((~wanted).sum())
    assert (order[wanted].sum() - n * (n - 1) / 2) / (n * m) > 0.9


def test_resampling_noise_is_gumbel(spark):
    """The noise of many ids follows the Gumbel distribution, and differs with the seed."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    noise = [
        np.array(
            [x["gumbel_key"] for x in resampling.weighted(docs, np.zeros(8), seed).orderBy("doc_id").collect()]
        ) / resampling.SCALE
        for seed in (1, 2)
    ]
    for x in noise:
        expected = np.exp(-np.exp(-np.sort(x)))
        # Kolmogorov's bound at 1 %
        assert np.abs(expected - (np.arange(4000) + 0.5) / 4000).max() < 1.63 / np.sqrt(4000)
    assert abs(np.corrcoef(noise)[0, 1]) < 0.06


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_take_odd_and_empty_tables(spark, docs, tmp_path, rows):
    """Nulls in every column, copies, equal ids and clashing names; each stage on all of them, not on what others
    left."""
    own = docs.where("false") if rows == "none" else docs
    bench = spark.createDataFrame([(1, None), (None, "")] if rows == "odd" else [], "item_id bigint, text string")
    labels = spark.createDataFrame(
        [(None, None, None), (1, 1, None)] if rows == "odd" else [], "doc_id bigint, quality int, toxic int"
    )
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda x: tuple((v is not None, v) for v in x)
    before = sorted(map(tuple, own.collect()), key=key)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, own, str(tmp_path))
        assert made.columns == own.columns, name
        after = sorted(map(tuple, made.collect()), key=key)
        at = own.columns.index("text")
        if name == "quality":
            assert all(x in before and len((x[at] or "").split()) >= 20 for x in after)
        elif name == "near_duplicates":
            assert all(x in before for x in after) and {x[0] for x in after} <= {x[0] for x in before}
            assert sum(x[0] is None for x in after) == sum(x[0] is None for x in before)
        elif name == "decontaminate":
            assert after == before
        else:
            same = lambda x: (
                *x[:at], *x[at + 1 : own.columns.index("n_chars")], *x[own.columns.index("n_chars") + 1 :]
            )
            assert sorted(map(same, after), key=key) == sorted(map(same, before), key=key)
    packed = corpus_pipeline.pack(spark, own, str(tmp_path)).collect()
    assert len({(p["doc_id"], p["piece"]) for p in packed}) <= len(packed) and (rows == "none") == (not packed)
