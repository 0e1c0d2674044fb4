"""Merkle manifest, piece encoding and vector codes on tables with every kind of odd row, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quadrille.llm import codes, merkle, pieces, queries

from .conftest import CLASH

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- Merkle manifest -----------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root and the proof of each node: [(before, after), ...]."""
    proofs, at = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run, own = runs[i // 3], i % 3
            proofs[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
        nodes, at = [h(*run) for run in runs], [i // 3 for i in at]
    return nodes[0], proofs


def tampered(row):
    text = row[4]
    if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return (*row[:4], text)


def expected_manifest(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), leaf(tampered(row)), row[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found = [tree([x[2] for x in sorted(by[s])]) for s in sources]
    root, above = tree([sub for sub, _ in found])
    out = []
    for s, (sub, proofs), up in zip(sources, found, above):
        for x, proof in zip(sorted(by[s]), proofs):
            acc = x[3]
            for before, after in proof + up:
                acc = h(before, acc, after)
            out.append((x[4], x[2], sub, root, h(*[b + a for b, a in proof + up]), acc, acc == root))
    return sorted(out, key=repr)


def as_query(docs):
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = merkle.manifest(docs, shown={"text": shown}).withColumn("folded", merkle.fold(F.col("shown"), F.col("proof")))
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded", F.col("folded") == F.col("root"))


def test_manifest_against_plain_trees(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in as_query(documents).collect()), key=repr)
    assert got == expected_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (3,), (4,), (10, 1), (28, 27, 2, 1)])
def test_manifest_of_small_trees(spark, sizes):
    rows = [(100 * s + i, [None, "b", "ä", "z"][s], "en", 1, f"t{i}\n") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in as_query(docs).collect()), key=repr) == expected_manifest(rows)


def test_manifest_by_shuffled_tables(documents, monkeypatch):
    few = {tuple(r) for r in as_query(documents).collect()}
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in as_query(documents).collect()} == few


def test_manifest_of_nothing(nothing):
    assert as_query(nothing).collect() == []


def test_manifest_spreads_one_source(spark):
    """No task gets all rows of the one source that all rows have."""
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("one").alias("s"))
    placed = merkle.place(rows.repartition(8), [F.col("s"), F.col("k")], ["s"])
    assert [r["idx"] == r["k"] for r in placed.collect()].count(False) == 0


# --- pieces --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(library, seed):
    rng = random.Random(seed)
    alphabet = "abcdthe ▁\n\té日\U0001f642the inonguioxs\x00"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    out += [f"a{' ' * k}{end}" for k in range(1, 60) for end in ("b", "", "\n")]
    names = [library.id_to_piece(rng.randrange(259, 32000)) for _ in range(2000)]
    out += ["".join(rng.choices(names, k=5)) for _ in range(2000)] + [n * k for n in names[:600] for k in (2, 3)]
    return out + ["thethe" * 200, "x" * 3001 + " " + "ab" * 2000, "</s>[INST]<unk><0x0A>", "", " ", "▁"]


def test_ids_as_the_library_gives_them(library):
    texts = odd_texts(library, 3)
    vocabulary = pieces.loaded(MODEL)
    encoder = pieces.Encoder(vocabulary)
    for i in range(0, len(texts), 700):
        part = texts[i : i + 700]
        ids, counts = encoder(part)
        expected = library.encode(part)
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == expected[0]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected
        assert vocabulary.decode(ids, counts) == [library.decode(x) for x in expected]


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(4)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000), 259, 28705]) for _ in range(rng.randrange(7))] for _ in range(5000)]
    flat = np.array([i for x in lists for i in x], np.int64)
    assert pieces.loaded(MODEL).decode(flat, np.array([len(x) for x in lists])) == [library.decode(x) for x in lists]


def test_encode_and_decode_tables(documents, texts, library, nothing):
    both = pieces.encode(documents, MODEL, decoded="said")
    got = Counter((r["doc_id"], tuple(r["ids"]), r["said"]) for r in both.collect())
    assert got == Counter((i, tuple(ids), library.decode(ids)) for (i, _), ids in zip(texts, library.encode([t or "" for _, t in texts])))
    again = pieces.decode(pieces.encode(documents, MODEL).withColumn("key", F.lit("clash")), MODEL)
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == Counter((i, t or "") for i, t in texts)
    assert pieces.encode(nothing, MODEL, decoded="said").collect() == [] and pieces.encode(nothing, MODEL).columns == ["doc_id", "ids"]


def test_chunks_and_a_forgetful_task_change_nothing(documents, monkeypatch):
    whole = {tuple(map(str, r)) for r in pieces.encode(documents, MODEL, decoded="said").collect()}
    assert [s.stop - s.start for s in pieces._chunks([3, 3_000_000, 0, 5, 1])] == [1, 1, 3]
    assert [*pieces._chunks([])] == []
    encoder = pieces.Encoder(pieces.loaded(MODEL))
    first = encoder(["one two"])
    monkeypatch.setattr(pieces, "HELD", 0)
    assert encoder(["one two"])[0].tolist() == first[0].tolist()
    assert len(whole) > 50


# --- vector codes --------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for key, v, label in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and len(v) % parts == 0:
            kept.append((key, [max(-codes.MOST, min(codes.MOST, int(np.floor(np.float64(x) * 4096)))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for c in cut:
                of[near(p, c[p])[1]].append(c[p])
            new.append([[sum(x) // len(of[i]) for x in zip(*of[i])] if of[i] else e for i, e in enumerate(books[p])])
        books = new
    out = []
    for (key, _, label), c in zip(kept, cut):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((key, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    return sorted([(k, c, e, total[g]) for k, c, e, g in out], key=repr), books


def vectors(spark, seed=7, n=400, dims=16):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centre)], rng.choice([None, 1, 1, 1, 2, 3])) for i in range(5, n)]
    bad = [(0, None, 1), (1, [], 1), (2, [None] * dims, 1), (3, [float("nan")] + [0.0] * (dims - 1), 2), (4, [float("-inf")] + [0.0] * (dims - 1), 2), (600, [0.5] * (dims + 8), 1), (601, [0.5] * 3, 1)]
    odd = [rows[3], rows[3], (None, rows[5][1], None), (700, rows[9][1], 2), (701, [1e30] + [0.0] * (dims - 1), 9), (702, [-0.0] * dims, 9)]
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for k, v, g in rows + bad + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return rows, df.select("*", *[F.lit(c).alias(c) for c in (*CLASH, "row", "code", "ints", "entry", "error")])


@pytest.mark.parametrize("seed", [7, 8])
def test_codes_against_plain_rounds(spark, seed):
    rows, df = vectors(spark, seed)
    coded, books = codes.compress(df)
    got = codes.with_label_error(coded)
    expected, plain = plain_codes(rows)
    assert books == plain
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error").collect()), key=repr) == expected


def test_codes_of_few_and_no_vectors(spark):
    rows, df = vectors(spark)
    coded, books = codes.compress(df.filter("vec_id BETWEEN 5 AND 8"))
    expected, plain = plain_codes([r for r in rows if r[0] in range(5, 9)])
    assert books == plain and len(books[0]) == len(expected) > 3
    assert sorted(r["code"] for r in coded.collect()) == sorted(r[1] for r in expected)
    none, books = codes.compress(df.filter("vec_id < 5"))
    assert codes.with_label_error(none).collect() == [] and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()


def test_rounds_shuffle_no_vectors(spark):
    """Vectors meet their previous codes without an exchange."""
    _, df = vectors(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, table, path = codes._buckets(codes.integers(df, "vec_id", "embedding", "label", 8, 4096).repartition(n, "row"), n, "vectors")
    new, *_ = codes._buckets(store.filter("size(ints) = 16").mapInArrow(codes._move(np.zeros((8, 2, 2), np.int64), 16), codes._ADDED), n, "codes")
    both = store.filter("size(ints) = 16").join(new.filter("part IS NULL").select("row", "code").hint("shuffle_hash"), "row")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    codes._remove(spark, table, path)
    assert not spark.catalog.tableExists(table)


def test_exact_and_large_distances_agree():
    rng = np.random.default_rng(1)
    x, books = rng.integers(-4096, 4096, (500, 16)), rng.integers(-4096, 4096, (4, 9, 4))
    small = codes.nearest(x, books)
    large = codes.nearest(x << 12, books << 12)
    assert (small[0] == large[0]).all() and (small[1] << 24 == large[1]).all()


def test_registered():
    assert {"op11_merkle_manifest", "op12_piece_round_trip", "op13_vector_codes"} <= set(queries.queries())
    assert {"op11_merkle_manifest", "op13_vector_codes"} <= set(queries.oracle_sql())
