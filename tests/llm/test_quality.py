import zlib

import numpy as np

from ledgerlens.llm import quality

GOOD = "the wind over the hills was calm and then it turned to rain by noon "
BAD = "BUY!! NOW!! CHEAP!! "


def corpus(n=120):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        words = (GOOD if i % 2 else BAD).split()
        text = " ".join(rng.choice(words, rng.integers(3, 400)))
        rows.append((i, text))
        labels.append((i, i % 2, 0))
    return rows, labels


def test_learns_and_leaves_held_out_rows_alone(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = quality.train(docs, known)
    found = quality.score(docs, net).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 10
    assert all((r["quality_score"] >= 0.3) == bool(r["doc_id"] % 2) for r in held)
    # Labels of held-out rows change nothing.
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = quality.train(docs, spark.createDataFrame(flip, known.schema))
    assert np.array_equal(again.filters, net.filters)


def test_batches_and_chunks_agree_with_one_by_one():
    net = quality.Network.fresh(3)
    texts = [b"", b"x", b"ab" * 3000, bytes(range(256)) * 40, b"y" * 512, b"z" * 513]
    one = [quality.scores(net, [t])[0] for t in texts]
    assert np.allclose(quality.scores(net, texts), one, atol=1e-6)
    raw = bytes(np.random.default_rng(0).integers(1, 256, 5000, np.uint8))
    rows = quality.chunks(raw)
    at = np.concatenate([np.arange(quality.CHUNK) + i * quality.STEP for i in range(len(rows))])
    assert set(range(len(raw))) <= set(at.tolist())
    assert all(rows.reshape(-1)[k] == raw[p] for k, p in enumerate(at) if p < len(raw))


def test_pooling_matches_a_plain_convolution():
    net = quality.Network.fresh(1)
    row = np.random.default_rng(2).integers(0, 256, (1, quality.CHUNK)).astype(np.uint8)
    plain = np.full(quality.FILTERS, -np.inf)
    for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
        window = net.embed[row[0, at : at + quality.WIDTH]].reshape(-1)
        plain = np.maximum(plain, window @ net.filters)
    assert np.allclose(net.pooled(row)[0], np.maximum(plain, 0), atol=1e-4)


def plain_score(net, text):
    """Score of one document, window by window."""
    best = []
    for row in quality.chunks(text):
        spots = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
        windows = np.array([net.embed[row[at : at + quality.WIDTH]].reshape(-1) for at in spots])
        best.append(np.maximum((windows @ net.filters).max(axis=0) + net.shift, 0))
    features = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)])
    return 1 / (1 + np.exp(-(features @ net.out + net.bias)))


def test_scores_and_gradients_match_plain_ones(monkeypatch):
    net = quality.Network.fresh(4)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (5, 600, 9000)]
    assert np.allclose(quality.scores(net, texts), [plain_score(net, t) for t in texts], atol=1e-5)
    # The gradient of all strongest responses together, by small steps of single weights.
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    for name in ("embed", "filters", "shift", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rows = quality.chunks(texts[2])
    pooled, best = net.strongest(rows)
    d_filters, d_embed = net.back(rows, best, (pooled > 0).astype(np.float32))
    spots = (np.arange(len(rows))[:, None, None], (best * quality.STRIDE)[:, :, None] + np.arange(quality.WIDTH))
    def total():
        picked = net.embed[rows[spots]].reshape(len(rows), quality.FILTERS, -1)
        return (np.einsum("cfk,kf->cf", picked, net.filters) * (pooled > 0)).sum()
    for array, found in ((net.filters, d_filters), (net.embed, d_embed)):
        for at in [(3, 5), (20, 7), (60, 2)]:
            before = total()
            array[at] += 1e-4
            assert np.isclose((total() - before) / 1e-4, found[at], rtol=1e-3, atol=1e-3)
            array[at] -= 1e-4


def test_learns_from_the_whole_of_long_texts(spark, documents):
    """What tells the classes apart is a few words in one of some 60 chunks."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(160):
        words = rng.choice(GOOD.split(), 5000).tolist()
        if i % 2 == 0:
            at = int(rng.integers(0, 5000))
            words[at : at + 8] = ["BUY!!"] * 8
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2, 0))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = quality.train(documents(rows), known)
    found = quality.score(documents(rows), net).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((r["quality_score"] >= 0.5) == bool(r["doc_id"] % 2) for r in held)
    assert right / len(held) > 0.9


def test_nulls_empty_tables_and_clashing_columns(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, None), (2, ""), (None, "x"), (2, "")])
    docs = docs.withColumn("quality_score", docs["lang"]).withColumn("score", docs["lang"])
    found = quality.score(docs, quality.train(docs, none)).collect()
    assert [r["quality_score"] for r in found] == [0.5] * 4
    some = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0)], none.schema)
    assert quality.score(documents([]), quality.train(docs, some)).count() == 0
    one = spark.createDataFrame([(2, 1, 0), (2, 1, 0)], none.schema)
    assert quality.score(docs, quality.train(docs, one)).first()["quality_score"] > 0.9


def test_accuracy_on_held_out_rows_of_the_test_tables(spark):
    """Held-out labels of a small table are told apart nearly always."""
    found = quality.op10_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.9
