"""Near duplicates against brute force."""

import random

import numpy as np
import pytest

from ledgerlens.llm import neardup, shingles
from ledgerlens.llm.common import text_words
from ledgerlens.llm.components import components

SMALL = "/root/testdata/sf0.001"


def plain_sets(texts):
    out = []
    for text in texts:
        w = text_words(text)
        if not w:
            out.append(set())
        elif len(w) < 5:
            out.append({tuple(w)})
        else:
            out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def brute(rows, percent=75):
    """(doc_id, n, component, kept) by comparing every pair."""
    sets = plain_sets([t for _, t in rows])
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[top(i)] = top(j)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        low = min(ids) if ids and sets[i] else doc_id
        found.append((doc_id, len(sets[i]), low, doc_id == low))
    return sorted(found, key=repr)


def got(df):
    return sorted(
        (tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()),
        key=repr,
    )


def corpus(seed=3):
    """Chains and stars of edited copies, so that some links are near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        rows.append(base)
        for _ in range(rng.choice([0, 2, 14])):
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    texts = [" ".join(r) for r in rows]
    texts += [None, "", "  \t\n", "one two", "One  TWO", texts[1], texts[1].upper()]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * i + 7, texts[k]) for i, k in enumerate(order)]


def test_agrees_with_brute_force(documents):
    rows = corpus()
    assert got(neardup.near_duplicates(documents(rows))) == brute(rows)


def test_repeated_rows_and_missing_ids(documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (3, text), (None, text), (None, "x y"), (9, "x y z"), (9, None)]
    found = got(neardup.near_duplicates(documents(rows)))
    assert found.count((5, 26, 3, False)) == 2
    assert (3, 26, 3, True) in found
    assert (None, 26, 3, False) in found
    assert (None, 1, None, True) in found
    assert (9, 0, 9, True) in found


def test_stage_keeps_one_of_each_group(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (3, text), (3, text), (8, text + " end"), (1, None), (2, ""), (4, "a b c")]
    kept = neardup.one_of_each(spark, documents(rows), SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clashing_columns_and_empty_table(spark, documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f")])
    for name in ("kept", "n_shingles", "key", "node", "text_key", "root_class"):
        docs = docs.withColumn(name, docs["lang"])
    assert [r["kept"] for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [True, False]
    assert neardup.one_of_each(spark, docs, SMALL).count() == 1
    assert neardup.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.75, 0.9])
@pytest.mark.parametrize("n", [40, 3000])
def test_estimates_are_close(share, n):
    rng = np.random.default_rng(n)
    both = rng.integers(0, 1 << 63, int(n * share), np.uint64)
    own = [rng.integers(0, 1 << 63, (n - len(both)) // 2, np.uint64) for _ in range(2)]
    a, b = (np.unique(np.concatenate([both, o])) for o in own)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (shingles.sketch(a) == shingles.sketch(b)).sum()
    assert abs(shingles.jaccard_estimate(same, np.int64(len(a)), np.int64(len(b))) - true) < 0.15
    fine = (shingles.fine_sketch(a) == shingles.fine_sketch(b)).sum()
    assert abs(shingles.fine_estimate(fine) - true) < 0.07


def test_collisions_of_unrelated_sets_are_corrected():
    rng = np.random.default_rng(1)
    total = 0.0
    for _ in range(200):
        a, b = (rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(2))
        same = (shingles.sketch(a) == shingles.sketch(b)).sum()
        total += shingles.jaccard_estimate(same, np.int64(300), np.int64(300))
    assert abs(total / 200) < 2e-4


def test_whole_text_counts():
    long = " ".join(str(i) for i in range(60_000))
    assert len(shingles.shingle_set(long)) == 59_996
    assert len(shingles.shingle_set("a b c d e a b c d e")) == 5


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    found = components(spark.createDataFrame(path + hub, "a long, b long"))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert {roots[i] for i in range(61)} == {0}
    assert {roots[1000 + i] for i in range(50)} == {1000}
