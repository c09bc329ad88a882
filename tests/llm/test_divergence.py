import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    """The audit by its definition: every source, pair and term in turn."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        sources[lang].add(source)
    out = {}
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(own, kept=kept, v=v):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            values = [
                (-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode())
                for o in names - {s}
            ]
            for rank, (value, item) in enumerate(sorted(values), 1):
                out[lang, s, "pair", rank] = (item.decode(), -value)
            values = [
                (-((p[s][t] - q[t]) ** 2 // q[t]), t.encode())
                for t in kept
                if counts[lang, s][t] and p[s][t] > q[t]
            ]
            for rank, (value, item) in enumerate(sorted(values)[:top], 1):
                out[lang, s, "term", rank] = (item.decode(), -value)
    return out


def found(df):
    got = {}
    for r in df.collect():
        assert (r.lang, r.source, r.part, r["rank"]) not in got
        got[r.lang, r.source, r.part, r["rank"]] = (r["item"], r.value)
    return got


def made_up(n=300, sources=7, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(200)]
    share = 1 / np.arange(1, 201)
    rows = []
    for i in range(n):
        own = rng.permutation(share) if i % 5 == 0 else share
        text = " ".join(rng.choice(words, rng.integers(0, 60), p=own / own.sum()))
        rows.append((i, text.upper() if i % 7 == 0 else text, ["en", "de"][i % 2], f"s{rng.integers(sources)}"))
    return rows


ODD = [
    (1, None, None, None), (2, "a a A b", "xx", "s"), (3, "a-b_c1d", "xx", "t"), (4, "A", "xx", ""),
    (4, "A", "xx", ""), (None, "É é ÉÉ a", "xx", None), (5, "one two", "yy", "s"), (6, "", "yy", "t"),
    (7, "alone alone", "zz", "only"), (8, "alone", "zz", "only"), (9, "alone x", "zz", "only"),
]


@pytest.mark.parametrize("rows", [made_up(), ODD, ODD + made_up(60, 3)])
def test_matches_the_definition(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("term", "n", "p", "tile", "Total"):
        docs = docs.withColumn(name, docs["lang"])
    assert found(divergence.audit(docs)) == plain(rows)
    assert found(divergence.audit(docs, least_docs=1, top=5)) == plain(rows, 1, 5)


def test_tiles_and_blocks_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 30)
    rows = made_up(200, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    cells = divergence.written(divergence.term_counts(docs), "terms")
    groups = divergence.groups_of(docs, cells, tile=2)
    assert groups.agg({"tile": "max"}).head()[0] == 4
    got = {(r.lang, r.source, r["item"]): r.value for r in divergence.pair_values(cells, groups).collect()}
    want = {(k[0], k[1], v[0]): v[1] for k, v in plain(rows).items() if k[2] == "pair"}
    assert got == want


def test_products_hold_the_joint_tables():
    rng = np.random.default_rng(0)
    n = rng.poisson(0.7, (500, 6))
    term, source = np.nonzero(n)
    cells = pd.DataFrame(
        {
            "term": [b"%d" % t for t in term], "source": [f"s{s}" for s in source],
            "n": n[term, source], "total": n.sum(axis=1)[term], "tile": 0,
        }
    )
    cells["p"], cells["p0"] = 10 + cells["n"] * 7, 10
    got = divergence._products(("en", 0, 0, 0), cells).set_index(["source", "item"])["value"]
    cost = lambda p, q: (p - q) ** 2 // q
    for a in range(6):
        for b in set(range(6)) - {a}:
            p, q = 10 + 7 * n[:, a], 10 + 7 * n[:, b]
            both = (n[:, a] > 0) & (n[:, b] > 0)
            want = (cost(p, q) - cost(p, 10) - cost(10, q))[both].sum()
            assert got.get((f"s{a}", f"s{b}"), 0) == want


def test_long_texts_and_flushes(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 16)
    monkeypatch.setattr(divergence, "HELD", 10)
    import pyarrow as pa

    text = ("Some words, and SOME more of them: " * 20).encode()
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a"], "source": ["s", "t"], "text": [text, text * 2]})
    total = Counter()
    for out in divergence._counted(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert total["s", b"some"] == 80 and total["t", b"words"] == 80 and total["t", b"them"] == 80


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
