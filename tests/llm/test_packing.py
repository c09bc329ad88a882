import zlib

import numpy as np
import pytest

from ledgerlens.llm import packing, tokens


def plain_ids(texts, name="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary(name))
    own.encode_special_tokens = True
    return [own.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_every_id_is_in_one_piece(documents):
    texts = [None, "", "a", "Some words, and more. " * 40, "long text 12 " * 9000, "a", "x, y"]
    rows = list(enumerate(texts)) + [(None, "no id")]
    docs = documents(rows)
    docs = docs.withColumn("piece", docs["lang"]).withColumn("shard", docs["lang"])
    found = packing.pack(docs, tokens.vocabulary("word_bpe_49k.json")).toPandas()
    whole = dict(zip([r[0] for r in rows], plain_ids([r[1] for r in rows])))
    assert (found["doc_id"].isna()).sum() == 1
    for doc_id, pieces in found.dropna(subset="doc_id").groupby("doc_id"):
        at = 0
        for p in pieces.sort_values("start").itertuples():
            part = np.array(whole[doc_id][p.start : p.start + p.length], "<u4")
            assert p.start == at and p.doc_tokens == len(whole[doc_id])
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(whole[doc_id])
    for _, pieces in found.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert list(pieces["offset"]) == list(pieces["length"].cumsum() - pieces["length"])
        fill = pieces["length"].sum()
        assert fill <= 4096 and set(pieces["padded_length"]) == {fill if fill & (fill - 1) == 0 else 4096}


def test_assignment_is_balanced_and_tight():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.lognormal(6, 1, 5000).astype(int).clip(1, 4096))[::-1]
    sequence, offset = packing.assign(lengths)
    fill = np.bincount(sequence, lengths)
    assert fill.max() <= 4096 and fill.sum() / (len(fill) * 4096) > 0.99
    # Each piece went to a sequence that was cheapest among those with room.
    cost, left = np.zeros(len(fill)), np.full(len(fill), 4096)
    opened = -(-lengths.sum() // 4096)
    for n, s, o in zip(lengths, sequence, offset, strict=True):
        assert o == 4096 - left[s]
        fits = np.flatnonzero(left[:opened] >= n)
        if len(fits):
            assert cost[s] <= cost[fits].min() + 1e-6
        left[s] -= n
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
        opened = max(opened, s + 1)


def test_empty_table(documents):
    assert packing.pack(documents([]), tokens.vocabulary("word_bpe_49k.json")).count() == 0


ODD = [
    "  a b", "a  b ", "a   b", "x\n\ny", "x \n y", "a\t b,c. d", "..., a", "it's. 'sé é ²½ ٣٤",
    "1,000.5 A_B_, c", "", "\n", " ", "a\n", "Σίσυφος ΣΑΣ. İ", "a b　 c", "<|endoftext|> a",
    "a.'s b,'t 're", "a .b ,c", "\x1c!\x1d! a", "é. ́, á.b", "a\n \n \nb", ",.,. a.b.c,d",
    "a​.b", "日本語。テスト, ok. 中文", "x" * 5000 + ". " + "y" * 70, "\r\n a\r\n\r\n b", "_., -. ). b",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cut_texts_encode_like_whole_ones(name):
    rng = np.random.default_rng(6)
    parts = ["a", "The", " ", "  ", "\n", ".", ",", "!", "é", "12", "'s", "_", "\t", " ", "word", "Ω"]
    mixed = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000)]
    found = [i.tolist() for i in tokens.encode_all(tokens.vocabulary(name), ODD + mixed, 2)]
    assert found == plain_ids(ODD + mixed, name)


def test_a_small_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90 * (k + 1), 60)) for k in range(40)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = tokens.Encoder(tokens.vocabulary(name))
        found = []
        for at in range(0, 40, 2):
            ids, lengths = own.encode_flat(texts[at : at + 2], 2)
            found += [i.tolist() for i in np.split(ids, np.cumsum(lengths)[:-1])]
        assert found == plain_ids(texts, name)
        assert len(own.slot) < 400


def test_units_that_hold_the_mark_itself():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = tokens.encoder(tokens.vocabulary(name))
        texts = [f"a {own.between.strip()} b {own.between}", own.between.strip() + "s x"]
        found = [i.tolist() for i in tokens.encode_all(tokens.vocabulary(name), texts, 2)]
        assert found == plain_ids(texts, name)
