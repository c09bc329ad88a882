import random

import pytest

from ledgerlens.llm import tokencount
from ledgerlens.llm.tokens import vocabulary

MODEL = "piece_bpe_32k.model"
ODD = [
    None, "", " ", "  ", "a  b", "a\nb", "\n", "\n\n", " \n ", "a \n b", "a\n ", "▁", "▁▁a", "a▁b",
    "<s> x </s>", "<0x0A>", "<unk>", " " * 15, " " * 17, " " * 31 + "t", " " * 1000, " " * 47 + "\n",
    "a\x00b", "\t\t a", "x" * 5000, "ab" * 3000, "日本語テスト", "  日本", " " * 100 + "zq", "é" * 301,
    "🙂🙂 é", "aaa aaaa aaaaa", "1234  5678", "   x", "\r\n x\r\n",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))
    return lambda texts: [len(ids) for ids in own.encode([t or "" for t in texts])]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(vocabulary(MODEL))


def raw(texts):
    return [(t or "").encode() for t in texts]


def test_counts_are_those_of_the_library(library, counter):
    pick = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", ".", "é", "12", "'s", "▁", "\t", "word", "日", "ing", "ION", "   "]
    mixed = ["".join(pick.choices(parts, k=pick.randint(1, 40))) for _ in range(4000)]
    mixed += ["".join(pick.choices("abcdefghijklmnop ", k=pick.randint(1, 60))) for _ in range(4000)]
    mixed += ["".join(pick.choices("etaoinshrdlu", k=20_000))]
    assert counter.merger.together
    assert counter.count(raw(ODD + mixed)) == library(ODD + mixed)


def test_one_pair_at_a_time_gives_the_same(counter):
    slow = tokencount.Counter(vocabulary(MODEL))
    slow.merger.together = False
    pick = random.Random(2)
    texts = ["".join(pick.choices("aabcdeinst  \n", k=80)) for _ in range(500)]
    assert slow.count(raw(texts)) == counter.count(raw(texts))


def test_long_texts_in_parts_and_a_small_memory(library, monkeypatch):
    monkeypatch.setattr(tokencount, "AT_ONCE", 50)
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 20)
    own = tokencount.Counter(vocabulary(MODEL))
    texts = ODD + ["some words, and more   of them\n" * 30, "a" + " " * 130 + "b", "z " * 200]
    assert own.count(raw(texts)) == library(texts)
    assert len(own.known) < 100


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(vocabulary(MODEL), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    other = tmp_path / "other.model"
    other.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        tokencount.Merger(str(other))


def test_rows_of_any_kind(spark, documents, library):
    texts = ["one text", None, "", "one text", "limit " * 3]
    docs = documents([(1, texts[0]), (2, None), (3, ""), (1, texts[3]), (None, texts[4])])
    docs = docs.withColumn("n_tokens", docs["lang"]).withColumn("n_bytes", docs["lang"])
    found = tokencount.token_counts(docs, vocabulary(MODEL), limit=4).collect()
    assert [r.n_tokens for r in found] == library(texts)
    assert [r.n_bytes for r in found] == [len(t or "") for t in texts]
    assert [r.over_limit for r in found] == [n > 4 for n in library(texts)]
    assert [r.doc_id for r in found] == [1, 2, 3, 1, None]
    assert tokencount.token_counts(documents([]), vocabulary(MODEL)).count() == 0


def test_query_over_whole_table(spark, library):
    from ledgerlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES["op12_token_counts"](spark, folder).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas().sort_values("doc_id")
    assert found["n_tokens"].tolist() == library(docs["text"])
    assert found["n_bytes"].tolist() == [len(t.encode()) for t in docs["text"]]
