"""Archives and id files: round trips, damage, and ZIP64."""

import gzip
import hashlib
import io
import os
import zipfile
import zlib

import numpy as np
import pytest

from ledgerlens.llm import idfiles, rans, tokens, warc, zipread
from tests.llm.test_packing import plain_ids


def reader(raw):
    return lambda offset, length: raw[offset : offset + length]


def test_zip64_directories_are_read(monkeypatch):
    for limit in (zipfile.ZIP64_LIMIT, 10):
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            z.writestr("ü.txt", "hello " * 50)
            z.writestr("deep/b", b"PK\x05\x06" * 9)
            z.writestr("zipped", "x" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = b"PK\x05\x06 a comment with the mark"
        data = raw.getvalue()
        assert (b"PK\x06\x06" in data) == (limit == 10)
        found = {m.name: m for m in zipread.members(reader(data), len(data))}
        for name, plain in (("ü.txt", b"hello " * 50), ("deep/b", b"PK\x05\x06" * 9)):
            at = zipread.data_offset(reader(data), found[name])
            assert data[at : at + found[name].size] == plain
            assert found[name].crc == zlib.crc32(plain)
        with pytest.raises(zipread.BadArchive):
            zipread.data_offset(reader(data), found["zipped"])
        for cut in (0, 10, 200, len(data) - 5):
            with pytest.raises(zipread.BadArchive):
                zipread.members(reader(data[:cut]), cut)


def test_member_beyond_four_gigabytes():
    """Sizes and offsets that need 64 bits, in a file of which only the directory exists."""
    big, start = 5 << 30, 6 << 30
    extra = b"\x01\x00\x18\x00" + b"".join(n.to_bytes(8, "little") for n in (big, big, start))
    central = (
        b"PK\x01\x02" + bytes(12) + bytes(4) + b"\xff" * 8 + (1).to_bytes(2, "little")
        + len(extra).to_bytes(2, "little") + bytes(2) + bytes(8) + b"\xff" * 4 + b"m" + extra
    )
    place = 12 << 30
    end64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + b"".join(
        n.to_bytes(8, "little") for n in (1, 1, len(central), place)
    )
    tail = (
        end64 + b"PK\x06\x07" + bytes(4) + (place + len(central)).to_bytes(8, "little")
        + (1).to_bytes(4, "little") + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    )
    raw, size = central + tail, place + len(central) + len(tail)

    def read_at(offset, length):
        at = offset - place
        return (bytes(max(0, -at)) + raw[max(0, at) : max(0, at + length)])[:length]

    (member,) = zipread.members(read_at, size)
    assert (member.name, member.size, member.offset) == ("m", big, start)


@pytest.fixture
def folder(tmp_path):
    return tmp_path.as_uri()


def page_rows():
    return [
        (1, "http://a/ b\r\n", "same"), (2, "http://é", "same"), (9, None, "same"), (9, "x", "same"),
        (None, "n", "same"), (None, "only", "lone"), (4, "e", ""), (5, "f", None), (6, "g", "é" * 100_000),
        (7, "h", "WARC/1.1\r\n\r\n"),
    ]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, folder, least, monkeypatch):
    rows = page_rows()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame = frame.withColumn("digest", frame["url"]).withColumn("first", frame["url"])
    found = warc.read(warc.write(frame, folder, least), folder).collect()
    assert len(found) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and top[h or ""] >= 0 and i != top[h or ""]
        want.append(
            (i, len(raw), warc.digest_of(raw), "revisit" if again else "response", top[h or ""] if again else None)
        )
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(want, key=repr)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert payloads[6] == ("é" * 100_000).encode() and payloads[7] == b"WARC/1.1\r\n\r\n"


def test_archives_are_plain_zip_files_and_damage_is_found(spark, folder, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"text {i}") for i in range(50)], "page_id long, url string, html string")
    archives = warc.write(frame, folder)
    name = sorted(os.listdir(tmp_path))[0]
    with zipfile.ZipFile(tmp_path / name) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.RECORDS, warc.INDEX}
        records = gzip.decompress(z.read(warc.RECORDS))
    assert records.count(b"WARC/1.1") >= 1
    payload = f"text {0}".encode()
    assert warc.digest_of(payload) == __import__("base64").b32encode(hashlib.sha1(payload).digest()).decode()
    raw = bytearray((tmp_path / name).read_bytes())
    raw[60:90] = bytes(30)
    (tmp_path / name).write_bytes(raw)
    with pytest.raises(Exception):
        warc.read(archives, folder).count()


def test_no_pages(spark, folder):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(frame, folder), folder).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype("<u4")
    table = rans.Table.of(np.bincount(ids, minlength=50_258))
    raw = rans.encode(ids, table)
    assert (rans.decode(raw, table, table.slots()) == ids).all()
    for at in range(0, len(raw), max(1, len(raw) // 40)):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(rans.BadBlock):
            rans.decode(bytes(bad), table, table.slots())
    with pytest.raises(rans.BadBlock):
        rans.decode(raw[:-1], table, table.slots())


@pytest.mark.parametrize("counts", [[5], [1, 10**12], [1] * 70_000, [10**15] + [1] * 60_000, [0, 0, 3, 0]])
def test_tables_fill_their_range(counts):
    table = rans.Table.of(np.array(counts))
    assert table.frequency.sum() == 1 << rans.BITS
    assert ((table.frequency > 0) == (np.array(counts) > 0)).all()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.2, 200_000) % 20_000).astype("<u4")
    n = np.bincount(ids)
    share = n[n > 0] / n.sum()
    bound = -(n[n > 0] * np.log2(share)).sum() / 8
    assert len(rans.encode(ids, rans.Table.of(n))) < 1.02 * bound + 8 * rans.LANES + 64


def test_id_files_round_trip(spark, documents, folder, monkeypatch):
    monkeypatch.setattr(idfiles, "BLOCK_IDS", 500)
    texts = ["Some text, and more. " * k for k in range(40)] + [None, "", "ü 日本 " * 3000, "twice", "twice"]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "same id"), (7, "same id")]
    path = tokens.vocabulary("byte_bpe_50k.json")
    docs = documents(rows)
    docs = docs.withColumn("ids", docs["lang"]).withColumn("row", docs["lang"])
    files = idfiles.write(docs, folder, path)
    found = idfiles.read(files, folder).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc_id, _), ids, r in zip(order, plain_ids([t for _, t in order], "byte_bpe_50k.json"), found, strict=True):
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(raw))
        assert bytes(r["ids"]) == raw
        at += len(ids)


def test_no_documents(spark, documents, folder):
    path = tokens.vocabulary("byte_bpe_50k.json")
    assert idfiles.read(idfiles.write(documents([]), folder, path), folder).count() == 0
