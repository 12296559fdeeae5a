"""Archives with flipped, cut and doubled bytes, lengths that are no numbers, and lookups of large ids beside null."""

import random

import public_tokenizers
import pytest

from tidemark.llm import sstable, warc


@pytest.mark.parametrize("size", ["²", "5" * 5_000, "-1", "", "9" * 19, "1_0", "٣"])
def test_no_length(size):
    """A length that is no number of 18 digits is damage; the record behind it is found."""
    good = warc.encode_record("urn:b", "http://b", b"good")
    for bad in (f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {size}\r\n\r\nx\r\n\r\n\r\n".encode(), warc.encode_record("urn:a", "http://a", b"x").replace(b"Length: 1\r", f"Length: {size}\r".encode())):
        for data in (bad + good, warc.gzip_member(bad) + warc.gzip_member(good)):
            kinds = list(warc.salvage(data))
            assert [x["record_id"] for k, _, x in kinds if k == "record"][-1] == "urn:b" and any(k == "gap" for k, *_ in kinds)


def test_salvage_of_random_damage():
    """Whatever is flipped, cut out or put in: no exception, and every record whose bytes are whole is found."""
    rnd = random.Random(11)
    records = [warc.encode_record(f"urn:{k}", f"http://h/{k}", rnd.randbytes(rnd.randint(0, 300)), None if k % 3 else "urn:x") for k in range(6)]
    for packed in (False, True):
        parts = [warc.gzip_member(r) for r in records] if packed else records
        for _ in range(400):
            hurt = rnd.randrange(len(parts))
            p = bytearray(parts[hurt])
            at = rnd.randrange(len(p))
            match rnd.randrange(3):
                case 0:
                    p[at] ^= 1 << rnd.randrange(8)
                case 1:
                    del p[at : at + rnd.randint(1, 40)]
                case 2:
                    p[at:at] = rnd.randbytes(rnd.randint(1, 40))
            got = list(warc.salvage(b"".join([*parts[:hurt], bytes(p), *parts[hurt + 1 :]])))
            found = {x["record_id"] for k, _, x in got if k == "record"}
            # a damaged length can swallow what stands right behind it, but no more
            assert {f"urn:{k}" for k in range(6) if k not in (hurt, hurt + 1)} <= found


def test_lookup_of_large_ids_beside_null(spark, tmp_path):
    """Ids above 2**53 stay whole when a null id is wanted too."""
    rows = [(2**53 + 1, "a"), (2**53, "b"), (-(2**63), "c"), (2**63 - 1, "d"), (None, "e")]
    shards = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), public_tokenizers.path("word_bpe_49k.json"))
    wanted = spark.createDataFrame([(d,) for d, _ in rows if d != 2**53], "doc_id long")
    assert {r["doc_id"] for r in sstable.lookup(spark, str(tmp_path / "s"), shards, wanted).collect()} == {d for d, _ in rows if d != 2**53}


def test_sstable_words_kept_over_chunks(monkeypatch):
    # the kept words change places between two chunks of one call
    file = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{i % 7}{chr(97 + k % 26)}{k}" for k in range(i, i + 12)) for i in range(60)]
    want = [*sstable.encode_texts(texts, file, "<u2")]
    monkeypatch.setattr(sstable, "CACHE", 20)
    monkeypatch.setattr(sstable, "CHUNK", 100)
    monkeypatch.setattr(sstable, "_caches", {})
    assert [*sstable.encode_texts(texts, file, "<u2")] == want
