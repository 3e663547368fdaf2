"""BPE against the tokenizers library; media as an exact round trip."""

import hashlib
import itertools
import json
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillseek.llm import bpe, media
from quillseek.llm.queries import op6_bpe, op8_media, vocabulary

try:
    VOCABULARY = vocabulary("byte_bpe_50k.json")
except ImportError:
    VOCABULARY = ""
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(VOCABULARY)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@needs_vocabulary
def test_the_whole_table_as_the_library(spark, data, raw, library):
    got = {r.doc_id: r for r in op6_bpe(spark, data).collect()}
    assert len(got) == len(raw)
    for i, text, *_ in raw:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert got[i].decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.from_regex(r"[a-zA-Z ,.'\n\t<|>é😀0-9]{0,80}", fullmatch=True))
def test_random_texts_as_the_library(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode([text])[0].tolist() == ids
    assert bpe.decoder(VOCABULARY).decode(ids) == library.decode(ids, skip_special_tokens=False)


@needs_vocabulary
def test_special_long_and_odd_texts(spark, odd, empty, coder, library, monkeypatch):
    texts = ["a<|endoftext|> b", "x" * 3000, "  lead", "trail  ", "a\n\n b", "ab\x00c", "\x1c \x85 x", "don't I'll", " " * 500, "lorem ipsum " * 20_000, None, ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [x.tolist() for x in coder.encode(texts)] == want
    coded = bpe.bpe_encode(odd, VOCABULARY)
    back = bpe.bpe_decode(coded, VOCABULARY)
    assert back.columns == [*odd.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert sorted(map(str, bpe.bpe_round_trip(odd, VOCABULARY).collect())) == sorted(map(str, back.collect()))
    assert bpe.bpe_decode(bpe.bpe_encode(empty, VOCABULARY), VOCABULARY).count() == 0
    clash = bpe.bpe_decode(bpe.bpe_encode(odd.withColumns({"ids": F.lit(1), "DECODED": F.lit(2)}), VOCABULARY), VOCABULARY)
    assert clash.columns == back.columns and clash.where("decoded = coalesce(text, '')").count() == odd.count()
    with pytest.raises(ValueError):
        bpe.decoder(VOCABULARY).decode([50257])


@needs_vocabulary
def test_speculation_is_verified(coder):
    fresh = bpe.Coder(VOCABULARY)
    words = [w.encode() for w in [" international", "unbelievable", " thththth", "inging", " reanthe", "hello", "x" * 300, "ab" * 600]]
    counts, tokens = fresh.exactly(*fresh._buffer(words))
    one_by_one = [fresh.exact(w) for w in words]
    assert counts.tolist() == [*map(len, one_by_one)] and tokens.tolist() == [t for x in one_by_one for t in x]
    assert fresh.learn_all(words) == [fresh.id_of[x].tolist() for x in one_by_one]
    assert 0 < fresh.failed < fresh.proposed == len(words)


#: Letters, numbers, marks, all kinds of white space, endings after an apostrophe, and characters of one to four bytes.
PIECES = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "''", " ", "  ", "\n", "\u3000", "\xa0", "\x1c", "\x85", "\0", "é", "1", "²", "٣", "!", "-", "😀", "中", "文", "\u0301", "’", "ß", "word"]
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=25).map("".join) | st.text(min_size=1, max_size=30))
def test_words_as_the_pattern_cuts_them(text):
    raw = text.encode()
    starts = bpe.word_starts(np.frombuffer(raw + bpe.PAD, np.uint8), len(raw)).tolist()
    assert [raw[i:j].decode() for i, j in itertools.pairwise([*starts, len(raw)])] == PATTERN.findall(text)


@needs_vocabulary
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*PIECES, "<|endoftext|>", "<|endof", "a fairly long sentence of words, "]), max_size=40).map("".join), max_size=6), stretch=st.sampled_from([5, 17, 64]))
def test_stretches_do_not_show(coder, library, texts, stretch):
    whole, bpe.STRETCH = bpe.STRETCH, stretch
    try:
        assert [x.tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        bpe.STRETCH = whole


@needs_vocabulary
def test_long_words_and_bytes_that_are_no_text(coder, library):
    rng = random.Random(4)
    for n in (31, 32, 33, 255, 256, 257, 1023, 1025, 30_000):
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert coder.encode([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids
    raw = pa.array([b"ok", b"\xff\xc3(", None, b"\xf0\x9f"], pa.binary())
    column = pa.Array.from_buffers(pa.string(), 4, raw.buffers())
    back = bpe.decoder(VOCABULARY).decode_column(coder.encode_column(column)).to_pylist()
    assert back == ["ok", "\ufffd\ufffd(", "", "\ufffd"]
    large = pa.array(["über", None, ""], pa.large_string())
    assert bpe.decoder(VOCABULARY).decode_column(coder.encode_column(large)).to_pylist() == ["über", "", ""]
    half = library.encode("😀", add_special_tokens=False).ids[:1]
    lists = pa.array([half, None, [], library.encode("a", add_special_tokens=False).ids], pa.list_(pa.int32()))
    assert bpe.decoder(VOCABULARY).decode_column(lists).to_pylist() == [library.decode(half), "", "", "a"]


@needs_vocabulary
@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"pre_tokenizer": None}, {"added_tokens": [{"id": 1, "content": "x", "special": False}]}])
def test_other_vocabulary_files_are_refused(tmp_path, change):
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f) | change
    (tmp_path / "v.json").write_text(json.dumps(spec))
    for kind in (bpe.Coder, bpe.Decoder):
        with pytest.raises(ValueError, match="byte-level"):
            kind(str(tmp_path / "v.json"))


def test_images_are_lossless():
    for text in (None, "", "a", "x" * 64, "x" * 65, "tail\0\0", "é" * 999):
        payload, n = media.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == (text or "").encode() and not any(payload[n:])
        image = media.png(payload)
        assert media.unpng(image) == payload
    broken = bytearray(image)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.unpng(bytes(broken))


def test_the_whole_table_comes_back(spark, data, raw):
    got = {r.doc_id: r for r in op8_media(spark, data).collect()}
    assert len(got) == len(raw)
    for i, text, *_ in raw:
        payload, n = media.payload_of(text)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.png(payload)), hashlib.sha256(media.png(payload)).hexdigest()) and r.feature == media.features(payload)


def test_ranges_members_and_retries(spark, odd, empty, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    manifest = media.store_media(odd, folder)
    assert manifest.agg(F.sum("members")).first()[0] == odd.count()
    for size in (200, 5000, 1 << 20):
        rows = media.read_media(spark, f"file://{folder}", manifest, range_bytes=size)
        assert sorted(str((r.doc_id, bytes(r.payload))) for r in rows.collect()) == sorted(str((r.doc_id, media.payload_of(r.text)[0])) for r in odd.collect())
    assert media.read_media(spark, folder).count() == odd.count()
    ranges = media.plan_ranges([(3, 25), (4, 0)], 10)
    assert [(r.part, r.begin, r.end) for r in ranges] == [(3, 0, 10), (3, 10, 20), (3, 20, 25)]
    assert len(media.plan_ranges([(k, 10**15) for k in range(100)], 1)) <= media.MOST_RANGES + 100
    archive = next(r.archive for r in manifest.orderBy("archive").collect() if r.bytes > 300)
    with open(f"{folder}/{archive}", "r+b") as f:
        f.seek(100)
        f.write(b"XXXX")
    bad = media.read_media(spark, folder, on_error="null", retries=1)
    assert bad.where("error IS NOT NULL AND payload IS NULL").count() == 1 and bad.where("error IS NULL").count() == odd.count() - 1
    with pytest.raises(Exception, match="wrong|at 0|bytes"):
        media.read_media(spark, folder, retries=0).collect()
    assert media.media_columns(empty, str(tmp_path / "e")).count() == 0


def test_another_decoder_reads_the_images(spark):
    """Java's ImageIO sees the samples that went in."""
    jvm = spark._jvm
    for text in (None, "short", "é😀" * 500, "x" * 10_000, "\0\1\xff" * 77):
        payload, _ = media.payload_of(text)
        raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(media.png(payload))).getRaster()
        assert (raster.getWidth(), raster.getHeight(), raster.getNumBands()) == (64, len(payload) // 64, 1)
        assert bytes(raster.getDataBuffer().getData()) == payload


def test_a_member_is_retried_alone(tmp_path, spark, odd):
    folder = str(tmp_path / "r")
    manifest = media.store_media(odd, folder)
    reader = media.ArchiveReader({"path": folder, "retries": "2"})
    fails = {"left": 2}
    whole = reader.member

    def flaky(f, info):
        if fails["left"]:
            fails["left"] -= 1
            raise OSError("gone for now")
        return whole(f, info)

    reader.member = flaky
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == manifest.agg(F.sum("members")).first()[0] and fails["left"] == 0
