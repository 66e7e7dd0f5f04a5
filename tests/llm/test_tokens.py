"""Packing, token files and token counts against the libraries on whole texts."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowmetrics.llm import token_files
from flowmetrics.llm.common import prepare
from flowmetrics.llm.encoding import Encoder
from flowmetrics.llm.packing import first_fit_decreasing, pack, token_pieces
from flowmetrics.llm.token_counts import count_tokens
from flowmetrics.llm.token_files import read_token_files, write_token_files

ODD = [
    None, "", " ", "\n", "  a  b\n\n c \x1c d", "don't. they'll! 's", "<|endoftext|> x<|startoftext|>.y", "É́. é. ① ½x. ǅ.a", "a b　 c", "ſ. K. İ. Σ. ΑΣ. ",
    "日本語。テキスト, x", "foo...bar.., \t\n", "9. 12.5%", "x\x85y\r\nz  \r\n", "a \tb\t c\n\td", "a\x00b \x00c", "x \x01 y", " ▁a▁ b", "<s> a</s>", "The THE the. THE!", "word " * 3000,
    "a\n\n<|endoftext|>b", "\n\n\n\n<|endoftext|>", "\n \x85<|endoftext|>",
]
SCHEMA = "doc_id long, text string, key string, length int"


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t, "k", 7) for i, t in enumerate(ODD)] + [(3, "\n", "k", 7), (50, "twice", None, None), (50, "twice", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    encoder = Encoder(public_tokenizers.path(name))

    @given(st.lists(st.text(alphabet=st.sampled_from(list("aZé .,!'\n\t\x00\x01İḰ9|<>中")), max_size=12), max_size=5))
    @settings(max_examples=150, deadline=None)
    def check(texts):
        ids, count = encoder.encode(pa.array(texts, pa.string()))
        assert [list(x) for x in np.split(ids, np.cumsum(count)[:-1])] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts] if texts else len(ids) == 0

    check()
    parts = ["a", "Zé", ".", "x1", " ", "\n", "\t", "\r", "\x85", "\xa0", "\u2003", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]

    @given(st.lists(st.lists(st.sampled_from(parts), max_size=8).map("".join), min_size=1, max_size=6))
    @settings(max_examples=400, deadline=None)
    def check_special(texts):
        ids, count = encoder.encode(pa.array(texts, pa.string()))
        assert [list(x) for x in np.split(ids, np.cumsum(count)[:-1])] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]

    check_special()
    ids, count = encoder.encode(pa.array(ODD))
    assert list(ids) == [i for t in ODD for i in encoder.library.encode(t or "", add_special_tokens=False).ids] and len(count) == len(ODD)


def test_first_fit_decreasing():
    bins, offsets = first_fit_decreasing(np.array([10, 10, 7, 6, 5, 3, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 2, 3, 4, 2, 3, 4] and offsets.tolist() == [0, 0, 0, 0, 0, 7, 6, 5]
    sizes = -np.sort(-np.random.default_rng(1).integers(1, 1025, 500))
    bins, _ = first_fit_decreasing(sizes, 1024)
    room, plain = [], []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        room[b:b + 1] = [(room[b] if b < len(room) else 1024) - s]
        plain.append(b)
    assert bins.tolist() == plain


def test_packing(spark, docs):
    pieces = token_pieces(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), capacity=64)
    rows = pack(pieces, "doc_id", capacity=64, group_pieces=16).collect()
    library = Encoder(public_tokenizers.path("byte_bpe_50k.json")).library
    want = sorted((i, bytes(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    by_doc, by_sequence = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, data in want:
        own = {r.start: bytes(r.ids) for r in by_doc[key]}
        assert b"".join(own[s] for s in sorted(own)) == data
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 64
    assert pack(pieces.limit(0), "doc_id").count() == 0


def test_packing_of_repeated_keys(spark):
    big = (1 << 53) + 1
    rows = [(None, 0, 5 + i % 50, i) for i in range(3000)] + [(7, 0, 9, i) for i in range(1000)] + [(big + 2 * i, 0, 11, i) for i in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, row long").repartition(3)
    got = pack(pieces, "doc_id", capacity=64, group_pieces=256).collect()
    assert sorted(map(str, ((r.doc_id, r.start, r.length, r.row) for r in got))) == sorted(map(str, rows))
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 512
    by_sequence = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == by_sequence.get(r.sequence_id, 0)
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 64


def test_token_files(spark, docs, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    write_token_files(docs, "doc_id", "text", path, f"file://{tmp_path}/tokens", end_id=2, shard_docs=5)
    kind = docs.schema["doc_id"].dataType
    rows = read_token_files(spark, f"file://{tmp_path}/tokens", "doc_id", kind).collect()
    library = Encoder(path).library
    at = 0
    for r, (key, text) in zip(sorted(rows, key=lambda r: r.start), sorted((r.doc_id, r.text or "") for r in docs.collect()), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = read_token_files(spark, f"file://{tmp_path}/tokens", "doc_id", kind, wanted={4, 7}).collect()
    assert {r.doc_id: r.start for r in some} == {r.doc_id: r.start for r in rows if r.doc_id in (4, 7)}
    shard = sorted((tmp_path / "tokens").glob("*.tokens"))[0]
    data = bytearray(shard.read_bytes())
    import io

    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True).read()) > 0
    seek = data[6]
    data[6] = seek ^ 0xFF
    shard.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.read_shard(str(shard)))
    write_token_files(docs.limit(0), "doc_id", "text", path, f"file://{tmp_path}/none", end_id=2)
    assert read_token_files(spark, f"file://{tmp_path}/none", "doc_id", kind).count() == 0


def test_token_counts(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(tuple(r) for r in count_tokens(docs, "doc_id", "text", path, buckets=3).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert count_tokens(docs.limit(0), "doc_id", "text", path).count() == 0
