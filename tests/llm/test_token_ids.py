import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import queries, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_rows(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for d, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def read_back(docs, **options):
    return [tuple(r) for r in token_ids.read(token_ids.write(docs, PATH, **options)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()]


def test_query_against_tokenizer(spark, sf_dir):
    got = queries.op12_token_ids(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == plain_rows(rows)


@pytest.mark.parametrize("block", [token_ids.BLOCK, 50])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(token_ids, "BLOCK", block)
    monkeypatch.setattr(token_ids, "PIECE", 200)
    rng = random.Random(4)
    texts = ["", " ", None, "a", " a  b ", "É é x", "It's, don't <|endoftext|> or <|endoftext |>", "x" * 5000, "naïve  \n\n \tcafé 中文 \U0001f600 end", "1 2  3", "word " * 3000]
    rows = [(i - 20, rng.choice(texts) if i > len(texts) else texts[i - 1], "s", 1) for i in range(1, 80)]
    rows += [(1 << 62, "far", "s", 1), (-(1 << 63), "least", "s", 1), ((1 << 63) - 1, "most", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, row long").repartition(5)
    want = plain_rows([(r[0], r[1]) for r in sorted(rows, key=lambda r: r[0])])
    assert sorted(read_back(docs)) == want


def test_null_and_repeated_ids(spark):
    rows = [(None, "one"), (None, "two two"), (3, "three"), (3, "three"), (3, None), (1, "first")]
    got = read_back(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((key(r), r[2], r[3]) for r in got) == sorted((key(r), len(plain_ids(r[1])), crc(plain_ids(r[1]))) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]


def test_empty_and_other_ids(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert read_back(empty) == []
    with pytest.raises(TypeError):
        token_ids.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)


values = st.integers(0, 63).flatmap(lambda b: st.integers(0, (1 << b) * 2 - 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(values, st.just(0)), max_size=400))
def test_coding_round_trip(numbers):
    given_ = np.array(numbers, np.uint64)
    words, exceptions = token_ids.encode(given_)
    assert token_ids.decode(words, exceptions, len(given_)).tolist() == numbers
    assert len(exceptions) == sum(v >= 1 << 60 for v in numbers) and len(words) <= max(1, len(numbers))


def test_coding_is_small():
    assert len(token_ids.encode(np.zeros(1200, np.uint64))[0]) == 10
    assert len(token_ids.encode(np.full(600, 1, np.uint64))[0]) == 10
    assert len(token_ids.encode(np.full(600, 32767, np.uint64))[0]) == 150


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, 9)), min_size=1, max_size=30), st.data())
def test_block_round_trip(doc_ids, data):
    doc_ids = sorted(doc_ids, key=lambda d: (d is not None, d or 0))
    lengths = data.draw(st.lists(st.integers(0, 5), min_size=len(doc_ids), max_size=len(doc_ids)))
    ids = list(range(sum(lengths)))
    raw = token_ids.pack(doc_ids, np.array(lengths), np.array(ids, np.uint64))
    got = token_ids.unpack(raw)
    assert got[0] == doc_ids and got[1].tolist() == lengths and got[2].tolist() == ids
    with pytest.raises(ValueError):
        token_ids.unpack(raw[:-1] + bytes([raw[-1] ^ 1])) if len(raw) > token_ids._HEAD.size else token_ids.unpack(b"x" + raw[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("aB é \n\t.,'’0१ß", max_size=40), st.text(max_size=20)), max_size=6))
def test_segments_give_the_ids_of_whole_texts(texts):
    encoder = token_ids._encoder(PATH, True)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, lengths = encoder(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == (encoder._whole(texts) or [[]])


def test_a_tokenizer_of_another_kind(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Some  words\nhere"), (2, None)], "doc_id long, text string")
    got = token_ids.read(token_ids.write(docs, path, end_id=None, segments=False)).orderBy("doc_id").collect()
    want = Tokenizer.from_file(path).encode("Some  words\nhere", add_special_tokens=False).ids
    assert np.frombuffer(got[0].ids, "<u4").tolist() == want and (got[1].start, got[1].n_tokens) == (len(want), 0)
