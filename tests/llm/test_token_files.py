import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import queries, token_files
from plumbline.llm.token_files import EVERY, LANES, Coder, Encoder, frequencies

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """Documents in order, encoded as whole texts."""
    tokenizer = Tokenizer.from_file(FILE)
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def result(spark, docs, path):
    token_files.write(docs, path, FILE, 2)
    frame = token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_given_documents_agree_with_whole_text_encoding(spark, table):
    rows = [(row.doc_id, row.text) for row in table("documents", "sf0.01").collect()]
    assert sorted((tuple(row) for row in queries.op12_token_files(spark, "/root/testdata/sf0.01").select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr) == brute(rows)


def test_odd_rows(spark, odd_documents, tmp_path):
    rows = [(row.doc_id, row.text) for row in odd_documents.collect()]
    assert result(spark, odd_documents, str(tmp_path / "files")) == brute(rows)


def test_empty_table(spark, documents, tmp_path):
    assert result(spark, documents([]), str(tmp_path / "files")) == []


def test_files_are_in_the_order_of_ids(spark, documents, tmp_path):
    rng = random.Random(1)
    rows = [(i, "some words of text " * rng.randint(0, 30)) for i in rng.sample(range(10_000), 400)]
    path = str(tmp_path / "files")
    assert result(spark, documents(rows).repartition(7), path) == brute(rows)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    parts = spark.read.parquet(f"{path}/parts").orderBy("part").collect()
    ids = [i for block in blocks for i in token_files.expand(block.ids, np.int64).tolist()]
    assert ids == sorted(ids) and len(ids) == 400
    assert [part.start for part in parts] == np.cumsum([0, *(part.n_ids for part in parts)])[:-1].tolist()


TRICKY = [
    "it's we're THEY'LL x'so ''s 's", "a,b;c . , ;d! e?f", "é e ́ e.́ café,", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>.",
    "tab\tand\x0bvt\x0cff\x1cfs\x85nel\xa0nbsp em　ideo", "ΑΣ ΑΣ. ΑΣ,α İstanbul ẞ ǅ", "0123 4,567.89 ½ ² Ⅷ x2y", "漢字 かな 한글 देवनागरी", "×÷ a×b ÷.", "﻿bom ​zero‍", "😀😀. 👩‍👩‍👧 é😀", "", " ", "\n\n", "ﬁ ﬀ K Å Ω", "ȩ́ q̣̇",
]


def test_pieces_are_encoded_like_whole_texts():
    tokenizer, encode = Tokenizer.from_file(FILE), Encoder(FILE, remembered=20)
    assert token_files.cuts_at_white_space(FILE)
    rng = random.Random(5)
    letters = "".join(TRICKY) + " .,;:!?'\t\n" * 8 + "abcST" * 8
    texts = [*TRICKY, *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000))]
    for some in (texts[:50], texts[50:51], texts[51:60], *([text] for text in texts[60:1000]), texts[1000:]):
        for text, ids in zip(some, encode([text.encode() for text in some]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_are_asked_for_whole_texts(spark, documents, tmp_path):
    file = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.cuts_at_white_space(file)
    token_files.write(documents([(1, "  two  spaces\n")]), str(tmp_path / "files"), file, 50256)
    (row,) = token_files.read(spark, str(tmp_path / "files")).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*Tokenizer.from_file(file).encode("  two  spaces\n").ids, 50256]


@pytest.mark.parametrize("size", [0, 1, LANES - 1, LANES, LANES + 1, LANES * EVERY, LANES * EVERY + 1, LANES * EVERY * 3 - 7])
def test_round_trip_and_checkpoints(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.zipf(1.3, size), 60_000).astype(np.uint32)
    counts = np.bincount(np.append(ids, [3, 99_999]))
    coder = Coder(frequencies(counts))
    block = coder.encode(ids)
    assert (coder.decode(block, size) == ids).all()
    for number in range(len(block["checks"]) // 4):
        part = ids[number * LANES * EVERY : (number + 1) * LANES * EVERY]
        assert (coder.decode(block, size, number, number + 1) == part).all()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(7)
    ids = np.minimum(rng.zipf(1.5, 1_200_000), 40_000).astype(np.uint32)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    bits = -(share * np.log2(share)).sum() * len(ids)
    block = Coder(frequencies(counts)).encode(ids)
    assert len(block["words"]) * 8 < bits * 1.01
    assert len(block["states"]) + len(block["places"]) + len(block["checks"]) <= 5 * (LANES * 8 + 8)


def test_one_id_only():
    ids = np.full(5000, 4, np.uint32)
    coder = Coder(frequencies(np.bincount(ids)))
    block = coder.encode(ids)
    assert (coder.decode(block, 5000) == ids).all()
    assert not block["words"]


def test_damage_is_noticed():
    ids = np.random.default_rng(2).integers(0, 1000, 900_000).astype(np.uint32)
    coder = Coder(frequencies(np.bincount(ids)))
    block = coder.encode(ids)
    words = bytearray(block["words"])
    words[len(words) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode({**block, "words": bytes(words)}, len(ids))


def test_frequencies_add_up():
    for counts in ([1], [0, 5, 0], [1] * 400_000, [10**12, 1, 1, 0], [3, 2, 2]):
        table = frequencies(np.array(counts))
        assert table.sum() == 1 << 20
        assert ((table > 0) == (np.array(counts) > 0)).all()
    assert len(frequencies(np.zeros(5, np.int64))) == 0
