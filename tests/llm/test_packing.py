import zlib
from collections import defaultdict

import numpy as np
import pytest

from tileframe.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(docs, capacity=2048):
    rows = docs.select("doc_id", "text").collect()
    want = defaultdict(int)
    for r, ids in zip(rows, tokens([r.text for r in rows]), strict=True):
        want[r.doc_id, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    by_id = {(r.doc_id, len(ids)): ids for r, ids in zip(rows, tokens([r.text for r in rows]), strict=True)}
    got = packing.pack(docs, PATH, capacity).collect()
    sequences, pieces = defaultdict(list), defaultdict(int)
    for p in got:
        ids = by_id[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert len(ids) == p.length > 0 and zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32
        sequences[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id, p.doc_tokens] += p.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = defaultdict(int)
    for (doc, _, n), times in want.items():
        total[doc, n] += n * times
    assert pieces == total
    return sum(pieces.values()), len(sequences)


def test_whole_table_with_little_padding(documents):
    total, windows = check(documents)
    assert windows * 2048 - total < 0.02 * total + 2048


def test_odd_rows(odd_docs):
    check(odd_docs)
    check(odd_docs, 16)


def test_empty(documents):
    assert packing.pack(documents.limit(0), PATH).count() == 0


def test_differencing():
    place = packing.difference([8, 7, 6, 5, 4], 2)
    assert abs(np.bincount(place, weights=[8, 7, 6, 5, 4])[0] - 15) <= 1
    assert packing.deal([3, 3, 3], 4)[1] == 3
    assert packing.deal([], 4)[1] == 1
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    place, windows = packing.deal(sizes, 2048)
    assert np.bincount(place, weights=sizes, minlength=windows).max() <= 2048 and windows == -(-sum(sizes) // 2048)


@pytest.mark.parametrize("capacity", [2048, 16, 3])
def test_many_full_batches(capacity):
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1.5, 3000) if capacity == 2048 else rng.lognormal(3, 1, 3000), 50_000).astype(int) + 1
    texts = [rng.integers(0, 50_000, n).astype(np.uint32) for n in lengths]
    packer = packing.Packer(capacity, 7)
    rows = [p for doc, ids in enumerate(texts) for p in packer.add(doc, ids)] + list(packer.flush())
    assert lengths.sum() > 10 * packing.WINDOWS * capacity / (1 if capacity < 2048 else 10)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in rows:
        assert length > 0 and tokens == lengths[doc] and zlib.crc32(texts[doc][start : start + length].astype("<u4").tobytes()) == crc
        pieces[doc].append((start, length))
        sequences[sequence].append((offset, length))
    assert set(pieces) == set(range(len(texts)))
    for of, end in [(sequences, None), (pieces, lengths)]:
        for name, parts in of.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at <= capacity if end is None else at == end[name]
    if capacity == 2048:
        assert len(sequences) * capacity < 1.01 * lengths.sum() + capacity


def test_ids_of_a_table_of_many_batches(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1)
    got = packing.pack(docs, PATH).select("doc_id", "start", "length", "doc_tokens").collect()
    parts = defaultdict(list)
    for p in got:
        parts[p.doc_id, p.doc_tokens].append((p.start, p.length))
    for (_, tokens), own in parts.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == tokens
    assert len(parts) == docs.count()
