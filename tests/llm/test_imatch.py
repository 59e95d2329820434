import hashlib
import math
import re
import struct
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from tileframe.llm import imatch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_long(v, seed=42):
    return xxh64_intdigest(struct.pack("<q", v), seed)


def hash_all(terms):
    h = 42
    for t in terms:
        h = hash_long(t, h)
    return signed(h)


def terms(text):
    return sorted({signed(xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())})


def plain(rows, band):
    """rows: (id, text) -> sorted results by a plain pass over all documents in order."""
    rows = [(i, t or "") for i, t in rows]
    df = Counter(t for _, x in rows for t in terms(x))
    n = len(rows)
    lexicon = {t for t, c in df.items() if n * math.exp(-band[1]) <= c <= n * math.exp(-band[0])}

    def fp(text):
        own, out = [t for t in terms(text) if t in lexicon], []
        for place, of, s in imatch.SUBSETS:
            kept = [t for t in own if (t >> place) % of == s]
            out.append(hash_all(kept) if kept else 0)
        return out if any(out) else [hash_all(terms(text))] * len(out)

    def like(a, b):
        return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / max(1, sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True)))

    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = fp(t), fp(edited), fp(after)
        out.append((-1 if i is None else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), tuple(a), tuple(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out)


def got(docs, band, parts):
    rows = imatch.fingerprints_with_edits(docs, band, parts=parts).collect()
    return sorted((-1 if r.id is None else r.id, r.n_chars, r.edited_sha256, tuple(r.fingerprint), tuple(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_whole_table(documents, parts):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(documents, imatch.IDF_BAND, parts) == plain(rows, imatch.IDF_BAND)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_odd_rows(odd_docs, monkeypatch, limit):
    monkeypatch.setattr(imatch, "SENT_TERMS", limit)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(odd_docs, (0.5, 7.0), 3) == plain(rows, (0.5, 7.0))


def test_few_rows(documents):
    assert got(documents.limit(0), imatch.IDF_BAND, 4) == []
    one = documents.limit(1)
    r = one.first()
    assert got(one, imatch.IDF_BAND, 4) == plain([(r.doc_id, r.text)], imatch.IDF_BAND)


def test_half_replaced_texts_stay_alike(spark):
    """Of the texts whose last half is another's, at least nine in ten beat the likeness that only one in fifty unlike texts has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = imatch.fingerprints_with_edits(docs).where("n_chars > 1").collect()
    assert sum(r.near_edited > imatch.ALIKE for r in rows) >= 0.9 * len(rows)
    assert sum(r.near_next > imatch.ALIKE for r in rows) <= 0.02 * len(rows)


def test_very_long_texts(spark):
    rows = [(i, " ".join(f"w{(i + 1) * j % 50_000}" for j in range(60_000))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, (0.1, 7.0), 3) == plain(rows, (0.1, 7.0))


def test_close_copies_stay_alike(spark):
    words = [f"w{i * i % 997}" for i in range(400)]
    rows = [(i, " ".join(f"x{(i * 31 + j * 7) % 4000}" for j in range(200))) for i in range(60)]
    rows += [(101, " ".join(words)), (100, " ".join([*words[:200], "changed", *words[201:]]))]
    r = imatch.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string"), (3.0, 7.0)).where("id = 101").first()
    assert r.near_next > 0.6
