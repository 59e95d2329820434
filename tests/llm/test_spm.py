import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tileframe.llm import spm

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def pieces():
    return spm.load(PATH)


def plain_score(p, marked):
    """The best sum of scores, by a full table."""
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - p.longest), end):
            if (own := p.ids.get(marked[start:end])) is not None:
                best[end] = max(best[end], best[start] + own[0])
        if marked[end - 1] not in p.ids:
            best[end] = max(best[end], best[end - 1] + p.unknown_score)
    return best[-1]


def score_of(p, ids):
    total, i = 0.0, 0
    while i < len(ids):
        if ids[i] in p.bytes_of:
            n = 1
            while True:
                try:
                    bytes(p.bytes_of[x] for x in ids[i : i + n]).decode()
                    break
                except UnicodeDecodeError:
                    n += 1
            total, i = total + p.unknown_score, i + n
        else:
            total, i = total + p.ids[p.texts[ids[i]]][0], i + 1
    return total


TEXT = st.text(st.sampled_from("abehnost rein \n\té😀中ß_"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_best_segmentation_and_round_trip(text):
    p = pieces()
    ids = p.encode(text).tolist()
    assert p.decode(ids) == text
    marked = spm.SPACE_MARK + text.replace(" ", spm.SPACE_MARK)
    if text:
        assert abs(score_of(p, ids) - plain_score(p, marked)) <= 1e-9 * abs(plain_score(p, marked))
        assert list(p.stream(marked)) == ids


def test_the_library_reads_the_ids():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("Hello there, world", " two  spaces ", "naïve 😀 x\ny", "a" * 500):
        assert model.decode(pieces().encode(text).tolist()) == text


def test_window_stays_small():
    p, held = pieces(), []
    text = "thereisnospaceinthisverylongword" * 300
    ids = list(p.stream(text, held))
    assert max(held) <= 4 * p.longest and "".join(p.texts[i] for i in ids) == text
    held.clear()
    assert np.frombuffer(p.streams([text, "short", text[7:], ""], held)[0], np.int32).tolist() == ids and max(held) <= 4 * p.longest


WORDS = st.lists(st.text(st.sampled_from("abehnost▁rein\n\té😀中ß_"), max_size=70), max_size=12)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_streams_side_by_side_are_those_one_by_one(words):
    p = pieces()
    assert [np.frombuffer(x, np.int32).tolist() for x in p.streams(words)] == [list(p.stream(w)) for w in words]


def test_equal_hashes_are_told_apart_by_characters(monkeypatch):
    """Even if all parts of words had the hash of one piece, only that piece would be found there."""
    p = spm.Pieces(PATH)
    monkeypatch.setattr(p, "power", [np.uint64(0)] * len(p.power))
    for word, ids in zip(words := ["there", "▁the", "zzz"], p.streams(words), strict=True):
        ids = np.frombuffer(ids, np.int32).tolist()
        assert b"".join(p.octets[i] for i in ids).decode() == word.replace("▁", " ")


def test_whole_tables(documents, odd_docs):
    for docs in (documents, odd_docs):
        for r in spm.decode(spm.encode(docs, PATH), PATH).collect():
            assert r.decoded == (r.text or "") and (len(r.ids) > 0) == bool(r.text)
    assert spm.encode(documents.limit(0), PATH).count() == 0
