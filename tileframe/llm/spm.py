"""SentencePiece encoding and decoding by a streaming Viterbi search.

The segmentation of a text with the largest sum of piece scores is found in one pass: only
the scores of the last places that a piece can reach back to are kept, and backpointers are
kept until the paths from all of these places pass one boundary; the ids up to it are then
final. Characters that no piece has are spelled in bytes. Where no piece goes past a space,
the streams are the distinct words of some texts, else the texts; all of them go forward
together, a place at a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: Words whose ids are kept from one portion of texts to the next, and bytes of texts in a portion.
KEPT_WORDS, PORTION = 200_000, 1 << 21


def _bytes(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


#: Multiplier of the polynomial hash of parts of words.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
    return h


class Pieces:
    """The pieces of a SentencePiece model file: their ids, scores and bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[float, int]] = {}
        self.byte_ids, self.texts = {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.texts.append(piece)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = model.get_score(i), i
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown_id = model.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((s for s, _ in self.ids.values()), default=0.0) - 10
        #: Whether every path has a boundary before a space mark that follows another character.
        self.words_part = all(SPACE_MARK not in p.lstrip(SPACE_MARK) for p in self.ids)
        #: What pieces end with: pieces with score and id, mere endings of pieces with None.
        self.endings: dict[str, tuple[float, int] | None] = {p[i:]: None for p in self.ids for i in range(1, len(p))}
        self.endings |= self.ids
        texts = list(self.ids)
        keys = np.fromiter(map(_hash, texts), np.uint64, len(texts))
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        by_hash = np.argsort(keys)
        self.hashes, self.scores = keys[by_hash], np.array([self.ids[t][0] for t in texts])[by_hash]
        self.hash_ids = np.array([self.ids[t][1] for t in texts], np.int32)[by_hash]
        self.sizes = np.array([len(t) for t in texts], np.int64)[by_hash]
        self.chars = np.array([*texts, ""], f"<U{self.longest}").view(np.uint32).reshape(-1, self.longest)[:-1][by_hash]
        self.power = [np.uint64(pow(int(BASE), n, 1 << 64)) for n in range(self.longest + 1)]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        # characters that no longer piece has stand alone: every path has boundaries around them
        longer = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in longer)
        self.alone, self.parts = f"[{alone}]", re.compile(f"[^{alone}]+|[{alone}]")
        self.kept: dict[str, bytes] = {}
        self.octets = [bytes([self.bytes_of[i]]) if i in self.bytes_of else t.replace(SPACE_MARK, " ").encode() for i, t in enumerate(self.texts)]

    def spelled(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown_id) for b in char.encode("utf-8", "replace")]

    def stream(self, text: str, retained: list[int] | None = None) -> Iterator[int]:
        """Ids of the best segmentation of one text; of equal sums the one whose last piece is longest, from the end on.

        ``streams`` does the same for many.

        ``retained``, if given, gets the number of backpointers held at each step.
        """
        endings, longest, unknown = self.endings, self.longest, self.unknown_score
        scores = [0.0]  # of the places from `low` on
        lengths: list[int] = []  # of the last pieces of places done + 1 on
        found: list[int] = []  # their ids (-1: spelled)
        low = done = 0
        for end in range(1, len(text) + 1):
            best, length, piece = scores[-1] + unknown, 1, -1
            for start in range(end - 1, low - 1, -1):
                own = endings.get(text[start:end], 0)
                if own is None:
                    continue
                if own == 0:  # no piece ends like this
                    break
                if (score := scores[start - low] + own[0]) >= best:
                    best, length, piece = score, end - start, own[1]
            scores.append(best)
            lengths.append(length)
            found.append(piece)
            if len(scores) > longest:
                del scores[0]
                low += 1
            if retained is not None:
                retained.append(len(found))
            if len(found) >= 2 * longest and end < len(text):
                common = self._converged(lengths, done, low, end)
                if common > done:
                    yield from self._ids(text, lengths, found, common - done, done)
                    del lengths[: common - done], found[: common - done]
                    done = common
        yield from self._ids(text, lengths, found, len(found), done)

    @staticmethod
    def _converged(lengths: list[int], done: int, low: int, end: int) -> int:
        """The last boundary that the paths from all places between low and end pass."""
        alive = set(range(max(low, done), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - lengths[last - done - 1])
        return alive.pop()

    def _ids(self, text: str, lengths: list[int], found: list[int], at: int, start: int) -> list[int]:
        """Ids of the best path to place ``at`` behind ``start``."""
        out = []
        while at:
            piece = found[at - 1]
            if piece >= 0:
                out.append(piece)
            else:
                out += reversed(self.spelled(text[start + at - 1]))
            at -= lengths[at - 1]
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, spaces as marks and with one more in front; none for an empty text."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty. Where no piece goes past a space, each distinct word is searched once for a portion of texts."""
        if not self.words_part:
            return [np.frombuffer(x, np.int32) for x in self.streams([self._marked(t) for t in texts.to_pylist()])]
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        cuts = np.flatnonzero(np.diff(ends // PORTION)) + 1 if len(ends) else []
        out: list[np.ndarray] = []
        for at, stop in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            out += self._portion(texts.slice(int(at), int(stop - at)))
        return out

    @staticmethod
    def _marked(text: str | None) -> str:
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""

    def _portion(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        runs = np.asarray(pc.match_substring_regex(texts, f"^ |  | $|{SPACE_MARK}"))
        plain = iter(self._words_of(texts.filter(pa.array(~runs))))
        return [self._runs_of(texts[k].as_py()) if run else next(plain) for k, run in enumerate(runs.tolist())]

    def _runs_of(self, text: str) -> np.ndarray:
        """Ids of a text with marks in a row, which may be one piece."""
        words = re.findall(rf"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+", self._marked(text))
        at = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = self._searched(list(at))
        return np.frombuffer(b"".join(found[at[w]] for w in words), np.int32)

    def _words_of(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose words have one space between them."""
        lists = pc.split_pattern(texts, " ")
        sizes = np.asarray(pc.list_value_length(lists), np.int64)
        flat = sizes.copy()
        sizes[np.asarray(pc.binary_length(texts)) == 0] = 0
        coded = lists.flatten().dictionary_encode()
        words = pc.binary_join_element_wise(SPACE_MARK, coded.dictionary, "").to_numpy(zero_copy_only=False).tolist()
        # words with characters that stand alone are put together from their parts
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(coded.dictionary, self.alone))).tolist()
        parts = {k: self.parts.findall(words[k]) for k in odd}
        more = list({p for own in parts.values() for p in own})
        for k in odd:
            words[k] = SPACE_MARK
        found = self._searched(words + more)
        ids_of = dict(zip(more, found[len(words) :], strict=True))
        del found[len(words) :]
        for k, own in parts.items():
            found[k] = b"".join([ids_of[p] for p in own])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), np.int32)
        starts = np.cumsum(lengths) - lengths
        own = np.asarray(coded.indices)
        own = own[np.repeat(sizes > 0, flat)]
        each = lengths[own]
        ends = np.cumsum(each)
        place = np.repeat((starts[own] - (ends - each)).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        ids = pool[place]
        doc_ends = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return np.split(ids, doc_ends[:-1]) if len(doc_ends) else []

    def _searched(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as bytes of 32-bit numbers, those that were kept and new ones."""
        known = self.kept
        fresh = list({w: None for w in words if w not in known})
        known.update(zip(fresh, self.streams(fresh), strict=True))
        out = [known[w] for w in words]
        if len(known) > KEPT_WORDS:
            self.kept = dict(zip(words, out, strict=True))
        return out

    def streams(self, words: list[str], retained: list[int] | None = None) -> list[bytes]:
        """What ``stream`` gives for each word, as bytes of 32-bit numbers: the same search for all words at once, place by place.

        Of each word the scores and hashes of the last ``longest`` places are kept in rings.
        Every ``longest`` places the ids up to the boundary that all surviving paths of a word
        share are committed and backpointers that no word needs any more go. Pieces are found
        by hash and then compared by their characters. ``retained`` gets the number of places
        whose backpointers are held after each step.
        """
        n, longest = len(words), self.longest
        sizes = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        scores, hashes = np.zeros((longest + 1, n)), np.zeros((longest + 1, n), np.uint64)
        done, base = np.zeros(n, np.int64), 0
        lengths: list[np.ndarray] = []  # of the last pieces of places base + 1 on
        found: list[np.ndarray] = []  # their ids (-1: spelled)
        told: list[tuple[np.ndarray, np.ndarray]] = []

        def tell(lanes: np.ndarray, ends: np.ndarray) -> None:
            """Commit the ids of the best paths of some words up to a place of each."""
            steps, at = [], ends.copy()
            while (left := at > done[lanes]).any():
                lanes, at = lanes[left], at[left]
                back = np.empty((2, len(lanes)), np.int64)
                for place in np.unique(at):
                    own = at == place
                    back[0, own], back[1, own] = lengths[place - base - 1][lanes[own]], found[place - base - 1][lanes[own]]
                spelled = back[1] < 0
                back[1, spelled] = -2 - text[starts[lanes[spelled]] + at[spelled] - 1].astype(np.int64)
                steps.append((lanes, back[1]))
                at = at - back[0]
            told.extend(reversed(steps))

        m, end = int((sizes > 0).sum()), 0
        while m:
            end += 1
            hashes[end % (longest + 1), :m] = hashes[(end - 1) % (longest + 1), :m] * BASE + text[starts[:m] + end - 1] + np.uint64(1)
            best = scores[(end - 1) % (longest + 1), :m] + self.unknown_score
            length, piece = np.ones(m, np.int64), np.full(m, -1, np.int32)
            for size in range(1, min(end, longest) + 1):
                own = hashes[end % (longest + 1), :m] - hashes[(end - size) % (longest + 1), :m] * self.power[size]
                at = np.flatnonzero(self.maybe[(own >> np.uint64(44)).astype(np.int64)])
                own = own[at]
                place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
                known = self.hashes[place] == own
                at, place = at[known], place[known]
                score = scores[(end - size) % (longest + 1), at] + self.scores[place]
                better = score >= best[at]
                at, place, score = at[better], place[better], score[better]
                same = (text[(starts[at] + end - size)[:, None] + np.arange(size)] == self.chars[place, :size]).all(axis=1) & (self.sizes[place] == size)
                at, place = at[same], place[same]
                best[at], length[at], piece[at] = score[same], size, self.hash_ids[place]
            scores[end % (longest + 1), :m] = best
            lengths.append(length)
            found.append(piece)
            if retained is not None:
                retained.append(len(found))
            left = int(np.searchsorted(-sizes, -end, side="left"))  # words that go on
            if left < m:
                tell(np.arange(left, m), np.full(m - left, end))
            m = left
            if m and end % longest == 0:
                lanes = np.arange(m)
                common = self._common(lengths, done[:m], base, end)
                tell(lanes[common > done[:m]], common[common > done[:m]])
                done[:m] = np.maximum(done[:m], common)
                gone = int(done[:m].min()) - base
                del lengths[:gone], found[:gone]
                base += gone
        lanes = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in told)])
        ids = np.concatenate([np.zeros(0, np.int64), *(x for _, x in told)])
        by_word = np.argsort(order[lanes], kind="stable")
        lanes, ids = order[lanes][by_word], ids[by_word]
        ends = np.searchsorted(lanes, np.arange(n + 1))
        octets = ids.astype(np.int32).tobytes()
        out = [octets[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.unique(lanes[ids < 0]).tolist():
            own = ids[ends[k] : ends[k + 1]].tolist()
            out[k] = _bytes(x for i in own for x in ([i] if i >= 0 else self.spelled(chr(-2 - i))))
        return out

    def _common(self, lengths: list[np.ndarray], done: np.ndarray, base: int, end: int) -> np.ndarray:
        """``_converged`` for many words: the last boundary of each that the paths from all places that pieces can still start at pass."""
        m = len(done)
        alive = np.zeros((end - base + 1, m), bool)
        places = np.arange(base, end + 1)[:, None]
        alive[(places >= np.maximum(end + 1 - self.longest, done)) & (places <= end)] = True
        count = alive.sum(axis=0)
        for place in range(end, base, -1):
            own = np.flatnonzero(alive[place - base] & (count > 1))
            if not len(own):
                continue
            to = place - lengths[place - base - 1][own] - base
            alive[place - base, own] = False
            count[own] -= alive[to, own]
            alive[to, own] = True
        return base + alive.argmax(axis=0)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks are spaces, the first of which goes; runs of bytes are UTF-8."""
        text = b"".join(map(self.octets.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in ``out_col``; null and empty texts have none.

    ``path`` is a SentencePiece model file that all executors can read. Rows are taken one
    by one: repeated rows, empty tables and other columns need nothing, a column named as
    ``out_col`` is replaced.
    """

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        ids = load(path).encode_all(texts)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))

    return docs.withColumn(out_col, encoded(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``out_col``, empty for null.

    Decoding gives back every encoded text, but for space marks (U+2581) in it, which come
    back as spaces.
    """

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        pieces = load(path)
        ids = pc.fill_null(ids, pa.scalar([], ids.type))
        values, sizes = ids.flatten().to_numpy(), np.asarray(pc.list_value_length(ids), np.int64)
        return pa.array([pieces.decode(x.tolist()) for x in np.split(values, np.cumsum(sizes)[:-1])] if len(ids) else [], pa.string())

    return docs.withColumn(out_col, decoded(F.col(ids_col)))
