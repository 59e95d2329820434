"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits, then checksums.

Keyword kinds are looked for with one automaton over the text in lower case; only at its
hits is the kind's expression tried, anchored there. Runs of hexadecimal digits have no
keyword, so their expression scans the text. Tokens with a checksum inside (a prefix, 30
characters and the CRC32 of these in base 62) count only if the checksum holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans at one place are listed.
KINDS = ["assign", "access", "hex", "checked"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS_WORDS = ["akia"]
CHECKED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ACCESS_WORDS), ("checked", CHECKED_WORDS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def checksum_holds(body: str, check: str) -> bool:
    """Whether ``check`` is the CRC32 of ``body`` in base 62, padded to six digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0") == check


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind; places in code points."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(low))
    over = {"assign": 0, "access": 0, "checked": 0}
    for at, kind in hits:
        if at < over[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                over[kind] = m.end()
                if len(m[2]) >= 12:
                    out.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                over[kind] = m.end()
                if len(m[0]) >= 18:
                    out.append((at, m.end(), kind))
        elif (m := CHECKED.match(text, at)) and checksum_holds(m[1], m[2]):
            over[kind] = m.end()
            out.append((at, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = "array<struct<start:long,end:long,kind:string>>"


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """``docs`` with an array of secret spans (start, end, kind) of each whole text.

    Null texts count as empty and have none. Rows are taken one by one, so repeated rows,
    empty tables and extra columns need nothing; a column named as ``out_col`` is replaced.
    """

    @F.pandas_udf(SPANS)
    def found(texts):
        automaton = _automaton()
        return texts.map(lambda t: [{"start": s, "end": e, "kind": k} for s, e, k in spans(t or "", automaton)])

    return docs.withColumn(out_col, found(F.col(text_col).cast("string")))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of its texts put out by ``mask``; overlapping spans become one. Nulls stay null."""

    @F.pandas_udf("string")
    def masked(texts):
        automaton = _automaton()

        def one(t: str | None) -> str | None:
            if not t or not (found := spans(t, automaton)):
                return t
            out, at = [], 0
            merged: list[list[int]] = []
            for s, e, _ in found:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            for s, e in merged:
                out += [t[at:s], mask]
                at = e
            return "".join([*out, t[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
