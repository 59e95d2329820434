import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tileframe.llm import secrets
from tileframe.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def plain(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, secrets.KINDS[k]) for s, k, e in sorted(out)]


def token(body="a1B2" * 7 + "zz"):
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = secrets.BASE62[r] + out
    return "ghp_" + body + out.rjust(6, "0")


PARTS = ["password", "PASSWD", "secret", "Token", "api_key", "APIKEY", "=", ": ", "'", '"', "abcdefghijkl", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", " ", "\n", "é", "ſecret", token()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_spans_are_those_of_plain_scans(text):
    got = secrets.spans(text, secrets._automaton())
    assert [s for s in got if s[2] != "checked"] == plain(text)


def test_checksum():
    good = token()
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    assert [s[2] for s in secrets.spans(f"x {good} y", secrets._automaton())] == ["checked"]
    assert secrets.spans(f"x {bad} y", secrets._automaton()) == []
    assert secrets.spans(f"x {good}Z y", secrets._automaton()) == []


def test_whole_tables(spark, documents, odd_docs, sf):
    for docs in (documents, odd_docs):
        for r in secrets.find_secrets(docs).collect():
            assert [(s.start, s.end, s.kind) for s in r.secret_spans if s.kind != "checked"] == plain(r.text)
    assert secrets.find_secrets(documents.limit(0)).count() == 0
    assert QUERIES["op10_secrets"](spark, sf).count() == documents.count()


def test_redact(spark, odd_docs):
    got = secrets.redact(odd_docs).collect()
    assert any("[SECRET]" in (r.text or "") for r in got) and not any(plain(r.text) for r in got)
    assert sorted(map(str, odd_docs.columns)) == sorted(got[0].asDict())
