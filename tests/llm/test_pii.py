import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import pii

from .conftest import ODD_TEXTS

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The four patterns as they are written."""
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if k % 2 == 0 else 2 * d - 9 * (2 * d > 9) for k, d in enumerate(reversed(digits))]
            good = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 9 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1279@.+- ()é\n", max_size=60))
def test_base_patterns(text):
    assert sorted(pii.detect(text)) == sorted(plain(text))


def test_cards_and_addresses():
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y", "256.1.1.1 10.0.0.1.5", "000255.1.1.1", "+1 (555) 123-4567", "a@b a@b.c@d.e x@y-z.q.r."):
        assert sorted(pii.detect(text)) == sorted(plain(text)), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john at example dot com now", [("email", "john at example dot com")]),
        ("x john.doe [at] mail (dot) example dot org y", [("email", "john.doe [at] mail (dot) example dot org")]),
        ("j.doe(at)example.org", [("email", "j.doe(at)example.org")]),
        ("JOHN {AT} EXAMPLE {DOT} COM", [("email", "JOHN {AT} EXAMPLE {DOT} COM")]),
        ("j\u043ehn@example.com", [("email", "j\u043ehn@example.com")]),
        ("joe\uff20example\uff0ecom", [("email", "joe\uff20example\uff0ecom")]),
        ("jo\u200be@exam\u200bple.com", [("email", "jo\u200be@exam\u200bple.com")]),
        ("plus four four two zero seven nine four six zero nine five eight", [("phone", "plus four four two zero seven nine four six zero nine five eight")]),
        ("one nine two dot one six eight dot zero dot one", [("ip", "one nine two dot one six eight dot zero dot one")]),
        ("card four-one-one-one one one one one one one one one one one one one!", [("card", "four-one-one-one one one one one one one one one one one one one")]),
        ("\uff14\uff11\uff11\uff11 \uff11111 \uff11111 \u0661\u0661\u0661\u0661", [("card", "\uff14\uff11\uff11\uff11 \uff11111 \uff11111 \u0661\u0661\u0661\u0661")]),
        ("meet at noon at the dot. Com, look at one two three", []),
        ("we met at example.com and at the one [at] least", []),
        ("plain a@b.com", []),
    ],
)
def test_disguises(text, found):
    base, added = pii.spans_of(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == found
    assert sorted(base) == sorted(plain(text))


def test_offsets_are_code_points():
    text = "\U0001f600\U0001f600 j\u043ehn@example.com \U0001f600 a@b.co"
    assert pii.written(sum(pii.spans_of(text), [])) == "email:3:19,email:5:19,email:22:28"


def test_frame(docs):
    rows = [*ODD_TEXTS, "write a@b.com or 10.0.0.1", "write a@b.com or 10.0.0.1"]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(rows) and all(got[k].spans == "" and got[k].base_sha256 == empty for k in range(len(ODD_TEXTS)))
    last = got[len(rows) - 1]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone, last.spans) == (1, 1, 0, 0, "email:6:13,ip:17:25")
    assert last.base_sha256 == hashlib.sha256(b"email:6:13,ip:17:25").hexdigest()
    assert pii.find_pii(docs(rows).where("false")).count() == 0


def test_redaction(docs):
    got = [r.text for r in pii.redact_pii(docs([(1, "to j\u043ehn@example.com, 10.0.0.1."), (2, None)])).orderBy("doc_id").collect()]
    assert got == ["to [EMAIL], [IP].", None]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("plus 44 20 7946 0958", [("phone", "plus 44 20 7946 0958")]),
        ("+44 two zero 7946 0958", [("phone", "+44 two zero 7946 0958")]),
        ("four 1 one 1 1 1 1 1 1 1 1 1 1 1 1 1", [("card", "four 1 one 1 1 1 1 1 1 1 1 1 1 1 1 1")]),
        ("192.168.one.one", [("ip", "192.168.one.one")]),
        ("192.168.\u017fix.F\u0130VE", [("ip", "192.168.\u017fix.F\u0130VE")]),
    ],
)
def test_disguises_of_few_words(text, found):
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.spans_of(text)[1]] == found


PARTS = ["plus", "+", "44", "one", "Two", "zero", "dot", "DOT", "at", "(at)", "[dot]", "{ . }", "<punkt>", ".", "-", ",", " ", "  ", "1", "192.168", "a", "bob", "example", "com", "@", "\n", "\u0430", "\u017fix", "_", "7946 0958", "4111 1111"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_gate_changes_no_result(text):
    if pii.normalise(text).text != text:
        assert pii.hinted(text)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_same_as_without_gate(text):
    base, tape = pii.detect(text), pii.normalise(text)
    every = {(k, *pii._trim(text, tape.start[a], tape.end[b - 1])) for k, a, b in pii.detect(tape.text)}
    every = {x for x in every if not any(k == x[0] and a <= x[1] and x[2] <= b for k, a, b in base)}
    assert pii.disguised(text, base) == sorted(every)


@pytest.mark.parametrize("text", ["Look at this dot matrix", "he arrived at home dot everything fine", "reach me at the dot net era", "we stood at noon dot by dot", "a at b dot in the end"])
def test_prose_is_no_address(text):
    assert pii.spans_of(text) == ([], [])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("john at example\u2028dot\u2028com", "john at example\u2028dot\u2028com"),
        ("ann at mail.example dot co dot uk Then", "ann at mail.example dot co dot uk"),
        ("ann at " + "x" * 80 + " dot " + "dot ".join(["y "] * 9) + "dot org", "ann at " + "x" * 80 + " dot " + "dot ".join(["y "] * 9) + "dot org"),
    ],
)
def test_hosts_in_words(text, found):
    assert [text[a:b] for _, a, b in pii.spans_of(text)[1]] == [found]


def test_long_runs_of_digits():
    text = "0" * 5000 + ".1.1.1 and " + "1" * 5000 + ".1.1.1"
    assert pii.detect(text)[0] == (1, 0, 5006) and sum(k == 1 for k, _, _ in pii.detect(text)) == 1


@pytest.mark.parametrize("part", ["a [at] b ", "at a dot ", " ", "1", "1.", "[ ", "a.", "+1(", "one ", "a@", "a at at dot "])
def test_long_texts_take_linear_time(part):
    text = "a [at] b" + part * (1_000_000 // len(part)) + "z"
    began = time.process_time()
    pii.spans_of(text)
    assert time.process_time() - began < 12
