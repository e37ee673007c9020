"""Personal data: the plain patterns, disguises, offsets, awkward rows."""

import hashlib
import random
import re
import time

import pytest
from llm_fixtures import SF_SMALL
from llm_fixtures import documents, make_docs, texts  # noqa: F401

from tidewatch.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or slow_luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_query_base_matches_the_patterns(spark, texts):
    rows = pii.query(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        want = slow_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


@pytest.mark.parametrize("seed", range(6))
def test_plain_spans_on_random_strings(seed):
    rng = random.Random(seed)
    alphabet = ["@", ".", "+", "-", " ", "(", ")", "a", "B", "%", "é", "1", "2", "99", "255", "256",
                "4539148803436467", "a@b.co", "1.2.3.4", "+1 415 555 1212"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert pii.plain_spans(text) == slow_spans(text), text


@pytest.mark.parametrize("text, kind, span", [
    ("write to john [at] example (dot) com now", "email", "john [at] example (dot) com"),
    ("write to john at mail dot example dot com", "email", "to john at mail dot example dot com"),
    ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("see ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("j​ohn@example.com", "email", "j​ohn@example.com"),
    ("a&#64;b&#46;com", "email", "a&#64;b&#46;com"),
    ("mail a_at_b_dot_com", "email", "a_at_b_dot_com"),
    ("plus one four one five five five five one two one two", "phone",
     "plus one four one five five five five one two one two"),
    ("+1 four one five 555 one two one two", "phone", "+1 four one five 555 one two one two"),
    ("one nine two dot one six eight dot zero dot one ok", "ip",
     "one nine two dot one six eight dot zero dot one"),
    ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
    ("vier fünf drei neun eins vier acht acht null drei vier drei sechs vier sechs sieben", "card",
     "vier fünf drei neun eins vier acht acht null drei vier drei sechs vier sechs sieben"),
    ("４５３９ 1488 0343 6467", "card", "４５３９ 1488 0343 6467"),
    ("45391488O3436467", "card", "45391488O3436467"),
])
def test_disguises_are_found_at_their_place(text, kind, span):
    _, every = pii.find(text)
    found = [(k, text[a:b]) for k, a, b in every]
    assert any(k == kind and (s == span or s == span.removeprefix("to ")) for k, s in found), found
    assert "[" + kind.upper() + "]" in pii.masked(text)


@pytest.mark.parametrize("text", [
    "Look at the dot on the map.", "point at a dot then go", "see x at y dot z", "He arrived at noon. Dot said no.", "one two", "",
    "Un deux trois soleil", "at example.com we met", "x@y", "1.2.3", "1234 5678", "+1 (2",
    "Привет, как дела?", "α β γ δ", "It was one, two or three days."])
def test_clean_texts_are_left_alone(text):
    assert pii.find(text) == ([], [])
    assert pii.masked(text) == text


def test_clean_documents_gain_nothing(texts):
    for t in texts.values():
        plain, every = pii.find(t)
        assert plain == every


def test_prose_after_an_address_is_not_taken_in():
    assert [s for s in pii.find("a@b.com dot then")[1]] == [("email", 0, 7)]


def test_overlaps_are_masked_once():
    assert pii.masked("go a@b.co and 1.2.3.4!") == "go [EMAIL] and [IP]!"
    assert pii.masked("hаhn@b.co") == "[EMAIL]"      # the plain span lies in the added one


@pytest.mark.parametrize("unit", ["a", "1", "@", "a@", "1.", "+", "+1 ", " ", "one ", "a.", "(",
                                  "1 ", "dot ", "at ", "O1", "é", "а", "zero-", "[at]"])
def test_long_runs_take_linear_time(unit):
    began = time.process_time()
    pii.find(unit * (200_000 // len(unit)))
    assert time.process_time() - began < 10


def test_awkward_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "a@b.co"), (3, "1.2.3.4"), (3, "1.2.3.4")]) \
        .selectExpr("*", "'x' AS spans", "7 AS n_email")
    rows = pii.personal_data(docs).collect()
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["spans"]) for r in rows), key=str)
    assert got == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (None, 1, 0, "email:0:6"),
                          (3, 0, 1, "ip:0:7"), (3, 0, 1, "ip:0:7")], key=str)
    assert pii.personal_data(make_docs([])).collect() == []
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    assert sorted(str(r["text"]) for r in masked.collect()) == [
        "", "None", "[EMAIL]", "[IP]", "[IP]"]


@pytest.mark.parametrize("text, kind", [
    ("+1 four 1 five 555 one 2 one 2", "phone"), ("plus 1 four 1 five 555 one 2 one 2", "phone"),
    ("192 dot 168 dot 0 dot 1", "ip"), ("call +1 four - one - five 555 one two one two", "phone"),
    ("plus one (four one five) five five five one two one two", "phone")])
def test_mixed_spellings_are_found_alone(text, kind):
    assert any(k == kind for k, _, _ in pii.find(text)[1])
    assert f"[{kind.upper()}]" in pii.masked(text)


def test_the_gate_never_changes_the_result(texts):
    rng = random.Random(1)
    bits = ["four", "1", "plus", "dot", "+", " - ", "(", ")", "at", "com", "x", "192", "[", "]", ".", "@",
            "O", "one", "&period;", "&#64;", "_at_", "<", ">", "\u017fix", "s\u0131x", "a",
            "%40", "。", "b.c", "email:", "\u00a0", "S\u0130X"]
    some = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 12)))
            for _ in range(5000)]
    for t in [*some, *texts.values()]:
        t, gated = t or "", pii.deobfuscated(t or "")
        assert (gated.text if gated else t) == pii.deobfuscated(t, always=True).text


@pytest.mark.parametrize("text, address", [
    ("mail maria at posta dot it now", "maria at posta dot it"),
    ("ivan at yandex dot ru", "ivan at yandex dot ru"), ("ana at uol dot com dot br", "ana at uol dot com dot br"),
    ("jan at poczta dot pl", "jan at poczta dot pl"), ("raj at mail dot in", "raj at mail dot in"),
    ("kim at tool dot dev", "kim at tool dot dev"), ("a at b dot museum", "a at b dot museum"),
    ("bo at firma punkt at", None), ("eva at firma punkt pl", "eva at firma punkt pl")])
def test_all_top_level_domains_end_an_address(text, address):
    found = [text[a:b] for k, a, b in pii.find(text)[1] if k == "email"]
    assert found == ([address] if address else [])


@pytest.mark.parametrize("text", [
    "look at the dot in the middle", "at this point in time", "it rained at some point it seems",
    "we were at that point people said", "she stood at knife point in May"])
def test_prose_with_words_that_are_domains_is_left_alone(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("text, kind, span", [
    ("bob @ example . com", "email", "bob @ example . com"), ("see bob @ example . co . uk.", "email", "bob @ example . co . uk"),
    ("bob＠example。com", "email", "bob＠example。com"), ("写信bob@example。com。", "email", "bob@example。com"),
    ("?m=bob%40example.com&x", "email", "bob%40example.com"), ("bob%40example%2Ecom", "email", "bob%40example%2Ecom"),
    ("ask ann.lee at example.com today", "email", "ann.lee at example.com"),
    ("Email: john at example.com", "email", "john at example.com"), ("write to john at mail.example.org", "email", "john at mail.example.org"),
    ("jօhո@example.com", "email", "jօhո@example.com"), ("Ꭺnn@example.com", "email", "Ꭺnn@example.com"),
    ("ᴊᴏᴇ@ᴀᴄᴍᴇ.ᴄᴏᴍ", "email", "ᴊᴏᴇ@ᴀᴄᴍᴇ.ᴄᴏᴍ"), ("bob﹫example․com", "email", "bob﹫example․com"),
    ("+1\u2011415\u2013555\u20111212", "phone", "+1\u2011415\u2013555\u20111212"),
    ("4539\u00a01488\u202f0343\u00a06467", "card", "4539\u00a01488\u202f0343\u00a06467")])
def test_spaced_encoded_and_look_alike_disguises(text, kind, span):
    assert (kind, span) in [(k, text[a:b]) for k, a, b in pii.find(text)[1]]
    assert f"[{kind.upper()}]" in pii.masked(text)


@pytest.mark.parametrize("text", [
    "we met at example.com yesterday", "sign up at github.com now", "see README.md at github.com", "contact us at example.com",
    "tickets @ the door . Come early", "he paid 5 @ 3 . 2 each", "50%40 off", "到了。com 是", "the end . De rest",
    "pages 12\u201315 and 1990\u20131995", "email works at example.com", "her\u00a0name\u2014Ann\u2014was"])
def test_prose_near_the_new_disguises_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_planted_disguises_are_recalled():
    """Of 2,000 addresses and numbers, each in one disguise within prose, nearly all are found
    whole, and the prose alone gives nothing."""
    rng = random.Random(5)
    names = "anna bob carla dmitri elena farid grace hugo ines jan".split()
    hosts = ["example.com", "mail.example.org", "firma.de", "correo.es", "posta.it", "uni.ac.uk", "shop.net"]
    alike = str.maketrans("aeopcx", "аеорсх")
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    prose = "the old house near the river was sold at last and nobody knew why it had taken so long".split()
    email = [lambda u, h: f"{u} [at] {h.replace('.', ' [dot] ')}", lambda u, h: f"{u} at {h.replace('.', ' dot ')}",
             lambda u, h: f"{u} @ {h.replace('.', ' . ')}", lambda u, h: f"{u}%40{h}", lambda u, h: f"{u}&#64;{h}",
             lambda u, h: f"{u}@{h}".translate(alike), lambda u, h: f"{u}＠{h.replace('.', '。')}",
             lambda u, h: "".join(chr(ord(c) + 0xFEE0) for c in f"{u}@{h}"), lambda u, h: f"{u}.lee at {h}",
             lambda u, h: f"{u}_at_{h.replace('.', '_dot_')}", lambda u, h: f"{u[0]}\u200b{u[1:]}@{h}"]
    phone = [lambda d: "plus " + " ".join(words[int(c)] for c in d), lambda d: "+" + "\u2011".join([d[:2], d[2:5], d[5:]]),
             lambda d: "＋" + "".join(chr(ord(c) + 0xFEE0) for c in d), lambda d: f"+{d[:2]} {words[int(d[2])]} {d[3:]}"]
    hit = 0
    for i in range(2000):
        if i % 4:
            kind, said = "email", rng.choice(email)(rng.choice(names), rng.choice(hosts))
        else:
            kind, said = "phone", rng.choice(phone)("49" + "".join(rng.choice("123456789") for _ in range(9)))
        left, right = (" ".join(rng.sample(prose, 6)) for _ in range(2))
        assert pii.find(f"{left}. {right}") == ([], [])
        text = f"{left}: {said} , {right}"
        at = len(left) + 2
        hit += (kind, at, at + len(said)) in pii.find(text)[1]
    assert hit >= 1900, hit
