"""Personal data with offset-preserving deobfuscation (operator 2).

Four kinds are found by their plain patterns first. Disguised ones are found
behind a chain of transducers, each of which rewrites the text and carries, for
every character it puts out, the source characters it stands for:

1. characters: homoglyphs, full-width and other digits and letters to ASCII,
   odd blanks and dashes between digits, invisible characters dropped;
2. spelled digits ("four one five", in four languages, with "plus" and "dot");
3. spaced addresses ("x @ y . z"), ideographic dots;
4. "at" and "dot" disguises ("x [at] y (dot) z", "x at y dot z", entities, "%40").

A bare "at" before a plain domain names a place more often than an address, so it
counts behind a local part of two names ("ann.lee at y.org") or a cue ("email: ann at
y.org") only.

The plain patterns run on the rewritten text and their spans are mapped back to
code points of the source. A mapped span is added unless a plain one of its kind
already covers it; plain spans always stay. Spans are found per row by one Arrow
UDF that reads the text only.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import document_batches, table
from .tlds import TLDS

KINDS = ("email", "ip", "card", "phone")

# The four plain patterns. Possessive digits and the look-behind change nothing
# about what matches; they keep a long run without a match linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DOTTED.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text)
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Look-alikes of ASCII letters in Cyrillic, Greek, Armenian, Cherokee and
# phonetic letters; dashes.
_LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏѵүΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρτυχ"
    "օսհոզցՕՏՍᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃɑɡɩıſ"
    "‐‑‒–—―−",
    "ABESIJKMHOPCTYXaesijopcyxdqwhlvyABEZHIKMNOPTYXoavikptux"
    "ouhnqgOSUABCDEGHJKLMPRSTVWZagiis"
    "-------")
# Small capitals, by their names.
_LOOKALIKES.update({c: m[1].lower() for c in range(0x1D00, 0x1D23) for m in
                    [re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(c)))] if m})
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Ranges in which a character may stand for an ASCII one.
_ODD = re.compile("[\u00ad\u0131\u017f\u0250-\u02af\u0370-\u0587\u0660-\u0669\u06f0-\u06f9\u0966-\u096f"
                  "\u13a0-\u13f5\u1d00-\u1d22\u200b-\u200d\u2024\u2060\u2070-\u209c\u2460-\u24ff\ufe50-\ufe6b"
                  "\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]"
                  "|[\u00a0\u2000-\u200a\u202f\u2010-\u2015\u2212](?<=[0-9)].)(?=[0-9(])", re.S)
# Digit words in English, French, German and Spanish.
DIGIT_WORDS = {
    **dict.fromkeys("zero oh zéro null cero".split(), "0"),
    **dict.fromkeys("one un eins uno".split(), "1"),
    **dict.fromkeys("two deux zwei dos".split(), "2"),
    **dict.fromkeys("three trois drei tres".split(), "3"),
    **dict.fromkeys("four quatre vier cuatro".split(), "4"),
    **dict.fromkeys("five cinq fünf cinco".split(), "5"),
    **dict.fromkeys("six sechs seis".split(), "6"),
    **dict.fromkeys("seven sept sieben siete".split(), "7"),
    **dict.fromkeys("eight huit acht ocho".split(), "8"),
    **dict.fromkeys("nine neuf neun nueve".split(), "9"),
}
def _any_of(words) -> str:
    """A pattern of any of the words, branching by character."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        branches = [re.escape(c) + pattern(at[c]) for c in sorted(at) if c]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)})" + ("?" if "" in at else "")

    return pattern(tree)


_WORD = _any_of(DIGIT_WORDS)
_AT, _DOT = "(?:at|arobase|arroba)", "(?:dot|point|punkt|punto)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# These patterns read the folded text. A look-ahead on first letters spares most words
# the long alternation.
_FIRST = "[" + "".join(sorted({w[0] for w in DIGIT_WORDS})) + "]"
_TOKEN = rf"(?:\b(?={_FIRST}){_WORD}\b|(?<![0-9])[0-9]++)"
_GAP = rf"(?:\s+{_DOT}\s+|[\s,.()\[\]-]{{1,4}})"
_SPELLED = re.compile(rf"(?:\bplus\s+)?{_TOKEN}(?:{_GAP}{_TOKEN}){{2,}}")
_SPELLED_PART = re.compile(rf"(plus\s+)|({_WORD})\b|([0-9]+)|(\s+{_DOT}\s+)|([\s,.()\[\]-]+)")
_MARKED_DOT = rf"(?:\s*{_OPEN}\s*(?:{_DOT}|\.)\s*{_CLOSE}\s*|_{_DOT}_|&(?:\#0*46|\#x2e|period);|%2e)"
_MARKED_AT = rf"(?:\s*{_OPEN}\s*(?:{_AT}|@)\s*{_CLOSE}\s*|_{_AT}_|&(?:\#0*64|\#x40|commat);|%40)"


# Bare words are prose unless they lead to a top-level domain. Those that are also words
# (long ones, and these codes) count only behind "dot" and a label that is no determiner.
_WORD_CODES = frozenset("ad am as at be by do et id in is it la ma me my ne ni no pa pm sa se so "
                        "su to tu".split())
_CLEAR = {t for t in TLDS if len(t) == 2 or t.startswith("xn--")} - _WORD_CODES | frozenset(
    "com org net edu gov mil info biz example dev app xyz".split())
_TLD, _ANY_TLD = _any_of(_CLEAR), _any_of(TLDS | _CLEAR)
_DETERMINER = (r"(?:an?|the|this|that|these|those|some|any|no|one|each|every|which|what|his|her|its|"
               r"their|our|my|your|another|either)\b(?!-)")
_BARE_DOT = rf"\s+{_DOT}\s+"
_ANY_DOT = rf"(?:{_MARKED_DOT}|{_BARE_DOT})"
_REST = rf"(?:[a-z0-9-]+(?:{_ANY_DOT}|\.)){{0,8}}{_TLD}\b"
_SAID_DOT = rf"(?:{_MARKED_DOT}|\s+dot\s+)"
_SAID_REST = rf"(?:[a-z0-9-]+(?:{_SAID_DOT}|\.)){{0,8}}{_ANY_TLD}\b"
_DISGUISE = re.compile(
    rf"(?<=[a-z0-9])(?:(?P<at>{_MARKED_AT}|\s+{_AT}\s+(?:(?=[a-z0-9-]+{_ANY_DOT}{_REST})"
    rf"|(?!{_DETERMINER})(?=[a-z0-9-]+{_SAID_DOT}{_SAID_REST}))|\s+@\s+(?=[a-z0-9]))"
    rf"|(?P<dot>{_MARKED_DOT}|{_BARE_DOT}(?={_REST})|\s+dot\s+(?={_SAID_REST})))(?=[a-z0-9])")
# What every text holds that the patterns above match: a sign, or a word for a dot that leads
# to a domain; a digit word beside another token, or a word for a dot between digits.
_SIGNS = tuple("@ %40 %2e _at_ _arobase_ _arroba_ _dot_ _point_ _punkt_ _punto_ &# &period; &commat;".split())
_BRACKETED = re.compile(rf"{_OPEN}\s*(?:{_AT}|{_DOT}|[@.])\s*{_CLOSE}")
_LEADING_DOT = re.compile(rf"{_DOT}\s+(?=(?:[a-z0-9-]+(?:{_ANY_DOT}|\.)){{0,8}}{_ANY_TLD}\b)")
_WORD_FIRST = re.compile(rf"{_WORD}\b{_GAP}{_TOKEN}")
_DIGIT_FIRST = re.compile(rf"[0-9](?:{_GAP}{_WORD}\b|\s+{_DOT}\s+[0-9])")
# An address whose dots all stand between the same blanks, or are ideographic.
_LABEL = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_SPACED = re.compile(
    rf"(?<=[a-z0-9])(?P<at>[ \t]{{0,3}}@[ \t]{{0,3}}|{_MARKED_AT}){_LABEL}(?P<dot>[ \t]{{1,3}}\.[ \t]{{1,3}}|[。｡])"
    rf"(?:{_LABEL}(?P=dot)){{0,7}}?(?:(?:com?|org|ac|gov|net|edu)(?P=dot)[a-z]{{2}}|{_TLD})\b(?!-)")
# A bare "at" before a plain domain, and what must stand before it.
_AT_DOMAIN = rf"{_AT}\s{{1,3}}(?=(?:{_LABEL}\.){{1,8}}{_TLD}\b(?!-))"
_PLAIN_AT = re.compile(rf"(?<=[a-z0-9])\s{{1,3}}{_AT_DOMAIN}")
_LEADING_AT = re.compile(_AT_DOMAIN)
_FILES = "bmp c conf cpp css csv doc docx exe gif go h html java jpg js json md pdf php png ppt py rb rs sh sql txt xls xml yml zip"
_NAMED = re.compile(r"(?<![a-z0-9._%+-])[a-z]+[0-9]*(?:[._][a-z]{2,}[0-9]*)+\Z")
_FILE = re.compile(rf"\.(?:{'|'.join(_FILES.split())})\Z")
_CUED = re.compile(r"\b(?:(?:e-?mail|mail|contact|courriel|correo)(?:\s+address)?\s*(?::|=)|(?:e-?mail|mail)\s+address\s+is"
                   r"|(?:e-?mail|write|mail)\s+(?:to|(?:me|us|him|her|them)\s+at))\s*[a-z0-9._%+-]+\Z")
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl]{1,3}(?=[0-9])")


def fold(text: str) -> str:
    """The text in lower case, of the same length, dotless i and long s folded too."""
    if text.isascii():
        return text.lower()
    return text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s")


class Mapped:
    """A rewritten text; character ``i`` stands for source ``[starts[i], ends[i])``."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, put, folded: bool = False) -> None:
        """Replace each match by the (piece, from, to) that ``put`` gives: every
        character of a piece stands for the match's characters from..to. ``folded``
        patterns read the text in lower case."""
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(fold(self.text) if folded else self.text):
            pieces = put(m)
            if pieces is None:
                continue
            a, b = m.span()
            out.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            for piece, f, t in pieces:
                out.append(piece)
                starts += [self.starts[f]] * len(piece)
                ends += [self.ends[t - 1]] * len(piece)
            at = b
        if at:
            self.text = "".join([*out, self.text[at:]])
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def _character(m):
    c = m[0]
    if c in _INVISIBLE:
        return []
    plain = unicodedata.normalize("NFKC", c).translate(_LOOKALIKES)
    if not plain.isascii():
        digit = unicodedata.decimal(c, None)
        if digit is None:
            return None
        plain = str(digit)
    return [(plain, m.start(), m.end())]


def _spelled(m):
    parts = [(p.lastindex, p[0], m.start() + p.start(), m.start() + p.end())
             for p in _SPELLED_PART.finditer(m[0])]
    if not any(k in (2, 4) for k, *_ in parts):      # a digit word, or a dot word
        return None
    out = []
    for at, (k, s, a, b) in enumerate(parts):
        beside = {parts[j][0] for j in (at - 1, at + 1) if 0 <= j < len(parts)}
        if k == 1:
            out.append(("+", a, a + 4))
        elif k == 2:
            out.append((DIGIT_WORDS[s], a, b))
        elif k == 4 or k == 5 and s.strip() == ".":
            out.append((".", a, b))
        elif k == 3 or 2 not in beside:      # digits, and what stands between digits
            out += [(c, a + i, a + i + 1) for i, c in enumerate(s)]
    return out


def _spaced(m):
    """The address without its blanks, every other character in its place."""
    at, from_ = m.start(), m.start("at")
    out = [("@", from_, m.end("at"))]
    for i, c in enumerate(m[0][m.end("at") - at:], m.end("at")):
        if c in ".。｡":
            out.append((".", i, i + 1))
        elif c not in " \t":
            out.append((c, i, i + 1))
    return out


def _plain_at(m):
    before = m.string[max(0, m.start() - 120):m.start()]
    if _CUED.search(before) or (_NAMED.search(before) and not _FILE.search(before)):
        return [("@", *m.span())]
    return None


def _disguise(m):
    return [("@" if m["at"] else ".", *m.span())]


def _acts(text: str) -> bool:
    """Whether a transducer finds anything in the text as it is; where none does, none can."""
    if not text.isascii() and _ODD.search(text) or _LETTER_DIGIT.search(text):
        return True
    low = fold(text)
    signs = any(s in low for s in _SIGNS) or _BRACKETED.search(low)
    return bool((signs or _LEADING_DOT.search(low)) and _DISGUISE.search(low)
                or signs and _SPACED.search(low) or _LEADING_AT.search(low) and any(map(_plain_at, _PLAIN_AT.finditer(low)))
                or (_WORD_FIRST.search(low) or _DIGIT_FIRST.search(low))
                and any(map(_spelled, _SPELLED.finditer(low))))


def deobfuscated(text: str, always: bool = False) -> Mapped | None:
    """The text behind the transducers, or None where none of them can act: the
    patterns themselves say so, as the first that acts finds the text as it is
    (``always`` runs them all the same)."""
    if not (always or _acts(text)):
        return None
    m = Mapped(text)
    m.rewrite(_ODD, _character)
    m.rewrite(_SPELLED, _spelled, folded=True)
    m.rewrite(_SPACED, _spaced, folded=True)
    m.rewrite(_PLAIN_AT, _plain_at, folded=True)
    m.rewrite(_DISGUISE, _disguise, folded=True)
    m.rewrite(_LETTER_DIGIT, lambda x: [("0" if c in "Oo" else "1", x.start() + i, x.start() + i + 1)
                                        for i, c in enumerate(x[0])])
    return m


def added_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source code points."""
    m = deobfuscated(text)
    if m is None or m.text == text:
        return []
    out = set()
    for kind, a, b in plain_spans(m.text):
        s, e = m.starts[a], m.ends[b - 1]
        if not any(k == kind and x <= s and e <= y for k, x, y in plain):
            out.add((kind, s, e))
    return list(out)


def find(text: str | None) -> tuple[list, list]:
    """(plain spans, all spans), each by start, then kind. Null: as empty."""
    plain = plain_spans(text or "")
    every = plain + added_spans(text or "", plain)
    return plain, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping
    spans are one, named after the first."""
    if not text:
        return text
    out, at, end = [], 0, -1
    for kind, a, b in find(text)[1]:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                      T.StructField("base_sha256", T.StringType()),
                      T.StructField("spans", T.StringType()),
                      T.StructField("n_added", T.LongType())])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, the counts and the digest of the plain
    spans, all spans, and how many the transducers added. A null or empty text
    has none. Ids are carried as they are; other columns are not read."""
    document_batches(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            plain, every = find(text)
            kinds = [k for k, _, _ in plain]
            rows.append([*(kinds.count(k) for k in KINDS),
                         hashlib.sha256(_join(plain).encode()).hexdigest(), _join(every),
                         len(every) - len(plain)])
        return pd.DataFrame(rows, columns=FOUND.names)

    return docs.select(F.col(id_col).alias("doc_id"), look(F.col(text_col)).alias("f")) \
        .select("doc_id", "f.*")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` masked; all else as it is."""
    document_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def mask_texts(texts: pd.Series) -> pd.Series:
        return texts.map(masked)

    return docs.withColumn(text_col, mask_texts(F.col(text_col)))


def query(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii_deobfuscation": query}
