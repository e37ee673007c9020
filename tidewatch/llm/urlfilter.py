"""URL filtering with a bit-parallel wildcard automaton (operator 9).

All glob rules are packed into one multiword Shift-And automaton: rule positions
are consecutive bits, a wildcard is a self-loop on its position, and one step on a
byte advances every rule at once: ``D = ((D & B[c]) << 1) | (D & L[c])`` with the
carry passed from word to word. Rules are anchored at both ends. A batch of URLs
is stepped together, longest first, so each step touches the open URLs only.

Globs match the canonical URL, host (A-Z lower-cased) and path without scheme,
query and fragment: ``*`` is any run without ``/``, ``**`` any run, ``?`` one
character other than ``/`` (bytes of its UTF-8 form; a host holds no ``/``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Host rules (verdict, rule): a host and all its subdomains, with a path prefix.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
              ("allow", "org/fr/"))
# Globs (verdict, pattern) that judge a URL which no host rule fits: advertising,
# tracking, sessions, log-ins, carts and files that are no text. Nothing: allow.
GLOBS = (
    ("block", "ads.**"), ("block", "*.ads.**"), ("block", "**/ads/**"), ("block", "**/adserver/**"),
    ("block", "tracker.**"), ("block", "**/tracking/**"), ("block", "**/pixel.gif"),
    ("block", "**/cgi-bin/**"), ("block", "**/login/**"), ("block", "**/login"),
    ("block", "**/signup"), ("block", "**/cart/**"), ("block", "**/checkout/**"),
    ("block", "**.exe"), ("block", "**.zip"), ("block", "**.gz"), ("block", "**.jpg"),
    ("block", "**.jpeg"), ("block", "**.png"), ("block", "**.gif"), ("block", "**.mp?"),
    ("block", "**.css"), ("block", "**.js"), ("allow", "**/robots.txt"),
)


def host_globs(rule: str) -> list[str]:
    """The globs of a host rule ``host/path``: the host itself, its subdomains."""
    return [f"{rule}**", f"*.{rule}**"]


class Automaton:
    """Shift-And masks of a list of globs, and the match of a batch of URLs."""

    def __init__(self, globs: list[str]):
        states = []                # per state: (bytes of its item or None, loop or None)
        self.final, first = [], []
        slash = ord("/")
        for glob in globs:
            first.append(len(states))
            data, at, loop = glob.encode(), 0, None
            while at < len(data):
                if data[at:at + 2] == b"**":
                    loop, at = "any", at + 2
                elif data[at:at + 1] == b"*":
                    loop, at = loop or "part", at + 1
                else:
                    states.append((data[at], loop))
                    loop, at = None, at + 1
            self.final.append(len(states))
            states.append((None, loop))
        words = max(1, -(-len(states) // 64))
        step = np.zeros((256, words * 64), dtype=bool)
        stay = np.zeros((256, words * 64), dtype=bool)
        for s, (item, loop) in enumerate(states):
            if item == ord("?"):
                step[:, s] = True
                step[slash, s] = False
            elif item is not None:
                step[item, s] = True
            if loop:
                stay[:, s] = True
                stay[slash, s] = loop == "any"
        start = np.zeros((1, words * 64), dtype=bool)
        start[0, first] = True
        self.step, self.stay, self.start = (self._pack(x) for x in (step, stay, start))

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def matches(self, urls: list[str]) -> np.ndarray:
        """(url, glob) -> whether the whole URL matches."""
        data = [u.encode("utf-8", "replace") for u in urls]
        size = np.array([len(d) for d in data], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        text = np.frombuffer(b"".join(data), dtype=np.uint8)
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        live = np.repeat(self.start, len(data), axis=0)
        open_rows = len(data)
        for t in range(int(size[0]) if len(size) else 0):
            while size[open_rows - 1] <= t:
                open_rows -= 1
            c = text[begin[:open_rows] + t]
            d = live[:open_rows]
            go = d & self.step[c]
            carry = go >> np.uint64(63)
            go <<= np.uint64(1)
            go[:, 1:] |= carry[:, :-1]
            live[:open_rows] = go | (d & self.stay[c])
        bits = np.unpackbits(live.view(np.uint8), axis=1, bitorder="little")
        out = np.empty((len(data), len(self.final)), dtype=bool)
        out[order] = bits[:, self.final].astype(bool)
        return out


def judge(urls: list[str], host_rules=HOST_RULES, globs=GLOBS) -> list[tuple]:
    """(rule or None, verdict) of each canonical URL. Of the host rules that fit the
    longest wins, of equally long ones the first; without one, the longest glob;
    without any, allow."""
    owners = [k for k, (_, r) in enumerate(host_rules) for _ in host_globs(r)]
    auto = Automaton([g for _, r in host_rules for g in host_globs(r)] + [g for _, g in globs])
    hit = auto.matches(urls)
    ranked = sorted(range(len(host_rules)), key=lambda k: (-len(host_rules[k][1]), k))
    loose = sorted(range(len(globs)), key=lambda k: (-len(globs[k][1]), k))
    out = []
    for row in hit:
        own = {k for k, h in zip(owners, row) if h}
        fits = next((k for k in ranked if k in own), None)
        if fits is not None:
            out.append((host_rules[fits][1], host_rules[fits][0]))
            continue
        free = next((k for k in loose if row[len(owners) + k]), None)
        out.append((None, "allow" if free is None else globs[free][0]))
    return out


def host_and_path(url):
    """Columns of the host (A-Z lower-cased) and path; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


VERDICT = T.StructType([T.StructField("rule", T.StringType()),
                        T.StructField("verdict", T.StringType())])


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                host_rules=HOST_RULES, globs=GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``. A null or
    empty URL has an empty host and path, no rule and the globs' verdict. Ids are
    carried as they are, repeated rows as often; other columns are not read."""
    @F.pandas_udf(VERDICT)
    def look(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge((hosts + paths).tolist(), host_rules, globs),
                            columns=VERDICT.names)

    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")) \
        .withColumn("v", look("host", "path")).select("page_id", "host", "path", "v.*")


def query(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def _regex(glob: str) -> str:
    """The glob as an anchored regular expression (for the oracle)."""
    out, at = [], 0
    while at < len(glob):
        if glob[at:at + 2] == "**":
            out.append("(?:.|\\n)*")
            at += 1
        elif glob[at] == "*":
            out.append("[^/]*")
        elif glob[at] == "?":
            out.append("[^/]")
        else:
            out.append("\\" + glob[at] if not glob[at].isalnum() else glob[at])
        at += 1
    return "".join(out)


def _case(rules, of, at) -> str:
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    return " ".join(f"WHEN {of(rules[k][1])} THEN '{rules[k][at]}'" for k in ranked)


def _host_fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return (f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '/{path}')")


ORACLE = {"op9_url_filter": f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {_case(HOST_RULES, _host_fits, 1)} END AS rule,
       CASE {_case(HOST_RULES, _host_fits, 0)}
            {_case(GLOBS, lambda g: f"regexp_full_match(host || path, '{_regex(g)}')", 0)}
            ELSE 'allow' END AS verdict
FROM p"""}

QUERIES = {"op9_url_filter": query}
