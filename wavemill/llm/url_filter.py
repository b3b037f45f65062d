"""URL filters by a bit-parallel wildcard automaton.

All glob rules are laid side by side, a bit for each of their characters, in as many
64-bit words as they need.  One pass over a canonical URL advances every rule at once:
shift the active bits, keep those whose character fits, and let stars hold theirs.
In a glob ``*`` stands for any run of characters but ``/``, ``**`` for any run, ``?`` for
one character, and every other character for itself; a glob covers the whole canonical
URL, which is a dot, the host in lower case, the path, and the query if there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE = np.uint64(1)
# Longer URLs go one by one through the same automaton as Python integers.
LONG = 4096
SCHEMA = "page_id long, host string, path string, rule string, verdict string, globs string"


@dataclass(frozen=True)
class HostRule:
    """Fits a host, all its subdomains, and the paths that start with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


# Fixed values of the query.
HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)
# Block list where no host rule fits: tracking parameters, log-in pages, media files.
DEFAULT_GLOBS = ("**?utm_source=**", "**&utm_source=**", "**/login**", "**/cart/**", "**.jpg", "**.png", "**.zip", "**.exe")
ESCAPE = "\\"


def parse_glob(glob: str) -> list[tuple[str, str]]:
    """Tokens: ('char', c), ('one', ''), ('star', '') and ('any', '')."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == ESCAPE and i + 1 < len(glob):
            out.append(("char", glob[i + 1]))
            i += 2
        elif glob[i : i + 2] == "**":
            out.append(("any", ""))
            i += 2
        else:
            out.append({"*": ("star", ""), "?": ("one", "")}.get(c, ("char", c)))
            i += 1
    return out


class Automaton:
    """Bit s of the state is set while the rule that owns s has matched as far as token s.

    A rule of n tokens that consume a character takes n + 1 bits; its stars are loops on
    the bit before them."""

    def __init__(self, globs):
        self.globs = list(globs)
        starts, self.final, chars, ones, star, any_ = 0, [], {}, 0, 0, 0
        at = 0
        for glob in self.globs:
            starts |= 1 << at
            for kind, c in parse_glob(glob):
                if kind == "star":
                    star |= 1 << at
                elif kind == "any":
                    any_ |= 1 << at
                else:
                    at += 1
                    if kind == "char":
                        chars[c] = chars.get(c, 0) | 1 << at
                    else:
                        ones |= 1 << at
            self.final.append(at)
            at += 1
        self.bits, self.words = at, -(-at // 64)
        self.start, self.any, self.star = starts, any_, star
        # For a character: the bits that a shift may enter, and those that hold.
        self.enter = {c: m | ones for c, m in chars.items()}
        self.other = ones
        self.hold = lambda c: any_ | (0 if c == "/" else star)
        self.codes = {ord(c): i + 1 for i, c in enumerate(sorted(set(chars) | {"/"}))}
        table = [(self.other, self.any | self.star)] + [(self.enter.get(chr(c), self.other), self.hold(chr(c))) for c in self.codes]
        self.enter_words = self._split([x for x, _ in table])
        self.hold_words = self._split([x for _, x in table])
        self.start_words = self._split([starts])[0]

    def _split(self, masks):
        return np.array([[(m >> 64 * w) & (2**64 - 1) for w in range(self.words)] for m in masks], np.uint64)

    def run_one(self, url: str) -> list[bool]:
        state = self.start
        for c in url:
            state = (state << 1) & self.enter.get(c, self.other) | state & self.hold(c)
            if not state:
                break
        return [bool(state >> f & 1) for f in self.final]

    def run(self, urls: list[str]) -> np.ndarray:
        """A row of flags, one for each glob, for every URL; columns of characters at a time."""
        out = np.zeros((len(urls), len(self.globs)), bool)
        short = [i for i, u in enumerate(urls) if len(u) <= LONG]
        for i, u in enumerate(urls):
            if len(u) > LONG:
                out[i] = self.run_one(u)
        short.sort(key=lambda i: -len(urls[i]))
        if not short or not self.globs:
            return out
        lengths = np.array([len(urls[i]) for i in short])
        points = np.frombuffer("".join(urls[i] for i in short).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.array(sorted(self.codes), np.uint32)
        place = np.minimum(np.searchsorted(known, points), len(known) - 1)
        ids = np.array([self.codes[k] for k in known.tolist()])[place]
        ids[known[place] != points] = 0
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.tile(self.start_words, (len(short), 1))
        for pos in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -pos, "left"))  # URLs that still have a character
            c = ids[begin[:n] + pos]
            s = state[:n]
            moved = s << ONE
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = moved & self.enter_words[c] | s & self.hold_words[c]
        for g, f in enumerate(self.final):
            out[short, g] = (state[:, f // 64] >> np.uint64(f % 64) & ONE).astype(bool)
        return out


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path and query; all empty for null or a URL without ``://``."""
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].translate(ASCII_LOWER), rest[cut:].split("#", 1)[0]
    path, mark, query = tail.partition("?")
    return host, path, mark + query


def escape(text: str) -> str:
    return "".join(ESCAPE + c if c in "*?" + ESCAPE else c for c in text)


def filter_urls(pages: DataFrame, rules=HOST_RULES, globs=DEFAULT_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the longest host rule that fits (else null), the verdict
    (that rule's; else block if a glob fits, or allow), and the globs that fit.

    Of rules of one length the first in the list wins.  Null, empty and malformed URLs have
    an empty host and path and are allowed; repeated rows and null ids stay as they are."""
    rules = sorted(rules, key=lambda r: -len(r.name))
    # Default globs see a full URL, where '?' begins the query: a leading '?' is literal.
    plain = [g.replace("?", ESCAPE + "?") for g in globs]
    # Host rules see host and path only, so that nothing in a query passes for either.
    hosts, machine = Automaton([f"*.{escape(r.host)}{escape(r.path)}**" for r in rules]), Automaton(plain)

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = hosts.run(["." + h + p if h or p else "" for h, p, _ in parts]).tolist()
            hits = machine.run(["." + h + p + q if h or p or q else "" for h, p, q in parts]).tolist()
            rule, verdict, which = [], [], []
            for on_host, row in zip(fits, hits):
                best = next((r for r, hit in zip(rules, on_host) if hit), None)
                fit = [g for g, hit in zip(globs, row) if hit]
                rule.append(best.name if best else None)
                verdict.append(best.verdict if best else "block" if fit else "allow")
                which.append(" ".join(fit))
            cols = [[h for h, _, _ in parts], [p for _, p, _ in parts], rule, verdict, which]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict", "globs"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(judge, SCHEMA)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL
    ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path,
    coalesce(regexp_extract(rest, '^[^#]*'), '') AS whole
  FROM u
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
), g AS (
  SELECT *, '.' || host || path || CASE WHEN strpos(whole, '?') > 0 THEN substr(whole, strpos(whole, '?')) ELSE '' END AS canon FROM r
), h AS (
  SELECT *, concat_ws(' ',
    CASE WHEN canon LIKE '%?utm!_source=%' ESCAPE '!' THEN '**?utm_source=**' END,
    CASE WHEN canon LIKE '%&utm!_source=%' ESCAPE '!' THEN '**&utm_source=**' END,
    CASE WHEN canon LIKE '%/login%' THEN '**/login**' END,
    CASE WHEN canon LIKE '%/cart/%' THEN '**/cart/**' END,
    CASE WHEN canon LIKE '%.jpg' THEN '**.jpg' END,
    CASE WHEN canon LIKE '%.png' THEN '**.png' END,
    CASE WHEN canon LIKE '%.zip' THEN '**.zip' END,
    CASE WHEN canon LIKE '%.exe' THEN '**.exe' END) AS globs FROM g
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN globs <> '' THEN 'block' ELSE 'allow' END AS verdict, globs
FROM h
"""
