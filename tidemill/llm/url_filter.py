"""URL filters by a bit-parallel wildcard automaton (extended Shift-And).

All glob rules are laid out one after another in a multiword bit vector; bit i
stands for "the first tokens of its rule, up to this one, are matched". One
step per URL byte moves every rule of every URL of a batch at once:

    D = (((D << 1) & ~FIRST) | START) & B[byte]  |  D & STAY

where STAY holds the bits that a ``*`` follows, and the shift carries between
words. ``?`` is one character, ``*`` any run of characters, also none; a
backslash makes the next character literal. A rule must match the whole
canonical URL.

Cases: a null URL has a null canonical form, matches no rule and is not
blocked; an empty one is matched by rules of stars only. Repeated rows are
judged one by one. Very long URLs are processed whole. Other columns of the
table are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read
from tidemill.llm.kernels import flat

#: (rule id, action, glob). An allow rule overrides block rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("pills", "block", "*://*pills.*"),
    ("bets", "block", "*://*bets.*"),
    ("casino", "block", "*casino*"),
    ("adult", "block", "*://*adult*.*/*"),
    ("xxx_tld", "block", "*://*.xxx/*"),
    ("loans", "block", "*payday*loan*"),
    ("replica", "block", "*replica-?*watch*"),
    ("warez", "block", "*://*/warez/*"),
    ("torrent", "block", "*.torrent"),
    ("login", "block", "*/login*"),
    ("signup", "block", "*/signup*"),
    ("cart", "block", "*/cart/*"),
    ("checkout", "block", "*/checkout*"),
    ("wp_admin", "block", "*/wp-admin/*"),
    ("cgi", "block", "*/cgi-bin/*"),
    ("calendar", "block", "*/calendar/????/??/*"),
    ("session", "block", "*?sid=*"),
    ("print", "block", "*print=1*"),
    ("paging", "block", "*?page=*"),
    ("jpg", "block", "*.jpg"),
    ("png", "block", "*.png"),
    ("zip", "block", "*.zip"),
    ("exe", "block", "*.exe"),
    ("ftp", "block", "ftp://*"),
    ("data_uri", "block", "data:*"),
    ("ip_host", "block", "*://???.???.???.???/*"),
    ("proxy", "block", "*proxy*?url=http*"),
    ("mirror", "block", "*://mirror?.*"),
    ("tracker", "block", "*://track*.*/click/*"),
    ("spin", "block", "*free*spin*bonus*"),
    ("forum_member", "block", "*/member.php*"),
    ("tagcloud", "block", "*/tag/*/page/*"),
    ("old_de", "block", "*.example.org/de/1??"),
    ("docs", "allow", "*/docs/*"),
    ("edu", "allow", "*://*.edu/*"),
    ("licensed", "allow", "*://*pills.example.com/en/1*.html"),
)

_SPLIT = "(?s)^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)(.*)$"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, www., default port, tracking parameters or last slash."""
    u = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.lower(F.regexp_extract(u, _SPLIT, 1))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, _SPLIT, 2)), "^www[.]", ""), ":(80|443)$", "")
    tail = F.regexp_replace(F.regexp_extract(u, _SPLIT, 3), "([?&])(utm_[^&]*|ref=[^&]*|fbclid=[^&]*)", "$1")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "[?]&+", "?"), "&&+", "&"), "[?&/]+$", "")
    return F.concat(head, host, tail)


_CANON_SQL = f"""SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_extract(u, '{_SPLIT}', 3), '([?&])(utm_[^&]*|ref=[^&]*|fbclid=[^&]*)', '\\1', 'g'), '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&/]+$', '') AS tail,
  lower(regexp_extract(u, '{_SPLIT}', 1)) || regexp_replace(regexp_replace(lower(regexp_extract(u, '{_SPLIT}', 2)), '^www[.]', ''), ':(80|443)$', '') AS head
  FROM (SELECT page_id, url, regexp_replace(url, '(?s)#.*$', '') AS u FROM pages)"""


def tokens(glob: str) -> tuple[list[int | None], set[int]]:
    """Bytes of the glob (None: any one character) and the places before which a star stands."""
    out: list[int | None] = []
    stars: set[int] = set()
    it = iter(glob)
    for ch in it:
        if ch == "*":
            stars.add(len(out))
        elif ch == "?":
            out.append(None)
        else:
            out.extend((next(it, "\\") if ch == "\\" else ch).encode())
    return out, stars


class Automaton:
    """All rules as masks over one multiword state vector."""

    def __init__(self, globs: Sequence[str]):
        parts = [tokens(g) for g in globs]
        self.n_rules = len(globs)
        bits = sum(len(t) for t, _ in parts)
        self.words = max(1, -(-bits // 64))
        z = lambda *n: np.zeros((*n, self.words), np.uint64)
        self.B, self.first, self.start0, self.start, self.stay, self.cont = z(256), z(), z(), z(), z(), z()
        self.last = np.zeros(self.n_rules, np.int64)
        self.empty = np.zeros(self.n_rules, bool)  # rules without a character to match
        self.all = np.zeros(self.n_rules, bool)
        at = 0
        for r, (toks, stars) in enumerate(parts):
            if not toks:
                self.empty[r], self.all[r] = True, bool(stars)
                continue
            for i, t in enumerate(toks):
                w, b = divmod(at + i, 64)
                m = np.uint64(1 << b)
                if t is None:
                    self.B[:0x80, w] |= m
                    self.B[0xC0:, w] |= m
                    self.cont[w] |= m
                else:
                    self.B[t, w] |= m
                if i + 1 in stars:
                    self.stay[w] |= m
                if i == 0:
                    self.first[w] |= m
                    self.start0[w] |= m
                    if 0 in stars:
                        self.start[w] |= m
            at += len(toks)
            self.last[r] = at - 1

    def match(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """hits[text, rule] for each text of a flat buffer."""
        n, size = len(off) - 1, np.diff(off)
        order = np.argsort(-size, kind="stable")
        ln, at = size[order], off[:-1][order]
        D = np.zeros((n, self.words), np.uint64)
        keep = ~self.first
        for j in range(int(ln[0]) if n else 0):
            live = int(np.searchsorted(-ln, -j, side="left"))
            d, c = D[:live], buf[at[:live] + j]
            s = d << np.uint64(1)
            s[:, 1:] |= d[:, :-1] >> np.uint64(63)
            s &= keep
            s |= self.start0 if j == 0 else self.start
            s &= self.B[c]
            stay = d & self.stay
            more = (c & 0xC0) == 0x80
            if more.any():
                stay[more] |= d[more] & self.cont
            D[:live] = s | stay
        hits = np.empty((n, self.n_rules), bool)
        hits[order] = (D[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1) == 1
        hits[:, self.empty] = self.all[self.empty] | (size == 0)[:, None]
        return hits


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, canonical_url, n_rules, rules (ids in order, comma between), blocked: one row per input row."""
    auto = Automaton([g for _, _, g in rules])
    ids = np.array([r for r, _, _ in rules], dtype=object)
    allow = np.array([a == "allow" for _, a, _ in rules])
    order = np.argsort(ids.astype(str), kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            hits = auto.match(*flat(col))
            hits[~np.asarray(col.is_valid())] = False
            code = hits @ (1 << np.arange(len(ids), dtype=object)) if len(ids) > 62 else hits @ (np.int64(1) << np.arange(len(ids)))
            uniq, inv = np.unique(code.astype(str) if len(ids) > 62 else code, return_inverse=True)
            one = np.zeros(len(uniq), np.int64)
            one[inv] = np.arange(len(inv))
            names = [",".join(ids[order][hits[i][order]]) for i in one]
            blocked = (hits & ~allow).any(1) & ~(hits & allow).any(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(hits.sum(1), pa.int64()), pa.array(names, pa.string()).take(pa.array(inv)), pa.array(blocked)],
                names=[*b.schema.names, "n_rules", "rules", "blocked"],
            )

    src = pages.select(F.col(id_col), F.col(url_col), canonical(F.col(url_col)).alias("canonical_url"))
    kind = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url_col}` string, canonical_url string, n_rules long, rules string, blocked boolean")


def _regex(glob: str) -> str:
    out, it = "", iter(glob)
    for ch in it:
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        else:
            c = next(it, "\\") if ch == "\\" else ch
            out += c if c.isalnum() or ord(c) > 127 else "\\" + c
    return "(?s)" + out


def oracle(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    rows = ", ".join(f"('{i}', '{a}', '{_regex(g)}')" for i, a, g in rules)
    return f"""WITH canon AS (SELECT page_id, url, head || tail AS canonical_url FROM ({_CANON_SQL})),
rules(id, action, re) AS (VALUES {rows}),
hits AS (SELECT page_id, url, canonical_url, r.id, r.action FROM canon LEFT JOIN rules r ON regexp_full_match(canonical_url, r.re))
SELECT page_id, url, canonical_url, count(id) AS n_rules, coalesce(string_agg(id, ',' ORDER BY id), '') AS rules,
  coalesce(bool_or(action = 'block'), false) AND NOT coalesce(bool_or(action = 'allow'), false) AS blocked
FROM hits GROUP BY page_id, url, canonical_url"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
