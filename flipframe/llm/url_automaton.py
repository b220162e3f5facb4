"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every glob rule becomes a run of bits in one multiword Shift-And state.  A URL's characters are
fed in one by one and a few word-wide operations advance all rules at once; a batch of URLs is
advanced together as a matrix of state words.

Glob syntax: ``*`` any run of characters except ``/``; ``**`` any run at all; all other
characters stand for themselves.  A rule must match the whole canonical URL, which is
``.host/path``: the leading dot lets ``*.org/**`` cover ``org`` and its subdomains but not
``xorg``.

Canonical URL: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path from there to ``?``, ``#`` or the end.  Null, empty and scheme-less URLs
have an empty host and path.  Very long URLs are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.llm.common import ready, scan_texts

_U = np.uint64


@dataclass(frozen=True)
class HostRule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, ...]:
        return (f"*.{self.host}{self.path}**",)


#: Verdicts by host and path; the longest fitting rule wins.
RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

#: Block list for URLs that no rule decides: words that spam hosts and paths carry.
BLOCK_GLOBS = tuple(f"**{w}**" for w in ("casino", "poker", "free-bets", "cheap-pills", "viagra", "payday-loan", "xxx"))


class ShiftAnd:
    """All patterns in one state: bit k is set when the k-th literal position has been reached.

    A pattern of n literal bytes owns n + 1 consecutive bits, bit 0 being its start.  ``loop``
    marks positions followed by ``**``, ``loop_seg`` those followed by ``*``: they stay alive on
    any byte, or on any byte but ``/``.
    """

    def __init__(self, patterns: Sequence[str]):
        start, accept, loop, seg, step = [], [], [], [], [[] for _ in range(256)]
        at = 0
        for p in patterns:
            raw, k, i = p.encode(), 0, 0
            start.append(at)
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loop.append(at + k)
                    i += 2
                elif raw[i] == 42:
                    seg.append(at + k)
                    i += 1
                else:
                    k += 1
                    step[raw[i]].append(at + k)
                    i += 1
            accept.append(at + k)
            at += k + 1
        self.words = max(1, -(-at // 64))
        self.start, self.loop, self.loop_seg = self._mask(start), self._mask(loop), self._mask(seg)
        self.step = np.stack([self._mask(s) for s in step])
        keep = np.tile(self.loop | self.loop_seg, (256, 1))
        keep[47] = self.loop
        self.keep = keep
        self.accept = [(b // 64, _U(1) << _U(b % 64)) for b in accept]

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        m = np.zeros(self.words, _U)
        for b in bits:
            m[b // 64] |= _U(1) << _U(b % 64)
        return m

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: texts x patterns.  Texts are advanced together, longest first, so
        that finished ones leave the working rows."""
        n = len(texts)
        out = np.zeros((n, len(self.accept)), bool)
        if not n or not self.accept:
            return out
        length = np.array([len(t) for t in texts])
        order = np.argsort(-length, kind="stable")
        begin = np.concatenate([[0], np.cumsum(length[order])])[:-1]
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        alive = np.searchsorted(-length[order], -np.arange(1, length.max(initial=0) + 1), side="right")
        state = np.tile(self.start, (n, 1))
        for i, m in enumerate(alive):
            d, c = state[:m], flat[begin[:m] + i]
            moved = d << _U(1)
            moved[:, 1:] |= d[:, :-1] >> _U(63)
            state[:m] = (moved & self.step[c]) | (d & self.keep[c])
        for k, (w, bit) in enumerate(self.accept):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def host_and_path(url: bytes | None) -> tuple[bytes, bytes]:
    """Host and path of the canonical URL."""
    if not url or (at := url.find(b"://")) < 0:
        return b"", b""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find(b"/")
    return (rest.lower(), b"") if cut < 0 else (rest[:cut].lower(), rest[cut:])


RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    + [T.StructField("block_glob", T.StringType())]
)


def judge(rules: Sequence[HostRule], block_globs: Sequence[str]):
    """A function from URLs to verdict columns; one automaton holds rules and block list."""
    by_length = sorted(rules, key=lambda r: -len(r.text))
    patterns = [g for r in by_length for g in r.globs] + list(block_globs)
    machine = ShiftAnd(patterns)

    def scan(urls: list[bytes | None]) -> dict[str, list]:
        parts = [host_and_path(u) for u in urls]
        hit = machine.matches([b"." + h + p for h, p in parts])
        got: dict[str, list] = {f.name: [] for f in RESULT.fields}
        for (h, p), row in zip(parts, hit):
            fits = np.flatnonzero(row)
            rule = by_length[fits[0]] if len(fits) and fits[0] < len(by_length) else None
            glob = next((patterns[k] for k in fits if k >= len(by_length)), None)
            got["host"].append(h.decode("utf-8", "replace"))
            got["path"].append(p.decode("utf-8", "replace"))
            got["rule"].append(rule.text if rule else None)
            got["block_glob"].append(glob)
            got["verdict"].append(rule.verdict if rule else "block" if glob else "allow")
        return got

    return scan


def url_verdicts(pages: DataFrame, rules: Sequence[HostRule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS,
                 url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per input row: ``keep``, host, path, rule, verdict and the block-list glob met.

    The longest fitting host rule decides; else a URL that meets a block glob is blocked, and
    any other is allowed.  Equal URLs get equal verdicts; rows are never merged.
    """
    ready(pages.sparkSession)
    rules, block_globs = tuple(rules), tuple(block_globs)
    src = pages.select(*keep, url_col)
    got, s = scan_texts(src, url_col, lambda: judge(rules, block_globs), RESULT, list(keep), "url_scan")
    return got.select(*keep, *[F.col(f"{s}.{f.name}").alias(f.name) for f in RESULT.fields])
