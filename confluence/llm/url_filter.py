"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules become one bit vector: a start state and a state for each literal.  In a pattern
``*`` is any run without ``/``, ``**`` any run, ``?`` one byte.  For a byte c all patterns
step at once, D = ((D << 1) & B[c]) | (D & L[c]), over as many 64-bit words as the rules need,
and over a batch of URLs side by side.

Site rules look at host and path as they stand.  The globs of unwanted pages look at the canonical URL: the
lower-cased host without user information, default port and final dot, then the path with escapes of plain
signs undone, empty and dot segments resolved and A-Z lower-cased; no scheme, query or fragment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.words import batches, utf8


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that begin as ``name`` says."""

    name: str
    verdict: str

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


# The site rules, and the globs of unwanted pages.
RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)
UNWANTED = (
    "**adult-**", "**casino**", "**cheap-pills**", "**free-bets**", "**payday-loan**", "**porn**",
    "**replica-watch**", "**sports-bet**", "**viagra**", "**xxx**",
    # hosts of one numbered server, a login page anywhere, doors with a one-letter name, and feeds right below a tag
    "ads?.*/**", "**/wp-login.php", "**/doorway-?/*", "**/tag/*/feed",
)
PLAIN = "-._~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def canonical(host: str, path: str) -> str:
    """The canonical URL of a lower-cased host and a path."""
    host = re.sub(r":(?:80|443)?$", "", host.rpartition("@")[2]).rstrip(".")
    path = re.sub("%([0-9A-Fa-f]{2})", lambda m: c if (c := chr(int(m[1], 16))) in PLAIN else m[0], path)
    kept: list[str] = []
    parts = re.sub("/+", "/", path).split("/")
    for part in parts[1:]:
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    if len(parts) > 1 and parts[-1] in (".", ".."):
        kept.append("")
    return host + "".join(f"/{part}" for part in kept).translate(LOWER)


class Automaton:
    """All patterns of a list, simulated together; patterns match whole URLs."""

    def __init__(self, patterns):
        steps, loops, self.finals = [None], [0], []  # per state: the byte it takes (-1: any), bytes it stays on
        steps.clear(), loops.clear()
        for pattern in patterns:
            data, at = pattern.encode(), 0
            steps.append(None)
            loops.append(0)
            while at < len(data):
                if data[at] == 42:
                    run = len(data[at:]) - len(data[at:].lstrip(b"*"))
                    loops[-1] = max(loops[-1], 2 if run > 1 else 1)
                    at += run
                    continue
                steps.append(-1 if data[at] == 63 else data[at])
                loops.append(0)
                at += 1
            self.finals.append(len(steps) - 1)
        n = len(steps)
        self.words = -(-n // 64)
        take, stay, start = np.zeros((257, n), bool), np.zeros((257, n), bool), np.zeros(n, bool)
        for s, (step, loop) in enumerate(zip(steps, loops)):
            if step is None:
                start[s] = True
            elif step == -1:
                take[:256, s] = True
            else:
                take[step, s] = True
            if loop:
                stay[:256, s] = True
                if loop == 1:
                    stay[ord("/"), s] = False
        stay[256] = True  # past the end nothing moves
        self.take, self.stay, self.start = self._pack(take), self._pack(stay), self._pack(start[None])[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def matches(self, texts: pa.Array) -> np.ndarray:
        """Boolean [text, pattern]."""
        data, offsets = utf8(texts)
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        ordered, begin = length[order], offsets[:-1][order]
        state = np.repeat(self.start[None], len(length), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-ordered, -i, "left"))
            c = data[begin[:live] + i]
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.take[c]) | (d & self.stay[c])
        out = np.empty((len(length), len(self.finals)), bool)
        for p, s in enumerate(self.finals):
            out[order, p] = (state[:, s // 64] >> np.uint64(s % 64)) & one == one
        return out


def judged(pages: DataFrame, rules=RULES, unwanted=UNWANTED, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row.

    The longest rule that fits decides; without one a page is blocked if a glob of ``unwanted``
    matches its canonical URL, and allowed otherwise.  A null URL or one without ``://`` has an empty
    host and path, no rule, and is allowed.  Repeated rows and null ids are judged like others, very long URLs whole; an
    empty table gives an empty result; other columns are ignored, also ones named like those of the result.
    """
    rules = sorted(rules, key=lambda r: (len(r.name), r.name))
    sites, pages_of = Automaton([g for r in rules for g in r.globs]), Automaton(list(unwanted))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    parts = pages.select(F.col(page_id).alias("page_id"), rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, UPPER.lower()).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    kind = pages.schema[page_id].dataType.simpleString()

    def run(source):
        for batch in batches(source):
            named = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            hit = sites.matches(pa.array([h + p for h, p in named], pa.large_string()))
            bad = pages_of.matches(pa.array([canonical(h, p) for h, p in named], pa.large_string()))
            rule, verdict = [None] * batch.num_rows, np.where(bad.any(axis=1), "block", "allow").tolist()
            for i, r in enumerate(rules):
                for row in np.flatnonzero(hit[:, 2 * i] | hit[:, 2 * i + 1]):
                    rule[row], verdict[row] = r.name, r.verdict
            yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def sql(rules=RULES, unwanted=UNWANTED) -> str:
    """The same judgement over ``pages`` in DuckDB's SQL (which resolves up to eight dot segments of a URL)."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def fits(r: Rule) -> str:
        host, path = r.name.split("/", 1)
        return f"(host = '{host}' or host like '%.{host}') and path like '/{path}%'"

    def regex(glob: str) -> str:
        signs = {"**": ".*", "*": "[^/]*", "?": "."}
        return "".join(signs[x] if x in signs else re.escape(x) for x in re.findall(r"\*\*|.", glob))

    plain = "path"
    for c in PLAIN:
        for code in sorted({f"%{ord(c):02X}", f"%{ord(c):02x}"}):
            plain = f"replace({plain}, '{code}', '{c}')"
    clean = "regexp_replace(plain, '/+', '/', 'g')"
    for _ in range(8):
        clean = f"regexp_replace(regexp_replace({clean}, '/[.](/|$)', '/'), '(/[^/]+)?/[.][.](/|$)', '/')"
    any_of = " or ".join(f"regexp_full_match(url, '{regex(g)}', 's')" for g in unwanted)
    return f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
plains as (select *, {plain} as plain from parts),
canon as (select *, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '.') || translate({clean}, '{UPPER}', '{UPPER.lower()}') as url from plains),
ruled as (select *, case {' '.join(f"when {fits(r)} then '{r.name}'" for r in longest)} end as rule from canon)
select page_id, host, path, rule, case {' '.join(f"when rule = '{r.name}' then '{r.verdict}'" for r in longest)}
  when {any_of} then 'block' else 'allow' end as verdict from ruled"""
