"""Secret scans by one combined automaton.

All rules are compiled together (see :mod:`causeway.llm.automaton`), each up to the shortest match it
has at any start; one pass over a text's bytes runs the combined table. Where it accepts, a match is
certain: the rule's reversed automaton walks back to the leftmost start and the anchored one forward to
the longest end. Both stay within the match, which is then consumed, so a text of any content is scanned
in linear time. Matches of a kind don't overlap; those shorter than the rule asks, whole or in their
value, fall away after they have been consumed.

Defined results: a null or empty text has no spans; an empty table gives an empty result. Texts are
scanned whole, however long, in time linear in their length. Offsets are code points, ends exclusive.
Ties: spans with one start are listed in the order of the rules. Repeated rows are scanned each on its
own; further columns are ignored by :func:`find_secrets` and passed through by :func:`redact_secrets`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.automaton import Dfa, compile_dfa, parse, reverse
from causeway.llm.common import map_batches, texts


@dataclass(frozen=True)
class Rule:
    """``lead`` then ``value``; lead and ``opening``: the shortest matches, with which every match begins. ``least``: bytes of the whole match; ``least_value``: of what follows the lead."""

    kind: str
    lead: str
    value: str
    opening: str = ""
    least: int = 0
    least_value: int = 0
    fold_case: bool = False


#: The rules asked for, then formats that issuers of keys document.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=\\-]+", "[A-Za-z0-9+/_.=\\-]", least_value=6, fold_case=True),
    Rule("access", "AKIA", "[A-Z0-9]+", "[A-Z0-9]", least=20),
    Rule("hex", "", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
    Rule("pem", "-----BEGIN ", "([A-Z0-9]+ )*PRIVATE KEY-----", "([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("hub", "gh[pousr]_", "[A-Za-z0-9]+", "[A-Za-z0-9]", least=40),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9\\-]+", "[A-Za-z0-9\\-]", least=24),
    Rule("jwt", "eyJ", "[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", "[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]", least=40),
    Rule("url", "[a-z]+://", "[A-Za-z0-9_.\\-]+:[A-Za-z0-9_.%\\-]+@", "[A-Za-z0-9_.\\-]+:[A-Za-z0-9_.%\\-]+@", least=12),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        openings = [parse(r.lead + r.opening, r.fold_case) for r in rules]
        self.all = compile_dfa(openings, search=True)
        self.forward = [compile_dfa([parse(r.lead + r.value, r.fold_case)], search=False) for r in rules]
        self.backward = [compile_dfa([reverse(t)], search=False) for t in openings]
        self.lead = [compile_dfa([parse(r.lead, r.fold_case)], search=False) for r in rules]
        self.of_mask = {m: [i for i in range(len(rules)) if m >> i & 1] for m in set(self.all.masks)}

    @staticmethod
    def longest(dfa: Dfa, data: bytes, at: int) -> int:
        """End of the longest match from ``at``, or -1."""
        s, table, end = dfa.start, dfa.table, -1
        if s >= dfa.first_accept:
            end = at
        for i in range(at, len(data)):
            s = table[s + data[i]]
            if s >= dfa.first_accept:
                end = i + 1
            elif s == dfa.dead:
                break
        return end

    @staticmethod
    def leftmost(dfa: Dfa, data: bytes, end: int, bound: int) -> int:
        """Leftmost start, from ``bound`` on, of a match that ends at ``end``, or -1."""
        s, table, start = dfa.start, dfa.table, -1
        for i in range(end - 1, bound - 1, -1):
            s = table[s + data[i]]
            if s >= dfa.first_accept:
                start = i
            elif s == dfa.dead:
                break
        return start

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        table, accept, s = self.all.table, self.all.first_accept, self.all.start
        done, out = [0] * len(self.rules), []
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= accept:
                for k in self.of_mask[self.all.masks[s >> 8]]:
                    if i >= done[k]:
                        self.match(data, k, i + 1, done, out)
        out.sort()
        return out

    def match(self, data: bytes, k: int, end: int, done: list[int], out: list[tuple[int, int, int]]) -> None:
        start = self.leftmost(self.backward[k], data, end, done[k])
        if start < 0:
            return
        end, rule = self.longest(self.forward[k], data, start), self.rules[k]
        if end < 0:
            return
        done[k] = end
        if end - start < rule.least or rule.least_value and end - self.longest(self.lead[k], data, start) < rule.least_value:
            return
        out.append((start, k, end))


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once on the driver; tasks get the transition arrays."""
    return Scanner(rules)


def points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if not spans or data.isascii():
        return spans
    cuts, at, n, where = sorted({x for s, _, e in spans for x in (s, e)}), 0, 0, {}
    for c in cuts:
        n += len(data[at:c].decode("utf-8", "replace"))
        where[c], at = n, c
    return [(where[s], k, where[e]) for s, k, e in spans]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and ``found``, an array of kind, start, end by start and then the rules' order."""
    kinds, s = [r.kind for r in rules], scanner(rules)
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": kinds[k], "start": i, "end": j} for i, k, j in points(x, s.scan(x))] for x in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, fields)], names=["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, found {SPANS}")


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with all their columns; each span of the text, overlaps joined, becomes ``[kind]`` of its first rule."""
    at, s = docs.columns.index(text_col), scanner(rules)

    def clean(data: bytes) -> bytes:
        parts, last = [], 0
        for start, k, end in s.scan(data):
            if start >= last:
                parts += [data[last:start], b"[" + rules[k].kind.encode() + b"]"]
            last = max(last, end)
        return b"".join([*parts, data[last:]]) if parts else data

    def run(batches):
        for b in batches:
            old = b.column(at)
            new = [None if x is None else clean(x) for x in old.cast(pa.large_binary()).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, pa.large_binary()).cast(pa.large_string()).cast(old.type))

    return map_batches(docs, run, docs.schema)
