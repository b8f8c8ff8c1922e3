"""Secret scan: all rules in one deterministic automaton, walked once over the bytes.

Rules are regular expressions over bytes (literals, classes, groups, alternation,
``? * + {m,n}``). A rule is a head, which tells it from the others, and a tail. The heads of all
rules are parsed into one non-deterministic automaton, made deterministic by subset
construction over byte classes, minimised by partition refinement, and laid out as one
transition array. (A joint automaton of whole rules has tens of thousands of states, since
tokens may begin inside each other; of heads it has hundreds and stays in the cache.)
``Scanner.hits`` walks that array over many stretches of text in step, so numpy does the inner
loop. A stretch is first walked from the start state; where the stretch before it turns out
to end in another state, it is walked again from that one, until all agree. So long documents
are cut without losing a match, whatever its length.

A rule may start with ``before`` (a class that the preceding byte must have) and end
with ``after``; the edges of a text count as a line end. Where a head's last byte is seen, the
automaton of the reversed head finds the start and that of the rule's tail, run forward from
there, the end (the longest; a hit without a tail is none). What may follow a hit (``rest``: the
body and the end of a private key) is found likewise, and none is as good. Of overlapping hits
of one rule the earliest-starting, then longest, is kept.

Defined results: null text gives no row and stays null when redacted; equal rows give
equal rows; an id may be null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record, strings, utf8

_NAMED = {"d": set(range(48, 58)), "w": {*range(48, 58), *range(65, 91), 95, *range(97, 123)}, "s": {9, 10, 11, 12, 13, 32}, "n": {10}, "t": {9}, "r": {13}}
ANY = set(range(256))
EDGE = ANY - _NAMED["w"] - {ord(c) for c in "+/=-"}
OPEN = frozenset(EDGE | {ord(c) for c in "=+/"})  # before a token: assignments, URLs and paths; "-" too where the token itself can't hold one
WIDE = frozenset(OPEN | {ord("-")})


@dataclass(frozen=True)
class Rule:
    name: str
    head: str
    tail: str = ""
    before: frozenset[int] = frozenset(EDGE)
    after: frozenset[int] = frozenset(EDGE)
    rest: str = ""

    @property
    def pattern(self) -> str:
        return self.head + self.tail


_KEY = r"((RSA|EC|DSA|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY( BLOCK)?-----"
_GAP = r"([ \t\r\n]|\\[nrt])*"  # also line ends written as in JSON
#: Up to the end line; without one, header lines and whole lines of base64, and a shorter line after these.
_BODY = rf"(([^\-]|-[^\-]|--[^\-]|---[^\-]|----[^\-])*-----END {_KEY}|{_GAP}([A-Za-z\-]+: [^\n\\]*{_GAP})*([A-Za-z0-9+/=]{{16,}}{_GAP})+([A-Za-z0-9+/=]+)?)"

RULES = (
    Rule("aws_access_key", r"(AKIA|ASIA|AROA|AIDA)", r"[A-Z0-9]{16}", WIDE),
    Rule("github_token", r"gh[pousr]_", r"[A-Za-z0-9]{36}", WIDE),
    Rule("gitlab_token", r"glpat-", r"[A-Za-z0-9_\-]{20}", OPEN),
    Rule("slack_token", r"xox[abprs]-", r"[A-Za-z0-9\-]{10,}", OPEN),
    Rule("google_api_key", r"AIza", r"[A-Za-z0-9_\-]{35}", OPEN),
    Rule("stripe_key", r"(sk|rk)_(live|test)_", r"[A-Za-z0-9]{16,}", WIDE),
    Rule("npm_token", r"npm_", r"[A-Za-z0-9]{36}", WIDE),
    Rule("json_web_token", r"eyJ", r"[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", OPEN),
    Rule("private_key", rf"-----BEGIN {_KEY}", "", frozenset(ANY), frozenset(ANY), _BODY),
    Rule("hex_secret", r"([0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{40}|[0-9A-F]{64})", "", WIDE),
    Rule("assigned_secret", r"([Pp]assword|PASSWORD|[Ss]ecret|SECRET|[Aa]pi[_\-]?[Kk]ey|API[_\-]?KEY|[Tt]oken|TOKEN)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?", r"[A-Za-z0-9_\-+/]{8,}", frozenset(ANY - {*range(65, 91), *range(97, 123)}), frozenset(ANY - {ord(c) for c in "-+/"} - _NAMED["w"])),
)


# -- parsing: a tree of ("set", bytes), ("cat", parts), ("alt", parts), ("rep", node, low, high)


def parse(p: str):
    at = 0

    def escape():
        nonlocal at
        c = p[at + 1]
        at += 2
        return _NAMED.get(c, {ord(c)})

    def klass():
        nonlocal at
        at += 1
        no = p[at] == "^"
        at += no
        out: set[int] = set()
        first = True
        while first or p[at] != "]":
            first = False
            if p[at] == "\\":
                out |= escape()
                continue
            lo = p[at]
            at += 1
            if p[at] == "-" and p[at + 1] != "]":
                out |= set(range(ord(lo), ord(p[at + 1]) + 1))
                at += 2
            else:
                out.add(ord(lo))
        at += 1
        return ANY - out if no else out

    def atom():
        nonlocal at
        c = p[at]
        if c == "(":
            at += 1
            x = alt()
            assert p[at] == ")", p
            at += 1
        elif c == "[":
            x = ("set", frozenset(klass()))
        elif c == "\\":
            x = ("set", frozenset(escape()))
        else:
            at += 1
            x = ("set", frozenset(ANY - {10}) if c == "." else frozenset({ord(c)}))
        while at < len(p) and p[at] in "?*+{":
            if p[at] == "{":
                end = p.index("}", at)
                lo, comma, hi = p[at + 1 : end].partition(",")
                x = ("rep", x, int(lo), int(hi) if hi else None if comma else int(lo))
                at = end + 1
            else:
                x = ("rep", x, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[p[at]])
                at += 1
        return x

    def cat():
        parts = []
        while at < len(p) and p[at] not in "|)":
            parts.append(atom())
        return ("cat", parts)

    def alt():
        nonlocal at
        parts = [cat()]
        while at < len(p) and p[at] == "|":
            at += 1
            parts.append(cat())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    tree = alt()
    if at != len(p):
        raise ValueError(p)
    return tree


def reverse(t):
    if t[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(t[1])])
    if t[0] == "alt":
        return ("alt", [reverse(x) for x in t[1]])
    return ("rep", reverse(t[1]), t[2], t[3]) if t[0] == "rep" else t


class Nfa:
    def __init__(self):
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, t, a: int) -> int:
        """The state after the tree when it starts at state a."""
        if t[0] == "set":
            b = self.new()
            self.step[a].append((t[1], b))
            return b
        if t[0] == "cat":
            for x in t[1]:
                a = self.add(x, a)
            return a
        if t[0] == "alt":
            end = self.new()
            for x in t[1]:
                s = self.new()
                self.free[a].append(s)
                self.free[self.add(x, s)].append(end)
            return end
        end = self.new()
        for i in range(t[2] if t[3] is None else t[3]):
            if i >= t[2]:
                self.free[a].append(end)
            a = self.add(t[1], a)
        if t[3] is None:
            loop = self.new()
            self.free[a].append(loop)
            self.free[self.add(t[1], loop)].append(loop)
            a = loop
        self.free[a].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _byte_classes(nfa: Nfa) -> np.ndarray:
    sig: list[list[int]] = [[] for _ in range(256)]
    for i, s in enumerate({s for st in nfa.step for s, _ in st}):
        for b in s:
            sig[b].append(i)
    ids: dict[tuple, int] = {}
    return np.array([ids.setdefault(tuple(x), len(ids)) for x in sig], np.int32)


def determinise(nfa: Nfa, start: int, accept: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte class of each byte, transitions [state, class], rules accepted by state as bits), minimised; the start is state 0."""
    cls = _byte_classes(nfa)
    k = int(cls.max()) + 1
    step = [[(sorted({int(cls[x]) for x in s}), t) for s, t in st] for st in nfa.step]
    reach = [nfa.closure([q]) for q in range(len(step))]
    first = reach[start]
    ids, order, trans = {first: 0}, [first], []
    i = 0
    while i < len(order):
        to: list[set[int]] = [set() for _ in range(k)]
        for q in order[i]:
            for classes, t in step[q]:
                for c in classes:
                    to[c] |= reach[t]
        row = []
        for x in map(frozenset, to):
            if x not in ids:
                ids[x] = len(order)
                order.append(x)
            row.append(ids[x])
        trans.append(row)
        i += 1
    tr = np.array(trans, np.int32).reshape(-1, k)
    acc = np.array([sum(1 << accept[q] for q in st if q in accept) for st in order], np.int64)
    # Minimisation: split blocks by where their states go until nothing splits.
    block = np.unique(acc, return_inverse=True)[1]
    while True:
        new = np.unique(np.c_[block, block[tr]], axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    name = np.full(int(block.max()) + 1, -1)
    seen = [x for x in dict.fromkeys(block.tolist())]
    name[seen] = np.arange(len(seen))
    block = name[block]
    pick = np.unique(block, return_index=True)[1]
    return cls, block[tr[pick]].astype(np.int32), acc[pick]


def _forward(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Automaton of a tree that starts where it is put, and its dead state."""
    nfa = Nfa()
    z = nfa.new()
    cls, tr, acc = determinise(nfa, z, {nfa.add(tree, z): 0})
    return cls, tr, acc, next((q for q in range(len(acc)) if not acc[q] and (tr[q] == q).all()), -1)


class Scanner:
    """Compiled rules; made once on the driver and sent to the executors as arrays."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.names = [r.name for r in rules]
        nfa, accept = Nfa(), {}
        start = nfa.new()
        nfa.step[start].append((frozenset(ANY), start))
        self.back, self.tail, self.rest = [], [], []
        for i, r in enumerate(rules):
            tree = parse(r.head)
            s = nfa.new()
            nfa.free[start].append(s)
            accept[nfa.add(("cat", [("set", r.before), tree]), s)] = i
            self.back.append(_forward(("cat", [reverse(tree), ("set", r.before)])))
            self.tail.append(_forward(("cat", [parse(r.tail), ("set", r.after)])))
            self.rest.append(_forward(parse(r.rest)) if r.rest else None)
        cls, tr, acc = determinise(nfa, start, accept)
        self.cls, self.k, self.acc = cls, tr.shape[1], acc
        self.table = (tr * self.k).reshape(-1)  # next state, already multiplied
        self.final = np.zeros(len(acc) * self.k, bool)
        self.final[:: self.k] = acc != 0

    def hits(self, buf: np.ndarray, off: np.ndarray, stretch: int = 512) -> list[tuple[int, int, int, int]]:
        """(document, rule, start, end) with byte offsets within the document."""
        lens = np.diff(off)
        docs = np.flatnonzero(lens)
        if not len(docs):
            return []
        # Framed text: a line end before and after each document.
        fl = lens[docs] + 2
        fo = np.r_[0, np.cumsum(fl)]
        code = np.full(int(fo[-1]), self.cls[10], np.int32)
        inside = np.ones(len(code), bool)
        inside[fo[:-1]] = inside[fo[1:] - 1] = False
        code[inside] = self.cls[buf]
        # The framed text is one stream cut into stretches; line ends separate documents, and no rule crosses one.
        n = len(code)
        heads = np.arange(0, n, stretch)
        pad = np.r_[code, np.full(len(heads) * stretch - n, self.cls[10], np.int32)].reshape(-1, stretch).T.copy()
        begin = np.zeros(len(heads), np.int32)
        end = np.zeros(len(heads), np.int32)
        hit: dict[int, list[tuple[int, int]]] = {}
        todo = np.arange(len(heads))
        while len(todo):
            for i in todo.tolist() if hit else ():
                hit.pop(i, None)
            state = begin[todo]
            part = pad if len(todo) == len(heads) else pad[:, todo]
            for t in range(stretch):
                state = self.table[state + part[t]]
                for f in np.flatnonzero(self.final[state]).tolist():
                    hit.setdefault(int(todo[f]), []).append((t, int(self.acc[state[f] // self.k])))
            end[todo] = state
            want = np.r_[np.int32(0), end[:-1]]
            todo = np.flatnonzero(want != begin)
            begin = want
        found = sorted((i * stretch + t, bits) for i, x in hit.items() for t, bits in x)
        out, last = [], {}
        for e, bits in found:
            if e >= n:
                continue
            d = int(np.searchsorted(fo, e, side="right")) - 1
            text = buf[off[docs[d]] : off[docs[d] + 1]]
            head_end = e - int(fo[d])  # in the document; the frame's line end comes before it
            while bits:
                r = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                begin_at = head_end - self._longest(self.back[r], text[:head_end][::-1], 1)
                known = last.get((d, r))
                if begin_at > head_end or known and known[0] != begin_at < known[1]:
                    continue  # inside a hit of the rule
                end_at = head_end + self._longest(self.tail[r], text[head_end:], 1)
                if end_at < head_end:
                    continue
                if self.rest[r]:
                    end_at += max(0, self._longest(self.rest[r], text[end_at:], 0))
                last[d, r] = begin_at, end_at
                out.append((int(docs[d]), r, begin_at, end_at))
        return _leftmost(out)

    @staticmethod
    def _longest(auto: tuple[np.ndarray, np.ndarray, np.ndarray, int], text: np.ndarray, edge: int) -> int:
        """Length of the longest match at the start of the text, or -1; with ``edge`` its last byte is what borders it, a line end at the text's end, and isn't counted."""
        cls, tr, acc, dead = auto
        s, best, at, step = 0, -1, 0, 128
        if acc[0]:
            best = 0
        while s != dead and at < len(text):
            for c in cls[text[at : at + step]].tolist():
                s = tr[s, c]
                at += 1
                if acc[s]:
                    best = at
                elif s == dead:
                    return best - edge if best >= 0 else -1
            step *= 2
        if edge and s != dead and acc[tr[s, cls[10]]]:
            best = len(text) + 1
        return best - edge if best >= 0 else -1


@functools.lru_cache(4)
def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _leftmost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out, last = [], None
    for d, r, s, e in sorted(set(found), key=lambda x: (x[0], x[1], x[2], -x[3])):
        if last and last[:2] == (d, r) and s < last[3]:
            continue
        last = (d, r, s, e)
        out.append(last)
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("secret_sha256", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per secret: doc_id, rule, start_byte, end_byte (in UTF-8), sha256 of the secret, never the secret itself."""
    scanner = compiled(rules)

    def run(batches):
        import hashlib

        for rb in chunks(batches):
            buf, off = utf8(rb.column(1))
            found = scanner.hits(buf, off)
            if found:
                ids = rb.column(0).to_pylist()
                yield record(_OUT, [ids[d] for d, *_ in found], [scanner.names[r] for _, r, _, _ in found], [s for *_, s, _ in found], [e for *_, e in found], [hashlib.sha256(buf[off[d] + s : off[d] + e].tobytes()).hexdigest() for d, _, s, e in found])

    return docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, rule string, start_byte int, end_byte int, secret_sha256 string")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; in the text each secret is replaced by ``[rule]``. Nothing else changes."""
    scanner = compiled(rules)

    def run(batches):
        for rb in chunks(batches, text_col):
            i = rb.schema.get_field_index(text_col)
            buf, off = utf8(rb.column(i))
            found = scanner.hits(buf, off)
            if not found:
                yield rb
                continue
            texts = rb.column(i).to_pylist()
            by: dict[int, list[tuple[int, int, int]]] = {}
            for d, r, s, e in found:
                by.setdefault(d, []).append((s, e, r))
            for d, spans in by.items():
                raw, at, parts = texts[d].encode(), 0, []
                for s, e, r in sorted(spans, key=lambda x: (x[0], -x[1])):
                    if e <= at:
                        continue
                    parts += [raw[at : max(s, at)], f"[{scanner.names[r]}]".encode()]
                    at = e
                texts[d] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            yield rb.set_column(i, rb.schema.field(i), pa.array(texts, rb.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
