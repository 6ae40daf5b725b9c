"""Secrets in texts: fixed patterns, and formats learned from what they find.

The base patterns find assigned passwords and tokens, access keys and hexadecimal runs. A bounded sample of the found
credentials, labelled by kind, trains one probabilistic automaton for each kind: their prefix tree, in which states
are merged when the Hoeffding bound finds no difference between their outgoing and final frequencies. All other tokens of
at least ``CANDIDATE_LENGTH`` characters are candidates, whatever they consist of; one that an automaton gives a likelihood as high as it gives nearly all of its own
held-out credentials, and higher than any sampled word of plain letters, is added under the kind ``format``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.llm.shared import stored, text_batches

KINDS = ("assign", "access", "hex")
LEARNED = "format"
SAMPLE = 1500
# Longer credentials are found and scored, but not learned from.
LONGEST_LEARNED = 128
ALPHA = 0.05
HELD_OUT = 5
# Share of held-out credentials whose likelihood is below the threshold.
BELOW = 0.02
# As short as the shortest credential that the base patterns know.
CANDIDATE_LENGTH = 12
WORD = "word"

_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_LEAST = {"assign": 12, "access": 18, "hex": 16}
# Every byte as ``h`` where it is a lower-case hexadecimal digit, so that runs are found by plain search.
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_TOKEN_MAP = bytes(116 if chr(b).isalnum() and b < 128 or chr(b) in "+/_.=-" else 32 for b in range(256))
_HEX_RUN, _TOKEN_RUN = re.compile(rb"h{16,}"), re.compile(rb"t{%d,}" % CANDIDATE_LENGTH)


def base_matches(raw: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(start, end, kind, secret) in bytes, leftmost non-overlapping for each kind, in order of start, then kind."""
    found = []
    low = raw.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(raw)]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(raw)]
    runs = raw.translate(_HEX_MAP)
    if b"h" * 16 in runs:
        found += [(m.start(), m.end(), "hex", raw[m.start() : m.end()]) for m in _HEX_RUN.finditer(runs)]
    kept = [f for f in found if len(f[3]) >= _LEAST[f[2]]]
    return sorted(kept, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(raw: bytes, base: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
    """Tokens of at least ``CANDIDATE_LENGTH`` characters that no base span touches. Both stand in order of their starts, so one
    walk over both tells."""
    runs = raw.translate(_TOKEN_MAP)
    if b"t" * CANDIDATE_LENGTH not in runs:
        return
    spans, at, covered = [(s, e) for s, e, *_ in base], 0, 0
    for m in _TOKEN_RUN.finditer(runs):
        a, b = m.span()
        # The furthest end of the spans that start before the token ends.
        while at < len(spans) and spans[at][0] < b:
            covered = max(covered, spans[at][1])
            at += 1
        if covered <= a:
            yield a, b, raw[a:b]


def is_word(token: bytes) -> bool:
    """Whether a token consists of letters alone."""
    return token.isalpha() and (token.islower() or token[1:].islower() or token.isupper())


def symbols(token: bytes) -> str:
    """Classes of the characters: digit, ``a``-``f``, other lower case, upper case; marks stand for themselves."""
    return "".join(
        "9" if 48 <= c <= 57 else "f" if 97 <= c <= 102 else "z" if 103 <= c <= 122 else "A" if 65 <= c <= 90 else chr(c)
        for c in token
    )


_CLASS_SIZE = {"9": 10, "f": 6, "z": 20, "A": 26}
_ALL_CHARACTERS = 68


class Automaton:
    """Probabilistic automaton of labelled strings, by merging of compatible prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.visits, self.final, self.next = [0], [0], [{}]
        for s in strings:
            self._insert(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _insert(self, s: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in s:
            if c not in self.next[state]:
                self.next[state][c] = len(self.visits)
                self.visits.append(0)
                self.final.append(0)
                self.next.append({})
            state = self.next[state][c]
            self.visits[state] += 1
        self.final[state] += 1

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.final[a], n, self.final[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.edges[a].get(c, 0), self.edges[b].get(c, 0)
                if self._differ(x, n, y, m):
                    return False
                if x and y:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _merge_states(self) -> None:
        self.edges = [{c: self.visits[t] for c, t in out.items()} for out in self.next]
        settled, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        kept = {0}
        while blue:
            parent, c = blue.popleft()
            state = self.next[parent][c]
            if state in kept:
                continue
            for target in settled:
                if self._compatible(target, state):
                    self.next[parent][c] = target
                    self._fold(target, state)
                    break
            else:
                settled.append(state)
                kept.add(state)
            # Transitions that lead out of the settled states, in order of discovery.
            waiting = set(blue)
            blue += [(s, d) for s in settled for d in sorted(self.next[s]) if self.next[s][d] not in kept and (s, d) not in waiting]
        self.states = settled

    def _fold(self, target: int, state: int) -> None:
        todo = [(target, state)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.final[a] += self.final[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child
                self.edges[a][c] = self.edges[a].get(c, 0) + self.edges[b][c]

    def table(self) -> dict:
        """State: (logarithm of the final probability or None, {symbol: (next state, log probability)})."""
        out = {}
        for s in self.states:
            n = self.visits[s]
            end = math.log(self.final[s] / n) if self.final[s] else None
            out[s] = (end, {c: (t, math.log(self.edges[s][c] / n)) for c, t in self.next[s].items()})
        return out


def likelihood(table: dict, text: str) -> float:
    """Mean logarithm of the probability of a character, a class standing for its characters, relative to characters drawn
    evenly from all; minus infinity where the automaton has no way."""
    state, total = 0, 0.0
    for c in text:
        step = table[state][1].get(c)
        if step is None:
            return -math.inf
        state = step[0]
        total += step[1] - math.log(_CLASS_SIZE.get(c, 1)) + math.log(_ALL_CHARACTERS)
    end = table[state][0]
    return -math.inf if end is None or not text else (total + end) / (len(text) + 1)


def learn(rows: list[tuple[str, str]], alpha: float = ALPHA) -> dict[str, tuple[dict, float]]:
    """Automaton table and threshold of each kind, from (kind, secret) pairs. Every fifth secret is held out for the
    threshold; a kind with fewer than 20 secrets is not learned. Pairs of the kind ``word`` are ordinary words: the
    threshold lies above the likelihood of each of them."""
    models = {}
    words = [symbols(s.encode()) for k, s in rows if k == WORD]
    for kind in KINDS:
        secrets = sorted({s for k, s in rows if k == kind}, key=lambda s: hashlib.md5(s.encode()).digest())
        if len(secrets) < 20:
            continue
        shapes = [symbols(s.encode()) for s in secrets]
        table = Automaton([s for i, s in enumerate(shapes) if i % HELD_OUT], alpha).table()
        scores = sorted(likelihood(table, s) for s in shapes[::HELD_OUT])
        ordinary = max((likelihood(table, s) for s in set(words)), default=-math.inf)
        models[kind] = (table, max(scores[int(BELOW * len(scores))], 0.0, math.nextafter(ordinary, math.inf)))
    return models


def _code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with offsets in code points."""
    out, at, count = [], 0, 0
    marks = {}
    for b in sorted({p for s, e, _ in spans for p in (s, e)}):
        count += len(raw[at:b].decode("utf-8", "replace"))
        at, marks[b] = b, count
    for s, e, kind in spans:
        out.append((marks[s], marks[e], kind))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan_text(raw: bytes | None, models: dict) -> tuple[str, str]:
    """Base spans and all spans, each as ``kind:start:end`` by start, then kind."""
    raw = raw or b""
    base = base_matches(raw)
    spans = [(s, e, kind) for s, e, kind, _ in base]
    added = []
    for s, e, token in candidates(raw, base):
        shape = symbols(token)
        if any(likelihood(table, shape) >= least for table, least in models.values()):
            added.append((s, e, LEARNED))
    if not spans and not added:
        return "", ""
    order = (*KINDS, LEARNED)
    both = sorted(spans + added, key=lambda x: (x[0], order.index(x[2])))
    return _joined(_code_points(raw, spans)), _joined(_code_points(raw, both))


def _draw(kind: str, secret: bytes) -> int:
    return xxhash.xxh64_intdigest(kind.encode() + b":" + secret)


def labelled_secrets(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``sample`` credentials of each kind, those with the lowest hash among all that the base patterns find, and as
    many ordinary words. A task passes on its own lowest ones only, which hold the lowest of all."""

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[bytes, int]] = {k: {} for k in (*KINDS, WORD)}
        limit = dict.fromkeys(held, 1 << 64)

        def take(kind: str, secret: bytes) -> None:
            if len(secret) > LONGEST_LEARNED or secret in held[kind]:
                return
            h = _draw(kind, secret)
            if h < limit[kind]:
                held[kind][secret] = h
                if len(held[kind]) >= 2 * sample:
                    held[kind] = dict(sorted(held[kind].items(), key=lambda x: x[1])[:sample])
                    limit[kind] = max(held[kind].values())

        for pdf in batches:
            for raw in pdf["text"]:
                base = base_matches(raw or b"")
                for _, _, kind, secret in base:
                    take(kind, secret)
                for _, _, token in candidates(raw or b"", base):
                    if is_word(token):
                        take(WORD, token)
        rows = [(k, s.decode(), h) for k, found in held.items() for s, h in sorted(found.items(), key=lambda x: x[1])[:sample]]
        out = pd.DataFrame(rows, columns=["kind", "secret", "draw"])
        # Unsigned numbers as signed ones of the same order.
        yield out.assign(draw=[int(h) - (1 << 63) for h in out["draw"]])

    text_batches(docs.sparkSession)
    found = docs.select(F.col(text).cast("binary").alias("text")).mapInPandas(lowest, "kind string, secret string, draw long")
    found = stored(found.distinct(), "credentials")
    # Kinds are four; each keeps a bounded number of rows.
    picked = [found.where(F.col("kind") == k).orderBy("draw", "secret").limit(sample) for k in (*KINDS, WORD)]
    rows = picked[0].union(picked[1]).union(picked[2]).union(picked[3])
    return [(r["kind"], r["secret"]) for r in rows.collect()]


def secret_spans(text: Column, models: dict) -> Column:
    """Struct of ``base`` and ``spans`` of each text (null: none)."""

    @F.pandas_udf("base string, spans string")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([scan_text(t, models) for t in texts], columns=["base", "spans"])

    return of_texts(text.cast("binary"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.regexp_count(spans, F.lit(f"(^|,){kind}:")).cast("long")


def find_secrets(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``base`` (spans of the base patterns) and ``spans`` (all), offsets in code points, end exclusive.

    Existing columns of these names are replaced. Null and blank texts have no spans; repeated rows have equal ones; an
    empty table trains no automaton and gives no rows.
    """
    models = learn(labelled_secrets(docs, text, sample))
    found = docs.withColumn("_found", secret_spans(F.col(text), models))
    return found.withColumns({"base": F.col("_found.base"), "spans": F.col("_found.spans")}).drop("_found")


def redacted(raw: bytes | None, models: dict) -> str | None:
    """The text with each stretch covered by spans replaced by ``[secret]``."""
    if raw is None:
        return None
    text, spans = raw.decode("utf-8", "replace"), scan_text(raw, models)[1]
    parts, at = [], 0
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
        if s >= at:
            parts += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(text: Column, models: dict) -> Column:
    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, models) for t in texts], dtype=object)

    return hide(text.cast("binary"))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every stretch covered by a span replaced in ``text``. Null texts stay null, texts without spans stay as they
    are, repeated rows stay repeated, an empty table gives no rows."""
    return docs.withColumn(text, redact(F.col(text), learn(labelled_secrets(docs, text))))
