"""Secret scans: fixed patterns, and formats learned by grammar inference.

Labelled credentials of each format are put into a prefix tree with counts; states whose outgoing and ending
frequencies are compatible under the Hoeffding bound, down through their subtrees, are merged, which leaves
one probabilistic automaton a format. Candidates are the parts, from any letter on, of every run of credential
letters of every text. They are scored under all automata: the bits by which the best format is likelier than
letters drawn evenly. Candidates beyond a threshold are added to the spans that the patterns find.

Spans are whole matches in code points, end exclusive. Defined cases: a null text is empty; repeated rows get
equal results; a text of any length is scanned whole, in time proportional to it; an empty table gives no rows; other
columns are kept, but a column named as the result's is replaced.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, load, tidy, unused

# The patterns of the scan.
KINDS = ("assign", "access", "hex", "learned")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_RUN = re.compile("[A-Za-z0-9+/_.=-]{16,}")

#: Significance of a merge, labelled credentials a format, bits that a candidate needs in all and per letter.
ALPHA, EXAMPLES, LEAST_BITS, BITS_A_LETTER = 0.05, 150, 14.0, 0.2
#: Letters of a candidate at least; bits behind an even draw at which one is given up.
LEAST_LETTERS, BEHIND = 16, -12
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_EVEN = math.log2(len(_ALPHABET))


def labelled_credentials(seed: int = 0, n: int = EXAMPLES) -> dict[str, list[str]]:
    """Labelled examples of public credential formats, made by rule."""
    rng = random.Random(seed)
    up, low, num = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
    some = lambda letters, k: "".join(rng.choices(letters, k=k))
    rules = {
        "access_key": lambda: "AKIA" + some(up + num, 16),
        "code_host": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(up + low + num, 36),
        "chat_bot": lambda: "xoxb-" + some(num, 12) + "-" + some(num, 12) + "-" + some(up + low + num, 24),
        "payment": lambda: rng.choice(("sk_live_", "sk_test_")) + some(up + low + num, 24),
        "cloud_key": lambda: "AIza" + some(up + low + num + "_-", 35),
        "web_token": lambda: "eyJhbGciOi" + some(up + low + num, 26) + ".eyJ" + some(up + low + num, 60) + "." + some(up + low + num + "_-", 43),
    }
    return {name: [rule() for _ in range(n)] for name, rule in rules.items()}


def _class(c: str) -> str:
    return "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c


class Automaton:
    """A probabilistic deterministic automaton inferred from strings by state merging."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end = [0]
        for s in strings:
            q = 0
            for c in s:
                self.count[q][c] = self.count[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                q = self.next[q][c]
            self.end[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._set_bits()

    def _total(self, q: int) -> int:
        return self.end[q] + sum(self.count[q].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether all frequencies below two states are compatible."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            width = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > width:
                return False
            ca, cb = self.count[a], self.count[b]
            if any(abs(ca.get(c, 0) / n - cb.get(c, 0) / m) > width for c in ca.keys() | cb.keys()):
                return False
            stack += [(self.next[a][c], self.next[b][c]) for c in ca.keys() & cb.keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree at b to state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    stack.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            known = set(kept)
            edge = [(q, c, r) for q in kept for c, r in sorted(self.next[q].items()) if r not in known]
            if not edge:
                break
            q, c, r = max(edge, key=lambda x: self._total(x[2]))
            for k in kept:
                if self._alike(k, r):
                    self.next[q][c] = k
                    self._fold(k, r)
                    break
            else:
                kept.append(r)
        self.kept = kept

    def _set_bits(self) -> None:
        """Per state: letter -> (bits over an even draw, next state); unseen letters by the share of their class."""
        sizes: dict[str, int] = {}
        for c in _ALPHABET:
            sizes[_class(c)] = sizes.get(_class(c), 0) + 1
        self.step: dict[int, dict[str, tuple[float, int]]] = {}
        for q in self.kept:
            n = self._total(q)
            share: dict[str, float] = {}
            for c, k in self.count[q].items():
                share[_class(c)] = share.get(_class(c), 0) + k / n
            likeliest = {x: self.next[q][max((k, c) for c, k in self.count[q].items() if _class(c) == x)[1]] for x in share}
            self.step[q] = {
                c: (math.log2(0.9 * self.count[q].get(c, 0) / n + 0.1 * share[_class(c)] / sizes[_class(c)]) + _EVEN, self.next[q].get(c, likeliest[_class(c)]))
                for c in _ALPHABET
                if _class(c) in share
            }

    def bits(self, s: str) -> float:
        """Bits by which s is likelier here than evenly drawn; -inf once far behind or impossible."""
        total, q, step = 0.0, 0, self.step
        for c in s:
            hit = step[q].get(c)
            if hit is None:
                return -math.inf
            total += hit[0]
            if total < BEHIND:
                return -math.inf
            q = hit[1]
        return total


class Scanner:
    """All automata as one, run over a text's runs from every letter at once."""

    def __init__(self, models: tuple[Automaton, ...]):
        self.step: list[dict[str, tuple[float, int]]] = []
        self.first: dict[str, list[tuple[float, int]]] = {c: [] for c in _ALPHABET}
        for x in models:
            number = {q: len(self.step) + k for k, q in enumerate(x.kept)}
            self.step += [{c: (bits, number[r]) for c, (bits, r) in x.step[q].items()} for q in x.kept]
            for c, hit in self.step[number[0]].items():
                self.first[c].append(hit)

    def candidates(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the parts of a run beyond the thresholds that don't overlap, those of most bits first.
        Of the starts that meet in a state, whose further bits are the same, the one with most bits and the one
        with most beyond BITS_A_LETTER are followed, so that the work grows with the run's length only. A part
        that came beyond LEAST_BITS ends at the last letter up to which it is beyond BITS_A_LETTER; no format
        ends in + / . or =."""
        step, first, per = self.step, self.first, BITS_A_LETTER
        # state -> paths (bits, bits + BITS_A_LETTER * start, start)
        active: dict[int, tuple] = {}
        found: dict[int, tuple[float, int]] = {}
        for i, c in enumerate(run):
            after: dict[int, tuple] = {}
            moves = [(bits + hit[0], start, hit[1]) for q, paths in active.items() if (hit := step[q].get(c)) for bits, _, start in paths]
            moves += [(bits, i, q) for bits, q in first[c]]
            for bits, start, q in moves:
                if bits < BEHIND:
                    continue
                one = (bits, bits + per * start, start)
                held = after.get(q)
                if held is None:
                    after[q] = (one,)
                else:
                    most = max(*held, one)
                    dense = max(*held, one, key=lambda x: x[1:])
                    after[q] = (most,) if most[2] == dense[2] else (most, dense)
            active = after
            for paths in active.values():
                for bits, _, start in paths:
                    n = i + 1 - start
                    if n >= LEAST_LETTERS and bits >= per * n and (bits >= LEAST_BITS or start in found):
                        found[start] = (max(bits, found[start][0]) if start in found else bits, i + 1)
        out: list[tuple[int, int]] = []  # in order, apart from one another
        for _, start, end in sorted((-bits, start, end) for start, (bits, end) in found.items()):
            k = bisect_left(out, (end, end))
            if not k or out[k - 1][1] <= start:
                out.insert(k, (start, start + len(run[start:end].rstrip("+/.="))))
        return out


@lru_cache(maxsize=2)
def _scanner(models: tuple[Automaton, ...]) -> Scanner:
    return Scanner(models)


@lru_cache(maxsize=2)
def automata(seed: int = 0) -> tuple[Automaton, ...]:
    return tuple(Automaton(strings) for strings in labelled_credentials(seed).values())


def scan_text(text: str, models: tuple[Automaton, ...]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    scanner = _scanner(models)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for m in _RUN.finditer(text):
        for start, end in scanner.candidates(m.group()):
            start, end = m.start() + start, m.start() + end
            k = bisect_left(starts, end)  # base spans that start before the end
            if not k or reach[k - 1] <= start:
                found.append((start, 3, end))
    return sorted(found)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for start, kind, end in spans:
        if end > last:
            if start >= last:
                out += [text[last:start], f"[{KINDS[kind]}]"]
            last = end
    return "".join(out) + text[last:]


def scan(docs: DataFrame, redact: bool = False, name: str = "spans") -> DataFrame:
    """docs with text -> all columns and, under name, an array of (start, end, kind), which replaces a column so named;
    with redact, spans in text are replaced by their kind in brackets."""
    held = docs.sparkSession.sparkContext.broadcast(automata())  # as large as the labelled examples

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            k = b.schema.get_field_index("text")
            spans, texts = [], []
            for text in b.column(k).to_pylist():
                found = scan_text(text or "", held.value)
                spans.append([{"start": s, "end": e, "kind": KINDS[i]} for s, i, e in found])
                texts.append(redact_text(text, found) if redact and found else text)
            columns = list(b.columns)
            columns[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*b.schema.names, name])

    plain = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(tidy(run), extended(plain.schema, f"`{name}` array<struct<start:long,end:long,kind:string>>"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with all secrets in text replaced; rows and all other columns stay as they are."""
    (name,) = unused(docs, "spans")
    return scan(docs, redact=True, name=name).drop(name)


def op5_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != "learned")
    join = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"), count("learned").alias("n_learned"))
