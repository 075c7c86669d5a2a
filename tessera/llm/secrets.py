"""Secret scans: fixed rules, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, spare_name

# Fixed rules. Letters of the keyword are matched in either case, by ASCII rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")

#: What the automata score: what the fixed rules leave of each maximal run of these characters, from SHORTEST on.
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
#: A candidate is a secret if its mean log-likelihood ratio per character against plain tokens is over this.
RATIO = 0.35
#: Confidence of the compatibility test; labelled strings per format; seed of their generator.
ALPHA, PER_FORMAT, SEED = 0.05, 60, 20240607


def symbol(c: str) -> str:
    """Characters of a class stand for each other; punctuation stands for itself."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "F":
        return "A"
    return "G" if "G" <= c <= "Z" else c


_CLASSES = str.maketrans({c: symbol(c) for c in string.ascii_letters + string.digits})


def labelled() -> tuple[list[str], list[str]]:
    """Credentials in public formats and plain tokens, from a seeded generator."""
    rng = random.Random(SEED)
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    formats = (
        lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + draw(alnum, 36),
        lambda: "sk_live_" + draw(alnum, 24),
        lambda: f"xoxb-{draw(string.digits, 12)}-{draw(alnum, 24)}",
        lambda: "AIza" + draw(alnum + "-_", 35),
        lambda: draw(hexa, rng.choice((32, 40, 64))),
        lambda: draw(b64, 40),
        lambda: draw(b64, 43) + "=",
        lambda: f"eyJ{draw(alnum, 17)}.eyJ{draw(alnum, 30)}.{draw(alnum + '-_', 43)}",
    )
    lower = string.ascii_lowercase
    plain = (
        lambda: draw(lower, rng.randint(10, 30)),
        lambda: draw(lower, rng.randint(10, 30)).capitalize() + rng.choice(("", ".", "...")),
        lambda: draw(string.ascii_uppercase, rng.randint(10, 30)),
        lambda: rng.choice("-_./").join(draw(lower, rng.randint(2, 9)) for _ in range(rng.randint(3, 6))),
        lambda: "www." + draw(lower, 9) + ".example.com/" + draw(lower, 6) + "/" + draw(string.digits, 3),
        lambda: draw(string.digits, rng.randint(8, 20)),
        lambda: "-".join(draw(string.digits, rng.randint(2, 4)) for _ in range(rng.randint(3, 5))),
        lambda: rng.choice("=-_.+") * rng.randint(10, 60),
        lambda: draw(lower, 8) + "." + draw(lower, 6) + draw(string.digits, 3),
    )
    return [f() for f in formats for _ in range(PER_FORMAT)], [f() for f in plain for _ in range(PER_FORMAT)]


class Automaton:
    """A deterministic probabilistic automaton: per state, visits, ends, and (next state, count) by symbol."""

    def __init__(self, samples: Iterable[str]) -> None:
        self.visits, self.ends, self.next = [0], [0], [{}]
        for text in samples:
            at = 0
            self.visits[0] += 1
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                self.next[at][c][1] += 1
                at = self.next[at][c][0]
                self.visits[at] += 1
            self.ends[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        """Hoeffding's bound on the difference of two observed shares."""
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], na, self.ends[b], nb, bound):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, na, y[1] if y else 0, nb, bound):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree, which no other state points into, onto a state."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (to, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, n]

    def merged(self, alpha: float = ALPHA) -> Automaton:
        """Merge statistically compatible states: settled states, and their frontier tried against each in turn."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        inside = {0}
        while True:
            frontier = [(self.visits[to], -s, c, to, s) for s in settled for c, (to, _) in self.next[s].items() if to not in inside]
            if not frontier:
                return self
            _, _, c, state, parent = max(frontier)
            for s in settled:
                if self._compatible(s, state, bound):
                    self.next[parent][c][0] = s
                    self._fold(s, state)
                    break
            else:
                settled.append(state)
                inside.add(state)

    def table(self, symbols: int = 14) -> dict:
        """{state: ({symbol: (log-probability, next)}, log-probability of any other symbol)}, add-half smoothed."""
        found, todo = {}, [0]
        while todo:
            s = todo.pop()
            if s in found:
                continue
            whole = self.visits[s] + 0.5 * (symbols + 1)
            found[s] = ({c: (math.log((n + 0.5) / whole), to) for c, (to, n) in self.next[s].items()}, math.log(0.5 / whole))
            todo += [to for to, _ in self.next[s].values()]
        return found


def infer() -> tuple[dict, dict]:
    """The automata of credentials and of plain tokens."""
    secret, plain = labelled()
    classes = lambda xs: [x.translate(_CLASSES) for x in xs]
    return Automaton(classes(secret)).merged().table(), Automaton(classes(plain)).merged().table()


def likelihood(table: dict, classes: str) -> float:
    """Log-likelihood of a string of classes; after a symbol that its state never saw it starts anew."""
    at, total = 0, 0.0
    for c in classes:
        row, other = table[at]
        step = row.get(c)
        if step is None:
            total += other
            at = 0
        else:
            total += step[0]
            at = step[1]
    return total


def scan(text: str, automata: tuple[dict, dict], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) in code points: the fixed rules', and what they leave of candidates, where its format is likely."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found, reach, at = list(base), 0, 0
    for m in CANDIDATE.finditer(text):
        start, pieces = max(m.start(), reach), []
        while at < len(base) and base[at][0] < m.end():
            pieces.append((start, base[at][0]))
            reach = max(reach, base[at][2])
            start = max(start, reach)
            at += 1
        for a, b in [*pieces, (start, m.end())]:
            if b - a < SHORTEST:
                continue
            classes = text[a:b].translate(_CLASSES)
            if likelihood(automata[0], classes) - likelihood(automata[1], classes) > ratio * len(classes):
                found.append((a, 3, b))
    found.sort()
    return found


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def find(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``docs`` with a struct column ``_secrets`` (``_secrets_`` if taken): spans (kind, start, end) in order. Null texts are empty.

    Each row is read by itself and whole, so repeated rows are alike and an empty table gives no
    rows; very long texts take time in proportion. Spans that begin together come in the order
    of the kinds. The automata are inferred on the driver from the labelled strings, a few hundred, and are
    the same in every run; documents are read in a map without any shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(infer())

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automata = sent.value
        for batch in texts:
            yield pd.Series([[(KINDS[k], a, b) for a, k, b in scan(x or "", automata, ratio)] for x in batch])

    found = packed(docs, "text").select("row", spans(F.col("text")).alias("found"))
    return found.select("row.*", F.col("found").alias(spare_name(docs, "_secrets")))


def query(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text")).select("doc_id", F.col("_secrets").alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("s", lambda x: x["kind"] != "format"), text), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("s", text), ",").alias("spans"),
        count("format").alias("n_format"),
    )


