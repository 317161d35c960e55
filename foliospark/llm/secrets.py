"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models, each trained from labelled samples, give the log-likelihood of a candidate token. A
token is taken for a secret if the ratio in favour of the random model is large for its length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns

#: The fixed patterns, in the order in which spans of one start are listed: pattern, group and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: As hex above: runs under the least length need not be found to be dropped.
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
#: The kind that the models add, listed last.
RANDOM = "random"
#: Candidates for the models.
CANDIDATE = re.compile(r"[A-Za-z0-9_+=/-][A-Za-z0-9_+=/.-]{14,}[A-Za-z0-9_+=/-]")
#: What a candidate's mean log-likelihood ratio a character has to exceed, in nats.
THRESHOLD = 0.35
#: Labelled samples of either kind, and the seed that makes them.
SAMPLES, SAMPLE_SEED = 4000, 8
#: Words of which ordinary identifiers are made.
PARTS = (
    "account active address archive async batch buffer build cache call channel check client close cluster code column commit config connect content "
    "context copy count create current data date default delete detail device document driver edit element enable encode entry error event export "
    "factory field file filter find first format frame function get group handle handler header hidden index init input insert internal invoice item "
    "join key label last layer length level line link list load local lock log manager map match max member merge message method min mode model module "
    "name network next node number object offset open option order output owner package page parent parse path payment pending pool port prefix process "
    "product profile project property query queue random range rate read record region release remove render report request reset resource response "
    "result retry return role root route row rule sample schema scope search section select send server service session set shape size sort source "
    "stack start state status step stop store stream string style submit suffix summary sync table target task template test text thread time title "
    "total trace transfer tree type update upload user value vector version view visible wait width window worker write zone "
    "und oder nicht eine dieser werden haben sein durch zwischen arbeit zeit stadt schule freund wasser sprache geschichte verbindung "
    "avec pour dans sans entre maison travail temps ville jeune histoire langue liberté monde propos question "
    "para entre sobre trabajo tiempo ciudad amigo nuevo historia lengua mundo palabra cuando siempre "
    "come quando lavoro tempo nuovo storia lingua parola mondo para como quando trabalho cidade novo palavra mundo "
    "there other every under after would could should which where being thing people about before between"
).split()
#: Characters with a state of their own; all others share one.
ALPHABET = {c: i for i, c in enumerate(string.ascii_letters + string.digits + "_+=-/.")}
OTHER, START = len(ALPHABET), len(ALPHABET) + 1


def samples(n: int = SAMPLES, seed: int = SAMPLE_SEED) -> list[tuple[str, int]]:
    """Labelled strings, n of either kind: 1 random ones of common alphabets, 0 identifiers made of words."""
    rng, out = random.Random(seed), []
    pools = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.digits + "abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "-_"]
    for i in range(n):
        out.append(("".join(rng.choices(pools[i % len(pools)], k=rng.randint(16, 48))), 1))
        parts = rng.choices(PARTS, k=rng.randint(2, 5))
        style = i % 8
        word = ("_".join(parts), "-".join(parts), "".join(p.title() for p in parts), parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper(), "".join(parts), "/".join(parts), ".".join(parts))[style]
        if rng.random() < 0.25:
            word += rng.choice(("", "_", "-", "v")) + str(rng.randint(0, rng.choice((9, 99, 2030))))
        out.append((word, 0))
    return out


@dataclass(frozen=True)
class Ratio:
    """Log-likelihood ratios of character pairs, random over ordinary."""

    table: tuple[tuple[float, ...], ...]

    @classmethod
    def train(cls, labelled: Iterable[tuple[str, int]], smoothing: float = 0.5) -> Ratio:
        size = START + 1
        counts = [[[smoothing] * size for _ in range(size)] for _ in range(2)]
        for text, label in labelled:
            before = START
            for c in text:
                now = ALPHABET.get(c, OTHER)
                counts[label][before][now] += 1
                before = now
        log = [[[math.log(x / sum(row)) for x in row] for row in model] for model in counts]
        return cls(tuple(tuple(log[1][a][b] - log[0][a][b] for b in range(size)) for a in range(size)))

    def score(self, text: str) -> float:
        """Mean ratio a character."""
        total, before = 0.0, START
        for c in text:
            now = ALPHABET.get(c, OTHER)
            total += self.table[before][now]
            before = now
        return total / max(1, len(text))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns' matches, dropped if their group is short."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        for m in (HEX_RUN if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), place, m.end()))
    return found


def random_spans(text: str, ratio: Ratio, taken: list[tuple[int, int, str]], threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Spans of candidates, apart from the taken ones, that the random model explains better.

    The ratio decides for all that have a letter; numbers and ruled lines have none.
    """
    out = []
    ends = sorted((a, e) for a, _, e in taken)
    i, reach = 0, 0  # spans that begin before the candidate ends, and how far they go
    for m in CANDIDATE.finditer(text):
        token = m[0]
        while i < len(ends) and ends[i][0] < m.end():
            reach, i = max(reach, ends[i][1]), i + 1
        if token.upper() != token.lower() and reach <= m.start() and ratio.score(token) > threshold:
            out.append((m.start(), len(BASE), m.end()))
    return out


def labelled_rows(rows: DataFrame, text: str = "text", label: str = "label", n: int = SAMPLES) -> list[tuple[str, int]]:
    """At most ``n`` strings of either label (1 random, 0 ordinary) from a labelled table, to train on: those of the least hashes.

    ``n`` bounds what comes to the driver, whatever the table's size. Null strings and labels other than 0 and 1 are left out;
    equal rows count as one; an empty table gives an empty list, which trains models that know nothing.
    """
    good = rows.select(F.col(f"`{text}`").alias("s"), F.col(f"`{label}`").cast("int").alias("l")).filter("s IS NOT NULL AND l IN (0, 1)").distinct()
    chosen = [good.filter(F.col("l") == k).orderBy(F.xxhash64("s"), "s").limit(n) for k in (0, 1)]
    return [(r.s, r.l) for part in chosen for r in part.collect()]


def listed(spans: Iterable[tuple[int, int, str]]) -> str:
    names = [*(b[0] for b in BASE), RANDOM]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, labelled: Iterable[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Each row with n_assign, n_access, n_hex, n_random, base_sha256 and ``spans`` (kind:start:end, code points).

    ``labelled`` holds (string, 1 for random or 0 for ordinary), as labelled_rows takes them from a table; the default is 2 x SAMPLES made
    ones. A null text
    is an empty one, without spans. Rows are independent, so repeated rows agree; an empty table gives an empty
    one; other columns pass unless they have one of the new names.
    """
    ratio = Ratio.train(samples() if labelled is None else labelled)

    def run(texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
        for value in texts:
            base = base_spans(value or "")
            more = random_spans(value or "", ratio, base, threshold)
            for place, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(1 for s in base if s[1] == place))
            out["n_random"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed([*base, *more]))
        return out

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_random")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_columns(df, [text], run, T.StructType(fields), keep)
