"""Secret scans: fixed token shapes, and guess costs of the values that stand in credential contexts.

The guess cost of a value is the least cost of any segmentation into words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming over all starts of each kind.
Costs are decimal logarithms of the guesses that a segment takes.  Words have the rank of a
fixed list of common passwords, then that of the corpus's own most frequent words.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import log10

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import keep, pieces, release, table
from granary.llm.spans import count_of, joined, scan_documents

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "guess"]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: More contexts than the base has, and any value without white space.
_CONTEXT = re.compile(
    r"(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|credentials?|bearer|(?:access|private|client|signing|encryption)[_-]?(?:key|secret))"
    r"[\"']?[\x20\t]{0,4}(?::=|=>|->|[:=]|\bis\b)[\x20\t]{0,4}[\"'`]?([^\s\"'`<>]{6,})",
    re.I | re.A,
)
_CONTEXT_KEYS = (*_KEYWORDS, "passphrase", "passcode", "pwd", "api-key", "credential", "bearer", "key")

#: Common passwords and words in them, the most frequent first.
WORDS = [
    "password", "123456", "12345678", "qwerty", "abc123", "letmein", "monkey", "dragon", "iloveyou", "admin",
    "welcome", "login", "master", "hello", "freedom", "whatever", "trustno1", "sunshine", "princess", "football",
    "baseball", "shadow", "superman", "batman", "michael", "jennifer", "jordan", "hunter", "ranger", "buster",
    "soccer", "hockey", "killer", "george", "charlie", "andrew", "thomas", "robert", "daniel", "jessica",
    "pepper", "summer", "winter", "spring", "autumn", "secret", "test", "guest", "root", "user",
    "love", "money", "access", "changeme", "default", "example", "sample", "demo", "pass", "passwd",
    "token", "apikey", "key", "server", "system", "service", "account", "company", "office", "private",
    "public", "database", "backup", "manager", "internet", "computer", "google", "windows", "linux", "cookie",
    "cheese", "coffee", "orange", "banana", "apple", "purple", "yellow", "green", "black", "white",
    "tiger", "eagle", "falcon", "phoenix", "diamond", "silver", "golden", "the", "and", "your",
]
#: Keyboard rows.
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
#: What is known without a corpus: word -> rank.
COMMON = {w: i + 1 for i, w in enumerate(WORDS)}
#: The corpus's most frequent words that are ranked after those, and the letters that one may have.
VOCABULARY, SHORTEST, LONGEST = 20_000, 3, 24
_LEET = str.maketrans("@4310$57!", "aaeiossti")
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
_DATE_SIZES = (10, 9, 8, 7, 6, 4)
_SEGMENT = log10(2)
_TURN = log10(4)


class _Starts:
    """Where a run of repeats or a walk may begin: the least of base[k] + log10(e - k) for growing e.

    A later start with a base no greater is better for good; an earlier one that is better now
    stays better.  So the starts kept have growing bases and are few, and none is left out.
    """

    def __init__(self):
        self.kept: list[tuple[int, float]] = []

    def add(self, k: int, base: float) -> None:
        while self.kept and self.kept[-1][1] >= base:
            self.kept.pop()
        self.kept.append((k, base))

    def best(self, e: int) -> tuple[float, int]:
        priced = [(base + log10(e - k), k) for k, base in self.kept]
        # A start that an earlier one beats now is beaten from now on.
        stay, least = [], float("inf")
        for cost, k in priced:
            if cost < least:
                stay.append(k)
                least = cost
        if len(stay) < len(self.kept):
            names = set(stay)
            self.kept = [x for x in self.kept if x[0] in names]
        return min(priced)


def _pool(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33


def word_price(part: str, vocabulary: dict[str, int]) -> float | None:
    """What a segment costs as a word, in its own or in replaced letters; None if it is none."""
    low = part.lower()
    rank, price = vocabulary.get(low), 0.0
    if rank is None and (rank := vocabulary.get(low.translate(_LEET))):
        price = log10(4)
    if not rank:
        return None
    return price + log10(rank + 1) + (0 if part == low else log10(2 if part.istitle() or part.isupper() else len(part)))


def guess_cost(value: str, vocabulary: dict[str, int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """The least cost of a segmentation of a value, and that segmentation as (kind, start, end)."""
    vocabulary = COMMON if vocabulary is None else vocabulary
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer stands for itself
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    best, brute = array("d", bytes(8 * (n + 1))), array("d", [float("inf")]) * (n + 1)
    kind, back, begin = bytearray(n + 1), array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    dates: dict[int, list[int]] = {}
    for i in range(n - 3):
        if value[i].isdigit():
            for size in _DATE_SIZES:
                if i + size <= n and _DATE.fullmatch(value, i, i + size):
                    dates.setdefault(i + size, []).append(i)
    runs, walks, run, walk, turns = _Starts(), _Starts(), 0, 0, 0
    turned = [0, 0]  # turns up to the last two characters
    for e in range(1, n + 1):
        i = e - 1
        pool = _pool(value[i])
        # A brute-force span goes on at the cost of its characters alone.
        if best[i] + _SEGMENT < brute[i]:
            brute[e], begin[e] = best[i] + _SEGMENT + log10(pool), i
        else:
            brute[e], begin[e] = brute[i] + log10(pool), begin[i]
        cost, name, at = brute[e], 0, begin[e]
        for k in range(max(0, e - LONGEST), e - SHORTEST + 1):
            price = word_price(value[k:e], vocabulary)
            if price is not None and best[k] + price + _SEGMENT < cost:
                cost, name, at = best[k] + price + _SEGMENT, 1, k
        for k in dates.get(e, ()):
            if (price := best[k] + log10(365 * 120) + _SEGMENT) < cost:
                cost, name, at = price, 2, k
        if i and value[i] != value[i - 1]:
            run, runs = i, _Starts()
        if e - run >= 3:
            runs.add(e - 3, best[e - 3])
            price, k = runs.best(e)
            if price + log10(pool) + _SEGMENT < cost:
                cost, name, at = price + log10(pool) + _SEGMENT, 3, k
        if i and (low[i - 1], low[i]) not in _NEXT:
            walk, walks, turns = i, _Starts(), 0
            turned = [0, 0]
        elif i > walk + 1 and low[i - 2] == low[i]:
            turns += 1
        if e - walk >= 3:
            # Turns after the second character of a walk are its own.
            walks.add(e - 3, best[e - 3] - _TURN * turned[1])
            price, k = walks.best(e)
            price += log10(47) + _TURN * turns + _SEGMENT
            if price < cost:
                cost, name, at = price, 4, k
        turned = [turned[1], turns]
        best[e], kind[e], back[e] = cost, name, at
    parts, e = [], n
    while e:
        parts.append((("brute", "word", "date", "repeat", "walk")[kind[e]], back[e], e))
        e = back[e]
    return best[n], parts[::-1]


def scan(text: str, least: float = 10.0, vocabulary: dict[str, int] | None = None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 guesses) of all secrets of a text, by start, then kind."""
    out = []
    low = text.lower()
    cost = lambda value: guess_cost(value, vocabulary)[0]
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end(), cost(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), cost(m[0][4:])) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), (m.end() - m.start()) * log10(16)) for m in _HEX.finditer(text)]
    if any(k in low for k in _CONTEXT_KEYS):
        # What base spans cover, as disjoint stretches in order.
        covered: list[list[int]] = []
        for _, a, b, _ in sorted(out, key=lambda s: s[1]):
            if covered and a < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        ends = [b for _, b in covered]
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            a, b = m.start(1), m.start(1) + len(value)
            k = bisect_right(ends, a)
            if len(value) >= 6 and not (k < len(covered) and covered[k][0] < b) and (price := cost(value)) >= least:
                out.append(("guess", a, b, price))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _word_counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    find = re.compile(rb"(?<![a-z])[a-z]{%d,%d}(?![a-z])" % (SHORTEST, LONGEST)).findall
    for batch in batches:
        for part in pieces(batch, "text"):
            counts = Counter(find(b"\n".join(t for t in part.column("text").cast(pa.binary()).to_pylist() if t).lower()))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def ranked_words(docs: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """Common passwords, then the `most` most frequent words of all texts (3 to 24 letters a-z, any case) -> their ranks.

    Counted over every whole text.  Of words, only those that come often enough to be among the
    first `most` reach the driver: numbers of words by the logarithm of their counts say how often.
    """
    counts = keep(docs.select(F.col("text").cast("string")).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    step = F.floor(64 * F.log2("n")).cast("int")
    least, above = 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # 4,096 rows at most
        least, above = r["step"], above + r["words"]
        if above >= most:
            break
    top = counts.filter(step >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    release(counts)
    return COMMON | {w: len(COMMON) + i for i, w in enumerate((r["word"] for r in top if r["word"] not in COMMON), 1)}


def secrets(docs: DataFrame, vocabulary: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, spans): all secrets of every whole text, with the decimal logarithm of each one's guesses as score.

    Words are those of the vocabulary (word -> rank), by default those of docs themselves.  A null text counts as empty and has no spans; null doc_ids and repeated rows are returned as
    they come; an empty table gives an empty result; further columns are ignored.
    """
    known = ranked_words(docs) if vocabulary is None else vocabulary
    return scan_documents(docs, partial(scan, vocabulary=known))


def redact(text: str, mark: str = "[secret]", vocabulary: dict[str, int] | None = None) -> str:
    """The text with each of its secrets, overlapping ones together, replaced by a mark."""
    out, at, end = [], 0, -1
    for _, a, b, _ in scan(text, vocabulary=vocabulary):
        if a >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    return "".join([*out, mark, text[end:]]) if end >= 0 else text


def _redacted(batches: Iterator, known: dict[str, int]) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "text"):
            texts = part.column("text").to_pylist()
            clean = [t and redact(t, vocabulary=known) for t in texts]
            part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(clean, part.schema.field("text").type))
            if "n_chars" in part.schema.names:
                field = part.schema.field("n_chars")
                counts = [n if a == b else len(b) for n, a, b in zip(part.column("n_chars").to_pylist(), texts, clean)]
                part = part.set_column(part.schema.get_field_index("n_chars"), field, pa.array(counts, field.type))
            yield part


def redacted(docs: DataFrame, vocabulary: dict[str, int] | None = None) -> DataFrame:
    """The rows of docs, with all their columns: secrets in text replaced, n_chars (if there) counted anew where they were.

    Null and empty texts stay as they are, and so do null ids and repeated rows; no row goes.  An
    empty table gives an empty result; further columns are kept, whatever their names.
    """
    known = ranked_words(docs) if vocabulary is None else vocabulary
    return docs.mapInArrow(lambda b: _redacted(b, known), docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(BASE), 256).alias("base_sha256"), joined().alias("spans"), count_of("guess").alias("n_guess"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_log10_guesses")
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE: dict[str, str] = {}
