"""Personal data: patterns as evidence, and a skip-chain conditional random field that carries it to other mentions.

Patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers; these base spans always stay. The
field's nodes are a document's mentions: numbers in any grouping, words with an `@`, and words that are the name part of an address
of the document (`ann.lee` in one word, or `Ann Lee` in two). Labels are private or not. Mentions that stand side by side are tied by
chain edges. Mentions that are the same or similar are tied by skip edges, each to the next in the document with the same key: equal text, equal
name part, equal last seven digits, or digits that differ by one digit (changed, missing or too many; of their last nine, changed). So distant mentions share potentials and a document's
label for an entity is consistent. Mentions of base spans are observed. Loopy belief propagation gives the other mentions' marginals; those of at least
MARGINAL that a skip edge ties to something become spans of kind `linked`. Every document with mentions that are tied is judged, with base spans or without.

Weights are learnt by pseudo-likelihood: a mention's label given its features and its neighbours' labels. Each mention of the sample is
seen twice: as it is, and with its surface masked, so that its label has to come from its neighbours; without that, features
alone would give the label and the skip weight would be learnt from nothing. Mentions that are tied to a base span but are none are latent: they are left out of a first
fit and enter the second with the label that the field gives them by the first. The fit sees at most MOST_DOCS documents and MOST_NODES mentions, those with the
smallest hashes; everything else covers all whole texts.

Free style (Arrow batches). Edge cases: null text counts as empty and has no spans; null ids, and ids of any size, come out as they are; repeated rows have
the same spans; mentions never overlap, so there are no ties of place; very long texts are scanned in linear time, and only numbers of at most LONGEST digits are compared
digit by digit (longer ones only as a whole); without private and other mentions in the sample nothing is learnt and only base spans
come out; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import in_batches, scratch, ship, smallest

ship(__name__)

KINDS = ("email", "ip", "card", "phone", "linked")
MARGINAL = 0.9
OBSERVED = 8.0
ROUNDS = 15
MOST_DOCS, MOST_NODES = 4_000, 40_000
#: Weights on chain and skip edges at most: belief propagation has to stay calm on loops. A skip edge has this weight where documents don't say otherwise.
MOST_TIED = 4.0
#: Digits of numbers that are compared digit by digit: from eight, as shorter ones are too often alike.
SHORTEST, LONGEST = 8, 24
#: Digits of a number's end that are compared whatever stands before them.
NATIONAL = 9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# no match can start inside a run of digits that its beginning could not; the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: A number in any grouping, not attached to letters.
_NUMBER = re.compile(r"(?<![0-9A-Za-z_])\+?\(?[0-9]+(?:[\x20().\-/]{1,2}[0-9]+)*(?![0-9A-Za-z_])")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'*%$#&|"
#: Groups of a number that stand apart by spaces have so many digits at most; longer ones are numbers of their own.
_GROUPED = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has one @, and starts as far left of it as its characters go: found from the @ signs in linear time."""
    over, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > over and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            over = m.end()
        at = text.find("@", max(at + 1, over))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        if "." in text:
            spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(spans)


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Spans of numbers: groups that spaces part are one number only if they are short, as in written phone and card numbers."""
    for m in _NUMBER.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        begin, last = m.start(), None
        for a, b in groups:
            if last and " " in text[last[1] : a] and (b - a > _GROUPED or last[1] - last[0] > _GROUPED):
                yield begin, last[1]
                begin = a - (text[a - 1] == "(")
            last = a, b
        yield begin, last[1]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, sort: number, address or name), sorted, without overlaps."""
    found = []
    at, over = text.find("@"), 0
    while at >= 0:  # the word around each @
        s, e = at, at
        while s > over and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        core = text[s:e].strip(_EDGE)
        if "@" in core.strip("@"):
            s = text.index(core, s)
            found.append((s, s + len(core), "address"))
        over = e
        at = text.find("@", e)
    names = {text[a : text.index("@", a)].lower() for a, kind, _ in base if kind == 0}
    if names:
        before = None
        for m in _WORD.finditer(text):
            core = m.group().strip(_EDGE)
            start = m.start() + m.group().find(core)
            low = core.lower()
            if low in names:
                found.append((start, start + len(core), "name"))
            elif before and before[1].isalpha() and low.isalpha() and any(f"{before[1]}{sep}{low}" in names for sep in (".", "_", "-", "")) and text[before[2] : start].strip() == "":
                found.append((before[0], start + len(core), "name"))
            before = (start, low, start + len(core))
    if any(d in text for d in "0123456789"):
        taken = sorted(found)
        begins, ends = [a for a, _, _ in taken], np.array([b for _, b, _ in taken])
        for a, b in _numbers(text):
            i = np.searchsorted(begins, b)
            if not i or ends[i - 1] <= a:
                found.append((a, b, "number"))
    out: list[tuple[int, int, str]] = []
    for x in sorted(found):
        if not out or out[-1][1] <= x[0]:
            out.append(x)
    return out


def keys_of(text: str, sort: str) -> set[str]:
    """What makes mentions similar: mentions that share a key are tied."""
    low = text.lower()
    if sort == "address":
        return {f"@{low}", f"n{re.sub('[^a-z0-9]', '', low.partition('@')[0])}"}
    if sort == "name":
        return {f"n{re.sub('[^a-z0-9]', '', low)}"}
    digits = _NOT_DIGIT.sub("", text)
    keys = {f"={digits}"} if len(digits) >= 6 else set()
    if len(digits) >= 7:
        keys.add(f"#{digits[-7:]}")
    if SHORTEST <= len(digits) <= LONGEST:
        # two numbers that differ by one digit share what is left when it is taken out
        keys |= {f"-{digits[:i]}{digits[i + 1 :]}" for i in range(len(digits))} | {f"-{digits}"}
    if NATIONAL <= len(digits) <= LONGEST:
        # and so do their ends, with a country's code or without
        keys |= {f"~{digits[-NATIONAL:][:i]}?{digits[-NATIONAL:][i + 1 :]}" for i in range(NATIONAL)}
    return keys


N_FEATURES = 16


def _features(text: str, sort: str, beside: int) -> list[float]:
    digits = _NOT_DIGIT.sub("", text)
    n = len(digits) if sort == "number" else 0
    return [
        1.0, sort == "address", sort == "name", text.startswith("+"), 0 < n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 15, n >= 16,
        " " in text, "-" in text, "(" in text, sort == "number" and text.count(".") == 3, 12 <= n <= 19 and luhn(digits), beside > 0, 0.0,
    ]


#: The place of the feature that stands for a masked surface; all others are 0 beside it but the first.
MASKED = N_FEATURES - 1


class Field:
    """The field of one document: mentions, which of them are observed, features, chain and skip edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        found = mentions(text, base)
        self.spans = [(a, b) for a, b, _ in found]
        n = len(found)
        self.observed = np.zeros(n, bool)
        begins, ends = np.array([s for s, _, _ in base]), np.sort([e for _, _, e in base])
        for j, (a, b) in enumerate(self.spans):  # as many spans begin before the mention ends as end before it begins: none meets it
            self.observed[j] = np.searchsorted(begins, b) > np.searchsorted(ends, a, side="right")
        self.chain = [(j, j + 1) for j in range(n - 1) if found[j + 1][0] - found[j][1] <= 3 and not text[found[j][1] : found[j + 1][0]].strip(" \t,;/|")]
        beside = np.zeros(n, int)
        for a, b in self.chain:
            beside[a] += 1
            beside[b] += 1
        self.x = np.array([_features(text[a:b], sort, k) for (a, b, sort), k in zip(found, beside, strict=True)], np.float64).reshape(n, N_FEATURES)
        skip, last = set(), {}
        for j, (a, b, sort) in enumerate(found):
            for key in keys_of(text[a:b], sort):
                if key in last:
                    skip.add((last[key], j))
                last[key] = j
        self.skip = sorted(skip)
        self.tied = np.zeros(n, bool)
        self.latent = np.zeros(n, bool)
        for a, b in self.skip:
            self.tied[[a, b]] = True
            self.latent[a] |= self.observed[b]
            self.latent[b] |= self.observed[a]
        self.latent &= ~self.observed

    def sums(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of labels y (-1 to 1) over chain neighbours and over skip neighbours."""
        out = []
        for edges in (self.chain, self.skip):
            s = np.zeros(len(y))
            for a, b in edges:
                s[a] += y[b]
                s[b] += y[a]
            out.append(s)
        return out[0], out[1]

    def marginals(self, w: np.ndarray) -> np.ndarray:
        """Probability of private by loopy belief propagation; w: feature weights, then chain and skip."""
        field = np.where(self.observed, OBSERVED, self.x @ w[:N_FEATURES])
        edges = np.array(self.chain + self.skip, np.int64).reshape(-1, 2)
        if not len(edges):
            return 1 / (1 + np.exp(-field))
        tie = np.tanh(np.r_[np.full(len(self.chain), w[-2]), np.full(len(self.skip), w[-1])] / 2)
        a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        tie, back = np.r_[tie, tie], np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        message = np.zeros(len(a))
        for _ in range(ROUNDS):
            belief = field + np.bincount(b, message, len(field))
            new = 2 * np.arctanh(tie * np.tanh(np.clip(belief[a] - message[back], -30, 30) / 2))
            message = 0.5 * message + 0.5 * new
        return 1 / (1 + np.exp(-np.clip(field + np.bincount(b, message, len(field)), -60, 60)))


def linked_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans that the field adds."""
    f = Field(text, base)
    if not f.skip:
        return []
    p = f.marginals(w)
    return [(a, 4, b) for j, (a, b) in enumerate(f.spans) if f.tied[j] and not f.observed[j] and p[j] >= MARGINAL]


def training_rows(text: str, w: np.ndarray | None) -> list[tuple[float, np.ndarray]]:
    """(label, features and neighbour sums) of a document's mentions, each as it is and masked. Without weights latent mentions are left out;
    with weights the likelier label is theirs."""
    f = Field(text, base_spans(text))
    if not f.spans:
        return []
    p = np.where(f.observed, 1.0, 0.0)
    if w is not None and f.latent.any():
        p = np.where(f.latent, (f.marginals(w) >= 0.5).astype(float), p)
    chain, skip = f.sums(2 * p - 1)
    rows = []
    for j in np.flatnonzero(~f.latent if w is None else np.ones(len(p), bool)):
        rows.append((p[j], np.r_[f.x[j], chain[j], skip[j]]))
        masked = np.zeros(N_FEATURES)
        masked[[0, MASKED]] = 1.0
        rows.append((p[j], np.r_[masked, chain[j], skip[j]]))
    return rows


def _maker(w: np.ndarray | None):
    def make():
        def work(texts: list) -> tuple[list, list]:
            at, labels, rows = [], [], []
            for i, text in enumerate(texts):
                for label, x in training_rows(text, w) if text else ():
                    at.append(i)
                    labels.append(label)
                    rows.append(x)
            return at, [pa.array(range(len(at)), pa.int64()), pa.array(labels, pa.float64()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))]

        return work

    return make


def fit(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weights of least log pseudo-likelihood, by Adam, drawn to 0 but for the skip weight, which is drawn to MOST_TIED: similar mentions are of one
    kind unless documents say otherwise. Edge weights stay between 0 and MOST_TIED."""
    prior = np.r_[np.zeros(N_FEATURES + 1), MOST_TIED]
    w, m, v = prior.copy(), 0.0, 0.0
    for t in range(1, 501):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + 1e-3 * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[-2:] = np.clip(w[-2:], 0, MOST_TIED)
    return w


def train(docs: DataFrame) -> np.ndarray | None:
    """Weights from a bounded sample, or None if it lacks either label."""
    picked = scratch(smallest(docs.select("doc_id").where("doc_id IS NOT NULL"), MOST_DOCS, 5).distinct())
    texts = scratch(docs.join(F.broadcast(picked), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))  # so many ids, and texts, at most
    w = None
    for _ in range(2):
        rows = in_batches(texts, _maker(w), "text", "place long, label double, x array<double>", ["doc_id"])
        got = rows.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(2 * MOST_NODES).select("label", "x").toPandas()
        y = got["label"].to_numpy(float)
        if not (y > 0.5).any() or (y > 0.5).all():
            return None
        w = fit(y, np.array(got["x"].tolist()))
    return w


def find(docs: DataFrame, w: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts of base kinds, base_sha256, spans, n_linked)."""

    def make():
        import hashlib

        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

        def work(texts: list) -> tuple[list, list]:
            columns: list[list] = [[] for _ in range(7)]
            for t in texts:
                base = base_spans(t) if t else []
                more = linked_spans(t, base, w) if t and w is not None else []
                n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                for column, value in zip(columns, (*n, hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + more)), len(more)), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            return list(range(len(texts))), [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]

        return work

    return in_batches(docs, make, text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_linked long", [key])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, train(docs))
