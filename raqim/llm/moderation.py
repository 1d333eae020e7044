"""Severity of abusive, hateful or sexual language, by cumulative-link ordinal regression.

Documents are read sentence by sentence, since a single sentence makes a document
abusive. Features are words and pairs of words after masking is undone (stretched or
spaced letters, vowel marks, tatweel, signs inside words). The grades of reviewers (0 no,
1 disputed, 2 agreed) are fitted with one weight per feature, shared by both thresholds;
within a graded document the sentence of highest score stands for it, chosen anew in each
round. A label is taken to be wrong with probability ``NOISE``, which bounds what a single
one can do; none is left out. The score of a document is the expected severity of its worst
sentence; a sentence without two features apart that speak for abuse scores 0.

The model is fitted on at most ``most_labels`` labelled documents of together at most
``most_chars`` characters (parameters; chosen by hash of the key), and broadcast; only
features met in ``least_docs`` of those graded above 0 have a weight, so its size is bounded
by the sample. All documents are scored.

Defined cases: null, empty and blank texts score 0; null labels are left out, and so are
labels of missing documents; without any graded document all scores are 0; repeated
documents each come out, and the labels of equal texts are those of one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raqim.operators.lineage import cut

#: Probability that a label is wrong.
NOISE = 0.01
#: Share of the documents holding a feature that speaks for abuse which are objected to, at least. A phrase that only
#: stands more often in such documents than in others (the title of an opinion) doesn't make them so.
PURE = 0.8
#: Share of the features more frequent in such documents that may be so by chance (Benjamini and Hochberg).
FALSE = 0.05

_END = re.compile(r"[.!?؟;؛:\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_MASK = re.compile(r"(?<=[^\W\d_])[*#%&·•]+(?=[^\W\d_])")
_SIGN = re.compile("[*#%&·•]")
_LEET = re.compile(r"[013457@$](?<=[^\W\d_].)(?=[^\W\d_])")
#: Digits and signs written for letters.
_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SPACED = re.compile(r"(?<![^\W_])((?:[^\W\d_][ .\-]){3,}[^\W\d_])(?![^\W_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
#: Letters written alike.
_ALIKE = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ـ": ""}


class _Plain(dict):
    def __missing__(self, point: int) -> str:
        c = _ALIKE.get(chr(point), chr(point)).casefold()
        self[point] = got = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Mn", "Cf"))
        return got


_PLAIN = _Plain()
#: Code points without a single one in their place: none (0), or several (_MANY).
_MANY, _UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE
_TABLE = np.full(0x110000, _UNKNOWN, np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _plain(text: str) -> str:
    """``text.translate(_PLAIN)``, by one lookup of all its code points."""
    points = _points(text)
    got = _TABLE[points]
    if (new := got == _UNKNOWN).any():
        for p in set(points[new].tolist()):
            to = _PLAIN[p]
            _TABLE[p] = _MANY if len(to) > 1 else ord(to) if to else 0
        got = _TABLE[points]
    if (got == _MANY).any():
        return text.translate(_PLAIN)
    return got[got != 0].tobytes().decode("utf-32-le", "surrogatepass")


def unmasked(text: str) -> str:
    """``text`` in plain letters with masking undone. The patterns run only where a cheap look at the letters shows what they look for."""
    if _SIGN.search(text):
        text = _MASK.sub("", text)
    text = _plain(_LEET.sub(lambda m: _FOR[m[0]], text))
    points = _points(text)
    if len(points) > 2 and ((points[:-2] == points[2:]) & (points[1:-1] == points[2:]) & (points[2:] > 64)).any():
        text = _LONG.sub(r"\1", text)
        points = _points(text)
    if len(points) > 6:
        gap = (points == 32) | (points == 45) | (points == 46)
        if (gap[1:-5] & gap[3:-3] & gap[5:-1] & ~gap[2:-4] & ~gap[4:-2]).any():
            text = _SPACED.sub(lambda m: re.sub(r"[ .\-]", "", m[1]), text)
    return text


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, with masking undone."""
    return [w for s in _END.split(unmasked(text)) if (w := _WORD.findall(s))]


def features(words: list[str]) -> set:
    return {*words, *zip(["", *words], [*words, ""])}


def grade(votes: list[int]) -> int:
    """0 if no reviewer objects, 2 if all do, else 1."""
    return 0 if not any(votes) else 2 if all(votes) else 1


class Ordinal:
    """Cumulative-link regression: P(grade >= k) = sigmoid(w.x - cut_k), one w for all k."""

    def __init__(self, weights: dict, cuts: tuple[float, ...], raising: frozenset[str] = frozenset()):
        """``raising`` are words of which every sentence that speaks for abuse holds one."""
        self.weights, self.cuts, self.raising = weights, cuts, raising

    def expected(self, text: str) -> float:
        """Expected severity of the worst sentence, between 0 and the number of cuts."""
        text = unmasked(text)
        said = _WORD.findall(text)
        if not said:
            return 0.0
        worst = 0.0
        if not self.raising.isdisjoint(said):
            scores = [self.score(w) for s in _END.split(text) if (w := _WORD.findall(s))]
            worst = max(scores)
        return float(sum(1 / (1 + np.exp(c - worst)) for c in self.cuts if c - worst < 700))

    def score(self, words: list[str]) -> float:
        if self.raising.isdisjoint(words):
            return 0.0
        held = {f: self.weights[f] for f in features(words) if f in self.weights}
        up = [{f} if isinstance(f, str) else {*f} - {""} for f, w in held.items() if w > 0]
        apart = any(a.isdisjoint(b) for i, a in enumerate(up) for b in up[:i])
        return sum(held.values()) if apart else 0.0

    @classmethod
    def fit(cls, graded: list[tuple[str, int]], least_docs: int = 3, rounds: int = 5, steps: int = 200, decay: float = 2e-3) -> "Ordinal":
        """Fit on (text, grade).

        A feature may raise the score if ``least_docs`` graded documents above 0 hold it, they
        are ``PURE`` of those that hold it, and so many more than its share of all documents
        that of the features taken only the share ``FALSE`` would do so by chance. Other
        features of sentences that hold one of those, in documents graded 0, may only lower it.
        """
        bags = [[features(w) for w in sentences(t)] for t, _ in graded]
        grades = np.array([g for _, g in graded], np.int64)
        above, all_docs = Counter(), Counter()
        for bag, g in zip(bags, grades):
            held = set().union(*bag) if bag else set()
            all_docs.update(held)
            if g:
                above.update(held)
        tried = [f for f, a in above.items() if a >= least_docs]
        prior = (grades > 0).mean() if len(grades) else 0.0
        chance = {f: _chance(above[f], all_docs[f], len(grades), int((grades > 0).sum())) for f in tried}
        # the largest chance at which no more than the share FALSE of those taken are expected to be there by chance
        most = max((c for i, c in enumerate(sorted(chance.values()), 1) if c * len(tried) <= FALSE * i), default=-1.0)
        start = {f for f in tried if chance[f] <= most and above[f] >= PURE * all_docs[f]}
        if not start or prior == 1.0:
            return cls({}, (1e9, 1e9))
        raising = sorted(start, key=str)
        near = [(d, s) for d, bag in enumerate(bags) for s in bag if not start.isdisjoint(s)]
        lowering = sorted(set().union(*(s for d, s in near if grades[d] == 0)) - start, key=str)
        at = {f: i for i, f in enumerate(raising + lowering)}
        # a document without such a sentence has one without features
        rows = [(d, [at[f] for f in s if f in at]) for d, s in near] + [(d, []) for d in sorted(set(range(len(bags))) - {d for d, _ in near})]
        doc = np.array([d for d, _ in rows], np.int64)
        size = np.array([len(f) for _, f in rows], np.int64)
        col = np.array([x for _, f in rows for x in f], np.int64)
        row = np.repeat(np.arange(len(rows)), size)
        w = np.array([1.0] * len(raising) + [0.0] * len(lowering))
        cuts = np.array([1.5, 2.5])
        for _ in range(rounds):
            score = np.bincount(row, w[col], len(rows))
            order = np.lexsort((score, doc))
            top = np.zeros(len(rows), bool)
            top[order[np.append(doc[order][1:] != doc[order][:-1], True)]] = True
            used = (top | (grades[doc] == 0)).astype(float)
            y = np.where(top, grades[doc], 0)
            w, cuts = cls._descend(row, col, len(rows), y, used / used.sum(), np.zeros(len(at)), len(raising), np.array([1.5, 2.5]), steps, decay)
        weights = {f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-3}
        # of a pair the word met in fewer documents
        rarer = lambda f: f if isinstance(f, str) else min((x for x in f if x), key=lambda x: (all_docs[x], x))
        return cls(weights, tuple(map(float, cuts)), frozenset(rarer(f) for f in raising if weights.get(f, 0) > 0))

    @staticmethod
    def _descend(row, col, n, y, share, w, free, cuts, steps, decay):
        """Adam on the weighted likelihood with an L2 penalty; cuts stay ordered."""
        v = np.concatenate([w, cuts])
        m1, m2 = np.zeros_like(v), np.zeros_like(v)
        for t in range(1, steps + 1):
            score = np.bincount(row, v[:-2][col], n)
            p = 1 / (1 + np.exp(-np.clip(score[:, None] - v[None, -2:], -30, 30)))  # P(y >= 1), P(y >= 2)
            p0, p1, p2 = 1 - p[:, 0], np.maximum(p[:, 0] - p[:, 1], 1e-9), p[:, 1]
            q = p * (1 - p)
            # how far the model, and not a wrong label, accounts for each grade
            said = np.where(y == 0, p0, np.where(y == 1, p1, p2)) * (1 - NOISE)
            trust = said / (said + NOISE / 3)
            # derivative of the log likelihood by score - cut_1 and score - cut_2
            d1 = np.where(y == 0, -q[:, 0] / np.maximum(p0, 1e-9), np.where(y == 1, q[:, 0] / p1, 0))
            d2 = np.where(y == 1, -q[:, 1] / p1, np.where(y == 2, q[:, 1] / np.maximum(p2, 1e-9), 0))
            d1, d2 = np.clip(d1, -5, 5) * share * trust, np.clip(d2, -5, 5) * share * trust
            g = np.concatenate([-np.bincount(col, (d1 + d2)[row], len(v) - 2) + decay * v[:-2] / 10, [d1.sum(), d2.sum()]])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            v = v - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            v[free:-2] = np.minimum(v[free:-2], 0)
            v[-2] = max(v[-2], 1.0)
            v[-1] = max(v[-1], v[-2] + 0.05)
        return v[:-2], v[-2:]


def _chance(a: int, docs: int, all_docs: int, above: int) -> float:
    """Probability that of ``docs`` documents drawn from ``all_docs`` at least ``a`` are among the ``above`` (hypergeometric)."""
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    most = min(docs, above)
    return sum(math.exp(log(above, k) + log(all_docs - above, docs - k) - log(all_docs, docs)) for k in range(a, most + 1) if docs - k <= all_docs - above)


def sample_labels(df: DataFrame, labels: DataFrame, most_labels: int, most_chars: int, key: str, text: str, label: str) -> list[tuple[str, int]]:
    """(text, grade) of at most ``most_labels`` documents of together ``most_chars`` characters, those whose key hashes lowest.

    The keys are broadcast, so that only the texts of the sample move.
    """
    votes = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.collect_list(F.col(label).cast("int")).alias("votes"))
    chosen = cut(votes.orderBy(F.xxhash64("k"), "k").limit(most_labels))
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(F.trim("t")) > 0).join(F.broadcast(chosen.select("k")), "k")
    texts = cut(texts.groupBy("k").agg(F.min("t").alias("t")))
    room = Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0)
    kept = texts.select("k", F.sum(F.length("t")).over(room).alias("chars")).where(F.col("chars") <= most_chars).select("k")
    rows = texts.join(F.broadcast(kept), "k").join(F.broadcast(chosen), "k").select("k", "t", "votes").toLocalIterator()
    merged: dict[str, list[int]] = {}
    for _, t, v in sorted(rows, key=lambda r: str(r[0])):
        merged.setdefault(t, []).extend(v)
    return [(t, grade(v)) for t, v in merged.items()]


def score(df: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, severity) of every row; the model is broadcast, nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.cuts, model.raising))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([own.expected(t) if t else 0.0 for t in b.column(1).to_pylist()], pa.float64())], ["k", "severity"])

    return rows.mapInArrow(run, f"k {kind}, severity double").withColumnRenamed("k", key)


def severity(df: DataFrame, labels: DataFrame, most_labels: int = 20_000, most_chars: int = 32_000_000, key: str = "doc_id", text: str = "text", label: str = "abusive") -> DataFrame:
    """(``key``, severity) of every document, by a model fitted on its labelled ones."""
    return score(df, Ordinal.fit(sample_labels(df, labels, most_labels, most_chars, key, text, label)), key, text)
