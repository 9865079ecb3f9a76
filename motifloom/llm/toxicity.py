"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two spans are as similar as they share subsequences of three characters, each weighted by DECAY to the length it covers
in either span, so gaps and inserted characters weaken a match but do not break it. Landmark spans are chosen from the
labelled texts; the Nyström map sends a span to its kernel values against them, whitened; a linear SVM separates the
witness span of every toxic text from the spans of clean ones (multiple-instance training: which span of a toxic text
carries the label is found again in each round). A text scores by its two worst spans, calibrated by a logistic fit on
labelled texts the SVM has not seen.

The kernel's feature space is small (ordered triples of character classes), so all landmarks and weights fold into one
weight per triple, and a span costs the same however many landmarks there are.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, tidy

DECAY, LONGEST, CLASSES = 0.6, 16, 64
SCORES = "id bigint, score double"
_SCORES = pa.schema([("id", pa.int64()), ("score", pa.float64())])
EDGES = " .,;:!?\"'()[]{}<>|*#$%&+-_=/\\~`^@…«»"
#: Single characters set apart: each has one reading only and nothing is tried twice, so a text takes time by its length.
SPACED = re.compile(r"(?<!\S)[^\s.*_-](?:[ .*_-]{1,2}+[^\s.*_-](?![^\s.*_-])){2,}+")
INNER = re.compile(r"[^\w]|_")


class _Classes(dict):
    """Character classes for str.translate: 1-26 letters, 27-36 digits, else 37-63 by code point."""

    def __missing__(self, point: int) -> int:
        self[point] = found = point - 96 if 97 <= point <= 122 else point - 21 if 48 <= point <= 57 else 37 + point % 27
        return found


_CLASSES = _Classes()


@lru_cache(maxsize=None)
def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j < k of a span of this length, one row each, and the weight of what they cover."""
    places = np.array(list(itertools.combinations(range(length), 3)), dtype=np.intp).reshape(-1, 3).T
    return places, (DECAY ** (places[2] - places[0] + 1)).astype(np.float32)


def self_kernel(x: np.ndarray) -> np.ndarray:
    """The kernel of each row of class numbers with itself, by the usual recursion over prefixes."""
    n, length = x.shape
    same = (x[:, :, None] == x[:, None, :]).transpose(1, 2, 0) * np.float32(DECAY**2)  # [place, place, row]
    inner = np.ones((length + 1, length + 1, n), dtype=np.float32)  # matches of 0, 1, 2 characters, by prefixes
    for _ in range(2):
        ahead = np.zeros_like(inner)
        for a in range(1, length + 1):
            run = np.zeros(n, dtype=np.float32)
            step = same[a - 1] * inner[a - 1, :-1]
            for b in range(1, length + 1):
                run = DECAY * run + step[b - 1]
                ahead[a, b] = DECAY * ahead[a - 1, b] + run
        inner = ahead
    return (same * inner[:-1, :-1]).sum(axis=(0, 1), dtype=np.float64)


def spans_of(token: str) -> list[str]:
    """What of a lower-case token is looked at: without outer marks, also without inner ones, long ones in windows."""
    core = token.strip(EDGES)
    found = []
    for s in {core} - {""} if core.isalnum() else {core, INNER.sub("", core)} - {""}:
        most = LONGEST - 2
        found += [s[i : i + most] for i in range(0, max(1, len(s) - most // 2), most // 2)] if len(s) > most else [s]
    return found


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text, and its runs of three or more single characters as one token each."""
    lower = text.lower()
    return {*lower.split(), *(m[0].replace(" ", "") for m in SPACED.finditer(lower))}


def features(spans: list[str]):
    """Per length: (positions in spans, classes [n, length], triple codes [n, c], weights [c]); 0 marks both ends."""
    by_length: dict[int, list[int]] = {}
    for i, span in enumerate(spans):
        by_length.setdefault(len(span), []).append(i)
    for length, at in by_length.items():
        places, weights = triples(length + 2)
        for first in range(0, len(at), 2048):
            part = at[first : first + 2048]
            x = np.zeros((len(part), length + 2), dtype=np.int32)
            x[:, 1:-1] = np.frombuffer("".join([spans[i] for i in part]).translate(_CLASSES).encode("latin-1"), dtype=np.uint8).reshape(len(part), length)
            yield np.array(part), x, (x[:, places[0]] * CLASSES + x[:, places[1]]) * CLASSES + x[:, places[2]], weights


@dataclass
class ToxicityModel:
    """fold: weight per triple; bias; calibration: weights of (worst, second worst, log of spans, 1)."""

    fold: np.ndarray
    bias: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    landmarks: list[str] = field(default_factory=list)

    def spans(self, spans: list[str]) -> np.ndarray:
        out = np.zeros(len(spans))
        for at, x, code, weights in features(spans):
            raw = self.fold[code] @ weights
            up = np.flatnonzero(raw > 0)  # what speaks against toxicity counts as nothing
            out[at[up]] = raw[up] / np.sqrt(self_kernel(x[up]))
        return out + self.bias

    def tokens(self, tokens: list[str], known: dict[str, float] | None = None) -> list[float]:
        """The worst span of each token; `known` remembers spans."""
        parts = [spans_of(t) for t in tokens]
        known = {} if known is None else known
        distinct = list({s for p in parts for s in p if s not in known})
        known.update(zip(distinct, self.spans(distinct).tolist(), strict=True))
        return [max((known[s] for s in p), default=self.bias) for p in parts]

    def score(self, values: list[float]) -> float:
        """From the span scores of a text's distinct tokens."""
        worst = second = self.bias
        for v in values:
            if v > worst:
                worst, second = v, worst
            elif v > second:
                second = v
        a, b, c, d = self.calibration.tolist()
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * worst + b * second + c * math.log1p(len(values)) + d))))


def _kernel(spans: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values [spans, landmarks]."""
    table: dict[int, int] = {}
    cells: list[tuple[int, int, float]] = []
    for at, x, code, weights in features(landmarks):
        for j, row, norm in zip(at.tolist(), code.tolist(), np.sqrt(self_kernel(x)).tolist(), strict=True):
            cells += [(table.setdefault(c, len(table)), j, w / norm) for c, w in zip(row, weights.tolist(), strict=True)]
    fold = np.zeros((len(table) + 1, len(landmarks)), dtype=np.float32)
    for c, j, w in cells:
        fold[c, j] += w
    where = np.full(CLASSES**3, len(table), dtype=np.int64)
    where[list(table)] = list(table.values())
    out = np.zeros((len(spans), len(landmarks)))
    for at, x, code, weights in features(spans):
        norms = np.sqrt(self_kernel(x))
        for first in range(0, len(at), 128):
            s = slice(first, first + 128)
            out[at[s]] = np.einsum("ncm,c->nm", fold[where[code[s]]], weights) / norms[s, None]
    return out


def _fold(landmarks: list[str], alphas: np.ndarray) -> np.ndarray:
    fold = np.zeros(CLASSES**3, dtype=np.float32)
    for at, x, code, weights in features(landmarks):
        np.add.at(fold, code, weights[None] * (alphas[at] / np.sqrt(self_kernel(x)))[:, None])
    return fold


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, rounds: int = 20) -> np.ndarray:
    """Squared-hinge SVM with a bias as last weight, by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        step = np.linalg.solve(a.T @ x[active] + ridge * np.eye(len(w)), a.T @ y[active])
        if np.allclose(step, w, atol=1e-6):
            break
        w = step
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _unlike(bags: list[list[str]], sketch: int = 32, most: int = 10) -> list[bool]:
    """Which bags to learn from: not those that share more than `most` of their `sketch` smallest hashes with an earlier
    one. Copies of one text would make each of its words look like evidence."""
    seen: dict[int, list[int]] = {}
    keep = []
    for i, bag in enumerate(bags):
        low = sorted({zlib.crc32(s.encode()) for s in bag})[:sketch]
        shared = Counter(j for h in low for j in seen.get(h, ()))
        keep.append(not shared or max(shared.values()) <= most * len(low) // sketch)
        if keep[-1]:
            for h in low:
                seen.setdefault(h, []).append(i)
    return keep


def _surprise(k1: int, n1: int, k0: int, n0: int) -> float:
    """Twice the log-likelihood ratio of k1 in n1 against k0 in n0."""
    share = (k1 + k0) / (n1 + n0)
    term = lambda k, of: k * math.log(k / of) if k else 0.0
    return 2 * (term(k1, n1 * share) + term(n1 - k1, n1 * (1 - share)) + term(k0, n0 * share) + term(n0 - k0, n0 * (1 - share)))


def fit_model(texts: list[str], toxic: list[int], *, landmarks: int = 128, negatives: int = 6000, rounds: int = 3, evidence: float = 16.0, seed: int = 3) -> ToxicityModel:
    """Train on labelled texts; every fourth only calibrates. Spans whose association with the label reaches `evidence`
    (twice the log-likelihood ratio) are witnesses wherever they stand in a toxic text."""
    rng = np.random.default_rng(seed)
    bags = [sorted({s for t in tokens_of(x) for s in spans_of(t)}) for x in texts]
    labels = np.array(toxic)
    prior = labels.mean() if len(labels) else 0.0
    calibrate = np.arange(len(bags)) % 4 == 3
    fit = [(b, t) for b, t, c in zip(bags, toxic, calibrate, strict=True) if not c and b]
    fit = list(itertools.compress(fit, _unlike([b for b, _ in fit])))
    seen = [Counter(), Counter()]
    for bag, label in fit:
        seen[label].update(bag)
    n1, n0 = sum(t for _, t in fit), sum(1 - t for _, t in fit)
    if not n1 or not n0:  # one class only: everything scores its share
        edge = math.log((prior + 1e-3) / (1 - prior + 1e-3))
        return ToxicityModel(np.zeros(CLASSES**3, dtype=np.float32), 0.0, np.array([0.0, 0.0, 0.0, edge]))
    # spans by how much likelier they are in toxic texts (log odds, shrunk, times support)
    odds = {s: math.log((k + 0.1) / (n1 + 0.2)) - math.log((seen[0][s] + 0.1) / (n0 + 0.2)) for s, k in seen[1].items()}
    ranked = sorted(odds, key=lambda s: (-odds[s] * math.sqrt(seen[1][s]), s))
    chosen: list[str] = ranked[: landmarks * 3 // 4]
    common = sorted((s for s in seen[0] if len(s) > 2), key=lambda s: (-seen[0][s], s))[: 20 * landmarks]
    chosen += [common[i] for i in sorted(rng.choice(len(common), min(len(common), landmarks - len(chosen)), replace=False))]
    chosen = list(dict.fromkeys(chosen))
    values, vectors = np.linalg.eigh(_kernel(chosen, chosen))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    clean = sorted(seen[0])
    sure = {s for s, k in seen[1].items() if odds[s] > 2.0 and _surprise(k, n1, seen[0][s], n0) >= evidence}
    score = odds  # the first witness of a toxic text is its span with the best odds
    model = ToxicityModel(np.zeros(CLASSES**3, dtype=np.float32), 0.0, np.zeros(4), chosen)
    hard = [clean[i] for i in rng.choice(len(clean), min(len(clean), negatives), replace=False)]
    support = lambda s: score.get(s, -9.0) * (math.sqrt(seen[1][s]) if score is odds else 1.0)
    for _ in range(rounds):
        witness = [max(bag, key=lambda s: (support(s), s)) for bag, label in fit if label]
        witness += [s for bag, label in fit if label for s in bag if s in sure]
        spans = witness + hard
        y = np.array([1.0] * len(witness) + [-1.0] * len(hard))
        cost = np.where(y > 0, len(hard) / max(1, len(witness)) / 4, 1.0)
        w = _svm(_kernel(spans, chosen) @ whiten, y, cost, ridge=1.0)
        model.fold, model.bias = _fold(chosen, whiten @ w[:-1]), float(w[-1])
        names = sorted({*clean, *(s for bag, label in fit if label for s in bag)})
        score = dict(zip(names, model.spans(names).tolist(), strict=True))
        worst = sorted(clean, key=lambda s: -score[s])[: negatives // 2]
        hard = sorted({*worst, *rng.choice(clean, min(len(clean), negatives // 2), replace=False).tolist()})
    rows, goals = [], []
    for x, label, c in zip(texts, toxic, calibrate, strict=True):
        if c:
            top = sorted(model.tokens(sorted(tokens_of(x))), reverse=True)
            rows.append([*(top + [model.bias] * 2)[:2], math.log1p(len(top)), 1.0])
            goals.append(label)
    if len(set(goals)) == 2:
        model.calibration = _logistic(np.array(rows), np.array(goals, dtype=float))
    else:
        model.calibration = np.array([2.0, 0.0, 0.0, 0.0])
    return model


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5,
    most_toxic: int = 1500, most_clean: int = 2500, longest: int = 200_000, **options,
) -> ToxicityModel:
    """Train on labelled rows whose crc32(id as text) mod `folds` is not 0: of each class at most most_toxic and
    most_clean ids, those that come first by a hash of the id. Null labels and null ids are left out. An id with
    different labels counts as toxic, and of different texts of one id the one with the least hash is read. Labelled
    texts of more than `longest` characters are not learnt from, which bounds what the driver holds."""
    usable = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    usable = usable.where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != 0).groupBy("id").agg(F.max("label").alias("label"))
    parts = [usable.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, most_toxic), (0, most_clean))]
    picked = parts[0].unionByName(parts[1])  # at most most_toxic + most_clean rows
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body(text).alias("text")).where(F.length("text") <= longest).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    found = rows.select(F.xxhash64("id").alias("h"), "id", "text", "label").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    return fit_model(found.column("text").to_pylist(), found.column("label").to_pylist(), **options)


class Scorer:
    """Scores texts in portions, remembering tokens and spans it has met."""

    def __init__(self, model: ToxicityModel, most: int = 200_000):
        self.model, self.most, self.known, self.spans = model, most, {}, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        bags = [tokens_of(t or "") for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
            self.spans.clear()
        new = list({t for bag in bags for t in bag if t not in self.known})
        self.known.update(zip(new, self.model.tokens(new, self.spans), strict=True))
        return [self.model.score([self.known[t] for t in bag]) for bag in bags]


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row and its whole text.

    Null and empty texts are scored like a text without spans. Repeated rows get the same score; a null id is never
    held out; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight per triple: 1 MB whatever the corpus

    def run(batches):
        score = Scorer(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                scores = score(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=_SCORES)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body(text).alias("text")).mapInArrow(tidy(run), SCORES)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return rows.select(F.col("id").alias(doc_id), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean_documents(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The filtering form: the rows of docs that score below the threshold, with all their columns, without a shuffle."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        score = Scorer(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                yield batch.filter(pa.array([s < threshold for s in score(batch.column(place).to_pylist())], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
