"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fitting runs on the driver over a bounded sample of labelled documents (sample_rows and sample_bytes, by
hash of the id). Labels are per document, so token labels are derived first: words and inner strings of words
that are far more frequent in toxic documents mark the tokens of toxic documents that hold them. A
two-state chain (clean, toxic) is then fitted to the tokens by gradient steps on its conditional
likelihood, with expectations from forward-backward. Last, a logistic curve over what the marginals
of a document add up to is fitted to the document labels.

Scoring covers every whole text: forward-backward over all its tokens, the sum and the maximum of the
marginals, and the offsets of tokens whose marginal is at least one half.

Defined cases: a null or empty text has no tokens and gets the score of no evidence; without a label
of either kind every score is the share of toxic labels (0 without any); several labels of a document
count each; repeated rows are scored alike; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import keep_rows, map_texts

#: Labelled documents of the sample, and bytes of text that they may have in all.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 64_000_000
FOLDS = 5
#: Lengths of the inner strings of a word, its ends marked.
GRAMS = (4, 5, 6, 7)
#: A feature must stand in so many toxic documents of the sample, and in this share of them.
LEAST_DOCS, LEAST_SHARE, LEAST_LOG_ODDS, MOST_FEATURES = 5, 0.03, 1.6, 400
#: Words whose scores a worker keeps; when there are more, it starts anew.
KEPT_WORDS = 100_000
_TOKEN = re.compile(r"\S+")
_CHUNK = 64


def _word(token: str) -> str:
    """A token without what isn't a letter at its ends, the ends marked; empty where nothing is left."""
    a, b = 0, len(token)
    while a < b and not _is_letter(token[a]):
        a += 1
    while a < b and not _is_letter(token[b - 1]):
        b -= 1
    return f"^{token[a:b]}$" if a < b else ""


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdigit()


def features_of(token: str) -> set[str]:
    """The word, without what isn't a letter at its ends, and its inner strings, whatever its length."""
    marked = _word(token)
    if not marked:
        return set()
    return {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}


@dataclass
class Model:
    """weights: of features for the toxic state; jump[i][j]: factor from state i to j; curve: of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    jump: tuple = ((1.0, 1.0), (1.0, 1.0))
    curve: tuple = (-20.0, 0.0, 0.0, 0.0, 0.0)
    rate: float | None = None

    def odds(self, token: str) -> float:
        total = self.bias + sum(self.weights.get(f, 0.0) for f in features_of(token))
        return math.exp(min(60.0, max(-60.0, total)))

    @property
    def plain(self) -> float:
        """The odds of a token without features."""
        return math.exp(min(60.0, max(-60.0, self.bias)))


def _chain(odds: list[float], jump: tuple, ratio: float | None, back: float) -> list[float]:
    """Forward-backward in ratios of the two states, from the ratio before the first token and that after the last."""
    (t00, t01), (t10, t11) = jump
    ahead = []
    for o in odds:
        ratio = o if ratio is None else o * (ratio * t11 + t01) / (ratio * t10 + t00)
        ratio = min(ratio, 1e30)
        ahead.append(ratio)
    for k in range(len(odds) - 1, -1, -1):
        joint = ahead[k] * back
        ahead[k] = joint / (1.0 + joint)
        onward = odds[k] * back
        back = (t11 * onward + t10) / (t01 * onward + t00)
    return ahead


def marginals(odds: list[float], jump: tuple, plain: float | None = None) -> list[float]:
    """The probability of the toxic state at each token.

    plain: the odds of tokens without features. Among such tokens both ratios settle at fixed values,
    each step closer by the ratio of the eigenvalues of the step; where they have settled to double
    precision the marginal is a constant, so only the surroundings of other tokens are computed.
    """
    if plain is None:
        return _chain(odds, jump, None, 1.0)
    (t00, t01), (t10, t11) = jump
    trace, det = t00 + plain * t11, plain * (t00 * t11 - t01 * t10)
    root = math.sqrt(max(0.0, trace * trace - 4 * det))
    pull = abs((trace - root) / (trace + root))
    reach = 2 if pull < 1e-18 else int(-38 / math.log(pull)) + 2 if pull < 0.7 else len(odds)
    n = len(odds)
    if n <= 2 * reach:
        return _chain(odds, jump, None, 1.0)
    ratio = back = 1.0
    for _ in range(reach):
        ratio = plain * (ratio * t11 + t01) / (ratio * t10 + t00)
        back = (t11 * plain * back + t10) / (t01 * plain * back + t00)
    runs = [[0, reach]]
    for k in [k for k, o in enumerate(odds) if o != plain] + [n - 1]:
        if k - reach <= runs[-1][1]:
            runs[-1][1] = min(n, k + reach + 1)
        else:
            runs.append([k - reach, min(n, k + reach + 1)])
    out = [ratio * back / (1.0 + ratio * back)] * n
    for a, b in runs:
        out[a:b] = _chain(odds[a:b], jump, None if a == 0 else ratio, 1.0 if b == n else back)
    return out


def _evidence(probabilities: list[float]) -> tuple[float, ...]:
    n = len(probabilities)
    total, most = (math.fsum(probabilities), max(probabilities)) if n else (0.0, 0.0)
    return (1.0, math.log1p(total), most, 100 * total / (n + 10), math.log1p(n))


def _select(documents: list[Counter], toxic: np.ndarray) -> dict[str, float]:
    """Features far more frequent among the tokens of toxic documents, with their log odds.

    Only features that enough toxic documents hold are counted elsewhere, so memory follows the toxic part.
    """
    docs: Counter = Counter()
    for tokens, bad in zip(documents, toxic, strict=True):
        if bad:
            docs.update(set().union(*map(features_of, tokens)))
    least = max(LEAST_DOCS, LEAST_SHARE * toxic.sum())
    docs = Counter({f: c for f, c in docs.items() if c >= least})
    counts = ({}, {})  # clean, toxic
    totals = [0, 0]
    words: dict[str, tuple[str, ...]] = {}
    for tokens, bad in zip(documents, toxic, strict=True):
        bad = int(bad)
        own = counts[bad]
        for token, n in tokens.items():
            if token not in words:
                words[token] = tuple(f for f in features_of(token) if f in docs)
            totals[bad] += n
            for f in words[token]:
                own[f] = own.get(f, 0) + n
    found = {}
    for f in docs:
        gain = math.log((counts[1].get(f, 0) + 0.5) / totals[1]) - math.log((counts[0].get(f, 0) + 0.5) / max(1, totals[0]))
        if gain >= LEAST_LOG_ODDS:
            found[f] = gain
    best = sorted(found, key=lambda f: (-docs[f] * found[f], f))[:MOST_FEATURES]
    return {f: found[f] for f in best}


def _fit_chain(sequences: list[list[str]], toxic: np.ndarray, chosen: dict[str, float], rounds: int = 80) -> Model:
    """Gradient steps (Adam) on the conditional likelihood of derived token labels, in chunks of the sequences."""
    names = sorted(chosen)
    place = {f: k for k, f in enumerate(names)}
    kinds: dict[str, int] = {}
    type_feature: list[tuple[int, int]] = []
    marked: list[bool] = []
    rows, labels = [], []
    for tokens, bad in zip(sequences, toxic, strict=True):
        ids = []
        for token in tokens:
            if token not in kinds:
                kinds[token] = len(kinds)
                own = [place[f] for f in features_of(token) if f in place]
                type_feature += [(kinds[token], k) for k in own]
                marked.append(bool(own))
            ids.append(kinds[token])
        for at in range(0, len(ids), _CHUNK):
            part = ids[at : at + _CHUNK]
            if any(marked[k] for k in part) or at == 0:  # chunks without a marked token say the same over and over
                rows.append(part + [-1] * (_CHUNK - len(part)))
                labels.append([bad and marked[k] for k in part] + [False] * (_CHUNK - len(part)))
    ids, y = np.array(rows, np.int64).reshape(-1, _CHUNK), np.array(labels, float).reshape(-1, _CHUNK)
    inside = ids >= 0
    ids = np.where(inside, ids, 0)
    pairs = np.array(type_feature, np.int64).reshape(-1, 2)
    theta = np.concatenate([np.full(len(names), 1.0), [-3.0], np.zeros(4)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    observed = np.array([[(inside[:, 1:] * (y[:, :-1] == i) * (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    for step in range(1, rounds + 1):
        w, bias, jump = theta[: len(names)], theta[len(names)], np.exp(theta[-4:].reshape(2, 2))
        emission = np.bincount(pairs[:, 0], weights=w[pairs[:, 1]], minlength=len(kinds)) + bias
        e = np.exp(np.clip(emission, -40, 40))[ids]
        a = np.zeros((2, _CHUNK, len(ids)))
        a[0, 0], a[1, 0] = 1, e[:, 0]
        for t in range(1, _CHUNK):
            p0 = a[0, t - 1] * jump[0, 0] + a[1, t - 1] * jump[1, 0]
            p1 = (a[0, t - 1] * jump[0, 1] + a[1, t - 1] * jump[1, 1]) * e[:, t]
            total = p0 + p1
            live = inside[:, t]
            a[0, t], a[1, t] = np.where(live, p0 / total, a[0, t - 1]), np.where(live, p1 / total, a[1, t - 1])
        b0, b1 = np.ones(len(ids)), np.ones(len(ids))
        expected, p = np.zeros((2, 2)), np.zeros_like(y)
        for t in range(_CHUNK - 1, -1, -1):
            z = a[0, t] * b0 + a[1, t] * b1
            p[:, t] = a[1, t] * b1 / z
            if t:
                live = inside[:, t]
                f0, f1 = b0, e[:, t] * b1
                joint = np.array([[a[i, t - 1] * jump[i, j] * (f0, f1)[j] for j in (0, 1)] for i in (0, 1)])
                expected += (joint / joint.sum((0, 1)) * live).sum(2)
                n0, n1 = jump[0, 0] * f0 + jump[0, 1] * f1, jump[1, 0] * f0 + jump[1, 1] * f1
                b0, b1 = np.where(live, n0 / (n0 + n1), b0), np.where(live, n1 / (n0 + n1), b1)
        error = np.where(inside, y - p, 0)
        by_type = np.bincount(ids.ravel(), weights=error.ravel(), minlength=len(kinds))
        gradient = np.concatenate([np.bincount(pairs[:, 1], weights=by_type[pairs[:, 0]], minlength=len(names)) - 0.1 * w, [error.sum()], (observed - expected).ravel() - 0.1 * theta[-4:]])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    jump = np.exp(theta[-4:].reshape(2, 2))
    return Model({f: float(theta[k]) for f, k in place.items()}, float(theta[len(names)]), tuple(map(tuple, jump.tolist())))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple:
    """Logistic regression by Newton steps with a small ridge, on scaled inputs."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(beta))
        step = np.linalg.solve(hessian, z.T @ (y - p) - 0.01 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple((beta / scale).tolist())


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(rate=float(y.mean()) if len(y) else 0.0)
    one: dict[str, str] = {}  # each token once in memory
    sequences = [[one.setdefault(w, w) for w in (t or "").lower().split()] for t in texts]
    chosen = _select([Counter(s) for s in sequences], y > 0)
    if not chosen:
        return Model(rate=float(y.mean()))
    model = _fit_chain(sequences, y > 0, chosen)
    kept: dict[str, float] = {}
    x = []
    for tokens in sequences:
        for t in tokens:
            if t not in kept:
                kept[t] = model.odds(t)
        x.append(_evidence(marginals([kept[t] for t in tokens], model.jump, model.plain)))
    model.curve = _fit_curve(np.array(x), y)
    return model


def in_fold_zero(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by the number of folds; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most sample_rows labelled documents outside fold 0, those of the smallest hashes of the id.

    Ids may repeat and texts be long, so the bounds hold after the join too: rows are taken in the order of
    the hash while their texts have at most sample_bytes in all (the first row always counts). The sizes
    are looked at before any text comes to the driver.
    """
    own = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~in_fold_zero(F.col("k")))
    sample = own.orderBy(F.xxhash64("k"), "k", "y").limit(sample_rows)
    joined = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample), "k")
    place = F.struct(F.xxhash64("k").alias("h"), "k", "y", F.xxhash64("t").alias("x"))
    sizes = joined.select(place.alias("p"), F.octet_length(F.coalesce("t", F.lit(""))).alias("n")).orderBy("p").limit(sample_rows).collect()
    taken, room = 0, sample_bytes
    while taken < len(sizes) and (taken == 0 or sizes[taken]["n"] <= room):
        room -= sizes[taken]["n"]
        taken += 1
    rows = joined.orderBy(place).limit(taken).orderBy("k", "y", "t").toArrow() if taken else None
    return fit(rows["t"].to_pylist(), rows["y"].to_pylist()) if taken else fit([], [])


class Scorer:
    """A model with the odds of the words seen so far."""

    def __init__(self, model: Model):
        self.model, self.kept, self.plain = model, {}, model.plain
        self.grams = None

    def odds(self, token: str) -> float:
        """As Model.odds, with all features found in one pass."""
        if self.grams is None:
            self.grams = ahocorasick.Automaton()
            for f, w in self.model.weights.items():
                self.grams.add_word(f, (f, w))
            self.grams.make_automaton()
        marked = _word(token)
        found = dict(x for _, x in self.grams.iter(marked)) if marked and self.model.weights else {}
        if not found:
            return self.plain
        return math.exp(min(60.0, max(-60.0, self.model.bias + sum(found.values()))))

    def __getstate__(self):
        return {"model": self.model, "kept": {}, "plain": self.plain, "grams": None}

    def __call__(self, text: bytes | None) -> tuple[float, list[str]]:
        """The score and the offending tokens as start:end in code points."""
        plain = (text or b"").decode()
        model = self.model
        if model.rate is not None:
            return model.rate, []
        tokens, kept = plain.lower().split(), self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for t in set(tokens).difference(kept):
            kept[t] = self.odds(t)
        p = marginals(list(map(kept.__getitem__, tokens)), model.jump, model.plain)
        evidence = _evidence(p)
        total = sum(a * b for a, b in zip(model.curve, evidence, strict=True))
        score = 1 / (1 + math.exp(-min(60.0, max(-60.0, total))))
        spans = []
        if evidence[2] >= 0.5:
            places = [m.span() for m in _TOKEN.finditer(plain)]
            if len(places) == len(p):
                spans = [f"{a}:{b}" for (a, b), x in zip(places, p, strict=True) if x >= 0.5]
        return score, spans


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, score, predicted and the offending spans."""
    scorer = Scorer(model)

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        found = [scorer(t) for t in texts]
        return {"doc_id": ids, "score": [s for s, _ in found], "spans": [",".join(x) for _, x in found]}

    scored = map_texts(docs, id_col, text_col, "doc_id long, score double, spans string", per_slice)
    return scored.select("doc_id", in_fold_zero(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def filter_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose score is below one half, with all their columns; each row is judged by its own text, whatever its id."""
    scorer = Scorer(model)
    return keep_rows(docs, text_col, lambda texts: [scorer(t)[0] < 0.5 for t in texts])
