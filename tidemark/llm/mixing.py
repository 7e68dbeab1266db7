"""Mixing sources to target weights with soft memberships.

A softmax classifier, fitted on a labelled table, gives each document posteriors over domains. Nonnegative rates for the
documents are then fitted by least squares, so that the expected tokens of each domain, the sum of rate x tokens x
posterior, come to the targets: projected gradient steps from rate 1, in the metric of the documents' tokens, preconditioned
by the small matrix of the documents whose rate is not held at 0. A step needs one pass of partial sums over the documents'
posteriors, a few numbers each; the rates themselves are folded from the steps so far and never gathered.

The classifier is fitted on a bounded sample of labelled rows (``max_examples``, by hash order); its features are hashed
words and measures of form. Totals and rates are over all documents.

Where documents are to be thinned and none repeated, rates end at 1; the scale of the targets then follows what can be
reached, so that only their proportions have to be met.

Defined results: null and empty texts have no tokens, and posteriors by the other features; with fewer than two labelled
domains all documents belong to the first; a domain without tokens cannot be raised, so its target is left unmet (gap and
converged of the fit); null labels and ids of the labelled table are left out; other columns are dropped by mix_to_targets and
kept by thin_to_shares, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, mix, numbered_columns, pick, portions, texts_in, word_hashes

MAX_EXAMPLES = 6000
HASHED = 2048
FORM = 8
_PUNCT, _SYMBOL, _UPPER, _DIGIT = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first and end row, the words of each, and (row, feature, value) of the hashed words and the form."""
    for i, j, data, starts, ends in texts_in(column):
        h, row = word_hashes(data, starts, ends)
        n = np.bincount(row, minlength=j - i)
        counts = np.bincount(row * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=(j - i) * HASHED)
        pairs = np.flatnonzero(counts)
        r, f, v = pairs // HASHED, pairs % HASHED, np.log1p(counts[pairs])
        v = v / np.sqrt(np.bincount(r, weights=v * v, minlength=j - i))[r]
        size = np.maximum(ends - starts, 1)
        sums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m[data])])[np.stack([starts, ends])], axis=0)[0] if len(data) else np.zeros(j - i)  # noqa: E731, B023
        some = np.unique(h ^ mix(row.astype(np.uint64)), return_index=True)[1]
        distinct = np.bincount(row[some], minlength=j - i)
        form = np.stack([
            np.ones(j - i), np.log1p(n) / 5, 5 * sums(_PUNCT) / size, 5 * sums(_SYMBOL) / size, 2 * sums(_UPPER) / size, 5 * sums(_DIGIT) / size,
            distinct / np.maximum(n, 1), np.log1p(size / np.maximum(n, 1)) / 3,
        ], axis=1)
        yield i, j, n, np.concatenate([r, np.repeat(np.arange(j - i), FORM)]), np.concatenate([f, np.tile(HASHED + np.arange(FORM), j - i)]), np.concatenate([v, form.ravel()])


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 250, rate: float = 8.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (features x classes) of a softmax classifier, by accelerated gradient steps."""
    w = np.zeros((x.shape[1], classes), np.float32)
    v = np.zeros_like(w)
    onehot = np.eye(classes, dtype=np.float32)[y]
    for _ in range(rounds):
        ahead = w + 0.9 * v
        g = x.T @ (softmax(x @ ahead) - onehot).astype(np.float32) / len(x) + decay * ahead
        v = 0.9 * v - 0.1 * rate * g
        w = w + v
    return w


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and posteriors of each text."""
        words, found = [np.zeros(0, np.int64)], [np.zeros((0, len(self.domains)))]
        for i, j, n, r, f, v in features(column):
            z = np.stack([np.bincount(r, weights=v * self.weights[f, k], minlength=j - i) for k in range(len(self.domains))], axis=1)
            words.append(n)
            found.append(softmax(z))
        return np.concatenate(words), np.concatenate(found)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], max_examples: int = MAX_EXAMPLES) -> Classifier:
    """docs (id, text), labels (id, domain)."""
    rows = labels.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    # The sample's size is its limit, which bounds what is sent to the executors and to the driver.
    chosen = docs.join(F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(max_examples)), "id").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, r, f, v in features(batch.column("text")):
                order = np.argsort(r, kind="stable")
                at = pa.array(np.searchsorted(r[order], np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("domain")[i:j], pa.ListArray.from_arrays(at, pa.array(f[order], pa.int32())), pa.ListArray.from_arrays(at, pa.array(v[order], pa.float32()))], names=["domain", "f", "v"])

    found = chosen.select("domain", "text").mapInArrow(run, "domain string, f array<int>, v array<float>").toArrow()
    y = np.array([domains.index(d) for d in found.column("domain").to_pylist()], np.int64)
    if len(set(y.tolist())) < 2:
        w = np.zeros((HASHED + FORM, len(domains)), np.float32)
        w[HASHED, int(y[0]) if len(y) else 0] = 50
        return Classifier(domains, w)
    x = np.zeros((len(y), HASHED + FORM), np.float32)
    fs, vs = found.column("f").combine_chunks(), found.column("v").combine_chunks()
    sizes = fs.value_lengths().to_numpy()
    x[np.repeat(np.arange(len(y)), sizes), fs.flatten().to_numpy()] = vs.flatten().to_numpy()
    order = np.lexsort((x @ np.linspace(0.1, 1, x.shape[1], dtype=np.float32), y))  # the same sums whatever the order of arrival
    return Classifier(domains, train(x[order], y[order], len(domains)))


def rate_of(p: Column, steps: list[np.ndarray], most: float | None = None) -> Column:
    """The rate after the gradient steps so far, held between 0 and ``most`` after each."""
    start = F.lit(1.0)
    if not steps:
        return start
    past = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    held = (lambda r: F.greatest(F.lit(0.0), r)) if most is None else (lambda r: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r)))
    return F.aggregate(past, start, lambda r, g: held(r - dot(g)))


@dataclass
class Fit:
    steps: list[np.ndarray]
    totals: np.ndarray
    expected: np.ndarray
    targets: np.ndarray
    tolerance: float
    most: float | None = None

    @property
    def gap(self) -> float:
        """The largest distance of a domain from its target, as a share of all tokens."""
        return float(np.abs(self.expected - self.targets).max() / max(self.targets.sum(), 1e-12))

    @property
    def converged(self) -> bool:
        return self.gap <= self.tolerance


def fit_rates(rows: DataFrame, targets, domains: int, rounds: int = 12, tolerance: float = 1e-6, most: float | None = None) -> Fit:
    """rows (n, p array<double>): the steps whose rates make the expected tokens of each domain come to the targets.

    ``targets`` gives them from the domains' totals at rate 1. With ``most`` no rate exceeds it, and the targets' scale is that
    of the first domain's tokens as they come out, so that only the proportions are aimed at.
    """
    steps: list[np.ndarray] = []
    totals = want = now = np.zeros(domains)
    for k in range(rounds + 1):
        r = rows.withColumn("r", rate_of(F.col("p"), steps, most))
        p = [F.get("p", F.lit(a)) for a in range(domains)]
        mass = [F.sum(F.col("r") * F.col("n") * p[a]).alias(f"s{a}") for a in range(domains)]
        free = F.col("r") > 0 if most is None else (F.col("r") > 0) & (F.col("r") < most)
        metric = [F.sum(F.when(free if steps else F.lit(True), F.col("n") * p[a] * p[b])).alias(f"h{a}_{b}") for a in range(domains) for b in range(a, domains)]
        got = {c: v or 0.0 for c, v in r.agg(*mass, *metric).first().asDict().items()}
        now = np.array([got[f"s{a}"] for a in range(domains)])
        if not k:
            totals, want = now, np.asarray(targets(now), float)
        if most is not None and want[0] > 0:
            want = want * (now[0] / want[0])
        if k == rounds or np.abs(now - want).max() <= tolerance * max(want.sum(), 1e-12):
            break
        h = np.array([[got[f"h{min(a, b)}_{max(a, b)}"] for b in range(domains)] for a in range(domains)])
        steps.append(np.linalg.lstsq(h + 1e-9 * np.trace(h) * np.eye(domains) / domains, now - want, rcond=None)[0])
    return Fit(steps, totals, now, want, tolerance, most)


def _draw(id_col: str, text_col: str) -> Column:
    """A number in [0, 1) of the id and text."""
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / (1 << 30)


def _fitted(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], targets, id_col: str, text_col: str, most: float | None = None, rounds: int = 12, tolerance: float = 1e-6, **options) -> tuple[Classifier, DataFrame, Fit]:
    # ``domain`` reads the labelled table's own columns, so it is taken before names are picked.
    table = labels.select(F.col(id_col), domain.alias("_domain"))
    rows = pick(docs, id=id_col, text=text_col)
    model = fit_classifier(rows, pick(table, id=id_col, domain="_domain"), domains, **options)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                n, p = model.posteriors(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("draw"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(domains), pa.int32()), pa.array(p.ravel()))], names=["id", "draw", "n", "p"])

    known = cut(rows.select("id", "text", _draw("id", "text").alias("draw")).mapInArrow(run, f"id {kind}, draw double, n long, p array<double>"))
    return model, known, fit_rates(known, targets, len(domains), rounds, tolerance, most)


def mix_to_targets(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], targets, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, Fit]:
    """Rates for all documents: id_col, n_tokens, p array<double> by domain, rate, copies; and the fit.

    ``domain`` makes the domain's name from the labelled table's columns. copies is the rate rounded down, or up with the
    rest's probability, by a hash of the id and text.
    """
    _, known, fit = _fitted(docs, labels, domain, domains, targets, id_col, text_col, **options)
    rate = rate_of(F.col("p"), fit.steps, fit.most)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return known.withColumn("rate", rate).select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "p", "rate", copies.alias("copies")), fit


def thin_to_shares(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], shares: list[float], id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1e-4, rounds: int = 30, **options) -> tuple[DataFrame, Fit]:
    """docs, all columns, without the documents that the rates leave out; and the fit.

    Documents of the first domain stay; those of a domain that has more than its share beside the first are thinned until
    the expected tokens are in proportion. Domains that have less than their share cannot be raised and count as they are.
    The posteriors are worked out again where the texts lie, which costs less than moving the texts.
    """
    want = np.asarray(shares, float)

    def targets(totals: np.ndarray) -> np.ndarray:
        return np.minimum(want / want[0] * totals[0], np.concatenate([[np.inf], totals[1:]]))

    rows, text, names = numbered_columns(docs, text_col)
    model, _, fit = _fitted(docs, labels, domain, domains, targets, id_col, text_col, most=1.0, rounds=rounds, tolerance=tolerance, **options)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at):
                _, p = model.posteriors(part.column(at))
                r = np.ones(len(p))
                for step in fit.steps:
                    r = np.minimum(1.0, np.maximum(0.0, r - p @ step))
                yield part.select(range(len(names))).filter(pa.array(part.column(len(names)).to_numpy() < r))

    drawn = rows.withColumn("draw", _draw(f"c{names.index(id_col)}", text))
    return drawn.mapInArrow(run, rows.schema).toDF(*names), fit
