"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives and unlabelled web text fit a logistic model on the shape of texts, so as to
minimise  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)):  where the second
part would turn negative, which means that the model fits noise, a step is taken against it.
The class prior is estimated from the same two samples by how many unlabelled texts look positive
to models that have not seen them.  Labelled negatives have no part in anything: with the prior
right, the risk itself sets the scale of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import pieces, table

#: Bytes counted one by one; others fall into classes.
_MARKS = b"|#$%&*!?.,;:-_=+@/\\<>()[]{}\"'~^`"
NAMES = [
    "log_words", "word_length", "word_spread", "upper", "title", "digit", "high", "line", "distinct", "again", "again_far",
    *(f"mark_{c:02x}" for c in _MARKS), "mark_end", "mark_alone", "vowel", "long_words",
]
BINS = 12
#: Trusted positives that the model is fitted on, at most, and unlabelled rows, at most.
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 20_000
EPOCHS, RATE, DECAY, SEED = 300, 0.05, 1e-3, 11
#: Parts that the prior is estimated on, each by a model of the others, and how those are fitted.
FOLDS, PRIOR_EPOCHS, PRIOR_DECAY = 3, 200, 1e-2


def features(texts: list[bytes]):
    """A row of numbers for each text that describe its shape: no names, no ids, no source."""
    import numpy as np

    from granary.llm.bytescan import buffer, word_hashes, words

    n = len(texts)
    data, begins = buffer(texts)
    starts, ends = words(data)
    firsts = np.searchsorted(starts, begins)
    count = np.diff(firsts)
    has = np.maximum(count, 1)
    size = np.maximum(np.diff(begins) - 1, 1)
    owner = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(np.float64)

    def by_text(values):
        return np.bincount(owner, weights=values, minlength=n)[:n]

    kinds = np.zeros(256, dtype=np.uint8)
    kinds[0x41:0x5B], kinds[0x61:0x7B], kinds[0x30:0x3A], kinds[0x80:], kinds[0x0A] = 1, 2, 3, 4, 5
    for v in b"aeiouAEIOU":
        kinds[v] += 5  # 6 upper, 7 lower
    for k, c in enumerate(_MARKS):
        kinds[c] = 8 + k
    width = 8 + len(_MARKS)
    place = np.repeat(np.arange(n), np.diff(begins))
    chars = np.bincount(place * width + kinds[data], minlength=n * width)[: n * width].reshape(n, width).astype(np.float64)
    upper, lower = chars[:, 1] + chars[:, 6], chars[:, 2] + chars[:, 7]
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    inside = np.arange(len(hashes)) - np.repeat(firsts[:-1], count)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (inside[1:] > 0)
    # Where a word came before, at no matter what distance: the same two words twice.
    pair = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1] if len(hashes) > 1 else np.empty(0, dtype=np.uint64)
    inner = np.flatnonzero(inside[1:] > 0)
    o = inner[np.lexsort((pair[inner], owner[inner + 1]))]
    same = np.zeros(len(hashes))
    if len(o) > 1:
        same[o[1:] + 1] = (pair[o[1:]] == pair[o[:-1]]) & (owner[o[1:] + 1] == owner[o[:-1] + 1])
    first, last = kinds[data[starts]], kinds[data[np.maximum(ends - 1, 0)]]
    title = np.isin(first, (1, 6))
    end = (last >= 8) & ~np.isin(last, [8 + _MARKS.index(c) for c in b".,"])
    alone = (last >= 8) & (length == 1)
    mean = by_text(length) / has
    columns = [
        np.log1p(count), mean, np.sqrt(np.maximum(by_text(length**2) / has - mean**2, 0)), upper / np.maximum(upper + lower, 1), by_text(title) / has, chars[:, 3] / size, chars[:, 4] / size, chars[:, 5] / has,
        np.bincount(owner[order], weights=fresh, minlength=n)[:n] / has / np.maximum(1 - 0.06 * np.log1p(count), 0.1), by_text(again) / has, by_text(same) / has,
        *(chars[:, 8 + k] / has for k in range(len(_MARKS))), by_text(end) / has, by_text(alone) / has, (chars[:, 6] + chars[:, 7]) / np.maximum(upper + lower, 1), by_text(length > 25) / has,
    ]
    return np.stack(columns, axis=1)


class Model:
    """A logistic model over bins of each feature."""

    def __init__(self, cuts, weights, bias: float, fitted: bool = True):
        self.cuts, self.weights, self.bias, self.fitted = cuts, weights, bias, fitted

    @staticmethod
    def bins(x):
        """Cuts between values of each feature: quantiles, without those that coincide."""
        import numpy as np

        return [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]), np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, BINS // 2 + 1)[:-1]) if (x[:, j] > 0).any() else []])) for j in range(x.shape[1])]

    @staticmethod
    def codes(x, cuts):
        import numpy as np

        at = np.cumsum([0, *(len(c) + 1 for c in cuts)])
        return np.stack([at[j] + np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1), int(at[-1])

    def margin(self, x):
        return self.weights[self.codes(x, self.cuts)[0]].sum(axis=1) + self.bias

    def score(self, texts: list[bytes]):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.margin(features(texts)), -30, 30)))


def estimate_prior(positive, unlabelled) -> float:
    """The share of positives among unlabelled scores: where few enough of the positives score lower still.

    A share a of all scores below a cut holds at least its part of positives, so for every cut
    prior <= (unlabelled above) / (positive above); the least such bound, at cuts that leave enough rows.
    """
    import numpy as np

    cuts = np.quantile(positive, np.linspace(0.02, 0.3, 15))
    bounds = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(bounds), 0.05, 0.99))


def _train(cp, cu, width: int, prior: float, risk: str, epochs: int, decay: float = DECAY):
    """Full-batch Adam; risk: the non-negative one, or plain positives against unlabelled."""
    import numpy as np

    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)

    def grad(codes, g):
        out = np.bincount(codes.ravel(), weights=np.repeat(g, codes.shape[1]), minlength=width)
        return np.append(out, g.sum())

    for t in range(1, epochs + 1):
        zp, zu = w[cp].sum(axis=1) + b, w[cu].sum(axis=1) + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        if risk == "plain":
            g = grad(cp, (sp - 1) / len(sp)) + grad(cu, su / len(su))
        else:
            plus = grad(cp, prior * (sp - 1) / len(sp))
            minus = grad(cu, su / len(su)) - grad(cp, prior * sp / len(sp))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = plus + minus if negative >= 0 else -minus
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(positive, unlabelled, of_positive, of_unlabelled) -> tuple[Model, float]:
    """Feature rows of trusted positives and of unlabelled texts, and a number of each row's text -> (model, class prior).

    Rows of one text have one number, so that no text is on both sides of a fold.  With fewer
    than two rows of either kind nothing is fitted: all texts score one half.
    """
    import numpy as np

    if len(positive) < 2 or len(unlabelled) < 2:
        return Model([np.empty(0)] * len(NAMES), np.zeros(len(NAMES)), 0.0, fitted=False), 0.5
    cuts = Model.bins(np.concatenate([positive, unlabelled]))
    (cp, width), (cu, _) = Model.codes(positive, cuts), Model.codes(unlabelled, cuts)
    fp, fu = of_positive % FOLDS, of_unlabelled % FOLDS
    priors = []
    for k in range(FOLDS):
        if min((fp == k).sum(), (fu == k).sum(), (fp != k).sum(), (fu != k).sum()):
            w, b = _train(cp[fp != k], cu[fu != k], width, 0.5, "plain", PRIOR_EPOCHS, PRIOR_DECAY)
            priors.append(estimate_prior(w[cp[fp == k]].sum(axis=1) + b, w[cu[fu == k]].sum(axis=1) + b))
    prior = sum(priors) / len(priors) if priors else 0.5
    w, b = _train(cp, cu, width, prior, "pu", EPOCHS)
    return Model(cuts, w, b), prior


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "text"):
            x = features([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "h", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from at most `most` rows of docs that are labelled 1 and `unlabelled` rows of any kind, none held out.

    Both samples are those with the least hashes of their ids, so they are the same in every
    run.  Labels that are null or neither 0 nor 1 are ignored; of several for one id the least
    counts.  Null texts count as empty, null ids have no label, repeated rows count as often as
    they come; empty tables give a model that is not fitted and scores one half throughout.
    """
    import numpy as np

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(~held_out(F.col("doc_id")))
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    hashed = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(SEED))
    # At most `most` rows: small enough to send everywhere.
    marked = docs.join(F.broadcast(known), "doc_id").withColumn("h", hashed)
    n = docs.count()
    share = min(1.0, 1.2 * unlabelled / max(n, 1))
    others = docs.withColumn("h", hashed).filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("quality", F.lit(None).cast("int"))

    def rows(df, most):
        found = df.select("quality", "h", "text").mapInArrow(_features, "quality int, h long, x binary").orderBy("h", "x").limit(most).collect()
        return np.frombuffer(b"".join(bytes(r["x"]) for r in found), dtype=np.float64).reshape(len(found), len(NAMES)), np.array([r["h"] for r in found], dtype=np.int64)

    (x, hx), (u, hu) = rows(marked, most), rows(others, unlabelled)
    return fit(x, u, hx, hu)[0]


def _scores(batches: Iterator, model: Model) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "text"):
            score = model.score([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): how likely each text is of good quality, 0 to 1.

    A null text counts as empty and is scored like one; null ids and repeated rows are returned
    as they come; an empty table gives an empty result; further columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _scores(b, model), "doc_id long, score double")


def _good(batches: Iterator, model: Model, least: float) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "text"):
            yield part.filter(pa.array(model.score([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]) >= least))


def without_rejected(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more; all of them if the model is not fitted.

    Null and empty texts are scored like any; null ids and repeated rows are kept or go by their
    text alone; an empty table gives an empty result; further columns are kept, whatever their names.
    """
    if not model.fitted:
        return docs
    return docs.mapInArrow(lambda b: _good(b, model, least), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}
