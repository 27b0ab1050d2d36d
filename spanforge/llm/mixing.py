"""Soft-membership mixing: a classifier fitted on a labelled table gives each document a posterior over domains, and
projected-gradient least squares fits nonnegative document rates whose expected token totals a domain match targets.

Domains are made from labels(doc_id, quality, toxic): `toxic` if toxic is 1, else `high` or `low` by quality. The
classifier is a softmax regression on hashed words of the whole text, fitted in numpy on a bounded sample of LABELLED
rows, chosen by a hash.

The rates minimise the squared distance of the expected totals from the targets, starting from 1 for every document, and
have no upper bound unless one is given. Steps along the gradient, scaled by the second moments of the rates that can
move, are summed and the sum is projected once (lazy projection), so the rate is a function of a document's own
posterior and of one number a domain: no rate is stored between rounds and a lost executor costs nothing. A round needs
one aggregate. A small weight holds the rates near 1; it falls tenfold until the projected gradient is under a
tolerance, and further while targets that can be met come nearer. Targets that can't be met (no toxic token at all,
where every posterior is positive) end at the tolerance; what is missed is logged.

Defined results: null and empty texts have no tokens and the prior posterior; null labels are ignored; without labels
or tokens all rates are 1; of contradicting labels of a doc_id the last in the order of DOMAINS counts (toxic first); a domain without a label has posterior 0; repeated rows each get the same rate; an empty
table gives no rows; extra columns stay in with_posteriors().
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Words, passes, table, tidy

DOMAINS = ("high", "low", "toxic")
LABELLED = 6000
FEATURES = 1 << 15
WEIGHTS = {"high": 0.75, "low": 0.25, "toxic": 0.0}
#: All tokens in units of the exact sums: far enough below 2**63 for rates of some hundreds.
ROOM = float(1 << 44)
_U = np.uint64
_LOG = logging.getLogger(__name__)

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the distinct words of each text, and the number of white-space words of each text."""
    words = Words(texts, fold=True, breaks=_BREAKS)
    place = words.doc * FEATURES + (words.hash[0] >> _U(20)).astype(np.int64) % FEATURES
    at, n = np.unique(place, return_counts=True)
    doc, feature = at // FEATURES, at % FEATURES
    value = np.log1p(n)
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    tokens = np.diff(Words(texts, fold=False).first)
    return doc, feature, (value / np.maximum(norm[doc], 1e-9)).astype(np.float32), tokens


@tidy
def _rows(batches):
    for batch in batches:
        for part in passes(batch):
            doc, feature, value, _ = features(part.column("text"))
            n = np.bincount(doc, minlength=part.num_rows)
            cut = np.concatenate([[0], np.cumsum(n)])
            cols = [[x[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)] for x in (feature.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), *(pa.array(c, pa.binary()) for c in cols)], ["doc_id", "domain", "features", "values"])


class Softmax:
    def __init__(self, classes: int):
        self.w, self.b = np.zeros((FEATURES, classes), np.float32), np.zeros(classes, np.float32)

    def posteriors(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = np.tile(self.b.astype(np.float64), (n, 1))
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(doc, value * self.w[feature, k], n)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, decay: float = 1e-6, batch: int = 64) -> None:
        """Adagrad on the cross-entropy of small batches, in an order fixed by the rows."""
        rng = np.random.default_rng(5)
        classes = len(self.b)
        seen = np.bincount(labels, minlength=classes)
        self.b = np.where(seen, np.log(np.maximum(seen, 1) / len(labels)), -30.0).astype(np.float32)
        sq = np.full_like(self.w, 1e-4)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
                feature = np.concatenate([rows[k][0] for k in part])
                value = np.concatenate([rows[k][1] for k in part])
                doc = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
                p = self.posteriors(doc, feature, value, len(part))
                p[np.arange(len(part)), labels[part]] -= 1
                ids, at = np.unique(feature, return_inverse=True)
                for k in range(classes):
                    if seen[k]:
                        g = np.bincount(at, value * p[doc, k]) / len(part) + decay * self.w[ids, k]
                        sq[ids, k] += g * g
                        self.w[ids, k] -= (rate * g / np.sqrt(sq[ids, k])).astype(np.float32)


def fit_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> Softmax | None:
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("doc_id is not null and domain is not null")
    chosen = known.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain").mapInArrow(_rows, "doc_id long, domain int, features binary, values binary").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["features"])))
    model = Softmax(len(DOMAINS))
    model.fit([(np.frombuffer(r["features"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows], np.array([r["domain"] for r in rows]))
    return model


def with_posteriors(spark: SparkSession, docs: DataFrame, model: Softmax | None) -> DataFrame:
    """docs with n_tokens (words) and p_<domain> appended; columns of those names are replaced."""
    sent = spark.sparkContext.broadcast(model)  # of one fixed size
    names = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]
    docs = docs.drop(*names)

    @tidy
    def run(batches):
        model = sent.value or Softmax(len(DOMAINS))
        for batch in batches:
            for part in passes(batch):
                doc, feature, value, tokens = features(part.column("text"))
                p = model.posteriors(doc, feature, value, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens.astype(np.int64)), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], [*part.schema.names, *names])

    types = [T.StructField(names[0], T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *types]))


def _pulled(pull: np.ndarray) -> Column:
    """The rate before it is projected: 1 moved against the sum of all steps so far."""
    return reduce(lambda a, b: a - b, [F.col(f"p_{d}") * F.lit(float(x)) for d, x in zip(DOMAINS, pull, strict=True)], F.lit(1.0))


def rate_column(pull: np.ndarray, most: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), _pulled(pull))
    return rate if most is None else F.least(F.lit(float(most)), rate)


def fit_rates(members: DataFrame, targets: dict[str, float] | None, weights: dict[str, float] | None = None, most: float | None = None, tolerance: float = 1e-3) -> tuple[Column, dict[str, dict[str, float]]]:
    """(rate column over p_<domain>, totals by domain: now, target, fitted) for members(n_tokens, p_<domain>).

    targets: token totals by domain; or weights, of which the corpus' tokens make totals. most: the greatest rate, None
    for no bound. tolerance: the projected gradient, a token of the corpus, under which the fit ends.
    """
    t, ps = F.col("n_tokens"), [F.col(f"p_{d}") for d in DOMAINS]
    k = len(DOMAINS)
    total = float(members.agg(F.sum(t)).first()[0] or 0)
    if not total:
        return F.lit(1.0), {}
    # sums of whole numbers don't depend on the order of their parts, so the fit is the same in each run
    unit = ROOM / total
    exact = lambda x: F.sum(F.floor(x * F.lit(unit) + F.lit(0.5)))
    now = np.array(members.agg(*[exact(t * p) for p in ps]).first(), float) / unit
    goal = np.array([float(targets[d]) if targets else total * weights[d] for d in DOMAINS])

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """What the rates of a pull sum up to: value, totals, second moments and greatest rate of those that can move."""
        u, r = _pulled(pull), rate_column(pull, most)
        free = (u > 0) if most is None else (u > 0) & (u < most)
        moments = [exact(F.when(free, t * x * y)) for x in ps for y in ps]
        row = members.agg(exact(t * (r * u - r * r / 2)), F.max(F.when(t > 0, r)), *[exact(r * t * p) for p in ps], *moments).first()
        return float(row[0]) / ROOM, np.array(row[2 : k + 2], float) / ROOM, np.array([x or 0 for x in row[k + 2 :]], float).reshape(k, k) / ROOM, float(row[1])

    pull, keep, before = np.zeros(k), 1e-2, np.inf
    value, at, moments, greatest = look(pull)
    while True:
        for _ in range(100):  # to the rates that are best for this weight of staying near 1
            slope = goal / total - at + keep * pull
            if np.abs(slope).max() < 1e-9 + 1e-3 * keep * np.abs(pull).max():
                break
            step, scale = -np.linalg.solve(moments + keep * np.eye(k), slope), 1.0
            whole = value + pull @ goal / total + keep / 2 * pull @ pull
            while True:
                new = pull + scale * step
                seen = look(new)
                if seen[0] + new @ goal / total + keep / 2 * new @ new <= whole + 1e-4 * scale * (slope @ step) or scale < 1e-6:
                    break
                scale /= 2
            pull, (value, at, moments, greatest) = new, seen
        gap = np.abs(at - goal / total).max()
        # targets that can be met come nearer in proportion to keep; others end at the tolerance
        if gap < 1e-6 or keep < 1e-9 or (keep * max(1.0, greatest - 1) < tolerance and gap > 0.3 * before):
            break
        keep, before = keep / 10, gap
    totals = {d: {"now": now[i], "target": goal[i], "fitted": at[i] * total} for i, d in enumerate(DOMAINS)}
    return rate_column(pull, most), totals


def copies_of(rate: Column, rounding: str = "hash") -> Column:
    """How often a document is taken: the rate, rounded so that totals hold on average (hash of doc_id), or to the nearest."""
    part = F.lit(0.5) if rounding == "nearest" else F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + part).cast("int")


def clean_targets(members: DataFrame) -> dict[str, float]:
    """Targets that keep what is expected of each domain but the toxic one, of which nothing is wanted."""
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    unit = ROOM / max(1, total)
    row = [(x or 0) / unit for x in members.agg(*[F.sum(F.floor(F.col("n_tokens") * F.col(f"p_{d}") * F.lit(unit) + F.lit(0.5))) for d in DOMAINS]).first()]
    return {d: 0.0 if d == "toxic" else float(x or 0) for d, x in zip(DOMAINS, row, strict=True)}


def op3_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_classifier(spark, docs, table(spark, sf_dir, "labels"))
    members = Scratch(spark, "mixing").table(with_posteriors(spark, docs, model).drop("text"), "members")
    rate, totals = fit_rates(members, None, WEIGHTS)
    for d, x in totals.items():
        _LOG.log(logging.WARNING if abs(x["fitted"] - x["target"]) > 1e-3 * sum(y["target"] for y in totals.values()) else logging.INFO, "%s: %.0f tokens, target %.0f, fitted %.0f", d, x["now"], x["target"], x["fitted"])
    members = members.withColumn("rate", rate)
    return members.select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", copies_of(F.col("rate")).alias("copies"))
