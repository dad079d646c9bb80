"""Toxicity by weak supervision.

1. Voters. A short general lexicon gives word voters. Words and word beginnings (4 to 7 letters) that
   favour toxic rows in the labelled training rows give pattern voters. Each votes "toxic" where it
   occurs and abstains elsewhere. The labels only serve to pick voters.
2. Label model. The votes on the training rows are explained by a hidden label: each voter has its own
   accuracy, estimated from the votes alone by expectation maximisation, all from one start: a voter that others join
   is right more often than one that stands alone, as a single vote leaves a row below its voter's accuracy.
   Correlations among likely toxic rows are estimated beside; voters joined by a strong one (``DEPENDENT``)
   depend on each other, so each one's evidence is divided by the sum of those correlations and the posterior
   counts a repeated signal once.
3. A linear (logistic) classifier of the same kind of features learns the posterior labels and scores
   every whole text.

The training rows are bounded: at most about ``max_per_class`` labelled rows of each class, by a hash
of the doc_id (never a held-out row). Scoring covers all documents and all of each text. Inputs of a
score are words of the text only.

Edge cases: null and empty texts get the score of a text without features; a document of several
labels counts with its largest; without any training row of either class the lexicon alone decides; a
null doc_id is never a training row and not held out; repeated rows are scored each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.common import checked, table, written

#: Lexicon voters: common insults.
LEXICON = ["idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "jerk", "bastard"]
PREFIXES = (4, 5, 6, 7)
MAX_PER_CLASS = 5000
MAX_VOTERS = 400
MAX_FEATURES = 20000
MIN_PRECISION, MAX_NOISE = 0.87, 0.03
FOLDS = 5
#: The label model: share of toxic rows before any vote; accuracy where the search begins for all voters, and its weight
#: beside the votes (votes that no independent voter joins say little); correlation from which voters depend on each other.
PRIOR, START, LEAN, DEPENDENT = 0.4, MIN_PRECISION, 0.5, 0.8
WORD = re.compile(r"[^\W_]+")


def features_of(text: str, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """Words (``=word``) and word beginnings (``begi``) of a text."""
    found: set[str] = set()
    for word in set(WORD.findall(text.lower())):
        own = cache.get(word)
        if own is None:
            if len(cache) > 500_000:
                cache.clear()
            own = cache[word] = ("=" + word, *(word[:n] for n in PREFIXES if len(word) >= n))
        found.update(own)
    return found


def shingle_minima(text: str) -> tuple[int, int]:
    """The least hash of a text's 5-word shingles, under two orders."""
    words = WORD.findall(text.lower())
    hashes = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))]
    return min(hashes), min(h * 0x9E3779B97F4A7C15 % (1 << 63) for h in hashes)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(text, toxic) of the bounded training sample."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}  # two rows
    share = F.lit(0.0)
    for toxic, n in sizes.items():
        share = F.when(F.col("toxic") == toxic, min(1.0, max_per_class / n)).otherwise(share)
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(checked(sample), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [shingle_minima(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64())], names=["doc_id", "text", "toxic", "m1", "m2"])

    # copies would vouch for one another's accidental words: one row for each least shingle, under two orders
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(sketch, "doc_id long, text string, toxic int, m1 long, m2 long")
    for m in ("m1", "m2"):
        rows = rows.groupBy(m).agg(F.min(F.struct("doc_id", "text", "toxic", *({"m1", "m2"} - {m}))).alias("x")).select(m, "x.*")
    return written(rows.select("text", "toxic"), "toxicity-sample")


def induced(rows: DataFrame, max_features: int = MAX_FEATURES, min_rows: int = 3, min_share: float = 0.02) -> list[tuple[str, int, int]]:
    """Features that favour toxic rows: (feature, toxic rows with it, other rows with it), strongest first.

    They occur in at least ``min_rows`` toxic rows and ``min_share`` of them; what a few near copies have
    in common is no pattern.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, cache = (Counter(), Counter()), {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                both[int(toxic > 0)].update(features_of(text, cache))
        for kind, counter in enumerate(both):
            names = list(counter)
            for at in range(0, len(names), 100_000):
                some = names[at : at + 100_000]
                n = pa.array([counter[x] for x in some], pa.int64())
                zero = pa.array([0] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(some), n if kind else zero, zero if kind else n], names=["feature", "pos", "neg"])

    counts = rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n_toxic = rows.where("toxic > 0").count()
    strong = counts.where((F.col("pos") >= max(min_rows, min_share * n_toxic)) & (F.col("pos") > F.col("neg")))
    kept = strong.orderBy((F.col("pos") - F.col("neg")).desc(), "feature").limit(max_features)
    return [(r["feature"], r["pos"], r["neg"]) for r in kept.collect()]


class LabelModel:
    """Posterior of a hidden binary label, given voters that vote "toxic" or abstain; no label is used.

    A voter that fires is right with its ``accuracy``, whatever the label abstains from; rows for which none
    fires get one vote for "clean" of accuracy ``clean``. Both are found by expectation maximisation.
    """

    def __init__(self, prior: float = PRIOR, start: float = START, rounds: int = 50):
        self.prior, self.start, self.rounds = prior, start, rounds

    def fit(self, votes: np.ndarray) -> np.ndarray:
        fired = votes.sum(0)
        silent = votes.sum(1) == 0
        self.accuracy, self.clean = np.full(votes.shape[1], self.start), 0.9
        self.weight = np.ones(votes.shape[1])
        for _ in range(self.rounds):
            self.weight = 1 / self._dependence(votes, self.posterior(votes))
            posterior = self.posterior(votes)
            accuracy = ((posterior @ votes + self.start * (LEAN * fired + 1)) / ((1 + LEAN) * fired + 1)).clip(0.05, 0.98)
            self.clean = float(np.clip(1 - posterior[silent].mean() if silent.any() else 0.9, 0.5, 0.98))
            moved, self.accuracy = np.abs(accuracy - self.accuracy).max(initial=0), accuracy
            if moved < 1e-4:
                break
        return self.posterior(votes)

    @staticmethod
    def _dependence(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """By voter, the sum of its correlations with the voters it depends on (1 with itself), among likely toxic rows.

        Voters of one language always fire together more than chance; that is no dependence.
        """
        mean = posterior @ votes / max(posterior.sum(), 1e-9)
        centred = (votes - mean) * np.sqrt(posterior)[:, None]
        cov = centred.T @ centred
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / scale[:, None] / scale[None, :]
        return np.where(corr > DEPENDENT, corr, 0).clip(0, 1).sum(1).clip(1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.accuracy / (1 - self.accuracy)))
        odds = odds - (votes.sum(1) == 0) * np.log(self.clean / (1 - self.clean))
        return 1 / (1 + np.exp(-odds.clip(-60, 60)))


def fit_linear(index: np.ndarray, owner: np.ndarray, target: np.ndarray, k: int, rounds: int = 800, rate: float = 0.5, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows, given as (row, feature) pairs, and soft targets, by full-batch Adagrad."""
    n = len(target)
    w, b = np.zeros(k), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    gw, gb = np.full(k, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, w[index], n) + b
        error = 1 / (1 + np.exp(-z.clip(-60, 60))) - target
        g = np.bincount(index, error[owner], k) / n + l2 * w
        gw += g * g
        gb += error.mean() ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * error.mean() / np.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept."""
    rows = training_rows(docs, labels, max_per_class)
    found = induced(rows)
    names = list(dict.fromkeys(["=" + w for w in LEXICON] + [f for f, _, _ in found]))
    measured = {f: (pos + 0.5) / (pos + neg + 1) for f, pos, neg in found}
    precise = [f for f, pos, neg in found if measured[f] >= MIN_PRECISION and neg <= MAX_NOISE * pos]
    voters = list(dict.fromkeys(["=" + w for w in LEXICON] + precise))[:MAX_VOTERS]
    number = {f: i for i, f in enumerate(names)}
    shipped = docs.sparkSession.sparkContext.broadcast(number)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = shipped.value, {}
        for batch in batches:
            own = [sorted(known[f] for f in features_of(t, cache) if f in known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], names=["own"])

    own = rows.mapInArrow(index, "own array<int>").toArrow().column("own").combine_chunks()  # bounded by max_per_class
    if not len(own) or not found:
        return {"=" + w: 6.0 for w in LEXICON}, -3.0
    feature = own.flatten().to_numpy()
    owner = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(own.offsets.to_numpy()))
    column = np.full(len(names), -1, np.int32)
    column[[number[f] for f in voters]] = np.arange(len(voters))
    cast = column[feature] >= 0
    votes = np.zeros((len(own), len(voters)), np.float32)
    votes[owner[cast], column[feature[cast]]] = 1
    posterior = LabelModel().fit(votes)
    w, b = fit_linear(feature, owner, posterior, len(names))
    return {f: float(w[i]) for f, i in number.items() if w[i]}, b


def score(docs: DataFrame, weights: dict[str, float], intercept: float, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the score of each row's whole text, named ``name``."""
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, b = model.value
        cache: dict[str, tuple[tuple[str, float], ...]] = {}
        for texts in batches:
            out = []
            for t in texts:
                hit: dict[str, float] = {}
                for word in set(WORD.findall((t.as_py() or "").lower())):
                    own = cache.get(word)
                    if own is None:
                        if len(cache) > 500_000:
                            cache.clear()
                        own = cache[word] = tuple((f, known[f]) for f in ("=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)) if f in known)
                    if own:
                        hit.update(own)
                out.append(1 / (1 + np.exp(-min(60.0, max(-60.0, sum(hit[f] for f in sorted(hit)) + b)))))
            yield pa.array(out, pa.float64())

    return docs.select(*keep, scores(F.col(text)).alias(name))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic."""
    return score(docs, *train(docs, labels), docs.columns, name="_tessera_score").where("_tessera_score < 0.5").drop("_tessera_score")
