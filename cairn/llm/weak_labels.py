"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. The votes' patterns are counted over
the whole corpus; there are at most 3 to the number of labellers of them, so the counts are all that
expectation-maximisation needs to estimate each labeller's accuracies and the classes' shares. A
pattern's posterior is its label. A hashed linear scorer is fitted to posteriors on a bounded sample
and then scores every document by its text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mixed, shingles, slices, text_rows, utf8, word_hashes, words
from .quality_rules import STOP_WORDS

#: Rows that the scorer is fitted on, about: the share of all hashes of id and text that holds so many.
FIT_ROWS = 6000
BUCKETS = 1 << 15
_SYMBOL, _UPPER, _LETTER = (np.zeros(256, np.int64) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>!")] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1


def _stop_hashes() -> np.ndarray:
    raw = " ".join(STOP_WORDS).encode()
    one = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words(one, np.array([0, len(raw)]))
    return np.unique(word_hashes(one, starts, ends))


def ratios(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text: words; then to each word: symbols, bytes, stop words, distinct words, distinct runs of three; upper-case to letters."""
    starts, ends, counts = words(raw, at)
    hashes = word_hashes(raw, starts, ends)
    runs, n_runs = shingles(hashes, counts, 3)
    n = np.maximum(counts, 1)
    summed = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[at])
    per_doc = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])
    stop = per_doc(np.isin(hashes, _stop_hashes()))
    distinct = lambda values, sizes: np.array([len(np.unique(values[z - k : z])) for k, z in zip(sizes, np.cumsum(sizes), strict=True)])
    return np.stack([counts, summed(_SYMBOL) / n, per_doc(ends - starts) / n, stop / n, distinct(hashes, counts) / n, distinct(runs, n_runs) / np.maximum(n_runs, 1), summed(_UPPER) / np.maximum(summed(_LETTER), 1)], axis=1).astype(np.float64) if len(counts) else np.zeros((0, 7))


@dataclass(frozen=True)
class Labeller:
    """Votes bad beyond `bad`, good within `good`, on documents of at least `words` words; else abstains."""

    name: str
    ratio: int
    good: tuple[float, float]
    bad_below: float = -np.inf
    bad_above: float = np.inf
    words: int = 20

    def votes(self, table: np.ndarray) -> np.ndarray:
        x, enough = table[:, self.ratio], table[:, 0] >= self.words
        bad = (x < self.bad_below) | (x > self.bad_above)
        good = (x >= self.good[0]) & (x <= self.good[1])
        return np.where(~enough, 1, np.where(bad, 0, np.where(good, 2, 1)))


LABELLERS = (
    Labeller("symbols", 1, (0, 0.05), bad_above=0.2),
    Labeller("word_length", 2, (4, 8), bad_below=3, bad_above=12),
    Labeller("stop_words", 3, (0.1, 0.6), bad_below=0.04, words=30),
    Labeller("distinct_words", 4, (0.35, 1), bad_below=0.15, words=50),
    Labeller("distinct_runs", 5, (0.9, 1), bad_below=0.6),
    Labeller("upper_case", 6, (0, 0.2), bad_above=0.5, words=5),
)


def patterns(table: np.ndarray) -> np.ndarray:
    """The votes of all labellers as one number, in base three."""
    out = np.zeros(len(table), np.int64)
    for x in LABELLERS:
        out = out * 3 + x.votes(table)
    return out


def fitted_labels(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 100) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Share of good; accuracies[l, c, v], the chance that labeller l votes v on class c; and the posterior of good of each pattern.

    Starts from the majority of votes; labellers are taken as independent given the class. A pattern
    of abstentions alone keeps the share of good.
    """
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in keys.tolist()], np.float64)
    votes = np.stack([keys // 3**k % 3 for k in range(labellers - 1, -1, -1)], axis=1) if len(keys) else np.zeros((0, labellers), np.int64)
    good = (votes == 2).sum(axis=1) + 0.5
    post = good / (good + 2 * (votes == 0).sum(axis=1) + 0.5)  # a good vote is the rule, a bad one is news
    share, accuracy = 0.5, np.full((labellers, 2, 3), 1 / 3)
    one_hot = votes[:, :, None] == np.arange(3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        accuracy = np.einsum("cp,plv->lcv", weight, one_hot) + 0.5
        accuracy /= accuracy.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        told = np.where(votes[:, :, None] == 1, 0.0, np.log(np.take_along_axis(accuracy.transpose(0, 2, 1)[None], votes[:, :, None, None], axis=2)[:, :, 0, :])).sum(axis=1) if len(keys) else np.zeros((0, 2))
        before, post = post, 1 / (1 + np.exp(np.clip(told[:, 0] - told[:, 1], -50, 50) + np.log((1 - share) / share)))
        if len(post) and np.abs(post - before).max() < 1e-9:
            break
    return np.array([share]), accuracy, dict(zip(keys.tolist(), post.tolist(), strict=True))


def hashed(raw: np.ndarray, at: np.ndarray, table: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, weight and text of each feature: runs of three bytes, with weights that sum to 1 in a text, and the ratios' steps."""
    n = len(raw)
    code = np.zeros(max(0, n - 2), np.uint64)
    if len(code):
        code = raw[:-2].astype(np.uint64) | raw[1:-1].astype(np.uint64) << np.uint64(8) | raw[2:].astype(np.uint64) << np.uint64(16)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(code)]
    whole = np.arange(len(code)) + 3 <= at[owner + 1]
    bucket, owner = (mixed(code[whole]) & np.uint64(buckets - 1)).astype(np.int64), owner[whole]
    size = np.bincount(owner, minlength=len(at) - 1)
    weight = 1 / size[owner] if len(owner) else np.zeros(0)
    steps = np.clip((table[:, 1:] * np.array([20, 1, 20, 10, 10, 10])).astype(np.int64), 0, 20)
    long_enough = table[:, :1] >= 20
    extra = (mixed((steps + np.arange(1, steps.shape[1] + 1) * 1000).astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)
    rows = np.broadcast_to(np.arange(len(table))[:, None], extra.shape)
    chosen = np.broadcast_to(long_enough, extra.shape)
    return np.concatenate([bucket, extra[chosen]]), np.concatenate([weight, np.full(int(chosen.sum()), 0.2)]), np.concatenate([owner, rows[chosen]])


def fitted_scorer(features: tuple[np.ndarray, np.ndarray, np.ndarray], goal: np.ndarray, importance: np.ndarray, buckets: int = BUCKETS, rounds: int = 150, rate: float = 1.0, decay: float = 1e-5) -> np.ndarray:
    """Weights of each bucket and, last, the bias: logistic regression on soft labels by Adagrad over all rows at once."""
    bucket, weight, owner = features
    pair, place = np.unique(owner * buckets + bucket, return_inverse=True)
    x = np.bincount(place, weight)
    owner, bucket = pair // buckets, pair % buckets
    # Both ways in order, so that sums are over neighbours: by row, and by bucket.
    rows, first = np.unique(owner, return_index=True)
    turn = np.argsort(bucket, kind="stable")
    own_buckets, start = np.unique(bucket[turn], return_index=True)
    x_turned, owner_turned = x[turn], owner[turn]
    w, seen, score = np.zeros(buckets + 1), np.full(buckets + 1, 1e-8), np.zeros(len(goal))
    for _ in range(rounds):
        score[rows] = np.add.reduceat(x * w[bucket], first) if len(x) else 0.0
        error = importance * (1 / (1 + np.exp(-np.clip(score + w[-1], -50, 50))) - goal) / max(importance.sum(), 1e-9)
        slope = decay * w
        if len(x):
            slope[own_buckets] += np.add.reduceat(x_turned * error[owner_turned], start)
        slope[-1] += error.sum()
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
    return w


def scorer_weights(rows: DataFrame, posterior: dict[int, float], prior: float, share: float) -> np.ndarray:
    """The scorer's weights, fitted on the rows (doc_id, text) whose hash of both lies in the first `share` of all hashes.

    Their features are made where the rows are: a row holds BUCKETS + 6 of them at most, however long
    its text. Equal rows are one with so much more weight, so hashes bound what is gathered.
    """
    most = max(-(2**63), min(2**63 - 1, int(2**64 * share) - 2**63))
    key = F.xxhash64("doc_id", "text")
    chosen = rows.select(key.alias("key"), "text").where(F.col("key") <= F.lit(most))

    def featured(batches):
        for batch in batches:
            for part in slices(batch, 1):
                raw, at = utf8(part.column(1))
                table = ratios(raw, at)
                bucket, weight, owner = hashed(raw, at, table)
                pair, place = np.unique(owner * BUCKETS + bucket, return_inverse=True)
                edges = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) * BUCKETS).astype(np.int32))
                lists = pa.ListArray.from_arrays(edges, pa.array((pair % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(np.bincount(place, weight, minlength=len(pair))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(patterns(table)), *lists], names=["key", "pattern", "buckets", "weights"])

    each = chosen.mapInArrow(featured, "key long, pattern long, buckets array<int>, weights array<double>")
    sample = each.groupBy("key").agg(F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("pattern", "buckets", "weights")))

    def fit(batches):
        held = list(batches)
        table = pa.Table.from_batches(held).sort_by("key") if held else None
        if not table or not table.num_rows:
            return
        copies = table.column("copies").to_numpy().astype(np.float64)
        goal = np.array([posterior.get(k, prior) for k in table.column("pattern").to_pylist()])
        importance = copies * np.where(goal > 0.5, 0.5 / max((copies * goal).sum(), 1), 0.5 / max((copies * (1 - goal)).sum(), 1)) * copies.sum()
        buckets, weights = (table.column(c).combine_chunks() for c in ("buckets", "weights"))
        owner = np.repeat(np.arange(table.num_rows), np.diff(buckets.offsets.to_numpy()))
        w = fitted_scorer((buckets.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy(), owner), goal, importance)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], names=["w"])

    fitted = sample.repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(bytes(fitted[0].w), "<f8") if fitted else np.zeros(BUCKETS + 1)


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, least: float = 0.4) -> DataFrame:
    """doc_id, label (posterior of good from the votes alone), score (the scorer's probability of good), kept (score >= least).

    The posteriors come from all rows; the scorer is fitted on about `fit_rows` of them, a share of
    all hashes, with both classes weighed alike; every row is scored on its whole text. Null and
    empty texts get the corpus' share of good as both and are kept if that is enough. Rows come out
    one for one, repeated and null ids included. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def vote(batches):
        for batch in batches:
            found, n = np.unique(np.concatenate([patterns(ratios(*utf8(part.column(0)))) for part in slices(batch, 0)] or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    # At most 3 ** len(LABELLERS) rows.
    counts = {r.pattern: r.n for r in rows.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    share, _, posterior = fitted_labels(counts)
    prior = float(share[0])
    shared = spark.sparkContext.broadcast(scorer_weights(rows, posterior, prior, fit_rows / max(1, sum(counts.values()))))

    def score(batches):
        w = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                raw, at = utf8(part.column(1))
                table = ratios(raw, at)
                bucket, weight, owner = hashed(raw, at, table)
                total = np.bincount(owner, weight * w[bucket], minlength=part.num_rows) + w[-1]
                chance = np.where(table[:, 0] > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), prior)
                label = [posterior.get(k, prior) for k in patterns(table).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.float64()), pa.array(chance)], names=["doc_id", "label", "score"])

    return rows.mapInArrow(score, "doc_id long, label double, score double").withColumn("kept", F.col("score") >= F.lit(least))
