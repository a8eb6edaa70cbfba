"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters look at a text and say "toxic" or nothing: every word of a small fixed lexicon; words and word
beginnings (4 to 6 bytes) mined from labelled rows as much more frequent in toxic ones; and patterns over those (two
lexicon hits, a hit in a short text, shouting). The label model gives each voter a firing rate for either class
(its accuracy), fitted by EM; voters whose votes still move together within a class share their weight. Its posteriors on
the labelled rows are the targets of a logistic regression with an L1 penalty on word and beginning features,
which scores every text. Labels serve to mine voters and to start the EM.

Fitting reads about `train_rows` labelled rows (at most twice as many), picked by hash, of the folds allowed (`learn`), equal ones once; mining keeps at most
`FEATURES` features. Everything kept on the driver or sent to tasks is bounded by these two. Scoring reads every text.

Defined results: null and empty texts have the score of a text without any feature; labels that are null, or whose
doc_id no document has, are not used; a doc_id with two labels counts as toxic; without labelled rows of both classes
the score rests on the fixed lexicon alone; repeated rows get equal scores; extra columns are kept, and
score and predicted replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .held import let_go
from .rows import with_columns
from .store import written
from .text import Words, buffers, owners, pieces

TRAIN_ROWS = 20_000
FEATURES = 4_096
MINED = 256
MINE_BYTES = 1 << 20  # bytes of text handled at once
PREFIXES = (4, 5, 6)
LEXICON = ("idiot stupid moron loser clown trash scum worthless pathetic disgusting dumb ugly garbage filth vermin "
           "imbecile cretin scumbag freak creep coward liar crap hate kill").split()

_GAP = np.ones(256, dtype=bool)  # words of letters, digits and all beyond ASCII
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_U = np.uint64


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(document, feature hash) of every word and beginning, both flat, and the documents' lengths in words."""
    words = Words(*buffers(column), lower=True, gap=_GAP, prefixes=PREFIXES)
    doc = owners(words.offsets)
    salt = np.arange(1, len(PREFIXES) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    hashes = np.concatenate([words.hashes[:, None], np.where(words.prefixes == 0, _U(0), words.prefixes ^ salt)], axis=1)
    return np.repeat(doc, 1 + len(PREFIXES)), hashes.reshape(-1), words.counts(), words


def word_hash(word: str) -> int:
    return int(_features(pa.array([word]))[1][0])


class Vocabulary:
    """Sorted feature hashes with a bit table in front, which most look-ups do not pass."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.front = np.zeros(1 << 20, dtype=bool)
        self.front[hashes & _U((1 << 20) - 1)] = True

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, feature number) pairs, in order, and the documents' word counts."""
        doc, hashes, counts, _ = _features(column)
        maybe = np.flatnonzero(self.front[hashes & _U((1 << 20) - 1)])
        doc, hashes = doc[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        real = (self.hashes[at] == hashes) if len(self.hashes) else np.zeros(0, bool)
        pairs = np.unique(doc[real] * len(self.hashes) + at[real]) if len(self.hashes) else np.zeros(0, np.int64)
        return pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1), counts


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> documents by feature hash and class, summed within the task's slices."""
    let_go()
    for batch in pieces(batches, "text", MINE_BYTES):
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        doc, hashes, _, _ = _features(batch.column(0))
        order = np.argsort(hashes, kind="stable")  # documents stay in order within a hash
        doc, hashes = doc[order], hashes[order]
        del order
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) & (hashes != 0) if len(doc) else np.zeros(0, bool)
        doc, hashes = doc[new], hashes[new]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        kinds, every = hashes[first], np.diff(np.concatenate([first, [len(hashes)]]))
        bad = np.add.reduceat(toxic[doc], first) if len(first) else first
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["h", "bad", "good"])


def _pattern_votes(column: pa.Array, lexical: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pattern voters: two hits, four hits, a hit per 50 words, shouting."""
    data, off = buffers(column)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    letters = np.concatenate([[0], np.cumsum(~_GAP[data])])
    share = (upper[off[1:]] - upper[off[:-1]]) / np.maximum(letters[off[1:]] - letters[off[:-1]], 1)
    return np.stack([lexical >= 2, lexical >= 4, lexical * 50 >= np.maximum(counts, 1), share > 0.5], axis=1)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of "toxic", firing rates by class, weights) from binary votes, documents x voters.

    Two EM runs: the first with independent voters; correlations left within a class then give each voter the
    weight 1 / (1 + sum of its correlations), with which the second runs."""
    votes = votes.astype(np.float64)
    weights = np.ones(votes.shape[1])
    post, rates = start.astype(np.float64), np.zeros((2, votes.shape[1]))
    for run in range(2):
        for _ in range(rounds):
            prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
            rates = np.stack([(votes.T @ r + 0.1) / (r.sum() + 0.2 + 1e-9) for r in (1 - post, post)])
            rates = np.clip(rates, 1e-4, 1 - 1e-4)
            fire, still = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
            logit = np.log(prior / (1 - prior)) + votes @ (weights * (fire - still)) + (weights * still).sum()
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if run == 0 and votes.shape[1] > 1:
            left = votes - np.outer(1 - post, rates[0]) - np.outer(post, rates[1])
            spread = np.sqrt((left ** 2).mean(axis=0)) + 1e-9
            correlation = (left.T @ left) / len(left) / np.outer(spread, spread)
            np.fill_diagonal(correlation, 0)
            weights = 1 / (1 + np.maximum(correlation - 0.05, 0).sum(axis=1))
    return post, rates, weights


def _logistic(doc: np.ndarray, feature: np.ndarray, target: np.ndarray, size: int, penalty: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression on presence features (accelerated proximal gradient)."""
    n = len(target)
    per_doc = np.bincount(doc, minlength=n)
    rate = 4.0 / max(1.0, per_doc.mean() + 2 * per_doc.std())  # a step for rows of usual length; halved when the loss rises
    weights, bias, ahead, ahead_bias, t = np.zeros(size), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))), np.zeros(size), 0.0, 1.0
    ahead_bias, last = bias, np.inf
    for _ in range(steps):
        logit = np.clip(np.bincount(doc, weights=ahead[feature], minlength=n) + ahead_bias, -30, 30)
        p = 1 / (1 + np.exp(-logit))
        loss = -(target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12)).mean() + penalty * np.abs(ahead).sum()
        if loss > last * 1.0001:
            rate, t, ahead, ahead_bias = rate / 2, 1.0, weights.copy(), bias
            last = np.inf
            continue
        last = loss
        error = (p - target) / n
        step = ahead - rate * np.bincount(feature, weights=error[doc], minlength=size)
        fresh = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        fresh_bias = ahead_bias - rate * error.sum()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = fresh + (t - 1) / grown * (fresh - weights), fresh_bias + (t - 1) / grown * (fresh_bias - bias)
        weights, bias, t = fresh, fresh_bias, grown
    return weights, bias


def _calibrate(logit: np.ndarray, target: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """(scale, shift) that undo the penalty's shrinkage: logistic regression of the target on the logit (Newton)."""
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (p - target) + ridge * (at - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        at = at - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


class Model:
    """Feature hashes, their weights and the intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def scores(self, vocabulary: Vocabulary, column: pa.Array) -> np.ndarray:
        doc, feature, counts = vocabulary.present(column)
        logit = np.bincount(doc, weights=self.weights[feature], minlength=len(counts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _lexicon_model() -> Model:
    hashes = np.unique(np.array([word_hash(w) for w in LEXICON], dtype=_U))
    return Model(hashes, np.full(len(hashes), 4.0), -3.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of `docs` whose doc_id `learn` (an expression over doc_id) allows."""
    marked = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = marked.count()
    share = int(min(1.0, train_rows / max(count, 1)) * (1 << 40))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share)  # about train_rows rows, hence the broadcast
    sample = written(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
                     .join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")
    rows = sample.count()
    if rows > 2 * train_rows:  # ids that many different texts share: pick among rows
        sample = written(sample.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(train_rows / rows * (1 << 40))), "labelled")
    sample = sample.select("text", "toxic")
    total, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == total:
        return _lexicon_model()
    good = total - bad
    counted = sample.mapInArrow(_mine, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p1, p0, p = F.col("bad") / bad, F.col("good") / good, (F.col("bad") + F.col("good")) / total
    z = (p1 - p0) / F.sqrt(p * (1 - p) * F.lit(1 / bad + 1 / good) + 1e-12)
    ranked = counted.where("bad + good >= 3").withColumn("z", z).orderBy(F.desc(F.abs("z")), "h").limit(FEATURES)
    rows = ranked.collect()  # FEATURES rows at most
    lexicon = np.array([word_hash(w) for w in LEXICON], dtype=_U)
    mined = np.array([r["h"] for r in rows], dtype=np.int64).view(_U)
    hashes = np.unique(np.concatenate([mined, lexicon]))
    strong = [(r["z"], r["h"]) for r in rows if r["z"] > 3 and r["bad"] / bad >= 5 * r["good"] / good]
    voters = np.union1d(np.array([h for _, h in sorted(strong, reverse=True)[:MINED]], dtype=np.int64).view(_U), lexicon)
    is_voter = np.isin(hashes, voters)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        vocabulary = Vocabulary(hashes)
        for batch in pieces(batches, "text", MINE_BYTES):
            doc, feature, counts = vocabulary.present(batch.column(0))
            lexical = np.bincount(doc[is_voter[feature]], minlength=len(counts))
            patterns = _pattern_votes(batch.column(0), lexical, counts)
            bounds = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
            edges = (np.arange(len(counts) + 1) * patterns.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32))),
                                              pa.ListArray.from_arrays(pa.array(edges), pa.array(patterns.reshape(-1)))], names=["toxic", "features", "patterns"])

    got = sample.mapInArrow(present, "toxic int, features array<int>, patterns array<boolean>").toArrow()  # train_rows rows x FEATURES at most
    toxic = np.asarray(got["toxic"]).astype(np.int64)
    lists = got["features"].combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    doc, feature = np.repeat(np.arange(len(toxic)), sizes), np.asarray(lists.flatten())
    numbers = np.cumsum(is_voter) - 1
    votes = np.zeros((len(toxic), int(is_voter.sum())), dtype=bool)
    ballot = is_voter[feature]
    votes[doc[ballot], numbers[feature[ballot]]] = True
    patterns = np.asarray(got["patterns"].combine_chunks().flatten()).reshape(len(toxic), -1)
    posterior, _, _ = label_model(np.concatenate([votes, patterns], axis=1), np.where(toxic > 0, 0.9, 0.1))
    weights, bias = _logistic(doc, feature, posterior, len(hashes))
    scale, shift = _calibrate(np.bincount(doc, weights=weights[feature], minlength=len(toxic)) + bias, posterior)
    used = weights != 0
    return Model(hashes[used], scale * weights[used], scale * bias + shift)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with score (0 to 1) and predicted (1 from 0.5)."""
    found: list[Vocabulary] = []

    def compute(column: pa.Array) -> list[pa.Array]:
        if not found:  # once a task
            let_go()
            found.append(Vocabulary(model.hashes))
        scores = model.scores(found[0], column)
        return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

    return with_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute, keep, limit=MINE_BYTES)
