"""Toxicity scores that do not hinge on who is mentioned."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.llm.ftrl import FollowTheRegularisedLeader
from wagerframe.llm.language import remainder
from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches

#: Groups of exchangeable identity terms: a term may be swapped for any other of its group.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "african", "arab", "latino", "european", "indigenous"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["immigrants", "refugees", "foreigners", "locals"],
    ["old", "young", "elderly"],
    ["blind", "deaf", "disabled", "autistic"],
    ["mexican", "chinese", "indian", "russian", "american", "german", "french", "turkish", "polish"],
]
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6, 7, 8)


def swaps(terms: list[list[str]]) -> dict[str, list[str]]:
    return {term: [x for x in group if x != term] for group in terms for term in group}


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; a beginning is told from a word by its star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def text_features(words: set[str]) -> set[str]:
    return {f for word in words for f in word_features(word)}


def counterfactuals(text: str, terms: list[list[str]], exchange: dict[str, list[str]], k: int) -> Iterator[tuple[set[str], set[str]]]:
    """Word sets of the text's sentences and of counterfactual forms of them.

    A sentence that names a group meets itself with other groups named. In a text
    that names none, one sentence (the ``k``-th, counted around) meets itself with
    a neutral mention put in: one term of every group of terms, in turn.
    """
    plain, named = [], False
    for at, sentence in enumerate(SENTENCE.findall(text.lower())):
        words = WORDS.findall(sentence)
        if any(word in exchange for word in words):
            named = True
            turn = lambda i, w: exchange[w][(k + at + i) % len(exchange[w])]
            yield set(words), {turn(i, w) if w in exchange else w for i, w in enumerate(words)}
        elif words:
            plain.append(set(words))
    if plain and not named:
        words = plain[k % len(plain)]
        for group in terms:
            yield words, words | {group[k % len(group)]}


class ToxicityModel:
    """A weight per feature that has one, and an intercept; scores depend on which words occur, not how often.

    ``pairs`` counts the counterfactual pairs that were regularised.
    """

    def __init__(self, weights: dict[str, float], intercept: float, pairs: int = 0):
        self.weights, self.intercept, self.pairs = weights, intercept, pairs
        self.known: dict[str, tuple[str, ...]] = {}

    def logit(self, words: set[str]) -> float:
        found: set[str] = set()
        for word in words:
            features = self.known.get(word)
            if features is None:
                features = tuple(f for f in word_features(word) if f in self.weights)
                if len(self.known) > 500_000:
                    self.known.clear()
                self.known[word] = features
            if features:
                found.update(features)
        return self.intercept + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        logit = self.logit(set(WORDS.findall((text or "").lower())))
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))))


def neutral_mention_errors(model: ToxicityModel, texts: list[str], terms: list[list[str]] = IDENTITY_TERMS) -> float:
    """Of texts that the model leaves alone, the share (over texts and terms) that one neutral mention turns toxic."""
    sets = [set(WORDS.findall((text or "").lower())) for text in texts]
    clean = [words for words in sets if model.logit(words) < 0.0]
    flagged = sum(model.logit(words | {term}) >= 0.0 for words in clean for group in terms for term in group)
    return flagged / max(1, len(clean) * sum(map(len, terms)))


def evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The log likelihood ratio statistic of a feature's occurrence against the label."""
    both, rows = toxic + clean, all_toxic + all_clean
    cells = [
        (toxic, both * all_toxic / rows), (clean, both * all_clean / rows),
        (all_toxic - toxic, (rows - both) * all_toxic / rows), (all_clean - clean, (rows - both) * all_clean / rows),
    ]
    return 2.0 * sum(seen * log(seen / due) for seen, due in cells if seen)


def train(
    texts: list[str],
    labels: list[int],
    terms: list[list[str]] = IDENTITY_TERMS,
    penalty: float = 1.0,
    least_evidence: float = 15.1,
    rounds: int = 20,
    seed: int = 11,
) -> ToxicityModel:
    """Sparse logistic regression with counterfactual pairs.

    Features whose occurrence tells less about the label than ``least_evidence``
    (15.1 is the chi-square quantile 0.9999 of one degree of freedom) get no
    weight, so a text's many rare words cannot be learned by heart. Beside the log
    loss of the labelled texts, every pair of a sentence and its counterfactual form
    adds ``penalty / 2 * (difference of their logits)**2``, which moves weight away
    from the terms that were swapped or put in, and from the beginnings that they share
    with other words.
    """
    held = [text_features(set(WORDS.findall((text or "").lower()))) for text in texts]
    toxic = Counter(f for features, label in zip(held, labels, strict=True) if label for f in features)
    clean = Counter(f for features, label in zip(held, labels, strict=True) if not label for f in features)
    all_toxic, all_clean = sum(labels), len(labels) - sum(labels)
    telling = (f for f in sorted(toxic.keys() | clean.keys()) if evidence(toxic[f], clean[f], all_toxic, all_clean) >= least_evidence)
    index = {f: k for k, f in enumerate(telling)}
    at = lambda features: np.asarray(sorted(index[f] for f in features if f in index), dtype=np.int64)
    rows = [at(features) for features in held]
    exchange = swaps(terms)
    pairs, met = [], 0
    for k, text in enumerate(texts):
        for words, other in counterfactuals(text or "", terms, exchange, k):
            met += 1
            gone, new = text_features(words - other) & index.keys(), text_features(other - words) & index.keys()
            if not gone and not new:
                continue  # neither form has a feature of its own that could hold weight
            shared = text_features(words & other)
            plus, minus = at(gone - new - shared), at(new - gone - shared)
            pairs.append((np.concatenate([plus, minus]), np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])))
    bias = len(index)
    learner = FollowTheRegularisedLeader(bias + 1, 1, alpha=1.0, l1=0.2, l2=0.05)
    draw = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        for k in draw.permutation(len(rows) + len(pairs)):
            if k < len(rows):
                where = np.append(rows[k], bias)
                values, weights = np.ones(len(where)), learner.weights(where)
                error = 1.0 / (1.0 + np.exp(-np.clip(weights.sum(), -500, 500))) - labels[k]
            else:
                where, values = pairs[k - len(rows)]
                weights = learner.weights(where)
                error = penalty * float(values @ weights[:, 0])
            if error:
                learner.update(where, weights, (values * error)[:, None])
    weights = learner.weights()[:, 0]
    return ToxicityModel({f: float(weights[i]) for f, i in index.items() if weights[i]}, float(weights[bias]), met)


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, penalty: float = 1.0) -> ToxicityModel:
    """A model of labelled rows: (doc_id, text) and (doc_id, toxic).

    At most ``per_class`` labels of each class, those of least hash, are drawn
    before the texts are touched. That bounds both the broadcast that finds their
    texts and the one task that fits the weights.
    """
    order = F.xxhash64(F.lit("toxicity sample"), "doc_id")
    drawn = [
        labels.filter(F.col("toxic") == value).select("doc_id", "toxic").distinct().orderBy(order, "doc_id").limit(per_class)
        for value in (0, 1)
    ]

    def fit(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        model = train(sample.column("text").to_pylist(), sample.column("toxic").to_pylist(), penalty=penalty)
        features = sorted(model.weights)
        weights = [*(model.weights[f] for f in features), model.intercept, float(model.pairs)]
        return pa.table({"feature": pa.array([*features, "", None]), "weight": pa.array(weights)})

    bounded_batches(docs.sparkSession)
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    fitted = (
        sample.select("doc_id", "toxic", "text", F.lit(0).alias("_all"))
        .groupBy("_all")
        .applyInArrow(fit, "feature string, weight double")
        .collect()  # the features of the sample that carry weight
    )
    weights = {row["feature"]: row["weight"] for row in fitted}
    intercept, pairs = weights.pop("", -1.0), int(weights.pop(None, 0))
    return ToxicityModel(weights, intercept, pairs)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, per_class: int = 3000, penalty: float = 1.0
) -> DataFrame:
    """Score every whole text of ``docs``.

    Only labels outside the held-out fold are learned from; scores see the text
    alone. Null, empty and wordless texts get the intercept's score; null labels
    are not learned from; without any label every score is that of logit -1. Equal
    texts get equal scores; no rows give no rows.
    """
    learned = labels.filter((remainder(F.col("doc_id"), folds) != held_out_fold) & F.col("toxic").isin(0, 1))
    model = learn_toxicity(docs, learned, per_class, penalty)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "text"
    ).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
