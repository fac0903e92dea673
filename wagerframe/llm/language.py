"""Language identification from TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.llm.ftrl import FollowTheRegularisedLeader
from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches

BITS = 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often the character n-grams of the lower-cased text fall into each of 2**BITS cells."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    hashed = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        hashed = hashed[: len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1 :] + np.uint64(order)
        if order in ORDERS:
            cell = (hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            counts += np.bincount(cell.view(np.int64), minlength=1 << BITS)
    return counts


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of the normalised TF-IDF vector."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm > 0 else values


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm.

    It is at least exp(-1.5), as rows without any error would ask for none at all.
    """
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(classes)), classes]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = -1.5, 4.0, (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many rows of ``docs`` each cell occurs; ``2**BITS`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += gram_counts(text) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    bounded_batches(docs.sparkSession)
    out = np.zeros(1 << BITS, dtype=np.int64)
    sums = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        out[row["cell"]] = row["n"]
    return out


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, text: str) -> np.ndarray:
        at, values = features(text, self.idf)
        return values @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def train(texts: list[str], labels: list[str], idf: np.ndarray, rounds: int = 4, calibration: float = 0.2, seed: int = 7) -> LanguageModel:
    """Multinomial logistic regression on part of the rows; the temperature is set on the rest.

    The rest is drawn within each language, and at least one row of each is left to fit.
    """
    languages = sorted(set(labels))
    classes = np.asarray([languages.index(x) for x in labels], dtype=np.int64)
    rows = [features(text, idf) for text in texts]
    draw = np.random.Generator(np.random.PCG64(seed))
    order = draw.permutation(len(rows))
    apart = np.zeros(len(rows), dtype=bool)
    if len(rows) >= 10 * len(languages):
        for c in range(len(languages)):
            own = order[classes[order] == c]
            apart[own[: min(int(len(own) * calibration), len(own) - 1)]] = True
    held, fit = order[apart[order]], order[~apart[order]]
    bias = 1 << BITS
    learner = FollowTheRegularisedLeader(bias + 1, len(languages), alpha=0.5, l1=0.05, l2=0.01)
    for _ in range(rounds):
        for k in draw.permutation(fit):
            at, values = rows[k]
            at, values = np.append(at, bias), np.append(values, 1.0)
            weights = learner.weights(at)
            error = softmax(values @ weights)
            error[classes[k]] -= 1.0
            learner.update(at, weights, values[:, None] * error)
    model = LanguageModel(languages, idf, learner.weights(), 1.0)
    if len(held):
        logits = np.stack([rows[k][1] @ model.weights[rows[k][0]] + model.weights[-1] for k in held])
        model.temperature = best_temperature(logits, classes[held])
    return model


def learn_languages(rows: DataFrame, per_language: int = 400, most_languages: int = 1000) -> LanguageModel:
    """A model of the rows (doc_id, text, lang), all with a language and a letter.

    Document frequencies cover all rows. Weights are fitted to a sample of about
    ``per_language`` rows of each language, drawn by a hash of the id, in one task.
    More than ``most_languages`` languages are an error, as each costs a column of weights.
    """
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return LanguageModel([], np.zeros(1 << BITS), np.zeros(((1 << BITS) + 1, 0)), 1.0)
    total = sum(row["n"] for row in counts)
    idf = np.log((1.0 + total) / (1.0 + document_frequencies(rows))) + 1.0
    rate = F.lit(0.0)
    for row in counts:
        rate = F.when(F.col("lang") == row["lang"], min(1.0, per_language / row["n"])).otherwise(rate)
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20) < rate

    def fit(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        model = train(sample.column("text").to_pylist(), sample.column("lang").to_pylist(), idf)
        return pa.table(
            {
                "languages": pa.array([model.languages], pa.list_(pa.string())),
                "weights": pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
                "temperature": pa.array([model.temperature]),
            }
        )

    bounded_batches(rows.sparkSession)
    fitted = (
        rows.filter(drawn)
        .select("doc_id", "lang", "text", F.lit(0).alias("_all"))
        .groupBy("_all")
        .applyInArrow(fit, "languages array<string>, weights binary, temperature double")
        .collect()
    )
    if not fitted:
        return LanguageModel([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    row = fitted[0]
    weights = np.frombuffer(bytes(row["weights"]), dtype="<f4").reshape((1 << BITS) + 1, -1).astype(np.float64)
    return LanguageModel(list(row["languages"]), idf, weights, row["temperature"])


def identify_languages(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, per_language: int = 400) -> DataFrame:
    """Predict the language of every whole text of ``docs``.

    Only rows outside the held-out fold, with a language and a letter in their
    text, are learned from. Predictions see the text alone. Null texts and texts
    without a letter are ``und`` with score 0, as is every row where there was
    nothing to learn from; equal texts get equal predictions, so repeated rows do, and
    languages that tie go to the first by name; a very long text counts whole; other
    columns are not read; no rows give no rows.
    """
    held_out = remainder(F.col("doc_id"), folds) == held_out_fold
    learnable = ~held_out & F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}"))
    model = learn_languages(docs.filter(learnable).select("doc_id", "text", "lang"), per_language)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double"
    )


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"))
