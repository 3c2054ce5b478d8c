"""Toxicity: a logistic model whose scores are held still when identity terms are swapped."""

from __future__ import annotations

import base64
import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import words as W
from fieldglass.llm.shared import renamed, written

#: Features are hashes of words, and of their first 4 and 5 bytes, modulo 2 ** FEATURE_BITS.
FEATURE_BITS = 20
PREFIXES = (4, 5)
#: Features that the model keeps: those that occur in LEAST_TOXIC toxic texts or more, at LEAST_LIFT times the rate in
#: clean texts or more, with a chi-square of LEAST_CHI or more; the MOST_FEATURES with the greatest chi-square.
LEAST_TOXIC, LEAST_LIFT, LEAST_CHI, MOST_FEATURES = 4, 3.0, 25.0, 4096
#: Texts of each label that the weights are fitted on, at most; what features are kept is counted over all labelled texts.
FIT_TEXTS = 10_000
#: Weight of the squares of score changes under swaps, and of the weights themselves.
SWAP_PENALTY, RIDGE = 10.0, 2e-5
PREDICT_FROM = 0.7

#: Terms that name groups of people, in lists within which they may be swapped. Fixed values.
IDENTITY_TERMS = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("american", "chinese", "mexican", "german", "french", "spanish", "turkish", "polish"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("männer", "frauen", "jungen", "mädchen"),
    ("christen", "muslime", "juden", "katholiken"),
    ("hommes", "femmes", "garçons", "filles"),
    ("chrétiens", "musulmans", "juifs", "catholiques"),
    ("hombres", "mujeres", "chicos", "chicas"),
    ("cristianos", "musulmanes", "judíos", "católicos"),
)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words (runs of letters and bytes above 127, lower-cased within Latin-1): features (word, kind), 64-bit hashes, row of each."""
    lower = W.LOWER[data]
    if len(lower):
        accent = np.zeros(len(lower), bool)
        accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower = np.where(accent, lower + 32, lower)
    kept = _LETTER[data]
    starts, lengths, row = W.spans(kept, at)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    terms = (lower[kept].astype(np.uint64) + np.uint64(1)) * W.powers(int(lengths.max()))[place]
    whole = W.mix(np.add.reduceat(terms, begin) + np.uint64(0x51))
    codes = [whole]
    for k in PREFIXES:
        head = W.mix(np.add.reduceat(np.where(place < k, terms, np.uint64(0)), begin) + np.uint64(0x1000 + k))
        codes.append(np.where(lengths > k, head, whole))
    features = np.stack([(c >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for c in codes], axis=1)
    return features, whole, np.repeat(np.arange(len(at) - 1), np.diff(row))


def _features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, at = W.texts(pa.array(words))
    features, whole, _ = word_features(data, at)
    return features, whole


@lru_cache(maxsize=1)
def _swaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identity terms by hash: hashes in order, their features, and the features of the next term of the list."""
    here, there = [x for terms in IDENTITY_TERMS for x in terms], [x for terms in IDENTITY_TERMS for x in (*terms[1:], terms[0])]
    features, whole = _features_of(here)
    order = np.argsort(whole)
    return whole[order], features[order], _features_of(there)[0][order]


def identity_features() -> np.ndarray:
    return np.unique(_swaps()[1])


def text_features(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct features (those in the sorted array wanted), and those after its identity terms were swapped."""
    keep = np.ones(1 << FEATURE_BITS, bool)
    if wanted is not None:
        keep[:] = False
        keep[wanted] = True
    terms, own, other = _swaps()
    data, at = W.texts(column)
    for i, j in W.chunks(at):
        features, whole, row = word_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
        place = np.minimum(np.searchsorted(terms, whole), len(terms) - 1)
        hit = np.flatnonzero(terms[place] == whole)
        swapped = features
        if len(hit):
            swapped = features.copy()
            swapped[hit] = other[place[hit]]
        found = []
        for table in (features, swapped) if len(hit) else (features,):
            some = keep[table]
            pairs = np.unique(np.repeat(row, table.shape[1])[some.ravel()] << FEATURE_BITS | table[some])
            ends = np.searchsorted(pairs >> FEATURE_BITS, np.arange(j - i + 1))
            flat = (pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
            found.append([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        yield from zip(found[0], found[-1], strict=True)


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(text, label) -> feature, toxic, n: in how many texts of either label each feature occurs. Feature -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for (own, _), label in zip(text_features(batch.column(0)), labels, strict=True):
                counts[label, own] += 1
                texts[label] += 1
        for label in (0, 1):
            used = np.flatnonzero(counts[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.full(len(used) + 1, label, np.int32)),
                pa.array(np.append(counts[label, used], texts[label]))], ["feature", "toxic", "n"]
            )

    return labelled.select("text", "label").mapInArrow(run, "feature int, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n")
    )


def chosen_features(counts: DataFrame) -> np.ndarray:
    """The features that tell toxic texts, and those of identity terms; at most MOST_FEATURES of the first reach the driver."""
    texts = counts.filter("feature = -1").first()
    if not texts or not texts["toxic"] or texts["toxic"] == texts["n"]:
        return identity_features()
    share = texts["toxic"] / texts["n"]
    expected = F.col("n") * share
    # Rates in the texts of either label, with half a text added, so that the least lift can be met at any share of toxic texts.
    rate = lambda of, among: (of + 0.5) / (among + 1.0)
    lift = rate(F.col("toxic"), texts["toxic"]) / rate(F.col("n") - F.col("toxic"), texts["n"] - texts["toxic"])
    chi = (F.col("toxic") - expected) ** 2 / (expected * (1 - share))
    picked = (
        counts.filter("feature >= 0").filter((F.col("toxic") >= LEAST_TOXIC) & (lift >= LEAST_LIFT)).withColumn("chi", chi)
        .filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(MOST_FEATURES).select("feature").collect()
    )
    return np.unique(np.concatenate([identity_features(), np.array([r["feature"] for r in picked], np.int32)]))


@dataclass(frozen=True)
class Weights:
    """Sorted features, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def dump(self) -> str:
        return json.dumps([base64.b64encode(x.tobytes()).decode() for x in (self.features.astype("<i4"), self.weights.astype("<f8"))] + [self.bias])

    @classmethod
    def of(cls, text: str) -> Weights:
        features, weights, bias = json.loads(text)
        return cls(np.frombuffer(base64.b64decode(features), "<i4"), np.frombuffer(base64.b64decode(weights), "<f8"), bias)

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[np.searchsorted(self.features, own)].sum(), -30, 30))))


def fit_weights(features: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 400) -> Weights:
    """rows (features, features after a swap, label): logistic loss of the texts, either label having half the weight, plus SWAP_PENALTY times the mean square of
    the changes of the linear score under swaps, plus RIDGE / 2 times the squares of the weights; by Adam steps over all rows.

    With labels of one kind only there is nothing to learn: all scores are the share of toxic labels, 0.5 at most, and no
    text is predicted to be toxic."""
    n, size = len(rows), len(features)
    labels = np.array([r[2] for r in rows], float)
    if not n or labels.min() == labels.max():
        warnings.warn("labels of one kind only: nothing to learn, so no text is predicted to be toxic", stacklevel=2)
        share = labels.mean() if n else 0.0
        return Weights(features, np.zeros(size), min(0.0, float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))))
    flat = lambda k: (np.repeat(np.arange(n), [len(r[k]) for r in rows]),
        np.searchsorted(features, np.concatenate([np.zeros(0, np.int32), *(r[k] for r in rows)])))
    (row, col), (row_s, col_s) = flat(0), flat(1)
    times = lambda w, r, c: np.bincount(r, w[c], minlength=n)
    back = lambda g, r, c: np.bincount(c, g[r], minlength=size)
    mass = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    swapped = np.array([not np.array_equal(r[0], r[1]) for r in rows])
    w, b, wv, bv = np.zeros(size), 0.0, np.zeros(size), 0.0
    mean_sq_w, mean_sq_b = np.zeros(size), 0.0
    for k in range(1, rounds + 1):
        z = times(w, row, col) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = (p - labels) * mass
        change = np.where(swapped, times(w, row, col) - times(w, row_s, col_s), 0.0) * (2 * SWAP_PENALTY / n)
        gw, gb = back(err + change, row, col) - back(change, row_s, col_s) + RIDGE * w, err.sum()
        wv, bv = 0.9 * wv + 0.1 * gw, 0.9 * bv + 0.1 * gb
        mean_sq_w, mean_sq_b = 0.99 * mean_sq_w + 0.01 * gw * gw, 0.99 * mean_sq_b + 0.01 * gb * gb
        fix = 1 - 0.9**k, 1 - 0.99**k
        w = w - 0.05 * (wv / fix[0]) / (np.sqrt(mean_sq_w / fix[1]) + 1e-8)
        b = b - 0.05 * (bv / fix[0]) / (np.sqrt(mean_sq_b / fix[1]) + 1e-8)
    return Weights(features, w, float(b))


def fit(labelled: DataFrame) -> Weights:
    """labelled: text, label (0 or 1). All rows are counted to choose features; about FIT_TEXTS of each label, those with
    the least hashes of the text, are fitted on."""
    features = chosen_features(written(feature_counts(labelled), "counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            pairs = list(text_features(batch.column(0), features))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in pairs], kind), pa.array([x[1] for x in pairs], kind), batch.column(1), batch.column(2)],
                ["own", "swapped", "label", "h"]
            )

    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    hashed = labelled.select("text", "label", (F.shiftrightunsigned(F.xxhash64("text"), 12) / F.lit(float(1 << 52))).alias("h"))
    rows = []
    for label, n in sorted(sizes.items()):
        some = hashed.filter((F.col("label") == label) & (F.col("h") <= 1.2 * FIT_TEXTS / n))
        taken = some.mapInArrow(run, "own array<int>, swapped array<int>, label int, h double").orderBy("h", "own").limit(FIT_TEXTS).collect()
        rows += [(np.array(r["own"], np.int32), np.array(r["swapped"], np.int32), label) for r in taken]
    return fit_weights(features, rows)


def score_texts(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every input row: doc_id, score, predicted. Null and empty texts have the score of no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([weights.score(own) for own, _ in text_features(batch.column(1), weights.features)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= PREDICT_FROM).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text is `part` modulo `parts`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts)) == part


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic") -> Weights:
    """Weights from the labelled rows that aren't held out. Null ids, texts and labels teach nothing."""
    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col)).filter(~held_out(parts, part) & F.col("text").isNotNull())
    known = renamed(labels, doc_id=F.col(id_col).cast("long"), label=(F.col(label_col) > 0).cast("int")).filter("label is not null")
    # Merged on ids at every size: labels grow with the documents, so a plan that broadcasts them now wouldn't later.
    return fit(written(rows.join(known.hint("merge"), "doc_id").select("text", "label"), "labelled"))


def learn_and_score(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """learn(), then one row for every row of docs: doc_id, held_out, score, predicted.

    Ids may be null or repeated, and other columns of either table are ignored. Without labelled rows of both kinds all
    scores are the same, 0.5 at most, so no text is rejected. An empty table gives an empty result.
    """
    scored = score_texts(docs, learn(docs, labels, parts, part, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col))
            clean = [weights.score(own) < PREDICT_FROM for own, _ in text_features(text, weights.features)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, schema)
