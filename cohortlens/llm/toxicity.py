"""Toxicity scores by a factorization machine over hashed terms: pairs of terms interact through learned factors,
which additive weights can't express."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import RangeHash, byte_class, byte_values, lists, mix, text_slices, word_bounds
from .common import cut, take, text_key

#: Letters of any script as UTF-8 bytes; A-Z are folded when hashed.
LETTERS = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that the machine is fitted on (those with the lowest hash of their id; the
    others stay unused); everything else covers all rows."""

    max_rows: int = 20_000
    buckets: int = 1 << 18
    prefixes: tuple[int, ...] = (4, 5)
    terms: int = 2048
    rows_per_term: int = 8
    positive_weight: float = 4.0
    factors: int = 4
    epochs: int = 30
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum w + sum over pairs <v_i, v_j>) over the distinct known terms of a text.

    ``slot`` maps a hash bucket to its term or -1; its size is fixed by the settings."""

    settings: Settings
    slot: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def text_terms(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hash buckets of terms: lower-cased words of letters, and their prefixes of some lengths in bytes."""
    start, end, row = word_bounds(data, offsets, LETTERS)
    if not len(start):
        return row, start
    ranged = RangeHash(data, byte_values(fold_case=True))
    rows, hashes = [row], [mix(ranged(start, end))]
    for size in settings.prefixes:
        long = end - start >= size
        rows.append(row[long])
        hashes.append(mix(ranged(start[long], start[long] + size) + np.uint64(size)))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(settings.buckets)).astype(np.int64)


def _distinct(rows: np.ndarray, terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows * width + terms)
    return key // width, key % width


def _raw(n: int, rows: np.ndarray, slots: np.ndarray, bias, weight, factor) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid and the factor sums of n texts."""
    k = factor.shape[1]
    v = factor[slots]
    sums = np.stack([np.bincount(rows, weights=v[:, f], minlength=n) for f in range(k)], axis=1) if len(rows) else np.zeros((n, k))
    squares = np.bincount(rows, weights=(v * v).sum(axis=1), minlength=n) if len(rows) else np.zeros(n)
    linear = np.bincount(rows, weights=weight[slots], minlength=n) if len(rows) else np.zeros(n)
    return bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def telling_terms(both: np.ndarray, hit: np.ndarray, n: int, positive: int, settings: Settings) -> np.ndarray:
    """Buckets with the highest chi-square against the label (the lower one on a tie), from the rows and the
    positive rows of each; few rows can't tell many terms apart."""
    expected = both * positive / max(n, 1)
    chi = np.where(both >= min(3, n), (hit - expected) ** 2 / np.maximum(expected * (1 - both / max(n, 1)), 1e-9), 0.0)
    most = min(settings.terms, max(16, n // settings.rows_per_term))
    best = np.lexsort((np.arange(settings.buckets), -chi))[:most]
    return np.sort(best[chi[best] > 0])


def train(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, settings: Settings) -> Machine:
    """Fit a machine to distinct (row, bucket) pairs, sorted by row, and 0/1 labels.

    Only ``telling_terms`` count.  Logistic loss, Adagrad over shuffled batches, L2 decay; the same input gives the same machine.  Without rows, or with
    one label only, the machine is the (smoothed) share of that label."""
    n = len(label)
    share = (label.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    slot = np.full(settings.buckets, -1, np.int32)
    positive = int(label.sum())
    if not len(row) or positive in (0, n):
        return Machine(settings, slot, bias, np.zeros(0), np.zeros((0, settings.factors)))
    both = np.bincount(bucket, minlength=settings.buckets)
    best = telling_terms(both, np.bincount(bucket, weights=label[row], minlength=settings.buckets), n, positive, settings)
    slot[best] = np.arange(len(best))
    known = slot[bucket] >= 0
    row, slots = row[known], slot[bucket[known]]
    first = np.searchsorted(row, np.arange(n + 1))
    random = np.random.default_rng(settings.seed)
    weight = np.zeros(len(best))
    factor = random.normal(0, 0.05, (len(best), settings.factors))
    seen_w, seen_v, seen_b = np.full(len(best), 1e-6), np.full(factor.shape, 1e-6), 1e-6
    for _ in range(settings.epochs):
        order = random.permutation(n)
        for lo in range(0, n, settings.batch):
            docs = order[lo:lo + settings.batch]
            counts = first[docs + 1] - first[docs]
            take_ = np.repeat(first[docs] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            s, r = slots[take_], np.repeat(np.arange(len(docs)), counts)
            raw, sums = _raw(len(docs), r, s, bias, weight, factor)
            error = (sigmoid(raw) - label[docs]) * np.where(label[docs] == 1, settings.positive_weight, 1.0) / len(docs)
            seen_b += error.sum() ** 2
            bias -= settings.rate * error.sum() / np.sqrt(seen_b)
            if not len(s):
                continue
            g = np.bincount(s, weights=error[r], minlength=len(best)) + settings.decay * weight
            seen_w += g * g
            weight -= settings.rate * g / np.sqrt(seen_w)
            each = error[r][:, None] * (sums[r] - factor[s])
            g = np.stack([np.bincount(s, weights=each[:, f], minlength=len(best)) for f in range(settings.factors)], axis=1) + settings.decay * factor
            seen_v += g * g
            factor -= settings.rate * g / np.sqrt(seen_v)
    return Machine(settings, slot, float(bias), weight, factor)


def score_texts(machine: Machine, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not len(machine.weight):
        return np.full(n, sigmoid(np.array(machine.bias)))
    row, bucket = text_terms(data, offsets, machine.settings)
    slots = machine.slot[bucket]
    known = slots >= 0
    row, slots = _distinct(row[known], slots[known].astype(np.int64), len(machine.weight))
    return sigmoid(_raw(n, row, slots, machine.bias, machine.weight, machine.factor)[0])


def sample(labels: DataFrame, settings: Settings, *, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(id, label) of at most ``settings.max_rows`` rows with a label of 0 or 1, those with the lowest hash of the id.

    A share of the hash range that holds half as many more is cut out first, so what is ordered is bounded too."""
    rows = take(labels, id=id_col, label=label_col).where("label IN (0, 1) AND id IS NOT NULL").select("id", F.col("label").cast("int").alias("label"))
    n = rows.count()
    share = min(1.0, (1.5 * settings.max_rows + 1000) / max(n, 1))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    return rows.where(place < int(share * (1 << 32))).orderBy(place, "id", "label").limit(settings.max_rows)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Machine:
    """Fit on a bounded ``sample`` of the labels and the documents of their ids.

    Null labels, null ids and labels of unknown ids are left out; null texts count as empty; an id with more rows
    or labels counts each time.  Where repeated ids join more than ``Settings.max_rows`` rows, equal ones count once, and of
    the different ones about so many, those with the lowest hash, so that the fit stays bounded.  Spark extracts and counts terms; the driver gets counts per hash bucket and, of
    the sampled rows, the telling terms."""
    chosen = sample(labels, settings, id_col=id_col, label_col=label_col)
    # at most max_rows small rows
    rows = take(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")
    if take(docs, id=id_col).join(F.broadcast(chosen), "id").count() > settings.max_rows:
        rows = cut(rows.withColumn("key", text_key(F.col("text"))).groupBy("id", "key", "label").agg(F.first("text").alias("text")))
        share = min(1.0, settings.max_rows / max(rows.count(), 1))
        rows = rows.where(F.pmod(F.xxhash64("id", "key", "label"), F.lit(1 << 32)) < int(share * (1 << 32)))
    rows = rows.select("text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                row, bucket = _distinct(*text_terms(data, offsets, settings), settings.buckets)
                yield pa.RecordBatch.from_arrays(
                    [lists(bucket, np.bincount(row, minlength=hi - lo), pa.int32()), batch.column("label").slice(lo, hi - lo)],
                    names=["terms", "label"])

    found = cut(rows.mapInArrow(work, "terms array<int>, label int"))
    n, positive = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("both"), F.sum("label").alias("hit")).toArrow()
    both, hit = np.zeros(settings.buckets), np.zeros(settings.buckets)
    both[counts["term"].to_numpy()] = counts["both"].to_numpy()
    hit[counts["term"].to_numpy()] = counts["hit"].to_numpy()
    known = np.zeros(settings.buckets, bool)
    known[telling_terms(both, hit, n, positive, settings)] = True
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            flat, sizes = terms.flatten().to_numpy(zero_copy_only=False), np.diff(terms.offsets.to_numpy())
            keep = shared.value[flat]
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            yield pa.RecordBatch.from_arrays([lists(flat[keep], np.bincount(row, minlength=len(sizes)), pa.int32()), batch.column("label")],
                                             names=["terms", "label"])

    got = found.mapInArrow(telling, "terms array<int>, label int").toArrow()
    records = sorted(zip(got["terms"].to_pylist(), got["label"].to_pylist(), strict=True))
    label = np.array([y for _, y in records], float)
    sizes = np.array([len(t) for t, _ in records], np.int64)
    flat = np.array([x for t, _ in records for x in t], np.int64)
    return train(np.repeat(np.arange(len(sizes)), sizes), flat, label, settings)


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` of every whole text, one row per input row; a text without known terms (also an
    empty or null one) scores the machine's bias.  Repeated rows score alike; null ids stay; other columns are not
    read.  ``predicted`` is 1 from a score of 0.5."""
    rows = take(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(score_texts(shared.value, data, offsets))],
                                                 names=["id", "score"])

    scored = rows.mapInArrow(work, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below 0.5; null and empty texts as in
    ``score``.  Rows are judged where they are: no shuffle, no key."""
    names = docs.columns
    at = names.index(text_col)
    placed = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [score_texts(shared.value, data, offsets) < 0.5 for _, _, data, offsets in text_slices(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return placed.mapInArrow(work, placed.schema).toDF(*names)
