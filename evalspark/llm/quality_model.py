"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its words hashed into ``BUCKETS`` (damped counts, unit
length), statistics of its structure, and its declared length where there is one. The
machine adds pairwise interactions of all features through factors of rank ``RANK`` and is
scored in linear time: half the sum over factors of (sum of v x) squared minus the sum of
(v x) squared. Scores are logistic, so they lie between 0 and 1.

Training reads a bounded sample: at most ``TRAIN_ROWS`` labelled documents outside the
held-out fold, those with the smallest hash of their id. Only this sample reaches the
driver, as feature vectors. Label, language, source and id are never features. Scoring is
one pass over all documents without a shuffle.

Cases: a null text is empty and is scored from its statistics; labels that are null are
ignored, of several labels of an id the lowest counts; without both classes in the sample
every score is 0.5; equal texts with equal metadata get equal scores; an empty table gives
no rows; a null id is never held out; other columns are passed on as asked, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evalspark.llm import arrays as A

BUCKETS = 1 << 16
RANK = 8
#: Labelled documents used for training, at most.
TRAIN_ROWS = 8_000
#: Passes over the sample; a small sample is passed over until it has made ``LEAST_STEPS`` steps.
EPOCHS = 6
LEAST_STEPS = 150
BATCH = 256
LEARNING_RATE = 0.05
DECAY = 1e-5
SEED = 7

STATISTICS = ["bias_length", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "symbols", "exclaims", "bars", "non_ascii",
              "distinct", "repeat_3", "top_word", "line_length", "short_lines", "stops", "declared", "no_declared"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>=~^_@{}[]\\/"]] = True
_CLASSES = {"upper": [*range(0x41, 0x5B)], "digits": [*range(0x30, 0x3A)], "marks": [ord(c) for c in ".,;:?'\"()-"],
            "exclaims": [ord("!")], "bars": [ord("|")], "non_ascii": [*range(0x80, 0x100)], "stops": [ord(c) for c in ".?!"]}


def _table(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


_TABLES = {name: _table(values) for name, values in _CLASSES.items()} | {"symbols": _SYMBOLS}


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(values)])
    return (running[offsets[1:]] - running[offsets[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature number and value of every nonzero feature, by row."""
    n = len(offsets) - 1
    starts, ends, rows = A.word_bounds(data, offsets, A.NOT_BLANK)
    hashes = A.word_hashes(data, starts, ends, lower=True)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    words = np.bincount(rows, minlength=n).astype(np.float64)
    full = np.maximum(words, 1)

    slots = (hashes >> np.uint64(48)).astype(np.int64)
    keys, counts = np.unique(rows * BUCKETS + slots, return_counts=True)
    word_row, bucket = keys // BUCKETS, keys % BUCKETS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(word_row, value * value, n))
    value = value / np.maximum(norm, 1e-9)[word_row]

    distinct = np.bincount(word_row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, word_row, counts)
    repeated = np.zeros(n)
    if len(hashes) > 2:
        places = np.flatnonzero(rows[:-2] == rows[2:])
        grams = A.ngram_hashes(hashes, 3)[places]
        order = np.lexsort((grams, rows[places]))
        again = (np.diff(grams[order]) == 0) & (np.diff(rows[places][order]) == 0)
        repeated = np.bincount(rows[places][order][1:][again], minlength=n).astype(np.float64)
    lengths = ends - starts
    lines = _row_sums(data == 0x0A, offsets) + 1
    share = {name: _row_sums(table[data], offsets) / size for name, table in _TABLES.items()}
    known = np.isfinite(declared)
    stats = {
        "bias_length": np.log1p(size) / 10, "log_words": np.log1p(words) / 8, "mean_word": np.minimum(size / full / 10, 3),
        "long_words": np.bincount(rows, lengths > 20, n) / full, "distinct": distinct / full, "repeat_3": repeated / full,
        "top_word": top / full, "line_length": np.log1p(size / lines) / 8, "short_lines": lines / full,
        "declared": np.where(known, np.log1p(np.maximum(np.nan_to_num(declared), 0)) / 10, 0), "no_declared": (~known).astype(np.float64),
        "upper": share["upper"] * 2, "digits": share["digits"] * 4, "marks": share["marks"] * 4, "symbols": share["symbols"] * 8,
        "exclaims": share["exclaims"] * 8, "bars": share["bars"] * 8, "non_ascii": share["non_ascii"] * 2, "stops": share["stops"] * 8}
    dense = np.stack([stats[name] for name in STATISTICS], 1)
    stat_row, stat = np.nonzero(dense)
    row = np.concatenate([word_row, stat_row])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([bucket, BUCKETS + stat])[order], np.concatenate([value, dense[stat_row, stat]])[order].astype(np.float32)


def _row_totals(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of a matrix by a sorted row number."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(row):
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[begin]] = np.add.reduceat(values, begin, axis=0)
    return out


@dataclass
class Machine:
    """Bias, weights and factors of all features."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def empty() -> Machine:
        size = BUCKETS + len(STATISTICS)
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))

    def margins(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins of ``n`` rows and their factor sums, in time linear in the nonzeros."""
        scaled = self.factors[feature] * value[:, None]
        terms = np.concatenate([scaled, (scaled * scaled).sum(1, keepdims=True), (self.weights[feature] * value)[:, None]], 1)
        totals = _row_totals(terms, row, n)
        sums = totals[:, :RANK]
        return self.bias + totals[:, RANK + 1] + 0.5 * ((sums * sums).sum(1) - totals[:, RANK]), sums

    def scores(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        margin = self.margins(row, feature, value, n)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad in shuffled batches; ``row`` is sorted."""
    n = len(labels)
    machine = Machine.empty()
    if n == 0 or labels.min() == labels.max():
        return machine
    rng = np.random.default_rng(SEED)
    machine.factors = rng.normal(0, 0.05, machine.factors.shape).astype(np.float32)
    machine.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    weight_sq, factor_sq = np.full(machine.weights.shape, 1e-6, np.float32), np.full(machine.factors.shape, 1e-6, np.float32)
    begin = np.searchsorted(row, np.arange(n + 1, dtype=row.dtype))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-n // BATCH)))):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            chosen = order[at:at + BATCH]
            sizes = begin[chosen + 1] - begin[chosen]
            ends = np.cumsum(sizes)
            take = np.repeat(begin[chosen] - (ends - sizes), sizes) + np.arange(ends[-1])
            r, f, x = np.repeat(np.arange(len(chosen)), sizes), feature[take], value[take]
            margin, sums = machine.margins(r, f, x, len(chosen))
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[chosen]) / len(chosen)
            machine.bias -= LEARNING_RATE * float(error.sum())
            scaled = (error[r] * x).astype(np.float32)
            by_factor = scaled[:, None] * (sums[r] - machine.factors[f] * x[:, None])
            touch = np.argsort(f, kind="stable")
            used, inverse = np.unique(f, return_inverse=True)
            totals = _row_totals(np.concatenate([by_factor, scaled[:, None]], 1)[touch], inverse[touch], len(used))
            step_v = totals[:, :RANK] + DECAY * machine.factors[used]
            step_w = totals[:, RANK] + DECAY * machine.weights[used]
            factor_sq[used] += step_v * step_v
            weight_sq[used] += step_w * step_w
            machine.factors[used] -= LEARNING_RATE * step_v / np.sqrt(factor_sq[used])
            machine.weights[used] -= LEARNING_RATE * step_w / np.sqrt(weight_sq[used])
    return machine


def _declared(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        declared = _declared(batch.column("_declared"))
        for first, data, offsets in A.pieces(batch.column("_text")):
            n = len(offsets) - 1
            row, feature, value = features(data, offsets, declared[first:first + n])
            at = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(first, n), pa.ListArray.from_arrays(at, pa.array(feature, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], ["label", "feature", "value"])


def held_out(doc_id, folds: int = 5):
    """Whether a document is in the fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _inputs(df: DataFrame, *more: str) -> DataFrame:
    declared = F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")
    return df.select(F.col("text").alias("_text"), declared.alias("_declared"), *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(more)])


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit the machine on a bounded sample of the labelled documents outside the held-out fold."""
    known = (labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the limit bounds what is broadcast; a second one holds if an id stands on many rows
    rows_of = _inputs(documents, "doc_id").join(F.broadcast(sample), F.col("_kept_0") == F.col("doc_id")).select("_text", "_declared", "label").limit(rows)
    found = rows_of.mapInArrow(_vectors, "label double, feature array<int>, value array<float>").toArrow()
    if found.num_rows == 0:
        return Machine.empty()
    # the driver holds the sample once more, in four bytes a number, and gives the received one back before it fits
    sizes = pc.list_value_length(found.column("feature")).to_numpy()
    label = found.column("label").to_numpy().astype(np.float64)
    feature, value = (np.concatenate([c.flatten().to_numpy() for c in found.column(name).chunks]) for name in ("feature", "value"))
    del found
    pa.default_memory_pool().release_unused()
    return fit(np.repeat(np.arange(len(label), dtype=np.int32), sizes), feature, value, label)


def _scorer(machine: Machine, keep: list[str], name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        declared = _declared(batch.column("_declared"))
        scores = [machine.scores(*features(data, offsets, declared[first:first + len(offsets) - 1]), len(offsets) - 1)
                  for first, data, offsets in A.pieces(batch.column("_text"))]
        made = pa.array(np.concatenate(scores) if scores else np.zeros(0))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], made], [*keep, name])


def score(documents: DataFrame, machine: Machine, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of every document and its score under ``name``; a kept column of that name gives way."""
    keep = [c for c in keep if c != name]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    # a few megabytes, whatever the corpus
    shared = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))
    return _inputs(documents, *keep).mapInArrow(lambda b: _scorer(Machine(*shared.value), keep, name, b), f"{kinds}, `{name}` double")
