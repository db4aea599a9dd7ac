"""Toxicity by compression distance: how much shorter a window gets when toxic text is in the zstandard dictionary.

Separate dictionaries are trained on windows of ordinary and of toxic documents. A window (a few whole words, about ``WINDOW``
bytes) is compressed with the ordinary dictionary alone and with the ordinary followed by a toxic one; the difference
of the lengths, averaged over ``DICTIONARIES`` toxic ones, is its excess. Ordinary text finds its matches in either case; toxic expressions
are only short where the toxic dictionary has them. (A toxic dictionary that isn't put after the ordinary one has to hold
ordinary text as well, and parts the classes much worse.)

Most of a toxic document is ordinary, so its windows are refined in rounds: those with the highest excess train the next
toxic dictionary, and the round whose dictionary parts the classes best is taken. Windows that occur more than once in the
sample are left out, since copies of a document would otherwise fill the dictionary. Thresholds are calibrated on other labelled documents than those of the dictionaries: a logistic
function of statistics of a document's excesses.

The sample of labelled rows is bounded by ``TOXIC_DOCS``, ``ORDINARY_DOCS`` and ``CALIBRATION_DOCS`` (those with the smallest hashes of
their ids), by ``SAMPLE_BYTES`` for each of the three, and by ``DOC_BYTES`` for one text; all windows of their whole texts
train, and every document is scored on its whole text. The sample stays in the shared folder: one task trains the dictionaries on
it, tasks take the statistics that calibrate, and the driver gets sizes, dictionaries (under a megabyte) and statistics, no text.

Defined cases: a null text is an empty one, and a text without words scores 0; labels that are null or contradict each
other count as toxic if any says so; of texts that share a key the least is in the sample; without labels of both
classes every score is 0; equal texts score equally; a null key is held out of nothing and of no label. Only key and text
are read, so other columns may have any name. A text is cut into windows whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shingles import slices
from plumbline.llm.storage import materialize

WINDOW = 24
ORDINARY_BYTES, TOXIC_BYTES = 256 << 10, 3 << 10
DICTIONARIES, ROUNDS, MIN_MATCH, LEVEL = 3, 5, 5, 3
TOXIC_DOCS, ORDINARY_DOCS, CALIBRATION_DOCS = 2000, 3000, 2500
#: Bytes of text that each part of the sample may have together, and one text.
SAMPLE_BYTES, DOC_BYTES = 24 << 20, 256 << 10
#: Bytes of text whose windows a task compresses at once, windows it remembers, and those from which a call for many pays.
SLICE_BYTES, MOST_WINDOWS, MANY = 1 << 20, 1 << 20, 256
#: Labelled rows are divided by crc32 of the id, modulo FOLDS: fold 0 is never seen, fold 1 calibrates, the rest train.
FOLDS = 5


def fold(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def windows(text: bytes) -> list[bytes]:
    """Runs of whole words of about ``WINDOW`` bytes, each sharing its last word with the next; longer words are cut."""
    out, current, size = [], [], 0
    for word in text.split():
        while len(word) > WINDOW:
            out.append(b" " + b" ".join([*current, word[:WINDOW]]) + b" ")
            current, size, word = [], 0, word[WINDOW:]
        current.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(current) + b" ")
            current, size = [word], len(word) + 1
    if len(current) > 1 or not out:
        out.append(b" " + b" ".join(current) + b" ")
    return out


class Distance:
    """Excess of windows: compressed length with the ordinary dictionary less that with a toxic one added, averaged over
    the toxic dictionaries."""

    def __init__(self, ordinary: bytes, toxic: list[bytes]) -> None:
        self.plain, *self.both = map(compressor, [ordinary, *(ordinary + t for t in toxic)])

    def excess(self, parts: list[bytes]) -> np.ndarray:
        return self.plain(parts) - sum(c(parts) for c in self.both) / len(self.both)


def compressor(content: bytes):
    """A function that gives the lengths of windows compressed, each alone, against a dictionary of this content."""
    import zstandard as zs

    own = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    params = zs.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=WINDOW, min_match=MIN_MATCH,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    own.precompute_compress(compression_params=params)
    one = zs.ZstdCompressor(dict_data=own, compression_params=params)

    def lengths(parts: list[bytes]) -> np.ndarray:
        done = one.multi_compress_to_buffer(parts) if len(parts) >= MANY and zs.backend == "cext" else map(one.compress, parts)
        return np.fromiter(map(len, done), np.float64, len(parts))

    return lengths


def statistics(excess: np.ndarray) -> list[float]:
    """What the calibration sees of a document: largest, mean of the three largest, shares over 1 and over 3, and mean."""
    top = np.sort(excess)[::-1][:3]
    n = len(excess)
    return [top[0], top.mean(), np.sqrt((excess > 1).sum() / n), np.sqrt((excess > 3).sum() / n), excess.mean(), np.log1p((excess > 3).sum()), np.log(n)]


class Sample:
    """Texts of the sample (``k`` and ``body``), as a table; going through it brings them to the driver, a partition at a time."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def __iter__(self) -> Iterator[bytes]:
        return (bytes(r["body"]) for r in self.rows.select("body").toLocalIterator())


def train_dictionaries(toxic: Sample, ordinary: Sample, seed: int = 0) -> tuple[bytes, list[bytes]]:
    """What ``dictionaries`` makes of the texts in the order of their keys, in one task, which holds the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("k", "ascending")])
        content, own = dictionaries(*(rows.filter(pc.field("toxic") == y).column("body").to_pylist() for y in (True, False)), seed)
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary()), pa.array([own], pa.list_(pa.binary()))], names=["ordinary", "toxic"])

    both = [part.rows.select("k", "body", F.lit(y).alias("toxic")) for part, y in ((toxic, True), (ordinary, False))]
    [got] = both[0].unionByName(both[1]).coalesce(1).mapInArrow(run, "ordinary binary, toxic array<binary>").toArrow().to_pylist()
    return got["ordinary"], got["toxic"]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], seed: int = 0) -> tuple[bytes, list[bytes]]:
    """The content of the ordinary dictionary, and of ``DICTIONARIES`` toxic ones trained in other orders of the samples.

    Which substrings a dictionary takes depends on that order; the mean over several is much steadier than any one.
    """
    order = random.Random(seed)
    toxic_parts, ordinary_parts = [windows(t) for t in toxic], [windows(t) for t in ordinary]
    times = Counter(w for parts in toxic_parts + ordinary_parts for w in set(parts))
    base = list(dict.fromkeys(w for parts in ordinary_parts for w in parts))
    order.shuffle(base)
    content = _trained(ORDINARY_BYTES, base)
    alone = [[w for w in parts if times[w] == 1] for parts in toxic_parts]
    check = [[w for w in parts if times[w] == 1] for parts in ordinary_parts[len(ordinary_parts) // 2 :]]
    compress = compressor(content)
    lengths = [compress(parts) for parts in alone]
    costs = [s / [len(w) for w in parts] if parts else s for s, parts in zip(lengths, alone, strict=True)]
    return content, [_toxic_dictionary(content, alone, check, costs, order) for _ in range(DICTIONARIES)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; samples too few or too uniform to train on are one as they are."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def _toxic_dictionary(content: bytes, alone: list[list[bytes]], check: list[list[bytes]], scores: list[np.ndarray], order: random.Random) -> bytes:
    """Rounds of training on the windows of the highest scores, first their cost, then their excess."""
    least, share, best = -1.0, 6, (-1.0, b"")
    for _ in range(ROUNDS):
        kept = [parts[k] for parts, s in zip(alone, scores, strict=True) for k in np.argsort(-s, kind="stable")[: max(2, len(parts) // share)] if s[k] > least]
        order.shuffle(kept)
        if len(kept) < 10:
            break
        found = _trained(TOXIC_BYTES, kept)
        distance = Distance(content, [found])
        scores = [distance.excess(parts) for parts in alone]
        plain = [distance.excess(parts) for parts in check if parts] or [np.zeros(1)]
        best = max(best, (_separation(scores, plain), found))
        least, share = max(1.0, float(np.percentile(np.concatenate(plain), 99)) - 1e-9), 20
    return best[1]


def _separation(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> float:
    """How often a toxic document has the larger share of windows of some excess than an ordinary one; ties count half."""
    a, b = (np.array([(x > 2).mean() if len(x) else 0.0 for x in rows]) for rows in (toxic, ordinary))
    order = np.sort(b)
    return float((np.searchsorted(order, a, "left") + np.searchsorted(order, a, "right")).mean() / (2 * len(b)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights (intercept last) of a logistic regression by Newton's method."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, deviation, w


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """The model: both dictionaries and the calibration; None without labels of both classes.

    The ids of the sample, which is bounded, are sent to the documents' side; its texts, one a key and bounded in bytes, are
    written to the shared folder and read there by tasks.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).alias("y"))
    rows = rows.withColumn("fold", fold("k")).where("fold <> 0").withColumn("h", F.xxhash64("k"))
    wanted = [("fold > 1 AND y = 1", TOXIC_DOCS), ("fold > 1 AND y = 0", ORDINARY_DOCS), ("fold = 1", CALIBRATION_DOCS)]
    parts = [rows.where(c).orderBy("h", "k").limit(n).select("k", "h", "y", F.lit(i).alias("use")) for i, (c, n) in enumerate(wanted)]
    sample = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    found = texts.where(F.octet_length("body") <= DOC_BYTES).join(sample, "k").groupBy("k", "h", "y", "use").agg(F.min("body").alias("body"))
    found = materialize(found, "toxicity-sample")
    sizes = found.select("use", "h", "y", F.octet_length("body").alias("size")).toArrow().sort_by([("use", "ascending"), ("h", "ascending")]).to_pylist()
    so_far, last = Counter(), {}
    for r in sizes:  # numbers of the bounded sample
        so_far[r["use"]] += r["size"]
        if so_far[r["use"]] <= SAMPLE_BYTES:
            last[r["use"]] = r["h"]
    if len(last) < 3 or len({r["y"] for r in sizes if r["use"] == 2 and r["h"] <= last[2]}) < 2:
        return None
    toxic, ordinary, checked = (Sample(found.where((F.col("use") == use) & (F.col("h") <= last[use]))) for use in range(3))
    content, own = train_dictionaries(toxic, ordinary)
    known = measured(checked, content, own).toArrow().sort_by([("k", "ascending")])
    x, y = (np.array(known.column(c).to_pylist(), np.float64) for c in ("x", "y"))
    return {"ordinary": content, "toxic": own, "calibration": fit_logistic(x, y)}


def measured(sample: Sample, content: bytes, own: list[bytes]) -> DataFrame:
    """``k``, ``y`` and ``x`` (the statistics) of each text."""
    rows = sample.rows.select("k", F.col("y").cast("double").alias("y"), "body")
    shared = rows.sparkSession.sparkContext.broadcast((content, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*shared.value)
        for batch in batches:
            x = [statistics(distance.excess(windows(t))) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["k", "y", "x"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, y double, x array<double>")


def score(docs: DataFrame, model: dict | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score double``: the calibrated probability of label 1, from the whole text alone."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    if model is None:
        return rows.select(key, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under a megabyte, by the sizes above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = Rater(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate(batch.column(1).to_pylist()))], names=[key, "score"])

    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_below(docs: DataFrame, model: dict | None, limit: float, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns; nothing is shuffled."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = Rater(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(rate([(t or "").encode() for t in batch.column(text).to_pylist()]) < limit))

    return docs.mapInArrow(run, docs.schema)


class Rater:
    """Scores of texts, in a task. Windows are remembered while they are few, as lines and texts repeat."""

    def __init__(self, model: dict) -> None:
        self.distance, self.known = Distance(model["ordinary"], model["toxic"]), {}
        self.mean, self.deviation, self.weights = model["calibration"]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        bounds = np.cumsum([0, *map(len, texts)])
        excess = (e for i, j in slices(bounds, SLICE_BYTES) for e in self._excess([windows(t) for t in texts[i:j]]))
        x = np.array([statistics(e) for e in excess]).reshape(-1, len(self.mean))
        logit = (x - self.mean) / self.deviation @ self.weights[:-1] + self.weights[-1]
        worded = np.array([bool(t.strip()) for t in texts], bool)
        return np.where(worded, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0.0)

    def _excess(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The excess of the windows of each text."""
        if len(self.known) > MOST_WINDOWS:
            self.known.clear()
        parts = [w for own in texts for w in own]
        new = [w for w in dict.fromkeys(parts) if w not in self.known]
        self.known.update(zip(new, self.distance.excess(new).tolist(), strict=True))
        values = np.fromiter(map(self.known.__getitem__, parts), np.float64, len(parts))
        return np.split(values, np.cumsum([len(own) for own in texts])[:-1])


def held_out(key: str):
    return F.coalesce(fold(key) == 0, F.lit(False))
