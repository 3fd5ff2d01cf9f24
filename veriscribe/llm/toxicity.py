"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are hashed to buckets, embedded, and passed through filters of several widths; the maximum of each
filter over the whole text feeds a logistic output. A word whose bucket few training texts have takes the
vector of its beginning's bucket, and if that is rare too the one of all rare words, so the model cannot
learn single documents by their rare words. It is trained on the driver on a bounded,
documented sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN, those with the smallest hashes of their
ids) and sent to the executors; its size is fixed by the parameters. Scoring is one pass without a shuffle,
over whole texts. As convolution is linear up to the pooling, each tap of a filter is applied to the
embedding table once, and scoring a word is a few look-ups and additions.

A threshold is chosen for each language on a held-back part of the sample, by its F0.5 score, and the logit is
shifted by it, so that a score of 0.5 is the decision everywhere. The language is guessed from function words
of the text itself: neither labels, nor lang, source or doc_id, enter a score.

Null texts count as empty; a text without words scores what an all-padding text scores. Where the labels hold
no row of either class, every score is 0. Repeated labels of an id count once, as toxic if any is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import fold, table
from veriscribe.llm.decontaminate import words_of

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 12
#: Bytes of a word's beginning, whose bucket stands in for that of a rare word.
PREFIX = 4
#: Labelled rows that the model is fitted on, at most; texts that must share a bucket before it gets a vector.
SAMPLE_TOXIC, SAMPLE_CLEAN, LEAST_TEXTS = 3000, 6000, 4
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 2e-2
#: Shares of words and of pooled features that a training step leaves out.
DROP_WORDS, DROP_FEATURES = 0.1, 0.3
FOLDS, SEED = 5, 20
#: Words scored at once, and words with their buckets kept in a worker.
AT_ONCE, CACHE = 1 << 17, 120_000
#: Function words by which a text's language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was on are this by be from not have which",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les des et du un une est que qui dans pour sur pas au par il avec ce",
    "es": "el los las y del una es por con no se lo para su al como más pero sus le",
}
LANGUAGES = [*FUNCTION_WORDS]


_SPOKEN = sorted({w.encode() for words in FUNCTION_WORDS.values() for w in words.split()})
#: For each function word, whether each language has it.
_VOTES = np.array([[w.decode() in words.split() for words in FUNCTION_WORDS.values()] for w in _SPOKEN], np.int64)


class Buckets(dict):
    """Words' buckets (from 1 up; 0 is padding) in the low bits, their beginnings' above; function words have their own."""

    def __init__(self):
        super().__init__((w, BUCKETS + 1 + k) for k, w in enumerate(_SPOKEN))

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = 1 + xxhash.xxh64_intdigest(word, SEED) % BUCKETS
        found += 1 + xxhash.xxh64_intdigest(word[:PREFIX], SEED + 1) % BUCKETS << 20
        if len(self) < CACHE:
            self[word] = found
        return found


def tokens(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, each text with a padding as long as the widest filter after it; where each text begins; its language."""
    pad = np.zeros(max(WIDTHS), np.int64)
    ids, starts, languages, n = [], [], [], 0
    for text in texts:
        words = words_of((text or "").lower())
        own = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
        low = own & 0xFFFFF
        counts = np.bincount(low[low > BUCKETS] - BUCKETS - 1, minlength=len(_SPOKEN)) @ _VOTES
        languages.append(int(counts.argmax()) if counts.any() else len(LANGUAGES))
        ids += [own, pad]
        starts.append(n)
        n += len(own) + len(pad)
    return np.concatenate(ids) if ids else np.empty(0, np.int64), np.array(starts, np.int64), np.array(languages, np.int64)


@dataclass
class Classifier:
    """Rows of the bucket table, taps of each filter on it, and the output layer."""

    rows: np.ndarray  # of each word's bucket, or 1
    begins: np.ndarray  # of each beginning's bucket, or 1
    taps: dict = field(default_factory=dict)  # (width, tap): rows x filters
    bias: dict = field(default_factory=dict)
    out: np.ndarray | None = None
    shift: np.ndarray | None = None  # of the logit, by language
    constant: bool = False

    def look_up(self, ids: np.ndarray) -> np.ndarray:
        found = self.rows[ids & 0xFFFFF]
        rare = np.flatnonzero(found == 1)
        found[rare] = self.begins[ids[rare] >> 20]
        return found

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts as tokens() gives them, any number of words long."""
        pooled = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        ends = np.r_[starts[1:], len(ids)]
        reach = max(WIDTHS) - 1
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + AT_ONCE, "right")))
            for a in range(int(starts[first]), int(ends[last - 1]) - reach, AT_ONCE):
                b = min(a + AT_ONCE, int(ends[last - 1]) - reach)
                rows = self.look_up(ids[a : b + reach])
                over = (ends[first:last, None] - 1 - np.arange(reach)).ravel() - a  # would reach into the next text
                over = over[(over >= 0) & (over < b - a)]
                cuts = starts[first:last] - a if last > first + 1 else np.zeros(1, np.int64)
                for k, w in enumerate(WIDTHS):
                    c = self.taps[w, 0][rows[: b - a]]
                    for t in range(1, w):
                        c = c + self.taps[w, t][rows[t : t + b - a]]
                    c[over] = -np.inf
                    part = pooled[first:last, k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(part, np.maximum.reduceat(c, cuts, axis=0), out=part)
            first = last
        hidden = np.maximum(pooled + np.concatenate([self.bias[w] for w in WIDTHS]), 0)
        return hidden @ self.out[:-1] + self.out[-1]

    def scores(self, texts: list[str | None], buckets: Buckets) -> np.ndarray:
        if self.constant or not texts:
            return np.zeros(len(texts))
        ids, starts, languages = tokens(texts, buckets)
        z = self.logits(ids, starts).astype(np.float64) - self.shift[languages]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str | None], labels: np.ndarray) -> Classifier:
    """Fit the filters on four fifths of the rows and the thresholds on the rest; the rows' order decides which."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Classifier(np.zeros(1, np.int32), np.zeros(1, np.int32), constant=True)
    rng, buckets = np.random.default_rng(SEED), Buckets()
    ids, starts, languages = tokens(texts, buckets)
    lengths = np.diff(np.r_[starts, len(ids)])
    held = np.arange(len(labels)) % 5 == 0
    if labels[held].min() == labels[held].max() or labels[~held].min() == labels[~held].max():
        held = np.zeros(len(labels), bool)
    least = LEAST_TEXTS if (~held).sum() >= 200 else 2
    size = 2  # row 0: padding, 1: all that is rare
    model = Classifier(np.ones(BUCKETS + 1 + len(_SPOKEN), np.int32), np.ones(BUCKETS + 1, np.int32))
    for table_ in (model.rows, model.begins):
        part = ids & 0xFFFFF if table_ is model.rows else np.where(model.rows[ids & 0xFFFFF] == 1, ids >> 20, 0)
        texts_with = np.zeros(len(table_), np.int32)
        for s, n in zip(starts[~held], lengths[~held]):
            texts_with[np.unique(part[s : s + n])] += 1
        kept = np.flatnonzero(texts_with >= least)
        kept = kept[kept > 0]
        table_[kept] = np.arange(size, size + len(kept))
        size += len(kept)
    model.rows[0] = 0
    p = {"e": rng.normal(0, 0.1, (size, DIM)).astype(np.float32)}
    p["e"][0] = 0
    for w in WIDTHS:
        p["w", w] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32)
        p["b", w] = np.zeros(FILTERS, np.float32)
    p["o"] = rng.normal(0, 0.3, FILTERS * len(WIDTHS) + 1).astype(np.float32)
    p["o"][-1] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    words, own = model.look_up(ids), np.flatnonzero(~held)
    weight = np.where(labels > 0, 0.5 / labels[~held].mean(), 0.5 / (1 - labels[~held].mean())).astype(np.float32)
    weight = np.sqrt(weight)
    step = 0
    epochs = EPOCHS if len(own) >= 1000 else 3 * EPOCHS
    for epoch in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), BATCH):
            docs = own[i : i + BATCH]
            at = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in docs])
            x = words[at]
            x = np.where((rng.random(len(x)) < DROP_WORDS) & (x > 0), 1, x)
            cuts = np.r_[0, np.cumsum(lengths[docs])[:-1]]
            hidden, best = [], {}
            for w in WIDTHS:
                taps = [p["e"] @ p["w", w][t] for t in range(w)]
                c = taps[0][x].copy()
                for t in range(1, w):
                    c[: len(x) - t] += taps[t][x[t:]]
                top = np.stack([c[a : a + n - max(WIDTHS) + 1].argmax(axis=0) for a, n in zip(cuts, lengths[docs])]) + cuts[:, None]
                best[w] = top
                hidden.append(c[top, np.arange(FILTERS)] + p["b", w])
            z = np.concatenate(hidden, axis=1)
            keep = (rng.random(z.shape) >= DROP_FEATURES).astype(np.float32) / (1 - DROP_FEATURES)
            h = np.maximum(z, 0) * keep
            y = h @ p["o"][:-1] + p["o"][-1]
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[docs]) * weight[docs] / len(docs)
            grads = {"o": np.r_[h.T @ g, g.sum()].astype(np.float32), "e": np.zeros_like(p["e"])}
            back = (np.outer(g, p["o"][:-1]) * keep * (z > 0)).astype(np.float32)
            at_rows, steps = [], []
            for k, w in enumerate(WIDTHS):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads["b", w] = b.sum(axis=0)
                grads["w", w] = np.zeros_like(p["w", w])
                for t in range(w):
                    seen = x[np.minimum(best[w] + t, len(x) - 1)]
                    grads["w", w][t] = np.einsum("df,dfe->ef", b, p["e"][seen])
                    at_rows.append(seen.ravel())
                    steps.append((b[:, :, None] * p["w", w][t].T[None]).reshape(-1, DIM))
            at_rows, steps = np.concatenate(at_rows), np.concatenate(steps)
            order = np.argsort(at_rows, kind="stable")
            first = np.flatnonzero(np.diff(at_rows[order], prepend=-1))
            grads["e"][at_rows[order][first]] = np.add.reduceat(steps[order], first, axis=0)
            grads["e"][0] = 0
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for key, v in p.items():
                m, s = moments[key]
                d = grads[key]
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + DECAY * v)
    model.out = p["o"].astype(np.float32)
    for w in WIDTHS:
        model.bias[w] = p["b", w]
        for t in range(w):
            model.taps[w, t] = p["e"] @ p["w", w][t]
    model.shift = calibrate(model.logits(ids, starts), labels, languages, held)
    return model


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit midway between neighbours at which F0.5, which counts a false alarm double, is highest."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    score = 1.25 * hits / (np.arange(1, len(z) + 1) + 0.25 * y.sum())
    k = int(np.argmax(score))
    top = z[order[k]]
    return float((top + z[order[k + 1]]) / 2 if k + 1 < len(z) else top - 1)


def calibrate(z: np.ndarray, labels: np.ndarray, languages: np.ndarray, held: np.ndarray, least: int = 15) -> np.ndarray:
    """A threshold for each language, and for texts of none; the common one where the held-back rows of a class are few."""
    use = held if held.any() else np.ones(len(z), bool)
    common = best_threshold(z[use], labels[use])
    out = np.full(len(LANGUAGES) + 1, common)
    for k in range(len(LANGUAGES)):
        own = use & (languages == k)
        if labels[own].sum() >= least and (1 - labels[own]).sum() >= least:
            out[k] = best_threshold(z[own], labels[own])
    return out


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str | None], np.ndarray]:
    """The texts and labels that the model is fitted on, in the order of the hashes of their ids."""
    known = labels.where(fold(F.col("doc_id"), FOLDS) != 0).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    parts = [known.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(n) for t, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = parts[0].unionByName(parts[1])
    most = SAMPLE_TOXIC + SAMPLE_CLEAN  # rows in chosen, at most: small enough to broadcast
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").orderBy("h", "doc_id", "text").limit(most)
    found = rows.select("text", "toxic").toArrow()
    return found.column("text").to_pylist(), np.array(found.column("toxic").to_pylist(), np.float32)


def with_score(docs: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """docs and their score, in a column of the given name."""
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                scores = pa.array(sent.value.scores(batch.column(at).to_pylist(), buckets), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, column])

    return docs.mapInArrow(run, type(docs.schema)([*docs.schema.fields]).add(column, "double"))


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier:
    return train(*sample(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
