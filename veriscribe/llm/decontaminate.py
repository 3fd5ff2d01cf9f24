"""Benchmark decontamination with an FM-index for each shard of the training documents.

A shard is some megabytes of whole documents in one task. Its words become symbols: one for each
word that a benchmark has, and a separator for runs of others. Only runs at least as long as the shortest
window are indexed, as no other can hold one. The index is the Burrows-Wheeler transform of the runs in a
wavelet matrix, with the suffix position of every few words and of each run's start. All windows of the
benchmark are searched backwards at once through wavelet ranks, occurrences are located by stepping to the
nearest sampled position, and the spans found are merged for each document.

The benchmark is taken in blocks of bounded size, each sent to the executors and searched in a pass of its
own over documents that carry what earlier passes found; usually there is one block. An executor works on one
at a time and keeps others on disk; the driver keeps the file of each until the result is dropped. Documents are not shuffled.

Null and empty texts have no words, so no hits; null and empty benchmark texts have no windows. A null item_id
counts as the empty id, items that share an id as one item, and a tie between items as a hit of both. Repeated rows and ids are judged row by
row. Long texts are searched whole, in a shard of their own if need be. Empty tables give no rows, an empty benchmark no hits. Input columns come
back inside `row`, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import nested, table

WINDOW = 10
#: Words of the benchmark in a block, bytes of text in a shard, words between sampled positions.
BLOCK_WORDS, SHARD_BYTES, SAMPLE = 2_000_000, 8_000_000, 8
#: Bytes of words, with A-Z in lower case; all others become spaces.
WORD_BYTES = bytes((x + 32 if 65 <= x <= 90 else x) if 48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence; each level holds one bit of every symbol, the highest bit first."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.levels.append((level, words, ones, int(self.n - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return ones[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before the position beside it."""
        first = np.zeros(len(at), np.int64)
        for level, words, ones, zeros in self.levels:
            one = (symbols >> level & 1).astype(bool)
            a, b = self._ones(words, ones, at), self._ones(words, ones, first)
            at, first = np.where(one, zeros + a, at - a), np.where(one, zeros + b, first - b)
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level, words, ones, zeros in self.levels:
            one = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a = self._ones(words, ones, at)
            at = np.where(one, zeros + a, at - a)
            out |= one.astype(np.int64) << level
        return out


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of text, in which each 0 ends a run and sorts by its place; prefixes double each round."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # words up to the run's end
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        inside = np.flatnonzero(left > k)
        key[inside] |= text[inside + k]
    order = np.argsort(key, kind="stable")
    tied = np.zeros(n, bool)  # with the one before
    tied[1:] = (key[order[1:]] == key[order[:-1]]) & (left[order[1:]] >= step)
    while tied.any():
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))
        slots = np.flatnonzero(tied | np.r_[tied[1:], False])
        own = order[slots]
        key = rank[own] * (n + 1) + rank[own + step]
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[slots] = own
        tied[:] = False
        tied[slots[1:]] = (key[1:] == key[:-1]) & (left[own[1:]] >= 2 * step)
        step *= 2
    return order


class FMIndex:
    """Counts and finds words' sequences in runs of symbols (1 and up), each ended by a 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        bits = max(1, int(symbols).bit_length())
        order = suffix_array(text, bits)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.wavelet = WaveletMatrix(text[order - 1], bits)  # a run's start is after a 0, and so is the first
        sampled = (order % sample == 0) | (text[order - 1] == 0)
        self.sampled, self.values = sampled, order[sampled]
        self.place = np.cumsum(sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that begin with each of the patterns, an array with one in a row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            c = patterns[live, k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            c = self.wavelet.symbol(at[live])
            at[live] = self.before[c] + self.wavelet.rank(c, at[live])
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.values[self.place[at]] + steps


class Block:
    """The windows of some benchmark items: by length, the distinct ones and the items that have each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        for item, words in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(own) - window + 1)):
                owners.setdefault(tuple(own[i : i + window]), set()).add(number[item])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {len(x) for x in owners}:
            own = [x for x in owners if len(x) == n]
            self.windows[n] = (np.array(own, np.int64), np.cumsum([0] + [len(owners[x]) for x in own]), np.array([i for x in own for i in sorted(owners[x])], np.int64))
        self.shortest = min(self.windows)

    def hits(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """The merged spans of hit words, and the ids of items, of each document of a shard."""
        found = [([], []) for _ in documents]
        get, texts, docs, places = self.vocabulary.get, [], [], []
        for d, words in enumerate(documents):
            ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
            edge = np.flatnonzero(np.diff(np.r_[False, ids > 0, False].astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            long = ends - starts >= self.shortest
            for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                texts += [ids[a:b], [0]]
                places.append(np.arange(a, b + 1))
                docs.append(np.full(b - a + 1, d))
        if not texts:
            return found
        index = FMIndex(np.concatenate(texts).astype(np.int64), len(self.vocabulary))
        doc, place = np.concatenate(docs), np.concatenate(places)
        spans, owned = [], []
        for n, (patterns, first, items) in self.windows.items():
            low, high = index.search(patterns)
            which = np.repeat(np.arange(len(patterns)), high - low)
            rows = np.arange(len(which)) + np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low)
            at = index.locate(rows)
            spans.append(np.stack([doc[at], place[at], place[at] + n], axis=1))
            pairs = np.unique(np.stack([doc[at], which], axis=1), axis=0)
            counts = (first[1:] - first[:-1])[pairs[:, 1]]
            step = np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts) if len(pairs) else np.empty(0, np.int64)
            owned.append(np.stack([np.repeat(pairs[:, 0], counts), items[np.repeat(first[pairs[:, 1]], counts) + step]], axis=1))
        all_spans = np.concatenate(spans)
        for d, a, b in all_spans[np.lexsort((all_spans[:, 1], all_spans[:, 0]))].tolist():
            own = found[d][0]
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        for d, i in np.unique(np.concatenate(owned), axis=0).tolist():
            found[d][1].append(self.ids[i])
        return found


def blocks(benchmark: DataFrame, window: int, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's windows, by blocks of bounded size; held one at a time."""
    held, n = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        words = words_of(text)
        if words:
            held.append((item, words))
            n += len(words)
        if n >= most:
            yield Block(held, window)
            held, n = [], 0
    if held:
        yield Block(held, window)


def merged(one: list, other: list) -> list:
    """The union of two lists of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*one, *other]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, text, n_words, spans, items): the input's rows as structs, their number of words, spans of hit words (start and end, merged, in order), and the ids of items found."""
    spark, at = docs.sparkSession, 1
    empty = "cast(array() as array<struct<start:long,end:long>>)"
    out = nested(docs).select("*", F.lit(-1).cast("long").alias("n_words"), F.expr(empty).alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    found_any = False

    def search(held) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value if held is not None else None
            for whole in batches:
                first = 0
                while first < whole.num_rows:  # shards of whole documents
                    documents, size = [], 0
                    while first + len(documents) < whole.num_rows and size < shard_bytes:
                        text = whole.column(at)[first + len(documents)].as_py()
                        documents.append(words_of(text))
                        size += len(text or "") + 64
                    batch = whole.slice(first, len(documents))
                    first += len(documents)
                    hits = block.hits(documents) if block is not None else [([], [])] * len(documents)
                    k = batch.num_columns - 3
                    if found_any:
                        old = zip(batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist())
                        hits = [(merged([(x["start"], x["end"]) for x in s], h[0]), sorted({*i, *h[1]})) for (s, i), h in zip(old, hits)]
                    spans = pa.array([[{"start": a, "end": b} for a, b in h[0]] for h in hits], SPANS)
                    items = pa.array([h[1] for h in hits], pa.list_(pa.string()))
                    n = pa.array([len(x) for x in documents], pa.int64())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:k], n, spans, items], batch.schema.names)

        return run

    for block in blocks(benchmark, window, block_words):
        out = out.mapInArrow(search(spark.sparkContext.broadcast(block)), schema)
        found_any = True
    return out if found_any else out.mapInArrow(search(None), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same rows by grouping windows of words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT k, i, n, item_id FROM (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)) JOIN p USING (n, g)),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT k, i, n FROM h)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
