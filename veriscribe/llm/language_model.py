"""Language-model scores by deleted interpolation of unigram and bigram estimates.

Every task compiles its documents to shards: the distinct words' 64-bit hashes and each token's index among
them, written once to the shared folder. A shard's n-grams are counted inside it, so that a frequent word or
pair crosses the network once for each shard, however often it occurs; packed, sorted key lists go to one
reducer for each range of hashes, which sums them over all shards and answers each list with the totals. A
score is then made beside the shard, from its own answers; no table of the corpus is ever broadcast or held
whole by one task.

Maximum-likelihood estimates of the bigram, the unigram and the uniform distribution are mixed. Contexts fall
in buckets by the logarithm of their count, and each bucket has its own weights, learned by expectation
maximisation on the counts of a part of the training documents that the estimates leave out (the deleted
part, a fixed share by a hash of the id). The tokens of that part enter as a histogram of bounded size.
Scores use the counts of all training documents.

Null and empty texts have the end token alone. A null doc_id is a training document. Repeated rows count and
are scored as often as they occur. Two words with one hash would count as one word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import materialise, table

FOLDS, HELD_OUT = 7, 2
#: One in so many documents, by the other digits of the hash, makes the deleted part.
DELETED = 12
SHARD_BYTES = 12_000_000
#: Buckets of contexts by the logarithm of their count, and cells for the logarithms of both estimates.
CONTEXTS, CELLS, STEPS = 28, 40, 200
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: No word holds white space, so these stand for the end of a text and for its beginning, a context only.
END, BEGIN = b"\n", b"\n\n"


class Numbered(dict):
    """Words, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def packed(values: np.ndarray) -> bytes:
    """Integers, bytes of one weight together, compressed."""
    import zstandard

    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def part_of(doc_id: int | None) -> tuple[int, bool]:
    """The fold of a document, and whether it is in the deleted part of the training documents."""
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    return (crc % FOLDS if doc_id is not None else 0), crc % FOLDS != HELD_OUT and crc // FOLDS % DELETED == 0


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Shard:
    """Documents as indices into sorted hashes of their words."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, training: np.ndarray):
        self.hashes, self.tokens, self.lengths, self.training = hashes, tokens, lengths, training
        self.ends = np.cumsum(lengths)
        self.end, self.begin = (int(np.searchsorted(hashes, hash_of(x))) for x in (END, BEGIN))

    @classmethod
    def compile(cls, texts: list[str | None], training: list[bool]) -> "Shard":
        import xxhash

        number = Numbered()
        end, _ = number[END], number[BEGIN]
        rows = []
        for text in texts:
            words = (text or "").encode().translate(LOWER).split()
            rows += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), np.array([end], np.int32)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lengths = np.array([len(x) + 1 for x in rows[::2]], np.int64)
        return cls(hashes[order], place[np.concatenate(rows)], lengths, np.array(training, bool))

    def codes(self) -> np.ndarray:
        """For every token, its context and itself as one number."""
        contexts = np.empty(len(self.tokens), np.int64)
        contexts[1:] = self.tokens[:-1]
        contexts[np.r_[0, self.ends[:-1]]] = self.begin
        return contexts * len(self.hashes) + self.tokens

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all tokens, the distinct ones in order, and the order of their hashes."""
        codes = self.codes()
        distinct = np.sort(codes)
        distinct = distinct[np.flatnonzero(np.diff(distinct, prepend=-1))]
        return codes, distinct, np.argsort(self.keys(distinct))

    def keys(self, distinct: np.ndarray) -> np.ndarray:
        return mixed(self.hashes[distinct // len(self.hashes)], self.hashes[distinct % len(self.hashes)])

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, keys in order, counts in training documents) of the unigrams and the bigrams."""
        learn = np.repeat(self.training, self.lengths)
        single = np.bincount(self.tokens[learn], minlength=len(self.hashes))
        single[self.begin] = self.training.sum()
        yield 1, self.hashes, single
        codes, distinct, order = self.pairs()
        known = np.sort(codes[learn])
        double = np.searchsorted(known, distinct, "right") - np.searchsorted(known, distinct, "left")
        yield 2, self.keys(distinct)[order], double[order]

    def estimates(self, single: np.ndarray, double: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each token's pair is among the distinct ones, and their counts: of the pair, its context, its word."""
        codes, distinct, order = self.pairs()
        both = np.empty(len(distinct), np.int64)
        both[order] = double
        return np.searchsorted(distinct, codes), both, single[distinct // len(self.hashes)], single[distinct % len(self.hashes)]


def hash_of(word: bytes) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(word))


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, deleted, doc_ids, held_out, hashes, tokens, lengths): the compiled documents, a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        waiting: dict[bool, tuple[list, list, list[int]]] = {False: ([], [], [0]), True: ([], [], [0])}

        def out(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            ids, texts, size = waiting[deleted]
            held = [part_of(d)[0] == HELD_OUT for d in ids]
            shard = Shard.compile(texts, [not h for h in held])
            row = {
                "shard": (TaskContext.get().partitionId() << 24) + made,
                "deleted": deleted,
                "doc_ids": list(ids),
                "held_out": held,
                "hashes": packed(shard.hashes),
                "tokens": packed(shard.tokens),
                "lengths": packed(shard.lengths),
            }
            made += 1
            ids.clear(), texts.clear()
            size[0] = 0
            return pa.RecordBatch.from_pylist([row], schema=SHARD_SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, texts, size = waiting[deleted := part_of(doc)[1]]
                ids.append(doc)
                texts.append(text)
                size[0] += len(text or "") + 64
                if size[0] >= shard_bytes:
                    yield out(deleted)
        for deleted in waiting:
            if waiting[deleted][0]:
                yield out(deleted)

    ddl = "shard long, deleted boolean, doc_ids array<long>, held_out array<boolean>, hashes binary, tokens binary, lengths binary"
    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl))


SHARD_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("deleted", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("hashes", pa.binary()), ("tokens", pa.binary()), ("lengths", pa.binary())]
)
ANSWER = "shard long, deleted boolean, n int, range int, counts binary, kept binary, total long, distinct_ long, kept_total long, kept_distinct long"
ANSWER_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("deleted", pa.bool_()), ("n", pa.int32()), ("range", pa.int32()), ("counts", pa.binary()), ("kept", pa.binary())]
    + [(x, pa.int64()) for x in ("total", "distinct_", "kept_total", "kept_distinct")]
)


def restored(row: dict) -> Shard:
    training = np.array([not h for h in row["held_out"]], bool)
    return Shard(unpacked(row["hashes"]), unpacked(row["tokens"]).astype(np.int64), unpacked(row["lengths"]).astype(np.int64), training)


def totals(compiled: DataFrame, ranges: int) -> DataFrame:
    """For each shard, order and range of hashes: the corpus's counts of the shard's n-grams; and each range's totals, as shard -1."""
    bits = max(0, ranges.bit_length() - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for n, keys, counts in restored(row).counts():
                    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(ranges + 1).astype(np.uint64)) if bits else np.array([0, len(keys)])
                    out = []
                    for r in np.flatnonzero(np.diff(edges)).tolist():
                        a, b = edges[r], edges[r + 1]
                        out.append({"range": r, "shard": row["shard"], "deleted": row["deleted"], "n": n, "keys": packed(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": packed(counts[a:b])})
                    yield pa.RecordBatch.from_pylist(out, schema=asked)

    asked = pa.schema([("range", pa.int32()), ("shard", pa.int64()), ("deleted", pa.bool_()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    ddl = "range int, shard long, deleted boolean, n int, keys binary, counts binary"

    def answer(group: pa.Table) -> pa.Table:
        rows, out = group.to_pylist(), []
        for n in (1, 2):
            own = [r for r in rows if r["n"] == n]
            if not own:
                continue
            lists = [np.cumsum(unpacked(r["keys"]), dtype=np.uint64) for r in own]
            counts = [unpacked(r["counts"]).astype(np.int64) for r in own]
            keys, sizes = np.concatenate(lists), np.cumsum([0] + [len(x) for x in lists])
            order = np.argsort(keys, kind="stable")
            new = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
            first = np.flatnonzero(new)
            where = np.empty(len(keys), np.int64)
            where[order] = np.cumsum(new) - 1
            kept = np.concatenate([c * (not r["deleted"]) for c, r in zip(counts, own)])
            all_sums, kept_sums = np.add.reduceat(np.concatenate(counts)[order], first), np.add.reduceat(kept[order], first)
            for r, a, b in zip(own, sizes, sizes[1:]):
                out.append({"shard": r["shard"], "deleted": r["deleted"], "n": n, "range": r["range"], "counts": packed(all_sums[where[a:b]]), "kept": packed(kept_sums[where[a:b]]) if r["deleted"] else None})
            if n == 1:
                word = keys[order[first]] != hash_of(BEGIN)
                sums = {"total": all_sums[word].sum(), "distinct_": (all_sums[word] > 0).sum(), "kept_total": kept_sums[word].sum(), "kept_distinct": (kept_sums[word] > 0).sum()}
                out.append({"shard": -1, "n": 1, "range": own[0]["range"]} | {k: int(v) for k, v in sums.items()})
        return pa.Table.from_pylist(out, schema=ANSWER_SCHEMA)

    return materialise(compiled.mapInArrow(ask, ddl).groupBy("range").applyInArrow(answer, ANSWER))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than its count's logarithm."""
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), CONTEXTS - 1)


def cell(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else a step for each half of a power of two."""
    return np.where(p > 0, np.clip((-2 * np.log2(np.where(p > 0, p, 1))).astype(np.int64), 0, CELLS - 2) + 1, 0)


def learned(histogram: list, distinct: int) -> np.ndarray:
    """Weights (uniform, unigram, bigram) of each bucket, by expectation maximisation on (bucket, tokens, sum of both estimates' values)."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0)
    rows = np.array(histogram, np.float64).reshape(-1, 4)
    if not len(rows):
        return weights
    b, n = rows[:, 0].astype(int), rows[:, 1]
    p = np.stack([np.full(len(rows), 1 / (distinct + 1)), rows[:, 3] / n, rows[:, 2] / n], axis=1)
    for _ in range(STEPS):
        share = p * weights[b]
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(b, share[:, k], CONTEXTS) for k in range(3)], axis=1) + 1e-3 * weights
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    compiled = shards(docs, shard_bytes)
    made = compiled.count()
    ranges = 1 << max(3, (made // 2).bit_length())  # each with about the n-grams of two shards or more
    answers = totals(compiled, ranges)
    sums = answers.where("shard = -1").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "distinct_", "kept_total", "kept_distinct")]).first()
    known = ["doc_ids", "held_out", "hashes", "tokens", "lengths"]
    own = answers.where("shard >= 0").select("shard", "deleted", "n", "range", "counts", "kept", *[F.lit(None).cast(compiled.schema[x].dataType).alias(x) for x in known])
    whole = compiled.select("shard", "deleted", F.lit(0).alias("n"), F.lit(0).alias("range"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("kept"), *known)
    together = whole.unionByName(own)

    def read(group: pa.Table, column: str) -> tuple[dict, Shard, list[np.ndarray]]:
        rows = group.to_pylist()
        main = next(r for r in rows if r["n"] == 0)
        counts = []
        for n in (1, 2):
            parts = sorted((r for r in rows if r["n"] == n), key=lambda r: r["range"])
            counts.append(np.concatenate([unpacked(r[column]) for r in parts]).astype(np.int64))
        return main, restored(main), counts

    def cells(group: pa.Table) -> pa.Table:
        _, shard, (single, double) = read(group, "kept")
        where, both, context, word = shard.estimates(single, double)
        n = np.bincount(where, minlength=len(both))
        p2, p1 = both / np.maximum(context, 1), word / max(1, sums["kept_total"])
        at = (bucket(context) * CELLS + cell(p2)) * CELLS + cell(p1)
        size = CONTEXTS * CELLS * CELLS
        totals_ = [np.bincount(at, x, size) for x in (n, n * p2, n * p1)]
        used = np.flatnonzero(totals_[0])
        return pa.table({"cell": pa.array(used, pa.int64())} | {k: pa.array(x[used], pa.float64()) for k, x in zip(("n", "p2", "p1"), totals_)})

    rows = together.where("deleted").groupBy("shard").applyInArrow(cells, "cell long, n double, p2 double, p1 double")
    found = rows.groupBy("cell").agg(F.sum("n"), F.sum("p2"), F.sum("p1")).orderBy("cell").collect()  # CONTEXTS * CELLS * CELLS rows at most
    weights = learned([(c // (CELLS * CELLS), n, p2, p1) for c, n, p2, p1 in found], sums["kept_distinct"])
    total, distinct = sums["total"], sums["distinct_"]

    def score(group: pa.Table) -> pa.Table:
        main, shard, (single, double) = read(group, "counts")
        where, both, context, word = shard.estimates(single, double)
        w = weights[bucket(context)]
        p = w[:, 0] / (distinct + 1) + w[:, 1] * word / max(1, total) + w[:, 2] * both / np.maximum(context, 1)
        starts = shard.ends - shard.lengths
        base = np.log10((word + 1) / (total + distinct + 1))
        columns = {
            "doc_id": pa.array(main["doc_ids"], pa.int64()),
            "held_out": pa.array(main["held_out"], pa.bool_()),
            "n_tokens": pa.array(shard.lengths),
            "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64)[where], starts)),
            "train_tokens": pa.array([total] * len(starts), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[where], starts)),
            "score": pa.array(np.add.reduceat(np.log10(np.maximum(p, 1e-300))[where], starts)),
        }
        return pa.table(columns)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.groupBy("shard").applyInArrow(score, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
