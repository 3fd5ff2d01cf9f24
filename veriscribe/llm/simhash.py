"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is split into blocks, more of them than bits may differ, so that a linked pair agrees on
some of them whole: with 7 blocks and 4 bits, on at least 3. Each distinct fingerprint goes to one bucket
for each choice of 3 blocks, about 27 bits of key, and Hamming distances are verified within buckets only.
Copies share a fingerprint and go once. From a bucket come only the links of a spanning forest, found by a
search that compares each fingerprint with those not reached yet, so that a cluster of near copies costs and
emits few; connected components of these links are those of all links. Buckets over a size are split in
chunks and done by pairs of chunks, so no task holds more than two chunks of a bucket.

Null and empty texts have fingerprint 0, which is linked like any other. Repeated rows stay, each with its
component; a null doc_id takes part and never names a component unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import connected_components, materialise, table

WIDTH, DISTANCE, BLOCKS = 4, 4, 7
#: Fingerprints of a bucket that one task holds.
CHUNK = 16_384
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash, as a signed integer."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()  # bytes split at 09-0D and 20 only
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(np.array(hashes[i : i + 65_536], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, column: str = "fp", width: int = WIDTH) -> DataFrame:
    """docs and their fingerprint, a long, in a column of the given name."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x, width) for x in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*batch.schema.names, column])

    return docs.mapInArrow(run, type(docs.schema)([*docs.schema.fields]).add(column, "long"))


def masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """The bits of each choice of blocks that a linked pair may agree on, as signed integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    out = [sum(x) for x in combinations(parts, blocks - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints which links connect."""
    links, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(x, y) for y in found.tolist()]
                queue += list(found)
    return links


def _between(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what links between two sets connect; those within each set are found elsewhere."""
    links, rest = [], (a, b)
    while len(rest[0]) and len(rest[1]):
        queue, rest = [(0, rest[0][0])], (rest[0][1:], rest[1])
        while queue:
            side, x = queue.pop()
            other = rest[1 - side]
            near = np.bitwise_count(other ^ x) <= distance
            if near.any():
                found = other[near]
                links += [(x, y) for y in found.tolist()]
                queue += [(1 - side, y) for y in found]
                rest = (rest[0], other[~near]) if side == 0 else (other[~near], rest[1])
    return links


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) that connect whatever chains of distances up to the bound connect; fps holds distinct longs fp."""
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(distance, blocks)])).alias("c", "k")
    dealt = fps.select("fp", keys).repartition("c", "k").sortWithinPartitions("c", "k", "fp")

    def done(fp: np.ndarray, c: np.ndarray, k: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        """Links of the whole buckets (part < 0), and the rows of the chunks."""
        cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(c) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
        whole = part[starts] < 0 if len(k) else np.zeros(len(starts), bool)
        two = (ends - starts == 2) & whole
        a, b = fp[starts[two]], fp[starts[two] + 1]
        near = np.bitwise_count(a ^ b) <= distance
        found = list(zip(a[near].tolist(), b[near].tolist()))
        many = (ends - starts > 2) & whole
        for start, end in zip(starts[many].tolist(), ends[many].tolist()):
            found += _forest(fp[start:end], distance)
        pairs, big = np.array(found, np.uint64).reshape(-1, 2).view(np.int64), part >= 0
        none = [None] * len(pairs)
        columns = [
            pa.array(np.concatenate([pairs[:, 0], fp[big].view(np.int64)])),
            pa.array(np.concatenate([pairs[:, 1], k[big]])),
            pa.array(none + c[big].tolist(), pa.int32()),
            pa.array(none + part[big].tolist(), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["src", "dst", "c", "part"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of whole buckets; of larger buckets, the rows with the number of their chunk."""
        fp, c, k = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)
        going, parts = None, 0  # the large bucket that may go on, and how many of its chunks are out
        for batch in _and_end(batches):
            if batch is not None:
                fp = np.concatenate([fp, batch.column(0).to_numpy().view(np.uint64)])
                c = np.concatenate([c, batch.column(1).to_numpy()])
                k = np.concatenate([k, batch.column(2).to_numpy()])
            if not len(k):
                continue
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(c) != 0)) + 1
            bounds = np.r_[0, cuts, len(k)]
            out = len(k) if batch is None else int(bounds[-2])
            part = np.full(len(k), -1, np.int64)
            goes_on = going == (c[0], k[0])
            large = set(np.flatnonzero(np.diff(bounds) > chunk).tolist()) | ({0} if goes_on else set())
            base, going = parts if goes_on else 0, None
            for run in sorted(large):
                start, end = int(bounds[run]), int(bounds[run + 1])
                first = base if run == 0 else 0
                if end == len(k) and batch is not None:
                    end = start + (end - start) // chunk * chunk
                    out, going, parts = end, (c[start], k[start]), first + (end - start) // chunk
                part[start:end] = first + np.arange(end - start) // chunk
            yield done(fp[:out], c[:out], k[:out], part[:out])
            fp, c, k = fp[out:], c[out:], k[out:]

    first = materialise(dealt.select("fp", "c", "k").mapInArrow(within, "src long, dst long, c int, part int"))
    small = first.where("part is null").select("src", "dst")
    large = first.where("part is not null").select(F.col("src").alias("fp"), F.col("dst").alias("k"), "c", "part")
    top = large.groupBy("c", "k").agg(F.max("part").alias("top"))

    def pairs(rows: "pa.Table") -> "pa.Table":
        fp, part = rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy()
        low = part.min()
        one, other = fp[part == low], fp[part != low]
        found = _between(one, other, distance) if len(other) else _forest(one, distance)
        return pa.Table.from_batches([_edges(found)])

    to = F.explode(F.expr("sequence(0, top)")).alias("to")
    meet = large.join(top, ["c", "k"]).select("c", "k", "fp", "part", "top", to)
    meet = meet.select("c", "k", "fp", "part", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"))
    across = meet.groupBy("c", "k", "i", "j").applyInArrow(pairs, "src long, dst long")
    return small.unionByName(across).distinct()


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(fp, root, component_id) for each distinct fp of prints(doc_id, fp); a component without an id has a null component_id."""
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(least.select("fp"), distance, blocks, chunk))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = materialise(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp", width).select("doc_id", "fp"))
    found = prints.join(components(prints, distance, blocks, chunk), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
