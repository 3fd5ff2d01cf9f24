"""Exact removal of repeated 200-byte strings by a hash-compared suffix sort.

Where two equal strings of LENGTH bytes are, the smallest hash of the GRAM-byte strings inside them, the
leftmost of equals, is at the same place in both. So every text is reduced to these anchors, about one in seventy bytes,
each with a 128-bit digest of its context: the bytes of all strings of LENGTH whose anchor it is. Anchors are
counted over the corpus by their hash, with partial sums before the shuffle, and those that occur once drop out.
An anchor whose whole context occurs again is repeated as far as its context goes. What is left are anchors
that occur in different contexts, of which one copy each is compared. Where counts meet anchors again, one that is frequent
in a slice of texts is salted, and its count goes to each salt in use.

These contexts form the texts of small shards, in which all suffixes that begin up to LENGTH bytes around an
anchor are sorted: a bottom-up merge sort, whose comparisons find the common extension of two suffixes by
binary search over prefix polynomial hashes, hence in a logarithmic number of steps. Neighbours that agree on LENGTH
bytes are repeated, after a comparison of the bytes themselves; a collision there makes the shard sort
again with another base. An anchor with more contexts than one task should sort has its strings grouped by their own bytes
over the cluster, with partial sums, which finds the same.

Texts are judged as UTF-8 bytes, long ones in blocks that overlap; null texts are empty. Repeated rows, also those that share an id or have
none, are copies of each other, so their strings repeat; ties between copies go by id and place. An empty table gives no rows. Only doc_id and text
are read, so other columns may have any names. Texts that need no comparison are finished with their first join; only others travel twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import drop, materialise, table

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM
#: Bytes whose anchors are found at once; contexts in a shard; contexts of an anchor that one task sorts; times that an anchor is in a slice under one salt.
BLOCK, SHARD, MOST, FREQUENT = 1 << 21, 6_000, 2_000, 16
#: Salts of strings that many contexts of such an anchor have.
SALTS = 16
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_hashes(data: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Of each prefix, the sum of its bytes times the powers of their places."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash, first and last string that it stands for) of every anchor, in order."""
    pieces: list[list[tuple[int, int, bytes]]] = [[]]
    size = 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), BLOCK - LENGTH) if len(text) >= LENGTH else ():
            part = text[start : start + BLOCK - 1]
            if size + len(part) > BLOCK and pieces[-1]:
                pieces.append([])
                size = 0
            pieces[-1].append((k, start, part))
            size += len(part)
    out: list[tuple] = []
    power, inverse = powers(BASES[0], BLOCK)
    for block in pieces:
        if not block:
            continue
        data = np.frombuffer(b"".join(p for *_, p in block), np.uint8)
        sums = prefix_hashes(data, power)
        own = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1]
        own = scattered(own)
        low = np.uint64(BLOCK - 1)
        least = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        width, window = 1, REACH + 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        lengths = np.array([len(p) for *_, p in block])
        starts = np.cumsum(lengths) - lengths
        valid = np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in zip(starts, lengths)])
        at = (least[valid] & low).astype(np.int64)
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        first, last = valid[begin], valid[np.r_[begin[1:], len(at)] - 1] if len(at) else valid
        at = at[begin]
        which = np.searchsorted(starts, at, "right") - 1
        number = np.array([k for k, *_ in block])[which]
        shift = np.array([s for _, s, _ in block])[which] - starts[which]
        out.append((number, at + shift, own[at], first + shift, last + shift))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    number, place, own, first, last = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((place, number))
    number, place, own, first, last = (x[order] for x in (number, place, own, first, last))
    new = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(place) != 0)][: len(number)])  # long texts' parts overlap
    if not len(new):
        return number, place, own, first, last
    return number[new], place[new], own[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode()


def anchors(docs: DataFrame) -> DataFrame:
    """(id, th, place, own, a, b, left, right, salt) of every anchor: the text's id and hash, the anchor's place and hash, its context's digest and reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, task = xxhash.xxh3_128_digest, TaskContext.get().partitionId()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = [as_bytes(x) for x in batch.column(2).to_pylist()]
                number, place, own, left, right = anchors_of(texts)
                right = right + LENGTH
                found = b"".join([digest(texts[k][a:b]) for k, a, b in zip(number.tolist(), left.tolist(), right.tolist())])
                a, b = np.frombuffer(found, ">i8").reshape(-1, 2).T.astype(np.int64)
                a = a + (place - left)
                order = np.argsort(own, kind="stable")
                nth = np.arange(len(own)) - np.searchsorted(own[order], own[order])
                salt = np.empty(len(own), np.int64)
                salt[order] = np.where(nth < FREQUENT, 0, nth // FREQUENT + (task % 64 << 10))
                ids, hashes = batch.column(0).take(pa.array(number)), batch.column(1).take(pa.array(number))
                reach = [pa.array((place - left).astype(np.int32)), pa.array((right - place).astype(np.int32))]
                columns = [ids, hashes, *[pa.array(x) for x in (place, own.view(np.int64), a, b)], *reach, pa.array(salt.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "place", "own", "a", "b", "left", "right", "salt"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, place long, own long, a long, b long, left int, right int, salt int")


def spread(counts: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """A row of counts for salt 0 of its keys and for each other salt that rows have."""
    more = rows.where("salt > 0").select(*keys, "salt").distinct().join(counts, [*keys])
    return counts.withColumn("salt", F.lit(0)).unionByName(more)


class Sorter:
    """Suffixes of a text, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, base: int):
        self.data, self.size = data, 1 << max(10, int(len(data)).bit_length())
        self.power, _ = powers(base, self.size)
        self.sums = prefix_hashes(data, self.power)

    def agree(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether the n bytes from a and those from b have one hash."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        return (self.sums[low + n] - self.sums[low]) * self.power[high - low] == self.sums[high + n] - self.sums[high]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes from a and b on are the same, LENGTH at most."""
        out = np.full(len(a), LENGTH)
        rest = np.flatnonzero(~self.agree(a, b, LENGTH))
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), LENGTH - 1, np.int64)
        x, y = a[rest], b[rest]
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live] + 1) >> 1
            same = self.agree(x[live], y[live], mid)
            low[live] = np.where(same, mid, low[live])
            high[live] = np.where(same, high[live], mid - 1)
        out[rest] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix a sorts before b; of equals, as ties says."""
        n = self.extension(a, b)
        equal = n >= LENGTH
        at = np.where(equal, 0, n)
        return np.where(equal, ties, self.data[a + at] < self.data[b + at])

    def sorted(self, suffixes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The order of suffixes inside each of the groups, which follow one another.

        Their first eight bytes part most of them; of those that share them, runs of which all agree with the first
        over LENGTH bytes are in order, and the others are merge sorted.
        """
        if not len(suffixes):
            return np.arange(0)
        head = np.zeros(len(suffixes), np.uint64)
        for k in range(8):
            head = head << np.uint64(8) | self.data[suffixes + k].astype(np.uint64)
        order = np.lexsort((head, groups))
        own, head, groups = suffixes[order], head[order], groups[order]
        first = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (head[1:] != head[:-1])])
        sizes = np.diff(np.r_[first, len(own)])
        run = np.repeat(np.arange(len(first)), sizes)
        shared = np.flatnonzero(sizes[run] > 1)
        differ = np.zeros(len(first), bool)
        differ[run[shared[~self.agree(own[shared], own[first[run[shared]]], LENGTH)]]] = True
        rest = np.flatnonzero(differ[run])
        if len(rest):
            order[rest] = order[rest][self.merge_sorted(own[rest], run[rest])]
        return order

    def merge_sorted(self, suffixes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The order of suffixes inside each of the groups, which follow one another, by merging runs of doubling length."""
        n = len(suffixes)
        order, first = np.arange(n), np.flatnonzero(np.diff(groups, prepend=-1))
        sizes = np.diff(np.r_[first, n])
        begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            within = np.arange(n) - begin
            run = begin + within // (2 * width) * (2 * width)
            left = within % (2 * width) < width
            middle = np.minimum(run + width, end)
            stop = np.minimum(run + 2 * width, end)
            moving = np.flatnonzero(middle < stop)
            low = np.where(left, middle, run)[moving]
            high = np.where(left, stop, middle)[moving]
            base = low.copy()
            mine = suffixes[order[moving]]
            is_left = left[moving]
            while (live := np.flatnonzero(low < high)).size:
                mid = (low[live] + high[live]) >> 1
                # a left element goes after smaller right ones, a right one after smaller and equal left ones
                goes = self.before(suffixes[order[mid]], mine[live], ~is_left[live])
                low[live] = np.where(goes, mid + 1, low[live])
                high[live] = np.where(goes, high[live], mid)
            own = np.where(is_left, moving - run[moving], moving - middle[moving])
            new = order.copy()
            new[run[moving] + own + low - base] = order[moving]
            order = new
            width *= 2
        return order


def repeated(contexts: list[tuple[int, int, bytes]]) -> list[list[int]]:
    """For contexts (anchor hash, bytes left of the anchor, bytes): the places left of each anchor where a repeated string begins."""
    contexts_at = sorted(range(len(contexts)), key=lambda i: contexts[i][0])
    data = np.frombuffer(b"".join(contexts[i][2] for i in contexts_at), np.uint8)
    sizes = np.array([len(contexts[i][2]) for i in contexts_at])
    offset = np.cumsum(sizes) - sizes
    left = np.array([contexts[i][1] for i in contexts_at])
    # a string begins at most `left` before its anchor, and ends inside the context
    least, most = np.maximum(0, LENGTH - (sizes - left)), np.minimum(left, REACH)
    counts = np.maximum(most - least + 1, 0)
    which = np.repeat(np.arange(len(contexts_at)), counts)
    back = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + least[which]
    _, anchor = np.unique(np.array([contexts[i][0] for i in contexts_at]), return_inverse=True)
    sort = np.lexsort((which, back, anchor[which]))
    which, back = which[sort], back[sort]
    groups = anchor[which].astype(np.int64) * (REACH + 1) + back
    suffixes = offset[which] + left[which] - back
    for base in BASES[1:]:
        sorter = Sorter(data, base)
        order = sorter.sorted(suffixes, groups)
        a, b = suffixes[order[:-1]], suffixes[order[1:]]
        pairs = np.flatnonzero((groups[order[1:]] == groups[order[:-1]]) & sorter.agree(a, b, LENGTH)) if len(order) else np.empty(0, np.int64)
        step = np.arange(LENGTH)
        if all((data[a[p][:, None] + step] == data[b[p][:, None] + step]).all() for p in np.array_split(pairs, len(pairs) // 20_000 + 1)):
            break
    else:
        raise ArithmeticError("every base had a collision")
    same = np.zeros(len(order), bool)
    same[order[pairs]] = same[order[pairs + 1]] = True
    out: list[list[int]] = [[] for _ in contexts]
    for w, d in zip(which[same].tolist(), back[same].tolist()):
        out[contexts_at[w]].append(d)
    return out


def runs(backs: list[int]) -> list[tuple[int, int]]:
    """The bytes, from an anchor's place on, of strings that begin so far left of it."""
    out: list[tuple[int, int]] = []
    for d in sorted(backs, reverse=True):
        if out and -d <= out[-1][1]:
            out[-1] = (out[-1][0], LENGTH - d)
        else:
            out.append((-d, LENGTH - d))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OPEN = pa.list_(pa.struct([("place", pa.int64()), ("own", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))


def result(doc_id: int | None, text: bytes, spans: list[tuple[int, int]], with_kept: bool) -> dict:
    spans = merged(spans)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept = b"".join([*kept, text[at:]])
    found = {"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}
    return found | {"spans": [{"start": a, "end": b} for a, b in spans]} | ({"kept": kept} if with_kept else {})


RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", SPANS)]
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def repeats(docs: DataFrame, most: int = MOST, shard: int = SHARD, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every row, spans and kept in bytes."""
    null_id = -(1 << 63)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    found = materialise(anchors(keyed))
    # anchors that occur again, and whether in more than one context
    differ = (F.min("a") != F.max("a")) | (F.min("b") != F.max("b"))
    twice = found.groupBy("own").agg(F.count("*").alias("n"), differ.alias("open")).where("n > 1").select("own", "open")
    again = materialise(found.join(spread(twice, found, "own"), ["own", "salt"]))
    drop(found)
    # of each context of an open anchor: how often it occurs, and the copy to compare
    open_ = again.where("open")
    copies = open_.groupBy("own", "a", "b").agg(F.count("*").alias("times"), F.min(F.struct("id", "th", "place")).alias("copy"))
    copied = materialise(copies)
    kinds = copied.groupBy("own").agg(F.count("*").alias("kinds"))
    many = kinds.where(F.col("kinds") > most).select("own", F.lit(True).alias("many"))
    copies = copied.join(many, "own", "left")
    marked = open_.join(spread(copies, open_, "own", "a", "b"), ["own", "a", "b", "salt"])
    fields = ["place", "own", "a", "b", "left", "right", "wait", "copy", "many"]
    first = F.col("copy") == F.struct("id", "th", "place")
    marked = marked.select("id", "th", *fields[:6], (F.col("times") == 1).alias("wait"), first.alias("copy"), F.coalesce("many", F.lit(False)).alias("many"))
    closed = again.where("not open").select("id", "th", *fields[:6], *[F.lit(False).alias(x) for x in fields[6:]])
    each = closed.unionByName(marked).groupBy("id", "th").agg(F.collect_set(F.struct(*fields)).alias("at"))  # of one text, however many rows have it

    extra = [("kept", pa.binary())] if with_kept else []
    schema = pa.schema([*RESULT, *extra, ("text", pa.binary()), ("waiting", OPEN), ("own", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("many", pa.bool_()), ("kind", pa.int32())])
    ddl = RESULT_DDL + ", kept binary" * with_kept + ", text binary, waiting array<struct<place:long,own:long,a:long,b:long>>, own long, a long, b long, left int, context binary, many boolean, kind int"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: finished texts; 1: texts that wait for comparisons; 2: contexts to compare, each once in a task."""
        given: set[tuple] = set()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                out = []
                for row in whole.slice(i, 500).to_pylist():
                    text, doc = as_bytes(row["text"]), None if row["id"] == null_id else row["id"]
                    spans, waiting = [], []
                    for x in row["at"] or ():
                        a, b = x["place"] - x["left"], x["place"] + x["right"]
                        if x["wait"]:
                            waiting.append({k: x[k] for k in ("place", "own", "a", "b")})
                        else:
                            spans.append((a, b))
                        if x["copy"] and (key := (x["own"], x["a"], x["b"])) not in given:
                            given.add(key)
                            out.append({"own": x["own"], "a": x["a"], "b": x["b"], "left": x["place"] - a, "context": text[a:b], "many": x["many"], "kind": 2})
                    if waiting:
                        out.append({"doc_id": doc, "text": text, "spans": [{"start": a, "end": b} for a, b in merged(spans)], "waiting": waiting, "kind": 1})
                    else:
                        out.append(result(doc, text, spans, with_kept) | {"kind": 0})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    passed = materialise(keyed.join(each, ["id", "th"], "left").select("id", "text", "at").mapInArrow(first_pass, ddl))
    drop(again)
    drop(copied)
    contexts = passed.where("kind = 2").select("own", "a", "b", "left", "context", "many")
    n = contexts.where("not many").count()
    dealt = contexts.where("not many").select("own", "a", "b", "left", "context", F.pmod(F.xxhash64("own"), F.lit(max(1, -(-n // shard)))).alias("shard"))

    def compare(group: pa.Table) -> pa.Table:
        keys = list(zip(*[group[x].to_pylist() for x in ("own", "a", "b")]))
        rows = list(zip(group["own"].to_pylist(), group["left"].to_pylist(), group["context"].to_pylist()))
        found = [(*key, start, end) for key, backs in zip(keys, repeated(rows)) for start, end in runs(backs)]
        columns = zip(*found) if found else [[]] * 5
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["own", "a", "b", "start", "end"])

    sorted_ = dealt.groupBy("shard").applyInArrow(compare, "own long, a long, b long, start long, end long")
    # strings of the others: of each place left of the anchor, those that more than one context has, by their bytes
    whole = contexts.where("many")
    least = F.greatest(F.lit(0), LENGTH - F.length("context") + F.col("left"))
    places = whole.select("own", "a", "b", "left", "context", F.explode(F.sequence(least, F.col("left"))).alias("back"))
    strings = places.select("own", "a", "b", "back", F.substring("context", F.col("left") - F.col("back") + 1, F.lit(LENGTH)).alias("string"))
    strings = strings.withColumn("salt", F.pmod(F.col("b"), F.lit(SALTS)).cast("int"))
    common = strings.groupBy("own", "back", "string").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).where("a0 <> a1 or b0 <> b1")
    common = common.select("own", "back", "string", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counted = strings.join(common, ["own", "back", "string", "salt"]).groupBy("own", "a", "b").agg(F.collect_set("back").alias("backs"))  # 137 at most
    counted = counted.select("own", "a", "b", F.explode("backs").alias("back"))
    counted = counted.select("own", "a", "b", (-F.col("back")).cast("long").alias("start"), (LENGTH - F.col("back")).cast("long").alias("end"))
    spans = materialise(sorted_.unionByName(counted))

    waiting = passed.where("kind = 1").select("doc_id", "text", "spans", "waiting").withColumn("uid", F.monotonically_increasing_id())
    asked = waiting.select("uid", F.explode("waiting").alias("w")).select("uid", "w.*")
    told = asked.join(spans, ["own", "a", "b"]).select("uid", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("end")).alias("end"))
    told = told.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("more"))  # of one text

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = whole.slice(i, 500).to_pylist()
                out = [result(r["doc_id"], r["text"], [(x["start"], x["end"]) for x in [*r["spans"], *(r["more"] or ())]], with_kept) for r in rows]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*RESULT, *extra]))

    late = waiting.join(told, "uid", "left").select("doc_id", "text", "spans", "more").mapInArrow(second_pass, RESULT_DDL + ", kept binary" * with_kept)
    return passed.where("kind = 0").select(*late.columns).unionByName(late)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
