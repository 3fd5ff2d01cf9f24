"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Packing is decided on a histogram of piece lengths, which has at most as many entries as a sequence has
tokens, whatever the size of the corpus. Reduction takes the longest piece left and looks for a partner
that provably makes every other way of filling its sequence no better: nothing else fits; the partner
fills the sequence exactly; or no two (or, if no three fit, no pair of) other pieces that fit beside it
are longer than the partner. Such sequences are fixed for good and the instance shrinks; what is left is packed best-fit, longest first.
Sequences of the same make-up are one entry with a count, so the plan stays small.

Each piece then gets its place from its rank among the pieces of its length: a rank within the task that
made it plus an offset per task, so no length is gathered in one task.

Null and empty texts give one piece of the end token. Texts of any length are encoded whole; only what holds more
tokens than a sequence is cut. Repeated rows, and rows that share an id or have none, are packed one by one; pieces of one length take
their places in an order that no one can rely on. An empty table gives no rows. Only doc_id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscribe.llm.common import materialise, table

LIMIT = 4096
END_ID = 1
#: Bytes of text whose words are numbered at once.
CHUNK = 8_000_000
#: Runs of what is no white space to the tokenizer; the first byte of characters from U+0240 on, which normalising may compose.
WORDS = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
BEYOND_LATIN = 0xC9


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts, by way of their distinct words, under a tokenizer that drops white space.

    Words are split and numbered by Arrow, and only the distinct ones of a chunk of texts are encoded, all in one
    call: normalised and cut into parts as the tokenizer says, the parts then merged by a byte-pair encoder over
    the same vocabulary, in which a blank stands for the end-of-word mark. The texts' ids are looked up from those
    of their words. Words that may hold a special token go to the tokenizer itself. Where the file's tokenizer is of
    another kind, or a probe shows a difference, whole texts go to it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self._encoding(json.loads(self.tokenizer.to_str()))
        if self.merges is not None:
            probe = "It's  a T\u00e9st\n12x!? (of words),\u3000don't unbelievable 1999's \u4e2d\u6587"
            if self.chunk(pa.array([probe]))[0].tolist() != self._whole(probe).tolist():
                self.merges = None

    def _encoding(self, spec: dict):
        """A byte-pair encoder with the same merges; None if the tokenizer is not of the kind that it needs."""
        import regex
        import tiktoken

        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        steps = cut.get("pretokenizers") or [cut]
        mark, vocabulary = model.get("end_of_word_suffix"), model.get("vocab") or {}
        alone = model.get("type") == "BPE" and mark and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        known = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        if not alone or not known or "Regex" not in steps[0]["pattern"] or steps[1].get("add_prefix_space") or steps[1].get("use_regex", True):
            return None
        letters, ranks = byte_alphabet(), {}
        for token, rank in vocabulary.items():
            body = token.removesuffix(mark)
            if not all(x in letters for x in body):
                return None
            ranks[bytes(letters[x] for x in body) + b" " * (token != body)] = rank
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        first = len(vocabulary) - len(pairs)
        if any(vocabulary.get(a + b) != first + k for k, (a, b) in enumerate(pairs)) or len(ranks) != len(vocabulary) or any(bytes([x]) not in ranks for x in range(256)):
            return None
        self.cut = regex.compile(steps[0]["pattern"]["Regex"])
        self.line = ranks[b"\n"]
        return tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _latin(self, words: list[str]) -> str:
        """Each word's parts with a blank after each, and a line feed after each word; for letters that have no other composed form."""
        return self.cut.sub(r"\g<0> ", "\n".join(words).lower()) + "\n"

    def _any(self, words: list[str]) -> str:
        """The same for all words, as the tokenizer itself normalises and cuts them."""
        out, at = [], 0
        text = self.tokenizer.normalizer.normalize_str(" ".join(words))
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            if a > at:
                out.append("\n")
            out += [text[a:b], " "]
            at = b
        return "".join(out) + "\n"

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has. Words hold no white space; an empty one has no ids."""
        words = pa.concat_arrays([words])  # with offsets from 0
        begin = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        far = np.flatnonzero(np.frombuffer(words.buffers()[2] or b"", np.uint8)[: begin[-1] if len(begin) else 0] >= BEYOND_LATIN)
        kind = np.where(np.diff(begin) > 0, 0, 3)
        kind[np.searchsorted(begin, far, "right") - 1] = 1
        for x in self.special:
            kind[pc.match_substring(words, x).to_numpy(zero_copy_only=False)] = 2
        ids, owner = [], []
        for k, text_of in enumerate((self._latin, self._any)):
            own = np.flatnonzero(kind == k)
            if len(own):
                text = text_of(words.take(pa.array(own)).to_pylist())
                found = self.merges.encode_to_numpy(text, disallowed_special=())
                end = np.flatnonzero(found == self.line)
                if len(end) != len(own):
                    raise ArithmeticError("words and their encodings don't match")
                ids.append(np.delete(found, end))
                owner.append(np.repeat(own, np.diff(end, prepend=-1) - 1))
        for k in np.flatnonzero(kind == 2).tolist():
            ids.append(self._whole(words[k].as_py()))
            owner.append(np.full(len(ids[-1]), k))
        if not ids:
            return np.empty(0, np.uint32), np.zeros(len(words), np.int64)
        owner = np.concatenate(owner)
        ids = np.concatenate(ids)
        if len(np.unique(kind[kind < 3])) > 1:
            ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=len(words))

    def chunk(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each text's with end_id after them, and how many each has."""
        texts = pc.fill_null(texts, "")
        end = [] if end_id is None else [end_id]
        if self.merges is None:
            found = [np.r_[self._whole(x), np.array(end, np.uint32)].astype(np.uint32) for x in texts.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        # Arrow also splits at these four, which the tokenizer takes as symbols
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            lists = pa.array([WORDS.findall(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        flat, sizes = self.words(coded.dictionary)
        code, last = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
        if end:  # as one more word of each text
            code = np.insert(code, last, len(sizes))
            last = last + np.arange(1, len(last) + 1)
            flat, sizes = np.r_[flat, np.array(end, np.uint32)], np.r_[sizes, 1]
        places = 4 * np.r_[0, np.cumsum(sizes)]
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(flat)])
        taken = known.take(pa.array(code))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(code) + 1] // 4
        return np.frombuffer(taken.buffers()[2], np.uint32)[: ends[-1]] if len(code) else np.empty(0, np.uint32), np.diff(np.r_[0, ends[last]])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """A worker keeps its encoder from task to task."""
    return WordEncoder(path)


def chunks(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with CHUNK bytes of text in column `at` or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)
    ends, first = np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, "right")))
        yield batch.slice(first, last - first)
        first = last


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]) of every document's pieces.

    rank counts the pieces of one length that the same task made.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for whole in batches:
            for batch in chunks(whole, 1):
                ids, sizes = encoder.chunk(batch.column(1), end_id)
                ids = ids.astype("<u4")
                number = -(-sizes // limit)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * limit
                length = np.minimum(sizes[row] - start, limit)
                first = (np.cumsum(sizes) - sizes)[row] + start
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                order = np.argsort(length, kind="stable")
                own = length[order]
                rank = np.empty(len(own), np.int64)
                rank[order] = seen[own] + np.arange(len(own)) - np.searchsorted(own, own)
                seen += np.bincount(length, minlength=limit + 1)
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                columns += [pa.array(np.full(len(row), task, np.int32)), pa.array(rank)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, ddl)


def reduce_by_dominance(counts: list[int], cap: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Take out of counts (pieces by length) what can be fixed for good: [(((length, number), ...), sequences)]."""
    fixed, available = [], sum(1 << w for w in range(1, cap + 1) if counts[w])

    def take(w: int, n: int) -> None:
        nonlocal available
        counts[w] -= n
        if not counts[w]:
            available &= ~(1 << w)

    def smallest(k: int, own: int) -> list[int]:
        """The k shortest pieces left beside one of length own."""
        out: list[int] = []
        rest = available
        while rest and len(out) < k:
            w = (rest & -rest).bit_length() - 1
            out += [w] * min(k - len(out), counts[w] - (w == own))
            rest &= rest - 1
        return out

    def best_pair(room: int, own: int) -> int:
        """The greatest sum, room at most, of two pieces beside one of length own."""
        best, rest = 0, available & ((1 << room) - 1)
        while rest:
            a = rest.bit_length() - 1
            rest ^= 1 << a
            if counts[a] - (a == own) < 1:
                continue
            under = available & ((1 << (min(a, room - a) + 1)) - 1)
            while under:
                b = under.bit_length() - 1
                if counts[b] - (b == own) - (a == b) >= 1:
                    best = max(best, a + b)
                    break
                under ^= 1 << b
            if 2 * a <= best:
                break
        return best

    for j in range(cap, 0, -1):
        while counts[j]:
            room = cap - j
            fit = available & ((1 << (room + 1)) - 1)
            if j <= room and counts[j] < 2:
                fit &= ~(1 << j)
            if not fit:
                fixed.append((((j, 1),), n := counts[j] if j > room else 1))
                take(j, n)
                continue
            k = fit.bit_length() - 1
            low = smallest(3, j)
            dominates = k == room or len(low) < 2 or low[0] + low[1] > room
            if not dominates and (len(low) < 3 or sum(low) > room):
                dominates = best_pair(room, j) <= k
            if not dominates:
                break
            if k == j:
                n = counts[j] // 2
                fixed.append((((j, 2),), n))
                take(j, 2 * n)
            else:
                n = min(counts[j], counts[k]) if k == room or low[0] + low[-1] > room else 1
                fixed.append((((j, 1), (k, 1)), n))
                take(j, n)
                take(k, n)
    return fixed


def best_fit(counts: list[int], cap: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Pack what reduction left, longest first, each piece where it leaves the least room."""
    open_: dict[int, list[list]] = {}
    rooms = 0

    def put(room: int, pattern: tuple, n: int) -> None:
        nonlocal rooms
        for x in open_.setdefault(room, []):
            if x[0] == pattern:
                x[1] += n
                return
        open_[room].append([pattern, n])
        rooms |= 1 << room

    for w in range(cap, 0, -1):
        left = counts[w]
        while left:
            above = rooms >> w
            if not above:
                each = min(cap // w, left)
                n = left // each
                put(cap - each * w, ((w, each),), n)
                left -= each * n
                continue
            room = w + (above & -above).bit_length() - 1
            entry = open_[room][-1]
            each = min(room // w, left)
            n = min(entry[1], left // each)
            pattern = entry[0]
            entry[1] -= n
            if not entry[1]:
                open_[room].pop()
                if not open_[room]:
                    rooms &= ~(1 << room)
            put(room - each * w, (*pattern, (w, each)), n)
            left -= each * n
        counts[w] = 0
    return [(p, n) for entries in open_.values() for p, n in entries]


def plan(histogram: dict[int, int], cap: int = LIMIT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(make-up, sequences)] that hold every piece of the histogram {length: pieces}."""
    counts = [0] * (cap + 1)
    for w, n in histogram.items():
        counts[w] = n
    return reduce_by_dominance(counts, cap) + best_fit(counts, cap)


def places(packing: list, cap: int = LIMIT) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and rank."""
    rows, used, sequence = [], np.zeros(cap + 1, np.int64), 0
    for pattern, n in packing:
        offset = 0
        for w, each in pattern:
            rows.append((w, used[w], each, sequence, offset))
            used[w] += each * n
            offset += w * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece, with its place."""
    spark = docs.sparkSession
    made = materialise(pieces(docs, tokenizer or default_tokenizer(), limit, end_id, with_ids))
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # limit rows at most
    where = places(plan(histogram, limit), limit)
    lookup = spark.sparkContext.broadcast(where)  # bounded by the limit, not by the corpus
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = made.join(by_task.select("length", "task", before.alias("before")), ["length", "task"])
    extra = ["ids"] if with_ids else []
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("at"), *extra)
    top = int(max(histogram.values(), default=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lookup.value
        keys = rows[:, 0] * top + rows[:, 1]
        for batch in batches:
            length, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            found = rows[np.searchsorted(keys, length * top + at, "right") - 1]
            step = at - found[:, 1]
            sequence, offset = found[:, 3] + step // found[:, 2], found[:, 4] + step % found[:, 2] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return ranked.mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
