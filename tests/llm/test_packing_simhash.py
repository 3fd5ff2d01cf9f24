import random
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from veriscribe.llm import best_fit_packing as packing
from veriscribe.llm import simhash
from veriscribe.llm.common import connected_components


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, u string, length int")


def test_plan_places_every_piece():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([10, 20, 50])
        histogram = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(0, 15))}
        got: dict[int, int] = {}
        for pattern, n in packing.plan(dict(histogram), cap):
            assert n > 0 and sum(w * e for w, e in pattern) <= cap
            for w, e in pattern:
                got[w] = got.get(w, 0) + n * e
        assert got == histogram


def test_reduction_is_optimal_on_small_instances():
    rng = random.Random(2)

    def best(items, cap):
        items, out = sorted(items, reverse=True), len(items)

        def go(i, bins):
            nonlocal out
            if len(bins) >= out:
                return
            if i == len(items):
                out = len(bins)
                return
            for b in sorted({x for x in bins if x + items[i] <= cap}):
                j = bins.index(b)
                go(i + 1, bins[:j] + [b + items[i]] + bins[j + 1 :])
            go(i + 1, bins + [items[i]])

        go(0, [])
        return out

    for _ in range(60):
        cap, items = 12, [rng.randint(1, 12) for _ in range(rng.randint(1, 8))]
        counts = [items.count(w) for w in range(cap + 1)]
        fixed = packing.reduce_by_dominance(counts, cap)
        rest = [w for w, n in enumerate(counts) for _ in range(n)]
        assert sum(n for _, n in fixed) + best(rest, cap) == best(items, cap)


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path, rng = packing.default_tokenizer(), random.Random(4)
    whole, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    assert encoder.merges is not None
    texts = [None, "", "It's A test\x1c of\x85NFC é e\u0301x", "<|endoftext|> a<|startoftext|>b", "ΑΣ Σ 中文 12 x_y!!\n\n\tz", " a\u3000b\x0bc", "İstanbul ǅ ɐ Ω \u212b"]
    letters = "abcde stm'réÉßΣσ中1٣²!?-_.\u0301İǅ\x00|<>\n"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for part in (texts, ["plain words only", "and more"], [], [""]):
        ids, sizes = encoder.chunk(pa.array(part, pa.string()), 1)
        ends = np.cumsum(sizes)
        for text, a, b in zip(part, ends - sizes, ends):
            assert ids[a:b].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert encoder.merges is None
    ids, sizes = encoder.chunk(pa.array(["two  words", None]), 7)
    assert ids.tolist() == [*whole.encode("two  words", add_special_tokens=False).ids, 7, 7] and sizes.tolist() == [len(ids) - 1, 1]


def test_packing_of_rows(spark):
    from tokenizers import Tokenizer

    rows = [(i % 7, "the word " * (i * 37 % 400), "x", "y", 1) for i in range(60)] + [(None, None, None, None, None), (9, "", "", "", 0), (10, "a b c " * 9000, "", "", 0)]
    got = packing.pack(frame(spark, rows)).collect()
    used: dict[int, list] = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    assert sorted(r.length for r in got if r.doc_id == 10) == sorted([4096] * 6 + [27001 - 6 * 4096])
    assert sum(r.length for r in got if r.doc_id is None) == 1
    assert len(used) == -(-sum(r.length for r in got) // packing.LIMIT)
    assert packing.pack(frame(spark, [])).count() == 0

    # every column of a piece, from the plain tokenizer
    tokenizer, plain = Tokenizer.from_file(packing.default_tokenizer()), []
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), packing.LIMIT)):
            part = ids[start : start + packing.LIMIT]
            plain.append((str(doc), k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(plain)


def brute_print(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    for x in "\t\n\x0b\x0c\r":
        low = low.replace(x, " ")
    words = [x for x in low.split(" ") if x]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{doc_id: smallest id reachable} of {doc_id: fingerprint}."""
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n ".join(copy))
    return texts + [None, "", " \t", "x y z"]


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i, x, "clash", "u", 1) for i, x in enumerate(corpus())]
    prints = {i: brute_print(x) for i, x, *_ in rows}
    label = brute_components(prints)
    for chunk in (simhash.CHUNK, 2):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows), chunk=chunk).collect()}
        assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, [(5, "a b", "", "", 1), (5, "a b", "", "", 1), (None, "A b", "", "", 1), (None, "zz", "", "", 1)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_connect_clusters_in_any_chunks(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    wanted = brute_components({s: x for (s,), x in zip(signed, fps)})
    for chunk in (1000, 7):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), chunk=chunk)
        for a, b in edges.collect():
            assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        roots = dict(connected_components(edges).collect())
        assert {s: roots.get(s, s) for (s,) in signed} == wanted


def test_connected_components_of_a_chain(spark):
    edges = spark.range(0, 70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.root for r in connected_components(edges).collect()} == {0}
