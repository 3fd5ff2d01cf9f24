import random
import re

import numpy as np

from veriscribe.llm import decontaminate, toxicity


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    """(doc_id, n_words, hit positions, items) of each document."""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "Cé", "d9", "e", "f", "中文"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 9, 10, 11, 30]))) for i in range(1, 12) if i != 3] + [(20, None), (21, "..."), (5, "zz a"), (None, "qq b qq")]
    items = [x for x in items if len(words(x[1])) != 1] + [(30, "single")]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 5))) for i in range(60)]
    docs += [(60, None), (61, ""), (None, items[0][1]), (1, items[1][1]), (1, items[1][1]), (62, items[2][1] * 500)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, words string, lang int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words, shard_bytes in ((10_000, 10_000), (15, 300)):
        got = decontaminate.contamination(frame, bench, block_words=block_words, shard_bytes=shard_bytes).collect()
        rows = [(r.row.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r["items"]) for r in got]
        assert sorted(rows, key=repr) == brute(docs, items)
    assert all(r.n_words >= 0 and not r.spans for r in decontaminate.contamination(frame, bench.limit(0)).collect())
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0


def test_index_finds_and_locates_every_occurrence():
    rng = random.Random(0)
    for t in range(60):
        v = rng.choice([1, 2, 5, 40])
        runs = [[rng.randint(1, v) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 12))]
        runs += runs[: t % 3]
        text = np.array([x for r in runs for x in [*r, 0]])
        index = decontaminate.FMIndex(text, v, rng.choice([1, 3, 8]))
        for n in (1, 2, 7):
            patterns = np.array([[rng.randint(1, v) for _ in range(n)] for _ in range(10)])
            for p, a, b in zip(patterns, *index.search(patterns)):
                wanted = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == wanted


def labelled(n):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        own, toxic = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))], i % 4 == 0
        for _ in range(2 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(["vilest", "awful", "Dreadful"]))
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def test_classifier_learns_and_scores_whole_texts(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows] + [(None, None, ""), (5000, "", ""), (5001, "good " * 300_000 + "awful vilest dreadful", "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(d, y, 0) for d, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fitted(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    right = [(got[d] >= 0.5) == bool(y) for d, _, y in rows]
    assert len(got) == len(rows) + 3 and np.mean(right) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[5001] > 0.5 and got[None] == got[5000] < 0.5
    empty = toxicity.fitted(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.with_score(docs, empty).collect()} == {0.0}
    assert toxicity.with_score(docs.limit(0), model).count() == 0


def test_chunks_of_a_long_text_score_alike(monkeypatch):
    rows = labelled(300)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [t for _, t, _ in rows] + [" ".join(t for _, t, _ in rows)]
    whole = model.scores(texts, toxicity.Buckets())
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    assert np.allclose(model.scores(texts, toxicity.Buckets()), whole)
