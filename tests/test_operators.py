import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscribe.functions import layout as L
from veriscribe.functions.register import register
from veriscribe.operators import judge, layout_search, recognition, rendering
from veriscribe.sources import files
from veriscribe.streaming import judge as stream

LOG = [
    {"code_id": "a", "ratio": 1, "num_pages": 2, "text": "x\n<|end_of_box|>", "image_path": "i/a/f/page_001.png", "image_paths": ["i/a/f/page_001.png", "i/a/f/page_002.png"]},
    {"ratio": 1.5, "text": "second", "image_path": "i\\b\\f\\page_002_ratio1.5.png"},
    {"ratio": 1.5, "text": "first", "image_path": "i/b/f/page_001_ratio1.5.png"},
    {"code_id": "c", "text": "no ratio"},
    {"code_id": "c", "ratio": 1.0, "num_pages": 1, "text": "again", "image_path": "z"},
    {"code_id": "d", "ratio": 1, "text": "", "image_path": "i/d/f/p.png"},
    {"code_id": "d", "ratio": 2, "text": "t", "error": "timeout"},
    {"ratio": 1, "text": "short path", "image_path": "f/p.png"},
    {"code_id": "e", "ratio": 3, "num_pages": 1, "text": "code e"},
    {"code_id": "gone", "ratio": 1, "num_pages": 1, "text": "t"},
]
TRUTH = [{"id": "a", "code": "old"}, {"id": "a", "code": "x"}, {"id": "b", "code": "first\nsecond"}, {"id": "c", "code": "no ratio"}, {"id": "e", "code": "code e"}, {"id": "f", "code": ""}]


@pytest.fixture
def home(tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps(TRUTH))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in LOG[:5]) + "\n\n")
    (tmp_path / "log" / "b.jsonl").write_text("\n".join(json.dumps(r) for r in LOG[5:]) + "\n")
    return tmp_path


def test_log_to_summary(spark, home):
    truth = files.read_truth(spark, str(home / "truth.json"))
    assert {r.id: r.code for r in truth.collect()}["a"] == "x"  # the last of two
    cases = judge.merge_pages(judge.valid_answers(files.read_log(spark, str(home / "log")))).cache()
    assert {(r.code_id, r.ratio): (r.num_pages, r.hypothesis) for r in cases.collect()} == {
        ("a", 1.0): (2, "x"), ("b", 1.5): (2, "first\nsecond"), ("c", 1.0): (2, "no ratio\nagain"), ("e", 3.0): (1, "code e"), ("gone", 1.0): (1, "t"),
    }
    assert [r.code_id for r in judge.without_truth(cases, truth).collect()] == ["gone"]
    details = judge.score(judge.with_truth(cases, truth)).cache()
    assert details.count() == 4
    summary = {r.ratio: r for r in judge.summarise(details).collect()}
    assert set(summary) == {1.0, 1.5}  # 3 is in no list of ratios
    assert summary[1.5].avg_cer == 0 and summary[1.5].error_counts == {} and summary[1.5].error_group_counts == {"Recognition": 0, "Structure": 0, "Hallucination": 0}
    assert summary[1.0]["count"] == 2 and summary[1.0].avg_cer == round((0 + 6 / 8) / 2, 4)
    files.write_summary(judge.summarise(details), str(home / "summary"))
    assert set(json.loads(spark.read.text(str(home / "summary")).first()[0])) == {"ratio_1x", "ratio_1.5x"}
    files.write_details(details, str(home / "details"))
    assert spark.read.json(str(home / "details")).count() == 4
    assert judge.report(judge.summarise(details)).count() == 2


def test_both_shapes_of_answers(spark):
    rows = [
        ("three", 1.0, None, ["p1", "p2", "p3"], "p1", "t"),  # listed, not counted
        ("zero", 1.0, 0, ["p1", "p2"], "p1", "t"),
        ("counted", 1.0, 5, ["p1"], "p1", "t"),
        ("legacy", 1.0, 7, None, "x/legacy/d/p1", "t"),  # counted, not listed
        ("empty", 1.0, 7, [], "p1", "t"),
        ("twice", 1.0, 2, ["p1", "p2"], "p1", "one"),
        ("twice", 1.0, 2, ["p1", "p2"], "p2", "two"),
    ]
    log = spark.createDataFrame([(*r, None) for r in rows], "code_id string, ratio double, num_pages int, image_paths array<string>, image_path string, text string, error string")
    got = {r.code_id: (r.num_pages, r.hypothesis) for r in judge.merge_pages(judge.valid_answers(log)).collect()}
    assert got == {"three": (3, "t"), "zero": (2, "t"), "counted": (5, "t"), "legacy": (1, "t"), "empty": (1, "t"), "twice": (2, "one\ntwo")}
    cases = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "code_id string, ratio double")
    done = spark.createDataFrame([("a", None), ("b", 1.0)], "code_id string, ratio double")
    assert [r.code_id for r in judge.pending(cases, done).collect()] == ["a"]  # a row without a ratio says nothing


def test_malformed_lines_and_resume(spark, home):
    (home / "log" / "c.jsonl").write_text('{"code_id": "q", "ratio": 1, "error": "x"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_log(spark, str(home / "log")).collect()
    done = files.read_done(spark, str(home / "log"))
    cases = spark.createDataFrame([("q", 1.0), ("q", 2.0), ("a", 1.0), ("new", 1.0)], "code_id string, ratio double")
    assert sorted(map(tuple, judge.pending(cases, done).collect())) == [("new", 1.0), ("q", 2.0)]  # failed ones are not tried again
    assert files.read_done(spark, str(home / "none")).count() == 0
    assert files.first_existing(spark, [str(home / "none"), str(home / "truth.json")]).endswith("truth.json")


def test_stream_equals_batch(spark, home):
    truth = files.read_truth(spark, str(home / "truth.json"))
    stream.start_details(stream.read_log_stream(spark, str(home / "log"), 1), truth, str(home / "out"), str(home / "c1")).awaitTermination()
    got = {(r.code_id, r.ratio, round(r.cer, 6)) for r in spark.read.parquet(str(home / "out")).collect()}
    answers = judge.valid_answers(files.read_log(spark, str(home / "log"))).withColumn("hypothesis", F.col("text"))
    assert got == {(r.code_id, r.ratio, round(r.cer, 6)) for r in judge.score(judge.with_truth(answers.select("code_id", "ratio", "hypothesis"), truth)).collect()}
    stream.start_summary(stream.read_log_stream(spark, str(home / "log"), 1), truth, str(home / "s"), str(home / "c2")).awaitTermination()
    assert {r.ratio: r["count"] for r in spark.read.parquet(str(home / "s")).collect()} == {1.0: 3, 1.5: 2}


def test_rollup_counts_groups(spark):
    flags = {n: 0 for n in judge.TAXONOMY} | {"Visual_Typo": 1, "Symbol_Loss": 1, "Repetition": 1}
    details = spark.createDataFrame([(1.0, flags)], "ratio double, taxonomy_labels struct<" + ",".join(f"{n}:int" for n in judge.TAXONOMY) + ">")
    rows = {(r.error_group, r.error): r.n for r in judge.error_rollup(details).collect()}
    assert rows["Recognition", None] == 2 and rows["Structure", "Repetition"] == 1 and rows["Hallucination", None] == 0


def closest(target, sizes):
    rows = sorted(((abs(L.image_tokens_of(r) - target), r, L.image_tokens_of(r)) for r in sizes), key=lambda x: x[0])
    near = [x for x in rows if x[0] <= rows[0][0] * 1.2]
    tokens = [x[2] for x in near]
    return max(x[1] for x in near) if len(near) > 1 and max(tokens) <= min(tokens) * 1.4 else rows[0][1]


def plain_plan(tokens, images, ratios):
    sizes, done = layout_search.ALL_RESOLUTIONS, []
    for ratio in sorted(ratios):
        each = tokens / ratio / images
        ideal = max(224, min(4480, int(math.sqrt(each * 1024)) // 16 * 16))
        t, tok = closest(each, sizes), L.image_tokens_of
        up = [r for r in sizes if r > ideal]
        if ratio <= 1.5 and up and tok(up[0]) <= each * 1.4:
            t = up[0]
        if ideal in sizes and abs(tok(ideal) - each) < abs(tok(t) - each) and (ratio > 1.5 or ideal > t):
            t = ideal
        if t in done:
            up, low = [r for r in sizes if r > max(done)], [r for r in sizes if r < min(done)]
            t = (up[0] if up else low[-1] if low and ratio == 2 else t) if ratio <= 2 else (low[-1] if low else t)
        for c in done:
            low = [r for r in sizes if r < c]
            t = low[-1] if t >= c and low else t
        done.append(t)
    return done


def test_plans_equal_plain_ones(spark):
    rows = [(t, n) for t in (1, 40, 99, 800, 3000, 8000, 40_000, 900_000) for n in (1, 3, 12)]
    df = spark.createDataFrame(rows, "t int, n int")
    got = df.select("t", "n", layout_search.compression_plan(F.col("t"), F.col("n"), L.COMPRESSION_RATIOS).alias("p")).collect()
    for r in got:
        assert [x.resolution for x in r.p] == plain_plan(r.t, r.n, L.COMPRESSION_RATIOS), (r.t, r.n)
    for r in df.select("t", "n", layout_search.dynamic_plan(F.col("t"), F.col("n"), F.lit(2240), L.COMPRESSION_RATIOS).alias("p")).collect():
        used, before = [2240], 2240
        for x in r.p[1:]:
            each = r.t / x.ratio / r.n
            t = closest(each, layout_search.ALL_RESOLUTIONS)
            if t in used or t > before:
                free = [s for s in layout_search.ALL_RESOLUTIONS if s not in used]
                low = [s for s in free if s <= before]
                t = max([s for s in low if s <= t] or low) if low else min(free, key=lambda s: abs(L.image_tokens_of(s) - each))
            assert x.resolution == t
            used.append(t)
            before = t


def test_largest_font_fills_the_pages(spark):
    df = spark.createDataFrame([([10] * 50,), ([500] * 400,), ([0],)], "l array<int>")
    for r in df.select("l", layout_search.largest_font(F.col("l"), F.lit(1024), F.lit(2)).alias("f")).collect():
        room = 1024 - 2 * 1024 * 0.01
        pages = lambda f: max(1, math.ceil(sum(max(1, math.ceil(n / max(1, int(room / (f * 0.6))))) for n in r.l) / max(1, int(room / f))))
        assert r.f == 4 or pages(r.f) <= 2
        assert r.f == 150 or pages(r.f + 1) > 2


def plain_pages(tokens, resolution, font):
    room = resolution - 2 * (resolution * 0.01)
    across, down, chars = max(1, int(room / (font * 0.6))), max(1, int(room / font)), tokens * 3.5
    return max(1, math.ceil((chars * 1.3 + chars / 50 * (across * 0.3)) / (across * down)))


def plain_search(tokens, ratio, used):
    strict, relaxed, target = [], [], tokens / ratio
    for r in [112 * i for i in (20, 16, 12, 8, 4, 2, 1)]:
        each, least = L.image_tokens_of(r), plain_pages(tokens, r, 4)
        ok = (lambda n: n * each <= target * 1.25) if least * each <= target * 1.25 else lambda n: n <= least
        font = max(f for f in range(4, 151) if ok(plain_pages(tokens, r, f)))
        n = plain_pages(tokens, r, font)
        (strict if least * each <= target * 1.25 else relaxed).append((r, n, font, n * each))
    new = lambda rows: [x for x in rows if x[:2] not in used]
    if strict:
        return max(new(strict) or strict, key=lambda x: x[0] * 1000 + x[2])
    order = lambda x: (x[3], -x[2], -x[0])
    best = min(relaxed, key=order)
    other = min(new(relaxed), key=order, default=best)
    return other if other[3] <= best[3] * 1.1 else best


def test_exhaustive_search_equals_a_plain_one(spark):
    some = [[], [(2240, 1)], [(112, 1)], [(112, 1), (224, 1), (448, 1)], [(896, 1), (112, 3), (112, 5), (112, 12)]]
    some.append([(112 * i, n) for i in (1, 2, 4, 8, 12, 16, 20) for n in range(1, 200)])
    rows = [(i, t, r, u) for i, (t, r, u) in enumerate((t, r, u) for t in (0, 1, 7, 13, 40, 99, 157, 400, 1555, 6000, 90_000, 2_000_000) for r in (0.5, 1.0, 4.0, 40.0) for u in some)]
    df = spark.createDataFrame(rows, "id int, text_tokens int, compression_ratio double, used array<struct<resolution:int,pages:int>>")
    got = {r.id: tuple(r)[1:] for r in layout_search.exhaustive(df, "id").collect()}
    plain = {r.id: tuple(r)[1:] for r in layout_search.exhaustive(df.drop("used"), "id").collect()}
    for i, t, r, used in rows:
        assert got[i] == plain_search(t, r, used), (t, r, used)
        assert plain[i] == plain_search(t, r, []), (t, r)
    assert {x[0] for x in plain.values()} >= {112, 2240} and {x[2] for x in plain.values()} & set(range(61, 151))


def test_pages_and_images(spark, tmp_path):
    docs = spark.createDataFrame([("a", "word " * 600 + "\n\nend"), ("b", ""), ("c", None)], "code_id string, text string")
    pages = rendering.paginate(docs, 256, 12)
    rows = {(r.code_id, r.page_num): r.page_rows for r in pages.collect()}
    assert "".join("".join(x) for (c, _), x in sorted(rows.items()) if c == "a") == "word " * 600 + "end" and rows["b", 1] == [""]
    images = rendering.degrade(layout_search.fan_out(rendering.render(pages, 256, 12), [1.0, 1.5, 4.0])).cache()
    files.export_images(images, str(tmp_path))
    found = files.read_images(spark, str(tmp_path))
    assert {(r.code_id, r.page_num, r.ratio, r.width, r.highlighted) for r in found.collect()} == {(c, n, x, 256, True) for c, n in rows for x in (1.0, 1.5, 4.0)}
    assert judge.group_pages(found.select("path")).where("size(page_paths) > 1").count() == 3
    assert images.select(rendering.png_size(F.col("content")).alias("s")).where("s.width <> 256 or s.height <> 256").count() == 0
    sharp, blurred = (rendering.pixels(bytes(r.content)) for r in images.where("path like 'a/%page_001%' and ratio in (1.0, 4.0)").orderBy("ratio").collect())
    assert np.abs(np.diff(sharp.astype(int), axis=1)).mean() > 2 * np.abs(np.diff(blurred.astype(int), axis=1)).mean()
    assert (rendering.pixels(rendering.png(sharp)) == sharp).all()
    some = images.where("ratio = 1.0").select("path", "content")
    assert {r.tokens for r in rendering.processor_tokens(some).collect()} == {270}
    assert {r.tokens for r in rendering.processor_tokens(some, lambda: lambda content: {"grid": (4, 5)}).collect()} == {20}
    assert L.modes([4, 1.5]) == ["text_only", "image", "image_ratio1.5", "image_ratio4"]
    page = np.full((50, 60, 3), 255, np.uint8)
    page[20:25, 30:40] = 0
    assert rendering.cropped(page, 10).shape == (15, 20, 3) and rendering.cropped(page[:10]).shape == (10, 60, 3)
    assert rendering.resized(sharp, 112, 112, lobes=3).shape == (112, 112, 3)
    tokens = spark.createDataFrame([("def f(): return 'x'  # c",)], "t string").select(rendering.highlight("python")("t").alias("h")).first().h
    assert "".join(t.text for t in tokens) == "def f(): return 'x'  # c" and {t.text: t.color for t in tokens}["def"] == "#0000FF"


def test_pages_are_drawn_in_the_colours_of_their_tokens(spark):
    text = "# note — one\r\ndef f():\n\treturn 'long string' * 12  # end…\rx"
    docs = spark.createDataFrame([("a", text), ("b", "\ufeffdef f"), ("c", None)], "code_id string, text string")
    pages = rendering.paginate(docs, 256, 12)
    rows = {r.code_id: (r.page_rows, r.page_colours) for r in pages.collect()}
    assert all([len(x) for x in a] == [len(x) for x in b] for a, b in rows.values())
    ink = lambda c, word: {k for r, p in zip(*rows[c]) for k in ([rendering.PALETTE[ord(x) - 97] for x in p[r.index(word) :][: len(word)]] if word in r else [])}
    assert ink("a", "# note") == ink("a", "one") == {"#008000"} and ink("a", "def") == ink("a", "return") == ink("b", "def") == {"#0000FF"}
    assert ink("a", "'long") == {"#A31515"} and ink("a", "12") == {"#098658"}
    image = rendering.pixels(bytes(rendering.render(pages.where("code_id = 'a'"), 256, 12).first().content))
    assert {tuple(x) for x in image.reshape(-1, 3).tolist()} >= {(0, 0x80, 0), (0, 0, 0xFF), (0xA3, 0x15, 0x15), (9, 0x86, 0x58), (0, 0, 0)}


def test_resizing_weighs_only_pixels_in_reach(spark, monkeypatch):
    """Sums over few pixels equal sums over all, and a page is read once for all its ratios."""
    image = np.random.default_rng(3).integers(0, 256, (37, 53, 3)).astype(np.uint8)

    def dense(old, new, lobes):
        scale = old / new
        x = (np.arange(old)[None, :] - ((np.arange(new) + 0.5) * scale - 0.5)[:, None]) / max(1.0, scale)
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0) if lobes else np.maximum(0, 1 - np.abs(x))
        return w / w.sum(axis=1, keepdims=True)

    for lobes in (0, 3):
        for width, height in ((20, 91), (53, 37), (1, 1), (160, 5)):
            wanted = np.einsum("yh,hwc,xw->yxc", dense(37, height, lobes), image.astype(float), dense(53, width, lobes))
            assert np.abs(rendering.resized(image, width, height, lobes) - np.clip(wanted, 0, 255)).max() <= 0.5 + 1e-6
    sums, real = [], np.tensordot
    monkeypatch.setattr(np, "tensordot", lambda *a, **k: sums.append(1) or real(*a, **k))
    rendering.resized(image, 20, 20)
    assert not sums  # no product with a whole matrix of weights
    page, other = rendering.png(image), rendering.png(255 - image)
    rows = [("a.png", x, c) for c in (page, other, b"none") for x in (1.0, 2.0, 4.0)]
    found = rendering.degrade(spark.createDataFrame(rows, "path string, ratio double, content binary").coalesce(1)).collect()
    for (_, x, c), r in zip(rows, found):
        wanted = c if x == 1 else None if c == b"none" else rendering.png(rendering.degraded(rendering.pixels(c), x))
        assert (None if r.content is None else bytes(r.content)) == wanted


def test_pages_are_degraded_by_their_different_channels_and_inked_rows(spark, monkeypatch, tmp_path):
    """Equal channels are resized once, blank rows not at all, and the result is that of whole images; small tables go to all cores."""
    from veriscribe.plans import registry

    def dense(old, new):
        scale = old / new
        x = (np.arange(old)[None, :] - ((np.arange(new) + 0.5) * scale - 0.5)[:, None]) / max(1.0, scale)
        w = np.maximum(0, 1 - np.abs(x))
        return w / w.sum(axis=1, keepdims=True)

    def plain(image, width, height):
        return np.einsum("yh,hwc,xw->yxc", dense(image.shape[0], height), image.astype(float), dense(image.shape[1], width))

    black, blue = (rendering.drawn_planes(["ab c", "", "de"], 96, 12, colours=[c * 4, "", c * 2]) for c in "ab")
    assert (len(black.each), black.rgb, len(blue.each), blue.rgb) == (1, (0, 0, 0), 2, (0, 0, 1)) and 0 < black.end == blue.end < 60
    made, real = [], rendering.scaled
    monkeypatch.setattr(rendering, "scaled", lambda rows, at, w: made.append(len(at)) or real(rows, at, w))
    for page, n in ((black, 1), (blue, 2)):
        image = page.image()
        for x in (1.5, 2.0, 6.0):
            made.clear()
            found = rendering.degraded_planes(page, x)
            assert len(made) == 4 * n and found.end < 96 and made[0] < int(96 / x) and (rendering.pixels(rendering.packed(found)) == found.image()).all()
            small = rendering.resized(image, int(96 / x), int(96 / x))
            assert np.abs(small - plain(image, int(96 / x), int(96 / x))).max() <= 0.5 + 1e-6
            assert np.abs(found.image() - plain(small, 96, 96)).max() <= 0.5 + 1e-6
        for sharp in (True, False):
            content = rendering.packed(page, sharp)
            assert (rendering.pixels(content) == image).all() and content[25] == (0 if n == 1 else 2)  # grey or RGB
    rows = np.random.default_rng(5).integers(0, 256, (6, 13)).astype(np.uint8)
    rows[:, 0] = [1, 2, 2, 0, 4, 2]
    wanted = np.zeros((6, 4, 3), np.uint8)
    for y in range(6):
        for x in range(4):
            for c in range(3):
                a, b, d = (int(v) for v in (wanted[y, x - 1, c] if x else 0, wanted[y - 1, x, c] if y else 0, wanted[y - 1, x - 1, c] if x and y else 0))
                near = min((a, b, d), key=lambda v: abs(a + b - d - v))
                wanted[y, x, c] = (int(rows[y, 1 + 3 * x + c]) + (0, a, b, 0, near)[rows[y, 0]]) % 256
    head, data = struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0), zlib.compress(rows.tobytes())
    chunks = b"".join(struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v)) for k, v in ((b"IHDR", head), (b"IDAT", data), (b"IEND", b"")))
    assert (rendering.pixels(b"\x89PNG\r\n\x1a\n" + chunks) == wanted).all()
    text = "# note\n\ndef f(): return 'é'\r\n" * 30
    pages = rendering.paginate(spark.createDataFrame([("a", text), ("b", "word"), ("c", None)], "code_id string, text string"), 256, 12)
    ratios = [1.0, 1.5, 16.0]
    apart = {r.path: r for r in rendering.degrade(layout_search.fan_out(rendering.render(pages, 256, 12), ratios)).collect()}
    at_once = rendering.render_degraded(pages, ratios, 256, 12)
    assert at_once._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1  # no images go from one task to another
    rows = at_once.collect()
    assert len(rows) == len(apart) == 3 * pages.count() > 9 and {r.path for r in rows} == set(apart)
    assert all(r.ratio == apart[r.path].ratio and (rendering.pixels(bytes(r.content)) == rendering.pixels(bytes(apart[r.path].content))).all() for r in rows)
    spark.createDataFrame([(i, "x") for i in range(9)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.q_degraded_pages(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rendering_queries_read_whole_documents(spark, tmp_path):
    from veriscribe.plans import registry

    texts = ["x = 1\n" * 60, "def g(): pass", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = registry.q_highlight(spark, str(tmp_path)).orderBy("pos").collect()
    assert ["".join(t.text for t in tokens if t.doc_id == i) for i in (0, 1)] == texts[:2]
    found = registry.q_degraded_pages(spark, str(tmp_path)).collect()
    assert {(r.ratio, r.path.split("_ratio")[0], r.width) for r in found} == {(x, f"{p}.png"[:-4], 1024) for x in L.RATIOS for p in ("0/1024x1024_hl_nl/page_001", "0/1024x1024_hl_nl/page_002", "1/1024x1024_hl_nl/page_001", "2/1024x1024_hl_nl/page_001")}


def test_recognition_retries_and_reports(spark):
    calls = []

    def failing():
        calls.append(1)
        raise RuntimeError("no")

    waits = []
    assert recognition.with_retries(failing, recognition.Options(), waits.append) == (None, "RuntimeError: no")
    assert len(calls) == 5 and waits == [1, 2, 4, 8]
    cases = spark.createDataFrame([("a", 1.0, ["p1", "p2"], [b"1", b"22"]), ("b", 2.0, ["p"], [b"333"])], "code_id string, ratio double, page_paths array<string>, contents array<binary>")
    got = {r.code_id: r for r in recognition.recognise(cases, recognition.echo_client()).collect()}
    assert got["a"].text == "1 bytes" and got["a"].num_pages == 2 and got["b"].usage == {"pages": "1"} and got["b"].error is None
    response = '{"id": "r", "choices": [{"finish_reason": "safety", "message": {}}], "usage": {"n": 3}}'
    row = spark.createDataFrame([(response, 'I say ["Repetition"] so', "none")], "r string, a string, b string").select(*[v.alias(k) for k, v in recognition.diagnostics(F.col("r")).items()], recognition.kinds_in(F.col("a")).alias("x"), recognition.kinds_in(F.col("b")).alias("y")).first()
    assert (row.response_id, row.blocked_by_safety, row.usage, row.x, row.y) == ("r", True, {"n": "3"}, ["Repetition"], [])


def test_keys_and_flags(tmp_path):
    (tmp_path / ".env").write_text("# KEY=a\n\nKEY=\nKEY = 'secret'\n")
    assert files.key_from_env_files("KEY", [str(tmp_path / "none"), str(tmp_path / ".env")]) == "secret"
    assert files.flag("ON") and not files.flag("0") and files.flag(None, True) and not files.flag("on", on=("1",))


def test_miner_array_and_status(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_mined(spark, lambda: [])
    rows = files.read_mined(spark, lambda: [{"id": "b", "code": "x = 'é'\n"}, {"id": "a", "code": "y"}, {"id": "c", "code": None}])
    files.write_truth_array(rows, str(tmp_path / "array"))
    assert {(r.id, r.code) for r in files.read_truth(spark, str(tmp_path / "array")).collect()} == {("a", "y"), ("b", "x = 'é'\n"), ("c", None)}
    files.write_truth_array(rows.where("false"), str(tmp_path / "none"))
    assert files.read_truth(spark, str(tmp_path / "none")).count() == 0
    log = spark.createDataFrame([("a", 1.0, None, "p1"), ("b", 1.0, "late", "p2"), ("c", 2.0, None, "")], "code_id string, ratio double, error string, image_path string")
    cases = spark.createDataFrame([("d", 2.0), ("e", 1.0), ("a", 1.0)], "code_id string, ratio double")
    done = spark.createDataFrame([("d", 2.0), ("d", 2.0), ("e", None)], "code_id string, ratio double")
    assert judge.status_counts(log, cases, done).first().asDict() == {"ok": 2, "skipped": 1, "error": 1}
    assert judge.status_counts(log.limit(0), cases.limit(0), done).first().asDict() == {"ok": 0, "skipped": 0, "error": 0}
    images = spark.createDataFrame([("p1",), ("p3",), ("",)], "path string")
    assert {r.path for r in judge.pending_pages(images, log).collect()} == {"p3", ""}
    assert [tuple(r) for r in judge.in_order(cases).collect()] == [("a", 1.0), ("d", 2.0), ("e", 1.0)]


def test_table_functions(spark):
    register(spark)
    texts = spark.createDataFrame([(1, "abcdefg\n\nxy"), (2, ""), (3, "a\nb\nc\nd\ne")], "id int, x string")
    texts.createOrReplaceTempView("texts_of_pages")
    got = sorted(map(tuple, spark.sql("SELECT id, page, page_rows FROM texts_of_pages, LATERAL text_pages(x, 3, 2)").collect()))
    assert got == [(1, 1, ["abc", "def"]), (1, 2, ["g", ""]), (1, 3, ["xy"]), (2, 1, [""]), (3, 1, ["a", "b"]), (3, 2, ["c", "d"]), (3, 3, ["e"])]
    texts = spark.createDataFrame([(t, t, 1, 1, 1.0, 1.0) for t in (30, 700, 4000)], "id int, text_tokens int, num_lines int, max_line_chars int, avg_line_chars double, compression_ratio double")
    want = {(r.id, r.resolution, r.pages, r.tokens) for r in layout_search.candidates(texts).collect()}
    texts.createOrReplaceTempView("targets")
    found = {tuple(r) for r in spark.sql("SELECT id, resolution, pages, tokens FROM targets, LATERAL layout_sizes(CAST(text_tokens AS DOUBLE))").collect()}
    assert found >= want and found
