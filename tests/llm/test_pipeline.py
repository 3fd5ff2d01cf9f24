import corpus_pipeline
from veriscribe.llm import registry


def write(spark, path, documents, labels, benchmark):
    for name, rows, ddl in (("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")


def test_stages_take_effect(spark, tmp_path):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    docs = [(i, words(i, 60) + (" vile brute" if i % 4 == 0 else ""), "en", "s", 0) for i in range(200)]
    docs += [(301, words(1, 60), "en", "s", 0), (302, words(2, 59) + " W2X59", "en", "s", 0)]  # copies of 1 and 2
    docs += [(303, words(3000, 30) + " " + words(9000, 12), "en", "s", 0), (304, words(4000, 30) + " write to a.b@c.de now", "en", "s", 0)]
    docs += [(None, words(5000, 20), None, None, None), (None, words(6000, 20), None, None, None), (305, None, None, None, None), (306, "", "", "", 0)]
    write(spark, str(tmp_path), docs, [(i, 1, int(i % 4 == 0)) for i in range(200)], [(1, words(9000, 12))])
    kept = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = out.collect()
        kept = spark.createDataFrame(rows, out.schema)
        seen[name] = {(r.doc_id, r.text) for r in rows}
    ids = {k: {d for d, _ in v} for k, v in seen.items()}
    assert len([i for i in range(0, 200, 4) if i in ids["toxicity"]]) < 5 and len([i for i in range(200) if i % 4 and i in ids["toxicity"]]) > 140
    assert {301, 302} & ids["near_duplicates"] == {i + 300 for i in (1, 2) if i not in ids["toxicity"]}
    assert len([1 for d, _ in seen["near_duplicates"] if d is None]) == 2  # both rows without an id stay
    assert 305 in ids["near_duplicates"] and 306 not in ids["near_duplicates"]
    assert 303 in ids["near_duplicates"] and 303 not in ids["decontamination"]
    assert dict(seen["personal_data"])[304].endswith("write to [EMAIL] now")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(p.doc_id or -1 for p in pieces) == sorted(d or -1 for d, _ in seen["personal_data"])


def test_columns_of_any_name(spark, tmp_path):
    """Names that stages and operators use themselves, and nulls in all columns."""
    names = ["spans", "items", "n_words", "all_spans", "__fp", "__row", "__score", "score", "fp", "row", "n", "email", "base", "candidates"]
    docs = spark.range(12).selectExpr("if(id = 3, null, id) as doc_id", "if(id = 4, null, concat('some words of row ', id % 9, ' mail a@b.cd and then more')) as text", *[f"if(id = 5, null, 'x') as {c}" for c in names])
    write(spark, str(tmp_path), [], [(i, 1, 0) for i in range(12)], [(1, "never in here")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert len(rows) > 0 and (name == "packing" or out.columns == docs.columns)
        if name == "personal_data":
            assert len(rows) == 12 and sum("[EMAIL]" in (r.text or "") for r in rows) == 11 and sum(r.row is None for r in rows) == 1


def test_stages_give_memory_back(spark, tmp_path, monkeypatch):
    from veriscribe.llm import common

    assert common.tidy(spark)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    write(spark, str(tmp_path), [], [(1, 1, 0)], [(1, "never in here")])
    for name, stage in corpus_pipeline.STAGES:
        calls = []
        monkeypatch.setattr(corpus_pipeline, "tidy", calls.append)
        stage(spark, docs, str(tmp_path))
        assert calls and calls[0] is spark, name


def test_queries_are_registered():
    assert {name.split("_")[0] for name in registry.queries()} == {"pipeline"} | {f"op{n}" for n in range(1, 11)}


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
