"""Queries over the test tables, each over whole tables and whole texts, and the SQL that they must agree with."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.functions import detect as D
from veriscribe.functions import layout as L
from veriscribe.functions import metrics as M
from veriscribe.functions import text as T
from veriscribe.operators import judge, layout_search, rendering
from veriscribe.operators.transcripts import EXTRA_LINE, EXTRA_NAMES, pairs, spread
from veriscribe.plans.workspace import folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(_docs(spark, sf_dir))





def q_cer(spark, sf_dir):
    df = _pairs(spark, sf_dir).select("code_id", "ratio", T.normalize(F.col("reference")).alias("r"), T.normalize(F.col("hypothesis")).alias("h"))
    return df.select("code_id", "ratio", F.round(M.cer(F.col("r"), F.col("h")), 6).alias("cer"))


def q_cer_by_ratio(spark, sf_dir):
    return q_cer(spark, sf_dir).groupBy("ratio").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("avg_cer"))


def q_wer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("code_id", F.round(M.wer("reference", "hypothesis"), 6).alias("wer"))


def _tokens(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("s", M.token_scores("reference", "hypothesis"))


def q_token_bleu(spark, sf_dir):
    return _tokens(spark, sf_dir).select("code_id", F.round("s.token_bleu", 6).alias("token_bleu"))


def q_keyword_f1(spark, sf_dir):
    return _tokens(spark, sf_dir).select("code_id", F.round("s.keyword_f1", 6).alias("keyword_f1"))


def q_codebleu(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("ratio").agg(F.count("*").alias("n"), F.round(F.avg("s.codebleu"), 6).alias("avg_codebleu"))


def q_normalize(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", T.normalize(F.concat(F.lit("\t\n"), F.replace("text", F.lit(". "), F.lit(".\t \r\n\n\n")))).alias("x"))
    return df.select("doc_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("md5"))


def q_exact_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("code_id", F.round(M.exact_match_rate(F.col("reference"), F.col("hypothesis")), 6).alias("exact_match_rate"))


def _detect(name):
    def query(spark, sf_dir):
        return _pairs(spark, sf_dir).select("code_id", D.DETECTORS[name](F.col("reference"), F.col("hypothesis")).cast("int").alias("flag"))

    return query


def _flags(spark, sf_dir):
    df = _pairs(spark, sf_dir)
    return df.select("code_id", "ratio", D.taxonomy(F.col("reference"), F.col("hypothesis")).alias("taxonomy_labels"))


def q_detected_errors(spark, sf_dir):
    return _flags(spark, sf_dir).select("code_id", F.array_join(D.detected(F.col("taxonomy_labels")), ",").alias("errors"))


def q_error_groups(spark, sf_dir):
    return judge.error_rollup(_flags(spark, sf_dir))


def q_codediff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("code_id", M.codediff(F.col("reference"), F.col("hypothesis")).alias("d")).select("code_id", "d.*")


def q_detail(spark, sf_dir):
    return judge.score(_pairs(spark, sf_dir), ["code_id", "ratio"])


def q_summary_by_ratio(spark, sf_dir):
    return judge.summarise(q_detail(spark, sf_dir))


def q_report(spark, sf_dir):
    return judge.report(q_summary_by_ratio(spark, sf_dir))


def _log(spark, sf_dir):
    """Conversations as an answer log of one row for each page; some rows have what a log's flaws are."""
    df = _table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("pages\\x\\c"), F.col("conv_id").cast("string"), F.lit("/1024x1024_hl_nl/page_"), F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit("_ratio1_5.png"))
    return df.select(
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("code_id"),
        F.when(F.col("role") != "none", F.lit(1.5)).alias("ratio"),
        F.lit(None).cast("int").alias("num_pages"),
        path.alias("image_path"),
        F.concat(F.lit("<|begin_of_box|> "), F.col("text"), F.lit("\n<|end_of_box|>")).alias("text"),
        F.when(F.col("turn") == 3, F.lit("timeout")).alias("error"),
    )


def q_merge_pages(spark, sf_dir):
    return judge.merge_pages(judge.valid_answers(_log(spark, sf_dir))).select("code_id", "ratio", "num_pages", F.md5("hypothesis").alias("md5"))


def q_group_pages(spark, sf_dir):
    images = _log(spark, sf_dir).select(F.replace("image_path", F.lit("\\"), F.lit("/")).alias("path"))
    cases = judge.in_order(judge.group_pages(images))
    return cases.select("code_id", "ratio", F.size("page_paths").cast("long").alias("n_pages"), F.col("page_paths")[0].alias("first_page"))


def q_path_parse(spark, sf_dir):
    path = F.col("image_path")
    return _log(spark, sf_dir).select("image_path", T.code_of(path).alias("code_id"), T.page_of(path).alias("page_num"), T.ratio_of(path).alias("ratio"), T.is_image(path).alias("is_image"))


#: Names of files with the page and ratio that they say, in turn for the pages of the table.
_NAMES = [("page_001_ratio2.png", 1, 2.0), ("page_001_ratio1.5.jpg", 1, 1.5), ("page_012_ratio1_5.png", 12, 1.5), ("page_001.png", 1, 1.0), ("page_003_ratioX.png", 3, 1.0), ("cover.PNG", 0, 1.0), ("notes.txt", 0, 1.0)]


def q_path_shapes(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n, _, _ in _NAMES]), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    path = F.col("path")
    df = _table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/c"), F.col("page_id").cast("string"), F.lit("/448x448/"), name).alias("path"))
    return df.select("path", T.code_of(path).alias("code_id"), T.page_of(path).alias("page_num"), T.ratio_of(path).alias("ratio"), T.is_image(path).alias("is_image"))


def q_status_counts(spark, sf_dir):
    done = _labelled(spark, sf_dir).withColumn("ratio", F.lit(1.5))
    return judge.status_counts(_log(spark, sf_dir), _pairs(spark, sf_dir).select("code_id", "ratio"), done)


def _labelled(spark, sf_dir):
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("code_id"))


def q_resume_anti(spark, sf_dir):
    done = _labelled(spark, sf_dir).withColumn("ratio", F.lit(1.5))
    return judge.pending(_pairs(spark, sf_dir).select("code_id", "ratio"), done)


def _truth(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("code"))
    return docs.join(_labelled(spark, sf_dir).withColumnRenamed("code_id", "id").distinct(), "id", "left_semi")


def q_ground_truth_join(spark, sf_dir):
    cases = _pairs(spark, sf_dir).select("code_id", "ratio")
    return judge.with_truth(cases, _truth(spark, sf_dir)).select("code_id", "ratio", F.length("reference").cast("long").alias("n_chars"))


def q_unmatched(spark, sf_dir):
    return judge.without_truth(_pairs(spark, sf_dir).select("code_id", "ratio"), _truth(spark, sf_dir))


def q_last_of_each(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("turn").alias("pos"), F.col("conv_id").cast("string").alias("id"), F.col("text").alias("code"))
    return judge.last_of_each(rows)


def q_text_structure(spark, sf_dir):
    s = T.structure(F.col("text"))
    df = _docs(spark, sf_dir).where("text is not null").select("doc_id", s.alias("s"))
    return df.select("doc_id", F.col("s.num_lines").cast("long").alias("num_lines"), F.col("s.max_line_chars").cast("long").alias("max_line_chars"), F.round("s.avg_line_chars", 6).alias("avg_line_chars"), "s.total_chars")


def q_comments(spark, sf_dir):
    return _pairs(spark, sf_dir).select("code_id", F.array_join(T.comments(F.col("reference")), "|").alias("comments"))


def q_identifiers(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.identifiers(F.regexp_replace("text", r"[^\x00-\x7f]", " "))).cast("long").alias("n_identifiers"))


def q_words_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def q_safe_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.dataset_name(F.col("url")).alias("dataset"), T.flat_name(F.col("url")).alias("flat"), T.masked_key(F.col("url")).alias("masked"))


def q_for_rendering(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(T.for_rendering(F.col("text"), False)).alias("md5"))


def _layout_input(spark, sf_dir):
    df = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.ceil(F.length("text") / 3.5).cast("int").alias("text_tokens"), T.structure(F.col("text")).alias("s"))
    return df.select("doc_id", "text_tokens", "s.num_lines", "s.max_line_chars", "s.avg_line_chars", F.lit(1.0).alias("compression_ratio"))


def q_layout_candidates(spark, sf_dir):
    found = layout_search.candidates(_layout_input(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("font_size").alias("fonts"), F.sum("tokens").alias("tokens"), F.round(F.max("score"), 6).alias("best"))


def q_layout_best(spark, sf_dir):
    found = layout_search.best(layout_search.candidates(_layout_input(spark, sf_dir)), "doc_id")
    return found.select("doc_id", "resolution", "pages", "font_size", F.round("score", 6).alias("score"))


def q_layout_fallback(spark, sf_dir):
    texts = _layout_input(spark, sf_dir)
    return layout_search.fallback(texts, layout_search.candidates(texts), "doc_id")


def q_layout_exhaustive(spark, sf_dir):
    return layout_search.exhaustive(_layout_input(spark, sf_dir), "doc_id")


def q_largest_font(spark, sf_dir):
    lengths = F.transform(T.lines(F.col("text")), F.length)
    df = _docs(spark, sf_dir).where("text is not null").select("doc_id", lengths.alias("lengths"))
    return df.select("doc_id", layout_search.largest_font(F.col("lengths"), F.lit(1024), F.lit(2)).alias("font_size"))


def q_closest_resolution(spark, sf_dir):
    df = layout_search.fan_out(_docs(spark, sf_dir).where("text is not null").select("doc_id", F.ceil(F.length("text") / 3.5).alias("t")), L.COMPRESSION_RATIOS)
    return df.select("doc_id", "ratio", L.closest_resolution(F.col("t") / F.col("ratio"), layout_search.ALL_RESOLUTIONS).alias("resolution"))


def q_compression_plan(spark, sf_dir):
    df = _layout_input(spark, sf_dir).select("doc_id", layout_search.compression_plan(F.col("text_tokens"), F.lit(2), L.COMPRESSION_RATIOS).alias("p"))
    return df.select("doc_id", F.inline("p"))


def q_dynamic_plan(spark, sf_dir):
    best = layout_search.best(layout_search.candidates(_layout_input(spark, sf_dir)), "doc_id").select("doc_id", "resolution", "pages")
    df = _layout_input(spark, sf_dir).join(best, "doc_id")
    return df.select("doc_id", F.inline(layout_search.dynamic_plan(F.col("text_tokens"), F.col("pages"), F.col("resolution"), L.COMPRESSION_RATIOS)))


def q_image_tokens(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 32).alias("w"), (F.col("p_partkey") % 100 * 16 + 16).alias("h"))
    return df.select("p_partkey", L.image_tokens(F.col("w"), F.col("h")).alias("tokens"), L.tile_tokens(F.col("w"), F.col("h")).alias("tile_tokens"))


def q_estimates(spark, sf_dir):
    t, r = F.col("text_tokens"), F.lit(1120)
    df = _layout_input(spark, sf_dir).withColumn("size", L.initial_font_size(t, r))
    return df.select(
        "doc_id",
        F.col("size").alias("font_size"),
        L.page_count(t, r, F.col("size")).alias("pages"),
        F.round(L.rough_fill_rate(r, F.col("size")), 6).alias("fill"),
        F.round(L.fill_rate_for_pages(t, r, F.lit(2)), 6).alias("fill_two"),
        L.in_range(F.lit(1), L.image_tokens(r, r), t).alias("in_range"),
        F.round(L.token_ratio(F.lit(1), L.image_tokens(r, r), t), 6).alias("token_ratio"),
    )


def q_fan_out(spark, sf_dir):
    return layout_search.fan_out(_table(spark, sf_dir, "pages").select("page_id")).groupBy("ratio").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"))


def q_paginate(spark, sf_dir):
    pages = rendering.paginate(_docs(spark, sf_dir).select("doc_id", "text"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.size("page_rows")).alias("n_rows"))


def q_highlight(spark, sf_dir):
    df = _docs(spark, sf_dir).where("text is not null").select("doc_id", rendering.highlight("python")("text").alias("t"))
    return df.select("doc_id", F.posexplode("t").alias("pos", "token")).select("doc_id", "pos", "token.text", "token.color")


def q_degraded_pages(spark, sf_dir):
    """Pages of documents as highlighted images, at all ratios: their sizes."""
    items = spread(_docs(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("code_id"), "text")
    found = rendering.render_degraded(rendering.paginate(items), L.RATIOS)
    return found.select("path", "ratio", rendering.png_size(F.col("content")).alias("size")).select("path", "ratio", "size.*")


def q_stream_summary(spark, sf_dir):
    """The summary by a stream over a log of one answer for each document, in two batches of files."""
    from veriscribe.streaming import judge as stream

    home, all_pairs = folder(spark), _pairs(spark, sf_dir)
    log = all_pairs.select("code_id", "ratio", F.lit(1).alias("num_pages"), F.col("hypothesis").alias("text"))
    log.repartition(2, "code_id").write.json(f"{home}/log")
    truth = all_pairs.select(F.col("code_id").alias("id"), F.col("reference").alias("code"))
    stream.start_summary(stream.read_log_stream(spark, f"{home}/log", 1), truth, f"{home}/summary", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/summary")


def q_stream_events(spark, sf_dir):
    from veriscribe.streaming import judge as stream

    home = folder(spark)
    events = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{home}/events")
    live = spark.readStream.schema(events.schema).parquet(f"{home}/events")
    rates = stream.event_rates(live, "1 day")

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(f"{home}/rates")

    rates.writeStream.outputMode("complete").option("checkpointLocation", f"{home}/c").foreachBatch(replace).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/rates").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# The SQL below says the same again for DuckDB, from the rules and not from the code above.
_PAIRS = f"""
p AS (SELECT CAST(doc_id AS VARCHAR) AS code_id, doc_id, CAST([1, 1.5, 2, 4, 6, 8, 16][doc_id % 7 + 1] AS DOUBLE) AS ratio,
 CASE WHEN doc_id % 8 = 7 THEN text || chr(10) || '# note ' || doc_id ELSE text END AS r,
 CASE doc_id % 8 WHEN 0 THEN replace(text, 'l', '1') WHEN 1 THEN replace(replace(text, '.', ''), ',', '')
  WHEN 2 THEN '    ' || replace(text, chr(10), chr(10) || '    ')
  WHEN 3 THEN array_to_string([z.x FOR z IN list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)) IF z.i % 5 <> 0], chr(10))
  WHEN 4 THEN text || chr(10) || '{EXTRA_NAMES}' WHEN 5 THEN text || chr(10) || '{EXTRA_LINE}'
  WHEN 6 THEN text || repeat(chr(10) || string_split(text, chr(10))[-1], 3) ELSE text END AS h
 FROM documents WHERE text IS NOT NULL AND text <> '')"""
_PAIRS = _PAIRS.replace("[z.x FOR z IN list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)) IF z.i % 5 <> 0]", "list_filter(string_split(text, chr(10)), lambda x, i: i % 5 <> 0)")
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"
_COUNT = lambda x, s: f"((length({x}) - length(replace({x}, '{s}', ''))) // {len(s.replace(chr(39) * 2, chr(39)))})"


def _sql_typo() -> str:
    quoted = lambda s: s.replace("'", "''")
    names = sorted({x for pair in D.LOOKALIKES for x in pair})
    columns = ", ".join(f"{_COUNT('h', quoted(n))} - {_COUNT('r', quoted(n))} AS c{i}" for i, n in enumerate(names))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    tests = " OR ".join(f"sign({at[a]}) * sign({at[b]}) = -1" for a, b in D.LOOKALIKES)
    return f"SELECT code_id, CAST({tests} AS INT) AS flag FROM (SELECT code_id, {columns} FROM p)"


_L = lambda t: f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '')"
_COMMENT = "flatten(list_transform(string_split({0}, chr(10)), lambda x: list_filter([CASE WHEN starts_with(trim(x), '#') THEN trim(x) END, CASE WHEN contains(x, '#') AND trim(substr(x, strpos(x, '#') + 1)) <> '' THEN '#' || trim(substr(x, strpos(x, '#') + 1)) END], lambda y: y IS NOT NULL)))"
_IDS = lambda t: f"list_filter(list_distinct(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')), lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]*'))"
_STOP = "[" + ", ".join(f"'{x}'" for x in D.COMMON_NAMES) + "]"
_DETECT = {
    "Visual_Typo": _sql_typo(),
    "Symbol_Loss": "SELECT code_id, CAST(" + " OR ".join(f"({_COUNT('r', s)} > 0 AND {_COUNT('h', s)} < 0.8 * {_COUNT('r', s)})" for s in D.SYMBOLS) + " AS INT) AS flag FROM p",
    "Indentation_Error": "SELECT code_id, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: abs((length(a[i]) - length(ltrim(a[i], ' ' || chr(9)))) - (length(b[i]) - length(ltrim(b[i], ' ' || chr(9))))) >= 2)) > 0.05 * least(len(a), len(b)) AS INT) AS flag FROM (SELECT code_id, string_split(r, chr(10)) AS a, string_split(h, chr(10)) AS b FROM p)",
    "Line_Skipped": f"SELECT code_id, CAST(len(a) > 0 AND (len(b) < 0.9 * len(a) OR len(list_filter(a, lambda x: length(x) > 10 AND NOT list_contains(b, x))) > 0.1 * len(a)) AS INT) AS flag FROM (SELECT code_id, {_L('r')} AS a, {_L('h')} AS b FROM p)",
    "Variable_Hallucination": f"SELECT code_id, CAST(len(list_filter(b, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x) AND NOT list_contains(a, x))) >= 3 AS INT) AS flag FROM (SELECT code_id, {_IDS('r')} AS a, {_IDS('h')} AS b FROM p)",
    "Code_Invention": f"SELECT code_id, CAST(len(b) > 0 AND len(list_filter(b, lambda x: length(x) > 15 AND NOT contains(r, left(x, 20)))) > 0.05 * len(b) AS INT) AS flag FROM (SELECT code_id, r, {_L('h')} AS b FROM p)",
    "Repetition": f"""SELECT code_id, CAST(coalesce(sum(CASE WHEN x = y AND length(s) > 5 THEN 1 ELSE 0 END), 0) >= 2 AND max(n) >= 3 OR max(n) >= 3 AND max(CASE WHEN length(s) > 10 THEN times ELSE 0 END) >= 3 AS INT) AS flag FROM (
 SELECT code_id, x, {_STRIP('x')} AS s, lag(x) OVER (PARTITION BY code_id ORDER BY i) AS y, count(*) OVER (PARTITION BY code_id, x) AS times, count(*) OVER (PARTITION BY code_id) AS n
 FROM (SELECT code_id, unnest(string_split(h, chr(10))) AS x, generate_subscripts(string_split(h, chr(10)), 1) AS i FROM p) WHERE {_STRIP('x')} <> '') GROUP BY code_id
 UNION ALL SELECT code_id, 0 FROM p WHERE len({_L('h')}) = 0""",
    "Comment_Loss": f"""SELECT code_id, CASE WHEN len(a) = 0 THEN 0 ELSE CAST(len(b) < 0.7 * len(a) OR len(list_filter(a, lambda x: len(list_filter(b, lambda y: contains(y, x) OR contains(x, y) OR len(list_filter(string_split(x, ''), lambda c: contains(y, c))) > 0.7 * length(x))) > 0)) < 0.7 * len(a) AS INT) END AS flag
 FROM (SELECT code_id, {_COMMENT.format('r')} AS a, {_COMMENT.format('h')} AS b FROM p)""",
}
_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_GRAMS = f"""
t AS (SELECT code_id, ratio, regexp_extract_all(r, '{_TOKENS}') AS a, regexp_extract_all(h, '{_TOKENS}') AS b FROM p),
g AS (SELECT code_id, n, gram, sum(x) AS x, sum(y) AS y FROM (
 SELECT code_id, n, array_to_string(a[i:i + n - 1], chr(1)) AS gram, 1 AS x, 0 AS y FROM (SELECT code_id, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4]) AS n))
 UNION ALL SELECT code_id, n, array_to_string(b[i:i + n - 1], chr(1)), 0, 1 FROM (SELECT code_id, b, n, unnest(range(1, len(b) - n + 2)) AS i FROM t, (SELECT unnest([1, 2, 3, 4]) AS n))) GROUP BY ALL),
s AS (SELECT code_id, n, sum(least(x, y)) / sum(y) AS q FROM g GROUP BY ALL HAVING sum(y) > 0),
bleu AS (SELECT code_id, ratio, coalesce(m, 0) * CASE WHEN len(b) = 0 THEN 0 ELSE least(1, exp(1 - len(a) / len(b))) END AS bleu FROM t LEFT JOIN (SELECT code_id, exp(avg(ln(q))) AS m FROM s WHERE q > 0 GROUP BY code_id) USING (code_id)),
k AS (SELECT code_id, sum(least(x, y)) AS hit, sum(x) AS x, sum(y) AS y FROM g WHERE n = 1 AND gram IN ('False','None','True','and','as','assert','async','await','break','class','continue','def','del','elif','else','except','finally','for','from','global','if','import','in','is','lambda','nonlocal','not','or','pass','raise','return','try','while','with','yield') GROUP BY code_id),
f AS (SELECT code_id, CASE WHEN coalesce(x, 0) = 0 AND coalesce(y, 0) = 0 THEN 1 WHEN x = 0 OR y = 0 OR hit = 0 THEN 0 ELSE 2 * (hit / y) * (hit / x) / (hit / y + hit / x) END AS f1 FROM t LEFT JOIN k USING (code_id))"""
_LOG = """
l AS (SELECT 'c' || conv_id AS code_id, 1.5::DOUBLE AS ratio, turn, 'pages\\x\\c' || conv_id || '/1024x1024_hl_nl/page_' || lpad(CAST(turn AS VARCHAR), 3, '0') || '_ratio1_5.png' AS image_path, text FROM conversations WHERE text IS NOT NULL)"""
_D = r"""
d AS (SELECT doc_id, text, string_split(replace(text, chr(9), '    '), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CAST(ceil(length(text) / 3.5) AS INT) AS t, len(a) AS num_lines, greatest(list_max(list_transform(a, lambda x: length(x))), 1) AS max_line_chars,
 greatest(list_sum(list_transform(a, lambda x: length(x))) / len(a), 1.0) AS avg_line_chars, CAST(list_sum(list_transform(a, lambda x: length(x))) AS BIGINT) AS total_chars FROM d)"""
_CANDIDATES = """,
v AS (SELECT *, t::DOUBLE AS target, res - 2 * (res * 0.01::DOUBLE) AS room, CAST(floor((res / 16 * (res / 16)) / 4) AS INT) AS tok FROM s, (SELECT unnest(range(112, 4481, 112)) AS res)),
w AS (SELECT *, unnest(range(low, high + 1)) AS pages FROM (SELECT *,
 greatest(1, CAST(ceil(target * CASE WHEN target < 50 THEN 0.5::DOUBLE WHEN target < 100 THEN 0.7::DOUBLE WHEN target < 3000 THEN 0.8::DOUBLE WHEN target < 5000 THEN 0.9::DOUBLE WHEN target < 10000 THEN 0.93::DOUBLE ELSE 0.95::DOUBLE END / tok) AS INT)) AS low,
 least(100, CAST(floor(target * CASE WHEN target < 50 THEN 2::DOUBLE WHEN target < 100 THEN 1.5::DOUBLE WHEN target < 3000 THEN 1.25::DOUBLE WHEN target < 5000 THEN 1.12::DOUBLE WHEN target < 10000 THEN 1.08::DOUBLE ELSE 1.05::DOUBLE END / tok) AS INT)) AS high FROM v) WHERE low <= high),
x AS (SELECT *, greatest(4, least(150, CAST(floor(least(room * pages / num_lines, room / (max_line_chars * 0.6::DOUBLE))) AS INT))) AS fs FROM w),
y AS (SELECT *, least(1.5, fs * num_lines / (room * pages), fs * 0.6::DOUBLE * avg_line_chars / room) AS fill, pages * tok / target AS token_ratio FROM x),
z AS (SELECT *, 1 / (1 + abs(token_ratio - 1) * CASE WHEN target < 50 THEN 1 WHEN target < 100 THEN 1.5::DOUBLE WHEN target < 3000 THEN 2 WHEN target < 5000 THEN 2.5::DOUBLE WHEN target < 10000 THEN 3 ELSE 3.5::DOUBLE END) AS near,
 CASE WHEN target < 50 THEN CASE WHEN fill >= 0.2::DOUBLE THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END WHEN fill >= 0.9::DOUBLE THEN 1 WHEN fill >= 0.2::DOUBLE THEN 0.2::DOUBLE + (fill - 0.2::DOUBLE) * (0.8::DOUBLE / 0.7::DOUBLE) WHEN fill >= 0.1::DOUBLE THEN 0.05::DOUBLE ELSE 0.01::DOUBLE END AS full_,
 1 + (res - 112) / 4368::DOUBLE * CASE WHEN target >= 3000 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS large FROM y
 WHERE NOT (target >= 10000 AND fill < 0.03::DOUBLE AND fs < 6 OR target >= 3000 AND target < 10000 AND fill < 0.1::DOUBLE AND fs < 5)),
c AS (SELECT *, 1.2::DOUBLE * large * CASE WHEN target < 50 THEN pow(near, 2.5) * pow(full_, 0.2) WHEN target < 100 THEN pow(near, 1.5) * pow(full_, 0.75) ELSE near * full_ * CASE WHEN target >= 5000 AND fs < 8 THEN 0.8::DOUBLE ELSE 1 END END AS score FROM z)"""
_SIZES = "(SELECT unnest([14, 28, 56] || range(112, 4481, 112)) AS res)"
_ROOM = lambda r: f"({r} - 2 * ({r} * 0.01::DOUBLE))"


def _sql_pages(t: str, r: str, size: str) -> str:
    """Pages that t tokens need at a resolution and font size."""
    across, down = f"greatest(1, floor({_ROOM(r)} / ({size} * 0.6::DOUBLE)))", f"greatest(1, floor({_ROOM(r)} / {size}))"
    chars = f"({t} * 3.5::DOUBLE)"
    return f"CAST(greatest(1, ceil(({chars} * 1.3::DOUBLE + {chars} / 50 * ({across} * 0.3::DOUBLE)) / ({across} * {down}))) AS INT)"


def oracle_sql() -> dict[str, str]:
    q = {name: f"WITH {_PAIRS} {sql}" for name, sql in ((f"q_detect_{n.lower()}", s) for n, s in _DETECT.items())}
    flags = " UNION ALL ".join(f"SELECT code_id, {i} AS i, '{n}' AS error, '{next(g for g, names in D.GROUPS.items() if n in names)}' AS error_group, flag FROM ({s})" for i, (n, s) in enumerate(_DETECT.items()))
    q["q_detected_errors"] = f"WITH {_PAIRS}, e AS ({flags}) SELECT code_id, coalesce(string_agg(CASE WHEN flag = 1 THEN error END, ',' ORDER BY i), '') AS errors FROM e GROUP BY code_id"
    q["q_error_groups"] = f"WITH {_PAIRS}, e AS ({flags}) SELECT ratio, error_group, error, CAST(sum(flag) AS BIGINT) AS n FROM e JOIN p USING (code_id) GROUP BY GROUPING SETS ((ratio, error_group, error), (ratio, error_group))"
    q["q_exact_match"] = f"WITH {_PAIRS} SELECT code_id, round(len(list_filter(range(1, len(a) + 1), lambda i: coalesce(a[i] = b[i], false))) / len(a), 6) AS exact_match_rate FROM (SELECT code_id, string_split(r, chr(10)) AS a, string_split(h, chr(10)) AS b FROM p)"
    q["q_token_bleu"] = f"WITH {_PAIRS}, {_GRAMS} SELECT code_id, round(bleu, 6) AS token_bleu FROM bleu"
    q["q_keyword_f1"] = f"WITH {_PAIRS}, {_GRAMS} SELECT code_id, round(f1, 6) AS keyword_f1 FROM f"
    q["q_codebleu"] = f"WITH {_PAIRS}, {_GRAMS} SELECT ratio, count(*) AS n, round(avg(0.8 * bleu + 0.2 * f1), 6) AS avg_codebleu FROM bleu JOIN f USING (code_id) GROUP BY ratio"
    q["q_comments"] = f"WITH {_PAIRS} SELECT code_id, array_to_string({_COMMENT.format('r')}, '|') AS comments FROM p"
    q["q_normalize"] = r"""WITH a AS (SELECT doc_id, chr(9) || chr(10) || replace(text, '. ', '.' || chr(9) || ' ' || chr(13) || chr(10) || chr(10) || chr(10)) AS x FROM documents),
 b AS (SELECT doc_id, regexp_replace(replace(regexp_replace(x, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(9), '    '), '[ \x1f\p{Z}]+(\n|$)', '\1', 'g') AS x FROM a),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '') AS x FROM b) SELECT doc_id, length(x) AS n_chars, md5(x) AS md5 FROM c"""
    q["q_words_tokens"] = rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(text, '{_TOKENS}')) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL"
    q["q_identifiers"] = r"SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g'), '[a-zA-Z0-9_]+'), lambda x: x), lambda x: regexp_matches(x, '^[a-zA-Z_]')))) AS BIGINT) AS n_identifiers FROM documents WHERE text IS NOT NULL"
    q["q_for_rendering"] = "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, chr(9), '    '), chr(10), '⏎'), '–', '-'), '—', '--'), '…', '...')) AS md5 FROM documents WHERE text IS NOT NULL"
    q["q_safe_names"] = r"SELECT page_id, 'dataset_' || left(regexp_replace(coalesce(nullif(trim(url), ''), 'model'), '[^a-zA-Z0-9._-]+', '_', 'g'), 80) || '.json' AS dataset, coalesce(replace(url, '/', '_'), 'unknown') AS flat, CASE WHEN coalesce(url, '') = '' THEN '' WHEN length(url) <= 12 THEN left(url, 2) || '...' || right(url, 2) ELSE left(url, 6) || '...' || right(url, 6) END AS masked FROM pages"
    q["q_merge_pages"] = rf"WITH {_LOG} SELECT code_id, ratio, CAST(count(*) AS INT) AS num_pages, md5(string_agg({_STRIP('text')}, chr(10) ORDER BY image_path)) AS md5 FROM l WHERE turn <> 3 AND text IS NOT NULL GROUP BY code_id, ratio"
    q["q_group_pages"] = f"WITH {_LOG} SELECT code_id, ratio, count(*) AS n_pages, replace(min_by(image_path, turn), chr(92), '/') AS first_page FROM l GROUP BY code_id, ratio"
    q["q_path_parse"] = f"WITH {_LOG} SELECT image_path, code_id, CAST(turn AS INT) AS page_num, ratio, true AS is_image FROM l"
    names, numbers, ratios = ([x[i] for x in _NAMES] for i in range(3))
    q["q_path_shapes"] = f"""SELECT 'pages/c' || page_id || '/448x448/' || {names}[k] AS path, 'c' || page_id AS code_id, CAST({numbers}[k] AS INT) AS page_num, CAST({ratios}[k] AS DOUBLE) AS ratio,
 {names}[k] <> 'notes.txt' AS is_image FROM (SELECT page_id, page_id % {len(_NAMES)} + 1 AS k FROM pages)"""
    q["q_status_counts"] = f"WITH {_PAIRS} SELECT count(*) FILTER (WHERE turn IS DISTINCT FROM 3) AS ok, (SELECT count(*) FROM p WHERE ratio = 1.5 AND doc_id IN (SELECT doc_id FROM labels)) AS skipped, count(*) FILTER (WHERE turn = 3) AS error FROM conversations"
    q["q_resume_anti"] =f"WITH {_PAIRS} SELECT code_id, ratio FROM p WHERE NOT (ratio = 1.5 AND doc_id IN (SELECT doc_id FROM labels))"
    q["q_ground_truth_join"] = f"WITH {_PAIRS} SELECT code_id, ratio, length(d.text) AS n_chars FROM p JOIN documents d USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels)"
    q["q_unmatched"] = f"WITH {_PAIRS} SELECT code_id, ratio FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
    q["q_last_of_each"] = "SELECT CAST(conv_id AS VARCHAR) AS id, max_by(text, turn) AS code FROM conversations GROUP BY conv_id"
    q["q_text_structure"] = f"WITH {_D} SELECT doc_id, CAST(num_lines AS BIGINT) AS num_lines, CAST(max_line_chars AS BIGINT) AS max_line_chars, round(avg_line_chars, 6) AS avg_line_chars, total_chars FROM s"
    q["q_layout_candidates"] = f"WITH {_D} {_CANDIDATES} SELECT doc_id, count(*) AS n, CAST(sum(fs) AS BIGINT) AS fonts, CAST(sum(pages * tok) AS BIGINT) AS tokens, round(max(score), 6) AS best FROM c GROUP BY doc_id"
    q["q_layout_best"] = f"WITH {_D} {_CANDIDATES} SELECT doc_id, CAST(res AS INT) AS resolution, CAST(pages AS INT) AS pages, fs AS font_size, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, res, pages) = 1"
    q["q_layout_fallback"] = f"WITH {_D} {_CANDIDATES} SELECT doc_id, 112 AS resolution, least({_sql_pages('t', '112', '3')}, 100) AS pages, 3 AS font_size FROM s WHERE NOT EXISTS (FROM c WHERE c.doc_id = s.doc_id)"
    q["q_layout_exhaustive"] = f"""WITH {_D}, a AS (SELECT doc_id, t, res, CAST(floor((res / 16 * (res / 16)) / 4) AS INT) AS per, fs, {_sql_pages('t', 'res', 'fs')} AS pages FROM s, (SELECT unnest([112, 224, 448, 896, 1344, 1792, 2240]) AS res), (SELECT unnest(range(4, 151)) AS fs)),
 b AS (SELECT *, pages * per AS tokens, min(pages) OVER (PARTITION BY doc_id, res) AS fewest, fewest * per <= 1.25::DOUBLE * t AS strict FROM a),
 e AS (SELECT * FROM b WHERE CASE WHEN strict THEN tokens <= 1.25::DOUBLE * t ELSE pages <= fewest END QUALIFY row_number() OVER (PARTITION BY doc_id, res ORDER BY fs DESC) = 1)
 SELECT doc_id, res AS resolution, pages, CAST(fs AS INT) AS font_size, tokens FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strict DESC, CASE WHEN strict THEN res * 1000 + fs ELSE -tokens END DESC, fs DESC, res DESC) = 1"""
    q["q_largest_font"] = f"""WITH {_D}, b AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM d),
 e AS (SELECT doc_id, fs, list_sum(list_transform(n, lambda x: greatest(1, ceil(x / greatest(1, floor({_ROOM('1024')} / (fs * 0.6::DOUBLE))))))) AS rows_, greatest(1, floor({_ROOM('1024')} / fs)) AS down FROM b, (SELECT unnest(range(4, 151)) AS fs))
 SELECT doc_id, CAST(coalesce(max(fs) FILTER (WHERE ceil(rows_ / down) <= 2), 4) AS INT) AS font_size FROM e GROUP BY doc_id"""
    q["q_estimates"] = f"""WITH {_D}, e AS (SELECT doc_id, t, {_ROOM('1120')} AS room, CASE WHEN t <= 0 THEN 40 ELSE greatest(4, least(150, CAST(floor(floor(sqrt(room * room * 0.95::DOUBLE / (t * 3.5::DOUBLE * 0.6::DOUBLE))) * 1.1::DOUBLE) AS INT))) END AS size,
 greatest(4, least(150, sqrt(room * room / (t * 3.5::DOUBLE / 2 * 0.6::DOUBLE)))) AS size_two FROM s)
 SELECT doc_id, size AS font_size, {_sql_pages('t', '1120', 'size')} AS pages, round(least(1.5::DOUBLE, 80 / (room / (size * 0.6::DOUBLE))), 6) AS fill,
 round(CASE WHEN t <= 0 THEN 1.5::DOUBLE ELSE least(1.5::DOUBLE, 80 / (room / (size_two * 0.6::DOUBLE))) END, 6) AS fill_two,
 t > 0 AND 1225 / t BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE AS in_range, round(CASE WHEN t <= 0 THEN 999::DOUBLE ELSE 1225 / t END, 6) AS token_ratio FROM e"""
    q["q_image_tokens"] ="SELECT p_partkey, CAST(floor((w / 16 * (h / 16)) / 4) AS INT) AS tokens, CAST(170 + least(2 * ceil(w / 14) * ceil(h / 14), 100) AS BIGINT) AS tile_tokens FROM (SELECT p_partkey, p_size * 32 AS w, p_partkey % 100 * 16 + 16 AS h FROM part)"
    q["q_fan_out"] = "SELECT CAST(r AS DOUBLE) AS ratio, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM pages, (SELECT unnest([1, 1.5, 2, 4, 6, 8, 16]) AS r) GROUP BY r"
    q["q_closest_resolution"] = f"""WITH a AS (SELECT doc_id, CAST(r AS DOUBLE) AS ratio, res, floor((res / 16 * (res / 16)) / 4) AS tok, abs(tok - ceil(length(text) / 3.5) / CAST(r AS DOUBLE)) AS d FROM documents, (SELECT unnest([0.5, 1, 1.5, 2, 4, 8]) AS r), {_SIZES} WHERE text IS NOT NULL),
 b AS (SELECT *, min(d) OVER (PARTITION BY doc_id, ratio) AS least_ FROM a), c AS (SELECT doc_id, ratio, count(*) AS n, max(tok) AS hi, min(tok) AS lo, max(res) AS top, min_by(res, d * 100000 + res / 10000) AS near FROM b WHERE d <= least_ * 1.2::DOUBLE GROUP BY ALL)
 SELECT doc_id, ratio, CAST(CASE WHEN n > 1 AND hi <= lo * 1.4::DOUBLE THEN top ELSE near END AS INT) AS resolution FROM c"""
    q["q_paginate"] = """WITH a AS (SELECT doc_id, CAST(list_sum(list_transform(string_split(replace(replace(replace(replace(coalesce(text, ''), chr(9), '    '), '–', '-'), '—', '--'), '…', '...'), chr(10)), lambda x: greatest(1, ceil(length(x) / 92)))) AS BIGINT) AS n FROM documents)
 SELECT doc_id, CAST(ceil(n / 47) AS BIGINT) AS n_pages, n AS n_rows FROM a"""
    q["q_stream_events"] = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
    return q


def queries() -> dict:
    plain = {name: f for name, f in globals().items() if name.startswith("q_")}
    return plain | {f"q_detect_{n.lower()}": _detect(n) for n in D.TAXONOMY}
