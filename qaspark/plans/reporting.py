"""Queries of reports, the leaderboard, charts and files over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.operators import board as L
from qaspark.operators import charts as G
from qaspark.operators import report as R
from qaspark.operators.lineage import folder
from qaspark.plans.evaluating import query, table
from qaspark.sources import markdown, runs, tables

# ---- long metrics made of orders: five models (segments), two levels of splits ------------

METRICS = """o AS (SELECT c_mktsegment AS model, o_orderstatus AS s, left(o_orderpriority, 1) AS p, o_totalprice > 150000 AS ok FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT model, '' AS d1, '' AS s1, '' AS d2, '' AS s2, ok FROM o UNION ALL SELECT model, 'dim1', s, '', '', ok FROM o UNION ALL SELECT model, 'dim1', s, 'dim2', p, ok FROM o WHERE model <> 'BUILDING' OR s <> 'P' UNION ALL SELECT model, 'qtype', 'Q' || p, '', '', ok FROM o WHERE p < '3' OR model = 'MACHINERY' UNION ALL SELECT model, 'q4_score', 'overall', '', '', ok FROM o WHERE s = 'P' UNION ALL SELECT model, 'q4_score', p, '', '', ok FROM o WHERE s = 'P'),
m AS (SELECT model, d1, s1, d2, s2, avg(ok::INTEGER) AS acc, count(*) AS n FROM e GROUP BY ALL)"""


def metrics(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("c_mktsegment").alias("model"), F.col("o_orderstatus").alias("s"), F.left("o_orderpriority", F.lit(1)).alias("p"), (F.col("o_totalprice") > 150000).alias("ok"))
    step = lambda dim, split: F.struct(F.lit(dim).alias("dim"), split.alias("split"))
    s, p, model = F.col("s"), F.col("p"), F.col("model")
    none = F.array().cast("array<struct<dim: string, split: string>>")
    paths = F.array(
        none, F.array(step("dim1", s)), F.when((model != "BUILDING") | (s != "P"), F.array(step("dim1", s), step("dim2", p))),
        F.when((p < "3") | (model == "MACHINERY"), F.array(step("qtype", F.concat(F.lit("Q"), p)))),
        F.when(s == "P", F.array(step("q4_score", F.lit("overall")))), F.when(s == "P", F.array(step("q4_score", p))),
    )
    each = o.select("model", "ok", F.explode(F.array_compact(paths)).alias("path"))
    return each.groupBy("model", "path").agg(F.avg(F.col("ok").cast("int")).alias("acc"), F.count(F.lit(1)).alias("n"))


def board_metrics(spark, sf_dir) -> DataFrame:
    return metrics(spark, sf_dir).withColumn("dataset", F.lit("orders"))


@query(f"""WITH {METRICS}, b AS (SELECT model, 'dimension_level_1' AS breakdown, 'Dimension Level 1' AS label, s1 AS id, s1 AS name, acc AS score, n FROM m WHERE d1 = 'dim1' AND d2 = ''
UNION ALL SELECT model, 'dimension_level_2', 'Dimension Level 2', s2, s2, arg_max(acc, s1), arg_max(n, s1) FROM m WHERE d2 = 'dim2' GROUP BY model, s2
UNION ALL SELECT model, 'question_type', 'Question Type', s1, CASE s1 WHEN 'Q1' THEN 'Single Choice' WHEN 'Q2' THEN 'Multiple Choice' WHEN 'Q3' THEN 'Judgment & Reasoning' WHEN 'Q4' THEN 'Open Analysis' ELSE s1 END, acc, n FROM m WHERE d1 = 'qtype')
SELECT model, breakdown, label, id, name, round(score, 6) AS score, n AS count FROM b""")
def leaderboard_breakdowns(spark, sf_dir):
    return L.breakdowns(board_metrics(spark, sf_dir)).select("model", "breakdown", "label", "id", "name", F.round("score", 6).alias("score"), "count")


@query(f"""WITH {METRICS}, b AS (SELECT model, 'by_dim1' AS f, s1 AS id, acc, n FROM m WHERE d1 = 'dim1' AND d2 = '' UNION ALL SELECT model, 'by_dim2', s2, arg_max(acc, s1), arg_max(n, s1) FROM m WHERE d2 = 'dim2' GROUP BY model, s2 UNION ALL SELECT model, 'by_qtype', s1, acc, n FROM m WHERE d1 = 'qtype')
SELECT model, f AS field, id, round(acc, 6) AS value FROM b UNION ALL SELECT model, f || '_counts', id, n FROM b UNION ALL SELECT model, 'q4_mean_score', '', round(acc, 6) FROM m WHERE s1 = 'overall' UNION ALL SELECT model, 'q4_count', '', n FROM m WHERE s1 = 'overall' UNION ALL SELECT model, 'q4_mean_score_by_dim', s1, round(acc, 6) FROM m WHERE d1 = 'q4_score' AND s1 <> 'overall'""")
def leaderboard_older_fields(spark, sf_dir):
    return L.older_fields(board_metrics(spark, sf_dir)).select("model", "field", "id", F.round("value", 6).alias("value"))


@query(f"""WITH {METRICS} SELECT model, round(acc, 6) AS accuracy, round(acc * 100, 6) AS overall_score, round(acc * n)::BIGINT AS correct, n AS total, CASE WHEN model = 'MACHINERY' THEN 5 ELSE 2 END::BIGINT AS types, 3 AS breakdowns, 'cot' AS protocol FROM m WHERE d1 = ''""")
def leaderboard_rows(spark, sf_dir):
    m = board_metrics(spark, sf_dir)
    found = L.entries(m, m.select("dataset", "model").distinct().withColumn("protocol", F.lit("cot")))
    types = F.size(F.element_at("breakdowns", "question_type")["items"])
    return found.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("overall_score", 6).alias("overall_score"), "correct", "total", types.cast("long").alias("types"), F.size("breakdowns").alias("breakdowns"), "protocol")


@query(f"WITH {METRICS} SELECT model, CASE WHEN d2 = '' THEN d1 ELSE d1 || '/' || s1 || '/' || d2 END AS dimension, CASE WHEN d2 = '' THEN s1 ELSE s2 END AS split, round(acc, 6) AS acc, n FROM m WHERE d1 <> ''")
def chart_bars(spark, sf_dir):
    return G.bars(metrics(spark, sf_dir)).withColumn("acc", F.round("acc", 6))


@query(f"""WITH {METRICS}, b AS (SELECT model, CASE WHEN d2 = '' THEN d1 ELSE d1 || '/' || s1 || '/' || d2 END AS dimension, CASE WHEN d2 = '' THEN s1 ELSE s2 END AS split, acc FROM m WHERE d1 <> '' AND model IN ('BUILDING', 'MACHINERY')),
s AS (SELECT dimension FROM b GROUP BY 1 HAVING count(DISTINCT model) = 2), w AS (SELECT DISTINCT dimension, split, x.model FROM b JOIN s USING (dimension), (SELECT unnest(['BUILDING', 'MACHINERY']) AS model) x)
SELECT w.dimension, w.split, w.model, round(coalesce(acc, 0), 6) AS acc FROM w LEFT JOIN b USING (dimension, split, model)""")
def chart_compared(spark, sf_dir):
    return G.compared(metrics(spark, sf_dir), ["BUILDING", "MACHINERY"]).withColumn("acc", F.round("acc", 6))


@query(f"WITH {METRICS} SELECT model, 'dim1' AS dimension, 'dim2' AS child, s1 AS \"row\", s2 AS \"column\", round(acc, 6) AS acc FROM m WHERE d2 = 'dim2' AND model <> 'BUILDING'")
def chart_heat(spark, sf_dir):
    return G.heat_cells(metrics(spark, sf_dir)).withColumn("acc", F.round("acc", 6))


@query("SELECT quality::DOUBLE AS a, n_chars / 1000.0::DOUBLE AS b, (quality + n_chars / 1000.0::DOUBLE) / 2 AS mean, quality - n_chars / 1000.0::DOUBLE AS diff FROM documents JOIN labels USING (doc_id)")
def chart_scatter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("b", F.col("n_chars") / F.lit(1000.0).cast("double"))
    return G.scatter(rows, "quality", "b")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ds' || page_id || '/m' ELSE 'a/m' || page_id END AS label, 'dim1__a_' || page_id AS name FROM pages")
def run_labels(spark, sf_dir):
    key = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/x/results/ds"), key, F.lit("/m/exp_1/metrics.json"))).otherwise(F.concat(F.lit("/y/a/m"), key, F.lit("/metrics.json")))
    return table(spark, sf_dir, "pages").select("page_id", G.label_of(path).alias("label"), G.safe_name(F.concat(F.lit("dim1/a "), key)).alias("name"))


# ---- tables ------------------------------------------------------------------------------

TWO_TABLES = """n AS (SELECT n_name AS r, n_nationkey AS rn, m AS c, mn AS cn, 'n' || n_nationkey AS cell FROM nation, (VALUES ('x', 2), ('w', 1)) v(m, mn) WHERE n_nationkey % 2 = 0),
o AS (SELECT n_name AS r, 24 - n_nationkey AS rn, m AS c, mn AS cn, 'o' || n_nationkey AS cell FROM nation, (VALUES ('z', 1), ('x', 2), ('y', 3)) v(m, mn) WHERE n_nationkey > 9)"""


@query(f"""WITH {TWO_TABLES}, w AS (SELECT q.r, row_number() OVER (ORDER BY min(k), min(rn)) AS row_no FROM (SELECT r, 0 AS k, rn FROM o UNION ALL SELECT n.r, 1, n.rn FROM n WHERE n.r NOT IN (SELECT o.r FROM o)) q GROUP BY q.r)
SELECT w.r AS "row", row_no, c.c AS "column", c.k AS column_no, coalesce(n.cell, o.cell, '-') AS cell FROM w, (VALUES ('z', 1), ('y', 2), ('w', 3), ('x', 4)) c(c, k) LEFT JOIN n ON n.r = w.r AND n.c = c.c LEFT JOIN o ON o.r = w.r AND o.c = c.c""")
def ordered_merge(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    columns = lambda *names: F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(i).alias("column_no")) for c, i in names))).alias("c")
    new = n.filter(k % 2 == 0).select(F.col("n_name").alias("row"), k.alias("row_no"), columns(("x", 2), ("w", 1)), F.concat(F.lit("n"), k.cast("string")).alias("cell")).select("row", "row_no", "c.*", "cell")
    old = n.filter(k > 9).select(F.col("n_name").alias("row"), (24 - k).alias("row_no"), columns(("z", 1), ("x", 2), ("y", 3)), F.concat(F.lit("o"), k.cast("string")).alias("cell")).select("row", "row_no", "c.*", "cell")
    return R.merged_table(new, old)


@query(f"WITH {METRICS} SELECT unnest(['accuracy', 'correct', 'total']) AS \"row\", model AS \"column\", unnest([printf('%.4f', acc), round(acc * n)::BIGINT::VARCHAR, n::VARCHAR]) AS cell FROM m WHERE d1 = ''")
def basic_table(spark, sf_dir):
    return R.basic_cells(metrics(spark, sf_dir))


@query(f"WITH {METRICS} SELECT CASE WHEN d2 = '' THEN d1 ELSE d1 || '/' || s1 || '/' || d2 END AS section, CASE WHEN d2 = '' THEN s1 ELSE s2 END AS \"row\", model AS \"column\", printf('%.4f', acc) AS cell FROM m WHERE d1 NOT IN ('', 'q4_counts') UNION ALL SELECT '', 'rate', model, printf('%.4f', acc) FROM m WHERE d1 = ''")
def other_tables(spark, sf_dir):
    m = metrics(spark, sf_dir)
    names = F.explode(F.array(F.lit("rate"), F.lit("total"))).alias("name")
    scalars = m.filter(F.size("path") == 0).select("model", names, F.col("acc").alias("value"))
    counts = m.filter(F.size("path") == 1).limit(1).select("model", F.array(F.struct(F.lit("q4_counts").alias("dim"), F.lit("x").alias("split"))).alias("path"), "acc", "n")
    return R.benchmark_sections(R.other_sections(m.unionByName(counts), scalars))


@query(f"WITH {METRICS} SELECT d1 || '.' || s1 AS name, round(acc, 6) AS value FROM m WHERE model = 'BUILDING' AND d1 <> '' AND d2 = ''")
def extra_metrics(spark, sf_dir):
    return R.extra_metrics(metrics(spark, sf_dir).filter("model = 'BUILDING'")).withColumn("value", F.round("value", 6))


@query("SELECT DISTINCT CASE WHEN s_nationkey % 3 = 0 THEN 'shown ' || s_nationkey ELSE 'm' || s_nationkey || '/Judge-' || s_suppkey % 2 END AS name FROM supplier")
def display_names(spark, sf_dir):
    k = F.col("s_nationkey").cast("string")
    path = F.concat(F.lit("m"), k, F.lit("/Judge-"), (F.col("s_suppkey") % 2).cast("string"), F.lit("/config.json"))
    shown = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit(" shown "), k)).when(F.col("s_nationkey") % 3 == 1, "")
    return R.display_names(table(spark, sf_dir, "supplier").select(path.alias("path"), shown.alias("table_display")))


@query("SELECT label, CASE WHEN label = 'm3' THEN 'm3/Judge-1' ELSE label END AS resolved FROM (SELECT 'm' || n_nationkey AS label FROM nation)")
def resolved_labels(spark, sf_dir):
    raw = table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("label"))
    known = spark.createDataFrame([("m1",), ("m1/Judge-1",), ("m2/Judge-1",), ("m2/Judge-2",), ("m3/Judge-1",), ("m30/Judge-1",)], "label string")
    return markdown.resolved(raw, known)


@query("SELECT l_linenumber, '#' || lpad(lower(hex(round(255 + v * (99 - 255))::BIGINT)), 2, '0') || lpad(lower(hex(round(255 + v * (190 - 255))::BIGINT)), 2, '0') || lpad(lower(hex(round(255 + v * (123 - 255))::BIGINT)), 2, '0') AS colour FROM (SELECT l_linenumber, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS v FROM (SELECT l_linenumber, avg(l_linenumber::DOUBLE) AS a FROM lineitem GROUP BY 1))")
def cell_colours(spark, sf_dir):
    from pyspark.sql import Window

    every = Window.partitionBy()
    m = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg(F.col("l_linenumber").cast("double")).alias("a"))
    return m.select("l_linenumber", R.colour(F.col("a"), F.min("a").over(every), F.max("a").over(every)).alias("colour"))


@query("SELECT o_orderpriority AS split, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'X') AS \"X\", count(*) AS total FROM orders GROUP BY 1")
def label_summary(spark, sf_dir):
    return R.label_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("label")), ["split"], ["F", "X"])


@query(f"WITH {METRICS}, p AS (SELECT d1, s1, d2, s2, max(acc) FILTER (WHERE model = 'BUILDING') AS a, max(acc) FILTER (WHERE model = 'MACHINERY') AS b FROM m GROUP BY ALL) SELECT d1 || s1 || d2 || s2 AS path, round(a, 6) AS acc, round(b, 6) AS baseline, round(a - b, 6) AS diff FROM p WHERE a IS NOT NULL")
def baseline_diff(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("path", F.array_join(F.transform("path", lambda s: F.concat(s["dim"], s["split"])), ""))
    of = lambda name: m.filter(F.col("model") == name).select("path", "acc")
    out = R.compared(of("BUILDING"), of("MACHINERY"), ["path"], "acc")
    return out.select("path", *(F.round(c, 6).alias(c) for c in ("acc", "baseline", "diff")))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'answer_missing,no_correct_answer' WHEN 1 THEN 'story_missing' WHEN 2 THEN 'question_empty,no_correct_answer' END AS violations FROM nation WHERE n_regionkey < 3")
def schema_violations(spark, sf_dir):
    r = F.col("n_regionkey")
    answer = F.struct(F.array(F.when(r == 2, " ").otherwise("x")).alias("correct_answers"), F.array().cast("array<string>").alias("wrong_answers"))
    s = table(spark, sf_dir, "nation").select("n_nationkey", F.when(r != 0, answer).alias("answer"), F.when(r != 1, F.lit("s")).alias("story"), F.when(r == 2, " ").otherwise("q").alias("question"))
    return tables.violations(s).select("n_nationkey", F.array_join("violations", ",").alias("violations"))


# ---- files: written to the application's scratch folder and read back ---------------------


def scratch(spark, name: str) -> str:
    import uuid

    return f"{folder(spark)}/{uuid.uuid4().hex}/{name}"


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n, 'subset/even,subset/odd' AS subsets FROM orders GROUP BY 1, 3")
def split_files(spark, sf_dir):
    root, o = scratch(spark, "root"), table(spark, sf_dir, "orders").select("o_orderkey")
    for name, rest, split in (("even", 0, "train"), ("odd", 1, "test")):
        tables.write_public(o.filter(F.col("o_orderkey") % 2 == rest).coalesce(1).withColumn("_private", F.lit(1)), f"{root}/subset/{name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/subset/{name}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(n for n, _ in tables.located(spark, f"{root}/subset/{name}") if n.endswith(".parquet"))
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(path, part), spark._jvm.org.apache.hadoop.fs.Path(path, f"{split}-00000.parquet"))
    read = tables.read_split(spark, f"{root}/subset/even").unionByName(tables.read_split(spark, f"{root}/subset/odd", "test"))
    return read.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("subsets", F.lit(",".join(tables.subsets(spark, root))))


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice) IS NOT NULL AS priced FROM orders GROUP BY 1")
def union_of_folders(spark, sf_dir):
    root, o = scratch(spark, "union"), table(spark, sf_dir, "orders")
    o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.parquet(f"{root}/a/deep")
    o.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(f"{root}/b")
    read = tables.read_all(spark, f"{root}/a", f"{root}/b")
    prices = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("_p"))
    read = read.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("p")).join(prices, "o_custkey", "left")
    return read.select("o_custkey", "n", F.coalesce("p", "_p").isNotNull().alias("priced"))


@query("SELECT o_orderkey FROM orders ORDER BY sha256('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 60")
def kept_sample(spark, sf_dir):
    path, o = scratch(spark, "sample"), table(spark, sf_dir, "orders").select("o_orderkey")
    tables.sampled(o, "o_orderkey", 60, path)
    return tables.sampled(o.limit(0), "o_orderkey", 60, path)


@query("SELECT (event_id // 2)::VARCHAR AS sample_id, 0 AS repeat, bool_and(user_id % 3 > 0) AS is_correct, CASE WHEN event_id // 2 % 2 = 0 THEN 'new' ELSE 'old' END AS layout FROM events GROUP BY ALL")
def verdict_files(spark, sf_dir):
    root = scratch(spark, "runs")
    v = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).cast("string").alias("sample_id"), F.lit(0).alias("repeat"), (F.col("user_id") % 3 > 0).alias("is_correct"))
    new, old = v.filter("sample_id % 2 = 0"), v.filter("sample_id % 2 = 1")
    none = spark.createDataFrame([], "path array<string>, acc double, n long")
    runs.write_run(new, none, f"{root}/d/m/exp_1")
    document = old.agg(F.array(F.struct(F.collect_list(F.struct("sample_id", "repeat", "is_correct")).alias("per_sample_results"))).alias("all_metrics"))
    document.select(F.to_json(F.struct("all_metrics")).alias("value")).coalesce(1).write.text(f"{root}/d/m/exp_0/metrics.json")
    read = runs.read_verdicts(spark, f"{root}/d/m/exp_1/detailed_metrics.jsonl").withColumn("layout", F.lit("new"))
    older = runs.read_verdicts(spark, f"{root}/d/m/exp_0/metrics.json", legacy=True).withColumn("layout", F.lit("old"))
    return read.unionByName(older).select("sample_id", "repeat", "is_correct", "layout")


@query("SELECT c_custkey::VARCHAR AS sample_id, c_name AS content, c_custkey % 2 AS repeat, 'cot' AS extractor FROM customer")
def prediction_files(spark, sf_dir):
    path = scratch(spark, "prediction.jsonl")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), (F.col("c_custkey") % 2).cast("int").alias("repeat"), F.struct(F.col("c_name").alias("content"), F.lit("").alias("reasoning")).alias("pred"), F.lit("cot").alias("extractor"))
    tables.write_lines(c.filter("repeat = 0"), path)
    tables.write_lines(c.filter("repeat = 1"), path, append=True)
    return runs.read_predictions(spark, path).select("sample_id", "pred.content", F.col("repeat").cast("long").alias("repeat"), "extractor")


@query("SELECT 'd' || n_regionkey AS dataset, 'm' || n_nationkey % 2 AS model, 'exp_' || max(n_nationkey + 10) AS exp, 'exp_' || max(CASE WHEN n_nationkey < 20 THEN n_nationkey + 10 END) AS valid FROM nation GROUP BY ALL HAVING max(CASE WHEN n_nationkey < 20 THEN 1 END) = 1")
def run_catalog(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    run = n.select(F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("dataset"), F.concat(F.lit("m"), (F.col("n_nationkey") % 2).cast("string")).alias("model"), F.concat(F.lit("exp_"), (F.col("n_nationkey") + 10).cast("string")).alias("exp"), F.when(F.col("n_nationkey") < 20, F.array(*map(F.lit, ("prediction.jsonl", *runs.FILES)))).otherwise(F.array(F.lit("prediction.jsonl"))).alias("files"))
    run = run.withColumn("valid", F.size(F.array_except(F.array(*map(F.lit, runs.FILES)), "files")) == 0)
    return runs.latest(run, "prediction.jsonl").join(runs.latest(run).withColumnRenamed("exp", "valid"), ["dataset", "model"])


@query("SELECT o_custkey, 'row ' || min(o_orderkey) AS note FROM orders GROUP BY 1")
def answered_table(spark, sf_dir):
    """Calls kept in a table: the second round asks only for those that the first did not answer."""
    from qaspark.plans.stand_ins import repeat_prompt
    from qaspark.sources import responder

    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("row "), F.min("o_orderkey").cast("string")).alias("prompt"))
    path = scratch(spark, "answers")
    responder.ask(o.filter("o_custkey % 2 = 0"), repeat_prompt, "o_custkey", path)
    again = responder.ask(o, repeat_prompt, "o_custkey", path)
    return again.select("o_custkey", F.col("content").alias("note"))


@query("SELECT sample_id, repeat, 'kept' AS state FROM (SELECT (event_id // 8)::VARCHAR AS sample_id, event_id % 8 AS repeat FROM events WHERE event_id % 3 > 0)")
def unfinished_items(spark, sf_dir):
    from qaspark.operators import quality as Q

    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).cast("string").alias("sample_id"), (F.col("event_id") % 8).alias("repeat"), "event_id")
    done = e.filter("event_id % 3 = 0")
    return Q.resume(e, done, ["sample_id", "repeat"]).select("sample_id", "repeat", F.lit("kept").alias("state"))


@query("""WITH d(dataset, a, b, c) AS (VALUES ('EmoBench', 'type', '—', '—'), ('EmoBench', 'subset', '—', '—'), ('EmoBench', 'language', '—', '—'), ('EmoBench', 'question_subtype', '—', '—'), ('EmoBench', 'coarse_category', 'finegrained_category', '—'), ('EmoBench', 'dimension', '—', '—'),
('rubric', 'type', '—', '—'), ('rubric', 'dim1', 'dim2', 'dim3'), ('rubric', 'qtype', '—', '—'), ('rubric', 'perspective', '—', '—'), ('rubric', 'variant', '—', '—'), ('rubric', 'length', '—', '—')) SELECT r_name, dataset, a AS second, b AS third, c AS fourth FROM d, region""")
def metric_definitions(spark, sf_dir):
    from qaspark.plans import tasks as T

    rows = [(d, *r) for d in ("EmoBench", "rubric") for r in T.definitions(d)]
    return table(spark, sf_dir, "region").select("r_name").join(F.broadcast(spark.createDataFrame(rows, "dataset string, second string, third string, fourth string")), F.lit(True))


@query("WITH s AS (SELECT o_custkey AS sid, count(*) FILTER (WHERE o_orderstatus <> 'F') AS wrong, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT (count(*) FILTER (WHERE wrong > 0))::DOUBLE / count(*) AS rate FROM s) SELECT 's' || sid AS sample_id, '### s' || sid || E'\\n\\n- tier: ' || CASE WHEN rate > 0.7 AND wrong = n THEN 1 WHEN rate > 0.5 AND wrong * 2 >= n THEN 2 ELSE 3 END || E'\\n- wrong: ' || wrong || ' of ' || n || E'\\n- group: x (' || printf('%.4f', rate) || E')\\n- answer: [\"A\"]\\n' AS text FROM s, g WHERE wrong > 0")
def bad_case_report(spark, sf_dir):
    from qaspark.operators import badcases as B

    sample = F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sample_id")
    o = table(spark, sf_dir, "orders").select(sample, F.col("o_orderkey").alias("repeat"), "o_orderstatus")
    records = o.select("sample_id", "repeat", F.lit("mcq_single").alias("prompt_type"), F.parse_json(F.lit('{"ability": "x"}')).alias("meta"), F.array(F.lit("x")).alias("correct_answers"), F.array(F.lit("A")).alias("correct_letters"))
    cases = B.samples(records, o.select("sample_id", "repeat", (F.col("o_orderstatus") == "F").alias("is_correct")))
    return B.case_lines(B.worst(cases))


@query("SELECT n_nationkey::VARCHAR AS sample_id, '' AS story, 'q' AS question, n_name AS right FROM nation WHERE n_nationkey > 0")
def coerced_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey > 0")
    raw = n.select(F.col("n_nationkey").cast("string").alias("sample_id"), F.lit(None).cast("string").alias("story"), F.lit("q").alias("question"), F.struct(F.array(F.concat(F.lit(" "), "n_name"), F.lit(" "), F.lit(None).cast("string")).alias("correct_answers"), F.lit(None).cast("array<string>").alias("wrong_answers")).alias("answer"))
    return tables.coerced(raw).select("sample_id", "story", "question", F.array_join(F.concat("answer.correct_answers", "answer.wrong_answers"), ",").alias("right"))
