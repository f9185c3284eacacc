"""The queries over the driver's tables that show each operator, and the same in SQL.

The tables hold no answers, so `events` is read as predictions: eight repeats of each sample, five models,
responses made by arithmetic. Each entry pairs a DataFrame with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions import answers as A
from qaspark.operators import metrics as M
from qaspark.operators import quality as Q
from qaspark.operators import report as R
from qaspark.operators import selection as S
from qaspark.operators import similarity as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PREDS = r"""p AS (SELECT event_id, event_id // 8 AS sample_no, event_id % 8 AS repeat, event_type AS model,
  CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'no final answer 42'
    ELSE 'try \boxed{Z} then \boxed{' || chr((65 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4)) || '}' END AS content,
  chr((65 + (event_id // 8) % 4)::INTEGER) AS gold FROM events)"""
#: The 'cot' extractor on such responses: the last box, else the last letter.
VERDICTS = PREDS + r""", x AS (SELECT *, coalesce(regexp_extract_all(trim(content), '\\box(?:ed)?\s*\{([^{}]*)\}', 1)[-1], regexp_extract_all(right(trim(content), 200), '[A-Za-z]')[-1]) AS raw FROM p),
v AS (SELECT *, upper(raw) AS letter, CASE WHEN content IS NULL OR content = '' THEN false ELSE coalesce(upper(raw) = gold, false) END AS ok,
  CASE WHEN content IS NULL OR content = '' THEN 'content_none' WHEN raw IS NULL THEN 'extraction_failed' WHEN NOT coalesce(upper(raw) = gold, false) THEN 'wrong_answer' END AS reason FROM x)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    box = F.concat(F.lit(r"try \boxed{Z} then \boxed{"), F.char(65 + k % 4), F.lit("}"))
    kind = F.col("event_id") % 10
    content = F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, "no final answer 42").otherwise(box)
    sample = F.floor(F.col("event_id") / 8).cast("long")
    return e.select("event_id", sample.alias("sample_no"), (F.col("event_id") % 8).alias("repeat"), F.col("event_type").alias("model"), content.alias("content"), F.char(65 + sample % 4).alias("gold"))


def verdicts(spark: SparkSession, sf_dir: str, extractor: str = "cot") -> DataFrame:
    p = predictions(spark, sf_dir)
    p = p.withColumn("letter", A.single_letter(A.extracted(F.col("content"), extractor)))
    return M.graded(p, F.col("content"), F.col("letter"), F.col("gold"))


@query(f"WITH {VERDICTS} SELECT event_id, letter, ok AS is_correct, reason AS error_reason FROM v")
def rule_judge_cot(spark, sf_dir):
    return verdicts(spark, sf_dir).select("event_id", "letter", "is_correct", "error_reason")


def _judge_sql(raw: str) -> str:
    return rf"WITH {PREDS}, b AS (SELECT *, regexp_extract_all(trim(content), '\\box(?:ed)?\s*\{{([^{{}}]*)\}}', 1) AS boxes, regexp_extract_all(trim(content), '[A-Za-z]') AS ls FROM p) SELECT event_id, upper(regexp_extract_all({raw}, '[A-Za-z]')[1]) AS letter FROM b"


@query(_judge_sql("coalesce(boxes[1], ls[1])"))
def extract_direct(spark, sf_dir):
    return verdicts(spark, sf_dir, "direct").select("event_id", "letter")


@query(_judge_sql("boxes[-1]"))
def extract_legacy(spark, sf_dir):
    return verdicts(spark, sf_dir, "legacy").select("event_id", "letter")


@query(f"WITH {VERDICTS} SELECT model, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, count(*) FILTER (WHERE reason = 'extraction_failed') AS extraction_failed, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 6) AS accuracy FROM v GROUP BY model")
def base_metrics_by_model(spark, sf_dir):
    return M.base_metrics(verdicts(spark, sf_dir), ["model"]).select("model", "correct", "total", "extraction_failed", F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {VERDICTS}, d AS (SELECT ok, 'model' AS dim, model AS split FROM v UNION ALL SELECT ok, 'gold', gold FROM v UNION ALL SELECT ok, 'letters', unnest(CASE WHEN letter IS NULL THEN ['unknown'] ELSE [letter, gold] END) FROM v)
SELECT dim, split, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 6) AS acc, count(*) AS n FROM d GROUP BY dim, split""")
def eval_dimensions(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    keys = {"model": F.col("model"), "gold": F.col("gold"), "letters": F.when(F.col("letter").isNotNull(), F.array("letter", "gold"))}
    return M.dimensions(v, keys).select("dim", "split", F.round("acc", 6).alias("acc"), "n")


NATIONS = "o AS (SELECT o_orderstatus = 'F' AS ok, r_name AS region, n_name AS nation, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {NATIONS} SELECT (3 - grouping(region) - grouping(nation) - grouping(segment))::INTEGER AS level, region, nation, segment, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 6) AS acc, count(*) AS n FROM o GROUP BY GROUPING SETS ((region), (region, nation), (region, nation, segment))")
def nested_dimensions(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = o.select((F.col("o_orderstatus") == "F").alias("is_correct"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return M.nested(o, ["region", "nation", "segment"]).withColumn("acc", F.round("acc", 6))


@query("WITH m AS (SELECT l_orderkey, l_returnflag, bool_and(l_quantity > 2) AS ok FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL), g AS (SELECT l_orderkey, count(*) AS have, bool_and(ok) AS ok FROM m GROUP BY l_orderkey) SELECT count(*) AS groups, count(*) FILTER (WHERE ok) AS groups_correct, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 6) AS acc FROM g WHERE have = 2")
def conjunctive_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_quantity") > 2).alias("is_correct"))
    return M.all_correct(rows, "l_orderkey", "l_returnflag", ["A", "N"]).withColumn("acc", F.round("acc", 6))


@query(f"WITH {VERDICTS}, g AS (SELECT model, (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS a FROM v GROUP BY model) SELECT (SELECT round(avg(a), 6) FROM g) AS macro_acc, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 6) AS micro_acc, (SELECT count(*) FROM g) AS splits FROM v")
def macro_micro(spark, sf_dir):
    return M.macro(verdicts(spark, sf_dir), "model").select(F.round("macro_acc", 6).alias("macro_acc"), F.round("micro_acc", 6).alias("micro_acc"), "splits")


@query(f"WITH {VERDICTS}, g AS (SELECT model, repeat, (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS a FROM v GROUP BY ALL) SELECT model, round(avg(a), 6) AS acc FROM g GROUP BY model")
def cross_repeat_mean(spark, sf_dir):
    per = M.base_metrics(verdicts(spark, sf_dir), ["model", "repeat"]).withColumnRenamed("accuracy", "acc")
    return M.over_repeats(per, ["model"], ["acc"]).withColumn("acc", F.round("acc", 6))


@query(f"WITH {VERDICTS}, c AS (SELECT sample_no, letter, count(letter) AS c FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sample_no ORDER BY c DESC, letter NULLS LAST) AS r FROM c) SELECT sample_no, letter AS vote FROM r WHERE r = 1")
def majority_vote(spark, sf_dir):
    return M.majority(verdicts(spark, sf_dir), "sample_no", "letter")


@query(f"WITH {VERDICTS}, c AS (SELECT sample_no, letter, count(*) AS c FROM v WHERE letter IS NOT NULL GROUP BY ALL), n AS (SELECT sample_no, count(*) AS n FROM v GROUP BY ALL) SELECT n.sample_no, string_agg(letter, ',' ORDER BY letter) FILTER (WHERE c * 2 > n) AS votes FROM n LEFT JOIN c USING (sample_no) GROUP BY n.sample_no")
def strict_majority_vote(spark, sf_dir):
    v = verdicts(spark, sf_dir).withColumn("chosen", F.when(F.col("letter").isNotNull(), F.array("letter")))
    return M.strict_majority(v, "sample_no", "chosen").select("sample_no", F.array_join("votes", ",").alias("votes"))


@query("SELECT count(*) AS n, round(avg(abs(quality - toxic)), 6) AS mae, round(avg(quality - toxic), 6) AS mean_diff, round(stddev_pop(quality - toxic), 6) AS sd FROM labels HAVING count(*) >= 3")
def judge_agreement(spark, sf_dir):
    return M.agreement(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("mae", 6).alias("mae"), F.round("mean_diff", 6).alias("mean_diff"), F.round("sd", 6).alias("sd"))


LABELED = VERDICTS + """, k AS (SELECT sample_no, count(*) FILTER (WHERE ok) AS passed, count(*) AS k, count(*) FILTER (WHERE ok AND repeat < 3) AS a, count(*) FILTER (WHERE ok AND repeat >= 5) AS b, count(*) FILTER (WHERE ok AND repeat IN (3, 4)) AS c FROM v GROUP BY sample_no),
w AS (SELECT k.*, CASE WHEN passed >= k THEN 'all_passed' WHEN passed <= 0 THEN 'all_failed' ELSE 'partial' END AS bucket, l.quality = 1 AS answerable, a >= 2 OR b >= 2 OR c < 2 AS short FROM k LEFT JOIN labels l ON k.sample_no = l.doc_id),
t AS (SELECT *, CASE WHEN bucket = 'all_passed' THEN 'easy' WHEN NOT coalesce(answerable, false) THEN 'bad' WHEN bucket = 'all_failed' THEN 'hard' WHEN short THEN 'shortcut' ELSE 'medium' END AS label FROM w)"""


def labeled(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    ok = lambda test: F.count_if(F.col("is_correct") & test)
    k = v.groupBy("sample_no").agg(F.count_if("is_correct").alias("passed"), F.count(F.lit(1)).alias("k"), ok(F.col("repeat") < 3).alias("a"), ok(F.col("repeat") >= 5).alias("b"), ok(F.col("repeat").isin(3, 4)).alias("c"))
    k = k.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_no"), (F.col("quality") == 1).alias("answerable")), "sample_no", "left")
    k = k.withColumn("bucket", Q.bucket(F.col("passed"), F.col("k"))).withColumn("short", Q.shortcut(F.col("a"), F.col("b"), F.col("c"), F.lit(2)))
    return k.withColumn("label", Q.label(F.col("bucket"), F.col("answerable"), F.col("short")))


@query(f"WITH {LABELED} SELECT sample_no, passed AS pass_at_k, bucket, label, CASE label WHEN 'easy' THEN 'easy' WHEN 'bad' THEN 'unanswerable' WHEN 'shortcut' THEN 'shortcut' END AS repair_type FROM t")
def quality_labels(spark, sf_dir):
    return labeled(spark, sf_dir).select("sample_no", F.col("passed").alias("pass_at_k"), "bucket", "label", Q.repair_type(F.col("label")).alias("repair_type"))


@query(f"WITH {LABELED} SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM t GROUP BY label")
def label_histogram(spark, sf_dir):
    return Q.histogram(labeled(spark, sf_dir), "label")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def keep_last_version(spark, sf_dir):
    return Q.keep_last(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_rest(spark, sf_dir):
    return Q.resume(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query(f"WITH {VERDICTS}, s AS (SELECT model, sample_no, NOT bool_and(ok) AS wrong FROM v GROUP BY ALL) SELECT model, count(*) AS total, count(*) FILTER (WHERE wrong) AS wrong, round((count(*) FILTER (WHERE wrong))::DOUBLE / count(*), 6) AS error_rate FROM s GROUP BY model")
def dimension_error_rates(spark, sf_dir):
    return S.dimension_errors(verdicts(spark, sf_dir), "model", "sample_no").withColumn("error_rate", F.round("error_rate", 6))


@query(f"WITH {VERDICTS}, d AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY sample_no)::BIGINT AS difficulty FROM v) SELECT sample_no, repeat, model, difficulty FROM d WHERE NOT ok")
def bad_case_difficulty(spark, sf_dir):
    return S.bad_cases(verdicts(spark, sf_dir), "sample_no").select("sample_no", "repeat", "model", "difficulty")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    return S.hash_sample(table(spark, sf_dir, "orders"), F.col("o_orderkey"), 50).select("o_orderkey")


#: Words and what stands between them, so that an article is a whole word; no look-around in this SQL.
TOKENS = r"""list_filter(string_split_regex(translate(array_to_string(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: CASE WHEN x IN ('a', 'an', 'the') THEN ' ' ELSE x END), ''), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '[ \t\n\r\f]+'), lambda x: x <> '')"""
F1_SQL = "round(CASE WHEN nq + na = 0 THEN 1.0 WHEN nq = 0 OR na = 0 THEN 0.0 ELSE 2.0 * shared / (nq + na) END::DOUBLE, 6)"


def _f1_sql(tokens: str) -> str:
    return f"""WITH c AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role FROM conversations), t AS (SELECT conv_id, turn, {tokens.format('q')} AS q, {tokens.format('a')} AS a FROM c WHERE role = 'user' AND a IS NOT NULL),
s AS (SELECT conv_id, turn, len(q) AS nq, len(a) AS na, coalesce(list_sum(list_transform(list_distinct(q), lambda x: least(len(list_filter(q, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))), 0) AS shared FROM t) SELECT conv_id, turn, {F1_SQL} AS f1 FROM s"""


def _turns(spark, sf_dir, tokens):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("a", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    c = c.filter((F.col("role") == "user") & F.col("a").isNotNull()).select("conv_id", "turn", tokens(F.col("text")).alias("q"), tokens(F.col("a")).alias("a"))
    return c.select("conv_id", "turn", F.round(A.max_f1(F.col("q"), F.array("a")), 6).alias("f1"))


@query(_f1_sql(TOKENS))
def token_f1_turns(spark, sf_dir):
    return _turns(spark, sf_dir, A.english_tokens)


@query(_f1_sql(r"""list_filter(string_split(translate(regexp_replace({0}, '[ \t\n\r\f]+', '', 'g'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), ''), lambda x: x <> '')"""))
def character_f1_turns(spark, sf_dir):
    return _turns(spark, sf_dir, A.chinese_tokens)


@query("SELECT lang, CASE WHEN starts_with(lower(trim(lang)), 'zh') THEN 'zh' ELSE 'en' END AS prompt_lang, count(*) AS n FROM documents GROUP BY ALL")
def prompt_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", A.language(F.col("lang")).alias("prompt_lang")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, ('0x' || substr(sha256('part|' || p_partkey::VARCHAR || '|0'), 1, 16))::UBIGINT::VARCHAR AS seed FROM part")
def shuffle_seeds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.shuffle_seed(F.lit("part"), F.col("p_partkey").cast("string"), F.lit("0")).cast("string").alias("seed"))


GRAMS = r"""n AS (SELECT k, id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
c AS (SELECT k, id, t, string_split(t, '') AS c FROM n WHERE length(t) > 0),
u AS (SELECT k, id, unnest(c) AS a, unnest(c[2:]) AS b, unnest(c[3:]) AS d, unnest(c[4:]) AS e FROM c),
g AS (SELECT DISTINCT k, id, a || b || d || e AS g FROM u WHERE e IS NOT NULL UNION ALL SELECT k, id, t FROM c WHERE length(t) < 4), z AS (SELECT k, id, count(*) AS z FROM g GROUP BY ALL)"""


@query(f"WITH {GRAMS}, s AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g WHERE a.k = 'd' AND b.k = 'b' GROUP BY ALL) SELECT a, b, round(shared::DOUBLE / z, 6) AS containment FROM s JOIN z ON z.k = 'b' AND z.id = s.b WHERE shared::DOUBLE / z >= 0.9")
def leaked_passages(spark, sf_dir):
    found = D.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 0.9)
    return found.withColumn("containment", F.round("containment", 6))


@query(f"WITH {VERDICTS}, m AS (SELECT gold, model, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 4) AS acc FROM v GROUP BY ALL) SELECT gold, coalesce(printf('%.4f', max(acc) FILTER (WHERE model = 'click')), '-') AS click, coalesce(printf('%.4f', max(acc) FILTER (WHERE model = 'error')), '-') AS error FROM m GROUP BY gold")
def summary_pivot(spark, sf_dir):
    m = M.base_metrics(verdicts(spark, sf_dir), ["gold", "model"]).withColumn("accuracy", F.round("accuracy", 4))
    return R.summary(m, "gold", "model", "accuracy", ["click", "error"])


@query("WITH n AS (SELECT n_name, count(*)::VARCHAR AS cell FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), o AS (SELECT n_name, count(*)::VARCHAR AS cell FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_name, coalesce(n.cell, o.cell, '-') AS cell FROM n FULL JOIN o USING (n_name)")
def merged_tables(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    cells = lambda t, k: table(spark, sf_dir, t).join(nation, F.col(k) == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).cast("string").alias("cell"))
    return R.merged(cells("supplier", "s_nationkey"), cells("customer", "c_nationkey"), ["n_name"], "cell")


@query("SELECT event_type AS model, max('exp_' || strftime(ts, '%Y%m%d_%H%M%S')) AS exp FROM events GROUP BY ALL")
def latest_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.concat(F.lit("exp_"), F.date_format("ts", "yyyyMMdd_HHmmss")).alias("exp"))
    return R.latest(runs, ["model"], "exp")


@query(f"WITH {VERDICTS}, s AS (SELECT sample_no, count(*) FILTER (WHERE NOT ok) AS wrong, count(*) AS total FROM v GROUP BY ALL) SELECT sample_no, wrong, CASE WHEN wrong >= total THEN 1 WHEN 2 * wrong >= total THEN 2 ELSE 3 END AS tier FROM s ORDER BY tier, wrong DESC, sample_no LIMIT 100")
def bad_case_tiers(spark, sf_dir):
    s = verdicts(spark, sf_dir).groupBy("sample_no").agg(F.count_if(~F.col("is_correct")).alias("wrong"), F.count(F.lit(1)).alias("total"))
    return s.select("sample_no", "wrong", R.tiers(F.col("wrong"), F.col("total")).alias("tier")).orderBy("tier", F.col("wrong").desc(), "sample_no").limit(100)


@query("WITH b AS (SELECT o_custkey, 'v1' AS version, min(o_orderkey) AS score FROM orders GROUP BY ALL), i AS (SELECT o_custkey, 'v2' AS version, max(o_orderkey) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT coalesce(i.o_custkey, b.o_custkey) AS o_custkey, coalesce(i.version, b.version) AS version, coalesce(i.score, b.score) AS score FROM b FULL JOIN i USING (o_custkey)")
def leaderboard_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    board = o.groupBy("o_custkey").agg(F.lit("v1").alias("version"), F.min("o_orderkey").alias("score"))
    fresh = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.lit("v2").alias("version"), F.max("o_orderkey").alias("score"))
    return R.upserted(board, fresh, ["o_custkey"], "version").select("o_custkey", "version", "score")
