"""Queries of grading, task metrics, prompts, calls and tables over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions import answers as A
from qaspark.functions import prompts as P
from qaspark.operators import judging as J
from qaspark.operators import selection as S
from qaspark.operators import similarity as D
from qaspark.operators.lineage import spread
from qaspark.plans import tasks as T
from qaspark.plans.evaluating import GRAMS, query, table
from qaspark.plans.stand_ins import echo
from qaspark.sources import markdown, responder, runs

# ---- events as answers of four question types ------------------------------------------

TYPED = r"""t AS (SELECT event_id, event_type, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_id % 7 = 0 AS none, ['mcq_single', 'mcq_multi', 'mcq_grouped', 'open'][event_id % 4 + 1] AS prompt_type FROM events),
j AS (SELECT *, CASE WHEN none THEN NULL WHEN prompt_type = 'mcq_single' THEN chr(65 + k % 4) WHEN prompt_type = 'mcq_multi' THEN CASE k % 4 WHEN 0 THEN 'A' ELSE 'A,' || chr(65 + k % 4) END WHEN prompt_type = 'mcq_grouped' AND k % 5 <> 0 THEN 'A,' || chr(65 + k % 4) END AS extracted,
  CASE WHEN NOT none AND prompt_type = 'open' THEN CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 / 3 ELSE 0.5 END END AS judge_score FROM t),
g AS (SELECT *, CASE WHEN none THEN false WHEN prompt_type = 'open' THEN judge_score >= 0.6 WHEN prompt_type = 'mcq_single' THEN extracted = chr((65 + event_id // 4 % 4)::INTEGER) WHEN prompt_type = 'mcq_multi' THEN extracted = 'A,B' ELSE coalesce(extracted = 'A,' || chr((65 + event_id // 4 % 4)::INTEGER), false) END AS is_correct FROM j)"""


def typed(spark, sf_dir) -> DataFrame:
    e = spread(table(spark, sf_dir, "events")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    e = e.withColumn("prompt_type", F.get(F.array(*map(F.lit, ("mcq_single", "mcq_multi", "mcq_grouped", "open"))), (F.col("event_id") % 4).cast("int")))
    letter, gold, kind = F.char(65 + F.col("k") % 4), F.char(65 + F.floor(F.col("event_id") / 4) % 4), F.col("prompt_type")
    box = lambda c: F.concat(F.lit(r"\boxed{"), c, F.lit("}"))
    parts = F.when(F.col("k") % 5 == 0, box(letter)).otherwise(F.concat(box(F.lit("C")), F.lit(" "), box(F.lit("a")), F.lit(" then "), box(letter)))
    content = F.when(kind == "mcq_single", F.concat(F.lit("so "), box(F.lower(letter)))).when(kind == "mcq_multi", box(F.concat(F.lit("A, "), letter))).when(kind == "mcq_grouped", parts).otherwise(F.concat(F.lit("It is "), box(F.concat(F.lit("the "), F.col("event_type"), F.lit(" event.")))))
    sub = lambda name, c: F.struct(F.lit(name).alias("subtype"), F.array(c).alias("correct_letters"))
    return e.select(
        "event_id", F.col("event_id").cast("string").alias("sample_id"), F.lit(0).alias("repeat"), "event_type", "user_id", "k", "prompt_type",
        F.when(F.col("event_id") % 7 != 0, content).alias("content"),
        F.when(kind == "mcq_multi", F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(gold)).alias("correct_letters"),
        F.array(F.lit("a click event"), F.lit("view")).alias("correct_answers"),
        F.lit("en").alias("lang"),
        F.array(sub("emotion", F.lit("A")), sub("cause", gold)).alias("sub_questions"),
    )


def judged(spark, sf_dir) -> DataFrame:
    return J.graded(typed(spark, sf_dir), "cot", 0.6)


@query(f"WITH {TYPED} SELECT event_id, extracted, round(judge_score, 6)::DOUBLE AS judge_score, is_correct, CASE WHEN none THEN 'content_none' WHEN prompt_type <> 'open' AND extracted IS NULL THEN 'extraction_failed' WHEN is_correct THEN NULL WHEN prompt_type = 'open' THEN 'below_threshold' ELSE 'wrong_answer' END AS error_reason FROM g")
def judge_by_type(spark, sf_dir):
    return judged(spark, sf_dir).select("event_id", F.array_join("extracted", ",").alias("extracted"), F.round("judge_score", 6).alias("judge_score"), "is_correct", "error_reason")


def with_meta(v: DataFrame, **keys) -> DataFrame:
    return v.withColumn("meta", F.to_variant_object(F.struct(*(c.alias(k) for k, c in keys.items()))))


def flat(m: DataFrame) -> DataFrame:
    path = F.array_join(F.transform("path", lambda s: F.concat_ws("=", s["dim"], s["split"])), "/")
    return m.select(*(c for c in m.columns if c == "scope"), path.alias("path"), F.round("acc", 6).alias("acc"), "n")


def _sql(parts: dict[str, str], more: str = "") -> str:
    """Accuracies by path expressions over the graded answers."""
    one = lambda p, cond: f"SELECT {p} AS path, is_correct FROM g WHERE {cond}"
    rows = " UNION ALL ".join(one(p, c) for p, c in ({"''": "true", "'type=' || prompt_type": "true"} | parts).items())
    return f"WITH {TYPED} SELECT path, round((count(*) FILTER (WHERE is_correct))::DOUBLE / count(*), 6) AS acc, count(*) AS n FROM ({rows}) GROUP BY path {more}"


@query(_sql({
    "'subset=' || chr((97 + user_id % 3)::INTEGER)": "true", "'language=unknown'": "true", "'question_subtype=' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END": "true",
    "'coarse_category=' || event_type": "true", "'coarse_category=' || event_type || '/finegrained_category=' || k % 3": "true",
    "'dimension=' || event_type": "true", "'dimension=x' || k % 2": "true",
}, "UNION ALL SELECT 'eu_subquestion=' || s, round(avg(ok::INTEGER), 6), count(*) FROM (SELECT unnest(['emotion', 'cause']) AS s, unnest([true, extracted = 'A,' || chr((65 + event_id // 4 % 4)::INTEGER)]) AS ok FROM g WHERE prompt_type = 'mcq_grouped' AND extracted IS NOT NULL) GROUP BY s"))
def task_nested_dimensions(spark, sf_dir):
    k, user = F.col("k"), F.col("user_id")
    v = with_meta(judged(spark, sf_dir), subset=F.char(97 + user % 3), question_subtype=k % 2 == 0, coarse_category=F.col("event_type"), finegrained_category=k % 3, dimension=F.array(F.col("event_type"), F.concat(F.lit(" x"), (k % 2).cast("string")), F.lit(" ")))
    return flat(T.evaluated(v, "EmoBench").drop("scope"))


KINDS = "(['beliefQAs', 'answerabilityQA_list', 'answerabilityQAs_binary', 'infoAccessibilityQA_list', 'infoAccessibilityQAs_binary', 'factQA'])[event_id % 6 + 1]"


@query(f"""WITH {TYPED}, m AS (SELECT event_id // 24 AS s, {KINDS} AS q, bool_and(is_correct OR prompt_type = 'open') AS ok FROM g GROUP BY ALL),
w AS (SELECT unnest(['overall', 'answerability', 'infoaccess']) AS split, unnest(['beliefQAs,answerabilityQA_list,answerabilityQAs_binary,infoAccessibilityQA_list,infoAccessibilityQAs_binary', 'answerabilityQA_list,answerabilityQAs_binary', 'infoAccessibilityQA_list,infoAccessibilityQAs_binary']) AS q),
c AS (SELECT split, s, bool_and(ok) AS ok, count(*) = any_value(len(string_split(w.q, ','))) AS all_there FROM m JOIN w ON list_contains(string_split(w.q, ','), m.q) GROUP BY split, s)
SELECT 'set_all=' || split AS path, round(coalesce((count(*) FILTER (WHERE ok AND all_there))::DOUBLE / nullif(count(*) FILTER (WHERE all_there), 0), 0), 6) AS acc, count(*) FILTER (WHERE all_there) AS n FROM c GROUP BY split""")
def task_joint_sets(spark, sf_dir):
    kinds = F.get(F.array(F.lit("beliefQAs"), *map(F.lit, (*T.ANSWERABILITY, *T.ACCESS)), F.lit("factQA")), (F.col("event_id") % 6).cast("int"))
    v = judged(spark, sf_dir).withColumn("is_correct", F.col("is_correct") | (F.col("prompt_type") == "open"))
    v = with_meta(v, question_type=kinds, snippet_id=F.floor(F.col("event_id") / 24))
    return flat(T.evaluated(v, "FanToM").drop("scope")).filter(F.col("path").startswith("set_all"))


@query(f"""WITH {TYPED}, p AS (SELECT event_id // 8 AS pair, event_id % 2 AS kind, bool_and(is_correct OR k % 3 > 0) AS ok FROM g GROUP BY ALL), b AS (SELECT pair, bool_and(ok) AS ok, count(*) AS kinds FROM p GROUP BY pair)
SELECT 'tb_and_fb=overall' AS path, round((count(*) FILTER (WHERE ok))::DOUBLE / count(*), 6) AS acc, count(*) AS n FROM b WHERE kinds = 2""")
def task_belief_pairs(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, "True-belief").otherwise("false belief")
    side = F.when(F.col("event_id") % 2 == 0, "_true_belief").otherwise("_false_belief")
    pair = F.concat(F.lit("story"), F.floor(F.col("event_id") / 8).cast("string"), side, F.lit("__"), (F.col("event_id") % 8).cast("string"))
    v = judged(spark, sf_dir).withColumn("is_correct", F.col("is_correct") | (F.col("k") % 3 > 0))
    return flat(T.evaluated(with_meta(v, id=pair, dimension=F.array(kind)), "BigToM").drop("scope")).filter(F.col("path").startswith("tb_and_fb"))


@query(f"""WITH {TYPED}, s AS (SELECT *, 'e' || user_id % 50 AS event, event_type AS style FROM g), u AS (SELECT 'event' AS split, event AS key, is_correct FROM s UNION ALL SELECT 'document', event || '_style_' || style || '_1', is_correct FROM s UNION ALL SELECT 'style', style, is_correct FROM s),
a AS (SELECT split, key, avg(is_correct::INTEGER) AS a FROM u GROUP BY ALL)
SELECT 'macro_split_acc=' || split AS path, round(avg(a), 6) AS acc, count(*) AS n FROM a GROUP BY split UNION ALL SELECT 'grading=informed', round(avg(is_correct::INTEGER), 6), count(*) FROM s UNION ALL SELECT 'grading=blind', round(avg(k * 0.5), 6), count(*) FROM s WHERE k % 2 = 0""")
def task_macro_means(spark, sf_dir):
    name = F.concat(F.lit("e"), (F.col("user_id") % 50).cast("string"), F.lit("_style_"), F.col("event_type"), F.lit("_1_question_"), F.col("event_id").cast("string"))
    v = with_meta(judged(spark, sf_dir), id=name, blind_grade_avg=F.when(F.col("k") % 2 == 0, F.col("k") * 0.5))
    return flat(T.evaluated(v, "FictionalQA").drop("scope")).filter(F.col("path").rlike("^(macro|grading)"))


@query(f"""WITH {TYPED}, u AS (SELECT is_correct, k % 3 = 0 AS up FROM g), m AS (SELECT avg(is_correct::INTEGER) FILTER (WHERE up) AS bu, count(*) FILTER (WHERE up) AS nu, avg(is_correct::INTEGER) FILTER (WHERE NOT up) AS bm, count(*) FILTER (WHERE NOT up) AS nm FROM u)
SELECT 'belief_reasoning=BREU' AS path, round((bu + bm) / 2, 6) AS acc, nu + nm AS n FROM m UNION ALL SELECT 'belief_reasoning=BU-Acc', round(bu, 6), nu FROM m UNION ALL SELECT 'belief_reasoning=BM-Acc', round(bm, 6), nm FROM m""")
def task_belief_reasoning(spark, sf_dir):
    v = with_meta(judged(spark, sf_dir), step=F.when(F.col("k") % 3 == 0, "time_T+1").otherwise("time_t"))
    return flat(T.evaluated(v, "Belief_R").drop("scope")).filter(F.col("path").startswith("belief_reasoning"))


@query(f"""WITH {TYPED}, s AS (SELECT 'all' AS scope, * FROM g UNION ALL SELECT 'qualified', * FROM g WHERE k % 4 = 0), u AS (SELECT scope, 'dim1=' || user_id % 3 || '/dim2=' || user_id % 3 || '.' || user_id % 2 || '/dim3=' || event_type AS path, is_correct FROM s)
SELECT scope, path, round(avg(is_correct::INTEGER), 6) AS acc, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT scope, 'q4_score=' || event_type, round(avg(judge_score), 6), count(judge_score) FROM s WHERE judge_score IS NOT NULL GROUP BY ALL UNION ALL SELECT scope, 'q4_score=overall', round(avg(judge_score), 6), count(judge_score) FROM s GROUP BY scope""")
def task_rubric_scopes(spark, sf_dir):
    first = (F.col("user_id") % 3).cast("string")
    v = with_meta(judged(spark, sf_dir), dim1=first, dim2=F.concat(first, F.lit("."), (F.col("user_id") % 2).cast("string")), dim=F.col("event_type"), review_pass=F.when(F.col("k") % 4 < 2, F.col("k") % 4 != 1))
    return flat(T.evaluated(v, "social", {"social": "rubric"})).filter(F.col("path").rlike("dim3=|^q4_score"))


@query(r"""WITH v AS (SELECT event_id // 8 AS s, event_id % 8 AS r, CASE WHEN event_id % 5 > 0 THEN chr(65 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3) END AS l FROM events), c AS (SELECT s, l, count(*) AS c FROM v WHERE l IS NOT NULL GROUP BY ALL), n AS (SELECT s, count(*) AS n FROM v GROUP BY s)
SELECT n.s::VARCHAR AS sample_id, n.n, CASE WHEN n.s % 2 = 0 THEN (SELECT l FROM c WHERE c.s = n.s ORDER BY c DESC, l LIMIT 1) ELSE (SELECT string_agg(l, ',' ORDER BY l) FROM c WHERE c.s = n.s AND c * 2 > n.n) END AS vote FROM n""")
def vote_collapse(spark, sf_dir):
    sample = F.floor(F.col("event_id") / 8)
    letter = F.char(65 + F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 3)
    v = table(spark, sf_dir, "events").select(sample.cast("string").alias("sample_id"), (F.col("event_id") % 8).alias("repeat"), F.when(sample % 2 == 0, "mcq_single").otherwise("mcq_multi").alias("prompt_type"), F.when(F.col("event_id") % 5 > 0, F.array(letter)).alias("extracted"))
    return J.collapsed(v).select("sample_id", "n", F.array_join("vote", ",").alias("vote"))


FORMS = ("\"A\"", "\"a\"", "\"AB\"", "[\"A\",\"C\"]", "[\"C\",\"A\"]", "[\"A\",\"A\"]", "[]", "\"A,C\"", "\"\"", "{\"label\": \"ambiguous\", \"reason\": \"two\"}", "no json", "so ```json\n{\"label\": \"bad\"}\n``` it is")
_FORMS_SQL = "[" + ", ".join("'" + f + "'" for f in FORMS) + "]"


@query(f"""WITH p AS (SELECT p_partkey, (p_partkey % {len(FORMS)})::INTEGER AS f, ['mcq_single', 'mcq_multi', 'mcq_grouped', 'open'][(p_partkey // {len(FORMS)} % 4 + 1)::INTEGER] AS t FROM part)
SELECT p_partkey, {_FORMS_SQL}[f + 1] AS answer, t AS prompt_type, CASE t WHEN 'mcq_single' THEN f = 0 WHEN 'mcq_multi' THEN f = 3 WHEN 'mcq_grouped' THEN f IN (3, 4, 5) ELSE f IN (0, 1, 2, 7) END AS valid,
CASE WHEN f = 9 THEN 'ambiguous' END AS label, CASE WHEN f = 9 THEN 'two' WHEN f = 11 THEN 'invalid_label:bad' ELSE 'json_parse_failed' END AS reason FROM p""")
def agent_contract(spark, sf_dir):
    key = F.col("p_partkey")
    answer = F.get(F.array(*map(F.lit, FORMS)), (key % len(FORMS)).cast("int"))
    kind = F.get(F.array(*map(F.lit, ("mcq_single", "mcq_multi", "mcq_grouped", "open"))), (F.floor(key / len(FORMS)) % 4).cast("int"))
    label, reason = J.answerability(answer)
    return table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), kind.alias("prompt_type"), J.keeps_contract(kind, F.try_parse_json(answer)).alias("valid"), label.alias("label"), reason.alias("reason"))


@query(r"""WITH s AS (SELECT p_partkey, ('0x' || substr(sha256('part|' || p_partkey || '|0'), 1, 16))::UBIGINT::VARCHAR AS seed, [p_name, p_brand, p_type] AS o, p_size FROM part), u AS (SELECT p_partkey, p_size, unnest(o) AS text, unnest(range(3)) AS i, sha256(seed || '|' || unnest(range(3))) AS h FROM s),
l AS (SELECT *, chr((64 + row_number() OVER (PARTITION BY p_partkey ORDER BY h))::INTEGER) AS letter FROM u)
SELECT p_partkey, string_agg(letter, ',' ORDER BY letter) FILTER (WHERE i = 0) AS correct, E'Story:\nsize ' || any_value(p_size) || E'\n\nQuestion: Which {part}?\n\nOptions:\n' || string_agg(letter || '. ' || text, chr(10) ORDER BY letter) AS prompt FROM l GROUP BY p_partkey""")
def prompts_of_parts(spark, sf_dir):
    answer = F.struct(F.array("p_name").alias("correct_answers"), F.array("p_brand", "p_type").alias("wrong_answers"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("sample_id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("story"), F.lit("Which {part}?").alias("question"), answer.alias("answer"), F.parse_json(F.lit('{"lang": "en"}')).alias("meta"))
    return P.prepared(s, "part", P.Protocol("cot")).select("p_partkey", F.array_join("correct_letters", ",").alias("correct"), "prompt")


@query("SELECT doc_id, 'ability_' || source || CASE WHEN lang = 'zh' THEN '__zh' ELSE '' END AS dimension, coalesce(CASE WHEN n_chars % 2 = 0 THEN 'order_' || n_chars % 5 END, 'unknown') AS degree FROM documents")
def dimension_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = with_meta(d, ability=F.concat(F.lit("ability_"), F.col("source")), lang=F.col("lang"), order=F.when(F.col("n_chars") % 2 == 0, F.col("n_chars") % 5))
    return d.select("doc_id", S.dimension_key(F.lit("ToMBench")).alias("dimension"), S.dimension_key(F.lit("HiToM")).alias("degree"))


@query(f"WITH {GRAMS}, s AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g WHERE a.k = 'd' AND b.k = 'b' GROUP BY ALL), y AS (SELECT s.a, s.b, shared::DOUBLE / (x.z + w.z - shared) AS j FROM s JOIN z x ON x.k = 'd' AND x.id = s.a JOIN z w ON w.k = 'b' AND w.id = s.b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS r FROM y WHERE j >= 0.3) SELECT a AS doc_id, b AS \"of\", round(j, 6) AS jaccard FROM r WHERE r = 1")
def leak_check(spark, sf_dir):
    return D.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 0.3).withColumn("jaccard", F.round("jaccard", 6))


#: Rows in order of the id, each kept unless it is like a smaller one that is kept: one step of the recursion for each
#: row that is like another.
GREEDY = f"""WITH RECURSIVE {GRAMS}, h AS (SELECT g.id, g.g, z.z FROM g JOIN z USING (k, id) WHERE g.k = 'd'),
s AS (SELECT a.id AS low, b.id AS high, count(*)::DOUBLE / (a.z + b.z - count(*)) AS j FROM h a JOIN h b ON a.g = b.g AND a.id < b.id AND a.z >= 0.85 * b.z AND b.z >= 0.85 * a.z GROUP BY a.id, b.id, a.z, b.z),
e AS MATERIALIZED (SELECT low, high, j FROM s WHERE j >= 0.85), q AS MATERIALIZED (SELECT high AS id, list(low) AS lows, row_number() OVER (ORDER BY high) AS step FROM e GROUP BY high),
f AS (SELECT list(DISTINCT low) AS firsts FROM e WHERE low NOT IN (SELECT high FROM e)),
r(step, kept) AS (SELECT 0::BIGINT, firsts FROM f UNION ALL SELECT r.step + 1, CASE WHEN list_has_any(q.lows, r.kept) THEN r.kept ELSE list_append(r.kept, q.id) END FROM r JOIN q ON q.step = r.step + 1),
w AS (SELECT DISTINCT unnest(kept) AS id FROM (SELECT kept FROM r ORDER BY step DESC LIMIT 1)), y AS (SELECT high AS id, min(low) AS class FROM e WHERE j = 1 GROUP BY 1)
SELECT DISTINCT d.doc_id, coalesce(y.class, d.doc_id) AS class, (q.id IS NULL OR w.id IS NOT NULL) AS kept FROM documents d LEFT JOIN y ON y.id = d.doc_id LEFT JOIN q ON q.id = d.doc_id LEFT JOIN w ON w.id = d.doc_id"""


@query(GREEDY)
def greedy_dedup(spark, sf_dir):
    return D.deduplicated(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT c_custkey, CASE WHEN length(c_name) % 5 > 0 THEN c_name END AS content, CASE WHEN length(c_name) % 5 > 0 THEN length(c_name)::VARCHAR END AS reasoning, length(c_name) % 5 > 0 AS ok, CASE WHEN length(c_name) % 5 = 0 THEN 'INTERNAL' END AS error, 1 AS attempts FROM (SELECT c_custkey, c_mktsegment AS c_name FROM customer)")
def model_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("prompt"))
    return responder.asked(rows, echo, "c_custkey").select("c_custkey", "content", "reasoning", "ok", "error", "attempts")


@query("SELECT r_name AS section, n_name AS \"row\", col AS \"column\", val AS cell, try_cast(val AS DOUBLE) AS number FROM (SELECT r_name, n_name, unnest(['key', 'none']) AS col, unnest([n_nationkey::VARCHAR, '-']) AS val FROM nation JOIN region ON n_regionkey = r_regionkey)")
def markdown_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" | - |"))
    texts = n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    texts = texts.select(F.col("r_name").alias("file"), F.concat(F.lit("## "), F.col("r_name"), F.lit("\n\n| nation | key | none |\n|---|:--:|--:|\n"), F.col("t"), F.lit("\n\nend\n")).alias("value"))
    c = markdown.cells(texts)
    return c.select("section", "row", "column", "cell", markdown.number(F.col("cell")).alias("number"))


@query("SELECT s_suppkey, 'm' || s_nationkey AS model, CASE s_suppkey % 4 WHEN 0 THEN 'Qwen' WHEN 1 THEN 'x/y' WHEN 2 THEN 'Qwen' ELSE '' END AS judge FROM supplier")
def model_labels(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, ("/Judge-Qwen", "/x/y", "/JUDGE_Qwen", ""))), (F.col("s_suppkey") % 4).cast("int"))
    model, judge = markdown.split_label(F.concat(F.lit("m"), F.col("s_nationkey").cast("string"), tail))
    return table(spark, sf_dir, "supplier").select("s_suppkey", model.alias("model"), judge.alias("judge"))


@query("WITH m AS (SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY ALL) SELECT flag, status, round((v - (SELECT min(v) FROM m)) / ((SELECT max(v) FROM m) - (SELECT min(v) FROM m)), 4) AS heat, v = max(v) OVER (PARTITION BY flag) AS best FROM m")
def heat_map(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return markdown.heat(m, "flag", "v").select("flag", "status", F.round("heat", 4).alias("heat"), "best")


@query("SELECT event_type AS dataset, 'm' || user_id % 5 AS model, max('exp_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(event_id::VARCHAR, 12, '0')) AS exp, max(strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(event_id::VARCHAR, 12, '0')) AS timestamp, arg_max(event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY ALL")
def leaderboard_entries(spark, sf_dir):
    name = F.concat(F.lit("exp_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), name.alias("exp"), "event_id")
    return runs.leaderboard(e)
