"""Queries of the quality filter, of feedback, synthesis and bad cases over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions import answers as A
from qaspark.operators import badcases as B
from qaspark.operators import curation as C
from qaspark.operators import feedback as K
from qaspark.operators import quality as Q
from qaspark.operators import selection as S
from qaspark.operators import synthesis as Y
from qaspark.plans import tasks as T
from qaspark.plans.grading import TYPED, judged, with_meta
from qaspark.plans.evaluating import query, table

# ---- quotas ------------------------------------------------------------------------------


@query("""WITH z AS (SELECT p_type AS dim, count(*) AS n FROM part GROUP BY 1), q AS (SELECT *, greatest(1, round_even(67 * n::DOUBLE / sum(n) OVER (), 0))::BIGINT AS q FROM z),
o AS (SELECT *, sum(q) OVER () - 67 AS over, row_number() OVER (PARTITION BY q > 1 ORDER BY n DESC, dim) AS among, row_number() OVER (ORDER BY n DESC, dim) AS place FROM q),
f AS (SELECT dim, q - CASE WHEN over > 0 AND q > 1 AND among <= over THEN 1 ELSE 0 END + CASE WHEN over < 0 AND place <= -over THEN 1 ELSE 0 END AS quota FROM o),
r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS r FROM part)
SELECT p_type, p_partkey, r <= quota AS within FROM r JOIN f ON p_type = dim ORDER BY r > quota, p_type, r LIMIT 67""")
def stratified_quota(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    order = [F.col("p_size").desc(), F.col("p_partkey")]
    picked = S.stratified(p, "p_type", order, 67)
    within = S.quotas(p, "p_type", 67).withColumnRenamed("p_type", "_t")
    counted = picked.join(within, F.col("p_type") == F.col("_t"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_type").orderBy(*order))
    return counted.select("p_type", "p_partkey", (place <= F.col("quota")).alias("within"))


def _apportion_sql(reports: int) -> str:
    return f"""(WITH d AS (SELECT n_name AS dim, count(*) AS n, 64 AS t FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
w AS (SELECT dim, n, n::DOUBLE / t AS w, count(*) OVER () AS dims FROM d), v AS (SELECT *, greatest(1, floor({reports}::DOUBLE * w / sum(w) OVER ()))::BIGINT AS raw, row_number() OVER (ORDER BY w DESC, n DESC, dim) AS place FROM w),
o AS (SELECT *, sum(raw) OVER () - {reports} AS over FROM v), u AS (SELECT dim, w, over, unnest(range(1, raw)) AS round FROM o), x AS (SELECT *, row_number() OVER (ORDER BY round, w, dim) AS r FROM u), y AS (SELECT dim, count(*) AS taken FROM x WHERE r <= over GROUP BY 1)
SELECT {reports} AS reports, o.dim, CASE WHEN dims > {reports} THEN 1 ELSE raw + CASE WHEN over < 0 AND place <= -over THEN 1 ELSE 0 END - coalesce(taken, 0) END::BIGINT AS share FROM o LEFT JOIN y ON o.dim = y.dim WHERE dims <= {reports} OR place <= {reports})"""


@query(" UNION ALL ".join(map(_apportion_sql, (7, 25, 26, 100))))
def report_apportion(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    d = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("dim")).agg(F.count(F.lit(1)).alias("wrong")).withColumn("total", F.lit(64))
    parts = [S.apportioned(d, "dim", "wrong", r, "total").select(F.lit(r).alias("reports"), "dim", "share") for r in (7, 25, 26, 100)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 > 0 ORDER BY ln((('0x' || substr(sha256('42|' || o_orderkey), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0) / (o_orderkey % 7) DESC, o_orderkey LIMIT 80")
def weighted_sample(spark, sf_dir):
    return S.weighted_sample(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), F.col("o_orderkey") % 7, 80).select("o_orderkey")


# ---- the filter's phases -----------------------------------------------------------------

PHASES = """d AS (SELECT doc_id AS row_id, n_chars FROM documents),
t AS (SELECT row_id, ['all_passed', 'partial', 'all_failed', 'partial'][n_chars % 4 + 1] AS bucket, n_chars % 9 AS pass_at_k FROM d WHERE n_chars % 11 > 0),
a AS (SELECT doc_id AS row_id, quality = 1 AS answerable, CASE WHEN quality = 1 THEN 'answerable' WHEN toxic = 1 THEN 'ambiguous' END AS answerability_label FROM labels),
s AS (SELECT row_id, n_chars % 3 = 0 AS is_shortcut FROM d WHERE n_chars % 2 = 1)"""


def phases(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    buckets = F.array(*map(F.lit, ("all_passed", "partial", "all_failed", "partial")))
    t = d.filter(n % 11 > 0).select("row_id", F.get(buckets, (n % 4).cast("int")).alias("bucket"), (n % 9).alias("pass_at_k"))
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") == 1).alias("answerable"), F.when(F.col("quality") == 1, "answerable").when(F.col("toxic") == 1, "ambiguous").alias("answerability_label"))
    return d, t, a, d.filter(n % 2 == 1).select("row_id", (n % 3 == 0).alias("is_shortcut"))


def _label_sql(run: str, bucket: str, answerable: str, short: str) -> str:
    label = f"CASE WHEN {bucket} = 'all_passed' THEN 'easy' WHEN {bucket} IS NULL OR NOT coalesce({answerable}, false) THEN 'bad' WHEN {bucket} = 'all_failed' THEN 'hard' WHEN coalesce({short}, false) THEN 'shortcut' ELSE 'medium' END"
    return f"SELECT '{run}' AS run, d.row_id, {label} AS label, CASE {label} WHEN 'easy' THEN 'easy' WHEN 'bad' THEN 'unanswerable' WHEN 'shortcut' THEN 'shortcut' END AS repair_type FROM d LEFT JOIN t USING (row_id) LEFT JOIN a USING (row_id) LEFT JOIN s USING (row_id)"


@query(f"WITH {PHASES} " + " UNION ALL ".join((_label_sql("all", "bucket", "answerable", "is_shortcut"), _label_sql("no trials", "'partial'", "answerable", "is_shortcut"), _label_sql("no answers", "bucket", "true", "is_shortcut"), _label_sql("no probes", "bucket", "answerable", "false"))))
def filter_labels(spark, sf_dir):
    d, t, a, s = phases(spark, sf_dir)
    out = None
    for run, args in (("all", (t, a, s)), ("no trials", (None, a, s)), ("no answers", (t, None, s)), ("no probes", (t, a, None))):
        part = C.labelled(d, *args).select(F.lit(run).alias("run"), "row_id", "label", "repair_type")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {PHASES} SELECT 'judge' AS phase, row_id FROM t WHERE bucket IN ('partial', 'all_failed') UNION ALL SELECT 'probe', t.row_id FROM t JOIN a USING (row_id) WHERE bucket = 'partial' AND answerable UNION ALL SELECT 'probe without answers', row_id FROM t WHERE bucket = 'partial'")
def filter_targets(spark, sf_dir):
    d, t, a, _ = phases(spark, sf_dir)
    of = lambda name, rows: rows.select(F.lit(name).alias("phase"), "row_id")
    return of("judge", C.to_judge(d, t)).unionByName(of("probe", C.to_probe(d, t, a))).unionByName(of("probe without answers", C.to_probe(d, t, None)))


@query(f"WITH {PHASES}, l AS ({_label_sql('all', 'bucket', 'answerable', 'is_shortcut')}) SELECT coalesce(answerability_label, 'unknown') AS reason, count(*) AS n FROM l LEFT JOIN a USING (row_id) WHERE label = 'bad' GROUP BY 1")
def bad_reasons(spark, sf_dir):
    d, t, a, s = phases(spark, sf_dir)
    return C.reasons(C.labelled(d, t, a, s))


@query(f"WITH {PHASES}, l AS ({_label_sql('all', 'bucket', 'answerable', 'is_shortcut')}) SELECT CASE WHEN repair_type IS NOT NULL THEN 'unfixable' ELSE label END AS label, count(*) AS n FROM l GROUP BY 1")
def unfixable(spark, sf_dir):
    d, t, a, s = phases(spark, sf_dir)
    return C.gave_up(C.labelled(d, t, a, s)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PHASES}, l AS ({_label_sql('all', 'bucket', 'answerable', 'is_shortcut')})
SELECT row_id, 'story ' || row_id AS story, 'right ' || row_id AS correct, repair_type || ',2' AS step, 'eval_iter2_repair' AS source_iter,
CASE repair_type WHEN 'easy' THEN 'Make this question harder without changing what is right.' ELSE 'Mend this question so that its story answers it. Fault: ' || coalesce(answerability_label, '') || '. ' END || E'\\n\\nDataset: docs\\nStory: old\\nQuestion: q {{story}}\\nRight: a, b\\nWrong: ' AS prompt
FROM l LEFT JOIN a USING (row_id) WHERE repair_type IN ('easy', 'unanswerable') AND row_id % 3 > 0""")
def repair_round(spark, sf_dir):
    d, t, a, s = phases(spark, sf_dir)
    none = F.array().cast("array<string>")
    samples = d.select("row_id", F.lit("old").alias("story"), F.lit("q {story}").alias("question"), F.struct(F.array(F.lit("a"), F.lit("b")).alias("correct_answers"), none.alias("wrong_answers")).alias("answer"))
    asked = C.to_repair(samples, C.labelled(d, t, a, s), ("easy", "unanswerable"))
    asked = asked.withColumn("prompt", Y.repair_prompt("docs"))
    key = F.col("row_id").cast("string")
    replies = d.select("row_id", F.concat(F.lit("story "), key).alias("story"), F.lit("new").alias("question"), F.when(F.col("row_id") % 3 > 0, F.array(F.concat(F.lit("right "), key))).alias("correct_answers"), none.alias("wrong_answers"))
    out = C.repaired(asked, replies, 2)
    step = F.get("history", F.lit(0))
    return out.select("row_id", "story", F.col("answer.correct_answers")[0].alias("correct"), F.concat_ws(",", step["repair_type"], step["iter"].cast("string")).alias("step"), "source_iter", "prompt")


@query("""WITH l AS (SELECT l_returnflag AS split, l_linenumber AS iter, l_orderkey * 1000 + l_partkey AS row_id, l_orderkey AS sample_id, ['easy', 'hard', 'medium', 'bad'][l_partkey % 4 + 1] AS label FROM lineitem),
k AS (SELECT DISTINCT split, iter, row_id, sample_id FROM l WHERE label IN ('hard', 'medium')), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY split DESC, iter DESC, row_id DESC) AS r FROM k)
SELECT sample_id, split, iter, row_id FROM r WHERE r = 1""")
def finalized_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_linenumber").alias("iter"), (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("row_id"), F.col("l_orderkey").alias("sample_id"), "l_partkey")
    labels = rows.select("split", "iter", "row_id", F.get(F.array(*map(F.lit, ("easy", "hard", "medium", "bad"))), (F.col("l_partkey") % 4).cast("int")).alias("label"))
    return C.finalized(rows, labels).select("sample_id", "split", "iter", "row_id")


# ---- feedback ----------------------------------------------------------------------------

ANSWERED = r"""p AS (SELECT event_id, event_type AS model, event_id // 8 AS sample_index, (event_id // 8)::VARCHAR AS sample_id, event_id % 8 AS repeat, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE event_id // 8 % 13 > 0),
c AS (SELECT *, CASE k % 5 WHEN 0 THEN 'We say (b) here' WHEN 1 THEN 'Delta' WHEN 2 THEN '' WHEN 3 THEN '7 up' ELSE 'a thing' END AS content FROM p),
j AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN k % 2 = 0 ELSE k % 5 IN (0, 4) AND (CASE k % 5 WHEN 0 THEN 'B' ELSE 'A' END) = chr((65 + sample_index % 2)::INTEGER) END AS ok FROM c)"""


def answered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    index = F.floor(F.col("event_id") / 8).cast("long")
    content = F.get(F.array(*map(F.lit, ("We say (b) here", "Delta", "", "7 up", "a thing"))), F.col("k") % 5)
    p = e.select("event_id", F.col("event_type").alias("model"), F.when(index % 13 > 0, index).otherwise(-1).alias("sample_index"), index.cast("string").alias("sample_id"), (F.col("event_id") % 8).alias("repeat"), content.alias("content"), F.array(F.lower(F.char(65 + index % 2))).alias("correct_letters"), "k")
    verdicts = p.filter(F.col("event_id") % 3 == 0).select("model", "sample_id", "repeat", (F.col("k") % 2 == 0).alias("is_correct"))
    return K.aligned(p), verdicts


@query(f"WITH {ANSWERED} SELECT event_id, ok AS is_correct, CASE k % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'D' WHEN 2 THEN '' WHEN 3 THEN '7' ELSE 'A' END AS letter FROM j")
def verdict_fallback(spark, sf_dir):
    p, verdicts = answered(spark, sf_dir)
    return K.judged(p, verdicts).select("event_id", "is_correct", A.guessed_letter(F.col("content")).alias("letter"))


@query(f"WITH {ANSWERED}, w AS (SELECT *, count(*) OVER (PARTITION BY sample_index) AS difficulty FROM j WHERE NOT ok) SELECT sample_index, model, repeat, difficulty, row_number() OVER (ORDER BY difficulty DESC, sample_index, model, repeat) AS place FROM w ORDER BY place LIMIT 500")
def hardest_cases(spark, sf_dir):
    from pyspark.sql import Window

    cases = K.wrong_cases(K.judged(*answered(spark, sf_dir)))
    top = cases.orderBy(*K.by_difficulty()).limit(500)
    return top.select("sample_index", "model", "repeat", "difficulty", F.row_number().over(Window.orderBy(*K.by_difficulty())).cast("long").alias("place"))


@query(f"WITH {ANSWERED}, w AS (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY model, repeat) AS r FROM j WHERE NOT ok) SELECT sample_index, model, repeat, o_orderstatus AS status FROM w LEFT JOIN orders ON o_orderkey = sample_index WHERE r = 1")
def first_wrong_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_index"), F.col("o_orderstatus").alias("status"))
    return K.first_wrong(K.judged(*answered(spark, sf_dir)), rows).select("sample_index", "model", "repeat", "status")


@query(f"WITH {ANSWERED}, s AS (SELECT k % 17 AS dim, sample_index, NOT bool_and(ok) AS wrong FROM j GROUP BY ALL), d AS (SELECT 'd' || dim AS dim, count(*) AS total, count(*) FILTER (WHERE wrong) AS wrong FROM s GROUP BY 1) SELECT dim, total, wrong, round(wrong::DOUBLE / total, 6) AS error_rate FROM d ORDER BY wrong::DOUBLE / total DESC, dim LIMIT 5")
def worst_dimensions(spark, sf_dir):
    v = K.judged(*answered(spark, sf_dir)).withColumn("dim", F.concat(F.lit("d"), (F.col("k") % 17).cast("string")))
    return K.worst(S.dimension_errors(v, "dim", "sample_index")).withColumn("error_rate", F.round("error_rate", 6))


@query(f"""WITH {ANSWERED}, w AS (SELECT *, count(*) OVER (PARTITION BY sample_index) AS difficulty FROM j WHERE NOT ok), b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY difficulty DESC, sample_index, model, repeat) AS rank FROM w), n AS (SELECT model, rank, (rank - 1) // 5 AS batch, row_number() OVER (PARTITION BY model, (rank - 1) // 5 ORDER BY rank) AS i, count(*) OVER (PARTITION BY model, (rank - 1) // 5) AS n, sample_index, content FROM b)
SELECT model AS dimension, batch, any_value(n) || ' wrong answers of dimension ' || model || E' in events. Say what the errors have in common.\\n\\n' || string_agg('### Case ' || i || E'\\nPrompt:\\n' || repeat('p', 1300) || E'\\n...[truncated]\\n\\nReasoning:\\n' || repeat('r', 700) || E'\\n...[truncated]\\n\\nAnswer: ' || CASE WHEN content = '' THEN '(unknown)' ELSE content END || E'\\nRight answer: s' || sample_index || E'\\n', E'\\n---\\n' ORDER BY i) AS prompt FROM n GROUP BY model, batch""")
def diagnosis_prompts(spark, sf_dir):
    from pyspark.sql import Window

    cases = K.wrong_cases(K.judged(*answered(spark, sf_dir))).withColumn("dimension", F.col("model"))
    cases = K.batched(cases, "dimension", K.by_difficulty(), 5).withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(*K.by_difficulty())))
    cases = cases.select("dimension", "batch", "rank", F.repeat(F.lit("p"), 1600).alias("actual_prompt"), F.repeat(F.lit("r"), 801).alias("wrong_reasoning"), F.col("content").alias("wrong_answer"), F.concat(F.lit("s"), F.col("sample_index").cast("string")).alias("gold_answer"))
    return Y.diagnosis_prompts(cases, "events")


@query("SELECT p_partkey, 'Write 3 questions of difficulty ' || CASE WHEN p_size % 3 = 0 THEN 'easy' WHEN p_size % 3 = 1 THEN 'hard' ELSE 'medium' END || ' on ' || p_type || E' that need op.\\n\\n- ' || p_name || E'\\n- ' || p_brand AS prompt FROM part")
def synthesis_prompts(spark, sf_dir):
    size = F.col("p_size") % 3
    shares = F.create_map(F.lit("hard"), F.when(size == 1, 0.6).otherwise(0.2).cast("double"), F.lit("easy"), F.when(size == 0, 0.5).otherwise(0.2).cast("double"), F.lit("medium"), F.when(size == 2, 0.4).otherwise(0.1).cast("double"))
    reports = table(spark, sf_dir, "part").select("p_partkey", shares.alias("difficulty_distribution"), F.array("p_type").alias("recommended_synthesis_themes"), F.lit("op").alias("primary_cognitive_operation"), F.array("p_name", "p_brand").alias("common_error_patterns"))
    return reports.select("p_partkey", Y.synthesis_prompt(3).alias("prompt"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) || CASE WHEN trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) = '' THEN '' ELSE ' ' END || lang || ' one two' AS text FROM documents".replace("\\\\", "\\"))
def candidate_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    one = F.array(F.lit(" one\n two "), F.lit("  "))
    return d.select("doc_id", K.candidate_text(F.col("text"), F.col("lang"), one, F.lit(None).cast("array<string>")).alias("text"))


@query("""WITH m AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'leak' WHEN quality = 0 THEN 'duplicate' END AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT count(*) AS a, count(*) FILTER (WHERE r = 'leak') AS b, count(*) FILTER (WHERE r = 'duplicate') AS c FROM m)
SELECT a AS total_raw, b AS dropped_test_dedup, a - b AS passed_test_dedup, round(b::DOUBLE / a, 4) AS test_drop_rate, c AS dropped_internal_dedup, a - b - c AS passed_internal_dedup, round(c::DOUBLE / (a - b), 4) AS internal_drop_rate, a - b - c AS final_clean FROM s""")
def dedupe_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    leaks = labels.filter("toxic = 1").select("doc_id", F.lit(3).alias("of"))
    kept = labels.select("doc_id", (F.col("quality") == 1).alias("kept"))
    return K.drop_rates(K.split(table(spark, sf_dir, "documents").select("doc_id"), leaks, kept, "doc_id"))


# ---- synthesised samples -----------------------------------------------------------------


@query("""WITH p AS (SELECT *, p_partkey % 5 AS k FROM part)
SELECT p_partkey, 'inline' AS schema, CASE k WHEN 0 THEN 'E' WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_type ELSE 'last one' END AS correct,
array_to_string(CASE k WHEN 0 THEN [p_name, p_brand, p_type, 'last one'] WHEN 1 THEN [p_brand, p_type, 'last one'] WHEN 2 THEN [p_name, p_type, 'last one'] WHEN 3 THEN [p_name, p_brand, 'last one'] ELSE [p_name, p_brand, p_type] END, '|') AS wrong, 'belief' AS dimension FROM p
UNION ALL SELECT p_partkey, 'many', p_name, p_brand || '|' || p_type, 'belief' FROM p
UNION ALL SELECT p_partkey, 'names', CASE WHEN k < 2 THEN p_name || '|' || p_brand ELSE p_type END, CASE WHEN k < 2 OR k = 4 THEN '' ELSE p_brand END, CASE WHEN k < 2 THEN 'answerabilityQA_list' ELSE 'factQA' END FROM p
UNION ALL SELECT p_partkey, 'several', p_name, 'w1|w2|' || p_type, 'joy' FROM p
UNION ALL SELECT p_partkey, 'judgement', CASE k WHEN 0 THEN '是' WHEN 1 THEN '否' ELSE '无法确定' END, CASE k WHEN 0 THEN '否|无法确定' WHEN 1 THEN '是|无法确定' ELSE '是|否' END, '1,1.2,Q3,third_person' FROM p
UNION ALL SELECT p_partkey, 'open', p_name || chr(10) || p_type, '', '1,1.2,Q4,third_person' FROM p
UNION ALL SELECT p_partkey, 'single', p_name, 'w1|w2|' || p_type, '1,1.2,Q1,third_person' FROM p
UNION ALL SELECT p_partkey, 'multiple', p_name || '|' || p_brand, p_type, '1,1.2,Q2,third_person' FROM p
UNION ALL SELECT p_partkey, 'pair', p_name, p_brand, 'first_order' FROM p
UNION ALL SELECT p_partkey, 'triple', p_name, 'w1|w2', 'joy' FROM p""")
def synthesis_shapes(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("k", (F.col("p_partkey") % 5).cast("int"))
    lit, name, brand, kind = F.lit, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    base = p.withColumns({"meta_id": F.col("p_partkey").cast("string"), "story": lit("s"), "question": lit("q"), "correct_answer": name})
    pick = lambda *values: F.get(F.array(*map(lit, values)), F.col("k"))
    several = F.lit(None).cast("array<string>")
    inputs = {
        "inline": base.withColumns({"question": F.concat(lit("Which? A. "), name, lit(" B. "), brand, lit("\nC．"), kind, lit(" D. last one")), "correct_letter": pick("e", " a ", "B", "c", "D"), "meta_ability": lit("belief")}),
        "many": base.withColumns({"correct_answer": F.concat(name, lit(" (what X believes)"))} | {f"wrong_{i}": c for i, c in enumerate((brand, F.concat(kind, lit(" (note)")), name, lit(" "), lit("(only)"), *[brand] * 9), 1)}),
        "names": base.withColumns({"meta_question_type": F.when(F.col("k") < 2, "answerabilityQA_list").otherwise("factQA"), "correct_names": F.array("p_name", "p_brand"), "wrong_names": several, "correct_answer": kind, "wrong_answer": F.when(F.col("k") == 4, "").otherwise(brand)}),
        "several": base.withColumns({"wrong_answer_1": lit("w1"), "wrong_answer_2": lit("w2"), "wrong_answer_3": lit(" "), "wrong_answer_4": kind, "wrong_answer_5": lit(None).cast("string"), "meta_dimension": lit("joy")}),
        "triple": base.withColumns({"wrong_answer_1": lit("w1"), "wrong_answer_2": lit("w2"), "meta_dimension": lit("joy")}),
        "pair": base.withColumns({"wrong_answer": brand, "meta_condition_type": lit("fb"), "meta_dimension": lit("first_order")}),
    }
    graded = base.withColumns({"meta_dim": lit("1.2.3"), "meta_perspective": lit(""), "meta_domain": lit(None).cast("string"), "meta_length_mode": lit("short")})
    inputs |= {
        "single": graded.withColumns({"wrong_answer_1": lit("w1"), "wrong_answer_2": lit("w2"), "wrong_answer_3": kind}),
        "multiple": graded.withColumns({"correct_answers": F.array("p_name", "p_brand"), "wrong_answers": F.array("p_type")}),
        "judgement": graded.withColumn("correct_verdict", pick(" 是", "否", "maybe", "", "无法确定")),
        "open": graded.withColumn("reference_points", F.array(name, lit("  "), F.concat(lit(" "), kind))),
    }
    out = None
    for schema, rows in inputs.items():
        of = lambda key: F.try_variant_get("meta", f"$.{key}", "string")
        dimension = F.coalesce(F.try_variant_get("meta", "$.dimension[0]", "string"), F.concat_ws(",", of("dim1"), of("dim2"), of("qtype"), of("perspective")))
        part = Y.shaped(rows, schema).select(F.col("meta_id").cast("long").alias("p_partkey"), lit(schema).alias("schema"), F.array_join("answer.correct_answers", "|").alias("correct"), F.array_join("answer.wrong_answers", "|").alias("wrong"), dimension.alias("dimension"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '1.' || p_size || '.1' END AS dim, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Q' || p_partkey % 4 END AS qtype, 'm_' || p_partkey || '_x_y' AS file FROM part")
def key_parts(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat("p_brand", F.lit("__en"))).otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".1__Q"), (key % 4).cast("string"), F.when(key % 3 == 1, "__zh").otherwise("")))
    dim, qtype = Y.key_parts(text)
    return table(spark, sf_dir, "part").select("p_partkey", dim.alias("dim"), qtype.alias("qtype"), Y.file_name(F.concat(F.lit("m/"), key.cast("string"), F.lit(":x y"))).alias("file"))


# ---- bad cases and qualified rows --------------------------------------------------------


@query(f"""WITH {TYPED}, r AS (SELECT user_id % 40 AS sid, event_id AS repeat, event_type, k, event_id % 5 > 0 AND is_correct AS ok FROM g), f AS (SELECT sid, arg_min(event_type, repeat) AS t, arg_min(k, repeat) AS k0, count(*) FILTER (WHERE NOT ok) AS wrong_count, count(*) AS max_repeat FROM r GROUP BY sid),
n AS (SELECT *, 'dimension=a,b|flag=' || (k0 % 2 = 0)::VARCHAR || '|kind=' || t AS group_key FROM f), w AS (SELECT group_key, (count(*) FILTER (WHERE wrong_count > 0))::DOUBLE / count(*) AS rate FROM n GROUP BY 1)
SELECT 's' || sid AS sample_id, wrong_count, max_repeat, 'a, b' AS group_display, round(rate, 6) AS group_wrong_rate, CASE WHEN rate > 0.7 AND wrong_count = max_repeat THEN 1 WHEN rate > 0.5 AND wrong_count * 2 >= max_repeat THEN 2 ELSE 3 END AS tier FROM n JOIN w USING (group_key) WHERE wrong_count > 0""")
def group_wrong_rates(spark, sf_dir):
    sample = F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string"))
    v = with_meta(judged(spark, sf_dir), id=F.col("event_id"), dimension=F.array(F.lit("a"), F.lit("b")), kind=F.col("event_type"), flag=F.col("k") % 2 == 0)
    records = v.select(sample.alias("sample_id"), F.col("event_id").alias("repeat"), "prompt_type", "meta", "correct_answers", "correct_letters")
    verdicts = v.filter(F.col("event_id") % 5 > 0).select(sample.alias("sample_id"), F.col("event_id").alias("repeat"), "is_correct")
    return B.worst(B.samples(records, verdicts), 1000).select("sample_id", "wrong_count", "max_repeat", "group_display", F.round("group_wrong_rate", 6).alias("group_wrong_rate"), "tier")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'unknown' ELSE 'brand=' || p_brand || '|size=' || p_size END AS signature, CASE p_partkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'brand=' || p_brand || '|size=' || p_size ELSE 'brand=' || p_brand || '|size=' || p_size END AS shown, CASE WHEN p_size % 2 = 0 THEN '["' || p_name || '"]' ELSE '["A"]' END AS gold FROM part""")
def group_signatures(spark, sf_dir):
    key = F.col("p_partkey")
    full = F.to_variant_object(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), key.alias("sample_id")))
    meta = F.when(key % 3 == 0, F.to_variant_object(F.struct(key.alias("id")))).otherwise(full)
    kind = F.when(F.col("p_size") % 2 == 0, "open").otherwise("mcq_single")
    return table(spark, sf_dir, "part").withColumn("meta", meta).select("p_partkey", B.signature(F.col("meta")).alias("signature"), B.shown(F.col("meta")).alias("shown"), B.gold(kind, F.array("p_name"), F.array(F.lit("A"))).alias("gold"))


@query(f"WITH {TYPED} SELECT count(*) FILTER (WHERE k % 4 NOT IN (1, 2)) AS review_pass_count, count(*) FILTER (WHERE k % 4 IN (1, 2)) AS review_fail_count, round((count(*) FILTER (WHERE k % 4 NOT IN (1, 2)))::DOUBLE / count(*), 6) AS review_pass_rate FROM g")
def qualified_counts(spark, sf_dir):
    k = F.col("k") % 4
    # true, false, null, missing
    meta = F.when(k == 3, '{"x": 1}').when(k == 2, '{"review_pass": null}').when(k == 1, '{"review_pass": false}').otherwise('{"review_pass": true}')
    v = judged(spark, sf_dir).withColumn("meta", F.parse_json(meta))
    return T.review_counts(v).withColumn("review_pass_rate", F.round("review_pass_rate", 6))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 3 = 0) AS open_count, count(*) FILTER (WHERE p_size % 3 > 0) AS mcq_count, 'Mixed (MCQ: ' || count(*) FILTER (WHERE p_size % 3 > 0) || ', Open: ' || count(*) FILTER (WHERE p_size % 3 = 0) || ')' AS question_type FROM part")
def type_counts(spark, sf_dir):
    wrong = F.when(F.col("p_size") % 3 == 1, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    right = F.when(F.col("p_size") % 3 == 2, F.array("p_name", "p_type")).otherwise(F.array("p_name"))
    return Q.type_counts(table(spark, sf_dir, "part").select(F.struct(right.alias("correct_answers"), wrong.alias("wrong_answers")).alias("answer")))
