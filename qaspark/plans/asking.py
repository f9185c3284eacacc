"""Queries of prompts, payloads and judges over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions import answers as A
from qaspark.functions import prompts as P
from qaspark.operators import judging as J
from qaspark.operators import open_judges as O
from qaspark.operators import quality as Q
from qaspark.operators.lineage import cut
from qaspark.plans import tasks as T
from qaspark.plans.grading import TYPED, flat, judged, typed, with_meta
from qaspark.plans.evaluating import query, table
from qaspark.plans.stand_ins import echo, score_judge, yes_judge
from qaspark.sources import responder

TYPES = ("mcq_single", "mcq_multi", "mcq_grouped", "open")


def _text(value: str) -> str:
    """A text as an SQL literal."""
    return "E'" + value.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def _values() -> str:
    """Every combination of language, type and protocol with its directive and system prompt, as SQL rows."""
    rows = []
    for (lang, kind), text in P.DIRECTIVES.items():
        for name in P.PROTOCOLS:
            said = (P.REASON[lang] if P.Protocol(name).reasons else "") + text
            rows.append(f"({_text(lang)}, {_text(kind)}, {_text(name)}, {_text(said)}, {_text(P.ROLE[lang] + said)})")
    return ", ".join(rows)


LOOKUP = f"x(lang, kind, protocol, said, role) AS (VALUES {_values()})"


@query(f"WITH {LOOKUP}, e AS (SELECT event_id, ['{TYPES[0]}', '{TYPES[1]}', '{TYPES[2]}', '{TYPES[3]}'][event_id % 4 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN 'zh' ELSE 'en' END AS lang FROM events) SELECT event_id, protocol, said AS directive, role AS system_prompt FROM e JOIN x USING (lang, kind)")
def system_prompts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, TYPES)), (F.col("event_id") % 4).cast("int")).alias("kind"), F.when(F.col("event_id") % 3 == 0, "zh").otherwise("en").alias("lang"))
    each = [F.struct(F.lit(n).alias("protocol"), P.directive(F.col("lang"), F.col("kind"), P.Protocol(n).reasons).alias("directive"), P.system_prompt(P.Protocol(n), F.col("lang"), F.col("kind")).alias("system_prompt")) for n in P.PROTOCOLS]
    return e.select("event_id", F.explode(F.array(*each)).alias("p")).select("event_id", "p.*")


def samples(spark, sf_dir) -> DataFrame:
    """Parts as questions: with two wrong answers, or open ones, in English and Chinese."""
    p, none = table(spark, sf_dir, "part"), F.array().cast("array<string>")
    open_ = F.col("p_partkey") % 3 == 0
    answer = F.struct(F.array("p_name").alias("correct_answers"), F.when(open_, none).otherwise(F.array("p_brand", "p_type")).alias("wrong_answers"))
    meta = F.when(F.col("p_partkey") % 2 == 0, '{"lang": "zh-CN"}').otherwise("{}")
    return p.select("p_partkey", F.col("p_partkey").cast("string").alias("sample_id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("story"), F.lit("Which?").alias("question"), answer.alias("answer"), F.parse_json(meta).alias("meta"))


#: Options in hash order, as prompts have them, and without an order for protocols that vote.
OPTIONS = r"""s AS (SELECT p_partkey, p_size, p_partkey % 3 = 0 AS open_, CASE WHEN p_partkey % 2 = 0 THEN 'zh' ELSE 'en' END AS lang, p_name, [p_name, p_brand, p_type] AS o, r.repeat FROM part, (SELECT unnest(range({repeats})) AS repeat) r),
h AS (SELECT *, ('0x' || substr(sha256('part|' || p_partkey || '|' || repeat), 1, 16))::UBIGINT::VARCHAR AS seed FROM s),
u AS (SELECT p_partkey, repeat, unnest(o) AS text, unnest(range(3)) AS i, sha256(seed || '|' || unnest(range(3))) AS k FROM h WHERE NOT open_),
l AS (SELECT *, chr((64 + row_number() OVER (PARTITION BY p_partkey, repeat ORDER BY {order}))::INTEGER) AS letter FROM u),
b AS (SELECT p_partkey, repeat, string_agg(letter || '. ' || text, chr(10) ORDER BY letter) AS block, string_agg(letter, ',') FILTER (WHERE i = 0) AS correct, '{{' || string_agg('"' || letter || '":"' || text || '"', ',' ORDER BY letter) || '}}' AS shown FROM l GROUP BY ALL)"""


def _body_sql(instruct: bool, of: str = "") -> str:
    fill = lambda t: _text(t).replace("{story}", "' || 'size ' || p_size || E'").replace("{question}", "' || 'Which?' || E'").replace("{options}", "' || block || E'")
    end = lambda lang: " || " + _text("\n\n" + P.DIRECTIVES[lang, "mcq_single"]) if instruct else ""
    return f"CASE WHEN open_ AND {of}lang = 'zh' THEN {fill(P.WORDING['zh', 'open'])} WHEN open_ THEN {fill(P.WORDING['en', 'open'])} WHEN {of}lang = 'zh' THEN {fill(P.WORDING['zh', 'choice'])}{end('zh')} ELSE {fill(P.WORDING['en', 'choice'])}{end('en')} END"


@query(f"WITH {OPTIONS.format(repeats=2, order='k')} SELECT p_partkey, h.repeat, {_body_sql(True)} AS prompt, '' AS system_prompt, CASE WHEN open_ THEN '0' ELSE seed END AS shuffle_seed, 'legacy' AS extractor FROM h LEFT JOIN b USING (p_partkey, repeat)")
def instructed_prompts(spark, sf_dir):
    s = P.prepared(samples(spark, sf_dir), "part", P.Protocol(), 2)
    return s.select("p_partkey", F.col("repeat").cast("long").alias("repeat"), "prompt", "system_prompt", F.col("shuffle_seed").cast("string").alias("shuffle_seed"), "extractor")


@query(f"WITH {OPTIONS.format(repeats=8, order='i')}, {LOOKUP} SELECT p_partkey, h.repeat, {_body_sql(False, 'h.')} AS prompt, role AS system_prompt, protocol, coalesce(correct, '') AS correct FROM h LEFT JOIN b USING (p_partkey, repeat) JOIN x ON x.lang = h.lang AND x.kind = CASE WHEN open_ THEN 'open' ELSE 'mcq_single' END AND protocol = 'del_tom'")
def prediction_rows(spark, sf_dir):
    s = P.prepared(samples(spark, sf_dir), "part", P.Protocol("del_tom"))
    return s.select("p_partkey", F.col("repeat").cast("long").alias("repeat"), "prompt", "system_prompt", "protocol", F.array_join("correct_letters", ",").alias("correct"))


@query(f"""WITH {OPTIONS.format(repeats=1, order='k')} SELECT p_partkey, h.lang, CASE WHEN open_ THEN '' ELSE shown END AS options, 'size ' || p_size AS story, CASE WHEN open_ THEN 'open' ELSE 'mcq_single' END AS prompt_type, false AS tells FROM h LEFT JOIN b USING (p_partkey, repeat)""")
def agent_payloads(spark, sf_dir):
    s = P.prepared(samples(spark, sf_dir), "part", P.Protocol(), 1, agent=True)
    value = F.parse_json("payload")
    of = lambda k: F.variant_get(value, f"$.{k}", "string")
    shown = F.coalesce(F.to_json(F.try_variant_get(value, "$.options", "variant")), F.lit(""))
    return s.select("p_partkey", of("lang").alias("lang"), shown.alias("options"), of("story").alias("story"), of("prompt_type").alias("prompt_type"), (F.col("payload").contains("correct") | ((F.col("prompt_type") == "open") & F.col("payload").contains("options"))).alias("tells"))


@query(r"""WITH d AS (SELECT * FROM documents WHERE doc_id < 400), p AS (SELECT doc_id // 3 AS pair, count(*) AS n, string_agg('q' || doc_id, ' || ' ORDER BY doc_id % 3 <> 1, doc_id::VARCHAR) AS question, string_agg(CASE WHEN doc_id % 3 = 1 THEN 'emotion' ELSE 'cause' END, ',' ORDER BY doc_id % 3 <> 1, doc_id::VARCHAR) AS kinds FROM d WHERE doc_id // 3 % 4 > 0 GROUP BY 1)
SELECT 'pair' || pair AS sample_id, question, kinds, 'mcq_grouped' AS prompt_type, n AS subs FROM p WHERE n > 1
UNION ALL SELECT doc_id::VARCHAR, 'q' || doc_id, '', 'mcq_single', 0 FROM d WHERE doc_id // 3 % 4 = 0 OR doc_id // 3 IN (SELECT pair FROM p WHERE n = 1)""")
def paired_questions(spark, sf_dir):
    key = F.col("doc_id")
    pair = F.when(F.floor(key / 3) % 4 > 0, F.concat(F.lit("pair"), F.floor(key / 3).cast("string")))
    answer = F.struct(F.array(F.lit("yes")).alias("correct_answers"), F.array(F.lit("no")).alias("wrong_answers"))
    d = table(spark, sf_dir, "documents").filter(key < 400).select(key.cast("string").alias("sample_id"), F.lit("s").alias("story"), F.concat(F.lit("q"), key.cast("string")).alias("question"), answer.alias("answer"), F.to_variant_object(F.struct(pair.alias("paired_group_id"), F.when(key % 3 == 1, "emotion").otherwise("cause").alias("question_subtype"))).alias("meta"))
    s = P.prepared(d, "EmoBench", P.Protocol())
    return s.select("sample_id", "question", F.coalesce(F.array_join(F.transform("sub_questions", lambda x: x["subtype"]), ","), F.lit("")).alias("kinds"), "prompt_type", F.greatest(F.coalesce(F.size("sub_questions"), F.lit(0)), F.lit(0)).cast("long").alias("subs"))


@query(f"""SELECT p_partkey, 'access' AS kind, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'story' END || E'\\n\\n' || CASE p_size % 3 WHEN 0 THEN 'Target: ' || p_name || chr(10) WHEN 1 THEN 'Information: ' || p_name || ' ' || p_brand || chr(10) ELSE '' END || E'Question: q\\n\\nOptions:\\nA. x\\nB. y' AS prompt, {_text(P.REASON['en'] + P.DIRECTIVES['en', 'mcq_single'])} AS system_prompt FROM part
UNION ALL SELECT p_partkey, 'inline', E'story\\n\\nQuestion: q\\nChoices: A. x, B. y', {_text(P.REASON['en'] + P.DIRECTIVES['en', 'mcq_single'])} FROM part""")
def hooked_prompts(spark, sf_dir):
    size = F.col("p_size")
    answer = F.struct(F.array(F.lit("x")).alias("correct_answers"), F.array(F.lit("y")).alias("wrong_answers"))
    kind = F.when(size % 3 == 0, "answerabilityQA_list").when(size % 3 == 1, "infoAccessibilityQA_list").otherwise("factQA")
    meta = F.to_variant_object(F.struct(kind.alias("question_type"), F.col("p_name").alias("fact_question"), F.col("p_brand").alias("fact_answer"), F.when(size % 2 == 0, F.col("p_type")).alias("short_context")))
    s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("sample_id"), F.lit("story").alias("story"), F.lit("q").alias("question"), answer.alias("answer"), meta.alias("meta"))
    out = None
    for name, dataset in (("access", "FanToM"), ("inline", "HiToM")):
        rows = P.prepared(s, dataset, P.Protocol("del_tom")).filter("repeat = 0").select("p_partkey", F.lit(name).alias("kind"), "prompt", "system_prompt")
        out = rows if out is None else out.unionByName(rows)
    return out


def _headed_sql(dataset: str, asked: str = "p_size % 3 > 0", headings=P.HEADINGS) -> str:
    story, question, options, between = (_text(h) for h in headings[dataset])
    return f"SELECT p_partkey, '{dataset}' AS dataset, {story} || p_type || {between} || {question} || p_name || CASE WHEN p_size % 5 > 0 THEN {between} || {options} || E'A. x\\nB. ' || p_brand ELSE '' END AS prompt FROM part WHERE {asked}"


HEADED = ("BigToM", "FictionalQA", "PUB", "SocialIQA", "ToMBench")


@query(" UNION ALL ".join([_headed_sql(d, "p_size % 3 > 0" if d in P.HEADINGS_ZH else "true") for d in HEADED] + [_headed_sql("ToMBench", "p_size % 3 = 0", P.HEADINGS_ZH)]))
def headed_prompts(spark, sf_dir):
    size, none = F.col("p_size"), F.array().cast("array<string>")
    answer = F.struct(F.array(F.lit("x")).alias("correct_answers"), F.when(size % 5 > 0, F.array("p_brand")).otherwise(none).alias("wrong_answers"))
    meta = F.to_variant_object(F.struct(F.when(size % 3 == 0, "zh-CN").otherwise("en").alias("lang")))
    s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_type").alias("story"), F.col("p_name").alias("question"), answer.alias("answer"), meta.alias("meta"))
    out = None
    for dataset in HEADED:
        rows = P.prepared(s, dataset, P.Protocol("del_tom")).filter("repeat = 0").select("p_partkey", F.lit(dataset).alias("dataset"), "prompt")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT p_partkey, replace(replace(replace({_text(P.WORDING['en', 'choice'])}, '{{story}}', 'st'), '{{question}}', 'Which?'), '{{options}}', CASE WHEN false THEN '' ELSE 'A. ' || p_name || E'\\nB. ' || p_brand END) AS no_story, 1 AS x FROM part WHERE false
UNION ALL SELECT p_partkey, probe, length(prompt)::INTEGER FROM (SELECT p_partkey, unnest(['no_options', 'no_question', 'no_story']) AS probe, unnest([E'Story:\\nst\\n\\nQuestion: Which?', E'Story:\\nst\\n\\nQuestion: \\n\\nOptions:\\nA. ' || p_name || E'\\nB. ' || p_brand, E'Story:\\n\\n\\nQuestion: Which?\\n\\nOptions:\\nA. ' || p_name || E'\\nB. ' || p_brand]) AS prompt FROM part WHERE p_size % 2 = 0)""")
def probe_prompts(spark, sf_dir):
    wrong = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    option = lambda letter, c: F.struct(F.lit(letter).alias("letter"), F.col(c).alias("text"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.lit("st").alias("story"), F.lit("Which?").alias("question"), F.struct(F.array("p_name").alias("correct_answers"), wrong.alias("wrong_answers")).alias("answer"), F.array(option("A", "p_name"), option("B", "p_brand")).alias("options"), F.lit("mcq_single").alias("prompt_type"), F.lit("en").alias("lang"))
    return P.probes(s).select("p_partkey", F.col("probe").alias("no_story"), F.length("prompt").alias("x"))


# ---- judges ------------------------------------------------------------------------------


def open_records(spark, sf_dir) -> DataFrame:
    v = with_meta(typed(spark, sf_dir).filter("prompt_type = 'open' OR event_id % 8 = 0"), dim=F.when(F.col("k") % 3 == 0, "mild").when(F.col("k") % 3 == 1, "none"))
    return v.withColumns({"row_id": F.col("event_id"), "wrong_answers": F.array().cast("array<string>"), "question": F.lit("q")})


@query(f"""WITH {TYPED} SELECT event_id, CASE WHEN prompt_type = 'open' THEN event_type = 'view' AND NOT none ELSE coalesce(is_correct, false) END AS is_correct,
CASE WHEN none THEN 'content_none' WHEN prompt_type <> 'open' THEN CASE WHEN extracted IS NULL THEN 'extraction_failed' WHEN NOT is_correct THEN 'wrong_answer' END WHEN event_type IN ('click', 'error') THEN 'judge_error' WHEN event_type <> 'view' THEN 'wrong_answer' END AS error_reason FROM g WHERE prompt_type = 'open' OR event_id % 8 = 0""")
def judge_yes_no(spark, sf_dir):
    ask = lambda rows, k: responder.asked(rows, yes_judge, "row_id", retries=0)
    return O.judged(open_records(spark, sf_dir), O.Context("llm_simple", ask)).select("event_id", "is_correct", "error_reason")


@query(f"""WITH {TYPED}, a AS (SELECT event_id, k % 3 AS m, CASE WHEN none THEN '' ELSE 'It is \\boxed{{the ' || event_type || ' event.}}' END AS answer FROM g WHERE prompt_type = 'open'),
s AS (SELECT event_id, m, least(10, length(answer) % 11 + CASE WHEN m = 0 THEN 1 ELSE 0 END)::DOUBLE AS one, CASE WHEN event_id % 3 > 0 THEN 4.0::DOUBLE END AS two FROM a),
w AS (SELECT event_id, CASE WHEN m <> 1 THEN one END AS judge1_score, two AS judge2_score, m FROM s), v AS (SELECT *, CASE WHEN judge1_score IS NULL THEN judge2_score WHEN judge2_score IS NULL THEN judge1_score ELSE (judge1_score + judge2_score) / 2 END AS judge_score FROM w)
SELECT event_id, judge_score, judge1_score, judge2_score, CASE WHEN judge1_score IS NOT NULL THEN CASE m WHEN 0 THEN 'mild' ELSE 'fallback' END WHEN judge2_score IS NOT NULL THEN 'second' END AS judge_reason, coalesce(judge_score >= 5, false) AS is_correct, CASE WHEN judge_score IS NULL THEN 'judge_error' WHEN judge_score < 5 THEN 'below_threshold' END AS error_reason FROM v""")
def judge_rubric(spark, sf_dir):
    rubrics = spark.createDataFrame([("mild", "mild"), ("none", "none"), ("other", "x")], "key string, rubric string")

    def ask(rows: DataFrame, k: int) -> DataFrame:
        if k == 0:
            return responder.asked(rows, score_judge, "row_id", retries=0)
        return rows.select("row_id", F.when(F.col("row_id") % 3 > 0, 'I say {"score": 4, "reason": "second"}').alias("content"))

    context = O.Context("rubric", ask, 2, 5.0, rubrics, "dim", "fallback")
    out = O.judged(open_records(spark, sf_dir).filter("prompt_type = 'open'"), context)
    return out.select("event_id", "judge_score", "judge1_score", "judge2_score", "judge_reason", "is_correct", "error_reason")


@query(f"WITH {TYPED} SELECT event_id, is_correct, round(judge_score, 6)::DOUBLE AS judge_score FROM g WHERE prompt_type = 'open'")
def judge_f1(spark, sf_dir):
    v = O.judged(open_records(spark, sf_dir), O.Context("f1", least=0.6))
    return v.filter("prompt_type = 'open'").select("event_id", "is_correct", F.round("judge_score", 6).alias("judge_score"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN length('故事' || p_name) ELSE length('Story: ' || p_name) END AS at, p_size % 2 = 0 AS zh, true AS filled FROM part")
def answerability_prompts(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_name").alias("story"), F.lit("q").alias("question"), F.struct(F.array("p_type", "p_brand").alias("correct_answers"), F.lit(None).cast("array<string>").alias("wrong_answers")).alias("answer"), F.when(F.col("p_size") % 2 == 0, "zh").otherwise("en").alias("lang"))
    text = P.answerability_prompt()
    head = F.when(F.col("lang") == "zh", F.concat(F.lit("故事"), F.col("story"))).otherwise(F.concat(F.lit("Story: "), F.col("story")))
    whole = text.contains(F.array_join("answer.correct_answers", ", ")) & text.contains(F.col("story")) & text.contains('"label"') & ~text.contains("{story}")
    return s.select("p_partkey", F.length(head).cast("long").alias("at"), text.contains("故事").alias("zh"), whole.alias("filled"))


# ---- answers of agents, calls and remaining scalars --------------------------------------

REPLIES = ("I think\nANSWER: c, a\nbye", "answer: none", "the Best", "ANSWER: D\n answer: b")


@query("SELECT p_partkey, kind, CASE kind WHEN 'mcq_single' THEN ['C', 'A', 'B', 'B'][(p_partkey % 4)::INTEGER + 1] ELSE ['A,C', 'A', 'B', 'B'][(p_partkey % 4)::INTEGER + 1] END AS letters FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'mcq_single' ELSE 'mcq_multi' END AS kind FROM part)")
def agent_letters(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "mcq_single").otherwise("mcq_multi")
    text = F.get(F.array(*map(F.lit, REPLIES)), (F.col("p_partkey") % 4).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), text.alias("t"))
    return p.select("p_partkey", "kind", F.array_join(J.offered_letters(F.col("t"), F.array(*map(F.lit, "ABC")), F.col("kind")), ",").alias("letters"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'x a' WHEN 1 THEN 'y' WHEN 2 THEN 'a' ELSE c_name END AS answer, CASE c_custkey % 4 WHEN 0 THEN c_name || E'\\nz' WHEN 1 THEN c_name WHEN 2 THEN c_name ELSE '' END AS thoughts FROM customer")
def split_thoughts(spark, sf_dir):
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("x <think> "), name, F.lit("</think><think>z</think>a"))).when(k == 1, F.concat(name, F.lit(" </think> y"))).when(k == 2, F.concat(F.lit("a<think>"), name)).otherwise(name)
    answer, thoughts = A.split_thoughts(text)
    return table(spark, sf_dir, "customer").select("c_custkey", answer.alias("answer"), thoughts.alias("thoughts"))


@query("SELECT count(*) AS calls, count(*) FILTER (WHERE length(c_mktsegment) % 5 > 0) AS succeeded, count(*) FILTER (WHERE length(c_mktsegment) % 5 = 0) AS failed, count(*) AS attempts, coalesce(sum(length(c_mktsegment)) FILTER (WHERE length(c_mktsegment) % 5 > 0), 0)::BIGINT AS prompt_tokens, count(*) FILTER (WHERE length(c_mktsegment) % 5 > 0) AS completion_tokens FROM customer")
def call_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("prompt"))
    return responder.usage(responder.asked(rows, echo, "c_custkey")).drop("seconds")


@query("SELECT p_partkey, CASE WHEN length(p_name) > 14 THEN left(p_name, 9) || ' …' ELSE p_name END AS short, CASE WHEN p_size > 25 THEN left(repeat(p_type, 200), 2000) ELSE p_type END AS judged FROM part")
def shortened_texts(spark, sf_dir):
    long = F.when(F.col("p_size") > 25, F.repeat("p_type", 200)).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", P.shortened(F.col("p_name"), 14, 9).alias("short"), F.left(long, F.lit(P.JUDGED_CHARS)).alias("judged"))


@query("SELECT p_partkey, coalesce(p_size % 3 = 0, false) AS ok, ceil(p_size / 2.0)::INTEGER AS majority, p_size AS every FROM part")
def open_by_threshold(spark, sf_dir):
    golds = F.array(F.lit(" "), F.when(F.col("p_size") % 3 == 0, F.lit("The answer")).otherwise(F.lit("other")))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", Q.open_correct(A.english_tokens(F.lit("answer")), golds, 0.5).alias("ok"), Q.threshold(F.col("p_size")).alias("majority"), Q.threshold(F.col("p_size"), "all").alias("every"))


# ---- tasks whose metrics are dimensions alone --------------------------------------------

#: Of each such task its dimensions: name, key of meta, what the SQL has for it.
PLAIN = {
    "ExploreToM": {"dimension": "event_type", "answer_type": "'u' || user_id % 3", "nth_order": "k % 4", "story_type": "'unknown'"},
    "HellaSwag": {"split_type": "event_type"},
    "HiToM": {"order": "k % 4"},
    "PUB": {"option_count": "2 + event_id % 2"},
    "SimpleToM": {"dimension": "event_type", "qa_type": "'u' || user_id % 3", "scenario_name": "'unknown'"},
    "SocialBench": {"category": "'u' || user_id % 3", "dimension": "event_type", "lang": "'unknown'", "num_choices": "2 + event_id % 2"},
    "SocialIQA": {"dimension": "event_type"},
    "TactfulToM": {"category": "'u' || user_id % 3", "question_type": "event_type", "lie_type": "'unknown'", "tom_type": "k % 4"},
    "ToMBench": {"task": "event_type", "ability": "'u' || user_id % 3", "lang": "'unknown'"},
    "ToMChallenges": {"question_type": "event_type", "task_format": "'unknown'", "test_type": "k % 4"},
    "ToMQA": {"dimension": "event_type", "task": "'u' || user_id % 3"},
    "ToMato": {"mental_state": "'u' || user_id % 3", "order": "k % 4", "false_belief": "CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END"},
    "ToMi": {"story_type": "'unknown'", "question_type": "event_type"},
}


def _plain_sql() -> str:
    one = lambda task, dim, split: f"SELECT '{task}' AS task, '{dim}=' || ({split}) AS path, is_correct FROM g"
    rows = [one(task, dim, split) for task, dims in PLAIN.items() for dim, split in dims.items()]
    rows += [f"SELECT '{task}', unnest(['', 'type=' || prompt_type]), is_correct FROM g" for task in PLAIN]
    joint = "SELECT 'TactfulToM', 'joint_comp_just=overall', 0.0::DOUBLE, 0"
    return f"WITH {TYPED} SELECT task, path, round((count(*) FILTER (WHERE is_correct))::DOUBLE / count(*), 6) AS acc, count(*) AS n FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL UNION ALL {joint}"


@query(_plain_sql())
def task_plain_dimensions(spark, sf_dir):
    k, user, kind = F.col("k"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), F.col("event_type")
    option = lambda x: F.struct(F.lit(x).alias("letter"), F.lit(x).alias("text"))
    v = judged(spark, sf_dir).withColumn("options", F.when(F.col("event_id") % 2 == 0, F.array(option("A"), option("B"))).otherwise(F.array(option("A"), option("B"), option("C"))))
    v = cut(v)  # graded once for all tasks
    columns = {"event_type": kind, "'u' || user_id % 3": user, "k % 4": k % 4, "CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END": k % 2 == 0}
    out = None
    for task, dims in PLAIN.items():
        keys = {"filename" if (task, dim) == ("ToMBench", "task") else dim: columns[split] for dim, split in dims.items() if split in columns}
        keys = {n: F.concat(c, F.lit(".jsonl")) if n == "filename" else F.array(c) if (task, n) == ("SocialBench", "dimension") else c for n, c in keys.items()} or {"none": F.lit(1)}
        part = flat(T.evaluated(with_meta(v, **keys), task).drop("scope")).withColumn("task", F.lit(task))
        out = part if out is None else out.unionByName(part)
    return out.select("task", "path", "acc", "n")
