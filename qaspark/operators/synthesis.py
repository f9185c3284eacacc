"""From what a model synthesises to samples, and the prompts of repair, diagnosis and synthesis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.prompts import filled, shortened

TEXTS = "array<string>"


def inline_options(question: Column, letter: Column) -> tuple[Column, Column]:
    """(right text, wrong texts in order of letters) of options written into a question as `A. ... B. ...`.

    A letter that is not on offer stands for itself. Of a letter that comes twice the later text counts.
    """
    mark = r"(?s)(?<![A-Za-z])([A-D])[.．]\s*(.*?)(?=\s*[A-D][.．]|$)"
    found = F.arrays_zip(F.regexp_extract_all(question, F.lit(mark), F.lit(1)).alias("l"), F.regexp_extract_all(question, F.lit(mark), F.lit(2)).alias("t"))
    wanted = F.upper(F.trim(letter))
    text_of = lambda l: F.get(F.filter(found, lambda o: o["l"] == l), F.size(F.filter(found, lambda o: o["l"] == l)) - 1)["t"]  # noqa: E731, E741
    letters = F.array_sort(F.array_distinct(F.transform(found, lambda o: o["l"])))
    wrong = F.transform(F.filter(letters, lambda x: x != wanted), lambda x: F.trim(text_of(x)))
    return F.coalesce(F.trim(text_of(wanted)), wanted), wrong


def without_notes(text: Column) -> Column:
    """Without notes in parentheses."""
    return F.trim(F.regexp_replace(text, r"\s*\(.*?\)", ""))


def other_options(texts: Column, right: Column) -> Column:
    """Texts without notes, blanks, repeats and the right one, in order."""
    return F.array_distinct(F.filter(F.transform(texts, without_notes), lambda t: t.isNotNull() & (t != "") & (t != right)))


#: What a statement can be judged to be.
JUDGEMENTS = ("是", "否", "无法确定")


def judgement(given: Column) -> tuple[Column, Column]:
    """(judgement, the two others); what is none of the three is the last."""
    known = F.when(F.trim(given).isin(*JUDGEMENTS), F.trim(given)).otherwise(JUDGEMENTS[-1])
    return known, F.filter(F.array(*map(F.lit, JUDGEMENTS)), lambda x: x != known)


def dimension_parts(dim: Column) -> tuple[Column, Column]:
    """(first part, first two parts) of a dimension such as 1.2.3."""
    parts = F.split(dim, r"\.")
    return parts[0], F.array_join(F.slice(parts, 1, 2), ".")


def key_parts(key: Column) -> tuple[Column, Column]:
    """(dimension, question type) of a key such as 1.1.1__Q1__zh; without a type it is empty."""
    plain = F.regexp_replace(F.coalesce(key, F.lit("")), "__(zh|en)$", "")
    typed = F.instr(plain, "__") > 0
    return F.when(typed, F.regexp_extract(plain, r"(?s)^(.*)__", 1)).otherwise(plain), F.when(typed, F.regexp_extract(plain, r"(?s).*__(.*)$", 1)).otherwise("")


def _texts(*columns: str) -> Column:
    return F.array(*columns)


def _some(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.array(column)).otherwise(F.array().cast(TEXTS))


def _several(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(TEXTS))


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """(meta_id, story, question, answer, meta) of synthesised rows, as `schema` lays them out.

    inline: options within the question; pair, triple, several: one, two, two to five wrong answers;
    names: lists of names or one answer each, by question type; many: up to 14 wrong answers, cleaned; and the four
    forms of a graded set, single, multiple, judgement and open, whose meta splits the dimension.
    """
    q, empty = F.col("question"), F.array().cast(TEXTS)
    story = F.col("story") if "story" in rows.columns else F.col("story_full")
    meta = lambda dimension, **more: F.to_variant_object(F.struct(F.col("meta_id").alias("id"), F.lit("").alias("condition_type"), F.array(dimension).alias("dimension"), *(c.alias(k) for k, c in more.items())))

    def graded(kind: str, reference: Column = empty) -> Column:
        or_else = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
        first, second = dimension_parts(F.col("meta_dim"))
        return F.to_variant_object(F.struct(F.col("meta_id").alias("id"), F.col("meta_dim").alias("dim"), first.alias("dim1"), second.alias("dim2"), F.lit(kind).alias("qtype"), or_else("meta_perspective", "third_person").alias("perspective"), F.coalesce("meta_domain", F.lit("")).alias("domain"), or_else("meta_length_mode", "long").alias("length_mode"), F.lit("synthetic").alias("variant"), F.lit("zh").alias("lang"), reference.alias("q4_reference")))

    if schema == "inline":
        right, wrong = inline_options(q, F.col("correct_letter"))
        right, meta_ = F.array(right), meta(F.col("meta_ability"))
    elif schema == "pair":
        right, wrong = _texts("correct_answer"), _texts("wrong_answer")
        meta_ = F.to_variant_object(F.struct(F.col("meta_id").alias("id"), F.col("meta_condition_type").alias("condition_type"), F.array("meta_dimension").alias("dimension")))
    elif schema == "triple":
        right, wrong, meta_ = _texts("correct_answer"), _texts("wrong_answer_1", "wrong_answer_2"), meta(F.col("meta_dimension"))
    elif schema == "several":
        more = F.filter(_texts("wrong_answer_3", "wrong_answer_4", "wrong_answer_5"), lambda w: F.coalesce(F.trim(w), F.lit("")) != "")
        right, wrong, meta_ = _texts("correct_answer"), F.concat(_texts("wrong_answer_1", "wrong_answer_2"), more), meta(F.col("meta_dimension"))
    elif schema == "names":
        listed = F.col("meta_question_type").endswith("_list")
        right, wrong = (F.when(listed, _several(names)).otherwise(_some(one)) for names, one in (("correct_names", "correct_answer"), ("wrong_names", "wrong_answer")))
        meta_ = meta(F.col("meta_question_type"), question_type=F.col("meta_question_type"))
    elif schema == "many":
        one = without_notes(F.col("correct_answer"))
        right, wrong, meta_ = F.array(one), other_options(_texts(*(f"wrong_{k}" for k in range(1, 15))), one), meta(F.lit("belief"))
    elif schema == "single":
        right, wrong, meta_ = _texts("correct_answer"), _texts("wrong_answer_1", "wrong_answer_2", "wrong_answer_3"), graded("Q1")
    elif schema == "multiple":
        right, wrong, meta_ = _several("correct_answers"), _several("wrong_answers"), graded("Q2")
    elif schema == "judgement":
        one, wrong = judgement(F.col("correct_verdict"))
        right, meta_ = F.array(one), graded("Q3")
    elif schema == "open":
        points = F.filter(F.transform(_several("reference_points"), lambda p: F.trim(p)), lambda p: p != "")
        right, wrong, meta_ = F.array(F.array_join(points, "\n")), empty, graded("Q4", points)
    else:
        raise ValueError(f"unknown schema {schema!r}")
    return rows.select("meta_id", story.alias("story"), q.alias("question"), F.struct(right.alias("correct_answers"), wrong.alias("wrong_answers")).alias("answer"), meta_.alias("meta"))


def file_name(model: Column) -> Column:
    """A model's name as part of a file name."""
    return F.regexp_replace(model, "[/: ]", "_")


# ---- prompts: wording of our own, given as parameters ------------------------------------

REPAIR: Mapping[str, str] = {
    "easy": "Make this question harder without changing what is right.\n\n{sample}",
    "shortcut": "Change this question so that it cannot be answered without its story.\n\n{sample}",
    "unanswerable": "Mend this question so that its story answers it. Fault: {label}. {reason}\n\n{sample}",
}
SAMPLE = "Dataset: {dataset}\nStory: {story}\nQuestion: {question}\nRight: {correct}\nWrong: {wrong}"
CASE = "Prompt:\n{prompt}\n\n{reasoning}Answer: {answer}\nRight answer: {gold}\n"
DIAGNOSIS = "{n} wrong answers of dimension {dimension} in {dataset}. Say what the errors have in common.\n\n{cases}"
SYNTHESIS = "Write {n} questions of difficulty {difficulty} on {theme} that need {operation}.\n\n{patterns}"


def listed(values: Column, between: str = ", ") -> Column:
    """An array as one text; null and no values are empty."""
    return F.coalesce(F.array_join(values, between), F.lit(""))


def repair_prompt(dataset: str, wording: Mapping[str, str] = REPAIR, sample: str = SAMPLE) -> Column:
    """What is asked to mend a sample of `to_repair`: by repair type, with the judge's label and reason."""
    body = filled(F.lit(sample), {"dataset": F.lit(dataset), "story": F.col("story"), "question": F.col("question"), "correct": listed(F.col("answer.correct_answers")), "wrong": listed(F.col("answer.wrong_answers"))})
    template = F.lit(None).cast("string")
    for kind, text in wording.items():
        template = F.when(F.col("repair_type") == kind, F.lit(text)).otherwise(template)
    return filled(template, {"sample": body, "label": F.col("answerability_label"), "reason": F.col("answerability_reason")})


def case_text(case: str = CASE) -> Column:
    """One wrong answer for a diagnosis: prompts over 1500 characters are cut to 1300, reasoning over 800 to 700."""
    mark = "\n...[truncated]"
    or_else = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    thought = F.trim(F.coalesce(F.col("wrong_reasoning"), F.lit("")))
    thought = F.when(thought == "", "").otherwise(F.concat(F.lit("Reasoning:\n"), shortened(thought, 800, 700, mark), F.lit("\n\n")))
    return filled(F.lit(case), {"prompt": or_else(shortened(F.trim("actual_prompt"), 1500, 1300, mark), "(not available)"), "reasoning": thought, "answer": or_else(F.col("wrong_answer"), "(unknown)"), "gold": or_else(F.col("gold_answer"), "(unknown)")})


def diagnosis_prompts(cases: DataFrame, dataset: str, wording: str = DIAGNOSIS) -> DataFrame:
    """(dimension, batch, prompt) of cases with dimension, batch and rank; a batch is small by construction."""
    texts = cases.withColumn("text", case_text()).groupBy("dimension", "batch").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda c, k: F.concat(F.lit("### Case "), (k + 1).cast("string"), F.lit("\n"), c["text"])), "\n---\n")
    return texts.select("dimension", "batch", filled(F.lit(wording), {"n": F.size("c").cast("string"), "dimension": F.col("dimension"), "dataset": F.lit(dataset), "cases": joined}).alias("prompt"))


def likeliest(shares: Column) -> Column:
    """The key of the largest value of a map, the smallest key on a tie."""
    best = F.array_sort(F.transform(F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"))))
    return F.get(best, F.lit(0))["key"]


def synthesis_prompt(n: int, wording: str = SYNTHESIS) -> Column:
    """What is asked for new samples by a diagnosis: its likeliest difficulty, first theme, operation and patterns."""
    return filled(F.lit(wording), {"n": F.lit(str(n)), "difficulty": likeliest(F.col("difficulty_distribution")), "theme": F.get("recommended_synthesis_themes", F.lit(0)), "operation": F.col("primary_cognitive_operation"), "patterns": listed(F.transform("common_error_patterns", lambda p: F.concat(F.lit("- "), p)), "\n")})
