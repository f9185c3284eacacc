"""Prompts as columns: protocols, repeats, options, bodies, probes. Wording is a parameter with a default of our own."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaspark.functions import answers as A

#: Sampling parameters of each protocol.
PROTOCOLS = {
    "direct": {"temperature": 0.0, "top_p": 0.95, "max_tokens": 8192, "repeats": 1, "thinking": False},
    "direct_think": {"temperature": 0.6, "top_p": 0.95, "max_tokens": 32768, "repeats": 1, "thinking": True},
    "cot": {"temperature": 0.6, "top_p": 0.95, "max_tokens": 32768, "repeats": 1, "thinking": True},
    "del_tom": {"temperature": 0.6, "top_p": 0.95, "max_tokens": 32768, "repeats": 8, "thinking": True},
}
VOTING = "del_tom"


@dataclass(frozen=True)
class Protocol:
    """How a protocol, or none, samples, extracts and votes."""

    name: str | None = None

    def __post_init__(self) -> None:
        if self.name is not None and self.name not in PROTOCOLS:
            raise ValueError(f"unknown protocol {self.name!r}")

    @property
    def extractor(self) -> str:
        return "legacy" if self.name is None else "direct" if self.name == "direct" else "cot"

    @property
    def reasons(self) -> bool:
        return self.name in ("cot", VOTING)

    @property
    def votes(self) -> bool:
        return self.name == VOTING

    @property
    def shuffles(self) -> bool:
        """Votes compare letters, so their options keep one order."""
        return self.name != VOTING

    def repeats(self, otherwise: int = 1) -> int:
        return otherwise if self.name is None else PROTOCOLS[self.name]["repeats"]


#: What is asked of a model, by language and question type; `{story}`, `{question}` and `{options}` are filled in.
WORDING: Mapping[tuple[str, str], str] = {
    ("en", "choice"): "Story:\n{story}\n\nQuestion: {question}\n\nOptions:\n{options}",
    ("en", "open"): "Story:\n{story}\n\nQuestion: {question}",
    ("zh", "choice"): "故事：\n{story}\n\n问题：{question}\n\n选项：\n{options}",
    ("zh", "open"): "故事：\n{story}\n\n问题：{question}",
}


def repeated(samples: DataFrame, repeats: int) -> DataFrame:
    """Each sample as often as it is asked, numbered from 0, without a shuffle."""
    return samples.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def options_block(options: Column) -> Column:
    """Lines `A. text` of array<struct<letter, text>>."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), F.coalesce(o["text"], F.lit("")))), "\n")


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with every {name} replaced; what a value holds is not replaced again."""
    parts = F.split(template, r"(?=\{\w+\})|(?<=\})")
    holes = F.map_from_arrays(F.array(*(F.lit("{%s}" % k) for k in values)), F.array(*(F.coalesce(v, F.lit("")) for v in values.values())))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(holes, p), p)), "")


#: How an answer is to be given, by language and question type: with a box, which every extractor reads.
DIRECTIVES: Mapping[tuple[str, str], str] = {
    ("en", "mcq_single"): "Answer with the letter of the best option, as \\boxed{X}.",
    ("en", "mcq_multi"): "Answer with the letters of all right options in one box, as \\boxed{A,C}.",
    ("en", "mcq_grouped"): "Answer each question in turn with a box of its own, as \\boxed{A} and then \\boxed{C}.",
    ("en", "open"): "Answer with a short phrase, as \\boxed{phrase}.",
    ("zh", "mcq_single"): "请用 \\boxed{X} 给出最佳选项的字母。",
    ("zh", "mcq_multi"): "请用一个 \\boxed{A,C} 给出全部正确选项的字母。",
    ("zh", "mcq_grouped"): "请依次为每个问题各给出一个方框,例如 \\boxed{A},再 \\boxed{C}。",
    ("zh", "open"): "请用 \\boxed{短语} 给出简短答案。",
}
#: What comes before it where a protocol asks for reasoning, and what a system prompt begins with.
REASON: Mapping[str, str] = {"en": "Think step by step first. ", "zh": "请先逐步思考。"}
ROLE: Mapping[str, str] = {"en": "You read a story closely and answer a question about it. ", "zh": "你仔细阅读故事并回答问题。"}


def _by_kind(texts: Mapping[tuple[str, str], str], lang: Column, prompt_type: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for (of, kind), text in texts.items():
        out = out.when((lang == of) & (prompt_type == kind), F.lit(text))
    return out


def _by_lang(texts: Mapping[str, str], lang: Column) -> Column:
    return F.when(lang == "zh", texts["zh"]).otherwise(texts["en"])


def directive(lang: Column, prompt_type: Column, reasons: bool = False, texts: Mapping[tuple[str, str], str] = DIRECTIVES) -> Column:
    """How the answer is to be given; null for a type that is not known."""
    text = _by_kind(texts, lang, prompt_type)
    return F.concat(_by_lang(REASON, lang), text) if reasons else text


def system_prompt(protocol: Protocol, lang: Column, prompt_type: Column, texts: Mapping[tuple[str, str], str] = DIRECTIVES) -> Column:
    """The system prompt of a protocol, which then holds the directive; empty without a protocol."""
    if protocol.name is None:
        return F.lit("")
    return F.concat(_by_lang(ROLE, lang), directive(lang, prompt_type, protocol.reasons, texts))


def prompt(story: Column, question: Column, options: Column, prompt_type: Column, lang: Column, wording: Mapping[tuple[str, str], str] = WORDING, instruct: bool = False) -> Column:
    """The question to a model, without white space at its end; `instruct` adds the directive to choice questions."""
    template = F.lit(wording["en", "choice"])
    for (of, kind), text in wording.items():
        template = F.when((lang == of) & ((prompt_type == "open") == F.lit(kind == "open")), F.lit(text)).otherwise(template)
    body = filled(template, {"story": story, "question": question, "options": options_block(options)})
    if instruct:
        body = F.concat(body, F.when(prompt_type != "open", F.concat(F.lit("\n\n"), directive(lang, prompt_type))).otherwise(""))
    return F.regexp_replace(body, r"(?U)\s+$", "")


@dataclass(frozen=True)
class Hooks:
    """What a dataset does in its own way: change its samples, its body, its system prompt. None is the default.

    samples: DataFrame -> DataFrame. body: Column of the prompt without a directive. system: (protocol) -> Column.
    """

    samples: Callable[[DataFrame], DataFrame] | None = None
    body: Callable[[], Column] | None = None
    system: Callable[[Protocol], Column] | None = None


def meta_text(key: str) -> Column:
    return F.coalesce(F.try_variant_get("meta", f"$.{key}", "string"), F.lit(""))


def access_body() -> Column:
    """A body with a line before the question that tells what it is about, by question type, and the short context
    instead of the story where there is one."""
    kind, fact = meta_text("question_type"), meta_text("fact_question")
    line = F.when(kind.startswith("answerability"), F.concat(F.lit("Target: "), fact, F.lit("\n"))).when(kind.startswith("infoAccessibility"), F.concat(F.lit("Information: "), fact, F.lit(" "), meta_text("fact_answer"), F.lit("\n"))).otherwise("")
    context = F.coalesce(F.nullif(meta_text("short_context"), F.lit("")), F.col("story"))
    return F.concat(context, F.lit("\n\n"), line, F.lit("Question: "), F.col("question"), F.lit("\n\nOptions:\n"), options_block(F.col("options")))


def inline_body() -> Column:
    """A body with all choices in one line."""
    line = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(". "), o["text"])), ", ")
    return F.concat(F.col("story"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nChoices: "), line)


def grouped_body() -> Column:
    """A story with several questions, each with its options; a sample with one question is asked as such."""
    part = lambda s, k: F.concat(F.lit("Question "), (k + 1).cast("string"), F.lit(":\n"), s["question"], F.lit("\n\nOptions:\n"), options_block(s["options"]))
    many = F.array_join(F.transform("sub_questions", part), "\n\n")
    one = F.concat(F.lit("Question:\n"), F.col("question"), F.lit("\n\nOptions:\n"), options_block(F.col("options")))
    return F.concat(F.lit("Story:\n"), F.col("story"), F.lit("\n\n"), F.when(F.size("sub_questions") > 0, many).otherwise(one))


def paired(samples: DataFrame, dataset: str) -> DataFrame:
    """Samples of one meta.paired_group_id as one with sub_questions, the question on emotion first, others by id.

    Samples without a partner stay, with no sub_questions. A group has few members, so they meet in one row.
    """
    key = F.coalesce(F.nullif(F.try_variant_get("meta", "$.paired_group_id", "string"), F.lit("")), F.col("sample_id"))
    kind = F.try_variant_get("meta", "$.question_subtype", "string")
    rows = samples.select(key.alias("_group"), F.struct((F.coalesce(kind, F.lit("")) != "emotion").alias("later"), F.col("sample_id").alias("sample_id"), "story", "question", "answer", kind.alias("subtype"), F.to_json("meta").alias("meta")).alias("m"))
    groups = rows.groupBy("_group").agg(F.array_sort(F.collect_list("m")).alias("m"))

    def sub(m: Column, k: Column) -> Column:
        seed = A.shuffle_seed(F.lit(dataset), F.concat(F.col("_group"), F.lit("|"), k.cast("string")), F.lit("0"))
        options = A.shuffled_options(m["answer"]["correct_answers"], m["answer"]["wrong_answers"], seed)
        return F.struct(m["question"].alias("question"), m["subtype"].alias("subtype"), F.transform(options, lambda o: F.struct(o["letter"].alias("letter"), o["text"].alias("text"))).alias("options"), F.transform(F.filter(options, lambda o: o["correct"]), lambda o: o["letter"]).alias("correct_letters"))

    first, many, none = F.col("m")[0], F.size("m") > 1, F.array().cast("array<string>")
    subs = F.transform("m", sub)
    answer = F.when(many, F.struct(none.alias("correct_answers"), none.alias("wrong_answers"))).otherwise(first["answer"])
    question = F.when(many, F.array_join(F.transform("m", lambda m: m["question"]), " || ")).otherwise(first["question"])
    return groups.select(F.when(many, F.col("_group")).otherwise(first["sample_id"]).alias("sample_id"), first["story"].alias("story"), question.alias("question"), answer.alias("answer"), F.parse_json(first["meta"]).alias("meta"), F.when(many, subs).alias("sub_questions"))


#: What stands before story, question and options of each dataset, and between the three.
HEADINGS: Mapping[str, tuple[str, str, str, str]] = {
    "Belief_R": ("Premises:\n", "Question:\n", "Options:\n", "\n\n"),
    "BigToM": ("Story: ", "Question: ", "Choose one of the following:\n", "\n"),
    "ExploreToM": ("Story:\n", "Question:\n", "Options:\n", "\n\n"),
    "FictionalQA": ("Document:\n", "Question:\n", "Options:\n", "\n\n"),
    "HellaSwag": ("Passage:\n", "Question:\n", "Options:\n", "\n\n"),
    "PUB": ("", "", "Options:\n", "\n\n"),
    "SimpleToM": ("Story:\n", "Question:\n", "Options:\n", "\n\n"),
    "SocialBench": ("", "", "Options:\n", "\n\n"),
    "SocialIQA": ("Context:\n", "Question:\n", "Answers:\n", "\n\n"),
    "TactfulToM": ("# Context:\n", "# Question:\n", "# Options:\n", "\n\n"),
    "ToMBench": ("[Story]\n", "[Question]\n", "[Candidate Answers]\n", "\n\n"),
    "ToMChallenges": ("Story:\n", "Question:\n", "Options:\n", "\n\n"),
    "ToMQA": ("Story:\n", "Question:\n", "Options:\n", "\n\n"),
    "ToMato": ("Conversation:\n", "Question:\n", "Options:\n", "\n\n"),
    "ToMi": ("Story:\n", "Question:\n", "Options:\n", "\n\n"),
}
#: The same for Chinese samples of datasets that have both languages.
HEADINGS_ZH: Mapping[str, tuple[str, str, str, str]] = {"ToMBench": ("[故事]\n", "[问题]\n", "[答案选项]\n", "\n\n")}


def headed_body(headings: tuple[str, str, str, str], zh: tuple[str, str, str, str] | None = None) -> Column:
    """A body of story, question and, where there are any, options, each under its heading."""
    of = lambda k: F.lit(headings[k]) if zh is None else F.when(F.col("lang") == "zh", zh[k]).otherwise(headings[k])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    shown = F.when(F.size("options") > 0, F.concat(of(3), of(2), options_block(F.col("options")))).otherwise("")
    return F.concat(of(0), text("story"), of(3), of(1), text("question"), shown)


def _headed(dataset: str) -> Hooks:
    return Hooks(body=lambda: headed_body(HEADINGS[dataset], HEADINGS_ZH.get(dataset)))


#: The ways of datasets that have one.
HOOKS: Mapping[str, Hooks] = {dataset: _headed(dataset) for dataset in HEADINGS} | {
    "EmoBench": Hooks(lambda s: paired(s, "EmoBench"), grouped_body),
    "FanToM": Hooks(body=access_body, system=lambda p: _own_system(p)),
    "HiToM": Hooks(body=inline_body, system=lambda p: _own_system(p)),
}


def _own_system(protocol: Protocol) -> Column:
    """A system prompt that is the directive alone."""
    return directive(F.col("lang"), F.col("prompt_type"), protocol.reasons) if protocol.name else F.lit("")


def prepared(samples: DataFrame, dataset: str, protocol: Protocol, repeats: int = 1, agent: bool = False, hooks: Mapping[str, Hooks] = HOOKS) -> DataFrame:
    """Samples with repeat, prompt_type, options, letters, prompt, system_prompt, shuffle_seed, protocol and extractor:
    what is sent to a model and graded later; with `agent` also `payload`, JSON without any answer.

    Without a protocol and an agent the body holds the directive, with a protocol the system prompt does.
    Over 26 options are an error.
    """
    own = hooks.get(dataset, Hooks())
    samples = own.samples(samples) if own.samples else samples
    if "sub_questions" not in samples.columns:
        samples = samples.withColumn("sub_questions", F.lit(None).cast("array<struct<question: string, subtype: string, options: array<struct<letter: string, text: string>>, correct_letters: array<string>>>"))
    s, c, w = repeated(samples, protocol.repeats(repeats)), F.col("answer.correct_answers"), F.col("answer.wrong_answers")
    seed, many = A.shuffle_seed(F.lit(dataset), F.col("sample_id"), F.col("repeat").cast("string")), F.coalesce(F.size("sub_questions"), F.lit(0)) > 0
    few = F.when(F.size(c) + F.size(w) > 26, F.raise_error(F.lit("over 26 options")).cast("array<string>")).otherwise(c)
    options = A.shuffled_options(few, w, seed) if protocol.shuffles else A.lettered(few, w)
    kind = F.when(many, "mcq_grouped").otherwise(A.question_type(c, w))
    # an open question's only option would be its answer, so it has neither options nor letters nor a seed
    chosen = kind.isin("mcq_single", "mcq_multi")
    s = s.withColumn("options", F.when(chosen, options).otherwise(F.slice(options, 1, 0))).withColumn("shuffle_seed", F.when(chosen, seed).otherwise(F.lit(0).cast("decimal(20,0)"))).withColumn("prompt_type", kind)
    letters = lambda right: F.transform(F.filter("options", lambda o: o["correct"] == right), lambda o: o["letter"])
    lang = A.language(F.try_variant_get("meta", "$.lang", "string"), F.try_variant_get("meta", "$.language", "string"))
    s = s.withColumn("correct_letters", letters(F.lit(True))).withColumn("wrong_letters", letters(F.lit(False))).withColumn("lang", lang)
    s = s.withColumn("protocol", F.lit(protocol.name).cast("string")).withColumn("extractor", F.lit("agent" if agent else protocol.extractor))
    instruct = protocol.name is None and not agent
    if own.body:
        body = F.concat(own.body(), F.lit("\n\n"), directive(F.col("lang"), F.col("prompt_type"))) if instruct else own.body()
        s = s.withColumn("prompt", F.regexp_replace(body, r"(?U)\s+$", ""))
    else:
        s = s.withColumn("prompt", prompt(F.col("story"), F.col("question"), F.col("options"), F.col("prompt_type"), F.col("lang"), instruct=instruct))
    system = F.lit("") if agent else own.system(protocol) if own.system else system_prompt(protocol, F.col("lang"), F.col("prompt_type"))
    s = s.withColumn("system_prompt", system)
    return s.withColumn("payload", payload()) if agent else s


def payload() -> Column:
    """What an agent is sent: id, type, language, story, question and, where there are any, options; no answers."""
    shown = F.map_from_entries(F.transform("options", lambda o: F.struct(o["letter"], o["text"])))
    return F.to_json(F.struct("sample_id", "prompt_type", "lang", "story", "question", F.when(F.size("options") > 0, shown).alias("options")))


def probes(samples: DataFrame) -> DataFrame:
    """Each choice question three times, as a probe lacks its story, its question or its options."""
    kinds = F.explode(F.array(*map(F.lit, ("no_story", "no_question", "no_options"))))
    s = samples.filter(F.size("answer.wrong_answers") > 0).withColumn("probe", kinds)
    without = lambda name, c: F.when(F.col("probe") != name, c)
    hidden = F.when(F.col("probe") == "no_options", F.lit("open")).otherwise(F.col("prompt_type"))
    return s.withColumn("prompt", prompt(without("no_story", F.col("story")), without("no_question", F.col("question")), F.col("options"), hidden, F.col("lang")))


def shortened(text: Column, most: int, kept: int, mark: str = " …") -> Column:
    """Texts over `most` characters cut to `kept` and a mark."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(kept)), F.lit(mark))).otherwise(text)


#: The questions to judges; wording of our own.
JUDGE: Mapping[str, str] = {
    "en": "Does the response match an accepted answer in meaning and no rejected one?\n\nAccepted: {correct}\nRejected: {wrong}\nResponse: {response}\n\nReply with JSON: {\"is_correct\": true} or {\"is_correct\": false}",
    "zh": "回答在语义上是否与某个正确答案一致,且不与错误答案一致?\n\n正确答案:{correct}\n错误答案:{wrong}\n回答:{response}\n\n只输出 JSON:{\"is_correct\": true} 或 {\"is_correct\": false}",
}
ANSWERABLE: Mapping[str, str] = {
    "en": "Can the question be answered from the story alone, with the given answers?\n\nStory: {story}\nQuestion: {question}\nRight: {correct}\nWrong: {wrong}\n\nReply with JSON: {\"label\": \"...\", \"reason\": \"...\"}",
    "zh": "仅凭故事能否用给出的答案回答问题?\n\n故事:{story}\n问题:{question}\n正确:{correct}\n错误:{wrong}\n\n只输出 JSON:{\"label\": \"...\", \"reason\": \"...\"}",
}
SCORE = "{rubric}\n\nQuestion: {question}\n\nReference:\n{reference}\n\nAnswer:\n{response}\n\nReply with JSON: {\"score\": 0 to {most}, \"reason\": \"...\"}"
#: Fixed value: characters of an answer that a judge is shown.
JUDGED_CHARS = 2000


def judge_prompt(wording: Mapping[str, str] = JUDGE) -> Column:
    """The question whether an open answer is right: against references, without story and question."""
    as_json = lambda c: F.to_json(F.coalesce(F.col(c), F.array().cast("array<string>")))
    return filled(_by_lang(wording, F.col("lang")), {"correct": as_json("correct_answers"), "wrong": as_json("wrong_answers"), "response": A.final_answer(F.col("content"))})


def answerability_prompt(wording: Mapping[str, str] = ANSWERABLE) -> Column:
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    return filled(_by_lang(wording, F.col("lang")), {"story": F.col("story"), "question": F.col("question"), "correct": joined("answer.correct_answers"), "wrong": joined("answer.wrong_answers")})


def with_rubric(records: DataFrame, rubrics: DataFrame, key: str, fallback: str) -> DataFrame:
    """Records with `rubric`: that of meta.<key> in (key, rubric), else the fallback. One rubric for each key."""
    asked = records.withColumn("_key", F.try_variant_get("meta", f"$.{key}", "string"))
    of = rubrics.select(F.col("key").alias("_of"), F.nullif("rubric", F.lit("")).alias("_rubric"))
    return asked.join(of, F.col("_key") == F.col("_of"), "left").withColumn("rubric", F.coalesce("_rubric", F.lit(fallback))).drop("_key", "_of", "_rubric")


def score_prompt(most: int = 10, wording: str = SCORE) -> Column:
    """The question for a score by a rubric: references by line, the answer's first 2000 characters."""
    return filled(F.lit(wording), {"rubric": F.col("rubric"), "question": F.col("question"), "reference": F.coalesce(F.array_join("correct_answers", "\n"), F.lit("")), "response": F.left(F.coalesce(F.col("content"), F.lit("")), F.lit(JUDGED_CHARS)), "most": F.lit(str(most))})


def schema_text(schema: StructType, allowed: Mapping[str, tuple[str, ...]] | None = None) -> str:
    """A reply's schema in words, for a prompt: name, type or allowed values, whether it is required, its comment."""
    lines = ["Schema:"]
    for field in schema.fields:
        kind = f"one of {', '.join(allowed[field.name])}" if allowed and field.name in allowed else field.dataType.simpleString()
        lines.append(f"  {field.name}: {kind}, {'optional' if field.nullable else 'required'} - {field.metadata.get('comment', '')}".rstrip(" -"))
    return "\n".join(lines)
