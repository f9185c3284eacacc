"""Metrics of each question-answering dataset: dimensions by keys of `meta`, and its joint aggregates.

Verdicts have sample_id, prompt_type, is_correct, meta (variant) and, where a task reads them, options, sub_results
and judge_score. Metrics are long: (path, acc, n), path an array of structs of dim and split, a split of a split a
longer path. All dimensions come from one explode and one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.answers import safe_ratio
from qaspark.operators.lineage import cut

UNKNOWN = "unknown"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with_part(key: str, then: Callable[[Column, Column], Column]) -> Column:
    """`then` of meta.key, a variant, and of the name of its type."""
    return _let(F.try_variant_get("meta", f"$.{key}", "variant"), lambda p: _let(F.schema_of_variant(p), lambda kind: then(p, kind)))


def _text(part: Column, kind: Column) -> Column:
    text = F.try_variant_get(part, "$", "string")
    printed = F.when(kind == "BOOLEAN", F.initcap(text)).when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), text)
    return _let(F.trim(printed), lambda t: F.when(t != "", t))


def scalar(key: str) -> Column:
    """meta.key as Python prints it: booleans as True and False; null for arrays, blanks and missing keys."""
    return _with_part(key, _text)


def listed(key: str) -> Column:
    """meta.key as an array of trimmed strings without blanks, repeats kept; a scalar is one element."""
    none = F.array().cast("array<string>")

    def elements(part: Column, kind: Column) -> Column:
        many = F.filter(F.transform(F.try_variant_get(part, "$", "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
        one = _let(_text(part, kind), lambda t: F.when(t.isNotNull(), F.array(t)))
        return F.coalesce(F.when(kind.startswith("ARRAY"), many).otherwise(one), none)

    return _with_part(key, elements)


def first_of(key: str) -> Column:
    return F.coalesce(F.get(listed(key), F.lit(0)), F.lit(UNKNOWN))


def identity() -> Column:
    return F.coalesce(scalar("id"), F.col("sample_id"), F.lit(""))


@dataclass(frozen=True)
class Dim:
    """A dimension: `key` makes a string or an array of strings; children split each of its splits."""

    name: str
    key: Callable[[], Column]
    many: bool = False
    children: tuple[Dim, ...] = ()

    def keys(self) -> Column:
        if not self.many:
            return F.array(F.coalesce(self.key(), F.lit(UNKNOWN)))
        return _let(self.key(), lambda keys: F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit(UNKNOWN))))

    def all(self) -> list[Dim]:
        return [self, *(d for child in self.children for d in child.all())]

    def paths(self, keys: dict[int, Column], above: Column | None = None) -> Column:
        """array<path>: each split's path, and those below it; `keys` holds every dimension's splits by identity."""
        step = lambda k: F.array(F.struct(F.lit(self.name).alias("dim"), k.alias("split")))
        own = F.transform(keys[id(self)], lambda k: F.concat(above, step(k)) if above is not None else step(k))
        below = [F.flatten(F.transform(own, child._under(keys))) for child in self.children]
        return F.concat(own, *below) if below else own

    def _under(self, keys: dict[int, Column]) -> Callable[[Column], Column]:
        return lambda path: self.paths(keys, path)


def by(name: str, key: str | None = None, *children: Dim) -> Dim:
    return Dim(name, lambda: first_of(key or name), children=children)


def each(name: str, key: str | None = None) -> Dim:
    return Dim(name, lambda: listed(key or name), many=True)


TYPE = Dim("type", lambda: F.col("prompt_type"))


def metrics(verdicts: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """(path, acc, n) of every dimension and of the question type; the empty path is all verdicts."""
    everything = F.array(F.array().cast("array<struct<dim: string, split: string>>"))
    dims = (TYPE, *dims)
    named = {id(d): (f"_{k}", d) for k, d in enumerate(d for top in dims for d in top.all())}
    # the splits as columns first: paths name them several times
    rows = verdicts.select(F.coalesce("is_correct", F.lit(False)).alias("ok"), *(d.keys().alias(c) for c, d in named.values()))
    keys = {k: F.col(c) for k, (c, _) in named.items()}
    rows = rows.select("ok", F.explode(F.concat(everything, *(d.paths(keys) for d in dims))).alias("path"))
    out = rows.groupBy("path").agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("n"))
    return out.select("path", safe_ratio(F.col("correct"), F.col("n")).alias("acc"), "n")


def _named(rows: DataFrame, dim: str, split: Column, acc: Column, n: Column) -> DataFrame:
    return rows.select(F.array(F.struct(F.lit(dim).alias("dim"), split.alias("split"))).alias("path"), acc.cast("double").alias("acc"), n.cast("long").alias("n"))


def _stacked(row: DataFrame, dim: str, splits: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of aggregates as one row per split, without reading it again."""
    parts = F.array(*(F.struct(F.lit(s).alias("split"), a.cast("double").alias("acc"), n.cast("long").alias("n")) for s, (a, n) in splits.items()))
    flat = row.select(F.explode(parts).alias("s"))
    return _named(flat, dim, F.col("s.split"), F.col("s.acc"), F.col("s.n"))


def jointly_right(verdicts: DataFrame, dim: str, group: Column, member: Column, sets: dict[str, Sequence[str]]) -> DataFrame:
    """For each named set of members: groups that have all of them, and how many have all of them right."""
    members = verdicts.select(group.alias("g"), member.alias("m"), F.coalesce("is_correct", F.lit(False)).alias("ok")).groupBy("g", "m").agg(F.every("ok").alias("ok"))
    wanted = sorted({m for s in sets.values() for m in s})
    # one column per wanted member: nothing is collected, a group of any size stays one row
    groups = members.filter(F.col("m").isin(*wanted)).groupBy("g").agg(*(F.bool_and(F.when(F.col("m") == m, F.col("ok"))).alias(f"m{k}") for k, m in enumerate(wanted)))
    column = {m: F.col(f"m{k}") for k, m in enumerate(wanted)}

    def both(names: Sequence[str], of: Callable[[Column], Column]) -> Column:
        out = F.lit(True)
        for m in names:
            out = out & of(column[m])
        return out

    counts = []
    for k, names in enumerate(sets.values()):
        counts += [F.count_if(both(names, lambda c: c.isNotNull())).alias(f"n{k}"), F.count_if(both(names, lambda c: F.coalesce(c, F.lit(False)))).alias(f"c{k}")]
    row = groups.agg(*counts)
    return _stacked(row, dim, {s: (safe_ratio(F.col(f"c{k}"), F.col(f"n{k}")), F.col(f"n{k}")) for k, s in enumerate(sets)})


def macro_means(verdicts: DataFrame, dim: str, groups: dict[str, Column]) -> DataFrame:
    """Mean of the groups' accuracies under each grouping, n the number of groups; one shuffle for all of them."""
    keys = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), c.alias("key")) for s, c in groups.items())))
    per = verdicts.select(F.coalesce("is_correct", F.lit(False)).alias("ok"), keys.alias("k")).groupBy("k.split", "k.key").agg(safe_ratio(F.count_if("ok"), F.count(F.lit(1))).alias("a"))
    out = per.groupBy("split").agg(F.avg("a").alias("a"), F.count(F.lit(1)).alias("n"))
    return _named(out, dim, F.col("split"), F.col("a"), F.col("n"))


# ---- joint aggregates of single tasks --------------------------------------------------


def belief_types() -> Column:
    return F.transform(listed("dimension"), lambda x: F.translate(F.lower(x), "- ", "__"))


def _pairs(v: DataFrame) -> DataFrame:
    """Pairs of a true-belief and a false-belief question that are both right."""
    head = F.when(F.instr(identity(), "__") > 0, F.regexp_extract(identity(), r"(?s)^(.*)__", 1)).otherwise(identity())
    head = F.regexp_replace(F.regexp_replace(head, "_true_belief$", ""), "_false_belief$", "")
    kinds = F.explode(F.array_distinct(belief_types()))
    pairs = v.select(head.alias("pair"), kinds.alias("kind"), "is_correct")
    return jointly_right(pairs, "tb_and_fb", F.col("pair"), F.col("kind"), {"overall": ("true_belief", "false_belief")})


#: Steps that are an update of belief; the rest is matching.
UPDATES = ("time_t+1", "time_t1", "t+1", "time_t_1")


def step_kind() -> Column:
    return F.when(F.lower(first_of("step")).isin(*UPDATES), "belief_update").otherwise("belief_matching")


def _belief_reasoning(v: DataFrame) -> DataFrame:
    up = step_kind() == "belief_update"
    ok = F.col("is_correct")
    row = v.agg(F.count_if(ok & up).alias("cu"), F.count_if(up).alias("nu"), F.count_if(ok & ~up).alias("cm"), F.count_if(~up).alias("nm"))
    bu, bm = safe_ratio(F.col("cu"), F.col("nu")), safe_ratio(F.col("cm"), F.col("nm"))
    return _stacked(row, "belief_reasoning", {"BREU": ((bu + bm) / 2, F.col("nu") + F.col("nm")), "BU-Acc": (bu, F.col("nu")), "BM-Acc": (bm, F.col("nm"))})


def _sub_questions(v: DataFrame) -> DataFrame:
    parts = v.select(F.explode("sub_results").alias("s")).groupBy(F.coalesce("s.subtype", F.lit(UNKNOWN)).alias("split")).agg(F.count_if("s.is_correct").alias("c"), F.count(F.lit(1)).alias("n"))
    return _named(parts, "eu_subquestion", F.col("split"), safe_ratio(F.col("c"), F.col("n")), F.col("n"))


def style() -> Column:
    from_id = F.regexp_extract(identity(), r"_style_([^_]*)", 1)
    return F.when(first_of("fiction_type") != UNKNOWN, first_of("fiction_type")).when(from_id != "", from_id).otherwise(UNKNOWN)


def _fiction(v: DataFrame) -> DataFrame:
    or_unknown = lambda c: F.when(c != "", c).otherwise(UNKNOWN)
    event = F.when(F.instr(identity(), "_style_") > 0, or_unknown(F.substring_index(identity(), "_style_", 1))).otherwise(UNKNOWN)
    document = or_unknown(F.substring_index(identity(), "_question_", 1))
    kind = F.schema_of_variant(F.try_variant_get("meta", "$.blind_grade_avg", "variant"))
    numeric = ~kind.isin("STRING", "VOID") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
    blind = F.when(numeric, F.coalesce(F.try_variant_get("meta", "$.blind_grade_avg", "double"), F.try_variant_get("meta", "$.blind_grade_avg", "boolean").cast("double")))
    row = v.agg(F.count_if("is_correct").alias("c"), F.count(F.lit(1)).alias("n"), F.avg(blind).alias("b"), F.count(blind).alias("nb"))
    grading = _stacked(row, "grading", {"informed": (safe_ratio(F.col("c"), F.col("n")), F.col("n")), "blind": (F.col("b"), F.col("nb"))}).filter(F.col("acc").isNotNull())
    return grading.unionByName(macro_means(v, "macro_split_acc", {"event": event, "document": document, "style": style()}))


def question_kind() -> Column:
    """meta.question_type, else the second part of the id between double underscores."""
    return F.coalesce(scalar("question_type"), F.get(F.split(identity(), "__"), F.lit(1)), F.lit(UNKNOWN))


#: Names of question kinds that belong together.
ANSWERABILITY = ("answerabilityQA_list", "answerabilityQAs_binary")
ACCESS = ("infoAccessibilityQA_list", "infoAccessibilityQAs_binary")


def _sets(v: DataFrame) -> DataFrame:
    snippet = F.coalesce(scalar("snippet_id"), F.substring_index(identity(), "__", 1))
    sets = {"overall": ("beliefQAs", *ANSWERABILITY, *ACCESS), "answerability": ANSWERABILITY, "infoaccess": ACCESS}
    return jointly_right(v, "set_all", snippet, question_kind(), sets)


def _joint(v: DataFrame) -> DataFrame:
    return jointly_right(v, "joint_comp_just", first_of("set_id"), first_of("category"), {"overall": ("comprehension", "justification")})


def _rubric_means(v: DataFrame) -> DataFrame:
    """Mean judge score over scored open answers, by dimension and over all."""
    scored = v.filter((F.col("prompt_type") == "open") & F.col("judge_score").isNotNull()).select("judge_score", F.explode(F.array(F.lit("overall"), first_of("dim"))).alias("split"))
    out = scored.groupBy("split").agg(F.avg("judge_score").alias("a"), F.count(F.lit(1)).alias("n"))
    return _named(out, "q4_score", F.col("split"), F.col("a"), F.col("n"))


@dataclass(frozen=True)
class Task:
    dims: tuple[Dim, ...]
    extra: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    #: A key of meta; rows where it is true or missing are measured a second time under the scope `qualified`.
    qualified: str | None = None
    open_judge: str = field(default="rule")


def _count(name: str) -> Dim:
    return Dim(name, lambda: F.greatest(F.coalesce(F.size("options"), F.lit(0)), F.lit(0)).cast("string"))


TASKS: dict[str, Task] = {
    "Belief_R": Task((Dim("step", step_kind), by("modus"), by("types_of_relation")), (_belief_reasoning,)),
    "BigToM": Task((by("condition", "condition_type"), Dim("belief_type", belief_types, many=True)), (_pairs,)),
    "EmoBench": Task((by("subset"), by("language"), by("question_subtype"), by("coarse_category", None, by("finegrained_category")), each("dimension")), (_sub_questions,)),
    "ExploreToM": Task((by("dimension"), by("answer_type"), by("nth_order"), by("story_type")), open_judge="f1"),
    "FanToM": Task((Dim("question_type", question_kind), by("order")), (_sets,)),
    "FictionalQA": Task((Dim("style", style),), (_fiction,), open_judge="f1"),
    "HellaSwag": Task((by("split_type"),)),
    "HiToM": Task((by("order"),)),
    "PUB": Task((_count("option_count"),)),
    "SimpleToM": Task((by("dimension"), by("qa_type"), by("scenario_name"))),
    "SocialBench": Task((by("category"), each("dimension"), by("lang"), _count("num_choices")), open_judge="f1"),
    "SocialIQA": Task((by("dimension"),)),
    "TactfulToM": Task((by("category"), by("question_type"), by("lie_type"), by("tom_type")), (_joint,)),
    "ToMBench": Task((Dim("task", lambda: F.regexp_replace(first_of("filename"), r"\.jsonl$", "")), by("ability"), by("lang"))),
    "ToMChallenges": Task((by("question_type"), by("task_format"), by("test_type")), open_judge="f1"),
    "ToMQA": Task((by("dimension"), by("task"))),
    "ToMato": Task((by("mental_state"), by("order"), by("false_belief"))),
    "ToMi": Task((by("story_type"), by("question_type"))),
    "rubric": Task((by("dim1", None, by("dim2", None, by("dim3", "dim"))), by("qtype"), by("perspective"), by("variant"), by("length", "length_mode")), (_rubric_means,), "review_pass", "rubric"),
}


def passed(key: str, meta: str = "meta") -> Column:
    """Whether meta.key is true as Python takes it: missing is true; null, 0, false and empty values are false."""
    part = F.try_variant_get(meta, f"$.{key}", "variant")
    kind, text = F.schema_of_variant(part), F.to_json(part)
    return F.when(part.isNull(), True).otherwise(~(F.coalesce(kind, F.lit("VOID")) == "VOID") & ~text.isin("false", "0", "0.0", '""', "[]", "{}"))


def task_of(dataset: str, tasks: Mapping[str, str] | None = None) -> Task:
    """The task of a dataset, which `tasks` may give another name; an unknown one is an error."""
    name = (tasks or {}).get(dataset, dataset)
    if name not in TASKS:
        raise ValueError(f"no task is known for dataset {dataset!r}")
    return TASKS[name]


def review_counts(verdicts: DataFrame, key: str = "review_pass") -> DataFrame:
    """(review_pass_count, review_fail_count, review_pass_rate): how many rows are qualified."""
    out = verdicts.agg(F.count_if(passed(key)).alias("review_pass_count"), F.count(F.lit(1)).alias("n"))
    return out.select("review_pass_count", (F.col("n") - F.col("review_pass_count")).alias("review_fail_count"), safe_ratio(F.col("review_pass_count"), F.col("n")).alias("review_pass_rate"))


def evaluated(verdicts: DataFrame, dataset: str, tasks: Mapping[str, str] | None = None) -> DataFrame:
    """(scope, path, acc, n) of a dataset's task. The verdicts are computed once: where several aggregates read them,
    as a written table."""
    spec = task_of(dataset, tasks)
    needed = ("sample_id", "prompt_type", "is_correct", "meta", "options", "sub_results", "judge_score")
    verdicts = verdicts.select(*(c for c in needed if c in verdicts.columns))
    if spec.extra or spec.qualified:
        verdicts = cut(verdicts)

    def measured(v: DataFrame, scope: str) -> DataFrame:
        out = metrics(v, spec.dims)
        for extra in spec.extra:
            out = out.unionByName(extra(v))
        return out.select(F.lit(scope).alias("scope"), "path", "acc", "n")

    out = measured(verdicts, "all")
    if spec.qualified:
        out = out.unionByName(measured(verdicts.filter(passed(spec.qualified)), "qualified"))
    return out


def definitions(dataset: str, tasks: Mapping[str, str] | None = None) -> list[tuple[str, str, str]]:
    """The dimensions of a dataset's metrics as (second, third, fourth) level, a dash where there is none."""
    rows = []
    for top in (TYPE, *task_of(dataset, tasks).dims):
        below = [(child.name, grand.name) for child in top.children for grand in child.children or ()] or [(child.name, "—") for child in top.children] or [("—", "—")]
        rows += [(top.name, *names) for names in below]
    return rows


def definition_text(dataset: str, tasks: Mapping[str, str] | None = None) -> str:
    """The same as a Markdown table under the accuracy, the first level."""
    lines = ["| level 1 | level 2 | level 3 | level 4 |", "|---|---|---|---|"]
    lines += [f"| {'accuracy' if k == 0 else ''} | {' | '.join(row)} |" for k, row in enumerate(definitions(dataset, tasks))]
    return "\n".join(lines) + "\n"
