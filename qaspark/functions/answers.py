"""Columns that read answers: boxed payloads, letters, thoughts, token F1, sample ids, languages."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = r"\\box(?:ed)?\s*\{([^{}]*)\}"


def boxed(text: Column) -> Column:
    """All boxed payloads; braces inside a box make it no box."""
    return F.regexp_extract_all(text, F.lit(BOX), F.lit(1))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]"), F.lit(0))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def extracted(text: Column, extractor: str) -> Column:
    """The raw answer of a response: 'direct' takes the first box or letter, 'cot' the last box or the last
    letter of the last 200 characters, 'legacy' the last box alone. Null where there is none."""
    t = F.trim(text)
    if extractor == "direct":
        return F.coalesce(first(boxed(t)), first(letters(t)))
    if extractor == "cot":
        return F.coalesce(last(boxed(t)), last(letters(F.right(t, F.lit(200)))))
    if extractor == "legacy":
        return last(boxed(t))
    raise ValueError(f"unknown extractor {extractor!r}")


def single_letter(raw: Column) -> Column:
    return F.upper(first(letters(raw)))


def letter_set(raw: Column) -> Column:
    """Distinct upper-case letters in order; null if there are none."""
    found = F.array_distinct(F.transform(letters(raw), F.upper))
    return F.when(F.size(found) > 0, found)


def guessed_letter(text: Column) -> Column:
    """A letter of free text: a lone one from A to O, else the first character, a capital; empty for nothing."""
    t = F.trim(F.coalesce(text, F.lit("")))
    alone = F.regexp_extract(t, r"(?U)\b([A-Oa-o])\b", 1)
    return F.upper(F.when(alone != "", alone).otherwise(F.left(t, F.lit(1))))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def final_answer(content: Column) -> Column:
    return F.coalesce(last(boxed(content)), content, F.lit(""))


def question_type(correct: Column, wrong: Column) -> Column:
    return F.when((F.size(wrong) == 0) & (F.size(correct) == 1), "open").when(F.size(correct) > 1, "mcq_multi").otherwise("mcq_single")


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def four_places(value: Column) -> Column:
    """A number with four decimals as C writes it: by the exact value of the double, an exact half to the even digit.

    Java's format rounds halves of the shortest decimal up. From 2**63 on, infinite and not a number: as Java writes them.
    """
    x = value.cast("double")
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole.cast("double")
    n = F.floor(part * 10000.0)
    # pieces of 26 bits, whose products are exact: the sign of their sum tells on which side of the half the value is
    high = F.floor(part * 2.0**26).cast("double") / 2.0**26
    middle = F.floor((part - high) * 2.0**52).cast("double") / 2.0**52
    beyond = high * 20000.0 - (n * 2 + 1).cast("double") + middle * 20000.0 + (part - high - middle) * 20000.0
    n = n + ((beyond > 0) | ((beyond == 0) & (n % 2 == 1))).cast("long")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    exact = F.format_string("%s%d.%04d", sign, whole + F.when(n == 10000, 1).otherwise(0), n % 10000)
    return F.when(F.abs(x) < 2.0**63, exact).when(x.isNotNull(), F.format_string("%.4f", x))


def language(lang: Column, fallback: Column | None = None) -> Column:
    given = F.lower(F.trim(F.coalesce(lang, fallback if fallback is not None else lang, F.lit("en"))))
    return F.when(F.startswith(given, F.lit("zh")), "zh").otherwise("en")


def english_tokens(text: Column) -> Column:
    """Lower case, articles out, ASCII punctuation out, split at white space."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " ")
    return F.filter(F.split(F.translate(plain, string.punctuation, ""), r"(?U)\s+"), lambda t: t != "")


def chinese_tokens(text: Column) -> Column:
    """Each character that is neither white space nor ASCII punctuation."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), string.punctuation, "")
    return F.filter(F.split(plain, ""), lambda t: t != "")


def token_f1(predicted: Column, gold: Column) -> Column:
    """Harmonic mean of multiset precision and recall; both empty 1, one empty 0."""
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda s, t: s + F.least(count(predicted, t), count(gold, t)))
    both = F.size(predicted) + F.size(gold)
    return F.when(both == 0, 1.0).when((F.size(predicted) == 0) | (F.size(gold) == 0), 0.0).otherwise(2.0 * shared / both)


def max_f1(predicted: Column, golds: Column) -> Column:
    """The best F1 over arrays of gold tokens; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(predicted, g))), F.lit(0.0))


def split_thoughts(content: Column) -> tuple[Column, Column]:
    """(answer, thoughts): pairs of think tags, a lone closing tag or a lone opening tag."""
    pair = r"(?s)<think>(.*?)</think>"
    thoughts = F.transform(F.regexp_extract_all(content, F.lit(pair), F.lit(1)), lambda x: F.trim(x))
    rest = F.regexp_replace(content, pair, "")
    closed, opened = F.locate("</think>", rest) > 0, F.locate("<think>", rest) > 0
    answer = F.when(closed, F.element_at(F.split(rest, "</think>"), -1)).when(opened, F.substring_index(rest, "<think>", 1)).otherwise(rest)
    extra = F.when(closed, F.substring_index(rest, "</think>", 1)).when(opened, F.element_at(F.split(rest, "<think>"), -1))
    return F.trim(answer), F.concat_ws("\n", F.filter(F.concat(thoughts, F.array(F.trim(F.coalesce(extra, F.lit(""))))), lambda t: t != ""))


def grams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    # each match looks ahead over a gram and takes one code point
    many = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(many)


def shuffle_seed(*parts: Column) -> Column:
    """The first 64 bits of SHA-256 over the parts joined by bars, as DECIMAL(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def shuffled_options(correct: Column, wrong: Column, seed: Column) -> Column:
    """array<struct<letter, text, correct>> in hash order of the seed."""
    marked = F.concat(F.transform(correct, lambda t: F.struct(t.alias("text"), F.lit(True).alias("correct"))), F.transform(wrong, lambda t: F.struct(t.alias("text"), F.lit(False).alias("correct"))))
    keyed = F.array_sort(F.transform(marked, lambda o, i: F.struct(F.sha2(F.concat_ws("|", seed.cast("string"), i.cast("string")), 256).alias("key"), o["text"].alias("text"), o["correct"].alias("correct"))))
    return F.transform(keyed, lambda o, i: F.struct(F.char(i + 65).alias("letter"), o["text"].alias("text"), o["correct"].alias("correct")))


def lettered(correct: Column, wrong: Column) -> Column:
    """array<struct<letter, text, correct>> in the given order, correct ones first."""
    mark = lambda texts, right: F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(right).alias("correct")))
    return F.transform(F.concat(mark(correct, True), mark(wrong, False)), lambda o, i: F.struct(F.char(i + 65).alias("letter"), o["text"].alias("text"), o["correct"].alias("correct")))
