"""A training corpus in five stages, from `documents` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm import bytebpe, curriculum, jaccard, langid, linededup
from qaspark.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text less like every language than this is rejected, if its trigrams weigh as much as LEAST_GRAMS equally
#: frequent ones: from there on clean texts lie above 0.25, most random letters under 0.1. Shorter texts are kept.
LEAST_SCORE, LEAST_GRAMS = 0.1, 64


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, null texts and those long enough to judge that are like no language go; `lang` stays as it was given.

    If nothing was learned (no labelled text with letters outside the held-out fold), no text can be judged: only
    null texts and those without letters go. Empty texts and texts of white space or digits alone have no letters.
    Very long texts are read whole. Ties: of equally like languages the first by name counts, which decides nothing
    here. Repeated rows and equal ids: each row is judged by itself. Null doc_id, lang or source: kept as they are.
    Empty table: no rows. Columns beyond those of documents are dropped, whatever their names.
    """
    profiles = langid.learn(docs)
    named = langid.identify_rows(docs.select(*COLUMNS), profiles)
    judged = (F.col("lang_grams") >= LEAST_GRAMS) & F.lit(bool(profiles.prototypes.any()))
    return named.filter((F.col("lang_grams") > 0) & (~judged | (F.col("lang_score") >= LEAST_SCORE))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut out; a document of which nothing is left goes.

    Null text: stays null. Texts of fewer than three lines, empty ones too: kept as they are. Very long texts are cut
    whole. Ties: the first window by doc_id, then by place, stays; null doc_id is the last; of repeated rows and of
    rows with one id one keeps its lines. Empty table: no rows. Further columns are dropped.
    """
    cut = linededup.dedup_lines(docs.select(*COLUMNS)).filter((F.col("n_removed") == 0) | (F.trim(F.col("kept_text")) != ""))
    return cut.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles, 0.8 alike or more, connect, one stays: the smallest doc_id.

    Null and empty texts, and white space alone, are like nothing and stay. Texts of fewer than five words are like
    equal ones. Very long texts are compared whole. Null doc_id is larger than all others; of rows with one id the one
    of the smallest hash of its text counts as first, equal rows are one. Empty table: no rows. Further columns go.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target takes them.

    Null, empty and wordless texts have size 0 and are not taken. Null source: a source of its own. Null doc_id:
    ordered as an empty id. Very long texts are taken whole. Ties of position go by hash and id; repeated rows are
    documents of their own. Empty table: no rows. Further columns are dropped.
    """
    return curriculum.mixed_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to.

    Null text: as empty, with no ids. Very long texts are encoded whole. Null doc_id: kept. Repeated rows and equal
    ids: each row has its own result. Empty table: no rows. Further columns are dropped.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode_column(docs, ranks, public_tokenizers.PATTERN)
    decoded = bytebpe.decode_column(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
