"""Language identification by hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. The vector of a letter n-gram binds (multiplies) its
letters' vectors, permuted by their place; a text's vector bundles (adds) those of all its n-grams, a
language's prototype those of its training texts. A text takes the language whose prototype has the
largest cosine with it, after the mean of all prototypes is taken away from prototypes and, in
proportion, from the text; the score is the cosine of text and prototype as they stand, 0 at least.

Letter classes: a to z, one for every 36th letter beyond (by code point), and one for anything else,
runs of which count once. Training sums whole texts of all labelled documents outside the held-out fold:
one vector for each language and task is shuffled.

Defined results. Null text, or one without any letter: `und`, score 0. Null doc_id: held out. Null lang:
not learned from. No training texts at all: every document is `und`. Ties: the language that is first in
order. Repeated rows are learned as often as they stand. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, no_clash

DIMENSIONS, ORDER, CLASSES, SEED = 512, 3, 64, 20240229
FOLDS, UNKNOWN = 5, "und"


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """The class of each code point: 0 for what is no letter, 1 to 26 for a to z, else 27 to 62."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    return table


@lru_cache(2)
def letter_vectors(dimensions: int, seed: int) -> list[np.ndarray]:
    """The letters' vectors, int8, for each place of an n-gram: at place p they are rolled by ORDER - 1 - p."""
    letters = np.random.default_rng(seed).integers(0, 2, (CLASSES, dimensions), dtype=np.int8) * 2 - 1
    return [np.roll(letters, ORDER - 1 - p, 1) for p in range(ORDER)]


def gram_vectors(found: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The bound vectors of n-grams, one row for each."""
    a, b, c = letter_vectors(dimensions, seed)
    return a[found // CLASSES**2] * b[found // CLASSES % CLASSES] * c[found % CLASSES]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text and how often each stands in it; none for a text without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    classes = letter_classes()[points]
    if not classes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = np.concatenate([[0], classes, [0]]).astype(np.int32)
    classes = classes[np.concatenate([[True], (classes[1:] != 0) | (classes[:-1] != 0)])]
    return np.unique(classes[:-2] * CLASSES**2 + classes[1:-1] * CLASSES + classes[2:], return_counts=True)


def bundle(found: tuple[np.ndarray, np.ndarray], dimensions: int, seed: int) -> np.ndarray:
    """A text's vector; float32 sums of whole numbers."""
    return found[1].astype(np.float32) @ gram_vectors(found[0], dimensions, seed).astype(np.float32)


class Profiles:
    """Prototypes of the languages."""

    def __init__(self, languages: list[str], sums: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.languages, self.dimensions, self.seed = languages, dimensions, seed
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12) if len(languages) else sums
        self.prototypes = unit.astype(np.float64)
        self.mean = self.prototypes.mean(0) if len(languages) else np.zeros(dimensions)
        apart = self.prototypes - self.mean if len(languages) > 1 else self.prototypes
        self.apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the number of equally frequent trigrams that would weigh as much as the text's."""
        found = grams(text or "")
        if not len(found[0]):
            return UNKNOWN, 0.0, 0.0
        weight = float(found[1].sum()) ** 2 / float((found[1].astype(np.float64) ** 2).sum())
        if not self.languages:
            return UNKNOWN, 0.0, weight
        vector = bundle(found, self.dimensions, self.seed).astype(np.float64)
        norm = np.linalg.norm(vector)
        if norm == 0:
            return self.languages[0], 0.0, weight
        vector /= norm
        near = self.prototypes @ vector
        best = int(np.argmax(self.apart @ (vector - self.mean)))
        return self.languages[best], round(min(1.0, max(0.0, float(near[best]))), 6), weight


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes from all labelled documents outside the held-out fold."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), folds))

    def bundled(batches):
        import pyarrow as pa

        from qaspark.llm import langid

        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = langid.grams(text)
                if lang not in counts:
                    counts[lang] = np.zeros(langid.CLASSES**3, np.int64)
                counts[lang][found[0]] += found[1]
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            total = np.zeros(dimensions, np.int64)
            for at in range(0, len(used), 4096):
                part = used[at : at + 4096]
                total += n[part] @ langid.gram_vectors(part, dimensions, seed).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "sums"])

    parts = in_batches(labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), bundled, "lang string, sums array<long>")
    sums = parts.select("lang", F.posexplode("sums").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("v")).select("lang", "v.n").orderBy("lang").collect()
    vectors = np.array([r["n"] for r in rows], np.float64).reshape(len(rows), dimensions)
    return Profiles([r["lang"] for r in rows], vectors, dimensions, seed)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            got = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col).alias("text"))
    return in_batches(read, named, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_rows(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """Every row of `docs`, with lang_pred, lang_score and lang_grams, the weight of its trigrams.

    A column of `docs` with one of these names, in any case, is an error.
    """
    no_clash(docs, ("lang_pred", "lang_score", "lang_grams"))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            got = [profiles.judge(t) for t in batch.column(text_col).to_pylist()]
            more = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "lang_score", "lang_grams"])

    return in_batches(docs, named, ", ".join([*columns, "lang_pred string", "lang_score double", "lang_grams double"]))
