"""Language identification by known words, backing off to shorter character n-grams for words that aren't known."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import beside, listed, materialise, small_batches, text_batches

#: Labelled rows that a model is learned from at most, as expected over a hash sample; ids decide, so any order of rows gives the same.
TRAIN_ROWS = 8_000
#: Sizes of n-grams, tried longest first.
ORDERS = (5, 4, 3, 2, 1)
#: Words whose vectors a worker remembers.
REMEMBER = 50_000

_WORD = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Log frequencies: tables[0] has known words' rows of values, tables[n] those of n-grams; a row has a number for each language."""

    languages: list[str]
    tables: dict[int, dict[str, int]]
    values: np.ndarray
    memory: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"languages": self.languages, "tables": self.tables, "values": self.values, "memory": {}}

    def word(self, word: str) -> tuple[float, ...]:
        """The word's log frequency by language; of an unknown word, the mean over its n-grams, each at the longest known size."""
        known = self.tables[0].get(word)
        if known is not None:
            return tuple(self.values[known].tolist())
        marked, total, n = f"^{word}$", [0.0] * len(self.languages), 0
        at = 0
        while at < len(marked):
            step = 1
            for size in ORDERS:
                if at + size <= len(marked) and (found := self.tables[size].get(marked[at : at + size])) is not None:
                    for j, x in enumerate(self.values[found].tolist()):
                        total[j] += x
                    n += 1
                    step = max(1, size - 1)
                    break
            at += step
        return tuple(x / n for x in total) if n else tuple(total)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior of it under even priors; ``und`` and 0 for null or a text without letters."""
        counts = Counter(_WORD.findall(text.lower())) if text else {}
        if not counts or not self.languages:
            return "und", 0.0
        total = [0.0] * len(self.languages)
        for word, n in counts.items():
            vector = self.memory.get(word)
            if vector is None:
                if len(self.memory) >= REMEMBER:
                    self.memory.clear()
                vector = self.memory[word] = self.word(word)
            for j, x in enumerate(vector):
                total[j] += n * x
        top = max(total)
        best = total.index(top)
        return self.languages[best], 1 / sum(math.exp(x - top) for x in total)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _grams(batches):
    """(lang, size, gram, n) of the words of a batch; size 0 is the word."""
    for batch in text_batches(batches, limit=500_000):
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        out: Counter = Counter()
        for lang, found in counts.items():
            for word, n in found.items():
                out[lang, 0, word] += n
                marked = f"^{word}$"
                for size in ORDERS:
                    for i in range(len(marked) - size + 1):
                        out[lang, size, marked[i : i + size]] += n
        langs, sizes, grams = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "size", "gram", "n"])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from (id, text, lang). Only a hash sample of about ``rows`` labelled rows is counted, over any number of machines;
    the driver gets every word and n-gram of those, each once a language.

    Frequencies are smoothed by one half, and a word must occur in two texts' worth of counts to be known. Null texts are left out.
    """
    small_batches(labelled.sparkSession)
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    n = labelled.count()
    if n > rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(rows / n * (1 << 40)))
    counted = labelled.select("text", "lang").mapInArrow(_grams, "lang string, size int, gram string, n long")
    counted = materialise(counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {(r["lang"], r["size"]): (r["t"], r["v"]) for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect()}
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return Model([], {}, np.zeros((0, 0)))
    known = counted.filter("size > 0 OR n > 1").groupBy("size", "gram").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{j}") for j, lang in enumerate(languages)])
    known = known.orderBy("size", "gram").toArrow()
    tables: dict[int, dict[str, int]] = {size: {} for size in (0, *ORDERS)}
    for row, (size, gram) in enumerate(zip(known["size"].to_pylist(), known["gram"].to_pylist(), strict=True)):
        tables[size][gram] = row
    sizes = known["size"].to_numpy()
    values = np.log(np.stack([known[f"n{j}"].to_numpy() for j in range(len(languages))], axis=1) + 0.5)
    for j, lang in enumerate(languages):
        floor = {size: math.log(t + 0.5 * (v + 1)) for size in tables for t, v in [totals.get((lang, size), (0, 0))]}
        values[:, j] -= np.array([floor[size] for size in range(max(tables) + 1)])[sizes]
    return Model(languages, tables, values)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in text_batches(batches):
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            lang, score = zip(*found, strict=True) if found else ((), ())
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) and drop the text; other columns stay, but those named text or like a result.

    The whole text is read. Null texts and texts without a letter are ``und`` with score 0. Of equal languages the first
    in order wins. An empty table gives no rows, a model without languages ``und``.
    """
    small_batches(docs.sparkSession)
    rest = beside(docs, text_col.lower(), "text", "lang_pred", "score")
    kept = docs.select(*[f.name for f in rest], F.col(text_col).alias("text"))
    return kept.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"{listed(rest)}lang_pred string, score double")


def trained_on(docs: DataFrame) -> Model:
    """A model of the documents that aren't held out."""
    return train(docs.filter(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: language of every whole text of documents, learned where crc32(doc_id) modulo 5 isn't 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), trained_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
