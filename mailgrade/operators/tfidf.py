"""TF-IDF over words and bigrams.

Fitting is one scan and one shuffle: terms are counted in arrays per few megabytes of text
(:mod:`..functions.wordcounts`) and per task before they travel, so a term that is in every mail
reaches its reducer as one row per task. Rows that come with ``terms`` alone are counted from them.
Weighting a mail needs no shuffle at all: its terms are counted inside the row
against the vocabulary, whose size is bounded by ``max_terms``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mail as M
from ..functions import terms as tm
from ..functions import wordcounts
from ..functions.matching import computed_once, constant, let
from ..schema import MAX_TERMS

# Document frequency limits of a vocabulary term.
MIN_DF, MAX_DF_SHARE = 2, 0.95
#: Column with the text behind ``terms``, by layout.
TEXT, COMPACT_TEXT = "_term_text", "_compact_term_text"


def with_terms(df: DataFrame, compact: bool = False) -> DataFrame:
    """Add ``terms``: words and bigrams of subject and whole body, and the text they come from."""
    text = F.concat(M.text("subject"), F.lit(" "), M.text("body"))
    return (
        df.withColumn("_words", tm.words(text, compact))
        .withColumn("terms", tm.words_and_bigrams(F.col("_words")))
        .drop("_words", TEXT, COMPACT_TEXT)
        .withColumn(COMPACT_TEXT if compact else TEXT, tm.word_text(text, compact))
    )


def _text_of(docs: DataFrame) -> str | None:
    """The column that ``terms`` come from, where it is there."""
    return next((c for c in (TEXT, COMPACT_TEXT) if c in docs.columns), None)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(term, df, cf)``: mails that hold the term, and how often it occurs in all.

    ``docs`` has an array column ``terms``, or what :func:`with_terms` adds.
    """
    text = _text_of(docs)
    if text is not None:
        found = docs.select(text).mapInArrow(wordcounts.counted(text == COMPACT_TEXT), wordcounts.COUNTS)
        return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    once = F.transform(
        F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("doc"))
    )
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("doc")))
    return (
        docs.select(F.inline(F.concat(once, each)))
        .groupBy("term")
        .agg(
            F.sum("doc").cast("long").alias("df"),
            F.sum(F.lit(1) - F.col("doc")).cast("long").alias("cf"),
        )
    )


def vocabulary(docs: DataFrame, n_docs: int, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(idx, term, df, cf, idf)`` of the kept terms, numbered in alphabetical order."""
    kept = (
        term_counts(docs)
        .filter((F.col("df") >= MIN_DF) & (F.col("df") <= F.lit(MAX_DF_SHARE * n_docs)))
        .orderBy(F.desc("cf"), "term")
        .limit(max_terms)
    )
    # At most max_terms rows are left here, so one sorted list numbers them.
    ordered = F.sort_array(F.collect_list(F.struct("term", "df", "cf")))
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return (
        kept.agg(ordered.alias("kept"))
        .select(F.posexplode("kept").alias("idx", "t"))
        .select("idx", "t.term", "t.df", "t.cf")
        .withColumn("idf", idf)
    )


class _TfidfParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "array of terms", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "weights vector", TypeConverters.toString)
    maxTerms = Param(Params._dummy(), "maxTerms", "vocabulary size limit", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="terms", outputCol="tfidf", maxTerms=MAX_TERMS)


class MailTfidf(Estimator, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary and its weights."""

    @keyword_only
    def __init__(self, *, inputCol: str = "terms", outputCol: str = "tfidf",
                 maxTerms: int = MAX_TERMS):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MailTfidfModel":
        name = self.getOrDefault(self.inputCol)
        text = _text_of(dataset) if name == "terms" else None
        docs = dataset.select(F.col(name).alias("terms")) if text is None else dataset.select(text)
        rows = vocabulary(docs, docs.count(), self.getOrDefault(self.maxTerms)).collect()
        rows.sort(key=lambda r: r["idx"])
        return MailTfidfModel.of(
            [r["term"] for r in rows], [r["idf"] for r in rows],
            self.getOrDefault(self.inputCol), self.getOrDefault(self.outputCol),
        )


class MailTfidfModel(Model, _TfidfParams, DefaultParamsReadable, DefaultParamsWritable):
    """Weights mail with a fitted vocabulary; unseen terms are ignored.

    The weight of a term is ``(1 + ln tf) * idf``, scaled to unit length per mail.
    """

    terms = Param(Params._dummy(), "terms", "vocabulary", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weight per term", TypeConverters.toListFloat)

    @classmethod
    def of(cls, terms, idf, inputCol="terms", outputCol="tfidf") -> "MailTfidfModel":
        model = cls()
        model._set(terms=terms, idf=idf, inputCol=inputCol, outputCol=outputCol)
        return model

    @classmethod
    def from_vocabulary(cls, rows) -> "MailTfidfModel":
        rows = sorted(rows, key=lambda r: r["idx"])
        return cls.of([r["term"] for r in rows], [r["idf"] for r in rows])

    def _fitted(self) -> list[str]:
        if not self.isSet(self.terms):
            raise ValueError("the vocabulary is not fitted; call MailTfidf().fit first")
        return self.getOrDefault(self.terms)

    def weigh(self, dataset: DataFrame) -> DataFrame:
        """Add ``_indices`` and ``_weights``, two parallel arrays per mail."""
        names = self._fitted()
        idf = constant(self.getOrDefault(self.idf), "double")
        raw = F.zip_with(
            "_indices", "_tf", lambda i, tf: (F.lit(1.0) + F.log(tf)) * F.get(idf, i)
        )

        def unit(weights: Column) -> Column:
            norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w * w))
            return let(norm, lambda n: F.transform(weights, lambda w: w / n))

        arrays = self._counted(dataset, names)
        return computed_once(
            arrays, {"_indices": F.col("_indices"), "_weights": let(raw, unit)}
        ).drop("_tf")

    def _counted(self, dataset: DataFrame, names: list[str]) -> DataFrame:
        """Add ``_indices`` and ``_tf``: the vocabulary terms of each mail, and how often it holds them."""
        text = _text_of(dataset) if self.getOrDefault(self.inputCol) == "terms" else None
        if text is None:
            counter = CountVectorizerModel.from_vocabulary(
                names, inputCol=self.getOrDefault(self.inputCol), outputCol="_counts"
            )
            counted = counter.transform(dataset).withColumn("_counts", F.unwrap_udt("_counts"))
            found = {"_indices": F.col("_counts.indices"), "_tf": F.col("_counts.values")}
        else:
            count = F.arrow_udf(
                wordcounts.counter(names, text == COMPACT_TEXT), "indices array<int>, counts array<double>"
            )
            counted = dataset.withColumn("_counts", count(text))
            found = {"_indices": F.col("_counts.indices"), "_tf": F.col("_counts.counts")}
        return counted.withColumns(found).drop("_counts")

    def weights(self, dataset: DataFrame, *keys: str) -> DataFrame:
        """``(*keys, term, weight)``, one row per mail and vocabulary term in it."""
        names = constant(self._fitted(), "string")
        return (
            self.weigh(dataset)
            .select(*keys, F.explode(F.arrays_zip("_indices", "_weights")).alias("e"))
            .select(*keys, F.get(names, F.col("e._indices")).alias("term"),
                    F.col("e._weights").alias("weight"))
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = len(self._fitted())
        return to_sparse(
            self.weigh(dataset), size, "_indices", "_weights", self.getOrDefault(self.outputCol)
        ).drop("_indices", "_weights", TEXT, COMPACT_TEXT)


def to_sparse(df: DataFrame, size: int, indices: str, values: str, output: str) -> DataFrame:
    """Build a sparse ML vector from two arrays.

    No built-in function does so; the vector's JSON form is read back with its
    own type, which keeps the work in the JVM and never makes the row dense.
    """
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        F.col(indices).alias("indices"), F.col(values).alias("values"),
    )
    holder = T.StructType([T.StructField("v", VectorUDT())])
    return df.withColumn(
        output, F.from_json(F.to_json(F.struct(vector.alias("v"))), holder).getField("v")
    )
