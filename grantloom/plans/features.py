"""Feature vectors: text, categories, units, metadata and their weighted combination."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizer,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.functions.wording import ngrams, tokens, words_in
from grantloom.operators import truncated_svd
from grantloom.plans.terms import computed_once
from grantloom.session import settled

# Fixed value: the title of an award without one.
NO_TITLE = "Unknown Project"


def text_vectors(
    rows: DataFrame,
    text: str,
    longest: int = 2,
    features: int = 5000,
    low: float = 2.0,
    high: float = 0.8,
    shortest: int = 2,
    stop: bool = False,
) -> DataFrame:
    """Adds ``tfidf``: L2-normalised weights with idf ``ln((1 + n) / (1 + df)) + 1``.

    Words have ``shortest`` letters or more; ``stop`` leaves English stop words out before runs are built.
    """
    found = tokens(F.col(text), shortest)
    if stop:
        stops = words_in(StopWordsRemover.loadDefaultStopWords("english"))
        found = F.filter(found, lambda word: ~F.array_contains(stops, word))
    worded = computed_once(rows, ["*"], "__words", found)
    worded = computed_once(worded, ["*"], "__grams", ngrams(F.col("__words"), longest))
    counter = CountVectorizer(inputCol="__grams", outputCol="__tf", vocabSize=features, minDF=low, maxDF=high)
    # Stored: the weights and every later pass read the counts instead of cutting all texts into runs again.
    counted = settled(counter.fit(worded).transform(worded).drop("__words", "__grams"))
    if not width(counted, "__tf"):  # no term is within the bounds
        return counted.withColumnRenamed("__tf", "tfidf")
    idf = IDF(inputCol="__tf", outputCol="__idf").fit(counted).idf
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(np.asarray(idf.toArray()) + 1.0), inputCol="__tf", outputCol="__raw"
    )
    shaped = Normalizer(inputCol="__raw", outputCol="tfidf").transform(weigh.transform(counted))
    return shaped.drop("__tf", "__raw")


def reduced(rows: DataFrame, vector: str, dimensions: int, output: str) -> DataFrame:
    """Truncated SVD without centring: adds ``vector x V`` as an array of ``dimensions`` numbers, fewer if the vocabulary is smaller.

    The vocabulary of an empty table is empty, and so is its output.
    """
    sparse = truncated_svd.cells(rows, vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        words = width(rows, vector)
        if not words:
            return sparse.withColumn(output, F.array().cast("array<double>")).drop("__at", "__by")
        basis, _ = truncated_svd.directions(sparse, words, dimensions)
    finally:
        sparse.unpersist()
    return truncated_svd.projected(truncated_svd.cells(rows, vector), basis, output)


def plane(rows: DataFrame, vector: str) -> DataFrame:
    """Adds ``x`` and ``y``: the first two principal components of an array column, centred."""
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False)
    data = rows.withColumn("__v", array_to_vector(vector))
    data = centred.fit(data).transform(data)
    data = PCA(k=2, inputCol="__c", outputCol="__p").fit(data).transform(data)
    place = vector_to_array("__p")
    return data.withColumns({"x": F.get(place, 0), "y": F.get(place, 1)}).drop("__v", "__c", "__p")


def scaled_embedding(rows: DataFrame, vector: str, output: str) -> DataFrame:
    """Standardised embedding (zero mean, unit deviation per dimension)."""
    data = rows.withColumn("__v", array_to_vector(vector))
    scaler = StandardScaler(inputCol="__v", outputCol=output, withMean=True, withStd=True).fit(data)
    return scaler.transform(data).drop("__v")


def category_vectors(rows: DataFrame, categories: Column, output: str) -> DataFrame:
    """Multi-label indicator vector of a category list; every category has its place."""
    data = rows.withColumn("__cats", categories)
    limit = max(1, data.select(F.explode("__cats")).distinct().count())
    return CountVectorizer(inputCol="__cats", outputCol=output, binary=True, vocabSize=limit).fit(data).transform(data).drop("__cats")


def unit_vectors(rows: DataFrame, unit: str, output: str) -> DataFrame:
    """One-hot vector of a code; a missing code is its own value."""
    data = rows.withColumn("__unit", F.coalesce(F.col(unit), F.lit("UNKNOWN")))
    data = StringIndexer(inputCol="__unit", outputCol="__index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data).transform(data)
    encoder = OneHotEncoder(inputCol="__index", outputCol=output, dropLast=True).fit(data)
    return encoder.transform(data).drop("__unit", "__index")


# Fixed value: categories that get a place, the first in alphabetical order.
MOST_CATEGORIES = 100


def indicators(rows: DataFrame, values: Column, limit: int | None = MOST_CATEGORIES) -> Column:
    """One number per known value in alphabetical order: whether the row has it. Meant for category lists and unit codes."""
    known = rows.select(F.explode(values).alias("v")).where("v is not null").distinct().orderBy("v")
    known = [r["v"] for r in (known.limit(limit) if limit else known).collect()]
    return F.transform(F.array(*map(F.lit, known)), lambda value: F.coalesce(F.array_contains(values, value), F.lit(False)).cast("double"))


def width(rows: DataFrame, column: str) -> int:
    """Length of a vector column: from its metadata where a transformer has noted it, else from a row; zero for no rows."""
    noted = rows.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in noted:
        return noted["num_attrs"]
    first = rows.select(vector_to_array(column).alias("v")).head()
    return len(first.v) if first else 0


def hybrid(rows: DataFrame, blocks: dict[str, float], base: str, output: str = "features") -> DataFrame:
    """Weighted concatenation of vector columns.

    Each block is scaled by ``sqrt(width of base / width of block)`` so blocks of different width have
    comparable length; the base block keeps its scale.
    """
    size = width(rows, base)
    data, parts = rows, []
    for name, weight in blocks.items():
        columns = width(rows, name)
        factor = weight * (1.0 if name == base else math.sqrt(size / max(columns, 1)))
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * columns), inputCol=name, outputCol=f"__{name}"
        )
        data = scale.transform(data)
        parts.append(f"__{name}")
    return VectorAssembler(inputCols=parts, outputCol=output).transform(data).drop(*parts)


def metadata_vectors(awards: DataFrame, output: str = "features") -> DataFrame:
    """Encoded unit and activity, log funding and duration."""
    data = awards.withColumns(
        {
            "__unit": F.coalesce("administering_ic", F.lit("UNKNOWN")),
            "__activity": F.coalesce("activity", F.lit("UNKNOWN")),
            "__funding": F.log10(F.greatest(F.coalesce(F.col("total_lifetime_funding").cast("double"), F.lit(1.0)), F.lit(1.0))),
            "__years": F.coalesce("distinct_fiscal_years", F.lit(1)).cast("double"),
        }
    )
    indexer = StringIndexer(
        inputCols=["__unit", "__activity"], outputCols=["__u", "__a"], stringOrderType="alphabetAsc"
    )
    data = indexer.fit(data).transform(data)
    joined = VectorAssembler(inputCols=["__u", "__a", "__funding", "__years"], outputCol=output).transform(data)
    return joined.drop("__unit", "__activity", "__funding", "__years", "__u", "__a")
