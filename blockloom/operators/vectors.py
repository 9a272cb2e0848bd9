"""Text and structured feature vectors: term vocabulary, tf-idf, ML stages.

The vocabulary is the only thing a corpus pass shuffles: term counts, combined
before the shuffle. With it (500 terms) fixed, a document's weights depend on
its own row and the document frequencies only, so weighting shuffles nothing.
"""

from __future__ import annotations

from math import log

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import WORD
from blockloom.operators.features import STRUCTURED
from blockloom.session import stored

# Text vectoriser defaults.
MAX_TERMS = 500
MAX_TAGS = 1000  # tags with a place of their own
BROADCAST_WORDS = 100_000  # that pairs of words are looked up in without a shuffle
TOKEN_PATTERN = WORD + "{2,}+"

_GRAMS_SQL = (
    "concat({tokens}, zip_with("
    "slice({tokens}, 1, greatest(size({tokens}) - 1, 0)),"
    " slice({tokens}, 2, greatest(size({tokens}) - 1, 0)),"
    " (a, b) -> concat(a, ' ', b)))"
)


def tokens(text: Column) -> Column:
    """Lowercased words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def with_grams(df: DataFrame, text: str, out: str = "grams") -> DataFrame:
    """Add the words and pairs of neighbouring words of a text."""
    return df.withColumn("__tokens", tokens(F.col(text))).withColumn(
        out, F.expr(_GRAMS_SQL.format(tokens="__tokens"))
    ).drop("__tokens")


def _count_terms(terms: DataFrame) -> DataFrame:
    """(term, tf) of the arrays in terms.

    explode() would have the optimizer filter on the array's size first, and so
    compute the array a second time; the outer form with a null check does not.
    """
    rows = terms.select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.count("*").alias("tf"))


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, tf) of all words and pairs of the corpus."""
    return _count_terms(with_grams(df.select(text), text, "terms").select("terms"))


def tfidf_vocab(df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """The max_terms most frequent words and pairs; equal counts are taken in term order.

    A pair is no more frequent than either of its words, so only words at least
    as frequent as the last of the max_terms best words can form a pair that gets
    in. Pairs are joined with these words before they are counted: nearly all pairs
    of a large corpus are rare, and counting all would move most of it. Some BROADCAST_WORDS
    words go to all tasks, as Spark could not know how few they are before it has shuffled the
    pairs for a join; more than that (when a great many are equally frequent) are
    Spark's choice. Counting the words is a job that runs at once.
    """
    top = (F.desc("tf"), F.asc("term"))
    split = df.select(tokens(F.col(text)).alias("terms"))
    words = stored(_count_terms(split))
    best = words.orderBy(*top).limit(max_terms)
    least = best.agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    floor = least["tf"] if least["n"] == max_terms else 0
    frequent = words.where(F.col("tf") >= floor).select("term")
    if frequent.count() <= BROADCAST_WORDS:
        frequent = F.broadcast(frequent)
    count = F.greatest(F.size("terms") - 1, F.lit(0))
    neighbours = F.zip_with(
        F.slice("terms", F.lit(1), count), F.slice("terms", F.lit(2), count), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    pairs = split.select(F.explode_outer(neighbours).alias("p")).where(F.col("p").isNotNull()).select("p.a", "p.b")
    for side in ("a", "b"):
        pairs = pairs.join(frequent.withColumnRenamed("term", side), side, "left_semi")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("tf"))
    counted = counted.select(F.concat("a", F.lit(" "), "b").alias("term"), "tf")
    return best.unionByName(counted).orderBy(*top).limit(max_terms)


def fit_counts(df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS) -> list[Transformer]:
    """Stages from a text to its term counts; at most max_terms strings come to the driver."""
    vocabulary = [r["term"] for r in tfidf_vocab(df, text, max_terms).collect()]
    if not vocabulary:
        raise ValueError("no terms in the corpus")
    pattern = TOKEN_PATTERN.replace("\\", "\\\\")
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '{pattern}', 0)"
    grams = SQLTransformer(
        statement=f"SELECT *, {_GRAMS_SQL.format(tokens='__tokens')} AS __grams"
        f" FROM (SELECT *, {words} AS __tokens FROM __THIS__)"
    )
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__grams", outputCol="__counts")
    return [grams, counter]


def fit_idf(counted: DataFrame, out: str = "tfidf") -> list[Transformer]:
    """Stages from term counts to weights of length 1: ln((1 + n) / (1 + df)) + 1 times the count."""
    row = counted.select(
        F.count("*").alias("n"), Summarizer.numNonZeros(F.col("__counts")).alias("df")
    ).first()
    idf = [log((1 + row["n"]) / (1 + d)) + 1 for d in row["df"]]
    return [
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__counts", outputCol="__weighted"),
        Normalizer(p=2.0, inputCol="__weighted", outputCol=out),
    ]


def fit_text(
    df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS, out: str = "tfidf"
) -> list[Transformer]:
    """Fitted tf-idf stages over words and pairs of words."""
    counting = fit_counts(df, text, max_terms)
    return [*counting, *fit_idf(PipelineModel(counting).transform(df.select(text)), out)]


def tfidf_weights(
    df: DataFrame, keys: list[str], text: str = "text", max_terms: int = MAX_TERMS
) -> DataFrame:
    """Long form (keys..., term, weight) of every non-zero weight.

    Splitting texts is the costly part, so the counts are stored: document
    frequencies and weights are read off them.
    """
    counting = fit_counts(df, text, max_terms)
    counted = stored(PipelineModel(counting).transform(df.select(*keys, text)).select(*keys, "__counts"))
    vectors = PipelineModel(fit_idf(counted)).transform(counted)
    rows = vector_entries(vectors, keys, "tfidf", counting[1].vocabulary)
    return rows.withColumnsRenamed({"key": "term", "value": "weight"})


def fit_structured(df: DataFrame, out: str = "structured", max_tags: int = MAX_TAGS) -> PipelineModel:
    """Stages for tag, parent tag and numbers.

    Every tag of df has a place of its own; a tag that df does not hold has none, and is all zeros. Tag names
    of wild pages have no bound, so only the max_tags most frequent have places, and come to the driver.
    """
    numeric = _numbers()
    top = df.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("n"))
    tags = sorted(r["tag"] for r in top.orderBy(F.desc("n"), "tag").limit(max_tags).collect())
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS __{c}" for c in numeric)
    # The indexer puts what it does not know behind the last tag; that place is the one the encoder leaves out.
    index = StringIndexerModel.from_labels(tags or [""], "tag", "__tag_index", "keep")
    return Pipeline(
        stages=[
            SQLTransformer(
                statement=(
                    f"SELECT *, {doubles}, "
                    "CAST(parent_tag = 'None' AS DOUBLE) AS __parent_tag FROM __THIS__"
                )
            ),
            index,
            OneHotEncoder(inputCols=["__tag_index"], outputCols=["__tag"], dropLast=True),
            VectorAssembler(
                inputCols=["__tag", "__parent_tag", *[f"__{c}" for c in numeric]], outputCol=out
            ),
        ]
    ).fit(df)


def _numbers() -> list[str]:
    return [c for c in STRUCTURED if c not in ("tag", "parent_tag")]


def structured_names(model: PipelineModel) -> list[str]:
    """What the places of fit_structured's vectors stand for."""
    tags = model.stages[1].labels
    return [*[f"tag={t}" for t in tags], "parent_tag=None", *_numbers()]


def entries(vector: Column, names: list[str]) -> Column:
    """The entries of a vector that are not zero, as structs (key, value); a sparse vector is not filled up."""
    plain = F.unwrap_udt(vector)
    places = F.coalesce(plain["indices"], F.sequence(F.lit(0), F.size(plain["values"]) - 1))
    every = F.zip_with(
        places, plain["values"], lambda i, v: F.struct(F.element_at(F.lit(names), i + 1).alias("key"), v.alias("value"))
    )
    return F.filter(every, lambda e: e["value"] != 0)


def vector_entries(df: DataFrame, keys: list[str], vector: str, names: list[str]) -> DataFrame:
    """Long form (keys..., key, value) of the entries of a vector that are not zero."""
    return df.select(*keys, F.inline(entries(F.col(vector), names)))


def fit_vectors(df: DataFrame, text: str = "raw", max_terms: int = MAX_TERMS, out: str = "features") -> list[Transformer]:
    """Fitted stages from feature rows to one vector: structured and text side by side."""
    union = VectorAssembler(inputCols=["structured", "tfidf"], outputCol=out)
    return [fit_structured(df), *fit_text(df, text, max_terms), union]
