"""Train, select, store and apply the mail classifier with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer,
    StopWordsRemover, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.functions import explain, fixed_values as fv, text
from lurewatch.operators import mail
from lurewatch.operators.prefix import running_sum
from lurewatch.session import use_checkpoints


def model_columns(featurized: DataFrame) -> DataFrame:
    """Spread the hand features the model reads; the ones never computed are 0, as is null."""
    known = set(text.FEATURE_FIELDS)
    pick = [(F.coalesce(F.col(f"f.{n}"), F.lit(0)) if n in known else F.lit(0)).cast("double")
            .alias(n) for n in fv.MODEL_FEATURES]
    return featurized.select("*", *pick)


def term_stages(stop_words: list[str] | None = None) -> list:
    """Words without stop words, and their pairs, in ``_terms``."""
    words = RegexTokenizer(inputCol="processed", outputCol="_words", pattern=r"(?U)\b\w\w+\b",
                           gaps=False)
    kept = StopWordsRemover(inputCol="_words", outputCol="_kept")
    if stop_words is not None:
        kept = kept.setStopWords(stop_words)
    return [words, kept, NGram(n=2, inputCol="_kept", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__")]


def term_weights(df: DataFrame, min_df: float = fv.TFIDF["min_df"], max_df: float = fv.TFIDF["max_df"],
                 stop_words: list[str] | None = None) -> DataFrame:
    """(term, weight) of all terms inside the document-count limits, as a table of any size."""
    listed = PipelineModel(term_stages(stop_words)).transform(df)
    total = df.agg(F.count("*").alias("n"))  # one row
    counts = listed.select(F.explode(F.array_distinct("_terms")).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    limit = lambda x: F.lit(x) if x >= 1 else x * F.col("n")
    return counts.join(F.broadcast(total)).where(
        (F.col("df") >= limit(min_df)) & (F.col("df") <= limit(max_df))).select(
        "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("weight"))


COMMON_WORDS = 200_000


def term_counts(listed: DataFrame, common: pa.Array | None = None, pairs: bool = False) -> DataFrame:
    """(term, tf, df) of the words of ``_kept`` or of their pairs, where ``common`` is given only of pairs
    of its words. A batch of mails is counted in its task, so a shuffled row stands for a whole batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = pc.list_parent_indices(batch.column(0)).to_numpy()
            coded = batch.column(0).flatten().dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            if pairs:
                keep = doc[1:] == doc[:-1]
                if common is not None:
                    known = pc.is_in(terms, value_set=common).to_numpy(zero_copy_only=False)[code]
                    keep &= known[1:] & known[:-1]
                doc, n = doc[1:][keep], max(1, len(terms))
                both, code = np.unique(code[:-1][keep] * n + code[1:][keep], return_inverse=True)
                terms = pc.binary_join_element_wise(terms.take(pa.array(both // n)), terms.take(pa.array(both % n)), " ")
            n = len(terms)
            once = np.unique(doc * n + code) % max(1, n)
            yield pa.RecordBatch.from_arrays(
                [terms, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(once, minlength=n))],
                names=["term", "tf", "df"])

    return listed.select("_kept").mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def top_counts(listed: DataFrame, max_terms: int, min_df: float, max_df: float) -> tuple[list[Row], int]:
    """The ``max_terms`` most frequent words and pairs (term, tf, df) inside the document-count limits,
    ties by term, and the number of documents.

    A pair is no more frequent than either of its words. So the words are counted first, and then only
    pairs of words that reach the last place of the words' own cut; others cannot be among the terms. The
    cut is made in Spark; the driver gets the vocabulary that the model holds anyway.
    """
    total = listed.agg(F.count("*").alias("n")).first().n
    limit = lambda x: x if x >= 1 else x * total
    inside = (F.col("df") >= limit(min_df)) & (F.col("df") <= limit(max_df))
    cut = lambda counts: counts.where(inside).orderBy(F.desc("tf"), "term").limit(max_terms)
    words = term_counts(listed).where(F.col("df") >= limit(min_df)).persist()
    first = cut(words).collect()
    least = first[-1].tf if len(first) == max_terms else 0
    # Where very many words tie, all pairs are counted.
    common = [r.term for r in words.where(F.col("tf") >= least).select("term").limit(COMMON_WORDS + 1).collect()]
    known = pa.array(common, pa.string()) if len(common) <= COMMON_WORDS else None
    best = cut(cut(term_counts(listed, known, pairs=True)).unionByName(cut(words))).collect()
    words.unpersist()
    return best, total


def top_terms(listed: DataFrame, max_terms: int, min_df: float, max_df: float) -> list[str]:
    return [r.term for r in top_counts(listed, max_terms, min_df, max_df)[0]]


def fit_terms(listed: DataFrame, max_terms: int = fv.TFIDF["max_terms"], min_df: float = fv.TFIDF["min_df"],
              max_df: float = fv.TFIDF["max_df"]) -> list[Transformer]:
    """The fitted stages from ``_terms`` to ``tfidf``. The counts that choose a term also give its weight."""
    best, total = top_counts(listed, max_terms, min_df, max_df)
    counted = CountVectorizerModel.from_vocabulary([r.term for r in best], inputCol="_terms", outputCol="_tf")
    raised = ElementwiseProduct(scalingVec=DenseVector([math.log((total + 1.0) / (r.df + 1.0)) + 1.0 for r in best]),
                                inputCol="_tf", outputCol="_weights")
    return [counted, raised, Normalizer(p=2.0, inputCol="_weights", outputCol="tfidf")]


def fit_text(df: DataFrame, max_terms: int = fv.TFIDF["max_terms"],
             min_df: float = fv.TFIDF["min_df"], max_df: float = fv.TFIDF["max_df"],
             stop_words: list[str] | None = None) -> PipelineModel:
    """1-2-gram TF-IDF at unit length, with weight ``tf * (ln((1+n)/(1+df)) + 1)``."""
    stages = term_stages(stop_words)
    return PipelineModel([*stages, *fit_terms(PipelineModel(stages).transform(df), max_terms, min_df, max_df)])


def vocabulary(text_model: PipelineModel) -> list[str]:
    return text_model.stages[4].vocabulary


def with_idf(text_model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(term, weight) of the fitted vocabulary, at most ``max_terms`` rows."""
    weights = text_model.stages[5].getScalingVec().toArray().tolist()
    return spark.createDataFrame(list(zip(vocabulary(text_model), weights)),
                                 "term string, weight double")


def assembler() -> VectorAssembler:
    """Terms and hand features in one vector; it stays sparse."""
    return VectorAssembler(inputCols=["tfidf", *fv.MODEL_FEATURES], outputCol="features",
                           handleInvalid="keep")


def class_weights(df: DataFrame, label: str = "class") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    classes = Window.partitionBy()  # one row per class
    return counts.select(label, "n", (
        F.sum("n").over(classes) / (F.count("*").over(classes) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "class") -> DataFrame:
    """Attach the class weight; the table broadcast has one row per class."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def stratified_rank(df: DataFrame, label: str = "class", row_id: str = "id", seed: int = 42) -> DataFrame:
    """Add ``rank`` within the class in a seeded random order, and ``class_rows``.

    Ranks come from 4096 hash ranges per class, so a class is never sorted by one task.
    """
    key = F.md5(F.concat_ws("-", F.col(row_id).cast("string"), F.lit(str(seed))).cast("binary"))
    hashed = df.filter(F.col(label).isNotNull()).withColumn("_hash", key)
    slot = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")
    ranked = running_sum(hashed, [label], slot, [F.col("_hash"), F.col(row_id)],
                         {"rank": F.lit(1).cast("bigint")})
    sizes = df.groupBy(label).agg(F.count("*").alias("class_rows"))
    return ranked.join(F.broadcast(sizes), label).drop("_hash")


def stratified_split(df: DataFrame, label: str = "class", row_id: str = "id",
                     train: float = 0.8, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``is_train`` (exact share per class) and ``fold``."""
    ranked = stratified_rank(df, label, row_id, seed)
    return ranked.withColumn("is_train", F.col("rank") <= F.floor(F.col("class_rows") * train)) \
        .withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "class_rows")


def forest(**settings) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="class", weightCol="weight",
                                  **{**fv.FOREST, **settings})


def boosted(**settings) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="class", checkpointInterval=10,
                         **{**fv.BOOSTED, **settings})


def linear_svc(**settings) -> LinearSVC:
    return LinearSVC(featuresCol="features", labelCol="class", weightCol="weight", **settings)


def weighted_f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="class", metricName="f1")


ROWS_PER_TASK = 4000


def packed(df: DataFrame, row_id: str = "id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows in as many partitions as they need, in order of their id inside each.

    A tree learner sends the statistics of every node from every partition in each of its many short
    jobs, so partitions without work cost more than the rows.
    """
    parts = max(1, -(-df.count() // rows_per_task))
    return df.repartition(parts, row_id).sortWithinPartitions(row_id)


def select_model(train: DataFrame, candidates: list, folds: int = 5,
                 parallelism: int = 5) -> CrossValidatorModel:
    """Cross-validate every candidate on the fold column; the best mean is refitted on all rows.

    A fit is a chain of short jobs, so fits of different folds run side by side.
    """
    use_checkpoints(train.sparkSession)
    judge = weighted_f1()

    def fold_score(task: tuple[int, int]) -> float:
        at, fold = task
        rest = packed(train.filter(F.col("fold") != fold))
        return judge.evaluate(candidates[at].fit(rest).copy().transform(train.filter(F.col("fold") == fold)))

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(fold_score, product(range(len(candidates)), range(folds))))
    per_fold = np.array(scores).reshape(len(candidates), folds)
    means = per_fold.mean(axis=1)
    best = Pipeline(stages=[candidates[int(means.argmax())]]).fit(train)
    return CrossValidatorModel(best, avgMetrics=means.tolist(), stdMetrics=per_fold.std(axis=1).tolist())


def cv_scores(selected: CrossValidatorModel, names: list[str], spark: SparkSession) -> DataFrame:
    rows = [(n, float(m), float(2 * s))
            for n, m, s in zip(names, selected.avgMetrics, selected.stdMetrics)]
    return spark.createDataFrame(rows, "model string, mean_f1 double, two_std double")


def feature_importance(classifier, names: list[str], spark: SparkSession, k: int = 20) -> DataFrame:
    """Top features of a fitted tree model; the table has one row per vector slot."""
    weights = classifier.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, weights)), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature").limit(k)


def feature_names(text_model: PipelineModel) -> list[str]:
    return [*vocabulary(text_model), *fv.MODEL_FEATURES]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(mails: DataFrame, model: PipelineModel, source: str = "file_upload") -> DataFrame:
    """Score a batch of mails (id, body, html, subject, sender).

    ``confidence`` is always P(phishing). Service mails are forced to safe with 0.1; mails without a
    body get the whole error record: its explanation and badge, no features, links or heads.
    """
    filled = mails.withColumn("problem", explain.error_record(F.col("body")))
    base = mail.featurize(mail.with_links(filled))
    scored = model.transform(model_columns(base))
    service = text.service_email(F.col("body"), F.col("sender"))
    p = vector_to_array("probability")[1]
    staged = scored.withColumn("is_service_email", service).withColumn(
        "confidence", F.when(F.col("problem").isNotNull(), F.lit(0.0))
        .when(F.col("is_service_email"), F.lit(0.1)).otherwise(p)).withColumn(
        "is_phishing", F.col("problem").isNull() & ~F.col("is_service_email")
        & (F.col("prediction") == 1.0))
    told = staged.withColumns({
        "explanation": explain.explain_model(F.col("f"), F.col("confidence"), F.col("is_service_email")),
        "badge": explain.summary(F.col("is_phishing"), F.col("confidence")),
        "quick_indicators": explain.quick_indicators(F.col("f"))})
    empty = F.col("problem").isNotNull()
    blank = {c: F.when(empty, F.lit("")).otherwise(F.col(c)) for c in ("subject", "sender", "body", "html")
             if c in mails.columns}
    return told.withColumns({
        "explanation": _or_record(told, "explanation", empty), "badge": _or_record(told, "badge", empty),
        "quick_indicators": _or_record(told, "quick_indicators", empty, F.lit(False)),
        "f": F.when(~empty, F.col("f")),
        "links": F.when(empty, F.array().cast(told.schema["links"].dataType)).otherwise(F.col("links")),
        **blank}).select(
        *[c for c in mails.columns], "is_phishing", "confidence", "is_service_email", "f", "links",
        "explanation", "badge", "quick_indicators", "problem", F.lit(source).alias("source"))


def _or_record(told: DataFrame, column: str, empty: Column, other: Column | None = None) -> Column:
    """A struct, or for empty mails the fields of the error record, ``other`` where it has none."""
    kind, record = told.schema[column].dataType, told.schema["problem"].dataType.names
    rest = F.lit(None) if other is None else other
    return F.when(~empty, F.col(column)).otherwise(F.struct(*[
        (F.col("problem")[n] if n in record else rest.cast(kind[n].dataType)).alias(n) for n in kind.names]))
