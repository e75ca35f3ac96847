"""Reference models: rule majority, constant, and TF-IDF with balanced logistic regression."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ATTACK, NON_ATTACK
from ..session import materialize, table_as
from .skew import join_hot_aware


def training_set(frame: DataFrame, test: DataFrame, key: str = "key") -> DataFrame:
    """Frame rows whose content does not occur in the test set."""
    return frame.join(test.select(key).distinct(), key, "left_anti")


def fit_rule_majority(train: DataFrame, by: list[str] | None = None, rule: str = "rule_name", label: str = "label") -> DataFrame:
    """(by, rule, n, share, base_rate): share of the positive label per rule beside the share over all rows of the group."""
    by = by or []
    y = (F.col(label) == ATTACK).cast("double")
    per = train.groupBy(*by, rule).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("_a"))
    base = per.groupBy(*by).agg((F.sum("_a") / F.sum("n")).alias("base_rate"))
    joined = per.join(base, by) if by else per.crossJoin(base)  # base: one row
    return joined.select(*by, rule, "n", (F.col("_a") / F.col("n")).alias("share"), "base_rate")


def predict_rule_majority(model: DataFrame, test: DataFrame, by: list[str] | None = None, rule: str = "rule_name") -> DataFrame:
    """test with pred, score, seen. Ties go to the positive label; an unseen rule is negative but scores the base rate.

    The base rate is attached on its own, so test groups whose rules are all unseen still have it. The model has a line a
    rule: AQE broadcasts it while it is small, and beyond that splits the partitions of a rule that holds many test rows.
    """
    by = by or []
    m = model.select(*[F.col(b).alias(f"_m_{b}") for b in by], F.col(rule).alias("_m_rule"), F.col("share").alias("_share"))
    match = F.col(rule).eqNullSafe(F.col("_m_rule"))
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_m_{b}"))
    base = model.groupBy(*by).agg(F.first("base_rate").alias("_base"))
    found = test.join(m, match, "left").drop("_m_rule", *[f"_m_{b}" for b in by])
    found = found.join(base, by, "left") if by else found.crossJoin(base)  # base: one row
    return found.select(
        *test.columns, F.when(F.col("_share") >= 0.5, ATTACK).otherwise(NON_ATTACK).alias("pred"),
        F.coalesce("_share", "_base").alias("score"), F.col("_share").isNotNull().alias("seen"),
    )


def always_attack(test: DataFrame) -> DataFrame:
    return test.withColumn("pred", F.lit(ATTACK))


def with_char_ngrams(df: DataFrame, text: str = "text", low: int = 3, high: int = 5, name: str = "grams") -> DataFrame:
    """Adds all character n-grams of a text after runs of white space are collapsed. Null and short texts give none.

    The text is taken apart into code points first, in a column of its own: a substring by position would walk the text
    from its start, and an expression inside the lambda would be evaluated anew, for every position.
    """
    chars = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s\s+", " "), F.lit("(?s)."), F.lit(0))
    c = F.col("_chars")
    grams = lambda n: F.when(
        F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
    ).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_chars", chars).withColumn(name, F.concat(*[grams(n) for n in range(low, high + 1)])).drop("_chars")


#: Width of the hashed feature space. A fit's blocks of rows cost time in proportion to it, however few features they have.
N_FEATURES = 1 << 16
#: Fits that run side by side: each is a row of small jobs that leave cores idle.
PARALLEL_FITS = 5


def sublinear_counts(df: DataFrame, text: str = "text", n_features: int = N_FEATURES) -> DataFrame:
    """df with _sub in place of the text: 1 + ln(count) of its hashed character 3- to 5-grams, a sparse vector.

    Only JVM steps: the vectors are written as what they consist of, their values are mapped as an array, and they are
    read back as vectors, so no row passes through Python.
    """
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.linalg import VectorUDT

    counted = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=n_features).transform(with_char_ngrams(df, text, name="_grams")).drop("_grams", text)
    spark, keep = df.sparkSession, [f for f in df.schema.fields if f.name != text]
    parts = T.StructType([T.StructField(n, t) for n, t in (("type", T.ByteType()), ("size", T.IntegerType()), ("indices", T.ArrayType(T.IntegerType())), ("values", T.ArrayType(T.DoubleType())))])
    plain = table_as(materialize(counted, "counts"), spark, T.StructType([*keep, T.StructField("_tf", parts)]))
    sub = F.col("_tf").withField("values", F.transform("_tf.values", lambda x: 1 + F.log(x)))
    return table_as(materialize(plain.select(*[f.name for f in keep], sub.alias("_sub")), "sublinear"), spark, T.StructType([*keep, T.StructField("_sub", VectorUDT())]))


def tfidf_logistic(train: DataFrame, test: DataFrame, text: str = "text", label: str = "label", n_features: int = N_FEATURES, max_iter: int = 100) -> DataFrame:
    """test with score and pred from hashed character 3- to 5-grams, sublinear smoothed TF-IDF and balanced logistic regression.

    The intercept is a constant feature, so that it is regularised like the weights; class weights are n / (2 n_class).
    Probabilities follow the same model as a dual coordinate solver's, not its exact path. Both classes must occur in
    train. Tables that have been through sublinear_counts (column _sub) are taken as they are.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, ElementwiseProduct, Normalizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    fitted, asked = (d if "_sub" in d.columns else sublinear_counts(d, text, n_features) for d in (train, test))
    idf = IDF(inputCol="_sub", outputCol="_x").fit(fitted)
    smooth = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_sub", outputCol="_w")
    norm = Normalizer(inputCol="_w", outputCol="_n", p=2.0)
    one = VectorAssembler(inputCols=["_n", "_one"], outputCol="features")
    features = lambda d: one.transform(norm.transform(smooth.transform(d)).withColumn("_one", F.lit(1.0)))
    sizes = {r[0]: r[1] for r in fitted.groupBy(label).count().collect()}
    n = sum(sizes.values())
    y = (F.col(label) == ATTACK).cast("double")
    weight = F.when(F.col(label) == ATTACK, n / (2.0 * sizes[ATTACK])).otherwise(n / (2.0 * sizes[NON_ATTACK]))
    ready = features(fitted).select("features", y.alias("_y"), weight.alias("_weight"))
    lr = LogisticRegression(labelCol="_y", weightCol="_weight", regParam=1.0 / n, standardization=False, fitIntercept=False, maxIter=max_iter)
    model = lr.fit(ready)
    scored = model.transform(features(asked)).withColumn("score", vector_to_array("probability")[1])
    kept = [c for c in test.columns if c in scored.columns and c != "_sub"]
    return scored.select(*kept, "score", F.when(F.col("score") >= 0.5, ATTACK).otherwise(NON_ATTACK).alias("pred"))


def cross_fit_tfidf(rows: DataFrame, fold: str = "fold", text: str = "text", label: str = "label", n_features: int = N_FEATURES, **fit: int) -> DataFrame:
    """All rows, without the text, with score and pred of the TF-IDF model fitted on the other folds; fit goes to tfidf_logistic.

    Texts are counted once for all folds.
    """
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    counted = sublinear_counts(rows, text, n_features)
    one = lambda k: tfidf_logistic(counted.filter(F.col(fold) != k), counted.filter(F.col(fold) == k), text, label, n_features, **fit)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, folds)))


def cross_fit_rule_majority(rows: DataFrame, fold: str = "fold", rule: str = "rule_name", label: str = "label") -> DataFrame:
    """rows with pred, score, seen of the rule model fitted on all other folds.

    The training counts of a fold are the totals less the fold's own, so each rule is counted once however many folds
    there are; rows meet one line per (fold, rule), the rows of a rule that holds many of them apart.
    """
    y = (F.col(label) == ATTACK).cast("long")
    per = rows.withColumn("_r", F.coalesce(rule, F.lit(""))).groupBy("_r", fold).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_a"))
    of_rule = per.groupBy("_r").agg(F.sum("_n").alias("_rn"), F.sum("_a").alias("_ra"))
    of_fold = per.groupBy(fold).agg(F.sum("_n").alias("_fn"), F.sum("_a").alias("_fa"))
    of_all = per.agg(F.sum("_n").alias("_tn"), F.sum("_a").alias("_ta"))
    base = of_fold.crossJoin(F.broadcast(of_all)).select(fold, ((F.col("_ta") - F.col("_fa")) / (F.col("_tn") - F.col("_fn"))).alias("_base"))  # of_all: one row
    rest = F.col("_rn") - F.col("_n")
    model = per.join(of_rule, "_r").join(base, fold).select("_r", fold, "_n", F.when(rest > 0, (F.col("_ra") - F.col("_a")) / rest).alias("_share"), "_base")
    model = materialize(model, "model")
    scored = join_hot_aware(rows.withColumn("_r", F.coalesce(rule, F.lit(""))), model, ["_r", fold], "_n")
    return scored.select(
        *rows.columns, F.when(F.col("_share") >= 0.5, ATTACK).otherwise(NON_ATTACK).alias("pred"), F.coalesce("_share", "_base").alias("score"), F.col("_share").isNotNull().alias("seen")
    )
