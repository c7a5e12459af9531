"""A trained question classifier beside the decision list, and questions to train it on."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of training questions by class; {a} and {b} are names, {m} a metric, {n} a number. The last one is held out.
FRAMES = {
    "F_Simple": ["What does {a} say about {m}?", "Tell me the {m} of {a}.", "Who runs {a}?", "What is the {m} of {a}?"],
    "F_LogUnion": ["Does {a} rely on {m} or on {b}?", "Which of {a} or {b} mentions {m}?", "Is it {a} or {b} that has {m}?"],
    "F_LogIntersection": ["What do {a} and {b} both have in {m}?", "Which {m} is common to both {a} and {b}?", "Which {m} do both {a} and {b} share?"],
    "F_LogDifference": ["Which {m} has {a} but not {b}?", "What {m} of {a} is there without {b}?", "Which {m} does {a} have but not {b}?"],
    "F_CompMore": ["Compare {a} and {b} on {m}.", "Is {m} higher at {a} versus {b}?", "Compare the {m} of {a} and {b}."],
    "F_CompLess": ["Is {m} lower at {a} versus {b}?", "Compare {a} with {b}: whose {m} is lower?", "Is the {m} of {a} lower versus {b}?"],
    "F_CompApprox": ["Is {m} similar at {a} versus {b}?", "Compare {a} with {b}: is {m} about similar?", "Is the {m} of {a} similar versus {b}?"],
    "F_CompCountMore": ["Has {a} a number of {m} of more than {n}?", "How many more than {n} {m} has {a}?", "Is the number of {m} at {a} more than {n}?"],
    "F_CompCountLess": ["Has {a} a number of {m} of fewer than {n}?", "How many fewer than {n} {m} has {a}?", "Is the number of {m} at {a} fewer than {n}?"],
    "F_CompCountApprox": ["Has {a} a number of {m} of approximately {n}?", "How many, approximately {n}, {m} has {a}?", "Is the number of {m} at {a} approximately {n}?"],
    "F_QuantCount": ["How many {m} has {a}?", "What is the number of {m} at {a}?", "How many {m} are there at {a}?"],
    "F_QuantCountAtmost": ["Is the count of {m} at {a} at most {n}?", "Are there at most {n} in the count of {m} of {a}?", "Is the count of {m} of {a} at most {n}?"],
    "F_QuantCountAtleast": ["Is the count of {m} at {a} at least {n}?", "Are there at least {n} in the count of {m} of {a}?", "Is the count of {m} of {a} at least {n}?"],
    "F_QuantCountEqual": ["Is the count of {m} at {a} exactly {n}?", "Are there exactly {n} in the count of {m} of {a}?", "Is the count of {m} of {a} exactly {n}?"],
    "F_QuantAtmost": ["Is {m} of {a} up to {n} percent?", "Where is {m} at most {n} percent for {a}?", "Is {m} at {a} up to {n} percent?"],
    "F_QuantAtleast": ["Is {m} of {a} at least {n} percent?", "Where is {m} at least {n} percent for {a}?", "Is {m} at {a} at least {n} percent?"],
    "F_QuantApprox": ["Is {m} of {a} roughly {n} percent?", "Where is {m} roughly {n} percent for {a}?", "Is {m} at {a} roughly {n} percent?"],
    "F_QuantEqual": ["Is {m} of {a} exactly {n} percent?", "Where is {m} exactly {n} percent for {a}?", "Is {m} at {a} exactly {n} percent?"],
    "F_QuantMax": ["What is the highest {m} of {a}?", "Which {m} of {a} is the largest?", "What is the largest {m} of {a}?"],
    "F_QuantMin": ["What is the lowest {m} of {a}?", "Which {m} of {a} is the smallest?", "What is the smallest {m} of {a}?"],
    "F_GlobalRank": ["Across all banks, which bank reports the highest {m}?", "Across all listed names, which company reports the lowest {m}?", "Across all banks, which bank reports the lowest {m}?"],
    "F_GroupAggregate": ["Which segment has the highest average {m}?", "Which segment has the lowest average {m}?", "Which segment has on average the highest {m}?"],
    "F_CompToGroupAverage": ["How is {m} of {a} against the segment average?", "Is {m} at {a} above the peer average?", "Is {m} of {a} above the segment average?"],
    "F_QuantCountApprox": ["Is the count of {m} at {a} close to {n}?", "Are there close to {n} in the count of {m} of {a}?", "Is the count of {m} of {a} close to {n}?"],
}


def split(rows: DataFrame, key: str, share: float, seed: int = 13) -> DataFrame:
    """rows with training, true for about `share` of them: each by the digest of seed and key, so a row's side depends on
    nothing else, whatever its label, its place and the number of tasks. Equal keys stay together."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("training", F.coalesce(place < int(share * (1 << 32)), F.lit(False)))


def questions(spark: SparkSession, each: int, names: list[str], metrics: list[str], seed: int = 13, held_out: bool = False) -> DataFrame:
    """(text, label): `each` questions a class. Held-out questions use a frame of each class that training never sees."""
    rng, rows = random.Random(seed), []
    for label, frames in FRAMES.items():
        for _ in range(each):
            a, b = rng.sample(names, 2)
            rows.append((rng.choice(frames[-1:] if held_out else frames[:-1]).format(a=a, b=b, m=rng.choice(metrics), n=rng.randint(2, 90)), label))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "text string, label string")


def train(rows: DataFrame) -> PipelineModel:
    """Linear one-against-rest classifiers over words and pairs of words."""
    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\w+", gaps=False), NGram(inputCol="words", outputCol="pairs", n=2),
        CountVectorizer(inputCol="words", outputCol="v1", minDF=2.0), CountVectorizer(inputCol="pairs", outputCol="v2", minDF=2.0), VectorAssembler(inputCols=["v1", "v2"], outputCol="features"),
        OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), labelCol="y", featuresCol="features"),
    ]
    return Pipeline(stages=stages).fit(rows)


def classify(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with predicted, the label's name."""
    names = model.stages[0].labels
    stages = PipelineModel(model.stages[1:])
    return stages.transform(rows).withColumn("predicted", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))).drop("words", "pairs", "v1", "v2", "features", "prediction", "rawPrediction")


def report(classified: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """For each label its rows and hits, precision, recall and their harmonic mean; labels that are only predicted too."""
    truth = classified.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == F.col(predicted)).alias("hits"))
    said = classified.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("said"))
    both = truth.join(said, "label", "full").na.fill(0, ["rows", "hits", "said"]).filter("label IS NOT NULL")
    share = lambda b: F.when(F.col(b) > 0, F.round(F.col("hits") / F.col(b), 4))
    f1 = F.when(F.col("rows") + F.col("said") > 0, F.round(2 * F.col("hits") / (F.col("rows") + F.col("said")), 4))
    return both.select("label", "rows", "hits", share("said").alias("precision"), share("rows").alias("recall"), f1.alias("f1"))


def accuracy(classified: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return classified.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col(label) == F.col(predicted)).cast("double")), 4).alias("accuracy"))
