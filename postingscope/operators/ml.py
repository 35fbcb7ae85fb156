"""Model training and inference as Spark ML jobs (ML2, ML3, ML5).

The transformer classifier and sentence-embedding model of the original
application are replaced by Spark ML pipelines: tokenise -> hashed term
frequencies -> IDF -> logistic regression (ML2/ML3), and hashed word +
bigram TF-IDF vectors, L2-normalised, as embeddings (ML5).  Both train and
score distributed; a fitted PipelineModel is loaded once per job.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.functions.features import clamp01r4, rule_probability

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
MODEL_TEXT = "_model_text"


def train(df: DataFrame, text: str = "description", label: str = "manually_verified_label",
          num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """ML2: fit a text classifier on verified labels; both columns are required."""
    missing = [c for c in (text, label) if c not in df.columns]
    if missing:
        raise ValueError(f"training data lacks columns: {missing}")
    data = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()) \
             .withColumn("_label", F.col(label).cast("double")).withColumn(MODEL_TEXT, F.col(text))
    pipe = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, lower({MODEL_TEXT}) AS _lt FROM __THIS__"),
        RegexTokenizer(inputCol="_lt", outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_feat"),
        LogisticRegression(featuresCol="_feat", labelCol="_label", maxIter=max_iter, regParam=reg),
    ])
    return pipe.fit(data)


def predict(df: DataFrame, model: PipelineModel | str | None = None, text: str = "_text",
            out: str = "bert_score") -> DataFrame:
    """ML3: probability of the positive class, clamped and rounded to 4;
    without a model the rule probability (FEAT5) is used."""
    if model is None:
        return df.withColumn(out, rule_probability("genericness_score", "vagueness_score",
                                                    "repost_score", "urgency_score", text))
    if isinstance(model, str):
        model = PipelineModel.load(model)
    cols = [c for c in df.columns if c != out]
    scored = model.transform(df.withColumn(MODEL_TEXT, F.col(text)))
    prob = vector_to_array(F.col("probability"))[1]
    blank = F.col(text).isNull() | (F.length(F.trim(F.col(text))) == 0)
    return scored.select(*cols, F.when(blank, F.lit(0.0)).otherwise(clamp01r4(prob)).alias(out))


def embed(df: DataFrame, text: str = "description", out: str = "embedding", dims: int = 1 << 12) -> DataFrame:
    """ML5: hashed word + bigram TF-IDF vectors, L2-normalised, as array<double>."""
    pipe = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, lower(coalesce({text}, '')) AS _lt FROM __THIS__"),
        RegexTokenizer(inputCol="_lt", outputCol="_w", pattern=TOKEN_PATTERN, gaps=False),
        NGram(n=2, inputCol="_w", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_w, _bi) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ])
    m = pipe.fit(df)
    res = m.transform(df)
    return res.select(*df.columns, vector_to_array("_vec").alias(out))
