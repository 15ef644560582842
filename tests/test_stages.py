"""Stages of ML pipelines, batch scores, jobs at once."""

import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from steadfast.operators import detect, features, stages
from steadfast.operators.support import concurrently, job


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"r{i}", f"please verify account {i % 3}" if i % 4 == 0 else f"lunch notes {i % 7} http://x.test/{i}", i % 2 == 0, int(i % 4 == 0), 1.0) for i in range(80)]
    return spark.createDataFrame(rows, "row_id string, text string, had_html boolean, label int, weight double").persist()


@pytest.mark.parametrize("last", [lambda: stages.Forest(trees=4), lambda: LogisticRegression(maxIter=20, weightCol="weight")])
@pytest.mark.parametrize("masked", [False, True])
def test_pipelines_come_back_as_they_were(spark, corpus, tmp_path, last, masked):
    last = last()
    fitted = Pipeline(stages=[stages.TextFeaturizer(maxTerms=40, masked=masked), last]).fit(corpus)
    fitted.save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    assert loaded.stages[0].featurizer.masked is masked and loaded.stages[0].getOrDefault("maxTerms") == 40
    column = "score" if isinstance(last, stages.Forest) else "probability"
    a, b = ({r["row_id"]: r[column] for r in m.transform(corpus).collect()} for m in (fitted, loaded))
    assert a == b and len(a) == 80
    terms = {r["term"] for r in loaded.stages[0].featurizer.vocab.collect()}
    assert ("http" in terms) is not masked


def test_entries_of_vectors(spark):
    vectors = [Vectors.sparse(5, [1, 4], [0.5, -2.0]), Vectors.dense([1.0, 0.0]), Vectors.sparse(3, [], [])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["i", "v"])
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in df.select("i", features.entries(F.col("v")).alias("e")).collect()}
    assert got == {0: [(1, 0.5), (4, -2.0)], 1: [(0, 1.0), (1, 0.0)], 2: []}


def test_batch_scores(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], f"t{i}") for i in range(50)], "id int, x array<double>, text string").repartition(3)

    def load():
        def predict(x, text):
            assert x.ndim == 2 and len(x) <= 7
            return x.sum(axis=1) + np.array([len(t) for t in text])

        return predict

    got = detect.batch_scores(df, ["x", "text"], load, batch_size=7).collect()
    assert {r["id"]: r["score"] for r in got} == {i: i + 1.0 + len(f"t{i}") for i in range(50)}


def test_jobs_at_once(spark):
    spark.sparkContext.setLocalProperty("steadfast.test", "inherited")
    meeting = threading.Barrier(3, timeout=60)

    def work(i):
        meeting.wait()  # only if all three run at once
        return spark.sparkContext.getLocalProperty("steadfast.test"), spark.range(i).count()

    assert concurrently({i: job(work, i) for i in (1, 2, 3)}) == {i: ("inherited", i) for i in (1, 2, 3)}
    assert concurrently({}) == {}

    def fails():
        raise KeyError("this one")

    with pytest.raises(KeyError):
        concurrently({"a": fails, "b": lambda: 1})
