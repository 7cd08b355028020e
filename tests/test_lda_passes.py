from pyspark.ml.clustering import LDA

from acervo.operators import models as M


def test_every_document_is_drawn_in_every_iteration(spark, monkeypatch):
    """The share drawn per iteration times the iterations: passes over the documents."""
    seen = []
    fit = LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: (seen.append(self.getSubsamplingRate() * self.getMaxIter()), fit(self, df))[1])
    docs = spark.createDataFrame([(i, ["a", "b"]) for i in range(8)], "doc_id int, tokens array<string>")
    M.train_lda(docs, 2, iterations=3)
    assert seen == [3]
