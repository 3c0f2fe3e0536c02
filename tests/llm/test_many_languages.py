"""Every label is learned, however many there are."""

from bankrec.llm import language_id


def test_each_language_is_learned(spark, monkeypatch):
    sizes = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda windows, *rest: sizes.append(len(windows)) or train(windows, *rest))
    docs = spark.range(230 * 4).selectExpr("id as doc_id", "concat('l', id % 230) as lang", "concat('text ', id, ' of ', id % 230) as text")
    docs = docs.where("lang <> 'l7' or doc_id < 230")      # rarer than 200 others
    net = language_id.learn(docs)
    assert net.labels == sorted(f"l{k}" for k in range(230)) and net.out.shape[1] == 230
    for total in (500, 100):
        assert language_id.learn(docs, total_texts=total).labels == net.labels
    assert sizes == [4 * 229 + 1, 2 * 229 + 1, 230]
