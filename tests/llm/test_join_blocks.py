import random

from tracelode.llm import ngram_join


def test_blocks_bounded_by_shingles_give_the_same_classes(spark, monkeypatch):
    """A family of near copies of a long text, in one block and, by a bound of a few texts' shingles, in many."""
    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(600)]
    texts = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 600, 15)] + [(900 + k, " ".join(r.choices(base, k=80))) for k in range(5)] + [(990, None), (991, " ".join(base))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    told = lambda: sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.classes(df).collect())
    one = told()
    assert [x[2] for x in one if x[0] < 600 or x[0] == 991] == [40] * 41
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    assert told() == one
