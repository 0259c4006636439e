import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelode.llm import digest, token_store
from tracelode.llm.common import bucket_of, id_buckets
from tracelode.llm.tokens import tokenizer_path

BPE = "byte_bpe_50k.json"


def hot(kind):
    """Rows of which most lack an id or share one, with texts of any first bytes."""
    r = random.Random(11)
    text = lambda: "".join(r.choices("abcxyzÄß 一\U0001f600", k=r.randint(0, 30)))
    rows = [(i, text()) for i in range(-20, 60)]
    return rows + {"null": [(None, text()) for _ in range(300)], "same": [(7, text()) for _ in range(300)], "equal": [(None, "one text")] * 200 + [(7, "one text")] * 100, "both": [(None, text()) for _ in range(200)] + [(59, text()) for _ in range(150)]}[kind]


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))


@pytest.mark.parametrize("kind", ["null", "same", "equal", "both"])
def test_buckets_keep_the_order_and_split_hot_ids(spark, kind):
    rows = hot(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cuts = id_buckets(df, 12)
    got = [tuple(r) for r in df.withColumn("b", bucket_of(F.col("doc_id"), F.col("text"), cuts)).collect()]
    by_row = {(i, t): b for i, t, b in got}
    buckets = [by_row[r] for r in ordered(rows)]
    assert buckets == sorted(buckets) and len(cuts) <= 24
    if kind != "equal":
        assert max(buckets.count(b) for b in set(buckets)) <= 4 * len(rows) / 12


@pytest.mark.parametrize("kind", ["null", "same", "equal"])
def test_digests_and_tokens_of_hot_ids(spark, tmp_path, kind):
    rows = hot(kind)
    order = ordered(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = [t for _, t in order]
    want = sorted((str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1]))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in digest.fingerprints(df).collect()) == want
    path = str(tmp_path / "t")
    token_store.write_tokens(df, path, tokenizer_path(BPE), 2)
    library, start, every = Tokenizer.from_file(tokenizer_path(BPE)), 0, []
    for r, (i, t) in zip(token_store.read_documents(spark, path).orderBy("start").collect(), order, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        start, every = start + len(ids), every + ids
    assert [token_store.read_token(spark, path, p) for p in (0, 1, start // 2, start - 1)] == [every[p] for p in (0, 1, start // 2, start - 1)]
    for p in (-1, start):
        with pytest.raises(IndexError):
            token_store.read_token(spark, path, p)
