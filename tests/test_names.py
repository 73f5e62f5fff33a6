"""Names in texts against plain search."""

import random
import time

from pyspark.sql import functions as F

from verdictlake.operators import names


def test_occurring(spark):
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abé ") for _ in range(k))
    listed = [word(r.randint(1, 4)) for _ in range(60)] + ["aa", "aaa", "", None]
    texts = [(k, word(r.randint(0, 200))) for k in range(50)] + [(90, None), (91, ""), (92, "aaaaa"), (92, "aaaaa"), (None, "aa")]
    want = sorted((i, n, c) for i, t in texts if t for n in {n for n in listed if n} if (c := sum(t.startswith(n, k) for k in range(len(t)))) if i is not None)
    df, ns = spark.createDataFrame(texts, "doc_id int, text string").repartition(3), spark.createDataFrame([(n,) for n in listed], "name string")
    for size in (1 << 20, 30):
        out = names.occurring(df, ns, "doc_id", "text", block_bytes=size)
        assert sorted(tuple(x) for x in out.where("doc_id is not null").collect()) == want and out.where("doc_id is null").count() > 0
    assert names.occurring(df, ns.where("1 = 0"), "doc_id", "text").count() == 0 and names.occurring(df.where("1 = 0"), ns, "doc_id", "text").count() == 0


def test_many_names_take_linear_time(spark):
    ns = spark.range(100_000).select(F.concat(F.lit("name "), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    text = spark.range(200).select("id", F.concat(F.repeat(F.lit("some other words of a text, "), 2000), F.lit("name "), F.sha2((F.col("id") * 7).cast("string"), 256)).alias("text"))
    began = time.time()
    assert names.occurring(text, ns, "id", "text").count() == 200 and time.time() - began < 60
