"""The corpus pipeline stage by stage, and its result as a whole."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from symgrid.llm import contain, secrets
from symgrid.llm.common import table
from tests.llm.test_operators import ODD, SCHEMA


def test_stages(spark, tmp_path):
    data = "/root/testdata/sf0.01"
    docs = table(spark, data, "documents")
    kept = [docs]
    for name, stage in P.STAGES:
        stage(spark, kept[-1], data).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert len(P.STAGES) == 5 and all(d.columns == docs.columns for d in kept[1:5])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] > ids[1] > ids[2] > ids[3] == ids[4] == ids[5]
    quality = {r["doc_id"] for r in table(spark, data, "labels").where("quality = 1").collect()}
    assert len(quality & ids[1]) > 0.9 * len(quality & ids[0])
    texts = [r["text"] for r in kept[2].collect()]
    assert len(set(texts)) == len(texts)
    assert contain.contained_items(kept[3], table(spark, data, "benchmark")).count() == 0
    assert secrets.secret_spans(kept[4]).where("size(base) > 0").count() == 0
    again = P.run(spark, data)
    assert again.agg(F.sum("length")).first() == kept[5].agg(F.sum("length")).first() and again.count() == kept[5].count()


def test_odd_rows_pass_every_stage(spark, data):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert set(Counter(r["doc_id"] for r in out.collect())) <= {r[0] for r in ODD}
        assert stage(spark, docs.limit(0), data).count() == 0, name
    assert P.best_fit_packing(spark, docs.limit(0), data).count() == 0
