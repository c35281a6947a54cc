"""The pipeline keeps one of each group of copies, drops leaks and letterless texts, and encodes what stays."""

import corpus_pipeline
from tidemark.llm.shared import cut


def test_stages(spark, tmp_path):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    item = "a leaked benchmark item of some words that is long enough to be found anywhere in a text"
    text = "some line of clean words number {} that nobody else has written so far\nand a second one with other words {} too"
    odd = [(9001, "123 456 !!", "en"), (9002, None, "en"), (9003, f"before it {item} after it", "en")]
    odd += [(9010 + i, " ".join(f"copy{j}" for j in range(60)) + (" end" if i else ""), "en") for i in range(3)]
    odd += [(9100 + i, text.format(f"a{i}" * 3, f"b{i}" * 2), "en") for i in range(3)]
    clean = ["the ferry left the northern harbour long before the storm had reached its peak", "seven engineers measured how quickly copper wires corrode under salty water", "my grandmother keeps her old recipes inside a blue tin above the kitchen stove"]
    odd += [(9200 + i, t, "en") for i, t in enumerate(clean)]
    extra = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in odd], small.schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    small.unionByName(extra).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not ids & {9001, 9002, 9003} and len(ids & {9010, 9011, 9012}) == 1
    assert ids & set(range(9100, 9103)) == {9100}  # lines that differ in one short word have an edit similarity of over 0.9: one of them stays
    assert {9200, 9201, 9202} <= ids
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == ids and all(r.round_trip for r in last)
