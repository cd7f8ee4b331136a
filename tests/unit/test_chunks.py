from pyspark.sql import functions as F

from chartloom.plans import catalogue, chunks, documents


def test_chunks_and_search(spark):
    found = documents.extract(catalogue.fixture(spark))["stool_results"]
    blocks = catalogue.stool_blocks(spark, "")
    assets = spark.createDataFrame([("stool", 1, "table_p001_01", "logical results")], "doc_id string, asset_no int, asset_id string, caption string")
    made = chunks.chunks(found, blocks, assets)
    kinds = {r.kind: r.n for r in made.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"result": 8, "section": 6, "summary": 1, "reference": 1}
    bodies = {r.chunk_id: r.body for r in made.collect()}
    assert bodies["stool/result/1"] == "Couleur : Marron (2024-06-03)"
    asked = spark.createDataFrame([(1, "couleur marron"), (2, "nothing known")], "query_id int, body string")
    best = chunks.search(chunks.keyword_index(made), asked, 3).orderBy("rank").collect()
    assert {r.query_id for r in best} == {1} and [r["rank"] for r in best] == [1, 2, 3] and best[0].score >= best[1].score
