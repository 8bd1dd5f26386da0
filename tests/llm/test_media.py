from factloom.llm import gif, queries

SF = "/root/testdata/sf0.001"


def test_digests_are_of_the_stored_bytes(spark):
    got = queries.op4_gif_media(spark, SF)
    files = got.inputFiles()
    assert files and all("/media-" in x for x in files)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, gif.media_digests(gif.media_column(docs)).collect()), key=str)
