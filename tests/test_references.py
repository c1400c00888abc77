from tessera.plans.graph import extract_reporter_refs


def test_references_far_into_a_text(spark, tmp_path):
    text = "word " * 60 + "as held in [1960] 2 S.C.R. 99, then AIR 1971 SC 530 " + "word " * 60 + "and (2003) 4 SCC 17."
    spark.createDataFrame([(2, text), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.target_ref for r in extract_reporter_refs(spark, str(tmp_path)).collect())
    assert got == ["AIR-1971-530", "SCC-2003-4-17", "SCR-1960-2-99"]
