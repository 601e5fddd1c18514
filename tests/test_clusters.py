import __spark_entry__ as entry


def test_claims_are_compared_in_full(spark, tmp_path):
    same, a, b = "the same words " * 20, "then one thing " * 20, "but quite another matter " * 12
    turns = [(1, 0, "user", same + a), (1, 1, "user", same + b), (1, 2, "user", same + a + "!"), (2, 0, "user", "x" + same + a), (2, 1, "user", "yyyyyyyyyy" + same + a)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.cluster for r in entry.queries()["wn08_claim_clusters"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0, (2, 1): 0}
