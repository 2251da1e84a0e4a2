from packetloom.llm import near_dedup as nd


def test_rows_that_share_a_key(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:59], "other"])  # near copies
    c, d = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [
        (1, c, "first of its group"),
        (2, c + " more", "later copy, of a key with another text"), (2, d, "alone"),
        (3, a, "one of two"), (3, b, "one of two"), (3, a, "one of two"), (4, b, "copy"),
        (5, "", "no words"), (5, None, "no words"), (6, "", "no words"), (None, a, "no key"), (None, a, "no key"),
    ]
    got = nd.keep_one(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()
    notes = sorted(x.note for x in got)
    assert notes == ["alone", "first of its group", "no key", "no key", "no words", "no words", "no words", "one of two"]
    assert sorted({x.doc_id or -1 for x in got}) == [-1, 1, 2, 3, 5, 6]
