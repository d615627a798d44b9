"""Columns without a hash, and more languages than one block of the model holds."""

from pyspark.sql import functions as F

from ripplespark.llm import language, near_dedup


def test_first_of_copies_with_a_map_column(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(2, text, {"a": 1}, [{"b": 2}]), (1, text, {"z": None}, None), (1, text, {"c": 3}, []), (3, "something else that is long enough to have shingles of its own", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, tags map<string,int>, more array<map<string,int>>")
    kept = near_dedup.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and set(kept[0].asDict()) == {"doc_id", "text", "tags", "more"}
    assert sorted(map(str, near_dedup.keep_first(df.repartition(5)).collect())) == sorted(map(str, kept))


def test_languages_in_several_blocks(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join(f"{letters[k % 26]}{letters[(k * 7 + j) % 26]}{letters[k % 26]}" for j in range(8)), f"l{k % 26:02d}") for k in range(260)]
    rows += [(900, None, "l00"), (901, "123", "l00"), (902, "zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # A column whose name clashes, and ties: every text twice.
    df = df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("score", F.lit("x"))
    one, many = language.train(df), language.train(df, at_a_time=5)
    assert len(one) == 1 and len(many) == 6 and sum((b[0] for b in many), []) == one[0][0]
    got = {m: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predict(df, model).collect()} for m, model in (("one", one), ("many", many))}
    assert got["one"] == got["many"] and len(got["one"]) == 526
    assert got["one"][900] == got["one"][901] == ("und", 0.0)
    assert sum(got["one"][k][0] == lang for k, _, lang in rows[:260]) > 250
    assert {r.lang_pred for r in language.predict(df, []).collect()} == {"und"}
