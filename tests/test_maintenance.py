from pyspark.sql import functions as F

from mediasift.operators import maintenance as M


def test_counts_picks_and_changes(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", None), (None, "x")], "g string, s string")
    assert sorted(map(str, M.counts_with_zeros(df, ["g"], "s", ["x", "y"]).collect())) == sorted(map(str, spark.createDataFrame([("a", 1, 1), ("b", 0, 0), (None, 1, 0)], "g string, n_x long, n_y long").collect()))
    t = spark.createDataFrame([(3, "b"), (1, "c"), (1, "a"), (None, "z")], "due int, k string")
    assert [r["k"] for r in M.earliest(t, [F.col("due"), F.col("k")], 3).collect()] == ["z", "a", "c"]
    v = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 6.0), ("b", 1, 0.0), ("b", 2, 5.0)], "g string, o int, v double")
    assert sorted((r["g"], r["o"], r["change"], r["share_of_first"]) for r in M.changes(v, ["g"], "o", "v").where("o = 2").collect()) == [("a", 2, 4.0, 3.0), ("b", 2, 5.0, None)]
    assert M.changes(v.limit(0), ["g"], "o", "v").count() == 0


def test_marks_and_relations(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "before", "old"), (3, None, "old"), (4, None, None)], "id int, deleted_at string, note string")
    got = {r["id"]: (r["deleted_at"], r["note"]) for r in M.mark_deleted(df, F.when(F.col("id") != 4, F.col("id") < 3), F.lit("now"), F.when(F.col("id") > 1, "new")).collect()}
    assert got == {1: ("now", "old"), 2: ("before", "old"), 3: (None, "old"), 4: (None, None)}
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert sorted((r["v"], r["related"]) for r in M.related(left, spark.createDataFrame([("a",), ("a",), (None,)], "k string"), ["k"]).collect()) == [(1, True), (2, False), (3, False)]


def test_only_new_rows_are_appended(spark):
    from mediasift.operators.maintenance import only_new

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, n int")
    x, y = only_new(df, [spark.createDataFrame([("a", "clash")], "k string, n string"), df.limit(0)], ["k"])
    assert {r["k"] for r in x.collect()} == {"b"} and sorted(r["k"] for r in y.collect()) == ["a", "b"]


def test_what_is_known_of_a_file(spark):
    from pyspark.sql import functions as F

    from mediasift.functions.gates import probed

    log = "Input #0\n  Duration: 01:02:03.50, start: 0\n  Stream #0:0: Video: h264, yuv420p, 1280x720, 25 fps"
    rows = [('{"duration_s": 5.5, "width": 4, "height": 3}', log, 9), ("{", log, 9), (None, "Duration: N/A", 9), (None, None, None), (None, "Duration: 00:00:01.00", None)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "r string, l string, n long").select(probed(F.col("r"), F.col("l"), F.col("n"))).collect()]
    assert got == [("report", 5.5, 4, 3, 9), ("log", 3723.5, 1280, 720, 9), ("size", None, None, None, 9), (None, None, None, None, None), ("log", 1.0, None, None, None)]
