"""Readers and writers on files."""

from pyspark.sql import functions as F

from latentlake.sources import generators, readers, writers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def values(df, col="x"):
    return sorted(list(r[0]) for r in df.select(col).collect())


def test_csv_with_and_without_header(spark, tmp_path):
    a = put(tmp_path, "wide.csv", "lon,lat,höhe,depth\n-7.25,1e3,0,+4\n.5,6.,-0.125,2E-2\n")
    assert values(readers.read_csv_vectors(spark, a)) == [[-7.25, 1000.0, 0.0, 4.0], [0.5, 6.0, -0.125, 0.02]]
    b = put(tmp_path, "bare.csv", "17\n19,23\n")
    assert values(readers.read_csv_vectors(spark, b, header=False)) == [[17.0, 0.0], [19.0, 23.0]]


def test_csv_ragged_blank_and_words(spark, tmp_path):
    p = put(tmp_path, "odd.csv", '1,2\n a ,, 3 ,"4",5e1\n,,\nword\n7\n')
    assert values(readers.read_csv_vectors(spark, p, header=False)) == [[1.0, 2.0, 0.0], [3.0, 4.0, 50.0], [7.0, 0.0, 0.0]]
    strict = readers.read_csv_vectors(spark, p, header=False, mode="strict")
    assert strict.where("ok").count() == 0


def test_quoted_cells_of_a_line(spark):
    df = spark.createDataFrame([('1,"2",x,"3,4"',)], "line string")
    assert df.select(readers.cells("line")).first()[0] == ["1", "2", "x", "3,4"]


def test_json_shapes(spark, tmp_path):
    docs = {"[8, -2.5, 1e2, 0]": [[8.0, -2.5, 100.0, 0.0]], "[[11], [12, 13, 14], []]": [[11.0, 0.0, 0.0], [12.0, 13.0, 14.0], [0.0, 0.0, 0.0]],
            '[{"höhe": 31, "name": "é"}, {"b": 32, "a": 33}]': [[31.0, 0.0], [32.0, 33.0]], '{"data": [[41, 42]], "rows": [[9]]}': [[41.0, 42.0]],
            '{"z": 51, "y": "text", "x": 52}': [[51.0, 52.0]], "-6.5e-1": [[-0.65]], "[]": [], '{"values": [61, null, 62]}': [[61.0, 62.0]],
            '{"rows": {"p": 71, "q": false, "r": 72}}': [[71.0, 72.0]], '[["no", 81], [null, 82, 83]]': [[81.0, 0.0], [82.0, 83.0]]}
    for i, (text, want) in enumerate(docs.items()):
        p = put(tmp_path, f"{i}.json", text)
        got = readers.read_json_vectors(spark, p).orderBy("row").collect()
        assert [r.x for r in got] == want, text


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 2, True, [0.5, 0.1]), ("r2", 0, False, [])], "run string, steps int, converged boolean, drift_trace array<double>")
    log = str(tmp_path / "log")
    writers.append_traces(df, "run", log)
    writers.append_traces(df, "run", log)
    back = spark.read.json(log)
    assert back.count() == 4 and {r.final_drift for r in back.collect()} == {0.1, None}
    writers.write_csv(df, str(tmp_path / "flat"))
    assert spark.read.csv(str(tmp_path / "flat"), header=True).columns == ["run", "steps", "converged"]


def test_validated_append(spark, tmp_path):
    df = spark.createDataFrame([("native",), ("other",), (None,), ("flow",)], "moment_type string")
    writers.append_validated(df, "moment_type", str(tmp_path / "log"), str(tmp_path / "bad"))
    assert spark.read.schema("moment_type string").json(str(tmp_path / "log")).count() == 2
    assert spark.read.schema("moment_type string").json(str(tmp_path / "bad")).count() == 2


def test_generated_values_do_not_depend_on_partitioning(spark):
    a = generators.random_candidates(spark.range(200, numPartitions=1), ["id"], 5)
    b = generators.random_candidates(spark.range(200, numPartitions=1).repartition(7), ["id"], 5)
    assert sorted((r.id, tuple(r.x)) for r in a.collect()) == sorted((r.id, tuple(r.x)) for r in b.collect())
    s = a.select(F.explode("x").alias("v")).agg(F.min("v"), F.max("v"), F.avg("v"), F.stddev("v")).first()
    assert s[0] == -1.0 and s[1] == 1.0 and abs(s[2]) < 0.1 and 0.6 < s[3] < 0.9


def test_random_orders_are_permutations(spark):
    df = generators.random_orders(spark.range(20).withColumn("r", F.lit(1)), ["r"], "id", 4)
    for g in df.groupBy("cand").agg(F.sort_array(F.collect_list("rank_value")).alias("v")).collect():
        assert [round(v * 19, 9) for v in g.v] == list(range(20))


def test_cluster_tree_has_three_and_nine_clusters(spark):
    df = generators.clustered(spark.range(90).withColumnRenamed("id", "vec_id"), "vec_id")
    assert df.select("label_l0").distinct().count() == 3 and df.select("label_l1").distinct().count() == 9
    from latentlake.operators.graph import shape_at

    assert shape_at(df, "vec_id", "x", 1.5).first().components == 9
