from sparkvigil.operators import monitor


def test_ancestors_and_all_descendants_of_every_root(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c")] + [("d", f"w{i}") for i in range(2100)] + [("p", "q"), ("q", "p")]
    roots = spark.createDataFrame([("c",), ("p",), ("alone",)], "root string")
    got = [tuple(r) for r in monitor.lineage(spark.createDataFrame(edges, "parent string, child string"), roots).collect()]
    want = {("c", "c", 0), ("c", "d", 1), ("c", "b", -1), ("c", "x", -1), ("c", "a", -2), ("p", "p", 0), ("p", "q", 1), ("alone", "alone", 0)}
    assert len(got) == len(set(got)) and set(got) == want | {("c", f"w{i}", 2) for i in range(2100)}


def test_query_gives_the_turns_of_every_conversation(spark):
    from sparkvigil.queries import lineage_closure

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn").distinct().collect()
    got = sorted((r.root, r.depth, r.ref) for r in lineage_closure(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((f"c{r.conv_id}:0", r.turn, f"c{r.conv_id}:{r.turn}") for r in rows)
