"""What rules are judged by, candidates in tiers, exports read back: each branch once."""

from alinea.operators import candidates, rules
from alinea.sources import tables


def test_chunks_of_rules(spark):
    named = spark.createDataFrame([(1, "war", None, []), (2, "flood risk", None, []), (3, "hail", None, None), (4, "quake", None, ["tremor"])], "rule_id long, name string, description string, keywords array<string>")
    hits = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.7)], "rule_id long, chunk long, similarity double")
    detected = spark.createDataFrame([(10, "Clause: flood risk", "x" * 30, None), (11, "flood risk", "short", 0.9), (12, "tremor", "y" * 20, 0.6), (13, "war", "z" * 40, 0.5), (14, None, "z" * 40, 0.5)], "clause_id long, name string, text string, confidence double")
    got = sorted(tuple(r) for r in rules.chunks_of(named, hits, detected, "chunk").select("rule_id", "item", "similarity", "origin").collect() if r.origin != "none")
    assert got == [(1, 7, 0.9, "retrieved"), (1, 8, 0.7, "retrieved"), (2, 10, 0.85, "detected"), (4, 12, 0.6, "detected")]
    assert [tuple(r) for r in rules.chunks_of(named, hits, detected, "chunk").filter("origin = 'none'").collect()] == [(3, None, None, None, "none")]


def test_retrieved_is_worked_out_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            runs.add(len(f))
            yield f

    named = spark.createDataFrame([(1, "war", None, []), (2, "flood risk", None, [])], "rule_id long, name string, description string, keywords array<string>")
    hits = spark.createDataFrame([(1, 7, 0.9)], "rule_id long, chunk long, similarity double").mapInPandas(counted, "rule_id long, chunk long, similarity double")
    detected = spark.createDataFrame([(10, "Clause: flood risk", "x" * 30, None)], "clause_id long, name string, text string, confidence double")
    assert len(rules.chunks_of(named, hits, detected, "chunk").collect()) == 2
    assert runs.value == 1


def test_tiers(spark):
    library = spark.createDataFrame([(1, "Interest Clause", "LSW300", "interest is due", True), (2, "Notice", "LSW 3001", "notice is given in days", False), (3, None, None, None, False)], "item long, name string, code string, text string, is_global boolean")
    rows = [(1, "INTEREST (LSW 3001)", "x"), (2, "Other", "see lsw-3001 here"), (3, "Other", "a" * 250 + "LSW300"), (4, "Other", "Interest is due."), (5, None, None), (6, "LSW 300", "notice is given in days")]
    got = {r.key: (r.tier, r.item) for r in candidates.in_tiers(spark.createDataFrame(rows, "key long, heading string, body string"), library, "key").collect()}
    assert got == {1: ("name-ref", 1), 2: ("code", 2), 3: (None, None), 4: ("semantic", 1), 5: (None, None), 6: ("code", 1)}


def test_json_export_is_read_back(spark, tmp_path):
    rows = [(1, "é \"x\"\n", [1.5, None]), (2, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, v array<double>")
    tables.json_export(df, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(f"{tmp_path}/out").collect()) == rows
