"""Rules and clauses: pairs by automaton against a nested loop, and whole words with signs of patterns in them."""

import random
import re

from pyspark.sql import functions as F

from alinea.operators import rules

RULE, CLAUSE = "rule_id long, name string, description string, keywords array<string>", "clause_id long, name string"


def bare(name):
    return re.sub(r"^(exclusion|clause|provision|article|section):\s*", "", name.lower().strip(" ")).strip(" ")


def nested(all_rules, clauses):
    out = set()
    for r, name, text, words in all_rules:
        fields = [x for x in [(name or "").lower(), *[bare(w) for w in words or [] if w is not None]] if x]
        for c, clause in clauses:
            b = bare(clause or "")
            if len(b) >= 3 and (any(b in x or x in b for x in fields) or (len(b) > 5 and b in (text or "").lower())):
                out.add((r, c))
    return out


def test_name_matches(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abc (.") for _ in range(rng.randint(0, n))).strip()
    all_rules = [(i, some(6), some(14), [some(5), "Clause: " + some(4)]) for i in range(40)] + [(90, None, None, None), (91, "", "", []), (92, "War (all)", "the war risk", [None, "Section:  war"])]
    clauses = [(i, rng.choice(["", "Exclusion: ", "ARTICLE:"]) + some(8)) for i in range(60)] + [(70, None), (71, ""), (72, "war (all)"), (72, "WAR RISK"), (73, "clause: the war risk of it")]
    r, c = spark.createDataFrame(all_rules, RULE), spark.createDataFrame(clauses, CLAUSE)
    got = [tuple(x) for x in rules.name_matches(r, c).collect()]
    want = nested(all_rules, clauses)
    assert set(got) == want and {(92, 72), (92, 73)} <= want
    assert rules.name_matches(r, c.limit(0)).count() == rules.name_matches(r.limit(0), c).count() == 0


def test_whole_words_and_matched_rules(spark):
    cases = [("the a.b is", "a.b", True), ("the axb is", "a.b", False), ("warden", "war", False), ("War, or", "war", True), ("x(all) y", "(all", True), ("c++ [1]", "[1", False), ("a$b", "a$b", True)]
    rows = spark.createDataFrame([(i, t, w) for i, (t, w, _) in enumerate(cases)], "i int, t string, w string").select("i", rules.whole_word(F.col("t"), F.col("w")).alias("v"))
    assert [r.v for r in sorted(rows.collect())] == [bool(re.search(rf"\b{re.escape(w)}\b", t.lower())) for t, w, _ in cases]
    r = spark.createDataFrame([(1, "war risk", None, ["war"]), (2, "flood", "x", ["zzz"]), (3, None, "of fire", ["clause: fire"]), (4, "hail storm", None, None)], RULE)
    some = spark.createDataFrame([(1, "storm"), (2, "ab")], CLAUSE)
    assert {x.rule_id: x.matched for x in rules.matched_rules(r, some).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert not any(x.matched for x in rules.matched_rules(r, some.filter("clause_id = 2")).collect())
