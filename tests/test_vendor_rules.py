from pyspark.sql import functions as F

from fitloom.operators import vendor_rules
from fitloom.plans.feeds import products


def judged(spark, rows, table=None):
    frame = spark.createDataFrame([(*r, "kept") for r in rows], "vendor string, title string, product_type string, tags string, extra string")
    return vendor_rules.classify(frame, table).collect()


def test_first_rule_that_holds_decides(spark):
    rows = [
        ("namoki", "Steel (With Case Back)", "SKX007 Cases", ""), ("namoki", "Slim Case Back", "SKX007 Cases", ""), ("namoki", "Plain insert", "Bezel Inserts", ""), ("namoki", "NH35 Rotor", "Rotors", None), ("lucius", "Ultra Thin Bracelet", "Bracelets", "fits-skx013"),
        ("lucius", "Jubilee Bracelet 22/18mm", "Bracelets", ""), ("dlw", "NH35 movement", "Dials", ""), ("watchandstyle", "SNXS Crystal", "Sapphire Crystal", ""), (None, "x", "Cases", ""), ("elsewhere", "x", "Cases", ""), ("namoki", None, None, None),
    ]
    got = judged(spark, rows)
    assert sorted((r.vendor or "", r.outcome or "", r.family or "", r.reason or "", r.rule or "") for r in got) == sorted([
        ("namoki", "tagged", "skx007-case", "", "namoki-3.1"), ("namoki", "rejected", "", "caseback", "namoki-3.1"), ("namoki", "", "", "", "namoki-14.3"), ("namoki", "tagged", "nh3x-movement-accessory", "", "namoki-18.2"), ("lucius", "rejected", "", "other maker's case", "lucius-14.1"),
        ("lucius", "tagged", "skx013-bracelet", "", "lucius-14.4"), ("dlw", "tagged", "nh3x-movement", "", "dlw-3.1"), ("watchandstyle", "rejected", "", "snxs", "watchandstyle-1.1"), ("", "unmatched", "", "", ""), ("elsewhere", "unmatched", "", "", ""), ("namoki", "unmatched", "", "", "namoki-23.2"),
    ])
    assert all(r.extra == "kept" for r in got)
    assert judged(spark, []) == []


def test_rules_come_from_a_table(spark):
    own = spark.createDataFrame([("b", "v", 2, "true", "unmatched", None, None, None, None, None), ("a", "v", 1, "contains(ti, 'dial')", "tagged", "dial", "{model}-dial", "high", "manual", None)], vendor_rules.COLUMNS)
    got = judged(spark, [("v", "SKX013 Dial", "", ""), ("v", "Hands", "", ""), ("namoki", "x", "Tools", "")], own)
    assert sorted((r.rule or "", r.outcome, r.family) for r in got) == [("", "unmatched", None), ("a", "tagged", "skx013-dial"), ("b", "unmatched", None)]


def test_most_rules_meet_a_product_and_nothing_is_shuffled(spark):
    where = "/root/testdata/sf0.01"
    told = vendor_rules.classify(products(spark, where))
    used = {r.rule for r in told.select("rule").distinct().collect()}
    assert len(used) > 0.75 * len(vendor_rules.rules())
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert told.groupBy("part_id").count().where(F.col("count") > 1).count() == 0
