"""Rules grown, pruned and rewritten, on tables whose rules are known."""

import itertools
import random

from riskweave.operators.rules import Ripper


def table(spark, seed=1, noise=0.0):
    """Bad customers are those of kind a with an amount of at least 60, and all of kind b in zone 3."""
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        kind, zone, amount, other = rng.choice("abcd"), rng.randrange(4), float(rng.randrange(100)), float(rng.randrange(50))
        bad = kind == "a" and amount >= 60 or kind == "b" and zone == 3
        rows.append((i, kind, zone, amount, other, int(bad != (rng.random() < noise))))
    return spark.createDataFrame(rows, "id long, kind string, zone int, amount double, other double, y int").repartition(3).persist(), rows


COLUMNS = ["kind", "zone", "amount", "other"]


def test_known_rules_come_out(spark):
    df, rows = table(spark)
    m = Ripper(least_positives=20).fit(df, "y", COLUMNS, "id")
    a, b = sorted(r["rule"] for r in m.rules)
    assert sorted(a.split(" AND ")) == ["`amount` >= 60.0D", "cast(`kind` as string) = 'a'"]
    assert sorted(b.split(" AND ")) == ["cast(`kind` as string) = 'b'", "cast(`zone` as string) = '3'"]
    assert sum(r["pos"] for r in m.rules) == sum(r[5] for r in rows) and not any(r["neg"] for r in m.rules)
    scored = {r["id"]: r["y_pred"] for r in m.transform(df).collect()}
    assert all(scored[r[0]] == float(r[5]) for r in rows)


def test_rounds_leave_valid_rules(spark):
    df, rows = table(spark, 2, noise=0.12)
    plain = Ripper(least_positives=20, rounds=0).fit(df, "y", COLUMNS, "id")
    m = Ripper(least_positives=20, rounds=2).fit(df, "y", COLUMNS, "id")
    again = Ripper(least_positives=20, rounds=2).fit(df.repartition(5), "y", COLUMNS, "id")
    assert m.rules == again.rules
    for model in (plain, m):
        left = df
        for r in model.rules:
            got = left.where(r["rule"]).groupBy("y").count().collect()
            assert {x["y"]: x["count"] for x in got} == {k: v for k, v in ((1, r["pos"]), (0, r["neg"])) if v}
            left = left.where(f"NOT coalesce({r['rule']}, false)")
    assert all(set(a["rule"].split(" AND ")) != set(b["rule"].split(" AND ")) for a, b in itertools.combinations(m.rules, 2))
    right = lambda model: sum((p["y_pred"] > 0.5) == p["y"] for p in model.transform(df).collect())
    assert min(right(m), right(plain)) > 0.75 * len(rows)


def test_a_short_rule_is_replaced_or_revised(spark):
    df, _ = table(spark)
    m = Ripper(least_positives=20)
    m._part = "part"
    base = df.withColumn("part", df["id"] % 5 > 0)
    m.conditions = m.candidates(base, COLUMNS)
    kind = lambda k: ("kind", f"cast(`kind` as string) = '{k}'")
    zone, amount = ("zone", "cast(`zone` as string) = '3'"), ("amount", "`amount` >= 60.0D")
    loose = [kind("b")]
    assert m._rewrite(base, "y", [[kind("a"), amount], loose]) == [[kind("a"), amount], [kind("b"), zone]]  # revised: it grows on
    padded = [kind("b"), zone, ("other", m.conditions[-1][1]), ("amount", "`amount` >= 10.0D")]
    out = m._rewrite(base, "y", [padded])
    assert len(out) == 1 and len(out[0]) == 2  # replaced: two conditions say more than four
    assert m._rewrite(base, "y", [[kind("a"), amount], [kind("a"), amount]]) == [[kind("a"), amount]]  # said already
    assert m.description([zone]) < m.description(loose + [zone]) < m.description(padded)
    assert m._prune(base.where("NOT part"), "y", [kind("b"), zone, ("other", "`other` >= 45.0D")])[:2] == [kind("b"), zone]


def test_tables_without_rules(spark):
    df, _ = table(spark)
    none = Ripper(least_positives=20).fit(df.withColumn("y", df["y"] * 0), "y", COLUMNS, "id")
    assert none.rules == [] and none.transform(df).where("y_pred > 0").count() == 0
    empty = Ripper().fit(df.limit(0), "y", COLUMNS, "id")
    assert empty.rules == []
    odd = spark.createDataFrame([(i, ["it's", "b\\c", None][i % 3], int(i % 3 == 0)) for i in range(300)], "id long, part string, y int")
    assert [r["pos"] for r in Ripper(least_positives=10).fit(odd, "y", ["part"], "id").rules] == [100]
