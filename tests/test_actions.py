"""The replay of decisions against a sequential one."""

import random

import pytest

from placeweave.operators import actions as ac


def sequential(rows, log):
    rows = {i: [n, list(a or [])] for i, n, a in rows}
    of = lambda kind: sorted(x for x in log if x[1] == kind)

    def blocks(kind):
        found = {}
        for seq, _, s, o, b in of(kind):
            found.setdefault((b, o), [seq, []])[1].append(s)
        return sorted((seq, b, o, own) for (b, o), (seq, own) in found.items())

    for _, _, s, o, _ in of("rename"):
        for r in rows.values():
            if r[0] == s:
                r[0] = o
                r[1] += [s] if s not in r[1] else []
    for _, b, o, own in blocks("split"):
        others = {x[3] for x in of("split") if x[4] == b} - {o}
        for r in rows.values():
            if r[0] in own:
                r[0], r[1] = o, [a for a in r[1] if a not in others and a not in own]
    gone = {x[3] for x in of("remove_alias")}
    names = {r[0].strip() for r in rows.values() if r[0].strip()}
    for r in rows.values():
        r[1] = [a for a in r[1] if a not in gone]
    for r in rows.values():
        r[1] = [a for a in r[1] if a not in names or a == r[0]]
    for _, _, o, own in blocks("merge_routes"):
        for r in rows.values():
            if r[0] in own:
                r[0] = o
                r[1] += [s for s in sorted(set(own) - {o}) if s not in r[1]]
    lists = lambda kind, n: {x[3] for x in of(kind) if x[2] == n}
    for r in rows.values():
        r[1] = [a for a in r[1] if a not in lists("bulk_remove", r[0])]
        if lists("define", r[0]):
            r[1] = sorted(lists("define", r[0]) | {r[0]})
        if own := lists("keep", r[0]):
            own = own | {r[0]}
            r[1] = sorted(set(r[1]) & own) or sorted(own)
        if own := lists("remove", r[0]):
            r[1] = sorted(set(r[1]) - own) or [r[0]]
    for _, _, o, own in blocks("merge_into"):
        known = (lists("define", o) or lists("keep", o)) | {o}
        for r in rows.values():
            if r[0] in own and r[0] != o:
                r[0], r[1] = o, sorted(known) if known != {o} else sorted(set(r[1]) | {o})
    return {(i, n, tuple(a)) for i, (n, a) in rows.items()}


KINDS = ["rename", "split", "remove_alias", "merge_routes", "bulk_remove", "define", "keep", "remove", "merge_into"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(14)]
    rows = [(k, rng.choice(names), rng.sample(names, rng.randint(0, 5))) for k in range(80)] + [(90, "n1", None), (91, " ", ["x"])]
    log = [(k, rng.choice(KINDS), rng.choice(names), rng.choice(names), rng.randint(0, 2)) for k in range(60)]
    got = ac.replay(spark.createDataFrame(rows, "row_id long, name string, aliases array<string>"), spark.createDataFrame(log, "seq long, action string, subject string, object string, block int")).collect()
    assert {(r.row_id, r.name, tuple(r.aliases)) for r in got} == sequential(rows, log)


def test_long_chains_and_order(spark):
    log = [(k, "rename", f"a{k}", f"a{k + 1}", 0) for k in range(40)] + [(50, "rename", "b1", "b2", 0), (49, "rename", "b2", "b3", 0), (60, "rename", "c", "c", 0)]
    rows = [(1, "a0", []), (2, "a39", ["x"]), (3, "b1", []), (4, "b2", []), (5, "c", []), (6, "z", ["y"])]
    df = spark.createDataFrame(rows, "row_id long, name string, aliases array<string>")
    got = {r.row_id: (r.name, list(r.aliases)) for r in ac.replay(df, spark.createDataFrame(log, "seq long, action string, subject string, object string, block int")).collect()}
    assert got[1][0] == "a40" and got[2] == ("a40", ["x", "a39"]) and len(got[1][1]) == 40
    assert got[3][0] == "b2" and got[4][0] == "b3" and got[6] == ("z", ["y"])  # the second one comes before the first in the log
    assert {(i, n, tuple(a)) for i, (n, a) in got.items()} == sequential(rows, log)


def test_query(spark, sf_dir):
    from placeweave.plans import resolve

    rows, log = (df.collect() for df in resolve.action_rows(spark, sf_dir))
    got = {(r.row_id, r.name, tuple(r.aliases)) for r in resolve.e3_log(spark, sf_dir).collect()}
    assert got == sequential([tuple(r) for r in rows], [tuple(r) for r in log]) and len(got) == len(rows)


def test_chains_hand_on_each_item_once(spark):
    from pyspark.sql import functions as F

    log = [(k, "rename", "ab"[k % 2], "ba"[k % 2], 0) for k in range(300)]
    rows = [(k, "ab"[k % 2], ["x", "a"][: k % 3]) for k in range(12)]
    df = spark.createDataFrame(log, "seq long, action string, subject string, object string, block int")
    got = ac.chains(df.select("seq", "subject", "object", F.lit(False).alias("reset"), F.array("subject").alias("items"))).collect()
    assert {(r["name"], r["target"], tuple(r["items"])) for r in got} == {("a", "a", ("a", "b")), ("b", "a", ("b", "a"))}
    out = ac.replay(spark.createDataFrame(rows, "row_id long, name string, aliases array<string>"), df).collect()
    assert {(r.row_id, r.name, tuple(r.aliases)) for r in out} == sequential(rows, log)


def test_equal_rows_of_one_class(spark, monkeypatch):
    from placeweave.operators import match

    monkeypatch.setattr(match, "TOGETHER", 5)  # a class of more rows is dealt
    log = [(1, "rename", "a", "b", 0), (2, "merge_into", "b", "c", 0), (3, "define", "c", "y", 0), (4, "remove", "n", "x", 0)]
    rows = [(k, "a", ["x"]) for k in range(40)] + [(50, None, ["x"]), (51, None, None), (52, "", []), (53, "n", ["x"]), (54, "a", ["x", "x"]), (55, "a", [])]
    out = ac.replay(spark.createDataFrame(rows, "row_id long, name string, aliases array<string>"), spark.createDataFrame(log, "seq long, action string, subject string, object string, block int")).collect()
    got = {r.row_id: (r.name, tuple(r.aliases)) for r in out}
    assert len(out) == len(rows) and got[50] == (None, ("x",)) and got[51] == (None, ()) and got[52] == ("", ())
    known = [r for r in rows if r[1] is not None]
    assert {(i, *got[i]) for i, _, _ in known} == sequential(known, log)
