"""Replay of a log of manual decisions over rows with a name and aliases.

The log is a table ``seq, action, subject, object, block``. Kinds of actions follow each other in a fixed order; those
of one kind follow ``seq``: a row that one action renames is met under its new name by the later ones only. Such chains
are found on the log alone: each action points at the next one that meets its result, pointers are doubled, and a row
joins the chain of the first action that meets its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .match import dealt, salted

RENAME, SPLIT, REMOVE_ALIAS, MERGE_ROUTES, BULK_REMOVE = "rename", "split", "remove_alias", "merge_routes", "bulk_remove"
DEFINE, KEEP, REMOVE, MERGE_INTO = "define", "keep", "remove", "merge_into"
_STRINGS = "array<string>"


def chains(moves: DataFrame) -> DataFrame:
    """``name, target, reset, items`` from moves ``seq, subject, object, reset, items``: what a row of that name is called after
    all moves, and what the steps on the way hand on: their items, each once, in the order of the steps; from the last step
    with ``reset`` on, if one has it. A move without effect (subject = object) is a step as well."""
    m = kept(moves.select("seq", "subject", "object", "reset", F.array_distinct("items").alias("items")).dropDuplicates(["seq", "subject"]), "moves")
    asks = m.select(F.col("object").alias("name"), "seq", F.lit(1).alias("ask"), "subject")
    offers = m.select(F.col("subject").alias("name"), "seq", F.lit(0).alias("ask"), "subject")
    later = Window.partitionBy("name").orderBy(F.desc("seq"), F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = asks.union(offers).withColumn("next", F.last(F.when(F.col("ask") == 0, F.col("seq")), True).over(later)).filter("ask = 1").select("seq", "subject", "next")
    now = kept(m.join(nxt, ["seq", "subject"]).select("seq", "subject", "next", F.col("object").alias("target"), "reset", "items"), "chains")
    while now.filter("next is not null").limit(1).count():
        ahead = now.select(F.col("seq").alias("next"), F.col("subject").alias("target"), F.col("next").alias("next2"), F.col("target").alias("target2"), F.col("reset").alias("reset2"), F.col("items").alias("items2"))
        new = now.join(ahead, ["next", "target"], "left")
        more = F.col("target2").isNotNull()
        items = F.when(~more, F.col("items")).when(F.col("reset2"), F.col("items2")).otherwise(F.array_union("items", "items2"))
        new = new.select("seq", "subject", F.when(more, F.col("next2")).alias("next"), F.coalesce("target2", "target").alias("target"), (F.col("reset") | F.coalesce("reset2", F.lit(False))).alias("reset"), items.alias("items"))
        now = kept(new, "chains")
    return now.groupBy(F.col("subject").alias("name")).agg(F.min_by(F.struct("target", "reset", "items"), "seq").alias("c")).select("name", "c.target", "c.reset", "c.items")


def _followed(rows: DataFrame, moves: DataFrame, aliases) -> DataFrame:
    """Rows under their last names; ``aliases`` makes the new aliases from the old ones, the items and whether these replace them."""
    met = salted(rows, chains(moves), ["name"], F.col("row_id"), "left")
    moved = F.col("target").isNotNull()
    return met.select("row_id", F.coalesce("target", "name").alias("name"), F.when(moved, aliases(F.col("aliases"), F.col("items"), F.col("reset"))).otherwise(F.col("aliases")).alias("aliases"))


def _appended(old: Column, more: Column) -> Column:
    return F.concat(old, F.array_except(more, old))


def _without(rows: DataFrame, gone: DataFrame, keep_own: bool) -> DataFrame:
    """Rows without the aliases in ``gone`` (``alias``), whatever their number; an alias that is the row's own name may stay."""
    each = rows.select("row_id", "name", F.posexplode("aliases").alias("pos", "alias"))
    marked = salted(each, gone.distinct().withColumn("gone", F.lit(True)), ["alias"], F.col("row_id"), "left")
    stays = F.col("gone").isNull() | ((F.col("alias") == F.col("name")) if keep_own else F.lit(False))
    left = marked.filter(stays).groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "alias"))), lambda s: s["alias"]).alias("left"))
    return rows.join(left, "row_id", "left").select("row_id", "name", F.coalesce("left", F.array().cast(_STRINGS)).alias("aliases"))


def _by_name(rows: DataFrame, log: DataFrame, action: str, aliases) -> DataFrame:
    """Rows whose name an action of this kind names; ``aliases`` makes the new aliases from the old ones and the objects."""
    lists = log.filter(F.col("action") == action).groupBy(F.col("subject").alias("name")).agg(F.collect_set("object").alias("objects"))
    met = salted(rows, lists, ["name"], F.col("row_id"), "left")
    return met.select("row_id", "name", F.when(F.col("objects").isNotNull(), aliases(F.col("aliases"), F.col("objects"), F.col("name"))).otherwise(F.col("aliases")).alias("aliases"))


def replay(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``row_id, name, aliases`` after all decisions of ``log``, in this order of kinds:

    rename (subject to object; the old name becomes an alias), split (rows named by one of a child's subjects take the
    child's name, its object; they lose as aliases the subjects of that child and the names of the other children of the
    ``block``), remove_alias (object, from every row), every alias that is another row's name, merge_routes (subject to
    object; the other subjects of that object in the ``block`` become aliases), bulk_remove (object from rows named subject),
    define (the objects, with the name, are the aliases), keep (only these of the aliases, or all of these if none is left),
    remove (not these; the name itself if none is left), merge_into (subject to object, with the defined or kept aliases of
    the new name, else with the name added). Row ids are unique; null aliases are none. Rows of equal names and aliases are
    one class, which is followed once."""
    log = kept(log.select("seq", "action", "subject", "object", "block"), "log")
    of = lambda action: log.filter(F.col("action") == action)
    own = rows.select("row_id", "name", F.coalesce("aliases", F.array().cast(_STRINGS)).alias("aliases"))
    own = kept(own.withColumn("class", F.md5(F.to_json(F.struct("name", "aliases")))), "own")
    now = kept(own.groupBy("class").agg(F.first("name").alias("name"), F.first("aliases").alias("aliases")).select(F.col("class").alias("row_id"), "name", "aliases"), "classes")

    moves = of(RENAME).select("seq", "subject", "object", F.lit(False).alias("reset"), F.array("subject").alias("items"))
    now = _followed(now, moves, lambda old, items, reset: _appended(old, items))

    child = of(SPLIT).groupBy("block", "object").agg(F.min("seq").alias("at"), F.collect_set("subject").alias("own"))
    names = of(SPLIT).groupBy("block").agg(F.collect_set("object").alias("names"))
    child = child.join(names, "block").select("block", "object", "at", F.array_union("own", F.array_except("names", F.array("object"))).alias("items"))
    moves = of(SPLIT).select("block", "subject", "object").join(child, ["block", "object"]).select(F.col("at").alias("seq"), "subject", "object", F.lit(False).alias("reset"), "items")
    now = _followed(now, moves, lambda old, items, reset: F.filter(old, lambda a: ~F.array_contains(items, a)))

    now = kept(_without(now, of(REMOVE_ALIAS).select(F.col("object").alias("alias")), False), "rows")
    others = now.select(F.trim("name").alias("alias")).filter("alias <> ''")
    now = _without(now, others, True)

    merged = of(MERGE_ROUTES).groupBy("block", "object").agg(F.min("seq").alias("at"), F.array_sort(F.collect_set("subject")).alias("own"))
    moves = of(MERGE_ROUTES).select("block", "subject", "object").join(merged, ["block", "object"]).select(F.col("at").alias("seq"), "subject", "object", F.lit(False).alias("reset"), F.array_except("own", F.array("object")).alias("items"))
    now = _followed(now, moves, lambda old, items, reset: _appended(old, items))

    now = _by_name(now, log, BULK_REMOVE, lambda old, gone, name: F.filter(old, lambda a: ~F.array_contains(gone, a)))
    now = _by_name(now, log, DEFINE, lambda old, own, name: F.array_sort(F.array_union(own, F.array(name))))

    def narrowed(old: Column, own: Column, name: Column) -> Column:
        whole = F.array_union(own, F.array(name))
        left = F.array_intersect(old, whole)
        return F.array_sort(F.when(F.size(left) > 0, left).otherwise(whole))

    now = _by_name(now, log, KEEP, narrowed)

    def reduced(old: Column, gone: Column, name: Column) -> Column:
        left = F.array_except(old, gone)
        return F.when(F.size(left) > 0, F.array_sort(left)).otherwise(F.array(name))

    now = kept(_by_name(now, log, REMOVE, reduced), "rows")
    known = log.filter(F.col("action").isin(DEFINE, KEEP)).groupBy(F.col("subject").alias("object")).agg(
        F.collect_set(F.when(F.col("action") == DEFINE, F.col("object"))).alias("defined"), F.collect_set(F.when(F.col("action") == KEEP, F.col("object"))).alias("kept")
    )
    whole = F.array_sort(F.array_union(F.when(F.size("defined") > 0, F.col("defined")).otherwise(F.col("kept")), F.array("object")))
    known = known.select("object", F.when(F.size(whole) > 1, whole).alias("note"))
    block = of(MERGE_INTO).groupBy("block", "object").agg(F.min("seq").alias("at"))
    moves = of(MERGE_INTO).filter("subject <> object").join(block, ["block", "object"]).join(known, "object", "left").select(F.col("at").alias("seq"), "subject", "object", F.col("note").isNotNull().alias("reset"), F.coalesce("note", F.array("object")).alias("items"))
    now = _followed(now, moves, lambda old, items, reset: F.array_sort(F.when(reset, items).otherwise(F.array_union(old, items))))
    return dealt(own.select("row_id", "class"), now.select(F.col("row_id").alias("class"), "name", "aliases"), ["class"], F.col("row_id")).select("row_id", "name", "aliases")
