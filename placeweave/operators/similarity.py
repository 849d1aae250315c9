"""Pairs of similar sets, and proposals of names that may mean one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import names as nm

from .graph import kept
from .match import salted, sized


def similar_sets(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, shared, total`` of each two rows (``id, items``; ids unique, a < b) with
    100 * shared items >= percent * items of both. Items are put in order, the rarest first: two similar sets share one of
    their first few, so only rows with such an item in common meet, and only where their sizes and what is left behind the item
    leave room. Null and empty sets are similar to nothing; equal sets travel as one."""
    x = sets.select("id", F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).filter("size(items) > 0")
    same = kept(x.groupBy("items").agg(F.min("id").alias("key")), "sets")
    each = same.select("key", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("df"))
    order = salted(each, often, ["item"], F.col("key"))
    lists = kept(order.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items")).select("key", F.transform("items", lambda s: s["item"]).alias("items"), F.size("items").alias("n")), "lists")
    least = lambda n: F.ceil(n * percent / 100)
    head = lists.select("key", "n", F.posexplode(F.slice("items", F.lit(1), (F.col("n") - least(F.col("n")) + 1).cast("int"))).alias("at", "item"))
    other = head.select(F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("at").alias("at2"), "item")
    met = head.join(other, "item").filter("key < key2").filter((100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    # the first item in common leaves at most this many
    room = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("n2") - F.col("at2") - 1)
    met = met.filter(100 * room >= percent * (F.col("n") + F.col("n2") - room)).select("key", "key2").distinct()
    left, right = lists.select("key", "items", "n"), lists.select(F.col("key").alias("key2"), F.col("items").alias("items2"), F.col("n").alias("n2"))
    shared = F.size(F.array_intersect("items", "items2"))
    pairs = met.join(left, "key").join(right, "key2").select("key", "key2", shared.alias("shared"), (F.col("n") + F.col("n2") - shared).alias("total")).filter(100 * F.col("shared") >= percent * F.col("total"))
    rows = kept(x.join(same, "items").select("id", "key", F.size("items").alias("n")), "rows")
    again = rows.select(F.col("id").alias("id2"), F.col("key").alias("key2"))
    apart = pairs.join(rows.select("id", "key"), "key").join(again, "key2").select("id", "id2", "shared", "total")
    equal = rows.join(again, F.col("key") == F.col("key2")).filter("id < id2").select("id", "id2", F.col("n").alias("shared"), F.col("n").alias("total"))
    return apart.union(equal).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "shared", "total")


def single_edits(names: DataFrame, name: str) -> DataFrame:
    """``a, b, kind`` (a < b) of each two different names one edit apart: the kind of edit that makes b of a, a letter
    exchanged (sub), inserted (ins) or left out (del). Names that are equal but for the letter at one place are one group, which
    never holds more of them than there are letters; a longer name meets a shorter one by what is left without a letter. Each
    pair is found once."""
    n = names.select(F.col(name).alias("a")).filter("a is not null").distinct()
    without = lambda i: F.concat(F.col("a").substr(F.lit(1), i - 1), F.col("a").substr(i + 1, F.length("a")))
    places = F.sequence(F.lit(1), F.length("a"))
    same = n.filter("a <> ''").select("a", F.explode(places).alias("i")).groupBy(without(F.col("i")).alias("key"), "i").agg(F.collect_list("a").alias("same")).filter("size(same) > 1")
    sub = same.select(F.explode("same").alias("a"), "same").select("a", F.explode("same").alias("b")).filter("a < b").withColumn("kind", F.lit("sub"))
    sizes = F.broadcast(n.select((F.length("a") + 1).alias("size")).distinct())  # as many as there are lengths
    longer = n.withColumn("size", F.length("a")).join(sizes, "size", "left_semi").filter("a <> ''")
    longer = longer.select(F.col("a").alias("long"), F.explode(F.array_distinct(F.transform(places, without))).alias("a"))
    # exploded rows count as one in Spark's estimate, which would broadcast them
    more = longer.hint("merge").join(n, "a").select(F.least("a", "long").alias("a"), F.greatest("a", "long").alias("b"), F.when(F.col("a") < F.col("long"), "ins").otherwise("del").alias("kind"))
    return sub.select("a", "b", "kind").unionByName(more)


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first character in which two texts differ; one behind the shorter one, if it starts the other."""
    equal = F.transform(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1)))
    at = F.array_position(equal, F.lit(False))
    return F.when(at == 0, F.least(F.length(a), F.length(b)) + 1).otherwise(at).cast("int")


def variant_proposals(entities: DataFrame, contrasts: DataFrame, particles: DataFrame) -> DataFrame:
    """``pattern, ids, names, prototype, conf``: entities (``id, name, aliases, chapters``) that may be one. Names that are
    equal in normal form (0.8); normal forms one edit apart (a particle 0.8, a letter more or less 0.6, another letter 0.5; at
    most 0.45 without a chapter in common; never where the letters are a pair of ``contrasts`` ``x, y``); an alias in common
    (0.6). ``particles`` has the column ``letter``."""
    e = kept(entities.select("id", "name", "aliases", "chapters", nm.normal_name(F.col("name")).alias("norm")), "entities")
    short = lambda names: F.array_sort(names, lambda p, q: F.when(F.length(p) != F.length(q), F.length(p) - F.length(q)).when(p < q, -1).when(p > q, 1).otherwise(0))[0]
    ids = F.array_sort(F.collect_set("id")).alias("ids")
    names = F.array_sort(F.collect_set("name")).alias("names")
    norm = e.groupBy("norm").agg(ids, names).filter("size(names) > 1").select(F.lit("norm").alias("pattern"), "ids", "names", short(F.col("names")).alias("prototype"), F.lit(0.8).alias("conf"))
    alias = e.select("id", "name", F.explode("aliases").alias("alias")).withColumn("alias", nm.normal_name(F.col("alias")))
    alias = alias.groupBy("alias").agg(ids, names).filter("size(ids) > 1").select(F.lit("alias").alias("pattern"), "ids", "names", F.col("names")[0].alias("prototype"), F.lit(0.6).alias("conf"))
    # normal forms one edit apart have a form in common with one letter left out
    forms = e.select(F.col("norm").alias("p")).filter(F.length("p") >= 3).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("p")), lambda i: F.concat(F.col("p").substr(F.lit(1), i - 1), F.col("p").substr(i + 1, F.length("p"))))
    keyed = forms.select("p", F.explode(F.array_distinct(F.array_append(cut, F.col("p")))).alias("key"))
    near = keyed.join(keyed.withColumnRenamed("p", "q"), "key").filter("p < q").select("p", "q").distinct().filter(F.levenshtein("p", "q", 1) == 1)
    at = first_difference(F.col("p"), F.col("q"))
    more = F.length("q") - F.length("p")
    near = near.withColumn("x", F.when(more <= 0, F.col("p").substr(at, F.lit(1))).otherwise("")).withColumn("y", F.when(more >= 0, F.col("q").substr(at, F.lit(1))).otherwise(""))
    both_ways = contrasts.select("x", "y").union(contrasts.select("y", "x"))
    near = near.join(sized(both_ways.distinct()), ["x", "y"], "left_anti")
    letter = particles.agg(F.collect_set("letter").alias("letters"))
    near = near.join(F.broadcast(letter))  # one row
    particle = F.array_contains("letters", F.col("x")) | F.array_contains("letters", F.col("y"))
    near = near.select("p", "q", F.when(particle, 0.8).when(more != 0, 0.6).otherwise(0.5).alias("conf"))
    one, two = e.select("id", "name", "chapters", F.col("norm").alias("p")), e.select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("chapters").alias("chapters2"), F.col("norm").alias("q"))
    pairs = near.join(one, "p").join(two, "q")
    conf = F.when(F.arrays_overlap(F.coalesce("chapters", F.array()), F.coalesce("chapters2", F.array())), F.col("conf")).otherwise(F.least(F.lit(0.45), F.col("conf")))
    pair_names = F.array_sort(F.array("name", "name2"))
    typo = pairs.select(F.lit("typo").alias("pattern"), F.array_sort(F.array("id", "id2")).alias("ids"), pair_names.alias("names"), short(pair_names).alias("prototype"), conf.alias("conf"))
    return norm.unionByName(alias).unionByName(typo)
