"""Dataset curation: duplicates, similarity joins, splits, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.prng import uniform
from .checkpoints import saved, stored
from .dealing import text_batches
from .ranks import placed
from .similar_texts import similar_texts
from .similarity import greatest_similarity, similar_pairs

__all__ = ["greatest_similarity", "similar_pairs"]


def exact_groups(rows: DataFrame, key: str, item: str) -> DataFrame:
    """key, size and first item of the keys that occur twice or more."""
    return rows.groupBy(key).agg(F.count("*").alias("size"), F.min(item).alias("first")).filter("size > 1")


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, found by an aggregate and not by sorting groups."""
    first = rows.groupBy(*key).agg(F.min(order).alias(order))
    return rows.join(first, [*key, order], "left_semi")


def conflicting_keys(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return rows.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("n")).filter("low < high").select(key, "n")


def without_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """All rows of conflicting keys dropped."""
    return rows.join(conflicting_keys(rows, key, label).select(key), key, "left_anti")


def conflict_log(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Rows whose label differs from that of the key's first row, which is the one kept."""
    first = rows.groupBy(key).agg(F.min_by(label, order).alias("kept_label"), F.min(order).alias("kept"))
    return rows.join(first, key).filter(F.col(label) != F.col("kept_label")).select(order, key, label, "kept", "kept_label")


def duplicate_accounting(rows: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """Rows in conflicts, exact duplicates (same text and label) and near duplicates (same key only) of the rest."""
    clean = without_conflicts(rows, key, label)
    groups = clean.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(text, label)).alias("forms"))
    rest = groups.agg(F.coalesce(F.sum(F.col("n") - F.col("forms")), F.lit(0)).alias("exact"), F.coalesce(F.sum(F.col("forms") - 1), F.lit(0)).alias("near"), F.count("*").alias("kept"))
    lost = conflicting_keys(rows, key, label).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("conflicts"))
    return rest.crossJoin(F.broadcast(lost)).select("conflicts", "exact", "near", "kept")


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words that have a blank at both ends; a word shorter than n counts once."""
    words = F.transform(F.filter(F.split(T.collapse(F.lower(text)), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(word: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))

    # a word of up to n characters is its own gram of the shortest length, and of no longer one
    def grams(n: int) -> Column:
        long = words if n == low else F.filter(words, lambda w: F.length(w) >= n)
        return F.flatten(F.transform(long, lambda w: of(w, n)))

    each = [grams(n) for n in range(low, high + 1)]
    return F.concat(*each)


def hashed_grams(text: Column) -> Column:
    """``char_grams`` as 64-bit hashes, which are shorter to move."""
    return F.transform(char_grams(text), lambda x: F.xxhash64(x))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tfidf(rows: DataFrame, item: str, terms: Column, fitted_on: DataFrame | None = None) -> DataFrame:
    """item, term, weight: (1 + ln tf) times smooth idf, each item of length one.

    ``fitted_on`` has columns term, df and n (as ``frequencies`` gives them)
    where the weights come from other rows. Else df is kept, too.
    """
    counted = rows.select(item, F.explode(terms).alias("term")).groupBy(item, "term").agg(F.count("*").alias("tf"))
    table = fitted_on
    if table is None:
        # tf is looked at so that both uses of ``counted`` share its exchange
        df = counted.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
        table = df.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    weighed = counted.join(table, "term").withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    # a window over one text's terms
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(item)))
    return weighed.select(item, "term", (F.col("w") / length).alias("weight"), *([] if fitted_on is not None else ["df"]))


def frequencies(rows: DataFrame, item: str, terms: Column, among: DataFrame | None = None) -> DataFrame:
    """term, df and n (all rows) of the terms of ``rows``, or of those that ``among`` (distinct terms) has."""
    n = rows.agg(F.count("*").alias("n"))
    each = rows.select(item, F.explode(F.array_distinct(terms)).alias("term"))
    df = (each if among is None else each.join(among, "term", "left_semi")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n))


def components(nodes: DataFrame, edges: DataFrame, item: str) -> DataFrame:
    """item, component (its least item) of all nodes; edges are (a, b).

    Labels go to the least of the neighbours' and then jump to their label's
    label, so rounds grow with the logarithm of the longest path. Each round
    ends in a checkpoint, in the shared folder that the session names.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = nodes.select(F.col(item).alias("node"), F.col(item).alias("label"))
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, now["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        then = saved(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        now = then.select("node", "label")
        if not then.filter(F.col("label") != F.col("was")).head(1):
            return now.select(F.col("node").alias(item), F.col("label").alias("component"))


def greedy_victims(pairs: DataFrame, item: str, original: DataFrame) -> DataFrame:
    """Items to drop: pairs by falling similarity, the later or non-original of each unless one is gone already. Two originals both stay.

    ``pairs``: a, b, similarity. ``original``: item, is_original. What goes
    through a pair is known beforehand, so an item goes if the other of one of
    its pairs is still there when that pair's turn comes. A pair is settled once
    no open pair before it can take its stayer, and void once a settled one has
    taken it. Each round settles all such pairs at once; rounds grow with the
    longest chain of pairs in which each waits for the one before, not with
    the items of a component.
    """
    named = pairs
    for side in ("a", "b"):
        named = named.join(original.select(F.col(item).alias(side), F.col("is_original").alias(f"original_{side}")), side)
    first = F.col("original_b") & ~F.col("original_a")
    turn = F.struct((-F.col("similarity")).alias("s"), "a", "b")
    waiting = named.filter("not (original_a and original_b)").select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("stays"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("goes"), turn.alias("turn"))
    waiting, gone = saved(waiting.distinct()), None
    while waiting.head(1):
        earliest = waiting.groupBy(F.col("goes").alias("stays")).agg(F.min("turn").alias("at"))
        judged = saved(waiting.join(earliest, "stays", "left").withColumn("settled", F.coalesce(F.col("turn") < F.col("at"), F.lit(True))))
        taken = saved(judged.filter("settled").groupBy("goes").agg(F.min("turn").alias("at")))
        gone = taken.select(F.col("goes").alias(item)) if gone is None else gone.union(taken.select("goes"))
        lost = taken.select(F.col("goes").alias("stays"), F.col("at").alias("lost_at"))
        # void: the stayer is gone before; needless: the goer is gone before
        rest = judged.filter("not settled").drop("at").join(lost, "stays", "left").join(taken, "goes", "left")
        waiting = saved(rest.filter((F.col("lost_at").isNull() | (F.col("turn") < F.col("lost_at"))) & (F.col("at").isNull() | (F.col("turn") < F.col("at")))).select("stays", "goes", "turn"))
    return gone.distinct() if gone is not None else pairs.select(F.col("a").alias(item)).limit(0)


def corrected(rows: DataFrame, corrections: DataFrame, key: str, label: str) -> DataFrame:
    """Labels replaced where both the key and the old label are in the correction table (key, old, new)."""
    table = corrections.select(F.col(key), F.col("old").alias(label), "new")
    return rows.join(table, [key, label], "left").withColumn(label, F.coalesce("new", label)).drop("new")


def missing_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Null or blank values by column."""
    blank = [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in columns]
    return rows.agg(*blank).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "missing"))


def contract_errors(rows: DataFrame, text: str, label: str, allowed: list[str], least: int, most: int) -> DataFrame:
    """check, label, n of every broken rule: blank texts, unknown and missing labels, duplicates, class sizes."""
    names = rows.sparkSession.createDataFrame([(x,) for x in allowed], "label string")
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    known = F.col("label").isin(allowed)
    rule = lambda df, name: df.select(F.lit(name).alias("check"), "label", F.col("n").cast("long").alias("n"))
    empty = rows.filter(F.coalesce(F.trim(text), F.lit("")) == "").agg(F.lit(None).cast("string").alias("label"), F.count("*").alias("n")).filter("n > 0")
    again = rows.groupBy(T.dedup_key(F.col(text)).alias("k")).agg(F.count("*").alias("c")).filter("c > 1").agg(F.lit(None).cast("string").alias("label"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).filter("n > 0")
    parts = [rule(empty, "empty"), rule(again, "duplicate"), rule(counts.filter(~known), "unknown_label"), rule(names.join(counts, "label", "left_anti").withColumn("n", F.lit(0)), "missing_label"), rule(counts.filter(known & (F.col("n") < least)), "too_few"), rule(counts.filter(known & (F.col("n") > most)), "too_many")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """n, share, the ratio of the largest class to the smallest, and inverse-frequency weights (if the ratio is over 1.5)."""
    every = Window.partitionBy()
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    ratio = F.max("n").over(every) / F.min("n").over(every)
    return counts.select(label, "n", ratio.alias("ratio"), F.when(ratio > 1.5, F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).otherwise(1.0).alias("weight"))


def word_statistics(rows: DataFrame, text: str, *by: str) -> DataFrame:
    n = T.word_count(F.col(text))
    return rows.groupBy(*by).agg(F.min(n).alias("min_words"), F.avg(n).alias("mean_words"), F.max(n).alias("max_words"))


def split_exact(rows: DataFrame, item: str, by: str, fractions: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """A split in which each class has its exact share: places in a hash order, cut at half-even rounded counts.

    Items get places by ranges of the order; the items at the cuts, a few for
    each class, then meet the rows, which aren't sorted. Rows of one item are
    on one side.
    """
    edges = [sum(share for _, share in fractions[: k + 1]) for k in range(len(fractions) - 1)]
    u = uniform(seed, F.col(item))
    places = placed(rows.select(F.col(by).alias("_class"), F.col(item).alias("_item"), u.alias("_u")), ["_class"], [F.col("_u"), F.col("_item")])
    at = lambda edge: F.max(F.when(F.col("k") == F.bround(F.col("n") * edge), F.struct("_u", "_item")))
    cuts = places.groupBy("_class").agg(*(at(edge).alias(f"_cut{k}") for k, edge in enumerate(edges)))
    joined = rows.join(cuts, F.col(by).eqNullSafe(F.col("_class")))
    own = F.struct(u.alias("_u"), F.col(item).alias("_item"))
    side = F.lit(fractions[-1][0])
    for k in reversed(range(len(edges))):
        side = F.when(own <= F.col(f"_cut{k}"), fractions[k][0]).otherwise(side)
    return joined.select(*rows.columns, side.alias("split"))


def split_groups(rows: DataFrame, group: str, fractions: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """A split in which no group is on two sides: groups in a hash order, cut by their number."""
    names = split_exact(rows.select(group).distinct().withColumn("_all", F.lit(1)), group, "_all", fractions, seed).drop("_all")
    return rows.join(names, group)


def capped(rows: DataFrame, by: str, most: int, item: str, protected: Column, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each class where enough of it isn't protected; the others go in a hash order."""
    order = [~F.coalesce(protected, F.lit(False)), uniform(seed, F.col(item)), F.col(item)]
    return placed(rows.withColumn("_protected", protected), [by], order, "_k", "_n").filter((F.col("_k") <= most) | F.col("_protected")).drop("_k", "_n", "_protected")


def linked_within(rows: DataFrame, text: str, by: str, item: str, least: float) -> DataFrame:
    """item, by, component: rows of a class are linked at a cosine of ``least`` or more of character grams, weighed over all rows.

    Texts that only differ in form have the same grams and are compared once.
    """
    text_batches(rows.sparkSession)
    with_text = T.with_dedup_key(rows.select(item, by, text), text, "form").select(item, by, F.md5("form").alias("key"), "form")
    keyed = saved(with_text.drop("form"))
    first = saved(keyed.groupBy(by, "key").agg(F.min(item).alias("first"), F.count("*").alias("copies")))
    if keyed.groupBy(item).count().filter((F.col("count") > 1) | F.col(item).isNull()).head(1):
        forms = stored(with_text.groupBy(by, "key").agg(F.min(item).alias("first"), F.count("*").alias("copies"), F.first("form").alias("form")))
    else:
        # an item names one row, so only the first of each form brings its text
        forms = T.with_dedup_key(rows.select(F.col(item).alias("first"), text).join(first, "first"), text, "form").drop(text)
    pairs = similar_texts(forms, "first", "form", least, by, "copies")
    found = components(first.select(F.col("first").alias(item)), pairs, item)
    named = first.join(found.withColumnRenamed(item, "first"), "first").select(F.col(by).alias("_by"), F.col("key").alias("_key"), "component")
    return keyed.join(named, F.col(by).eqNullSafe(F.col("_by")) & (F.col("key") == F.col("_key"))).select(item, by, "component")


def leakage_safe_split(rows: DataFrame, component: str, by: str, item: str, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """Whole components of a class go to one side: the largest first, to test, then validation while they have room, else train."""
    sizes = rows.groupBy(by, component).agg(F.count("*").alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = group["n"].sum()
        room = {"test": round(total * test), "validation": round(total * validation)}
        out = []
        for row in group.sort_values(["n", component], ascending=[False, True]).itertuples():
            side = next((x for x, r in room.items() if row.n <= r), "train")
            if side in room:
                room[side] -= row.n
            out.append(side)
        return group.sort_values(["n", component], ascending=[False, True]).assign(split=out)[[by, component, "split"]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (by, component))
    # a group holds a row for each component of a class, not its texts
    return rows.join(sizes.groupBy(by).applyInPandas(run, f"{kinds}, split string"), [by, component])


def split_overlap(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Distinct keys that two splits share."""
    keys = rows.select(key, F.col(split).alias("s")).distinct()
    return keys.withColumnRenamed("s", "a").join(keys.withColumnRenamed("s", "b"), key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def hash_sample(rows: DataFrame, item: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of their id: the same ones on any partitioning."""
    return rows.orderBy(uniform(seed, F.col(item)), item).limit(n)
