"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all get the same expected number of copies, target /
source size. Its whole part is taken as it is; the fractional parts are rounded
together: two documents meet, mass (probability x size) moves at random from
one to the other until one of them is integral, and the other goes on. Mass is
conserved, so a source ends within one document of its target. Residuals climb
a reduction tree: each node folds a bounded number of documents and passes one
residual up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 64
MAX_REPEAT = 3
#: A unit above 1 / HEAVY of its source is heavy.
HEAVY = 100
WEIGHTS = (1, 2, 3)
#: Sources whose statistics are sent to all tasks; beyond this they are joined by shuffle.
BROADCAST_SOURCES = 100_000
EPSILON = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _running(rows: DataFrame, order: list, sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with their place in ``order`` (a total one) from 0, and the sums of columns over all rows before.

    The rows are dealt to tasks by ranges; one row per range is summed up in one
    task, the rest within the ranges.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.save(ranged, name)
    each = {"place": F.lit(1)} | {k: F.col(c) for k, c in sums.items()}
    over = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    per = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in each.items()))
    per = per.select("_range", *(over(f"_{k}", Window.orderBy("_range")).alias(f"_{k}") for k in each))
    inner = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(per), "_range").select(*rows.columns, *((F.col(f"_{k}") + over(c, inner)).alias(k) for k, c in each.items()))


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, weights: tuple = WEIGHTS) -> DataFrame:
    """Per source of (source, size): source_size, n_docs, target, tree (its place in code-point order).

    Weights go round in code-point order of the sources, null last. Targets
    share the total by weight, none above ``max_repeat`` times its source. A
    source is capped if its cap / weight lies below the level that is left for
    the rest, which is found with running sums in order of that ratio. An empty
    table has no sources.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    name = F.col("source").asc_nulls_last()
    per = _running(per, [name], {}, scratch, "named").withColumnRenamed("place", "tree")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(cycle, (F.pmod("tree", F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, all_weight = (v or 0 for v in per.agg(F.sum("source_size"), F.sum("weight")).first())
    per = _running(per, [F.col("ratio"), name], {"caps": "cap", "weights": "weight"}, scratch, "ratios")
    level = (F.lit(total) - F.col("caps")) / (F.lit(float(all_weight)) - F.col("weights"))
    per = scratch.save(per.withColumn("capped", F.col("ratio") < level), "capped")
    caps, capped_weight = (v or 0 for v in per.filter("capped").agg(F.sum("cap"), F.sum("weight")).first())
    rest = (total - caps) / (all_weight - capped_weight) if all_weight > capped_weight else 0.0
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest)
    return per.select("source", "source_size", "n_docs", target.alias("target"), F.col("tree").cast("bigint").alias("tree"))


#: A unit: rows with the same doc_id and size in one source. ``unit`` is a hash that orders and draws; it needs not be unique.
UNIT = "unit:bigint,doc_id:bigint,size:bigint"
_KEY = ("unit", "doc_id", "size")


def _key(x: Column) -> list[Column]:
    return [x[c].alias(c) for c in _KEY]


def _same_unit(left: DataFrame, right: DataFrame) -> Column:
    """Rows of one unit; ``tree`` says which source."""
    return (left["unit"] == right["unit"]) & (left["tree"] == right["tree"]) & (left["size"] == right["size"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not wherever it is mentioned."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(a: Column, b: Column, seed: int) -> Column:
    """Both documents after their meeting, each with its share f of one more copy, as an array."""
    room = lambda x: x["mass"] * (1 - x["f"])
    held = lambda x: x["mass"] * x["f"]
    snap = lambda v: F.when(v < EPSILON, 0.0).when(v > 1 - EPSILON, 1.0).otherwise(v)
    after = lambda x, d: F.struct(*_key(x), x["mass"].alias("mass"), snap(x["f"] + d / x["mass"]).alias("f"))
    ways = F.struct(F.least(room(a), held(b)).alias("up"), F.least(room(b), held(a)).alias("down"))
    # a rises with a chance of down / (up + down), so that each share keeps its expectation
    rises = lambda w: _uniform(a["unit"], b["unit"], F.lit(seed)) * (w["up"] + w["down"]) < w["down"]
    moved = _let(ways, lambda w: F.when(rises(w), w["up"]).otherwise(-w["down"]))
    return _let(moved, lambda d: F.array(after(a, d), after(b, -d)))


def _fold(units: Column, seed: int) -> Column:
    """Fold an array of (unit, doc_id, size, mass, f): the settled ones in ``done`` and at most one residual in ``open``."""
    kind = f"array<struct<{UNIT},mass:double,f:double>>"
    state = f"struct<done:{kind},open:{kind}>"
    start = F.expr(f"cast(named_struct('done', array(), 'open', array()) as {state})")
    integral = lambda x: (x["f"] == 0) | (x["f"] == 1)

    def step(acc, x):
        met = F.when(F.size(acc["open"]) == 0, F.array(x)).otherwise(_pair(acc["open"][0], x, seed))
        split = lambda m: F.struct(F.concat(acc["done"], F.filter(m, integral)).alias("done"), F.filter(m, lambda y: ~integral(y)).alias("open"))
        return _let(met, split).cast(state)

    return F.aggregate(units, start, step)


def _fold_heavy(units: Column, target: Column, size: Column, max_repeat: int, seed: int) -> Column:
    """Heavy units against all smaller ones of their source, largest first.

    Each meets what is left of the source as one composite: the unit becomes
    integral by chance, and the composite takes the mass over, which keeps its
    expectation. Where the chance would leave more or less than the rest can
    make up for, the other way is taken.
    """
    kind = f"array<struct<{UNIT},copies:bigint>>"
    state = f"struct<t:double,s:double,done:{kind}>"
    start = F.struct(target.alias("t"), size.cast("double").alias("s"), F.expr(f"cast(array() as {kind})").alias("done")).cast(state)

    def step(acc, x):
        ratio = F.least(F.greatest(acc["t"] / acc["s"], F.lit(0.0)), F.lit(float(max_repeat)))
        bounds = F.struct(
            ratio.alias("r"), F.floor(ratio + EPSILON).alias("base"),
            F.ceil((acc["t"] - max_repeat * (acc["s"] - x["mass"])) / x["mass"] - EPSILON).alias("low"), F.floor(acc["t"] / x["mass"] + EPSILON).alias("high"),
        )
        chance = lambda b: b["base"] + (_uniform(x["unit"], F.lit(seed)) < b["r"] - b["base"]).cast("int")
        pick = lambda b: F.least(F.greatest(chance(b), F.least(b["low"], b["base"] + 1)), F.greatest(b["high"], b["base"])).cast("bigint")
        after = lambda c: F.struct((acc["t"] - c * x["mass"]).alias("t"), (acc["s"] - x["mass"]).alias("s"), F.concat(acc["done"], F.array(F.struct(*_key(x), c.alias("copies")))).alias("done")).cast(state)
        return _let(_let(bounds, pick), after)

    return F.aggregate(units, start, step)


def _flip(x: Column, seed: int) -> Column:
    """The last residual of a source has nobody to meet: its hash decides."""
    return _uniform(x["unit"], F.lit(seed), F.lit("last")) < x["f"]


def _chunks(level: DataFrame, seed: int) -> DataFrame:
    """Fold the units x of each (tree, node) in an order that reruns share."""
    folded = level.groupBy("tree", "node").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return folded.select("tree", "node", _fold(F.col("xs"), seed).alias("y"))


def _settled(folded: DataFrame) -> DataFrame:
    return folded.select("tree", F.explode("y.done").alias("x")).select("tree", *_key(F.col("x")), (F.col("x.f") == 1).alias("more"))


def _reduce_tree(level: DataFrame, most: int, fan_in: int, seed: int, scratch: Scratch, name: str) -> DataFrame:
    """(tree, unit, doc_id, size, more) for the units x of ``level``: level by level, fan_in residuals meet in a node, up to one per tree."""
    settled, nodes, height = [], max(1, most), 0
    while True:
        folded = scratch.save(_chunks(level, seed + height), f"{name}{height}")
        settled.append(_settled(folded))
        level = folded.select("tree", F.floor(F.col("node") / fan_in).alias("node"), F.explode("y.open").alias("x"))
        nodes, height = -(-nodes // fan_in), height + 1
        if nodes <= 1:
            break
    last = level.select("tree", *_key(F.col("x")), _flip(F.col("x"), seed).alias("more"))
    return reduce(DataFrame.unionByName, [*settled, last])


def mix_decisions(docs: DataFrame, seed: int = 7, max_repeat: int = MAX_REPEAT, weights: tuple = WEIGHTS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, size, rows, source_size, target, copies: one row per distinct (doc_id, source, size).

    * Rows with the same doc_id, source and size are one unit: all get the same copies.
    * Null text has size 0; a document without words gets the whole part of its
      expected copies and one more with the chance of the rest, by hash.
    * Null source is a source of its own; with no words at all every target is 0.
    * The random choices are hashes of ids and ``seed``: reruns agree.

    Units above 1 / HEAVY of their source (fewer than HEAVY of them) are rounded
    first; the others then share what is left of the target, so that the last
    residual is a light unit. Expectations are kept but where a unit is so heavy
    that the rest of its source could not make up for it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = units.withColumns({"unit": F.xxhash64("doc_id", "source", "size", F.lit(seed)), "mass": F.col("size") * F.col("rows")})
    units = scratch.save(units, "units")
    targets = scratch.save(source_targets(units.select("source", F.col("mass").alias("size")), max_repeat, weights).withColumnRenamed("source", "_source"), "targets")
    n_sources, most = targets.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    small = n_sources <= BROADCAST_SOURCES
    side = F.broadcast(targets) if small else targets
    units = units.join(side, units["source"].eqNullSafe(F.col("_source"))).drop("_source")

    def shares(df: DataFrame, ratio: Column) -> DataFrame:
        df = df.withColumn("expected", F.least(F.greatest(F.coalesce(ratio, F.lit(0.0)), F.lit(0.0)), F.lit(float(max_repeat))))
        whole = F.floor(F.col("expected") + EPSILON)
        return df.withColumns({"whole": whole, "f": F.greatest(F.col("expected") - whole, F.lit(0.0))})

    is_heavy = F.col("mass") * HEAVY > F.col("source_size")
    each = F.struct((-F.col("mass")).alias("order"), *_KEY, F.col("mass").cast("double").alias("mass"))
    heavy = units.filter(is_heavy).groupBy("tree").agg(F.array_sort(F.collect_list(each)).alias("xs"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    heavy = scratch.save(heavy.select("tree", _fold_heavy(F.col("xs"), F.col("target"), F.col("size"), max_repeat, seed).alias("y")), "heavy")
    chosen = heavy.select("tree", F.explode("y.done").alias("x")).select("tree", *_key(F.col("x")), "x.copies")
    left = heavy.select("tree", F.col("y.t").alias("left_target"), F.col("y.s").alias("left_size"))
    heavy = units.filter(is_heavy)
    heavy = heavy.join(chosen, _same_unit(heavy, chosen)).select(*(heavy[c] for c in heavy.columns), "copies")

    light = units.filter(~is_heavy).join(F.broadcast(left) if small else left, "tree", "left")
    light = shares(light, F.try_divide(F.coalesce("left_target", "target"), F.coalesce("left_size", "source_size")))
    x = F.struct(*_KEY, F.col("mass").cast("double").alias("mass"), "f").alias("x")
    free = (F.col("f") > EPSILON) & (F.col("size") > 0)
    # Level 0: hash chunks of about fan_in units of one source.
    chunk = F.pmod(F.xxhash64("unit", F.lit("chunk")), F.greatest(F.ceil(F.col("n_docs") / fan_in), F.lit(1)))
    more = _reduce_tree(light.filter(free).select("tree", chunk.alias("node"), x), most or 1, fan_in, seed, scratch, "level")
    by_hash = F.when((F.col("f") > EPSILON) & (F.col("size") == 0), _uniform(F.col("unit"), F.lit("empty")) < F.col("f"))
    light = light.join(more, _same_unit(light, more), "left").select(*(light[c] for c in light.columns), "more").withColumn("copies", F.col("whole") + F.coalesce("more", by_hash, F.lit(False)).cast("int"))
    columns = ["doc_id", "source", "size", "rows", "source_size", "target", "copies"]
    return light.select(columns).unionByName(heavy.select(columns))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: one row per row of ``docs``."""
    out = mix_decisions(docs, **options).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_corpus(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all its columns, with each row repeated as often as the mix takes it (0 times: dropped).

    Rows with the same doc_id, source and number of words are repeated alike; a
    null doc_id or source is a value of its own, a null text has no words, and
    an empty table stays empty.
    """
    made = mix_decisions(docs, **options).filter("copies > 0").select(*(F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "source", "size", "copies")))
    same = docs["doc_id"].eqNullSafe(F.col("__mix_doc_id")) & docs["source"].eqNullSafe(F.col("__mix_source")) & (n_words(docs["text"]) == F.col("__mix_size"))
    repeated = docs.join(made, same).select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))).alias("__mix_copy"))
    return repeated.drop("__mix_copy")
