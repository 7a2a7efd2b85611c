"""Mix sources to target weights by a multivariate-hypergeometric splitting tree; Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._common import WORD, running_total, staged

# Blocks of all sources together, about 80 MB as arrays: the bound of what is broadcast.
MOST_BLOCKS = 1 << 21
_SHIFT = 8
_PLACES = 1 << 40


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, brought down; right to about 1e-11."""
    x = n.cast("double") + 1.0
    product = F.lit(1.0)
    for i in range(_SHIFT):
        product = product * (x + float(i))
    y = x + float(_SHIFT)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def _hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``population``, by inversion of the uniform number ``u``.

    Terms further than ten standard deviations from the mean are left out; their weight is under 1e-20.
    """
    lowest = F.greatest(F.lit(0).cast("long"), drawn + marked - population)
    highest = F.least(marked, drawn)
    share = F.coalesce(F.try_divide(marked.cast("double"), population.cast("double")), F.lit(0.0))
    mean = drawn * share
    spread = 10 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share))) + 10
    first = F.greatest(lowest, F.floor(mean - spread).cast("long"))
    last = F.least(highest, F.ceil(mean + spread).cast("long"))
    constant = (
        _log_factorial(marked) + _log_factorial(population - marked) + _log_factorial(drawn)
        + _log_factorial(population - drawn) - _log_factorial(population)
    )

    def term(acc: Column, x: Column) -> Column:
        log = (
            constant - _log_factorial(x) - _log_factorial(marked - x) - _log_factorial(drawn - x)
            - _log_factorial(population - marked - drawn + x)
        )
        return F.struct(
            (acc["sum"] + F.exp(log)).alias("sum"),
            F.when(acc["sum"] <= u, x).otherwise(acc["x"]).alias("x"),
        )

    start = F.struct(F.lit(0.0).alias("sum"), first.alias("x"))
    return F.aggregate(F.sequence(first, last), start, term, lambda acc: acc["x"])


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _left_counts(seed: int, level: int, half: Column):
    """One step of the draw of a left half: its count of the next source."""

    def step(acc: Column, marked: Column) -> Column:
        u = _uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(acc["out"]))
        drawn = half - F.aggregate(acc["out"], F.lit(0).cast("long"), lambda a, k: a + k)
        return F.struct(
            (acc["population"] - marked).alias("population"),
            F.concat(acc["out"], F.array(_hypergeometric(acc["population"], marked, drawn, u))).alias("out"),
        )

    return step


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Split exact block quotas among shards: one row (node, quotas array) in, 2^k rows out.

    Each node's blocks are cut in two halves; the left half's count of each source is drawn from the
    multivariate hypergeometric distribution, one source after the other, and the right half gets the
    rest. Column sums stay exact and leaves differ by at most one block.
    """
    levels = max(0, (shards - 1).bit_length())
    tree = quotas
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, k: a + k)
        half = F.floor(total / 2).cast("long")
        start = F.struct(total.alias("population"), F.array().cast("array<long>").alias("out"))
        left = F.aggregate("quotas", start, _left_counts(seed, level, half), lambda acc: acc["out"])
        split = staged(tree.withColumn("left", left), f"tree-{level}")
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.transform(F.arrays_zip("quotas", "left"), lambda z: z["quotas"] - z["left"]).alias("quotas"),
            ),
        )
        tree = split.select(F.explode(halves).alias("half")).select("half.*")
    return tree


def targets(sizes: DataFrame, weights: tuple[int, ...], ratio: float, cap: float) -> DataFrame:
    """(source, source_size, weight, target): ``ratio`` of all words shared by weight, capped per source.

    Sources stand in code-point order, null last, and get the weights in turn. A source whose share is
    above ``cap`` times its size gets just that, and the rest is shared anew among the others. The table
    has one row per source, so its windows have no partition.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    repeated = F.array(*[F.lit(float(w)) for w in weights])
    sources = sizes.withColumn("rank", rank).withColumn(
        "weight", F.element_at(repeated, (F.col("rank") % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    level = cap * F.col("source_size") / F.col("weight")
    before = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = ratio * F.sum("source_size").over(everything)
    filled = sources.withColumn("level", level).withColumn(
        "rate",
        (budget - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward),
    )
    # The rate that holds is that of the first source whose share stays under its cap.
    under = F.when(F.col("level") > F.col("rate"), F.struct("level", "rank"))
    rate = F.min_by("rate", under).over(everything)
    return filled.withColumn("_rate", rate).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("level") <= F.coalesce("_rate", F.col("level")), cap * F.col("source_size"))
        .otherwise(F.col("_rate") * F.col("weight")).alias("target"),
    )


def schedule(sources: DataFrame, blocks: int, shards: int, seed: int, tree_seed: int) -> DataFrame:
    """Drawn blocks: source, length (words of a block), block, epoch, shard, position in the shard.

    The words of each source, its documents in order of a hash, are cut into at most ``blocks`` blocks.
    Each epoch draws blocks in an order of its own, all of them but in the last epoch. The splitting
    tree says how many blocks of each source every shard gets; shards take disjoint stretches of the
    drawn order and shuffle what they got.
    """
    sized = sources.where("source_size > 0").withColumn("length", F.ceil(F.col("source_size") / blocks).cast("long"))
    sized = sized.withColumn("n", F.ceil(F.col("source_size") / F.col("length")).cast("long")).withColumn(
        "quota", F.round(F.col("target") / F.col("length")).cast("long")
    )
    sized = staged(sized, "quotas")
    in_order = F.sort_array(F.collect_list(F.struct("rank", "quota")))
    root = sized.agg(F.transform(in_order, lambda x: x["quota"]).alias("quotas"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    ranks = root.select("ranks")
    leaves = shard_quotas(root.select(F.lit(1).cast("long").alias("node"), "quotas"), shards, tree_seed)
    dealt = leaves.crossJoin(F.broadcast(ranks)).select(
        "node", F.posexplode(F.arrays_zip("ranks", "quotas")).alias("_i", "z")
    ).select("node", F.col("z.ranks").alias("rank"), F.col("z.quotas").alias("quota"))
    until = F.sum("quota").over(Window.partitionBy("rank").orderBy("node"))
    ends = dealt.withColumn("until", until).groupBy("rank").agg(F.sort_array(F.collect_list("until")).alias("ends"))
    drawn = sized.select(
        "source", "rank", "length", "n", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block")
    )
    epochs = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("quota") - 1, F.lit(0)) / F.col("n")).cast("long"))
    drawn = drawn.withColumn("epoch", F.explode(epochs))
    order = Window.partitionBy("rank", "epoch").orderBy(F.xxhash64(F.lit(seed), "rank", "epoch", "block"), "block")
    drawn = drawn.withColumn("draw", F.col("epoch") * F.col("n") + F.row_number().over(order) - 1).where("draw < quota")
    drawn = drawn.join(F.broadcast(ends), "rank").withColumn(
        "shard", F.size(F.filter("ends", lambda e: e <= F.col("draw")))
    )
    inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "rank", "draw"), "rank", "draw")
    return drawn.select(
        "source", "rank", "length", "block", "epoch", "shard", (F.row_number().over(inside) - 1).alias("position")
    )


def mix(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    ratio: float = 1.5,
    cap: float = 2.0,
    blocks: int = 4096,
    shards: int = 16,
    seed: int = 42,
    carry: tuple[str, ...] = (),
    tree_seed: int | None = None,
) -> DataFrame:
    """ident, source, the ``carry`` columns, size, source_size, target, taken (words) and kept (pieces).

    kept is an array of structs (first, last, times, places): words of the document, both ends included, how
    often the mix takes them, one for each block that the document meets, and the shard and position in it of each time;
    times is at most ``cap`` rounded up. taken sums it. How many blocks of a source each shard gets is what the splitting tree
    draws (by ``tree_seed``, else ``seed``): another tree deals the same blocks to other shards. Each source's taken words differ from its target by one block at most, a
    block being a ``blocks``-th of the source. Words are runs without ASCII white space; a null or empty
    text has none and is taken 0 times; a null source is a source of its own, last in order. Repeated
    rows are documents of their own. The order depends on the ident and the text alone, so reruns agree.
    An empty table gives an empty result. The table of sources is broadcast with at most MOST_BLOCKS
    blocks; more sources mean fewer blocks each.
    """
    light = docs.select(
        F.col(ident).alias("_id"),
        F.col(source).cast("string").alias("_src"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(ident).cast("string"), F.col(text)).alias("_h"),
        *carry,
    )
    light = staged(light, "sizes")
    sizes = light.groupBy(F.col("_src").alias("source")).agg(F.sum("_size").alias("source_size"))
    per_source = staged(targets(sizes, weights, ratio, cap), "targets")
    each = max(1, min(blocks, MOST_BLOCKS // max(1, per_source.count())))
    drawn = schedule(per_source, each, shards, seed, seed if tree_seed is None else tree_seed)
    # Shard and position in one number, to keep the broadcast table small.
    place = F.col("shard") * F.lit(_PLACES) + F.col("position")
    places = drawn.groupBy("rank", "length", "block").agg(F.sort_array(F.collect_list(place)).alias("places"))
    found = places.groupBy("rank", "length").agg(
        F.map_from_entries(F.collect_list(F.struct("block", "places"))).alias("found")
    )
    number = F.ceil(F.col("source_size") / F.col("length")).cast("long")
    listed = F.transform(
        F.sequence(F.lit(0).cast("long"), number - 1),
        lambda b: F.coalesce(F.element_at("found", b), F.array().cast("array<long>")),
    )
    table = per_source.join(found, "rank", "left").select(
        F.col("source").alias("_of"), "source_size", "target",
        F.coalesce("length", F.lit(1).cast("long")).alias("_length"),
        F.when(F.col("length").isNotNull(), listed).alias("_places"),
    )
    table = staged(table, "drawn-blocks")
    started = running_total(light, "_src", ["_h", "_size"], "_size", "_start")
    joined = started.join(F.broadcast(table), F.col("_src").eqNullSafe(F.col("_of")))
    first, last = F.col("_start"), F.col("_start") + F.col("_size") - 1
    met = F.transform(
        F.sequence(F.floor(first / F.col("_length")), F.floor(last / F.col("_length"))),
        lambda b: F.struct(
            (F.greatest(first, b * F.col("_length")) - first).alias("first"),
            (F.least(last, (b + 1) * F.col("_length") - 1) - first).alias("last"),
            F.coalesce(F.get("_places", b.cast("int")), F.array().cast("array<long>")).alias("places"),
        ),
    )
    met = F.transform(
        met,
        lambda k: F.struct(
            k["first"], k["last"], F.size(k["places"]).cast("long").alias("times"),
            F.transform(
                k["places"],
                lambda p: F.struct(F.floor(p / _PLACES).cast("int").alias("shard"), F.pmod(p, F.lit(_PLACES)).alias("position")),
            ).alias("places"),
        ),
    )
    kind = "array<struct<first:bigint,last:bigint,times:bigint,places:array<struct<shard:int,position:bigint>>>>"
    kept = F.when(F.col("_size") > 0, met).otherwise(F.array()).cast(kind)
    taken = F.aggregate("kept", F.lit(0).cast("long"), lambda a, k: a + (k["last"] - k["first"] + 1) * k["times"])
    return joined.withColumn("kept", kept).select(
        F.col("_id").alias(ident), F.col("_src").alias(source), *carry, F.col("_size").alias("size"),
        "source_size", "target", taken.alias("taken"), "kept",
    )


def mixed_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as its words are taken.

    The n-th copy of a document holds the words that are taken n times or more; it is the whole text as it
    stands where that is all of them, and the words joined by one space otherwise. Documents of
    which no word is taken, those without words included, are left out.
    """
    row = "_row_of_mix"
    # Names of the input may clash with those of the mix, so these have names of their own.
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    kept = mix(numbered, ident, text, source, carry=(row,), **options).select(row, F.col("size").alias("_size_of_mix"), F.col("kept").alias("_kept_of_mix"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))

    def copy(n: int) -> Column:
        pieces = F.filter("_kept_of_mix", lambda k: k["times"] >= n)
        cut = F.flatten(
            F.transform(pieces, lambda k: F.slice(words, (k["first"] + 1).cast("int"), (k["last"] - k["first"] + 1).cast("int")))
        )
        whole = F.forall("_kept_of_mix", lambda k: k["times"] >= n)
        return F.when(whole, F.col(text)).when(F.size(pieces) > 0, F.array_join(cut, " "))

    most = int(-(-float(options.get("cap", 2.0)) // 1))
    joined = numbered.join(kept.where("_size_of_mix > 0"), row)
    copies = F.array_compact(F.array(*[copy(n) for n in range(1, most + 1)]))
    return joined.withColumn("_copy_of_mix", F.explode(copies)).select(
        *[F.col("_copy_of_mix").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )
