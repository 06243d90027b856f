"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in order of code points, null last, have the weights 3, 1, 2, 3, 1, 2, ...; together
they shall give ``RATIO`` times all words.  A source's target is capped at ``CAP`` times its
size, and what it can't give is shared among the others by weight until none is above: the
fixed point is min(CAP * size, weight * level), whose level follows from running sums over the
sources in order of size by weight.

Each source's documents fall into at most ``BLOCKS`` blocks by a hash of source, id and text; blocks are permuted by a seeded
hash.  The mix takes whole passes over a source, then a prefix of its permuted blocks.  In the block in which
the target falls, the documents are ordered by a second hash: exact sums over ranges of it narrow the place down to a few
documents, and one of them gives its first words only, so each source gives its target rounded to words.

The blocks taken are dealt to output shards by a binary tree.  At each node one number a source is drawn, from the
multivariate hypergeometric law: how many of its blocks go left.  The draw is by selection sampling source by source, and exact.  The
leaves' quotas then take disjoint runs of each source's permuted blocks, and rows are dealt by shard in one exchange and
shuffled within it by a hash.

DataFrame operations only.  The texts are read once for the plan, which keeps numbers only; windows run over the blocks
of one source, over sources, and over ranges, never over rows.  Tables of blocks are bounded by ``BLOCKS`` a source.

Defined cases: null and empty texts have size 0 and are never taken; a source without words
has target 0; an empty table gives an empty result; rows that agree in all columns are interchangeable, but each counts,
also where equal ids and texts come from several sources.  Extra columns, of any name, pass through ``mix`` and are ignored by the report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._arrow import kept, partitions, shared_folder

WEIGHTS = (3, 1, 2)
RATIO = 1.5
CAP = 2
BLOCK_ROWS = 256
BLOCKS = 4096  # of a source at most, so blocks grow with a large source
RANGE_BITS = 12
OUTPUT_SHARDS = 16
RUN = 1024  # copies of a row that are dealt together
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"


def n_words(text: Column) -> Column:
    """Words of a text: places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """Adds nth, weight and target to one row a source (source, source_size); the windows here run over sources, not rows."""
    alls = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_need = Window.orderBy("need", "nth").rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    out = sizes.withColumn("nth", F.row_number().over(ordered)).withColumn("weight", F.element_at(weights, ((F.col("nth") - 1) % len(WEIGHTS) + 1).cast("int")))
    out = out.withColumn("need", cap * F.col("source_size") / F.col("weight"))
    out = out.withColumn("wanted", ratio * F.sum("source_size").over(alls))
    # the level if this source and all with more need are not capped, and those before are
    capped = F.coalesce(F.sum(cap * F.col("source_size")).over(by_need), F.lit(0.0))
    left = F.sum("weight").over(alls) - F.coalesce(F.sum("weight").over(by_need), F.lit(0.0))
    out = out.withColumn("level_here", F.greatest((F.col("wanted") - capped) / left, F.lit(0.0)))
    out = out.withColumn("level", F.min(F.when(F.col("level_here") <= F.col("need"), F.struct("need", "nth", "level_here"))).over(alls)["level_here"])
    return out.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("weight") * F.col("level"), cap * F.col("source_size").cast("double")))))


def _hashed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """source, h (of source, id and text), ident (of all columns that can be hashed) and ``more`` of each row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() not in ("variant", "void")]
    h = F.xxhash64(text("source"), F.col("source").isNull(), text("doc_id"), F.coalesce("text", F.lit("")), F.lit(seed))
    return docs.select(F.col("source").alias("source"), h.alias("h"), F.xxhash64(*whole, F.lit(seed)).alias("ident"), *more)


def _by_source(rows: DataFrame, other: DataFrame, how: str, *columns: str) -> DataFrame:
    """Joined by source, a null one too, and ``columns``; of ``other``, only its other columns."""
    keys = ["source", *columns]
    renamed = other.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in other.columns])
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in columns:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return rows.join(renamed, on, how).drop(*[f"_{c}" for c in keys])


@dataclass
class Plan:
    rows: DataFrame  # of each document: source, doc_id, size, h, ident
    sources: DataFrame  # source, nth, source_size, target, n_blocks, passes, rest
    blocks: DataFrame  # source, block, shard (null: not taken), whole, edge
    cuts: DataFrame  # source, and of the document in which its target falls: doc_id, size, place, m (rows), full (of them taken once more), part (words of another)


def _place(seed: int) -> Column:
    """Where a document lies in its block: an order that no two different documents share; the first number is not negative."""
    return F.struct(F.shiftrightunsigned(F.xxhash64("h", F.lit(seed + 2)), 1).alias("a"), F.col("h").alias("b"), F.col("ident").alias("c"))


def _block() -> Column:
    return F.pmod(F.col("h"), F.col("n_blocks"))


def make_plan(docs: DataFrame, seed: int = 17, block_rows: int = BLOCK_ROWS, shards: int = OUTPUT_SHARDS) -> Plan:
    folder = shared_folder(docs.sparkSession)
    rows = kept(_hashed(docs, seed, F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size")), folder, "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = source_targets(sizes).select(
        "source", "nth", "source_size", "target", F.least(F.ceil(F.col("source_rows") / block_rows), F.lit(BLOCKS)).cast("long").alias("n_blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
    )
    sources = kept(sources.withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size")), folder, "sources")

    some = _by_source(rows, sources, "inner").withColumn("block", _block())
    blocks = some.groupBy("source", "block").agg(F.sum("size").alias("block_size"), *[F.max(c).alias(c) for c in ("nth", "rest", "passes")])
    permuted = Window.partitionBy("nth").orderBy(F.xxhash64("nth", "block", F.lit(seed + 1)), "block")
    blocks = blocks.withColumn("start", F.sum("block_size").over(permuted) - F.col("block_size"))
    blocks = blocks.withColumn("taken", (F.col("start") < F.col("rest")) | (F.col("passes") > 0))
    blocks = kept(blocks.withColumn("rank", F.sum(F.col("taken").cast("long")).over(permuted) - 1), folder, "sums")  # taken ones are numbered from 0
    quotas = split_quotas(blocks.where("taken").groupBy("nth").agg(F.count("*").alias("n")), seed, shards)
    upto = F.sum("quota").over(Window.partitionBy("nth").orderBy("shard"))
    runs = quotas.select(F.col("nth").alias("_nth"), "shard", upto.alias("_upto"), (upto - F.col("quota")).alias("_from"))
    hit = F.col("taken") & (F.col("nth") == F.col("_nth")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_upto"))
    end = F.col("start") + F.col("block_size")
    edge = (F.col("start") < F.col("rest")) & (end > F.col("rest"))
    blocks = blocks.join(runs, hit, "left").select("source", "block", "shard", (end <= F.col("rest")).alias("whole"), edge.alias("edge"), (F.col("rest") - F.col("start")).alias("left"))
    blocks = kept(blocks, folder, "blocks")

    # the document in which a source's target falls: first its range of places, then the document
    inside = _by_source(some, blocks.where("edge").select("source", "block", "left"), "inner", "block").withColumn("place", _place(seed))
    inside = kept(inside.withColumn("range", F.shiftright(F.col("place.a"), 63 - RANGE_BITS)).select("source", "nth", "doc_id", "size", "place", "range", "left"), folder, "inside")

    def fallen(sums: DataFrame, order: str) -> DataFrame:
        upto = F.sum("words").over(Window.partitionBy("nth").orderBy(order))
        return sums.withColumn("before", upto - F.col("words")).where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("words")))

    ranges = fallen(inside.groupBy("source", "nth", "range").agg(F.sum("size").alias("words"), F.max("left").alias("left")), "range")
    near = _by_source(inside.drop("left"), ranges.select("source", "range", (F.col("left") - F.col("before")).alias("left")), "inner", "range")
    each = near.groupBy("source", "nth", "place").agg(F.first("doc_id").alias("doc_id"), F.max("size").alias("size"), F.count("*").alias("m"), F.max("left").alias("left"))
    cut = fallen(each.withColumn("words", F.col("m") * F.col("size")), "place").withColumn("here", F.col("left") - F.col("before"))
    cuts = kept(cut.select("source", "doc_id", "size", "place", "m", F.expr("here div size").alias("full"), F.expr("here % size").alias("part")), folder, "cuts")
    return Plan(rows, sources, blocks, cuts)


def split_quotas(counts: DataFrame, seed: int, shards: int) -> DataFrame:
    """(nth, shard, quota) from how many blocks each source has (nth, n): a tree of draws over one row of numbers.

    Shards' quotas differ by one at most.  A node draws for one source after another how many of its blocks go left: each
    block does with the probability of the places left there to the blocks left, which is the multivariate hypergeometric law.
    """
    long, longs = "long", "array<long>"
    every = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("nth", F.col("n").cast(long).alias("n")))).alias("s"))
    nodes = every.select(F.lit(0).alias("first"), F.lit(shards).alias("many"), F.transform("s", lambda x: x["nth"]).alias("names"), F.transform("s", lambda x: x["n"]).alias("counts"))
    for level in range(max(0, (shards - 1).bit_length())):
        total = F.aggregate("counts", F.lit(0).cast(long), lambda a, n: a + n)
        half = F.expr("(many + 1) div 2")
        # shards that get one more than others come first, so the left side's places follow from the total
        places = F.expr("total div many") * half + F.least(F.expr("total % many"), half)
        nodes = nodes.withColumn("total", total).withColumn("half", half).withColumn("places", places.cast(long))

        def draw(a: Column, n: Column) -> Column:
            def one(b: Column, k: Column) -> Column:
                chance = F.pmod(F.xxhash64(F.lit(seed + 100), F.col("first"), F.lit(level), a["i"], k), F.lit(1 << 52)) / F.lit(float(1 << 52))  # noqa: B023
                left = (chance * b["blocks"] < b["places"]).cast(long)
                return F.struct((b["blocks"] - 1).alias("blocks"), (b["places"] - left).alias("places"), (b["got"] + left).alias("got"))

            each = F.when(n > 0, F.sequence(F.lit(1).cast(long), n)).otherwise(F.array().cast(longs))
            b = F.aggregate(each, F.struct(a["blocks"].alias("blocks"), a["places"].alias("places"), F.lit(0).cast(long).alias("got")), one)
            return F.struct(b["blocks"].alias("blocks"), b["places"].alias("places"), (a["i"] + 1).alias("i"), F.array_append(a["out"], b["got"]).alias("out"))

        zero = F.struct(F.col("total").alias("blocks"), F.col("places").alias("places"), F.lit(0).cast(long).alias("i"), F.array().cast(longs).alias("out"))
        nodes = nodes.withColumn("left", F.aggregate("counts", zero, draw)["out"])
        right = F.zip_with("counts", "left", lambda n, k: n - k)
        children = F.array(F.struct(F.col("first"), F.col("half").cast("int").alias("many"), F.col("left").alias("counts")), F.struct((F.col("first") + F.col("half")).cast("int").alias("first"), (F.col("many") - F.col("half")).cast("int").alias("many"), right.alias("counts")))
        nodes = nodes.select("names", F.explode(children).alias("c")).select("c.first", "c.many", "names", "c.counts").where("many > 0")
    each = nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("names", "counts")).alias("z"))
    return each.select(F.col("z.names").alias("nth"), "shard", F.col("z.counts").alias("quota"))


def _told(rows: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """Rows (source, h, ident, ...) with what the plan has for them: shard, passes, more (whether taken once more) and is_cut."""
    out = _by_source(rows, plan.sources.drop("nth", "rest"), "inner").withColumn("block", _block())
    out = _by_source(out, plan.blocks.drop("left"), "inner", "block").withColumn("place", _place(seed))
    out = _by_source(out, plan.cuts.select("source", F.col("place").alias("cut"), "m", "full", "part"), "left")
    before = F.coalesce(F.col("place") < F.col("cut"), F.lit(False))
    return out.withColumn("more", (F.col("whole") | (F.col("edge") & before)).cast("long")).withColumn("is_cut", F.col("edge") & F.coalesce(F.col("place") == F.col("cut"), F.lit(False)))


def mixing_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row a document: how many of its words the mix takes, and the shard of its block."""
    plan = make_plan(docs.select("doc_id", "text", "source"), seed)
    out = ("doc_id", "size", "source_size", "target", "taken", "shard")
    each = _told(plan.rows, plan, seed)
    plain = each.where("not is_cut").withColumn("taken", (F.col("passes") + F.col("more")) * F.col("size")).select(*out)
    # the one document a source that the target cuts, as often as it is there: numbered in runs, which are dealt
    cut = each.where("is_cut").groupBy("source", "place").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "shard", "passes", "m", "full", "part")])
    run = 4096
    runs = cut.withColumn("run", F.explode(F.expr(f"sequence(0L, (m - 1) div {run})"))).repartition(F.col("place"), F.col("run"))
    rows = runs.withColumn("k", F.explode(F.expr(f"sequence(run * {run}, least((run + 1) * {run}, m) - 1)")))
    extra = F.when(F.col("k") < F.col("full"), F.col("size")).when(F.col("k") == F.col("full"), F.col("part")).otherwise(0)
    return plain.unionByName(rows.withColumn("taken", (F.col("passes") * F.col("size") + extra).cast("long")).select(*out))


def _mixed(docs: DataFrame, seed: int, salts: int | None) -> DataFrame:
    """The mix as (row, _shard): each document as often as whole passes take it, and the one cut by the target with its first words.

    Each task holds rows of one shard only, shuffled; a shard is ``salts`` tasks, by default so many that all shuffle partitions have some.
    """
    plan = make_plan(docs, seed)
    rows = _told(_hashed(docs, seed, F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")), plan, seed).where(F.col("shard").isNotNull() & F.col("row.text").rlike(WORD))
    plain = rows.where("not is_cut")
    often = kept(plan.rows.groupBy("h", "ident").agg(F.count("*").alias("often")).where(F.col("often") > RUN), shared_folder(docs.sparkSession), "often")
    if not often.isEmpty():  # rows that are there very often: one stands for all, and is as often taken
        alike = plain.join(often, ["h", "ident"])
        alike = alike.groupBy("source", "place").agg(*[F.first(c).alias(c) for c in ("row", "shard", "h", "passes", "more", "often")])
        alike = alike.select("row", "shard", "h", (F.col("often") * (F.col("passes") + F.col("more"))).alias("whole"), F.lit(0).cast("long").alias("part"))
        plain = plain.join(often, ["h", "ident"], "left_anti")
    plain = plain.select("row", "shard", "h", (F.col("passes") + F.col("more")).alias("whole"), F.lit(0).cast("long").alias("part"))
    plain = plain if often.isEmpty() else plain.unionByName(alike)
    # equal rows that the target cuts: one stands for all
    cut = rows.where("is_cut").groupBy("source", "place").agg(*[F.first(c).alias(c) for c in ("row", "shard", "h", "passes", "m", "full", "part")])
    cut = cut.select("row", "shard", "h", (F.col("m") * F.col("passes") + F.col("full")).alias("whole"), "part")
    taken = plain.unionByName(cut).where("whole > 0 or part > 0")
    # one exchange by shard and salt, before passes multiply the rows; many copies of a row are dealt in runs
    salts = salts or max(1, -(-partitions(docs.sparkSession) // OUTPUT_SHARDS))
    taken = taken.withColumn("all", F.col("whole") + (F.col("part") > 0).cast("long")).withColumn("run", F.explode(F.expr(f"sequence(0L, (all - 1) div {RUN})")))
    cell = F.col("shard") * salts + F.pmod(F.xxhash64("h", "run", F.lit(seed + 4)), F.lit(salts)).cast("int")
    dealt = taken.withColumn("cell", cell).repartitionById(OUTPUT_SHARDS * salts, F.col("cell"))
    copies = dealt.withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN} + 1, least((run + 1) * {RUN}, all))")))
    cut_here = F.col("copy") > F.col("whole")
    first = F.array_join(F.slice(F.filter(F.split("row.text", SPACES), lambda w: w != ""), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    row = F.col("row").withField("text", F.when(cut_here, first).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut_here, F.length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    shuffled = copies.withColumn("local", F.xxhash64("h", "copy", F.lit(seed + 3))).sortWithinPartitions("cell", "local")
    return shuffled.select(row.alias("row"), F.col("shard").alias("_shard"))


def sharded_mix(docs: DataFrame, seed: int = 17, salts: int | None = None) -> DataFrame:
    """The mix and the ``shard`` of each row, in place of a column of that name."""
    return _mixed(docs, seed, salts).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "shard"], F.col("_shard").alias("shard"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix with the columns of ``docs``: a task or file that it makes holds rows of one shard, shuffled."""
    return _mixed(docs, seed, None).select("row.*")
