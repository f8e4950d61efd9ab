"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this, and no source's target exceeds this many times its size.
REPEATS = 3
#: Divisors tried at once when the apportionment's divisor is narrowed down.
TRIES = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, work: Workspace, *order: Column) -> DataFrame:
    """df with column `place`, its 0-based position in the order; sorted in ranges, so no task sees all rows."""
    ranged = work.save(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__n", within).join(before, "__part").withColumn("place", F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source_size, weight) with `target`: weights share the total; a target stops at REPEATS times its source's size and the excess is shared again by weight."""
    full = F.lit(float(REPEATS)) * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    level = 0.0
    while True:
        stopped = full <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(stopped, full)).alias("used"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        new = (float(total) - (got.used or 0.0)) / got.open if got.open else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(full.cast("double"), F.lit(level) * F.col("weight")))


def sainte_lague(parties: DataFrame, seats: int, votes: str, cap: str, order: list[str], work: Workspace) -> DataFrame:
    """parties with `quota`: `seats` seats by the highest quotients votes / (2k + 1), none above its cap.

    The k-th seat has quotient votes / (2k - 1), so at divisor d a party holds floor(votes / (2d) + 1/2)
    of the quotients >= d. The divisor is narrowed by aggregates over all parties, many divisors at
    once; ties at the last seats go by `order`.
    """
    held = lambda d: F.least(F.col(cap), F.floor(F.col(votes) / (F.lit(2.0) * d) + F.lit(0.5)).cast("long"))
    top = parties.agg(F.max(votes).alias("v"), F.sum(F.when(F.col(votes) > 0, F.col(cap))).alias("n")).first()
    seats = min(seats, top.n or 0)
    if seats <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    high, low = top.v * 2.0, top.v / (4.0 * seats + 4.0)
    while parties.agg(F.sum(held(F.lit(low))).alias("n")).first().n < seats:
        low /= 1024
    for _ in range(16):
        ratio = (low / high) ** (1 / (TRIES + 1))
        tries = [high * ratio ** (k + 1) for k in range(TRIES)]
        each = parties.select(votes, cap, F.posexplode(F.array(*map(F.lit, tries))).alias("k", "d"))
        found = dict(each.groupBy("k").agg(F.sum(held(F.col("d")))).collect())
        fits = [k for k in range(TRIES) if found[k] <= seats]
        over = [k for k in range(TRIES) if found[k] > seats]
        high, low = (tries[max(fits)] if fits else high), (tries[min(over)] if over else low)
        if high / low < 1 + 1e-14 or (fits and found[max(fits)] == seats):
            break
    base = work.save(parties.withColumn("quota", held(F.lit(high))))
    left = seats - (base.agg(F.sum("quota").alias("n")).first().n or 0)
    if left <= 0:
        return base
    # the seats whose quotients lie within the last bracket: fewer than there are ties in it
    more = held(F.lit(low * (1 - 1e-12))) - F.col("quota")
    next_seats = base.where(more > 0).select(*[F.col(c).alias(f"__{c}") for c in order], F.explode(F.sequence(F.lit(1), more)).alias("k"), (F.col(votes) / (2 * (F.col("quota") + F.col("k")) - 1)).alias("q"))
    won = next_seats.orderBy(F.desc("q"), *[f"__{c}" for c in order]).limit(int(left)).groupBy(*[f"__{c}" for c in order]).agg(F.count(F.lit(1)).alias("extra"))
    same = [base[c].eqNullSafe(won[f"__{c}"]) for c in order]
    return base.join(won, same, "left").withColumn("quota", F.col("quota") + F.coalesce("extra", F.lit(0))).drop("extra", *[f"__{c}" for c in order])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shard_rows: int = 5_000, seed: int = 0, extra: list[str] = (), work: Workspace | None = None) -> DataFrame:
    """For each row: doc_id, size, source, source_size, target, taken, first (the first word taken within the last round, 0-based), place (its order), and `extra` columns.

    Sources by code point, null last, weigh `weights` in turn. Each source's rows are dealt to shards
    by a hash, so a hot source has many shards; within a shard rows stand in a seeded order and their
    words form one stream cut into blocks of equally many words. Sainte-Lague gives each (source,
    shard) a whole number of blocks; full rounds take every block, and the last round takes the run
    of blocks from a seeded start, cyclically. A row with no words takes none. Rows that repeat are
    rows of their own. An empty table, or one without words, gives taken = 0 throughout. What it returns
    is read from `work`, which a caller may clear once that is written.
    """
    work = work or Workspace(docs.sparkSession, "mixing")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text_hash).alias("draw"), *extra)
    rows = work.save(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = numbered(sources, work, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    sources = work.save(targets(work.save(sources.withColumn("weight", weight).drop("place"))))
    least = sources.where("target > 0").agg(F.min("target").alias("m")).first().m
    # a block is 1 % of the smallest target, 1 to 64 words: no source is far from its target by rounding
    block = int(min(64, max(1, (least or 0) // 100)))

    known = sources.select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("n_rows") / shard_rows).alias("n_shards"))
    rows = rows.join(known, rows.source.eqNullSafe(known.s)).drop("s")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("draw"), F.lit(seed + 1)), F.col("n_shards")))
    order = [F.col("draw"), F.col("doc_id"), F.col("size")]
    ahead = Window.partitionBy("source", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = work.save(rows.withColumn("end", F.sum("size").over(ahead)))
    cells = rows.groupBy("source", "shard").agg(F.max("end").alias("cell_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    cells = cells.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(0.0))
    cells = work.save(cells.withColumn("blocks", F.ceil(F.col("cell_size") / block)).withColumn("cap", F.col("blocks") * REPEATS))
    wanted = cells.agg(F.sum("votes").alias("v")).first().v or 0.0
    cells = sainte_lague(cells, round(wanted / block), "votes", "cap", ["source", "shard"], work)
    cells = cells.select(F.col("source").alias("cs"), F.col("shard").alias("ch"), "blocks", "cell_size", "quota")
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    rest = F.col("quota") - F.col("rounds") * F.col("blocks")
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "cs", "ch"), F.greatest(F.col("blocks"), F.lit(1)))
    cells = work.save(cells.withColumn("rounds", rounds).withColumn("rest", rest).withColumn("a", begin * block).withColumn("b", F.col("a") + F.col("rest") * block))
    rows = rows.join(cells, rows.source.eqNullSafe(cells.cs) & (rows.shard == cells.ch))
    start, end, length = F.col("end") - F.col("size"), F.col("end"), F.col("blocks") * block
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(start, a))
    straight, around = overlap(F.col("a"), F.col("b")), overlap(F.lit(0), F.col("b") - length)
    first = F.when(straight > 0, F.greatest(start, F.col("a")) - start).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("rounds") * F.col("size") + straight + around).cast("long").alias("taken"), first.cast("long").alias("first"), *extra)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row once for every full round, and once more with the words of its last, partial round.

    Rows that the mix leaves out go: those without words (null and empty texts), and those past their source's
    target. Text that is cut keeps the bytes between the words it keeps; n_chars, where it exists, follows.
    All columns stay, whatever their names. Rows alike in all columns are taken each for itself.
    """
    columns = docs.columns
    work, own = Workspace(docs.sparkSession, "mixed"), Workspace(docs.sparkSession, "mixing")
    key = F.xxhash64(F.coalesce("text", F.lit("")), *[F.col("`" + c + "`").cast("string") for c in columns if c not in ("doc_id", "text")])
    docs = docs.withColumn("__key", key)
    taken = mix(docs, extra=["__key"], work=own, **options).where("taken > 0")
    taken = work.save(taken.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), F.col("taken").alias("__taken"), F.col("first").alias("__first"), F.col("size").alias("__size")))
    own.clear()
    # rows alike in all columns are one here, and each of them that the mix takes meets it
    one = docs.dropDuplicates(["doc_id", "__key"])
    out = one.join(taken, one["doc_id"].eqNullSafe(F.col("__id")) & (one["__key"] == F.col("__k")))
    full, part = F.floor(F.col("__taken") / F.col("__size")), F.col("__taken") % F.col("__size")
    out = out.withColumn("__full", full).withColumn("__part", part)
    copies = F.concat(F.array_repeat(F.lit(False), F.col("__full").cast("int")), F.array_repeat(F.lit(True), F.when(F.col("__part") > 0, 1).otherwise(0)))
    out = out.withColumn("__cut", F.explode(copies))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)), (F.least("__first", F.col("__size") - F.col("__part")) + 1).cast("int"), F.col("__part").cast("int"))
    text = F.when(F.col("__cut"), F.array_join(words, "")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col("`" + c + "`") for c in columns])
