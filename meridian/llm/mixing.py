"""Mix sources to target weights: exact block quotas, split over the shards by a hypergeometric tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import discard, let, materialize, n_words, words

#: Rows of a source that share one running sum; bounds the window of a hot source.
ROWS_PER_BUCKET = 4096
#: Shards hold about so many words (one task each), and there are so many at least.
SHARD_WORDS = 20_000_000
LEAST_SHARDS = 16
BLOCKS_PER_SHARD = 64
#: Sources that are drawn one after the other; more are drawn as groups first.
CHUNK = 256


def source_targets(
    totals: DataFrame, share: float = 1.5, cycle: Sequence[int] = (3, 1, 2), most: int = 2
) -> DataFrame:
    """Words to take from each source: rows of ``totals(source, source_size)`` plus ``unit`` (its number), ``weight`` and ``target``.

    Sources in code-point order, null last, weigh ``cycle`` in turn and share ``share`` of all
    words; a target stops at ``most`` times its source, and what is over goes to the others by
    weight until none is above. Ranks come from a range sort with per-partition offsets, so
    many sources do not meet in one task; only three sums per round reach the driver.
    """
    ordered = materialize(
        totals.repartitionByRange(F.asc_nulls_last("source"))
        .sortWithinPartitions(F.asc_nulls_last("source"))
        .withColumn("at", F.monotonically_increasing_id())
        .withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("at"),
        "sources",
    )
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    weights = F.array(*[F.lit(w) for w in cycle])
    unit = F.col("before") + F.col("row")
    ranked = materialize(
        ordered.join(before, "part").select("source", "source_size", unit.alias("unit"), F.get(weights, (unit % len(cycle)).cast("int")).alias("weight")),
        "weights",
    )
    discard(ordered)
    all_words, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (all_words or 0)
    level, full = budget / (all_weight or 1), -1
    while True:
        capped = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        n, held, rest = ranked.agg(
            F.count_if(capped),
            F.coalesce(F.sum(F.when(capped, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or rest == 0:
            break
        level, full = (budget - held) / rest, n
    capped = most * F.col("source_size") <= F.lit(level) * F.col("weight")
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    targets = materialize(ranked.withColumn("target", target), "targets")
    discard(ranked)
    return targets


def _hash(*parts) -> Column:
    """Hex digest of ``parts``, which may be columns or constants."""
    return F.md5(F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]))


def _uniform(*parts) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.conv(F.substring(_hash(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _offsets(sums: DataFrame, buckets: int) -> DataFrame:
    """``sums(key, bucket, w)`` with ``offset``, the sum of w over the earlier buckets of the key, ROWS_PER_BUCKET at a time."""
    before = lambda *by: F.coalesce(
        F.sum("w").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
    )
    if buckets <= ROWS_PER_BUCKET:
        return sums.select("key", "bucket", before("key").alias("offset"))
    sums = sums.withColumn("group", F.floor(F.col("bucket") / ROWS_PER_BUCKET))
    groups = sums.groupBy("key", F.col("group").alias("bucket")).agg(F.sum("w").alias("w"))
    groups = _offsets(groups, -(-buckets // ROWS_PER_BUCKET)).select("key", F.col("bucket").alias("group"), F.col("offset").alias("outer"))
    inner = sums.select("key", "bucket", "group", before("key", "group").alias("inner"))
    return inner.join(groups, ["key", "group"]).select("key", "bucket", (F.col("outer") + F.col("inner")).alias("offset"))


def running_sum(rows: DataFrame, value: Column, count: int) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the earlier rows of the same ``key`` in the order of the hex digest ``order``.

    ``count`` rows are dealt to buckets by the digest; a bucket's rows are summed together and the sums of
    buckets are added up, so no key has to be sorted in one task.
    """
    buckets = max(1, -(-count // ROWS_PER_BUCKET))
    place = F.floor(F.conv(F.substring("order", 1, 12), 16, 10).cast("decimal(20,0)") * buckets / (1 << 48)).cast("long")
    rows = rows.withColumns({"bucket": place, "w": value})
    sums = _offsets(rows.groupBy("key", "bucket").agg(F.sum("w").alias("w")), buckets)
    within = Window.partitionBy("key", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("w").over(within), F.lit(0))
    return rows.join(sums, ["key", "bucket"]).withColumn("before", before.cast("long")).drop("bucket", "w", "offset")


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """The ``u`` quantile of the number of marked items among ``drawn`` out of ``total``.

    Sums the probabilities by their recurrence in log space, over the support within 12
    standard deviations of the mean (outside lies less than 1e-30). Built-in functions only.
    """
    N, K, n = (x.cast("double") for x in (total, marked, drawn))
    mean = n * K / N
    sd = F.sqrt(F.greatest(mean * (1 - K / N) * (N - n) / F.greatest(N - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0.0), n + K - N, F.floor(mean - 12 * sd - 12).cast("double")).cast("long")
    high = F.least(K, n, F.ceil(mean + 12 * sd + 12).cast("double")).cast("long")

    def over(x: Column) -> Column:  # log p(x+1) - log p(x)
        return F.ln(F.greatest((K - x) * (n - x), F.lit(1e-300))) - F.ln((x + 1) * (N - K - n + x + 1))

    def draw(support: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("top"))
        peak = F.aggregate(
            support,
            zero,
            lambda s, x: F.struct((s["lw"] + over(x)).alias("lw"), F.greatest(s["top"], s["lw"]).alias("top")),
        )["top"]

        def scaled(top: Column) -> Column:
            mass = F.aggregate(
                support,
                F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum")),
                lambda s, x: F.struct((s["lw"] + over(x)).alias("lw"), (s["sum"] + F.exp(s["lw"] - top)).alias("sum")),
            )["sum"]

            def find(m: Column) -> Column:
                found = F.aggregate(
                    support,
                    F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("x")),
                    lambda s, x: F.struct(
                        (s["lw"] + over(x)).alias("lw"),
                        (s["sum"] + F.exp(s["lw"] - top)).alias("sum"),
                        F.when((s["x"] < 0) & (s["sum"] + F.exp(s["lw"] - top) >= u * m), x).otherwise(s["x"]).alias("x"),
                    ),
                )["x"]
                return F.when(found < 0, high).otherwise(found)

            return let(m := mass, find)

        return let(peak, scaled)

    return F.when(N <= 0, F.lit(0).cast("long")).otherwise(let(F.sequence(low, high), draw))


def _draw_left(parts: DataFrame, units: int, seed: int, depth: int = 0) -> DataFrame:
    """``parts(lo, hi, left, unit, quota)`` with ``l``: how much of each unit's quota goes left when ``left`` of a node's blocks do.

    The multivariate hypergeometric law, one unit after the other; more than CHUNK units are
    drawn as groups of CHUNK first, so that no list grows with the number of sources.
    """
    node = ["lo", "hi", "left"]
    if units > CHUNK:
        group = F.floor(F.col("unit") / CHUNK)
        groups = parts.groupBy(*node, group.alias("unit")).agg(F.sum("quota").alias("quota"))
        above = _draw_left(groups, -(-units // CHUNK), seed, depth + 1).select("lo", "hi", F.col("unit").alias("group"), F.col("l").alias("left"))
        parts = parts.drop("left").withColumn("group", group).join(above, ["lo", "hi", "group"])
        node = [*node, "group"]
    nodes = parts.groupBy(*node).agg(
        F.sort_array(F.collect_list(F.struct("unit", "quota"))).alias("parts"), F.sum("quota").alias("held")
    )
    start = F.struct(
        F.col("held").alias("total"), F.col("left").alias("left"), F.array().cast("array<struct<unit:bigint,quota:bigint,l:bigint>>").alias("out")
    )

    def step(s: Column, p: Column) -> Column:
        x = hypergeometric(_uniform(seed, "tree", depth, F.col("lo"), F.col("hi"), p["unit"]), s["total"], p["quota"], s["left"])
        return let(
            x,
            lambda x: F.struct(
                (s["total"] - p["quota"]).alias("total"),
                (s["left"] - x).alias("left"),
                F.concat(s["out"], F.array(F.struct(p["unit"].alias("unit"), p["quota"].alias("quota"), x.alias("l")))).alias("out"),
            ),
        )

    return nodes.select("lo", "hi", F.explode(F.aggregate("parts", start, step)["out"]).alias("d")).select("lo", "hi", "d.*")


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Split exact block quotas ``(key, unit, blocks)`` over ``n_shards``: rows (key, shard, quota).

    ``unit`` numbers the sources from 0. Each level halves the shards of a node and draws how many
    blocks of each source go left from the multivariate hypergeometric law. Shards get equal
    numbers of blocks (at most one apart) and every quota is met exactly.
    """
    known = materialize(quotas.where("blocks > 0").select("key", F.col("unit").cast("long").alias("unit"), "blocks"), "quotas")
    units, total = known.agg(F.max("unit") + 1, F.sum("blocks")).first()
    state = known.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "unit", F.col("blocks").alias("quota"))
    upto = lambda shard: F.floor(shard.cast("decimal(20,0)") * (total or 0) / n_shards)
    width = n_shards
    while width > 1:
        width = (width + 1) // 2
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        left = (upto(mid) - upto(F.col("lo"))).cast("long")
        dealt = _draw_left(state.select("lo", "hi", left.alias("left"), "unit", "quota"), units or 0, seed)
        both = F.array(
            F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.col("l").alias("quota")),
            F.struct(mid.alias("lo"), F.col("hi").alias("hi"), (F.col("quota") - F.col("l")).alias("quota")),
        )
        state = dealt.select("unit", F.explode(both).alias("n")).select("n.lo", "n.hi", "unit", "n.quota").where("quota > 0")
        if (units or 0) > CHUNK:  # each level reads the one above twice
            state = materialize(state, "quotas")
    return state.join(known.select("key", "unit"), "unit").select("key", F.col("lo").alias("shard"), "quota")


PIECES = "array<struct<copy:int,words:bigint,block:bigint,shard:int>>"


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    n_shards: int | None = None,
    share: float = 1.5,
    cycle: Sequence[int] = (3, 1, 2),
    most: int = 2,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Choose what the mix takes, one row per document: id, source, size, source_size, target, taken (words, repeats counted)
    and pieces, an array of (copy, words, block, shard), and the columns of ``docs`` named in ``carry``.

    The documents of a source stand in the order of a digest of (seed, id, text); a block is the
    documents that begin in a stretch of that many words. A target is met in permuted blocks: all of
    them for each whole copy of the source, then blocks in the order of a seeded digest until the
    target is reached, of the last one the leading words only. So every document is taken whole 0 to
    ``most`` times but for one per source. The drawn blocks of all sources are dealt to the
    shards: the tree says how many of each source a shard gets, and each shard draws so many,
    disjoint from the others'. Shards (``n_shards``, else by SHARD_WORDS) and blocks follow the words taken.

    Running sums go bucket by bucket, so a source with a third of all rows is many tasks, and rows equal in
    everything are one row with a multiplicity until they are placed. Null texts and texts without
    words have size 0 and are never taken; null sources form one source that comes last; null
    ids are told apart by their texts; an empty table gives an empty mix.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    text = F.col(text_col).cast("string")
    order = _hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))
    kept = [F.struct(*carry).alias("carry")] if carry else []
    named = ["carry"] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), order.alias("order"), *kept)
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("key", key)
    rows = materialize(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(totals, share, cycle, most).withColumns({"key": key, "take": F.round("target").cast("long")}).drop("source")
    taken = targets.agg(F.sum("take")).first()[0] or 0
    n_shards = n_shards or max(LEAST_SHARDS, -(-taken // SHARD_WORDS))
    block = max(1, -(-taken // (n_shards * BLOCKS_PER_SHARD)))

    start = F.col("before") + F.col("nth") * F.col("size")
    placed = running_sum(rows, F.col("n") * F.col("size"), rows.count()).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = placed.select("id", "source", "key", "size", start.alias("start"), *named)
    placed = materialize(placed.withColumn("block", F.when(F.col("size") > 0, F.floor(F.col("start") / block))), "placed")
    discard(rows)

    blocks = placed.where("block is not null").groupBy("key", "block").agg(F.sum("size").alias("words"), F.min("start").alias("first"))
    blocks = blocks.join(targets.where("take > 0").select("key", "source_size", "take"), "key")
    blocks = materialize(blocks.withColumn("order", _hash(seed, "block", F.col("key"), F.col("block"))), "blocks")
    whole = F.floor(F.col("take") / F.col("source_size"))
    rest = F.col("take") - F.col("whole") * F.col("source_size") - F.col("before")
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("whole")),
        lambda c: F.struct(c.cast("int").alias("copy"), F.when(c < F.col("whole"), F.col("words")).otherwise(F.least(F.col("words"), rest)).alias("words")),
    )
    drawn = running_sum(blocks, F.col("words"), blocks.count()).withColumn("whole", whole)
    drawn = drawn.select("key", "block", "first", F.explode(F.filter(copies, lambda c: c["words"] > 0)).alias("c")).select("key", "block", "first", "c.*")
    drawn = materialize(drawn.withColumn("order", _hash(seed, "draw", F.col("key"), F.col("block"), F.col("copy"))), "drawn")
    quotas = drawn.groupBy("key").agg(F.count("*").alias("blocks")).join(targets.select("key", "unit"), "key")
    run = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = split_quotas(quotas, n_shards, seed).withColumn("from", F.coalesce(F.sum("quota").over(run), F.lit(0)))
    dealt = dealt.select("key", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("quota") - 1)).alias("before"))
    draws = running_sum(drawn, F.lit(1).cast("long"), drawn.count()).join(dealt, ["key", "before"])
    draws = draws.groupBy("key", "block").agg(
        F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("copy", "shard", "words"))).alias("draws")  # one entry per copy
    )
    draws = materialize(draws, "draws")
    for used in (blocks, drawn):
        discard(used)

    info = targets.select("key", "source_size", "target")
    wordless = placed.where("block is null").withColumn("pieces", F.array().cast(PIECES))
    parts = F.transform(
        F.coalesce("draws", F.array().cast("array<struct<copy:int,shard:int,words:bigint>>")),
        lambda d: F.struct(
            d["copy"].alias("copy"), F.least(F.col("size"), d["words"] - (F.col("start") - F.col("first"))).alias("words"),
            F.col("block").alias("block"), d["shard"].alias("shard"),
        ),
    )
    worded = placed.where("block is not null").join(draws, ["key", "block"], "left")
    worded = worded.withColumn("pieces", F.filter(parts, lambda p: p["words"] > 0).cast(PIECES)).select(wordless.columns)
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return worded.unionByName(wordless).join(info, "key").select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", total.alias("taken"), "pieces", *[F.col(f"carry.{c}") for c in carry]
    )


def shuffle_key(seed: int, shard: Column, *row: Column) -> Column:
    """Where a piece stands in the shuffled order of its shard."""
    return F.xxhash64(F.lit(seed), shard, *row)


def take_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, one space apart."""
    return F.array_join(F.slice(words(text), F.lit(1), n.cast("int")), " ")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """With ``drawn``: copy:block:shard of every piece that the mix takes of the document, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    spelled = F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("copy", "block", "shard")])), ",")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", spelled.alias("drawn"))


OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS unit,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM s),
r AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
         sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS held,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS rest,
         1.5 * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weight
  FROM w),
c AS (
  SELECT coalesce(max(held) FILTER (ok), 0) AS held, coalesce(min(rest) FILTER (ok), any_value(all_weight)) AS rest,
         any_value(budget) AS budget
  FROM (SELECT *, ratio * (rest + weight) <= budget - (held - 2 * source_size) AS ok FROM r)),
t AS (
  SELECT w.source, coalesce('s' || w.source, 'n') AS key, unit, source_size, weight,
         CASE WHEN 2 * source_size <= CAST((budget - held) AS DOUBLE) / rest * weight THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST((budget - held) AS DOUBLE) / rest * weight END AS target
  FROM w, c),
tt AS (SELECT *, CAST(round(target) AS BIGINT) AS take FROM t),
n AS (
  SELECT shards, greatest(1, CAST(ceil(taken / (shards * {BLOCKS_PER_SHARD})) AS BIGINT)) AS block_words
  FROM (SELECT sum(take) AS taken, greatest({LEAST_SHARDS}, CAST(ceil(sum(take) / {SHARD_WORDS}) AS BIGINT)) AS shards FROM tt)),
p AS (
  SELECT d.doc_id, size, o, tt.key, tt.source_size, tt.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY tt.key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN tt ON d.source IS NOT DISTINCT FROM tt.source),
pb AS (SELECT *, CASE WHEN size > 0 THEN start // (SELECT block_words FROM n) END AS block FROM p),
b AS (SELECT key, block, sum(size) AS words, min(start) AS first FROM pb WHERE block IS NOT NULL GROUP BY key, block),
bo AS (
  SELECT b.*, tt.source_size, take, take // tt.source_size AS whole,
         take - take // tt.source_size * tt.source_size - coalesce(sum(words) OVER (
           PARTITION BY b.key ORDER BY md5('0|block|' || b.key || '|' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM b JOIN tt ON b.key = tt.key WHERE take > 0),
dr AS (
  SELECT key, block, first, copy, words, row_number() OVER (PARTITION BY key ORDER BY md5('0|draw|' || key || '|' || block || '|' || copy)) - 1 AS rank
  FROM (SELECT key, block, first, copy, CASE WHEN copy < whole THEN words ELSE least(words, rest) END AS words
        FROM bo, unnest(range(0, whole + 1)) AS r(copy)) WHERE words > 0),
q AS (SELECT unit, tt.key, count(*) AS quota FROM dr JOIN tt ON dr.key = tt.key GROUP BY unit, tt.key),
al AS (SELECT sum(quota) AS total, count(*) AS k, list(unit ORDER BY unit) AS units, list(quota ORDER BY unit) AS quotas FROM q),
tree AS (
  SELECT 0::BIGINT AS lo, (SELECT shards FROM n) AS hi, 0::BIGINT AS j, total::BIGINT AS held,
         (((SELECT shards FROM n) + 1) // 2 * total // (SELECT shards FROM n))::BIGINT AS go, quotas::BIGINT[] AS quotas, []::BIGINT[] AS ls FROM al
  UNION ALL
  SELECT CASE WHEN s = 2 THEN (lo + hi + 1) // 2 ELSE lo END, CASE WHEN s = 1 THEN (lo + hi + 1) // 2 ELSE hi END,
         CASE WHEN s = 0 THEN j + 1 ELSE 0 END,
         CASE WHEN s = 0 THEN held - quotas[j + 1] ELSE list_sum(kids)::BIGINT END,
         CASE s WHEN 0 THEN go - x WHEN 1 THEN ((lo + (lo + hi + 1) // 2 + 1) // 2 * total // shards - lo * total // shards)::BIGINT
                ELSE (((lo + hi + 1) // 2 + hi + 1) // 2 * total // shards - (lo + hi + 1) // 2 * total // shards)::BIGINT END,
         CASE WHEN s = 0 THEN quotas ELSE kids END, CASE WHEN s = 0 THEN ls || [x] ELSE []::BIGINT[] END
  FROM (
    SELECT *, CASE WHEN s = 0 THEN low + least(len(list_filter(range(1, len(ps) + 1), lambda i: list_sum(ps[1:i]) < uu * list_sum(ps))), high - low) END::BIGINT AS x
    FROM (
      SELECT *, list_transform(lps, lambda v: exp(v - list_max(lps))) AS ps
      FROM (
        SELECT *, list_transform(range(low, high + 1), lambda v: -lgamma(v + 1) - lgamma(kk - v + 1) - lgamma(go - v + 1) - lgamma(held - kk - go + v + 1)) AS lps
        FROM (
          SELECT *, greatest(0, go + kk - held, CAST(floor(mean - 12 * sd - 12) AS BIGINT))::BIGINT AS low, least(kk, go, CAST(ceil(mean + 12 * sd + 12) AS BIGINT))::BIGINT AS high
          FROM (
            SELECT *, CAST(go AS DOUBLE) * kk / nn AS mean,
                   sqrt(greatest(CAST(go AS DOUBLE) * kk / nn * (1 - CAST(kk AS DOUBLE) / nn) * (nn - go) / greatest(nn - 1, 1), 0)) AS sd
            FROM (
              SELECT tree.*, s, total, shards, coalesce(tree.quotas[j + 1], 0) AS kk, greatest(held, 1) AS nn,
                     CAST('0x' || substr(md5('0|tree|0|' || lo || '|' || hi || '|' || coalesce(units[j + 1], 0)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS uu,
                     CASE WHEN s = 1 THEN ls WHEN s = 2 THEN list_transform(range(1, len(ls) + 1), lambda i: tree.quotas[i] - ls[i]) END::BIGINT[] AS kids
              FROM tree, al, n, (VALUES (0), (1), (2)) AS v(s) WHERE hi - lo > 1 AND ((j < k AND s = 0) OR (j = k AND s > 0))))))))),
sh AS (
  SELECT q.key, lo AS shard, quota, coalesce(sum(quota) OVER (PARTITION BY q.key ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT lo, units[i] AS unit, tree.quotas[i] AS quota FROM tree, al, unnest(range(1, k + 1)) AS r(i) WHERE hi - lo = 1) AS leaf JOIN
       (SELECT unit, key FROM q) AS q ON leaf.unit = q.unit),
dd AS (SELECT dr.*, shard FROM dr JOIN sh ON dr.key = sh.key AND rank >= sh.first AND rank < sh.first + quota)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(coalesce(sum(greatest(0, least(size, words - (start - dd.first)))) FILTER (shard IS NOT NULL), 0) AS BIGINT) AS taken,
       coalesce(string_agg(copy || ':' || pb.block || ':' || shard, ',' ORDER BY copy) FILTER (words - (start - dd.first) > 0), '') AS drawn
FROM pb LEFT JOIN dd ON pb.key = dd.key AND pb.block = dd.block GROUP BY doc_id, o
"""
