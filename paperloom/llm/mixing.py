"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources, by code point with null last, weigh 5, 2, 1, repeating. They share 150 % of all
   words; a target stops at twice its source's words and the excess goes to the others by weight.
   That is water-filling: target = least(2 * words, level * weight), with the level found from
   prefix sums over the sources in order of 2 * words / weight.
2. Blocks. A source's documents fall into blocks by hash, of about BLOCK_WORDS words and documents
   together, so that a source of empty texts is split as well; a source has at most MAX_BLOCKS, so
   that the order of its blocks is one task's work at any size. The mix takes whole passes over a
   source and then blocks in a permuted order until the target is met to the word; the last block is
   cut, within it the last document. Each taken block is a slot.
3. Tree. The sources' slot counts are the quotas of the root. A node splits its quotas between two
   halves of the output shards by a multivariate hypergeometric draw (each source in turn, by
   inversion of the exact distribution), down to single shards. Quotas add up exactly.
4. Draws. A source's slots, permuted, are dealt to the shards by these quotas without overlap.
   Within a shard documents are ordered by hash.

All draws hash the seed and the rows' own values, so reruns agree. What is joined is one row for
each block, sent to where the documents are; of these only the cut blocks move, by (source, block), and
what is drawn, by shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import set_aside, table, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK_WORDS, MAX_BLOCKS = 1 << 17, 1 << 16
SHARDS = 16
#: Slots up to which their list is sent to all executors, some 100 bytes each.
MOST_SENT = 200_000
SEED = 97


def words(text):
    """Number of runs of characters other than space and \\t-\\r; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def hash31(*parts) -> str:
    """SQL for a number in [0, 2^31) from the md5 of the parts; DuckDB can compute it as well."""
    text = " || ':' || ".join(f"coalesce(cast({p} as string), '~')" for p in parts)
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint) div 2"


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Add target to a table of one row per source, with source and source_size.

    The windows run over the source list, not over documents.
    """
    n = len(weights)
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.coalesce(*(F.when((F.col("_rank") - 1) % n == i, F.lit(float(w))) for i, w in enumerate(weights)))
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.select(*sizes.columns, "_rank", weight.alias("_w"), (F.col("source_size") * float(CAP)).alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select("*", F.coalesce(F.sum("_cap").over(full), F.lit(0.0)).alias("_filled"), F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_open"), F.sum("source_size").over(everything).alias("_all"))
    ranked = ranked.withColumn("_level", (F.col("_all") * F.lit(SHARE) - F.col("_filled")) / F.col("_open"))
    # the first source, in order of cap / weight, whose cap is not below level * weight sets the level
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(everything)
    return ranked.select(*sizes.columns, F.least(F.col("_cap"), level["_level"] * F.col("_w")).alias("target"))


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for the u-quantile of the number of good items among `drawn` of `total`.

    The weights run over the mean +- 9 standard deviations, beyond which they are below the
    precision of a double.
    """
    t, g, d = (f"cast({x} as double)" for x in (total, good, drawn))
    sd = f"sqrt({d} * {g} / greatest({t}, 1) * greatest({t} - {g}, 0) / greatest({t}, 1))"
    low = f"greatest(0L, {drawn} - ({total} - {good}), cast(floor({d} * {g} / greatest({t}, 1) - 9 * {sd} - 9) as bigint))"
    high = f"least({good}, {drawn}, cast(ceil({d} * {g} / greatest({t}, 1) + 9 * {sd} + 9) as bigint))"
    ratio = f"(({g} - x) * ({d} - x) / ((x + 1) * ({t} - {g} - {d} + x + 1)))"
    mass = f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 's', 0D), (a, x) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w), a -> a.s)"
    return f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 's', 0D, 'k', {high}, 'm', {mass}), (a, x) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w, 'k', if(a.s + a.w >= {u} * a.m and a.k = {high}, x, a.k), 'm', a.m), a -> a.k)"


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, first, quota) -> (source, shard, quota): the splitting tree, level by level.

    The table has a row for each source and node; `_id` is the source's place in the list.
    """
    nodes = quotas.select("source", "_id", "quota", F.lit(0).cast("long").alias("_lo"), F.lit(shards).cast("long").alias("_hi"))
    for _ in range(max(1, shards - 1).bit_length() if shards > 1 else 0):
        node = nodes.groupBy("_lo", "_hi").agg(F.array_sort(F.collect_list(F.struct("_id", "source", "quota"))).alias("q"))
        node = node.withColumn("_mid", F.expr("(_lo + _hi) div 2")).withColumn("_sum", F.expr("aggregate(q, 0L, (a, x) -> a + x.quota)"))
        node = node.withColumn("_left", F.expr("if(_hi - _lo < 2, _sum, cast(round(_sum * (_mid - _lo) / (_hi - _lo)) as bigint))"))
        u = f"(({hash31(seed, '_lo', '_hi', 's._id')}) + 0.5D) / 2147483648D"
        taken = hypergeometric("acc.t", "s.quota", "acc.d", u)
        step = f"transform(array({taken}), k -> named_struct('t', acc.t - s.quota, 'd', acc.d - k, 'out', concat(acc.out, array(k))))[0]"
        node = node.withColumn("_k", F.expr(f"aggregate(q, named_struct('t', _sum, 'd', _left, 'out', cast(array() as array<bigint>)), (acc, s) -> {step}, acc -> acc.out)"))
        part = node.select("_lo", "_mid", "_hi", F.posexplode("q").alias("_at", "s"), "_k").withColumn("_k", F.col("_k")[F.col("_at")])
        half = F.explode(F.array(F.struct(F.col("_lo").cast("long").alias("_lo"), F.when(F.col("_hi") - F.col("_lo") < 2, F.col("_hi")).otherwise(F.col("_mid")).alias("_hi"), F.col("_k").alias("quota")), F.struct(F.col("_mid").alias("_lo"), F.col("_hi").alias("_hi"), (F.col("s.quota") - F.col("_k")).alias("quota"))))
        nodes = part.select("s.source", "s._id", half.alias("h")).select("source", "_id", "h.quota", "h._lo", "h._hi").filter("quota > 0")
    return nodes.select("source", F.col("_lo").alias("shard"), "quota")


def mix_plan(df: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """Add to each row source_size, target and draws: array<struct<pass, shard, words>>.

    df has doc_id, source and size (words); further columns are carried along, whatever their names, but
    those called like an added one are replaced. A draw of fewer words than size is the cut one, at most
    one for each source. An empty table, or one without words, gets no draws.
    """
    df = df.drop("source_size", "target", "draws")
    own, at = set_aside(df)
    rows = own.withColumnsRenamed({at[c]: c for c in ("doc_id", "source", "size")})
    return _plan(rows, shards, block_words, seed, weights).toDF(*df.columns, "source_size", "target", "draws")


def _plan(rows: DataFrame, shards: int, block_words: int, seed: int, weights) -> DataFrame:
    rows = rows.withColumn("_h", F.expr(hash31(seed, "doc_id")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    plan = targets(sizes, weights)
    # `words` is capped, for rounding up must not ask for more than two passes
    plan = plan.withColumn("_words", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * CAP))
    plan = plan.withColumn("_passes", F.expr("if(source_size = 0, 0, _words div source_size)")).withColumn("_rest", F.expr("if(source_size = 0, 0, _words % source_size)"))
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil((F.col("source_size") + F.col("_rows")) / block_words))
    plan = plan.withColumn("_blocks", blocks).withColumn("_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    plan = written(plan, "mix-plan")
    same = rows["source"].eqNullSafe(plan["source"])
    # a row for each source; the side of a checked size is sent to all, a longer list is merged
    few = plan.count() <= 10_000
    side = F.broadcast(plan) if few else plan.hint("merge")
    placed = rows.join(side, same).drop(plan["source"]).withColumn("_block", F.expr("_h % _blocks"))
    blocks = placed.groupBy("source", "_id", "_block").agg(F.sum("size").alias("_size"), F.first("_passes").alias("_passes"), F.first("_rest").alias("_rest"))
    order = Window.partitionBy("_id").orderBy(F.expr(hash31(seed, "'b'", "_id", "_block")), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    blocks = blocks.withColumn("_limit", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before"))))
    slots = blocks.select("source", "_id", "_block", F.explode(F.expr("filter(transform(sequence(0L, _passes), p -> named_struct('pass', p, 'limit', if(p < _passes, _size, _limit), 'cut', p = _passes and _limit < _size)), s -> s.limit > 0)")).alias("s")).select("source", "_id", "_block", "s.*")
    slots = written(slots.withColumn("_turn", F.row_number().over(Window.partitionBy("_id").orderBy(F.expr(hash31(seed, "'s'", "_id", "pass", "_block")), "pass", "_block"))), "mix-slots")
    quotas = split_quotas(slots.groupBy("source", "_id").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    ends = quotas.groupBy(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n")).agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    ends = ends.withColumn("_ends", F.expr("aggregate(q, cast(array() as array<struct<shard:bigint,end:bigint>>), (a, x) -> concat(a, array(named_struct('shard', x.shard, 'end', coalesce(try_element_at(a, -1).end, 0L) + x.quota))))"))
    ends = ends.select("_s", "_n", "_ends")
    ends = F.broadcast(ends) if few else ends.hint("merge")
    dealt = slots.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).join(ends, ["_s", "_n"])
    dealt = dealt.withColumn("shard", F.expr("cast(filter(_ends, e -> e.end >= _turn)[0].shard as int)"))
    per_block = dealt.groupBy("_id", "_block").agg(F.array_sort(F.collect_list(F.struct("pass", "limit", "shard"))).alias("_slots"), F.bool_or("cut").alias("_cut"))
    # one row for each block: a list of checked size is sent to all, so that documents stay where they are; a longer one is spread by block as they are
    drawn = placed.join(F.broadcast(per_block) if slots.count() <= MOST_SENT else per_block.hint("shuffle_hash"), ["_id", "_block"], "left")
    # only in the last block of a source, which is cut, does it matter what comes before a document
    inside = Window.partitionBy("_id", "_block").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    drawn = drawn.filter(~F.coalesce("_cut", F.lit(False))).withColumn("_start", F.lit(0).cast("long")).unionByName(drawn.filter("_cut").withColumn("_start", start))
    draws = F.expr("filter(transform(coalesce(_slots, array()), s -> named_struct('pass', s.pass, 'shard', s.shard, 'words', greatest(0L, least(size, s.limit - _start)))), d -> d.words > 0)")
    return drawn.select(*rows.drop("_h").columns, "source_size", "target", draws.alias("draws"))


def mix(df: DataFrame, text_col: str = "text", shards: int = SHARDS, seed: int = SEED, **rule) -> DataFrame:
    """The mix itself: one row for each draw, ordered by hash within its shard.

    The text of a cut draw is its first words, joined by single spaces. Columns shard, pass and place are
    replaced; others are kept, whatever their names.
    """
    kept = df.drop("shard", "pass", "place")
    own, at = set_aside(kept)
    named = {c: "doc_id" if c == "doc_id" else "source" if c == "source" else at[c] for c in kept.columns}
    text = named[text_col]
    sized = own.withColumnsRenamed({at[c]: c for c in ("doc_id", "source")}).withColumn("size", words(F.col(text)))
    drawn = mix_plan(sized, shards=shards, seed=seed, **rule).withColumn("d", F.explode("draws"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0)), F.lit(1), F.col("d.words").cast("int")), " ")
    out = drawn.withColumn(text, F.when(F.col("d.words") < F.col("size"), cut).otherwise(F.col(text)))
    out = out.select(*(F.col(n).alias(c) for c, n in named.items()), F.col("d.shard").alias("shard"), F.col("d.pass").alias("pass"), F.expr(hash31(seed, "'o'", "doc_id", "d.pass")).alias("place"))
    return out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id")


def op5_mixing(spark, sf_dir):
    """Words taken from every document, from the draws that the mix deals to its shards."""
    rows = written(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    taken = F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")
    return mix_plan(rows).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


QUERIES = {"op5_mixing": op5_mixing}


def _h(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '~')" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) // 2)"


ORACLES = {
    "op5_mixing": f"""
    WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS id, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
    w AS (SELECT *, CAST(CASE (id - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM r),
    l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
    v AS (SELECT lev AS level FROM l WHERE lev * w <= cap ORDER BY cap / w, id LIMIT 1),
    p AS (SELECT *, least(cap, level * w) AS target FROM l, v),
    q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), source_size * 2) AS words, least({MAX_BLOCKS}, CAST(ceil((source_size + n) / {BLOCK_WORDS}) AS BIGINT)) AS blocks FROM p),
    x AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE words % source_size END AS rest FROM q),
    b AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.passes, x.rest, x.id, {_h(str(SEED), 'd.doc_id')} AS h, {_h(str(SEED), 'd.doc_id')} % x.blocks AS block FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
    bs AS (SELECT id, block, sum(size) AS bsize FROM b GROUP BY id, block),
    bo AS (SELECT *, coalesce(sum(bsize) OVER (PARTITION BY id ORDER BY {_h(str(SEED), "'b'", 'id', 'block')}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bs),
    o AS (SELECT b.*, bo.before, coalesce(sum(size) OVER (PARTITION BY b.id, b.block ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b JOIN bo ON b.id = bo.id AND b.block = bo.block)
    SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before - start)) AS BIGINT) AS taken FROM o"""
}
