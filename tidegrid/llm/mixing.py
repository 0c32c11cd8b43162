"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent, found by bisection: the largest one whose weights still
have the target entropy, raised further where a source would be repeated more often than the limit allows. The
weights times the token budget are then realised source by source: whole passes over the source, and one last partial
pass over a permutation of its blocks. Only sums by source and by block are ordered; documents are summed up
one by one in the one block of each source where the budget ends.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, saved, table

#: Sources whose totals go to the driver for the bisection; with more, each step of it is one aggregation.
MAX_SOURCES = 100_000
STEPS = 60


def _key(*parts) -> F.Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, F.Column) else F.lit(str(p)) for p in parts)))


def _measures(totals: DataFrame, whole: float, budget: float):
    """f(exponent) -> (entropy of the weights, passes over the most repeated source)."""
    counted = totals.where("total > 0")
    if counted.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        sizes = np.array([r["total"] for r in counted.orderBy("total", "source").collect()], float)
        shares = sizes / whole

        def local(exponent: float) -> tuple[float, float]:
            raised = shares**exponent
            weights = raised / raised.sum()
            return float(-(weights * np.log(weights)).sum()), float((budget * weights / sizes).max())

        return local

    def spread(exponent: float) -> tuple[float, float]:
        share = F.col("total") / F.lit(whole)
        raised = F.pow(share, F.lit(exponent))
        z, zl, top = counted.agg(F.sum(raised), F.sum(raised * F.log(raised)), F.max(raised / F.col("total"))).first()
        return math.log(z) - zl / z, budget * top / z

    return spread


def exponent_for(measure, n_sources: int, target_entropy: float, max_repeats: float) -> float:
    """Largest exponent in [0, 1] whose entropy reaches target_entropy * ln(n), or the least above it that keeps to max_repeats.

    Both measures fall as the exponent grows. Entropy: 0 if even equal weights fall short. Repeats: 1 if none keeps to it.
    """
    goal = target_entropy * math.log(n_sources) if n_sources > 1 else 0.0
    lo, hi = 0.0, 1.0
    if measure(1.0)[0] >= goal:
        lo = 1.0
    else:
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if measure(mid)[0] >= goal else (lo, mid)
    if measure(lo)[1] <= max_repeats:
        return lo
    hi = 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if measure(mid)[1] <= max_repeats else (mid, hi)
    return hi


def _realised(totals: DataFrame, whole: float, budget: float, most_passes: int):
    """f(exponent, share of the budget) -> entropy of what the sources really give when none gives more than most_passes."""
    counted = totals.where("total > 0")
    if counted.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        sizes = np.array([r["total"] for r in counted.orderBy("total", "source").collect()], float)

        def local(exponent: float, share: float) -> float:
            raised = (sizes / whole) ** exponent
            given = np.minimum(budget * share * raised / raised.sum(), sizes * most_passes)
            weights = given / given.sum()
            return float(-(weights * np.log(weights)).sum())

        return local

    def spread(exponent: float, share: float) -> float:
        raised = F.pow(F.col("total") / F.lit(whole), F.lit(exponent))
        z = counted.agg(F.sum(raised)).first()[0]
        given = F.least(F.lit(budget * share / z) * raised, F.col("total") * most_passes)
        g, gl = counted.agg(F.sum(given), F.sum(given * F.log(given))).first()
        return math.log(g) - gl / g

    return spread


def thinning_for(realised, n_sources: int, target_entropy: float) -> tuple[float, float]:
    """(exponent, share of the budget) at which the realised weights reach target_entropy * ln(n).

    First the exponent falls from 1 to 0; if even equal weights fall short, as small sources have too little, the budget
    falls until the others come down to them.
    """
    goal = target_entropy * math.log(n_sources) if n_sources > 1 else 0.0

    def at(x: float) -> tuple[float, float]:
        return max(0.0, 1.0 - x), min(1.0, 2.0 - x)

    if realised(*at(0.0)) >= goal:
        return at(0.0)
    lo, hi = 0.0, 2.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if realised(*at(mid)) >= goal else (mid, hi)
    return at(hi)


def mix(docs: DataFrame, budget_share: float = 1.0, target_entropy: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 20, seed: int = 7, most_passes: int | None = None, realise: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, progress): a row for each document and each pass that it is taken in.

    docs(doc_id, text, source, ...). Tokens are words between ASCII white space; the budget is budget_share of all
    of them; with most_passes a source gives at most so many whole passes, whatever its weight asks for; with realise too, the
    exponent and the budget are such that the tokens taken reach the entropy. progress, from 0 to below 1, is how far into its source's budget the row's block starts; ordering by it
    interleaves the sources by weight. A document is taken while tokens before it in the pass stay below the budget, so
    a source exceeds it by less than one document. Null or empty text: no tokens, taken with the pass it stands in; of a
    source without any tokens nothing is taken. Texts of any length are counted whole.
    Null source: a source of its own named ''. Repeated rows each count; null doc_ids stay; empty table or no tokens at
    all: no rows. Other columns are ignored.
    """
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens"))
    base = saved(base, "tokens")
    totals = saved(base.groupBy("source").agg(F.sum("n_tokens").alias("total")), "sources")
    whole, n_sources = totals.where("total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    budget = float(whole) * budget_share
    if realise and most_passes is not None and whole:
        exponent, share = thinning_for(_realised(totals, float(whole), budget, most_passes), n_sources, target_entropy)
        budget *= share
    else:
        exponent = exponent_for(_measures(totals, float(whole), budget), n_sources, target_entropy, max_repeats) if whole else 1.0
    raised = F.pow(F.col("total") / F.lit(float(whole or 1)), F.lit(exponent))
    norm = totals.where("total > 0").agg(F.sum(raised)).first()[0] or 1.0
    wanted = F.floor(F.lit(budget) * raised / F.lit(norm))
    wanted = wanted if most_passes is None else F.least(wanted, F.col("total") * most_passes)
    asked = totals.where("total > 0").select("source", "total", wanted.alias("asked"))
    asked = asked.select("source", "asked", F.floor(F.col("asked") / F.col("total")).alias("passes"), (F.col("asked") % F.col("total")).alias("rest"), F.ceil(F.col("total") / F.lit(block_tokens)).alias("n_blocks"))

    # which blocks of each pass are taken: running sums over blocks, not documents
    number = F.conv(F.substring(_key("block", seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    blocked = base.join(asked, "source").withColumn("block", number % F.col("n_blocks"))
    sizes = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("asked").alias("asked"))
    passes = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).where("epoch < passes or rest > 0")
    order = Window.partitionBy("source", "epoch").orderBy(_key("pass", seed, F.col("epoch"), F.col("source"), F.col("block")), "block")
    placed = passes.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    limit = F.when(F.col("epoch") < F.col("passes"), F.lit((1 << 62))).otherwise(F.col("rest"))
    placed = placed.withColumn("room", limit - F.col("before")).where("room > 0")
    size = F.col("asked").cast("double")
    done = (F.col("epoch") * ((F.col("asked") - F.col("rest")) / F.greatest(F.col("passes"), F.lit(1))) + F.col("before")) / size
    placed = placed.select("source", "block", "epoch", "size", "room", F.round(done, 9).alias("progress"))

    rows = base.join(asked.select("source", "n_blocks"), "source").withColumn("block", number % F.col("n_blocks")).drop("n_blocks")
    taken = rows.join(placed, ["source", "block"])
    whole_blocks = taken.where("size <= room")
    within = Window.partitionBy("source", "block", "epoch").orderBy(_key("doc", seed, F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last_blocks = taken.where("size > room").withColumn("prior", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("prior < room").drop("prior")
    return whole_blocks.unionByName(last_blocks).select("doc_id", "source", "n_tokens", "epoch", "block", "progress")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive base as (
  select doc_id, coalesce(source, '') as source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens,
         ('0x' || substr(md5('block|7|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as deal
  from documents
), totals as (
  select source, sum(n_tokens)::double as total from base group by source having sum(n_tokens) > 0
), sums as (
  select sum(total) as whole, count(*) as n, 0.95 * ln(count(*)) as goal from totals
), plain as (
  select -sum(total / whole * ln(total / whole)) as h1 from totals, sums
), by_entropy(i, lo, hi) as (
  select 0, case when h1 >= goal then 1.0::double else 0.0::double end, 1.0::double from plain, sums
  union all
  select i + 1, case when ok then mid else lo end, case when ok then hi else mid end
  from (
    select i, lo, hi, (lo + hi) / 2 as mid,
           (select ln(sum(pow(total / whole, (lo + hi) / 2))) - sum(pow(total / whole, (lo + hi) / 2) * ln(pow(total / whole, (lo + hi) / 2))) / sum(pow(total / whole, (lo + hi) / 2)) from totals, sums) >= (select goal from sums) as ok
    from by_entropy where i < 60
  )
), first_found as (
  select lo as e from by_entropy order by i desc limit 1
), by_repeats(i, lo, hi) as (
  select 0, e, 1.0::double from first_found
  union all
  select i + 1, case when ok then lo else mid end, case when ok then mid else hi end
  from (
    select i, lo, hi, (lo + hi) / 2 as mid,
           (select max(whole * pow(total / whole, (lo + hi) / 2) / total) / sum(pow(total / whole, (lo + hi) / 2)) from totals, sums) <= 4.0 as ok
    from by_repeats where i < 60
  )
), exponent as (
  select case when (select max(whole * pow(total / whole, e) / total) / sum(pow(total / whole, e)) from totals, sums) <= 4.0 then e
              else (select hi from by_repeats order by i desc limit 1) end as e
  from first_found
), norm as (
  select sum(pow(total / whole, e)) as z from totals, sums, exponent
), asked0 as (
  select source, total::bigint as total, floor(whole * pow(total / whole, e) / z)::bigint as asked from totals, sums, exponent, norm
), asked as (
  select source, asked, asked // total as passes, asked % total as rest, (total + 1048575) // 1048576 as n_blocks from asked0
), blocked as (
  select b.doc_id, b.source, b.n_tokens, b.deal % a.n_blocks as block from base b join asked a on a.source = b.source
), sizes as (
  select source, block, sum(n_tokens)::bigint as size from blocked group by source, block
), passes as (
  select s.source, s.block, s.size, a.asked, a.passes, a.rest, unnest(range(0, a.passes + 1)) as epoch from sizes s join asked a on a.source = s.source
), placed as (
  select *, coalesce(sum(size) over (partition by source, epoch order by md5('pass|7|' || epoch || '|' || source || '|' || block), block rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from passes where epoch < passes or rest > 0
), roomy as (
  select source, block, epoch, size, case when epoch < passes then 4611686018427387904 else rest end - before as room,
         round((epoch * ((asked - rest) / greatest(passes, 1)::double) + before) / asked::double, 9) as progress
  from placed
), taken as (
  select b.doc_id, b.source, b.n_tokens, r.epoch, b.block, r.progress, r.size, r.room,
         coalesce(sum(b.n_tokens) over (partition by b.source, b.block, r.epoch order by md5('doc|7|' || r.epoch || '|' || coalesce(b.doc_id::varchar, '')), b.n_tokens rows between unbounded preceding and 1 preceding), 0) as prior
  from blocked b join roomy r on r.source = b.source and r.block = b.block where r.room > 0
)
select doc_id, source, n_tokens, epoch, block, progress from taken where size <= room or prior < room
"""


def rebalance(docs: DataFrame, target_entropy: float = 0.9, **settings) -> DataFrame:
    """docs, with its own columns, thinned to tempered weights: no document is repeated.

    The budget is all tokens there are. Sources whose weight asks for more than they have are kept whole; the others
    are thinned to their weight's tokens. Of rows that share a doc_id, or have none, all of one id stay as soon as one is taken. The entropy of what is kept then falls short of the target, unless realise is
    set: then it is that entropy which reaches it, and more is dropped. Documents without tokens stay.
    """
    kept = mix(docs, target_entropy=target_entropy, max_repeats=math.inf, most_passes=1, **settings)
    taken = fresh(docs, "taken")
    ids = kept.select(F.col("doc_id").alias(taken)).distinct()
    empty = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) == 0
    with_tokens = docs.where(~empty).join(ids, F.col("doc_id").eqNullSafe(F.col(taken))).drop(taken)
    return with_tokens.union(docs.where(empty))
