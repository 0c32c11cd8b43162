"""The trie of conversation prefixes, as tables that merge.

A node is a different sequence of first turns. Its key is its depth and 128 bits that are combined over its turns, so that
a dialogue can be keyed in pieces, wherever its turns lie. Partitions combine their rows of a node into one, and so do two
rounds of merging by key: members add up, lists of ended dialogues are joined piece by piece.

The rollup runs from the bottom without a round a level. A node belongs to the least dialogue that goes through it, so a
dialogue owns the last stretch of its own path. Sums over that stretch are taken from its end up; what it comes to in
all goes to the nodes above it, which others own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import saved, small_batches, table, used_up

#: Turns of a dialogue, and its ids of an end list, that one task or row has at most.
STRETCH, PIECE = 1024, 8192
#: Tables of a node that the last round of merging joins.
FAN = 16
KEY = ["depth", "hi", "lo"]


def _so_far(agg: Column, keys: list[str], order: Column | str, before: bool = False) -> Column:
    """agg over the rows up to this one; before: over those before it, 0 for none."""
    found = agg.over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    return F.coalesce(found, F.lit(0).cast("long")) if before else found


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, no, digest, bytes): the turns of turns(conv_id, turn, role, text, ...) counted from 1 in each dialogue, by turn
    (null first), then role, then text; what was said as a digest, and the UTF-8 bytes of the text.

    A null role or text is empty. Rows without a conv_id are left out. Rows that are alike are turns of their own. Turns are
    counted over ranges of the whole table, so one long dialogue is many tasks' work.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *said).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    placed = saved(ranged.select("conv_id", "part", "at", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = spans.select("conv_id", "part", (F.col("first") - _so_far(F.sum("n"), ["conv_id"], "part", before=True)).alias("zero"))
    return placed.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero") + 1).alias("no"), "digest", "bytes")


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, up_hi, up_lo, bytes): each dialogue's nodes from the root down, and their parents' keys."""
    own = turns.select("conv_id", F.col("no").alias("depth"), "bytes", F.xxhash64("digest", "no").alias("a"), F.xxhash64("no", "digest", F.lit("lo")).alias("b")).withColumn("stretch", F.expr(f"(depth - 1) div {STRETCH}"))
    keys = ["conv_id", "stretch"]
    inside = own.withColumns({"in_a": _so_far(F.bit_xor("a"), keys, "depth"), "in_b": _so_far(F.bit_xor("b"), keys, "depth")})
    ahead = own.groupBy(*keys).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    ahead = ahead.select(*keys, *(_so_far(F.bit_xor(c), ["conv_id"], "stretch", before=True).alias(f"pre_{c}") for c in "ab")).where("stretch > 0")
    joined = inside.join(ahead, keys, "left").na.fill(0, ["pre_a", "pre_b"])
    hi, lo = F.col("in_a").bitwiseXOR(F.col("pre_a")), F.col("in_b").bitwiseXOR(F.col("pre_b"))
    nodes = joined.select("conv_id", "depth", hi.alias("hi"), lo.alias("lo"), hi.bitwiseXOR(F.col("a")).alias("up_hi"), lo.bitwiseXOR(F.col("b")).alias("up_lo"), "bytes")
    nothing = F.lit(0).cast("long")
    return nodes.union(convs.select("conv_id", *([nothing] * 3), *([F.lit(None).cast("long")] * 2), nothing))


def _merged(paths: DataFrame) -> DataFrame:
    """(depth, hi, lo, up_hi, up_lo, bytes, least, n): one row a node, merged in two rounds."""
    found = paths.withColumns({"least": F.col("conv_id"), "n": F.lit(1).cast("long"), "share": F.pmod(F.xxhash64("conv_id"), F.lit(FAN))})
    for keys in ([*KEY, "share"], KEY):
        found = found.groupBy(*keys).agg(*(F.min(c).alias(c) for c in ("up_hi", "up_lo", "bytes", "least")), F.sum("n").alias("n"))
    return found


def _end_digests(paths: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256): of the ids of the dialogues that end at a node, ascending, joined by commas.

    Lists travel in pieces of at most PIECE ids. A task reads a node's pieces in order and keeps only the state of the digest.
    """
    ends = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("conv_id", "end.*")
    pieces = ends.groupBy(*KEY, F.expr(f"conv_id div {PIECE}").alias("piece")).agg(F.array_join(F.sort_array(F.collect_list(F.col("conv_id"))).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if here != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(done)
        yield _rows([(*key, state.hexdigest())] if key is not None else [])

    def _rows(done):
        return pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in done], pa.int64()) for i in range(3)), pa.array([d[3] for d in done], pa.string())], [*KEY, "ends_sha256"])

    return small_batches(pieces).repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(run, "depth long, hi long, lo long, ends_sha256 string")


def _below(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth, hi, lo, n_leaves, saved): sums over each node's subtree, itself included, of leaf and saving."""
    owned = nodes.select(F.col("least").alias("conv_id"), *KEY, F.expr(f"depth div {STRETCH}").alias("stretch"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("saving"))
    keys, sums = ["conv_id", "stretch"], ("leaf", "saving")
    inside = owned.select("conv_id", "stretch", *KEY, *(_so_far(F.sum(c), keys, F.desc("depth")).alias(f"own_{c}") for c in sums))
    whole = saved(owned.groupBy(*keys).agg(F.min("depth").alias("top"), *(F.sum(c).alias(c) for c in sums)), "stretches")
    later = whole.select(*keys, *(_so_far(F.sum(c), ["conv_id"], F.desc("stretch"), before=True).alias(f"later_{c}") for c in sums)).where("later_leaf > 0 or later_saving > 0")
    own = inside.join(later, keys, "left").na.fill(0, [f"later_{c}" for c in sums])
    # what a dialogue owns in all, for the nodes above, which belong to others
    totals = whole.groupBy("conv_id").agg(F.min("top").alias("top"), *(F.sum(c).alias(c) for c in sums))
    above = paths.select("conv_id", *KEY).join(totals, "conv_id").where("depth < top").groupBy(*KEY).agg(*(F.sum(c).alias(f"from_{c}") for c in sums))
    both = own.join(above, KEY, "left").na.fill(0, [f"from_{c}" for c in sums])
    return both.select(*KEY, *(sum((F.col(f"{p}_{c}") for p in ("own", "later", "from")), F.lit(0).cast("long")).alias(name) for c, name in (("leaf", "n_leaves"), ("saving", "saved"))))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie of the dialogues convs(conv_id), each with turns(conv_id, no, digest, bytes) numbered from 1:
    conv_id (least member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (nodes without
    children in its subtree), saved_tokens (sum over its subtree of (n_convs - 1) times the bytes of the node's last text),
    ends_sha256 (of the ids that end here, ascending, joined by commas).

    A dialogue without turns is a member of the root. conv_id is unique in convs and not null. No dialogues: no rows.
    """
    ship(convs.sparkSession)
    paths = saved(_paths(turns, convs), "paths")
    merged = saved(_merged(paths), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")]
    children = merged.where("depth > 0").select(*parent).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = saved(merged.join(children, KEY, "left").na.fill(0, ["n_children"]), "family")
    ups = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("least").alias("parent_conv_id"))
    found = nodes.join(_below(nodes, paths), KEY).join(_end_digests(paths), KEY, "left").join(ups, ["depth", "up_hi", "up_lo"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    used_up(merged)
    return found.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """trie() of the dialogues as they are, from turns(conv_id, turn, role, text, ...); see ordered() for their order."""
    return trie(ordered(turns), _ids(turns))


def _ids(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()


#: Most turns that a rebuilt dialogue takes over.
HEAD = 8


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns(conv_id, no, digest, bytes) of dialogues that start with the first h turns of dialogue c - c % 5, where they have
    as many, and go on with their own after the first h; h is the CRC-32 of the id in decimal, modulo 9."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    plan = convs.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = turns.where(f"conv_id % 5 = 0 and no <= {HEAD}").withColumnRenamed("conv_id", "base")
    taken = plan.join(heads, "base").where("no <= h").select("conv_id", "no", "digest", "bytes")
    plan = plan.join(heads.groupBy("base").agg(F.max("no").alias("there")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("n"))
    return taken.union(turns.join(plan, "conv_id").where("no > h").select("conv_id", (F.col("no") - F.col("h") + F.col("n")).alias("no"), "digest", "bytes"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    convs = saved(_ids(turns), "conversations")
    return trie(rebuilt(saved(ordered(turns), "ordered"), convs), convs)


OP12_SQL = """
with said as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as no, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), sizes as (
  select conv_id, count(*) as n, xor(4294967295, list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::ubigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda r: r::ubigint)), lambda x, r: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end))) % 9 as h
  from said group by conv_id
), planned as (
  select s.conv_id, s.h, s.conv_id - s.conv_id % 5 as base, least(s.h, coalesce(b.n, 0)) as taken from sizes s left join sizes b on b.conv_id = s.conv_id - s.conv_id % 5
), turns as (
  select p.conv_id, b.no as d, b.role, b.text from planned p join said b on b.conv_id = p.base where b.no <= p.h
  union all
  select p.conv_id, o.no - p.h + p.taken, o.role, o.text from planned p join said o on o.conv_id = p.conv_id where o.no > p.h
), whole as (
  select p.conv_id, coalesce(list({'r': role, 't': text} order by d) filter (where d is not null), []) as path from planned p left join turns t on t.conv_id = p.conv_id group by p.conv_id
), visits as (
  select conv_id, path[1:d] as node, d, len(path) = d as ends from whole, unnest(range(0, len(path) + 1)) x(d)
), nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n, coalesce(string_agg(conv_id, ',' order by conv_id) filter (where ends), '') as ended,
         case when d = 0 then 0 else octet_length(encode(node[d].t)) end as size
  from visits group by node, d
), family as (
  select p.node, p.d, count(c.d) as children from nodes p left join nodes c on c.d = p.d + 1 and c.node[1:p.d] = p.node group by p.node, p.d
), below as (
  select a.node, a.d, count(*) filter (where f.children = 0) as leaves, sum((b.n - 1) * b.size) as saved
  from nodes a join nodes b on b.d >= a.d and b.node[1:a.d] = a.node join family f on f.node = b.node and f.d = b.d group by a.node, a.d
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n as n_convs, f.children as n_children, b.leaves as n_leaves, b.saved::bigint as saved_tokens, sha256(n.ended) as ends_sha256
from nodes n join family f on f.node = n.node and f.d = n.d join below b on b.node = n.node and b.d = n.d left join nodes u on u.d = n.d - 1 and n.d > 0 and u.node = n.node[1:n.d - 1]
"""
