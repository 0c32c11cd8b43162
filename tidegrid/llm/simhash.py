"""SimHash near-duplicates found by multi-index hashing (Norouzi, Punjani and Fleet, 2012).

Words, shingles and bits are made from whole texts in Arrow batches. The fingerprints, one row for each
different one, then stay in the JVM: each is cut into segments, the small Hamming ball around each segment value
is enumerated, the table of segment values is probed with it by an equi-join, and the whole distance is verified.
A pair within `max_bits` differs by at most max_bits // segments in some segment, so no link is lost.

Near copies by similarity (similar_groups) lie about 10 of 64 bits apart at a Jaccard similarity of 0.8, too far for any
few segments. They are found by wider fingerprints, of as many segments as a pair needs to share one all but surely; a
segment value has about as many bits as the number of texts asks for, so that strangers seldom meet. There the ball has
radius zero: further segments find more for the same rows than balls around fewer. The segment table crosses one shuffle;
documents of a small segment value meet there by 64 bits of distance, large and hot ones follow by leaders, rows of values
in between meet if still apart, and what stays apart in large ones is searched by a prefix filter over shingles. Distances
of 2,048 bits are verified for what meets, and then the two exact shingle sets.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, fresh, list_array, mix, remembered, saved, small_batches, table, used_up
from .components import components

BITS = 64
#: Near copies by similarity: words of a shingle, least Jaccard similarity, and how often a pair at it may be missed.
SHINGLE, THRESHOLD, MISSED = 5, 0.8, 0.002
#: Bits whose distance is verified at last, at first and in late meetings, and up to how many standard deviations a pair at the threshold passes each.
VERIFIED, MET, LATE = 2048, 64, 1024
PRINTS = [f"print{i}" for i in range(VERIFIED // 64)]
SPREADS = {VERIFIED: 3.5, MET: 4.5, LATE: 3.5}
#: Bits of sets of n shingles differ a little more often than their angle says, by less than TIES / n (ties of small even sets).
TIES = 0.3
#: Rows before it that a row of a segment value meets at first. Of a value with more rows than that and one each meets the first.
BACK = 3
#: First rows of larger values that a row meets, at most, whatever the number of such values it has.
FIRSTS = 2
#: Up to so many rows of a value meet each other next, where their groups still differ: chance fills values that far, at any number
#: of texts. A value with more rows goes by leaders and by the exact search.
MANY = 32
#: A segment value is hot, and kept from the sort, above HOT rows and this share of the texts; one of SAMPLED texts counts.
HOT, HOT_SHARE, SAMPLED = 8192, 256, 64
#: Leaders of a segment value after the first round, and rounds of leaders before the exact search of what is still apart.
LEADERS, ROUNDS = 8, 1
#: Shingles of a bucket in which they are counted, on average, least buckets, and how many of its rarest shared shingles a text shows in the exact search.
BUCKET_ITEMS, LEAST_BUCKETS, HEAD = 1 << 19, 16, 64


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Unsigned fingerprint of one text. No words: 0; fewer words than a shingle: of the whole sequence."""
    words = text.lower().split()  # bytes: only A-Z, and only the six ASCII white-space characters
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        raw = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a row for each row of docs; fp holds the 64 bits as a signed long. Null texts have no words."""

    def run(batches):
        remembered.clear()
        for batch in batches:
            made = np.array([fingerprint(x, shingle, seed) for x in bytes_of(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(found: DataFrame, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """(u, v) for each pair of different values of found.fp that differ in at most max_bits bits.

    A pair may come once for each segment in which it is close.
    """
    width = BITS // segments
    if width * segments != BITS:
        raise ValueError("segments must divide 64")
    part, radius = (1 << width) - 1, max_bits // segments
    masks = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]
    distinct = found.select("fp").distinct()
    # the key of segment s: its value, and s above it where that has room; of two values the smaller one probes
    rows = F.array(*(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(part)).alias("key")) for s in range(segments)))
    keyed = distinct.select("fp", F.explode(rows).alias("k")).select("fp", "k.seg", "k.key")
    ball = [F.col("key")] + [F.when(F.col("key").bitwiseXOR(F.lit(m)) > F.col("key"), F.col("key").bitwiseXOR(F.lit(m))) for m in masks]
    probes = keyed.select(F.col("fp").alias("u"), F.col("seg"), F.col("key").alias("own"), F.explode(F.array(*ball)).alias("key")).where("key is not null")
    tables = keyed.select(F.col("fp").alias("v"), "seg", "key")
    near = probes.join(tables, ["seg", "key"]).where((F.col("own") != F.col("key")) | (F.col("u") < F.col("v")))
    return near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs(doc_id, text, ...).

    Equal fingerprints form a class, of which only one row enters the search, so groups of copies cost nothing there.
    component_id is the least doc_id reachable over links, the row's own included. Null or wordless text: fingerprint
    zero, linked like any other. Texts of any length are taken whole. Rows that share a doc_id each have their own text's
    fingerprint. Null doc_id: the row stays and gets the component of its fingerprint (null if nobody
    there has an id). Repeated rows each stay. Empty table: no rows. Other columns are ignored.
    """
    found = saved(fingerprints(docs, shingle, seed), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(found, max_bits, segments))
    linked = roots.join(classes, roots.node == classes.fp).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "root").select("fp", "least")
    # written down, so that the last join stands on its own and a fingerprint that many rows share can be split there
    groups = saved(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "groups")
    return found.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs without near-duplicates: the row with the least doc_id of each component stays, of repeated rows one.

    Rows without a doc_id can't be told apart and stay as they are.
    """
    return keep_least(docs, near_duplicates(docs, **settings))


def shingles(text: bytes, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """(signed hash of the word sequence, sorted different hashes of its shingles). No words: (0, none); fewer than a shingle: one."""
    words = text.lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    whole = digest(joined, 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, width = ends - sizes, min(shingle, len(words))
    found = [digest(joined[a:b], 0) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return whole - (1 << 64) if whole >> 63 else whole, np.unique(np.array(found, np.uint64))


def wide_segments(n_texts: int, threshold: float = THRESHOLD, missed: float = MISSED) -> tuple[int, int, int, int, int]:
    """(segments, bits of one, most differing bits of VERIFIED, those of MET and of LATE) for near copies among so many texts.

    A bit of two texts differs with the angle of their shingle sets over pi, that is at Jaccard similarity j with
    p = acos(2 j / (1 + j)) / pi. A segment of b bits is shared with (1 - p) ** b.
    """
    bits = max(16, math.ceil(math.log2(max(2, n_texts))))
    differs = math.acos(2 * threshold / (1 + threshold)) / math.pi
    segments = math.ceil(math.log(missed) / math.log1p(-((1 - differs) ** bits)))
    most = (math.ceil(n * differs + spread * math.sqrt(n * differs * (1 - differs))) for n, spread in SPREADS.items())
    return segments, bits, *most


def wide_fingerprint(found: np.ndarray, n_bits: int) -> np.ndarray:
    """n_bits bits, each 1 if it is set in over half of the shingles; every 64 of them have a hash of their own."""
    steps = np.arange(1, -(-n_bits // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(len(steps) * 64, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 255):  # counts fit in a byte
            hashes = mix(found[at : at + 255, None] + steps)
            ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return (ones * 2 > len(found))[:n_bits]


def _signatures(docs: DataFrame, segments: int, bits: int, shingle: int) -> DataFrame:
    """(doc_id, node, n, print0, print1, ..., keys): node stands for the words of the text, n is the number of its shingles, the
    prints are the first VERIFIED bits of its fingerprint, and a key is a segment's number and value."""

    def run(batches):
        remembered.clear()
        weights, base = np.int64(1) << np.arange(bits, dtype=np.int64), np.arange(segments, dtype=np.int64) << np.int64(bits)
        for batch in batches:
            made = [shingles(x, shingle) for x in bytes_of(batch.column("text"))]
            wide = [wide_fingerprint(s, max(segments * bits, VERIFIED)) if len(s) else None for _, s in made]
            keys = [np.zeros(0, np.int64) if w is None else base + w[: segments * bits].reshape(segments, bits) @ weights for w in wide]
            prints = np.array([np.zeros(len(PRINTS), "<i8") if w is None else np.packbits(w[:VERIFIED], bitorder="little").view("<i8") for w in wide]).reshape(-1, len(PRINTS))
            lists = list_array(np.concatenate([*keys, np.zeros(0, np.int64)]), np.array([len(k) for k in keys], np.int64), pa.int64())
            columns = [batch.column("doc_id"), pa.array([node for node, _ in made], pa.int64()), pa.array([len(s) for _, s in made], pa.int64()), *(pa.array(np.ascontiguousarray(p)) for p in prints.T), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", *PRINTS, "keys"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, node long, n long, {', '.join(f'{p} long' for p in PRINTS)}, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the shingles of each row."""

    def run(batches):
        for batch in batches:
            made = [shingles(x, shingle) for x in bytes_of(batch.column("text"))]
            lists = list_array(np.concatenate([*(s for _, s in made), np.zeros(0, np.uint64)]).view(np.int64), np.array([len(s) for _, s in made], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in made], pa.int64()), lists], ["node", "items"])

    return small_batches(docs).select("text").mapInArrow(run, "node long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs(u, v) whose shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
            keep = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # merge joins, which can be split where many candidates meet the same leader
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")).hint("merge"), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")).hint("merge"), "v")
    return small_batches(both).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _hot_keys(nodes: DataFrame, n_texts: int, hot: int, sampled: int) -> DataFrame:
    """(key): segment values that more than about `hot` texts and a 256th of them share, so at most 512 for each segment.

    That bounds what is broadcast: 4 KB a segment. They are found in one of `sampled` texts. The choice only says how a value's rows are compared, not whether.
    """
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(sampled)) == 0)
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    return counts.where(F.col("rows") * sampled > max(hot, n_texts // HOT_SHARE)).select("key")


def _meetings(keyed: DataFrame, most: int) -> DataFrame:
    """(key, node, rows, m0, m1, ...): rows of keyed(key, node, print0) that meet others at most `most` bits apart, m0 and so on, or
    whose key has more than BACK + 1 rows. Such a key's rows meet its first here, all others meet each other."""
    order, me = Window.partitionBy("key").orderBy("node"), F.struct("node", PRINTS[0])
    seen = keyed.select("key", "node", PRINTS[0], F.count("*").over(Window.partitionBy("key")).alias("rows"), F.first(me).over(order).alias("l0"), *(F.lag(me, i).over(order).alias(f"l{i}") for i in range(1, BACK + 1)))
    large = F.col("rows") > BACK + 1
    near = lambda i: F.bit_count(F.col(PRINTS[0]).bitwiseXOR(F.col(f"l{i}.{PRINTS[0]}"))) <= most
    met = [F.when(large & (F.col("node") != F.col("l0.node")) & near(0), F.col("l0.node")).alias("m0")]
    met += [F.when(~large & near(i), F.col(f"l{i}.node")).alias(f"m{i}") for i in range(1, BACK + 1)]
    found = seen.where("rows > 1").select("key", "node", "rows", *met)
    return found.where((F.col("rows") > BACK + 1) | F.coalesce(*(f"m{i}" for i in range(BACK + 1))).isNotNull())


def _first_pairs(met: DataFrame) -> DataFrame:
    """(u, v): who meets whom in small keys, and of the firsts of the larger keys that a row has the FIRSTS least.

    A row of a large group has nearly as many firsts as keys. Where those left out would have linked it, it is still apart and
    meets others late, by leaders or in the exact search, as every key of more than BACK + 1 rows goes there.
    """
    small = met.select("node", F.explode(F.array(*(f"m{i}" for i in range(1, BACK + 1)))).alias("v"))
    large = met.where("m0 is not null").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("m0")), 1, FIRSTS).alias("m")).select("node", F.explode("m").alias("v"))
    both = small.where("v is not null").union(large)
    return both.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def _late_meetings(rows: DataFrame, most: int) -> DataFrame:
    """(u, v): rows(key, node, n, print0, ..., root) of one key, MANY at most, that have different roots and are at most `most` of LATE bits apart."""
    before, prints = Window.partitionBy("key").orderBy("node").rowsBetween(1 - MANY, -1), PRINTS[: LATE // 64]
    seen = rows.withColumn("earlier", F.collect_list(F.struct("node", "n", "root", *prints)).over(before))
    far = lambda x: sum(F.bit_count(x[c].bitwiseXOR(F.col(c))) for c in prints)
    near = lambda x: (x["root"] != F.col("root")) & (far(x) <= most + LATE * TIES / F.least(x["n"], F.col("n")))
    pairs = seen.select("node", F.explode(F.filter("earlier", near)["node"]).alias("v"))
    return pairs.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def _few_bits(a: str, b: str, max_bits: int) -> Column:
    """Whether the prints of columns a + print0, ... and b + print0, ... differ in at most max_bits bits, and what ties of the smaller n allow."""
    far = sum(F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in PRINTS)
    return far <= max_bits + VERIFIED * TIES / F.least(f"{a}n", f"{b}n")


def _near_enough(pairs: DataFrame, nodes: DataFrame, threshold: float, max_bits: int) -> DataFrame:
    """Those of pairs(u, v) with sizes of which one is large enough a part of the other, at most max_bits of VERIFIED bits apart."""
    for end in "uv":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", *PRINTS))), end)
    return pairs.where((F.least("u_n", "v_n") >= F.lit(threshold) * F.greatest("u_n", "v_n")) & _few_bits("u_", "v_", max_bits)).select("u", "v")


def _candidates(keyed: DataFrame, threshold: float, max_bits: int, salt: int) -> DataFrame:
    """(u, v): rows of keyed(key, keys, node, n, print0, ..., root) with the leaders of their key that have another root, near enough
    in size, and at most max_bits of VERIFIED bits apart. A key's rows meet a few leaders, never each other.

    The leaders are the first of each slot in an order of all nodes that is another one in each round, so keys that a row
    shares with a leader mostly agree on it. A row meets a leader under the least of the keys that it has and the other leads.
    """
    slot, turn = (F.xxhash64("node", F.lit(salt), F.lit(what)) for what in ("slot", "turn"))
    leader = F.struct(turn.alias("turn"), "node", "n", *PRINTS, F.col("root").alias("of"))
    firsts = [F.min(F.when(F.pmod(slot, F.lit(LEADERS)) == i, leader)).alias(f"l{i}") for i in range(LEADERS)]
    found = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *firsts).where("lo < hi")
    found = saved(found.select("key", F.explode(F.array_compact(F.array(*(f"l{i}" for i in range(LEADERS))))).alias("l")), "led")
    # a node has one key a segment at most, so these lists are short
    led = found.groupBy(F.col("l.node").alias("leader")).agg(F.collect_list("key").alias("led"))
    found = found.join(led, F.col("l.node") == F.col("leader")).select("key", F.col("l").withField("led", F.col("led")).alias("l"))
    slot = F.pmod(F.xxhash64("l.node", F.lit(salt), F.lit("slot")), F.lit(LEADERS))
    found = found.groupBy("key").agg(*(F.first(F.when(slot == i, F.col("l")), ignorenulls=True).alias(f"l{i}") for i in range(LEADERS)))
    # written down, so that a key of many rows can be split in the join, which makes one row of each at most
    found = saved(found, "leaders")

    def near(i: int) -> Column:
        sizes = F.least("n", f"l{i}.n") >= F.lit(threshold) * F.greatest("n", f"l{i}.n")
        least = F.array_min(F.array_intersect("keys", f"l{i}.led")) == F.col("key")
        return F.when((F.col("root") != F.col(f"l{i}.of")) & sizes & _few_bits("", f"l{i}.", max_bits) & least, F.col(f"l{i}.node"))

    met = F.array_compact(F.array(*(near(i) for i in range(LEADERS))))
    rows = keyed.join(found.hint("merge"), "key").select("node", met.alias("met")).where(F.size("met") > 0)
    pairs = rows.select("node", F.explode("met").alias("v"))
    return pairs.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def _shared(sets: DataFrame) -> DataFrame:
    """(node, items): of sets(node, items) with different nodes the shingles that several nodes have, by their number, rarest first.

    Shingles are counted in buckets of their hashes, to which those of a node go in one row each.
    """
    total = sets.agg(F.sum(F.size("items"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ITEMS))

    def deal(batches):
        for batch in batches:
            column = batch.column("items")
            items, owner = column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            bucket = (mix(items.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((bucket, owner))
            items, owner, bucket = items[order], owner[order], bucket[order]
            starts = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(bucket, prepend=-1))
            lists = list_array(items, np.diff(np.append(starts, len(items))), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), batch.column("node").take(pa.array(owner[starts])), lists], ["bucket", "node", "items"])

    def count(rows: pa.Table) -> pa.Table:
        column = rows.column("items").combine_chunks()
        items, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
        _, at, counts = np.unique(items, return_inverse=True, return_counts=True)
        has = counts[at]
        left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[has > 1], minlength=len(sizes))
        lists = (list_array(x[has > 1], left, pa.int64()) for x in (has, items))
        return pa.Table.from_arrays([rows.column("node"), *lists], ["node", "has", "items"]).filter(pa.array(left > 0))

    dealt = small_batches(sets.select("node", "items")).mapInArrow(deal, "bucket long, node long, items array<long>")
    counted = dealt.groupBy("bucket").applyInArrow(count, "node long, has array<long>, items array<long>")
    ordered = counted.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("has", "items")))).alias("order"))
    return ordered.select("node", F.col("order.items").alias("items"))


def _prefix_pairs(apart: DataFrame, sets: DataFrame, threshold: float, max_bits: int) -> DataFrame:
    """(u, v): all pairs of apart(node, n, print0, ..., root) with different roots that may be similar enough, by a prefix filter.

    Shingles are ordered by the number of nodes that have them, rarest first. Of a set of n, all but ceil(2 t n / (1 + t)) - 1 are its
    own prefix and all but ceil(t n) - 1 the one it probes with: of two sets at similarity t, the smaller one's own prefix and the
    larger one's probe share a shingle (Xiao, Wang, Lin and Yu, 2008). In texts of one template these are the shingles of their own
    edits, so texts below the threshold do not meet. The join holds its conditions itself: a pair comes out once, at the first shingle
    that both look by (again only past HEAD of them), if enough may be common from there on and it is within max_bits.
    """
    # a little below the bound, for rounding: a longer prefix only costs work
    past = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1
    probe, own = past(threshold), past(2 * threshold / (1 + threshold))
    ranked = _shared(sets.join(apart.select("node"), "node", "left_semi")).join(apart, "node")
    # shingles of nobody else come first in the order and link nothing
    ranked = ranked.withColumn("alone", F.col("n") - F.size("items")).withColumn("items", F.slice("items", 1, F.greatest(probe - F.col("alone"), F.lit(0)).cast("int")))
    rows = ranked.withColumn("head", F.slice("items", 1, HEAD)).select("*", F.posexplode("items").alias("pos", "item"))
    rows = rows.withColumn("at", F.col("alone") + F.col("pos") + 1).withColumn("before", F.slice("head", 1, F.least("pos", F.lit(HEAD))))
    rows = saved(rows.select("item", (F.col("at") <= own).alias("own"), "pos", "at", "before", "node", "n", "root", *PRINTS), "postings")
    # nor does one that only a single root's nodes look by
    torn = rows.groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own").alias("any")).where("lo < hi and any")
    rows = saved(rows.join(torn.select("item"), "item", "left_semi"), "postings")
    a, b = rows.where("own").alias("a"), rows.alias("b")
    after = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    sizes = F.col("a.n") >= F.lit(threshold) * F.col("b.n")
    # a pair meets at the first shingle that both have; what may be common is then that one and what follows, and before it what lies past the heads
    first = ~F.arrays_overlap("a.before", "b.before")
    past_heads = sum(F.greatest(F.col(f"{x}.pos") - HEAD, F.lit(0)) for x in "ab")
    common = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + past_heads
    enough = common >= F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-6
    here = (F.col("a.item") == F.col("b.item")) & (F.col("a.root") != F.col("b.root")) & after & sizes & enough & first
    met = a.join(b.hint("merge"), here & _few_bits("a.", "b.", max_bits))
    return met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def similar_groups(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, component_id) for each row of docs(doc_id, text, ...) that has a doc_id.

    component_id is the least doc_id reachable over pairs whose sets of shingles have a Jaccard similarity of at least
    `threshold`; a pair at it shares no segment value with probability MISSED, more similar ones less often. Pairs that share one
    meet there, or, where it has over MANY rows, at its leaders or in an exact search of all rows of such values. Texts with the same
    words are one node of the search, and so are null and wordless ones. Texts of any length are taken whole. Repeated
    rows each stay. Empty table: no rows. Other columns are ignored.
    """
    ids, groups = _similar(docs, **settings)
    return ids.join(groups, "node").select("doc_id", "component_id")


def _similar(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, hot: int = HOT, sampled: int = SAMPLED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row that has a doc_id, and (node, root, component_id) of each node; rows of one group have one root."""
    docs = docs.where("doc_id is not null")
    n_texts = docs.count()
    segments, bits, max_bits, first_bits, late_bits = wide_segments(n_texts, threshold)
    signed = saved(_signatures(docs, segments, bits, shingle), "signatures")
    nodes = saved(signed.drop("doc_id").dropDuplicates(["node"]), "nodes")
    ids = saved(signed.select("doc_id", "node"), "ids")
    used_up(signed)
    classes = ids.groupBy("node").agg(F.min("doc_id").alias("rep"))
    hot_keys = saved(_hot_keys(nodes, n_texts, hot, sampled), "hot")
    keyed = nodes.select("node", PRINTS[0], F.explode("keys").alias("key"))
    met = saved(_meetings(keyed.join(F.broadcast(hot_keys), "key", "left_anti"), first_bits), "met")
    crowded = met.where(F.col("rows") > MANY).select("key", "node").union(keyed.join(F.broadcast(hot_keys), "key", "left_semi").select("key", "node"))
    listed = crowded.groupBy("node").agg(F.collect_list("key").alias("keys")).join(nodes.select("node", "n", *PRINTS), "node")
    listed = saved(listed, "segments")

    # texts move only for one document of each node that has a candidate, and that once
    def sets_of(nodes: DataFrame) -> DataFrame:
        # written down, so that Spark knows the size before it decides whether texts must be shuffled
        wanted = saved(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")), "wanted")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
        return saved(_sets(texts, shingle).dropDuplicates(["node"]), "shingles")

    def with_sets_of(wanted: DataFrame, sets: DataFrame) -> DataFrame:
        lacking = saved(wanted.join(sets, "node", "left_anti"), "lacking")
        return sets if lacking.isEmpty() else sets.union(sets_of(lacking))

    def with_roots() -> tuple[DataFrame, DataFrame]:
        roots = components(links)
        # a row a node: its keys come apart after the join
        here = listed.join(roots, "node", "left").select("node", "n", *PRINTS, "keys", F.coalesce("root", "node").alias("root"))
        return roots, here.select("*", F.explode("keys").alias("key"))

    pairs = saved(_near_enough(_first_pairs(met), nodes, threshold, max_bits), "pairs")
    nodes_of = lambda pairs: pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = sets_of(nodes_of(pairs))
    links = saved(_verified(pairs, sets, threshold), "links")
    roots, grouped = with_roots()
    # leaders join what is large; that only spares the exact search work
    for salt in range(1, ROUNDS + 1):
        fresh_pairs = saved(_candidates(grouped, threshold, max_bits, salt).join(pairs, ["u", "v"], "left_anti"), "pairs")
        if fresh_pairs.isEmpty():
            break
        sets = with_sets_of(nodes_of(fresh_pairs), sets)
        more = saved(_verified(fresh_pairs, sets, threshold), "links")
        pairs = pairs.union(fresh_pairs)
        if more.isEmpty():
            break
        links = links.union(more)
        roots, grouped = with_roots()
    # what values of a few rows more still hold apart
    between = met.where((F.col("rows") > BACK + 1) & (F.col("rows") <= MANY)).select("key", "node")
    between = between.join(nodes.select("node", "n", *PRINTS[: LATE // 64]), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    late = _late_meetings(between, late_bits).join(pairs, ["u", "v"], "left_anti")
    late = saved(_near_enough(late, nodes, threshold, max_bits), "pairs")
    if not late.isEmpty():
        sets = with_sets_of(nodes_of(late), sets)
        more = saved(_verified(late, sets, threshold), "links")
        pairs = pairs.union(late)
        if not more.isEmpty():
            links = links.union(more)
            roots, grouped = with_roots()
    # what crowded values still hold apart, exactly
    torn = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    here = grouped.select("node", "root", "key").join(torn, "key", "left_semi").select("node", "root").distinct()
    apart = saved(here.join(nodes.select("node", "n", *PRINTS), "node"), "apart")
    if not apart.isEmpty():
        sets = with_sets_of(apart.select("node"), sets)
        rest = saved(_prefix_pairs(apart, sets, threshold, max_bits).join(pairs, ["u", "v"], "left_anti"), "pairs")
        more = saved(_verified(rest, sets, threshold), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)

    linked = roots.join(classes, "node").select("node", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = linked.join(least, "root").select("node", "root", "least")
    groups = classes.join(moved, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    return ids, saved(groups, "groups")


def keep_dissimilar(docs: DataFrame, **settings) -> DataFrame:
    """docs without near copies: the row with the least doc_id of each group of similar_groups stays, of repeated rows one.

    Rows that share a doc_id are told apart by their words, so that each is kept or dropped with its own group. Rows without a
    doc_id can't be told apart and stay as they are.
    """
    ids, groups = _similar(docs, **settings)
    # one text a group: of those that share the least doc_id the one with the least node
    found = ids.join(groups, "node").where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("node"))
    kept, node, other = (fresh(docs, name) for name in ("kept", "node", "kept_node"))
    stay = saved(found.select(F.col("doc_id").alias(kept), F.col("node").alias(node)), "kept")
    shared = saved(ids.groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias("rows")).where("rows > 1").select(kept), "shared")
    own = F.col("doc_id") == F.col(kept)
    unnamed = docs.where("doc_id is null")
    # the same plan at every size: the list of ids to keep grows with the input
    if shared.isEmpty():
        return docs.join(stay.select(kept).hint("merge"), own).drop(kept).union(unnamed)
    once = docs.join(stay.join(shared, kept, "left_anti").select(kept).hint("merge"), own).drop(kept)
    told = _with_node(docs.join(shared, own, "left_semi"), node).join(stay.withColumnRenamed(node, other), own & (F.col(node) == F.col(other)))
    return once.union(told.dropDuplicates(["doc_id", node]).select(*docs.columns)).union(unnamed)


def _with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs and the node that each row's text stands for."""

    def run(batches):
        for batch in batches:
            made = pa.array([shingles(x)[0] for x in bytes_of(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is the component_id of found(doc_id, component_id), one of each, and those without a doc_id."""
    kept, rows = fresh(docs, "kept"), fresh(docs, "rows")
    found = found.where("doc_id is not null")
    stay = saved(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias(rows)), "kept")
    # the same plan at every size: the list of ids to keep grows with the input
    here = docs.join(stay.hint("merge"), F.col("doc_id") == F.col(kept)).drop(kept)
    once, again = here.where(F.col(rows) == 1).drop(rows), here.where(F.col(rows) > 1).drop(rows)
    return once.union(again.dropDuplicates(["doc_id"])).union(docs.where("doc_id is null"))
