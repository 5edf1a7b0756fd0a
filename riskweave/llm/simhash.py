"""Near-duplicate classes by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some value lies within r/2 bits of both. With r = 4 every fingerprint of 64 bits
would send out 2,081 variants. Halves come first here, by the same argument: of two fingerprints that differ in 4 bits or fewer, one
half of 32 bits differs in 2 or fewer, so each half sends out its variants within 1 bit (66 in all), and the shuffle is on them. A
variant that few fingerprints share is settled by comparing them. In any other variant all are compared with three of it, and the
components so far are found; then only links between components are missing, so a variant of one component is done, and where few stand
apart from the largest component they are compared with all. The fingerprints of what is left send out their whole ball of
2,081: whoever meets there is within 4 bits, so each links to the smallest of the meeting and no pairs are listed. Only distinct
fingerprints take part, and at most 2,081 of them can meet in one variant of a ball, so no group grows with the number of copies.

By chance alone 33 N / 2^32 of N distinct fingerprints share a variant of a half, so halves help less as N grows. Beyond `halves_up_to`
of them (where four meet by chance) all send out their whole balls directly.

Components are found by alternating large-star and small-star steps over links, cut by checkpoints. Components and fingerprints that
many share are broadcast as small tables of bounded length, so that their rows never meet in one task.

Defined cases: a null text is empty, and its fingerprint is 0; texts of fewer words than a shingle have one shingle, all their words;
very long texts are read whole, in a block of their own; repeated rows and equal fingerprints share a class; a component of null ids
alone has a null component_id, else nulls don't count; an empty table gives an empty result; other columns are carried along and never
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import cut, forget, fresh, join_groups
from riskweave.llm.pretokens import blocks

_BLOCK = 8 << 20
_AT_ONCE = 100_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text's shingles of words, as a signed number."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z, and white space 09-0D and 20
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = digest(b" ".join(words), seed)
        return h - (h >> 63 << 64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), _AT_ONCE):
        h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[i : i + _AT_ONCE], stops[i : i + _AT_ONCE], strict=True)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    h = int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")
    return h - (h >> 63 << 64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id, content (a 64-bit hash of the text) and fp of every row."""

    def run(batches):
        import pyarrow as pa

        for part, texts in blocks(batches, 2, _BLOCK):
            found = [fingerprint(t, shingle, seed) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.int64())], names=["id", "content", "fp"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, content long, fp long")


def _within(bits: int, radius: int, shift: int = 0) -> list[int]:
    """All masks of up to `radius` bits, as signed 64-bit numbers."""
    from itertools import combinations

    masks = (sum(1 << (i + shift) for i in c) for k in range(radius + 1) for c in combinations(range(bits), k))
    return [m - (m >> 63 << 64) for m in masks]


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 4


def ball_links(fps: DataFrame) -> DataFrame:
    """Links a > b between fingerprints that meet in some variant within 2 bits of both: those of all pairs within 4 bits, as stars."""
    masks = F.array(*[F.lit(m) for m in _within(64, 2)])
    balls = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    meetings = balls.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 2,081 at most
    return meetings.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a > b")


def classes(fps: DataFrame, compared: int = 16, halves_up_to: int = 1 << 29) -> DataFrame:
    """node and label (the smallest of its component) of the distinct fingerprints (column fp) that have others within 4 bits, over any
    number of steps. A variant that more than `compared` fingerprints share is a crowd; so is what stands apart in it."""
    n = fps.count()
    fps = fps.repartition(n // 50_000 + 1, "fp")  # each row becomes very many: not as few tasks as the table has files
    if n > halves_up_to:
        return components(ball_links(fps).distinct())
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    # Bit 32 tells the halves apart.
    keys = [low.bitwiseXOR(F.lit(m)) for m in _within(32, 1)] + [high.bitwiseXOR(F.lit(m + (1 << 32))) for m in _within(32, 1)]
    sent = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = cut(sent.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.col("n") > len(keys) * n / 4096  # fewer than 4,096
    if shared.where(hot).isEmpty():
        met = cut(sent.join(shared.hint("merge"), "key"))
    else:
        small = F.broadcast(shared.where(hot))
        rest = sent.join(small.select("key"), "key", "left_anti").join(shared.where(~hot).hint("merge"), "key")
        met = cut(rest.unionByName(sent.join(small, "key")))
    forget(shared)
    few = met.where(F.col("n") <= compared)
    # A merge join, as these tables are far larger in memory than as files, by which small ones are told.
    pairs = few.select("key", F.col("fp").alias("b")).hint("merge").join(few.select("key", F.col("fp").alias("a")), "key").where("a > b")
    near = pairs.where(_close("a", "b")).select("a", "b").distinct()
    many = met.where(F.col("n") > compared).select("key", "fp", ((F.col("key") == low) | (F.col("key") == high + F.lit(1 << 32))).alias("own"))
    if many.isEmpty():
        found = components(near)
        forget(met)
        return found
    # Everyone in a shared variant is compared with three of it: most of a crowd is one component after that.
    three = many.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("p1"), F.min(F.when(F.col("own"), F.col("fp"))).alias("p2"), F.min_by("fp", F.xxhash64("fp")).alias("p3"))
    beside = cut(join_groups(many.select("key", "fp"), cut(three), ["key"], "n", "fp"))
    for p in ("p1", "p2", "p3"):
        linked = beside.where((F.col("fp") != F.col(p)) & _close("fp", p))
        near = near.union(linked.select(F.greatest("fp", p).alias("a"), F.least("fp", p).alias("b")))
    known = components(near.distinct())
    crowd = cut(beside.select("key", "fp").join(known.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    forget(beside)
    more = cut(_between(crowd, known, compared))
    if not more.isEmpty():
        # Only components are still to be joined: the same steps over their labels.
        joined = cut(components(more).select(F.col("node").alias("label"), F.col("label").alias("root")))
        alone = joined.select("label").join(known.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), "label")
        sizes = known.union(alone).groupBy("label").agg(F.count("*").alias("n")).join(joined, "label", "left")
        both = join_groups(known.union(alone), cut(sizes), ["label"], "n", "node")
        known = cut(both.select("node", F.coalesce("root", "label").alias("label")))
    for table in (met, crowd):
        forget(table)
    return known


def _between(crowd: DataFrame, known: DataFrame, compared: int) -> DataFrame:
    """Links a > b between labels of components that have fingerprints within 4 bits. crowd: key, fp, label of crowded variants."""
    shares = crowd.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    mixed = cut(mixed.select("key", F.col("most.label").alias("main"), (F.col("n") - F.col("most.n")).alias("others"), "n"))
    left = join_groups(crowd, mixed, ["key"], "n", "fp").where("main IS NOT NULL")  # a variant of one component has no links to give
    here = left.where(F.col("others") <= compared).select("key", F.col("fp").alias("b"), F.col("label").alias("b_label"))
    strays = left.where((F.col("others") <= compared) & (F.col("label") != F.col("main"))).select("key", F.col("fp").alias("a"), F.col("label").alias("a_label"))
    found = strays.join(here.hint("merge"), (strays["key"] == here["key"]) & (F.col("a_label") != F.col("b_label")) & _close("a", "b")).select("a_label", "b_label")
    stars = ball_links(left.where(F.col("others") > compared).select("fp").distinct())
    for c in ("a", "b"):
        stars = stars.join(known.select(F.col("node").alias(c), F.col("label").alias(f"{c}_known")), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_known", c))
    every = found.union(stars.select("a_label", "b_label")).where("a_label != b_label")
    return every.select(F.greatest("a_label", "b_label").alias("a"), F.least("a_label", "b_label").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of the links a > b, as a table that is cut. Steps go on until
    nothing changes; they halve the distance to the smallest node, so they are few. Joins are between tables, so adaptive execution deals a node with very
    many links over several tasks."""
    edges = cut(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = cut(both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        nearest = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(nearest.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.union(nearest.select("a", F.col("m").alias("b"))).where("a > b").distinct())
        for table in (edges, least, large, nearest):
            forget(table)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    found = cut(labels.union(roots))
    forget(edges)
    return found


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, compared: int = 16) -> DataFrame:
    """id, content, fp, label and component_id (the smallest id of the component) of every row."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    labels = classes(fps.select("fp"), compared)
    known = cut(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    ids = cut(known.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    named = cut(join_groups(known.select("fp", "label", "n"), ids, ["label"], "fps", "fp"))
    return join_groups(rows, named, ["fp"], "n", "id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with the smallest id (nulls last)."""
    key, content = fresh(docs, "key", "content")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = near_classes(docs, id_col, text_col, shingle, seed)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("first"))
    keepers = first.select(name(F.col("first.id")).alias(key), F.col("first.content").alias(content))
    own = docs.withColumns({key: name(F.col(id_col)), content: F.xxhash64(text_col)})
    return own.join(keepers, [key, content], "left_semi").dropDuplicates([key, content]).drop(key, content)
