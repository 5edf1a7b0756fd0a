"""Homomorphic multiset hashes of documents, with DataFrame functions only.

A paragraph (a line that is not empty) is hashed into a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, each
lane modulo 2^32. So the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector: the
fingerprint of an edited text is that of the text, less what was taken out, plus what was put in (`add`, `remove`).

A vector has 8 lanes from the paragraph's SHA-256, which tell multisets apart; one lane that counts the paragraph's pairs of neighbouring words
(the last word is a pair with nothing); and 64 lanes, each the number of those pairs whose MD5 has a certain bit. From the last, as sums of
signs, the cosine of two documents' counts of pairs is estimated, with a deviation of 1/8 at most (`likeness`).

Words are exploded and summed up again in the task that has the document, in whole-stage code: two lanes lie in one long, so 41 sums do.

Defined cases: a null text is empty; a text without paragraphs has the fingerprint of zeros, which is like another one (1) and like no other
text (0); very long texts (up to 2^31 words) are exploded row by row; rows that repeat with the same id and text are one document for what follows
it, and each gets its row; of rows with one id the smaller MD5 of the text comes first; null ids come last; the only document follows itself; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import cut, forget

EXACT, SIGNS = 8, 64
LANES = EXACT + 1 + SIGNS
_SPACE = r"[\x09-\x0D ]+"
_MODULUS = 1 << 32


def _number(hexes: Column, at: int) -> Column:
    """Eight hexadecimal digits as a number."""
    return F.conv(F.substring(hexes, at, 8), 16, 10).cast("long")


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def lanes(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, lanes (array of long, modulo 2^32): the sum of the vectors of the paragraphs of all texts with the same keys, none of them null. If rows are
    partitioned by some of the keys already, nothing is shuffled."""
    paragraphs = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda p: p != "")
    each = rows.select(*keys, F.explode_outer(paragraphs).alias("__p"))
    words = F.filter(F.split("__p", _SPACE), lambda w: w != "")
    each = each.select(*keys, "__p", words.alias("__w"))
    pairs = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(0))).alias("b"))
    each = each.select(*keys, "__p", F.posexplode_outer(pairs).alias("__at", "__pair"))
    first = F.col("__p").isNotNull() & (F.coalesce("__at", F.lit(0)) == 0)  # the row that has the paragraph's own hash
    pair = F.when(F.col("__pair").isNotNull(), F.md5(F.concat(F.col("__pair.a"), F.lit(" "), F.coalesce(F.col("__pair.b"), F.lit("")))))
    each = each.select(*keys, F.when(first, F.sha2("__p", 256)).alias("__sha"), pair.alias("__md5"))
    both = F.when(F.col("__md5").isNotNull(), _number(F.col("__md5"), 1) + F.shiftleft(_number(F.col("__md5"), 9), 32))
    each = each.select(*keys, "__sha", F.coalesce(both, _long(0)).alias("__bits"), F.col("__md5").isNotNull().cast("long").alias("__one"))
    exact = [F.sum(F.when(F.col("__sha").isNotNull(), _number(F.col("__sha"), 1 + 8 * i)).otherwise(_long(0))).alias(f"__e{i}") for i in range(EXACT)]
    signs = [F.sum(F.shiftrightunsigned("__bits", i).bitwiseAND(_long(_MODULUS + 1))).alias(f"__s{i}") for i in range(SIGNS // 2)]
    sums = each.groupBy(*keys).agg(*exact, F.sum("__one").alias("__n"), *signs)
    low = [F.col(f"__s{i}").bitwiseAND(_long(_MODULUS - 1)) for i in range(SIGNS // 2)]
    high = [F.shiftrightunsigned(f"__s{i}", 32) for i in range(SIGNS // 2)]
    return sums.select(*keys, F.array(*[F.col(f"__e{i}") % _MODULUS for i in range(EXACT)], F.col("__n") % _MODULUS, *low, *high).alias("lanes"))


def add(a: Column, b: Column) -> Column:
    """Lanes of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y) % _MODULUS)


def remove(a: Column, b: Column) -> Column:
    """Lanes of multiset a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, _long(_MODULUS)))


def text_form(a: Column) -> Column:
    """Lanes as one text of 8 hexadecimal digits for each."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the counts of pairs of words behind two arrays of lanes, as estimated; 1 if all lanes are equal, 0 at least."""
    signed = lambda v: F.transform(F.slice(v, EXACT + 2, SIGNS), lambda c: (2 * c - v[EXACT]).cast("double"))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    x, y = signed(a), signed(b)
    size = F.sqrt(product(x, x) * product(y, y))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(x, y) / size)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each id. Texts with the same id are one multiset; null ids are one document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return lanes(rows, ["id"], "text").select(F.col("id").alias(id_col), text_form(F.col("lanes")).alias("fingerprint"))


def followers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 1_000_000) -> DataFrame:
    """id, key, md5 (both name a document), n_chars, copies, next_key and next_md5: for each document the one with the next larger id, after the last
    the first. Only ids and hashes are sorted, in ranges; each range learns where the next one begins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = docs.select(F.col(id_col).alias("id"), _key(id_col), F.unhex(F.md5(text)).alias("md5"), F.length(text).cast("long").alias("n_chars"))
    names = names.groupBy("id", "key", "md5", "n_chars").agg(F.count("*").alias("copies"))
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_at_once + 1)
    order = [F.col("id").asc_nulls_last(), F.col("md5")]
    ranged = cut(names.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "md5", "key").alias("place")
    begins = ranged.groupBy("range").agg(F.min(place).alias("place"))  # one row for each range
    every = Window.orderBy("range")
    after = F.coalesce(F.lead("place").over(every), F.first("place").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    begins = begins.select("range", after.alias("after"))
    inside = Window.partitionBy("range").orderBy(*order)
    led = ranged.withColumn("led", F.lead(F.struct("key", "md5")).over(inside)).join(F.broadcast(begins), "range")
    found = cut(led.select("id", "key", "md5", "n_chars", "copies", F.coalesce("led.key", "after.key").alias("next_key"), F.coalesce("led.md5", "after.md5").alias("next_md5")))
    forget(ranged)
    return found


def _key(id_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).alias("key")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, lanes, edited_lanes and next_lanes of every row. The edited text has, in place of its last floor(n_chars / 2)
    characters, as many (or all) of the first ones of the next document.

    Each text is shuffled once, and the first half of it to the document before it. The paragraphs before the edit are hashed once: the text has them
    and what is removed, the edited text has them and what is inserted."""
    links = followers(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(id_col), F.unhex(F.md5(text)).alias("md5"), text.alias("text"))
    if not links.where("copies > 1").isEmpty():
        rows = rows.dropDuplicates(["key", "md5"])
    to = links.select(F.col("next_key").alias("key"), F.col("next_md5").alias("md5"), F.col("key").alias("to_key"), F.col("md5").alias("to_md5"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    heads = rows.join(to.hint("merge"), ["key", "md5"]).select(F.col("to_key").alias("key"), F.col("to_md5").alias("md5"), F.left("text", F.col("half")).alias("head"))
    both = rows.join(links.hint("merge"), ["key", "md5"]).join(heads.hint("merge"), ["key", "md5"])
    stays = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    both = both.withColumn("begun", F.substring_index(F.left("text", stays), "\n", -1))  # the paragraph that the edit begins in
    before = stays - F.length("begun")
    both = both.withColumns({"kept": F.left("text", before), "removed": F.substring("text", before + 1, F.length("text")), "inserted": F.concat("begun", "head")})
    sha = F.unhex(F.sha2(F.concat("kept", "inserted"), 256))
    keys = ["key", "md5", "id_kept", "n_chars", "copies", "next_key", "next_md5", "edited_sha"]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col(c).alias("text")) for i, c in enumerate(("kept", "removed", "inserted"))])
    both = both.select("key", "md5", F.struct("id").alias("id_kept"), "n_chars", "copies", "next_key", "next_md5", sha.alias("edited_sha"), F.explode(parts).alias("p"))
    sums = lanes(both.select(*keys, "p.part", "p.text"), [*keys, "part"], "text")
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("lanes")))
    whole = sums.groupBy(*keys).agg(of(0).alias("a"), of(1).alias("b"), of(2).alias("c"))
    whole = cut(whole.select(*keys, add(F.col("a"), F.col("b")).alias("lanes"), add(F.col("a"), F.col("c")).alias("edited_lanes")))
    following = whole.select(F.col("key").alias("next_key"), F.col("md5").alias("next_md5"), F.col("lanes").alias("next_lanes"))
    out = whole.join(following.hint("merge"), ["next_key", "next_md5"])
    each = F.explode(F.sequence(_long(1), F.col("copies")))
    out = out.select(F.col("id_kept.id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), "lanes", "edited_lanes", "next_lanes", each.alias("copy")).drop("copy")
    return out
