"""Document fingerprints: canonical exact digests, in DataFrame and SQL functions only.

A text is brought to one form (NFKC, full case folding, NFKC again, runs of white space to one space, ends trimmed) and hashed by
two xxhash64 of different seed text: 128 bits. Documents of equal hash form a bucket; inside a bucket the canonical bytes
themselves are compared, so a class holds equal canonical texts only, even after a collision.

Defined cases: a null text is empty; equal texts have equal fingerprints; a null doc_id is an id before all others; rows of one doc_id
are ordered by their text's hash; the likeness of two fingerprints is 1 for equal canonical texts, else 0; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of buckets with several rows that may be broadcast; beyond it, the join is a shuffled one.
BROADCAST_KEYS = 400_000
#: Consecutive documents that are looked at together.
BLOCK = 64
SUPERBLOCK = 65_536
#: Parts that quantiles of the ids make.
CUTS = 64
SPACE = r"[\s\u0085   -     　]+"


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC; white space folded. ICU, which Spark carries, is called by Spark's own reflect function."""
    nfkc = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold), SPACE, " "))


def fingerprint(canon: Column) -> Column:
    return F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0"))


def classes(docs: DataFrame) -> DataFrame:
    """fingerprint, class_id (smallest doc_id of equal canonical bytes), n_docs; one row per distinct canonical text that several rows have.

    Counting is over hashes alone. Only texts of buckets with several rows are then grouped by (hash, bytes): the grouping compares
    bytes inside equal hashes, and copies fold together on the map side, so a hot group sends one row per task.
    """
    keyed = docs.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", fingerprint(F.col("canon")))
    many = keyed.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    small = many.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    held = keyed.join(F.broadcast(many) if small else many, "fingerprint", "left_semi")
    return held.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs")).drop("canon")


def blocks(docs: DataFrame, doc_id: Column, order: Column) -> Column:
    """The number of a row's block; blocks are in the order of rows. Quantiles of all ids cut them into CUTS parts of about as many rows, each of which is dealt evenly, so ids that lie far
    from all others, or ids spread over all 64 bits, do not put many rows into one block. Rows without an id are dealt by order, a 64-bit hash and the next key of their order."""
    got = docs.agg(F.percentile_approx("doc_id", [k / CUTS for k in range(CUTS + 1)], 20 * CUTS).alias("q"), F.min("doc_id").alias("lo"), F.count("doc_id").alias("n")).first()
    cuts = sorted({got.lo, *got.q}) if got.n else [0]
    parts = max(1, got.n // (CUTS * BLOCK))
    at = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda k, c: k + F.when(doc_id >= c, 1).otherwise(0))  # 1 to len(cuts)
    of = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), at - 1)
    inside = (doc_id.cast("double") - of(cuts)) / of([max(b - a, 1) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)])
    block = at.cast("long") * F.lit(1 << 32) + F.least(F.floor(inside * parts), F.lit(parts - 1)).cast("long")
    return F.coalesce(block, F.shiftright(order, 48) - (1 << 17), F.lit(-1).cast("long"))


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: of each and of the next document by ascending doc_id (after the last: the first).

    Documents are dealt out by blocks of about BLOCK consecutive ones, so a whole text moves once; the last of each block finds its
    successor through the first documents of the blocks, of which only ids are sorted, in blocks again.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # never null, so that no filter on it is pushed below the exchange and all branches share one
    base = base.withColumn("block", blocks(base, F.col("doc_id"), F.xxhash64("text")))
    base = base.withColumn("canon", canonical(F.col("text"))).withColumn("fp", fingerprint(F.col("canon"))).drop("canon")
    w = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "fp")
    mine = base.select("*", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp"), F.lag(F.lit(True)).over(w).isNull().alias("head"))
    # the block after each block, by ids alone; its first document comes from the same exchange as all the others
    sup = Window.partitionBy("sup").orderBy("block")
    heads = base.select("block").distinct().withColumn("sup", F.floor(F.col("block") / SUPERBLOCK).cast("long"))
    tops = heads.groupBy("sup").agg(F.min("block").alias("top"))
    tops = tops.select("sup", F.coalesce(F.lead("top").over(Window.orderBy("sup")), F.min("top").over(Window.orderBy("sup").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("top"))
    after = heads.select("block", "sup", F.lead("block").over(sup).alias("nb")).join(tops, "sup").select(F.col("block").alias("from_block"), F.coalesce("nb", "top").alias("block"))
    found = mine.where("head").select("block", F.col("text").alias("wrap_text"), F.col("fp").alias("wrap_fp")).join(after, "block").drop("block")
    last = mine.where("next_fp IS NULL").join(found, F.col("block") == F.col("from_block"), "left")
    last = last.select("doc_id", "text", "fp", F.col("wrap_text").alias("next_text"), F.col("wrap_fp").alias("next_fp"))
    return mine.where("next_fp IS NOT NULL").select("doc_id", "text", "fp", "next_text", "next_fp").unionByName(last)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    df = successors(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", fingerprint(canonical(F.col("edited"))).alias("edited_fingerprint"), "next_fp")
    one = classes(docs)
    per = one.groupBy("fingerprint").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n_texts"))
    like = lambda a, b: (a == b).cast("double")
    out = df.join(per.withColumnRenamed("fingerprint", "fp"), "fp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), "edited_fingerprint",
        like(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"), like(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.coalesce("n_texts", F.lit(1)) == 1, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )
