"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of ``BLOCK`` bytes.  Blocks are sorted and grouped, each distinct one gets an integer
name, and adjacent names are named as pairs, level after level, until one name is left.  With the byte length this is
a collision-free identity: equal lengths give equal tree shapes, and at each level a name stands for one content.

Whole texts cross the network once.  Blocks are grouped by a 64-bit hash, and the smallest and largest block of each hash
are compared: where they are equal, every block of that hash is the same.  Where they differ (a hash clash), the blocks
themselves are ranked, so equality never rests on a hash.  The grouping combines copies before the shuffle, and names are
joined back on long keys, which Spark splits where one of them is hot.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

BLOCK = 4096  #: bytes in a block
NAME_BUCKETS = 4096  #: buckets in which distinct keys are sorted and numbered


def fold_case(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is the empty text."""
    plain = F.octet_length(text) == F.char_length(text)  # lower() changes ASCII texts in A-Z only, and is faster
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(folded, F.lit(""))


def _with_names(keys: DataFrame, columns: list[str]) -> DataFrame:
    """An integer for every distinct key: its rank among the sorted keys of its bucket, below the bucket's number."""
    keys = keys.select(*columns).distinct().withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(NAME_BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*columns))
    return keys.select(*columns, (F.shiftleft(F.col("_bucket"), 40) + rank).alias("name"))


def _blocks() -> Column:
    at = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    return F.transform(at, lambda i: F.substring(F.col("bytes"), i * BLOCK + 1, F.lit(BLOCK)))


def identities(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, bytes, sha256, name) per row; rows have equal texts exactly if (bytes, name) are equal, whatever the hash."""
    folded = docs.select(F.col(id_col).cast("long").alias("id"), fold_case(F.col(text_col).cast("string")).cast("binary").alias("bytes"))
    folded = folded.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / BLOCK).cast("int")))
    rows = folded.select(
        "id", F.monotonically_increasing_id().alias("rid"), F.octet_length("bytes").alias("size"), F.sha2("bytes", 256).alias("sha256"),
        "n_blocks", F.transform(_blocks(), lambda b: block_hash(b)).alias("hashes"),
    )
    rows = scratch.save(rows, "rows")

    blocks = folded.select(F.explode(_blocks()).alias("block")).select(block_hash(F.col("block")).alias("h"), "block")
    groups = blocks.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    groups = scratch.save(groups.select("h", (F.col("lo") == F.col("hi")).alias("single")), "groups")
    parts = rows.select("rid", "n_blocks", F.posexplode("hashes").alias("seq", "h"))
    if groups.where("not single").isEmpty():
        parts = parts.withColumn("rank", F.lit(0))
        keys = groups.select("h", F.lit(0).alias("rank"))
    else:
        clashing = groups.where("not single").select("h")
        ranked = blocks.join(clashing, "h", "left_semi").distinct()
        ranked = scratch.save(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("block"))), "clashes")
        # the texts are cut once more to rank the clashing blocks of each; a row's number is its own run's only, so the
        # ranks come back by id and digest (rows equal in both have equal texts, or the digest is broken)
        again = folded.select("id", F.sha2("bytes", 256).alias("sha256"), F.posexplode(_blocks()).alias("seq", "block")).withColumn("h", block_hash(F.col("block")))
        own = again.join(ranked, ["h", "block"]).select(F.col("id").alias("_id"), F.col("sha256").alias("_sha256"), "seq", "rank").distinct()
        own = rows.select("rid", "id", "sha256").join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha256") == F.col("_sha256"))).select("rid", "seq", "rank")
        parts = parts.join(own, ["rid", "seq"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
        keys = groups.where("single").select("h", F.lit(0).alias("rank")).union(ranked.select("h", "rank"))
    level = parts.join(_with_names(keys, ["h", "rank"]), ["h", "rank"]).select("rid", "n_blocks", F.col("seq").cast("long").alias("seq"), "name")
    level = scratch.save(level, "level-0")

    done, depth = [level.where("n_blocks = 1").select("rid", "name")], 0
    most = rows.agg(F.max("n_blocks")).first()[0] or 1
    while 1 << depth < most:
        pairs = level.where(F.col("n_blocks") > 1 << depth).groupBy("rid", "n_blocks", F.shiftright("seq", 1).alias("seq")).agg(
            F.max(F.when(F.col("seq") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("seq") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = scratch.save(pairs, f"pairs-{depth}")
        depth += 1
        level = pairs.join(_with_names(pairs, ["left", "right"]), ["left", "right"]).select("rid", "n_blocks", "seq", "name")
        level = scratch.save(level, f"level-{depth}")
        done.append(level.where(F.col("n_blocks") <= 1 << depth).select("rid", "name"))
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return rows.join(named, "rid").select("id", F.col("size").alias("bytes"), "sha256", "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row: of equal texts the row of the largest id stays.

    Texts are equal when identical after lower-casing A-Z only; null is the empty text, and empty texts are copies of
    one another.  Repeated rows (same id, same text) are counted each; the kept id is marked kept in every repeat.  A
    null id counts in its group and is kept only where its group has no other.  An empty table gives no rows; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    named = scratch.save(identities(docs, scratch, id_col, text_col), "named")
    groups = named.groupBy("bytes", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    out = named.join(groups, ["bytes", "name"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def exact_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of several rows of the id that stays, the one of the least text in byte order stays (`HELLO`, not `hello`); of those with
    equal texts the least as JSON.  So the result does not depend on how the rows are partitioned.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    keep = exact_duplicates(docs, id_col, text_col).where("kept").groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).count()
    keep = scratch.save(keep, "keep")
    sha = F.sha2(fold_case(F.col(text_col).cast("string")).cast("binary"), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("rid"), sha.alias("rsha"))
    of = lambda kept: rows.join(kept, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rsha") == F.col("sha")), "left_semi")
    if keep.where("count > 1").isEmpty():
        return of(keep).select("row.*")
    repeated = of(keep.where("count > 1")).withColumn("order", F.struct(F.col("row")[text_col].cast("string").alias("text"), F.to_json("row").alias("all")))
    chosen = repeated.groupBy("rid", "rsha").agg(F.min_by("row", "order").alias("row"))
    return of(keep.where("count = 1")).select("row").union(chosen.select("row")).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
