"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

A document is its sequence of lines. A suffix starts at a line; its rank after
round ``k`` orders it by its first ``2^k`` lines. A round joins every suffix with
the one ``2^k`` lines on, and ranks the pairs of ranks. A pair that occurs once
has no repeat of that depth and leaves the array, so later rounds hold only
repeated runs, and the rounds end with the longest of them. Suffixes of equal rank
are a longest-common-prefix interval; all of them but the earliest mark their lines as
a later copy. Marked lines that touch are the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.llm.common import materialize, text_of

#: A line of more words than this, or one that is its whole document, is a run by itself.
LONG_WORDS = 50
BLANK = r"^[\x20\x09-\x0D]*$"
WORD = r"[^\x20\x09-\x0D]+"


def _dense(pairs: DataFrame) -> DataFrame:
    """``pairs`` with rank: places of distinct (a, b) in their order, from range partitions and the rows before them."""
    placed = materialize(pairs.repartitionByRange("a", "b").withColumn("part", F.spark_partition_id()), "line_ranks")
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("part").orderBy("a", "b"))
    return placed.withColumn("place", within).join(before, "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def repeated_lines(docs: DataFrame, min_lines: int = 2, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(k1, k2, n, depth): lines ``n .. n + depth - 1`` of a document repeat an earlier run.

    Runs have ``min_lines`` lines at least; one line is enough if it has more than ``long_words`` words or
    is the only line of its document that is not blank (None: never).

    ``n`` counts the lines that are not blank. (k1, k2) name a document: its id and text.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines is a power of two")
    text = text_of(docs)
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_key(docs), F.filter(F.split(text, "\n"), lambda x: ~x.rlike(BLANK)).alias("lines"))
    lines = named.select("doc_id", "k1", "k2", F.size("lines").alias("all"), F.posexplode("lines").alias("n", "line"))
    # A copy of a row with the same id and text is the same document.
    alone = F.lit(False) if long_words is None else F.when(F.length("line") > 2 * long_words, F.regexp_count("line", F.lit(WORD)) > long_words).otherwise(False) | (F.col("all") == 1)
    lines = lines.select("doc_id", "k1", "k2", "n", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), alone.alias("alone"))
    pairs = materialize(lines.distinct(), "lines")
    found, depth = None, 1
    while True:
        place = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "n")
        classes = pairs.groupBy("a", "b").agg(F.count("*").alias("rows"), F.min(place).alias("first")).where("rows > 1")
        ranks = materialize(_dense(classes), "line_classes")
        if ranks.isEmpty():
            break
        now = materialize(pairs.join(ranks, ["a", "b"]).withColumn("later", place > F.col("first")).select(
            "doc_id", "k1", "k2", "n", "rank", "later", *["alone"][:depth == 1]), "line_suffixes")
        if depth >= min_lines or depth == 1 and long_words is not None:
            marks = now.where("later" if depth >= min_lines else "later and alone").select("k1", "k2", "n", F.lit(depth).alias("depth"))
            found = marks if found is None else found.unionByName(marks)
        ahead = now.select("k1", "k2", (F.col("n") - depth).alias("n"), F.col("rank").alias("b"))
        pairs = now.select("doc_id", "k1", "k2", "n", F.col("rank").alias("a")).join(ahead, ["k1", "k2", "n"])
        depth *= 2
    if found is None:
        return pairs.select("k1", "k2", "n", F.lit(1).alias("depth")).where("false")
    return found


def _key(docs: DataFrame):
    return [F.xxhash64(docs["doc_id"].cast("long"), text_of(docs)).alias("k1"), F.xxhash64(text_of(docs)).alias("k2")]


def runs(docs: DataFrame, min_lines: int = 2, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(k1, k2, runs): sorted maximal runs (first, last) of later copies, in lines that are not blank."""
    marks = repeated_lines(docs, min_lines, long_words).groupBy("k1", "k2", "n").agg(F.max("depth").alias("depth"))
    order = Window.partitionBy("k1", "k2").orderBy("n")
    reach = F.max(F.col("n") + F.col("depth") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = marks.withColumn("new", F.when(reach >= F.col("n") - 1, 0).otherwise(1))
    islands = islands.withColumn("run", F.sum("new").over(order))
    spans = islands.groupBy("k1", "k2", "run").agg(F.min("n").alias("first"), F.max(F.col("n") + F.col("depth") - 1).alias("last"))
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(docs: DataFrame, min_lines: int = 2, long_words: int | None = LONG_WORDS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed and n_runs of every document.

    Runs of at least ``min_lines`` lines that occur earlier, by doc_id and line, go,
    overlaps with the earlier run included; so does a single line of more than ``long_words`` words that occurs
    earlier, and one that is all of its document. Blank lines stay and do not part a
    run; a null text is empty. Null ids come last; repeated rows are one
    document, whose result every row gets. Lines compare by two 64-bit hashes.
    """
    found = runs(docs, min_lines, long_words)
    own = docs.select(docs["doc_id"], text_of(docs).alias("text"), *_key(docs))
    joined = own.join(found, ["k1", "k2"], "left")
    lines = F.split("text", "\n")
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~F.get("lines", i).rlike(BLANK))
    # Runs in all lines: the places of the lines that are not blank translate them.
    gone = F.flatten(F.transform("runs", lambda r: F.slice("full", r["first"] + 1, r["last"] - r["first"] + 1)))
    cut = joined.withColumn("lines", lines).withColumn("full", F.when(F.col("runs").isNotNull(), full))
    cut = cut.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i)), "\n"))
    return cut.select(
        "doc_id", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"))


def report(docs: DataFrame, min_lines: int = 2, long_words: int | None = LONG_WORDS) -> DataFrame:
    return dedup(docs, min_lines, long_words).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))
