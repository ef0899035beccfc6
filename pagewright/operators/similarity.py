"""Similarity joins: all pairs of texts or sets over a threshold, without comparing all with all.

Sets are joined by prefixes: with members in one order, the rarest first, two sets that are alike enough share one of their first few members. Texts are joined by
pieces: an existing text is cut into one piece more than the edits that are allowed, so one piece is unchanged and hardly moved.

A member or piece that very many rows share is split: both sides' rows are dealt to parts of at most ``most`` rows, and each part of one side meets each
part of the other in a task of its own. Nothing is left out for being frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key on one side that one task gets.
MOST = 5_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """The inner join on ``keys``, a key's rows dealt to parts where it has over ``most`` on a side."""
    sizes = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(n))
    parts = sizes(left, "_left").join(sizes(right, "_right"), keys)

    def dealt(df: DataFrame, own: str, other: str, own_parts: str, other_parts: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        mine = F.pmod(F.xxhash64(*(values or keys)), F.col(own_parts)).cast("int")
        return df.join(parts, keys).select(*df.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)).alias(other))

    # rows are few beside the pairs that come of them, so tasks are not left to be merged by the size of what they read
    tasks, on = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_l", "_r"]
    a, b = dealt(left, "_l", "_r", "_left", "_right"), dealt(right, "_r", "_l", "_right", "_left")
    return a.repartition(tasks, *on).join(b.repartition(tasks, *on), on).drop("_l", "_r")


def similar_sets(df: DataFrame, text: str, members: Column, least: float, measure: str = "jaccard", most: int = MOST) -> DataFrame:
    """(a, b, similarity): all pairs a < b of distinct values of column ``text`` whose sets of ``members`` are alike.

    ``measure`` is jaccard or dice, ``least`` over 0. Null texts and empty sets are alike to nothing.
    """
    jaccard = least if measure == "jaccard" else least / (2 - least)
    own = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.array_distinct(F.filter(members, lambda x: x.isNotNull())).alias("s")).dropDuplicates(["t"])
    each = own.select("t", F.explode("s").alias("m"))
    counted = each.groupBy("m").agg(F.count("*").alias("n"))
    ordered = split_join(each, counted, ["m"], most=1_000_000).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x["m"]).alias("s"))  # one text's set
    size = F.size("s")
    first = ordered.withColumn("k", (size - F.ceil(size * F.lit(jaccard) - 1e-9) + 1).cast("int")).select("t", "s", F.slice("s", F.lit(1), F.col("k")).alias("p"))
    rows = first.select(F.explode("p").alias("m"), "t", "s", "p")
    a, b = (rows.select("m", *[F.col(c).alias(c + x) for c in ("t", "s", "p")]) for x in ("a", "b"))
    pairs = split_join(a, b, ["m"], most).filter("ta < tb")
    sizes = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * F.lit(jaccard) - 1e-9
    # a pair that shares several of its first members is met at the first of them alone
    pairs = pairs.filter(sizes & (F.array_intersect("pa", "pb")[0] == F.col("m")))
    both, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    alike = both / (total - both) if measure == "jaccard" else 2.0 * both / total
    return pairs.select(F.col("ta").alias("a"), F.col("tb").alias("b"), alike.alias("similarity")).filter(F.col("similarity") >= least - 1e-12)


def _marks(text: Column, width: int) -> Column:
    """64 bits: which of the text's runs of ``width`` letters there are, by their hashes."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (width - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(width)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    # never null: else a join on marks would look for nulls among them in every row that is read, copies too
    return F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x))), F.lit(0).cast("long"))


def similar_texts(new: DataFrame, old: DataFrame, least: float = 0.85, most: int = MOST) -> DataFrame:
    """(title, near, pos, similarity): all pairs of a new title and another existing one (title, pos) whose edit similarity is ``least`` or more.

    Titles are joined by (length, piece's number, piece). A pair that shares several pieces is met at the first of them alone, so pairs are never made
    distinct, and distances are counted no further than the edits allowed. An edit alters at most two of the letters that a text has and four of its pairs
    of letters, so most other pairs are told apart by bits. Empty titles are alike to nothing else.
    """
    edits = F.floor(F.col("_m") * ((1 - least) / least) + 1e-9).cast("int")  # that leave an existing title of length _m similar enough
    cut = lambda i: F.floor(i * F.col("_m") / (F.col("_e") + 1)).cast("int")
    piece = lambda text, at, i: F.substring(text, at + 1, cut(i + 1) - cut(i))
    first, last = lambda i: F.greatest(F.lit(0), cut(i) - F.col("_e")), lambda i: F.least(F.col("_n"), cut(i) + F.col("_e"))
    i = F.col("_i")
    lower, marks = F.lower("title"), [_marks(F.lower("title"), k) for k in (1, 2)]
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a title makes hundreds of rows
    o = old.select("title", "pos").distinct().repartition(tasks, "title").select(F.col("title").alias("near"), "pos", lower.alias("_u"), F.length(lower).alias("_m"), marks[0].alias("_y1"), marks[1].alias("_y2"))
    o = o.withColumn("_e", edits).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_e")))).withColumn("_piece", piece(F.col("_u"), cut(i), i)).drop("_e")
    reach = F.sequence(F.ceil(F.col("_n") * least - 1e-9).cast("int"), F.floor(F.col("_n") / least + 1e-9).cast("int"))
    n = new.select("title").distinct().repartition(tasks, "title").select("title", lower.alias("_t"), F.length(lower).alias("_n"), marks[0].alias("_x1"), marks[1].alias("_x2"))
    n = n.withColumn("_m", F.explode(reach)).withColumn("_e", edits).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_e"))))
    n = n.withColumn("_piece", F.explode(F.array_distinct(F.transform(F.sequence(first(i), last(i)), lambda at: piece(F.col("_t"), at, i))))).drop("_e")
    longest = F.greatest("_n", "_m")
    allowed = F.floor(longest * (1 - least) + 1e-9).cast("int")
    apart = lambda k: F.bit_count(F.col(f"_x{k}").bitwiseXOR(F.col(f"_y{k}")))
    pairs = split_join(n, o, ["_m", "_i", "_piece"], most).filter((F.col("title") != F.col("near")) & (apart(1) <= 2 * allowed) & (apart(2) <= 4 * allowed))
    pairs = pairs.withColumns({"_d": F.call_function("levenshtein", F.col("_t"), F.col("_u"), allowed), "_e": edits}).filter("_d >= 0")
    within = lambda j: F.substring(F.col("_t"), first(j) + 1, last(j) - first(j) + cut(j + 1) - cut(j))
    met = F.exists(F.sequence(F.lit(0), i), lambda j: (j < i) & (F.call_function("instr", within(j), piece(F.col("_u"), cut(j), j)) > 0))
    similarity = F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.col("_d") / longest)
    return pairs.filter(~met).select("title", "near", "pos", similarity.alias("similarity")).filter(F.col("similarity") >= least)
