"""Projects side by side: reconciling candidates, conflicts, the queue, resumed jobs, trash, detection windows.

Defined results: null keys match nothing; a project without receipts has none to resume; ties go to the smaller key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconciled(leaders: DataFrame, existing: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """Adds outcome to each group's leader: merged where its key exists, conflict where ``near`` (key, near) has a title
    much like its own, else created; near is the project in conflict."""
    rows = leaders.join(existing.select(key).distinct().withColumn("_e", F.lit(True)), key, "left").join(near.groupBy(key).agg(F.min("near").alias("near")), key, "left")
    outcome = F.when(F.col("_e").isNotNull(), "merged").when(F.col("near").isNotNull(), "conflict").otherwise("created")
    return rows.withColumn("outcome", outcome).withColumn("near", F.when(F.col("outcome") == "conflict", F.col("near"))).drop("_e")


def copy_names(wanted: DataFrame, taken: DataFrame, title: str, most: int = 100) -> DataFrame:
    """Adds copy: the title with the fewest `` (copy)`` that is not taken; null where all ``most`` are.

    Looks at those taken titles alone that are a wanted one with copies, so a title's tries are never spread out.
    """
    def split(name: Column) -> tuple[Column, Column]:
        base = F.regexp_replace(name, r"( \(copy\))+$", "")
        return base.alias("_b"), ((F.length(name) - F.length(base)) / 7).cast("int")

    base, copies = split(F.col(title))
    held = taken.select(base, copies.alias("_n"))
    rows = wanted.select("*", base, copies.alias("_o"))
    used = rows.select(title, "_b", "_o").distinct().join(held.distinct(), "_b").filter("_n > _o").withColumn("_k", F.col("_n") - F.col("_o"))
    # the first gap in 1, 2, 3, ...: how many of the used numbers are their own rank
    rank = F.row_number().over(Window.partitionBy(title).orderBy("_k"))
    run = used.withColumn("_r", rank).groupBy(title).agg(F.count_if(F.col("_k") == F.col("_r")).alias("_run"))
    rows = rows.join(run, title, "left").withColumn("_run", F.coalesce("_run", F.lit(0)).cast("int") + 1)
    return rows.withColumn("copy", F.when(F.col("_run") <= most, F.concat(F.col(title), F.repeat(F.lit(" (copy)"), F.col("_run"))))).drop("_b", "_o", "_run")


def resumed(steps: DataFrame, receipts: DataFrame, job: str, index: str, lesson: str) -> DataFrame:
    """Steps with their receipt's lesson and whether they are still to do; a step without a receipt gets an empty one."""
    last = receipts.groupBy(job, index).agg(F.max(lesson).alias(lesson))
    rows = steps.join(last, [job, index], "left")
    return rows.withColumn("to_do", F.col(lesson).isNull())


def cursors(receipts: DataFrame, persisted: DataFrame, job: str, index: str, lesson: str, cursor: str) -> DataFrame:
    """The queue's cursor of each job: after its last uploaded step, and never behind the persisted one."""
    done = receipts.filter(F.col(lesson).isNotNull()).groupBy(job).agg((F.max(index) + 1).alias("_c"))
    return persisted.join(done, job, "left").withColumn(cursor, F.greatest(F.col(cursor), F.coalesce("_c", F.lit(0)))).drop("_c")


def completed(receipts: DataFrame, job: str, order: list[str], lesson: str) -> DataFrame:
    """The lessons of each job in the receipts' order."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(*order, lesson))), lambda x: x[lesson])  # one job's steps
    return receipts.filter(F.col(lesson).isNotNull()).groupBy(job).agg(held.alias("lessons"))


def confirmed(current: DataFrame, resolved: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """Adds unchanged: a confirmation may be written where no input has changed since it was resolved (null equals null)."""
    then = resolved.select(key, F.struct(*inputs).alias("_r"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r.{c}")) for c in inputs])
    return current.join(then, key).withColumn("unchanged", same).drop("_r")


def sample_windows(start: Column, end: Column, skip: float = 5.0, target: float = 30.0, least: float = 10.0) -> dict[str, Column]:
    """head, head_retry, tail and tail_retry: (from, to) in seconds, null where too little sound is left."""

    def window(a: Column, b: Column) -> Column:
        return F.when(b - a >= least, F.struct(a.alias("from"), b.alias("to")))

    head, tail = start + skip, end - skip
    return {
        "head": window(head, F.least(head + target, end)), "head_retry": window(head + target, F.least(head + 2 * target, end)),
        "tail": window(F.greatest(start, tail - target), tail), "tail_retry": window(F.greatest(start, tail - 2 * target), tail - target),
    }


def bounds(start: Column, end: Column, probed: Column, declared: Column) -> Column:
    """(from, to) of a track in its file: the probed duration, else the declared one; an empty window is the whole file.

    Null where no duration is known or the window's ends are no numbers.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = lambda c: F.when(finite(c) & (c > 0), c)
    whole = F.coalesce(good(probed), good(declared))
    a, b = F.greatest(F.coalesce(start, F.lit(0.0)), F.lit(0.0)), F.least(F.coalesce(end, whole), whole)
    usable = whole.isNotNull() & F.coalesce(finite(start), F.lit(True)) & F.coalesce(finite(end), F.lit(True))
    return F.when(usable, F.when(b <= a, F.struct(F.lit(0.0).alias("from"), whole.alias("to"))).otherwise(F.struct(a.alias("from"), b.alias("to"))))


def sample_plans(tracks: DataFrame, book: str, order: list[str], path: str, skip: float = 5.0, target: float = 30.0, least: float = 10.0) -> DataFrame:
    """One row a book: windows of its first track's head and its last track's tail, or why there are none.

    ``tracks`` has start, end (a window in the file, or null), probed and declared seconds besides the columns named. A book of one track, or whose
    first and last are the same whole file, is split at its middle, so that both sides never hear the same sound; it needs twice
    the least sound. A side without sound enough refuses the book; a retry is only left out.
    """
    own = F.struct(F.col(path).alias("path"), "start", "end", bounds(F.col("start"), F.col("end"), F.col("probed"), F.col("declared")).alias("b"))
    rows = tracks.groupBy(book).agg(F.count("*").alias("_n"), F.min_by(own, F.struct(*order)).alias("_h"), F.max_by(own, F.struct(*order)).alias("_t"))
    h, t = F.col("_h"), F.col("_t")
    whole = h["start"].isNull() & h["end"].isNull() & t["start"].isNull() & t["end"].isNull()
    alone = (F.col("_n") == 1) | (F.coalesce(h["path"] == t["path"], F.lit(False)) & whole)
    a, b = h["b"]["from"], h["b"]["to"]
    middle = F.when(alone & (b - a - 2 * skip >= 2 * least), (a + b) / 2)
    edge = F.struct(F.when(alone, middle).otherwise(t["b"]["from"]).alias("from"), F.when(alone, b).otherwise(t["b"]["to"]).alias("to"))
    rows = rows.withColumns({"_head": F.struct(a.alias("from"), F.when(alone, middle).otherwise(b).alias("to")), "_tail": edge})
    head, tail = sample_windows(F.col("_head.from"), F.col("_head.to"), skip, target, least), sample_windows(F.col("_tail.from"), F.col("_tail.to"), skip, target, least)
    fine = head["head"].isNotNull() & tail["tail"].isNotNull() & (~alone | middle.isNotNull())
    sides = {"head": head["head"], "head_retry": head["head_retry"], "tail": tail["tail"], "tail_retry": tail["tail_retry"]}
    return rows.select(book, *[F.when(fine, w).alias(n) for n, w in sides.items()], F.when(~fine, "insufficient audio").alias("error"))


def preview_error(confidence: Column, source: Column, provider: Column, head: Column, tail: Column) -> Column:
    """Why a detection preview is refused; null where it is fine."""
    return (
        F.when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0.0, 1.0), "confidence")
        .when(~F.coalesce(((source == "title") & provider.isNull()) | ((source == "transcript") & provider.isNotNull()), F.lit(False)), "provider")
        .when((F.coalesce(F.length(head), F.lit(0)) > 240) | (F.coalesce(F.length(tail), F.lit(0)) > 240), "preview")
    )


def vendor(kobo_most: Column, kobo_total: Column, kobo_files: Column, kindle: Column, ncx: Column) -> tuple[Column, Column]:
    """(vendor, confidence) of a package from its markers' counts."""
    cluster = (kobo_most >= 3) | (kobo_files >= 3)
    strong = (kindle >= 2) | (ncx & (kindle >= 1))
    kind = F.when(cluster, "kobo").when(strong | ncx, "kindle").otherwise("generic")
    sure = (
        F.when(cluster, F.least(F.lit(0.99), 0.6 + F.least(kobo_total, F.lit(12)) / 30))
        .when(strong, F.least(F.lit(0.99), 0.6 + F.least(kindle, F.lit(8)) / 20))
        .when(ncx, 0.6).when(kobo_total + kindle == 0, 0.2).otherwise(0.35)
    )
    return kind, sure


#: Fixed values here and in vendor(): marker names, thresholds and formulas of confidence.
def marker_counts(body: Column) -> tuple[Column, Column]:
    """(Kobo, Kindle) markers of a file, its comments left out."""
    text = F.lower(F.regexp_replace(body, r"(?s)<!--.*?-->", ""))
    kobo = F.regexp_count(text, F.lit("kobospan")) + F.regexp_count(text, F.lit("font-1[246]0per"))
    return kobo, F.regexp_count(text, F.lit('amzn-page-break|kindle:embed|kindle:position|kf8|"calibre'))


def first_rung(*rungs: tuple[str, Column]) -> Column:
    """(rung, href) of the first rule that finds a cover."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("rung"), c.alias("href"))) for n, c in rungs])


#: File names of covers by media type.
COVER_NAMES = {"image/jpeg": "cover.jpg", "image/png": "cover.png", "image/webp": "cover.webp", "image/gif": "cover.gif"}


def cover_name(mime: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in COVER_NAMES.items() for x in kv])[F.lower(mime)]


def trash_slots(trashed: DataFrame, slug: str, at: str) -> DataFrame:
    """Adds slot: slug and time, with -1, -2 ... for further ones of the same second."""
    n = F.row_number().over(Window.partitionBy(slug, at).orderBy("seq")) - 1
    return trashed.withColumn("slot", F.concat(slug, F.lit("-"), F.col(at).cast("string"), F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise("")))


def trash_requests(requests: DataFrame, trashed: DataFrame, live: DataFrame, slug: str) -> DataFrame:
    """Answers to (seq, action, slot): restored, purged, not found, or conflict where the project's place is taken.

    A slot's requests are answered in the order of seq, its first that succeeds takes it away; of several slots of one project that are
    restored the first takes the place, the others are conflicts.
    """
    places = trashed.filter(F.col(slug).isNotNull()).select("slot", slug).join(live.select(slug).distinct().withColumn("_live", F.lit(True)), slug, "left")
    held = requests.join(places, "slot", "left")
    known, taken = F.col(slug).isNotNull(), F.col("_live").isNotNull()
    # requests for slots that nobody has are by slot, never all in one task
    own, place = Window.partitionBy("slot").orderBy("seq"), Window.partitionBy(slug, F.when(~known, F.col("slot"))).orderBy("seq")
    before = lambda c, w: F.coalesce(F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    # a purge, or a restore to a free place, takes the slot away; a first restore takes the place
    purged = before(known & (F.col("action") == "purge"), own)
    tries = held.withColumn("_may", known & ~taken & (F.col("action") == "restore") & ~purged)
    first = tries.withColumn("_placed", before("_may", place))
    done = first.withColumn("_gone", purged | before(F.col("_may") & ~F.col("_placed"), own))
    answer = (
        F.when(~known | F.col("_gone"), "not found").when(F.col("action") == "purge", "purged")
        .when(F.col("_may") & ~F.col("_placed"), "restored").otherwise("conflict")
    )
    return done.select("seq", "action", "slot", answer.alias("answer"))


def restorable(trashed: DataFrame, live: DataFrame, slug: str) -> DataFrame:
    """Trashed rows whose slot no live project has; the rest are conflicts."""
    return trashed.join(live.select(slug), slug, "left_anti")


def queue_states(operations: DataFrame, queue: str, order: str) -> DataFrame:
    """After each operation (push with its job, or advance): length, current (the job in front) and popped, the job an advance took.

    The n-th advance that finds a job takes the n-th that was pushed. An advance that finds none changes nothing; how many there were is how far the
    running sum of pushes less advances ever fell below 0. So a queue is told by running sums and one join, never by a walk.
    """
    w = Window.partitionBy(queue).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("op") == "push", 1).otherwise(-1)
    rows = operations.withColumns({"_pushed": F.sum((F.col("op") == "push").cast("long")).over(w), "_sum": F.sum(step).over(w)})
    rows = rows.withColumn("_missed", -F.least(F.lit(0), F.min("_sum").over(w)))
    rows = rows.withColumns({"length": F.col("_sum") + F.col("_missed"), "_taken": F.col("_pushed") - F.col("_sum") - F.col("_missed")})
    before = F.coalesce(F.lag("_taken").over(Window.partitionBy(queue).orderBy(order)), F.lit(0))
    rows = rows.withColumn("_took", F.when(F.col("_taken") > before, F.col("_taken")))
    pushed = rows.filter("op = 'push'").select(F.col(queue).alias("_q"), F.col("_pushed").alias("_n"), "job")
    front, popped = (pushed.select(F.col("_q").alias(f"_q{x}"), F.col("_n").alias(f"_n{x}"), F.col("job").alias(x)) for x in ("current", "popped"))
    at_front = F.when(F.col("length") > 0, F.col("_taken") + 1)
    out = rows.join(front, F.col(queue).eqNullSafe(F.col("_qcurrent")) & (at_front == F.col("_ncurrent")), "left")
    out = out.join(popped, F.col(queue).eqNullSafe(F.col("_qpopped")) & (F.col("_took") == F.col("_npopped")), "left")
    return out.select(*operations.columns, F.col("length").cast("long").alias("length"), "current", "popped")
