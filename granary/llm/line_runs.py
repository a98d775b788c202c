"""Line dedup: maximal repeated runs of lines, by prefix doubling over sequences of line ids, in DataFrame functions alone.

A line counts if it has a character other than white space; lines are one if their MD5 digests are.  Lines that stand once repeat
nothing and end every run.  The others are ranked, and a suffix is a place of such a line with what follows it.

*Doubling.*  The rank of a suffix at depth 2d comes from the pair of ranks at depth d, of itself and of the suffix d lines on: pairs that
occur twice are sorted over ranges of tasks and numbered.  So ranks are exact and in the order of the suffix array; a suffix that is
alone in its rank leaves it, as it has no neighbour that shares so many lines.  This ends when no rank is shared.

*Intervals.*  Suffixes that share their first ``depth`` lines, and no two of which are told apart before, are an interval of longest
common prefixes.  From the highest depth down, each interval is taken apart by the ranks of half the depth, a quarter, and so on, that
follow it.  A group of two or more that goes deeper leaves one shadow behind with the group's first place, so that suffixes that
stay are held against all of the interval.  At the end each suffix is in the deepest interval that it belongs to: its depth is the
length of the longest run that begins there and stands elsewhere too.

*Deletion.*  A run is a repeat if it has ``MIN_RUN`` lines or its first line has ``LONG_WORDS`` words.  The copy at an interval's first place, by (doc_id,
text digest, place), is retained, all others are later copies.  A line goes if a later copy of some run covers it and no retained copy of any run does.
So of each repeated run, of whatever length, one copy stays whole.

Counts are summed before the shuffle, and where suffixes meet an interval it is one row, so that AQE can split a hot one.

Blank lines are no lines here, break no run, and stay.  Null texts are empty.  Rows with equal doc_id and text are one document and
lose the same lines; a null doc_id counts as the least long integer.  Lines that differ in white space differ.  An empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_text, written

MIN_RUN, LONG_WORDS = 2, 50
KEY = ["g_doc", "g_text"]
PLACE = [*KEY, "at"]
#: What stands for a null doc_id.
NO_ID = -(1 << 63)


def _is_long(line, words: int | None):
    """Whether a line has at least so many words; none has for None.  Short lines are told by their length."""
    if words is None:
        return F.lit(False)
    counted = F.size(F.filter(F.split(line, r"[\x09-\x0D\x20]+"), lambda w: w != ""))
    return F.when(F.length(line) >= 2 * words - 1, counted >= words).otherwise(False)


def _exploded(docs: DataFrame, *fields) -> DataFrame:
    """The lines that count: g_doc, g_text, at (index among them), and `fields`, functions of a line and its index among all."""
    counted = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.rlike(r"[^\x09-\x0D\x20]").alias("counts"), *(f(x, i) for f in fields)))
    found = docs.select(*KEY, F.posexplode(F.filter(counted, lambda x: x["counts"])).alias("at", "x"))
    return found.select(*PLACE, "x.*").drop("counts")


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the keys that two rows or more have: the keys, the first place, and `up`, their rank in ascending order."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("g_n"), F.min(F.struct(*PLACE)).alias("first")).filter("g_n > 1").drop("g_n")
    return written(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("up", F.monotonically_increasing_id()), "line-ranks")


def _repeated_lines(docs: DataFrame, long_words: int | None) -> DataFrame:
    """The lines that stand twice or more: g_doc, g_text, at, line (index among all), long, name (rank at depth one)."""
    by_hash = _exploded(docs, lambda x, i: F.xxhash64(x).alias("h")).groupBy("h").agg(F.count("*").alias("g_n")).filter("g_n > 1").select("h")
    often = written(by_hash, "repeated-hashes")  # apart, so that a hot line can be split in the join
    fields = [
        lambda x, i: i.alias("line"), lambda x, i: F.xxhash64(x).alias("h"), lambda x, i: F.unhex(F.md5(x)).alias("digest"), lambda x,
        i: _is_long(x, long_words).alias("long")
    ]
    lines = written(_exploded(docs, *fields).join(often, "h", "left_semi").drop("h").dropDuplicates(PLACE), "repeated-lines")
    return written(lines.join(_ranked(lines, "digest"), "digest").select(*PLACE, "line", "long", F.col("up").alias("name")), "line-names")


def _doubled(names: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(suffixes with their rank `name` at a depth and `up` at twice that, null if they share none; the ranks: name, next, first, up)."""
    ahead = Window.partitionBy(*KEY).orderBy("at").rangeBetween(depth, depth)
    both = names.withColumn("next", F.max("name").over(ahead))
    ranks = _ranked(both.filter("next is not null"), "name", "next")
    return written(both.join(ranks.drop("first"), ["name", "next"], "left").select(*names.columns, "up"), "suffix-ranks"), ranks


INTERVAL = ["kind", "id"]
STATE = [*PLACE, "depth", *INTERVAL, "real", "first"]


def _refined(active: DataFrame, names: DataFrame, step: int, kind: int) -> DataFrame:
    """The suffixes `active`, after those that share `step` more lines with others of their interval have gone deeper."""
    at = names.select(*(F.col(c).alias(f"n_{c}") for c in PLACE), F.col("name").alias("ext"))
    here = [F.col(k) == F.col(f"n_{k}") for k in KEY] + [F.col("at") + F.col("depth") == F.col("n_at")]
    asked = written(active.join(at, here, "left").select(*STATE, "ext"), "asked-suffixes")
    grouped = asked.filter("ext is not null").groupBy(*INTERVAL, "ext").agg(
        F.count("*").alias("g_n"), F.count_if("real").alias("g_real"), F.min("first").alias("g_first"), F.min(F.struct(*PLACE)).alias("g_place"), F.first("depth").alias("g_depth")
    )
    groups = written(grouped.filter("g_n > 1").withColumn("g_child", F.monotonically_increasing_id()), "deeper-groups")
    # intervals in which no suffix stays need no shadows
    left = asked.groupBy(*INTERVAL).agg(F.count_if("real").alias("g_n")).unionAll(groups.groupBy(*INTERVAL).agg(-F.sum("g_real")))
    waiting = left.groupBy(*INTERVAL).agg(F.sum("g_n").alias("g_n")).filter("g_n > 0").select(*INTERVAL)
    tried = asked.filter("ext is not null").join(
        groups.select(*INTERVAL, "ext", "g_child", "g_real"), [*INTERVAL, "ext"], "left"
    ).filter("g_child is null or g_real > 0")
    deeper = F.col("g_child").isNotNull()
    after = tried.select(
        *PLACE, (F.col("depth") + F.when(deeper, step).otherwise(0)).alias("depth"), F.when(deeper, kind).otherwise(F.col("kind")).alias("kind"),
        F.when(deeper, F.col("g_child")).otherwise(F.col("id")).alias("id"), "real", "first",
    )
    shadows = groups.select("g_place.*", F.col("g_depth").alias("depth"), *INTERVAL, F.lit(False).alias("real"), F.col("g_first").alias("first"))
    every = after.unionAll(asked.filter("ext is null").select(*STATE)).unionAll(shadows).join(waiting.withColumn("g_waiting", F.lit(True)), INTERVAL, "left")
    return every.filter(F.col("real") | (F.col("kind") == kind) | F.col("g_waiting")).select(*STATE)


def _new(lifted: DataFrame, ranks: DataFrame, depth: int, kind: int) -> DataFrame:
    """The suffixes that share no more than `depth` to twice as many lines, and a shadow for each group that shares more with some of them."""
    state = lambda df, place, real: df.select(*place, F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), F.col("name").alias("id"), F.lit(real).alias("real"), F.struct(*place).alias("first"))
    ending = lifted.filter("up is null")
    beside = ranks.join(ending.select("name").distinct(), "name", "left_semi")
    return state(ending, [F.col(c) for c in PLACE], True).unionAll(state(beside, [F.col(f"first.{c}").alias(c) for c in PLACE], False))


def runs(lines: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The suffixes in their deepest intervals: g_doc, g_text, at, depth, retained (whether theirs is the first place).

    `lines` is of _repeated_lines; suffixes that share one line alone are left out unless it is long or `min_run` is one.
    """
    levels, depth, names = [], 1, lines.select(*PLACE, "name", "long")
    while not levels or not levels[-1][1].isEmpty():
        levels.append(_doubled(names, depth))
        names, depth = levels[-1][0].filter("up is not null").select(*PLACE, F.col("up").alias("name")), 2 * depth
    active = None
    for k, (lifted, ranks) in reversed(list(enumerate(levels))):
        worth = lifted if k or min_run <= 1 else lifted.filter("long")
        parts = [_new(worth, ranks, 1 << k, 2 * k)]
        if active is not None:
            parts.append(_refined(active, lifted, 1 << k, 2 * k + 1))
        active = written(reduce(DataFrame.unionAll, parts), "intervals")
    least = active.groupBy(*INTERVAL).agg(F.min("first").alias("g_top"))
    return active.filter("real").join(least, INTERVAL).select(*PLACE, "depth", (F.col("first") == F.col("g_top")).alias("retained"))


def copies(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The lines to delete: (g_doc, g_text, line), each once; `docs` has g_doc, g_text, text.  Lines of `long_words` words are runs by themselves."""
    lines = _repeated_lines(docs, long_words)
    found = runs(lines, min_run).select(*(F.col(c).alias(f"r_{c}") for c in PLACE), "depth", "retained")
    both = lines.join(found, [F.col(c) == F.col(f"r_{c}") for c in PLACE], "left")
    stop = F.when((F.col("depth") >= min_run) | (F.col("long") & F.col("depth").isNotNull()), F.col("at") + F.col("depth"))
    before = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a document's own lines
    reach = lambda own: F.coalesce(F.max(F.when(own, stop)).over(before) > F.col("at"), F.lit(False))
    marked = both.select(*KEY, "line", reach(~F.col("retained")).alias("gone"), reach(F.col("retained")).alias("held"))
    return marked.filter("gone and not held").select(*KEY, "line")


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with what tells documents apart, and orders them: g_doc and 60 bits of the text's digest, g_text."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(
        "g_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    ).withColumn("g_text", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


def without_runs(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """`docs` with text less the deleted lines, and g_lines, g_deleted: how many lines a text has, and how many were deleted."""
    keyed = _keyed(docs)
    gone = copies(with_text(keyed, *KEY), min_run, long_words).groupBy(*(F.col(k).alias(f"m_{k}") for k in KEY)).agg(
        F.sort_array(F.collect_list("line")).alias("d")
    )
    # a byte for each line up to the last deleted one: 1 is deleted; bytes, unlike characters, are found at once
    zeros = lambda x, j: F.concat(F.repeat(F.lit("0"), x - F.when(j > 0, F.get("d", j - 1) + 1).otherwise(0)), F.lit("1"))
    masks = gone.select("m_g_doc", "m_g_text", F.size("d").alias("g_deleted"), F.array_join(F.transform("d", zeros), "").cast("binary").alias("g_mask"))
    both = keyed.join(masks, (F.col("g_doc") == F.col("m_g_doc")) & (F.col("g_text") == F.col("m_g_text")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.substr(F.col("g_mask"), i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    text = F.when(F.col("g_mask").isNull(), F.col("text")).otherwise(kept)
    return both.select(
        *[F.col(c) for c in docs.columns if c != "text"], text.alias("text"), F.coalesce(F.size(lines), F.lit(1)).cast("long").alias("g_lines"),
        F.coalesce("g_deleted", F.lit(0)).cast("long").alias("g_deleted")
    ).select(*docs.columns, "g_lines", "g_deleted")


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_deleted, text (what is left of it)."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return without_runs(named, min_run, long_words).select("doc_id", F.col("g_lines").alias("n_lines"), F.col("g_deleted").alias("n_deleted"), "text")


def drop_copies(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The pipeline's stage: deleted lines leave the texts, and documents of which nothing is left go; columns as in `docs`."""
    out = without_runs(docs, min_run, long_words).filter((F.col("g_deleted") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]")).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = f"""
WITH RECURSIVE
k AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS g_doc, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS g_text FROM documents),
d AS (SELECT DISTINCT g_doc, g_text, text FROM k),
a AS (SELECT g_doc, g_text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY g_doc, g_text ORDER BY i) AS pos, dense_rank() OVER (ORDER BY line) AS id, len(regexp_extract_all(line, '[^\\x09-\\x0D\\x20]+')) >= {LONG_WORDS} AS long
      FROM a WHERE regexp_matches(line, '[^\\x09-\\x0D\\x20]')),
-- the runs of each length that stand twice: each round is one line longer
w AS (SELECT 1 AS depth, g_doc, g_text, pos, id AS name FROM l QUALIFY count(*) OVER (PARTITION BY id) > 1
      UNION ALL
      SELECT depth, g_doc, g_text, pos, name FROM (
        SELECT w.depth + 1 AS depth, w.g_doc, w.g_text, w.pos, dense_rank() OVER (ORDER BY w.name, l.id) AS name, count(*) OVER (PARTITION BY w.name, l.id) AS n
        FROM w JOIN l ON w.g_doc = l.g_doc AND w.g_text = l.g_text AND l.pos = w.pos + w.depth) AS longer
      WHERE n > 1),
f AS (SELECT *, row_number() OVER (PARTITION BY depth, name ORDER BY g_doc, g_text, pos) = 1 AS retained FROM w),
m AS (SELECT g_doc, g_text, pos, max(depth) AS depth, arg_max(retained, depth) AS retained FROM f GROUP BY g_doc, g_text, pos),
c AS (SELECT l.g_doc, l.g_text, l.i, l.pos, m.retained, CASE WHEN m.depth >= {MIN_RUN} OR (l.long AND m.depth >= 1) THEN m.pos + m.depth END AS stop
      FROM l LEFT JOIN m ON l.g_doc = m.g_doc AND l.g_text = m.g_text AND l.pos = m.pos),
e AS (SELECT g_doc, g_text, i, coalesce(max(stop) FILTER (WHERE NOT retained) OVER o > pos, false) AND NOT coalesce(max(stop) FILTER (WHERE retained) OVER o > pos, false) AS gone
      FROM c WINDOW o AS (PARTITION BY g_doc, g_text ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT a.g_doc, a.g_text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY a.i) FILTER (WHERE gone IS NOT TRUE), '') AS text
      FROM a LEFT JOIN e ON a.g_doc = e.g_doc AND a.g_text = e.g_text AND a.i = e.i GROUP BY a.g_doc, a.g_text)
SELECT k.doc_id AS doc_id, n_lines, n_deleted, t.text AS text FROM k JOIN t ON k.g_doc = t.g_doc AND k.g_text = t.g_text
"""
