"""Line-oriented operators: a block of text is rows (block, pos, line); selection and gaps are window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.config import DIFF, LOG, SEARCH
from condensa.functions import signals
from condensa.functions.core import lines
from condensa.kernels import diffs, searchhits


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """block, pos (from 0), line."""
    return df.select(F.col(key).alias("block"), F.posexplode(lines(text)).alias("pos", "line"))


def _block(*more: str | Column):
    return Window.partitionBy("block", *more)


def context_flag(flag: Column, near: int, *within: str) -> Column:
    """True for flagged rows and for those up to ``near`` rows from one, within a block."""
    w = _block(*within).orderBy("pos").rowsBetween(-near, near)
    return F.max(flag.cast("int")).over(w) > 0


def omissions(df: DataFrame, kept: Column) -> DataFrame:
    """block, start_line (from 1), line_count of each run of rows that are not kept."""
    island = F.sum(kept.cast("int")).over(_block().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    gaps = df.withColumns({"__kept": kept, "__island": island}).where(~F.col("__kept"))
    return gaps.groupBy("block", "__island").agg((F.min("pos") + 1).alias("start_line"), F.count(F.lit(1)).alias("line_count")).drop("__island")


def omission_hint(path: Column, start_line: Column, line_count: Column) -> Column:
    return F.concat(F.lit("[... "), line_count.cast("string"), F.lit(' lines omitted from file "'), path, F.lit('", starting at line '), start_line.cast("string"), F.lit("]\n"))


def fold_repeats(df: DataFrame) -> DataFrame:
    """block, pos, line, n: runs of equal successive lines as one, with the run's length."""
    w = _block().orderBy("pos")
    new = F.coalesce(F.lag("line").over(w) != F.col("line"), F.lit(True)).cast("int")
    runs = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("block", "__run").agg(F.min("pos").alias("pos"), F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    return out.select("block", "pos", F.when(F.col("n") > 1, F.concat("line", F.lit("  [x"), F.col("n").cast("string"), F.lit("]"))).otherwise(F.col("line")).alias("line"), "n")


# ---------------------------------------------------------------- logs


def classify(df: DataFrame) -> DataFrame:
    """Rows with level, summary, command, score; stack traces are the kernel's."""
    out = df.withColumns({"level": signals.level("line"), "summary": signals.summary("line"), "command": signals.command_echo("line")})
    score = F.least(F.lit(1.0), signals.level_score("level") + F.when(F.col("summary"), 0.4).otherwise(0.0))
    return out.withColumn("score", F.round(score, 6))


def protected(df: DataFrame) -> Column:
    """The first line with text, echoed commands, and lines that continue a protected one."""
    w = _block().orderBy("pos")
    filled = F.trim("line") != ""
    first = filled & (F.sum(filled.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    opens = first | signals.command_echo("line")
    # a chain goes on while each line before continues: it starts anew after each line that does not
    ends = F.coalesce(F.lag(~signals.goes_on("line")).over(w), F.lit(True))
    return opens, ends


def log_select(df: DataFrame, errors: int = LOG.max_errors, warnings: int = LOG.max_warnings, near: int = LOG.context, most: int = LOG.max_lines) -> DataFrame:
    """Rows to keep of logs: commands, errors and failures (first, last, best), distinct warnings, summaries; with context."""
    w = _block().orderBy("pos")
    opens, ends = protected(df)
    rows = classify(df).withColumns({"__opens": opens, "__ends": ends})
    rows = rows.withColumn("__chain", F.sum(F.col("__ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("protected", F.max(F.col("__opens").cast("int")).over(_block("__chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) > 0)
    of = _block("level")
    place = F.when(F.row_number().over(of.orderBy("pos")) == 1, 0).when(F.row_number().over(of.orderBy(F.desc("pos"))) == 1, 1).otherwise(2)
    rows = rows.withColumn("__place", place).withColumn("__best", F.row_number().over(of.orderBy("__place", F.desc("score"), "pos")))
    rows = rows.withColumn("__key", F.when(F.col("level") == "warn", signals.dedupe_key("line")))
    rows = rows.withColumn("__first", (F.col("level") == "warn") & (F.row_number().over(_block("__key").orderBy("pos")) == 1))
    rows = rows.withColumn("__nth", F.sum(F.col("__first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    severe = F.col("level").isin("error", "fail") & (F.col("__best") <= errors)
    picked = F.col("protected") | F.col("summary") | severe | (F.col("__first") & (F.col("__nth") <= warnings))
    rows = rows.withColumn("__picked", picked).withColumn("__near", context_flag(F.col("__picked"), near))
    free = F.col("__near") & ~F.col("protected")
    rows = rows.withColumn("__free", free).withColumn("__rank", F.row_number().over(_block("__free").orderBy(F.desc("score"), "pos")))
    kept = F.col("protected") | (F.col("__free") & (F.col("__rank") <= most))
    return rows.withColumn("kept", kept).select("block", "pos", "line", "level", "summary", "protected", "score", "kept")


def level_counts(df: DataFrame) -> DataFrame:
    named = df.withColumn("level", signals.level("line"))
    n = lambda x: F.count_if(F.col("level") == x)
    return named.groupBy("block").agg(n("error").alias("errors"), n("fail").alias("fails"), n("warn").alias("warnings"), n("info").alias("info"), F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------------------- search results


def parse_hits(df: DataFrame) -> DataFrame:
    """block, pos, file, line_number, content of the lines ``file:line:content``; other forms are the kernel's."""
    pattern = r"^((?:[A-Za-z]:(?=[\\/]))?[^\s:]+):(\d+):(.*)$"
    part = lambda g: F.regexp_extract("line", pattern, g)
    hits = df.where(F.col("line").rlike(pattern))
    return hits.select("block", "pos", part(1).alias("file"), part(2).cast("bigint").alias("line_number"), part(3).alias("content"))


def hit_score(content: Column, query: str) -> Column:
    low = F.lower(content)
    words = sorted({w for w in query.lower().split() if len(w) > 2} | searchhits.bigrams(query.lower()))
    asked = sum((F.when(low.contains(w), 0.3).otherwise(0.0) for w in words), F.lit(0.0))
    any_of = lambda ws: low.rlike(r"(?<![a-z0-9])(?:" + "|".join(ws) + r")s?(?![a-z0-9])")
    trouble = F.when(any_of(searchhits.ERRORS), 0.5).when(any_of(searchhits.WARNINGS), 0.4).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(asked + trouble, 6))


def select_hits(hits: DataFrame, files: int = SEARCH.files, each: int = SEARCH.per_file, total: int = SEARCH.total) -> DataFrame:
    """``hits`` (block, file, line_number, content, score, pos) that stay: best files, first and last and best of each."""
    per_file = hits.groupBy("block", "file").agg(F.round(F.sum("score"), 6).alias("file_score"), F.count(F.lit(1)).alias("n"))
    best = per_file.withColumn("file_rank", F.row_number().over(_block().orderBy(F.desc("file_score"), "file"))).where(F.col("file_rank") <= files)
    best = best.withColumn("k", F.least(F.lit(total), F.sum("n").over(_block())))
    in_file = _block("file")
    first, last = F.row_number().over(in_file.orderBy("pos")), F.row_number().over(in_file.orderBy(F.desc("pos")))
    rows = hits.withColumn("place", F.when(first == 1, 0).when(last == 1, 1).otherwise(2))
    # equal hits of a file count once, at their best place
    same = Window.partitionBy("block", "file", "line_number", "content").orderBy("place", F.desc("score"), "pos")
    rows = rows.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__copy")
    rows = rows.withColumn("nth", F.row_number().over(in_file.orderBy("place", F.desc("score"), "line_number", "pos")))
    takes = rows.groupBy("block", "file").agg(F.least(F.lit(each), F.count(F.lit(1))).alias("take")).join(best, ["block", "file"])
    before = F.coalesce(F.sum("take").over(_block().orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = takes.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col("take"), F.col("k") - before)))
    return rows.join(takes.select("block", "file", "allowed", "n"), ["block", "file"]).where(F.col("nth") <= F.col("allowed")).drop("place", "nth", "allowed")


# ---------------------------------------------------------------- diffs


def diff_rows(df: DataFrame) -> DataFrame:
    """Rows with file_no and hunk_no (0 before the first), kind: prelude, header, hunk, add, del, note or context."""
    upto = _block().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__file", F.col("line").rlike("^(?:%s)" % diffs.FILE_HEADER.pattern))
    rows = rows.withColumn("__hunk", F.col("line").rlike("^(?:%s)" % diffs.HUNK_HEADER.pattern) & ~F.col("__file"))
    rows = rows.withColumn("file_no", F.sum(F.col("__file").cast("int")).over(upto))
    in_file = _block("file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk_no", F.when(F.col("file_no") > 0, F.sum(F.col("__hunk").cast("int")).over(in_file)).otherwise(0))
    kind = (
        F.when(F.col("file_no") == 0, "prelude").when(F.col("__hunk"), "hunk").when(F.col("hunk_no") == 0, "header")
        .when(F.col("line").rlike(r"^\+(?!\+\+)"), "add").when(F.col("line").rlike(r"^-(?!--)"), "del")
        .when(F.col("line").startswith("\\"), "note").otherwise("context")
    )
    return rows.withColumn("kind", kind).drop("__file", "__hunk")


def diff_context(rows: DataFrame, near: int = DIFF.context) -> DataFrame:
    """``kept``: changes, lines near them, notes and headers; of a hunk without changes its first lines."""
    hunk = Window.partitionBy("block", "file_no", "hunk_no")
    body = F.col("kind").isin("add", "del", "note", "context")
    changed = F.col("kind").isin("add", "del")
    any_change = F.max(changed.cast("int")).over(hunk) > 0
    nth = F.row_number().over(hunk.orderBy("pos")) - 2  # after the hunk's header
    close = F.max(changed.cast("int")).over(hunk.orderBy("pos").rowsBetween(-near, near)) > 0
    kept = ~body | F.when(any_change, close | (F.col("kind") == "note")).otherwise(nth < near)
    return rows.withColumn("kept", kept)


def diff_hunks(rows: DataFrame, query: str = "") -> DataFrame:
    """block, file_no, hunk_no, additions, deletions, context_lines and score of each hunk."""
    any_of = lambda ws: r"(?<![a-z0-9])(?:" + "|".join(ws) + r")s?(?![a-z0-9])"
    low = F.lower("line")
    body = rows.where(F.col("kind").isin("add", "del", "note", "context"))
    n = lambda k: F.count_if(F.col("kind") == k)
    words = [w for w in query.lower().split() if len(w) > 2] + sorted(searchhits.bigrams(query.lower()))
    asked = [F.max(low.contains(w).cast("int")).alias(f"w{i}") for i, w in enumerate(words)]
    prior = F.max(low.rlike("|".join(map(any_of, diffs.PRIORITY))).cast("int")).alias("prior")
    out = body.groupBy("block", "file_no", "hunk_no").agg(n("add").alias("additions"), n("del").alias("deletions"), n("context").alias("context_lines"), prior, *asked)
    s = F.least(F.lit(0.3), 0.03 * (F.col("additions") + F.col("deletions"))) + 0.3 * F.col("prior")
    s = sum((0.2 * F.col(f"w{i}") for i in range(len(words))), s)
    return out.select("block", "file_no", "hunk_no", "additions", "deletions", "context_lines", F.least(F.lit(1.0), F.round(s, 6)).alias("score"))


def select_hunks(hunks: DataFrame, most: int = DIFF.hunks) -> DataFrame:
    """First, last and best hunks of each file."""
    f = Window.partitionBy("block", "file_no")
    place = F.when(F.row_number().over(f.orderBy("hunk_no")) == 1, 0).when(F.row_number().over(f.orderBy(F.desc("hunk_no"))) == 1, 0).otherwise(1)
    ranked = hunks.withColumn("__place", place).withColumn("__nth", F.row_number().over(f.orderBy("__place", F.desc("score"), "hunk_no")))
    return ranked.where(F.col("__nth") <= most).drop("__place", "__nth")


def select_files(hunks: DataFrame, most: int = DIFF.files) -> DataFrame:
    """block, file_no, changes of the files with most changes."""
    files = hunks.groupBy("block", "file_no").agg(F.sum(F.col("additions") + F.col("deletions")).alias("changes"))
    return files.withColumn("__nth", F.row_number().over(_block().orderBy(F.desc("changes"), "file_no"))).where(F.col("__nth") <= most).drop("__nth")


def noise_files(rows: DataFrame) -> DataFrame:
    """block, file_no, reason: lock files, and files of which only white space changed."""
    named = rows.where(F.col("kind") == "header").groupBy("block", "file_no").agg(F.max(F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))).alias("path"))
    bare = F.regexp_replace(F.expr("substring(line, 2)"), r"\s", "")
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", bare.alias("b"))))), lambda x: x["b"])
    sides = rows.groupBy("block", "file_no").agg(side("add").alias("a"), side("del").alias("d"))
    lock = F.col("path").rlike(diffs._LOCK.pattern)
    blank = (F.size("a") > 0) & (F.col("a") == F.col("d"))
    return named.join(sides, ["block", "file_no"]).select("block", "file_no", F.when(lock, "lockfile").when(blank, "whitespace-only").alias("reason")).where("reason is not null")


# ---------------------------------------------------------------- configuration


def elide_config(df: DataFrame, ini: bool = False) -> DataFrame:
    """Rows with ``kept``: comments and blank lines go; of INI files only comments at the start of a line."""
    gone = F.col("line").rlike("^[#;]") if ini else F.col("line").rlike(r"^\s*(?:#|$)")
    return df.withColumn("kept", ~gone)
