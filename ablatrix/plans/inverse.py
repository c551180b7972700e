"""Diffs turned round, as Columns: what takes a change off again, without a repository.

A file's block turned round is what git writes for the way back, but where its diff algorithm would group lines otherwise. Copies
can't be turned round (the diffs of this engine hold none, they find renames only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Stands at the start of a line where no line of a diff has it.
MARK = "\x01"
#: Both sides' paths change places.
BOTH = (r'^--- ("?)a/(.*)\n\+\+\+ ("?)b/(.*)$', "--- $3a/$4\n+++ $1b/$2")
LINE = r"[^\n]*+\n(?:\\[^\n]*+\n)?"


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, replacement in pairs:
        text = F.regexp_replace(text, f"(?md){pattern}", replacement)
    return text


def header(text: Column) -> Column:
    """The lines of a file's block before its hunks: sides, modes, names and blobs change places."""
    named = lambda side, c: F.when(c.startswith('"'), F.concat(F.lit(f'"{side}/'), F.substring(c, F.lit(2), F.length(c)))).otherwise(F.concat(F.lit(f"{side}/"), c))
    old, new = (F.regexp_extract(text, f"(?md)^rename {w} (.*)$", 1) for w in ("from", "to"))
    first = F.when(old != "", F.concat(F.lit("diff --git "), named("a", new), F.lit(" "), named("b", old))).otherwise(F.substring_index(text, "\n", 1))
    rest = F.substring(text, F.instr(text, "\n"), F.length(text))
    rest = _replaced(
        rest, (r"^old mode (\d+)\nnew mode (\d+)$", "old mode $2\nnew mode $1"), (r"^rename from (.*)\nrename to (.*)$", "rename from $2\nrename to $1"),
        (r"^index ([0-9a-f]+)\.\.([0-9a-f]+)", "index $2..$1"), (r"^new file mode ", f"{MARK}mode "), (r"^deleted file mode ", "new file mode "), (f"^{MARK}mode ", "deleted file mode "),
    )
    both = _replaced(rest, BOTH)
    made, gone = _replaced(rest, (r'^--- /dev/null\n\+\+\+ ("?)b/(.*)$', "--- $1a/$2\n+++ /dev/null")), _replaced(rest, (r'^--- ("?)a/(.*)\n\+\+\+ /dev/null$', "--- /dev/null\n+++ $1b/$2"))
    swapped = F.when(rest.contains("\n--- /dev/null\n"), made).when(rest.contains("\n+++ /dev/null\n"), gone).otherwise(both)
    rare = F.lit(False)  # most blocks have nothing but two paths to change
    for marker in ("mode ", "rename ", "index ", "/dev/null", "GIT binary patch", MARK):
        rare = rare | text.contains(marker)
    plain = F.concat(F.substring_index(text, "\n", 1), _replaced(F.substring(text, F.instr(text, "\n"), F.length(text)), BOTH))
    binary = F.regexp_replace(swapped, r"(?s)(\nGIT binary patch\n)(.*?\n)\n(.*?\n)\n", "$1$3\n$2\n")
    return F.when(rare, F.concat(first, binary)).otherwise(plain)


def body(lines: Column) -> Column:
    """The lines of a hunk after its header: signs change, and what is taken off stands before what is added, as git has it."""
    flipped = F.concat(F.lit("\n"), lines)
    for old, new in (("+", MARK), ("-", "+"), (MARK, "-")):
        flipped = F.replace(flipped, F.lit(f"\n{old}"), F.lit(f"\n{new}"))
    return _replaced(F.substring(flipped, F.lit(2), F.length(flipped)), (rf"((?:^\+{LINE})++)((?:^-{LINE})++)", "$2$1"))


def hunk(h: Column) -> Column:
    """A hunk (header, text) turned round, where it stands."""
    ranges = F.regexp_replace(h["header"], r"^@@ -(\S+) \+(\S+) @@", "@@ -$2 +$1 @@")
    lines = F.substring(h["text"], F.instr(h["text"], "\n") + 1, F.length(h["text"]))
    return F.concat(ranges, F.lit("\n"), body(lines))


def inverse_files(files: DataFrame) -> DataFrame:
    """patch_id, file_ord, path (that the way back leads to), patch: the block of each of files (those of file_patches())."""
    block = F.concat(header(F.col("header")), F.array_join(F.transform("hunks", hunk), ""))
    return files.select("patch_id", "file_ord", F.col("old_path").alias("path"), block.alias("patch"))


def inverse_patches(files: DataFrame) -> DataFrame:
    """patch_id, inverse: the way back of whole diffs, one aggregate over their files."""
    blocks = inverse_files(files).groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("file_ord", "patch"))).alias("b"))
    return blocks.select("patch_id", F.array_join(F.transform("b", lambda x: x["patch"]), "").alias("inverse"))


def reduction_patches(files: DataFrame, removed: DataFrame) -> DataFrame:
    """patch_id, reduction_patch: from the candidate to the candidate without some hunks. removed: patch_id, file_ord, hunk_ord.

    Whole files that change as one (structural) are given by hunk_ord 0. Ranges of hunks move by what earlier ones of their file have
    taken off; blobs aren't known, so files that keep hunks have no index line."""
    rows = files.select("patch_id", "file_ord", "header", "structural", "hunks").join(removed.select("patch_id", "file_ord", "hunk_ord").distinct(), ["patch_id", "file_ord"])
    whole = rows.filter("structural").select("patch_id", "file_ord", F.lit(0).alias("hunk_ord"), F.concat(header(F.col("header")), F.array_join(F.transform("hunks", hunk), "")).alias("text"), F.lit("").alias("head"))
    h = rows.filter("not structural").select("patch_id", "file_ord", "hunk_ord", F.size("hunks").alias("all"), header(F.col("header")).alias("head"), F.get("hunks", F.col("hunk_ord")).alias("h"))
    w = Window.partitionBy("patch_id", "file_ord").orderBy("hunk_ord")
    count = lambda c: F.coalesce(F.col(f"h.{c}"), F.lit(1))
    moved = F.coalesce(F.sum(count("old_count") - count("new_count")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("h.new_start") + F.when(count("new_count") == 0, 1).otherwise(0) + moved  # the first line on the new side
    start = F.when(count("old_count") == 0, place - 1).otherwise(place).cast("string")
    span = lambda first, n: F.concat(first, F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string"))))
    ranges = F.concat(F.lit("@@ -"), span(F.col("h.new_start").cast("string"), count("new_count")), F.lit(" +"), span(start, count("old_count")), F.regexp_extract("h.header", r"^@@ [^@]* (@@.*)$", 1), F.lit("\n"))
    lines = F.substring(F.col("h.text"), F.instr(F.col("h.text"), "\n") + 1, F.length(F.col("h.text")))
    text = F.concat(F.regexp_replace(ranges, r"(\+\S+)@@", "$1 @@"), body(lines))
    bare = F.when(F.count("*").over(Window.partitionBy("patch_id", "file_ord")) < F.col("all"), F.regexp_replace("head", r"(?m)^index .*\n", "")).otherwise(F.col("head"))
    some = h.select("patch_id", "file_ord", "hunk_ord", text.alias("text"), bare.alias("head"))
    parts = whole.unionByName(some).groupBy("patch_id", "file_ord").agg(F.array_sort(F.collect_list(F.struct("hunk_ord", "text"))).alias("t"), F.max("head").alias("head"))
    blocks = parts.select("patch_id", F.struct("file_ord", F.concat("head", F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("patch")).alias("b"))
    return blocks.groupBy("patch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["patch"]), "").alias("reduction_patch"))
