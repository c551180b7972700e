"""Unified diffs to files, hunks and mutations, in projections of one row per patch, file or hunk; nothing is shuffled.

Kept on purpose: structural markers count anywhere in a file's block, an added line that starts with `++` is not counted, lines
end at all of Unicode's line ends, and unquoted paths with spaces are cut at the spaces.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_test_path, matches_any

# What marks a file as structural or binary.
STRUCTURAL = ("new file mode ", "deleted file mode ", "old mode ", "new mode ", "rename from ", "rename to ", "copy from ", "copy to ", "GIT binary patch", "Binary files ")
BINARY = ("GIT binary patch", "Binary files ")
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
#: Line ends besides \n; most diffs have none and are read without expressions for them.
ODD_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
FIRST_LINE = rf"(?s)\A(.+?)(?:{LINE_END}|\z)"
#: Where a hunk starts: at the start of a line, whatever ends the one before.
HUNK_START = rf"(?=@@ )(?<=[\n{ODD_ENDS}])"
RANGE = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"

# A shell's words: plain runs, escaped characters, double and single quotes. Possessive, so that long lines need no stack.
PIECE = r"""\\.|"(?:[^"\\]++|\\.)*+"|'[^']*+'"""
WORD = rf"(?s)(?:[^ \t\r\n\"'\\]++|{PIECE})++"
WHOLE = rf"(?s)\A(?:[^\"'\\]++|{PIECE})*+\z"
BLANKS = r"[\s\x1c-\x1f]+"


def _words(line: Column) -> Column:
    """The words of a first line as a shell reads them; split at blanks where quotes or escapes stay open."""

    def piece(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        double = F.regexp_replace(inner, r"(?s)\\([\"\\])", "$1")
        return F.when(x.startswith('"'), double).when(x.startswith("'"), inner).when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)

    pieces = lambda w: F.transform(F.regexp_extract_all(w, F.lit(rf"(?s)[^\"'\\]++|{PIECE}"), 0), piece)
    read = lambda w: F.when(w.rlike(r"""["'\\]"""), F.array_join(pieces(w), "")).otherwise(w)
    plain = ~line.rlike(r"""["'\\]""")
    return F.when(plain, F.regexp_extract_all(line, F.lit(r"[^ \t\r\n]+"), 0)).when(line.rlike(WHOLE), F.transform(F.regexp_extract_all(line, F.lit(WORD), 0), read)).otherwise(F.split(line, f"(?U){BLANKS}"))


def _any_of(block: Column, markers: Iterable[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | block.contains(m)
    return found


def file_patches(patches: DataFrame, test_globs: Iterable[str] = ()) -> DataFrame:
    """patch_id, file_ord, path, old_path, raw, header, hunks, structural, binary, is_test: a row per file of each diff.

    A null or blank diff has no files. What stands before the first file is dropped."""
    mark = "diff --git "
    found = patches.select("patch_id", F.when(F.startswith("diff_text", F.lit(mark)), 0).otherwise(1).alias("_before"), F.posexplode(F.split(F.coalesce("diff_text", F.lit("")), f"(?md)(?=^{mark})")).alias("_place", "raw"))
    files = found.filter(F.col("raw").startswith(mark)).select("patch_id", (F.col("_place") - F.col("_before")).alias("file_ord"), "raw", F.col("raw").rlike(f"[{ODD_ENDS}]").alias("_odd"))
    raw, odd = F.col("raw"), F.col("_odd")
    # Cut at a mark where the block has none: splitting at an expression costs more than all the rest.
    marked = F.split(F.replace(raw, F.lit("\n@@ "), F.lit("\n\x01@@ ")), "\x01")
    files = files.withColumn("_parts", F.when(odd | raw.contains("\x01"), F.split(raw, HUNK_START)).otherwise(marked))

    def counted(text, header, ended):
        # a hunk's own line is its first, so that all counted ones follow a line end
        shorter = lambda sign: F.octet_length(ended) - F.octet_length(F.replace(ended, F.lit(f"\n{sign}"), F.lit("\n")))
        count = lambda sign: (shorter(sign) - F.call_function("div", shorter(sign * 3), F.lit(3))).cast("int")
        numbers = F.split(F.regexp_replace(header, f"{RANGE}(?s:.*)", "$1,$2,$3,$4"), ",")
        return F.struct(header.alias("header"), text.alias("text"), count("+").alias("additions"), count("-").alias("deletions"), numbers.alias("numbers"))

    def odd_hunk(text):
        header = F.regexp_replace(F.regexp_extract(text, FIRST_LINE, 1), r"\n+\z", "")
        return counted(text, header, F.translate(text, ODD_ENDS, "\n" * len(ODD_ENDS)))  # as many lines of each sign

    def ranged(h):
        number = lambda i: F.get(h["numbers"], F.lit(i))
        read = ~number(0).startswith("@")  # else its header has no ranges
        count = lambda i: F.when(~read, None).when(number(i) == "", F.lit(1)).otherwise(F.coalesce(number(i).try_cast("int"), F.lit(1)))
        return F.struct(
            *[h[f].alias(f) for f in ("header", "text", "additions", "deletions")],
            number(0).try_cast("int").alias("old_start"), count(1).alias("old_count"), F.when(read, number(2).try_cast("int")).alias("new_start"), count(3).alias("new_count"),
        )

    texts = F.slice("_parts", F.lit(2), F.size("_parts"))
    hunks = F.when(odd, F.transform(texts, odd_hunk)).otherwise(F.transform(texts, lambda t: counted(t, F.substring_index(t, "\n", 1), t)))
    files = files.withColumn("hunks", F.transform(hunks, ranged)).withColumn("header", F.element_at("_parts", 1))
    first = F.when(odd, F.regexp_extract(raw, FIRST_LINE, 1)).otherwise(F.substring_index(raw, "\n", 1))
    line = F.regexp_replace(first, rf"(?U){BLANKS}\z|\A{BLANKS}", "")
    words = files.withColumn("_line", line).withColumn("_words", F.explode(F.array(_words(F.col("_line")))))
    whole = F.size("_words") >= 4
    old_path, path = (F.regexp_replace(F.get("_words", F.lit(i)), f"^{side}/", "") for i, side in ((2, "a"), (3, "b")))
    files = words.withColumn("old_path", F.when(whole, old_path)).withColumn("path", F.when(whole, path).otherwise("<unknown>"))
    return files.select(
        "patch_id",
        "file_ord",
        "path",
        "old_path",
        "raw",
        "header",
        "hunks",
        (_any_of(raw, STRUCTURAL) | (F.size("hunks") == 0)).alias("structural"),
        _any_of(raw, BINARY).alias("binary"),
        is_test_path(F.col("path"), test_globs).alias("is_test"),
    )


def mutation_id(path: Column, patch: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.char(F.lit(0)), patch).cast("binary"), 256), 1, 10)


def file_mutations(files: DataFrame, include_tests: bool = False, ignore_globs: Iterable[str] = ()) -> DataFrame:
    """patch_id, file_ord, hunk_ord and the fields of a mutation: a row per hunk, or per file if it is structural."""
    files = files.filter((~F.col("is_test") | F.lit(include_tests)) & ~matches_any(F.col("path"), ignore_globs))
    total = lambda f: F.aggregate("hunks", F.lit(0), lambda acc, h: acc + h[f])
    first = F.get("hunks", F.lit(0))["new_start"]
    none = F.size("hunks") == 0
    whole = F.struct(
        F.lit(0).alias("hunk_ord"), F.concat("path", F.lit(" (file-level/structural)")).alias("label"), F.col("raw").alias("patch"), F.when(F.col("binary"), "binary").otherwise("structural").alias("kind"),
        total("additions").alias("additions"), total("deletions").alias("deletions"), F.when(none, F.lit(1)).otherwise(first).alias("line"), F.when(none | (F.coalesce(first, F.lit(0)) == 0), F.lit(1)).otherwise(first).alias("end_line"),
    )

    def part(h, i):
        context = F.btrim(F.substring_index(h["header"], "@@", -1), F.lit(" \t\n\x0b\f\r"))
        label = F.concat(F.col("path"), F.lit(" hunk "), i + 1, F.lit("/"), F.size("hunks"), F.when(context != "", F.concat(F.lit(" — "), context)).otherwise(F.lit("")))
        count = F.when(F.coalesce(h["new_count"], F.lit(0)) == 0, F.lit(1)).otherwise(h["new_count"])
        return F.struct(
            i.alias("hunk_ord"), label.alias("label"), F.concat("header", h["text"]).alias("patch"), F.lit("hunk").alias("kind"),
            h["additions"].alias("additions"), h["deletions"].alias("deletions"), h["new_start"].alias("line"), (h["new_start"] + count - 1).alias("end_line"),
        )

    units = F.when(F.col("structural"), F.array(whole)).otherwise(F.transform("hunks", part))
    rows = files.select("patch_id", "file_ord", "path", "is_test", F.inline(units))
    return rows.withColumn("id", mutation_id(F.col("path"), F.col("patch")))


def mutations(files: DataFrame, include_tests: bool = False, ignore_globs: Iterable[str] = ()) -> DataFrame:
    """file_mutations() numbered within each patch (mut_ord, from 0): file order, then hunk order."""
    order = Window.partitionBy("patch_id").orderBy("file_ord", "hunk_ord")
    return file_mutations(files, include_tests, ignore_globs).withColumn("mut_ord", F.row_number().over(order) - 1)


def ignored_counts(files: DataFrame, include_tests: bool = False, ignore_globs: Iterable[str] = ()) -> DataFrame:
    """patch_id, mutations, ignored (what the filters left out), test_files (sorted, distinct)."""
    dropped = (F.col("is_test") & ~F.lit(include_tests)) | matches_any(F.col("path"), ignore_globs)
    units = F.when(F.col("structural"), F.lit(1)).otherwise(F.size("hunks")).cast("bigint")
    return files.groupBy("patch_id").agg(
        F.sum(F.when(dropped, F.lit(0)).otherwise(units)).alias("mutations"),
        F.sum(F.when(dropped, units).otherwise(F.lit(0))).alias("ignored"),
        F.array_sort(F.collect_set(F.when(F.col("is_test"), F.col("path")))).alias("test_files"),
    )


def test_overlay(files: DataFrame) -> DataFrame:
    """patch_id, overlay: the blocks of a patch's test files in order, ignored paths included; '' without any."""
    blocks = F.array_sort(F.collect_list(F.when(F.col("is_test"), F.struct("file_ord", "raw"))))
    return files.groupBy("patch_id").agg(F.array_join(F.transform(blocks, lambda b: b["raw"]), "").alias("overlay"))
