"""Unified-diff Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_BREAK_CLASS, NOT_LINE_BREAK, col_, py_strip

#: groups: old line count, new start, new line count
HUNK_LENGTHS = r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def extract_diff(response) -> Column:
    """The diff in a model response: ``<patch>`` block, else ``<diff>``
    block, else a ```diff fence, else the raw response (cut at ``</s>``);
    if that is empty, the stripped response."""
    r = col_(response)

    def block(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(r, pattern, 1), F.lit(""))

    return F.coalesce(block(r"(?s)<patch>(.*?)</patch>"), block(r"(?s)<diff>(.*?)</diff>"),
                      block(r"(?s)```diff\n(.*?)```"),
                      F.nullif(F.split_part(r, F.lit("</s>"), F.lit(1)), F.lit("")), py_strip(r))


# one regex pass per patch instead of split + lambda (higher-order functions
# are interpreted, regex functions are code-generated)
_HEADER_PATHS = rf"(?:^|{LINE_BREAK_CLASS})\+\+\+ (?:b/)?({NOT_LINE_BREAK}*)"
_GIT_B_PATHS = rf"(?:^|{LINE_BREAK_CLASS})diff --git {NOT_LINE_BREAK}*? b/({NOT_LINE_BREAK}*)"


def changed_files(patch) -> Column:
    """Paths on ``+++ `` lines, ``b/`` dropped, ``/dev/null`` skipped;
    duplicates kept, diff order."""
    paths = F.regexp_extract_all(col_(patch), F.lit(_HEADER_PATHS), F.lit(1))
    return F.array_remove(paths, "/dev/null")


def python_files(files: Column) -> Column:
    """The changed files the syntax verifier looks at."""
    return F.filter(files, lambda f: F.endswith(f, F.lit(".py")))


def patch_lines(patch) -> Column:
    """Number of newlines in the (stripped) patch; 0 when empty."""
    p = py_strip(patch)
    return F.coalesce(F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))), F.lit(0))


def files_changed(patch) -> Column:
    """Distinct paths after the first `` b/`` on ``diff --git`` lines."""
    paths = F.regexp_extract_all(py_strip(patch), F.lit(_GIT_B_PATHS), F.lit(1))
    return F.coalesce(F.size(F.array_distinct(paths)), F.lit(0))


def with_trailing_newline(patch) -> Column:
    """Git apply needs a final newline."""
    p = col_(patch)
    return F.when(F.endswith(p, F.lit("\n")), p).otherwise(F.concat(p, F.lit("\n")))


def patch_b64(patch) -> Column:
    """base64 of the patch with its trailing newline."""
    # Spark's base64 may wrap at 76 characters (MIME); Python's never does
    return F.replace(F.base64(F.encode(with_trailing_newline(patch), "UTF-8")), F.lit("\r\n"), F.lit(""))
