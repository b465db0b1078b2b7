"""Content filters: size, binary content, ignored paths, presets, the pass/fail gate."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

# Default size limit and the bytes looked at for a NUL.
DEFAULT_SIZE_LIMIT = 10 * 1024 * 1024
BINARY_WINDOW = 8192

# Fixed value: directories that are never scanned.
IGNORED_DIRECTORIES = ["node_modules", "target", ".git"]


def filter_size(content, limit=DEFAULT_SIZE_LIMIT) -> DataFrame:
    return content.where(F.octet_length("text") <= limit)


def is_binary(column="text"):
    """A NUL among the first bytes; works on text and on binary columns."""
    return f"instr(substring({column}, 1, {BINARY_WINDOW}), char(0)) > 0"


def is_binary_bytes(column="content"):
    return f"instr(decode(substring({column}, 1, {BINARY_WINDOW}), 'ISO-8859-1'), char(0)) > 0"


def filter_binary(content) -> DataFrame:
    return content.where(f"not ({is_binary()})")


def glob_to_regex(glob):
    """Anchored pattern of a glob; ``*`` crosses directory separators."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def ignore_globs(text):
    """Globs of an ignore file: comments and blanks are dropped, negations are not honoured."""
    lines = (line.strip() for line in text.splitlines())
    return [line for line in lines if line and not line.startswith(("#", "!"))]


def not_ignored(path, globs=()):
    """Condition on a path column: no fixed directory and no glob excludes it."""
    kept = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    any_glob = "|".join(f"(?:{glob_to_regex(glob)})" for glob in globs)
    return kept & ~path.rlike(any_glob) if globs else kept


def filter_ignored(files, globs, path="path") -> DataFrame:
    """Keep paths that no glob and no fixed directory excludes."""
    return files.where(not_ignored(F.col(path), globs))


def gate_passes(findings, threshold="low", sources=None) -> DataFrame:
    """(id, passes): a source fails with a finding of at least the threshold."""
    rank = F.expr(scalars.severity_rank("severity"))
    marked = findings.select("id", rank.alias("rank"))
    if sources is not None:
        marked = marked.unionByName(sources.select("id", F.lit(0).alias("rank")))
    limit = F.expr(scalars.severity_rank(f"'{threshold}'"))
    return marked.groupBy("id").agg((F.max("rank") < F.max(limit)).alias("passes"))
