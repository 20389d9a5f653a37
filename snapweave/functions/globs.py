"""Path filters: glob rules as one ``CASE`` of regular expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_SPECIAL = set("^.[]$()|+{}\\")
#: Rule files of this many bytes or more are ignored.
RULE_FILE_LIMIT = 1024 * 1024 - 1


def quote(text: str, special: set[str] = _SPECIAL | set("*?")) -> str:
    return "".join("\\" + c if c in special else c for c in text)


def glob_to_regex(pattern: str, base: str = "") -> str:
    """A regular expression for whole paths, directories ending in a slash.

    ``*`` and ``?`` stop at slashes, ``**`` doesn't. A pattern without a leading slash
    matches below any directory (of ``base``), one with a trailing slash only directories.
    The empty pattern matches all.
    """
    if not pattern:
        return r"(?s)\A.*\z"
    parts = [quote(base) + "/" if base not in ("", ".") else "", "" if pattern[0] == "/" else "(?:|.*/)"]
    for token in re.findall(r"\*\*|.", pattern.removeprefix("/"), re.S):
        parts.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or quote(token))
    return rf"(?s)\A{''.join(parts)}{'' if pattern.endswith('/') else '/?'}\z"


def parse_rules(text: str, base: str = "") -> list[tuple[bool, str]]:
    """(include, regular expression) of each line ``+ glob`` or ``- glob``; comments, blank and other lines are skipped."""
    out = []
    for line in text.split("\n"):
        m = re.fullmatch(r"\s*([+-])\s+(.*)", line)
        if m and m[2]:
            out.append((m[1] == "+", glob_to_regex(m[2], base)))
    return out


def included(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the first matching rule includes the path; without one it is included. Directories should end in a slash."""
    if not rules:
        return F.lit(True)
    out = None
    for include, regex in rules:
        out = (F.when if out is None else out.when)(path.rlike(regex), F.lit(include))
    return out.otherwise(F.lit(True))


def with_parents_included(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """``included`` for the path and each directory above it: an excluded directory takes all below with it."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    ok = F.forall(above, lambda p: included(p, rules))
    return included(path, rules) & (ok | (F.size(parts) < 2))


def merged_rules(base_rules: list[tuple[bool, str]], rule_files: list[tuple[str, str]], precedence: str = "documented") -> list[tuple[bool, str]]:
    """Rules with those of rule files ((directory, text), shallow ones first) put ahead.

    ``documented``: deeper files win; ``as_coded``: shallower files win. Files that are too
    large are skipped.
    """
    files = [(d, t) for d, t in rule_files if len(t.encode()) < RULE_FILE_LIMIT]
    files.sort(key=lambda f: 0 if f[0] in ("", ".") else f[0].count("/") + 1, reverse=precedence == "documented")
    return [r for d, t in files for r in parse_rules(t, d)] + base_rules


def filter_paths(df: DataFrame, rules: list[tuple[bool, str]], path_col: str = "path", prune: bool = True) -> DataFrame:
    """Rows whose path the rules include."""
    return df.where((with_parents_included if prune else included)(F.col(path_col), rules))


@pandas_udf(T.StringType())
def _regex(pattern: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([glob_to_regex(p, b) for p, b in zip(pattern, base)])


def rule_table(rule_files: DataFrame) -> DataFrame:
    """``dir, no, include, regex``: the rules of rule files (``dir, text``; the root is the empty string), numbered in each. Files that are too large are left out."""
    small = rule_files.where(F.octet_length("text") < RULE_FILE_LIMIT)
    lines = small.select("dir", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    pattern = r"(?s)\A\s*([+-])\s+(.+)\z"
    rules = lines.select("dir", "no", F.regexp_extract("line", pattern, 1).alias("sign"), F.regexp_extract("line", pattern, 2).alias("pattern")).where("sign <> ''")
    return rules.select("dir", "no", (F.col("sign") == "+").alias("include"), _regex("pattern", "dir").alias("regex"))


def filter_by_rule_files(df: DataFrame, rules: DataFrame, base_rules: list[tuple[bool, str]], path_col: str = "path", precedence: str = "documented") -> DataFrame:
    """Rows whose path, and each directory above it, the rules include: those of ``rule_table`` that lie in a directory above, then ``base_rules``.

    Paths meet rules by the directories above them, so the rule files may be as many as the
    directories. ``documented``: the deepest file that has a matching rule decides; ``as_coded``: the
    shallowest.
    """
    paths = df.select(F.col(path_col).alias("path_")).distinct().withColumn("parts_", F.split(F.rtrim("path_", F.lit("/")), "/"))
    # a path and the directories above it, each with the directories whose rule files apply to it
    steps = paths.select("path_", "parts_", F.explode(F.sequence(F.lit(1), F.size("parts_"))).alias("n"))
    own = F.when(F.col("n") == F.size("parts_"), F.col("path_")).otherwise(F.concat(F.array_join(F.slice("parts_", F.lit(1), F.col("n")), "/"), F.lit("/")))
    steps = steps.select(own.alias("step"), "parts_", "n").groupBy("step").agg(F.first(F.slice("parts_", F.lit(1), F.col("n") - 1)).alias("above"))
    at = steps.select("step", F.explode(F.sequence(F.lit(0), F.size("above"))).alias("depth"), "above").select("step", "depth", F.array_join(F.slice("above", F.lit(1), F.col("depth")), "/").alias("dir"))
    hits = at.join(rules, "dir").where(F.expr("step rlike regex"))
    first = F.struct(-F.col("depth") if precedence == "documented" else F.col("depth"), "no")
    decided = hits.groupBy("step").agg(F.min_by("include", first).alias("include"))
    said = steps.join(decided, "step", "left").select("step", F.coalesce("include", included(F.col("step"), base_rules)).alias("include"))
    dropped = said.where("not include").select(F.col("step").alias("dropped_"))
    # an excluded directory takes all below with it
    mine = paths.select("path_", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts_")), lambda n: F.when(n == F.size("parts_"), F.col("path_")).otherwise(F.concat(F.array_join(F.slice("parts_", F.lit(1), n), "/"), F.lit("/"))))).alias("step"))
    gone = mine.join(dropped, F.col("step") == F.col("dropped_")).select(F.col("path_").alias("gone_")).distinct()
    return df.join(gone, F.col(path_col) == F.col("gone_"), "left_anti")
