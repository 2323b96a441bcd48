"""Workspace paths as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.config import AliasRule
from runloom.sources.scratch import discard, saved

# Labels of paths that are not known.
UNKNOWN = "(unknown)"
UNKNOWN_NAME = "Unknown workspace"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def _plain(path: Column) -> Column:
    bare = F.regexp_replace(trimmed(path), r"^\\\\\?\\", "")
    bare = F.regexp_replace(F.translate(bare, "/", "\\"), r"\\+$", "")
    return F.when(bare.rlike("^[a-zA-Z]:"), F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))).otherwise(bare)


def _known(path: Column) -> Column:
    return F.when(path == "", F.lit(UNKNOWN)).otherwise(path)


def plain_path(path: str) -> str:
    """The same rules for one path of a parameter."""
    bare = path.strip().removeprefix("\\\\?\\").replace("/", "\\").rstrip("\\")
    if len(bare) > 1 and bare[1] == ":" and bare[0].isascii() and bare[0].isalpha():
        bare = bare[0].upper() + bare[1:]
    return bare or UNKNOWN


def resolved(aliases: Iterable[AliasRule]) -> dict[str, str]:
    """Where each source, lower-cased, ends up when each rule sees what earlier ones made."""
    ends: dict[str, str] = {}
    for rule in reversed([r for r in aliases if r.enabled and r.source.strip()]):
        target = plain_path(rule.target or rule.source)
        ends[plain_path(rule.source).lower()] = ends.get(target.lower(), target)
    return ends


def normalize(path: Column, aliases: Iterable[AliasRule] = ()) -> Column:
    """The path in one notation, rewritten by alias rules; each rule sees what earlier ones made."""
    value = plain = _known(_plain(path))
    for source, target in resolved(aliases).items():
        value = F.when(F.lower(plain) == source, F.lit(target)).otherwise(value)
    return value


def with_path(df: DataFrame, raw: str, name: str, aliases: Iterable[AliasRule] = (), most: int = 32) -> DataFrame:
    """``df`` with ``name``, the normalised path in ``raw``. More than ``most`` rules are no expression but a table of their ends, which Spark joins as its size allows. Rules that are a table already go through with_path_by()."""
    ends = resolved(aliases)
    if len(ends) <= most:
        return df.withColumn(name, normalize(F.col(raw), aliases))
    rules = df.sparkSession.createDataFrame(list(ends.items()), "_source string, _target string")  # Spark knows its size
    held = df.withColumn(name, normalize(F.col(raw))).join(rules, F.lower(name) == F.col("_source"), "left")
    return held.withColumn(name, F.coalesce("_target", name)).drop("_source", "_target")


def alias_ends(rules: DataFrame) -> DataFrame:
    """_source (normalised, lower case) and _target, where its chain of rules ends, of a table of rules (ordinal, source, target, enabled).

    The same as resolved(), by pointer doubling: each rule points at the first later one that takes up
    its target, and in every round at where that one points, so a chain of n rules takes log n joins.
    Later rules are found by a window over what has a path as source or as target. Of rules with one
    ordinal the one with the lesser target counts as the later for others, and neither sees the other.
    """
    target = normalize(F.coalesce(F.nullif("target", F.lit("")), "source"))
    held = rules.where("enabled").where(trimmed(F.col("source")) != "").select("ordinal", F.lower(normalize(F.col("source"))).alias("source"), target.alias("target"))
    held = saved(held.withColumn("rule", F.monotonically_increasing_id()))
    sources = held.select(F.col("source").alias("path"), "ordinal", F.lit(0).alias("asks"), "target", "rule")
    asked = held.select(F.lower("target").alias("path"), "ordinal", F.lit(1).alias("asks"), "target", "rule")
    later = W.partitionBy("path").orderBy(F.desc("ordinal"), F.desc("asks"), F.desc("target")).rowsBetween(W.unboundedPreceding, -1)
    found = F.last(F.when(F.col("asks") == 0, F.col("rule")), ignorenulls=True).over(later)
    links = saved(sources.unionByName(asked).withColumn("next", found).where("asks = 1").select("rule", "next", F.col("target").alias("end")))
    while links.where("next is not null").limit(1).count():
        ahead = links.select(F.col("rule").alias("next"), F.col("next").alias("_next"), F.col("end").alias("_end"))
        joined = saved(links.join(ahead, "next", "left").select("rule", F.col("_next").alias("next"), F.coalesce("_end", "end").alias("end")))
        discard(links)
        links = joined
    return held.join(links, "rule").groupBy(F.col("source").alias("_source")).agg(F.min_by("end", F.struct("ordinal", "target")).alias("_target"))


def with_path_by(df: DataFrame, raw: str, name: str, rules: DataFrame) -> DataFrame:
    """``df`` with ``name``, the path in ``raw`` rewritten by a table of rules of any size; Spark chooses how to join it."""
    held = df.withColumn(name, normalize(F.col(raw))).withColumn("_lower", F.lower(name))
    held = held.join(alias_ends(rules), F.col("_lower") == F.col("_source"), "left")
    return held.withColumn(name, F.coalesce("_target", name)).drop("_source", "_target", "_lower")


def workspace_id(path: Column) -> Column:
    """URL-safe Base64 of the lower-cased path, without padding."""
    coded = F.regexp_replace(F.base64(F.encode(F.lower(path), "UTF-8")), r"[\r\n=]", "")
    return F.translate(coded, "+/", "-_")


def display_name(path: Column) -> Column:
    """Last part of the path."""
    last = F.regexp_extract(path, r"([^\\/]+)[\\/]*$", 1)
    named = F.when(last == "", path).otherwise(last)
    return F.when(path.isNull() | path.isin("", UNKNOWN), F.lit(UNKNOWN_NAME)).otherwise(named)


def is_ignored(path: Column, ignored: Iterable[str]) -> Column:
    """Whether a path equals an ignored one or lies below it, whatever the case."""
    lower, found = F.lower(path), F.lit(False)
    for entry in ignored:
        at = plain_path(entry).lower()
        found = found | (lower == at) | lower.startswith(at + "\\")
    return found


def hidden_by(df: DataFrame, name: str, ignored: DataFrame) -> DataFrame:
    """``df`` with hidden: whether the path in ``name`` equals one of a table ``ignored`` (path) or lies below it, whatever the case.

    Each distinct path is split into itself and the folders above it, and these are joined by equality.
    """
    parts = F.split(F.lower("_path"), r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\\"))
    wanted = ignored.select(F.lower(normalize(F.col("path"))).alias("_at")).distinct()
    hits = df.select(F.col(name).alias("_path")).distinct().withColumn("_at", F.explode(above)).join(wanted, "_at", "left_semi").select("_path").distinct()
    return df.join(hits, F.col(name) == F.col("_path"), "left").withColumn("hidden", F.col("_path").isNotNull()).drop("_path")


def file_stem(path: Column) -> Column:
    """File name without the ending .jsonl; null for an empty path."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), r"(?<=.)\.jsonl$", "")
    return F.when(F.coalesce(path, F.lit("")) != "", stem)
