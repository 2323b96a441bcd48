"""Token breakdowns out of JSON and text, as column expressions over VARIANT values.

A breakdown is a struct of input, output, cached and reasoning counts, each null where unknown.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PARTS = ("input", "output", "cached", "reasoning")
BREAKDOWN = "struct<input: bigint, output: bigint, cached: bigint, reasoning: bigint>"
# Keys of session events and of usage objects, in the order of PARTS, and what follows a token name in text.
SESSION_KEYS = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")
USAGE_PATHS = ("input_tokens", "output_tokens", "input_tokens_details.cached_tokens", "output_tokens_details.reasoning_tokens")
TEXT_COUNT = r"[_-]?tokens?[\"'\s:=]+(\d+)"


#: Counts and sums beyond the largest long are the largest long, below the smallest its negative.
MOST = (1 << 63) - 1


def accept_repeated_keys(spark: SparkSession) -> None:
    """Lets this session read JSON objects that repeat a key; the last one counts. Spark refuses such objects unless it is told."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def whole(number: Column) -> Column:
    """A double as a long, cut off towards zero and held to +-MOST; not a number is null."""
    return once(number, lambda x: F.coalesce(x.try_cast("long"), F.when(F.isnan(x), None).when(x > 0, F.lit(MOST)).when(x < 0, F.lit(-MOST))))


def total(number: Column) -> Column:
    """An aggregate: the sum of longs, held to +-MOST; null without any."""
    return F.coalesce(F.try_sum(number), whole(F.sum(number.cast("double"))))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often ``of`` uses it: plans would repeat it for each use."""
    return F.transform(F.array(value), of)[0]


def strict_json(text: Column) -> Column:
    """The one JSON value that the text is, else null. As an element of an array, nothing may follow it."""
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return once(held, lambda h: F.when(F.try_variant_get(h, "$[1]", "variant").isNull(), F.try_variant_get(h, "$[0]", "variant")))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_container(value: Column) -> Column:
    return F.coalesce(kind(value).rlike("^(OBJECT|ARRAY)<"), F.lit(False))


def text_at(value: Column, path: str, only_text: bool = False) -> Column:
    """A non-empty string at a path; numbers and booleans as text unless ``only_text``."""
    at = F.try_variant_get(value, path, "variant")
    text = F.try_variant_get(value, path, "string")
    plain = kind(at) == "STRING" if only_text else ~F.coalesce(is_container(at), F.lit(False))
    return F.when(plain & (text != ""), text)


def number_at(value: Column, path: str) -> Column:
    """A number at a path, as a long; strings of digits are none."""
    at = F.try_variant_get(value, path, "variant")
    return once(at, lambda x: F.when(kind(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), whole(F.try_variant_get(x, "$", "double"))))


def breakdown(parts: dict[str, Column]) -> Column:
    return F.struct(*(parts[p].cast("long").alias(p) for p in PARTS))


def is_zero(b: Column) -> Column:
    """Whether all counts are zero or unknown."""
    out = F.lit(True)
    for p in PARTS:
        out = out & (F.coalesce(b[p], F.lit(0)) == 0)
    return out


def has_values(b: Column) -> Column:
    """Whether any count is known; zero is known."""
    return F.coalesce(*(b[p] for p in PARTS)).isNotNull()


def cache_hit_rate(input_: Column, cached: Column) -> Column:
    """Share of cached input; null without input."""
    return F.when(input_ > 0, F.coalesce(cached, F.lit(0)) / input_)


def score(b: Column) -> Column:
    return F.coalesce(b["input"], F.lit(0)).cast("double") + F.coalesce(b["output"], F.lit(0)).cast("double")


def session_breakdown(event: Column, info: str = "$.payload.info") -> Column:
    """The larger of the total and the last usage of an event, the total if they tie; null if all is zero."""

    def usage(name: str) -> Column:
        at = F.try_variant_get(event, f"{info}.{name}", "variant")
        return once(once(at, lambda u: breakdown({p: number_at(u, f"$.{k}") for p, k in zip(PARTS, SESSION_KEYS, strict=True)})), lambda b: F.when(~is_zero(b), b))

    both = F.struct(usage("total_token_usage").alias("total"), usage("last_token_usage").alias("last"))
    return once(both, lambda b: F.when(b["total"].isNull() | (b["last"].isNotNull() & (score(b["last"]) > score(b["total"]))), b["last"]).otherwise(b["total"]))


def usage_breakdown(value: Column, path: str) -> Column:
    """A usage object's counts, zero where absent."""
    return once(F.try_variant_get(value, path, "variant"), lambda u: breakdown({p: F.coalesce(number_at(u, f"$.{k}"), F.lit(0)) for p, k in zip(PARTS, USAGE_PATHS, strict=True)}))


def body_json(body: Column) -> Column:
    """The object or array that a log body is, or that follows the first brace in it."""
    bare = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    brace = F.instr(body, "{")
    value = F.when(bare.rlike(r"^[\[{]"), strict_json(bare)).when(brace > 0, strict_json(F.substring(body, brace, F.length(body))))
    return once(value, lambda x: F.when(is_container(x), x))


def _scanned(text: str | None) -> tuple[int, int, int, int] | None:
    """Sums of all numbers whose key names tokens, at any depth and in strings that are JSON."""
    if text is None:
        return None
    sums, todo = [0, 0, 0, 0], [text]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            try:
                value = json.loads(value, parse_constant=_no_constant)
            except (ValueError, RecursionError):
                continue
        pairs = value.items() if isinstance(value, dict) else ((("", v) for v in value) if isinstance(value, list) else ())
        for key, inner in pairs:
            if isinstance(inner, (dict, list)) or isinstance(inner, str) and inner[:1] in ("{", "[") and len(inner) > 1:
                todo.append(inner)
            elif isinstance(inner, (int, float)) and not isinstance(inner, bool) and "token" in (name := key.lower()):
                for i, part in enumerate(PARTS):
                    sums[i] += _held(inner) if part in name else 0
    return tuple(map(_held, sums))


def _held(number: float) -> int:
    return int(max(-MOST, min(MOST, number)))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind_ = pa.struct([(p, pa.int64()) for p in PARTS])
    for batch in texts:
        rows = [_scanned(t.as_py()) for t in batch]
        yield pa.array([r and dict(zip(PARTS, r, strict=True)) for r in rows], kind_)


def scan_breakdown(text: Column) -> Column:
    """The recursive scan; null in, null out, so callers hand over only texts that need it."""
    return F.arrow_udf(_scan, BREAKDOWN)(text)


def text_breakdown(body: Column) -> Column:
    """Sums of the numbers that follow token names in free text; null where there is none."""

    def matches(part: str) -> Column:
        found = F.regexp_extract_all(body, F.lit(f"(?i){part}{TEXT_COUNT}"), F.lit(1))
        most = F.lit(MOST)
        added = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: F.coalesce(F.try_add(a, F.coalesce(x.try_cast("long"), most)), most))
        return F.when(F.size(found) > 0, added)

    return breakdown({p: matches(p) for p in PARTS})
