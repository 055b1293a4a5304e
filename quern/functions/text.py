"""Text rules as column expressions. Whole texts, no prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


# Patterns of the value scan, task names, paths and answers.
VALUE_PATTERNS = {
    "url": r"(?i)\bhttps?://[^\s\"'<>]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "uuid": r"(?i)\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b",
    "token": r"\b[A-Za-z0-9_-]{32,}\b",
}
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
ANSWER_NAME = r"(?i)(^|[_\-.])(answer|answers|ground[_-]?truth|private[_-]?label)([_\-.]|$)"
HEADINGS = ["task", "metric", "submission format", "dataset"]
FAILURES = [
    (("exceeded", "wall-clock"), "solver_timeout"),
    (("did not create",), "missing_submission"),
    (("could not be scored",), "invalid_submission"),
    (("does not exist",), "no_usable_train_py"),
]
OTHER_FAILURE = "solver_runtime_error"
FENCE = "```"


def trimmed(text: Column) -> Column:
    """Strip every Unicode white space, not only U+0020."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(r"^(?U)\s*$")


def plan_and_code(df: DataFrame, response: str) -> DataFrame:
    """Add plan, code and reason: a plan followed by one closing code block, or why not.

    The pattern runs once per part, and only on texts that hold a fence.
    """
    shape = r"(?is)\A\s*(.*?)\s*\n```(?:python|py)?\s*\n(.*?)\n```\s*\z"
    fence_in = F.contains(response, F.lit(FENCE))
    parts = df.withColumns({
        "_fits": fence_in & F.col(response).rlike(shape),
        "_plan": F.when(fence_in, F.regexp_extract(response, shape, 1)),
        "_code": F.when(fence_in, F.regexp_extract(response, shape, 2)),
    })
    cut = parts.withColumns({"_plan": trimmed(F.col("_plan")), "_code": trimmed(F.col("_code"))})
    plan, code = F.col("_plan"), F.col("_code")
    reason = (
        F.when(~F.col("_fits"), "not_plan_then_code").when((plan == "") | (code == ""), "empty_part")
        .when(plan.contains(FENCE) | code.contains(FENCE), "extra_fence")
    )
    judged = cut.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return judged.select(
        *df.columns, F.when(ok, plan).alias("plan"), F.when(ok, F.concat(code, F.lit("\n"))).alias("code"), "reason"
    )


def excerpt(text: Column, limit: int, label: str) -> Column:
    """Middle cut out, a marker names the omitted count; shorter texts pass unchanged."""
    size = F.length(text)
    marker = F.concat(F.lit(f"\n...[{label}; "), (size - limit).cast("string"), F.lit(" characters omitted]...\n"))
    room = F.greatest(F.lit(0), F.lit(limit) - F.length(marker))
    head = F.floor(room / 2).cast("int")
    tail = (room - head).cast("int")
    return F.when(size <= limit, text).otherwise(F.concat(F.left(text, head), marker, F.right(text, tail)))


def byte_capped(text: Column, limit: int) -> Column:
    """First ``limit`` bytes, a broken last character replaced, plus a notice when cut."""
    raw = F.encode(text, "utf-8")
    head = F.call_function("make_valid_utf8", F.substring(raw, 1, limit).cast("string"))
    notice = F.lit(f"\n[output truncated after {limit} bytes]")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, notice))


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template


def open_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\{\{[A-Za-z0-9_]+\}\})"))
    return F.array_sort(F.array_distinct(found))


def failure_code(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    out = None
    for words, code in FAILURES:
        hit = F.lit(True)
        for w in words:
            hit = hit & low.contains(w)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(OTHER_FAILURE)


def scrub_lines(text: Column, drops: Sequence[str], shown: int | None = None) -> Column:
    """struct(text, leftovers): bullets that document only dropped names are removed.

    Leftovers are other lines that name a dropped column in backticks, cut to
    ``shown`` characters if given, then every bare mention with 40 characters around it.
    """
    gone = F.array(*map(F.lit, drops))

    def ticks(line):
        return F.regexp_extract_all(line, F.lit("`([^`]+)`"))

    def hits(line):
        return F.arrays_overlap(ticks(line), gone)

    def only_dropped(line):
        names = F.filter(ticks(line), lambda n: n.rlike(r"^(?U)[\w()\- .]+$"))
        return hits(line) & line.rlike(r"^(?U)\s*[-*]") & (F.size(names) > 0) & F.forall(names, lambda n: F.array_contains(gone, n))

    lines = F.split(text, "\r\n|\n|\r")
    kept = F.filter(lines, lambda x: ~only_dropped(x))
    named = F.transform(F.filter(kept, hits), lambda x: trimmed(x) if shown is None else F.left(trimmed(x), F.lit(shown)))
    out = F.array_join(kept, "\n")
    bare = [_mentions(out, d) for d in drops]
    return F.struct(out.alias("text"), F.concat(named, *bare).alias("leftovers"))


def _mentions(text: Column, name: str, around: int = 40) -> Column:
    """Bare mentions of ``name`` outside backticks, each with its surroundings."""
    import re

    parts = F.split(text, f"(?<!`){re.escape(name)}(?!`)", -1)
    n = F.size(parts)

    def context(i):
        before = F.array_join(F.slice(parts, F.lit(1), i), name)
        after = F.array_join(F.slice(parts, i + 1, n), name)
        around_it = F.concat(F.right(before, F.lit(around)), F.lit(name), F.left(after, F.lit(around)))
        return F.concat(F.lit("prose: …"), F.replace(around_it, F.lit("\n"), F.lit(" ")), F.lit("…"))

    none = F.array().cast("array<string>")
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), context)).otherwise(none)


def heading_report(text: Column) -> Column:
    """struct(missing, in_order) for the required level-2 headings."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1)), lambda h: F.lower(trimmed(h))
    )
    need = F.array(*map(F.lit, HEADINGS))
    missing = F.array_except(need, found)
    places = F.transform(need, lambda h: F.array_position(found, h))
    return F.struct(
        missing.alias("missing"), ((F.size(missing) > 0) | (F.array_sort(places) == places)).alias("in_order")
    )


def sentence_count(text: Column) -> Column:
    return F.regexp_count(trimmed(text), F.lit(r"(?U)[.!?](?:\s|$)"))


def safe_path(path: Column) -> Column:
    """Normalised relative path of two or more parts below ``public``."""
    parts = F.split(path, "/", -1)
    clean = F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    return clean & ~path.contains("\\") & (F.size(parts) >= 2) & (parts[0] == "public")


def missing_phrases(text: Column, required: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, required)), lambda p: ~F.contains(text, p))


def forbidden_phrases(text: Column, forbidden: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, forbidden)), lambda p: F.contains(low, p))


def pattern_counts(text: Column) -> dict[str, Column]:
    """Matches per value pattern. Counts only, never the matched values."""
    return {name: F.regexp_count(text, F.lit(p)) for name, p in VALUE_PATTERNS.items()}


def number_12g(x: Column) -> Column:
    """Twelve significant digits, trailing zeros removed, C's general format."""
    size = F.abs(x)
    science = F.format_string("%.11e", x)
    mantissa = F.regexp_replace(F.substring_index(science, "e", 1), r"\.?0+$", "")
    # The exponent is read after rounding to twelve digits.
    power = F.substring_index(science, "e", -1).cast("int")
    out = None
    for p in range(-4, 12):
        text = F.format_string(f"%.{11 - p}f", x)
        text = F.regexp_replace(text, r"\.?0+$", "") if p < 11 else text
        out = F.when(power == p, text) if out is None else out.when(power == p, text)
    return F.when(size == 0, F.lit("0")).otherwise(out.otherwise(F.concat(mantissa, F.lit("e"), F.substring_index(science, "e", -1))))
