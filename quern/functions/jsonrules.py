"""JSON type rules on variant values: bool is not a number, keys must not repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


# Fields and tier names of the task record, fields of a review.
REQUIRED_FIELDS = [
    "competition_id", "dataset", "category", "short_description", "is_lower_better",
    "evaluation_metric", "gold_solution_score", "score_tiers", "hidden_test_set",
    "hidden_test_paths", "wall_clock_limit_minutes", "task_difficulty",
]
FORBIDDEN_FIELDS = [
    "baseline_score", "minimum_score", "score_tier_rule", "environment_constraints",
    "system_prompt_addendum",
]
TIER_NAMES = ["baseline", "bronze", "silver", "gold"]
REVIEW_FIELDS = ["is_bug", "has_csv_submission", "summary", "metric", "lower_is_better"]
SMALL_MARGIN = 1e-4


def parsed(raw: Column) -> Column:
    """Variant, or null when the text is malformed or repeats a key."""
    return F.try_parse_json(raw)


def document_state(raw: Column) -> Column:
    """ok / duplicate_key / malformed / absent."""
    loose = F.from_json(raw, "map<string,string>")
    return (
        F.when(raw.isNull(), "absent").when(parsed(raw).isNotNull(), "ok")
        .when(loose.isNotNull() & (F.size(loose) > 0), "duplicate_key").otherwise("malformed")
    )


def with_nodes(df: DataFrame, raw: str, paths: Sequence[str]) -> DataFrame:
    """Add ``_doc`` and, per path, a struct column ``_<path>`` of kind, num, txt and flag.

    Every step is a column of its own, so a document is parsed once per row
    however many rules look at it. ``kind`` is absent, null, bool, text, whole,
    real, array or object; ``num`` is a finite number and never a boolean.
    """
    names = {p: "_" + p for p in paths}
    parsed_once = df.withColumn("_doc", parsed(F.col(raw)))
    at = parsed_once.withColumns({f"_v{i}": F.try_variant_get("_doc", f"$.{p}", "variant") for i, p in enumerate(paths)})
    shaped = at.withColumns({f"_s{i}": F.schema_of_variant(f"_v{i}") for i in range(len(paths))})

    def kind(i):
        s = F.col(f"_s{i}")
        return (
            F.when(F.col(f"_v{i}").isNull(), "absent").when(s == "VOID", "null").when(s == "BOOLEAN", "bool")
            .when(s == "STRING", "text").when(s == "BIGINT", "whole").when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object").otherwise("real")
        )

    kinds = shaped.withColumns({f"_k{i}": kind(i) for i in range(len(paths))})

    def node(i):
        k, v = F.col(f"_k{i}"), f"_v{i}"
        number = F.when(k.isin("whole", "real"), F.try_variant_get(v, "$", "double"))
        finite = F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)
        return F.struct(
            k.alias("kind"), finite.alias("num"), F.when(k == "text", F.try_variant_get(v, "$", "string")).alias("txt"),
            F.when(k == "bool", F.try_variant_get(v, "$", "boolean")).alias("flag"),
        )

    done = kinds.withColumns({names[p]: node(i) for i, p in enumerate(paths)})
    return done.drop(*[f"_{c}{i}" for c in "vsk" for i in range(len(paths))])


def node(path: str) -> Column:
    return F.col(f"`_{path}`")


def field_sets(raw: Column, required: Sequence[str], forbidden: Sequence[str] = ()) -> dict[str, Column]:
    """Required but absent, forbidden but present, present but not required."""
    have = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    need = F.array(*map(F.lit, required))
    ban = F.array(*map(F.lit, forbidden)) if forbidden else F.array().cast("array<string>")
    return {
        "missing": F.array_sort(F.array_except(need, have)),
        "forbidden": F.array_sort(F.array_intersect(ban, have)),
        "extra": F.array_sort(F.array_except(have, need)),
    }


def listed(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


REVIEW_PATHS = REVIEW_FIELDS
TIER_PATHS = [f"score_tiers.{n}" for n in TIER_NAMES]
RECORD_PATHS = [
    "competition_id", "category", "dataset", "evaluation_metric", "short_description", "is_lower_better",
    "wall_clock_limit_minutes", "task_difficulty", "gold_solution_score", "score_tiers", *TIER_PATHS,
]


def no_text(n: Column) -> Column:
    return n["txt"].isNull() | n["txt"].rlike(r"^(?U)\s*$")


def review_errors(df: DataFrame, raw: str, out: str = "errors") -> DataFrame:
    """Add the rules a review record breaks, in a fixed order."""
    ready = with_nodes(df, raw, REVIEW_PATHS).withColumns(
        {f"_f_{k}": F.size(v) for k, v in field_sets(F.col(raw), REVIEW_FIELDS).items()}
    )
    same = F.col("_doc").isNotNull() & (F.col("_f_missing") == 0) & (F.col("_f_extra") == 0)
    is_bool = {n: node(n)["kind"] == "bool" for n in REVIEW_FIELDS}
    broken = listed(
        F.when(~(is_bool["is_bug"] & is_bool["has_csv_submission"]), "boolean_fields"),
        F.when(no_text(node("summary")), "summary"),
        F.when((node("metric")["kind"] != "null") & node("metric")["num"].isNull(), "metric"),
        F.when(~is_bool["lower_is_better"], "direction"),
    )
    return ready.withColumn(out, F.when(~same, F.array(F.lit("field_set"))).otherwise(broken)).select(*df.columns, out)


def tier_rules() -> list[Column]:
    """Tier order in the metric's direction, gold cleared, gold cleared by a hair."""
    base, bronze, silver, top = (node(p)["num"] for p in TIER_PATHS)
    lower, gold = node("is_lower_better")["flag"], node("gold_solution_score")["num"]
    usable = lower.isNotNull() & base.isNotNull() & bronze.isNotNull() & silver.isNotNull() & top.isNotNull()
    falls = (base >= bronze) & (bronze >= silver) & (silver >= top)
    rises = (base <= bronze) & (bronze <= silver) & (silver <= top)
    clears = F.when(lower, gold <= top).otherwise(gold >= top)
    margin = F.abs(gold - top) / F.greatest(F.lit(1.0), F.abs(top))
    return [
        F.when(usable & ~F.when(lower, falls).otherwise(rises), "tier_order"),
        F.when(usable & ~clears, "gold_not_cleared"),
        F.when(usable & clears & (margin < SMALL_MARGIN), "small_margin"),
    ]


def tier_errors(df: DataFrame, raw: str, out: str = "errors") -> DataFrame:
    """Add tier problems of parsable records; other records are left out."""
    ready = with_nodes(df, raw, ["is_lower_better", "gold_solution_score", *TIER_PATHS])
    return ready.where("_doc is not null").withColumn(out, listed(*tier_rules())).select(*df.columns, out)


def task_record_errors(df: DataFrame, raw: str, slug: str, final: bool = False, out: str = "errors") -> DataFrame:
    """Add the rules a task record breaks; ``final`` also wants every score filled."""
    ready = with_nodes(df, raw, RECORD_PATHS).withColumns(
        {f"_f_{k}": F.size(v) for k, v in field_sets(F.col(raw), REQUIRED_FIELDS, FORBIDDEN_FIELDS).items()}
    )
    inner = F.json_object_keys(F.get_json_object(raw, "$.score_tiers"))
    ready = ready.withColumn("_tiers", F.array_sort(F.coalesce(inner, F.array().cast("array<string>"))))

    def no_whole(path, least, most=None):
        n = node(path)
        ok = (n["kind"] == "whole") & (n["num"] >= least)
        return ~(ok if most is None else ok & (n["num"] <= most)) | n["num"].isNull()

    def no_score(path):
        n = node(path)
        return n["num"].isNull() if final else ~n["kind"].isin("absent", "null") & n["num"].isNull()

    has_tiers = node("score_tiers")["kind"] == "object"
    order, cleared, _ = tier_rules()
    broken = listed(
        F.when(F.col("_f_missing") > 0, "missing_fields"),
        F.when(F.col("_f_forbidden") > 0, "forbidden_fields"),
        F.when(~F.coalesce(node("competition_id")["txt"] == F.col(slug), F.lit(False)), "competition_id"),
        *[F.when(no_text(node(n)), n) for n in ("category", "dataset", "evaluation_metric", "short_description")],
        F.when(node("is_lower_better")["kind"] != "bool", "is_lower_better"),
        F.when(no_whole("wall_clock_limit_minutes", 1), "wall_clock_limit_minutes"),
        F.when(no_whole("task_difficulty", 1, 5), "task_difficulty"),
        F.when(no_score("gold_solution_score"), "gold_solution_score"),
        F.when(~has_tiers, "score_tiers"),
        F.when(has_tiers & (F.col("_tiers") != F.array(*map(F.lit, sorted(TIER_NAMES)))), "tier_names"),
        *[F.when(has_tiers & no_score(p), p) for p in TIER_PATHS],
        order,
        cleared,
    )
    return ready.withColumn(
        out, F.when(F.col("_doc").isNull(), F.array(document_state(F.col(raw)))).otherwise(broken)
    ).select(*df.columns, out)
