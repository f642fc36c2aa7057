"""Filters, flags, de-duplication, coercion and column shuffling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.functions.numbers import missing_count
from duelframe.functions.text import elapsed_minutes, elapsed_seconds, left_side, lenient_double, right_side

# Outcome texts and the flag each way of ending a match sets.
WON_LEFT, WON_RIGHT = "W/L", "L/W"
METHOD_FLAGS: dict[str, tuple[str, ...]] = {
    "udec": ("Decision - Unanimous",),
    "mdec": ("Decision - Majority",),
    "sdec": ("Decision - Split",),
    "subw": ("Submission",),
    "ko": ("KO/TKO", "TKO - Doctor's Stoppage"),
}
CONCEDED = {"udec": "udecd", "mdec": "mdecd", "sdec": "sdecd", "subw": "subwd", "ko": "kod"}
# The time formats that are comparable round by round.
REGULAR_FORMATS = ["3 Rnd (5-5-5)", "5 Rnd (5-5-5-5-5)", "2 Rnd (5-5)", "3 Rnd + OT (5-5-5-5)"]


def outcome_flags(method: Column, won: Column, lost: Column) -> dict[str, Column]:
    """win, loss and one achieved and one conceded flag per way of ending."""
    flags = {"win": won, "loss": lost}
    for flag, methods in METHOD_FLAGS.items():
        by = F.trim(method).isin(list(methods))
        flags[flag] = by & won
        flags[CONCEDED[flag]] = by & lost
    return {k: F.when(v, 1).otherwise(0) for k, v in flags.items()}


def match_sides(results: DataFrame, *, bout="BOUT", outcome="OUTCOME", method="METHOD", round_no="ROUND", clock="TIME",
                keep: Sequence[str] = ("DATE", "EVENT")) -> DataFrame:
    """One row per match and side with outcome flags and minutes fought; voided matches are left out.

    One scan: each result row is exploded into its two points of view.
    """
    valid = exclude_void(results, outcome, method)
    sides = valid.withColumn("_side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    left = F.col("_side") == "L"
    won = F.when(left, F.col(outcome) == WON_LEFT).otherwise(F.col(outcome) == WON_RIGHT)
    lost = F.when(left, F.col(outcome) == WON_RIGHT).otherwise(F.col(outcome) == WON_LEFT)
    return sides.select(
        *[F.trim(c).alias(c) if c != "DATE" else F.col(c) for c in keep],
        F.trim(bout).alias(bout),
        F.when(left, left_side(bout)).otherwise(right_side(bout)).alias("fighter"),
        *[v.cast("int").alias(k) for k, v in outcome_flags(F.col(method), won, lost).items()],
        elapsed_minutes(round_no, clock).alias("fight_time_minutes"),
        elapsed_seconds(round_no, clock).alias("fight_time_seconds"),
    ).distinct()


def exclude_void(df: DataFrame, outcome: str = "OUTCOME", method: str = "METHOD") -> DataFrame:
    return df.where(~F.coalesce((F.col(outcome) == "NC/NC") | (F.trim(method) == "Overturned"), F.lit(False)))


def drop_irregular(df: DataFrame, time_format: str = "TIME FORMAT", round_no: str = "ROUND",
                   corrections: DataFrame | None = None) -> DataFrame:
    """Drop rows of unusual formats that lasted beyond round 1, then add corrected rows if given; unknown formats and rounds stay."""
    fmt, rnd = F.col(f"`{time_format}`"), F.col(round_no)
    kept = df.where(~F.coalesce(~fmt.isin(REGULAR_FORMATS) & (rnd.cast("string") != "1"), F.lit(False)))
    return kept if corrections is None else kept.unionByName(corrections)


def strip_quotes_from_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("'", "") for c in df.columns])


def winner_loser(df: DataFrame, result="result", entity="entity", opponent="opp_entity") -> DataFrame:
    won = F.col(result) == 1
    return df.withColumns({
        "winner": F.when(won, F.col(entity)).otherwise(F.col(opponent)),
        "loser": F.when(won, F.col(opponent)).otherwise(F.col(entity)),
    })


def result_column(df: DataFrame, win: str = "win", renames: Mapping[str, str] | None = None) -> DataFrame:
    """Result flag from the win column, optional renames."""
    out = df.withColumn("result", F.when(F.col(win).cast("int") == 1, 1).otherwise(0))
    return out.withColumnsRenamed(dict(renames or {}))


def since(df: DataFrame, ts: str, floor: str, league: str | None = None, value=None) -> DataFrame:
    out = df.where(F.col(ts) >= F.lit(floor).cast("date"))
    return out if league is None else out.where(F.col(league) == value)


def experienced(df: DataFrame, count: str, opp_count: str, at_least: int) -> DataFrame:
    """Both sides have at least this many earlier matches."""
    return df.where((F.col(count) >= at_least) & (F.col(opp_count) >= at_least))


def with_appearances(df: DataFrame, entity: str, out: str = "appearances") -> DataFrame:
    """Total rows of the entity on every row: pre-aggregated counts joined back."""
    counts = df.groupBy(F.col(entity).alias("_entity")).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, F.col(entity).eqNullSafe(F.col("_entity")), "left").drop("_entity")


def appears_at_least(df: DataFrame, entity: str, n: int) -> DataFrame:
    return with_appearances(df, entity, "_appearances").where(F.col("_appearances") >= n).drop("_appearances")


def keep_complete_enough(df: DataFrame, features: Sequence[str], max_missing_share: float = 0.7) -> DataFrame:
    """Rows with fewer than int(share * features) missing values."""
    return df.where(missing_count(list(features)) < int(max_missing_share * len(features)))


def keep_with_any(df: DataFrame, features: Sequence[str], at_least: int = 2) -> DataFrame:
    return df.dropna(thresh=at_least, subset=list(features))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of every key; the order makes the choice repeatable."""
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    window = Window.partitionBy(*keys).orderBy(*ranks)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the latest row of every key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def move_columns(df: DataFrame, block: Sequence[str], anchor: str, place: str = "after") -> DataFrame:
    others = [c for c in df.columns if c not in block]
    at = others.index(anchor) + (1 if place == "after" else 0)
    return df.select(*others[:at], *block, *others[at:])


def insert_after_twins(df: DataFrame, pairs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Place each block of columns behind its anchor column."""
    for anchor, block in pairs.items():
        df = move_columns(df, list(block), anchor, "after")
    return df


def drop_prefixed(df: DataFrame, prefix: str = "Unnamed") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def prefixed(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles: unparsable text and absent columns become NULL."""
    return df.withColumns({
        c: lenient_double(c) if c in df.columns else F.lit(None).cast("double") for c in columns
    })


# Largest plausible absolute odds per book.
ODDS_LIMITS = {
    "draftkings_odds": 5000, "fanduel_odds": 3500, "betmgm_odds": 5000, "bet365_odds": 5000, "bovada_odds": 5000,
}


def null_out_of_bounds(df: DataFrame, limits: Mapping[str, float] = ODDS_LIMITS) -> DataFrame:
    """Numbers beyond the limit of their column become NULL."""
    return df.withColumns({
        c: F.when(F.abs(lenient_double(c)) <= top, lenient_double(c)) for c, top in limits.items() if c in df.columns
    })


def bounds_report(df: DataFrame, limits: Mapping[str, float] = ODDS_LIMITS) -> DataFrame:
    """How many values per column are missing once the limits are applied: one pass, one row per column."""
    cols = [c for c in limits if c in df.columns]
    checked = null_out_of_bounds(df, limits)
    wide = checked.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "removed")


def within_all(df: DataFrame, columns: Sequence[str], low: float, high: float, allow_missing: bool = False) -> DataFrame:
    """Every column lies in [low, high]; a missing value fails unless allowed."""
    def ok(c):
        inside = F.col(c).between(low, high)
        return F.coalesce(inside, F.lit(allow_missing))

    return df.where(reduce(lambda a, b: a & b, [ok(c) for c in columns]))


def sample_entities(df: DataFrame, entity: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct entities in a repeatable pseudo-random order: the smallest digests of (seed, entity)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(entity).cast("string")))
    return df.select(entity).distinct().orderBy(digest, entity).limit(n)


def rows_removed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``before`` whose key is gone from ``after``."""
    return before.join(after.select(*keys).distinct(), list(keys), "left_anti")
