"""Putting the two sides of a match together: opponents, mirrors, lookups, fuzzy and as-of joins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.functions.text import block_ratio, edit_ratio, left_side, right_side
from duelframe.operators.phrases import PART_BYTES, phrases_in
from duelframe.plans.ordered import ordered_scan
from duelframe.plans.sizing import fits_broadcast, same_key


# ---------------------------------------------------------------- opponents

def opponent_rows(df: DataFrame, match: Sequence[str], entity: str, stats: Mapping[str, str]) -> DataFrame:
    """Add the other side's stats, {source column: new column}, to every side of a two-sided match.

    The two sides are found with min/max of a struct per match: combined
    map-side, one row per match, no self-join. Rows of a match that does not
    have exactly two different sides keep NULL and show their ``n_sides``.
    """
    side = F.struct(F.lower(F.col(entity)).alias("_who"), *[F.col(c) for c in stats])
    ends = df.groupBy(*match).agg(
        F.count(F.lit(1)).alias("n_sides"), F.min(side).alias("_lo"), F.max(side).alias("_hi")
    )
    joined = df.join(ends, list(match))
    two = (F.col("n_sides") == 2) & (F.col("_lo._who") != F.col("_hi._who"))
    is_lo = F.lower(F.col(entity)) == F.col("_lo._who")
    return joined.withColumns({
        new: F.when(two, F.when(is_lo, F.col(f"_hi.{c}")).otherwise(F.col(f"_lo.{c}"))) for c, new in stats.items()
    }).drop("_lo", "_hi")


def others_total(df: DataFrame, match: Sequence[str], stats: Mapping[str, str]) -> DataFrame:
    """Sum over everybody else in the match, for any number of sides: match total minus own value."""
    totals = df.groupBy(*match).agg(*[F.sum(c).alias(f"_t_{c}") for c in stats])
    return (
        df.join(totals, list(match))
        .withColumns({new: F.col(f"_t_{c}") - F.col(c) for c, new in stats.items()})
        .drop(*[f"_t_{c}" for c in stats])
    )


def side_join(left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """One row per match: left side's columns plus the right side's with a prefix."""
    renamed = right.select(*[F.col(c).alias(c if c in on else prefix + c) for c in right.columns])
    return left.join(renamed, list(on))


def left_view(df: DataFrame, label: str, name: str) -> DataFrame:
    """Rows whose entity is named first in the match label."""
    return df.where(F.instr(F.col(label), F.col(name)) == 1)


def right_view(df: DataFrame, label: str, name: str) -> DataFrame:
    return df.where(F.instr(F.col(label), F.col(name)) > 1)


def mirror_rows(df: DataFrame, prefix: str = "opp_", fixed: Sequence[str] = ("result",), recompute: str | None = None,
                source: str = "win") -> DataFrame:
    """Every row and its twin with ``x`` and ``opp_x`` exchanged, in one scan.

    Columns without a twin stay. ``recompute`` derives that column from
    ``source`` after the swap, so a result always belongs to the row's own side.
    """
    names = [c for c in df.columns if c not in fixed]
    pairs = {c: prefix + c for c in names if not c.startswith(prefix) and prefix + c in names}
    swap = {**pairs, **{v: k for k, v in pairs.items()}}
    straight = F.struct(*[F.col(c) for c in df.columns])
    turned = F.struct(*[F.col(swap.get(c, c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    both = df.select(F.explode(F.array(straight, turned)).alias("_r")).select("_r.*")
    if recompute:
        both = both.withColumn(recompute, F.when(F.col(source).cast("int") == 1, 1).otherwise(0))
    return both


def winners_and_losers(df: DataFrame, match: Sequence[str], entity: str, won: str) -> DataFrame:
    """Winner and loser of every decided match from one row per side."""
    return (
        df.groupBy(*match)
        .agg(
            F.max(F.when(F.col(won) == 1, F.col(entity))).alias("winner"),
            F.max(F.when(F.col(won) == 0, F.col(entity))).alias("loser"),
        )
        .where(F.col("winner").isNotNull() & F.col("loser").isNotNull())
    )


# ---------------------------------------------------------------- lookups

def lookup_left(df: DataFrame, table: DataFrame, on: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Scalar lookup: at most one table row per key, values renamed, missing keys give NULL."""
    unique = table.groupBy(*on).agg(*[F.min(c).alias(new) for c, new in columns.items()])
    return df.join(unique, list(on), "left")


def overwrite_from(df: DataFrame, updates: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace columns where an update row exists, keep the old values elsewhere."""
    new = updates.dropDuplicates(list(on)).select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = df.join(new, list(on), "left")
    return out.withColumns({
        c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns
    }).select(*df.columns)


def contains_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """All (text row, phrase row) with the phrase inside the text, ignoring case.

    Distinct texts run once through an automaton of all phrases (``phrases_in``); what is found is joined by equality.
    """
    low = texts.select(F.lower(text).alias("_low"))
    keyed = phrases.withColumn("_phrase", F.lower(phrase))
    hits = phrases_in(low, "_low", keyed, "_phrase", part_bytes).join(keyed, "_phrase").drop("_phrase")
    return texts.withColumn("_low", F.lower(text)).join(hits, "_low").drop("_low")


def longest_phrase(matched: DataFrame, keys: Sequence[str], phrase: str) -> DataFrame:
    """Of several phrases found in one text keep the longest."""
    rest = [c for c in matched.columns if c not in keys]
    best = matched.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.length(phrase), F.col(phrase))).alias("_m")
    )
    return best.select(*keys, "_m.*").select(*matched.columns)


def attribute_of_named(entities: DataFrame, name: str, results: DataFrame, label: str, value: str) -> DataFrame:
    """Value of any match whose "A vs. B" label names the entity (smallest when several differ).

    The label is split into its two sides, so a containment scan becomes an equi-join.
    """
    named = results.select(
        F.explode(F.array(left_side(label), right_side(label))).alias(name), F.col(value)
    ).groupBy(name).agg(F.min(value).alias(value))
    return entities.join(named, name, "left")


def nearest_value(df: DataFrame, group: str, value: str, table: DataFrame, table_value: str, carry: Sequence[str],
                  key: Sequence[str], limit: int | None = 1_000) -> DataFrame:
    """The table row of the same group with the closest value, the larger one on a tie.

    Rows without a value, and groups that the table lacks, have no nearest row and are left out. Of several table rows
    with the same value the one with the largest carried columns counts, on either way.

    A table proven small is broadcast and reduced per row; otherwise the
    neighbours below and above are found by two as-of passes, so a crowded group
    never pairs everything with everything.
    """
    cols = list(dict.fromkeys([table_value, *carry]))
    df, table = df.where(F.col(value).isNotNull()), table.where(F.col(table_value).isNotNull())
    if fits_broadcast(table, limit):
        grouped = table.groupBy(group).agg(F.collect_list(F.struct(*cols)).alias("_t"))
        joined = df.join(F.broadcast(grouped), group)
        best = F.array_max(F.transform(
            "_t", lambda t: F.struct((-F.abs(t[table_value] - F.col(value))).alias("_d"), t.alias("_t")),
        ))
        return joined.withColumn("_b", best).select(*df.columns, *[F.col(f"_b._t.{c}").alias(c) for c in cols])
    probe = df.withColumn("_v", F.col(value))
    side = table.select(group, F.col(table_value).alias("_v"), F.struct(*cols).alias("_snap"))
    below = asof_latest(probe, side, [group], "_v", "_snap", "_below", strict=False, tie=list(key))
    flipped = side.withColumn("_v", -F.col("_v"))
    above = asof_latest(below.withColumn("_v", -F.col("_v")), flipped, [group], "_v", "_snap", "_above", strict=False, tie=list(key))
    d_below, d_above = F.col(value) - F.col(f"_below.{table_value}"), F.col(f"_above.{table_value}") - F.col(value)
    pick = F.when(F.col("_below").isNull() | (d_above <= d_below), F.col("_above")).otherwise(F.col("_below"))
    return above.withColumn("_b", pick).where(F.col("_b").isNotNull()).select(
        *df.columns, *[F.col(f"_b.{c}").alias(c) for c in cols]
    )


# ---------------------------------------------------------------- as-of

def asof_latest(probes: DataFrame, snapshots: DataFrame, keys: Sequence[str], ts: str, snap: str, out: str,
                *, strict: bool = True, tie: Sequence[str] = (), **kw) -> DataFrame:
    """Latest snapshot (column ``snap``) of the same key before each probe, NULL if there is none.

    Of several snapshots of one key and instant the largest counts.

    Probes and snapshots are interleaved in one ordered scan. With ``strict`` a
    snapshot of the same instant does not count.
    """
    first, second = (0, 1) if strict else (1, 0)
    ties = list(tie)
    types = {f.name: f.dataType for f in probes.schema.fields}
    snap_type = snapshots.schema[snap].dataType
    p = probes.withColumns({"_kind": F.lit(first), "_snapshot": F.lit(None).cast(snap_type)})
    s = snapshots.select(
        *[
            F.col(c).cast(types[c]).alias(c) if c in (*keys, ts) else F.lit(None).cast(types[c]).alias(c)
            for c in probes.columns
        ],
        F.lit(second).alias("_kind"),
        F.col(snap).alias("_snapshot"),
    )

    def build(d, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn(out, F.last("_snapshot", ignorenulls=True).over(before))

    seen = ordered_scan(p.unionByName(s), list(keys), [ts, "_kind", *ties, "_snapshot"], build, reach=1, lasts=["_snapshot"], **kw)
    return seen.where(F.col("_kind") == first).drop("_kind", "_snapshot")


def expand_matchups(requests: DataFrame, latest: DataFrame, a: str, b: str, entity: str, prefix: str = "opp_") -> DataFrame:
    """Requests (a, b) with both sides' latest snapshot; unknown sides give NULL."""
    own = latest.select(*[F.col(c).alias("_own_key" if c == entity else c) for c in latest.columns])
    opp = latest.select(*[F.col(c).alias("_opp_key" if c == entity else prefix + c) for c in latest.columns])
    return (
        requests.join(own, F.col(a) == F.col("_own_key"), "left")
        .join(opp, F.col(b) == F.col("_opp_key"), "left")
        .drop("_own_key", "_opp_key")
    )


def asof_sides(matches: DataFrame, snapshots: DataFrame, *, match_id: str, ts: str, a: str, b: str, entity: str,
               columns: Sequence[str], prefix: str = "opp_", **kw) -> DataFrame:
    """Matches with both sides' latest snapshot strictly before the match, NULL for a side without one.

    Both sides are probed in one scan: a match is one probe per side, and the
    two answers come back together in one aggregation by match.
    """
    probes = matches.select(F.col(match_id), F.col(ts), F.explode(F.array(
        F.struct(F.lit(0).alias("_side"), F.col(a).alias(entity)), F.struct(F.lit(1).alias("_side"), F.col(b).alias(entity)),
    )).alias("_p")).select(match_id, ts, "_p.*")
    snaps = snapshots.select(entity, ts, F.struct(*columns).alias("_snap"))
    seen = asof_latest(probes, snaps, [entity], ts, "_snap", "_found", tie=[match_id, "_side"], **kw)
    both = seen.groupBy(match_id).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_found"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_found"))).alias("_b")
    )
    return matches.join(both, match_id).select(
        *matches.columns, *[F.col(f"_a.{c}").alias(c) for c in columns], *[F.col(f"_b.{c}").alias(prefix + c) for c in columns]
    )


def version_at(requests: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored version of exactly this entity and date."""
    return requests.join(history, list(keys))


def rating_or_default(df: DataFrame, ratings: DataFrame, key: str, rating: str, out: str, default: float = 1500.0):
    known = ratings.select(F.col(key), F.col(rating).alias(out))
    return df.join(known, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


# ---------------------------------------------------------------- names

def full_name_members(people: DataFrame, first: str, last: str, wanted: DataFrame, name: str) -> DataFrame:
    """People whose "First Last" is in the wanted list."""
    named = people.withColumn(name, F.concat_ws(" ", F.trim(first), F.trim(last)))
    return named.join(wanted.select(name).distinct(), name, "left_semi").select(*people.columns, name)


def tiered_names(requests: DataFrame, asked: str, names: DataFrame, name: str, part_bytes: int = PART_BYTES,
                 opponents: DataFrame | None = None) -> DataFrame:
    """Best match per requested text: exact (1), ignoring case (2), contained (3), contained in an opponent's name (4).

    The first name in alphabetical order wins inside a tier.
    """
    known = names.select(name).distinct()
    want = requests.select(asked).distinct()
    exact = want.join(known, F.col(asked) == F.col(name)).withColumn("tier", F.lit(1))
    folded = want.join(known, F.lower(asked) == F.lower(name)).withColumn("tier", F.lit(2))
    part = contains_join(known, name, want, asked, part_bytes).select(asked, name).withColumn("tier", F.lit(3))
    found = exact.unionByName(folded).unionByName(part)
    if opponents is not None:
        other = contains_join(opponents.select(name).distinct(), name, want, asked, part_bytes)
        found = found.unionByName(other.select(asked, name).withColumn("tier", F.lit(4)))
    best = found.groupBy(asked).agg(F.min(F.struct("tier", name)).alias("_b")).select(asked, "_b.*")
    return requests.join(best, asked, "left")


def _edit_budget(length: Column, similarity: float) -> Column:
    return F.floor((1.0 - similarity) * length + 1e-9).cast("int")


def similar_texts(left: DataFrame, a: str, right: DataFrame, b: str, block: Sequence[str], similarity: float = 0.8, *,
                  keep: Sequence[str] = (), right_keep: Sequence[str] = (), spread: Mapping[str, Column] = MappingProxyType({}),
                  within: Column | None = None) -> DataFrame:
    """Pairs of distinct texts of the same block with edit similarity >= ``similarity``.

    Candidates come from an exact filter, not from pairing the block: the longer
    text is cut into e + 1 pieces, e being its edit budget. If two texts are
    within e edits, some piece i survives unchanged with at most i edits before
    it and e - i after it, which leaves a narrow range of places in the shorter
    text. Both sides meet in an equi-join on a hash of (block, length, piece
    number, piece); only pairs of one block within the budget leave it, so equal
    hashes of different pieces do no harm. Copies are collapsed first. Exploded sides are larger than the planner takes them for, so they are
    merged, never broadcast.

    Texts may also be told apart by the columns ``keep`` of the left and ``right_keep`` of the right side, which the
    pairs have too and the condition ``within`` may compare. A right row of several blocks names them in ``spread``,
    {block column: array}; it is spread after copies have been collapsed.
    """
    block, keep, right_keep = list(block), list(keep), list(right_keep)
    ls = left.select(*block, *keep, F.col(a).alias("_a")).distinct()
    rs = right.select(*[c for c in block if c not in spread], *right_keep, F.col(b).alias("_b")).distinct()
    for c, values in spread.items():
        rs = rs.withColumn(c, F.explode(values))
    short, long = _lengths(left, a), _lengths(right, b)
    columns = [*block, *keep, *right_keep, "_a", "_b"]
    pairs = _short_in_long(ls, "_a", rs, "_b", block, columns, similarity, short, long, within, strict=False).unionByName(
        _short_in_long(rs, "_b", ls, "_a", block, columns, similarity, long, short, within, strict=True)
    )
    scored = pairs.withColumn("similarity", edit_ratio("_a", "_b")).where(F.col("similarity") >= similarity)
    return scored.withColumnsRenamed({"_a": a, "_b": b})


def _lengths(df: DataFrame, text: str) -> list[int]:
    """Lengths that occur; at most as many as the longest text has characters."""
    return sorted(r[0] for r in df.select(F.length(text)).distinct().collect() if r[0] is not None)


def _piece(df: DataFrame) -> DataFrame:
    """Number the _e + 1 near-equal pieces of a text of length _len and give each its start and size."""
    n = F.col("_e") + 1
    base, extra = F.floor(F.col("_len") / n), F.col("_len") % n
    i = F.col("_no")
    return df.withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_e")))).withColumns({
        "_at": (i * base + F.least(i, extra) + 1).cast("int"), "_size": (base + F.when(i < extra, 1).otherwise(0)).cast("int"),
    })


def _short_in_long(shorts, s, longs, l, block, columns, similarity, short_lengths, long_lengths, within, strict) -> DataFrame:
    """Pairs within the edit budget with len(s) <= len(l) (strictly shorter when ``strict``), each once.

    Lengths, piece numbers and places are generated with plain explodes, which
    stay inside generated code. Only lengths that occur among the longer texts
    are offered, and only longer texts that some shorter length can reach.
    """
    # The longest partner: (1 - similarity) * length edits must cover the difference in length.
    most = lambda n: math.floor(n / similarity + 1e-9)
    lengths = [n for n in long_lengths if any(m + (1 if strict else 0) <= n <= most(m) for m in short_lengths)]
    other = {c: f"_other_{c}" for c in block}
    key = lambda text, at: F.xxhash64(*block, "_len", "_no", F.substr(F.col(text), at, F.col("_size"))).alias("_key")
    budget = _edit_budget(F.col("_len"), similarity)
    long_keys = _piece(longs.withColumn("_len", F.length(l)).where(F.col("_len").isin(lengths)).withColumn("_e", budget)).select(
        *[F.col(c).alias(other.get(c, c)) for c in longs.columns], key(l, F.col("_at"))
    )
    own, e, i, at, size = (F.col(c) for c in ("_own", "_e", "_no", "_at", "_size"))
    low, high = own + (1 if strict else 0), F.floor(own / similarity + 1e-9).cast("int")
    shift = own - F.col("_len")
    offered = (
        shorts.withColumn("_own", F.length(s)).withColumns({"_low": low, "_high": high}).where(F.col("_low") <= F.col("_high"))
        .withColumn("_len", F.explode(F.sequence("_low", "_high"))).where(F.col("_len").isin(lengths)).withColumn("_e", budget)
    )
    spots = _piece(offered).withColumns({
        "_first": F.greatest(F.lit(1), at - i, at + shift - (e - i)).cast("int"),
        "_last": F.least(own - size + 1, at + i, at + shift + (e - i)).cast("int"),
    }).where(F.col("_first") <= F.col("_last"))
    short_keys = spots.withColumn("_p", F.explode(F.sequence("_first", "_last"))).select(*shorts.columns, key(s, F.col("_p")))
    met = short_keys.hint("merge").join(long_keys.hint("merge"), "_key").where(reduce(lambda x, y: x & y, [F.col(c) == F.col(o) for c, o in other.items()]))
    if within is not None:
        met = met.where(within)
    ordered = F.length(s) < F.length(l) if strict else F.length(s) <= F.length(l)
    near = F.call_function("levenshtein", F.col(s), F.col(l), _edit_budget(F.length(l), similarity)) >= 0
    return met.where(ordered & near).select(*columns).distinct()


def market_event_candidates(matches: DataFrame, events: DataFrame, *, day: str, a: str, b: str, event_day: str,
                            home: str, away: str, event_id: str, slack: int = 1) -> DataFrame:
    """Events within ``slack`` days naming exactly the same two sides, in either order."""
    pair = lambda x, y: F.array_sort(F.array(F.col(x), F.col(y)))
    near = events.select(
        F.col(event_id), F.col(event_day), F.col(home), F.col(away), pair(home, away).alias("_pair"),
        F.explode(F.array(*[F.date_add(F.col(event_day), d) for d in range(-slack, slack + 1)])).alias("_day"),
    )
    return matches.withColumn("_pair", pair(a, b)).withColumn("_day", F.col(day)).hint("merge").join(near.hint("merge"), ["_pair", "_day"]).drop("_pair", "_day")


def match_market_events(matches: DataFrame, events: DataFrame, *, match_id: str, day: str, a: str, b: str, event_day: str,
                        home: str, away: str, event_id: str, slack: int = 1, threshold: float = 0.8,
                        exact_ratio: bool = False) -> DataFrame:
    """Best market event per match: same two names if any, else mean name similarity >= threshold.

    A mean of at least the threshold needs one name at the threshold, so
    candidates come from ``similar_texts`` on one name; the mean is then
    computed for both orientations. With ``exact_ratio`` the matching-block
    ratio scores the candidates, which are then drawn with the wider edit budget
    that ratio implies.
    """
    near = events.select(event_id, F.col(event_day).alias("_eday"), home, away, F.explode(F.array(home, away)).alias("_theirs"))
    mine = matches.select(match_id, a, b, F.col(day).alias("_day"), F.explode(F.array(a, b)).alias("_mine"))
    # Names meet by spans of days, twice as long as the days that an event reaches, so few events belong to two spans.
    length = 2 * (2 * slack + 1)
    span = lambda d: F.floor(F.unix_date(d) / length).cast("int")
    first, last = (span(F.date_add(F.col("_eday"), d)) for d in (-slack, slack))
    near_days = dict(keep=["_day"], right_keep=["_eday"], spread={"_span": F.sequence(first, last)},
                     within=F.abs(F.datediff("_eday", "_day")) <= slack)
    # Block ratio r bounds edits by (1 - r)(|a| + |b|) <= 2 (1 - r) * longer length.
    floor = 1 - 2 * (1 - threshold) if exact_ratio else threshold
    if floor <= 0:
        raise ValueError("a threshold this low admits every pair of names; use one above 0.5 with exact_ratio, above 0 without")
    ratio = block_ratio if exact_ratio else edit_ratio
    named = mine.withColumn("_span", span(F.col("_day")))
    names = similar_texts(named, "_mine", near, "_theirs", ["_span"], floor, **near_days).drop("_span", "similarity")
    found = (
        mine.hint("merge").join(names.hint("merge"), ["_day", "_mine"]).hint("merge").join(near.hint("merge"), ["_eday", "_theirs"])
        .select(match_id, a, b, event_id, home, away).distinct()
    )
    score = F.greatest(
        (ratio(F.col(a), F.col(home)) + ratio(F.col(b), F.col(away))) / 2,
        (ratio(F.col(a), F.col(away)) + ratio(F.col(b), F.col(home))) / 2,
    )
    same = F.array_sort(F.array(F.col(a), F.col(b))) == F.array_sort(F.array(F.col(home), F.col(away)))
    scored = found.withColumn("similarity", F.when(same, F.lit(1.0)).otherwise(score)).where(F.col("similarity") >= threshold)
    best = scored.groupBy(match_id).agg(
        F.max(F.struct(same.cast("int").alias("same"), F.col("similarity"), F.col(event_id))).alias("_b")
    )
    return best.select(match_id, F.col(f"_b.{event_id}").alias(event_id), F.col("_b.similarity").alias("similarity"))


def keep_known(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``known``."""
    return df.join(known.select(*keys), list(keys), "left_semi")
