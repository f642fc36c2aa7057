"""Path-dependent pairwise ratings over a table of matches.

A rating after match i depends on the ratings before it, so matches of one
entity must be handled in order. Two exact ways:

``fold``   Matches of one league, or of one connected component of a league, are
           sorted and streamed through one task that keeps only the entities'
           current states, never the matches. Used only where every such group is
           proven to hold at most ``max_group_rows`` matches.
``blocks`` Leagues too large for that are cut by time into blocks of as many
           matches. Within a block, entities fall into clusters that do not meet;
           every cluster is folded in a task of its own, all leagues at once, and
           states pass from an entity's block to the next block it plays in. The
           number of jobs grows with the blocks and not with the longest chain.

Inside a task, matches of one batch that do not wait for each other are updated
together as arrays; where nearly every match waits for the one before, one by one.

A chain of matches through one entity has no parallel form in any exact rating
of this kind: its length is a lower bound on the sequential work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from duelframe.functions import ratings as rf
from duelframe.operators.rating_rules import RATINGS, RULES, ArrayMath, FloatMath, RatingSpec
from duelframe.operators.sequence import first_difference, numbered, rolling_sums
from duelframe.plans.sizing import Folder, cut, fits_broadcast, oversized_groups
from duelframe.session import max_group_rows

INPUTS = ["day", "score", "k0", "u", "v"]
STATE = ["r", "x", "n", "streak", "day"]
OUT = ["pre", "opp_pre", "post", "opp_post", "pre_x", "opp_pre_x", "post_x", "opp_post_x"]


# ---------------------------------------------------------------- inputs

def rating_inputs(matches: DataFrame, spec: RatingSpec | str, *, match_id="match_id", league="league", ts="ts", a="a",
                  b="b", score="score", symmetric_method=False, legacy_rounds=False, promotion: str | None = None) -> DataFrame:
    """The narrow table the engine runs on: ids, day number, score and the static part of K.

    Uses whichever of these columns the spec asks for: outcome flags, ``round``,
    ``time_format``, ``natural_class``/``opp_natural_class``/``fought_class``,
    ``label`` or ``title_fight``, ``u`` and ``v``.
    """
    spec = RATINGS[spec] if isinstance(spec, str) else spec
    have = set(matches.columns)
    k0 = F.lit(1.0) if "k0" not in have else F.col("k0").cast("double")
    if spec.weights:
        k0 = k0 * rf.method_weight(spec.weights, symmetric_method)
    if spec.round_bonus:
        k0 = k0 * rf.first_round_bonus("round") * rf.round_modifier("round", "time_format", legacy_rounds)
    if spec.class_modifier:
        k0 = k0 * rf.weight_modifier("natural_class", "opp_natural_class", "fought_class")
    if spec.title_factor != 1.0:
        title = F.col("title_fight") == 1 if "title_fight" in have else rf.title_text("label", spec.rule == "simple", promotion)
        k0 = k0 * F.when(title, F.lit(spec.title_factor)).otherwise(F.lit(1.0))
    number = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    return matches.select(
        F.col(league).alias("league"), F.col(match_id).alias("match_id"), F.col(ts).cast("date").alias("ts"),
        F.col(a).alias("a"), F.col(b).alias("b"),
        F.unix_date(F.col(ts).cast("date")).cast("double").alias("day"),
        F.col(score).cast("double").alias("score"), k0.alias("k0"), number("u").alias("u"), number("v").alias("v"),
    )


def strike_inputs(df: DataFrame, landed="landed", absorbed="absorbed", prefix="opp_") -> DataFrame:
    """Score 1, 0.5 or 0 by landed minus absorbed of either side; NULL inputs leave the score NULL."""
    mine, theirs = F.col(landed) - F.col(absorbed), F.col(prefix + landed) - F.col(prefix + absorbed)
    return df.withColumn("score", _by_margin(mine, theirs))


def recent_strike_inputs(df: DataFrame, as_of, ts="ts", landed="landed", absorbed="absorbed", prefix="opp_") -> DataFrame:
    """Margins of both sides and the age discount relative to ``as_of``."""
    mine, theirs = F.col(landed) - F.col(absorbed), F.col(prefix + landed) - F.col(prefix + absorbed)
    age = F.datediff(F.lit(as_of).cast("date"), F.col(ts).cast("date"))
    return df.withColumns({"u": mine.cast("double"), "v": theirs.cast("double"),
                           "score": _by_margin(mine, theirs), "k0": F.exp(-age / F.lit(1000.0))})


def two_sided_inputs(df: DataFrame, landed="landed", attempts="attempts", prefix="opp_") -> DataFrame:
    """Success shares of both sides; a missing or zero attempt count skips the match."""
    u = F.try_divide(F.col(landed).cast("double"), F.col(attempts).cast("double"))
    v = F.try_divide(F.col(prefix + landed).cast("double"), F.col(prefix + attempts).cast("double"))
    return df.withColumns({"u": u, "v": v}).withColumn("score", F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.lit(1.0)))


def grapple_inputs(df: DataFrame, td="tdavg", sub="subavg", defence="tddef", prefix="opp_") -> DataFrame:
    total = lambda p: F.col(p + td) + F.col(p + sub) + F.col(p + defence) / 100
    return df.withColumn("score", _by_margin(total(""), total(prefix)))


def finish_inputs(df: DataFrame, score="score", both_sides: bool = False) -> DataFrame:
    """u and v: +1 the side finished the match, -1 it was finished, 0 otherwise.

    The flags belong to side A, and the published rule reads them unswapped for
    side B, whose factor therefore only drifts; ``both_sides`` swaps them.
    """
    won = F.col(score) == 1
    finished = (F.col("ko") == 1) | (F.col("subw") == 1)
    beaten = (F.col("kod") == 1) | (F.col("subwd") == 1)
    u = F.when(won & finished, 1.0).when(~won & beaten, -1.0).otherwise(0.0)
    return df.withColumns({"u": u, "v": -u if both_sides else F.lit(0.0)})


def _by_margin(mine, theirs):
    return F.when(mine == theirs, 0.5).when(mine > theirs, 1.0).when(mine < theirs, 0.0)


# ---------------------------------------------------------------- engine

def rate(inputs: DataFrame, spec: RatingSpec | str, *, state: DataFrame | None = None, mode: str = "auto", limit: int | None = None,
         parts: DataFrame | None = None) -> DataFrame:
    """Ratings of both sides before and after every match.

    ``inputs`` comes from ``rating_inputs``. ``state`` (see ``current_state``)
    continues from earlier matches. ``limit`` is the number of matches that one
    task may fold, by default the session's ``max_group_rows``. ``parts`` holds
    the ``components`` of a table that has all these matches, where they are known.
    """
    limit = limit or max_group_rows(inputs.sparkSession)
    spec = RATINGS[spec] if isinstance(spec, str) else spec
    if mode == "auto":
        # Sized first and rated after: materialised so that the matches are built once.
        inputs = cut(inputs)
        mode = "fold" if largest_group(inputs, ["league"]) <= limit else "components"
    if mode == "fold":
        return fold(inputs, spec, ["league"], state)
    if mode == "components":
        parts = components(inputs) if parts is None else parts
        grouped = cut(inputs.join(parts.withColumnRenamed("entity", "a"), ["league", "a"]))
        if largest_group(grouped, ["league", "component"]) <= limit:
            return fold(grouped, spec, ["league", "component"], None if state is None else state.join(parts, ["league", "entity"]))
        mode = "blocks"
    if mode == "blocks":
        return blocks(inputs, spec, state, limit)
    raise ValueError(mode)


def largest_group(matches: DataFrame, keys: Sequence[str]) -> int:
    """Matches of the largest group; only this count travels to the driver."""
    return matches.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _result_schema(inputs: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in inputs.schema.fields}
    ids = ", ".join(f"{c} {kinds[c]}" for c in ("league", "match_id", "ts", "a", "b"))
    return ids + ", score double, day double, " + ", ".join(f"{c} double" for c in OUT)


def fold(matches: DataFrame, spec: RatingSpec, groups: Sequence[str], state: DataFrame | None = None) -> DataFrame:
    """Stream every group in time order through one task holding current states only.

    ``state`` has the groups, the entity and its stored state. Its rows travel with the matches and come first in their
    group, the five values of a state in the place of the five inputs of a match.
    """
    groups = list(groups)
    ids = ["league", "match_id", "ts", "a", "b"]
    extra = [g for g in groups if g not in ids]
    columns = [*extra, *ids, *INPUTS]
    n_extra, keyed = len(extra), [columns.index(g) for g in groups]
    rows = matches.select(*columns, F.lit(1).alias("_kind"))
    if state is not None:
        kinds = {f.name: f.dataType for f in matches.schema.fields}
        known = dict(zip(["score", "k0", "u", "v", "day"], STATE)) | {"a": "entity"} | {g: g for g in groups}
        stored = [F.col(known[c]).cast(kinds[c]).alias(c) if c in known else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
        held = state.where(" AND ".join(f"{c} IS NOT NULL" for c in ("entity", "r", *groups)))
        rows = rows.unionByName(held.select(*stored, F.lit(0).alias("_kind")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = _States(spec)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = states.open([batch.column(i) for i in keyed], batch.column(n_extra + 3), batch.column(n_extra + 4))
            played = batch.column(batch.num_columns - 1).to_numpy() == 1
            if not played.all():
                stored = batch.filter(pa.array(~played))
                values = [stored.column(n_extra + 5 + INPUTS.index(c)) for c in ("score", "k0", "u", "v", "day")]
                states.now[:, a[~played]] = [_floats(x) for x in values]
                batch, a, b = batch.filter(pa.array(played)), a[played], b[played]
            if batch.num_rows:
                game = [batch.column(n_extra + 5 + i) for i in range(len(INPUTS))]
                levels = _levels(a.tolist(), b.tolist())
                together = len(levels) >= WIDE * (max(levels) + 1)
                made = (_by_level if together else _one_by_one)(spec, states.now, a, b, game, levels)
                arrays = [batch.column(n_extra + i) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*arrays, game[1], game[0], *made], names=[*ids, "score", "day", *OUT])
            states.close()

    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, "_kind", "ts", "match_id")
    return ordered.mapInArrow(run, _result_schema(matches))


WIDE = 8  # matches a level from which array updates pay


def _floats(column: pa.Array) -> np.ndarray:
    """Numbers as floats, NaN for NULL."""
    return column.to_numpy(zero_copy_only=False).astype(float)


class _States:
    """Current states in one task. ``now`` holds a column for every entity of the batch at hand; between two batches only the
    states of the last group are kept, since a sorted partition is done with the others."""

    def __init__(self, spec: RatingSpec):
        self.blank = np.array([[spec.base], [spec.base_x], [0.0], [0.0], [np.nan]])
        self.group, self.slots, self.kept = None, {}, np.empty((len(STATE), 0))

    def open(self, groups: list[pa.Array], a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The columns in ``now`` of both sides of every row."""
        n = len(a)
        entities = pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode")
        number, total = entities.indices.to_numpy().astype(np.int64), len(entities.dictionary)
        new = np.zeros(n, bool)
        for g in groups:
            code = g.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        run = np.cumsum(new)
        keys, at = np.unique(np.concatenate([run, run]) * total + number, return_inverse=True)
        self.now = np.repeat(self.blank, len(keys), axis=1)
        names = entities.dictionary.to_pylist()
        first, last = (tuple(g[i].as_py() for g in groups) for i in (0, n - 1))
        if first == self.group:
            here = int(np.searchsorted(keys, total))  # the keys of the first group, in the order of their numbers
            slot = np.array([self.slots.get(names[i], -1) for i in keys[:here].tolist()], dtype=np.int64)
            known = np.flatnonzero(slot >= 0)
            self.now[:, known] = self.kept[:, slot[known]]
        if first != self.group or run[-1]:
            self.group, self.slots, self.kept = last, {}, np.empty((len(STATE), 0))
        tail = int(np.searchsorted(keys, run[-1] * total))
        self.tail, self.names = tail, [names[i] for i in (keys[tail:] - run[-1] * total).tolist()]
        return at[:n], at[n:]

    def close(self) -> None:
        """Keep the states of the last group."""
        slots = self.slots
        put = np.array([slots.setdefault(name, len(slots)) for name in self.names], dtype=np.int64)
        if len(slots) > self.kept.shape[1]:
            self.kept = np.concatenate([self.kept, np.empty((len(STATE), 2 * len(slots) - self.kept.shape[1]))], axis=1)
        self.kept[:, put] = self.now[:, self.tail :]


def _levels(a: list[int], b: list[int]) -> list[int]:
    """For every match, how many matches of the batch it has to wait for, one after the other."""
    seen = [0] * (max(max(a), max(b)) + 1)
    out = []
    for x, y in zip(a, b):
        level = seen[x] if seen[x] > seen[y] else seen[y]
        seen[x] = seen[y] = level + 1
        out.append(level)
    return out


def _one_by_one(spec: RatingSpec, now: np.ndarray, a: np.ndarray, b: np.ndarray, game: list[pa.Array], levels: list[int]) -> list[pa.Array]:
    step, keep_pre = RULES[spec.rule], spec.pre_when_skipped
    results = []
    states = [(*rest, None if day != day else day) for *rest, day in now.T.tolist()]
    for i, j, day, score, k0, u, v in zip(a.tolist(), b.tolist(), *(column.to_pylist() for column in game)):
        sa, sb = dict(zip(STATE, states[i])), dict(zip(STATE, states[j]))
        if score is None:
            held = (sa["r"], sb["r"], None, None, sa["x"], sb["x"]) if keep_pre else (None,) * 6
            results.append((*held, None, None))
            continue
        pre_a, pre_b, ra, rb, xa, xb = step(FloatMath, spec, sa, sb, {"day": day, "score": score, "k0": k0, "u": u, "v": v})
        results.append((pre_a, pre_b, ra, rb, sa["x"], sb["x"], xa, xb))
        won = score == 1
        states[i] = (ra, xa, sa["n"] + 1, sa["streak"] + 1 if won else 0.0, day)
        states[j] = (rb, xb, sb["n"] + 1, 0.0 if won else sb["streak"] + 1, day)
    now[:] = np.array([[np.nan if v is None else v for v in held] for held in states], dtype=float).T
    return [pa.array(x, pa.float64()) for x in zip(*results)]


def _by_level(spec: RatingSpec, now: np.ndarray, a: np.ndarray, b: np.ndarray, game: list[pa.Array], levels: list[int]) -> list[pa.Array]:
    """The same updates with all matches of a level at once; no side plays twice in a level."""
    level = np.array(levels)
    order = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[order], np.arange(level.max() + 2)).tolist()
    a, b = a[order], b[order]
    inputs = np.array([_floats(column) for column in game])[:, order]
    rated = game[1].is_valid().to_numpy(zero_copy_only=False)[order]
    every, rule = rated.all(), RULES[spec.rule]
    made = np.full((len(OUT), len(a)), np.nan)
    with np.errstate(all="ignore"):
        for x, y in zip(edges, edges[1:]):
            ia, ib, g = a[x:y], b[x:y], dict(zip(INPUTS, inputs[:, x:y]))
            held_a, held_b = now[:, ia], now[:, ib]
            sa, sb = dict(zip(STATE, held_a)), dict(zip(STATE, held_b))
            out = made[:, x:y]
            out[0], out[1], out[2], out[3], out[6], out[7] = rule(ArrayMath, spec, sa, sb, g)
            out[4], out[5] = sa["x"], sb["x"]
            won = g["score"] == 1
            next_a = np.array([out[2], out[6], sa["n"] + 1, np.where(won, sa["streak"] + 1, 0.0), g["day"]])
            next_b = np.array([out[3], out[7], sb["n"] + 1, np.where(won, 0.0, sb["streak"] + 1), g["day"]])
            if every:
                now[:, ia] = next_a
                now[:, ib] = next_b
                continue
            go = rated[x:y]
            now[:, ia[go]] = next_a[:, go]
            now[:, ib[go]] = next_b[:, go]
            if spec.pre_when_skipped:
                out[0], out[1] = np.where(go, out[0], sa["r"]), np.where(go, out[1], sb["r"])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    blind = ~rated
    kept = blind & (not spec.pre_when_skipped)
    hide = [kept, kept, blind, blind, kept, kept, blind, blind]
    return [pa.array(row[back], pa.float64(), mask=None if every else m[back]) for row, m in zip(made, hide)]


def blocks(inputs: DataFrame, spec: RatingSpec, state: DataFrame | None, limit: int) -> DataFrame:
    """Blocks of at most ``limit`` matches a league in time order, folded cluster by cluster, one block after the other.

    A block's matches, the states that wait for it, and its results are folders of their own, so a block reads and
    writes in proportion to itself.
    """
    spark = inputs.sparkSession
    store = Folder(spark, "ratings")
    order = numbered(inputs, ["league"], ["ts", "match_id"], "_n", limit=limit)
    placed = cut(order.withColumn("block", F.floor((F.col("_n") - 1) / limit).cast("int")).drop("_n"))
    seats = components(placed, ["league", "block"])
    matches = placed.join(seats.withColumnRenamed("entity", "a"), ["league", "block", "a"]).repartitionByRange("block", "league", "component")
    store.write(matches, "matches", "block")
    ahead = F.lead("block").over(Window.partitionBy("league", "entity").orderBy("block"))  # a row a block, so short
    store.write(seats.withColumn("next", ahead).repartitionByRange("block", "league", "entity"), "seats", "block")
    waiting = "league {league}, entity {entity}, ".format(league=inputs.schema["league"].dataType.simpleString(), entity=inputs.schema["a"].dataType.simpleString())
    waiting += ", ".join(f"{c} double" for c in STATE)
    if state is not None:
        first = seats.groupBy("league", "entity").agg(F.min("block").alias("next"))
        store.write(state.select("league", "entity", *[F.col(c).cast("double").alias(c) for c in STATE]).join(first, ["league", "entity"]), "states", "next")
    for k in store.values("matches"):
        states = store.read(f"states/next={k}", waiting)
        rows = store.read(f"matches/block={k}", matches.drop("block").schema)
        here = store.read(f"seats/block={k}", seats.drop("block").withColumn("next", F.lit(0)).schema)
        store.write(fold(rows, spec, ["league", "component"], states.join(here.drop("next"), ["league", "entity"])), f"rated/block={k}")
        after = current_state(store.read(f"rated/block={k}", _result_schema(inputs)), states)
        onward = here.where("next IS NOT NULL").drop("component")
        store.write(after.join(onward, ["league", "entity"]).repartition("next"), "states", "next")
    return store.read("rated", _result_schema(inputs) + ", block int").drop("block")


def components(matches: DataFrame, keys: Sequence[str] = ("league",)) -> DataFrame:
    """Connected component of every entity among the matches of each key, named by its smallest entity.

    Every entity follows its smallest opponent, chains are shortened until they end at a root, and only meetings of
    different roots are left for the next turn: all matches are read in the first turn, few meetings in the others.
    """
    keys = list(keys)
    meetings = matches.select(*keys, "a", "b")
    labels = cut(meetings.select(*keys, F.explode(F.array("a", "b")).alias("entity")).distinct().withColumn("component", F.col("entity")))
    edges = meetings.dropna().where("a <> b")
    while True:
        way = lambda x, y: F.struct(F.col(x).alias("entity"), F.col(y).alias("_near"))
        near = edges.select(*keys, F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_w")).select(*keys, "_w.*")
        hop = cut(near.groupBy(*keys, "entity").agg(F.min("_near").alias("_near")).select(*keys, "entity", F.least("entity", "_near").alias("root")))
        if not hop.limit(1).count():
            return labels
        while True:
            up = hop.select(*keys, F.col("entity").alias("root"), F.col("root").alias("_far"))
            nxt = cut(hop.join(up, [*keys, "root"]).select(*keys, "entity", F.col("root").alias("_old"), F.col("_far").alias("root")))
            moved = nxt.where("_old <> root").limit(1).count()
            hop = nxt.drop("_old")
            if not moved:
                break
        to = lambda x, new: hop.select(*keys, F.col("entity").alias(x), F.col("root").alias(new))
        labels = cut(labels.join(to("component", "_root"), [*keys, "component"], "left").select(
            *keys, "entity", F.coalesce("_root", "component").alias("component")
        ))
        met = edges.join(to("a", "_a"), [*keys, "a"]).join(to("b", "_b"), [*keys, "b"]).where("_a <> _b")
        edges = cut(met.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())


# ---------------------------------------------------------------- reading ratings

def by_entity(rated: DataFrame) -> DataFrame:
    """One row per match and side with that side's ratings."""
    def side(me, opp, pre, post, won):
        return F.struct(
            F.col(me).alias("entity"), F.col(opp).alias("opp_entity"), F.col(pre).alias("pre"), F.col(post).alias("post"),
            F.col(f"{pre}_x").alias("pre_x"), F.col(f"{post}_x").alias("post_x"), won.alias("score"),
        )

    return rated.select("league", "match_id", "ts", F.explode(F.array(
        side("a", "b", "pre", "post", F.col("score")), side("b", "a", "opp_pre", "opp_post", 1 - F.col("score")),
    )).alias("_s")).select("league", "match_id", "ts", "_s.*")


def current_state(rated: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Rating state of every entity after its last match, ready to continue from."""
    # A draw ends side A's streak and extends side B's, as in the update rules.
    sides = rated.where(F.col("post").isNotNull()).select("league", "match_id", "ts", "day", F.explode(F.array(
        F.struct(F.col("a").alias("entity"), F.col("post").alias("r"), F.col("post_x").alias("x"), (F.col("score") == 1).alias("up")),
        F.struct(F.col("b").alias("entity"), F.col("opp_post").alias("r"), F.col("opp_post_x").alias("x"), (F.col("score") != 1).alias("up")),
    )).alias("_s")).select("league", "match_id", "ts", "day", "_s.*")
    at = F.struct("ts", "match_id")
    down_at = sides.groupBy("league", "entity").agg(
        F.max_by(F.struct("r", "x", "day"), at).alias("_last"),
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.max(F.when(~F.col("up"), at)).alias("_down"),
    )
    since = sides.join(down_at.select("league", "entity", "_down"), ["league", "entity"])
    run = since.where(F.col("_down").isNull() | (at > F.col("_down"))).groupBy("league", "entity").agg(
        F.count(F.lit(1)).cast("double").alias("_run")
    )
    now = down_at.join(run, ["league", "entity"], "left").select(
        "league", "entity", F.col("_last.r").alias("r"), F.col("_last.x").alias("x"), F.col("_n").alias("n"),
        F.coalesce("_run", F.lit(0.0)).alias("streak"), F.col("_last.day").alias("day"), F.col("_down").isNull().alias("_whole"),
    )
    if previous is None:
        return now.drop("_whole")
    old = previous.select("league", "entity", *[F.col(c).cast("double").alias(f"_o_{c}") for c in STATE])
    merged = old.join(now, ["league", "entity"], "full")
    fresh = F.col("r").isNotNull()
    return merged.select(
        "league", "entity",
        F.coalesce("r", "_o_r").alias("r"), F.coalesce("x", "_o_x").alias("x"),
        (F.coalesce("n", F.lit(0.0)) + F.coalesce("_o_n", F.lit(0.0))).alias("n"),
        F.when(~fresh, F.col("_o_streak")).when(F.col("_whole"), F.col("streak") + F.coalesce("_o_streak", F.lit(0.0)))
        .otherwise(F.col("streak")).alias("streak"),
        F.coalesce("day", "_o_day").alias("day"),
    )


def top_rated(state: DataFrame, n: int = 10, column: str = "r") -> DataFrame:
    return state.orderBy(F.col(column).desc(), F.col("league"), F.col("entity")).limit(n)


def rating_history(rated: DataFrame, entities: DataFrame, key: str = "entity") -> DataFrame:
    """Ratings over time of the listed entities."""
    wanted = entities.select(key).distinct()
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    return by_entity(rated).join(side.withColumnRenamed(key, "entity"), "entity", "left_semi")


def rating_features(rated: DataFrame, **kw) -> DataFrame:
    """Per entity and match: rating change, difference to the previous match and its rolling sums.

    The rated rows are materialised and the groups counted once for the three scans.
    """
    keys, order = ["league", "entity"], ["ts", "match_id"]
    rows = cut(by_entity(rated).withColumn("change", F.col("post") - F.col("pre")))
    kw.setdefault("hot", oversized_groups(rows, keys, kw.get("limit")))
    rows = first_difference(rows, keys, order, "pre", "pre_prev", **kw)
    rows = rolling_sums(rows, keys, order, "pre_prev", **kw)
    return rolling_sums(rows, keys, order, "change", pattern="post_change_{n}", **kw)


def update_with_late_results(late: DataFrame, spec: RatingSpec | str, state: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Rate late matches on top of stored ratings: (rated matches, new state)."""
    rated = cut(rate(late, spec, state=state, **kw))
    return rated, current_state(rated, state)
