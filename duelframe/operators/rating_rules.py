"""Update rules of the pairwise rating systems.

A rule is written once against a tiny arithmetic vocabulary and runs in two
settings: on arrays, when many matches are updated together, and on Python floats,
when each match waits for the one before.

State of an entity: ``r`` rating, ``x`` second value (deviation, defence, finish
factor), ``n`` matches so far, ``streak`` wins in a row, ``day`` day number of the
last match (NULL before the first).

Inputs of a match: ``day``, ``score`` (1 side A won, 0 lost, 0.5 even, NULL skips
the match), ``k0`` (product of everything about the match that scales K), and two
rule-specific numbers ``u`` and ``v``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np


class ArrayMath:
    """The vocabulary on arrays; a missing number is NaN."""

    where = staticmethod(np.where)
    missing = staticmethod(np.isnan)
    either = staticmethod(np.logical_or)
    both = staticmethod(np.logical_and)
    least = staticmethod(np.minimum)
    most = staticmethod(np.maximum)
    power = staticmethod(np.power)
    sqrt = staticmethod(np.sqrt)

    @staticmethod
    def lit(a):
        return a


class FloatMath:
    """The vocabulary on Python floats."""

    @staticmethod
    def where(c, a, b):
        return a if c else b

    @staticmethod
    def missing(a):
        return a is None

    @staticmethod
    def either(a, b):
        return a or b

    @staticmethod
    def both(a, b):
        return a and b

    least = staticmethod(min)
    most = staticmethod(max)
    power = staticmethod(pow)
    sqrt = staticmethod(math.sqrt)

    @staticmethod
    def lit(a):
        return a


@dataclass(frozen=True)
class Layoff:
    """What a break does to a rating when it is next used."""

    mode: str = "none"  # none, flat, hybrid, to_base, linear
    factor: float = 0.978
    floor_factor: float = 0.95
    threshold: int = 365


# Weights of the ways a match can end, per published variant.
WEIGHTS_LIVE = {"ko": 1.3, "sub": 1.6, "udec": 1.0, "sdec": 0.6, "mdec": 0.8}
WEIGHTS_TUNED = {"ko": 1.4, "sub": 1.5, "udec": 1.0, "sdec": 0.7, "mdec": 0.9}
WEIGHTS_ACCURACY = {"ko": 1.18, "sub": 2.07, "udec": 1.0, "sdec": 0.02, "mdec": 0.27}


@dataclass(frozen=True)
class RatingSpec:
    """Everything that distinguishes one rating system from another."""

    name: str
    rule: str = "elo"
    base: float = 1500.0
    base_x: float = 0.0
    k: float = 40.0
    scale: float = 220.0
    layoff: Layoff = field(default_factory=Layoff)
    weights: dict | None = None
    streak_bonus: float = 0.0
    streak_both: bool = True
    experience_gain: float = 0.0
    experience_root: bool = False
    class_modifier: bool = False
    round_bonus: bool = False
    title_factor: float = 1.0
    # rule-specific
    decay_rate: float = 2.0
    floor: float = 1200.0
    tau: float = 0.5
    mirrored: bool = True
    sequential_sides: bool = True
    pre_when_skipped: bool = False  # keep showing the held ratings on matches without inputs

    def with_(self, **changes) -> "RatingSpec":
        return replace(self, **changes)


def _registry() -> dict[str, RatingSpec]:
    flat = Layoff("flat")
    acc = RatingSpec("accuracy", layoff=flat, weights=WEIGHTS_ACCURACY, streak_bonus=0.05)
    specs = [
        RatingSpec("time_finish", layoff=flat, weights=WEIGHTS_LIVE, streak_bonus=0.15, class_modifier=True, round_bonus=True),
        RatingSpec("tuned", layoff=flat, weights=WEIGHTS_TUNED, streak_bonus=0.1, class_modifier=True, round_bonus=True,
                   experience_gain=0.01),
        acc,
        acc.with_(name="learned_decay", layoff=Layoff("flat", factor=0.975)),
        acc.with_(name="log_loss", layoff=Layoff("hybrid")),
        acc.with_(name="weight_class", class_modifier=True),
        RatingSpec("finish_factor", rule="finish", k=32.0, base_x=1.0),
        RatingSpec("mean_reverting", scale=400.0, layoff=Layoff("to_base", factor=0.9995), weights=WEIGHTS_ACCURACY,
                   streak_bonus=0.05, streak_both=False, experience_root=True, title_factor=2.0),
        RatingSpec("activity", rule="activity", scale=400.0, title_factor=1.15),
        RatingSpec("simple", rule="simple", k=32.0, scale=400.0, title_factor=1.15),
        RatingSpec("linear", k=25.0, scale=400.0),
        RatingSpec("striking", k=20.0, scale=400.0),
        RatingSpec("striking_recent", rule="recent", k=20.0, scale=400.0),
        RatingSpec("offence_defence", rule="two_sided", k=20.0, scale=400.0, base_x=1500.0,
                   pre_when_skipped=True),
        RatingSpec("grappling", k=20.0, scale=400.0),
        RatingSpec("glicko", rule="glicko", scale=400.0, base_x=350.0),
    ]
    return {s.name: s for s in specs}


RATINGS = _registry()


def _expect(m, a, b, scale):
    return 1 / (1 + m.power(10.0, (b - a) / scale))


def _rested(m, spec, s, day):
    """Rating after the break since the entity's last match."""
    lay = spec.layoff
    if lay.mode == "none":
        return s["r"]
    gap = m.where(m.missing(s["day"]), m.lit(0.0), (day - s["day"]) if m is ArrayMath else day - (s["day"] or 0))
    if lay.mode == "flat":
        return m.where(gap > lay.threshold, s["r"] * lay.factor, s["r"])
    if lay.mode == "to_base":
        return spec.base + (s["r"] - spec.base) * m.power(lay.factor, gap)
    if lay.mode == "hybrid":
        share = (m.least(gap, m.lit(2.0 * lay.threshold)) - lay.threshold) / lay.threshold
        return m.where(gap > lay.threshold, s["r"] * (lay.factor - (lay.factor - lay.floor_factor) * share), s["r"])
    raise ValueError(lay.mode)


def elo(m, spec, a, b, g):
    """Elo with optional layoff, streak and experience terms."""
    ra, rb = _rested(m, spec, a, g["day"]), _rested(m, spec, b, g["day"])
    ka = kb = spec.k * g["k0"]
    if spec.streak_bonus:
        ka = ka * (1 + spec.streak_bonus * a["streak"])
        if spec.streak_both:
            kb = kb * (1 + spec.streak_bonus * b["streak"])
    if spec.experience_gain:
        ka, kb = ka * (1 + spec.experience_gain * a["n"]), kb * (1 + spec.experience_gain * b["n"])
    if spec.experience_root:
        ka = ka / m.sqrt(m.most(m.lit(1.0), a["n"]))
        kb = kb / m.sqrt(m.most(m.lit(1.0), b["n"]))
    new_a = ra + ka * (g["score"] - _expect(m, ra, rb, spec.scale))
    new_b = rb + kb * ((1 - g["score"]) - _expect(m, rb, ra, spec.scale))
    return ra, rb, new_a, new_b, a["x"], b["x"]


def finish(m, spec, a, b, g):
    """K follows each side's finishing record: +0.05 for a finish, -0.1 when finished, else back towards 1.

    ``u`` is 1 when side A finished the match and -1 when it was finished; ``v`` likewise for side B.
    """
    def factor(x, hit):
        drift = m.where(x > 1.0, m.most(m.lit(1.0), x - 0.01), m.where(x < 1.0, m.least(m.lit(1.0), x + 0.02), m.lit(1.0)))
        return m.where(hit == 1, m.least(m.lit(1.5), x + 0.05), m.where(hit == -1, m.most(m.lit(0.7), x - 0.1), drift))

    fa, fb = factor(a["x"], g["u"]), factor(b["x"], g["v"])
    ra, rb = a["r"], b["r"]
    new_a = ra + spec.k * fa * (g["score"] - _expect(m, ra, rb, spec.scale))
    new_b = rb + spec.k * fb * ((1 - g["score"]) - _expect(m, rb, ra, spec.scale))
    return ra, rb, new_a, new_b, fa, fb


def activity(m, spec, a, b, g):
    """Inactive sides move less (down to 95 %), a winner rated over 50 points lower moves both by 10 % more."""
    def active(s):
        gap = m.where(m.missing(s["day"]), m.lit(0.0), (g["day"] - s["day"]) if m is ArrayMath else g["day"] - (s["day"] or 0))
        return m.most(1.0 - m.least(gap / 30 * spec.decay_rate, m.lit(50.0)) / 1000, m.lit(0.95))

    ra, rb = a["r"], b["r"]
    lead = m.where(g["score"] == 1, ra - rb, rb - ra)
    upset = m.where(lead < -50, m.lit(1.1), m.lit(1.0))
    k = spec.k * g["k0"] * upset
    new_a = ra + k * active(a) * (g["score"] - _expect(m, ra, rb, spec.scale))
    new_b = rb + k * active(b) * ((1 - g["score"]) - _expect(m, rb, ra, spec.scale))
    return ra, rb, new_a, new_b, a["x"], b["x"]


def simple(m, spec, a, b, g):
    """Points per month of inactivity, a floor, upset bonus and a minimum move of 16.

    When side B wins, its gain is computed from side A's expectation, as published.
    With ``mirrored`` a side stopped by the floor still moves by 16.
    """
    def rested(s):
        gap = m.where(m.missing(s["day"]), m.lit(0.0), (g["day"] - s["day"]) if m is ArrayMath else g["day"] - (s["day"] or 0))
        drop = m.least(spec.decay_rate * gap / 30, m.lit(50.0))
        return m.where(gap > 0, m.most(s["r"] - drop, m.lit(spec.floor)), s["r"])

    ra, rb = rested(a), rested(b)
    k = spec.k * g["k0"]
    ea, eb = _expect(m, ra, rb, spec.scale), _expect(m, rb, ra, spec.scale)
    won = g["score"] == 1
    gain = k * (1 - ea)
    upset = m.where(won, ea < 0.5, ea > 0.5)
    gain = m.most(m.where(upset, gain * 1.1, gain), m.lit(16.0))
    loss = m.most(k * eb, m.lit(16.0))
    new_a = m.most(m.where(won, ra + gain, ra - loss), m.lit(spec.floor))
    new_b = m.most(m.where(won, rb - loss, rb + gain), m.lit(spec.floor))
    if spec.mirrored:
        new_a = m.where(won, m.where(new_a <= ra, ra + 16, new_a), m.where(new_a >= ra, ra - 16, new_a))
        new_b = m.where(won, m.where(new_b >= rb, rb - 16, new_b), m.where(new_b <= rb, rb + 16, new_b))
    return ra, rb, new_a, new_b, a["x"], b["x"]


def recent(m, spec, a, b, g):
    """Score discounted by age (``k0`` = exp(-days/1000)); the opponent's strength scales both margins ``u`` and ``v``."""
    ra, rb = a["r"], b["r"]
    strength = 1 + (rb - 1500.0) / 1000.0
    fa, fb = g["u"] * strength, g["v"] * strength
    even = m.where(fa == fb, m.lit(0.5), m.where(fa > fb, m.lit(1.0), m.lit(0.0)))
    ea = _expect(m, ra, rb, spec.scale)
    new_a = ra + spec.k * (g["k0"] * even - ea)
    new_b = rb + spec.k * (g["k0"] * (1 - even) - (1 - ea))
    return ra, rb, new_a, new_b, a["x"], b["x"]


def two_sided(m, spec, a, b, g):
    """Offence ``r`` and defence ``x``: ``u`` is A's success share against B, ``v`` is B's against A."""
    oa, da, ob, db = a["r"], a["x"], b["r"], b["x"]
    s = spec.scale
    new_oa = oa + spec.k * (g["u"] - _expect(m, oa, db, s))
    new_da = da + spec.k * ((1 - g["v"]) - _expect(m, da, ob, s))
    new_ob = ob + spec.k * (g["v"] - _expect(m, ob, da, s))
    new_db = db + spec.k * ((1 - g["u"]) - _expect(m, db, oa, s))
    return oa, ob, new_oa, new_ob, new_da, new_db


def glicko(m, spec, a, b, g):
    """Rating and deviation. With ``sequential_sides`` side B is updated against A's new rating."""
    def widened(s):
        gap = m.where(m.missing(s["day"]), m.lit(0.0), (g["day"] - s["day"]) if m is ArrayMath else g["day"] - (s["day"] or 0))
        return m.least(m.sqrt(s["x"] * s["x"] + spec.tau * spec.tau * gap), m.lit(350.0))

    def move(r, opp, rd_opp, rd_stored, res):
        gg = 1 / m.sqrt(1 + 3 * rd_opp * rd_opp / (math.pi**2 * 400.0**2))
        e = 1 / (1 + m.power(10.0, -gg * (r - opp) / 400.0))
        v = 1 / (gg * gg * e * (1 - e))
        new_rd = m.most(m.lit(30.0), 1 / m.sqrt(1 / (rd_stored * rd_stored) + 1 / v))
        return r + v * gg * (res - e), new_rd

    ra, rb = a["r"], b["r"]
    wa, wb = widened(a), widened(b)
    new_a, rd_a = move(ra, rb, wb, a["x"], g["score"])
    new_b, rd_b = move(rb, new_a if spec.sequential_sides else ra, wa, b["x"], 1 - g["score"])
    return ra, rb, new_a, new_b, rd_a, rd_b


def touch(m, spec, a, b, g):
    """1 for both sides from a marked match (``u`` = 1) on, and for whoever meets them from then on."""
    on = m.most(m.most(a["r"], b["r"]), g["u"])
    return a["r"], b["r"], on, on, a["x"], b["x"]


TOUCHED = RatingSpec("touched", rule="touch", base=0.0)  # no rating system: which matches follow from marked ones

RULES: dict[str, Callable] = {
    "elo": elo, "finish": finish, "activity": activity, "simple": simple,
    "recent": recent, "two_sided": two_sided, "glicko": glicko, "touch": touch,
}
