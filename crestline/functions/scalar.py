"""Scalar column expressions; every function takes and returns Spark columns."""
from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions admitted by the scan.
EXTENSIONS = ("wav", "mp3", "flac", "aif", "aiff", "m4a", "ogg")

# Title words that mark spoken material.
SPEECH_WORDS = (
    "speech", "访谈", "对白", "lecture", "名言", "podcast", "播客",
    "interview", "对话", "口播", "独白", "talk", "voice", "vocal",
)

# Duration bands in seconds and their categories.
DURATION_BANDS = ((3, "one_shots"), (20, "loops"), (60, "fx"))

# Token pattern of a tag.
TAG_PATTERN = "[A-Za-z0-9一-鿿]+"

# Source words and their weights.
SOURCE_WORDS = {
    "78rpm": 0.5, "breakbeat": 0.5, "vinyl": 0.4, "78": 0.4,
    "funk": 0.3, "soul": 0.3, "jazz": 0.3, "disco": 0.3, "boogie": 0.3,
    "motown": 0.3, "stax": 0.3, "r&b": 0.3, "rnb": 0.3, "hip-hop": 0.2,
    "hiphop": 0.2, "rare": 0.2, "old": 0.2, "vintage": 0.2, "tape": 0.2,
    "groove": 0.2, "latin": 0.2, "afro": 0.2, "fusion": 0.2, "break": 0.3,
    "drum": 0.15, "percussion": 0.15, "kit": 0.15, "loop": 0.1,
}

# Words of primary and supporting types.
PRIMARY_WORDS = ("melod", "vocal", "bass", "hook", "solo")
SUPPORTING_WORDS = ("texture", "transition", "drum break", "drum_break", "fx")

# Semitone of each note letter.
NOTE_SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}

# Time base.
STEPS_PER_BAR = 16
BEATS_PER_BAR = 4
TICKS_PER_BEAT = 96


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_to(value: Column, digits: int) -> Column:
    """Round half up with a tolerance far above float noise, so that the order in which
    partial sums were merged cannot move a tie to the other side."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5000001) / scale


# --- catalog attributes ------------------------------------------------------------------

def category(duration: Column, title: Column, words=SPEECH_WORDS) -> Column:
    """Title words first, then duration bands; an unknown duration has its own category."""
    lowered = F.lower(title)
    spoken = reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])
    banded = F.when(F.coalesce(spoken, F.lit(False)), "speech").when(duration.isNull(), "unknown")
    for limit, name in DURATION_BANDS:
        banded = banded.when(duration < limit, name)
    return banded.otherwise("songs")


def tags(name: Column, category_: Column, cap: int = 20) -> Column:
    """Distinct lower-case tokens in order of appearance, then the category, at most ``cap``."""
    tokens = F.transform(F.regexp_extract_all(name, F.lit(f"({TAG_PATTERN})"), 1), F.lower)
    long_enough = F.filter(tokens, lambda t: F.length(t) >= 2)
    return F.slice(F.array_distinct(F.concat(long_enough, F.array(category_))), 1, cap)


def source_weight(text: Column, words: dict[str, float] = SOURCE_WORDS) -> Column:
    """Sum of the weights of all words contained in the text, at most 1."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(lowered.contains(w), F.lit(float(v))).otherwise(F.lit(0.0)) for w, v in words.items()]
    return round_to(clamp(reduce(add, hits), 0.0, 1.0), 4)


def type_matches(type_: Column, words) -> Column:
    """True when the type, with underscores read as blanks, contains one of the words."""
    plain = F.regexp_replace(F.lower(type_), "_", " ")
    return plain.rlike("|".join(words))


# --- keys --------------------------------------------------------------------------------

def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` plus 16 hex digits of the sha256 of the parts written as a JSON array."""
    payload = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(payload, 256), F.lit(16)))


def moment_key(asset: Column, type_: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%s:%07.3f-%07.3f", asset, type_, start, end)


def seed(key: Column) -> Column:
    """First 8 hex digits of the key's sha256 as an unsigned 32-bit number."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long")


def hash_pick(key: Column, n: int | Column) -> Column:
    """Repeatable choice in ``0..n-1``: the same key always gives the same number."""
    return F.pmod(seed(key), F.lit(n) if isinstance(n, int) else n)


def hash_unit(key: Column) -> Column:
    """Repeatable number in 0..1 (1 excluded)."""
    return seed(key) / float(2 ** 32)


def hash_sample(key: Column, items: Column, k: int) -> Column:
    """``k`` different items of an array, picked without replacement by the hash of key and item."""
    drawn = F.transform(items, lambda x: F.struct(seed(F.concat_ws(":", key, x.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.sort_array(drawn), 1, k), lambda d: d["x"])


def jitter_ms(key: Column) -> Column:
    """Repeatable shift of 2 to 8 ms in either direction."""
    side = F.when(hash_pick(F.concat(key, F.lit(":side")), 2) == 0, -1.0).otherwise(1.0)
    return round_to((2.0 + 6.0 * hash_unit(F.concat(key, F.lit(":ms")))) * side, 2)


def jitter_velocity(key: Column, base: Column) -> Column:
    """Repeatable change by 5 to 15 in either direction, within 1..127."""
    side = F.when(hash_pick(F.concat(key, F.lit(":up")), 2) == 0, -1).otherwise(1)
    moved = base + side * (5 + hash_pick(F.concat(key, F.lit(":velocity")), 11))
    return F.greatest(F.lit(1), F.least(F.lit(127), moved)).cast("int")


# --- levels ------------------------------------------------------------------------------

def decibels(rms: Column) -> Column:
    return 20.0 * F.log10(rms + 1e-9)


def gain_hint(peak: Column, target_db: float = -6.0) -> Column:
    """Gain in dB that brings the peak to the target, within 30 dB; 0 for silence."""
    return F.when(peak > 1e-6, round_to(clamp(target_db - 20.0 * F.log10(peak), -30.0, 30.0), 1)).otherwise(F.lit(0.0))


def stretch_ratio(target: Column, source: Column) -> Column:
    """Target over source tempo; 1 when unknown or within half a beat per minute."""
    far = (source != 0) & (F.abs(target - source) > 0.5)
    return F.when(far, round_to(F.try_divide(target, source), 4)).otherwise(F.lit(1.0))


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Equal-power left and right gains of a pan position in -1..1."""
    angle = (pan + 1.0) * (math.pi / 4.0)
    return F.cos(angle), F.sin(angle)


def fade_out(position: Column, length: Column, depth: float = 0.35) -> Column:
    return 1.0 - depth * position / length


def edge_ramp(position: Column, length: Column, ramp: int) -> Column:
    """Linear fade-in and fade-out weight of row ``position`` (0-based) among ``length`` rows."""
    n = F.greatest(F.lit(1), F.least(F.lit(ramp), F.floor(length / 2)))
    step = F.greatest(n - 1, F.lit(1))
    up = F.when(n == 1, F.lit(0.0)).otherwise(position / step)
    down = F.when(n == 1, F.lit(0.0)).otherwise((length - 1 - position) / step)
    return F.least(F.lit(1.0), up, down).cast("double")


# --- time base ---------------------------------------------------------------------------

def beat_at(bar: Column, step: Column, offset_ms: Column, bpm: Column) -> Column:
    return round_to(bar * float(BEATS_PER_BAR) + step / 4.0 + offset_ms * bpm / 60000.0, 6)


def beats_of(seconds: Column, bpm: Column) -> Column:
    return round_to(seconds * bpm / 60.0, 6)


def frame_at(seconds: Column, rate: int, total: Column) -> Column:
    """Frame index of a time, inside the known length (0 means unknown length)."""
    frame = F.floor(seconds * rate + 0.5)
    return F.when(total > 0, F.least(total, frame)).otherwise(frame)


def ticks_of(ms: Column, bpm: Column) -> Column:
    return F.floor(ms * bpm * TICKS_PER_BEAT / 60000.0 + 0.5)


def note_number(text: Column) -> Column:
    """``A1`` -> 33, ``C#2`` -> 37, digits 0..127 as they are, anything else NULL."""
    plain = F.trim(text)
    as_number = plain.try_cast("int")
    letter = F.upper(F.regexp_extract(plain, "^([A-Ga-g])([#b]?)(-?[0-9])$", 1))
    sign = F.regexp_extract(plain, "^([A-Ga-g])([#b]?)(-?[0-9])$", 2)
    octave = F.regexp_extract(plain, "^([A-Ga-g])([#b]?)(-?[0-9])$", 3).try_cast("int")
    pairs = [F.lit(x) for item in NOTE_SEMITONES.items() for x in item]
    base = F.create_map(*pairs)[letter]
    shift = F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0)
    named = F.when(letter != "", (octave + 1) * 12 + base + shift)
    numbered = F.when(as_number.between(0, 127), as_number)
    return F.when(plain.rlike("^[0-9]+$"), numbered).otherwise(named).cast("int")


# --- JSON --------------------------------------------------------------------------------

def parse_json(text: Column, schema: str) -> Column:
    """Parsed value, NULL for an empty or malformed document."""
    return F.from_json(F.when(F.trim(text) != "", text), schema)


# --- descriptions ------------------------------------------------------------------------

def reasons(type_: Column, start: Column, end: Column, scores: Column, has_channels: Column) -> Column:
    """Type sentence, interval sentence, the three best dimensions, missing-channel note."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    best = F.slice(F.sort_array(entries), 1, 3)
    named = F.transform(best, lambda e: F.concat(e["k"], F.lit("="), F.format_string("%.2f", round_to(-e["v"], 2))))
    return F.array_compact(F.array(
        F.concat(F.lit("type "), type_),
        F.format_string("window %.1f-%.1f", start, end),
        F.concat(F.lit("best "), F.array_join(named, ",")),
        F.when(~has_channels, F.lit("no channels: drum and vocal states are estimates")),
    ))


def risks(type_: Column, start: Column, end: Column, scores: Column, has_channels: Column,
          tempo: Column, duration: Column, level_db: Column) -> Column:
    """Codes of the risks of a window; ``none`` when no rule fires."""
    score = lambda k: F.coalesce(scores[k], F.lit(0.0))
    flags = F.array_compact(F.array(
        F.when(score("vocal_state") > 0.15, "vocal"),
        F.when(score("key_stability") < 0.4, "unstable_key"),
        F.when((score("drum_state") > 0.5) & type_.isin("melody", "melody_no_drums"), "strong_drums"),
        F.when((start < 0.5) | (end > duration - 0.5), "edge"),
        F.when(F.coalesce(tempo, F.lit(0.0)) == 0, "no_tempo"),
        F.when(~has_channels, "no_channels"),
        F.when(level_db < -30.0, "low_level"),
    ))
    return F.when(F.size(flags) == 0, F.array(F.lit("none"))).otherwise(flags)


def op_chain(lowpass: Column, reverse: Column, stretch: Column, gain: Column, pan: Column) -> Column:
    """Ordered operations of an audio event with the place where each can be edited."""
    def op(name, value, capability):
        number = value.cast("double") if isinstance(value, Column) else F.lit(value).cast("double")
        return F.struct(F.lit(name).alias("op"), number.alias("value"), F.lit(capability).alias("capability"))

    return F.array_compact(F.array(
        op("trim", None, "native"),
        op("highpass", 100.0, "baked"),
        F.when(F.coalesce(lowpass, F.lit(0.0)) != 0, op("lowpass", lowpass, "baked")),
        F.when(F.coalesce(reverse, F.lit(False)), op("reverse", None, "baked")),
        F.when(F.coalesce(stretch, F.lit(0.0)) != 0, op("time_stretch", round_to(stretch, 6), "baked")),
        op("gain", round_to(F.coalesce(gain, F.lit(1.0)), 6), "native"),
        op("pan", round_to(F.coalesce(pan, F.lit(0.0)), 6), "native"),
    ))


def explain_quality(explain: Column, risks_: Column) -> Column:
    """1 plus a length bonus for given reasons, 0.5 for given risks."""
    text = F.array_join(explain, " ")
    reason = F.when(F.length(text) > 0, 1.0 + F.least(F.length(text) / 200.0, F.lit(1.0))).otherwise(F.lit(0.0))
    return reason + F.when(F.size(risks_) > 0, 0.5).otherwise(0.0)
