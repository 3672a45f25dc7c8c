"""Scalar functions on columns: metric names, times, timecodes, labels and scores. Null in, null out unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def metric_name(key: Column | str) -> Column:
    """The last dotted part of a tag key; the last two where the last is a single character (psnr and mse planes)."""
    parts = F.split(_c(key), r"\.")
    last = F.element_at(parts, -1)
    return F.when((F.length(last) == 1) & (F.size(parts) > 1), F.concat_ws(".", F.element_at(parts, -2), last)).otherwise(last)


def seconds_to_hms4(t: Column | str) -> Column:
    """HH:MM:SS.ssss, truncated nowhere: rounded to ten thousandths first."""
    ticks = F.round(_c(t) * 10000).cast("long")
    part = lambda n, most: F.lpad((F.floor(ticks / n) % most).cast("string"), 2, "0")
    hours = F.floor(ticks / 36_000_000).cast("string")
    return F.concat(F.lpad(hours, F.greatest(F.lit(2), F.length(hours)), F.lit("0")), F.lit(":"), part(600_000, 60), F.lit(":"), part(10_000, 60), F.lit("."), F.lpad((ticks % 10000).cast("string"), 4, "0"))


def seconds_to_timecode(t: Column | str, fps: float = 30000 / 1001, start_frames: Column | int = 0, drop_frame: bool = False) -> Column:
    """SMPTE timecode HH:MM:SS:FF, or HH:MM:SS;FF with dropped frame numbers; negative times count as 0."""
    nominal = round(fps)
    n = F.round(F.greatest(_c(t), F.lit(0.0)) * fps).cast("long") + (start_frames if isinstance(start_frames, Column) else F.lit(start_frames))
    if drop_frame:
        drop = nominal // 15
        tens, minute = nominal * 600 - 9 * drop, nominal * 60 - drop
        d, m = F.floor(n / tens), n % tens
        n = n + d * 9 * drop + F.when(m >= drop, F.floor((m - drop) / minute) * drop).otherwise(0)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(n / (nominal * 3600)) % 24), F.lit(":"), two(F.floor(n / (nominal * 60)) % 60), F.lit(":"), two(F.floor(n / nominal) % 60), F.lit(";" if drop_frame else ":"), two(n % nominal))


def timecode_to_frames(tc: Column | str, nominal: int = 30) -> Column:
    """struct(frames, drop_frame) of a timecode; a `;` means drop frame; anything else than a timecode gives (0, false)."""
    tc = F.coalesce(_c(tc), F.lit(""))
    good = tc.rlike(r"^\d{1,2}:\d{2}:\d{2}[:;]\d{2}$")
    drop = tc.contains(";")
    h, m, s, f = (F.split(tc, "[:;]").getItem(k).try_cast("long") for k in range(4))
    whole = ((h * 60 + m) * 60 + s) * nominal + f
    minutes = h * 60 + m
    frames = whole - F.when(drop, (nominal // 15) * (minutes - F.floor(minutes / 10))).otherwise(0)
    return F.struct(F.when(good, frames).otherwise(0).cast("long").alias("frames"), (good & drop).alias("drop_frame"))


def hms_to_seconds(s: Column | str) -> Column:
    """Seconds of H:M:S.s; null where it is not of that form."""
    parts = F.split(_c(s), ":")
    h, m, sec = (F.trim(parts.getItem(k)).try_cast("double") for k in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + sec)


def format_elapsed(t: Column | str, style: str = "tenths") -> Column:
    """tenths: M:SS.s, with hours H:MM:SS.s; millis: MM:SS.mmm; seconds: M:SS."""
    scale = {"tenths": 10, "millis": 1000, "seconds": 1}[style]
    n = F.floor(_c(t) * scale + (0.5 if style != "seconds" else 0)).cast("long")
    sec, rest = F.floor(n / scale), n % scale
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    tail = {"tenths": F.concat(F.lit("."), rest.cast("string")), "millis": F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0")), "seconds": F.lit("")}[style]
    short = F.concat((two(F.floor(sec / 60)) if style == "millis" else F.floor(sec / 60).cast("string")), F.lit(":"), two(sec % 60), tail)
    if style != "tenths":
        return short
    return F.when(sec >= 3600, F.concat(F.floor(sec / 3600).cast("string"), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60), tail)).otherwise(short)


def parse_duration_tag(duration: Column | str, tag: Column | str) -> Column:
    """Seconds: the stream's own duration, else its DURATION tag."""
    return F.coalesce(_c(duration).try_cast("double"), hms_to_seconds(tag))


# Names of the twelve hue segments of 30 degrees, the first centred on 0.
HUES = ("red", "orange", "yellow", "yellow-green", "green", "green-cyan", "cyan", "blue-cyan", "blue", "blue-magenta", "magenta", "red-magenta")


def hue_label(degrees: Column | str) -> Column:
    """The name of a hue angle's segment; empty where there is no angle."""
    named = F.element_at(F.array(*map(F.lit, HUES)), (F.floor(F.pmod(_c(degrees) + 15, F.lit(360)) / 30) + 1).cast("int"))
    return F.coalesce(named, F.lit(""))


# What a level difference between channels is called, by the decibels that it stays below.
IMBALANCE = {1: "Balanced", 3: "Slight imbalance", 6: "Moderate imbalance", None: "Significant imbalance"}


def characterize_imbalance(db: Column | str) -> Column:
    db = F.abs(_c(db))
    out = F.when(db.isNull(), None)
    for below, name in IMBALANCE.items():
        out = out.when(db < below, name) if below else out.otherwise(name)
    return out


def wildcard_to_regex(pattern: str) -> str:
    """`#` a digit, `@` a letter, `*` a letter or digit; anything else stands for itself. On the small table of profiles only.

    >>> wildcard_to_regex("TAPE_##@*.x")
    'TAPE_\\\\d{2}[A-Za-z][A-Za-z0-9]\\\\.x'
    """
    out = []
    for m in re.finditer(r"#+|@|\*|[^#@*]+", pattern):
        s = m[0]
        out.append(rf"\d{{{len(s)}}}" if s[0] == "#" else "[A-Za-z]" if s == "@" else "[A-Za-z0-9]" if s == "*" else re.escape(s))
    return "".join(out)


def hash_algorithm(s: Column | str) -> Column:
    return F.when(F.length(_c(s)) == 32, "md5").when(F.length(_c(s)) == 64, "sha256")


def byte_offset_seconds(offset: Column | str, size: Column | str, duration: Column | str) -> Column:
    return F.when(_c(size) > 0, _c(offset) / _c(size) * _c(duration))


def split_encoder_settings(s: Column | str) -> Column:
    """map of device to its settings: `;` parts devices, `:` and `,` part settings; the first setting names the device."""
    devices = F.filter(F.split(F.trim(_c(s)), r"\s*;\s*"), lambda d: F.trim(d) != "")
    parts = F.transform(devices, lambda d: F.split(F.trim(d), r"\s*:\s*|\s*,\s*"))
    entries = F.transform(parts, lambda p: F.struct(p.getItem(0), F.slice(p, F.lit(2), F.size(p))))
    keys = F.transform(entries, lambda e: e["col1"])
    first = F.filter(entries, lambda e, k: F.array_position(keys, e["col1"]) == k + 1)
    return F.map_from_entries(first)


def normalize_field(*aliases: Column | str) -> Column:
    """The first alias that is there, as a list of its distinct values in order."""
    return F.array_distinct(F.coalesce(*map(_c, aliases)))


def yes_no_to_bool(v: Column | str) -> Column:
    v = F.lower(F.trim(_c(v)))
    return F.when(v.isin("yes", "true"), True).when(v.isin("no", "false"), False)


def dropped_sample_score(spikes: Column | str, diff_ms: Column | str, tolerance_ms: float = 0.0) -> Column:
    """struct(score, status): 0.2 + 0.06 a spike, at most 0.8, weighs 0.7; a duration difference 0.3 x 0.3; both together 0.15 more."""
    some, apart = _c(spikes) > 0, F.abs(_c(diff_ms)) > tolerance_ms
    part = F.when(some, F.least(F.lit(0.8), 0.2 + 0.06 * _c(spikes)) * 0.7).otherwise(0.0)
    score = F.bround(part + F.when(apart, 0.09).otherwise(0.0) + F.when(some & apart, 0.15).otherwise(0.0), 3)
    return F.struct(score.alias("score"), F.when(score == 0, "clean").when(score < 0.4, "warning").otherwise("critical").alias("status"))


def ltc_in_band(rms: Column | str, crest: Column | str, zcr: Column | str, entropy: Column | str, bands: dict[str, tuple[float, float]]) -> Column:
    """Whether the four metrics lie in their bands; false where one is missing."""
    inside = [_c(c).between(*bands[k]) for c, k in ((rms, "rms"), (crest, "crest"), (zcr, "zcr"), (entropy, "entropy"))]
    out = inside[0]
    for x in inside[1:]:
        out = out & x
    return F.coalesce(out, F.lit(False))


def floor_neg_inf(v: Column | str, floor: float = -120.0) -> Column:
    return F.when(_c(v) == float("-inf"), F.lit(floor)).otherwise(_c(v))


# Zones of luma by the value that they stay below.
LUMA_ZONES = {64: "subblack", 192: "midtones", None: "highlights"}


def luma_zone(y: Column | str) -> Column:
    out = F.when(_c(y).isNull(), None)
    for below, name in LUMA_ZONES.items():
        out = out.when(_c(y) < below, name) if below else out.otherwise(name)
    return out


def format_percentage(part: Column | str, whole: Column | str) -> Column:
    """Per cent of the whole with two decimals; 0.00% of nothing."""
    return F.format_string("%.2f%%", F.when(_c(whole) > 0, 100.0 * _c(part) / _c(whole)).otherwise(F.lit(0.0)).cast("double"))


def humanize_label(s: Column | str) -> Column:
    return F.initcap(F.regexp_replace(_c(s), "[_-]+", " "))


def border_regions(x: Column | str, y: Column | str, w: Column | str, h: Column | str, width: int, height: int, least: int = 0) -> Column:
    """array of struct(side, x, y, w, h): what the active area leaves of the frame on each side, corners on both of theirs; sides of at most `least` pixels are left out."""
    x, y, w, h = map(_c, (x, y, w, h))
    side = lambda name, a, b, c, d: F.struct(F.lit(name).alias("side"), a.cast("int").alias("x"), b.cast("int").alias("y"), c.cast("int").alias("w"), d.cast("int").alias("h"))
    zero = F.lit(0)
    whole = F.lit(width)
    sides = F.array(side("left", zero, zero, x, F.lit(height)), side("right", x + w, zero, width - x - w, F.lit(height)), side("top", zero, zero, whole, y), side("bottom", zero, y + h, whole, height - y - h))
    across = lambda s: F.when(s["side"].isin("left", "right"), s["w"]).otherwise(s["h"])
    return F.filter(sides, lambda s: (s["w"] > 0) & (s["h"] > 0) & (across(s) > least))


def simple_area(width: Column | str, height: Column | str, border: int = 25) -> Column:
    """struct(x, y, w, h): the frame less a border of fixed width; the whole frame where nothing would be left."""
    w, h = _c(width) - 2 * border, _c(height) - 2 * border
    fits = (w > 0) & (h > 0)
    at = F.when(fits, border).otherwise(0)
    return F.struct(at.alias("x"), at.alias("y"), F.when(fits, w).otherwise(_c(width)).cast("int").alias("w"), F.when(fits, h).otherwise(_c(height)).cast("int").alias("h"))


# Kinds of findings in the order of a report.
PROFILES = ("color_bars_detection", "color_bars_evaluation", "threshold_profile", "tag_check")


def timestamp_sort_key(text: Column | str) -> Column:
    """struct(hours, minutes, seconds, fraction) of HH:MM:SS.ffff, the fraction in four digits; what is no time comes last."""
    parts = F.split(_c(text), ":")
    seconds = F.split(F.get(parts, F.lit(2)), r"\.")
    whole = lambda x: F.try_to_number(F.trim(x), F.lit("99999999")).cast("int")
    fraction = F.coalesce(whole(F.substring(F.rpad(F.get(seconds, F.lit(1)), 4, "0"), 1, 4)), F.when(F.size(seconds) < 2, 0))
    found = F.struct(whole(F.get(parts, F.lit(0))).alias("hours"), whole(F.get(parts, F.lit(1))).alias("minutes"), whole(F.get(seconds, F.lit(0))).alias("seconds"), fraction.alias("fraction"))
    there = (F.size(parts) == 3) & found["hours"].isNotNull() & found["minutes"].isNotNull() & found["seconds"].isNotNull() & found["fraction"].isNotNull()
    last = F.struct(F.lit(9999).alias("hours"), F.lit(99).alias("minutes"), F.lit(99).alias("seconds"), F.lit(99).alias("fraction"))
    return F.when(there, found).otherwise(last)


def profile_sort_key(name: Column | str) -> Column:
    """The place of a finding's kind in a report, by what its name begins with; others come last."""
    out = F
    for k, kind in enumerate(PROFILES):
        out = out.when(_c(name).startswith(kind), k)
    return out.otherwise(99)


def expand_borders(x: Column | str, y: Column | str, w: Column | str, h: Column | str, by: dict[str, int], width: int, height: int, least: int = 100) -> Column:
    """struct(x, y, w, h): the active area made smaller by `by` pixels on the named sides, at least `least` wide and high, inside the frame."""
    x, y, w, h = map(_c, (x, y, w, h))
    nx, ny = F.least(x + by.get("left", 0), F.lit(width - least)), F.least(y + by.get("top", 0), F.lit(height - least))
    nw = F.least(F.greatest(w - by.get("left", 0) - by.get("right", 0), F.lit(least)), F.lit(width) - nx)
    nh = F.least(F.greatest(h - by.get("top", 0) - by.get("bottom", 0), F.lit(least)), F.lit(height) - ny)
    return F.struct(nx.cast("int").alias("x"), ny.cast("int").alias("y"), nw.cast("int").alias("w"), nh.cast("int").alias("h"))
