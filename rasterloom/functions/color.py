"""Color formulas over channel columns 0..255. Halves round away from zero; alpha stays unless a formula is about alpha."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Channels = dict[str, Column]

# Rec. 601 luma and the sepia matrix.
LUMA = (0.299, 0.587, 0.114)
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))


class ParameterError(ValueError):
    """A parameter is outside its range; raised when an operation is made, before any data is read."""


def within(name: str, value: float, low: float, high: float) -> float:
    if not math.isfinite(value) or not low <= value <= high:
        raise ParameterError(f"{name} must be within {low} and {high}, not {value}")
    return value


def channels(*names: str) -> Channels:
    return {n: F.col(n) for n in (names or ("r", "g", "b", "a"))}


def to_byte(value: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(value))).cast("int")


def luma(c: Channels) -> Column:
    return F.lit(LUMA[0]) * c["r"] + F.lit(LUMA[1]) * c["g"] + F.lit(LUMA[2]) * c["b"]


def each(f: Callable[[Column], Column]) -> Callable[[Channels], Channels]:
    """The same formula on r, g and b."""
    return lambda c: {n: f(c[n]) for n in ("r", "g", "b")}


def grayscale() -> Callable[[Channels], Channels]:
    return lambda c: {n: to_byte(luma(c)) for n in ("r", "g", "b")}


def invert() -> Callable[[Channels], Channels]:
    return each(lambda v: (F.lit(255) - v).cast("int"))


def brightness(level: int) -> Callable[[Channels], Channels]:
    shift = math.floor(abs(within("level", level, -100, 100)) * 255 / 100 + 0.5) * (1 if level >= 0 else -1)
    return each(lambda v: to_byte((v + F.lit(shift)).cast("double")))


def contrast(level: int) -> Callable[[Channels], Channels]:
    factor = ((100 + within("level", level, -100, 100)) / 100) ** 2
    return each(lambda v: to_byte((v - F.lit(127.5)) * F.lit(factor) + F.lit(127.5)))


def gamma(g: float) -> Callable[[Channels], Channels]:
    power = 1 / within("gamma", g, 0.01, 10)
    return each(lambda v: to_byte(F.pow(v / F.lit(255.0), F.lit(power)) * F.lit(255.0)))


def colorize(tint: tuple[int, int, int], strength: float = 0.5) -> Callable[[Channels], Channels]:
    within("strength", strength, 0, 1)
    for t in tint:
        within("tint", t, 0, 255)
    return lambda c: {n: to_byte(c[n] * F.lit(1.0 - strength) + F.lit(float(t) * strength)) for n, t in zip("rgb", tint, strict=True)}


def opacity(value: float) -> Callable[[Channels], Channels]:
    within("opacity", value, 0, 1)
    return lambda c: {"a": to_byte(c["a"] * F.lit(float(value)))}


def sepia() -> Callable[[Channels], Channels]:
    return lambda c: {n: to_byte(F.lit(row[0]) * c["r"] + F.lit(row[1]) * c["g"] + F.lit(row[2]) * c["b"]) for n, row in zip("rgb", SEPIA, strict=True)}


def hue_saturation(hue: float = 0, saturation: float = 0) -> Callable[[Channels], Channels]:
    """Turns the hue and scales the saturation in HSL. Gray pixels (no difference between channels) keep their value."""
    within("hue", hue, -180, 180)
    within("saturation", saturation, -100, 100)

    t = lambda n: F.col(f"_hsl_{n}")

    def apply(c: Channels) -> list[Channels]:
        r, g, b = (c[n] / F.lit(255.0) for n in "rgb")
        top, low, delta, light = (t(n) for n in ("top", "low", "delta", "light"))
        gray = delta == 0
        safe = F.when(gray, F.lit(1.0)).otherwise(delta)
        sat = F.when(gray, 0.0).otherwise(safe / F.when(gray, 1.0).otherwise(1 - F.abs(2 * light - 1)))
        turn = F.when(gray, 0.0).when(top == r, F.pmod((g - b) / safe, F.lit(6.0))).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6
        h, s, chroma = t("h"), t("s"), t("chroma")
        zero = F.lit(0.0)
        x, base, sector = t("x"), t("base"), t("sector")
        table = {"r": (chroma, x, zero, zero, x, chroma), "g": (x, chroma, chroma, x, zero, zero), "b": (zero, zero, x, chroma, chroma, x)}
        out = {}
        for n, picks in table.items():
            pick = F.when(sector == 0, picks[0])
            for k, p in enumerate(picks[1:], 1):
                pick = pick.when(sector == k, p)
            out[n] = to_byte((pick + base) * 255)
        return [
            {"_hsl_top": F.greatest(r, g, b), "_hsl_low": F.least(r, g, b)},
            {"_hsl_delta": top - low, "_hsl_light": (top + low) / 2},
            {"_hsl_h": F.pmod(turn + F.lit(hue / 360), F.lit(1.0)), "_hsl_s": F.least(F.lit(1.0), F.greatest(F.lit(0.0), sat * F.lit(1 + saturation / 100)))},
            {"_hsl_chroma": (1 - F.abs(2 * light - 1)) * s},
            {"_hsl_x": chroma * (1 - F.abs(F.pmod(h * 6, F.lit(2.0)) - 1)), "_hsl_base": light - chroma / 2, "_hsl_sector": F.least(F.lit(5), F.floor(h * 6).cast("int"))},
            out,
        ]

    return apply


def to_linear(value: Column) -> Column:
    """sRGB 0..1 to linear light."""
    return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def from_linear(value: Column) -> Column:
    return F.when(value <= 0.0031308, value * 12.92).otherwise(F.pow(value, F.lit(1 / 2.4)) * 1.055 - 0.055)


def parse_hex(text: Column) -> dict[str, Column]:
    """#rgb, #rgba, #rrggbb or #rrggbbaa, with or without #, as channels; null for anything else."""
    raw = F.lower(F.regexp_replace(text, "^#", ""))
    long = F.when(F.length(raw).isin(3, 4), F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)
    ok = F.regexp_like(raw, F.lit("^([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$"))
    part = lambda k: F.conv(F.substring(F.rpad(long, 8, "f"), 2 * k + 1, 2), 16, 10).cast("int")
    return {n: F.when(ok, part(k)) for k, n in enumerate("rgba")}


def to_hex(c: Channels) -> Column:
    """#rrggbb, with aa only where the color isn't opaque."""
    pair = lambda v: F.lower(F.lpad(F.hex(v), 2, "0"))
    return F.concat(F.lit("#"), pair(c["r"]), pair(c["g"]), pair(c["b"]), F.when(c["a"] < 255, pair(c["a"])).otherwise(F.lit("")))


#: Separable blend formulas: (backdrop, source), both 0..1.
BLEND: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda b, s: s,
    "multiply": lambda b, s: b * s,
    "screen": lambda b, s: b + s - b * s,
    "overlay": lambda b, s: F.when(b <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s)),
    "darken": lambda b, s: F.least(b, s),
    "lighten": lambda b, s: F.greatest(b, s),
    "color_dodge": lambda b, s: F.when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), b / F.when(s >= 1, 1.0).otherwise(1 - s))),
    "color_burn": lambda b, s: F.when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - b) / F.when(s <= 0, 1.0).otherwise(s))),
    "hard_light": lambda b, s: F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s)),
    "soft_light": lambda b, s: F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b)) - b)),
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
}


def source_over(back: Channels, over: Channels, mode: str = "normal", opacity: float = 1.0) -> list[Channels]:
    """Source-over of one pixel, in levels; a source without alpha leaves the backdrop as it is."""
    if mode not in BLEND:
        raise ParameterError(f"unknown blend mode {mode}")
    within("opacity", opacity, 0, 1)
    t = lambda n: F.col(f"_over_{n}")
    sa, ba, oa = t("sa"), t("ba"), t("oa")
    skip = over["a"].isNull() | (sa <= 0)
    first = {"_over_sa": over["a"] / F.lit(255.0) * F.lit(float(opacity)), "_over_ba": back["a"] / F.lit(255.0)}
    first |= {f"_over_b{n}": back[n] / F.lit(255.0) for n in "rgb"} | {f"_over_s{n}": over[n] / F.lit(255.0) for n in "rgb"}
    out = {n: F.when(skip, back[n]).otherwise(to_byte((sa * t(f"m{n}") + (1 - sa) * ba * t(f"b{n}")) / F.when(oa == 0, 1.0).otherwise(oa) * 255)).cast("int") for n in "rgb"}
    out["a"] = F.when(skip, back["a"]).otherwise(to_byte(oa * 255)).cast("int")
    mixed = {f"_over_m{n}": (1 - ba) * t(f"s{n}") + ba * BLEND[mode](t(f"b{n}"), t(f"s{n}")) for n in "rgb"}
    return [first, {"_over_oa": sa + ba * (1 - sa)} | mixed, out]
