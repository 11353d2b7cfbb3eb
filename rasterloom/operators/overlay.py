"""Painting one small raster over packed images: placed, scaled, blended. The overlay goes to the workers with the function, so its size is bounded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from rasterloom.functions.color import ParameterError, within
from rasterloom.functions.geometry import ANCHORS, half_up
from rasterloom.operators.packed import Kernel, resize

#: Bytes that an overlay may have.
MOST = 64 << 20


def _light(b: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(s <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s))


def _soft(b: np.ndarray, s: np.ndarray) -> np.ndarray:
    root = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
    return np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (root - b))


#: The separable blend formulas of functions.color, on arrays: (backdrop, source), both 0..1.
BLEND: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "normal": lambda b, s: s,
    "multiply": lambda b, s: b * s,
    "screen": lambda b, s: b + s - b * s,
    "overlay": lambda b, s: _light(s, b),
    "darken": np.minimum,
    "lighten": np.maximum,
    "color_dodge": lambda b, s: np.where(s >= 1, 1.0, np.minimum(1.0, b / np.where(s >= 1, 1.0, 1 - s))),
    "color_burn": lambda b, s: np.where(s <= 0, 0.0, 1 - np.minimum(1.0, (1 - b) / np.where(s <= 0, 1.0, s))),
    "hard_light": _light,
    "soft_light": _soft,
    "difference": lambda b, s: np.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
}


def over(back: np.ndarray, source: np.ndarray, mode: str, opacity: float) -> np.ndarray:
    """Source-over of rasters of one size; a source pixel without alpha leaves the backdrop as it is."""
    b, s = back / 255.0, source / 255.0
    ba, sa = b[..., 3:], s[..., 3:] * opacity
    mixed = (1 - ba) * s[..., :3] + ba * BLEND[mode](b[..., :3], s[..., :3])
    alpha = sa + ba * (1 - sa)
    color = (sa * mixed + (1 - sa) * ba * b[..., :3]) / np.where(alpha == 0, 1.0, alpha)
    out = np.clip(np.floor(np.concatenate([color, alpha], axis=2) * 255 + 0.5), 0, 255).astype(np.uint8)
    return np.where(sa > 0, out, back)


def composite(overlay: np.ndarray, left: int, top: int, width: int | None = None, height: int | None = None, mode: str = "normal", opacity: float = 1.0, name: str = "lanczos") -> Kernel:
    """Paints the overlay, scaled to a placement; what leaves the image is cut."""
    if mode not in BLEND:
        raise ParameterError(f"unknown blend mode {mode}")
    within("opacity", opacity, 0, 1)
    h, w = height or overlay.shape[0], width or overlay.shape[1]
    if max(overlay.nbytes, h * w * 4) > MOST:
        raise ParameterError("an overlay too large to send to all workers")
    scaled = resize(w, h, name)(overlay)

    def run(raster: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = max(0, left), max(0, top), min(raster.shape[1], left + w), min(raster.shape[0], top + h)
        if x0 >= x1 or y0 >= y1:
            return raster
        out = raster.copy()
        out[y0:y1, x0:x1] = over(raster[y0:y1, x0:x1], scaled[y0 - top : y1 - top, x0 - left : x1 - left], mode, opacity)
        return out

    return run


def visible_mark(overlay: np.ndarray, anchor: str = "bottom-right", margin: int = 0, opacity: float = 1.0, mode: str = "normal", relative_width: float | None = None, name: str = "lanczos") -> Kernel:
    """The overlay at an anchor, moved inwards by a margin; relative_width is its width as a part of the image's, in its own shape."""
    if anchor not in ANCHORS:
        raise ParameterError(f"unknown anchor {anchor}")
    if relative_width is not None:
        within("relative width", relative_width, 0.001, 1)
    composite(overlay, 0, 0, mode=mode, opacity=opacity)  # the same parameters are refused
    across, down = ANCHORS[anchor]

    def cut(room: int, k: int) -> int:
        return abs(room) * k // 2 * (1 if room >= 0 else -1)

    def run(raster: np.ndarray) -> np.ndarray:
        oh, ow, _ = overlay.shape
        h, w, _ = raster.shape
        if relative_width is not None:
            wide = max(1, half_up(w * relative_width))
            oh, ow = max(1, half_up(wide / (ow / oh))), wide
        left, top = cut(w - ow, across) + margin * (1 - across), cut(h - oh, down) + margin * (1 - down)
        return composite(overlay, left, top, ow, oh, mode, opacity, name)(raster)

    return run
