"""The orientation tag of JPEG, PNG and WebP files. Broken metadata means no turn: a picture that can be read stays readable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.sources.headers import Broken, _u, identify

#: What stands before the directory, the tag and its type, the marks of byte order.
EXIF, TAG, SHORT = b"Exif\0\0", 0x0112, 3
ORDERS = {b"II*\0": "little", b"MM\0*": "big"}


def _piece(d: bytes, at: int, n: int) -> bytes:
    if n < 0 or at + n > len(d):
        raise Broken("the file ends early")
    return d[at : at + n]


def _pieces(name: str, d: bytes) -> Iterator[bytes]:
    """What may hold the directory, up to where the image's data begins."""
    if name == "jpeg":
        at = 2
        while at + 4 <= len(d) and d[at] == 0xFF and d[at + 1] not in (0xD9, 0xDA):
            n = _u(d, at + 2, 2)
            if d[at + 1] == 0xE1 and d.startswith(EXIF, at + 4):
                yield _piece(d, at + 10, n - 8)
            at += 2 + n
    elif name == "png":
        at = 8
        while at + 8 <= len(d) and d[at + 4 : at + 8] not in (b"IDAT", b"IEND"):
            n = _u(d, at, 4)
            if d[at + 4 : at + 8] == b"eXIf":
                yield _piece(d, at + 8, n)
            at += 12 + n
    elif name == "webp":
        at = 12
        while at + 8 <= len(d):
            n = _u(d, at + 4, 4, "little")
            if d[at : at + 4] == b"EXIF":
                yield _piece(d, at + 8, n).removeprefix(EXIF)
            at += 8 + n + n % 2


def orientation_bytes(name: str | None, data: bytes | None) -> int:
    """1 to 8 of the first directory; 1 where there is none, or it is broken, or says something else."""
    try:
        tiff = next(_pieces(name or "", bytes(data or b"")), None)
        order = None if tiff is None else ORDERS.get(tiff[:4])
        if order is None:
            return 1
        base = _u(tiff, 4, 4, order)
        for at in range(base + 2, base + 2 + 12 * _u(tiff, base, 2, order), 12):
            if (_u(tiff, at, 2, order), _u(tiff, at + 2, 2, order)) == (TAG, SHORT):
                value = _u(tiff, at + 8, 2, order)
                return value if 1 <= value <= 8 else 1
    except Broken:
        pass
    return 1


def orientation(content: Column, name: Column | None = None) -> Column:
    """The orientation of each file; name is its format, as identify(content) gives it."""

    @F.pandas_udf("int")
    def run(names: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([orientation_bytes(n, d) for n, d in zip(names, data, strict=True)], dtype="int32")

    return run(identify(content) if name is None else name, content)


def directory(value: int, order: str = "little") -> bytes:
    """The smallest directory that says an orientation."""
    mark = next(m for m, o in ORDERS.items() if o == order)
    n = lambda v, k: v.to_bytes(k, order)
    return mark + n(8, 4) + n(1, 2) + n(TAG, 2) + n(SHORT, 2) + n(1, 4) + n(value, 2) + bytes(6)
