"""Texts as arrays of code points, with their words found by array operations."""

import unicodedata
from functools import lru_cache

import numpy as np

# Script ranges of Unicode (fixed values): first and last code point. Letters outside all of them count as "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)], "gujarati": [(0xA80, 0xAFF)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "ethiopic": [(0x1200, 0x137F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
OTHER = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def scripts() -> np.ndarray:
    """Number of the script of each letter and combining mark, 0 for all other characters."""
    marks = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
    out = np.where(letters() | marks, OTHER, 0).astype(np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            part = out[first : last + 1]
            part[part > 0] = number
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text starts (with the total at the end)."""
    joined = "\n".join(texts) + "\n" if texts else ""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), starts


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of letters of one script, and the script of every character."""
    script = scripts()[points]
    change = np.flatnonzero(np.diff(script, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = change[:-1], change[1:]
    inside = script[starts] > 0
    return starts[inside], ends[inside], script
