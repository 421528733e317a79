"""Character classes that mean the same to Python's ``str`` methods, Java regex and RE2."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

WORD = r"\p{L}\p{N}_"
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{2028}\x{2029}\p{Zs}"


def _ranges(test) -> str:
    """Regex class body of all code points outside the surrogates that pass ``test``."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        hit = cp <= sys.maxunicode and not 0xD800 <= cp <= 0xDFFF and test(chr(cp))
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            out.append(rf"\x{{{start:x}}}-\x{{{cp - 1:x}}}" if cp - 1 > start else rf"\x{{{start:x}}}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Decimal digits and the other characters with a digit value (superscripts, circled, ...)."""
    return r"\p{Nd}" + _ranges(lambda c: unicodedata.digit(c, None) is not None and unicodedata.decimal(c, None) is None)


@lru_cache(maxsize=1)
def upper_class() -> str:
    """Upper-case letters and the other characters with the Uppercase property."""
    return r"\p{Lu}" + _ranges(lambda c: c.isupper() and unicodedata.category(c) != "Lu")
