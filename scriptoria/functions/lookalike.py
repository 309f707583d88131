"""Plain counterparts of characters that look like other characters.

Pure-Python string helpers shared by Arrow-batched operators.  Everything works
on whole strings with C-level primitives (``str.translate``, ``normalize``), and
pure-ASCII strings are returned untouched.
"""

from __future__ import annotations

import unicodedata

# Letters of another script whose printed shape equals a Latin letter.
CYRILLIC_UPPER = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Һ": "h"}
CYRILLIC_LOWER = {"а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ρ": "p"}
ARMENIAN = {"Լ": "L", "Օ": "O", "Ս": "U", "Տ": "S", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o"}
CHEROKEE = {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"}
# Letters of another block with the shape of a plain one, beyond those that compatibility names.
OTHER_BLOCKS = {"ɡ": "g", "µ": "μ"}
# Letters that have the shape of two plain ones; the first is taken where nothing tells them apart.
TWO_SHAPES = {"Ӏ": "Il", "ӏ": "lI"}
# Hyphens of other blocks.
HYPHENS = "‐‑﹣－"
# Ranges of code points that show nothing and that programs may ignore, and of the blocks with compatibility characters.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
COMPATIBLE = ((0xA0, 0x33FF), (0xA640, 0xABFF), (0xFB00, 0xFFEF), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF))

LETTERS = {**CYRILLIC_UPPER, **CYRILLIC_LOWER, **GREEK, **ARMENIAN, **CHEROKEE, **OTHER_BLOCKS}


def _folds() -> dict[int, str]:
    """Compatibility characters to what they look like, by their kind of decomposition.

    Widths, fonts, positional forms and fixed spaces fold; ligatures, digraphs,
    Roman numerals and spaces too.  Superscripts, fractions, circled and squared
    signs stay: they are visible differences.
    """
    out: dict[int, str] = {}
    for first, last in COMPATIBLE:
        for o in range(first, last + 1):
            c = chr(o)
            kind, *parts = unicodedata.decomposition(c).split()[:3] or [""]
            if not kind.startswith("<") or c in LETTERS:
                continue
            sort = unicodedata.category(c)
            same = kind in ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
            if same or kind == "<compat>" and (sort in ("Zs", "Nl") or sort[0] == "L" and len(parts) > 1):
                out[o] = unicodedata.normalize("NFKC", c)
    return out


#: Code-point maps for ``str.translate``: signs (deletions, spaces, widths) and, on top of them, letters.
SIGNS: dict[int, str | None] = {
    **_folds(),
    **{ord(c): "-" for c in HYPHENS},
    **{o: None for first, last in IGNORABLE for o in range(first, last + 1)},
}
ALL: dict[int, str | None] = {**SIGNS, **{ord(k): v for k, v in LETTERS.items()}}


def plain_signs(text: str) -> str:
    """Fold compatibility forms and hyphens, delete what shows nothing, compose accents.  Letters of other scripts stay."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(SIGNS))


def plain(text: str) -> str:
    """One form for all texts that look the same.

    Letters are mapped on decomposed text, so that an accented letter of another
    script meets the accented Latin letter.
    """
    if text.isascii():
        return text
    if not any(map(_IN_ALL, set(text))) and unicodedata.is_normalized("NFC", text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(ALL))


_ACCENTED = {
    c
    for c in map(chr, range(0x370, 0x530))
    if (d := unicodedata.normalize("NFD", c)) != c and ord(d[0]) in ALL
} | {c for c in map(chr, range(0x1F00, 0x2000)) if (d := unicodedata.normalize("NFD", c)) != c and ord(d[0]) in ALL}
_IN_ALL = ({chr(c) for c in ALL} | _ACCENTED).__contains__
