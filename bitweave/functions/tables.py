"""Fixed values of the coder: subbands, default weights, symbol maps and codes."""

from __future__ import annotations

# Fixed values, as the format defines them.
#: Subbands in their order, with level and orientation (horizontal, vertical high-pass).
SUBBANDS = ("LL3", "HL3", "LH3", "HH3", "HL2", "LH2", "HH2", "HL1", "LH1", "HH1")
LEVEL = (3, 3, 3, 3, 2, 2, 2, 1, 1, 1)
#: Default weights of the subbands, as powers of two.
WEIGHTS = (3, 3, 3, 2, 2, 2, 1, 1, 1, 0)
#: Codes of symbols 0, 1, 2, ... by word length and option.
CODES = {
    (2, 0): "1 01 001 000",
    (3, 0): "1 01 001 00000 00001 00010 000110 000111",
    (3, 1): "10 11 010 011 0010 0011 0000 0001",
    (4, 0): "1 01 001 0001 0000000 0000001 0000010 0000011 00001000 00001001 00001010 00001011 00001100 00001101 00001110 00001111",
    (4, 1): "10 11 010 011 0010 0011 000000 000001 000010 000011 000100 000101 0001100 0001101 0001110 0001111",
    (4, 2): "100 101 110 111 0100 0101 0110 0111 00100 00101 00110 00111 00000 00001 00010 00011",
}
#: Symbols of words 0, 1, 2, ... by length and kind of word; -1 never occurs.
SYMBOLS = {
    (2, "any"): (0, 2, 1, 3),
    (3, "any"): (1, 4, 0, 5, 2, 6, 3, 7),
    (3, "tran_D"): (-1, 3, 0, 4, 1, 5, 2, 6),
    (4, "any"): (10, 1, 3, 6, 2, 5, 9, 12, 0, 8, 7, 13, 4, 14, 11, 15),
    (4, "types_H"): (-1, 1, 3, 6, 2, 5, 9, 11, 0, 8, 7, 12, 4, 13, 10, 14),
    (4, "tran_H"): (-1, 1, 3, 6, 2, 5, 9, 11, 0, 8, 7, 12, 4, 13, 10, 14),
}
#: Blocks in a gaggle, coefficients in a block.
GAGGLE, BLOCK = 16, 64


def code_rows() -> list[tuple[int, int, int, str]]:
    """(length, option, symbol, code)."""
    return [(n, o, s, c) for (n, o), codes in CODES.items() for s, c in enumerate(codes.split(" "))]


def symbol_rows() -> list[tuple[int, str, int, int]]:
    """(length, kind, word, symbol)."""
    return [(n, k, w, s) for (n, k), symbols in SYMBOLS.items() for w, s in enumerate(symbols) if s >= 0]


def place(index: int) -> tuple[int, int, int, int, int]:
    """(subband, scale, row, column, family) of a block's coefficient: its place in that subband is
    scale * block + (row, column). The index has 0 for DC, then parents, children and grandchildren by family."""
    if index == 0:
        return 0, 1, 0, 0, -1
    if index < 4:
        return index, 1, 0, 0, index - 1
    if index < 16:
        f, k = divmod(index - 4, 4)
        return 4 + f, 2, k >> 1, k & 1, f
    f, k = divmod(index - 16, 16)
    a, b, c, d = (k >> 3) & 1, (k >> 2) & 1, (k >> 1) & 1, k & 1
    return 7 + f, 4, 2 * a + c, 2 * b + d, f


def mask(indices) -> int:
    """Bits of the AC coefficients: index 1 is bit 62, index 63 is bit 0, so a mask fits BIGINT."""
    return sum(1 << (63 - i) for i in indices)


#: Masks of parents, of children and grandchildren by family, and of groups of grandchildren.
PARENTS = mask(range(1, 4))
CHILDREN = tuple(mask(range(4 + 4 * f, 8 + 4 * f)) for f in range(3))
GROUPS = tuple(tuple(mask(range(16 + 16 * f + 4 * k, 20 + 16 * f + 4 * k)) for k in range(4)) for f in range(3))
GRAND = tuple(sum(g) for g in GROUPS)
DESCENDANTS = tuple(c + g for c, g in zip(CHILDREN, GRAND, strict=True))
ALL_DESCENDANTS = sum(DESCENDANTS)


def subband_mask(sb: int) -> int:
    """The AC coefficients of a block that lie in a subband."""
    return mask(i for i in range(1, BLOCK) if place(i)[0] == sb)
