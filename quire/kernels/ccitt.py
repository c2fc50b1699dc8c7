"""CCITT fax (groups 3 and 4) to packed bits, a row padded to bytes. Damaged rows repeat the one before."""

from __future__ import annotations

# fixed values of the format: run-length codes, as code -> run
_WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100".split()
_WHITE_MAKEUP = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011".split()
_BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111".split()
_BLACK_MAKEUP = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101".split()
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
_MODES = {"1": 0, "011": 1, "010": -1, "000011": 2, "000010": -2, "0000011": 3, "0000010": -3, "0001": "pass", "001": "horizontal"}
_EOL = "000000000001"


def _runs(short: list[str], makeup: list[str]) -> dict[str, int]:
    return dict(zip(short, range(64))) | {c: 64 * (i + 1) for i, c in enumerate(makeup)} | {c: 1792 + 64 * i for i, c in enumerate(_LONG)}


RUNS = (_runs(_WHITE, _WHITE_MAKEUP), _runs(_BLACK, _BLACK_MAKEUP))


class _Damage(Exception):
    pass


class Fax:
    def __init__(self, data: bytes, columns: int):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at, self.columns = 0, columns

    def code(self, table: dict, longest: int):
        for n in range(1, longest + 1):
            v = table.get(self.bits[self.at : self.at + n])
            if v is not None and self.at + n <= len(self.bits):
                self.at += n
                return v
        raise _Damage

    def run(self, black: int) -> int:
        total = 0
        while True:
            n = self.code(RUNS[black], 13)
            total += n
            if n < 64:
                return total

    def eol(self) -> bool:
        """Take an end-of-line mark, with fill bits before it."""
        end = self.at
        while end < len(self.bits) and self.bits[end] == "0":
            end += 1
        if end - self.at >= 11 and end < len(self.bits):
            self.at = end + 1
            return True
        return False

    def row_1d(self) -> list[int]:
        """Positions where the color changes, white first."""
        out, x, black = [], 0, 0
        while x < self.columns:
            x += self.run(black)
            if x > self.columns:
                raise _Damage
            out.append(x)
            black ^= 1
        return out

    def row_2d(self, before: list[int]) -> list[int]:
        out: list[int] = []
        a0, black = -1, 0
        while a0 < self.columns:
            b1 = next((i for i, x in enumerate(before) if x > a0 and i % 2 == black), len(before))
            change = lambda i: before[i] if i < len(before) else self.columns
            mode = self.code(_MODES, 7)
            if mode == "pass":
                a0 = change(b1 + 1)
            elif mode == "horizontal":
                start = max(a0, 0)
                first = start + self.run(black)
                a0 = first + self.run(black ^ 1)
                if a0 > self.columns:
                    raise _Damage
                out += [first, a0]
            else:
                x = change(b1) + mode
                if x < max(a0, 0) or x > self.columns:
                    raise _Damage
                out.append(x)
                a0, black = x, black ^ 1
                if x == self.columns:
                    break
        return out


def decode(data: bytes, *, k: int = 0, columns: int = 1728, rows: int = 0, black_is_1: bool = False, align: bool = False, end_of_block: bool = True) -> bytes:
    fax, out, before = Fax(data, columns), [], []
    width = (columns + 7) // 8
    while fax.at < len(fax.bits) and (not rows or len(out) < rows):
        if align and not k > 0:
            fax.at += -fax.at % 8
        marks = 0
        while (k >= 0 or end_of_block) and fax.bits[fax.at : fax.at + 11] == "0" * 11 and fax.eol():
            marks += 1
            if marks > 1 and end_of_block:
                break
            if k > 0:
                two = fax.bits[fax.at : fax.at + 1] == "0"
                fax.at += 1
        if marks > 1 and end_of_block or fax.at >= len(fax.bits) - 7 and not fax.bits[fax.at :].strip("0"):
            break
        try:
            row = fax.row_2d(before) if k < 0 or k > 0 and marks and two else fax.row_1d()
        except _Damage:
            if k < 0:
                break  # nothing marks the next row
            end = fax.bits.find(_EOL, fax.at)
            if end < 0:
                break
            fax.at, row = end, before
        before = row
        line, black, x = bytearray(), 0, 0
        text = []
        for stop in [*row, columns]:
            text.append(("1" if black else "0") * (min(stop, columns) - x))
            x, black = min(stop, columns), black ^ 1
        line = int("".join(text).ljust(width * 8, "0"), 2).to_bytes(width, "big")
        out.append(line if black_is_1 else bytes(~b & 255 for b in line))
    blank = (b"\0" if black_is_1 else b"\xff") * width
    return b"".join(out + [blank] * (rows - len(out) if rows else 0))


def encode_g4(rows: list[list[int]]) -> bytes:
    """Rows of 0 (white) and 1 (black) by group 4; for tests."""
    codes = ({v: c for c, v in RUNS[0].items()}, {v: c for c, v in RUNS[1].items()})

    def run(n: int, black: int) -> str:
        out = ""
        while n >= 2560:
            out, n = out + codes[black][2560], n - 2560
        return out + (codes[black][n // 64 * 64] if n >= 64 else "") + codes[black][n % 64]

    modes = {v: c for c, v in _MODES.items()}
    bits, width = "", len(rows[0])
    above = [0] * width
    for row in rows:
        a0, color = -1, 0

        def change(line, start, of):
            x = start
            while x < width and not (line[x] != of and (x == 0 and of == 0 and line[x] == 1 or x > 0 and line[x - 1] == of)):
                x += 1
            return x

        while a0 < width:
            a1 = next((x for x in range(max(a0, 0), width) if row[x] != color), width)
            b1 = change(above, a0 + 1, color)
            b2 = next((x for x in range(b1, width) if above[x] == color), width)
            if b2 < a1:
                bits += modes["pass"]
                a0 = b2
            elif abs(a1 - b1) <= 3:
                bits += modes[a1 - b1]
                a0, color = a1, color ^ 1
                if a1 == width:
                    break
            else:
                a2 = next((x for x in range(a1, width) if row[x] == color), width)
                bits += modes["horizontal"] + run(a1 - max(a0, 0), color) + run(a2 - a1, color ^ 1)
                a0 = a2
        above = row
    bits += _EOL * 2
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
