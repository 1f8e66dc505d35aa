"""Glyph programs (Type 1 and Type 2 charstrings): a stack machine that yields outlines."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

#: Numbers of the operators (fixed values); two-byte operators are 1200 and the second byte.
OPERATORS = {
    1: "hstem", 3: "vstem", 4: "vmoveto", 5: "rlineto", 6: "hlineto", 7: "vlineto", 8: "rrcurveto", 9: "closepath", 10: "callsubr", 11: "return", 13: "hsbw",
    14: "endchar", 18: "hstemhm", 19: "hintmask", 20: "cntrmask", 21: "rmoveto", 22: "hmoveto", 23: "vstemhm", 24: "rcurveline", 25: "rlinecurve",
    26: "vvcurveto", 27: "hhcurveto", 29: "callgsubr", 30: "vhcurveto", 31: "hvcurveto", 1200: "dotsection", 1201: "vstem3", 1202: "hstem3", 1203: "and",
    1204: "or", 1205: "not", 1206: "seac", 1207: "sbw", 1209: "abs", 1210: "add", 1211: "sub", 1212: "div", 1214: "neg", 1215: "eq", 1216: "callothersubr",
    1217: "pop", 1218: "drop", 1220: "put", 1221: "get", 1222: "ifelse", 1223: "random", 1224: "mul", 1226: "sqrt", 1227: "dup", 1228: "exch", 1229: "index",
    1230: "roll", 1233: "setcurrentpoint", 1234: "hflex", 1235: "flex", 1236: "hflex1", 1237: "flex1",
}
RANDOM = 0.42
MAX_DEPTH, MAX_STEPS = 12, 200_000


class CharStringError(ValueError):
    pass


@dataclass
class Glyph:
    width: float | None = None
    segments: list[tuple[str, tuple[tuple[float, float], ...]]] = field(default_factory=list)
    hints: list[tuple[str, float, float]] = field(default_factory=list)
    seac: tuple[float, float, int, int] | None = None  # place of the accent, codes of base and accent

    def path(self, dx: float = 0.0, dy: float = 0.0) -> str:
        show = lambda v: f"{v:.3f}".rstrip("0").rstrip(".") if v % 1 else str(int(v))
        return " ".join(k + " ".join(f"{show(x + dx)} {show(y + dy)}" for x, y in ps) for k, ps in self.segments)

    def bounds(self) -> tuple[float, float, float, float] | None:
        points = [p for _, ps in self.segments for p in ps]
        return (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)) if points else None


def _bias(subrs: Sequence[bytes]) -> int:
    return 107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768


class Machine:
    """One run of a glyph program. ``kind`` is 1 or 2; arithmetic operators work in both."""

    def __init__(self, kind: int = 2, local: Sequence[bytes] = (), shared: Sequence[bytes] = ()) -> None:
        self.kind, self.local, self.shared = kind, local, shared
        self.stack: list[float] = []
        self.storage = [0.0] * 32
        self.results: list[float] = []
        self.glyph = Glyph()
        self.x = self.y = 0.0
        self.open = self.done = False
        self.first = kind == 2  # the first operator that clears the stack may carry the width
        self.flex: list[tuple[float, float]] | None = None
        self.steps = 0

    def run(self, code: bytes) -> Glyph:
        self.execute(code, 0)
        self.close()
        return self.glyph

    def execute(self, code: bytes, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise CharStringError("subroutines are nested too deeply")
        at = 0
        while at < len(code) and not self.done:
            self.steps += 1
            if self.steps > MAX_STEPS:
                raise CharStringError("the program does not end")
            b = code[at]
            at += 1
            if b >= 32 or b == 28 and self.kind == 2:
                at = self.number(b, code, at)
                continue
            if b == 12:
                b, at = 1200 + code[at] if at < len(code) else 1299, at + 1
            name = OPERATORS.get(b)
            if name in ("hintmask", "cntrmask"):
                self.stem("v")
                at += (len(self.glyph.hints) + 7) // 8
            elif name in ("callsubr", "callgsubr"):
                subrs = self.local if name == "callsubr" else self.shared
                n = int(self.take()) + (_bias(subrs) if self.kind == 2 else 0)
                if not 0 <= n < len(subrs):
                    raise CharStringError(f"no subroutine {n}")
                self.execute(subrs[n], depth + 1)
            elif name == "return":
                return
            elif name is None:
                self.stack.clear()
            else:
                _ACTIONS[name](self)

    def number(self, b: int, code: bytes, at: int) -> int:
        if b == 28:
            value, size = int.from_bytes(code[at : at + 2], "big", signed=True), 2
        elif b < 247:
            value, size = b - 139, 0
        elif b < 255:
            low = code[at] if at < len(code) else 0
            value, size = ((b - 247) * 256 + low + 108 if b < 251 else -(b - 251) * 256 - low - 108), 1
        else:
            value, size = int.from_bytes(code[at : at + 4], "big", signed=True), 4
            value = value / 65536 if self.kind == 2 else value
        self.stack.append(value)
        return at + size

    def take(self) -> float:
        if not self.stack:
            raise CharStringError("stack underflow")
        return self.stack.pop()

    def arguments(self, n: int | None = None) -> list[float]:
        """The whole stack, which is cleared; with n the last n of it, the one before them being the width of a first operator."""
        own, self.stack = self.stack, []
        if n is None:
            return own
        if self.first and len(own) > n:
            self.glyph.width = own[len(own) - n - 1]
        self.first = False
        if len(own) < n:
            raise CharStringError("missing operands")
        return own[len(own) - n :] if n else []

    # outlines

    def close(self) -> None:
        if self.open:
            self.glyph.segments.append(("Z", ()))
        self.open = False

    def move(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        if self.flex is not None:
            self.flex.append((self.x, self.y))
            return
        if self.kind == 2:
            self.close()
        self.glyph.segments.append(("M", ((self.x, self.y),)))
        self.open = True

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.glyph.segments.append(("L", ((self.x, self.y),)))

    def curve(self, *d: float) -> None:
        points = []
        for i in (0, 2, 4):
            self.x, self.y = self.x + d[i], self.y + d[i + 1]
            points.append((self.x, self.y))
        self.glyph.segments.append(("C", tuple(points)))

    def lines(self, horizontal: bool) -> None:
        for d in self.arguments():
            self.line(d if horizontal else 0, 0 if horizontal else d)
            horizontal = not horizontal

    def polyline(self, args: list[float]) -> None:
        for i in range(0, len(args) - 1, 2):
            self.line(args[i], args[i + 1])

    def polycurve(self, args: list[float]) -> None:
        for i in range(0, len(args) - 5, 6):
            self.curve(*args[i : i + 6])

    def curve_line(self) -> None:
        args = self.arguments()
        self.polycurve(args[:-2])
        self.polyline(args[-2:])

    def line_curve(self) -> None:
        args = self.arguments()
        self.polyline(args[:-6])
        self.polycurve(args[-6:])

    def flat_curves(self, horizontal: bool) -> None:
        """Curves that start and end along one axis; a first odd operand is the other axis's offset."""
        args = self.arguments()
        across = args.pop(0) if len(args) % 4 else 0
        for i in range(0, len(args) - 3, 4):
            a, b, c, d = args[i : i + 4]
            self.curve(*((a, across, b, c, d, 0) if horizontal else (across, a, b, c, 0, d)))
            across = 0

    def turning_curves(self, horizontal: bool) -> None:
        """Curves that start along one axis and end along the other, by turns; a last odd operand bends the last one's end."""
        args = self.arguments()
        n = len(args) // 4
        for i in range(n):
            a, b, c, d = args[4 * i : 4 * i + 4]
            last = args[-1] if i == n - 1 and len(args) % 4 else 0
            self.curve(*((a, 0, b, c, last, d) if horizontal else (0, a, b, c, d, last)))
            horizontal = not horizontal

    def flexes(self, *d: float) -> None:
        self.curve(*d[:6])
        self.curve(*d[6:])

    def hflex(self) -> None:
        a = self.arguments(7)
        self.flexes(a[0], 0, a[1], a[2], a[3], 0, a[4], 0, a[5], -a[2], a[6], 0)

    def hflex1(self) -> None:
        a = self.arguments(9)
        self.flexes(a[0], a[1], a[2], a[3], a[4], 0, a[5], 0, a[6], a[7], a[8], -(a[1] + a[3] + a[7]))

    def flex1(self) -> None:
        a = self.arguments(11)
        dx, dy = sum(a[0:10:2]), sum(a[1:10:2])
        self.flexes(*a[:10], *((a[10], -dy) if abs(dx) > abs(dy) else (-dx, a[10])))

    # hints and ends

    def stem(self, axis: str) -> None:
        args = self.arguments()
        if len(args) % 2:
            if self.first:
                self.glyph.width = args[0]
            args = args[1:]
        self.first = False
        at = 0.0
        for i in range(0, len(args), 2):
            self.glyph.hints.append((axis, at + args[i], args[i + 1]))
            at += args[i] + args[i + 1] if self.kind == 2 else 0

    def stem3(self, axis: str) -> None:
        args = self.arguments(6)
        self.glyph.hints += [(axis, args[i], args[i + 1]) for i in (0, 2, 4)]

    def end(self) -> None:
        if len(self.stack) >= 4 and self.kind == 2:
            args = self.arguments(4)
            self.glyph.seac = (args[0], args[1], int(args[2]), int(args[3]))
        elif self.kind == 2:
            self.arguments(0)
        self.done = True

    def bearing(self, two: bool) -> None:
        args = self.arguments(4 if two else 2)
        self.x, self.y = args[0], args[1] if two else 0.0
        self.glyph.width = args[2] if two else args[1]

    def seac(self) -> None:
        _, x, y, base, accent = self.arguments(5)
        self.glyph.seac, self.done = (x, y, int(base), int(accent)), True

    def close_path(self) -> None:
        self.arguments()
        self.close()

    def other(self) -> None:
        """Calls into the PostScript side: flex is 0 to 2, hint replacement 3; others hand their operands back."""
        which, n = int(self.take()), int(self.take())
        args = [self.take() for _ in range(max(n, 0))]
        if which == 1:
            self.flex = []
        elif which == 0 and self.flex is not None:
            points, self.flex = self.flex, None
            if len(points) >= 7:
                self.glyph.segments += [("C", tuple(points[1:4])), ("C", tuple(points[4:7]))]
            self.results = args[1::-1]
        elif which != 2:
            self.results = args[::-1]

    def set_point(self) -> None:
        x, y = self.arguments(2)
        if (x, y) != (self.x, self.y):
            self.line(x - self.x, y - self.y)

    # arithmetic

    def compute(self, n: int, f: Callable[..., float]) -> None:
        args = [self.take() for _ in range(n)][::-1]
        self.stack.append(f(*args))

    def drop(self) -> None:
        """Takes a count and as many values."""
        for _ in range(max(int(self.take()), 0)):
            self.take()

    def put(self) -> None:
        i, v = int(self.take()), self.take()
        if 0 <= i < len(self.storage):
            self.storage[i] = v

    def exchange(self) -> None:
        b, a = self.take(), self.take()
        self.stack += [b, a]

    def copy(self) -> None:
        n = max(int(self.take()), 0)
        if n >= len(self.stack):
            raise CharStringError("stack underflow")
        self.stack.append(self.stack[-1 - n])

    def roll(self) -> None:
        j, n = int(self.take()), int(self.take())
        if n > len(self.stack) or n < 0:
            raise CharStringError("stack underflow")
        if n:
            part, j = self.stack[-n:], j % n
            self.stack[-n:] = part[n - j :] + part[: n - j]

    def duplicate(self) -> None:
        v = self.take()
        self.stack += [v, v]


def _operator(n: int, f: Callable[..., float]):
    return lambda m: m.compute(n, f)


_ACTIONS: dict[str, Callable[[Machine], None]] = {
    "rmoveto": lambda m: m.move(*m.arguments(2)), "hmoveto": lambda m: m.move(m.arguments(1)[0], 0), "vmoveto": lambda m: m.move(0, m.arguments(1)[0]),
    "rlineto": lambda m: m.polyline(m.arguments()), "hlineto": lambda m: m.lines(True), "vlineto": lambda m: m.lines(False),
    "rrcurveto": lambda m: m.polycurve(m.arguments()), "rcurveline": Machine.curve_line, "rlinecurve": Machine.line_curve,
    "hhcurveto": lambda m: m.flat_curves(True), "vvcurveto": lambda m: m.flat_curves(False), "hvcurveto": lambda m: m.turning_curves(True), "vhcurveto": lambda m: m.turning_curves(False),
    "flex": lambda m: m.flexes(*m.arguments(13)[:12]), "hflex": Machine.hflex, "hflex1": Machine.hflex1, "flex1": Machine.flex1,
    "hstem": lambda m: m.stem("h"), "vstem": lambda m: m.stem("v"), "hstemhm": lambda m: m.stem("h"), "vstemhm": lambda m: m.stem("v"),
    "hstem3": lambda m: m.stem3("h"), "vstem3": lambda m: m.stem3("v"), "dotsection": lambda m: m.stack.clear(),
    "endchar": Machine.end, "hsbw": lambda m: m.bearing(False), "sbw": lambda m: m.bearing(True), "seac": Machine.seac, "closepath": Machine.close_path,
    "callothersubr": Machine.other, "pop": lambda m: m.stack.append(m.results.pop(0)) if m.results else None, "setcurrentpoint": Machine.set_point,
    "abs": _operator(1, abs), "add": _operator(2, lambda a, b: a + b), "sub": _operator(2, lambda a, b: a - b), "div": _operator(2, lambda a, b: a / b if b else 0.0),
    "neg": _operator(1, lambda a: -a), "random": _operator(0, lambda: RANDOM), "mul": _operator(2, lambda a, b: a * b), "sqrt": _operator(1, lambda a: math.sqrt(max(a, 0))),
    "drop": Machine.drop, "exch": Machine.exchange, "index": Machine.copy, "roll": Machine.roll, "dup": Machine.duplicate, "put": Machine.put,
    "get": lambda m: m.compute(1, lambda i: m.storage[int(i)] if 0 <= i < len(m.storage) else 0.0),
    "and": _operator(2, lambda a, b: float(bool(a) and bool(b))), "or": _operator(2, lambda a, b: float(bool(a) or bool(b))), "not": _operator(1, lambda a: float(not a)),
    "eq": _operator(2, lambda a, b: float(a == b)), "ifelse": _operator(4, lambda a, b, x, y: a if x <= y else b),
}


def encode(values: Sequence[float | str], kind: int = 2) -> bytes:
    """A program of numbers and operator names; numbers beyond 1131 are in the form of the program's kind."""
    numbers = {v: k for k, v in OPERATORS.items()}
    out = bytearray()
    for v in values:
        if isinstance(v, str):
            n = numbers[v]
            out += bytes([12, n - 1200]) if n >= 1200 else bytes([n])
        elif v == int(v) and -107 <= v <= 107:
            out.append(int(v) + 139)
        elif v == int(v) and 108 <= abs(v) <= 1131:
            out += bytes([(247 if v > 0 else 251) + (int(abs(v)) - 108 >> 8), int(abs(v)) - 108 & 255])
        elif kind == 1:
            out += b"\xff" + int(v).to_bytes(4, "big", signed=True)
        elif v == int(v) and -32768 <= v < 32768:
            out += b"\x1c" + int(v).to_bytes(2, "big", signed=True)
        else:
            out += b"\xff" + round(v * 65536).to_bytes(4, "big", signed=True)
    return bytes(out)


def combine(base: Glyph, accent: Glyph, dx: float, dy: float) -> Glyph:
    """An accented glyph of its two parts."""
    moved = [(k, tuple((x + dx, y + dy) for x, y in ps)) for k, ps in accent.segments]
    return Glyph(base.width, base.segments + moved, base.hints)
