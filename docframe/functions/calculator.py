"""Function objects as column expressions: sampled, exponential, stitching and calculator programs.

A calculator program is run once, symbolically, when the plan is built: the stack holds columns, so that
stack operators cost nothing at run time and the whole program becomes one expression of the projection.
"""

from __future__ import annotations

import itertools

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp


@dataclass(frozen=True)
class Value:
    """A stack item: a column and its type (int, real or bool), and its constant where that is known."""

    column: Column
    kind: str
    known: float | int | bool | None = None


def constant(v: float | int | bool) -> Value:
    return Value(F.lit(v), "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "real", v)


def _real(v: Value) -> Column:
    return v.column.cast("double") if v.kind == "int" else v.column


def _int(v: Value) -> Column:
    return v.column.cast("int") if v.kind == "real" else v.column


class ProgramError(ValueError):
    pass


def parse(program: str) -> list:
    """Words and numbers; a block in braces is a nested list."""
    root: list = []
    stack = [root]
    for word in re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", " ", program)):
        if word == "{":
            stack.append([])
        elif word == "}":
            if len(stack) < 2:
                raise ProgramError("unbalanced braces")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(int(word) if re.fullmatch(r"[+-]?\d+", word) and abs(int(word)) < 1 << 31 else float(word) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", word) else word)
    if len(stack) != 1:
        raise ProgramError("unbalanced braces")
    return root[0] if len(root) == 1 and isinstance(root[0], list) else root


_NAN, _INF = float("nan"), float("inf")


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: no error at 0."""
    at_zero = F.when((a == 0) | F.isnan(a), _NAN).when(a > 0, _INF).otherwise(-_INF)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _log(x: Column, base10: bool) -> Column:
    return F.when(x == 0, -_INF).when(x < 0, _NAN).otherwise(F.log10(x) if base10 else F.ln(x))


def _arc(num: Column, den: Column) -> Column:
    angle = F.degrees(F.atan(_divide(num, den)))
    return F.when(angle < 0, angle + 360).otherwise(angle)


_REALS1: dict[str, Callable[[Column], Column]] = {
    "neg": lambda x: -x,
    "abs": F.abs,
    "ceiling": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "round": lambda x: F.bround(x, 0),
    "truncate": lambda x: F.signum(x) * F.floor(F.abs(x)),
    "sqrt": lambda x: F.when(x < 0, _NAN).otherwise(F.sqrt(F.abs(x))),
    "sin": lambda x: F.sin(F.radians(x)),
    "cos": lambda x: F.cos(F.radians(x)),
    "ln": lambda x: _log(x, False),
    "log": lambda x: _log(x, True),
}
_REALS2: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": _divide,
    "atan": _arc,
    "exp": lambda a, b: F.pow(a, b),
}
_ORDERS = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_LOGIC = {
    "and": (lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)),
    "or": (lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)),
    "xor": (lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)),
}
_INTS2 = {
    "idiv": lambda a, b: (a / b).cast("int"),
    "mod": lambda a, b: a % b,
}


def _shift(a: Column, by: Column) -> Column:
    """Left for positive counts, else arithmetic right; counts are modulo 32, as 32-bit shifts are."""
    return F.call_function("shiftright", F.call_function("shiftleft", a, F.greatest(by, F.lit(0))), F.greatest(-by, F.lit(0)))


def run(program: str | list, inputs: Sequence[Value]) -> list[Value]:
    """The stack that a program leaves."""
    stack = list(inputs)

    def pop() -> Value:
        if not stack:
            raise ProgramError("stack underflow")
        return stack.pop()

    def count() -> int:
        v = pop()
        if v.known is None:
            raise ProgramError("copy, index and roll need a constant count")
        return int(v.known)

    def step(words: list) -> None:
        at = 0
        while at < len(words):
            word = words[at]
            at += 1
            if isinstance(word, (int, float)):
                stack.append(constant(word))
            elif isinstance(word, list):
                blocks = [word]
                while at < len(words) and isinstance(words[at], list):
                    blocks.append(words[at])
                    at += 1
                verb = words[at] if at < len(words) else None
                at += 1
                if verb not in ("if", "ifelse") or len(blocks) != (1 if verb == "if" else 2):
                    raise ProgramError("a block needs if or ifelse")
                branch(pop(), blocks)
            else:
                operate(word)

    def branch(condition: Value, blocks: list[list]) -> None:
        if condition.known is not None:
            if condition.known:
                step(blocks[0])
            elif len(blocks) > 1:
                step(blocks[1])
            return
        before = list(stack)
        results = []
        for block in [*blocks, []][:2]:
            stack[:] = before
            step(block)
            results.append(list(stack))
        yes, no = results
        if len(yes) != len(no):
            raise ProgramError("branches leave stacks of different sizes")
        merged = []
        for a, b in zip(yes, no):
            if a is b:
                merged.append(a)
            else:
                kind = a.kind if a.kind == b.kind else "real"
                x, y = (_real(a), _real(b)) if kind == "real" else (a.column, b.column)
                merged.append(Value(F.when(condition.column, x).otherwise(y), kind))
        stack[:] = merged

    def operate(word: str) -> None:
        if word in _REALS1:
            stack.append(Value(_REALS1[word](_real(pop())), "real"))
        elif word in _REALS2:
            b, a = pop(), pop()
            stack.append(Value(_REALS2[word](_real(a), _real(b)), "real"))
        elif word in _INTS2:
            b, a = pop(), pop()
            stack.append(Value(_INTS2[word](_int(a), _int(b)), "int"))
        elif word in _ORDERS:
            b, a = pop(), pop()
            stack.append(Value(_ORDERS[word](_real(a), _real(b)), "bool"))
        elif word in ("eq", "ne"):
            b, a = pop(), pop()
            same = a.column.eqNullSafe(b.column) if a.kind == b.kind else F.lit(False)
            stack.append(Value(same if word == "eq" else ~same, "bool"))
        elif word in _LOGIC:
            b, a = pop(), pop()
            logical = b.kind == "bool"
            stack.append(Value(_LOGIC[word][0 if logical else 1](a.column if logical else _int(a), b.column if logical else _int(b)), "bool" if logical else "int"))
        elif word == "not":
            a = pop()
            stack.append(Value(~a.column, "bool") if a.kind == "bool" else Value(F.bitwise_not(_int(a)), "int"))
        elif word == "bitshift":
            by, a = pop(), pop()
            stack.append(Value(_shift(_int(a), _int(by)), "int"))
        elif word in ("cvi", "cvr"):
            a = pop()
            stack.append(Value(_int(a), "int") if word == "cvi" else Value(_real(a), "real"))
        elif word in ("true", "false"):
            stack.append(constant(word == "true"))
        elif word == "pop":
            pop()
        elif word == "exch":
            b, a = pop(), pop()
            stack.extend([b, a])
        elif word == "dup":
            stack.append(pop())
            stack.append(stack[-1])
        elif word == "copy":
            n = count()
            if not 0 <= n <= len(stack):
                raise ProgramError("stack underflow")
            stack.extend(stack[len(stack) - n :])
        elif word == "index":
            n = count()
            if not 0 <= n < len(stack):
                raise ProgramError("stack underflow")
            stack.append(stack[-1 - n])
        elif word == "roll":
            j, n = count(), count()
            if not 0 <= n <= len(stack):
                raise ProgramError("stack underflow")
            if n:
                part = stack[-n:]
                stack[-n:] = part[-(j % n) :] + part[: -(j % n)] if j % n else part
        else:
            raise ProgramError(f"unknown operator {word}")

    step(parse(program) if isinstance(program, str) else program)
    return stack


def clip(values: Sequence[Column], ranges: Sequence[float] | None) -> list[Column]:
    """Each value within its pair of bounds; values without a whole pair stay."""
    pairs = list(zip((ranges or [])[::2], (ranges or [])[1::2]))
    return [clamp(v, float(pairs[i][0]), float(pairs[i][1])) if i < len(pairs) else v for i, v in enumerate(values)]


def calculator(program: str, inputs: Sequence[Column], domain: Sequence[float], range_: Sequence[float]) -> list[Column]:
    left = run(program, [Value(c, "real") for c in clip(inputs, domain)])
    if len(left) != len(range_) // 2:
        raise ProgramError("the program leaves another number of results than its range")
    return clip([_real(v) for v in left], range_)


def exponential(x: Column, c0: Sequence[float] = (0.0,), c1: Sequence[float] = (1.0,), n: float = 1.0, domain: Sequence[float] | None = None, range_: Sequence[float] | None = None) -> list[Column]:
    x = clip([x], domain)[0]
    power = x if n == 1 else F.pow(x, F.lit(float(n)))
    return clip([F.lit(float(a)) + power * (float(b) - float(a)) for a, b in zip(c0, c1)], range_)


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.lit(float(y0)) if x0 == x1 else F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))


def stitching(x: Column, parts: Sequence[Callable[[Column], list[Column]]], bounds: Sequence[float], encode: Sequence[float], domain: Sequence[float]) -> list[Column]:
    """Function of the interval that x lies in; a bound belongs to the interval on its right."""
    x = clip([x], domain)[0]
    edges = [domain[0], *bounds, domain[1]]
    each = [p(interpolate(x, edges[i], edges[i + 1], encode[2 * i], encode[2 * i + 1])) for i, p in enumerate(parts)]
    out = each[-1]
    for i in range(len(bounds) - 1, -1, -1):
        out = [F.when(x < float(bounds[i]), a).otherwise(b) for a, b in zip(each[i], out)]
    return out


def sampled(inputs: Sequence[Column], sizes: Sequence[int], samples: Sequence[float], domain: Sequence[float], outputs: int = 1, range_: Sequence[float] | None = None) -> list[Column]:
    """Multilinear interpolation between the corners of the cell that the inputs lie in; samples run fastest along the first input."""
    low, share = [], []
    for i, (x, n) in enumerate(zip(clip(inputs, domain), sizes)):
        at = clamp(interpolate(x, domain[2 * i], domain[2 * i + 1], 0, n - 1), 0.0, float(n - 1))
        low.append(F.least(F.floor(at).cast("int"), F.lit(max(n - 2, 0))))
        share.append(at - low[-1])
    table = F.array(*(F.lit(float(s)) for s in samples))
    out = []
    for j in range(outputs):
        total = F.lit(0.0)
        for corner in itertools.product((0, 1), repeat=len(sizes)):
            weight, index, stride = F.lit(1.0), F.lit(0), 1
            for k, side in enumerate(corner):
                weight = weight * (share[k] if side else 1 - share[k])
                index = index + F.least(low[k] + side, F.lit(sizes[k] - 1)) * stride
                stride *= sizes[k]
            total = total + weight * F.get(table, index * outputs + j)
        out.append(total)
    return clip(out, range_)


def int_log2(x: Column) -> Column:
    return (F.length(F.bin(x)) - 1).cast("int")


def floor_div(x: Column, y: Column) -> Column:
    return F.floor(_divide(x.cast("double"), y.cast("double"))).cast("int")


def bits_to_bytes(bits: Column) -> Column:
    return F.shiftright(bits + 7, 3)


