"""PDF functions: sampled (0), exponential (2), stitching (3) and calculator (4). ``load`` gives inputs -> outputs, or None."""

from __future__ import annotations

import math
from collections.abc import Callable

from quire.kernels.syntax import END, Reader, Stream, Word

Function = Callable[[list[float]], list[float]]


def _clip(v: list[float], ranges: list[float]) -> list[float]:
    return [min(max(x, a), b) for x, a, b in zip(v, ranges[::2], ranges[1::2])] if ranges else v


def _numbers(doc, v) -> list[float]:
    out = [doc.get(x) for x in doc.list(v)]
    return [float(x) for x in out] if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in out) else []


def load(doc, v, depth: int = 0) -> Function | None:
    """A function object, or an array of functions of one output each."""
    v = doc.get(v)
    if depth > 8:
        return None
    if isinstance(v, list):
        parts = [load(doc, x, depth + 1) for x in v]
        return (lambda xs: [p(xs)[0] for p in parts]) if parts and all(parts) else None
    d = doc.dict(v)
    domain, range_ = _numbers(doc, d.get("Domain")), _numbers(doc, d.get("Range"))
    kind = doc.get(d.get("FunctionType"))
    if len(domain) < 2 or len(domain) % 2:
        return None
    inner = {0: _sampled, 2: _exponential, 3: _stitching, 4: _calculator}.get(kind)
    f = inner(doc, v, d, domain, range_, depth) if inner else None
    return (lambda xs: _clip(f(_clip(list(xs), domain)), range_)) if f else None


def _exponential(doc, v, d, domain, range_, depth) -> Function | None:
    c0, c1 = _numbers(doc, d.get("C0")) or [0.0], _numbers(doc, d.get("C1")) or [1.0]
    n = doc.get(d.get("N"))
    if not isinstance(n, (int, float)) or len(c0) != len(c1):
        return None

    def run(xs: list[float]) -> list[float]:
        t = xs[0] ** n if xs[0] > 0 else (1.0 if n == 0 else 0.0)
        return [a + t * (b - a) for a, b in zip(c0, c1)]

    return run


def _stitching(doc, v, d, domain, range_, depth) -> Function | None:
    parts = [load(doc, x, depth + 1) for x in doc.list(d.get("Functions"))]
    bounds, encode = _numbers(doc, d.get("Bounds")), _numbers(doc, d.get("Encode"))
    if not parts or not all(parts) or len(bounds) != len(parts) - 1 or len(encode) != 2 * len(parts):
        return None
    edges = [domain[0], *bounds, domain[1]]

    def run(xs: list[float]) -> list[float]:
        i = sum(xs[0] >= b for b in bounds)
        a, b = edges[i], edges[i + 1]
        e0, e1 = encode[2 * i : 2 * i + 2]
        return parts[i]([e0 + (xs[0] - a) * (e1 - e0) / (b - a) if b > a else e0])

    return run


def _sampled(doc, v, d, domain, range_, depth) -> Function | None:
    size = [int(x) for x in _numbers(doc, d.get("Size"))]
    bits = doc.get(d.get("BitsPerSample"))
    m, n = len(domain) // 2, len(range_) // 2
    if not isinstance(v, Stream) or len(size) != m or not n or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or min(size) < 1:
        return None
    data = doc.decoded(v) or b""
    encode = _numbers(doc, d.get("Encode")) or [x for s in size for x in (0, s - 1)]
    decode = _numbers(doc, d.get("Decode")) or range_
    top = (1 << bits) - 1

    def sample(i: int) -> float:
        at = i * bits
        chunk = int.from_bytes(data[at // 8 : (at + bits + 7) // 8].ljust((at + bits + 7) // 8 - at // 8, b"\0"), "big")
        return (chunk >> -(at + bits) % 8) & top

    def run(xs: list[float]) -> list[float]:
        at = []
        for i, x in enumerate(xs[:m]):
            a, b = domain[2 * i : 2 * i + 2]
            e0, e1 = encode[2 * i : 2 * i + 2]
            at.append(min(max(e0 + (x - a) * (e1 - e0) / (b - a) if b > a else e0, 0), size[i] - 1))
        out = [0.0] * n
        for corner in range(1 << m):
            weight, index, stride = 1.0, 0, 1
            for i, x in enumerate(at):
                low = min(int(x), size[i] - 2) if size[i] > 1 else 0
                part = x - low
                up = corner >> i & 1
                weight *= part if up else 1 - part
                index += min(low + up, size[i] - 1) * stride
                stride *= size[i]
            if weight:
                for j in range(n):
                    out[j] += weight * sample(index * n + j)
        return [decode[2 * j] + s * (decode[2 * j + 1] - decode[2 * j]) / top for j, s in enumerate(out)]

    return run


def _shift(a: float, b: float) -> float:
    a, b = int(a), int(b)
    return a << b if b >= 0 else a >> -b


_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "idiv": lambda a, b: math.trunc(a / b) if b else 0, "mod": lambda a, b: math.fmod(a, b) if b else 0.0,
    "exp": lambda a, b: float(a) ** b if a > 0 or float(b).is_integer() and a else 0.0, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "bitshift": _shift, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: a and b if isinstance(a, bool) else int(a) & int(b), "or": lambda a, b: a or b if isinstance(a, bool) else int(a) | int(b), "xor": lambda a, b: a != b if isinstance(a, bool) else int(a) ^ int(b),
}
_ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "sqrt": lambda a: math.sqrt(a) if a > 0 else 0.0, "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "cvi": math.trunc, "cvr": float, "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}


def _program(r: Reader, depth: int = 0) -> list | None:
    out: list = []
    while True:
        t = r.next()
        if t is END or depth > 32:
            return None
        if isinstance(t, Word) and t == "{":
            inner = _program(r, depth + 1)
            if inner is None:
                return None
            out.append(inner)
        elif isinstance(t, Word) and t == "}":
            return out
        elif isinstance(t, (int, float, Word)):
            out.append(t)
        else:
            return None


def execute(program: list, stack: list) -> None:
    for i, t in enumerate(program):
        if isinstance(t, list):
            continue  # taken by the if or ifelse that follows
        if not isinstance(t, str):
            stack.append(t)
        elif t in _TWO:
            b, a = stack.pop(), stack.pop()
            stack.append(_TWO[t](a, b))
        elif t in _ONE:
            stack.append(_ONE[t](stack.pop()))
        elif t == "pop":
            stack.pop()
        elif t == "dup":
            stack.append(stack[-1])
        elif t == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif t == "copy":
            n = int(stack.pop())
            stack += stack[len(stack) - n :] if n > 0 else []
        elif t == "index":
            stack.append(stack[-1 - int(stack.pop())])
        elif t == "roll":
            j, n = int(stack.pop()), int(stack.pop())
            if n > 0:
                part = stack[-n:]
                j %= n
                stack[-n:] = part[n - j :] + part[: n - j]
        elif t == "if":
            if stack.pop():
                execute(program[i - 1], stack)
        elif t == "ifelse":
            execute(program[i - 2] if stack.pop() else program[i - 1], stack)
        else:
            raise ValueError(t)


def _calculator(doc, v, d, domain, range_, depth) -> Function | None:
    if not isinstance(v, Stream) or not range_:
        return None
    r = Reader(doc.decoded(v) or b"")
    if r.next() != "{":
        return None
    program = _program(r)
    n = len(range_) // 2
    if program is None:
        return None

    def run(xs: list[float]) -> list[float]:
        stack = list(xs)
        try:
            execute(program, stack)
        except (IndexError, ValueError, OverflowError, TypeError):
            return [0.0] * n
        return [float(x) for x in ([0.0] * n + stack)[-n:]]

    return run
