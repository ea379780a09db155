"""Scalar functions: whole-number codes, keys and small arithmetic, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zigzag(c) -> Column:
    c = col(c)
    return F.when(c >= 0, c * 2).otherwise(c * -2 - 1)


def unzigzag(c) -> Column:
    c = col(c)
    c = c.cast("long")
    return F.when(c % 2 == 0, F.shiftright(c, 1)).otherwise(-F.shiftright(c, 1) - 1)


def pin(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def bits(c) -> Column:
    """Binary digits of a whole number; 1 for 0."""
    return F.length(F.bin(col(c).cast("long")))


def next_pow2(c) -> Column:
    """The least power of two that is not below c; 1 for numbers under 2."""
    c = col(c).cast("long")
    return F.when(c < 2, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2.0), bits(c - 1)).cast("long"))


def catmull_rom(x, p0, p1, p2, p3) -> Column:
    x, p0, p1, p2, p3 = (col(c) for c in (x, p0, p1, p2, p3))
    return p1 + x * 0.5 * (p2 - p0 + x * (p0 * 2 - p1 * 5 + p2 * 4 - p3 + x * (p1 * 3 - p2 * 3 + p3 - p0)))


#: Fibonacci numbers from 1, 2 on, all that a long holds.
FIBONACCI = [1, 2]
while FIBONACCI[-1] + FIBONACCI[-2] < 2**63:
    FIBONACCI.append(FIBONACCI[-1] + FIBONACCI[-2])


def truncated_len(v, base) -> Column:
    """Bits of v in 0 .. base - 1 in truncated binary."""
    v, base = col(v).cast("long"), base if isinstance(base, Column) else F.lit(base).cast("long")
    k = bits(base)
    return F.when(v < F.call_function("shiftleft", F.lit(1).cast("long"), k) - base, k - 1).otherwise(k)


def code_len(name: str, c, m: int = 8) -> Column:
    """Bits of one value under a universal code; Elias codes and the code of unary length take values from 1, signed LEB128 any,
    the others from 0. m: the parameter of Golomb codes, the chunk of "chunked", the base of "truncated"."""
    v = col(c).cast("long")
    n = bits(v)
    div = lambda x, d: F.call_function("div", x, F.lit(d).cast("long"))
    if name == "fibonacci":
        return F.size(F.filter(F.array(*map(F.lit, FIBONACCI)), lambda f: f <= v + 1)) + 1
    if name == "elias_gamma":
        return n * 2 - 1
    if name == "elias_delta":
        return n - 1 + bits(n) * 2 - 1
    if name == "elias_omega":
        total, rest = F.lit(1), v
        for _ in range(5):
            total, rest = total + F.when(rest > 1, bits(rest)).otherwise(0), F.greatest(bits(rest) - 1, F.lit(1))
        return total
    if name == "chunked":
        return F.greatest(F.ceil(n / m), F.lit(1)) * (m + 1)
    if name == "chunked_bytes":
        return F.greatest(F.ceil(n / 8), F.lit(1)) * 9
    if name == "unary_length":
        return n * 2 - 1
    if name == "truncated":
        return truncated_len(v, m)
    if name == "stout":  # the chain of lengths ends below 8, which 64 bits need one step for
        return F.when(n < 8, 3).otherwise(bits(n) + 3) + 1 + n
    if name == "golomb":
        return div(v, m) + 1 + truncated_len(v % m, m)
    if name == "exp_golomb":
        return bits(F.shiftright(v, m) + 1) * 2 - 1 + m
    if name == "even_rodeh":
        return F.when(v < 4, 3).when(v < 8, 4).otherwise(n + F.when(n >= 8, bits(n)).otherwise(0) + 4)
    if name == "byte_block":
        return F.when(v < 127, 8).when(v < 16511, 16).otherwise(24)
    if name == "short_block":
        return F.when(v == 0, 1).when(v <= 32, 8).when(v <= 8223, 16).otherwise(24)
    if name == "leb128":
        return F.when(v == 0, 8).otherwise(F.ceil((n + 1) / 7) * 8)
    if name == "leb128_signed":
        rest = F.when(v < 0, F.bitwise_not(v)).otherwise(v)
        return F.when(rest == 0, 8).otherwise(F.ceil((bits(rest) + 1) / 7) * 8)
    raise ValueError(f"no code named {name}")


CODES = ("elias_gamma", "elias_delta", "chunked_bytes", "unary_length", "golomb", "exp_golomb", "byte_block", "short_block", "leb128")
MORE_CODES = ("fibonacci", "elias_omega", "chunked", "truncated", "stout", "even_rodeh", "leb128_signed")


def _spread(c: Column, gap: int, width: int) -> Column:
    """The low bits of c with `gap` zero bits after each."""
    out = F.lit(0).cast("long")
    for k in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), k * (gap + 1)))
    return out


def morton2(x, y) -> Column:
    """Interleaved bits of two 16-bit numbers, x in the even places."""
    return _spread(col(x).cast("long"), 1, 16).bitwiseOR(F.shiftleft(_spread(col(y).cast("long"), 1, 16), 1))


def morton3(x, y, z) -> Column:
    parts = [F.shiftleft(_spread(col(c).cast("long"), 2, 10), k) for k, c in enumerate((x, y, z))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def _gather(c: Column, gap: int, width: int) -> Column:
    out = F.lit(0).cast("long")
    for k in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, k * (gap + 1)).bitwiseAND(F.lit(1)), k))
    return out


def unmorton2(c) -> tuple[Column, Column]:
    c = col(c).cast("long")
    return _gather(c, 1, 16), _gather(F.shiftright(c, 1), 1, 16)


def unmorton3(c) -> tuple[Column, Column, Column]:
    c = col(c).cast("long")
    return tuple(_gather(F.shiftright(c, k), 2, 10) for k in range(3))


def unhilbert(n: int, d: str) -> tuple[Column, Column]:
    """(x, y) at a distance along the curve, as a fold over pairs of bits from the low end."""
    steps = ", ".join(f"{1 << k}L" for k in range(n.bit_length() - 1))
    rx, ry = "(shiftright(a.t, 1) & 1)", "((a.t ^ shiftright(a.t, 1)) & 1)"
    turned = lambda own, other: f"(case when {ry} = 1 then a.{own} when {rx} = 1 then s - 1 - a.{other} else a.{other} end)"
    state = f"named_struct('x', 0L, 'y', 0L, 't', cast({d} as bigint))"
    fold = f"(a, s) -> named_struct('x', {turned('x', 'y')} + s * {rx}, 'y', {turned('y', 'x')} + s * {ry}, 't', shiftright(a.t, 2))"
    return tuple(F.expr(f"aggregate(array({steps}), {state}, {fold}, a -> a.{axis})") for axis in "xy")


def hilbert(n: int, x: str, y: str) -> Column:
    """Distance along the Hilbert curve of an n by n square (n a power of two), as a fold over the bits from the top."""
    steps = ", ".join(str(n >> k) for k in range(1, n.bit_length()))
    state = "named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint), 'd', 0L)"
    rx, ry = "(if((a.x & s) > 0, 1, 0))", "(if((a.y & s) > 0, 1, 0))"
    flip = f"({ry} = 0 and {rx} = 1)"
    new = lambda own, other: f"case when {ry} = 1 then a.{own} when {flip} then {n - 1} - a.{other} else a.{other} end"
    fold = f"(a, s) -> named_struct('x', {new('x', 'y')}, 'y', {new('y', 'x')}, 'd', a.d + cast(s as bigint) * s * ((3 * {rx}) ^ {ry}))"
    return F.expr(f"aggregate(array({steps}), {state.format(x=x, y=y)}, {fold}, a -> a.d)")


def human(c) -> Column:
    """A size in bytes with a unit and at most two decimals, as 1.5kb."""
    c = col(c).cast("double")
    unit = F.when(c < 1024, 0).when(c < 1024**2, 1).when(c < 1024**3, 2).when(c < 1024**4, 3).when(c < 1024**5, 4).otherwise(5)
    number = F.call_function("format_number", F.round(c / F.pow(F.lit(1024.0), unit), 2), F.lit("0.##"))
    return F.concat(number, F.element_at(F.array(*map(F.lit, ("b", "kb", "mb", "gb", "tb", "pb"))), unit + 1))


def big_endian(c) -> Column:
    """The eight bytes of a long, the high one first, as binary."""
    return F.unhex(F.lpad(F.hex(col(c).cast("long")), 16, "0"))


def bin_text(c) -> Column:
    """Eight binary digits of a byte."""
    return F.lpad(F.bin(col(c).cast("long")), 8, "0")


def dc_shift(c, by: float = 128.0, back: bool = False) -> Column:
    """Values around 0 of values around the middle, or back."""
    return col(c) + (by if back else -by)


def catmull_rom2(x, y, samples: list[list]) -> Column:
    """The 4 by 4 samples interpolated along y within each column of rows samples[i], then along x."""
    return catmull_rom(x, *(catmull_rom(y, *row) for row in samples))


def rotate2(x, y, radians) -> tuple[Column, Column]:
    """(x, y) by the rotation's matrix, stored by rows and applied by columns: clockwise for growing angles."""
    x, y, a = col(x), col(y), col(radians)
    return x * F.cos(a) + y * F.sin(a), x * -F.sin(a) + y * F.cos(a)


def invert2(a, b, c, d) -> tuple[Column, Column, Column, Column]:
    """Inverse of a 2 by 2 matrix by rows; null if there is none."""
    a, b, c, d = map(col, (a, b, c, d))
    det = F.lit(1.0) / F.nullif(a * d - b * c, F.lit(0.0))
    return d * det, -b * det, -c * det, a * det


def vector_length(x, y) -> Column:
    return F.sqrt(col(x) * col(x) + col(y) * col(y))


def dot(ax, ay, bx, by) -> Column:
    return col(ax) * col(bx) + col(ay) * col(by)


def cross(ax, ay, bx, by) -> Column:
    return col(ax) * col(by) - col(ay) * col(bx)


def normalized(x, y) -> tuple[Column, Column]:
    """The unit vector; (0, 0) for the zero vector."""
    n = vector_length(x, y)
    return tuple(F.when(n == 0, 0.0).otherwise(col(c) / F.nullif(n, F.lit(0.0))) for c in (x, y))
