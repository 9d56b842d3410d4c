"""Exact algebra for short answers: rational functions over the rationals with square roots, pi, roots and functions as symbols.

A value is a quotient of two polynomials. A polynomial maps monomials to rational coefficients; a monomial is a sorted tuple
of (symbol, exponent). Square roots are written over primes (√12 is 2·√3, √6 is √2·√3) and their squares reduce, so a
constant built from them has one form; pi and infinity are symbols, and so is what is not computed further (a sine, a cube
root of 2), named by the form of its argument. Two values are equal if their cross products are, which needs no division.

An answer is more than a value: an equation (equal up to a constant factor), an inequality (up to a positive factor), a
tuple or interval (by place and bracket), a set or bare list (in any order), a union. What cannot be read raises
NotEvaluable. Sizes are bounded by MOST_CHARS, MOST_TERMS and MOST_EXPONENT, since answers come from models.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce
from itertools import product as combinations_of
from math import comb, factorial, isqrt
from typing import NamedTuple

from quarry.session import ship

MOST_CHARS, MOST_TERMS, MOST_EXPONENT, MOST_DIGITS = 400, 300, 64, 200
#: Degree up to which equations in one unknown are compared and products are checked for complete factors.
MOST_DEGREE = 12

Monomial = tuple[tuple[str, int], ...]
Poly = dict[Monomial, Fraction]
ONE: Monomial = ()


class NotEvaluable(ValueError):
    """The expression is outside the supported algebra."""


class Value(NamedTuple):
    num: Poly
    den: Poly


# --- polynomials -----------------------------------------------------------------------------------------------------


def number(q) -> Poly:
    q = Fraction(q)
    return {ONE: q} if q else {}


def symbol(name: str) -> Poly:
    return {((name, 1),): Fraction(1)}


def plus(a: Poly, b: Poly, k=1) -> Poly:
    """a + k b."""
    out = dict(a)
    for m, c in b.items():
        if total := out.pop(m, 0) + k * c:
            out[m] = total
    if len(out) > MOST_TERMS:
        raise NotEvaluable("terms")
    return out


def _joined(a: Monomial, b: Monomial) -> tuple[Monomial, int]:
    """Product of two monomials, and the whole number that its squared roots leave."""
    powers, factor = dict(a), 1
    for name, n in b:
        powers[name] = powers.get(name, 0) + n
        if name[0] == "√" and powers[name] > 1:
            factor *= int(name[1:]) ** (powers[name] // 2)
            powers[name] %= 2
        if abs(powers[name]) > MOST_EXPONENT:
            raise NotEvaluable("exponent")
    return tuple(sorted((name, n) for name, n in powers.items() if n)), factor


def times(a: Poly, b: Poly) -> Poly:
    out: Poly = {}
    for (m, x), (n, y) in combinations_of(a.items(), b.items()):
        joined, factor = _joined(m, n)
        out[joined] = out.get(joined, Fraction(0)) + x * y * factor
        if len(out) > MOST_TERMS or max(abs(out[joined].numerator), out[joined].denominator).bit_length() > 4 * MOST_DIGITS:
            raise NotEvaluable("size")
    return {m: c for m, c in out.items() if c}


def unknowns(a: Poly) -> set[str]:
    """Symbols of a polynomial that stand for unknown numbers: letters, with or without an index."""
    return {name for m in a for name, _ in m if name[0].isalpha() and "(" not in name and name != "π"}


def rational(a: Poly) -> Fraction | None:
    return a.get(ONE, Fraction(0)) if set(a) <= {ONE} else None


def coefficients(a: Poly) -> tuple[list[Fraction], str] | None:
    """Coefficients from degree 0 upwards, and the unknown, of a polynomial in one unknown over the rationals."""
    names = {name for m in a for name, _ in m}
    if len(names) != 1 or names != unknowns(a):
        return None
    degree = {m: (m[0][1] if m else 0) for m in a}
    out = [Fraction(0)] * (max(degree.values()) + 1)
    for m, c in a.items():
        out[degree[m]] = c
    return out, names.pop()


def text_of(a: Poly) -> str:
    return "+".join(f"{c}" + "".join(f"*{name}^{n}" for name, n in m) for m, c in sorted(a.items())) or "0"


# --- values ----------------------------------------------------------------------------------------------------------


def whole(a: Poly) -> Value:
    return Value(a, number(1))


def add(a: Value, b: Value, k=1) -> Value:
    if a.den == b.den:
        return Value(plus(a.num, b.num, k), a.den)
    return Value(plus(times(a.num, b.den), times(b.num, a.den), k), times(a.den, b.den))


def multiply(a: Value, b: Value) -> Value:
    return Value(times(a.num, b.num), times(a.den, b.den))


def inverse(a: Value) -> Value:
    if not a.num:
        raise NotEvaluable("division by zero")
    if len(a.num) == 1 and (q := rational(a.num)):
        return Value(times(a.den, number(1 / q)), number(1))
    return Value(a.den, a.num)


def power(a: Value, n: int) -> Value:
    if abs(n) > MOST_EXPONENT:
        raise NotEvaluable("exponent")
    return reduce(multiply, [a if n >= 0 else inverse(a)] * abs(n), whole(number(1)))


def equal(a: Value, b: Value) -> bool:
    return times(a.num, b.den) == times(b.num, a.den)


def fraction_of(a: Value) -> Fraction | None:
    """The rational number that a value is, if it is one."""
    p, q = rational(a.num), rational(a.den)
    return p / q if p is not None and q else None


def name_of(a: Value) -> str:
    """One form for equal values in most cases: the denominator's constant goes into the numerator."""
    q = rational(a.den)
    return text_of(times(a.num, number(1 / q))) if q else f"{text_of(a.num)}|{text_of(a.den)}"


def _squarefree(n: int) -> tuple[int, list[int]]:
    """s and primes with n = s² · product of the primes, by trial division; a large rest counts as one prime."""
    square, primes, p = 1, [], 2
    while p * p <= n and p < 100_000:
        while n % (p * p) == 0:
            square, n = square * p, n // (p * p)
        if n % p == 0:
            primes.append(p)
            n //= p
        p += 1
    if n > 1:
        s = isqrt(n)
        square, primes = (square * s, primes) if s * s == n else (square, [*primes, n])
    return square, primes


def root(a: Value, n: int = 2) -> Value:
    """The n-th root: exact for perfect powers, over primes for square roots of rationals, else a symbol."""
    q = fraction_of(a)
    if q is not None and (q >= 0 or n % 2):
        sign, p = (-1 if q < 0 else 1), abs(q)
        exact = [round(x ** (1 / n)) if x < 10**15 else None for x in (p.numerator, p.denominator)]
        if None not in exact and Fraction(exact[0] ** n, exact[1] ** n) == p:
            return whole(number(Fraction(sign * exact[0], exact[1])))
        if n == 2:
            square, primes = _squarefree(p.numerator * p.denominator)
            return whole({tuple((f"√{x}", 1) for x in sorted(primes, key=str)): Fraction(square, p.denominator)})
    return whole(symbol(f"root{n}({name_of(a)})"))


# --- reading ---------------------------------------------------------------------------------------------------------

#: Layout that has no meaning, functions that stay symbols, letters by name, signs of relations.
LAYOUT = re.compile(r"\\(?:left|right|bigl?|bigr?|Bigl?|Bigr?|displaystyle|textstyle|limits|quad|qquad)(?![A-Za-z])|\\[,;:! ]|[$~]")
DEGREES = re.compile(r"\^\s*\{?\s*\\circ\s*\}?|\\(?:circ|degrees?)(?![A-Za-z])")
UNITS = re.compile(r"\\(?:text|mathrm)\s*\{[~\s]*(?:mm|cm|km|m|mg|kg|g|s|ft|in|yd)[~\s]*\}")
FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "ln", "log", "exp"}
GREEK = {"alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "rho", "sigma", "tau", "phi", "varphi", "omega"}
RELATIONS = {"=": "=", "<": "<", ">": ">", "≤": "<=", "≥": ">=", "\\le": "<=", "\\leq": "<=", "\\leqslant": "<=", "\\ge": ">=", "\\geq": ">=", "\\geqslant": ">=", "\\lt": "<", "\\gt": ">"}
_SPELLED = {"<=": "≤", ">=": "≥", "−": "-", "–": "-", "×": "*", "·": "*", "÷": "/", "π": r"\pi ", "√": r"\sqrt ", "∞": r"\infty ", "∪": r"\cup ", "％": "%", "dfrac": "frac", "tfrac": "frac", "cfrac": "frac"}
_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\(?:[A-Za-z]+|.)|\S)")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "\\{": "\\}"}, {")", "]", "}", "\\}"}


def tokens(text: str) -> list[str]:
    if not text or len(text) > MOST_CHARS:
        raise NotEvaluable("length")
    for sign, plain in _SPELLED.items():
        text = text.replace(sign, plain)
    text = UNITS.sub(" ", LAYOUT.sub(" ", DEGREES.sub("°", text)))
    if re.fullmatch(r"\s*[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*", text):
        text = text.replace(",", "")
    return _TOKEN.findall(text)


class Reader:
    """Reads one expression from tokens, by precedence: sums, products (also by juxtaposition), signs, powers, atoms."""

    def __init__(self, own: list[str]):
        self.own, self.at = list(own), 0

    def seen(self) -> str:
        return self.own[self.at] if self.at < len(self.own) else ""

    def next(self) -> str:
        self.at += 1
        return self.own[self.at - 1] if self.at <= len(self.own) else ""

    def skip(self, *signs: str) -> str:
        return self.next() if self.seen() in signs and self.seen() else ""

    def all(self) -> Value:
        out = self.sum()
        if self.seen():
            raise NotEvaluable(f"unread: {self.seen()}")
        return out

    def sum(self) -> Value:
        out = self.product()
        while sign := self.skip("+", "-"):
            out = add(out, self.product(), 1 if sign == "+" else -1)
        return out

    def product(self) -> Value:
        out = self.signed()
        while True:
            if self.skip("*", "\\cdot", "\\times", "\\ast"):
                out = multiply(out, self.signed())
            elif self.skip("/", "\\div"):
                out = multiply(out, inverse(self.signed()))
            elif self.begins():
                out = multiply(out, self.raised())
            else:
                return out

    def begins(self) -> bool:
        """Whether the next token begins an atom that multiplies what stands before it."""
        t = self.seen()
        return bool(t) and (t[0].isalnum() or t == "°" or t[0] == "." and len(t) > 1 or t in _OPEN or t[0] == "\\" and (t[1:] in FUNCTIONS | GREEK or t in ("\\frac", "\\sqrt", "\\pi", "\\infty", "\\binom")))

    def signed(self) -> Value:
        negative = False
        while sign := self.skip("+", "-"):
            negative ^= sign == "-"
        out = self.raised()
        return multiply(whole(number(-1)), out) if negative else out

    def raised(self) -> Value:
        out = self.atom()
        while True:
            if self.skip("^"):
                exponent = self.argument(signed=True)
                q = fraction_of(exponent)
                if q is None:
                    out = whole(symbol(f"power({name_of(out)};{name_of(exponent)})"))
                else:
                    out = power(out if q.denominator == 1 else root(out, q.denominator), q.numerator)
            elif self.skip("!"):
                n = fraction_of(out)
                if n is None or n.denominator != 1 or not 0 <= n <= 100:
                    raise NotEvaluable("factorial")
                out = whole(number(factorial(int(n))))
            elif self.skip("%", "\\%"):
                out = multiply(out, whole(number(Fraction(1, 100))))
            else:
                return out

    def argument(self, signed: bool = False) -> Value:
        """What a command or an exponent takes: a group, or one token (of a number its first digit)."""
        if signed and self.skip("-"):
            return multiply(whole(number(-1)), self.argument())
        if self.seen()[:1].isdigit() and len(self.seen()) > 1 and not signed:
            first = self.own[self.at]
            self.own[self.at : self.at + 1] = [first[0], first[1:]]
        return self.atom()

    def group(self) -> Value:
        close = _OPEN[self.next()]
        out = self.sum()
        if self.next() != close:
            raise NotEvaluable("open group")
        return out

    def index(self) -> str:
        """The index of a letter, as text."""
        if not self.skip("_"):
            return ""
        if not self.skip("{"):
            return "_" + self.next()
        out = "_"
        while self.seen() not in ("}", ""):
            out += self.next()
        self.next()
        return out

    def atom(self) -> Value:
        t = self.seen()
        if t in _OPEN:
            return self.group()
        self.next()
        if t[:1].isdigit() or t[:1] == "." and len(t) > 1:
            if len(t) > MOST_DIGITS:
                raise NotEvaluable("digits")
            out = whole(number(t))
            if t.isdigit() and self.seen() == "\\frac" and self.own[self.at + 1 : self.at + 2] and self.own[self.at + 1][:1] in "{0123456789":
                part = self.raised()  # a mixed number
                q = fraction_of(part)
                return add(out, part) if q is not None and 0 < q < 1 else multiply(out, part)
            return out
        if t.isalpha() and len(t) == 1:
            return whole(symbol(t + self.index()))
        if t == "°":
            return whole(symbol(t))
        if t == "|":
            inside = self.sum()
            if self.next() != "|":
                raise NotEvaluable("open bars")
            q = fraction_of(inside)
            return whole(symbol(f"abs({name_of(inside)})") if q is None else number(abs(q)))
        return self.command(t[1:]) if t[:1] == "\\" and len(t) > 1 else self.fail(t)

    def fail(self, what: str):
        raise NotEvaluable(f"symbol: {what}")

    def command(self, name: str) -> Value:
        if name == "frac":
            above = self.argument()
            return multiply(above, inverse(self.argument()))
        if name == "sqrt":
            n = self.group() if self.seen() == "[" else whole(number(2))
            q = fraction_of(n)
            if q is None or q.denominator != 1 or not 2 <= q <= 20:
                raise NotEvaluable("root")
            return root(self.argument(), int(q))
        if name == "binom":
            n, k = (fraction_of(self.argument()) for _ in "nk")
            if n is None or k is None or n.denominator != 1 or k.denominator != 1 or not 0 <= k <= n <= 200:
                raise NotEvaluable("binomial")
            return whole(number(comb(int(n), int(k))))
        if name in ("pi", "infty"):
            return whole(symbol("π" if name == "pi" else "∞"))
        if name in GREEK:
            return whole(symbol(name + self.index()))
        if name in FUNCTIONS:
            base = self.index() if name == "log" else ""
            n = self.argument(signed=True) if self.skip("^") else None
            own = whole(symbol(f"{name}{base}({name_of(self.raised())})"))
            return own if n is None else power(own, int(fraction_of(n) or self.fail(name)))
        return self.fail(name)


# --- answers ---------------------------------------------------------------------------------------------------------


class Shape(NamedTuple):
    """kind: value, equation, inequality, list (with its brackets), union."""

    kind: str
    content: object
    mark: str = ""


def _split(own: list[str], signs) -> list[list[str]]:
    """Token lists between signs that stand outside of all brackets; the signs stand alone in between."""
    out, depth = [[]], 0
    for i, t in enumerate(own):
        opens = t in _OPEN or t == "[" and own[i - 1 : i] != ["\\sqrt"]
        depth += opens - (t in _CLOSE)
        if depth == 0 and t in signs:
            out += [[t], []]
        else:
            out[-1].append(t)
    return out


def _enclosed(own: list[str]) -> bool:
    """Whether the first bracket closes at the last token; brackets of intervals may differ."""
    depth = 0
    for i, t in enumerate(own):
        depth += (t in _OPEN) - (t in _CLOSE)
        if depth == 0:
            return i == len(own) - 1 and i > 0
    return False


def shape(text: str) -> Shape:
    """What an answer is; NotEvaluable if it cannot be read."""
    try:
        return _shape(tokens(text))
    except (RecursionError, ZeroDivisionError, OverflowError, IndexError, KeyError) as e:
        raise NotEvaluable(str(e)) from e


def _shape(own: list[str]) -> Shape:
    unions = _split(own, {"\\cup"})
    if len(unions) > 1:
        return Shape("union", [_shape(x) for x in unions[::2]])
    commas = _split(own, {","})
    if len(commas) > 1:
        return Shape("list", [_shape(x) for x in commas[::2]], "any")
    if "\\pm" in own:
        return Shape("list", [_shape([sign if t == "\\pm" else t for t in own]) for sign in "+-"], "any")
    if own[1:2] == ["\\in"]:
        own = own[2:]
    sides = _split(own, RELATIONS)
    if len(sides) > 1:
        return _relation([Reader(x).all() for x in sides[::2]], [RELATIONS[x[0]] for x in sides[1::2]])
    if own and own[0] in _OPEN and _enclosed(own):
        inner = _split(own[1:-1], {","})
        if len(inner) > 1 or own[0] == "\\{":
            mark = "any" if own[0] == "\\{" else own[0] + own[-1]
            return Shape("list", [_shape(x) for x in inner[::2]], mark)
    return Shape("value", Reader(own).all())


def _relation(sides: list[Value], signs: list[str]) -> Shape:
    if len(sides) > 2:
        if set(signs) == {"="}:
            return Shape("chain", sides)
        pairs = [_relation(list(x), [s]) for x, s in zip(zip(sides, sides[1:]), signs)]
        return Shape("list", pairs, "any")
    a, b = sides
    if any(rational(x.den) is None for x in sides):
        raise NotEvaluable("unknown denominators")
    difference = add(a, b, -1)
    poly = times(difference.num, number(1 / rational(difference.den)))
    if signs[0] == "=":
        assigned = next((x for x, y in ((b, a), (a, b)) if len(y.num) == 1 and len(unknowns(y.num)) == 1 and y == whole(symbol(min(unknowns(y.num)))) and not unknowns(x.num) & unknowns(y.num)), None)
        return Shape("equation", (poly, assigned))
    if signs[0][0] == ">":
        poly = times(poly, number(-1))
    return Shape("inequality", poly, signs[0][1:])


def proportional(a: Poly, b: Poly, positive: bool = False) -> bool:
    """Whether one polynomial is a constant (positive if asked for) times the other."""
    if not a or not b:
        return a == b
    x, y = a[max(a)], b.get(max(a))
    return y is not None and (not positive or x * y > 0) and times(a, number(y)) == times(b, number(x))


def same(a: Shape, b: Shape) -> bool:
    """Whether two answers say the same. A bare value and an equation letter = value do; so do lists of one element and it."""
    if a.kind == b.kind == "value":
        return equal(a.content, b.content)
    if a.kind == b.kind == "equation":
        return proportional(a.content[0], b.content[0])
    if {a.kind, b.kind} == {"equation", "value"}:
        equation, value = (a, b) if a.kind == "equation" else (b, a)
        return equation.content[1] is not None and equal(equation.content[1], value.content)
    if a.kind == b.kind == "inequality":
        return a.mark == b.mark and proportional(a.content, b.content, positive=True)
    if "list" in (a.kind, b.kind) and a.kind != b.kind:
        one, other = (a, b) if a.kind == "list" else (b, a)
        return one.mark == "any" and len(one.content) == 1 and same(one.content[0], other)
    if a.kind != b.kind or a.kind in ("value", "equation", "inequality"):
        return False
    if a.kind == "chain":
        return all(equal(x, y) for x, y in zip(a.content, b.content)) and len(a.content) == len(b.content)
    if a.kind == "list" and a.mark != b.mark:
        return False
    if a.kind == "list" and a.mark != "any":
        return len(a.content) == len(b.content) and all(map(same, a.content, b.content))
    return all(any(same(x, y) for y in q.content) for p, q in ((a, b), (b, a)) for x in p.content)


# --- factors ---------------------------------------------------------------------------------------------------------


def factor_bases(text: str) -> list[Value]:
    """Bases of the factors of a product; a sum is one factor."""
    reader, out = Reader(tokens(text)), []
    while reader.skip("-", "+"):
        pass
    while reader.seen():
        if reader.skip("*", "\\cdot", "\\times"):
            continue
        if reader.seen() in ("+", "-"):
            return [Reader(tokens(text)).all()]
        out.append(reader.atom())
        if reader.skip("^"):
            q = fraction_of(reader.argument(signed=True))
            if q is None or q.denominator != 1 or q <= 0:
                raise NotEvaluable("exponent of a factor")
    return out


def _at(own: list[int], x: Fraction) -> Fraction:
    return reduce(lambda total, c: total * x + c, reversed(own), Fraction(0))


def _divisors(n: int) -> list[int]:
    if n > 10**10:
        raise NotEvaluable("large coefficient")
    return [d for k in range(1, isqrt(n) + 1) if n % k == 0 for d in {k, n // k}]


def _degrees_modulo(own: list[int], p: int) -> set[int] | None:
    """Degrees that factors of a polynomial can have by its factors modulo p; None where p says nothing."""

    def trim(a):
        while a and a[-1] % p == 0:
            a = a[:-1]
        return [c % p for c in a]

    def rest(a, b):
        a, inverse_lead = trim(a), pow(b[-1], -1, p)
        while len(a) >= len(b):
            k = a[-1] * inverse_lead % p
            a = trim([c - k * b[i - len(a) + len(b)] if i >= len(a) - len(b) else c for i, c in enumerate(a)])
        return a

    def quotient(a, b):
        a, out, inverse_lead = trim(a), [0] * max(len(trim(a)) - len(b) + 1, 0), pow(b[-1], -1, p)
        while len(a) >= len(b):
            k, at = a[-1] * inverse_lead % p, len(a) - len(b)
            out[at] = k
            a = trim([c - k * b[i - at] if i >= at else c for i, c in enumerate(a)])
        return out

    def common(a, b):
        while b:
            a, b = b, rest(a, b)
        return a

    def product(a, b, modulus):
        out = [0] * (len(a) + len(b) - 1) if a and b else []
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i + j] = (out[i + j] + x * y) % p
        return rest(out, modulus)

    f = trim(own)
    if len(f) != len(own) or len(common(f, trim([i * c for i, c in enumerate(f)][1:]))) != 1:
        return None
    degrees, d, x = [], 0, [0, 1]
    frobenius = rest(x, f)
    while len(f) - 1 >= 2 * (d + 1):
        d += 1
        result, base, n = [1], frobenius, p
        while n:
            result = product(result, base, f) if n & 1 else result
            base, n = product(base, base, f), n >> 1
        frobenius = result
        difference = trim([a - b for a, b in zip(frobenius + [0] * 2, (x + [0] * len(frobenius))[: len(frobenius) + 2])])
        found = common(f, difference) if difference else f
        if len(found) > 1:
            degrees += [d] * ((len(found) - 1) // d)
            f = quotient(f, found)
            if len(f) > 1:
                frobenius = rest(frobenius, f)
    if len(f) > 1:
        degrees.append(len(f) - 1)
    sums = {0}
    for n in degrees:
        sums |= {s + n for s in sums}
    return sums


def irreducible(own: list[Fraction]) -> bool | None:
    """Whether a polynomial (coefficients from degree 0) has no factors over the rationals; None if that stays open."""
    scale = reduce(lambda a, q: a * q.denominator, own, 1)
    f = [int(c * scale) for c in own]
    degree = len(f) - 1
    if degree <= 1:
        return True
    if f[0] == 0 or any(_at(f, Fraction(s * p, q)) == 0 for p in _divisors(abs(f[0])) for q in _divisors(abs(f[-1])) for s in (1, -1)):
        return False
    if degree <= 3:
        return True
    possible = set(range(2, degree - 1))
    for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if (sums := _degrees_modulo(f, p)) is not None:
            possible &= sums
    if not possible:
        return True
    values = [_at(f, Fraction(x)) for x in (0, 1, -1)]
    for a, b, c in combinations_of(*[[s * d for d in _divisors(abs(int(v))) for s in (1, -1)] for v in values]):
        lead = Fraction(b + c, 2) - a
        if lead and not _remainder(f, [Fraction(a), Fraction(b - c, 2), lead]):
            return False
    return True if degree <= 5 else None


def _remainder(f: list[int], g: list[Fraction]) -> list[Fraction]:
    rest = [Fraction(c) for c in f]
    while len(rest) >= len(g):
        k, at = rest[-1] / g[-1], len(rest) - len(g)
        rest = [c - k * g[i - at] if i >= at else c for i, c in enumerate(rest)][:-1]
    return [c for c in rest if c]


def factored(text: str) -> bool | None:
    """Whether a product in one unknown is complete over the rationals; None where that is not decided here."""
    try:
        product = Reader(tokens(text)).all()
        if rational(product.den) is None or (own := coefficients(product.num)) is None or not 1 <= len(own[0]) - 1 <= MOST_DEGREE:
            return None
        decided = []
        for base in factor_bases(text):
            if fraction_of(base) is not None:
                continue
            factor = coefficients(times(base.num, number(1 / (rational(base.den) or 1))))
            decided.append(None if factor is None else irreducible(factor[0]))
    except (NotEvaluable, RecursionError, ZeroDivisionError, OverflowError):
        return None
    return False if False in decided else None if None in decided else True


ship(__name__)
