"""Equality of formulas by value: a parser of plain and LaTeX formulas that computes them at fixed points.

Two formulas are equal if they have the same free letters' values at every point, up to a
relative error. So equal forms of one expression agree, whatever their shape; expressions that
differ anywhere near the points don't. Nothing is evaluated but by this parser.
"""

from __future__ import annotations

import cmath
import math
import re

#: Relative error of equal values.
ERROR = 1e-9
#: Values of letters: for each point a start and a step by the letter's place.
POINTS = ((0.7310585786, 0.1307), (1.6180339887, 0.0919), (2.7755575616, -0.0733))
#: Depth of brackets and length of powers that are worked out.
DEPTH, POWER = 60, 4096

_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\[A-Za-z]+|\\.|[A-Za-z]+|π|√|∞|.)", re.DOTALL)
_GROUPED = re.compile(r"(?<![\d.])\d{1,3}(?:,\d{3})+(?![\d,])")
_TEXT = re.compile(r"\\(?:text|textbf|mathrm|mathbf|operatorname|mbox)\s*\{([^{}]*)\}")
#: Commands that say nothing about a value, commands for an operator, and functions.
_SILENT = ("\\left", "\\right", "\\,", "\\;", "\\:", "\\!", "\\ ", "\\quad", "\\qquad", "\\displaystyle", "\\$", "$", "\\%", "%", "\\degree")
_SIGNS = {"\\cdot": "*", "\\times": "*", "·": "*", "×": "*", "\\div": "/", "÷": "/", "−": "-", "\\{": "{set", "\\}": "set}", "\\lbrace": "{set", "\\rbrace": "set}", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "√": "\\sqrt", "π": "\\pi", "∞": "\\infty", "**": "^"}
_FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "ln": cmath.log, "log": cmath.log10, "exp": cmath.exp}
_CLOSES = {"(": ")", "[": "]", "{": "}"}


class NotAFormula(ValueError):
    pass


def tokens(text: str) -> list[str]:
    text = _TEXT.sub(r" \1 ", text)
    text = _GROUPED.sub(lambda m: m[0].replace(",", ""), text).replace("**", "^")
    text = re.sub(r"\^\s*(?:\{\s*)?\\circ(?:\s*\})?", "", text)
    out = []
    for t in _TOKEN.findall(text.strip()):
        t = _SIGNS.get(t, t)
        if t in _SILENT or t.isspace():
            continue
        if t.isalpha() and t.isascii() and t not in _FUNCTIONS:
            if len(t) > 2 and t not in ("sqrt", "pi"):
                # a word, not a product of letters
                raise NotAFormula(t)
            out += ["\\" + t] if t in ("pi",) else list(t)
            continue
        out.append("\\" + t if t in _FUNCTIONS or t == "sqrt" else t)
    return out


class _Parser:
    """Values of one list of tokens at one point."""

    def __init__(self, listed: list[str], point: tuple[float, float]):
        self.listed, self.at, self.point, self.depth = listed, 0, point, 0

    def peek(self) -> str:
        return self.listed[self.at] if self.at < len(self.listed) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or (wanted is not None and t != wanted):
            raise NotAFormula(f"{t or 'end'} for {wanted}")
        self.at += 1
        return t

    def whole(self) -> complex:
        value = self.sum()
        if self.peek():
            raise NotAFormula(self.peek())
        return value

    def sum(self) -> complex:
        value = self.product()
        while self.peek() in ("+", "-"):
            value = value + self.product() if self.take() == "+" else value - self.product()
        return value

    def product(self) -> complex:
        value = self.signed()
        while True:
            t = self.peek()
            if t == "*":
                self.take()
                value *= self.signed()
            elif t == "/":
                self.take()
                value /= self.signed()
            elif t and (t[0].isdigit() or t[0] == "." or t.isalpha() or t in ("(", "[", "{", "\\frac", "\\sqrt", "\\pi") or t[1:] in _FUNCTIONS):
                value *= self.power()
            else:
                return value

    def signed(self) -> complex:
        if self.peek() in ("+", "-"):
            return -self.signed() if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> complex:
        value = self.atom()
        while self.peek() == "!":
            self.take()
            if abs(value.imag) > 0 or value.real != int(value.real) or not 0 <= value.real <= 150:
                raise NotAFormula("factorial")
            value = complex(math.factorial(int(value.real)))
        if self.peek() == "^":
            self.take()
            by = self.signed() if self.peek() in ("+", "-") else self.power()
            if abs(by) > POWER:
                raise NotAFormula("power")
            value = value**by
        return value

    def group(self) -> complex:
        opening = self.take()
        self.depth += 1
        if opening not in _CLOSES or self.depth > DEPTH:
            raise NotAFormula(opening)
        value = self.sum()
        self.take(_CLOSES[opening])
        self.depth -= 1
        return value

    def argument(self) -> complex:
        """A group, or the next digit or letter, as LaTeX has it."""
        t = self.peek()
        if t == "{":
            return self.group()
        if t.isdigit() and len(t) > 1:
            self.listed[self.at] = t[1:]
            return complex(int(t[0]))
        return self.atom()

    def atom(self) -> complex:
        t = self.peek()
        if t in _CLOSES:
            return self.group()
        self.take()
        if t[0].isdigit() or t[0] == ".":
            return complex(float(t))
        if t == "\\frac":
            above = self.argument()
            return above / self.argument()
        if t == "\\sqrt":
            degree = self.group() if self.peek() == "[" else complex(2)
            value = self.argument()
            if value.imag == 0 and value.real < 0 and degree == 3:
                return -((-value) ** (1 / degree))
            return value ** (1 / degree)
        if t == "\\pi":
            return complex(math.pi)
        if t[1:] in _FUNCTIONS and t[0] == "\\":
            power = None
            if self.peek() == "^":
                self.take()
                power = self.argument()
            value = _FUNCTIONS[t[1:]](self.group() if self.peek() in _CLOSES else self.power())
            return value if power is None else value**power
        if len(t) == 1 and t.isalpha():
            if t in "ei":
                return complex(math.e) if t == "e" else 1j
            start, step = self.point
            return complex(start + step * (ord(t) - ord("A")))
        raise NotAFormula(t)


def parts(listed: list[str]) -> tuple[str, list[list[str]]]:
    """The kind of brackets around a list and its elements; one element without a kind if it isn't a list."""
    kind, inner = "", listed
    if listed and listed[0] == "{set" and listed[-1] == "set}":
        kind, inner = "{}", listed[1:-1]
    elif len(listed) > 1 and listed[0] in "([" and listed[-1] in ")]":
        kind, inner = listed[0] + listed[-1], listed[1:-1]
    out, depth = [[]], 0
    for t in inner:
        depth += (t in ("(", "[", "{", "{set")) - (t in (")", "]", "}", "set}"))
        if depth < 0:
            # the brackets at both ends don't belong together
            return "", [listed]
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    if len(out) == 1 and kind != "{}":
        return "", [listed]
    return kind, out


def _side(listed: list[str]) -> list[str]:
    """What a letter is said to be equal to."""
    if listed.count("=") == 1 and listed.index("=") == 1 and listed[0].isalpha():
        return listed[2:]
    return listed


def _values(listed: list[str]) -> list[complex]:
    if listed in (["\\infty"], ["+", "\\infty"]):
        return [complex(math.inf)] * len(POINTS)
    if listed == ["-", "\\infty"]:
        return [complex(-math.inf)] * len(POINTS)
    return [_Parser(list(listed), p).whole() for p in POINTS]


def _close(a: list[complex], b: list[complex]) -> bool:
    return all(x == y or abs(x - y) <= ERROR * max(abs(x), abs(y)) for x, y in zip(a, b, strict=True))


def same(a: str, b: str) -> bool:
    """Whether two texts are formulas, or lists or sets of such, of one value. Anything that can't be read isn't equal."""
    try:
        left, right = (parts(_side(tokens(x.strip().strip("$").rstrip(".")))) for x in (a, b))
        if left[0] != right[0] or len(left[1]) != len(right[1]):
            return False
        rest = [_values(_side(x)) for x in right[1]]
        for i, x in enumerate(left[1]):
            own = _values(_side(x))
            # sets in any order, anything else place by place
            found = next((k for k, y in enumerate(rest) if _close(own, y) and (left[0] == "{}" or k == 0)), None)
            if found is None:
                return False
            del rest[found]
        return True
    except (NotAFormula, ValueError, ArithmeticError, RecursionError):
        return False
