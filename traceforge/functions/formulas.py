"""Identity of formulas, tested at hashed points modulo two primes."""

from __future__ import annotations

import re
from hashlib import blake2b
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# The first two primes above 2^30 that leave 7 modulo 8 and have 2 to 23 as squares,
# so that roots of small whole numbers multiply as they should.
PRIMES = (1073761391, 1073772311)
MODULUS = PRIMES[0] * PRIMES[1]
# --- fixed values: how formulas are written
NAMED = ["\\sin", "\\cos", "\\tan", "\\log", "\\ln", "\\exp"]
TIMES, OVER, UNION = ["*", "\\cdot", "\\times"], ["/", "\\div"], "\\cup"
BRACKETS = {"(": ")]", "[": ")]", "{": "}", "«": "»", "": ""}
TOKEN = re.compile(r"\d+(?:\.\d+)?|\.\d+|\\[a-z]+|[a-z]{3,}|[a-z](?:_(?:[a-z0-9]|\{[a-z0-9]+\}))?|.", re.DOTALL)
NAME = re.compile(r"\\[a-z]+|[a-z]+|[a-z]_.+")
# Longest formula that is read, in characters, deepest brackets, largest exponent that is multiplied out.
MOST_CHARACTERS, DEEPEST, MOST_EXPONENT = 400, 40, 1_000_000


class _Unreadable(Exception):
    """The text is no formula, or holds what is not read."""


class _Formula:
    """Value of a formula modulo both primes. Parts return a number and, for one whole number, that number."""

    def __init__(self, text: str) -> None:
        self.tokens, self.at, self.depth = [*TOKEN.findall(text), ""], 0, 0

    @staticmethod
    def hashed(*parts: object) -> int:
        return int.from_bytes(blake2b(repr(parts).encode(), digest_size=16).digest(), "big") % MODULUS

    @staticmethod
    def inverse(value: int) -> int:
        if gcd(value, MODULUS) != 1:
            raise _Unreadable
        return pow(value, -1, MODULUS)

    @property
    def next(self) -> str:
        return self.tokens[self.at]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self) -> int:
        found = self.group("")[0]
        if self.at != len(self.tokens):
            raise _Unreadable
        return found

    def group(self, opener: str) -> tuple[int, int | None]:
        """Up to the closing bracket: one part, or a set, tuple or interval as the hash of its parts."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise _Unreadable
        parts = [self.union()]
        while self.next == ",":
            self.take()
            parts.append(self.union())
        closer = self.take()
        self.depth -= 1
        if closer not in (BRACKETS[opener] or [""]) or (opener and not closer):
            raise _Unreadable
        if len(parts) == 1 and opener != "«":
            return parts[0]
        values = [v for v, _ in parts]
        if opener in ("", "«"):
            return self.hashed("set", *sorted(set(values))), None
        return self.hashed(opener + closer, *values), None

    def union(self) -> tuple[int, int | None]:
        parts = [self.sum()]
        while self.next == UNION:
            self.take()
            parts.append(self.sum())
        return parts[0] if len(parts) == 1 else (self.hashed("union", *sorted({v for v, _ in parts})), None)

    def sum(self) -> tuple[int, int | None]:
        total, whole = self.term()
        while self.next in ("+", "-"):
            sign = 1 if self.take() == "+" else -1
            total, whole = (total + sign * self.term()[0]) % MODULUS, None
        return total, whole

    def sign(self) -> int:
        out = 1
        while self.next in ("+", "-"):
            out = out if self.take() == "+" else -out
        return out

    def starts(self) -> bool:
        return self.next in BRACKETS and self.next != "" or bool(re.match(r"[\d.]", self.next) or self.names())

    def names(self) -> bool:
        return bool(NAME.fullmatch(self.next)) and self.next not in (*TIMES, *OVER, UNION)

    def term(self) -> tuple[int, int | None]:
        sign = self.sign()
        total, whole = self.power()
        total, whole = sign * total % MODULUS, None if whole is None else sign * whole
        while True:
            if self.next in TIMES:
                self.take()
                factor = self.sign() * self.power()[0]
            elif self.next in OVER:
                self.take()
                factor = self.inverse(self.sign() * self.power()[0])
            elif self.starts():
                factor = self.power()[0]
            else:
                return total, whole
            total, whole = total * factor % MODULUS, None

    def power(self) -> tuple[int, int | None]:
        base, whole = self.atom()
        if self.next != "^":
            return base, whole
        self.take()
        sign = self.sign()
        exponent, whole = self.power()
        if whole is None:
            return self.hashed("^", base, sign * exponent % MODULUS), None
        if abs(whole) > MOST_EXPONENT:
            raise _Unreadable
        raised = pow(base, abs(whole), MODULUS)
        return (self.inverse(raised) if sign * whole < 0 else raised), None

    def root(self, value: int) -> int:
        """Square root; of no square, the root of its negative times an imaginary unit."""
        parts = []
        for prime in PRIMES:
            v, half = value % prime, (prime + 1) // 4
            root = pow(v, half, prime)
            parts.append(root if root * root % prime == v else self.hashed("imaginary") * pow(-v, half, prime))
        first, second = PRIMES
        return (parts[0] + first * ((parts[1] - parts[0]) * pow(first, -1, second) % second)) % MODULUS

    def atom(self) -> tuple[int, int | None]:
        is_name = self.names()
        token = self.take()
        if token and token in BRACKETS:
            return self.group(token)
        if token == "\\frac":
            upper = self.atom()[0]
            return upper * self.inverse(self.atom()[0]) % MODULUS, None
        if token == "\\sqrt":
            if self.next == "[":
                raise _Unreadable
            return self.root(self.atom()[0]), None
        if token in NAMED:
            if self.next == "^":
                raise _Unreadable
            return self.hashed(token, self.power()[0]), None
        if re.fullmatch(r"[\d.]+", token) and token != ".":
            digits, _, decimals = token.partition(".")
            value = int(digits + decimals) * self.inverse(pow(10, len(decimals), MODULUS)) % MODULUS
            return value, None if decimals else int(digits)
        if is_name:
            return pow(self.hashed("name", token.replace("{", "").replace("}", "")), 2, MODULUS), None
        raise _Unreadable


def key_of(text: str | None) -> str | None:
    """See ``formula_keys``."""
    if text is None or len(text) > MOST_CHARACTERS or re.fullmatch("[a-z]*", text):
        return None
    try:
        return str(_Formula(text).value())
    except _Unreadable:
        return None


@F.arrow_udf(T.ArrayType(T.StringType()))
def _keys(texts: pa.Array) -> pa.Array:
    keys = pa.list_(pa.string())
    if texts.null_count == len(texts):  # most batches have no formula at all
        return pa.nulls(len(texts), keys)
    known: dict[str | None, str | None] = {}

    def of(text: str | None) -> str | None:
        if text not in known:
            known[text] = key_of(text)
        return known[text]

    return pa.array([None if row is None else [of(t) for t in row] for row in texts.to_pylist()], keys)


def formula_keys(texts: Column) -> Column:
    """For an array of texts: a number that equal formulas share, and unequal ones hardly ever, or null for no formula.

    A text is in lower case without blanks. Sums, products, quotients, powers,
    fractions, roots, functions, tuples and intervals in brackets, sets in «» or
    as bare lists, and unions are read; names take hashed values, other powers
    and functions hash their arguments. Unequal polynomials of degree k agree
    with a chance of (k / 2^30)^2. A text of letters alone is a word, no product.
    A null array stays null.

    An Arrow UDF that reads each distinct text of a batch once: the same reader
    as a fold over tokens in column expressions took 1.4 ms a formula, over
    ten times as long, and half a minute to plan.
    """
    return _keys.asNondeterministic()(texts)  # so that a filter on the verdict is not pushed into its own input
