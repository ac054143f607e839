"""Four-function arithmetic in 28-digit decimals, by precedence climbing over a token list."""

from __future__ import annotations

import re
from decimal import Context, Decimal

# Operator words and signs, and the limits on an expression.
WORDS = {"乘以": "*", "除以": "/", "加": "+", "减": "-", "×": "*", "÷": "/"}
MAX_CHARS, MAX_NODES = 256, 128
_TOKEN = re.compile(r"\s*(\d+\.?\d*|\.\d+|[-+*/()])")
_POWER = {"+": 1, "-": 1, "*": 2, "/": 2}


def calculate(expression: str) -> str:
    """The result as plain digits. Raises ValueError for anything but numbers, + - * / and parentheses."""
    for word, sign in WORDS.items():
        expression = expression.replace(word, sign)
    expression = expression.strip()
    if not expression or len(expression) > MAX_CHARS or not re.fullmatch(r"[0-9.\s()+*/-]+", expression):
        raise ValueError("an expression has up to 256 characters: numbers, + - * / and parentheses")
    tokens, at = [], 0
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError("the expression is not well formed")
        tokens.append(m.group(1))
        at = m.end()
    if sum(t not in "()" for t in tokens) > MAX_NODES:
        raise ValueError("the expression is too long; split it")
    context, place = Context(prec=28), 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def operand() -> Decimal:
        if not peek() or peek() in "*/)":
            raise ValueError("the expression is not well formed")
        t = take()
        if t in "+-":
            value = operand()
            return value if t == "+" else context.minus(value)
        if t == "(":
            value = climb(1)
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            take()
            return value
        return Decimal(t)

    def climb(least: int) -> Decimal:
        left = operand()
        while _POWER.get(peek(), 0) >= least:
            sign = take()
            right = climb(_POWER[sign] + 1)
            if sign == "/" and right == 0:
                raise ValueError("division by zero")
            left = {"+": context.add, "-": context.subtract, "*": context.multiply, "/": context.divide}[sign](left, right)
        return left

    value = context.plus(climb(1))
    if place < len(tokens):
        raise ValueError("the expression is not well formed")
    text = format(value if value else Decimal(0), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
