"""Patterns over whole terms, as Java regular expressions: wildcards, prefixes and the term-regex language."""

from __future__ import annotations

from quarry.errors import IllegalArgument, Unsupported

FLAGS = ("ALL", "NONE", "COMPLEMENT", "INTERSECTION", "INTERVAL", "ANYSTRING", "EMPTY")
_CLASSES = {"d": "0-9", "w": "a-zA-Z0-9_", "s": " \\t\\n\\r"}


def literal(c: str, fold: bool = False) -> str:
    """One character as itself; with `fold`, either case of an ASCII letter."""
    if fold and c.isascii() and c.isalpha():
        return f"[{c.lower()}{c.upper()}]"
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def anchored(body: str) -> str:
    return f"(?s)\\A(?:{body})\\z"


def prefix(value: str, fold: bool = False) -> str:
    return anchored("".join(literal(c, fold) for c in value) + ".*")


def wildcard(value: str, fold: bool = False) -> str:
    """`*` any characters, `?` one, a backslash makes the next one itself."""
    out, i = [], 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):
            i += 1
            out.append(literal(value[i], fold))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else literal(c, fold))
        i += 1
    return anchored("".join(out))


def read_flags(flags: str | None) -> set[str]:
    if flags is None:
        return {"ALL"}
    found = set(flags.split("|")) if flags else {"ALL"}
    for f in found:
        if f not in FLAGS:
            raise IllegalArgument(f"Unknown regexp flag [{f}]")
    return found


class _Regex:
    """Recursive descent over union, concatenation, repetition and atoms."""

    def __init__(self, source: str, flags: set[str], fold: bool):
        self.s, self.i, self.fold = source, 0, fold
        self.on = lambda f: "ALL" in flags or f in flags

    def fail(self, why: str):
        raise IllegalArgument(f"failed to parse regexp [{self.s}]: {why}")

    def more(self, chars: str = "") -> bool:
        return self.i < len(self.s) and (not chars or self.s[self.i] in chars)

    def take(self) -> str:
        if not self.more():
            self.fail("unexpected end")
        self.i += 1
        return self.s[self.i - 1]

    def union(self) -> str:
        parts = [self.concat()]
        while self.more("|"):
            self.take()
            parts.append(self.concat())
        return "|".join(parts)

    def concat(self) -> str:
        if self.more("&") and self.on("INTERSECTION"):
            raise Unsupported("regexp intersection [&] is not supported")
        out = []
        while self.more() and not self.more("|)"):
            if self.more("&") and self.on("INTERSECTION"):
                raise Unsupported("regexp intersection [&] is not supported")
            out.append(self.repeat())
        return "".join(out)

    def repeat(self) -> str:
        atom = self.atom()
        while self.more("?*+{"):
            c = self.take()
            if c == "{":
                end = self.s.find("}", self.i)
                bounds = self.s[self.i : end] if end >= 0 else ""
                low, comma, high = bounds.partition(",")
                if not low.isdigit() or (high and not high.isdigit()):
                    self.fail("integer expected in repetition")
                if high and int(high) < int(low):
                    self.fail("repetition bounds out of order")
                self.i = end + 1
                c = f"{{{low}{comma}{high}}}"
            atom = f"(?:{atom}){c}"
        return atom

    def escaped(self) -> str:
        c = self.take()
        if c in _CLASSES:
            return f"[{_CLASSES[c]}]"
        if c.lower() in _CLASSES:
            return f"[^{_CLASSES[c.lower()]}]"
        if c.isascii() and c.isalpha():
            raise Unsupported(f"regexp escape [\\{c}] is not supported")
        return literal(c, self.fold)

    def atom(self) -> str:
        c = self.take()
        if c == "(":
            if self.more(")"):
                self.take()
                return "(?:)"
            inner = self.union()
            if not self.more(")"):
                self.fail("missing )")
            self.take()
            return f"(?:{inner})"
        if c == "[":
            return self.char_class()
        if c == '"':
            end = self.s.find('"', self.i)
            if end < 0:
                self.fail("missing closing quote")
            text, self.i = self.s[self.i : end], end + 1
            return "(?:" + "".join(literal(x, self.fold) for x in text) + ")"
        if c == "\\":
            return self.escaped()
        if c == ".":
            return "."
        if c == "@" and self.on("ANYSTRING"):
            return "(?:.*)"
        for sign, flag in (("~", "COMPLEMENT"), ("<", "INTERVAL"), ("#", "EMPTY")):
            if c == sign and self.on(flag):
                raise Unsupported(f"regexp operator [{sign}] is not supported")
        if c in "?*+{":
            self.fail(f"nothing to repeat before [{c}]")
        return literal(c, self.fold)

    def char_class(self) -> str:
        negated = self.more("^")
        if negated:
            self.take()
        parts: list[str] = []
        first = True
        while first or not self.more("]"):
            first = False
            c = self.take()
            if c == "\\":
                c = self.take()
                if c in _CLASSES:
                    parts.append(_CLASSES[c])
                    continue
                if c.isascii() and c.isalpha():
                    raise Unsupported(f"regexp escape [\\{c}] is not supported")
            if self.more("-") and self.i + 1 < len(self.s) and self.s[self.i + 1] != "]":
                self.take()
                high = self.take()
                if high == "\\":
                    high = self.take()
                if ord(high) < ord(c):
                    self.fail("range out of order")
                parts.append(f"\\x{{{ord(c):x}}}-\\x{{{ord(high):x}}}")
                if self.fold:
                    inside = [x for x in map(chr, range(ord(c), min(ord(high), 127) + 1)) if x.isalpha()]
                    parts += [f"\\x{{{ord(x.swapcase()):x}}}" for x in inside]
            else:
                both = {c, c.swapcase()} if self.fold and c.isascii() and c.isalpha() else {c}
                parts += [f"\\x{{{ord(x):x}}}" for x in sorted(both)]
        self.take()
        return f"[{'^' if negated else ''}{''.join(parts)}]"


def regexp(source: str, flags: str | None = None, fold: bool = False) -> str:
    """A whole-term regular expression; `^` and `$` are themselves, and what can't be translated is refused."""
    reader = _Regex(source, read_flags(flags), fold)
    body = reader.union() if source else ""
    if reader.more():
        reader.fail(f"unexpected [{reader.s[reader.i]}]")
    return anchored(body)


def glob(pattern: str, path: str) -> bool:
    """Does `path` match a pattern in which `*` stands for any characters?"""
    import re

    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), path, re.S) is not None
