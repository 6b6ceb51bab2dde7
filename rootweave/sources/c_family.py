"""What a C or C++ file states: a tokenizer, matched brackets, and a walk over the statements of each scope.

Nothing is expanded or typed; what the walk does not know, it steps over. Types count where they are defined.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]+[>\"])", re.MULTILINE)
_SKIPPED = r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|(?m:^)[ \t]*\#(?:\\\n|/\*.*?\*/|[^\n])*"
_TEXT = r"R\"(?P<mark>[^()\\ ]{0,16})\(.*?\)(?P=mark)\"|(?:u8|[uUL])?(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')"
_TOKEN = re.compile(rf"(?P<skipped>{_SKIPPED})|(?P<text>{_TEXT})|(?P<name>[^\W\d]\w*)|(?P<number>\.?\d(?:[\w.']|[eEpP][+-])*)|(?P<sign>::|->|&&|\[\[|\]\]|[^\s\w])", re.DOTALL)
# Words of the languages.
_QUALIFIERS = {"const", "volatile", "restrict", "register", "static", "extern", "inline", "constexpr", "virtual", "explicit", "mutable", "typename", "friend"}
_KINDS = {"class", "struct", "union", "enum"}
_PLAIN_TYPES = {"void", "bool", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "auto", "wchar_t"}
_NO_CALLS = {
    "if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "new", "delete", "throw", "case", "goto", "alignof", "decltype", "typeid", "alignas",
    "noexcept", "static_assert", "co_return", "co_await", "co_yield", "static_cast", "const_cast", "dynamic_cast", "reinterpret_cast", "defined", "__attribute__", "__declspec", "requires", "throws",
} | _PLAIN_TYPES
_NO_VARIABLES = {"typedef", "using", "friend", "namespace", "static_assert", "return", "goto", "template", "asm", "public", "private", "protected"}
_ENDS = {"(": ")", "{": "}", "[": "]"}


@dataclass(frozen=True)
class Token:
    word: str
    kind: str
    start: int
    end: int


class Scan:
    def __init__(self, text: str, with_methods: bool) -> None:
        self.text, self.with_methods = text, with_methods
        kinds = ("text", "name", "number", "sign")
        self.tokens = [Token(m[0], next(k for k in kinds if m[k] is not None), m.start(), m.end()) for m in _TOKEN.finditer(text) if m["skipped"] is None]
        self.end_of = self._brackets()
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.variables: list[dict] = []
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def _brackets(self) -> dict[int, int]:
        """Where each opened bracket closes; one that never does closes at the end, a stray end is stepped over."""
        ends, open_ = {}, []
        for at, token in enumerate(self.tokens):
            if token.word in _ENDS:
                open_.append(at)
            elif token.word in _ENDS.values():
                while open_ and _ENDS[self.tokens[open_[-1]].word] != token.word and any(_ENDS[self.tokens[o].word] == token.word for o in open_):
                    ends[open_.pop()] = at
                if open_ and _ENDS[self.tokens[open_[-1]].word] == token.word:
                    ends[open_.pop()] = at
        return {**ends, **dict.fromkeys(open_, len(self.tokens))}

    def word(self, at: int) -> str:
        return self.tokens[at].word if 0 <= at < len(self.tokens) else ""

    def is_name(self, at: int) -> bool:
        return 0 <= at < len(self.tokens) and self.tokens[at].kind == "name"

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, self.tokens[at].start) + 1

    def after_angles(self, at: int) -> int:
        """Behind the angle brackets that open at `at`; parentheses in them hide their own."""
        depth = 0
        while at < len(self.tokens):
            word = self.word(at)
            depth += (word == "<") - (word == ">")
            if depth == 0 or word in (";", "{"):
                return at + (depth == 0)
            at = self.end_of.get(at, at) + 1
        return at

    def top(self, low: int, high: int):
        """Tokens of a statement that no bracket holds; an opening bracket stands for its group."""
        while low < high:
            yield low
            low = self.end_of.get(low, low) + 1

    def scope(self, low: int, high: int, methods: list | None = None) -> None:
        """Statements between two tokens: of a file, a namespace, or (with `methods`) a type's body."""
        at = start = low
        typed = None  # behind a type's body: whether the statement is a typedef
        while at < high:
            word = self.word(at)
            if word == "template" and self.word(at + 1) == "<":
                at = start = self.after_angles(at + 1)
            elif at == start and word in ("public", "private", "protected") and self.word(at + 1) == ":":
                at = start = at + 2
            elif word == ";":
                if not typed:
                    self.declaration(start, at, methods, typed is not None)
                at = start = at + 1
                typed = None
            elif word == "{" and typed is None:
                close = self.end_of[at]
                what = self.opened(start, at)
                if what == "scope":
                    self.scope(at + 1, close, None)
                elif what == "type":
                    self.define(start, at, close)
                    typed = self.word(start) == "typedef"
                elif what == "function":
                    self.function(start, at, close, self.functions if methods is None else methods)
                at = close + 1
                start = start if what == "value" else at
            else:
                at = self.end_of.get(at, at) + 1

    def opened(self, start: int, at: int) -> str:
        """What a brace opens: a scope, a type, a function's body, or a value."""
        head = list(self.top(start, at))
        words = [self.word(i) for i in head]
        plain = [w for w in words if w not in ("inline", "[[")]
        if plain[:1] == ["namespace"] or (plain[:1] == ["extern"] and len(head) == 2 and self.tokens[head[1]].kind == "text"):
            return "scope"
        signature = self.declarator(start, at)
        if signature is None:
            return "type" if _KINDS & set(words) and "=" not in words else "value"
        behind = [self.word(i) for i in self.top(signature[2] + 1, at)]
        # A member's initial value in braces is followed by another member or by the body.
        if ":" in behind and self.word(self.end_of[at] + 1) in (",", "{"):
            return "value"
        return "function"

    def declarator(self, start: int, end: int) -> tuple[str, int, int] | None:
        """Name of the function that a statement declares, and where its parameters begin and end."""
        for at in self.top(start, end):
            word = self.word(at)
            if word == "operator":
                first = at + 3 if self.word(at + 1) == "(" else next((i for i in range(at + 1, end) if self.word(i) == "("), end)
                return ("".join(t.word for t in self.tokens[at:first]), first, self.end_of[first]) if self.word(first) == "(" else None
            if word in ("=", "{"):
                return None
            if word == "(" and self.is_name(at - 1) and self.word(at - 1) not in _NO_CALLS and self.word(at + 1) not in ("*", "^"):
                return ("~" if self.word(at - 2) == "~" else "") + self.word(at - 1), at, self.end_of[at]
        return None

    def function(self, start: int, low: int, high: int, into: list) -> None:
        signature = self.declarator(start, low)
        initialised = set(self.top(signature[2] + 1, low))  # members and bases; what is called for their values counts
        into.append(self.record(start, signature, self.calls(signature[2] + 1, high, initialised)))

    def record(self, start: int, signature: tuple[str, int, int], calls: list[str]) -> dict:
        name, low, high = signature
        params = [p for p in (self.parameter(*part) for part in self.parts(low + 1, high)) if p]
        return {"name": name, "qualname": name, "params": params, "line": self.line(start), "calls": calls, "decorators": []}

    def calls(self, low: int, high: int, besides: set[int]) -> list[str]:
        """Called names in order of the text: the last part of a qualified one. A name behind a name is a declaration."""
        found = []
        for at in range(low, min(high, len(self.tokens))):
            if at not in besides and self.word(at + 1) == "(" and self.is_name(at) and self.word(at) not in _NO_CALLS:
                first = at
                while self.word(first - 1) == "::" and self.is_name(first - 2):
                    first -= 2
                if first <= low or not self.is_name(first - 1) or self.word(first - 1) in _NO_CALLS - _PLAIN_TYPES:
                    found.append(self.word(at))
        return found

    def parts(self, low: int, high: int):
        """Ranges between commas that no bracket holds, angles included."""
        start, at = low, low
        while at < high:
            if self.word(at) == ",":
                yield start, at
                start = at + 1
            at = self.after_angles(at) if self.word(at) == "<" else self.end_of.get(at, at) + 1
        if start < high:
            yield start, high

    def parameter(self, low: int, high: int) -> str | None:
        """A parameter's declarator as written, where it has a name and no default."""
        top = list(self.top(low, high))
        if any(self.word(i) == "=" for i in top):
            return None
        pointer = next((i for i in top if self.word(i) == "(" and self.word(i + 1) == "*"), None)
        if pointer is not None:
            return self.text[self.tokens[pointer].start : self.tokens[high - 1].end]
        while top and self.word(top[-1]) == "[":
            top.pop()
        typed = [i for i in top if self.is_name(i) and self.word(i) not in _QUALIFIERS | _KINDS]
        if len(typed) < 2 or typed[-1] != top[-1] or self.word(top[-1]) in _PLAIN_TYPES or self.word(top[-1] - 1) == "::":
            return None
        first = top[-1]
        for at in range(top[-1] - 1, low - 1, -1):
            if self.word(at) in ("*", "&", "&&"):
                first = at
            elif self.word(at) not in _QUALIFIERS:
                break
        return self.text[self.tokens[first].start : self.tokens[high - 1].end]

    def define(self, start: int, low: int, high: int) -> None:
        """A type with a name; types in its body are types of their own. Enumerations are none."""
        kind = max(i for i in self.top(start, low) if self.word(i) in _KINDS)
        colon = next((i for i in self.top(kind, low) if self.word(i) == ":"), low)
        names = [i for i in self.top(kind + 1, colon) if self.is_name(i) and self.word(i) not in ("final", "alignas", "__attribute__", "__declspec")]
        if "enum" in (self.word(kind - 1), self.word(kind)):
            return
        methods: list[dict] = []
        if names:
            bases = [self.base(*part) for part in self.parts(colon + 1, low)] if self.with_methods else []
            row = {"name": self.word(names[0]), "qualname": self.word(names[0]), "bases": [b for b in bases if b], "line": self.line(kind), "methods": methods if self.with_methods else []}
            self.classes.append(row)
        self.scope(low + 1, high, methods)

    def base(self, low: int, high: int) -> str | None:
        while self.word(low) in ("public", "private", "protected", "virtual"):
            low += 1
        single = low < high and self.is_name(low) and (low + 1 == high or (self.word(low + 1) == "<" and self.after_angles(low + 1) == high))
        return self.text[self.tokens[low].start : self.tokens[high - 1].end] if single else None

    def declaration(self, start: int, end: int, methods: list | None, typed: bool) -> None:
        """A method without a body, or (outside of types) the first variable of a declaration."""
        if start >= end or self.word(start) in _NO_VARIABLES:
            return
        signature = None if typed else self.declarator(start, end)
        if methods is not None:
            if signature:
                methods.append(self.record(start, signature, []))
            return
        if signature or any(self.word(i) == "(" and self.word(i + 1) == "*" for i in self.top(start, end)):
            return
        at, name = start, None
        words = 1 if typed else 0
        while at < end and self.word(at) not in ("=", "[", ",", "{", ":"):
            if self.is_name(at) and self.word(at) not in _QUALIFIERS and self.word(at) not in _KINDS:
                name, words = at, words + (self.word(at - 1) != "::")
            at = self.after_angles(at) if self.word(at) == "<" else self.end_of.get(at, at) + 1
        forward = self.word(start) in _KINDS and at == end and words < 2
        if name is not None and words > 1 and not forward and self.word(name) not in _PLAIN_TYPES:
            self.variables.append({"name": self.word(name), "line": self.line(start)})


def parse_c_family(text: str, path: str) -> dict:
    """Includes, functions, types and file-scope variables of a C or C++ file; in C, types have neither bases nor methods."""
    includes = [{"module": m[1].strip('<>"'), "names": [], "line": text.count("\n", 0, m.start(1)) + 1} for m in _INCLUDE.finditer(text)]
    scan = Scan(text, not path.lower().endswith((".c", ".h")))
    scan.scope(0, len(scan.tokens))
    return {"imports": includes, "functions": scan.functions, "classes": scan.classes, "variables": scan.variables, "blocks": [], "flows": [], "uses": []}
