"""What a program text can do, read as data: an iterative tokeniser and small static rules over its tokens.

`profile(text, ext)` gives signals (capabilities), hosts, gaps and a control-byte count, all
without paths, so that one distinct content is profiled once however many files carry it. The
contract for gaps: an unterminated string, template, comment or expression, or brackets that do
not pair, is a gap, and the lexical module rules then stand in for the token rules.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .. import rules

_SPACES = re.compile(r"[\s\ufeff]+")
_IDENT = re.compile(r"[^\W\d][\w$]*|[$#][\w$]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|\r\n|(.))", re.S)
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": "", "\u2028": "", "\u2029": ""}
#: Words after which a slash begins an expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}
MAX_DEPTH = 4000

_START, _STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Text rules (pattern, capability, message); matches inside comments and literals don't count.
TEXT_RULES = tuple(
    (re.compile(p), capability, message)
    for p, capability, message in (
        (_START + r"(?:eval|Function)\s*\(", "dynamic-code", "compiles a string into code"),
        (_START + r"process\s*\.\s*env" + _STOP, "environment", "reads environment variables"),
        (_START + r"(?:fetch|XMLHttpRequest|WebSocket)" + _STOP, "network", "names a network client"),
        (_START + r"(?:axios|got|superagent|request|undici)\s*\.\s*(?:get|post|put|patch|delete|request|fetch|stream)\s*\(", "network", "calls a network client"),
        (_START + r"(?:Bun\s*\.\s*spawn|Deno\s*\.\s*Command)" + _STOP, "child_process", "starts a process through the runtime"),
        (_START + r"WebAssembly\s*\.\s*(?:compile|instantiate)\s*\(", "dynamic-code", "compiles a binary module"),
    )
)
#: Module references in text whose tokens can't be trusted.
MODULE_RULES = tuple(
    re.compile(p)
    for p in (
        _START + r"(?:require|_load|_compile)\s*\(\s*['\"]([^'\"\n]{1,120})['\"]",
        _START + r"import\s*\(\s*['\"]([^'\"\n]{1,120})['\"]",
        _START + r"from\s*['\"]([^'\"\n]{1,120})['\"]",
    )
)
#: An address literal, its slashes perhaps escaped.
URL = re.compile(_START + r"https?:\\?/\\?/([^\W_](?:[^\W_]|[.-])*|\[[a-f0-9:]+\])(?::\d+)?(?:[/?#]|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", re.I)


@dataclass
class Token:
    kind: str  # name, number, string, chunk, regex, punct, comment
    start: int
    end: int
    text: str


@dataclass
class Scan:
    tokens: list[Token] = field(default_factory=list)  # without comments
    comments: list[tuple[int, int]] = field(default_factory=list)
    literals: list[tuple[int, int]] = field(default_factory=list)
    gap: str | None = None  # reason
    detail: str = ""


def cooked(raw: str) -> str:
    """The value of a literal's source characters."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else ""
        c = m[4]
        return "" if c is None else _SIMPLE.get(c, c)

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


def _regex_end(s: str, i: int) -> int:
    """End of a regular expression literal that begins at `i`, or -1."""
    j, inside = i + 1, False
    while j < len(s) and s[j] not in "\n\r":
        c = s[j]
        if c == "\\":
            j += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "/" and not inside:
            j += 1
            while j < len(s) and s[j].isalpha():
                j += 1
            return j
        j += 1
    return -1


def scan(s: str, loose_quotes: bool = False) -> Scan:
    """Tokens of `s`, where its comments and literals lie, and the first thing that doesn't fit."""
    out = Scan()
    stack: list[str] = []  # open brackets; "`" stands for a template, "$" for a hole in one
    i, n = 0, len(s)
    if s.startswith("#!"):
        i = s.find("\n") if "\n" in s else n
        out.comments.append((0, i))

    def fail(reason: str, detail: str) -> None:
        if out.gap is None:
            out.gap, out.detail = reason, detail

    def chunk(i: int) -> int:
        """Literal characters of a template from `i` to its end or the next hole."""
        j = i
        while j < n and s[j] != "`" and not s.startswith("${", j):
            j += 2 if s[j] == "\\" else 1
        j = min(j, n)
        out.tokens.append(Token("chunk", i, j, cooked(s[i:j])))
        out.literals.append((i, j))
        if j >= n:
            fail("parse-failure", "a template is not closed")
            stack.pop()
            return n
        if s[j] == "`":
            stack.pop()
            out.tokens.append(Token("punct", j, j + 1, "`end"))
            return j + 1
        stack.append("$")
        out.tokens.append(Token("punct", j, j + 2, "${"))
        return j + 2

    while i < n:
        if m := _SPACES.match(s, i):
            i = m.end()
            continue
        c = s[i]
        if s.startswith("//", i):
            j = s.find("\n", i)
            j = n if j < 0 else j
            out.comments.append((i, j))
            i = j
        elif s.startswith("/*", i):
            j = s.find("*/", i + 2)
            if j < 0:
                fail("parse-failure", "a comment is not closed")
            j = n if j < 0 else j + 2
            out.comments.append((i, j))
            i = j
        elif c in "'\"":
            j = i + 1
            while j < n and s[j] != c and s[j] not in "\n\r":
                j += 2 if s[j] == "\\" else 1
            if j < n and s[j] == c:
                out.tokens.append(Token("string", i, j + 1, cooked(s[i + 1 : j])))
                out.literals.append((i, j + 1))
                i = j + 1
            else:
                if not loose_quotes:
                    fail("parse-failure", "a string is not closed")
                i += 1
        elif c == "`":
            stack.append("`")
            out.tokens.append(Token("punct", i, i + 1, "`"))
            i = chunk(i + 1)
        elif m := _NUMBER.match(s, i):
            out.tokens.append(Token("number", i, m.end(), m[0]))
            i = m.end()
        elif m := _IDENT.match(s, i):
            out.tokens.append(Token("name", i, m.end(), m[0]))
            i = m.end()
        elif c == "/":
            last = out.tokens[-1] if out.tokens else None
            opens = last is None or last.kind == "punct" and last.text not in (")", "]", "}", "`end") or last.kind == "name" and last.text in _BEFORE_REGEX
            j = _regex_end(s, i) if opens else -1
            if j > 0:
                out.tokens.append(Token("regex", i, j, s[i:j]))
                out.literals.append((i, j))
                i = j
            else:
                out.tokens.append(Token("punct", i, i + 1, "/"))
                i += 1
        elif c == "}" and stack and stack[-1] == "$":
            stack.pop()
            out.tokens.append(Token("punct", i, i + 1, "}hole"))
            i = chunk(i + 1)
        else:
            if c in "([{":
                stack.append(c)
                if len(stack) > MAX_DEPTH:
                    fail("parse-failure", "brackets are nested too deeply")
                    break
            elif c in ")]}":
                if stack and stack[-1] == _PAIRS[c]:
                    stack.pop()
                else:
                    fail("partial-parse", "brackets do not pair")
            text = next((t for t in ("=>", "===", "!==", "==", "!=", ">=", "<=", "...", "?.", "++", "--", "&&", "||", "??", "+=") if s.startswith(t, i)), c)
            out.tokens.append(Token("punct", i, i + len(text), text))
            i += len(text)
    if stack:
        fail("partial-parse", "brackets are left open")
    return out


class Ranges:
    """Whether an offset lies in one of many ranges."""

    def __init__(self, ranges: list[tuple[int, int]]):
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            elif b > a:
                merged.append([a, b])
        self.starts, self.ends = [a for a, _ in merged], [b for _, b in merged]

    def __contains__(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.ends[k]


def _from_base64(v: str) -> bytes:
    v = re.sub(r"[^A-Za-z0-9+/]", "", v.replace("-", "+").replace("_", "/").split("=")[0])
    if len(v) % 4 == 1:
        v = v[:-1]
    return base64.b64decode(v + "=" * (-len(v) % 4))


#: Encodings whose text can be folded.
_TO_BYTES = {
    "utf8": str.encode, "utf-8": str.encode, "base64": _from_base64, "base64url": _from_base64,
    "hex": lambda v: bytes.fromhex(re.match(r"(?:[0-9a-fA-F]{2})*", v)[0]),
    "latin1": lambda v: bytes(ord(c) & 255 for c in v), "ascii": lambda v: bytes(ord(c) & 255 for c in v), "binary": lambda v: bytes(ord(c) & 255 for c in v),
}
_TO_TEXT = {
    "utf8": lambda b: b.decode("utf-8", "replace"), "utf-8": lambda b: b.decode("utf-8", "replace"), "latin1": lambda b: b.decode("latin-1"),
    "ascii": lambda b: bytes(x & 127 for x in b).decode(), "binary": lambda b: b.decode("latin-1"),
}


class Reader:
    """Static reading of a token list: folds string expressions, follows aliases of loaders."""

    def __init__(self, tokens: list[Token]):
        self.t = tokens
        self.loaders, self.compilers, self.factories = {"require"}, {"eval", "Function"}, {"createRequire"}
        self.close = self._pair()
        self.open = {b: a for a, b in self.close.items()}

    def _pair(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "punct" and t.text in ("(", "[", "{"):
                stack.append(i)
            elif t.kind == "punct" and t.text in (")", "]", "}") and stack and self.t[stack[-1]].text == _PAIRS[t.text]:
                out[stack.pop()] = i
        return out

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in ("punct", "name") and self.t[i].text in texts

    # -- folding: each returns ((value, is plain literal), next index) or None

    def fold(self, i: int, depth: int = 0) -> tuple[tuple[str, bool], int] | None:
        """A sum of foldable terms."""
        if depth > 12 or (got := self._term(i, depth)) is None:
            return None
        (value, literal), i = got
        while self.is_(i, "+"):
            if (more := self._term(i + 1, depth + 1)) is None:
                return None
            value, literal, i = value + more[0][0], False, more[1]
        return (value, literal), i

    def whole(self, i: int, end: int, depth: int = 0) -> tuple[str, bool] | None:
        """The folded expression that fills the tokens i .. end - 1."""
        got = self.fold(i, depth) if i < end else None
        return got[0] if got and got[1] == end else None

    def arguments(self, open_at: int, depth: int = 0) -> list[tuple[int, int]]:
        """Token ranges of the arguments of a call or the items of an array."""
        end = self.close.get(open_at, len(self.t))
        out, start, i = [], open_at + 1, open_at + 1
        while i < end:
            if i in self.close:
                i = self.close[i]
            elif self.is_(i, ","):
                out.append((start, i))
                start = i + 1
            i += 1
        return out + [(start, end)] if start < end else out

    def _each(self, open_at: int, depth: int) -> list[str] | None:
        out = []
        for a, b in self.arguments(open_at):
            got = self.fold(a, depth + 1)
            if got is None or got[1] != b:
                return None
            out.append(got[0][0])
        return out

    def _term(self, i: int, depth: int) -> tuple[tuple[str, bool], int] | None:
        if i >= len(self.t):
            return None
        t, base, end = self.t[i], None, i + 1
        if t.kind == "string":
            base = (t.text, True)
        elif t.text == "`" and t.kind == "punct":
            base, end = self._template(i, depth)
        elif self.is_(i, "(") and i in self.close:
            got = self.fold(i + 1, depth + 1)
            if got and got[1] == self.close[i]:
                base, end = got[0], self.close[i] + 1
        elif self.is_(i, "[") and i in self.close:
            call = self.close[i] + 1
            if self._member(call, depth) == "join" and (at := self._call_after(call)) is not None:
                items, glue = self._each(i, depth), self._each(at, depth)
                if items is not None and glue is not None:
                    base, end = ((glue[0] if glue else ",").join(items), False), self.close[at] + 1
        elif t.kind == "name":
            base, end = self._named(i, depth)
        if base is None:
            return None
        while True:  # .concat(...), non-null marks and type assertions
            if self._member(end, depth) == "concat" and (at := self._call_after(end)) is not None:
                more = self._each(at, depth)
                if more is None:
                    return None
                base, end = (base[0] + "".join(more), False), self.close[at] + 1
            elif self.is_(end, "!") and not self.is_(end + 1, "="):
                end += 1
            elif self.is_(end, "as", "satisfies") and end + 1 < len(self.t) and self.t[end + 1].kind == "name":
                end += 2
                while self.is_(end, ".") or self.is_(end - 1, "."):
                    end += 1
            else:
                return base, end

    def _template(self, i: int, depth: int) -> tuple[tuple[str, bool] | None, int]:
        value, plain, i = "", True, i + 1
        while i < len(self.t):
            t = self.t[i]
            if t.kind == "chunk":
                value, i = value + t.text, i + 1
            elif t.text == "`end":
                return (value, plain), i + 1
            elif t.text == "${":
                got = self.fold(i + 1, depth + 1)
                if got is None or not self.is_(got[1], "}hole"):
                    return None, i
                value, plain, i = value + got[0][0], False, got[1] + 1
            else:
                return None, i
        return None, i

    def _named(self, i: int, depth: int) -> tuple[tuple[str, bool] | None, int]:
        name = self.t[i].text
        if name == "atob" and self.is_(i + 1, "(") and i + 1 in self.close:
            got = self._each(i + 1, depth)
            return ((_from_base64(got[0]).decode("utf-8", "replace"), False), self.close[i + 1] + 1) if got else (None, i)
        if name == "String" and self._member(i + 1, depth) == "fromCharCode" and (at := self._call_after(i + 1)) is not None:
            codes = []
            for a, b in self.arguments(at):
                if b != a + 1 or self.t[a].kind != "number":
                    return None, i
                try:
                    codes.append(int(self.t[a].text.replace("_", ""), 0) & 0xFFFF)
                except ValueError:
                    return None, i
            return ("".join(map(chr, codes)).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), False), self.close[at] + 1
        if name == "Buffer" and self._member(i + 1, depth) == "from" and (at := self._call_after(i + 1)) is not None:
            source, call = self._each(at, depth), self.close[at] + 1
            if source and self._member(call, depth) == "toString" and (to := self._call_after(call)) is not None:
                target = self._each(to, depth)
                read, write = _TO_BYTES.get(source[1] if len(source) > 1 else "utf8"), _TO_TEXT.get((target or ["utf8"])[0])
                if target is not None and read and write:
                    return (write(read(source[0])), False), self.close[to] + 1
        return None, i

    def _member(self, i: int, depth: int = 0) -> str | None:
        """Name of the property that the tokens at `i` select."""
        if self.is_(i, ".", "?.") and i + 1 < len(self.t) and self.t[i + 1].kind == "name":
            return self.t[i + 1].text
        if self.is_(i, "[") and i in self.close and (got := self.whole(i + 1, self.close[i], depth + 1)):
            return got[0]
        return None

    def _after_member(self, i: int) -> int:
        return self.close[i] + 1 if self.is_(i, "[") else i + 2

    def _call_after(self, i: int) -> int | None:
        at = self._after_member(i)
        return at if self.is_(at, "(") and at in self.close else None

    # -- aliases

    def kind_of(self, i: int) -> str | None:
        """What the expression at `i` holds: a loader, a compiler or a maker of loaders."""
        while self.is_(i, "(") and i in self.close and (self.t[i + 1].kind == "name" if i + 1 < len(self.t) else False) and not self.is_(self.close[i] + 1, "=>", "."):
            i += 1
        if i >= len(self.t):
            return None
        t = self.t[i]
        if t.kind == "name":
            kind = "loader" if t.text in self.loaders else "compiler" if t.text in self.compilers else "factory" if t.text in self.factories else None
            i += 1
        elif self.is_(i, "(", "[") and i in self.close:
            kind, i = None, self.close[i] + 1
        elif t.kind == "string":
            kind, i = None, i + 1
        else:
            return None
        while True:
            name = self._member(i)
            if name is not None:
                kind = "factory" if name == "createRequire" else "loader" if name in rules.LOADER_NAMES else "compiler" if name in rules.COMPILER_NAMES else None
                i = self._after_member(i)
            elif self.is_(i, "(") and i in self.close:
                kind, i = "loader" if kind == "factory" else None, self.close[i] + 1
            elif self.is_(i, "!") and not self.is_(i + 1, "="):
                i += 1
            elif self.is_(i, "as", "satisfies"):
                return kind
            else:
                return None if self.is_(i, "+", "-", "*", "?", "&&", "||", "=>", "==", "===") else kind

    def follow_aliases(self) -> None:
        bindings = []
        for i, t in enumerate(self.t):
            if t.kind == "punct" and t.text == "=" and i and self.t[i - 1].kind == "name" and not self.is_(i - 2, ".", "?."):
                bindings.append((self.t[i - 1].text, i + 1))
            elif t.kind == "name" and t.text == "createRequire" and self.is_(i + 1, ":", "as") and i + 2 < len(self.t) and self.t[i + 2].kind == "name":
                self.factories.add(self.t[i + 2].text)
        for _ in range(6):
            size = len(self.loaders) + len(self.compilers) + len(self.factories)
            for name, i in bindings:
                kind = self.kind_of(i)
                if kind:
                    {"loader": self.loaders, "compiler": self.compilers, "factory": self.factories}[kind].add(name)
            if size == len(self.loaders) + len(self.compilers) + len(self.factories):
                break

    # -- signals: (offset, capability, message)

    def signals(self) -> list[tuple[int, str, str]]:
        self.follow_aliases()
        out: list[tuple[int, str, str]] = []

        def module(name: str, literal: bool, at: int) -> None:
            plain = name.removeprefix("node:")
            if plain in rules.MODULES:
                out.append((at, rules.MODULES[plain], f"loads module {plain}"))
            elif not literal:
                out.append((at, "module-loader", "loads a module under a computed name"))

        def argument(open_at: int, at: int) -> None:
            args = self.arguments(open_at)
            got = self.whole(*args[0]) if args else None
            if got:
                module(*got, at)
            else:
                out.append((at, "module-loader", "loads a module under a computed name"))

        for i, t in enumerate(self.t):
            member = self.is_(i - 1, ".", "?.")
            if t.kind == "name" and not member:
                if t.text == "import" and self.is_(i + 1, "("):
                    argument(i + 1, t.start)
                elif t.text == "import" and i + 1 < len(self.t) and self.t[i + 1].kind == "string":
                    module(self.t[i + 1].text, True, t.start)
                elif t.text in ("import", "export"):
                    j = i + 1
                    while j + 1 < len(self.t) and not self.is_(j, ";", "=", "(", "function", "class", "import", "export"):
                        if self.is_(j, "from") and self.t[j + 1].kind == "string":
                            module(self.t[j + 1].text, True, t.start)
                            break
                        j = self.close.get(j, j) + 1
                elif self.is_(i + 1, "(") and not self.is_(i - 1, "function"):
                    if t.text in self.loaders:
                        argument(i + 1, t.start)
                    elif t.text in self.compilers - {"eval", "Function"}:
                        out.append((t.start, "dynamic-code", "compiles a string through another name"))
            if (t.kind == "name" and member and self.is_(i + 1, "(")) or (t.kind == "punct" and t.text == "]" and self.is_(i + 1, "(")):
                at = i - 1 if t.kind == "name" else self.open.get(i, -1)
                name = self._member(at) if at > 0 else None
                if name is None or t.text == "]" and (self.t[at - 1].kind == "punct" and self.t[at - 1].text not in (")", "]", "}", "`end")):
                    continue
                if name in rules.LOADER_NAMES:
                    argument(i + 1, self.t[self._chain_start(at)].start)
                elif name in rules.COMPILER_NAMES:
                    args = self.arguments(i + 1)
                    if args and self.whole(*args[0]):
                        out.append((self.t[self._chain_start(at)].start, "dynamic-code", "compiles a string through a member"))
        return out

    def _chain_start(self, i: int) -> int:
        """First token of the member chain whose last selection begins at token `i`."""
        while i > 0:
            if self.t[i - 1].kind in ("name", "string"):
                i -= 1
                if not self.is_(i - 1, ".", "?."):
                    return i
                i -= 1
            elif self.is_(i - 1, ")", "]") and i - 1 in self.open:
                i = self.open[i - 1]
                if not (i > 0 and (self.t[i - 1].kind == "name" or self.is_(i - 1, ")", "]"))):
                    return i
            else:
                return i
        return i


def truncated(s: str, limit: int = 180) -> str:
    flat = _SPACES.sub(" ", s).strip()
    return flat if len(flat) <= limit else flat[: limit - 1] + "…"


def profile(text: str, ext: str = ".js") -> dict[str, list]:
    """signals (capability, line, message, snippet), hosts (host, line, snippet), gaps (reason, detail)."""
    text = text.removeprefix("\ufeff")
    got = scan(text, loose_quotes=ext in (".jsx", ".tsx"))
    comments, literals = Ranges(got.comments), Ranges(got.literals)
    feeds = [m.start() for m in re.finditer("\n", text)]
    lines = text.split("\n")

    snippets: dict[int, str] = {}  # a line may hold a great many signals

    def place(at: int) -> tuple[int, str]:
        k = bisect_right(feeds, at - 1)
        if k not in snippets:
            snippets[k] = truncated(lines[k])
        return k + 1, snippets[k]

    found: list[tuple[int, str, str]] = []
    for pattern, capability, message in TEXT_RULES:
        found += [(m.start(), capability, message) for m in pattern.finditer(text) if m.start() not in comments and m.start() not in literals]
    if got.gap:
        for pattern in MODULE_RULES:
            for m in pattern.finditer(text):
                name = m[1].removeprefix("node:")
                if m.start() not in comments and m.start() not in literals and name in rules.MODULES:
                    found.append((m.start(), rules.MODULES[name], f"loads module {name} (lexical)"))
    found += Reader(got.tokens).signals()
    signals = [(capability, *place(at), message) for at, capability, message in found]
    hosts = [(m[1].lower(), *place(m.start())) for m in URL.finditer(text) if m.start() not in comments]
    return {
        "signals": [(c, line, message, snippet) for c, line, snippet, message in dict.fromkeys(signals)],
        "hosts": hosts,
        "gaps": [(got.gap, got.detail)] if got.gap else [],
    }
