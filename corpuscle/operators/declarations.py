"""Declarations of source files in languages of braces: which lines each takes, its name and kind.

Strings and comments are blanked, brackets paired in one pass, and declarations looked for outside all brackets and inside
the bodies of types; all of it linear in the file. Not a grammar: what it does not know stays with the lines between.
"""

from __future__ import annotations

import re
from bisect import bisect_left

Span = tuple[int, int, str | None, str]

_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\[\s\S]|[^"\\\n])*"'
_SCRIPT = re.compile(_COMMENT + "|" + _QUOTED + r"|'(?:\\[\s\S]|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`|(?P<kept>[=(,:\[!&|?;]\s*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\n\\\[])+/")
_BLANKED = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "go": re.compile(_COMMENT + "|" + _QUOTED + r"|`[^`]*`|'(?:\\[^\n']*|[^'\\\n])'"),
    "rust": re.compile(_COMMENT + r'|\bb?r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)|"(?:\\[\s\S]|[^"\\])*"|' + r"'(?:\\[^\n']*'|[^'\\\n]')"),
}

_SCRIPT_HEAD = r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_TOP = {
    "javascript": re.compile(_SCRIPT_HEAD + r"(?:(?P<imports>import)\b(?![ \t]*[(.])|(?:async[ \t]+)?(?P<function>function)[ \t]*\*?[ \t]*(?P<f>[\w$]+)|(?P<class>class)[ \t]+(?P<c>[\w$]+))", re.M),
    "typescript": re.compile(
        _SCRIPT_HEAD + r"(?:(?P<imports>import)\b(?![ \t]*[(.])|(?:async[ \t]+)?(?P<function>function)[ \t]*\*?[ \t]*(?P<f>[\w$]+)|(?P<class>(?:abstract[ \t]+)?class)[ \t]+(?P<c>[\w$]+)"
        r"|(?P<interface>interface)[ \t]+(?P<i>[\w$]+)|(?P<type_alias>type|(?:const[ \t]+)?enum)[ \t]+(?P<t>[\w$]+))", re.M),
    "go": re.compile(r"^(?:(?P<imports>import)\b|(?P<method>func)[ \t]*\((?:\w+[ \t]+)?\*?(?P<of>\w+)[^)\n]*\)[ \t]*(?P<m>\w+)|(?P<function>func)[ \t]+(?P<f>\w+)"
        r"|type[ \t]+(?P<n>\w+)(?:\[[^\]\n]*\])?[ \t]+(?:(?P<struct>struct)|(?P<interface>interface)|(?P<type_alias>\S)))", re.M),
    "rust": re.compile(
        r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?P<imports>use)\b|(?:(?:async|const|unsafe|extern(?:[ \t]+\S*)?)[ \t]+)*(?P<function>fn)[ \t]+(?P<f>\w+)|(?P<struct>struct|union)[ \t]+(?P<s>\w+)"
        r"|(?P<type_alias>enum|type)[ \t]+(?P<t>\w+)|(?:unsafe[ \t]+)?(?P<interface>trait)[ \t]+(?P<i>\w+)|(?:unsafe[ \t]+)?(?P<class>impl)\b(?:<[^{\n]*?>)?(?:[^{\n]*\bfor\b)?[ \t]+&?(?:\w+::)*(?P<c>\w+))", re.M),
}
_SCRIPT_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|override|get|set)[ \t]+)*\*?[ \t]*(?P<name>#?[\w$]+)[ \t]*(?:<[^>(\n]*>)?(?=\()", re.M)
_METHOD = {
    "javascript": _SCRIPT_METHOD,
    "typescript": _SCRIPT_METHOD,
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:async|const|unsafe|extern(?:[ \t]+\S*)?)[ \t]+)*fn[ \t]+(?P<name>\w+)", re.M),
}
#: Languages and kinds of declarations whose bodies hold methods.
_HOLDS = {("javascript", "class"), ("typescript", "class"), ("rust", "class"), ("rust", "interface")}
_KINDS = ("imports", "function", "method", "class", "struct", "interface", "type_alias")
_BRACKET, _STOP, _BRACE, _ON = re.compile(r"[(){}\[\]]"), re.compile(r"[({\[;\n]"), re.compile(r"[ \t]*\{"), re.compile(r"[ \t\n]*[|&=.{]")
_ABOVE = re.compile(r"[ \t]*(?://|/\*|\*|#\[|@\w)")
LANGUAGES = tuple(_TOP)


def _blank(m: re.Match) -> str:
    kept = m.lastgroup == "kept" and m["kept"] or ""
    if "\n" not in m[0]:
        return kept + " " * (len(m[0]) - len(kept))
    return kept + re.sub(r"[^\n]", " ", m[0][len(kept) :])


class _Source:
    """A file with strings and comments blanked, and the partner of every bracket."""

    def __init__(self, source: str, language: str):
        self.text, self.language = _BLANKED[language].sub(_blank, source), language
        self.lines = source.split("\n")
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.closes: dict[int, int] = {}
        held: list[int] = []
        for m in _BRACKET.finditer(self.text):
            if m[0] in "({[":
                held.append(m.start())
            elif not held or self.text[held[-1]] + m[0] not in ("()", "{}", "[]"):
                raise ValueError("brackets do not pair")
            else:
                self.closes[held.pop()] = m.start()
        if held:
            raise ValueError("brackets do not pair")
        self.opens = sorted(self.closes)

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def outside(self, pattern: re.Pattern, low: int, high: int):
        """Matches outside all brackets between two places; the caller sends back where to go on."""
        at, found = low, pattern.search(self.text, low, high)
        while found:
            if found.start() < at:
                found = pattern.search(self.text, at, high)
                continue
            k = bisect_left(self.opens, at)
            if k < len(self.opens) and self.opens[k] < found.start():
                at = self.closes[self.opens[k]] + 1
                continue
            at = max((yield found) or 0, found.end())
            found = pattern.search(self.text, at, high)

    def body(self, at: int, high: int, one_line: bool) -> tuple[int, int | None]:
        """Where a declaration ends, and where its body of braces opens, if it has one."""
        for m in _STOP.finditer(self.text, at, high):
            if m.start() < at:
                continue
            if m[0] == "{":
                end = self.closes[m.start()]
                more = _BRACE.match(self.text, end + 1)
                if more:  # what came first was a type
                    at = more.end() - 1
                    continue
                return end, m.start()
            if m[0] in "([":
                at = self.closes[m.start()] + 1
            elif m[0] == ";" or (one_line and not _ON.match(self.text, m.start())):
                return m.start(), None
        return high - 1, None

    def start(self, at: int, least: int) -> int:
        """The first line of what stands above a declaration and belongs to it: comments, attributes, decorators."""
        first = self.line(at)
        while first - 1 > least and _ABOVE.match(self.lines[first - 2]):
            first -= 1
        return first


def spans(source: str, language: str) -> list[Span]:
    """First line, last line, name and kind of each declaration, in order, none over another.

    Methods are named after their type, whose own span ends where its first method starts; one
    on its type's first line stays with it. Imports that follow each other
    are one span. Raises ValueError if brackets do not pair.
    """
    src = _Source(source, language)
    out: list[Span] = []

    def add(first: int, last: int, name: str | None, kind: str) -> None:
        if out and kind == out[-1][3] == "imports" and not "".join(src.lines[out[-1][1] : first - 1]).strip():
            out[-1] = (out[-1][0], max(last, out[-1][1]), None, kind)
        elif out and first <= out[-1][1]:  # both on one line: it stays with the first
            out[-1] = (out[-1][0], max(last, out[-1][1]), *out[-1][2:])
        else:
            out.append((first, last, name, kind))

    walk = src.outside(_TOP[language], 0, len(src.text))
    m = next(walk, None)
    while m:
        groups = m.groupdict()
        kind = next(k for k in _KINDS if groups.get(k))
        name = next((groups[g] for g in ("f", "c", "i", "t", "s", "m", "n") if groups.get(g)), None)
        if kind == "method":
            name = f"{groups['of']}.{name}"
        begin = m.end("type_alias") - 1 if language == "go" and groups.get("type_alias") else m.end()
        end, opened = src.body(begin, len(src.text), one_line=kind in ("imports", "type_alias") and language != "rust" or language == "go")
        if kind == "imports" and language in ("javascript", "typescript") and opened is not None:
            end, _ = src.body(end + 1, len(src.text), one_line=True)
        first, last = src.start(m.start() + len(m[0]) - len(m[0].lstrip()), out[-1][1] if out else 0), src.line(end)
        methods: list[Span] = []
        if opened is not None and (language, kind) in _HOLDS:
            inner = src.outside(_METHOD[language], opened + 1, end)
            one = next(inner, None)
            while one:
                stop, braces = src.body(one.end(), end, one_line=False)
                if braces is not None:
                    low = max(methods[-1][1] if methods else first, src.line(opened))
                    methods.append((src.start(one.start("name"), low), src.line(stop), f"{name}.{one['name']}", "method"))
                try:
                    one = inner.send(stop + 1)
                except StopIteration:
                    one = None
        if methods and methods[0][0] > first:
            add(first, methods[0][0] - 1, name, kind)
        elif not methods:
            add(first, last, name, kind)
        for span in methods:
            add(*span)
        try:
            m = walk.send(end + 1)
        except StopIteration:
            m = None
    return out
