"""Translate ECMAScript patterns to Java's (Spark) and RE2's (oracle) dialects."""

from __future__ import annotations



def spaces(java: bool = True) -> str:
    point = lambda h: f"\\x{{{h}}}"
    parts = ["\\t\\n\\x0B\\f\\r " if java else "\\t\\n\\v\\f\\r ", point("A0"), point("1680"), f"{point('2000')}-{point('200A')}"]
    return "".join([*parts, *(point(h) for h in ("2028", "2029", "202F", "205F", "3000", "FEFF"))])


JS_WS = spaces()
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def translate(pattern: str, ignore_case: bool = False, java: bool = True) -> str:
    """ECMAScript without the m, s and u flags: ASCII \\b, \\w and \\d, Unicode \\s, $ only at the very end."""
    out, i, in_class = ["(?i)" if ignore_case else ""], 0, False
    ws = spaces(java)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            i += 2
            if two == "\\s":
                out.append(ws if in_class else f"[{ws}]")
            elif two == "\\b" and java and not in_class:
                out.append(_BOUNDARY)
            elif two == "\\u":
                out.append(f"\\x{{{pattern[i : i + 4]}}}")
                i += 4
            elif two == "\\-" and not java:
                out.append("\\-")
            else:
                out.append(two)
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "[" and in_class and java:
            c = "\\["
        elif c == "]" and in_class:
            in_class = False
        elif c == "$" and not in_class:
            c = "\\z"
        elif c == "." and not in_class:
            c = "[^\\n\\r\\x{2028}\\x{2029}]"
        elif c == "}" and java and not in_class and not _closes(pattern, i):
            c = "\\}"
        out.append(c)
        i += 1
    return "".join(out)


def _closes(pattern: str, i: int) -> bool:
    """Does the brace at i end a quantifier."""
    start = pattern.rfind("{", 0, i)
    return start > 0 and pattern[start - 1] != "\\" and all(c in "0123456789," for c in pattern[start + 1 : i]) and i > start + 1


def needed_literals(pattern: str, ignore_case: bool = False) -> list[str] | None:
    """Texts of which every match of the pattern contains one, lower-cased with ignore_case; None if there are no useful ones.

    Of the parts of a sequence the best counts, alternatives add up, and what may be absent says nothing.
    """
    from re import _constants as op
    from re import _parser

    fold = str.lower if ignore_case else str

    def better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
        rank = lambda x: (0,) if x is None else (min(map(len, x)), -len(x))
        return a if rank(a) >= rank(b) else b

    def of(items) -> list[str] | None:
        best, run = None, ""
        for kind, value in items:
            if kind is op.LITERAL:
                run += fold(chr(value))
                continue
            best, run = better(best, [run] if run else None), ""
            inner = None
            if kind is op.BRANCH:
                parts = [of(x) for x in value[1]]
                inner = None if None in parts else [x for p in parts for x in p]
            elif kind is op.SUBPATTERN:
                inner = of(value[3])
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                inner = of(value[2])
                if inner and len(inner) == 1 and len(value[2]) == 1 and value[2][0][0] is op.LITERAL:
                    inner = [inner[0] * value[0]]
            best = better(best, inner)
        return better(best, [run] if run else None)

    found = of(_parser.parse(pattern))
    return None if found is None or min(map(len, found)) < 2 else sorted(set(found))
