"""Comments and docstrings of code blocks: where they are and which of their words are prose.

A lexer per family of languages skips strings and finds comments; Python docstrings come from the syntax
tree. Prose is taken line by line, without comment markers, tags and decoration. Code of an unknown
language has no comments, so it is never changed.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache

_C = {"line": ("//",), "block": (("/*", "*/"),), "quotes": "\"'`"}
_HASH = {"line": ("#",), "block": (), "quotes": "\"'", "spaced": True}
# Comment marks of each family and the names of its languages.
FAMILIES = {
    "javascript js jsx mjs typescript ts tsx csharp cs c-sharp c# cpp c++ c java go rust rs php kotlin swift scala dart bicep json5 jsonc groovy": _C,
    "kusto kql": {"line": ("//",), "block": (), "quotes": "\"'"},
    "css": {"line": (), "block": (("/*", "*/"),), "quotes": "\"'"},
    "scss sass less": {"line": ("//",), "block": (("/*", "*/"),), "quotes": "\"'"},
    "python py": {"line": ("#",), "block": (), "quotes": "\"'", "triple": True},
    "bash sh shell zsh yaml yml toml dockerfile docker makefile make hash perl r elixir nix conf graphql gql": _HASH,
    "ruby rb": {**_HASH, "block": (("=begin", "=end"),)},
    "powershell ps1 pwsh": {**_HASH, "block": (("<#", "#>"),)},
    "terraform hcl tf": {**_HASH, "line": ("#", "//"), "block": (("/*", "*/"),)},
    "sql tsql plsql mysql postgresql": {"line": ("--",), "block": (("/*", "*/"),), "quotes": "'"},
    "xml html svg xaml vue": {"line": (), "block": (("<!--", "-->"),), "quotes": ""},
    "lua": {"line": ("--",), "block": (("--[[", "]]"),), "quotes": "\"'"},
    "haskell hs elm": {"line": ("--",), "block": (("{-", "-}"),), "quotes": '"'},
    "vb vbnet vbscript": {"line": ("'",), "block": (), "quotes": '"'},
    "erlang matlab tex": {"line": ("%",), "block": (), "quotes": '"'},
    "lisp clojure scheme elisp": {"line": (";",), "block": (("#|", "|#"),), "quotes": '"'},
    "ini properties": {"line": (";", "#"), "block": (), "quotes": "", "own": True},
    "batch bat cmd": {"line": ("::", "REM ", "rem ", "@REM ", "@rem "), "block": (), "quotes": "", "own": True},
}
_SPEC = {name: spec for names, spec in FAMILIES.items() for name in names.split()}

# Comments that tools read, and notices that must stay as they are.
_DIRECTIVE = re.compile(
    r"^(?:!|noqa|pylint|flake8|mypy|ruff|type:|pragma|fmt:|isort:|eslint|jshint|tslint|prettier|@ts-|ts-|istanbul|c8 |webpack|#?(?:end)?region|"
    r"nolint|go:|\+build|shellcheck|rubocop|clang-format|syntax=|yaml-language-server|vim:|-\*-|SPDX-|copyright|\(c\)|licen[sc]ed? )",
    re.IGNORECASE,
)
_TAG = re.compile(r"^(?:@(?:param|arg|property|typeparam|exception)\b(?:\s+\{[^}]*\})?(?:\s+\[?[\w$.=]+\]?(?=\s))?(?:\s+-)?|@(?:returns?|throws?|see|deprecated)\b(?:\s+\{[^}]*\})?|:(?:param|type|returns?|rtype|raises?)\b[^:]*:|(?:TODO|FIXME|NOTE|HACK|XXX|BUG)(?:\([^)]*\))?:)\s*")
_CODE = re.compile(
    r"[;{}]\s*$|^[\w$.\[\]\"']+\s*(?:[-+*/|&]|:)?=(?!=)\s*\S|^[\w$.]+\([^)]*\)\s*$|^(?:import|from|using|#include|package)\s+[\w.<\"]+\s*(?:$|;|import\b)|"
    r"^(?:const|let|var|def|class|func|fn|return)\s+[\w$]+\s*(?:[(={:;]|$)|^</?\w+[^>]*>\s*$|^(?:\$|>|PS>)\s"
)
_LETTER = re.compile(r"[^\W\d_]")
_SECTION = re.compile(r"^(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Attributes|Keyword Args|Other Parameters|Examples?|Notes?|See Also|References|Warnings?)\s*:?\s*$")
_ITEM = re.compile(r"^\*{0,2}[\w.]+(?:\s*\([^)]*\))?:\s+(?=\S)")


def language(info: str) -> str:
    """The language of a fence's info string: its first word, without braces and dot, in lower case."""
    word = info.strip().split()[0] if info.strip() else ""
    return word.strip("{}").lstrip(".").split(",")[0].split("{")[0].lower()


@lru_cache
def _lexer(name: str) -> re.Pattern | None:
    spec = _SPEC.get(name)
    if spec is None:
        return None
    parts = [f"(?P<b{i}>{re.escape(a)}.*?(?:{re.escape(z)}|\\Z))" for i, (a, z) in enumerate(spec["block"])]
    if spec.get("triple"):
        parts.append(r'[rRbBfFuU]{0,2}(?:"""(?:\\.|.)*?"""|' + r"'''(?:\\.|.)*?''')")
    if spec["line"]:
        before = r"(?m:^[ \t]*)" if spec.get("own") else r"(?:(?<=\s)|(?m:^))" if spec.get("spaced") else ""
        parts.append(f"{before}(?P<line>(?:{'|'.join(map(re.escape, spec['line']))})[^\\n]*)")
    for q in spec["quotes"]:
        parts.append(rf"`(?:\\.|[^`\\])*`" if q == "`" else rf"{q}(?:\\.|[^{q}\\\n])*{q}")
    return re.compile("|".join(parts), re.DOTALL)


def find_comments(name: str, code: str) -> list[tuple[int, int, int, int]] | None:
    """(start, end, inner start, inner end) of every comment; None for an unknown language."""
    lexer = _lexer(name)
    if lexer is None:
        return None
    spec, out = _SPEC[name], []
    for m in lexer.finditer(code):
        kind = m.lastgroup
        if kind == "line":
            a, b = m.span("line")
            mark = max((x for x in spec["line"] if code.startswith(x, a)), key=len)
            inner = a + len(mark)
            while inner < b and code[inner] in mark[-1] + "!/" and mark.strip()[-1] in "/#;-%":
                if code[inner] == "!" and code[a : a + 2] == "#!":
                    break
                inner += 1
            out.append((a, b, inner, b))
        elif kind:
            a, b = m.span()
            opener, closer = spec["block"][int(kind[1:])]
            out.append((a, b, a + len(opener), b - len(closer) if code.endswith(closer, a + len(opener), b) else b))
    return out


def docstrings(code: str) -> list[tuple[int, int, int, int]]:
    """Like find_comments, for triple-quoted docstrings of Python; none where the code doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    starts, at = [], 0
    for line in code.split("\n"):
        starts.append(at)
        at += len(line) + 1
    lines = code.split("\n")

    def offset(row: int, col: int) -> int:
        return starts[row - 1] + len(lines[row - 1].encode("utf-8", "surrogatepass")[:col].decode("utf-8", "surrogatepass"))

    out = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) or not node.body:
            continue
        first = node.body[0]
        if not isinstance(first, ast.Expr) or not isinstance(first.value, ast.Constant) or not isinstance(first.value.value, str):
            continue
        a, b = offset(first.lineno, first.col_offset), offset(first.end_lineno, first.end_col_offset)
        m = re.match(r"[rRuU]?(\"\"\"|''')", code[a:b])
        if m and code[a:b].count(m[1]) == 2:
            out.append((a, b, a + m.end(), b - 3))
    return sorted(out)


def _lines(code: str, a: int, b: int):
    at = a
    for line in code[a:b].split("\n"):
        yield at, line.rstrip("\r")
        at += len(line) + 1


def prose(name: str, code: str, comments: bool = True, strings: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, comment | docstring) of every line of prose, in order; nothing overlaps.

    Skipped are tool directives, notices, commented-out code, lines without letters, and in docstrings
    section titles, examples and lines with a backslash. Tags such as ``@param x`` stay outside.
    """
    out = []
    for _, _, a, b in (find_comments(name, code) or []) if comments else []:
        example = False
        for at, line in _lines(code, a, b):
            m = re.match(r"[ \t]*(?:\*+(?=\s|$)|[*/!]+(?=\s))?[ \t]*", line)
            body = line[m.end() :].rstrip()
            body = re.sub(r"\s*\*+$", "", body)
            example = body.startswith("@example") or example and not body.startswith("@")
            if example or _DIRECTIVE.match(body) or body.startswith(">>>") or _CODE.search(body) or body.endswith("\\"):
                continue
            start = at + m.end()
            if t := _TAG.match(body):
                start, body = start + t.end(), body[t.end() :]
            if _LETTER.search(body):
                out.append((start, start + len(body), "comment"))
    for _, _, a, b in docstrings(code) if strings and name in ("python", "py") else []:
        section, depth, skip = "", 0, False
        for at, line in _lines(code, a, b):
            body = line.strip()
            indent = len(line) - len(line.lstrip())
            if _SECTION.match(body):
                section, depth, skip = body.rstrip(": "), indent, False
                continue
            if not body:
                skip = False
                continue
            if section and indent < depth:
                section = ""
            skip = skip or body.startswith((">>>", "..."))
            if skip or section.startswith("Example") and indent > depth or "\\" in body:
                continue
            start = at + indent
            if t := _TAG.match(body) or (_ITEM.match(body) if section and indent > depth else None):
                start, body = start + t.end(), body[t.end() :]
            if _LETTER.search(body) and not _CODE.search(body):
                out.append((start, start + len(body), "docstring"))
    return sorted(out)


def fingerprint(name: str, code: str) -> str:
    """The code without comments and docstrings, white space collapsed: equal before and after translation."""
    out, at = [], 0
    for a, b, *_ in sorted([*(find_comments(name, code) or []), *(docstrings(code) if name in ("python", "py") else [])]):
        if a >= at:
            out.append(code[at:a])
            at = b
    return " ".join("".join([*out, code[at:]]).split())
