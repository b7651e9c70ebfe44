"""Tokens of source files: one kind for each token, and where it starts. BAD is a token that no language has."""

from __future__ import annotations

import re

# ---- Fixed values: keywords and operators of the languages. ----

KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "javascript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async get set of from as enum",
    "typescript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async get set of from as enum implements interface public private protected readonly abstract declare type namespace module keyof infer is unique asserts satisfies override global",
    "java": "assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while record sealed permits var yield non when",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
}
KINDS = {
    "java": dict.fromkeys("public private protected abstract native strictfp transient volatile".split(), "MOD") | dict.fromkeys("int long short byte char boolean float double void".split(), "PRIM") | dict.fromkeys("true false null".split(), "NUM"),
    "javascript": dict.fromkeys("true false null".split(), "NUM"),
    "typescript": dict.fromkeys("true false null".split(), "NUM"),
    "rust": {"true": "NUM", "false": "NUM", "_": "_"},
    "python": dict.fromkeys("None True False".split(), "NUM"),
}
COMMON = dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^= //= @=".split(), "ASSIGN")
OPERATORS = {
    "go": COMMON | dict.fromkeys("+ - ^".split(), "SIGN") | {"!": "OP1"} | dict.fromkeys("/ % << >> &^ && || == != <= >=".split(), "OP") | dict.fromkeys("++ --".split(), "INC"),
    "javascript": COMMON | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("! ~".split(), "OP1") | dict.fromkeys("/ % ** & | ^ << && || ?? == != === !== <=".split(), "OP") | dict.fromkeys("++ --".split(), "INC"),
    "typescript": COMMON | dict.fromkeys("+ -".split(), "SIGN") | {"~": "OP1"} | dict.fromkeys("/ % ** ^ << && || ?? == != === !== <=".split(), "OP") | dict.fromkeys("++ --".split(), "INC"),
    "java": COMMON | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("! ~".split(), "OP1") | dict.fromkeys("/ % ^ << && || == != <=".split(), "OP") | dict.fromkeys("++ --".split(), "INC"),
    "rust": COMMON | {"-": "SIGN"} | dict.fromkeys("/ % ^ << == != <=".split(), "OP"),
    "python": COMMON | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("// % & | ^ << >>".split(), "OP") | dict.fromkeys("< > == >= <= !=".split(), "COMP"),
}
MARKS = {
    "go": [":=", "<-", "...", "*", "&", "|", "<", ">", "~"],
    "javascript": ["=>", "?.", "...", "*", "<", ">", "?", "@", "#"],
    "typescript": ["=>", "?.", "...", "*", "<", ">", "?", "@", "#", "&", "|", "!"],
    "java": ["->", "::", "...", "*", "&", "|", "<", ">", "?", "@"],
    "rust": ["::", "->", "=>", "..=", "...", "..", "&&", "||", "*", "+", "&", "|", "<", ">", "?", "!", "@", "#", "~", "$"],
    "python": ["->", ":=", "...", "**", "*", "/", "@", "~"],
}
#: After these a slash starts a regular expression.
BEFORE_REGEX = frozenset("OP OP1 SIGN ASSIGN = ( , : [ ! & | ? { } ; => return typeof case in of do else instanceof new delete void throw await yield BR < > * ${".split())

CONFLICT = r"(?P<conflict>^(?:<{7}|={7}|>{7}|\|{7})(?= |\r?$).*)"
NUMBER = r"(?P<num>0[xXbBoO][\w.]+|(?>(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?SUFFIX?)(?!\w))"
#: Letters that may follow the digits of a number.
SUFFIXES = {"go": "i", "javascript": "n", "typescript": "n", "java": "[lLfFdD]", "python": "[jJ]"}
WORD = r"(?P<word>[^\W\d][\w$]*)"


def _compiled(language: str) -> re.Pattern[str]:
    ops = sorted([*OPERATORS[language], *MARKS[language], *"()[]{},;:.="], key=len, reverse=True)
    operators = "(?P<op>" + "|".join(map(re.escape, ops)) + ")"
    comments = r"(?P<skip>[ \t\f\v ﻿]+|//[^\n]*|/\*.*?\*/)"
    line = r"(?P<nl>\r?\n)"
    strings = {
        "go": r"(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)')",
        "javascript": r"(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<tpl>`)",
        "java": r"(?P<str>\"\"\"[\s\S]*?(?<!\\)\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^'\n]+|\\')')",
        "rust": r"(?P<str>(?:br|cr|r)(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:[^u\n]|u\{\w+\}|x\w\w))')|(?P<life>'[^\W\d]\w*(?!'))",
        "python": r"(?P<str>(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'))",
    }
    strings["typescript"] = strings["javascript"]
    if language == "python":
        comments = r"(?P<skip>[ \t\f ﻿]+|#[^\n]*|\\\r?\n)"
    after = r"(?:(?!\w)|(?=(?:if|else|and|or|in|is|not|for)\b))" if language == "python" else r"(?!\w)"  # Python lets some words follow at once
    number = NUMBER.replace("SUFFIX", SUFFIXES[language]).replace(r"(?!\w)", after) if language != "rust" else r"(?P<num>0[xXbBoO]\w+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?\w*)"
    word = WORD if language != "rust" else r"(?P<word>(?:r#)?[^\W\d]\w*)"
    if language in ("javascript", "typescript"):
        word = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)"
    flags = re.M | (re.S if language != "python" else 0)
    comments = comments.replace("[^\\n]*", "[^\\n]*")
    # What is frequent is tried first, and white space after a token goes with it: most tokens have some, and a match for itself costs as much as
    # a token. A word before a quote or # may be the beginning of a string.
    marks = r"(?P<mark>[()\[\]{},;])"
    first = word
    if language in ("python", "rust"):
        first = r"(?P<word>[^\W\d]\w*+(?![\"'#$]))"
        number += "|" + word.replace("<word>", "<prefix>")
    conflict = CONFLICT.replace(".*)", "[^\\n]*)")
    return re.compile("(?:" + "|".join([first, marks, line, comments, strings[language], number, conflict, operators, r"(?P<bad>\S)"]) + r")[ \t]*+", flags)


_patterns: dict[str, re.Pattern[str]] = {}
_kinds: dict[str, dict[str, str]] = {}
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")


TEMPLATE = re.compile(r"(?:[^\\`$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")


def tokens(text: str, language: str) -> tuple[list[str], list[int]]:
    """(kinds, starts) of a file in one of the languages with braces, or Python without its lines.

    A template literal is STR, or TPL and its substitutions between ${ and $}.
    """
    if language not in _patterns:
        _patterns[language] = _compiled(language)
        words = dict.fromkeys(KEYWORDS[language].split())
        _kinds[language] = {w: w for w in words} | KINDS.get(language, {}) | OPERATORS[language]
    pattern, kinds = _patterns[language], _kinds[language]
    script = language in ("javascript", "typescript")
    out: list[str] = []
    starts: list[int] = []
    at, last = 0, ""
    depth: list[str] = []
    goes_on = False
    if text.startswith("#!"):
        at = (text + "\n").index("\n")
    if language == "python":
        return _python_parts(text, at, len(text), pattern, kinds)
    if not script:
        return _plain_tokens(text, at, language, pattern, kinds)
    match = pattern.match
    word, mark, op, skip, line = (pattern.groupindex[k] for k in ("word", "mark", "op", "skip", "nl"))
    n = len(text)
    while at < n:
        m = match(text, at)
        if m is None:
            at += 1
            continue
        kind, start, at = m.lastindex, at, m.end()
        if kind == skip:
            continue
        if kind == word:
            last = kinds.get(m[word], "ID")
            if last != "ID" and out and out[-1] in (".", "?."):
                last = "KEY"
        elif kind == op or kind == mark:
            t = m[kind]
            last = kinds.get(t, t)
            if t[0] == "/" and (not out or out[-1] in BEFORE_REGEX) and (r := REGEX.match(text, start)):
                last, at = "REGEX", r.end()
            elif t in ("(", "[", "{"):
                depth.append(t)
            elif t in (")", "]", "}") and depth:
                if "${" not in depth:
                    depth.pop()
                elif t != "}":
                    if depth[-1] == ("(" if t == ")" else "["):
                        depth.pop()
                else:  # the end of a substitution, whatever is left open in it, or of a brace within
                    k = max(k for k, o in enumerate(depth) if o in ("{", "${"))
                    if depth[k] == "${":
                        last, goes_on = "$}", True
                    del depth[k:]
        elif kind == line:
            if depth and depth[-1] != "{" or last == "BR":
                continue
            last = "BR"
        elif m.lastgroup == "num":
            last = "NUM"
        elif m.lastgroup == "str":
            last = "STR"
        elif m.lastgroup == "tpl":
            part = TEMPLATE.match(text, at)
            last, at = ("BAD", n) if not part else ("STR", part.end()) if part[1] == "`" else ("TPL", at)
            goes_on = last == "TPL"
        else:
            last = "BAD"
        out.append(last)
        starts.append(start)
        if goes_on:  # the template's text up to its end or next substitution
            goes_on, start = False, at
            part = TEMPLATE.match(text, at)
            at = part.end() if part else n
            if not part or part[1] == "${":
                last = "${" if part else "BAD"
                out.append(last)
                starts.append(max(start, at - 2))
                if part:
                    depth.append("${")
    return out, starts


SIMPLE = {"num": "NUM", "str": "STR", "h": "STR", "life": "LIFE"}


def _plain_tokens(text: str, at: int, language: str, pattern: re.Pattern[str], kinds: dict[str, str]) -> tuple[list[str], list[int]]:
    """Tokens of languages whose lexing needs no context; Go gets its semicolons."""
    out: list[str] = []
    starts: list[int] = []
    go, last = language == "go", ""
    get, put, mark = kinds.get, out.append, starts.append
    word, mark_, op, skip, line = (pattern.groupindex[k] for k in ("word", "mark", "op", "skip", "nl"))
    prefix = pattern.groupindex.get("prefix")
    for m in pattern.finditer(text, at):
        kind = m.lastindex
        if kind == word:
            last = get(m[word], "ID")
        elif kind == mark_:
            last = m[mark_]
        elif kind == op:
            last = m[op]
            last = get(last, last)
        elif kind == prefix:
            last = get(m[prefix], "ID")
        elif kind == skip or kind == line:
            if go and last in GO_ENDS and (kind == line or "\n" in m[0]):
                last = ";"
            else:
                continue
        else:
            last = SIMPLE.get(m.lastgroup, "BAD")
        put(last)
        mark(m.start())
    if go and last in GO_ENDS:
        put(";")
        mark(len(text))
    return out, starts


FORMATTED = re.compile(r"[rR]?[fFtT][rR]?(\"{3}|'{3}|\"|')")


def _python_parts(text: str, at: int, end: int, pattern: re.Pattern[str], kinds: dict[str, str]) -> tuple[list[str], list[int]]:
    """Tokens of Python with its line ends. A formatted string is STR, with its replacement fields between ${ and $} after it."""
    out: list[str] = []
    starts: list[int] = []
    get, put, mark = kinds.get, out.append, starts.append
    word, mark_, op, skip, line, string, prefix = (pattern.groupindex[k] for k in ("word", "mark", "op", "skip", "nl", "str", "prefix"))
    while at < end:
        for m in pattern.finditer(text, at, end):
            kind = m.lastindex
            if kind == skip:
                continue
            start = m.start()
            if kind == word:
                put(get(m[word], "ID"))
            elif kind == mark_:
                put(m[mark_])
            elif kind == op:
                t = m[op]
                put(get(t, t))
            elif kind == prefix:
                at = m.end(prefix)
                if at < end and text[at] in "\"'" and (f := FORMATTED.match(text, start)):
                    break
                put(get(m[prefix], "ID"))
            elif kind == string and (f := FORMATTED.match(text, start)):
                break
            elif kind == line:
                put("nl")
                start = m.end(line) - 1
            else:
                put(SIMPLE.get(m.lastgroup, "BAD"))
            mark(start)
        else:
            break
        put("STR")
        mark(start)
        at = _format(text, f.end(), end, f[1], out, starts, pattern, kinds)
    return out, starts


def _format(text: str, at: int, end: int, quote: str, out: list[str], starts: list[int], pattern: re.Pattern[str], kinds: dict[str, str]) -> int:
    """Reads a formatted string from `at` to its closing quote, or a field's format up to its brace (no quote); gives the place after it."""
    while at < end:
        c = text[at]
        if quote and text.startswith(quote, at):
            return at + len(quote)
        if not quote and c == "}":
            return at
        if c == "\n" and len(quote) == 1:
            break
        if c == "\\" and quote:
            at += 2
        elif c in "{}" and quote and text.startswith(c * 2, at):
            at += 2
        elif c == "{":
            out.append("${")
            starts.append(at)
            stop = _field_end(text, at + 1, end)
            inner = text[at + 1 : stop].rstrip()
            size = len(inner) - 1 if inner.endswith("=") and inner[-2:-1] not in ("=", "!", "<", ">") else len(inner)
            for k, s in zip(*_python_parts(text, at + 1, at + 1 + size, pattern, kinds)):
                if k != "nl":
                    out.append(k)
                    starts.append(s)
            out.append("$}")
            starts.append(min(stop, len(text)))
            conversion = re.compile(r"(?:![rsa]\s*)?").match(text, stop, end)
            at = conversion.end()
            if text.startswith(":", at):
                at = _format(text, at + 1, end, "", out, starts, pattern, kinds)
            if not text.startswith("}", at):
                break
            at += 1
        elif c == "}":
            break
        else:
            at += 1
    out.append("BAD")
    starts.append(min(at, len(text)))
    # Where it can't go on, the string is taken to end with its line, or with its quote.
    stop = text.find(quote if len(quote) == 3 else "\n", at, end)
    return end if stop < 0 else stop + (3 if len(quote) == 3 else 0)


def _field_end(text: str, at: int, end: int) -> int:
    """Where the expression of a replacement field ends: at its brace, conversion or format."""
    depth = 0
    while at < end:
        c = text[at]
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif c == "}":
            return at
        elif not depth and (c == ":" and text[at + 1 : at + 2] != "=" or c == ":" or c == "!" and text[at + 1 : at + 2] != "="):
            return at
        elif c in "\"'":
            quote = text[at : at + 3] if text[at : at + 3] in ('"' * 3, "'" * 3) else c
            stop = at + len(quote)
            while stop < end and not text.startswith(quote, stop):
                stop += 2 if text[stop] == "\\" else 1
            at = stop + len(quote)
            continue
        at += 1
    return end


#: After these a line end is a semicolon in Go.
GO_ENDS = frozenset("ID NUM STR break continue fallthrough return INC ) ] }".split())


def python_tokens(text: str) -> tuple[list[str], list[int]]:
    """Tokens with NL at the ends of logical lines; blocks stand between INDENT and DEDENT."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    kinds: list[str] = []
    starts: list[int] = []
    levels, depth, begin, fresh = [0], 0, 0, True
    for k, s in zip(*tokens(text, "python")):
        if k == "nl":
            if not depth:
                if not fresh:
                    kinds.append("NL")
                    starts.append(s)
                begin, fresh = s + 1, True
            continue
        if fresh:
            fresh = False
            lead = text[begin:s]
            width = len(lead.expandtabs(8)) if "\t" in lead else s - begin
            if width > levels[-1]:
                levels.append(width)
                if len(kinds) > 1 and kinds[-1] == "NL" and kinds[-2] == ":":
                    kinds.pop()
                    starts.pop()
                kinds.append("INDENT")
                starts.append(s)
            while width < levels[-1]:
                levels.pop()
                kinds.append("DEDENT")
                starts.append(s)
                if width > levels[-1]:
                    kinds.append("BAD")
                    starts.append(s)
                    levels.append(width)
        if k in "([{":
            depth += 1
        elif k in ")]}" and depth:
            depth -= 1
        kinds.append(k)
        starts.append(s)
    if not fresh:
        kinds.append("NL")
        starts.append(len(text))
    kinds += ["DEDENT"] * (len(levels) - 1)
    starts += [len(text)] * (len(levels) - 1)
    return soft_keywords(kinds, starts, text), starts


def soft_keywords(kinds: list[str], starts: list[int], text: str) -> list[str]:
    """match, case and type stand for themselves only where a statement of theirs is."""
    for i, k in enumerate(kinds):
        if k == "ID" and (not i or kinds[i - 1] in ("NL", "INDENT", "DEDENT")):
            word = re.compile(r"\w+").match(text, starts[i])
            if word and word[0] in ("match", "case") and i + 1 < len(kinds) and kinds[i + 1] not in ("=", ".", "ASSIGN", ",", ":", "NL"):
                j = i + 1
                while j < len(kinds) and kinds[j] not in ("NL", "INDENT"):
                    j += 1
                if kinds[j - 1] == ":":
                    kinds[i] = word[0]
    return kinds


JSON = re.compile(r"(?P<skip>[ \t\r\n]+)|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|(?P<word>true|false|null)\b|(?P<op>[{}\[\],:])|(?P<bad>\S)")
JSON_KINDS = {"str": "STR", "num": "NUM", "word": "WORD", "bad": "BAD"}


def json_tokens(text: str) -> tuple[list[str], list[int]]:
    kinds, starts = [], []
    for m in JSON.finditer(text.removeprefix("﻿")):
        if (k := m.lastgroup) != "skip":
            kinds.append(JSON_KINDS.get(k) or m[0])
            starts.append(m.start())
    return kinds, starts


PLAIN = r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s]))"
YAML_KEY = re.compile(r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|(?:&[^\s]+[ ]+|![^\s]*[ ]+)*" + PLAIN + r"(?:[^\n:#]|:(?=[^\s])|(?<=\S)#)*?)[ ]*:(?=[ \t]|\r?$)|:(?=[ ]|$)", re.M)
YAML_FLOW = re.compile(r"(?P<skip>[ \t\r\n]+|(?<=\s)#[^\n]*)|(?P<str>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')|(?P<op>[{}\[\],]|:(?=[\s,\[\]{}\"']|$))|(?P<prop>[!&][^\s,\[\]{}]*)|(?P<alias>\*[^\s,\[\]{}]+)|(?P<plain>(?:[^\s,\[\]{}#&*!|>'\"%@`:-]|[-?:](?=[^\s,\[\]{}]))(?:[^\s,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ ]+(?=[^\s,\[\]{}:#]))*)|(?P<bad>\S)")


def yaml_tokens(text: str) -> tuple[list[str], list[int]]:
    """Block structure as indentation groups; flow collections as brackets; a plain scalar is one token."""
    kinds: list[str] = []
    starts: list[int] = []
    text = text.replace("\r\n", "\n").removeprefix("﻿")
    lines = text.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    levels = [-1]

    def put(k: str, at: int) -> None:
        kinds.append(k)
        starts.append(at)

    def close(width: int, at: int) -> None:
        while levels[-1] > width:
            levels.pop()
            put("DEDENT", at)

    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip(" \t\r")
        at = offsets[i]
        if not bare or bare[0] == "#":
            i += 1
            continue
        if re.match(r"(?:<{7}|={7}|>{7})(?: |$)", line):
            put("BAD", at)
            i += 1
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            close(-1, at)
            put("DOC", at)
            line = line[3:]
            bare = line.strip()
            if not bare or bare[0] == "#":
                i += 1
                continue
            line = "   " + line
        if line[0] == "%" and levels == [-1] and all(k == "DOC" for k in kinds):
            i += 1
            continue
        width = len(line) - len(line.lstrip(" "))
        if line[width] == "\t":
            put("BAD", at)
            i += 1
            continue
        column = width
        if width < levels[-1]:
            close(width, at)
            if levels[-1] != width and levels[-1] != -1:
                put("BAD", at)
        if width > levels[-1]:
            if kinds and kinds[-1] == "NL" and len(levels) > 1 and not (len(kinds) > 1 and kinds[-2] in ("KEY", "DASH", "PROP")):
                put("BAD", at)  # deeper than anything that asks for it
                i += 1
                continue
            levels.append(width)
            put("INDENT", at)
        # The parts of the line: dashes, a key, a value.
        while True:
            rest = line[column:]
            if m := re.match(r"-(?:[ \t]+|$)", rest):
                put("DASH", at + column)
                inner = column + len(m[0])
                if not rest[len(m[0]) :].strip() or rest[len(m[0]) :].lstrip().startswith("#"):
                    put("NL", at + column)
                    i += 1
                    break
                column = inner
                follow = line[column:]
                if re.match(r"-(?:[ \t]+|$)", follow) or YAML_KEY.match(follow) and follow[0] not in "[{":
                    levels.append(column)
                    put("INDENT", at + column)
                continue
            if (m := YAML_KEY.match(rest)) and rest[0] not in "[{":
                put("KEY", at + column)
                column += len(m[0])
                value = line[column:].lstrip(" \t")
                column = len(line) - len(value)
                if not value or value[0] == "#":
                    put("NL", at + column)
                    i += 1
                    break
            value = line[column:]
            while m := re.match(r"[!&][^\s]*(?:[ \t]+|$)", value):
                put("PROP", at + column)
                column += len(m[0])
                value = line[column:]
            if not value or value[0] == "#":
                put("NL", at + column)
                i += 1
                break
            i = _yaml_value(lines, offsets, i, column, levels[-1], put)
            break
    close(-1, len(text))
    return kinds, starts


def _yaml_value(lines: list[str], offsets: list[int], i: int, column: int, level: int, put) -> int:
    """Reads one value, over several lines if need be; gives the next line."""
    line, at = lines[i], offsets[i] + column
    value = line[column:]
    if value[0] in "|>":
        put("BLOCK" if re.fullmatch(r"[|>][-+0-9]*\s*(?:#.*)?", value) else "BAD", at)
        put("NL", at)
        i += 1
        while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > level):
            i += 1
        return i
    if value[0] == "*":
        put("ALIAS" if re.fullmatch(r"\*[^\s,\[\]{}]+\s*(?:#.*)?", value) else "BAD", at)
        put("NL", at)
        return i + 1
    if value[0] in "\"'":
        text = "\n".join(lines[i:])[column:]
        m = re.match(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'", text)
        if not m:
            put("BAD", at)
            put("NL", at)
            return len(lines)
        used = text[: m.end()].count("\n")
        tail = text[m.end() :].split("\n", 1)[0].strip()
        put("SCALAR" if not tail or tail[0] == "#" else "BAD", at)
        put("NL", at)
        return i + used + 1
    if value[0] in "[{":
        text = "\n".join(lines[i:])[column:]
        depth, end = 0, 0
        for m in YAML_FLOW.finditer(text):
            k = m.lastgroup
            if k != "skip":
                put({"str": "STR", "plain": "SCALAR", "prop": "PROP", "alias": "ALIAS", "bad": "BAD"}.get(k) or m[0], at + m.start())
                depth += (m[0] in ("[", "{")) - (m[0] in ("]", "}")) if k == "op" else 0
            end = m.end()
            if not depth:
                break
        tail = text[end:].split("\n", 1)[0].strip()
        if tail and tail[0] != "#":
            put("BAD", at)
        put("NL", at)
        return i + text[:end].count("\n") + 1
    if value[0] in "%@`" or value[:2] in ("? ",) or not re.match(PLAIN, value):
        put("BAD", at)
        put("NL", at)
        return i + 1
    if re.search(r"(?<!\s#):(?:\s|$)", re.sub(r"\s#.*", "", value)):
        put("BAD", at)  # a mapping within a value on one line
        put("NL", at)
        return i + 1
    put("SCALAR", at)
    i += 1
    while i < len(lines):
        nxt = lines[i]
        bare = nxt.strip()
        if bare and (len(nxt) - len(nxt.lstrip(" ")) <= level or bare[0] == "#"):
            break
        if bare and re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", bare)):
            put("BAD", offsets[i])  # a key where a plain scalar goes on
            i += 1
            break
        i += 1
    put("NL", at)
    return i


RESERVED = frozenset("if then elif else fi while until do done for select case esac function in { } ! time".split())
SHELL_OP = re.compile(r"\n|;;&|;;|;&|;|&&|&>>|&>|&|\|\||\|&|\||\(\(|\(|\)|<<-|<<<|<<|<>|>>|>\||<&|>&|<\(|>\(|<|>")


def _quoted(text: str, at: int) -> int:
    """The end of the quotation, substitution or expansion that starts at `at`; -1 if it doesn't end."""
    c = text[at]
    n = len(text)
    if c == "'":
        return text.find("'", at + 1) + 1 or -1
    if c == "\\":
        return min(at + 2, n)
    if c == "`":
        i = at + 1
        while i < n and text[i] != "`":
            i += 2 if text[i] == "\\" else 1
        return i + 1 if i < n else -1
    if c == '"':
        i = at + 1
        while i < n and text[i] != '"':
            if text[i] == "\\":
                i += 2
            elif text[i] == "`" or text[i] == "$" and text[i + 1 : i + 2] in ("(", "{"):
                i = _quoted(text, i)
                if i < 0:
                    return -1
            else:
                i += 1
        return i + 1 if i < n else -1
    nxt = text[at + 1 : at + 2]
    if c == "$" and nxt in ("'", '"'):
        if nxt == '"':
            return _quoted(text, at + 1)
        m = re.compile(r"'(?:[^'\\]|\\.)*'", re.S).match(text, at + 1)
        return m.end() if m else -1
    if c == "$" and nxt in ("(", "{", "[") or c in "<>" and nxt == "(":
        opener = text[at + 1]
        closer = {"(": ")", "{": "}", "[": "]"}[opener]
        if opener == "(" and text[at + 2 : at + 3] != "(":
            end = _substitution(text, at + 2)
            return end
        depth, i = 1, at + 2
        while i < n and depth:
            d = text[i]
            if d in "'\"`\\" and not (d == "'" and opener == "{" and False) or d == "$" and text[i + 1 : i + 2] in ("(", "{"):
                i = _quoted(text, i)
                if i < 0:
                    return -1
                continue
            depth += (d == opener) - (d == closer)
            i += 1
        return i if not depth else -1
    return at + 1


def _substitution(text: str, at: int) -> int:
    """The end of $( whose content starts at `at`: at its own bracket, whatever case clauses hold."""
    kinds, starts, end = _shell(text, at, True)
    return end


def shell_tokens(text: str) -> tuple[list[str], list[int]]:
    kinds, starts, _ = _shell(text.replace("\\\n", "  ").replace("\\\r\n", "   "), 0, False)
    return kinds, starts


def _shell(text: str, at: int, inner: bool) -> tuple[list[str], list[int], int]:
    """Tokens from `at` on; with `inner` up to the bracket that closes a substitution, and the place after it."""
    kinds: list[str] = []
    starts: list[int] = []
    cases: list[str] = []  # for each open case: "word", "pattern" or "body"
    pending: list[tuple[str, bool]] = []  # here-documents whose text comes after the line
    depth = 0
    n = len(text)
    command = True  # a command may start here

    def put(k: str, s: int) -> None:
        kinds.append(k)
        starts.append(s)

    while at < n:
        c = text[at]
        if c in " \t\r\x0b\x0c":
            at += 1
            continue
        if c == "#":
            at = text.find("\n", at)
            if at < 0:
                break
            continue
        start = at
        m = SHELL_OP.match(text, at)
        if m and not (m[0] in ("<(", ">(")):
            op = m[0]
            at = m.end()
            if op == "((" and command:
                end = re.compile(r"[\s\S]*?\)\)").match(text, at)
                put("ARITH" if end else "BAD", start)
                at = end.end() if end else n
                command = False
                continue
            if op == "((":
                op, at = "(", start + 1
            if op == "\n":
                put("NL", start)
                for mark, tabs in pending:
                    done = False
                    while at < n:
                        stop = text.find("\n", at)
                        line = text[at : stop if stop >= 0 else n]
                        at = stop + 1 if stop >= 0 else n
                        if (line.lstrip("\t") if tabs else line).rstrip("\r") == mark:
                            done = True
                            break
                    if not done:
                        pass  # the end of the file ends a here-document, too
                pending = []
                command = True
            elif op in ("<<", "<<-"):
                w = re.compile(r"[ \t]*(?:'([^'\n]*)'|\"([^\"\n]*)\"|\\?([^\s;&|<>()]+))").match(text, at)
                if not w or re.match(r"<{3,}", text[start:]):
                    put("BAD", start)
                    continue
                pending.append((next(g for g in w.groups() if g is not None), op == "<<-"))
                put("HEREDOC", start)
                at = w.end()
            elif op in ("<", ">", ">>", "<>", ">|", "&>", "&>>", "<&", ">&", "<<<"):
                if kinds and kinds[-1] == "WORD" and start and text[start - 1].isdigit() and re.search(r"(?:^|[\s;&|(])\d+$", text[max(0, start - 12) : start]):
                    kinds.pop()
                    starts.pop()
                put("REDIR", start)
                command = False
            elif op == "(":
                if cases and cases[-1] == "pattern":
                    put("OPEN", start)
                else:
                    depth += 1
                    put("(", start)
                    command = True
            elif op == ")":
                if cases and cases[-1] == "pattern":
                    put("CLOSE", start)
                    cases[-1] = "body"
                    command = True
                elif inner and not depth:
                    sub = list(kinds)
                    if not _shell_valid(sub):
                        return kinds, starts, -1
                    return kinds, starts, at
                else:
                    depth -= 1
                    put(")", start)
                    command = len(kinds) > 2 and kinds[-2] == "("  # after name() comes a body
            else:
                put(op, start)
                command = True
                if op in (";;", ";&", ";;&") and cases:
                    cases[-1] = "pattern"
                    command = False
            continue
        # A word: up to white space or an operator outside of quotations.
        assign = False
        while at < n:
            c = text[at]
            if c in " \t\r\n;&|()<>" and not (c in "<>" and text[at + 1 : at + 2] == "(" and at == start):
                if c == "(" and text[at - 1] == "=" and re.fullmatch(r"\w+(?:\[[^\]]*\])?\+?=", text[start:at]):
                    assign = True
                if c == "(" and at > start and text[at - 1] in "?*+@!" :
                    end = _pattern_end(text, at)
                    if end > 0:
                        at = end
                        continue
                break
            if c in "'\"\\`$" or c in "<>":
                end = _quoted(text, at)
                if end < 0:
                    put("BAD", start)
                    at = n
                    break
                at = max(end, at + 1)
            else:
                at += 1
        word = text[start:at]
        if re.match(r"(?:={7}|>{7}|<{7})$", word):
            put("BAD", start)
            continue
        if cases and cases[-1] == "word" and word == "in":
            put("in", start)
            cases[-1] = "pattern"
            command = False
            continue
        if cases and cases[-1] == "pattern" and word == "esac":
            put("esac", start)
            cases.pop()
            command = False
            continue
        if cases and cases[-1] == "pattern":
            put("WORD", start)
            continue
        if command and word == "[[":
            end = re.compile(r"\[\[(?:[^\]'\"\n]|'[^']*'|\"(?:[^\"\\]|\\.)*\"|\](?!\])|\n)*\]\]", re.S).match(text, start)
            put("TEST" if end else "BAD", start)
            at = end.end() if end else n
            command = False
            continue
        if command and word in RESERVED and word not in ("in", "time"):
            put(word, start)
            if word == "case":
                cases.append("word")
                command = False
            elif word == "esac" and cases:
                cases.pop()
                command = False
            elif word in ("for", "select", "function"):
                command = word == "for"
                if word == "for":
                    command = True if re.compile(r"\s*\(\(").match(text, at) else False
            else:
                command = word not in ("fi", "done", "}")
                if word in ("fi", "done", "}"):
                    command = False
            continue
        if word == "in" and len(kinds) > 1 and kinds[-2] in ("for", "select") and kinds[-1] == "WORD" or word == "in" and len(kinds) > 2 and kinds[-1] == "NL" and kinds[-3] == "for":
            put("in", start)
            command = False
            continue
        if word == "do" and len(kinds) > 1 and kinds[-2] == "for":
            put("do", start)
            command = True
            continue
        if command and re.match(r"\w+(?:\[[^\]]*\])?\+?=", word):
            put("ASSIGN", start)
            command = not assign
            continue
        if command and word == "time":
            continue
        put("ASSIGN" if assign else "WORD", start)
        command = False
    if inner:
        return kinds, starts, -1
    return kinds, starts, at


def _pattern_end(text: str, at: int) -> int:
    depth = 0
    while at < len(text) and text[at] != "\n":
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
        if not depth:
            return at
    return -1


def _shell_valid(kinds: list[str]) -> bool:
    """Whether the tokens of a substitution are commands."""
    from siltstone.llm.chart import nest
    from siltstone.llm.grammars import grammar

    seq, _, edits = nest(kinds, {"(": ")", "{": "}"})
    return not edits and not grammar("shell").cost("file", seq, 0)
