"""Languages whose blocks are words, not braces: Ruby, Lua; and R and shell, whose functions are bound to names."""

from __future__ import annotations

import re

LANGUAGES = ("RUBY", "LUA", "R", "BASH")
BLANKED = {
    "LUA": re.compile(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.DOTALL),
    "": re.compile(r"(?<!\$)#[^\n{]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.DOTALL),
}
OPENERS = {"RUBY": r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", "LUA": r"\b(?:function|if|for|while|do|repeat)\b"}
CLOSERS = {"RUBY": r"\bend\b", "LUA": r"\b(?:end|until)\b"}
START = {
    "RUBY": re.compile(r"^\s*def\s+(?:self\.)?([\w?!=]+)\s*\(?([^)\n]*)\)?"),
    "LUA": re.compile(r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(\w+)\s*\(([^)]*)\)|^\s*(?:local\s+)?(?:[\w.]+\.)?(\w+)\s*=\s*function\s*\(([^)]*)\)"),
    "R": re.compile(r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(([^)]*)\)"),
    "BASH": re.compile(r"^\s*(?:function\s+)?([\w-]+)\s*(?:\(\s*\))\s*\{|^\s*function\s+([\w-]+)\s*\{"),
}
CALL = re.compile(r"([A-Za-z_.][\w.]*[?!]?)\s*\(")
KEYWORDS = set("if for while function return unless until elsif end def and or not in then do switch repeat".split())


def parse(code: str, lang: str) -> dict:
    text = BLANKED.get(lang, BLANKED[""]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    lines, source = text.split("\n"), code.split("\n")
    owner = next((m for line in lines if lang == "RUBY" and (m := re.match(r"\s*class\s+([\w:]+)", line))), None)
    methods = []
    for i, line in enumerate(lines):
        if m := START[lang].match(line):
            last = ending(lines, i, lang)
            name = m[1] or next(g for g in m.groups()[1:] if g)
            arguments = next((g for g in m.groups()[1:] if g and g != name), "") if lang != "BASH" else ""
            inner = "\n".join([line[m.end() :], *lines[i + 1 : last + 1]])
            called = [c.split(".")[-1] for c in CALL.findall(inner)]
            methods.append(
                {
                    "name": name, "return_type": "", "parameters": [p for x in arguments.split(",") if (p := x.split("=")[0].strip(" *&:"))],
                    "body": "\n".join(source[i : last + 1]), "start_line": i + 1, "end_line": last + 1, "callees": [c for c in called if c and c not in KEYWORDS],
                }
            )
    properties = [n for line in lines if owner and (m := re.match(r"\s*attr_\w+\s+(.*)", line)) for n in re.findall(r":(\w+)", m[1])]
    return {"package_name": "", "class_name": owner[1] if owner else "", "properties": properties, "methods": methods}


def ending(lines: list[str], at: int, lang: str) -> int:
    """The line on which the block that starts on line `at` ends; the last line if it never does."""
    depth = 0
    for i in range(at, len(lines)):
        if lang in OPENERS:
            opened = re.findall(OPENERS[lang], lines[i])
            if lang == "LUA":
                opened = [o for o in opened if o != "do" or not re.search(r"\b(?:for|while)\b", lines[i])]
            depth += len(opened) - len(re.findall(CLOSERS[lang], lines[i]))
        else:
            depth += lines[i].count("{") - lines[i].count("}")
        if depth <= 0 and (i > at or lang in OPENERS or "}" in lines[i]):
            return i
    return len(lines) - 1
