"""Languages with braces, by a lexer that blanks strings and comments and by matching brackets."""

from __future__ import annotations

import re
from bisect import bisect_right

BLANKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`?", re.DOTALL)
#: What stands before declarations without being part of them: annotations, attributes, and access labels.
DECORATIONS = {
    "JAVA": r"@(?!interface\b)\w+(?:\.\w+)*(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?", "C_SHARP": r"(?m)^\s*\[[^\]\n]*\]", "RUST": r"#!?\[[^\]]*\]",
    "CPP": r"\b(?:public|private|protected)\s*(?:slots\s*)?:(?!:)", "PHP": r"#\[[^\]]*\]",
}
DECORATIONS |= dict.fromkeys(("KOTLIN", "SCALA", "DART", "TYPESCRIPT", "TSX", "JAVASCRIPT", "SWIFT"), DECORATIONS["JAVA"])
HASH_COMMENTS = re.compile(r"(?m)#(?!\[)[^\n]*")
PACKAGE = re.compile(r"(?m)^\s*(?:package|namespace)\s+([\w.\\]+(?:::\w+)*)")
#: Kinds of class-like declarations, in the order in which the first of them is looked for (fixed values).
KINDS = ("class", "interface", "enum", "object", "type", "struct", "trait", "protocol", "mixin", "extension", "impl")
KEYWORDS = set(
    "if for while switch catch return new else do try synchronized using lock foreach function fn func fun def sizeof typeof await throw case when match with assert super this loop unsafe elif in not and or defer go select yield".split()
)
CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:::<[^>()]*>)?!?\(")
KEYWORD_METHOD = re.compile(r"\b(?:fun|func|fn|function|def)(?:\s+|\s*\*\s*)(?:<[^>]*>\s*)?(?:\([^)]*\)\s*)?(?:[\w.]+\.)?([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>|\[[^\]]*\])?\s*\(")
TYPED_METHOD = re.compile(r"(?<![\w.])((?:[A-Za-z_$][\w$:.]*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*[\s*&?]+)+)(~?[A-Za-z_$][\w$]*)\s*\(")
BARE_METHOD = re.compile(r"(?m)(?<=[;{}\n])\s*(?:(?:static|async|get|set|public|private|protected|override|readonly|abstract)\s+)*\*?\s*([#A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\(")
ARROW = re.compile(r"(?m)(?:\b(?:const|let|var)\s+|(?<=[;{}\n])[ \t]*(?:(?:static|public|private|protected|readonly|override)\s+)*)([#A-Za-z_$][\w$]*)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:<[^>(]*>\s*)?(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\)|([A-Za-z_$][\w$]*))\s*(?::\s*([^=;{}]+?))?\s*=>\s*")
FIELD = re.compile(r"^(?:@\w+(?:\([^)]*\))?\s*|(?:public|private|protected|internal|static|final|readonly|const|volatile|transient|override|lateinit|open|let|var|val|mut|pub|declare|abstract)\s+)*")
MODIFIERS = set("public private protected internal static final abstract synchronized native async override virtual inline extern const default open suspend export pub unsafe constexpr explicit friend partial sealed".split())
BY_KEYWORD = {"GO", "RUST", "KOTLIN", "SWIFT", "SCALA", "PHP", "JAVASCRIPT", "TYPESCRIPT", "TSX"}
BY_NAME = {"JAVASCRIPT", "TYPESCRIPT", "TSX", "DART"}
ARROWS = {"JAVASCRIPT", "TYPESCRIPT", "TSX"}
BY_TYPE = {"JAVA", "C", "CPP", "C_SHARP", "DART"}
PAIRS = {"{": "}", "(": ")", "[": "]"}


def blanked(code: str, lang: str) -> str:
    """code with strings and comments as spaces of the same length, line ends kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    out = BLANKED.sub(blank, code)
    return HASH_COMMENTS.sub(blank, out) if lang == "PHP" else out


def closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`; the end of text if none does."""
    opener, closer, depth = text[at], PAIRS[text[at]], 0
    for m in re.compile(f"[{re.escape(opener + closer)}]").finditer(text, at):
        depth += 1 if m[0] == opener else -1
        if not depth:
            return m.start()
    return len(text)


def balanced(text: str, at: int) -> int:
    """Place after the angle bracket that closes the one at `at`; `at` if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "<") - (text[i] == ">")
        if not depth:
            return i + 1
        if text[i] in ";{}":
            break
    return at


def undecorated(text: str, lang: str) -> str:
    """text with decorations, and the parameters of C++ templates, as spaces of the same length."""
    if lang in DECORATIONS:
        text = re.sub(DECORATIONS[lang], lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in re.finditer(r"\btemplate\s*(?=<)", text) if lang == "CPP" else ():
        end = balanced(text, m.end())
        text = text[: m.start()] + re.sub(r"[^\n]", " ", text[m.start() : end]) + text[end:]
    return text


def top_level(text: str, start: int, end: int) -> str:
    """text from start to end with what lies in inner braces blanked."""
    out, at = list(text[start:end]), start
    while (at := text.find("{", at, end)) >= 0:
        stop = min(closing(text, at), end)
        for i in range(at + 1, stop):
            if out[i - start] != "\n":
                out[i - start] = " "
        at = stop + 1
    return "".join(out)


def first_class(text: str) -> tuple[str, int, int] | None:
    """Name and body of the first class-like declaration of the first kind that occurs."""
    for kind in KINDS:
        if kind == "type":  # a named struct or interface
            m = re.search(r"\btype\s+(\w+)\s+(?:struct|interface)\b", text)
        else:
            m = re.search(rf"(?<![\w.]){kind}\s+(?:class\s+)?(?:<[^>]*>\s*)?([A-Za-z_]\w*)", text)
        if m:
            at, end = text.find("{", m.end()), text.find(";", m.end())
            if at < 0 or 0 <= end < at:
                return m[1], m.end(), m.end()
            return m[1], at + 1, closing(text, at)
    return None


def parameters(text: str, lang: str) -> list[str]:
    out = []
    for part in split_top(text):
        part = re.sub(r"@\w+(\([^)]*\))?\s*", "", part.split("=")[0]).strip()
        if not part or part in ("self", "&self", "&mut self", "void"):
            continue
        if lang in ("RUST", "KOTLIN", "SWIFT", "SCALA", "TYPESCRIPT", "TSX"):
            name = part.split(":")[0].split()[-1:]
        elif lang == "GO":
            name = part.split()[:1]
        else:
            name = re.findall(r"[\w$]+", part)[-1:]
        out += [n.strip("?&*$") for n in name]
    return out


def split_top(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def calls(text: str) -> list[str]:
    return [m[1] for m in CALL.finditer(text) if m[1] not in KEYWORDS]


def parse(code: str, lang: str) -> dict:
    """The first class with its fields and methods; without one, or where methods stand outside (Go, Rust), the file's functions."""
    text = undecorated(blanked(code, lang), lang)
    lines = [m.start() for m in re.finditer("\n", text)]
    package = PACKAGE.search(text)
    found = first_class(text)
    start, end = found[1:] if found else (0, len(text))
    flat = top_level(text, start, end)
    outside = lang in ("GO", "RUST") and found
    if lang == "RUST" and found and (m := re.search(rf"\bimpl\b[^{{;]*\b{found[0]}\b[^{{;]*", text)) and text[m.end() : m.end() + 1] == "{":
        begin, stop = m.end() + 1, closing(text, m.end())
    else:
        begin, stop = (0, len(text)) if outside else (start, end)
    methods = [m for m in functions(text, top_level(text, begin, stop) if (begin, stop) != (start, end) else flat, begin, stop, code, lang, lines, found[0] if found else "")]
    return {"package_name": package[1].replace("\\", ".").replace("::", ".") if package else "", "class_name": found[0] if found else "", "properties": fields(flat, lang) if found else [], "methods": methods}


def functions(text: str, flat: str, begin: int, stop: int, code: str, lang: str, lines: list[int], owner: str):
    """The functions whose heads stand in flat, text from begin to stop without what lies in inner braces, in source order."""
    yield from sorted([*declared(text, flat, begin, stop, code, lang, lines, owner), *(arrows(text, flat, begin, code, lang, lines) if lang in ARROWS else ())], key=lambda f: f["start_line"])


def arrows(text: str, flat: str, begin: int, code: str, lang: str, lines: list[int]):
    """Functions that are bound to a name by an arrow."""
    for m in ARROW.finditer(flat):
        first, at = begin + m.start(1), begin + m.end()
        if text[at : at + 1] == "{":
            last = closing(text, at)
        else:  # an expression, up to the end of its statement
            depth, last = 0, at
            while last < len(text) and (depth > 0 or text[last] not in ";\n,)}"):
                depth += (text[last] in PAIRS) - (text[last] in PAIRS.values())
                last += 1
            last -= 1
        yield {
            "name": m[1], "return_type": (m[4] or "").strip(), "parameters": parameters(m[2] if m[2] is not None else m[3], lang), "body": code[at : last + 1],
            "start_line": bisect_right(lines, first - 1) + 1, "end_line": bisect_right(lines, max(0, last - 1)) + 1, "callees": calls(text[at : last + 1]),
        }


def declared(text: str, flat: str, begin: int, stop: int, code: str, lang: str, lines: list[int], owner: str):
    patterns = [p for p, langs in ((KEYWORD_METHOD, BY_KEYWORD), (TYPED_METHOD, BY_TYPE), (BARE_METHOD, BY_NAME)) if lang in langs] or [KEYWORD_METHOD, TYPED_METHOD]
    if owner and lang in BY_TYPE:  # constructors and destructors have no type
        patterns.append(re.compile(rf"(?<![\w.:~])((?:~\s*)?{re.escape(owner)})\s*\("))
    found: dict[int, tuple[int, str, str]] = {}
    for p in patterns:
        for m in p.finditer(flat):
            name = m[m.re.groups]
            head = m[1] if p is TYPED_METHOD else ""
            if (p is KEYWORD_METHOD or name not in KEYWORDS) and not (set(head.split()) & {"return", "new", "else", "throw", "case"}):
                found.setdefault(m.end() - 1, (m.start() + len(m[0]) - len(m[0].lstrip()), name.replace(" ", ""), head))
    for at, (first, name, head) in sorted(found.items()):
        shut = closing(text, begin + at)
        open_at = re.compile(r"[{;=]|\n\s*\n").search(text, shut + 1, stop)
        if not open_at or open_at[0] not in "{=" or (open_at[0] == "=" and lang not in ("KOTLIN", "SCALA", "JAVASCRIPT", "TYPESCRIPT", "TSX", "DART", "C_SHARP")):
            continue
        between = text[shut + 1 : open_at.start()]
        if open_at[0] == "=":
            brace = re.compile(r"=>?\s*\{").match(text, open_at.start())
            last = closing(text, brace.end() - 1) if brace else text.find("\n", open_at.start())
            last = len(text) - 1 if last < 0 else last
        else:
            last = closing(text, open_at.start())
        if p_type(between, lang) is None:
            continue
        body = code[open_at.start() : last + 1]
        kind = " ".join(w for w in head.split() if w not in MODIFIERS)
        kind = kind[balanced(kind, 0) :].strip() if kind.startswith("<") else kind  # type parameters of the method
        kind = kind or p_type(between, lang)
        yield {
            "name": name,
            "return_type": "" if name.lstrip("~") == owner else kind,
            "parameters": parameters(text[begin + at + 1 : shut], lang),
            "body": body,
            "start_line": bisect_right(lines, begin + first - 1) + 1,
            "end_line": bisect_right(lines, max(0, last - 1)) + 1,
            "callees": calls(text[open_at.start() : last + 1]),
        }


def p_type(between: str, lang: str) -> str | None:
    """Return type between parameters and body; None if what stands there can't belong to a function."""
    if re.search(r"[()]", between) and lang not in ("GO", "RUST", "CPP", "SWIFT", "SCALA", "TYPESCRIPT", "TSX", "KOTLIN"):
        return None
    m = re.match(r"\s*(?:->|:)\s*([^{=]+?)\s*(?:where\b.*)?$", between, re.DOTALL)
    if m:
        return m[1].strip()
    return between.strip() if lang == "GO" else ""


def fields(flat: str, lang: str) -> list[str]:
    """Names of the fields that stand in flat, a class body without what lies in inner braces; of a declaration with several names, all."""
    out = []
    for part in re.split(r"[;\n]" if lang not in ("JAVA", "C", "CPP", "C_SHARP", "DART", "PHP") else r"[;{}]", flat):
        part = part.strip().rstrip(",")
        rest = FIELD.sub("", part)
        named = rest != part
        first, *more = split_top(rest)
        first = first.split("=")[0].strip()
        if not first or "(" in first or first.split()[0] in KEYWORDS | set(KINDS) | {"func", "fn", "fun", "import", "package", "use"} or ("=>" in part and lang in ARROWS):
            continue
        if lang in ("RUST", "KOTLIN", "SWIFT", "SCALA", "TYPESCRIPT", "TSX") or (":" in first and lang in ("DART",)):
            m = re.match(r"([A-Za-z_]\w*)\??!?\s*(?::|$)", first)
        elif lang == "GO":
            names = re.match(r"((?:[A-Za-z_]\w*\s*,\s*)*[A-Za-z_]\w*)\s+\S", rest)
            out += re.findall(r"\w+", names[1]) if names else []
            continue
        elif lang == "JAVASCRIPT":
            m = re.match(r"(#?[A-Za-z_$][\w$]*)$", first) if "=" in part or named else None
        elif lang == "PHP":
            m = re.search(r"\$(\w+)$", first)
        else:
            m = re.search(r"^[\w$:.<>,\[\]?*&\s]+[\s*&>\]]([A-Za-z_$][\w$]*)\s*(?:\[[^\]]*\])*$", first)
        if m:
            others = (re.match(r"[\s*&$]*([A-Za-z_$][\w$]*)", FIELD.sub("", x.strip())) for x in more)
            out += [m[1], *(x[1] for x in others if x)]
    return out
