"""Regular expressions as tokenizer definitions write them (PCRE2 with Unicode classes), for Java and for Python."""

from __future__ import annotations

import re

import regex

_BRANCH_RESET = "(?|"


def to_java(pattern: str) -> str:
    r"""Unicode `\s \w \d \b`, only `\n` ends a line, script names as Java has them. Branch resets raise ValueError."""
    if _BRANCH_RESET in pattern:
        raise ValueError("branch reset groups have no Java form")
    pattern = re.sub(r"\\([pP])\{(Han|Hiragana|Katakana|Hangul|Latin|Greek|Cyrillic|Arabic|Hebrew|Thai|Devanagari)\}", r"\\\1{Is\2}", pattern)
    return f"(?Ud){pattern}"


def to_python(pattern: str) -> str:
    r"""For the `regex` module: `\x{...}` becomes `\uXXXX` or `\UXXXXXXXX`."""

    def code(m: re.Match) -> str:
        n = int(m[1], 16)
        return f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"

    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", code, pattern)


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(to_python(pattern), regex.V1 if _BRANCH_RESET in pattern else regex.V0)


def replacement_to_java(replacement: str) -> str:
    r"""`\1` to `\9` and `$1` to `$9` name groups, `$0` and `\0` the match; any other backslash or dollar is itself."""
    out, i = [], 0
    while i < len(replacement):
        c, after = replacement[i], replacement[i + 1 : i + 2]
        if c in "\\$" and after.isdigit():
            out.append(f"${after}")
            i += 2
        elif c == "\\" and after in ("\\", "$"):
            out.append("\\" + after)
            i += 2
        else:
            out.append("\\" + c if c in "\\$" else c)
            i += 1
    return "".join(out)


def can_be_empty(pattern: str) -> bool:
    return compiled(pattern).fullmatch("") is not None


def quoted(text: str) -> str:
    """A pattern that matches the text literally, in Java, Python and RE2."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else f"\\x{ord(c):02x}" for c in text)
