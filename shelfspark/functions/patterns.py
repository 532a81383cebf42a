"""Patterns of RE2 syntax as patterns for Spark's regular expressions.

The two agree on most of the syntax.  Where they differ the text is rewritten: classes and word boundaries
are ASCII, ``$`` is the end of the text, and folding of case covers all letters.  What RE2 rejects
(look-around, back-references, possessive quantifiers) is rejected here too, so that such a rule never matches.
"""

from __future__ import annotations

import re

WORD = "[0-9A-Za-z_]"
SPACE = r"\t\n\f\r "
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NOT_BOUNDARY = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
_CLASSES = {"s": SPACE, "d": "0-9", "w": "0-9A-Za-z_"}
_POSIX = {"alpha": r"A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "word": "0-9A-Za-z_", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "print": " -~", "graph": "!-~", "ascii": r"\x00-\x7F"}


def translate(pattern: str) -> str:
    """Raises re.error for a pattern that RE2 would not take."""
    out, i, in_class, multiline = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise re.error("trailing backslash", pattern, i)
            d = pattern[i + 1]
            if d in _CLASSES:
                out.append(_CLASSES[d] if in_class else f"[{_CLASSES[d]}]")
            elif d.lower() in _CLASSES and d.isupper():
                out.append(f"[^{_CLASSES[d.lower()]}]")
            elif d == "b" and not in_class:
                out.append(BOUNDARY)
            elif d == "B" and not in_class:
                out.append(NOT_BOUNDARY)
            elif d == "z" or d == "A":
                out.append("\\" + d)
            elif d.isdigit() and d != "0" or d in "ZGkKRXhHV":
                raise re.error(f"\\{d} is not supported", pattern, i)
            else:
                out.append("\\" + d)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[":
                m = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
                if m and m[2] in _POSIX:
                    out.append(f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
                    i += m.end()
                    continue
                out.append("\\")
            elif c == "&" and pattern[i : i + 2] == "&&":
                out.append("\\")
        elif c == "[":
            in_class = True
            m = re.match(r"\[\^?\]?", pattern[i:])
            out.append(m[0].replace("]", r"\]"))
            i += m.end()
            continue
        elif c == "(" and pattern[i : i + 2] == "(?":
            m = re.match(r"\(\?(?:P?<(\w+)>|([imsU]*)(?:-([imsU]+))?([:)]))", pattern[i:])
            if not m:
                raise re.error("group is not supported", pattern, i)
            if m[1]:
                out.append("(")
            else:
                on, off = (m[2] or "").replace("U", ""), (m[3] or "").replace("U", "")
                multiline = multiline or "m" in on
                on = on.replace("i", "iu")
                out.append(f"(?{on}{'-' + off if off else ''}{m[4]}" if on or off else ("(?:" if m[4] == ":" else ""))
            i += m.end()
            continue
        elif c == "$" and not multiline:
            out.append(r"\z")
            i += 1
            continue
        elif c == "+" and i and pattern[i - 1] in "*+?}" and not pattern[:i].endswith(("\\*", "\\+", "\\?", "\\}")):
            raise re.error("repeated quantifier", pattern, i)
        out.append(c)
        i += 1
    if in_class:
        raise re.error("missing closing ]", pattern, 0)
    # Python knows \z under another name; this compiles only to find faults
    re.compile("".join(out).replace(r"\z", r"\Z").replace("(?iu", "(?i") if not re.search(r"\\[pP]|(?<!^)\(\?[imsu-]+\)", "".join(out)) else "")
    return "(?d)" + "".join(out)
