"""Patterns of RE2's syntax as Java patterns that match the same.

What RE2 doesn't know (look-around, back references, possessive repeats and so on) is refused, as are patterns that can't be read; a filter with such a pattern
matches nothing. Java differs in ``$``, ``.``, ``\\b``, ``\\s``, in the case folding of ``(?i)``, in class set operations and in group names, all of which are rewritten.
"""

from __future__ import annotations

import re

_POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
_CONTROL = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}
_W = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_INSIDE = f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_MOST = 1000


class BadPattern(ValueError):
    """Not a pattern of this syntax."""


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    """The Java form of the escape at ``i`` (the backslash), and where it ends."""
    if i + 1 >= len(p):
        raise BadPattern("trailing backslash")
    c = p[i + 1]
    if c in _CONTROL:
        return _CONTROL[c], i + 2
    if c.lower() in _PERL:
        body = _PERL[c.lower()]
        if inside:
            return (body if c.islower() else f"[^{body}]"), i + 2
        return f"[{'' if c.islower() else '^'}{body}]", i + 2
    if c in "pP":
        m = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(p, i + 2)
        if not m:
            raise BadPattern("bad property")
        name, negated = m[2] or m[3], (c == "P") != bool(m[1])
        if len(name) > 2:
            name = f"Is{name}"
        return rf"\{'P' if negated else 'p'}{{{name}}}", m.end()
    if c == "x":
        m = re.compile(r"\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2})").match(p, i + 2)
        if not m or int(m[1] or m[2], 16) > 0x10FFFF:
            raise BadPattern("bad hex escape")
        return rf"\x{{{m[1] or m[2]}}}", m.end()
    if c in "01234567":
        m = re.compile(r"0[0-7]{0,2}|[1-7][0-7]{2}|[1-7][0-7]").match(p, i + 1)
        if not m:
            raise BadPattern("back reference")
        return rf"\x{{{int(m[0], 8):x}}}", m.end()
    if c == "Q" and not inside:
        end = p.find(r"\E", i + 2)
        text = p[i + 2 :] if end < 0 else p[i + 2 : end]
        return "".join(f"\\{x}" if not x.isalnum() and ord(x) < 128 else x for x in text), len(p) if end < 0 else end + 2
    if not inside:
        if c == "b":
            return _BOUNDARY, i + 2
        if c == "B":
            return _INSIDE, i + 2
        if c == "A":
            return r"\A", i + 2
        if c == "z":
            return r"\z", i + 2
        if c == "C":
            return r"(?s:.)", i + 2
    if ord(c) < 128 and not c.isalnum():
        return f"\\{c}", i + 2
    raise BadPattern(f"unknown escape \\{c}")


def _char_class(p: str, i: int) -> tuple[str, int]:
    """The class at ``i`` (its bracket)."""
    out, i = ["["], i + 1
    if p[i : i + 1] == "^":
        out.append("^")
        i += 1
    first, low = True, None
    while True:
        if i >= len(p):
            raise BadPattern("missing ]")
        c = p[i]
        if c == "]" and not first:
            return "".join(out) + "]", i + 1
        first = False
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(p, i):
            if m[2] not in _POSIX:
                raise BadPattern("unknown class")
            out.append(f"[{m[1]}{_POSIX[m[2]]}]")
            i, low = m.end(), None
            continue
        one = i
        if c == "\\":
            text, i = _escape(p, i, True)
            single = p[one + 1] not in "dswDSWpP"
        else:
            text, i, single = (f"\\{c}" if c in "[&^~-\"'#" or (c == "]") else c), i + 1, True
        if single and p[i : i + 1] == "-" and p[i + 1 : i + 2] not in ("", "]"):
            if p[i + 1] == "\\":
                high, i = _escape(p, i + 1, True)
            else:
                high = p[i + 1]
                high, i = (f"\\{high}" if high in "[&^~-" else high), i + 2
            if _value(text) > _value(high):
                raise BadPattern("bad range")
            out.append(f"{text}-{high}")
        else:
            out.append(text)
        low = text


def _value(text: str) -> int:
    if text.startswith(r"\x"):
        return int(text[2:].strip("{}"), 16)
    return {"\\t": 9, "\\n": 10, "\\f": 12, "\\r": 13}.get(text, ord(text[-1]))


def to_java(p: str) -> str:
    """The Java pattern; BadPattern if ``p`` isn't one."""
    out, i, depth, flags = [], 0, [], {"m": False}
    item = False  # whether something that can be repeated came before
    repeated = False
    while i < len(p):
        c = p[i]
        if c == "\\":
            text, i = _escape(p, i, False)
            out.append(text)
            item, repeated = True, False
        elif c == "[":
            text, i = _char_class(p, i)
            out.append(text)
            item, repeated = True, False
        elif c == "(":
            depth.append(dict(flags))
            i += 1
            item = repeated = False
            if p[i : i + 1] != "?":
                out.append("(")
                continue
            if m := re.compile(r"\?P?<([A-Za-z0-9_]+)>").match(p, i):
                out.append("(")  # names don't matter to a test
            elif m := re.compile(r"\?([imsU]*)(?:-([imsU]+))?([:)])").match(p, i):
                on, off = m[1], m[2] or ""
                if "U" in on + off or (m[3] == ")" and not on + off and p[i + 1] != ")"):
                    raise BadPattern("flag U isn't supported")
                if "m" in on:
                    flags["m"] = True
                if "m" in off:
                    flags["m"] = False
                java = on.replace("i", "iu") + ("-" + off.replace("i", "iu") if off else "")
                if m[3] == ")":
                    kept = dict(flags)
                    depth.pop()
                    flags.update(kept)
                    out.append(f"(?{java})" if java else "")
                else:
                    out.append(f"(?{java}:")
            else:
                raise BadPattern("unknown group")
            i = m.end()
        elif c == ")":
            if not depth:
                raise BadPattern("unexpected )")
            flags = depth.pop()
            out.append(c)
            i, item, repeated = i + 1, True, False
        elif c in "*+?" or (c == "{" and (m := _REPEAT.match(p, i))):
            if not item or repeated:
                raise BadPattern("nothing to repeat")
            if c == "{":
                if int(m[1]) > _MOST or (m[2] and (int(m[2]) > _MOST or int(m[2]) < int(m[1]))):
                    raise BadPattern("bad repeat count")
                text, i = m[0], m.end()
            else:
                text, i = c, i + 1
            if p[i : i + 1] == "?":
                text, i = text + "?", i + 1
            out.append(text)
            repeated = True
        else:
            out.append({"$": "$" if flags["m"] else r"\z", "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c))
            i += 1
            item, repeated = c not in "|", False
            if c == "^":
                item = True
    if depth:
        raise BadPattern("missing )")
    return "(?d)" + "".join(out)
