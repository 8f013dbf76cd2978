"""JSON read strictly, and its values as text.

Every number is a double, as it is where logs are compared by value: whole ones print without a point or exponent, others in their shortest form.
"""

from __future__ import annotations

import json
import math


def _refuse(word: str) -> None:
    raise ValueError(f"{word} isn't JSON")


def _double(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


def strict_loads(text: str) -> dict:
    """An object that is all of the text; ValueError for anything else. The last of equal keys counts."""
    found = json.loads(text, parse_constant=_refuse, parse_int=_double, parse_float=_double)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def _scientific(value: float) -> tuple[str, str, int]:
    """Sign, shortest digits and exponent."""
    mantissa, exponent = f"{value:e}".split("e") if value == 0 else _shortest(value)
    digits = mantissa.lstrip("-").replace(".", "").rstrip("0") or "0"
    return ("-" if mantissa[0] == "-" else ""), digits, int(exponent)


def _shortest(value: float) -> tuple[str, str]:
    text = repr(value)
    sign, text = ("-", text[1:]) if text[0] == "-" else ("", text)
    body, _, exponent = text.partition("e")
    whole, _, part = body.partition(".")
    digits = (whole + part).lstrip("0")
    lead = len(whole) if whole.strip("0") else -(len(part) - len(part.lstrip("0")))
    return sign + digits[0] + "." + digits[1:], str(int(exponent or 0) + lead - 1)


def _fixed(sign: str, digits: str, exponent: int) -> str:
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    if len(digits) <= exponent + 1:
        return sign + digits.ljust(exponent + 1, "0")
    return f"{sign}{digits[: exponent + 1]}.{digits[exponent + 1 :]}"


def number_text(value: float) -> str:
    """Whole numbers in full, others in the shortest form, with an exponent of two digits at least below 1e-4 and from 1e21 on (1e6 for fractions)."""
    if abs(value) < 2.0**63 and value == int(value):
        return str(int(value))
    sign, digits, exponent = _scientific(value)
    if -4 <= exponent < 6:
        return _fixed(sign, digits, exponent)
    return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def _json_number(value: float) -> str:
    """As in JSON text that is written anew: an exponent below 1e-6 and from 1e21 on."""
    sign, digits, exponent = _scientific(value)
    if value == 0 or -6 <= exponent < 21:
        return _fixed(sign, digits, exponent)
    return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}".replace("e-0", "e-")


def _quoted(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    for c in "<>&  \x7f":
        if c != "\x7f":
            out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def compact(value: object) -> str:
    """JSON text without spaces, keys sorted, with ``<``, ``>`` and ``&`` escaped."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{compact(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return _json_number(value) if isinstance(value, float) else _quoted(value)


def flatten(box: dict, prefix: str = "") -> dict[str, str]:
    """All leaves by dotted path, as text. Arrays are JSON text, nulls are left out, and of equal paths the last counts."""
    out: dict[str, str] = {}
    for key, value in box.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(value, dict):
            out |= flatten(value, path)
        elif isinstance(value, list):
            out[path] = compact(value)
        elif isinstance(value, bool):
            out[path] = "true" if value else "false"
        elif value is not None:
            out[path] = number_text(value) if isinstance(value, float) else value
    return out
