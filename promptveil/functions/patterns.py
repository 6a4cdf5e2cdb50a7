"""The personal-data patterns, and their spelling for Spark's Java regex engine."""

from __future__ import annotations

from dataclasses import dataclass

# Label order, patterns and street types that results must agree with. They are given in the
# dialect where \w, \d, \s and \b follow Unicode; `to_java` below spells those out for Java.
STREET_TYPES = (
    r"street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|place|pl\.?|boulevard|blvd\.?"
    r"|way|row|square|sq\.?|gardens?|terrace|crescent|close|mews|walk"
)
PII_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){13,16}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PHONE": r"(?<!\w)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3}[ .-]?\d{3,4}(?!\w)",
    "ADDRESS": r"(?i)(?<!\w)\d[\d\-–]*\s+[A-Za-z][\w\s]{1,40}?\b(?:" + STREET_TYPES + r")\b",
}
# A stricter phone form that also takes a full national number after a country code ("+1 555-123-4567").
STRICT_PHONE = r"(?<!\w)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?(?:\d{3}[ .-]?){1,2}\d{3,4}(?!\w)"
# the placeholder format
PLACEHOLDER = r"\[[A-Z_]+_[0-9]+\]"

# Character classes of the Unicode dialect, for use inside brackets. Java's own \w has combining marks and lacks
# numbers such as the superscript two, so the classes are written out.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class PiiPattern:
    label: str
    regex: str
    gate: str  # a cheap regex that every text with a match must satisfy


# What a text must hold at the least for a label to be possible; spares most texts the full pattern.
GATES = {
    "EMAIL": r"@[A-Za-z0-9.-]",
    "CREDIT_CARD": r"(?:\d[ -]?){13}",
    "SSN": r"\d-\d{2}-\d",
    "IP": r"\d\.\d{1,3}\.\d",
    "PHONE": r"\d{3}[ .-]?\d{3}",
    "ADDRESS": r"\d[\-–]*\s",
}


def to_java(pattern: str) -> str:
    """Spell out the Unicode shorthands. Handles them inside and outside brackets."""
    boundary = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
    flags = ""
    if pattern.startswith("(?i)"):
        flags, pattern = "(?iu)", pattern[4:]
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            code = pattern[i + 1]
            inner = {"w": WORD, "d": DIGIT, "s": SPACE}.get(code)
            if inner is not None:
                out.append(inner if in_class else f"[{inner}]")
            elif code == "b":
                out.append(boundary)
            else:
                out.append(ch + code)
            i += 2
            continue
        in_class = (ch == "[") or (in_class and ch != "]")
        out.append(ch)
        i += 1
    return flags + "".join(out)


def pii_patterns(strict_phone: bool = False) -> list[PiiPattern]:
    """The ordered patterns. ``strict_phone`` trades agreement with the fixed patterns for fewer leaks."""
    source = dict(PII_PATTERNS)
    if strict_phone:
        source["PHONE"] = STRICT_PHONE
    return [PiiPattern(label, to_java(p), to_java(GATES[label])) for label, p in source.items()]
