"""Translate filter patterns into the regular-expression dialect Spark runs.

Route patterns are written in a linear-time dialect: unanchored search,
Unicode classes, no look-around, no back-references.  ``RLIKE`` runs
``java.util.regex``, which spells several of these things differently and a
few of them with another meaning.  :func:`to_java_pattern` accepts exactly the
constructs it can carry over faithfully and raises :class:`PatternError` for
everything else, so a pattern is never silently misread.

Framed lines never hold a line feed.  The multi-line and dot-all flags
therefore change nothing and are dropped.
"""

from __future__ import annotations

import re

# ASCII character classes of the form [[:name:]].
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": "\\x00-\\x7F",
    "blank": "\\t ",
    "cntrl": "\\x00-\\x1F\\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": "!-/:-@\\[-`{-~",
    "space": "\\t\\n\\x0B\\f\\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# General categories that both dialects name alike.
GENERAL_CATEGORIES = frozenset(
    "L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po "
    "S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Co".split()
)

# Scripts accepted by name, for example \p{Greek}.
SCRIPTS = frozenset(
    "Arabic Armenian Bengali Cyrillic Devanagari Georgian Greek Han Hangul "
    "Hebrew Hiragana Katakana Latin Tamil Thai".split()
)

# One-letter escapes and their Java spelling.
CHAR_ESCAPES = {
    "a": "\\x07",
    "f": "\\x0C",
    "n": "\\x0A",
    "r": "\\x0D",
    "t": "\\x09",
    "v": "\\x0B",
}

_META = set("\\.+*?()|[]{}^$")
_MAX_REPEAT = 2**31 - 1
_FLAG_PREFIX = "(?dU)"


class PatternError(ValueError):
    """The pattern is invalid or outside the supported dialect."""


def to_java_pattern(pattern: str) -> str:
    """Return the equivalent ``java.util.regex`` pattern."""
    return _FLAG_PREFIX + _Translator(pattern).translate()


def pattern_problem(pattern: str) -> str | None:
    """Return why ``pattern`` cannot be used, or ``None`` when it can."""
    try:
        to_java_pattern(pattern)
    except PatternError as problem:
        return str(problem)
    return None


def literal_form(pattern: str) -> tuple[str, str] | None:
    """Reduce a pattern without real regex content to a string test.

    Returns ``(kind, text)`` with kind ``contains``, ``startswith``,
    ``endswith`` or ``equals``, or ``None`` when a regex is needed.  The string
    tests compare bytes and skip the regex engine altogether.
    """
    body, at_start, at_end = pattern, False, False
    if body.startswith("^"):
        body, at_start = body[1:], True
    if body.endswith("$") and not re.search(r"(?<!\\)(?:\\\\)*\\\$$", body):
        body, at_end = body[:-1], True
    text, i = [], 0
    while i < len(body):
        ch = body[i]
        if ch == "\\" and i + 1 < len(body) and _is_escapable(body[i + 1]):
            text.append(body[i + 1])
            i += 2
            continue
        if ch in _META:
            return None
        text.append(ch)
        i += 1
    kind = {
        (False, False): "contains",
        (True, False): "startswith",
        (False, True): "endswith",
        (True, True): "equals",
    }[at_start, at_end]
    return kind, "".join(text)


def _is_escapable(ch: str) -> bool:
    return ch.isascii() and ch.isprintable() and not ch.isalnum() and ch not in "<> "


def _java_literal(ch: str) -> str:
    if ch.isascii() and not ch.isalnum() and ch != "_":
        return f"\\x{ord(ch):02X}" if not ch.isprintable() or ch == " " else "\\" + ch
    return ch


class _Translator:
    """One left-to-right pass that emits the Java spelling as it reads."""

    def __init__(self, pattern: str):
        self.src = pattern
        self.pos = 0
        self.names: set[str] = set()

    def translate(self) -> str:
        out = self._alternation()
        if self.pos < len(self.src):
            raise PatternError("unopened group")
        return out

    # -- reading ---------------------------------------------------------
    def _peek(self, width: int = 1) -> str:
        return self.src[self.pos : self.pos + width]

    def _next(self, what: str) -> str:
        if self.pos >= len(self.src):
            raise PatternError(what)
        ch = self.src[self.pos]
        self.pos += 1
        return ch

    def _until(self, closer: str, what: str) -> str:
        end = self.src.find(closer, self.pos)
        if end < 0:
            raise PatternError(what)
        text = self.src[self.pos : end]
        self.pos = end + len(closer)
        return text

    # -- structure -------------------------------------------------------
    def _alternation(self) -> str:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.pos += 1
            branches.append(self._sequence())
        return "|".join(branches)

    def _sequence(self) -> str:
        out: list[str] = []
        repeatable = repeated = False
        while self.pos < len(self.src) and self._peek() not in ("|", ")"):
            ch = self._peek()
            if ch in "*+?{":
                if not repeatable:
                    raise PatternError("repetition operator missing expression")
                quantifier = self._quantifier()
                # A second quantifier means nested repetition here, but a
                # possessive match or an error in Java: close the first off.
                out[-1] = f"(?:{out[-1]}){quantifier}" if repeated else out[-1] + quantifier
                repeated = True
                continue
            piece, repeatable = self._piece()
            repeated = False
            out.append(piece)
        return "".join(out)

    def _quantifier(self) -> str:
        ch = self._next("repetition operator missing expression")
        if ch == "{":
            body = self._until("}", "unclosed counted repetition")
            found = re.fullmatch(r"([0-9]+)(,([0-9]*))?", body)
            if not found:
                raise PatternError("repetition quantifier expects a valid decimal")
            low = int(found.group(1))
            high = int(found.group(3)) if found.group(3) else low
            if max(low, high) > _MAX_REPEAT:
                raise PatternError("repetition count is too large")
            if high < low:
                raise PatternError("invalid repetition count range")
            quantifier = "{" + body + "}"
        else:
            quantifier = ch
        if self._peek() == "?":
            self.pos += 1
            quantifier += "?"
        return quantifier

    def _piece(self) -> tuple[str, bool]:
        """Read one item; the flag says whether a quantifier may follow."""
        ch = self._next("unexpected end of pattern")
        if ch == "(":
            return self._group()
        if ch == "[":
            return self._char_class(), True
        if ch == "\\":
            return self._escape(), True
        if ch == ".":
            return ".", True
        if ch == "^":
            return "\\A", True
        if ch == "$":
            return "\\z", True
        return _java_literal(ch), True

    def _group(self) -> tuple[str, bool]:
        flags = ""
        if self._peek() == "?":
            self.pos += 1
            if self._peek(2) == "P<":
                self.pos += 2
                self._group_name()
            elif self._peek() == "<" and self._peek(2) not in ("<=", "<!"):
                self.pos += 1
                self._group_name()
            elif self._peek() in ("=", "!", "<", ">"):
                raise PatternError("look-around is not supported")
            else:
                flags, closed = self._flags()
                if closed:
                    return (f"(?{flags})" if flags else ""), False
        body = self._alternation()
        if self._peek() != ")":
            raise PatternError("unclosed group")
        self.pos += 1
        return f"(?{flags}:{body})", True

    def _group_name(self) -> None:
        name = self._until(">", "unclosed group name")
        if not re.fullmatch(r"[A-Za-z_][0-9A-Za-z_.\[\]]*", name):
            raise PatternError("invalid group name")
        if name in self.names:
            raise PatternError("duplicate group name")
        self.names.add(name)

    def _flags(self) -> tuple[str, bool]:
        """Read ``i-s)`` or ``i:``; return Java flags and whether it closed."""
        seen: set[str] = set()
        negated, count_after_minus, java = False, 0, {False: "", True: ""}
        while True:
            ch = self._next("unclosed group")
            if ch in "):":
                break
            if ch == "-":
                if negated:
                    raise PatternError("repeated flag negation")
                negated = True
                continue
            if ch not in "imsUu" or (ch == "u" and negated):
                raise PatternError(f"unsupported flag '{ch}'")
            if ch in seen:
                raise PatternError(f"duplicate flag '{ch}'")
            seen.add(ch)
            count_after_minus += negated
            if ch == "i":
                java[negated] += "i"
        if negated and not count_after_minus:
            raise PatternError("dangling flag negation")
        if ch == ")" and not seen:
            raise PatternError("repetition operator missing expression")
        return java[False] + ("-" + java[True] if java[True] else ""), ch == ")"

    # -- escapes ---------------------------------------------------------
    def _escape(self) -> str:
        ch = self._next("incomplete escape sequence")
        if ch in "dDwWsS":
            return "\\" + ch
        if ch == "A" or ch == "z":
            return "\\" + ch
        if ch in "bB":
            if ch == "b" and self._peek() == "{":
                raise PatternError("special word boundaries are not supported")
            return "\\" + ch
        return self._escaped_char(ch)

    def _escaped_char(self, ch: str) -> str:
        if ch in "pP":
            return self._property(ch)
        point = self._code_point(ch)
        if point is not None:
            return f"\\x{{{point:X}}}"
        if ch in CHAR_ESCAPES:
            return CHAR_ESCAPES[ch]
        if ch == " " or _is_escapable(ch):
            return _java_literal(ch)
        if ch.isdigit():
            raise PatternError("back-references are not supported")
        raise PatternError(f"unrecognized escape sequence '\\{ch}'")

    def _code_point(self, ch: str) -> int | None:
        widths = {"x": 2, "u": 4, "U": 8}
        if ch not in widths:
            return None
        if self._peek() == "{":
            self.pos += 1
            digits = self._until("}", "unclosed hexadecimal escape")
        else:
            digits = self._peek(widths[ch])
            if len(digits) != widths[ch]:
                raise PatternError("incomplete hexadecimal escape")
            self.pos += len(digits)
        if not re.fullmatch(r"[0-9A-Fa-f]{1,8}", digits):
            raise PatternError("invalid hexadecimal digit")
        point = int(digits, 16)
        if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
            raise PatternError("hexadecimal literal is not a Unicode scalar value")
        return point

    def _property(self, letter: str) -> str:
        name = self._next("incomplete Unicode class")
        if name == "{":
            name = self._until("}", "unclosed Unicode class")
            if name.startswith("^"):
                name, letter = name[1:], "P" if letter == "p" else "p"
        if name in GENERAL_CATEGORIES:
            return f"\\{letter}{{{name}}}"
        if name in SCRIPTS:
            return f"\\{letter}{{Is{name}}}"
        raise PatternError(f"unsupported Unicode class '{name}'")

    # -- character classes -------------------------------------------------
    def _char_class(self, nested: bool = False, outer_negated: bool = False) -> str:
        unclosed = "unclosed character class"
        negated = self._peek() == "^"
        if negated:
            self.pos += 1
            if nested and outer_negated:
                raise PatternError("nested negation in a negated class is not supported")
        items: list[str] = []
        # Hyphens and one closing bracket right after the opening are literals.
        while self._peek() == "-" and self._peek(2) != "--":
            self.pos += 1
            items.append("\\-")
        if not items and self._peek() == "]":
            self.pos += 1
            items.append(self._range("\\]", ord("]")))
        while True:
            if self._peek(2) in ("&&", "--", "~~"):
                raise PatternError("character class set operations are not supported")
            ch = self._next(unclosed)
            if ch == "]":
                break
            if ch == "[":
                items.append(self._nested_class(negated))
                continue
            if ch == "\\":
                items.append(self._class_escape(unclosed))
                continue
            items.append(self._range(_java_literal(ch), ord(ch)))
        if nested and not negated:
            return "".join(items)  # a nested class only adds to the outer one
        return f"[{'^' if negated else ''}{''.join(items)}]"

    def _nested_class(self, outer_negated: bool) -> str:
        posix = re.compile(r":(\^?)([a-z]+):\]").match(self.src, self.pos)
        if not posix:
            return self._char_class(nested=True, outer_negated=outer_negated)
        self.pos = posix.end()
        if posix.group(2) not in POSIX_CLASSES:
            raise PatternError(f"unknown character class '{posix.group(2)}'")
        if posix.group(1):
            if outer_negated:
                raise PatternError("nested negation in a negated class is not supported")
            return f"[^{POSIX_CLASSES[posix.group(2)]}]"
        return POSIX_CLASSES[posix.group(2)]

    def _class_escape(self, unclosed: str) -> str:
        ch = self._next(unclosed)
        if ch in "dDwWsS":
            return self._not_a_range("\\" + ch)
        if ch in "pP":
            return self._not_a_range(self._property(ch))
        if ch in "bBAz":
            raise PatternError("assertion in a character class")
        text = self._escaped_char(ch)
        return self._range(text, _point_of(text))

    def _not_a_range(self, text: str) -> str:
        if self._peek() == "-" and self._peek(2) not in ("-]", "--"):
            raise PatternError("invalid range in a character class")
        return text

    def _range(self, low_text: str, low: int) -> str:
        if self._peek() != "-" or self._peek(2) in ("-]", "--") or len(self._peek(2)) < 2:
            return low_text
        self.pos += 1
        ch = self._next("unclosed character class")
        if ch == "\\":
            ch = self._next("unclosed character class")
            if ch in "dDwWsSpPbBAz":
                raise PatternError("invalid range in a character class")
            high_text = self._escaped_char(ch)
            high = _point_of(high_text)
        elif ch == "[":
            raise PatternError("invalid range in a character class")
        else:
            high_text, high = _java_literal(ch), ord(ch)
        if high < low:
            raise PatternError("invalid range in a character class")
        return f"{low_text}-{high_text}"


def _point_of(java_text: str) -> int:
    """Code point of one emitted literal."""
    if java_text.startswith("\\x"):
        return int(java_text[2:].strip("{}"), 16)
    return ord(java_text[-1])
