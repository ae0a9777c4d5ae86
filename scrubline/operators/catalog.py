"""The detectors: what is searched, and how it is classified.

Patterns follow the ASCII word boundaries and the white space class of ECMAScript, spelled out in
what Java and Python (ASCII) read alike: before a word character a boundary is a negative lookbehind, after one a negative lookahead;
where the neighbour may be either, both sides are spelled. A search tries a pattern at every character, so
patterns begin with what tells most of them apart, and look behind only after that.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.scalars import SPACES

#: Severities and their ranks, actions, classes, routes, the dictionary detector, types that must be deleted.
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
ACTIONS = ("delete", "tokenize", "generalize", "keep")
CLASSIFICATIONS = ("P0", "P1", "P2", "P3")
ROUTES = ("cloud-approved", "cloud-sanitized", "local-only")
DICTIONARY, DICTIONARY_KIND = "local-exact-data", "exact-data"
FORCED_DELETE = ("private-key", "api-token", "credential")

#: ASCII letters, digits and _; by its name Java asks a table, not one range after the other.
_W = r"\w"
_BEFORE, _AFTER = f"(?<!{_W})", f"(?!{_W})"
_EITHER = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
#: Parts of patterns.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL, _DOMAIN = r"(?:\w(?<!\w\w)|[.%+-](?<=\w[.%+-]))[\w.%+-]*+", rf"@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_AFTER}"
_FIRST, _OTHERS = rf"(?=[0-9]){_BEFORE}{_OCTET}", rf"(?:\.{_OCTET}){{3}}{_AFTER}"
_PEM = "(?:RSA |EC |OPENSSH )?PRIVATE KEY-----"


@dataclass(frozen=True)
class Detector:
    name: str
    kind: str
    severity: str
    pattern: str
    #: A literal that every match holds, or None.
    literal: str | None = None
    #: A short pattern that every match holds, asked where a common literal is found, or alone.
    probe: str | None = None
    #: Characters of which every match holds one.
    signs: tuple[str, ...] = ()
    #: For a pattern of two parts, head and tail: a character that every tail begins with, and the characters of the heads, of which it is none.
    around: tuple[str, str] | None = None
    head: str = ""
    tail: str = ""

    @property
    def may_be_empty(self) -> bool:
        """Whether nothing is known that every match holds."""
        return not (self.literal or self.probe or self.signs)

    def may_match(self, text: Column) -> Column:
        """A test that is true for every text with a match, and much cheaper than the pattern."""
        asked = [F.contains(text, F.lit(self.literal))] if self.literal is not None else []
        if self.signs:
            asked.append(reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in self.signs]))
        if self.probe or not asked:
            asked.append(text.rlike(self.probe or self.pattern))
        return reduce(Column.__and__, asked)


#: The built-in detectors in their order.
DETECTORS = (
    Detector("private-key-block", "private-key", "critical", rf"-----BEGIN {_PEM}[\s\S]*?-----END {_PEM}", "-----BEGIN "),
    Detector("openai-style-token", "api-token", "critical", rf"sk-(?<!\wsk-)[\w-]{{20,}}{_EITHER}", "sk-"),
    Detector("github-token", "api-token", "critical", rf"gh[pousr]_(?<!\wgh[pousr]_)[A-Za-z0-9]{{20,}}{_AFTER}", "_", "gh[pousr]_"),
    Detector(
        "credential-assignment",
        "credential",
        "critical",
        rf"[PpAaCc](?<!\w[PpAaCc])(?i:(?<=p)(?:assword|asswd)|(?<=a)(?:pi[_-]?key|ccess[_-]?token)|(?<=c)lient[_-]?secret)[{SPACES}]*[:=][{SPACES}]*[\"']?[^{SPACES}\"']{{8,}}",
        probe="[PpAaCc](?i:assw(?:or)?d|pi[_-]?key|ccess[_-]?token|lient[_-]?secret)",
        signs=(":", "="),
    ),
    Detector("email", "email", "high", _LOCAL + _DOMAIN, "@", around=("@", string.ascii_letters + string.digits + "_.%+-"), head=_LOCAL, tail=_DOMAIN),
    Detector("taiwan-mobile", "phone", "high", "09(?<![0-9]09)[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}(?![0-9])", "09"),
    Detector("taiwan-id", "taiwan-id", "high", rf"[A-Z][12](?<!\w[A-Z][12])[0-9]{{8}}{_AFTER}", probe="[12][0-9]{8}"),
    Detector("ipv4", "ip-address", "medium", _FIRST + _OTHERS, probe=r"[0-9]\.[0-9]", around=(".", string.digits), head=_FIRST, tail=_OTHERS),
)


def escape(term: str) -> str:
    """A term as a literal Java pattern: every ASCII punctuation mark gets a backslash."""
    return "".join("\\" + c if c in string.punctuation else c for c in term)


def with_dictionary(terms: list[str] | tuple[str, ...] = ()) -> tuple[Detector, ...]:
    """The built-in detectors, then one for each term of two characters or more, in the caller's order."""
    return DETECTORS + tuple(Detector(DICTIONARY, DICTIONARY_KIND, "high", escape(t), t) for t in terms if len(t) >= 2)
