"""Patterns in Java's dialect, word edges and white space being Unicode's.

Searches look at every position of every text, so what is tried first is what is cheap and mostly fails: ``\\w`` (a table
of ASCII word characters in this dialect) and a first letter. Flags stand around words only: under them a class of ranges
folds each character several times.

``WORD`` is what counts as a word character, ``EDGE`` a change between word and other characters, ``SPACE`` a white
space character as str.isspace has it.
"""

from __future__ import annotations

from dataclasses import dataclass

WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<!\w)|(?!\w))(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: The left edge of what begins with a letter or digit; ASCII letters, the most common case, are ruled out first.
START = rf"(?<!\w)(?<!{WORD})"
#: The right edge of what ends with one.
END = rf"(?!{WORD})"
SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_SET}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_BREAK = r"[\n\u0085\u2028\u2029]"
TOKEN = rf"\w+|[^\w{SPACE_SET}]"
#: All but one character of each token, and what stands between tokens.
NO_TOKEN = rf"(?<=\w)\w+|{SPACE}+"


def first(*words: str) -> str:
    """What a word of these may begin with, in either case: also the letters that fold to an ASCII one."""
    odd = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}
    return "[" + "".join(c.upper() + c + odd.get(c, "") for c in sorted({w.lstrip("\\")[0] for w in words})) + "]"


def any_of(words: tuple[str, ...]) -> str:
    """One of the words in either case, tried by first letter."""
    heads = dict.fromkeys(w[0] for w in words if w[0].isalpha())
    return "(?:" + "|".join([first(h) + "(?iu:" + "|".join(w[1:] for w in words if w[0] == h) + ")" for h in heads] + [w for w in words if not w[0].isalpha()]) + ")"


# The character classes that normalisation strips, and the letters that it folds.
CONTROL = "[" + "".join(rf"\x{c:02x}" for c in (*range(9), 0xB, 0xC, *range(0xE, 0x20), 0x7F)) + "]"
ZERO_WIDTH = r"[\u00ad\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff]"
BIDI = r"[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"
TAG = r"[\x{e0000}-\x{e007f}]"
HIDDEN = rf"(?![\x00-\x7f])(?:{ZERO_WIDTH}|{BIDI}|{TAG})"
CONFUSABLE = "аеорсухѕіјԁғԛԝАВЕКМНОРСТУХЅІЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
#: The blocks of all of these.
CONFUSABLE_BLOCKS = r"[\u0370-\u052f]"
CONFUSED_WITH = "aeopcyxsijdfqwABEKMHOPCTYXSIJABEZHIKMNOPTYXov"


@dataclass(frozen=True)
class Secret:
    name: str
    pattern: str
    #: A text without any of these cannot match, which is far cheaper to see.
    literals: tuple[str, ...] = ()
    spans_lines: bool = False
    #: The same as a pattern, where no literal says it.
    guard: str = ""


#: How keys of the first two patterns begin.
KEYS = ("sk", "ghp", "gho", "github_pat", *(f"xox{c}" for c in "baprs"))


# The nine secret patterns, applied in this order, each to what the one before has left.
SECRETS = (
    Secret("pattern-1", rf"{START}(?:sk|ghp|gho|github_pat|xox[baprs])-[-_A-Za-z0-9]{{16,}}{EDGE}", tuple(f"{k}-" for k in KEYS)),
    Secret("pattern-2", rf"{START}(?:sk|ghp|gho|github_pat|xox[baprs])_[-_A-Za-z0-9]{{16,}}{EDGE}", tuple(f"{k}_" for k in KEYS)),
    Secret("pattern-3", rf"{START}(?:AKIA|ASIA)[0-9A-Z]{{16}}{EDGE}", ("AKIA", "ASIA")),
    Secret("pattern-4", rf"{START}AIza[0-9A-Za-z_-]{{35}}{EDGE}", ("AIza",)),
    Secret("pattern-5", rf"{START}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}{EDGE}", ("eyJ",)),
    Secret("pattern-6", r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]+?-----END[A-Z ]*PRIVATE KEY-----", ("-----BEGIN",), True),
    Secret("pattern-7", rf"{EDGE}[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{EDGE}", ("@",)),
    Secret("pattern-8", rf"{START}({any_of(('api[_-]?key', 'token', 'password', 'secret'))}){SPACE}*[:=]{SPACE}*['\"]?[^'\"{SPACE_SET}]{{8,}}", (":", "="), True),
    Secret("pattern-9", rf"{START}(?:\p{{Nd}}[ -]?){{13,19}}{EDGE}", guard=r"(?:\p{Nd}[ -]?){13}"),
)
MASK = "[REDACTED]"

# What marks a line.
CRITICAL_WORDS = ("must", "must not", "never", "only", "required", "forbidden", "approval", "approve", "deny", "scope", "deadline", "due", "owner", "assignee", "blocked", "blocks", "secret", "redact", "source", "provenance", "trust", "unsafe", "safe default")
QUESTION_WORDS = ("todo", "open question", "unknown", "unclear", "blocked", r"\?")
INJECTION_WORDS = ("ignore previous", "system:", "developer:", "assistant:", "user:", "tool:", "reveal secrets", "exfiltrate", "send to", rf"curl{SPACE}+http", "base64")
URL = rf"https?://[^{SPACE_SET})>\]]+"

CRITICAL = rf"(?<!\w)(?={first(*CRITICAL_WORDS)})(?<!{WORD}){any_of(CRITICAL_WORDS)}{END}"
QUESTION = rf"(?={first(*QUESTION_WORDS)})(?:^|(?<={SPACE})){any_of(QUESTION_WORDS)}"
ANCHOR = rf"{CRITICAL}|{QUESTION}"
INJECTION = rf"(?<!\w)(?={first(*INJECTION_WORDS)})(?<!{WORD}){any_of(INJECTION_WORDS)}{EDGE}"

# The same searches in RE2's dialect, for Arrow's kernels, which take a few nanoseconds a character. They let through all
# that the patterns above match and little more: edges are those of ASCII words, and what they let through is searched again.
_EDGE_2 = "[^0-9A-Za-z_]"


def _any_2(words: tuple[str, ...]) -> str:
    """What one of the words begins with, up to a class; beside s and k, which RE2 folds itself, i has odd forms."""
    return "(?:" + "|".join(dict.fromkeys(w.split("[")[0].replace("i", "[i\u0130\u0131]") for w in words)) + ")"


MAY_ANCHOR = f"(?i)(?:^|{_EDGE_2})(?:{_any_2(CRITICAL_WORDS)}(?:{_EDGE_2}|$)|{_any_2(QUESTION_WORDS)})"
MAY_INJECT = f"(?i)(?:^|{_EDGE_2}){_any_2(INJECTION_WORDS)}"
