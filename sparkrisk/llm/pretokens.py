"""Pre-tokens of texts, by the two vocabularies' own rules.

The known characters are tab, line ends, printable ASCII and the Latin letters and signs up to U+017F; they mean the same to Python's
re and to the tokenizers library, and the tests compare each of them, and pairs of them, with the library. Other characters concern
only the stretch between two cuts in which they stand: if all of a stretch's characters have been of one kind in all versions of
Unicode since 3.2, a general pattern splits it, else the library counts that stretch. Texts that hold a special string are left to the
library as a whole, as it looks for these first.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = " \\t\\n\\r"
#: Without no-break space, U+0085 and the capital I with dot, on whose kind or lower case libraries differ.
KNOWN = re.compile("[\\t\\n\\r -~¡-įı-ſ]*")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two vocabularies' own pre-tokenizer patterns, over the known characters; letters come first as no other part begins with one.
BYTE_PATTERN = re.compile(f" ?[{LETTERS}]+|{CONTRACTIONS}| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_PATTERN = re.compile(f"[{LETTERS}]+|{CONTRACTIONS}|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Byte-level pre-tokens over all characters, for those whose kind is steady.
GENERAL_PATTERN = regex.compile(f" ?\\p{{L}}+|{CONTRACTIONS}| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}]+|\\s+(?!\\S)|\\s+")
#: Before a space behind a character that is white space to nobody a pre-token begins.
CUT = re.compile("(?<=[^\\s\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff])(?= )")
#: Longer texts are walked match by match, so that their pre-tokens are never all in memory.
LONG_TEXT = 2_000_000
#: Words kept by a worker; then the memory starts anew.
MOST_WORDS = 400_000


#: White space beside which a cut before each space would not be a cut between pre-tokens.
UNEVEN = re.compile(" [ \\t\\n\\r]|[\\t\\n\\r] ")


@lru_cache(maxsize=1)
def steady() -> re.Pattern:
    """Matches texts of characters that were assigned in Unicode 3.2 and have kept their category since, without control characters:
    libraries of any Unicode version agree on these."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    kept = [c for c in range(0x20, 0x30000) if (k := old(chr(c))) == now(chr(c)) and k[0] not in "C"]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(kept), key=lambda x: x[1] - x[0])]
    return re.compile("[\\t\\n\\r" + "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs) + "]*")


def has_special(text: str, specials: tuple[str, ...]) -> bool:
    return any(s in text for s in specials)


def is_known(text: str, specials: tuple[str, ...]) -> bool:
    return KNOWN.fullmatch(text) is not None and not any(s in text for s in specials)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else the next free one from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level(text: str) -> str:
    stand_in = byte_letters()
    return "".join(stand_in[b] for b in text.encode())


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())
