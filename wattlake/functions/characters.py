"""Character tables that are built when a plan is made and applied inside it: entities, compatibility forms, case folding.

The tables come from the Unicode data and the entity list of the standard library; a plan holds them as literals.
"""

from __future__ import annotations

import html.entities
import json
import re
import sys
import unicodedata
import zlib
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.functions.tables import let

BUCKETS = 64
# Hangul syllables decompose by arithmetic (first, last, and the bases and counts of their three parts).
HANGUL, HANGUL_LAST = 0xAC00, 0xD7A3
LEAD, VOWEL, TAIL, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7, 21, 28
# What may follow an ampersand as a reference, and code points that no reference can name.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
UNNAMED = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF))
SURROGATES, LAST = (0xD800, 0xDFFF), 0x10FFFF


def folded(c: str) -> str:
    """Compatibility form of a character without combining marks, case folded."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that become one character or nothing, what they become, and those that become several (without Hangul)."""
    one, gone, many = [], [], {}
    for code in range(sys.maxunicode + 1):
        if SURROGATES[0] <= code <= SURROGATES[1] or HANGUL <= code <= HANGUL_LAST:
            continue
        c = chr(code)
        if (f := folded(c)) != c:
            if len(f) == 1:
                one.append((c, f))
            elif f:
                many[c] = f
            else:
                gone.append(c)
    return "".join(c for c, _ in one) + "".join(gone), "".join(f for _, f in one), many


def _class(codes: list[int]) -> str:
    """A character class of these code points, in ranges."""
    runs: list[list[int]] = []
    for code in sorted(codes):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def lookup(table: dict[str, str]):
    """Function from a key column to its value in ``table``, NULL for others.

    Keys are spread over buckets by their checksum, so that a look-up compares with a few keys only.
    """
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for key, value in table.items():
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return lambda key: F.element_at(F.get(literal, (F.crc32(key.cast("binary")) % BUCKETS).cast("int")), key)


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _hangul(c: Column) -> Column:
    """Two or three parts of a syllable."""

    def parts(s: Column) -> Column:
        tail = F.when(s % TAILS != 0, character(F.lit(TAIL) + s % TAILS)).otherwise("")
        return F.concat(character(F.lit(LEAD) + F.floor(s / (VOWELS * TAILS))), character(F.lit(VOWEL) + F.floor(s % (VOWELS * TAILS) / TAILS)), tail)

    return let(F.ascii(c) - HANGUL, parts)


def fold_characters(x: Column) -> Column:
    """NFKD, combining marks removed, case folded, in one pass over characters.

    Plain ASCII is only lowered. Characters that become one or none are translated; of those that become several, each kind that
    a text holds is replaced in turn.
    """
    source, target, many = _folds()
    several = _class([*map(ord, many), *range(HANGUL, HANGUL_LAST + 1)])
    # Most text is Latin, for which the small class is told apart much faster.
    unusual = "[^" + _class([c for c in range(256) if chr(c) not in many])[1:]
    found = lookup(many)

    def expanded(t: Column) -> Column:
        # The large classes cost a microsecond a character: they see each kind of character once and no ASCII.
        kinds = F.array_join(F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7f]+", ""), "")), "")
        value = lambda c: F.when(c.between(chr(HANGUL), chr(HANGUL_LAST)), _hangul(c)).otherwise(found(c))
        each = lambda k: F.aggregate(F.regexp_extract_all(k, F.lit(several), F.lit(0)), t, lambda done, c: F.replace(done, c, value(c)))
        return let(kinds, lambda k: F.when(k.rlike(unusual), each(k)).otherwise(t))

    def whole(t: Column) -> Column:
        return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(expanded(t), source, target))

    return let(x, whole)


@cache
def _legacy() -> str:
    """Pattern of the names that need no semicolon, longest first."""
    names = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^(" + "|".join(map(re.escape, names)) + ")"


def _numbered(code: Column) -> Column:
    """Text of a numeric reference; a number too large to read is NULL and stands for one that is out of range.

    Numbers of the C1 range mean characters of the Windows code page, where it has one.
    """
    windows = {}
    for n in range(0x80, 0xA0):
        try:
            windows[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            windows[str(n)] = chr(n)
    nowhere = F.lit(False)
    for low, high in UNNAMED:
        nowhere = nowhere | code.between(low, high)
    return (
        F.when(code.isNull() | (code == 0) | code.between(*SURROGATES) | (code > LAST), "�")
        .when(code.between(0x80, 0x9F), lookup(windows)(code.cast("string")))
        .when(nowhere | (code.bitwiseAND(0xFFFE) == 0xFFFE), "")
        .otherwise(character(code))
    )


def unescape(x: Column) -> Column:
    """HTML references to characters, once: all named ones, those without semicolon by their longest name, decimal and hexadecimal ones.

    The text is cut at ampersands and each piece decoded by itself, so that what a reference gives is never read again.
    """
    named = lookup(html.entities.html5)

    def decoded(piece: Column) -> Column:
        def known(ref: Column) -> Column:
            rest = F.substring(piece, F.char_length(ref) + 1, F.char_length(piece))
            hexadecimal = F.conv(F.regexp_extract(ref, r"^#[xX]0*([0-9a-fA-F]{1,8});?$", 1), 16, 10).try_cast("long")
            decimal = F.regexp_extract(ref, r"^#0*([0-9]{1,10});?$", 1).try_cast("long")
            zero = ref.rlike(r"^#[xX]?0+;?$")
            number = F.when(zero, F.lit(0).cast("long")).when(ref.rlike("^#[xX]"), hexadecimal).otherwise(decimal)
            prefix = F.regexp_extract(ref, _legacy(), 1)
            by_prefix = F.concat(named(prefix), F.substring(piece, F.char_length(prefix) + 1, F.char_length(piece)))
            return (
                F.when(ref == "", F.concat(F.lit("&"), piece))
                .when(ref.startswith("#"), F.concat(let(number, _numbered), rest))
                .otherwise(F.coalesce(F.concat(named(ref), rest), F.when(prefix != "", by_prefix), F.concat(F.lit("&"), piece)))
            )

        return let(F.regexp_extract(piece, REFERENCE, 1), known)

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&")
        later = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
        return F.when(t.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(later, ""))).otherwise(t)

    return let(x, whole)
