"""String functions as column expressions: folding, cleaning, codes, entities and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.functions.characters import fold_characters, unescape

# Entity patterns.
PHONE = r"(?:\+?55\s*)?(?:\(?\d{2}\)?\s*)?9?\d{4}[-\s]?\d{4}"
CEP = r"\b\d{5}-?\d{3}\b"
PROTOCOL = r"\b(?:protocolo|prot)\s*[:#-]?\s*(\d{6,})\b"
DAY_TEXT = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
INSTALLATION = r"\b(?:uc|instalacao|instalação|inst)\s*[:#-]?\s*(\d{5,})\b"

# White space of Unicode and the four separators that count as such.
WHITE = r"(?U)[\s\x1c-\x1f]+"

# Mask patterns.
CPF = r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"
CNPJ = r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b"
EMAIL = r"\b[\w.-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE_WORD = r"\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?9?\d{4}-?\d{4}\b"


def squeeze(x: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fold(x: Column) -> Column:
    """FN05: case-, accent- and compatibility-free comparison form, white space of any script squeezed."""
    return F.trim(F.regexp_replace(fold_characters(x), WHITE, " "))


def upper_trim(x: Column) -> Column:
    """FN01: upper case, squeezed, blank to NULL."""
    return F.nullif(F.upper(squeeze(x)), F.lit(""))


def decimal_text(x: Column) -> Column:
    """FN02: ``1.234,56`` to ``1234.56``; text without comma is kept; blank to NULL."""
    t = F.trim(x)
    swapped = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.nullif(F.when(t.contains(","), swapped).otherwise(t), F.lit(""))


def code_text(x: Column) -> Column:
    """FN03: upper-case code without the spreadsheet suffix ``.0``."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(x.cast("string"))), r"^(\d+)\.0$", "$1"), F.lit(""))


def key_text(x: Column) -> Column:
    """Key of the enrichment joins: NULL to blank, ``.0`` dropped, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\.0$", ""))


def clean_text(x: Column) -> Column:
    """FN04: references decoded, tags to blanks, compatibility forms without accents, case folded, white space squeezed; NULL to blank."""
    return fold(F.regexp_replace(unescape(F.coalesce(x, F.lit(""))), r"<[^>]+>", " "))


def _distinct_matches(x: Column, pattern: str, group: int) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit("(?U)" + pattern), F.lit(group))))


def extract_entities(x: Column) -> dict[str, Column]:
    """FN06: sorted distinct phones, postal codes, protocols, dates and installation numbers."""
    return {
        "telefones_extraidos": _distinct_matches(x, PHONE, 0),
        "ceps_extraidos": _distinct_matches(x, CEP, 0),
        "protocolos_extraidos": _distinct_matches(x, PROTOCOL, 1),
        "datas_extraidas": _distinct_matches(x, DAY_TEXT, 0),
        "instalacoes_mencionadas": _distinct_matches(x, INSTALLATION, 1),
    }


def _mask(x: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, label in steps:
        x = F.regexp_replace(x, pattern, label)
    return x


def mask_registry_numbers(x: Column) -> Column:
    """FN07: CPF, CNPJ and phone."""
    return F.trim(_mask(x, [(CPF, "[CPF]"), (CNPJ, "[CNPJ]"), (PHONE_WORD, "[TELEFONE]")]))


def mask_pii(x: Column) -> Column:
    """FN08: CPF, CNPJ, e-mail and phone."""
    return _mask(x, [(CPF, "[CPF]"), (CNPJ, "[CNPJ]"), (EMAIL, "[EMAIL]"), (PHONE_WORD, "[TELEFONE]")])


def redact_pii(x: Column) -> Column:
    """FN09: both CPF forms, e-mail and phone with the redaction labels."""
    return _mask(
        x,
        [
            (r"\d{3}\.\d{3}\.\d{3}-\d{2}", "[CPF_REDACTED]"),
            (r"\b\d{11}\b", "[CPF_REDACTED]"),
            (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
            (r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}", "[PHONE_REDACTED]"),
        ],
    )


def mask_sensitive(x: Column) -> Column:
    """FN10: e-mail, internal ids, operator names, phone, postal code and protocol."""
    return _mask(
        F.coalesce(x, F.lit("")),
        [
            (r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "[EMAIL]"),
            (r"(?i)\bbr\d{5,}\b", "br[ID_INTERNO]"),
            (r"\bgmtuk\s+[^()*\n\r]{3,80}\s+\(br\[?ID_INTERNO\]?\)", "gmtuk [USUARIO] (br[ID_INTERNO])"),
            (
                r"\bgmtuk\s+[a-zA-ZÀ-ÿ\s]{3,100}?(?=\s+(?:cliente|clt|reclama|solicita|trata|erro|segue|\*|$))",
                "gmtuk [USUARIO]",
            ),
            (PHONE, "[TELEFONE]"),
            (CEP, "[CEP]"),
            (r"\b(?:protocolo|prot)\s*[:#-]?\s*\d{6,}\b", "protocolo [PROTOCOLO]"),
            (r"\b((?:celular|telefone|tel))\s*:\s*\d+\b", "$1: [TELEFONE]"),
        ],
    )


def pseudonym(x: Column) -> Column:
    """FN11: first 12 hex digits of the sha256 of the trimmed text; blank, NULL and ``nan`` stay blank."""
    t = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit("")).otherwise(F.substring(F.sha2(t, 256), 1, 12))


def slug(x: Column, length: int = 64) -> Column:
    """FN12: lower-case words joined by hyphens."""
    words = F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w\s-]", ""))
    return F.substring(F.regexp_replace(words, r"[\s_]+", "-"), 1, length)


def excerpt(x: Column, length: int = 220) -> Column:
    """FN13: squeezed text, cut at a word boundary with an ellipsis when longer than ``length``."""
    t = squeeze(F.coalesce(x, F.lit("")))
    head = F.regexp_replace(F.substring(t, 1, length - 1), r" [^ ]*$", "")
    return F.when(F.char_length(t) <= length, t).otherwise(F.concat(head, F.lit("…")))


def bounded_example(x: Column, length: int = 420) -> Column:
    """FN14: masked text cut to ``length`` characters."""
    t = mask_sensitive(x)
    return F.when(F.char_length(t) <= length, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, length)), F.lit("..."))
    )


def join_keywords(x: Column, limit: int = 8) -> Column:
    """FN15: at most eight keywords as one text."""
    return F.coalesce(F.concat_ws(", ", F.slice(x, 1, limit)), F.lit(""))


def truthy(x: Column, words: tuple[str, ...] = ("true", "1", "sim", "yes")) -> Column:
    """PRJ22: boolean from text; NULL is false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*words), F.lit(False))


def tokens(x: Column, min_length: int = 3) -> Column:
    """Lower-case Unicode words of at least ``min_length`` characters, in text order."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w{%d,}" % min_length), F.lit(0))
