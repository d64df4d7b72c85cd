"""Text functions as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that searches leave out.
STOPWORDS = ("a ao aos as da das de do dos e em na nas no nos o os ou para por qual quais que sobre sao se um uma").split()

#: Blocks whose characters decompose to letters and digits: Latin, super- and subscripts, letter-like, enclosed and squared signs, ligatures, full-width forms,
#: mathematical letters, and letters in circles and squares beyond the basic plane.
_BLOCKS = ((0xA0, 0x250), (0x2B0, 0x2FF), (0x1D2C, 0x1DC0), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0x2C60, 0x2C80), (0x3200, 0x3400), (0xA69C, 0xA69E), (0xA770, 0xA7FA),
           (0xAB5C, 0xAB6A), (0xFB00, 0xFB07), (0xFF00, 0xFF5F), (0x1D400, 0x1D800), (0x1F100, 0x1F200))


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without marks: one-to-one as two strings, others as a mapping."""
    source, target, longer = [], [], {}
    for low, high in _BLOCKS:
        for char in map(chr, range(low, high)):
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if plain != char and len(plain) == 1:
                source.append(char)
                target.append(plain)
            elif plain != char and plain:
                longer[char] = plain
    return "".join(source), "".join(target), longer


def _ranges(chars: list[str], gap: int = 16) -> list[str]:
    """A few ranges that hold all chars: a long list of single ones would be tried one by one at every place."""
    out: list[list[str]] = []
    for c in chars:
        if out and ord(c) - ord(out[-1][1]) <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [f"{a}-{b}" for a, b in out]


@cache
def _spelt_out() -> dict[str, str]:
    return {k: v for k, v in _decompositions()[2].items() if any(c.isascii() and c.isalnum() for c in v)}


@cache
def _pairs() -> str:
    """The characters that become several, as SQL: one expression instead of a call for each."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "array(" + ", ".join(f"named_struct('c', {quoted(c)}, 'p', {quoted(p)})" for c, p in _spelt_out().items()) + ")"


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    source, target, longer = _decompositions()
    short = _spelt_out()
    spelt = F.aggregate(F.expr(_pairs()), text, lambda t, x: F.replace(t, x["c"], x["p"]))
    spelt = F.when(text.rlike("[" + "".join(_ranges(sorted(short))) + "]"), spelt).otherwise(text)
    plain = F.regexp_replace(F.translate(spelt, source, target), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain)


def normalize_whitespace(text: Column) -> Column:
    """Lines without outer or repeated white space; blank ones go."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    clean = F.transform(lines, collapse)
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def normalize_identifier(text: Column) -> Column:
    """Lower case, no accents, runs of anything but a-z and 0-9 as one space. Null is empty."""
    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, single spaces; punctuation stays."""
    return collapse(strip_accents(F.lower(F.coalesce(text, F.lit("")))))


def search_tokens(text: Column) -> Column:
    """Words of the normalized text, without stopwords and single letters."""
    return F.filter(F.split(normalize_identifier(text), " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def stable_id(*parts: Column) -> Column:
    """24 hex digits that depend on the parts and their order; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 24)


def fold(text: Column) -> Column:
    """The key by which repeated queries and claims are found."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def document_title(text: Column, file_name: Column) -> Column:
    """The first heading of level one, or the file name where there is none."""
    return F.when(text.rlike(r"(?m)^# "), F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1))).otherwise(file_name)


def normalize_cell(text: Column, limit: int = 200) -> Column:
    clean = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))).otherwise(clean)


def excerpt(text: Column, limit: int = 240) -> Column:
    return F.substring(collapse(F.coalesce(text, F.lit(""))), 1, limit)


def safe_file_name(name: Column, limit: int = 80) -> Column:
    """Letters, digits, dot, dash and underscore; others become one underscore."""
    return F.substring(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_"), 1, limit)


def display_label(path: Column) -> Column:
    """The file's stem without its number."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"^[0-9]+[_\- ]*", "")


def truncate_title(text: Column, limit: int = 34) -> Column:
    clean = collapse(text)
    return F.when(F.length(clean) > limit, F.concat(F.rtrim(F.substring(clean, 1, limit - 3)), F.lit("..."))).otherwise(clean)


def decode_with_fallback(content: Column) -> Column:
    """UTF-8 without its byte order mark where the bytes are valid, else Latin-1, which never fails."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


# Names that are no person's and no role's, in two presets.
PERSON_BLOCKED = ("nome", "tbd", "total", "totais", "subtotal", "sub total", "target", "rpa", "profissionais", "bolsas", "custo total de rh mensal", "encargos clt", "descricao", "descricoes", "rh direto bolsas", "rh direto celetistas", "rh indireto administrativo")
PERSON_BLOCKED_IMPORT = (*PERSON_BLOCKED, "custo dell", "historico de margem para prestacao de contas dell")
PERSON_PREFIXES = ("rh ", "sub total", "subtotal", "total ", "totais ", "custo ", "historico ", "margem ")
ROLE_BLOCKED = ("ufc", "s vinculo", "total", "totais", "custo dell")
ROLE_BLOCKED_IMPORT = (*ROLE_BLOCKED, "column")
_WORDS = "[A-Za-zÀ-ÿ]+"


def is_person_name(value: Column, blocked: tuple[str, ...] = PERSON_BLOCKED) -> Column:
    text, name = collapse(F.coalesce(value, F.lit(""))), normalize_identifier(value)
    free = ~name.isin(*blocked)
    for prefix in PERSON_PREFIXES:
        free = free & ~F.startswith(name, F.lit(prefix))
    return (F.length(text) >= 5) & ~text.rlike(r"\p{Nd}") & text.rlike(r"\p{Ll}") & (name != "") & free & (F.size(F.regexp_extract_all(text, F.lit(_WORDS), 0)) >= 2)


def is_role(value: Column, blocked: tuple[str, ...] = ROLE_BLOCKED) -> Column:
    from docquarry.functions.numbers import profile_number

    text, name = collapse(F.coalesce(value, F.lit(""))), normalize_identifier(value)
    words = F.size(F.regexp_extract_all(text, F.lit(_WORDS), 0))
    return (name != "") & ~name.isin(*blocked) & profile_number(text).isNull() & ~text.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}") & words.between(1, 12)
