"""Column and table names: safety tests, safe spellings, hints, and cells safe to open in a spreadsheet."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.values import worked_out

# Name rules of the target platforms.
UNSAFE_NAME = r"[ ,;{}()\n\t=]"
TARGET_NAME = r"^[a-z_][a-z0-9_]*$"
NAME_LENGTH = 128
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]{0,127}$"
SAFE_PATH = r"^[A-Za-z0-9_./:@\- ]{1,300}$"

# What a column name suggests about personal data; the first match wins.
PRIVACY_HINTS = [
    ("nome de pessoa", r"(^|_|\b)(nome|name|sobrenome|surname)(_|\b|$)"),
    ("e-mail", r"e-?mail"),
    ("documento (CPF, CNPJ, RG)", r"(^|_|\b)(cpf|cnpj|rg|passaporte|passport)(_|\b|$)"),
    ("telefone", r"telefone|phone|celular|fone|whatsapp"),
    ("endereço ou CEP", r"endere[cç]o|address|(^|_|\b)(cep|zip|postal)(_|\b|$)"),
    ("data de nascimento", r"nascimento|birth|(^|_|\b)dob(_|\b|$)"),
    ("credencial", r"senha|password|token|secret"),
    ("remuneração", r"sal[aá]rio|salary|remunera"),
]


@cache
def _ascii_of() -> dict[str, str]:
    """What the compatibility decomposition of every character outside ASCII leaves in ASCII, where it leaves any."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000 and unicodedata.decomposition(chr(code)):
            letters = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if letters:
                found[chr(code)] = letters
    return found


@cache
def _accents() -> tuple[str, str]:
    """Every character that leaves one ASCII character, and that character."""
    one = {c: letters for c, letters in _ascii_of().items() if len(letters) == 1}
    return "".join(one), "".join(one.values())


@cache
def _signs() -> tuple[str, str]:
    """Every character that leaves several ASCII characters, and those, separated."""
    several = {c: letters for c, letters in _ascii_of().items() if len(letters) > 1}
    return "\x1f".join(several), "\x1f".join(several.values())


@cache
def _sign_pages() -> tuple[str, list[list[str]]]:
    """The characters of ``_signs`` by the upper part of their code: a pattern of all characters on such pages, and
    the letters on each page, by the lower part of the code."""
    pages: dict[int, list[str]] = {}
    for sign, letters in zip(*(s.split("\x1f") for s in _signs())):
        page, place = divmod(ord(sign), 256)
        pages.setdefault(page, [""] * 256)[place] = letters
    spans = "".join(rf"\x{{{max(page * 256, 0x80):x}}}-\x{{{page * 256 + 255:x}}}" for page in sorted(pages))
    return f"[{spans}]", [pages.get(page, []) for page in range(max(pages) + 1)]


def _spelled(text: Column) -> Column:
    """A text with its signs spelled out. Only characters on pages that hold signs are looked at one by one, each found
    by its place; what lies between them stays in one piece."""
    on_page, pages = _sign_pages()
    letters = F.array(*[F.split(F.lit("\x1f".join(page)), "\x1f") for page in pages])

    def spelled(piece: Column) -> Column:
        code = F.ascii(piece)
        sign = F.get(F.get(letters, F.shiftright(code, 8)), code.bitwiseAND(255))
        return F.when(code < 0x80, piece).otherwise(F.coalesce(F.nullif(sign, F.lit("")), piece))

    pieces = F.regexp_extract_all(text, F.lit(rf"{on_page}|[^{on_page[1:]}+"), F.lit(0))
    return F.when(text.rlike(on_page), F.array_join(F.transform(pieces, spelled), "")).otherwise(text)


def without_accents(text: Column) -> Column:
    """ASCII letters only: accents go, signs like ™ and ligatures become their letters, other symbols are dropped."""
    plain = F.regexp_replace(worked_out(F.translate(text, *_accents()), _spelled), r"[^\x00-\x7f]+", "")
    return F.when(F.octet_length(text) > F.length(text), plain).otherwise(text)


def snake_case(name: Column) -> Column:
    def filled(cleaned: Column) -> Column:
        return F.when(cleaned == "", "coluna").when(cleaned.rlike("^[0-9]"), F.concat(F.lit("c_"), cleaned)).otherwise(cleaned)

    # Every ASCII letter or digit stays, so what comes after more of them than a name holds can't change the name.
    telling = F.coalesce(F.regexp_substr(name, F.lit("^(?:[^0-9a-zA-Z]*+[0-9a-zA-Z]){%d}" % (NAME_LENGTH + 1))), name)
    cleaned = F.lower(F.trim(F.regexp_replace(without_accents(telling), "[^0-9a-zA-Z]+", "_"), F.lit("_")))
    return F.left(worked_out(cleaned, filled), F.lit(NAME_LENGTH))


def name_key(name: Column) -> Column:
    """The name in lower case, letters and digits only, to match names across datasets."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def table_name(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    cleaned = F.lower(F.trim(F.regexp_replace(stem, "[^A-Za-z0-9_]+", "_"), F.lit("_")))
    filled = F.when(cleaned == "", "dataset").otherwise(cleaned)
    return F.left(F.when(filled.rlike("^[a-z_]"), filled).otherwise(F.concat(F.lit("t_"), filled)), F.lit(100))


def is_unsafe_name(name: Column) -> Column:
    return name.rlike(UNSAFE_NAME) | (F.trim(name) == "")


def privacy_hint(name: Column) -> Column:
    hint = F.lit(None).cast("string")
    for reason, pattern in reversed(PRIVACY_HINTS):
        hint = F.when(name.rlike("(?i)" + pattern), reason).otherwise(hint)
    return hint


def csv_safe(cell: Column) -> Column:
    """A cell a spreadsheet will not run as a formula."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(F.left(text, F.lit(1)).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def is_identifier(name: Column) -> Column:
    """Whether a name may stand unquoted in generated statements; a line end after it does not pass."""
    return F.coalesce(name.rlike(IDENTIFIER.replace("$", r"\z")), F.lit(False))


def is_safe_path(path: Column) -> Column:
    return F.coalesce(path.rlike(SAFE_PATH.replace("$", r"\z")), F.lit(False))


def check_identifier(value: str, label: str) -> str:
    if not re.fullmatch(IDENTIFIER, value or ""):
        raise ValueError(f"{label}: use letters, digits and _, starting with a letter or _")
    return value


def check_path(value: str) -> str:
    if not re.fullmatch(SAFE_PATH, value or ""):
        raise ValueError("path: use letters, digits and . _ / : @ - only")
    return value
