"""Text expressions: missing values, comparison forms, keys, masks and repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point that counts as white space when a cell is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: The same set as a regular-expression class (Java syntax).
WS_INNER = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_INNER}]"

# Words read as yes and as no.
TRUE_WORDS = ("true", "yes", "y", "1", "t", "si", "sì", "oui", "vrai")
FALSE_WORDS = ("false", "no", "n", "0", "f", "non", "faux")

# Filler words, reduced to letters and digits.
FILLER_WORDS = (
    "na", "nd", "nan", "nil", "none", "null", "tbd", "undefined", "unknown", "unspecified",
    "unavailable", "notavailable", "notapplicable", "notspecified", "nodata", "missing", "empty",
    "placeholder", "dummy", "test", "xxx", "xxxx", "sconosciuto", "ignoto", "nondisponibile",
    "nonspecificato", "nonapplicabile", "dadefinire", "mancante", "nessuno", "vuoto",
)
#: Fillers and punctuation up to this length are only trusted beside longer values.
SHORT_TOKEN = 3

# Legal forms ignored when organisation names are compared.
LEGAL_FORMS = (
    "ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "gmbh", "ag", "bv",
    "nv", "sa", "sas", "sarl", "srl", "spa", "plc", "co", "company", "group", "holding",
    "holdings",
)

# The shape of an email address, and of a number without decoration.
EMAIL_PATTERN = (
    r"\A[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\z"
)
PLAIN_NUMBER_PATTERN = r"\A[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?\z"

# The characters of code page 1252 that differ from Latin-1, and their bytes.
CP1252_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
REPLACEMENT = "\ufffd"
MASK_LENGTH = 40


def trim(value: Column) -> Column:
    """Strip every kind of white space. Spark's ``trim`` removes plain spaces only."""
    return F.btrim(value, F.lit(WHITESPACE))


def fold(value: Column) -> Column:
    """Lower-case for comparison; the sharp s is spelled out as two letters."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def missing(value: Column, data_type: T.DataType) -> Column:
    """Null, NaN, or text made of nothing but white space."""
    if is_text(data_type):
        return value.isNull() | (trim(value) == "")
    if is_floating(data_type):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def comparison_form(value: Column, data_type: T.DataType) -> Column:
    """Trimmed and folded text; other types as they are."""
    return fold(trim(value)) if is_text(data_type) else value


def normalised_text(value: Column, data_type: T.DataType) -> Column:
    """Trimmed text with every flavour of blank as null."""
    text = trim(value.cast("string")) if is_text(data_type) else value.cast("string")
    return F.when(~missing(value, data_type), text)


def boolean_token(value: Column) -> Column:
    """True, false, or null when the trimmed text is neither a yes word nor a no word."""
    lowered = F.lower(trim(value))
    return F.when(lowered.isin(*TRUE_WORDS), True).when(lowered.isin(*FALSE_WORDS), False)


def is_email(value: Column) -> Column:
    return trim(value).rlike(EMAIL_PATTERN)


def is_plain_number(value: Column) -> Column:
    """Text that a plain cast accepts without any cleaning."""
    return trim(value).rlike(PLAIN_NUMBER_PATTERN)


def squash(value: Column) -> Column:
    """Category key: folded letters and digits only."""
    return F.regexp_replace(fold(trim(value)), r"[^\p{L}\p{N}]+", "")


def identity_key(value: Column) -> Column:
    """Comparison key of a name: punctuation, dots and legal forms removed.

    Dots stay inside anything with an ``@``, where they are part of the address.
    """
    text = F.coalesce(fold(value.cast("string")), F.lit(""))
    spaced = F.regexp_replace(text, r"(?U)[^\w\s@.]+", " ")
    dotless = F.when(spaced.contains("@"), spaced).otherwise(F.replace(spaced, F.lit("."), F.lit("")))
    bare = F.regexp_replace(dotless, rf"(?U)\b(?:{'|'.join(LEGAL_FORMS)})\b", " ")
    return trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def blocking_key(parts: list[Column]) -> Column:
    """Identity keys joined by a bar; null when every part is empty."""
    keys = [identity_key(part) for part in parts]
    filled = F.concat_ws("", *keys) != ""
    return F.when(filled, F.concat_ws("|", *keys))


#: A lead byte followed by a continuation byte, as either code page shows them. Text without
#: such a pair cannot be damaged, which spares nearly every value the decoding below.
_BYTE_PAIR = rf"[\xC2-\xF4][\x80-\xBF{CP1252_CHARACTERS}]"


def _decoded_again(text: Column, original: Column) -> Column:
    """Read Latin-1 text as the UTF-8 bytes it may really be; null when it is not."""
    single_byte = F.when(text.rlike(r"\A[\x00-\xFF]*\z"), text)
    repaired = F.try_validate_utf8(F.encode(single_byte, "ISO-8859-1").cast("string"))
    sound = (repaired != original) & ~repaired.rlike(r"[\x80-\x9F\x{FFFD}]")
    return F.when(sound, repaired)


def repair_encoding(value: Column) -> Column:
    """UTF-8 text that was read as code page 1252 or Latin-1, decoded properly.

    Null when there is nothing to repair. Correctly read accents are left alone because
    their bytes are not valid UTF-8.
    """
    windows = F.when(
        ~value.rlike(r"[\x80-\x9F]"),
        F.translate(value, CP1252_CHARACTERS, CP1252_BYTES),
    )
    return F.when(
        value.rlike(_BYTE_PAIR),
        F.coalesce(_decoded_again(windows, value), _decoded_again(value, value)),
    )


def has_lost_characters(value: Column) -> Column:
    return value.contains(REPLACEMENT)


def mask(value: Column, length: int = MASK_LENGTH) -> Column:
    """The shape of a value: letters as ``a``, digits as ``9``."""
    shape = F.regexp_replace(F.substring(value, 1, length), r"\p{Nd}", "9")
    shape = F.regexp_replace(shape, r"[\p{L}\p{Nl}\p{No}]", "a")
    return F.when(F.length(value) > length, F.concat(shape, F.lit("…"))).otherwise(shape)


def neutralise_formula(value: Column) -> Column:
    """Quote text a spreadsheet would run as a formula; plain numbers stay as they are."""
    left_trimmed = F.regexp_replace(value, rf"\A{WS}+", "")
    formula = left_trimmed.rlike(r"\A[=+\-@]") | value.rlike(r"\A[\t\r]")
    number = left_trimmed.rlike(r"\A[-+]?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?\z")
    return F.when(formula & ~number, F.concat(F.lit("'"), value)).otherwise(value)


def render(value: Column) -> Column:
    """A cell for display: gaps are named and padding is bracketed."""
    text = value.cast("string")
    return (
        F.when(text.isNull() | (text == ""), F.lit("(empty)"))
        .when(trim(text) != text, F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
    )
