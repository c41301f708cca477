"""Credential masking over text columns with native regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions.text import fold_space

MASK = "***"

# What names a credential. A key is one if it holds a name, ends in a
# password, or is the header that carries one; a scheme stands before a credential.
_NAMES = ("secret", "token", "api[_-]?key", "access[_-]?key", "credential", "passwd", "pwd")
_SCHEMES = ("bearer", "basic", "token")

# A doubled quote inside a literal, set aside while the grammar runs.
_DOUBLED = "\u0001"

# The grammar. A key is a whole run of key characters, entered at its beginning alone and
# never given back, and every repetition is of one character class: each character is read
# a bounded number of times, and the stack does not grow with the text.
_KEY_CHAR = r"[\w.-]"
_KEY_START = rf"(?<!{_KEY_CHAR})"
_KEY = rf"{_KEY_START}{_KEY_CHAR}++"
_NAMED_KEY = rf"{_KEY_START}(?={_KEY_CHAR}*?(?:{'|'.join(_NAMES)})){_KEY_CHAR}++"
_SIGN = r"\"? ?[=:] ?"
_LITERAL = r"""'[^']*+'|"[^"]*+\""""
# Where the value of a pair ends, of a header, of a scheme, and of a user in an address.
_PAIR, _HEADER, _WORD, _USER = (f"[^{stop}]" for stop in (r"\s&,;", "|,;", r"\s|,;'\"", r"\s@#/?"))

# Kept text is in a group, one for each form; a form without one keeps nothing before it.
_FORMS = (
    rf"(?<=://)({_USER}*?:){_USER}*+(?=@)",
    rf"(?<=\b(?:{'|'.join(_SCHEMES)}) )(?![=:]){_WORD}++",
    rf"({_KEY}(?<=\bauthorizations?){_SIGN})(?:{_LITERAL}|{_HEADER}++)",
    rf"({_KEY}(?<=password)\"? ?)(?:{_LITERAL}|{_DOUBLED})",
    rf"({_KEY}(?<=password){_SIGN}|{_NAMED_KEY}{_SIGN})(?:{_LITERAL}|{_PAIR}*+)",
)
GRAMMAR = "(?i)" + "|".join(_FORMS)
_KEPT = "".join(f"${group}" for group in range(1, 5))

# Plain words the grammar needs one of; most texts hold none of them, and a plain search
# costs a fraction of it.
_WORDS = (
    "://", "authorization", "bearer", "basic", "secret", "token", "credential",
    "passw", "pwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key",
)


def _worth_a_look(line: Column) -> Column:
    folded = F.lower(line)
    return reduce(Column.__or__, [F.contains(folded, F.lit(w)) for w in _WORDS])


def mask_secrets(col: Column | str) -> Column:
    """Fold white space, then replace everything credential-shaped by ``***``.

    One pass from left to right over all forms: the password of a user in an address,
    the whole value of an authorization header, what follows a bearer, basic or token
    scheme, the value of a key that names a credential, and every password spelling.
    What one form has taken no other looks at again.
    """
    line = F.trim(fold_space(col))
    # A text that holds the stand-in itself goes without it.
    taken = F.contains(line, F.lit(_DOUBLED))
    out = F.when(taken, line).otherwise(F.replace(line, F.lit("''"), F.lit(_DOUBLED)))
    out = F.regexp_replace(out, GRAMMAR, _KEPT + MASK)
    out = F.when(taken, out).otherwise(F.replace(out, F.lit(_DOUBLED), F.lit("''")))
    return F.when(_worth_a_look(line), out).otherwise(line)


def mask_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: mask_secrets(c) for c in columns})
