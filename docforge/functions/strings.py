"""Text, identifiers and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import yymmdd

#: Suffixes of company names.
COMPANY_SUFFIXES = r"\b(?:sendirian\s+berhad|sdn\.?\s*bhd\.?|berhad|bhd\.?|sdn\.?|s/b|enterprise|ent\.?)(?:\b|(?<=\.))\.?"
#: Other names of currencies.
CURRENCIES = {
    "MYR": ["RM", "RINGGIT", "RINGGIT MALAYSIA"], "USD": ["US$"], "GBP": ["£"], "EUR": ["€"], "SGD": ["S$"],
    "JPY": ["JP¥", "¥"], "CNY": ["RMB"], "AUD": ["A$"],
}
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def company_name(text: Column, entities: bool = True) -> Column:
    """Entities resolved (unless told otherwise), lower case, suffixes and punctuation dropped, blanks collapsed."""
    t = F.regexp_replace(F.lower(unescape(text) if entities else text), COMPANY_SUFFIXES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"\s+", " "))


def currency(text: Column) -> Column:
    t = F.upper(F.trim(text))
    out = t
    for code, names in CURRENCIES.items():
        out = F.when(t.isin(names), F.lit(code)).otherwise(out)
    return F.when(t != "", out)


def domain(url: Column, suffixes: tuple[str, ...] = ("com.my", "co.uk", "com.sg", "com.au")) -> Column:
    """The registrable domain: the last two labels of the host, three under the listed suffixes of two."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(host != "", F.when(two.isin(list(suffixes)), three).otherwise(two))


def clean_key(text: Column) -> Column:
    t = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[_\-/]+", " "), r"[^\w ]+|\s+", " "))


def search_query(value: Column, keys: Column) -> Column:
    """The value in quotes if it has blanks, and the cleaned keys with their values."""
    quoted = F.when(F.contains(value, F.lit(" ")), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    return F.concat_ws(" ", quoted, F.array_join(F.transform(keys, lambda k: F.concat_ws(" ", clean_key(k["key"]), k["value"])), " "))


def match_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w]", " "), r"\s+", " "))


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | text.rlike(r"^[\x{FFFD}\s]*\x{FFFD}[\x{FFFD}\s]*$")


def tools_differ(a: Column, b: Column) -> Column:
    """Neither name contains the other; a word processor's document distilled by a PDF tool is no mismatch."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    exempt = (F.contains(x, F.lit("word")) & F.contains(y, F.lit("acrobat"))) | (F.contains(x, F.lit("acrobat")) & F.contains(y, F.lit("word")))
    return (x != "") & (y != "") & ~F.contains(x, y) & ~F.contains(y, x) & ~exempt


def should_check_text(text: Column, least: int = 3) -> Column:
    """Three characters at least, with a letter of A to Z or two groups of digits apart."""
    plain = F.trim(text)
    return F.coalesce((F.length(plain) >= least) & (plain.rlike("[A-Za-z]") | plain.rlike(r"\d\s+\d")), F.lit(False))


def symbols_only(text: Column) -> Column:
    return text.rlike(r"^[\p{P}\p{S}\p{Z}\s]*$")


def glyph_class(char: Column) -> Column:
    """Letters with descenders are uncertain, punctuation is excluded."""
    return F.when(symbols_only(char), "excluded").when(char.isin(list("gjpqyJQ")), "uncertain").otherwise("reliable")


def font_name(text: Column) -> Column:
    return F.regexp_replace(text, r"^[^+]*\+", "")


def uri(text: Column) -> Column:
    """Search addresses keep their q parameter only."""
    q = F.regexp_extract(text, r"[?&]q=([^&#]*)", 1)
    return F.when(F.contains(text, F.lit("/search")) & (q != ""), F.concat(F.regexp_extract(text, r"^([^?#]*)", 1), F.lit("?q="), q)).otherwise(text)


def common_name(issuer: Column) -> Column:
    cn = F.trim(F.regexp_extract(issuer, r"CN\s*=\s*([^,]+)", 1))
    return F.when(cn != "", cn)


def first_hit(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The class of the first listed part that the text contains."""
    out, low = F.lit(default), F.lower(text)
    for part, label in reversed(rules):
        out = F.when(F.contains(low, F.lit(part)), F.lit(label)).otherwise(out)
    return out


def phone(text: Column, country: str = "60") -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    national = F.regexp_replace(digits, f"^(?:00)?{country}|^0", "")
    return F.when(F.length(national).between(7, 11), F.concat(F.lit(f"+{country}-"), national))


def address(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", ", "), r"\s+", " "), r"(?:\s*,)+\s*", ", "), F.lit(", "))


def postcode(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(1, 5), F.lpad(digits, 5, "0"))


def isin(line: Column) -> Column:
    return F.struct(
        F.regexp_extract(line, r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b", 1).alias("isin"),
        F.trim(F.regexp_extract(line, r"^(.*?)\s*\b[A-Z]{2}[A-Z0-9]{9}[0-9]\b", 1)).alias("name"),
        F.regexp_extract(line, r"\b[A-Z]{2}[A-Z]([0-9]{4})[A-Z0-9]{4}[0-9]\b", 1).alias("stock_code"),
    )


def mykad_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[- ]", "")


def mykad_fault(text: Column) -> Column:
    """Null for a well-formed identity number of twelve digits, else what is wrong with it.

    Fixed values: birthplace codes 01-16, 21-59 and 82.
    """
    d = mykad_digits(text)
    place = F.substring(d, 7, 2).try_cast("int")
    return (
        F.when(~d.rlike("^[0-9]{12}$"), "format")
        .when(yymmdd(F.substring(d, 1, 6)).isNull(), "date")
        .when(~(place.between(1, 16) | place.between(21, 59) | (place == 82)), "place")
    )


def xmp_history(text: Column) -> Column:
    """array<struct> of the items of a flattened history: action, software_agent, when, parameters, instance_id."""
    part = lambda x, name: F.nullif(F.trim(F.regexp_extract(x, rf"(?i)\b{name}\s*[=:]\s*([^,;}}]+)", 1)), F.lit(""))
    items = F.filter(F.split(text, r"[{}]|\r?\n"), lambda x: x.rlike(r"(?i)\baction\s*[=:]"))
    return F.transform(items, lambda x: F.struct(part(x, "action").alias("action"), part(x, "softwareAgent").alias("software_agent"), part(x, "when").alias("when"), part(x, "parameters").alias("parameters"), part(x, "instanceID").alias("instance_id")))
