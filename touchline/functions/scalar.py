"""Column functions: tolerant casts, money, names, positions, seasons, rounding and hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Letters that decompose (NFKD, marks left out) to one character, and to what; and those that decompose to more with a letter or digit among them."""
    one, to, more = [], [], {}
    for c in map(chr, [*range(0x80, 0x250), *range(0x300, 0x530), *range(0x1D00, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]):
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d != c and len(d) == 1:
            one.append(c)
            to.append(d)
        elif len(d) > 1 and any(x.isascii() and x.isalnum() for x in d) and c.islower():
            more[c] = d.lower()
    return "".join(one), "".join(to), more


MARKED, PLAIN, LONGER = _decomposed()

#: Loose labels of positions and countries and what they stand for.
POSITION_ALIASES = {
    "goalkeeper": "gk", "keeper": "gk", "gk": "gk", "defender": "def", "center back": "cb", "centre back": "cb", "full back": "fb", "wing back": "wb",
    "midfielder": "mid", "attacking midfielder": "am", "defensive midfielder": "dm", "forward": "fwd", "striker": "fwd", "winger": "wing",
    "d": "cb", "m": "cm", "f": "st", "s": "st", "d m": "fb", "d s": "cb", "d m s": "fb", "d f": "cb", "f m": "am", "f m s": "w", "f s": "st",
    "df": "cb", "mf": "cm", "fw": "st", "df mf": "fb", "mf fw": "am", "fw mf": "w",
}
COUNTRY_ALIASES = {
    "eng": "england", "en": "england", "gb": "united kingdom", "uk": "united kingdom", "es": "spain", "esp": "spain", "de": "germany", "ger": "germany", "fr": "france", "fra": "france",
    "it": "italy", "ita": "italy", "nl": "netherlands", "ned": "netherlands", "por": "portugal", "pt": "portugal", "usa": "united states", "us": "united states", "u s a": "united states",
}


def number(value: Column) -> Column:
    """A double, or null where the text is none."""
    return F.trim(value.cast("string")).try_cast("double")


def money(value: Column) -> Column:
    """€1.5m, 300k, 2bn as a number; null on anything else."""
    parts = [F.regexp_extract(F.lower(F.trim(value)), r"^[€$£]?\s*([0-9]+(?:\.[0-9]+)?)\s*(bn|m|k|th\.?)?$", k) for k in (1, 2)]
    scale = F.when(parts[1] == "bn", 1e9).when(parts[1] == "m", 1e6).when(parts[1].isin("k", "th", "th."), 1e3).otherwise(1.0)
    return parts[0].try_cast("double") * scale


def folded(value: Column) -> Column:
    """Lower case without marks on letters, whether they stand alone or are part of the letter; letters that don't decompose stay."""
    out = F.translate(F.regexp_replace(F.lower(value), r"\p{M}+", ""), MARKED, PLAIN)
    for a, b in LONGER.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(out)


def name_key(value: Column) -> Column:
    """A name for matching: folded, & as and, anything but letters and digits as one space; null is empty."""
    text = F.replace(folded(F.coalesce(value, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def renamed(key: Column, aliases: dict[str, str]) -> Column:
    """What a key stands for; others stay."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, key), key)


def position_group(value: Column) -> Column:
    """A loose position label as a group; unknown labels stay, as keys."""
    return renamed(name_key(value), POSITION_ALIASES)


def country_key(value: Column) -> Column:
    return renamed(name_key(value), COUNTRY_ALIASES)


def composite_key(name: Column, born: Column, nation: Column) -> Column:
    """name|year|country, with NA for what is missing."""
    return F.concat_ws("|", name_key(name), F.coalesce(born.cast("string"), F.lit("NA")), F.when(nation.isNull(), "NA").otherwise(country_key(nation)))


def season_code(date: Column, first_month: int = 7) -> Column:
    """2023-08-01 as 2324: seasons begin in first_month."""
    y = F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)
    return F.concat(F.lpad((y % 100).cast("string"), 2, "0"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def day_first(value: Column) -> Column:
    """A date of the forms dd/mm/yyyy, dd/mm/yy or yyyy-mm-dd; null on anything else."""
    return F.coalesce(*[F.try_to_date(value, f) for f in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")])


def id_text(value: Column) -> Column:
    """An id as text: whole numbers without a fraction, 12.0 as 12."""
    n = value.cast("string").try_cast("double")
    return F.when(n == F.floor(n), F.floor(n).cast("long").cast("string")).otherwise(value.cast("string"))


def confidence(minutes: Column, low: float = 450, high: float = 1800) -> Column:
    return F.when(minutes >= high, "HIGH").when(minutes >= low, "MEDIUM").otherwise("LOW")


def age_band(age: Column, size: int = 4) -> Column:
    return (F.floor(age / size) * size).cast("int")


def membership_hash(keys: Column) -> Column:
    """16 hex digits of the hash of sorted keys, for one group in an aggregation."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.collect_set(keys)), "\n"), 256), 1, 16)


def csv_safe(value: Column) -> Column:
    """Text that no spreadsheet takes for a formula: a quote goes before = + - @ tab and return."""
    return F.when(value.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
