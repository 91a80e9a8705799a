"""Scalar functions over text, amounts and values, as column expressions that stay inside the JVM.

Patterns are Java regular expressions; `(?iuU)` makes them fold case and classes by Unicode, `(?d)` lets `.` and `$` know
only line feeds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Italian number words.
NUMBER_WORDS = {"due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use() mentions it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def is_blank(c: Column | str) -> Column:
    """Null, only white space, "0" or "false"."""
    c = F.trim(F.regexp_replace(_col(c).cast("string"), r"(?U)\s+", " "))
    return c.isNull() | F.lower(c).isin("", "0", "false", "[]", "{}")


def clean_string(c: Column | str) -> Column:
    """White space collapsed, ends trimmed, trailing commas, semicolons and colons dropped."""
    one = F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))
    return F.regexp_replace(one, r"[,;:\s]+$", "")


def clean_text(c: Column | str) -> Column:
    """Typographic and mis-decoded characters mapped, bold marks dropped, white space collapsed; empty gives null."""
    plain = F.translate(_col(c), "\u2019\u2018\u201c\u201d\u2013\u2014\u00c7\u00a0", "''\"\"--\u20ac ")
    return F.nullif(F.trim(F.regexp_replace(F.replace(plain, F.lit("**"), F.lit("")), r"(?U)\s+", " ")), F.lit(""))


def decode_glyphs(c: Column | str) -> Column:
    """`(cid:N)` escapes as the characters they number."""
    parts = F.split(_col(c), r"\(cid:")
    tail = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.when(p.rlike(r"^\d+\)"), F.concat(F.char(F.regexp_extract(p, r"^(\d+)\)", 1).cast("int")), F.regexp_replace(p, r"^\d+\)", ""))).otherwise(F.concat(F.lit("(cid:"), p)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))


def amount_text(value: Column) -> Column:
    """A decimal in Italian notation: 1.234,56."""
    return F.translate(F.format_number(value, 2), ",.", ".,")


def normalize_amount(c: Column | str) -> Column:
    """Canonical `€ 1.234,56` of an amount in Italian or English notation; what isn't a number comes back as it is."""
    raw = F.trim(F.replace(F.replace(F.trim(_col(c)), F.lit("EUR"), F.lit("")), F.lit("€"), F.lit("")))

    def read(x: Column) -> Column:
        plain = (
            F.when(x.rlike(r"\d{1,3}(\.\d{3})+,\d{2}"), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(x.rlike(r"\d{1,3}(,\d{3})+\.\d{2}"), F.replace(x, F.lit(","), F.lit("")))
            .otherwise(F.replace(x, F.lit(","), F.lit(".")))
        )
        number = F.regexp_replace(plain, r"[^\d.]", "").try_cast("decimal(20,2)")
        return F.coalesce(F.concat(F.lit("€ "), amount_text(number)), x)

    return F.when(F.trim(_col(c)) != "", let(raw, read))


def parse_amount(c: Column | str, dot3_thousands: bool = False) -> Column:
    """DECIMAL(18,2) of an amount; not positive or not a number gives null. dot3_thousands reads 1.234 as 1234."""
    s = F.regexp_replace(F.trim(F.translate(_col(c), "€Ç", "")), r"(?i)^euro?\b\s*|\s+", "")
    s = F.regexp_replace(s, r"^\.+|[.,;:]+$", "")

    def read(x: Column) -> Column:
        no_dots = F.replace(x, F.lit("."), F.lit(""))
        thousands = r"\..*\." + (r"|^\d{1,3}\.\d{3}$" if dot3_thousands else "")
        plain = F.when(x.rlike(r"^\d{1,3}(?:,\d{3})+\.\d{1,2}$"), F.replace(x, F.lit(","), F.lit(""))).when(x.rlike(r"\..*,|,.*\."), F.replace(no_dots, F.lit(","), F.lit("."))).when(x.contains(","), F.replace(x, F.lit(","), F.lit("."))).when(x.rlike(thousands), no_dots).otherwise(x)
        return let(plain.try_cast("decimal(18,2)"), lambda v: F.when(v > 0, v))

    return let(s, read)


def parse_numeric(c: Column | str) -> Column:
    """A double of a value with currency or percent signs in Italian notation."""
    s = F.regexp_replace(_col(c).cast("string"), r"[€$%\s]", "")
    s = F.when(s.contains(",") & s.contains("."), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return s.try_cast("double")


def find_amounts(c: Column | str) -> Column:
    """All amounts above 1 that follow or precede a currency sign or word, in order."""
    either = r"(?i)(?:€|Ç|\beuro\b)\s*\.?\s*(\d[\d.,]*)|(\d[\d.,]*)\s*(?:€|\beuro\b)"
    after, before = (F.regexp_extract_all(_col(c), F.lit(either), k) for k in (1, 2))
    found = F.zip_with(after, before, lambda x, y: F.when(x != "", x).otherwise(y))
    return F.filter(F.transform(found, lambda x: parse_amount(x)), lambda v: v > 1)


def format_amount(value: Column | str) -> Column:
    """`EUR 1.234,56`; null if not positive."""
    v = _col(value)
    return F.when(v > 0, F.concat(F.lit("EUR "), amount_text(v)))


def number_word(c: Column | str) -> Column:
    """An Italian number word (due to sei), else all digits of the text as a number."""
    words = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(words, F.lower(F.trim(_col(c)))), F.regexp_replace(_col(c), r"\D", "").try_cast("int"))


def group_count(pattern: str) -> int:
    """Capturing groups of a Java pattern."""
    return len(re.findall(r"(?<!\\)\((?!\?)", re.sub(r"\[(?:\\.|[^\]\\])*\]", "", pattern)))


def filled(template: str, *values: Column | str) -> Column:
    """A template whose %s and %d are filled with values, as format_string() does; null is written as such."""
    texts = [F.lit(x.replace("%%", "%")) for x in re.split("%[sd]", template)]
    filling = [F.coalesce(_col(v).cast("string"), F.lit("null")) for v in values]
    return F.concat(texts[0], *[x for pair in zip(filling, texts[1:]) for x in pair])


def first_match(c: Column | str, patterns: list[str], read=None) -> Column:
    """Cleaned first hit of the first pattern that has one (group 1 if it has groups). read(column) makes a value of each
    pattern's hit, or null to veto it, in which case the next pattern is tried."""
    tries = []
    for p in patterns:
        hit = F.regexp_replace(F.regexp_extract(_col(c), f"(?iumd){p}", min(1, group_count(p))), r"(?U)\s+", " ")
        hit = F.regexp_replace(hit, r"^ |[,;: ]+$", "")
        tries.append(let(hit, lambda x: F.when(x != "", x if read is None else read(x))))
    return F.coalesce(*tries)


def all_matches(c: Column | str, patterns: list[str]) -> Column:
    """Distinct cleaned hits of all patterns, pattern by pattern, in order."""
    found = F.concat(*[F.regexp_extract_all(_col(c), F.lit(f"(?iumd){p}"), min(1, group_count(p))) for p in patterns])
    return F.array_distinct(F.filter(F.transform(found, clean_string), lambda x: x != ""))


def extract_int(c: Column | str, patterns: list[str]) -> Column:
    return F.regexp_replace(first_match(c, patterns), r"\D", "").try_cast("int")


def value_context(text: Column | str, value: Column | str, window: int = 300) -> Column:
    """Text around a value: where it stands, else around its first word of more than 3 letters that occurs, else its first number of 3 or more digits."""
    t, v = _col(text), F.trim(_col(value))
    low = F.lower(t)
    words = F.filter(F.split(v, r"\s+"), lambda w: (F.length(w) > 3) & (F.instr(low, F.lower(w)) > 0))
    numbers = F.filter(F.regexp_extract_all(v, F.lit(r"(\d{3,})"), 1), lambda w: F.instr(t, w) > 0)
    key = F.coalesce(F.when(F.instr(low, F.lower(v)) > 0, v), F.get(words, F.lit(0)), F.get(numbers, F.lit(0)))
    at = F.instr(low, F.lower(key))
    start = F.greatest(F.lit(1), at - window)
    cut = F.trim(F.substring(t, start, at + F.length(key) + window - start))
    return F.when((F.length(v) < 2) | t.isNull() | key.isNull(), F.lit("")).otherwise(cut)


def prefix_suffix(text: Column | str, value: Column | str, size: int = 150) -> Column:
    """struct(prefix, suffix, section): what stands before and after a value, and the last heading line above it."""
    t, v = _col(text), _col(value)
    at = F.instr(F.lower(t), F.lower(v))
    start = F.greatest(F.lit(1), at - size)
    above = F.substring(t, F.greatest(F.lit(1), at - 2000), F.least(at - 1, F.lit(2000)))
    heading = F.regexp_extract_all(above, F.lit(r"(?m)^\s*((?:ART|Art|SEZIONE|CAPO|[0-9]+\.)[^\n]{3,100})$"), 1)
    return F.when(at > 0, F.struct(F.substring(t, start, at - start).alias("prefix"), F.substring(t, at + F.length(v), F.lit(size)).alias("suffix"), F.try_element_at(heading, F.lit(-1)).alias("section")))


def value_type(c: Column | str) -> Column:
    """numeric, date or text."""
    return F.when(_col(c).rlike(r"^\s*\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"), "date").when(parse_numeric(c).isNotNull(), "numeric").otherwise("text")


def compare_key(c: Column | str) -> Column:
    """Lower case, white space collapsed, trailing punctuation off."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " ")), r"[.,;:]+$", "")


def category_code(c: Column | str) -> Column:
    """E20 as E.20."""
    return F.regexp_replace(F.upper(F.trim(_col(c))), r"^(IA|IB|[ESDG])(\d+)$", "$1.$2")


def match_positions(c: Column | str, literal: Column | str) -> Column:
    """1-based positions of a literal, overlapping ones included."""
    t, v = _col(c), _col(literal)
    last = F.length(t) - F.length(v) + 1
    return F.when((F.length(v) > 0) & (last > 0), F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.length(v)) == v)).otherwise(F.array().cast("array<int>"))


def section_grab(c: Column | str, keyword: Column | str, size: int = 2000) -> Column:
    """The text from 100 characters before a keyword's first place, size characters long; empty if absent."""
    at = F.instr(F.lower(_col(c)), F.lower(_col(keyword)))
    return F.when(at > 0, F.substring(_col(c), F.greatest(F.lit(1), at - 100), F.lit(size))).otherwise("")


def generalize(c: Column | str) -> Column:
    """Literal text as a pattern: specials escaped, then digits, white space, dashes and colons made general."""
    s = F.regexp_replace(_col(c), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    s = F.regexp_replace(s, r"\d+", r"\\d+")
    s = F.regexp_replace(s, r"[\-–—]", "[-–—]")
    s = F.regexp_replace(s, r"\s*:\s*", r"[:\\s]+")
    return F.regexp_replace(s, r"(?U)\s+", r"\\s+")


def register(spark: SparkSession) -> list[str]:
    """The scalar pack as SQL functions without Python: CREATE TEMPORARY FUNCTION ... RETURN."""
    pack = {
        "clean_string(s STRING)": r"STRING RETURN regexp_replace(trim(regexp_replace(s, '(?U)\\s+', ' ')), '[,;:\\s]+$', '')",
        "compare_key(s STRING)": r"STRING RETURN regexp_replace(trim(regexp_replace(lower(s), '(?U)\\s+', ' ')), '[.,;:]+$', '')",
        "category_code(s STRING)": r"STRING RETURN regexp_replace(upper(trim(s)), '^(IA|IB|[ESDG])(\\d+)$', '$1.$2')",
        "format_amount(v DECIMAL(18,2))": "STRING RETURN CASE WHEN v > 0 THEN concat('EUR ', translate(format_number(v, 2), ',.', '.,')) END",
        "content_hash(s STRING)": "STRING RETURN sha2(s, 256)",
    }
    for name, body in pack.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {body}")
    return [n.split("(")[0] for n in pack]
