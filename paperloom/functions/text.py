"""Text functions as Column -> Column expressions, evaluated in the JVM.

Patterns follow Python's Unicode-aware classes, hence (?U) where \\w, \\b, \\d or \\s occur.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The patterns.
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?:(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,5}\d{2,4})"
EIGHT_DIGITS = r"(?U)\d(?:\D*\d){7}"
MONEY = r"(?U)(?<!\w)(?:[A-Z]{0,3}\s*)?(?:\d{1,3}(?:[ ,.\x{202f}]\d{3})*|\d+)(?:[.,]\d{2})?(?:\s*(?:EUR|USD|GBP|CHF|€|\$|£))?(?!\w)"
PERCENT = r"(?U)\b\d{1,2}(?:[.,]\d{1,2})?\s*%"
DATE = r"(?iU)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4})\b"
INVOICE_ID = r"(?iU)\b[A-Z0-9][A-Z0-9./_-]{3,}\b"
STREET = r"(?iU)\b(lane|ln|street|st|avenue|ave|road|rd|drive|dr|blvd|boulevard|court|ct|place|pl|way|circle|cir)\b"
POSTAL = r"(?iU)^(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}|\d{5}(?:-\d{4})?|[A-Z]\d[A-Z]\s*\d[A-Z]\d|\d{4,5})$"
NUMBER_KEYWORD = r"(?:invoice\s*(?:no|number|#)?|facture\s*(?:n|no|numero)?|factura\s*(?:n|no|numero|n°)?)\s*[:#-]?\s*([a-z0-9./_-]{3,})"
NUMBER_NO = r"\bno\.?\s*([a-z0-9./_-]{3,})"
TABLE_HEADER = ("designation", "date debut", "date fin", "quantite", "puht", "remise", "tva", "base tva", "montant tva", "total ht")
SUMMARY_NOISE = ("observations", "abonnement", "augmentera", "topnet")
PAYMENT_NOISE = ("virement", "banque", "reglement", "paiement", "piece", "cheque", "attijari")
PRODUCT_NOISE = ("total", "tva", "remise", "montant", "base", "taux", "reglement")
#: Letters with marks that Western texts use, and what stays of them in ASCII.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def let(value: Column, f) -> Column:
    """f(value) with value computed once per row, also within branches and lambdas, where Spark shares no common expressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def filled(value: Column) -> Column:
    """A text, or null where it is empty."""
    return let(value, lambda v: F.when(v != "", v))


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def any_in(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


#: White space as Unicode defines it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_ocr_text(text: Column) -> Column:
    """ASCII only, single blanks, no one-character words but digits.

    Patterns alone, no lambda, so that a projection which uses it several times evaluates it once.
    """
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    single = F.trim(F.regexp_replace(ascii_only, r"[\s\x0b\x1c-\x1f]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(single, "(^| )[^0-9 ](?= |$)", "$1"), " +", " "))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def normalize_text(text: Column, exact: bool = False) -> Column:
    """Lower-case ASCII of a text with only [a-z0-9%@./,_#:$+- ] kept and single blanks.

    Marked Western letters are replaced in the JVM. exact=True sends texts with any other character
    through full compatibility decomposition in Arrow batches; ASCII texts never leave the JVM.
    """
    other = _compatible(text) if exact else F.regexp_replace(F.translate(text, MARKED, PLAIN), r"[^\x00-\x7F]", "")
    plain = F.when(F.length(text) == F.octet_length(text), text).otherwise(other)
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9%@./,_#:$+\-]+", " "))


def first(text: Column, pattern: str) -> Column:
    """First match, or null."""
    return filled(F.regexp_extract(text, pattern, 0))


def every(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.trim(m))


def last(text: Column, pattern: str) -> Column:
    return F.try_element_at(every(text, pattern), F.lit(-1))


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\D", ""))


def head(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def find_email(text: Column, repair: bool = True) -> Column:
    """First address; else the first after the usual misreadings are mended."""
    mend = lambda c: F.replace(c, F.lit(".con"), F.lit(".com"))
    lead = lambda c: let(c, lambda v: F.when(v.startswith("nfo@"), F.concat(F.lit("i"), v)).otherwise(v)) if repair else c
    squeezed = F.replace(F.replace(mend(F.regexp_replace(text, r"(?U)\s+", "")), F.lit("sitecom"), F.lit("site.com")), F.lit("gmailcom"), F.lit("gmail.com"))
    found = let(first(text, EMAIL), lambda v: F.when(v.isNotNull(), mend(lead(v)) if repair else v).otherwise(first(lead(squeezed), EMAIL)))
    return F.when(text.contains("@"), found)


def find_phone(text: Column, check_nif: bool = True, norm: Column | None = None) -> Column:
    """First number of eight digits and more; norm is the text's normal form, where it is at hand."""
    found = F.when(text.rlike(EIGHT_DIGITS), head(F.filter(every(text, PHONE), lambda c: digits(c) >= 8)))
    if not check_nif:
        return found
    norm = normalize_text(text) if norm is None else norm
    return let(found, lambda v: F.when(v.isNotNull() & ~norm.contains("nif"), v))


def find_phone_noise(text: Column) -> Column:
    """The OCR track's phone: no noise words, no bare runs of over ten digits."""
    noisy = lambda norm: any_in(norm, ("facture", "invoice", "code ", "reference", "ref ", *PAYMENT_NOISE))
    found = head(F.filter(every(text, PHONE), lambda c: (digits(c) >= 8) & (c.rlike(r"[+\-(). ]") | (digits(c) <= 10))))
    return F.when(text.rlike(EIGHT_DIGITS), let(found, lambda v: F.when(v.isNotNull() & ~let(normalize_text(text), noisy), v)))


def is_postal_code(token: Column) -> Column:
    return F.trim(token).rlike(POSTAL)


def looks_like_phone(text: Column) -> Column:
    t = F.trim(text)
    return t.startswith("+") | ((digits(t) >= 8) & t.rlike(r"(?U)^[\d().+\-\s]+$"))


def is_street_line(text: Column) -> Column:
    return text.rlike(STREET)


def is_header_line(text: Column) -> Column:
    """Over 80 % of the letters upper case, and two words or more."""
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (letters > 0) & (upper > letters * 0.8) & (F.size(F.split(F.trim(text), r"(?U)\s+")) >= 2)


def invoice_id_candidates(text: Column) -> Column:
    words = ("code", "facture", "invoice", "numero", "number", "ref")
    return F.filter(every(text, INVOICE_ID), lambda t: (digits(t) >= 4) & ~F.lower(t).isin(*words))


def invoice_number(text: Column, basic: bool = False, norm: Column | None = None) -> Column:
    """Number after a keyword (three digits or more), else a token: mixed ones before bare digits.

    norm is the text's normal form, where it is at hand. All of them hold digits, so other texts are passed by.
    """
    if norm is None:
        return let(normalize_text(text), lambda n: invoice_number(text, basic, n))
    ok = (lambda t: F.lit(True)) if basic else (lambda t: ~looks_like_phone(t) & ~is_postal_code(t))
    keyed = [let(F.regexp_extract(norm, p, 1), lambda k: F.when((digits(k) >= 3) & ok(k), k)) for p in (NUMBER_KEYWORD, NUMBER_NO)]
    tokens = F.regexp_extract_all(text, F.lit(r"(?iU)\b[A-Z0-9./_-]{4,}\b"), F.lit(0))
    mixed = lambda every: head(F.filter(every, lambda t: t.rlike("[A-Za-z]") & has_digit(t) & ok(t)))
    bare = lambda every: head(F.filter(every, lambda t: (digits(t) >= 4) & ok(t)))
    value = F.coalesce(*keyed, let(tokens, lambda e: bare(e) if basic else F.coalesce(mixed(e), bare(e))))
    return F.when(has_digit(text) if basic else has_digit(text) & ~norm.contains("nif") & ~is_street_line(text), value)


def clean_invoice_number(text: Column) -> Column:
    spaced = F.regexp_replace(F.trim(text), r"\s*([/._-])\s*", " $1 ")
    return F.regexp_replace(F.regexp_replace(spaced, r"\s+", " "), "^[ \\-:#]+|[ \\-:#]+$", "")


def contains_anchor(norm: Column, anchor: str) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {anchor} ")


def strip_anchor_prefix(text: Column, anchors) -> Column:
    """What follows the first colon or dash, if an anchor stands before it."""
    parts = F.split(text, "[:\\-]", 2)
    return F.when((F.size(parts) == 2) & any_in(normalize_text(parts[0]), anchors), F.trim(F.try_element_at(parts, F.lit(2)))).otherwise(text)


def looks_like_table_header(norm: Column) -> Column:
    return reduce(lambda a, b: a + b, (norm.contains(t).cast("int") for t in TABLE_HEADER)) >= 3


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, "^[ :\\-]+|[ :\\-]+$", "")


def regex_or_strip(text: Column, pattern: str | None) -> Column:
    return F.trim(first(text, pattern)) if pattern else F.nullif(strip_ends(text), F.lit(""))


def strip_product_noise(text: Column) -> Column:
    cut = strip_ends(F.split(text, DATE, 2)[0])
    runs = F.regexp_replace(F.regexp_replace(cut, r"\s{2,}", " "), r"(?U)(?:\b\d+[.,]?\d*\b\s*){2,}$", "")
    return F.nullif(strip_ends(runs), F.lit(""))


def strip_trailing_price(text: Column) -> Column:
    cut = F.trim(F.regexp_replace(text, r"\s+(?:[$€£]?\d[\d,]*(?:\.\d{2})?)\s*$", ""))
    return F.when(cut == "", F.trim(text)).otherwise(cut)


def infer_currency(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(up.contains("€") | up.contains("EUR"), "EUR").when(up.contains("$") | up.contains("USD"), "USD").when(up.contains("£") | up.contains("GBP"), "GBP").otherwise("")


def parse_date(text: Column) -> Column:
    """Nine formats, day first; two-digit years from 69 on are of the last century."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    whole = [F.try_to_date(t, f) for f in ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d")]
    short = [F.try_to_date(t, f) for f in ("d/M/yy", "d-M-yy")]
    short = [F.when(F.year(c) >= 2069, F.add_months(c, -1200)).otherwise(c) for c in short]
    named = [F.try_to_date(t, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")]
    return F.coalesce(*whole, *short, *named)


def parse_amount_decimal(text: Column) -> Column:
    """`123,45` has a decimal comma; else commas are dropped. Codes such as EUR make it null."""
    t = F.regexp_replace(text, r"(?U)[€$£\s]", "")
    t = F.when(t.rlike(r"^\d+,\d{2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("decimal(14,2)"))


def parse_amount_float(text: Column) -> Column:
    """Letters and signs are dropped; of comma and point the later one is the decimal mark."""
    t = F.regexp_replace(text, r"(?U)[A-Za-z€$£\s]", "")
    comma, point = F.length(F.substring_index(t, ",", -1)), F.length(F.substring_index(t, ".", -1))
    both = t.contains(",") & t.contains(".")
    t = F.when(both & (comma < point), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))


def parse_amount_legacy(text: Column) -> Column:
    point = lambda t: F.when(t.rlike(r"^\d+,\d{2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    number = let(F.regexp_replace(text, r"(?U)\s+", ""), point)
    return let(number, lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast("double")))


#: Words whose presence counts, by document class.
KEYWORDS = {
    "invoice_kw": ("invoice", "total", "amount", "due date", "bill to", "subtotal", "tax", "payment"),
    "email_kw": ("from:", "to:", "subject:", "sent:", "dear", "regards", "sincerely", "cc:"),
    "resume_kw": ("experience", "education", "skills", "objective", "references", "university", "degree", "employment"),
    "sci_kw": ("abstract", "introduction", "conclusion", "references", "methodology", "results", "figure", "table", "et al"),
}


def keyword_counts(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {name: reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words)) for name, words in KEYWORDS.items()}


def text_meta_features(text: Column) -> dict[str, Column]:
    """Fifteen features of a text."""
    clean = clean_ocr_text(text)
    # words are parted by one blank and lines by one newline, so lengths tell how many there are
    letters = F.length(F.replace(clean, F.lit(" "), F.lit("")))
    n_words = F.length(clean) - letters + (clean != "").cast("int")
    stripped = F.btrim(text, F.lit(BLANKS))
    in_lines = F.length(F.replace(stripped, F.lit("\n"), F.lit("")))
    n_lines = F.length(stripped) - in_lines + 1
    n = F.length(text)
    share = lambda p: F.regexp_count(text, F.lit(p)) / F.greatest(n, F.lit(1))
    return {
        "n_chars": n.cast("long"),
        "n_words": n_words.cast("long"),
        "n_lines": n_lines.cast("long"),
        "avg_word_len": letters / F.greatest(n_words, F.lit(1)),
        "avg_line_len": in_lines / n_lines,
        "digit_ratio": share(r"\p{Nd}"),
        "upper_ratio": share(r"\p{Lu}"),
        "special_ratio": share(r"[^\p{L}\p{N}\p{M}\s]"),
        **keyword_counts(text),
        "has_at": text.contains("@").cast("double"),
        "has_currency": text.rlike("[$€£]").cast("double"),
        "has_date": text.rlike(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b").cast("double"),
    }
