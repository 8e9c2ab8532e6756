"""Text expressions: cleaning, tokens, addresses, numbers and their formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"
#: Other names of countries in locations.
COUNTRY_NAMES = {
    "USA": "United States",
    "US": "United States",
    "UK": "United Kingdom",
    "United Kingdom of Great Britain and Northern Ireland": "United Kingdom",
    "The Netherlands": "Netherlands",
    "Russian Federation": "Russia",
}
#: Common English words that say nothing of a text.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does"
    " doing don down during each few for from further had has have having he her here hers him his how i if in into is it its just me more"
    " most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their them then"
    " there these they this those through to too under until up very was we were what when where which while who whom why will with you your"
).split()


def preprocess(text: Column) -> Column:
    """Lower case, runs of white space as one blank, numbers of one or two digits removed; null becomes empty."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))
    return F.regexp_replace(plain, r"(?<![a-z0-9_])[0-9]{1,2}(?![a-z0-9_])", "")


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of two or more ASCII letters in order, stop words left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![a-z0-9_])[a-z]{2,}(?![a-z0-9_])"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: ~F.array_contains(stop, w)) if stop_words else words


def ngrams(words: Column, sizes: list[int]) -> Column:
    """All n-grams of the given sizes, joined by blanks."""
    # the one-element array binds the words, so that they are not cut again for every n-gram
    bound = F.transform(F.array(words), lambda ws: F.concat(*[_ngrams(ws, n) for n in sizes]))
    return F.get(bound, F.lit(0))


def _ngrams(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    made = F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def clean(text: Column) -> Column:
    """White space as one blank, trimmed, without marks other than comma, full stop and hyphen."""
    plain = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}_ ,.\-]", "")


def split_rows(df: DataFrame, column: str) -> DataFrame:
    """A row for each part between commas or slashes; a value of one part or none, and null, keep their row."""
    parts = F.filter(F.transform(F.split(column, "[,/]"), lambda p: F.trim(p)), lambda p: p != "")
    several = F.when(F.size(parts) > 1, parts).otherwise(F.array(F.col(column)))
    return df.withColumn(column, F.explode(several))


def company_slug(url: Column, showcase: bool = True) -> Column:
    """The last path element of a company's address; null for other addresses. ``showcase`` also takes showcase pages and a final slash."""
    pattern = r"/(?:company|showcase)/([^/]+)/?$" if showcase else r"/company/([^/]+)$"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def any_route_id(url: Column) -> Column:
    """The identifier in any of the routes for organisations, decoded."""
    path = F.regexp_extract(url, r"/(?:company-beta|company|showcase|school|organization-guest/company)/([^/?#]+)", 1)
    query = F.regexp_extract(url, r"/edu/[^?]*\?(?:[^#]*&)?id=([^&#]+)", 1)
    return F.try_url_decode(F.coalesce(F.nullif(path, F.lit("")), F.nullif(query, F.lit(""))))


def country_of(location: Column, names: dict[str, str] = COUNTRY_NAMES) -> Column:
    """The last part of a location between commas, by its usual name; empty for null or empty."""
    last = F.trim(F.element_at(F.split(F.coalesce(location, F.lit("")), ","), -1))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, last), last)


def slug(name: Column) -> Column:
    """Lower case, trimmed, white space as hyphens."""
    return F.regexp_replace(F.trim(F.lower(name)), SPACE, "-")


def to_number(text: Column) -> Column:
    """A number typed with blanks or thousands commas; null where it is none."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


#: What spreadsheets write where there is nothing.
SENTINELS = ["#N/A", "#ERROR!", ""]


def without_sentinels(text: Column) -> Column:
    """Null where the text is one of a spreadsheet's marks for nothing."""
    return F.when(~F.trim(text).isin(SENTINELS), text)


def to_flag(text: Column) -> Column:
    """True for true, t, 1 or yes in any case, False otherwise."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "t", "1", "yes"), F.lit(False))


def to_share(value: Column) -> Column:
    """A share in [0, 1] from a fraction, a percentage above 1, or a text with a percent sign or decimal comma."""
    plain = F.replace(F.trim(value.cast("string")), F.lit(","), F.lit("."))
    percent = F.endswith(plain, F.lit("%"))
    number = F.regexp_replace(plain, "%$", "").try_cast("double")
    return F.when(percent, number / 100).when(number > 1, number / 100).otherwise(number)


def year_of(text: Column, low: int = 1700, high: int = 2100) -> Column:
    """The year of a date, or the first four digits that make one in the range."""
    raw = F.trim(text)
    dated = F.year(F.try_to_timestamp(F.regexp_extract(raw, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")))
    found = F.nullif(F.regexp_extract(raw, r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1), F.lit("")).try_cast("int")
    year = F.coalesce(dated, found)
    return F.when(year.between(low, high), year)


def range_midpoint(text: Column) -> Column:
    """Middle of a range "a-b" or "a to b", or the number of "n+" or "n"; thousands commas and long dashes allowed."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), ",", ""), "[‐-―]", "-")
    low = F.nullif(F.regexp_extract(plain, r"^\s*([0-9]+)\s*(?:-|to)\s*[0-9]+", 1), F.lit("")).try_cast("double")
    high = F.nullif(F.regexp_extract(plain, r"^\s*[0-9]+\s*(?:-|to)\s*([0-9]+)", 1), F.lit("")).try_cast("double")
    single = F.nullif(F.regexp_extract(plain, r"^\s*([0-9]+)\s*\+?", 1), F.lit("")).try_cast("double")
    return F.coalesce((low + high) / 2, single)


def spaced_integer(value: Column) -> Column:
    """A number cut to an integer, with blanks between thousands; '-' for null."""
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return F.coalesce(F.replace(F.format_number(whole.cast("double"), 0), F.lit(","), F.lit(" ")), F.lit("-"))


def interval_text(centre: Column, low: Column, high: Column) -> Column:
    """'C (L - U)'; '-' without a centre, the centre alone without limits."""
    both = low.isNotNull() & high.isNotNull()
    return (
        F.when(centre.isNull(), F.lit("-"))
        .when(both, F.concat(spaced_integer(centre), F.lit(" ("), spaced_integer(low), F.lit(" - "), spaced_integer(high), F.lit(")")))
        .otherwise(spaced_integer(centre))
    )


def percent_text(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f %%", (share * 100).cast("double"))).otherwise(F.lit("-"))


def number_list(values: list[Column]) -> Column:
    """'[12, -, 3]' from columns."""
    return F.concat(F.lit("["), F.array_join(F.array(*[spaced_integer(v) for v in values]), ", "), F.lit("]"))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")
