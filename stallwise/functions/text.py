"""Text functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a title that tell its condition, in the order in which they are tried.
CONDITIONS = [("refurbished", "refurbished"), ("refurb", "refurbished"), ("renewed", "refurbished"), ("used", "used"), ("second hand", "used"), ("brand new", "new")]


def clean_title(title: Column) -> Column:
    """Lower case, white space of any kind collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(title), r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    """Letters without accents and digits in lower case, everything else one hyphen, none at the ends."""
    accented = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
    plain = "aaaaaaeeeeiiiiooooouuuuncyy"
    folded = F.translate(F.lower(text), accented, plain)
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(text: Column) -> Column:
    """A capital after every sign that is no letter, lower case elsewhere."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def condition(title: Column) -> Column:
    """The first condition whose word the title holds; new if none."""
    found = F.lit(None)
    lowered = F.lower(title)
    for word, state in reversed(CONDITIONS):
        found = F.when(lowered.contains(word), F.lit(state)).otherwise(found)
    return F.coalesce(found, F.lit("new"))


def title_hash(category: Column, title: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of category, a zero byte and title."""
    return F.substring(F.sha2(F.concat(category, F.lit("\0"), title), 256), 1, 16)


def strip_html(html: Column) -> Column:
    """Text without scripts, styles and tags, two entities decoded, blanks collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def js_unescape(text: Column) -> Column:
    """The escapes of a string literal in a script undone, in order."""
    for escaped, sign in (("\\u0026", "&"), ("\\u003c", "<"), ("\\u003e", ">"), ("\\/", "/"), ('\\"', '"'), ("\\n", "\n"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(escaped), F.lit(sign))
    return text


def xml_escape(text: Column) -> Column:
    for sign, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(escaped))
    return text


def url_quote(text: Column) -> Column:
    """Percent encoding that keeps slashes and writes blanks as %20."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def with_parameters(url: Column, parameters: Column) -> Column:
    """The address with query parameters appended; without parameters it stays."""
    joined = F.concat(url, F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), parameters)
    return F.when(parameters.isNull() | (parameters == ""), url).otherwise(joined)


def ago(seconds: Column) -> Column:
    """A span in words: just now, then whole minutes, hours or days."""
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def first_picture(*addresses: Column) -> Column:
    """The first address that is neither empty, inline data, a drawing nor a placeholder."""
    no_picture = r"(?i)^data:|\.svg(\?|$)|placeholder|no[-_]?image|coming[-_]?soon|spinner|loading|blank\.|default[-_]"
    return F.coalesce(*[F.when((a != "") & ~a.rlike(no_picture), a) for a in addresses])
