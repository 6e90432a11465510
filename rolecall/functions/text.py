"""Text helpers as column expressions."""

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Keeps long expressions linear in size: a plain reference would be copied into
    every place it is used, and copied again by each step that uses the result.
    """
    return F.get(F.transform(F.array(value), body), 0)


def record(**fields: Column) -> Column:
    """Struct with the given field names.

    Unlike aliases inside ``struct``, the names survive beside a generator.
    """
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def strip_controls(c: Column) -> Column:
    """Trim every leading and trailing character up to U+0020, not only spaces."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-whitespace text."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x.rlike(r"\S"), x))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[strip_controls(blank_to_null(c)) for c in cols])


def texts(*cols: Column) -> Column:
    """Array of the trimmed non-blank texts, in order."""
    trimmed = F.array(*[strip_controls(c) for c in cols])
    return F.filter(trimmed, lambda x: ~is_blank(x))


def contains_any(c: Column, words) -> Column:
    def any_of(x):
        return reduce(lambda a, b: a | b, [x.contains(w) for w in words])

    return any_of(c) if len(words) == 1 else let(c, any_of)


def host_under(host: Column, suffixes) -> Column:
    """Host equals one of the suffixes or is a subdomain of one."""
    return host.rlike(r"(^|\.)(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def case_first(rules, default=None) -> Column:
    """CASE over (condition, value) pairs; the first true condition wins."""
    out = F
    for cond, value in rules:
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out if default is None else out.otherwise(
        default if isinstance(default, Column) else F.lit(default)
    )


def like_contains(c: Column, needle: str) -> Column:
    """Case-insensitive LIKE '%needle%'; % and _ in the needle stay wildcards."""
    return F.lower(c).like("%" + like_text(needle.lower()) + "%")


def like_text(text: str) -> str:
    """A text as part of a LIKE pattern: its backslashes stand for themselves."""
    return text.replace("\\", "\\\\")


def unescape_html(c: Column) -> Column:
    """Decode character references once, from left to right: what one gives never starts another.

    Numbers and all names of HTML count; the old names also without a semicolon, where no letter or
    digit follows. Anything else stays as it is.
    """
    def decoded(text):
        parts = F.split(text, "&")
        return F.concat(F.get(parts, 0), F.array_join(
            F.transform(F.slice(parts, F.lit(2), F.size(parts)), _after_ampersand), ""))

    return let(c, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def _after_ampersand(text: Column) -> Column:
    """A piece of text that followed an ampersand, with its reference decoded."""
    def with_reference(ref):
        number = F.when(ref.startswith("#"), _code_point(ref))
        char = F.coalesce(number, F.try_element_at(_named(COMMON_NAMES), ref), F.try_element_at(_named(ALL_NAMES), ref))
        rest = F.substr(text, F.length(ref) + 2)
        bare = F.regexp_extract(text, OLD_NAME, 1)
        old = F.concat(F.try_element_at(_named(ALL_NAMES), bare), F.substr(text, F.length(bare) + 1))
        return F.when(ref != "", F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), text))).when(
            bare != "", old).otherwise(F.concat(F.lit("&"), text))

    return let(F.regexp_extract(text, REFERENCE, 1), with_reference)


def _named(names: dict[str, str]) -> Column:
    """Names and characters as a constant map."""
    return F.str_to_map(F.lit("\x02".join(f"{n}\x01{char}" for n, char in names.items())), F.lit("\x02"), F.lit("\x01"))


def _code_point(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"^#[xX]?([0-9a-fA-F]+)$", 1)
    number = F.when(
        F.lower(ref).startswith("#x"), F.conv(digits, 16, 10)
    ).otherwise(digits).cast("bigint")
    return let(number, lambda n: F.when(
        (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.hex(_utf8(n))), "UTF-8")))


def _utf8(n: Column) -> Column:
    """Bytes of a code point as one number."""
    low = n.bitwiseAND(0x3F)
    mid = F.shiftright(n, 6).bitwiseAND(0x3F) * 256
    high = F.shiftright(n, 12).bitwiseAND(0x3F) * 65536
    return (
        F.when(n < 0x80, n)
        .when(n < 0x800, F.lit(0xC080) + F.shiftright(n, 6) * 256 + low)
        .when(n < 0x10000, F.lit(0xE08080) + F.shiftright(n, 12) * 65536 + mid + low)
        .otherwise(F.lit(0xF0808080) + F.shiftright(n, 18) * 16777216 + high + mid + low)
    )


REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
ALL_NAMES = {name.rstrip(";"): char for name, char in html5.items()}
COMMON_NAMES = {n: ALL_NAMES[n] for n in ("amp", "lt", "gt", "quot", "apos", "nbsp")}
OLD_NAME = "^(" + "|".join(sorted(n for n in html5 if not n.endswith(";"))) + ")(?![a-zA-Z0-9;])"

# fixed values: elements that do not part words
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
          "span strike strong sub sup time tt u var wbr").split()
INLINE_TAG = rf"(?is)<!--.*?-->|</?(?:{'|'.join(INLINE)})(?:\s[^>]*|/)?>"


def html_to_text(c: Column) -> Column:
    """Text as a reader sees it: inline tags leave no trace, other tags part words; references are decoded
    and white space is collapsed."""
    def no_tags(t):
        no_code = F.when(
            t.rlike(r"(?i)<(?:script|style)"),
            F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", " "),
        ).otherwise(t)
        return F.regexp_replace(F.regexp_replace(no_code, INLINE_TAG, ""), "<[^>]*>", " ")

    bare = let(c, lambda t: F.when(t.contains("<"), no_tags(t)).otherwise(t))
    return F.trim(F.regexp_replace(F.translate(unescape_html(bare), "\u00a0", " "), r"\s+", " "))


def html_tables(html: Column) -> Column:
    """The tables of a page in the order in which they end, each without the tables inside it."""
    pieces = F.split(html, r"(?i)(?=<table\b|</table\s*>)")
    texts_ = "array<string>"
    start = F.struct(F.array().cast(texts_).alias("open"), F.array().cast(texts_).alias("done"))

    def step(state, piece):
        stack, done = state["open"], state["done"]
        depth, top = F.size(stack), F.get(stack, F.size(stack) - 1)
        outer = F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        rest = F.regexp_replace(piece, r"(?is)^</table\s*>", " ")
        below = F.when(depth > 1, F.concat(
            F.slice(outer, F.lit(1), F.greatest(depth - 2, F.lit(0))),
            F.array(F.concat(F.get(stack, depth - 2), rest)))).otherwise(outer)
        return (F.when(piece.rlike(r"(?i)^<table\b"), F.struct(F.concat(stack, F.array(piece)).alias("open"), done.alias("done")))
                .when(piece.rlike(r"(?i)^</table") & (depth > 0), F.struct(
                    below.alias("open"), F.concat(done, F.array(F.concat(top, F.lit("</table>")))).alias("done")))
                .otherwise(state))

    return F.when(html.rlike(r"(?i)<table\b"), F.aggregate(pieces, start, step, lambda s: s["done"])).otherwise(
        F.array().cast(texts_))


def iso_date(c: Column) -> Column:
    """Strict yyyy-MM-dd from the first ten characters, null when it is no date."""
    head = F.regexp_extract(F.substring(strip_controls(c), 1, 10), r"^(\d{4}-\d{2}-\d{2})$", 1)
    return F.try_to_date(head, "yyyy-MM-dd")
