"""String and number functions as Spark columns.

Lengths and places count code points.  White space is the Unicode set with the byte-order
mark, spelled out, because Spark's own trim takes the space character alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind as _bind

# White space, headings of a table of contents, marks that end a sentence, scripts without word spaces.
WHITE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SOLID = WHITE.replace("[", "[^", 1)
WHITE_LETTERS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
TOC_HEADING = r"(?iu)(?<![0-9A-Za-z_])contents?(?![0-9A-Za-z_])|table\s+of\s+contents|(?<![0-9A-Za-z_])illustrations?(?![0-9A-Za-z_])|目录|目次|索引|插图|sommaire|índice|indice|inhalt"
TERMINAL = r"[.!?。！？][”’\x22\x27)\]}】》」』]*\z"
CLOSING = r"[.!?。！？”’\x22\x27)\]}】》」』]"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
LETTER = r"[\p{L}\p{N}]"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
LANGUAGES_ZH = {"Simplified Chinese": "简体中文", "Traditional Chinese": "繁體中文", "English": "English", "Japanese": "日本語", "Spanish": "Español"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_start(x: Column) -> Column:
    return F.ltrim(x, F.lit(WHITE_LETTERS))


def trim_end(x: Column) -> Column:
    return F.rtrim(x, F.lit(WHITE_LETTERS))


def trim(x: Column) -> Column:
    return trim_end(trim_start(x))


def ascii_lower(x: Column) -> Column:
    """Lower-case A-Z only, as an ASCII-folding store does."""
    return F.translate(x, UPPER, LOWER)


def round_half_up(x: Column) -> Column:
    """floor(x + 1/2): -0.5 gives 0, unlike Spark's round."""
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def one_of(x: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    return F.when(x.isin(*allowed), x).otherwise(F.lit(otherwise))


def roman_value(label: Column) -> Column:
    """Roman numeral, read from the right: a digit below the largest one so far is subtracted; null unless positive."""
    digits = F.split(F.reverse(F.lower(label)), "")
    worth = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("top"))

    def step(a, d):
        v = F.element_at(worth, d)
        return F.struct((a["total"] + F.when(v < a["top"], -v).otherwise(v)).cast("long").alias("total"), F.greatest(a["top"], v).alias("top"))

    total = F.aggregate(F.filter(digits, lambda d: d != ""), start, step, lambda a: a["total"])
    return F.when(label.rlike(r"(?i)\A[ivxlcdm]+\z"), _bind(total, lambda t: F.when(t > 0, t)))


def page_reference(value: Column) -> Column:
    """struct(label, value, numbering) of a printed page label; null for a blank one."""

    def read(label):
        arabic = label.rlike(r"\A[0-9]{1,6}\z")
        return F.when(F.length(label) > 0, _bind(arabic, lambda a: told(label, a)))

    def told(label, arabic):
        kind = F.when(arabic, "arabic").when(label.rlike(r"(?i)\A[ivxlcdm]+\z"), "roman").otherwise("other")
        number = F.when(arabic, label.try_cast("long")).otherwise(roman_value(label))
        return F.struct(label.alias("label"), number.alias("value"), kind.alias("numbering"))

    return _bind(trim(value), read)


def snippet(text: Column, query: str, radius: int = 72) -> Column:
    """The first match with `radius` code points on both sides, white space collapsed; empty without a match."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(0), at - 1 - radius)
    end = F.least(F.length(text), at - 1 + len(query) + radius)
    inner = trim(F.regexp_replace(F.substring(text, start + 1, end - start), f"{WHITE}+", " "))
    whole = F.concat(F.when(start > 0, "…").otherwise(""), inner, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > 0, whole).otherwise("")


def highlight(text: Column, query: str) -> Column:
    """array<struct<text, hit>>: the text cut at all non-overlapping matches, whatever their case."""
    needle = query.strip()
    if not needle:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    pattern = "(?iu)" + "".join(f"\\x{{{ord(c):x}}}" for c in needle)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern)
    pair = F.flatten(F.zip_with(rest, found, lambda a, b: F.array(F.struct(a.alias("text"), F.lit(False).alias("hit")), F.struct(b.alias("text"), F.lit(True).alias("hit")))))
    return F.filter(pair, lambda x: F.length(x["text"]) > 0)


def title_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf\z", "")


def file_size(size: Column) -> Column:
    """KB below one MB (1 at least), MB with one decimal below ten."""
    mb = size / 1048576
    one = (round_half_up(mb * 10) / 10).cast("decimal(20,1)").cast("string")
    small = F.greatest(F.lit(1), round_half_up(size / 1024)).cast("string")
    return F.when(size < 1048576, F.concat(small, F.lit(" KB"))).otherwise(F.concat(F.when(size < 10485760, one).otherwise(round_half_up(mb).cast("string")), F.lit(" MB")))


def signed(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def language_label(value: Column, locale: str) -> Column:
    if locale != "zh-CN":
        return value
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES_ZH.items() for x in pair))
    return F.coalesce(F.try_element_at(names, value), value)


def percent_decode(value: Column) -> Column:
    """Null where the escapes are broken; a plus sign stays one."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def percent_encode(value: Column) -> Column:
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, kept in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(kept))
    return out


def book_id_of(url: Column) -> Column:
    """The decoded and trimmed `book` parameter of an address; null where it is blank or missing, or the address is none."""
    raw = F.replace(F.try_parse_url(url, F.lit("QUERY"), F.lit("book")), F.lit("+"), F.lit(" "))
    own = trim(percent_decode(raw))
    return F.when(own != "", own)


def with_book_id(url: Column, book: Column) -> Column:
    """The address with its `book` parameter set, or taken out where `book` is null or empty."""
    rest, fragment = F.regexp_extract(url, r"\A([^#]*)", 1), F.regexp_extract(url, r"(#.*)\z", 1)
    path, query = F.regexp_extract(rest, r"\A([^?]*)", 1), F.regexp_extract(rest, r"\A[^?]*\?(.*)\z", 1)
    other = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("book=") & (p != "book"))
    own = F.when(F.coalesce(book, F.lit("")) != "", F.array(F.concat(F.lit("book="), percent_encode(book)))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(other, own)
    return F.concat(path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""), fragment)


def endpoint(raw: Column, kind: str, default: str) -> Column:
    """A provider's address: one trailing slash goes; a compatible one gets its path."""
    base = F.regexp_replace(trim(raw), r"/\z", "")
    if kind == "default":
        return F.when(base == "", F.lit(default)).otherwise(base)
    return F.when(base.rlike(r"/(chat/completions|responses)\z"), base).otherwise(F.concat(base, F.lit("/chat/completions")))


def safe_return_path(path: Column) -> Column:
    """A path on the same site that starts with a single slash, else "/"."""
    ok = path.startswith("/") & ~path.startswith("//") & ~F.contains(path, F.lit("\\"))
    return F.when(ok, path).otherwise("/")


def reveal_duration(characters: Column, per_second: Column) -> Column:
    """Milliseconds that a text takes to appear."""
    return F.when(characters <= 0, F.lit(0.0)).otherwise(characters / F.greatest(F.lit(1), per_second) * 1000)


def revealed(elapsed_ms: Column, characters: Column, per_second: Column) -> Column:
    """Characters shown after a time."""
    shown = F.floor(F.greatest(F.lit(0), elapsed_ms) * F.greatest(F.lit(1), per_second) / 1000)
    return F.when(characters <= 0, F.lit(0)).otherwise(F.least(characters.cast("long"), shown))


def reveal_parts(text: Column, offset: Column, progress: Column) -> Column:
    """struct(stable, tail, pending) of a text of which `progress - offset` code points are shown."""
    n = F.length(text)
    shown = F.least(n, F.greatest(F.lit(0), progress - offset)).cast("int")
    tail = F.when(shown < n, F.least(F.lit(5), shown)).otherwise(0)
    return F.struct(F.substring(text, F.lit(1), shown - tail).alias("stable"), F.substring(text, shown - tail + 1, tail).alias("tail"), F.substring(text, shown + 1, n - shown).alias("pending"))


def accepted_locale(saved: Column, header: Column) -> Column:
    """The saved locale, else the most wanted supported one of an Accept-Language header, else en-US."""

    def part(entry, i):
        pieces = F.split(trim(entry), ";")
        wanted = F.try_element_at(F.filter(F.transform(F.slice(pieces, 2, 100), trim), lambda p: p.startswith("q=")), F.lit(1))
        raw = trim(F.substring(wanted, 3, 100))
        quality = F.when(wanted.isNull(), 1.0).when(raw == "", 0.0).otherwise(F.coalesce(raw.try_cast("double"), F.lit(0.0)))
        return F.struct((-quality).alias("less"), i.alias("i"), F.lower(pieces[0]).alias("language"))

    parts = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), part), lambda p: p["less"] < 0)
    known = F.filter(F.array_sort(parts), lambda p: p["language"].rlike(r"\A(zh|en)(-|\z)"))
    first = F.try_element_at(known, F.lit(1))["language"]
    return F.when(saved.isin("zh-CN", "en-US"), saved).when(first.startswith("zh"), "zh-CN").otherwise("en-US")
