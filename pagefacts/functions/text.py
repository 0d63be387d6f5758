"""Page text, titles, links, chunks, title and entity keys. Column expressions unless noted."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named entities that are decoded; ``&amp;`` comes after all others.
NAMES = (
    "nbsp lt gt quot apos mdash ndash hellip laquo raquo middot iexcl iquest deg sect para euro pound copy reg trade bull dagger szlig times divide plusmn "
    "agrave aacute acirc atilde auml aring ccedil egrave eacute ecirc euml igrave iacute icirc iuml ntilde ograve oacute ocirc otilde ouml ugrave uacute ucirc uuml yacute yuml "
    "Agrave Aacute Acirc Atilde Auml Aring Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml Ntilde Ograve Oacute Ocirc Otilde Ouml Ugrave Uacute Ucirc Uuml Yacute"
).split()
ENTITIES = {f"&{n};": chr(name2codepoint.get(n, 39)) for n in NAMES}
ENTITIES["&nbsp;"] = " "
#: Elements whose content is no text, and what may follow a tag's name.
HIDDEN, _AFTER_NAME = ["script", "style", "noscript", "svg"], "[ \\t\\n\\f\\r>/]"
#: What a page is made of, in order: hidden elements with their content, tags (the last one may lack its end), text.
_TOKEN = "(?is)" + "|".join(f"<{t}(?={_AFTER_NAME}).*?</{t}>" for t in HIDDEN) + "|<[^>]*>|<[^>]*\\z|[^<]+"
_DATA = "(?is)^<script[ \\t\\n\\f\\r/][^>]*ld\\+json[^>]*>(.*)</script>$"
#: Tags that break a line go by the beginning of their names.
_BREAKS = "(?i)^(</?(p|div|li|tr|h)|<br|</table)"
_IMAGE = "(?i)^<img[ \\t\\n\\r/>]"
_ALT = "(?is)^(?>.*?alt=)(?:\"([^\"]*)\"|'([^']*)'|([^\"' \\t\\n\\f\\r>][^ \\t\\n\\f\\r>]*)?)"
_SPACE = "[\\s\\x85\\p{Z}]"
_BLANK = "[ \\t\\x0B\\f\\r\\x85\\p{Z}]"
#: JSON-LD characters that a page keeps of a block.
MOST_JSON_LD = 2000


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: under higher-order functions an expression is evaluated at each mention."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def decode_entities(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def named(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit("&[A-Za-z]+[0-9]?;"), F.lit(0)))
        out = F.aggregate(found, text, lambda t, e: F.replace(t, e, F.coalesce(F.try_element_at(names, e), e)))
        return F.replace(out, F.lit("&amp;"), F.lit("&"))

    def one(t: Column, e: Column) -> Column:
        digits = F.regexp_extract(e, "^&#x?\\+?0*([0-9A-Fa-f]*);", 1)
        code = F.when(F.rlike(e, F.lit("^&#x\\+?[0-9A-Fa-f]+;$")), F.conv(F.left(digits, F.lit(8)), 16, 10)).when(F.rlike(e, F.lit("^&#\\+?[0-9]+;$")), F.left(digits, F.lit(9)))
        code = F.when(F.length(digits) == 0, F.when(code.isNotNull(), 0)).otherwise(code.cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.replace(t, e, F.coalesce(F.when((code < 0x110000) & ~code.between(0xD800, 0xDFFF), char), F.lit("")))

    numbers = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit("&#[^;]*;"), F.lit(0)))
    return _once(_once(text, named), lambda text: F.aggregate(numbers(text), text, one))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|(?<!{_SPACE}){_SPACE}++$", "")


def page_text(html: Column) -> Column:
    """Visible text, line by line: lines are trimmed, one empty line stays of several, and the last line ends too.

    Hidden elements go with their content (of an unclosed one the tag alone), but a JSON-LD block stays in its
    place, on one line of MOST_JSON_LD characters at most; block tags break lines, images leave their alt text
    in any quoting, and a tag without an end takes what is left. One pass cuts the page into tokens; places
    where a line or a space may begin are marked (``<`` is free there, a literal one is ``<l>``) and settled at the end.
    """
    kept = lambda text: F.replace(text, F.lit("<"), F.lit("<l>"))

    def piece(t: Column) -> Column:
        data = F.left(F.replace(_trimmed(F.regexp_replace(F.regexp_extract(t, _DATA, 1), f"{_SPACE}+", " ")), F.lit("\\/"), F.lit("/")), F.lit(MOST_JSON_LD))
        alt = _trimmed(F.concat(*(F.regexp_extract(t, _ALT, i) for i in (1, 2, 3))))
        seen = F.when(F.rlike(t, F.lit(_BREAKS)), "<b>").when(F.rlike(t, F.lit(_IMAGE)) & F.endswith(t, F.lit(">")) & (alt != ""), F.concat(F.lit("<i>"), kept(alt), F.lit(" ")))
        seen = seen.when(F.rlike(t, F.lit(_DATA)) & (data != ""), F.concat(F.lit("<d>"), kept(data), F.lit("\n")))
        return F.when(~F.startswith(t, F.lit("<")), t).otherwise(F.coalesce(seen, F.lit("")))

    text = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), piece), "")
    text = F.replace(F.regexp_replace(text, "(?:^|(?<=[ \\n]|<b>))<i>", ""), F.lit("<i>"), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(text, "^<d>", ""), "\\n?(?:<[bd]>)+", "\n")
    text = decode_entities(F.replace(text, F.lit("<l>"), F.lit("<")))
    text = _once(text, lambda t: F.when((t == "") | F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n"))))
    text = F.regexp_replace(F.regexp_replace(text, f"(?md)^{_BLANK}++", ""), f"(?<!{_BLANK}){_BLANK}++(?=\\n)", "")
    return F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\n{2,}", "\n")


def page_title(html: Column) -> Column:
    return F.regexp_replace(decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), "^\\s+|\\s+$", "")


#: Packs of so many characters or fewer are not chunks; chunks are cut to this size at least.
LEAST_CHUNK, LEAST_SIZE = 80, 200
_EDGE = "^[\\s\\x85\\p{Z}]+|[\\s\\x85\\p{Z}]+$"


def chunks(text: Column, size: int = 4000, cap: int | None = 40) -> Column:
    """Array of chunks: paragraphs (parted by an empty line) packed to ``size`` characters together, short packs
    dropped, ``cap`` chunks at most (the chunks asked for, as in a head of a list; None: all).

    A paragraph over ``size`` is cut before the last line end of each window, or, where the window holds none, before
    the last space; where that lies in the window's first half the cut is hard.
    """
    size = max(size, LEAST_SIZE)
    late, any_ = size // 2 + 1, "[\\s\\S]"
    window = f"{any_}{{1,{size}}}\\z|{any_}{{{late},{size - 1}}}(?=\\n)|(?!{any_}{{0,{size - 1}}}\\n){any_}{{{late},{size - 1}}}(?= )|{any_}{{{size}}}"
    pieces = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(window), F.lit(0)))
    parts = F.filter(F.transform(F.flatten(F.transform(F.split(text, "\n\n"), pieces)), lambda p: F.regexp_replace(p, _EDGE, "")), lambda p: p != "")
    start = F.struct(F.lit("").alias("now"), F.expr("cast(array() as array<string>)").alias("out"))

    def pack(s: Column, p: Column) -> Column:
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(p) > size)
        joined = F.when(full | (s["now"] == ""), p).otherwise(F.concat(s["now"], F.lit("\n\n"), p))
        return F.struct(joined.alias("now"), F.when(full & (F.length(s["now"]) > LEAST_CHUNK), F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"))

    packed = F.aggregate(parts, start, pack, lambda s: F.when(F.length(s["now"]) > LEAST_CHUNK, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))
    return packed if cap is None else F.slice(packed, 1, cap)


#: Separators before a site's name in a title, and words that such a name has at most.
SEPARATORS = [" - ", " – ", " — ", " | ", " : ", ": ", "|", " · "]
NAME_WORDS, KEY_WORDS = 5, 8


def title_key(title: Column) -> Column:
    """The first eight words of a title, lower-cased, without a short last segment (a site's name)."""
    lower = F.lower(F.regexp_replace(title, "^\\s+|\\s+$", ""))
    cut = F.lit(0)
    for sep in SEPARATORS:
        at = F.length(lower) - F.length(F.substring_index(lower, sep, -1)) - len(sep)
        head, tail = F.trim(F.left(lower, at)), F.trim(F.substring_index(lower, sep, -1))
        ok = F.contains(lower, F.lit(sep)) & (head != "") & (tail != "") & (F.size(F.split(tail, "\\s+")) <= NAME_WORDS)
        cut = F.greatest(cut, F.when(ok, at).otherwise(0))
    head = F.when(cut > 0, F.left(lower, cut)).otherwise(lower)
    return F.array_join(F.slice(F.regexp_extract_all(head, F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), 1, KEY_WORDS), " ")


def normalize_query(query: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(query, "\\s+", " "), "^ | $", ""))


#: Municipal prefixes in the order they are tried, one of which is taken off.
PREFIXES = [
    "ayuntamiento de ", "municipality of ", "ajuntament de ", "concello de ", "concejo de ", "municipio de ", "udaletxea ", "comune di ", "mairie de ",
    "ajuntament d'", "ville de ", "town of ", "city of ", "udala ", "ayto. de ", "ayto de ", "gemeinde ", "stadt ", "ayto. ", "ayto ",
    "ayuntamiento ", "ajuntament ", "concello ", "concejo ", "municipio ", "comune ", "mairie ",
]
#: Letters with accents and their plain forms.
PLAIN = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿł", "aaaaaaceeeeiiiinoooooouuuuyyl")
PREFIX = "^(" + "|".join(p.replace(".", "\\.") for p in PREFIXES) + ")"


def normalize_entity(name: Column) -> Column:
    """Key of an entity's name: case, accents, a gloss or region in parentheses, one municipal prefix, a
    repository's owner and punctuation do not count."""
    s = F.translate(F.lower(name), *PLAIN)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, "\\s+$", "")
    inner = F.trim(F.regexp_extract(s, "\\(([^(]*)\\)$", 1))
    gloss = F.trim(F.regexp_replace(inner, PREFIX, ""))
    s = F.when((inner != gloss) & (gloss != "") & F.rlike(inner, F.lit(PREFIX)), gloss).otherwise(F.regexp_replace(s, "\\s*\\([^(]*\\)$", ""))
    s = F.regexp_replace(s, " (udaletxea|udala)\\s*$", "")
    s = F.regexp_replace(s, PREFIX, "")
    s = F.when(F.rlike(s, F.lit("^[^\\s/]+/[^\\s/]+$")), F.substring_index(s, "/", -1)).otherwise(s)
    return F.trim(F.regexp_replace(s, "[^\\p{L}\\p{N}]+", " "))


# Contacts. Patterns, and hosts of made-up addresses.

EMAIL = "[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}"
URL = "(?:https?://|www\\.)[^\\s<>\"'(){}\\[\\],;]{3,}"
PHONE = "\\+?[0-9][0-9 .\\-]{5,}[0-9]"
AT_WORD = "([a-z0-9._%+\\-]+) at ((?:[a-z0-9\\-]+ ?\\. ?)+[a-z]{2,})"
PLACEHOLDERS = ["example.com", "example.org", "domain.com", "email.com", "test.com"]
PUNCT = "[.,:;!?)\\]]+$"


def deobfuscate(text: Column) -> Column:
    """Lower-cased text with written-out @ and dots put back; "x at www.y" is no address."""
    s = F.lower(text)
    for a, b in ((" arroba ", "@"), ("(at)", "@"), ("[at]", "@"), ("(dot)", "."), ("[dot]", ".")):
        s = F.replace(s, F.lit(a), F.lit(b))
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(AT_WORD), F.lit(0)))
    mail = lambda m: F.concat(F.regexp_extract(m, AT_WORD, 1), F.lit("@"), F.replace(F.regexp_extract(m, AT_WORD, 2), F.lit(" "), F.lit("")))
    web = lambda m: F.rlike(F.regexp_extract(m, AT_WORD, 2), F.lit("^(www\\.|http)"))
    return F.aggregate(found, s, lambda t, m: F.replace(t, m, F.when(web(m), m).otherwise(mail(m))))


def emails(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(deobfuscate(text), F.lit(EMAIL), F.lit(0)), lambda m: F.regexp_replace(m, PUNCT, ""))

    def plausible(m: Column) -> Column:
        local, host = F.regexp_replace(m, "@[^@]*$", ""), F.substring_index(m, "@", -1)
        return (local != "email") & ~F.contains(local, F.lit("protected")) & ~host.isin(PLACEHOLDERS)

    return F.array_distinct(F.filter(found, plausible))


def urls(text: Column) -> Column:
    def clean(m: Column) -> Column:
        m = F.regexp_replace(m, PUNCT, "")
        return F.replace(F.when(F.startswith(m, F.lit("www.")), F.concat(F.lit("https://"), m)).otherwise(m), F.lit("\\/"), F.lit("/"))

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), clean))


def phones(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= 7)
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.trim(m), PUNCT, "")))


def folded(text: Column) -> Column:
    """Case, white space and escaped slashes do not count when a value is looked for in a text."""
    return F.lower(F.regexp_replace(F.replace(text, F.lit("\\/"), F.lit("/")), "\\s+", " "))
