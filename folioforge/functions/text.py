"""Text helpers, Column to Column, all on the JVM.

Null stays null unless said otherwise. White space is one class everywhere: tab, line feed, vertical tab, form feed, carriage
return and blank (`WS`); `unicode=True` takes every Unicode white space instead.
"""

from __future__ import annotations

import html
import html.entities
import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r ]"
UWS = r"[\s\x1C-\x1F]"
_NUMERIC = r"#[0-9]{1,8};?|#[xX][0-9A-Fa-f]{1,6};?"


@lru_cache(None)
def entity_table() -> tuple[str, str]:
    """All named entities of HTML 5, and numbers that don't mean their code point, as JSON (`&name;` to text); and the pattern of an entity, which may lack the semicolon where HTML lets it."""
    names = {f"&{k}": v for k, v in html.entities.html5.items()} | {f"&#{n}": html.unescape(f"&#{n};") for n in (0, *range(128, 160))}
    bare = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return json.dumps(names), f"&(?:{_NUMERIC}|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{'|'.join(bare)}))"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str, unicode: bool = False) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"(?U){UWS}+" if unicode else f"{WS}+", " "))


def unescape(c: Column | str) -> Column:
    """All entities of HTML 5 decoded, by name or number, on the JVM; unknown names stay. A no-break space becomes a blank.

    Only texts with an ampersand are looked at; each different entity of a text is replaced once, `&amp;` last.
    """
    c = col(c)
    table, pattern = entity_table()
    known = F.from_json(F.lit(table), "map<string,string>")  # one constant of the plan

    def one(e: Column) -> Column:
        bare = F.rtrim(e, F.lit(";"))
        hexed = bare.rlike("^&#[xX]")
        number = F.when(hexed, F.conv(F.substring(bare, 4, 8), 16, 10)).when(bare.rlike("^&#[0-9]"), F.substring(bare, 3, 8)).try_cast("int")
        fine = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(number.isNotNull(), F.lit("\ufffd"))
        named = F.try_element_at(known, F.when(number.isNotNull(), F.concat(F.lit("&#"), number.cast("string"))).otherwise(e))
        return F.coalesce(named, char, e)

    # longer ones first, where one begins another
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), asc=False)
    # an ampersand that comes out is held back by a sign of no text, so that nothing is decoded twice
    held = F.aggregate(found, c, lambda acc, e: F.replace(acc, e, F.replace(one(e), F.lit("&"), F.lit("\ufdd0"))))
    return F.when(~c.contains("&"), c).otherwise(F.replace(F.replace(held, F.lit("\ufdd0"), F.lit("&")), F.lit("\xa0"), F.lit(" ")))


def normalize_space(c: Column | str, unicode: bool = False) -> Column:
    """Entities decoded, white space collapsed; null gives an empty string."""
    return collapse(unescape(F.coalesce(col(c), F.lit(""))), unicode)


def clean_pdf_text(c: Column | str, unicode: bool = False) -> Column:
    """NUL as blank, white space collapsed; null gives an empty string."""
    return collapse(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\x00"), F.lit(" ")), unicode)


def strip(c: Column | str) -> Column:
    """White space off both ends, in linear time."""
    return F.btrim(col(c), F.lit("\t\n\x0b\f\r "))


def strip_html(c: Column | str) -> Column:
    """Tags as blanks, then normalised; null gives an empty string."""
    return normalize_space(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "))


def safe_filename(c: Column | str, hash_suffix: bool = False) -> Column:
    """Letters, digits and `._-` kept, all else one `_`; at most 160 characters; nothing left: `document_` and a digest.

    With `hash_suffix` names that were changed get a digest, so that different inputs keep different names.
    """
    c = col(c)
    s = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"), "_+", "_")
    s = F.substring(F.btrim(s, F.lit("._")), 1, 160)
    digest = F.sha1(F.encode(c, "utf-8"))
    if hash_suffix:
        s = F.when(s == c, s).otherwise(F.concat(F.substring(s, 1, 147), F.lit("_"), F.substring(digest, 1, 12)))
    return F.when(c.isNull(), None).when(F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"), F.lit("._")) == "", F.concat(F.lit("document_"), F.substring(digest, 1, 12))).otherwise(s)


def safe_int(c: Column | str, default: int = 0) -> Column:
    """A number read from text, or the default."""
    return F.coalesce(col(c).cast("string").try_cast("int"), F.lit(default))


def bool_text(c: Column | str) -> Column:
    return F.when(col(c), F.lit("true")).otherwise(F.lit("false"))


def cache_key(c: Column | str) -> Column:
    """Name of a model as a folder name."""
    return F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def key_value(c: Column | str) -> Column:
    """`KEY=VALUE` as struct(key, value); raises on a missing `=` or an empty key."""
    c = col(c)
    key = strip(F.substring_index(c, "=", 1))
    ok = c.contains("=") & (key != "")
    value = F.substring(c, F.instr(c, "=") + 1, F.length(c))
    return F.when(ok, F.struct(key.alias("key"), value.alias("value"))).otherwise(F.raise_error(F.concat(F.lit("expected KEY=VALUE, got: "), c)))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def snippet(c: Column | str, chars: int = 400) -> Column:
    """The first characters of a text on one line."""
    return F.replace(F.substring(strip(c), 1, chars), F.lit("\n"), F.lit(" "))


def embed_text(c: Column | str) -> Column:
    """What is sent to an embedder: a blank for texts with nothing on them."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(strip(c) == "", F.lit(" ")).otherwise(c)


def split_paths(c: Column | str) -> Column:
    """Several paths in one option, split at `;` `,` `:`, blank ones dropped. Lists are the better interface: this breaks URIs."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[;,:]"), strip), lambda x: x != "")


def first_filled(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, or an empty string."""
    return F.coalesce(*[F.when(col(c) != "", col(c)) for c in cs], F.lit(""))


def first_nonblank(*cs: Column | str) -> Column:
    """The first with anything on it, stripped, or an empty string."""
    return F.coalesce(*[F.when(strip(c) != "", strip(c)) for c in cs], F.lit(""))
