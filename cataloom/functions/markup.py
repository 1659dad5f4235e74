"""A page's text by its tree: tokens, a stack of open elements, and character references, all in expressions.

Elements nest by their tags alone, as a lenient parser without implied end tags reads them: an end tag closes the innermost
open element of its name with all inside, or nothing; void and self-closed elements have no content.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F

from cataloom.functions import constants as K

# Attributes: a quoted value may hold ">" where it follows "=".
_REST = r"""[^>"'=]*+(?:(?:=\s*+(?:"[^"]*+"|'[^']*+')|["'=])[^>"'=]*+)*+>"""
#: Comments; scripts and styles with all they hold; tags; declarations; text, to which a bare "<" belongs.
TOKEN = rf"""(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)|</?[a-z]{_REST}|<[!?/][^>]*+>|<?+[^<]*+(?:<(?![a-z/!?])[^<]*+)*+"""
_REFERENCE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[A-Za-z][A-Za-z0-9]*+;?+)|[^&]++|&"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named() -> Column:
    """The standard's names of characters, from Python's own table, as one constant map."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _character(n: Column) -> Column:
    """The character of a code point; numbers of C1 controls mean what Windows-1252 has there, impossible ones U+FFFD."""
    western = {i: bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
    mapped = F.try_element_at(F.from_json(F.lit(json.dumps({str(i): c for i, c in western.items() if c})), "map<string,string>"), n.cast("string"))
    sound = n.isNotNull() & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(sound, F.coalesce(mapped, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))).otherwise(F.lit("�"))


def referenced(text: Column) -> Column:
    """Text with its character references decoded: decimal, hexadecimal and named, the old names also without semicolon."""

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+)", 1)
        # Longer numbers than eight digits are beyond all characters.
        number = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
        name = F.substring(piece, F.lit(2), F.length(piece))

        def longest(known: Column) -> Column:
            """The longest beginning that is a name of its own, and what follows it."""
            begins = F.when(F.length(name) > 2, F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
            found = F.get(F.filter(begins, lambda k: F.try_element_at(known, F.substring(name, F.lit(1), k)).isNotNull()), F.lit(0))
            return F.concat(F.try_element_at(known, F.substring(name, F.lit(1), found)), F.substring(name, found + 1, F.length(name)))

        named = F.coalesce(F.try_element_at(_named(), name), longest(_named()), piece)
        return F.when(~piece.startswith("&") | (piece == "&"), piece).when(piece.startswith("&#"), _character(number)).otherwise(named)

    return F.when(~text.contains("&"), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), decoded), ""))


def text_nodes(page: Column, noise: tuple[str, ...] = K.PAGE_NOISE, enough: int = K.PAGE_CHARS_KEPT) -> Column:
    """The texts between tags and comments, in order, without those inside ``noise`` elements, references decoded.

    Ends once the texts hold ``enough`` characters other than white space, so a long page costs no more.
    """
    none = F.array().cast("array<string>")

    def state(open_: Column, hidden: Column, held: Column, texts: Column) -> Column:
        return F.struct(open_.alias("open"), hidden.cast("int").alias("hidden"), held.cast("int").alias("held"), texts.alias("texts"))

    def step(s: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*+)", 1))

        def begun(name: Column) -> Column:
            opened = F.concat(s["open"], F.array(name))
            hidden = F.when((s["hidden"] == 0) & name.isin(*noise), F.size(opened)).otherwise(s["hidden"])
            empty = name.isin(*K.VOID_ELEMENTS) | token.endswith("/>") | name.isin("script", "style")
            return F.when(empty, s).otherwise(state(opened, hidden, s["held"], s["texts"]))

        def ended(back: Column) -> Column:
            """``back``: how many open elements an end tag closes; 0 if none has its name."""
            left = F.size(s["open"]) - back
            hidden = F.when(s["hidden"] > left, 0).otherwise(s["hidden"])
            return F.when(back == 0, s).otherwise(state(F.slice(s["open"], F.lit(1), left), hidden, s["held"], s["texts"]))

        def told(text: Column) -> Column:
            held = s["held"] + F.length(F.regexp_replace(text, r"\s", ""))
            return state(s["open"], s["hidden"], held, F.concat(s["texts"], F.array(text)))

        tag = token.rlike("^</?[a-zA-Z]") & token.endswith(">")
        other = token.startswith("<!") | token.startswith("<?") | token.startswith("</")
        return (
            F.when((s["held"] >= enough) | (token == ""), s)
            .when(tag & token.startswith("</"), _let(F.array_position(F.reverse(s["open"]), name).cast("int"), ended))
            .when(tag, _let(name, begun))
            .when(other | (s["hidden"] > 0), s)
            .otherwise(_let(referenced(token), told))
        )

    tokens = F.regexp_extract_all(page, F.lit(TOKEN), F.lit(0))
    return F.aggregate(tokens, state(none, F.lit(0), F.lit(0), none), step, lambda s: s["texts"])
