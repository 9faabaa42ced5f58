"""Text and action functions as column expressions.

Regular expressions spell out what they mean in Java: ``(?U)`` for Unicode white space, ``(?d)`` so
that only a newline ends a line, ``^(?:...)\\z`` for a full match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1C-\x1F]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def strip(x: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(x), rf"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def normalize_text(x: Column | str) -> Column:
    """Runs of white space are one space; trimmed and lower-case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), SPACE, " ")))


def normalize_action(x: Column | str) -> Column:
    """struct<kind, arg>: of the last ``action:`` line if there is one; kind is search, click or invalid."""
    pattern = r"(?isU)^\s*(search|click)\s*\[(.*)\]\s*\z"

    def last(raw: Column) -> Column:
        lines = F.filter(F.split(raw, r"\R|[\x0B\x0C\x1C-\x1E]"), lambda s: F.lower(strip(s)).startswith("action:"))
        of_lines = let(lines, lambda found: F.when(F.size(found) > 0, strip(F.regexp_replace(F.element_at(found, -1), r"(?s)^[^:]*:", ""))).otherwise(raw))
        return F.when(F.contains(F.lower(raw), F.lit("action:")), of_lines).otherwise(raw)

    def read(raw: Column, text: Column) -> Column:
        kind = let(F.lower(F.regexp_extract(text, pattern, 1)), lambda k: F.when(k == "", "invalid").otherwise(k))
        return let(kind, lambda k: F.struct(k.alias("kind"), normalize_text(F.when(k == "invalid", raw).otherwise(F.regexp_extract(text, pattern, 2))).alias("arg")))

    return let(F.coalesce(col(x), F.lit("")), lambda raw: let(last(raw), lambda text: read(raw, text)))


def looks_like_product(x: Column | str) -> Column:
    """8 to 20 lower-case letters or digits, with a digit."""
    return col(x).rlike(r"^[a-z0-9]{8,20}\z") & col(x).rlike("[0-9]")


def visible_response(x: Column | str) -> Column:
    """Escaped newlines as newlines."""
    return F.replace(col(x), F.lit("\\n"), F.lit("\n"))


def extract_action(x: Column | str) -> Column:
    """What follows the first ``\\nAction: ``, else all."""
    text = visible_response(x)
    at = F.instr(text, "\nAction: ")
    return F.when(at > 0, F.substr(text, at + 9)).otherwise(text)


ACTION = r"(?d)^(.+)\[(.+)\]"


def parse_action(x: Column | str) -> Column:
    """struct<name, argument>: greedy, from the start; without brackets the argument is null."""
    hit = col(x).rlike(ACTION)
    return F.struct(
        F.when(hit, F.regexp_extract(col(x), ACTION, 1)).otherwise(col(x)).alias("name"),
        F.when(hit, F.regexp_extract(col(x), ACTION, 2)).alias("argument"),
    )


def trace_action(x: Column | str) -> Column:
    """struct<normalized_response, extracted_action, action_name, action_argument, canonical>."""
    extracted = extract_action(x)
    parsed = parse_action(extracted)
    ok = parsed["name"].isin("search", "click") & F.coalesce(strip(parsed["argument"]) != "", F.lit(False))
    return F.struct(
        visible_response(x).alias("normalized_response"),
        extracted.alias("extracted_action"),
        parsed["name"].alias("action_name"),
        parsed["argument"].alias("action_argument"),
        ok.alias("canonical"),
    )


def audit_action(x: Column | str) -> Column:
    """struct<name, argument> as the audit reads it: the part up to the next marker, any newline, trimmed, lower-case."""
    text = visible_response(x)
    part = strip(F.when(F.instr(text, "\nAction: ") > 0, F.get(F.split(text, "\nAction: "), F.lit(1))).otherwise(text))
    pattern = r"(?s)^(.+)\[(.+)\]"
    hit = part.rlike(pattern)
    name = F.when(hit, F.lower(strip(F.regexp_extract(part, pattern, 1)))).otherwise(F.nullif(F.lower(part), F.lit("")))
    return F.struct(name.alias("name"), F.when(hit, F.lower(strip(F.regexp_extract(part, pattern, 2)))).alias("argument"))


#: The audit's product ids, and the names of buttons.
PRODUCT_ID = r"^\p{Nd}{8,16}\z"
BUTTONS = {
    "Buy Now": ("buy now", "buy", "购买", "立即购买"),
    "Next >": ("next >", "next", "下一页", ">"),
    "Back/navigation": ("back to search", "< prev", "prev", "返回搜索", "返回"),
    "product section": ("description", "features", "reviews"),
}


def action_kind(name: Column | str, argument: Column | str) -> Column:
    """Seven kinds of action."""
    arg = F.lower(strip(argument))
    out = (
        F.when(col(name) == "search", "search")
        .when((F.coalesce(col(name), F.lit("")) != "click") | (F.coalesce(col(argument), F.lit("")) == ""), "malformed/other")
        .when(arg.rlike(PRODUCT_ID), "product ASIN/numeric click")
    )
    for kind, names in BUTTONS.items():
        out = out.when(arg.isin(*names), kind)
    return out.otherwise("option/other click")


def casefold(x: Column | str) -> Column:
    """Text without differences of case, as Unicode folds it (``ß`` is ``ss``, a final sigma a sigma); ``ı`` stays."""
    # what stands between keeps Catalyst from leaving out the upper case
    upper = F.translate(F.upper(F.translate(col(x), "ı", "\ue000")), "\ue000", "ı")
    return F.translate(F.lower(upper), "ς", "σ")


def contains_argument(argument: Column | str, observation: Column | str) -> Column:
    """Whether the observation shows the argument; null if either is missing. One character must stand alone."""

    def shown(hay: Column, needle: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(hay, r"(?U)(?<=\w)(?=\w)", "\u0001"), F.lit(" "))
        lone = F.contains(F.regexp_replace(padded, r"(?U)\w(?:\u0001\w)+", " "), needle)
        return F.when((F.coalesce(needle, F.lit("")) == "") | hay.isNull(), F.lit(None).cast("boolean")).when(F.char_length(needle) <= 1, F.contains(hay, needle) & lone).otherwise(F.contains(hay, needle))

    def folded(text: Column) -> Column:
        return F.when(text.rlike(r"[^\x00-\x7F]"), casefold(text)).otherwise(F.lower(text))

    return let(folded(strip(argument)), lambda needle: let(folded(col(observation)), lambda hay: shown(hay, needle)))


def log_value(x: Column | str) -> Column:
    """Letters, digits and ``._:/=-`` only, 180 characters at most, ``-`` if nothing is left."""
    kept = F.left(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^\p{L}\p{N}._:/=-]", ""), F.lit(180))
    return F.when(kept == "", "-").otherwise(kept)


def displayed(x: Column | str, digits: int | None = None, unit: str = "") -> Column:
    """A value for reports: ``N/A`` for null, a number with ``digits`` places (else as it is), then the unit. Halves, as the shortest decimal text tells them, round to even."""
    shown = col(x).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.bround(col(x).cast("double"), digits))
    return F.when(col(x).isNull(), "N/A").otherwise(F.concat(shown, F.lit(unit)))


def displayed_rate(estimate: Column | str, low: Column | str, high: Column | str) -> Column:
    """``estimate [low, high]`` with three places each."""
    return F.concat(displayed(estimate, 3), F.lit(" ["), displayed(low, 3), F.lit(", "), displayed(high, 3), F.lit("]"))


def available_summary(clickables: Column | str, has_search_bar: Column | str) -> Column:
    """struct<clickable_count, has_search_bar> as texts; ``N/A`` for what is missing."""
    count = F.when(col(clickables).isNotNull(), F.size(col(clickables)))
    return F.struct(displayed(count).alias("clickable_count"), displayed(has_search_bar).alias("has_search_bar"))


def file_component(x: Column | str) -> Column:
    """A safe part of a file name: other characters are underscores, no dots or underscores at the ends."""
    return F.regexp_replace(F.regexp_replace(col(x), "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+\z", "")


#: Fixed patterns of the redaction, in their order.
URL, BEARER = r"(?i)https?://[^\s)]+", r"(?i)bearer\s+[A-Za-z0-9._-]+"
SECRET = r"(?i)((?:sk|key|token|secret)[-_A-Za-z0-9]*)\s*([:=])\s*[^\s,;]+"
KEY = r"\bsk-[A-Za-z0-9_-]{12,}\b"


def redact(x: Column | str) -> Column:
    """Addresses, bearer tokens and named secrets masked."""
    out = F.regexp_replace(col(x), URL, "<redacted-url>")
    out = F.regexp_replace(out, BEARER, "Bearer <redacted>")
    out = F.regexp_replace(out, SECRET, "$1$2<redacted>")
    return F.regexp_replace(out, KEY, "<redacted-key>")


def capacities(x: Column | str) -> Column:
    """``1:8,2:12`` as map<int, int>."""
    pairs = F.transform(F.split(col(x), ","), lambda p: F.split(F.trim(p), ":"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].cast("int"), p[1].cast("int"))))
