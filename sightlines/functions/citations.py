"""Sources of AI answers: lists of citations in any of the forms that providers give, and addresses in the answer itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members that hold the list where a provider wraps it.
WRAPPERS = ("citations", "sources")
CITATION = "struct<url: string, domain: string>"
_NONE = f"cast(array() as array<{CITATION}>)"


def source_host(value: Column) -> Column:
    """Lower-case host of an address or bare domain, without user, port and closing dots; empty for what is none."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    raw = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(F.regexp_extract(raw, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(host, r":[^:\]]*$", ""), r"\.+$", "")


def _text(v: Column) -> Column:
    """A string value, null for all else."""
    return F.when(F.startswith(F.to_json(v), F.lit('"')), F.try_variant_get(v, "$", "string"))


def _empty(v: Column) -> Column:
    """Absent, null, false, zero, or an empty string, list or object."""
    return F.coalesce(F.to_json(v).isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(True))


def _cited(url: Column, domain: Column) -> Column:
    host = source_host(F.when(F.coalesce(domain, F.lit("")) != "", domain).otherwise(url))
    return F.struct(url.alias("url"), F.nullif(host, F.lit("")).alias("domain"))


def parse_citations(raw: Column) -> Column:
    """array<struct(url, domain)>: from a JSON list of addresses or objects, an object that wraps one or is one, or lines.

    Objects give their `domain`, else the host of their `url`; other items are left out.  Text that is no JSON is
    a list of lines; null and blank text have no citations.
    """
    v = F.try_parse_json(F.trim(raw))
    member = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    wrapped = v
    for name in reversed(WRAPPERS):
        wrapped = F.when(~_empty(member(v, name)), member(v, name)).otherwise(wrapped)
    is_object = F.startswith(F.to_json(v), F.lit("{"))
    itself = is_object & _empty(member(v, WRAPPERS[0])) & _empty(member(v, WRAPPERS[1]))
    items = F.when(itself, F.array(v)).when(is_object, F.try_variant_get(wrapped, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$", "array<variant>"))
    known = F.filter(items, lambda x: _text(x).isNotNull() | F.startswith(F.to_json(x), F.lit("{")))
    read = F.transform(known, lambda x: F.when(_text(x).isNotNull(), _cited(_text(x), F.lit(None).cast("string"))).otherwise(_cited(_text(member(x, "url")), _text(member(x, "domain")))))
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    by_line = F.transform(lines, lambda x: _cited(x, F.lit(None).cast("string")))
    none = F.expr(_NONE)
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", none).when(v.isNull(), by_line).otherwise(F.coalesce(read, none))


def explicit_urls(answer: Column) -> Column:
    """array<struct(url, domain)>: the distinct addresses that an answer spells out, without closing punctuation."""
    plain = F.replace(F.replace(F.coalesce(answer, F.lit("")), F.lit("\\:"), F.lit(":")), F.lit("\\/"), F.lit("/"))
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"""(https?://[^\s<>"\])]+)"""), F.lit(1)), lambda u: F.regexp_replace(u, """[.,;:'"]+$""", ""))
    return F.filter(F.transform(F.array_distinct(found), lambda u: _cited(u, F.lit(None).cast("string"))), lambda c: c["domain"].isNotNull())


def cited_sources(citations: Column, answer: Column) -> Column:
    """The citations that a provider lists, or, where none of them has a domain, the addresses in its answer."""
    listed = parse_citations(citations)
    return F.when(F.exists(listed, lambda c: c["domain"].isNotNull()), listed).otherwise(explicit_urls(answer))
