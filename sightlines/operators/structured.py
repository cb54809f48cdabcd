"""Structured data of pages: the typed nodes of their JSON-LD, reached through `@graph` and `mainEntity`.

A script holds a node, or lists of them, and nodes hold others; how deep is not known
before.  Each round takes one level of VARIANT values apart, for all pages at once, until none is
left.  Equal scripts are walked once, whatever the number of pages that carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a node that lead to further nodes.
INTO = ("@graph", "mainEntity")
#: Types that stand for whoever is responsible, and what they should say.
RESPONSIBLE, TOLD = ("Organization", "Person"), ("name", "url", "sameAs")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string, variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _keep(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def text_of(value: Column) -> Column:
    """A member as text, null where it is absent or null."""
    return F.try_variant_get(value, "$", "string")


def says(value: Column) -> Column:
    """Whether a member says anything: not absent, null, blank, an empty list or a list of one such value."""
    items = _list(value)
    blank = lambda v: F.coalesce(F.trim(text_of(v)), F.lit("")) == ""
    return F.when(items.isNotNull(), (F.size(items) > 1) | ((F.size(items) == 1) & ~blank(F.get(items, F.lit(0))))).otherwise(~blank(value))


def node_types(members: Column) -> Column:
    """The types of a node, one or a list."""
    given = F.try_element_at(members, F.lit("@type"))
    one = F.when(F.startswith(F.to_json(given), F.lit('"')), F.array(text_of(given)))
    return F.coalesce(F.transform(_list(given), text_of), one, F.expr("cast(array() as array<string>)"))


def nodes(scripts: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """key, place, types, fields and members (a map of VARIANT) of every node in scripts (key, body).

    place: the way to the node, as in `$.@graph[2].mainEntity`.  A body that is no JSON has no nodes.
    """
    v = F.col("v")
    found, level = None, _keep(scripts.select(F.col(key).alias("key"), F.lit("$").alias("place"), F.try_parse_json(F.trim(body)).alias("v")).filter("v is not null"))
    while True:
        apart = level.select("key", "place", _object(v).alias("members"), _list(v).alias("items"))
        own = apart.filter("members is not null").select("key", "place", "members")
        found = own if found is None else found.unionByName(own)
        inner = F.filter(F.array(*[F.struct(F.lit(f".{m}").alias("step"), F.try_element_at("members", F.lit(m)).alias("v")) for m in INTO]), lambda x: x["v"].isNotNull())
        listed = F.transform("items", lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), x.alias("v")))
        below = apart.select("key", "place", F.explode(F.coalesce(listed, inner)).alias("x")).select("key", F.concat("place", "x.step").alias("place"), "x.v")
        level = _keep(below.filter(_object(v).isNotNull() | _list(v).isNotNull()))
        if not level.limit(1).count():
            break
    return found.select("key", "place", node_types(F.col("members")).alias("types"), F.array_sort(F.map_keys("members")).alias("fields"), "members")


def organization_gaps(nodes_: DataFrame) -> DataFrame:
    """key, place and what each responsible node leaves unsaid."""
    member = lambda m: F.try_element_at("members", F.lit(m))

    def told(m: str) -> Column:
        items = _list(member(m))
        return F.when(items.isNotNull(), F.size(items) > 0).otherwise(says(member(m))) if m == "sameAs" else says(member(m))

    missing = F.array_compact(F.array(*[F.when(~told(m), m) for m in TOLD]))
    return nodes_.filter(F.arrays_overlap("types", F.array(*map(F.lit, RESPONSIBLE)))).select("key", "place", missing.alias("missing"))


def script_key(jsonld: Column) -> Column:
    """Known by content, so that equal scripts are walked once; null where a page has none."""
    return F.when(F.size(jsonld) > 0, F.sha2(F.array_join(jsonld, "\x1e").cast("binary"), 256))


def page_structure(facts: DataFrame) -> DataFrame:
    """key (`script_key` of jsonld), types, fields and names of all its nodes, and organization_gap: whether a responsible one leaves anything unsaid."""
    scripts = facts.select(script_key(F.col("jsonld")).alias("key"), "jsonld").filter("key is not null").groupBy("key").agg(F.any_value("jsonld").alias("jsonld"))
    all_ = nodes(scripts.select("key", F.explode("jsonld").alias("body")))
    gap = organization_gaps(all_).groupBy("key").agg(F.max(F.size("missing") > 0).alias("organization_gap"))
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    name = text_of(F.try_element_at("members", F.lit("name")))
    whole = all_.groupBy("key").agg(distinct("types").alias("types"), distinct("fields").alias("fields"), F.collect_set(F.when(F.trim(name) != "", F.trim(name))).alias("names"))
    return whole.join(gap, "key", "left").fillna(False, ["organization_gap"])
