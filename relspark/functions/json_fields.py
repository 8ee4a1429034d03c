"""Fields of the JSON results. Known shapes are parsed by Spark into typed structs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions.arrow_slices import by_slices, in_slices

# Sentinels and member names of the service results.
UNDEFINED = "Undefined"
NO_SIGNATURE = "NONE"
SIGNATURE_KEY = "Signature"
URL_RECORD, URL_PATH = "Data", ("arguments", "url")
OPCODES = "opcodes"

PEINFO = {
    "pehash": "variant",
    "imphash": "variant",
    "version_info": "array<struct<key:string,value:string>>",
    "timestamp": "struct<timestamp:double>",
    "pe_sections": "array<struct<section_name:string,entropy:double,virt_address:string,"
    "virt_size:double,size:double>>",
    "imports": "array<struct<dll:string,function:string>>",
}
SECTION_MEMBERS = ("section_name", "entropy", "virt_address", "virt_size", "size")
DETECTIONS = "scans map<string,struct<result:string>>"


def parse_peinfo(text: Column, *fields: str) -> Column:
    """The named members of a PE result; the others are skipped by the parser."""
    return F.from_json(text, ", ".join(f"{name} {PEINFO[name]}" for name in fields))


def string_only(member: Column) -> Column:
    """The text of a variant member if it is a JSON string other than the sentinel, else NULL."""
    text = F.variant_get(member, "$", "string")
    kept = (F.schema_of_variant(member) == "STRING") & (text != UNDEFINED)
    return F.when(kept, text)


def string_member(text: Column, name: str) -> Column:
    """A top-level member of a JSON text if it is a JSON string other than the sentinel."""
    return string_only(F.variant_get(F.try_parse_json(text), f"$.{name}", "variant"))


def member_or(text: Column, path: str, default: float) -> Column:
    """A numeric member, or the default where it is missing."""
    return F.coalesce(F.get_json_object(text, path).cast("double"), F.lit(default))


def _members(text: Column, name: str) -> Column:
    """How often a member name stands in a JSON text, at any depth."""
    return F.regexp_count(text, F.lit(f'"{name}"\\s*:'))


def _known(values: Column) -> Column:
    """How many members the parser has found: if as many as the text has, none lies elsewhere."""
    return F.coalesce(F.size(F.filter(values, lambda v: v.isNotNull())), F.lit(-1))


def first_signature(text: Column, version_info: Column) -> Column:
    """The value of the first {key, value} record whose key names a signature, without quotes.

    `version_info` is the parsed member of `text`. Records that lie deeper than one list are searched
    for in the text: keys and values at any depth below the member, paired in document order.
    """
    def seen(name: str) -> Column:
        return _known(F.transform(version_info, lambda r: r[name]))

    flat = (_members(text, "key") == seen("key")) & (_members(text, "value") == seen("value"))
    nested = F.when(~flat & text.contains('"version_info"'), text)
    keys = json_find_all(nested, "key", within="version_info")
    values = json_find_all(nested, "value", within="version_info")
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    records = F.when(nested.isNull(), version_info).otherwise(pairs)
    hit = F.filter(records, lambda r: F.contains(r["key"], F.lit(SIGNATURE_KEY)))
    value = F.replace(F.get(hit, F.lit(0))["value"], F.lit('"'), F.lit(""))
    return F.when(value != NO_SIGNATURE, value)


def detection_names(text: Column) -> Column:
    """The non-null vendor results of a scan report, at any depth below `scans`."""
    results = F.transform(F.map_values(F.from_json(text, DETECTIONS)["scans"]), lambda s: s["result"])
    flat = _members(text, "result") == _known(results)
    nested = F.when(~flat & text.contains('"scans"'), text)
    found = F.when(nested.isNull(), results).otherwise(json_find_all(nested, "result", within="scans"))
    return F.filter(found, lambda r: r.isNotNull())


def pe_layout(text: Column, parsed: Column) -> Column:
    """struct<sections, timestamp> of a PE result parsed with `pe_sections` and `timestamp`.

    Flat records keep what the parser found. If the text has more section members than that, they lie
    deeper, and one walk below `pe_sections` pairs the n-th name with the n-th entropy, address and sizes in
    document order; what is missing is NULL. A timestamp not directly below its member is the first at any depth below it.
    """
    sections, stamp = parsed["pe_sections"], parsed["timestamp"]["timestamp"]

    def seen(name: str) -> Column:
        return F.greatest(_known(F.transform(sections, lambda s: s[name])), F.lit(0))

    def whole(section: Column) -> Column:
        held = F.lit(True)
        for name in SECTION_MEMBERS:
            held &= section[name].isNotNull()
        return held

    # cheap first: whole records, and no section name elsewhere
    flat = F.coalesce(F.forall(sections, whole), F.lit(False)) & (_members(text, "section_name") == F.size(sections))
    same = F.lit(True)
    for name in SECTION_MEMBERS:
        same &= _members(text, name) == seen(name)
    flat |= same
    deep_sections = ~flat & text.contains('"pe_sections"')
    deep_stamp = stamp.isNull() & (_members(text, "timestamp") > 1)
    walked = _walk_pe(F.when(deep_sections | deep_stamp, text))
    return F.struct(
        F.when(deep_sections, walked["sections"]).otherwise(sections).alias("sections"),
        F.coalesce(stamp, walked["timestamp"]).alias("timestamp"),
    )


def _number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _paired_sections(value: object) -> list[dict] | None:
    """Section records of what lies below the member, their fields paired by order."""
    if value is None:
        return None
    found = {name: _find(value, name) for name in SECTION_MEMBERS}
    text_members = ("section_name", "virt_address")

    def field(name: str, i: int) -> str | float | None:
        member = found[name][i] if i < len(found[name]) else None
        return _as_text(member) if name in text_members else _number(member)

    return [{name: field(name, i) for name in SECTION_MEMBERS} for i in range(len(found["section_name"]))]


def _walk_pe(text: Column) -> Column:
    kept = f"sections {PEINFO['pe_sections']}, timestamp double"
    section = pa.struct([(n, pa.string() if n in ("section_name", "virt_address") else pa.float64()) for n in SECTION_MEMBERS])
    shape = pa.struct([("sections", pa.list_(section)), ("timestamp", pa.float64())])

    def records(texts: pa.Array) -> pa.Array:
        rows = []
        for one in texts.to_pylist():
            value = _parsed(one)[1]
            stamps = _find(_follow(value, ("timestamp",)), "timestamp")
            sections = _paired_sections(_follow(value, ("pe_sections",)))
            rows.append({"sections": sections, "timestamp": _number(stamps[0]) if stamps else None})
        return pa.array(rows, shape)

    @F.arrow_udf(kept)
    def walk(texts: pa.Array) -> pa.Array:
        return by_slices(records, texts)

    return walk(text)


def _find(root: object, name: str) -> list:
    """Members called `name` at any depth, in document order, without recursion."""
    found, waiting = [], [(None, root)]
    while waiting:
        key, node = waiting.pop()
        if key == name:
            found.append(node)
        if isinstance(node, dict):
            waiting.extend(reversed(node.items()))
        elif isinstance(node, list):
            waiting.extend((None, value) for value in reversed(node))
    return found


def _parsed(text: str | None) -> tuple[bool, object]:
    """(whether it is JSON of a depth that can be read, the value)."""
    try:
        return (False, None) if text is None else (True, json.loads(text))
    except (ValueError, RecursionError):
        return False, None


def _follow(node: object, path: tuple[str, ...]) -> object:
    for step in path:
        node = node.get(step) if isinstance(node, dict) else None
    return node


def _as_text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _as_list(value: object) -> list | None:
    return [_as_text(v) for v in value] if isinstance(value, list) else None


def _find_all(
    text: Column, name: str, path: tuple[str, ...], make, item: pa.DataType, within: str | None = None
) -> Column:
    """Arrow UDF: `make` of what lies under the path in each hit, below the top-level member `within`."""
    kept = T.ArrayType(T.StringType()) if item == pa.list_(pa.string()) else T.StringType()

    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for one in texts.to_pylist():
            known, value = _parsed(one)
            if within is not None:
                value = _follow(value, (within,))
            rows.append([make(_follow(hit, path)) for hit in _find(value, name)] if known else None)
        return pa.array(rows, pa.list_(item))

    @F.arrow_udf(T.ArrayType(kept))
    def find_all(texts: pa.Array) -> pa.Array:
        return by_slices(found, texts)

    return find_all(text)


def json_find_all(
    text: Column, name: str, path: tuple[str, ...] = (), within: str | None = None
) -> Column:
    """Every member called `name` at any depth in document order, as array<string>.

    With a path, what lies under it in each hit; with `within`, only below that top-level member. Strings are given bare, other values as JSON text,
    null and missing as NULL; text that is no JSON, or nested too deep to read, gives NULL. JSON paths in Spark cannot search at unknown depth, so this runs in
    Python on Arrow batches.
    """
    return _find_all(text, name, path, _as_text, pa.string(), within)


def json_find_lists(text: Column, name: str) -> Column:
    """Every list called `name` at any depth, as array<array<string>>; what is no list is NULL."""
    return _find_all(text, name, (), _as_list, pa.list_(pa.string()))


def called_urls(text: Column) -> Column:
    """The URLs requested in a sandbox report, as array<string>."""
    return F.filter(json_find_all(text, URL_RECORD, URL_PATH), lambda u: u.isNotNull())


def opcode_lists(text: Column) -> Column:
    """The opcode lists of a disassembly as array<array<string>>; a null list stays NULL."""
    return json_find_lists(text, OPCODES)


def opcode_codes(text: Column, terms: Sequence[str]) -> Column:
    """The opcodes of a disassembly as array<int>: positions from 1 in a fixed list, 0 for others; null lists left out.

    NULL without opcode lists. Names are coded where they are found, by dictionary: no text goes back to Spark.
    """
    known = pa.array(list(terms), pa.string())

    def coded_lists(texts: pa.Array) -> pa.Array:
        names: list[str | None] = []
        ends, missing = [0], []
        for one in texts.to_pylist():
            readable, value = _parsed(one)
            lists = _find(value, OPCODES) if readable else []
            for found in lists:
                if isinstance(found, list):
                    names.extend(found)
            missing.append(not lists)
            ends.append(len(names))
        if not all(x is None or isinstance(x, str) for x in names):
            names = [_as_text(x) for x in names]
        coded = pa.array(names, pa.string()).dictionary_encode()
        place = pc.add(pc.fill_null(pc.index_in(coded.dictionary, known), -1), 1)
        codes = place.take(coded.indices).cast(pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), codes, mask=pa.array(missing, pa.bool_()))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_slices(coded_lists, batches)

    return code(text)
