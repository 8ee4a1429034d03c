"""Feature arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# PE sections and the fields taken from each, in feature order.
SECTIONS = (".text", ".data", ".rsrc", ".rdata")
SECTION_FIELDS = ("entropy", "virt_address", "virt_size", "size")

# Least sequence length of the opcode features, and the width of their one-hot form.
SEQUENCE_LENGTH = 10_000
CLASSIFIER_CODES = 120

#: Codes that are counted at a time, besides those of the first row.
CODES_AT_ONCE = 1 << 17

# The opcode list; a code is the position in it, from 1.
X86_OPCODES = """
aaa aad aam aas adc add and call cbw clc cld cli cmc cmp cmpsb cmpsw cwd daa das dec div esc hlt
idiv imul in inc int into iret ja jae jb jbe jc jcxz je jg jge jl jle jna jnae jnb jnbe jnc jne jng
jnge jnl jnle jno jnp jns jnz jo jp jpe jpo js jz jmp lahf lds lea les lock lodsb lodsw loop loope
loopne loopnz loopz mov movsb movsw mul neg nop not or out pop popf push pushf rcl rcr rep repe
repne repnz repz ret retn retf rol ror sahf sal sar sbb scasb scasw shl shr stc std sti stosb stosw
sub test wait xchg xlat xor (bad)
""".split()


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def hex_to_double(text: Column) -> Column:
    """`0x...` as a number; no 31-bit limit."""
    return F.conv(F.substring(text, 3, 64), 16, 10).cast("double")


def section_numbers(sections: Column, timestamp: Column) -> Column:
    """The 17 PE numbers: four fields of four sections, then the timestamp.

    Section names are compared without NUL padding; of a repeated name the last one counts; what is
    missing is 0. Everything is taken from the row's own array.
    """

    def number(section: Column, field: str) -> Column:
        value = section[field]
        value = hex_to_double(value) if field == "virt_address" else value
        return F.coalesce(value, F.lit(0.0))

    def last_of(named: Column, name: str) -> Column:
        last = F.try_element_at(F.filter(named, lambda s: s["section_name"] == name), F.lit(-1))
        return bind(last, lambda s: F.array(*[number(s, field) for field in SECTION_FIELDS]))

    plain = F.transform(
        sections,
        lambda s: s.withField("section_name", F.replace(s["section_name"], F.lit("\0"), F.lit(""))),
    )
    fields = bind(plain, lambda named: F.concat(*[last_of(named, name) for name in SECTIONS]))
    return F.concat(fields, F.array(F.coalesce(timestamp, F.lit(0.0))))


def multi_hot(indices: Column, size: int | Column) -> Column:
    """0/1 array of the given length with ones at the indices, which are sorted and distinct.

    Built from runs of zeros that each end in a one, so the work grows with the length only.
    """
    size = F.lit(size) if isinstance(size, int) else size
    last = F.coalesce(F.try_element_at(indices, F.lit(-1)), F.lit(-1))
    runs = F.transform(
        indices,
        lambda x, i: F.concat(
            zeros(x - F.coalesce(F.get(indices, i - 1), F.lit(-1)) - 1), F.array(F.lit(1.0))
        ),
    )
    return F.concat(F.flatten(runs), zeros(size - last - 1))


def scattered(indices: Column, values: Column, size: int | Column) -> Column:
    """array<double> of the given length with the values at the indices, which are sorted and distinct, and 0 elsewhere."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.coalesce(F.try_element_at(indices, F.lit(-1)), F.lit(-1))
    runs = F.transform(
        indices,
        lambda x, i: F.concat(
            zeros(x - F.coalesce(F.get(indices, i - 1), F.lit(-1)) - 1), F.array(F.get(values, i))
        ),
    )
    return F.concat(F.flatten(runs), zeros(size - last - 1))


def one_hot(number: Column, size: int) -> Column:
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(slots, lambda i: (i == number).cast("double"))


def arg_max(array: Column) -> Column:
    """Position from 0 of the greatest element, the first of equals."""
    return F.array_position(array, F.array_max(array)) - 1


def codes(terms: Column, vocabulary: list[str] | tuple[str, ...]) -> Column:
    """Position from 1 of each term in a short fixed list; unknown terms are 0."""
    listed = F.array(*[F.lit(v) for v in vocabulary])
    return F.transform(terms, lambda t: F.array_position(listed, t).cast("double"))


def term_positions(terms: Column) -> Column:
    """array<struct<term, positions>>: the distinct terms of an array<string>, each with its places from 0.

    A null term is the empty text; NULL has no terms. One Arrow pass: terms are numbered by dictionary and sorted
    by (row, number).
    """

    @F.arrow_udf("array<struct<term:string,positions:array<int>>>")
    def positions(lists: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.fill_null(lists.flatten(), "").dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = row * max(1, len(coded.dictionary)) + number
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = pa.array(np.append(heads, len(key)), pa.int32())
        spots = pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32()))
        distinct = coded.dictionary.take(pa.array(number[order][heads]))
        entries = pa.StructArray.from_arrays([distinct, spots], ["term", "positions"])
        bounds = np.searchsorted(row[order][heads], np.arange(len(counts) + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries)

    return positions(terms)


def codes_by_position(entries: Column) -> Column:
    """array<double> from array<struct<code, positions>>: each code at its places. Position and code are sorted as one long."""
    places = F.transform(
        entries,
        lambda e: F.transform(e["positions"], lambda p: F.shiftleft(p.cast("long"), 32) + e["code"]),
    )
    return F.transform(F.sort_array(F.flatten(places)), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))


def padded(array: Column, length: int | Column) -> Column:
    """Pad with 0 up to a length; longer arrays stay whole."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(array, zeros(F.greatest(F.lit(0), length - F.size(array))))


def flatten_lists(lists: Column) -> Column:
    """Join several lists, null lists left out."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def position_one_hot(array: Column, width: int = CLASSIFIER_CODES) -> Column:
    """Indices of the ones in the flattened position-by-code image of a code sequence."""
    return F.transform(array, lambda c, i: (i * width + c).cast("int"))


def code_counts(array: Column, width: int = CLASSIFIER_CODES) -> Column:
    """How often each code occurs in a code sequence; NULLs for NULL.

    One Arrow pass over the codes, some rows at a time.
    """

    @F.arrow_udf("array<double>")
    def counts(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        given = pc.fill_null(lists.flatten().cast(pa.float64()), -1).to_numpy(zero_copy_only=False)
        found = np.zeros((len(sizes), width))
        cuts = [0, *(np.flatnonzero(np.diff(ends[1:] // CODES_AT_ONCE)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            part, row = given[ends[a] : ends[b]], np.repeat(np.arange(b - a), sizes[a:b])
            own = (part >= 0) & (part < width) & (part == np.floor(part))
            slots = row[own] * width + part[own].astype(np.int64)
            found[a:b] = np.bincount(slots, minlength=(b - a) * width).reshape(b - a, width)
        missing = np.repeat(lists.is_null().to_numpy(zero_copy_only=False), width)
        bounds = pa.array(np.arange(len(sizes) + 1) * width, pa.int32())
        return pa.ListArray.from_arrays(bounds, pa.array(found.ravel(), mask=missing))

    return counts(array)
