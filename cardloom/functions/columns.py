"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.constants import (
    COLORLESS,
    COLORS,
    DECK_NAME_LENGTH,
    MAX_COPIES_PER_ADD,
    ROLE_ORDER,
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def no_strings() -> Column:
    """An empty array<string>."""
    return F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference inside a lambda would be worked out again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- color identity -------------------------------------------------------


def identity_mask(identity: Column | str) -> Column:
    """Identity array -> INT mask over COLORS; NULL counts as no colors."""
    known = F.coalesce(_col(identity), no_strings())
    bits = [
        F.when(F.array_contains(known, color), F.lit(1 << i)).otherwise(F.lit(0))
        for i, color in enumerate(COLORS)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def mask_colors(mask: Column | str) -> Column:
    """INT mask -> array of color symbols in canonical order."""
    bit_set = [F.when(_col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(COLORS)]
    return F.array_compact(F.array(*bit_set))


def mask_within(mask: Column | str, allowed: Column | str) -> Column:
    """Every color of ``mask`` is in ``allowed``."""
    return _col(mask).bitwiseAND(F.bitwise_not(_col(allowed))) == 0


def mask_of(colors: list[str]) -> int:
    return sum(1 << COLORS.index(c) for c in colors)


# --- type predicates ------------------------------------------------------


def is_land(type_line: Column | str = "type_line") -> Column:
    return _col(type_line).contains("Land")


def is_basic_land(type_line: Column | str = "type_line") -> Column:
    return _col(type_line).contains("Basic Land")


def is_nonbasic_land(type_line: Column | str = "type_line") -> Column:
    return is_land(type_line) & ~_col(type_line).contains("Basic")


def can_lead(type_line: Column | str = "type_line") -> Column:
    """Commander-eligible: legendary creature."""
    return _col(type_line).contains("Legendary") & _col(type_line).contains("Creature")


# --- text -----------------------------------------------------------------


def trim_all(text: Column | str) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"^\s+", ""), r"\s+$", "")


def folded(text: Column | str) -> Column:
    return F.lower(trim_all(text))


def mana_symbols(mana_cost: Column | str) -> Column:
    """All ``{...}`` groups of a mana cost; empty array for blank or NULL."""
    return F.regexp_extract_all(F.coalesce(_col(mana_cost), F.lit("")), F.lit(r"\{([^}]+)\}"), F.lit(1))


def symbol_label(symbol: Column | str) -> Column:
    """Display label: a longer symbol loses its first slash only."""
    s = _col(symbol)
    slash = F.instr(s, "/")
    cut = F.concat(F.substring(s, F.lit(1), slash - 1), F.substring(s, slash + 1, F.length(s)))
    return F.when((F.length(s) > 1) & (slash > 0), cut).otherwise(s)


def default_deck_name(commander_name: Column | str) -> Column:
    return F.coalesce(F.concat(_col(commander_name), F.lit(" deck")), F.lit("Untitled deck"))


def saved_deck_name(name: Column | str) -> Column:
    """Trimmed; NULL when nothing is left or when it is longer than a name may be."""
    trimmed = trim_all(name)
    return F.when((F.length(trimmed) > 0) & (F.length(trimmed) <= DECK_NAME_LENGTH), trimmed)


def display_date(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "MMM d, yyyy")


# --- numbers --------------------------------------------------------------


def clamp_copies(quantity: Column | str) -> Column:
    """Copies of one add command: between 1 and 99."""
    return F.least(F.lit(MAX_COPIES_PER_ADD), F.greatest(F.lit(1), _col(quantity)))


# --- sort keys ------------------------------------------------------------


def color_sort_key(type_line: Column | str = "type_line", identity: Column | str = "color_identity") -> Column:
    """Land 7, colorless 6, multicolor 5, else position of the one color (-1 unknown)."""
    colors = F.coalesce(_col(identity), no_strings())
    order = F.array(*[F.lit(c) for c in COLORS])
    return (
        F.when(is_land(type_line), F.lit(7))
        .when(F.size(colors) == 0, F.lit(6))
        .when(F.size(colors) > 1, F.lit(5))
        .otherwise((F.array_position(order, F.get(colors, F.lit(0))) - 1).cast("int"))
    )


def name_key(name: Column | str = "name") -> Column:
    """Locale-like name order."""
    return F.collate(_col(name), "UNICODE")


def role_order_key(role: Column | str) -> Column:
    """Known roles by their listed position, unknown ones after them, Land last."""
    known = F.array(*[F.lit(r) for r in ROLE_ORDER if r != "Land"])
    position = F.array_position(known, _col(role)).cast("int")
    return (
        F.when(_col(role) == "Land", F.lit(len(ROLE_ORDER) + 1))
        .when(position > 0, position)
        .otherwise(F.lit(len(ROLE_ORDER)))
    )


def matches_colors(identity: Column | str, selected: list[str]) -> Column:
    """Any overlap with the selection; ``C`` selects the colorless."""
    colors = F.coalesce(_col(identity), no_strings())
    wanted = F.array(*[F.lit(c) for c in selected])
    hit = F.arrays_overlap(colors, wanted)
    if COLORLESS in selected:
        hit = hit | (F.size(colors) == 0)
    return hit
