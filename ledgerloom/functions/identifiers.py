"""Tax ids, state codes and invoice numbers, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.plans.fixed import STATE_ALIASES, STATE_NAMES

GSTIN_PATTERN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHORTEST_RUN = 3


def gstin(cell: Column) -> Column:
    return F.upper(F.trim(cell.cast("string")))


def is_gstin(value: Column) -> Column:
    return value.rlike(GSTIN_PATTERN)


def gstin_check_digit(value: Column) -> Column:
    """Check character of the first 14: alternating factors 1 and 2, base-36 digit sums. Null for other characters."""
    weighted = F.transform(
        F.sequence(F.lit(1), F.lit(14)),
        lambda i: (F.instr(F.lit(_ALPHABET), F.substr(value, i, F.lit(1))) - 1) * (F.when(i % 2 == 1, 1).otherwise(2)),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, p: acc + F.floor(p / 36).cast("int") + p % 36)
    return F.when(value.rlike("^[0-9A-Z]{14}"), F.substr(F.lit(_ALPHABET), (36 - total % 36) % 36 + 1, F.lit(1)))


def has_valid_checksum(value: Column) -> Column:
    return is_gstin(value) & (gstin_check_digit(value) == F.substr(value, F.lit(15), F.lit(1)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def state_of_gstin(value: Column) -> Column:
    code = F.substring(value, 1, 2)
    return F.when(code.isin(*STATE_NAMES), code)


def state_of_place(place: Column) -> Column:
    """State code of ``27-Maharashtra``, or of a state's name or an alias of it."""
    text = F.trim(place)
    code = F.regexp_extract(text, r"^(\d{2})\s*[-–—]", 1)
    name = F.trim(F.regexp_replace(F.lower(text), r"^\d{2}\s*[-–—]\s*", ""))
    by_name = {state.lower(): number for number, state in STATE_NAMES.items()}  # a later code of one name counts
    return F.when(code.isin(*STATE_NAMES), code).otherwise(_lookup(by_name | STATE_ALIASES, name))


def identifier(cell: Column) -> Column:
    """An invoice or voucher number as it is compared: upper case, no blanks around it."""
    return F.upper(F.trim(F.coalesce(cell.cast("string"), F.lit(""))))


def strip_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def plain_number(value: Column) -> Column:
    """The number without leading zeros if the identifier is digits alone, else null."""
    return F.when(value.rlike(r"^\d+$"), strip_zeros(value))


def duplicate_key(value: Column) -> Column:
    """Plain numbers lose leading zeros; other identifiers stay as they are."""
    return F.coalesce(plain_number(value), value)


def digit_runs(value: Column, shortest: int = 1) -> Column:
    runs = F.filter(F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1)), lambda run: F.length(run) >= shortest)
    return F.transform(runs, strip_zeros)


def skeleton(value: Column) -> Column:
    return F.regexp_replace(value, r"\d+", "#")


def segments(value: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.upper(F.trim(value)), r"[-/]+", "-"), "-"), lambda s: s != "")


def _at(parts: Column, index: Column) -> Column:
    return F.get(parts, index)


def normalized_number(value: Column) -> Column:
    """Segments joined by ``-``; ``21-22`` and other years that follow each other read ``2021-22``."""
    parts = segments(value)

    def widened(part: Column, i: Column) -> Column:
        after = _at(parts, i + 1)
        follows = part.rlike(r"^\d{2}$") & F.coalesce(after.rlike(r"^\d{2}$"), F.lit(False)) & ((part.try_cast("int") + 1) % 100 == after.try_cast("int"))
        return F.when(follows, F.concat(F.lit("20"), part)).otherwise(part)

    return F.array_join(F.transform(parts, widened), "-")


def core_segments(value: Column) -> Column:
    """Segments without year pairs: a year (two digits, or 2000 to 2099) and the one or two digits behind it."""
    parts = segments(value)
    year = lambda s: s.rlike(r"^(\d{2}|20\d{2})$")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(state: Column, i: Column) -> Column:
        part, after = _at(parts, i), _at(parts, i + 1)
        pair = ~state["skip"] & year(part) & F.coalesce(after.rlike(r"^\d{1,2}$"), F.lit(False))
        kept = F.when(state["skip"] | pair, state["kept"]).otherwise(F.concat(state["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), pair.alias("skip"))

    places = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda state: state["kept"])


def numbers_agree(a: Column, b: Column, core_a: Column, core_b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Whether two invoice numbers may be one: equal when normalized, or equal cores whose last compared segment may be cut short."""
    least = F.least(F.size(core_a), F.size(core_b))
    heads = F.slice(core_a, F.lit(1), F.greatest(least - 1, F.lit(0))) == F.slice(core_b, F.lit(1), F.greatest(least - 1, F.lit(0)))
    last_a, last_b = F.get(core_a, least - 1), F.get(core_b, least - 1)
    return (norm_a == norm_b) | ((least > 0) & heads & (F.startswith(last_a, last_b) | F.startswith(last_b, last_a)))


def near_sequential(a: Column, b: Column, most: Column) -> Column:
    """Same shape and exactly one run of digits that differs, by ``most`` at most. Runs compare as written."""
    runs_a, runs_b = (F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)) for x in (a, b))
    pairs = F.filter(F.arrays_zip(runs_a.alias("x"), runs_b.alias("y")), lambda p: p["x"] != p["y"])
    only = F.get(pairs, F.lit(0))
    close = F.abs(only["x"].try_cast("decimal(38,0)") - only["y"].try_cast("decimal(38,0)")).cast("double") <= most
    return (a != "") & (b != "") & (skeleton(a) == skeleton(b)) & (F.size(pairs) == 1) & F.coalesce(close, F.lit(False))


def similarity_percent(a: Column, b: Column) -> Column:
    """Edit similarity of two names in percent, halves rounded up; case and outer blanks do not count."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(100)).otherwise(F.floor((1 - F.levenshtein(x, y) / longest) * 100 + 0.5).cast("int"))
