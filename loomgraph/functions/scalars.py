"""Scalar functions of the text formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_TYPES = ("FF", "FR", "RF", "RR")
#: What a weight must look like to count as a number.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def split_fields(line: Column, delimiter: str) -> Column:
    """Fields of a line: inner empty fields stay, one empty field at the end goes, an empty line has none."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiter)
    parts = F.split(line, quoted)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def field(fields: Column, i: int) -> Column:
    """The 0-based i-th field, null if there are fewer."""
    return F.get(fields, F.lit(i))


def leading_integer(text: Column) -> Column:
    """The integer at the start of the text, such as 60 of 60M; null if there is none."""
    digits = F.regexp_extract(text, r"^\s*\+?(\d+)", 1)
    return F.when(digits != "", digits.cast("bigint"))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER), F.lit(False))


def edge_weight(text: Column) -> Column:
    """The third field of an edge: its number, else 1.0."""
    return F.when(is_number(text), F.trim(text).cast("double")).otherwise(F.lit(1.0))


def step_name(step: Column) -> Column:
    return F.substring(step, F.lit(1), F.length(step) - 1)


def step_orientation(step: Column) -> Column:
    return F.right(step, F.lit(1))


def path_reference(name: Column) -> Column:
    """What stands between ``Reference:`` and ``_Sequence:``."""
    return F.regexp_extract(name, "Reference:(.*?)_Sequence:", 1)


def path_sequence(name: Column) -> Column:
    """What follows ``_Sequence:``."""
    return F.regexp_extract(name, "Reference:.*?_Sequence:(.*)$", 1)


def edge_type(from_orient: Column, to_orient: Column) -> Column:
    """Orientations + and - as F and R."""
    return F.translate(F.concat(from_orient, to_orient), "+-", "FR")


def canonical_type(from_id: Column, to_id: Column, kind: Column) -> Column:
    """The type of the link whose ids are in order: if they are swapped, FF and RR change places."""
    flipped = F.when(kind == "FF", "RR").when(kind == "RR", "FF").otherwise(kind)
    return F.when(from_id > to_id, flipped).otherwise(kind)


def source_side(unitig: Column, kind: Column) -> Column:
    """The node (2u left, 2u+1 right) that a link leaves from."""
    return unitig * 2 + (F.substring(kind, 1, 1) == "F").cast("bigint")


def target_side(unitig: Column, kind: Column) -> Column:
    """The node that a link arrives at."""
    return unitig * 2 + (F.substring(kind, 2, 1) == "R").cast("bigint")


def other_side(node: Column) -> Column:
    return node.bitwiseXOR(F.lit(1))


def fixed_distance(distance: Column, limit: float | None = None) -> Column:
    """Unreachable (null, or at least the limit) as -1."""
    reached = distance if limit is None else F.when(distance < limit, distance)
    return F.coalesce(reached, F.lit(-1.0))


def whole(distance: Column) -> Column:
    """Towards zero, as written to text files."""
    return distance.cast("bigint")


def presence(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) > 0, "c").otherwise("a")


def spaced_thousands(number: Column) -> Column:
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def grouped_digits(number: int | None) -> str:
    """As spaced_thousands, for a number of the driver's."""
    return f"{number or 0:,}".replace(",", " ")


def truncated_ratio(numerator: Column, denominator: Column) -> Column:
    """Two decimals, cut off."""
    return F.floor(numerator * 100 / denominator) / 100


def significant(number: Column, digits: int = 6) -> Column:
    """A number as C's %g prints it."""
    scientific = F.format_string(f"%.{digits - 1}e", number.cast("double"))
    mantissa, power = F.substring_index(scientific, "e", 1), F.substring_index(scientific, "e", -1).try_cast("int")
    short = lambda x: F.when(F.instr(x, ".") > 0, F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    places = [F.format_string(f"%.{p}f", number.cast("double")) for p in range(digits + 4)]
    fixed = places[-1]
    for p in range(digits + 3, -1, -1):
        fixed = F.when(power >= digits - 1 - p, places[p]).otherwise(fixed)
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exponent = F.when(F.abs(power) > 99, F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(exponent)
    shown = F.when((power < -4) | (power >= digits), F.concat(short(mantissa), exponent)).otherwise(short(fixed))
    return F.when(number.isNotNull(), shown)


def axis_exponent(max_distance: Column) -> Column:
    """Power of ten of a plot's distance axis; halves go to the even number."""
    return F.bround(F.log10(max_distance), 0).cast("int") - 1


def thousands(count: Column) -> Column:
    return F.floor(count / 1000)


def elapsed(seconds: float) -> str:
    """Time as 1h2m3s, without leading parts that are zero."""
    s = int(seconds)
    parts = [(s // 86400, "d"), (s // 3600 % 24, "h"), (s // 60 % 60, "m"), (s % 60, "s")]
    while len(parts) > 1 and not parts[0][0]:
        parts.pop(0)
    return "".join(f"{n}{u}" for n, u in parts)
