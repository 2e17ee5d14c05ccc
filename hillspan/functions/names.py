"""Variant names: what they encode, and the labels made of it. All are expressions over string columns.

A name is `original`, `rot_<sign><degrees>p<hundredths>deg`, `trans_<metres>m_a<sign><angle>` or `scale_<ns|ew>_<factor>`,
with p for the decimal point, an optional prefix graph_ and an optional suffix .pkl.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of variant names.
ROTATION = r"^rot_([+-])(\d+)p(\d+)deg$"
TRANSLATION = r"^trans_(\d+)m_a([+-])(\d+)$"
SCALE = r"^scale_(ns|ew)_(\d+)p(\d+)$"
#: Translations below this length (m) do not count.
SHORTEST_TRANSLATION_M = 200.0


def bare(name: Column) -> Column:
    """The name without its file prefix and suffix."""
    return F.regexp_replace(F.regexp_replace(name, "^graph_", ""), r"\.pkl$", "")


def part(name: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(bare(name), pattern, group), F.lit(""))


def number(*pieces: Column) -> Column:
    return F.concat(*pieces).cast("double")


def rotation_deg(name: Column) -> Column:
    """The angle of a rotation, in (-180, 180]."""
    size = number(part(name, ROTATION, 2), F.lit("."), part(name, ROTATION, 3))
    angle = F.when(part(name, ROTATION, 1) == "-", -size).otherwise(size)
    return F.when(angle > 180, angle - 360).otherwise(angle)


def translation_m(name: Column) -> Column:
    return part(name, TRANSLATION, 1).cast("double")


def translation_angle(name: Column) -> Column:
    angle = part(name, TRANSLATION, 3).cast("double")
    return F.when(part(name, TRANSLATION, 2) == "-", -angle).otherwise(angle)


def scale_factor(name: Column) -> Column:
    return number(part(name, SCALE, 2), F.lit("."), part(name, SCALE, 3))


def family(name: Column) -> Column:
    """original, rotation, translation_<angle>, scale_ns, scale_ew or unknown."""
    return (
        F.when(bare(name) == "original", "original")
        .when(rotation_deg(name).isNotNull(), "rotation")
        .when(translation_m(name).isNotNull(), F.concat(F.lit("translation_"), part(name, TRANSLATION, 3)))
        .when(scale_factor(name).isNotNull(), F.concat(F.lit("scale_"), part(name, SCALE, 1)))
        .otherwise("unknown")
    )


def parameter(name: Column) -> Column:
    """The number that the name encodes: degrees, metres or factor; 0 for the original."""
    return F.when(bare(name) == "original", F.lit(0.0)).otherwise(F.coalesce(rotation_deg(name), translation_m(name), scale_factor(name)))


def in_main_ensemble(name: Column) -> Column:
    """Neither a contraction nor a short translation; names that encode neither stay."""
    return ~F.coalesce(scale_factor(name) < 1.0, F.lit(False)) & ~F.coalesce(translation_m(name) < SHORTEST_TRANSLATION_M, F.lit(False))


def translation_name(metres: Column, angle: Column) -> Column:
    return F.format_string("trans_%dm_a%+04d", metres.cast("int"), angle.cast("int"))


def scale_name(axis: Column, factor: Column) -> Column:
    return F.concat(F.lit("scale_"), axis, F.lit("_"), F.replace(factor.cast("decimal(6,2)").cast("string"), F.lit("."), F.lit("p")))


def rotation_name(angle: Column) -> Column:
    return F.concat(F.lit("rot_"), F.when(angle < 0, "-").otherwise("+"), F.lpad(F.replace(F.abs(angle).cast("decimal(6,2)").cast("string"), F.lit("."), F.lit("p")), 5, "0"), F.lit("deg"))


def direction(angle: Column) -> Column:
    """East, north, west or south for the four axes, the angle in degrees otherwise."""
    a = F.pmod(angle, F.lit(360))
    return F.when(a == 0, "east").when(a == 90, "north").when(a == 180, "west").when(a == 270, "south").otherwise(F.concat(angle.cast("int").cast("string"), F.lit("°")))


def axis(angle: Column) -> Column:
    a = F.pmod(angle, F.lit(180))
    return F.when(a == 0, "EW").when(a == 90, "NS").otherwise("oblique")


def signed_distance(metres: Column, angle: Column) -> Column:
    """Along the axis: negative for west and south, null for other directions."""
    a = F.pmod(angle, F.lit(360))
    return F.when(a.isin(0, 90), metres).when(a.isin(180, 270), -metres)


def kind_in(text: Column) -> Column:
    """original, rotation, translation, scale or other: by a word anywhere in a text."""
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("original")), "original").when(F.contains(t, F.lit("rot")), "rotation").when(F.contains(t, F.lit("trans")), "translation").when(F.contains(t, F.lit("scale")), "scale").otherwise("other")


def kind_of(name: Column, kind: Column) -> Column:
    """The same by what a table says of the variant's kind, or by its file's name."""
    n, k = F.lower(name), F.lower(F.coalesce(kind, F.lit("")))
    starts, holds = (lambda x: F.startswith(k, F.lit(x))), (lambda x: F.contains(n, F.lit(x)))
    return F.when((k == "original") | holds("original"), "original").when(starts("rotation") | holds("rot_"), "rotation").when(starts("scale") | holds("scale_"), "scale").when(starts("translation") | starts("translate") | holds("trans_"), "translation").otherwise("other")


def kind_of_row(variant: Column, kind: Column) -> Column:
    """The same of a row of statistics: its type and its variant's beginning."""
    v, k = F.lower(F.coalesce(variant, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    of = lambda a, b: F.startswith(k, F.lit(a)) | F.startswith(v, F.lit(b))
    return F.when((k == "original") | (v == "original"), "original").when(of("translate", "trans_"), "translation").when(of("rotate", "rot_"), "rotation").when(of("scale", "scale_"), "scale").otherwise("other")


def growth(name: Column, more: str = "expansion", less: str = "contraction", moved: str = "translation", turned: str = "rotation") -> Column:
    """Scalings as expansions or contractions, moved and turned ones, and original for the rest."""
    n = bare(name)
    return F.when(F.startswith(n, F.lit("trans")), moved).when(F.startswith(n, F.lit("rot")), turned).when(scale_factor(name) > 1, more).when(scale_factor(name).isNotNull(), less).otherwise("original")


def scale_axis(text: Column) -> Column:
    """ns or ew of the ways to write them; null of others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("ns", "north-south", "north_south"), "ns").when(t.isin("ew", "east-west", "east_west"), "ew")


def metres_in(text: Column) -> Column:
    """The length in a text that names a translation, with or without decimals."""
    return F.nullif(F.regexp_extract(text, r"trans_(\d+(?:\.\d+)?)m", 1), F.lit("")).cast("double")


def one_sided(axis: Column, values: Column) -> Column:
    """northward, southward, eastward or westward if all values (an array of signed lengths, nulls and zeros aside) have one sign; null otherwise."""
    signs = F.array_distinct(F.transform(F.filter(values, lambda v: v.isNotNull() & (F.abs(v) > 1e-9)), lambda v: F.signum(v).cast("int")))
    up = F.element_at(signs, 1) > 0
    one = F.size(signs) == 1
    return F.when(one & (axis == "ns"), F.when(up, "northward").otherwise("southward")).when(one & (axis == "ew"), F.when(up, "eastward").otherwise("westward"))


def canonical(name: Column) -> Column:
    """A variant's name with its numbers in one form: whole degrees and factors with a point become the forms of rotation_name() and scale_name()."""
    n = bare(name)
    sign, whole = (F.regexp_extract(n, r"^rot_([+-])(\d+)deg$", g) for g in (1, 2))
    axis_, a, b = (F.regexp_extract(n, r"^scale_(ns|ew)_(\d+)[.p](\d+)$", g) for g in (1, 2, 3))
    turned = F.concat(F.lit("rot_"), sign, F.lpad(whole, 2, "0"), F.lit("p00deg"))
    return F.when(whole != "", turned).when(axis_ != "", F.concat(F.lit("scale_"), axis_, F.lit("_"), a, F.lit("p"), F.rpad(F.regexp_replace(b, "0+$", ""), 2, "0"))).otherwise(n)


def plain_number(hundredths: Column) -> Column:
    """A number of hundredths as text without trailing zeros."""
    whole, rest = F.floor(F.abs(hundredths) / 100).cast("long"), F.abs(hundredths) % 100
    end = F.regexp_replace(F.lpad(rest.cast("string"), 2, "0"), "0+$", "")
    return F.concat(F.when(hundredths < 0, "-").otherwise(""), whole.cast("string"), F.when(end != "", F.concat(F.lit("."), end)).otherwise(""))


def unit_of(pct: Column) -> Column:
    """The unit in which a change (in %) is shown: %, ‰, ppm or ppb by its size."""
    a = F.abs(pct)
    return F.when(a.isNull() | (a >= 1), "%").when(a >= 0.1, "‰").when(a >= 0.0001, "ppm").otherwise("ppb")


def decimals_of(value: Column) -> Column:
    """Decimals that a value is shown with: fewer for larger ones; 3 for none."""
    a = F.abs(value)
    return F.when(a >= 100, 1).when(a >= 10, 2).otherwise(3)


def normalised_angles(angles: Column) -> Column:
    """An array of angles in (-180, 180], distinct and ascending."""
    # a negative multiple of a turn leaves -0.0, which array_distinct holds for another angle than 0.0
    wrapped = F.transform(angles, lambda a: F.pmod(a, F.lit(360.0)) + F.lit(0.0))
    return F.array_sort(F.array_distinct(F.transform(wrapped, lambda a: F.when(a > 180, a - 360).otherwise(a))))


def _plain_letters() -> dict[str, str]:
    """Small letters with marks, and the one letter that each is when decomposed; marks by themselves, for which there is nothing."""
    out = {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        first, *marks = unicodedata.normalize("NFKD", c)
        if c.islower() and first.isascii() and first.isalpha() and all(map(unicodedata.combining, marks)):
            out[c] = first
    return out


_PLAIN = _plain_letters()
#: Letters with marks, then marks alone, which go; and the plain letters.
MARKED, UNMARKED = "".join(_PLAIN) + "".join(map(chr, range(0x300, 0x370))), "".join(_PLAIN.values())


def normalised(place: Column) -> Column:
    """Lower case without marks, and one underscore for each run of anything but letters and digits."""
    plain = F.translate(F.lower(F.trim(place)), MARKED, UNMARKED)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def escaped_xml(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def escaped_tex(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def joined(names: Column, last: str = " and ") -> Column:
    """An array in words: `a`, `a and b`, `a, b and c`."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit(last), F.element_at(names, -1)))


def ring_to_wkt(ring: Column) -> Column:
    """A ring (array of structs x, y) as a polygon in well-known text."""
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def wkt_to_ring(wkt: Column) -> Column:
    """The outer ring of a polygon in well-known text."""
    points = F.split(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1), r"\s*,\s*")
    return F.transform(points, lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), 0).cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("y")))
