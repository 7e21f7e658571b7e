"""Column functions: lenient casts, intervals, sequences, bins, identifiers, vectors and fixed-width text. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One letter for each standard residue, in the usual order; the modified methionine counts as one.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L",
    "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M",
}
#: Van der Waals radii in angstrom by element, and of any other one.
RADII, OTHER_RADIUS = {"C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "SE": 1.90, "H": 1.20}, 1.70


def literal_map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


# Lenient casts


def lenient_double(text: Column) -> Column:
    """A number as structure files write it: quotes go, what follows ``(`` goes; empty, ``.``, ``?`` and non-numbers are null."""
    bare = F.regexp_replace(F.trim(text), "^['\"]+|['\"]+$", "")
    head = F.trim(F.regexp_extract(bare, r"^([^(]*)", 1))
    return F.when(~bare.isin("", ".", "?"), head.try_cast("double"))


def first_valid(*candidates: Column, blanks: tuple[str, ...] = ("", ".", "?")) -> Column:
    """The first candidate that is neither null nor one of ``blanks`` after trimming."""
    return F.coalesce(*(F.when(~F.trim(c).isin(*blanks), F.trim(c)) for c in candidates))


def double_or(value: Column, default: float = 0.0) -> Column:
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(default))


def int_or(value: Column, default: int = 0) -> Column:
    """Truncates towards zero."""
    return F.coalesce(value.cast("string").try_cast("double").cast("long"), F.lit(default).cast("long"))


# Scores and intervals (both ends inclusive)


def window_score(burial: Column, coverage: Column, risk: Column) -> Column:
    return 0.60 * burial + 0.30 * coverage - 0.15 * risk


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared = overlap(a0, a1, b0, b1)
    union = (a1 - a0 + 1) + (b1 - b0 + 1) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def contains_either(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return ((a0 <= b0) & (a1 >= b1)) | ((b0 <= a0) & (b1 >= a1))


def anchor_offset(anchor: Column, left: Column, right: Column) -> Column:
    return anchor - (left + right) / 2


# Sequences


def positional_identity(a: Column, b: Column) -> Column:
    """Matching positions over the longer length, without alignment; 0 if either is empty."""
    letters = lambda s: F.split(s, "")
    same = F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((F.char_length(a) > 0) & (F.char_length(b) > 0), same / longest).otherwise(F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    la, lb = F.char_length(a), F.char_length(b)
    return F.when((la > 0) & (lb > 0), F.least(la, lb) / F.greatest(la, lb)).otherwise(F.lit(0.0))


def kmers(text: Column, k: Column) -> Column:
    """The distinct k-mers; a text of k characters or fewer is its own only one, an empty one has none."""
    n = F.char_length(text)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, k)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= k, F.array(text)).otherwise(many)


def one_letter(resname: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(ONE_LETTER), F.upper(resname)), F.lit("X"))


def radius(element: Column, atom: Column) -> Column:
    """By element, or by the first letter of the atom's name where no element is given."""
    given = F.upper(F.coalesce(F.when(F.trim(element) != "", F.trim(element)), F.substring(F.trim(atom), 1, 1)))
    return F.coalesce(F.element_at(literal_map(RADII), given), F.lit(OTHER_RADIUS))


def token_ids(sequence: Column, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", first: int = 2, unknown: int = 1) -> Column:
    """Token ids of a sequence's letters: 0 is padding, 1 unknown; blanks are skipped, nothing left gives one unknown."""
    ids = literal_map({c: first + i for i, c in enumerate(letters)})
    upper = F.translate(F.coalesce(sequence, F.lit("")), letters.lower(), letters)
    kept = F.filter(F.split(upper, ""), lambda c: F.trim(c) != "")
    out = F.transform(kept, lambda c: F.coalesce(F.element_at(ids, c), F.lit(unknown)))
    return F.when(F.size(out) == 0, F.array(F.lit(unknown))).otherwise(out)


def padded(ids: Column, width: int, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), width)), 1, width)


# Bands and bins


def band(value: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that the value does not exceed."""
    out = reduce(lambda acc, e: acc.when(value <= e[0], e[1]), edges[1:], F.when(value <= edges[0][0], edges[0][1]))
    return out.otherwise(rest)


def short_length_band(n: Column) -> Column:
    return band(n, [(10, "8_10"), (14, "11_14")], "15_20")


def wide_length_band(n: Column) -> Column:
    return F.when(n.between(8, 10), "8-10").when(n.between(11, 15), "11-15").when(n.between(16, 20), "16-20").otherwise("other")


def bin_label(value: Column, edges: list[float]) -> Column:
    """Left-closed bin as a label ``[a, b)``; null or outside gives ``nan``. The last edge may be infinite."""
    shown = ["inf" if e == float("inf") else repr(float(e)) for e in edges]
    out = None
    for (a, b), (x, y) in zip(zip(edges, edges[1:]), zip(shown, shown[1:])):
        inside = (value >= a) if b == float("inf") else (value >= a) & (value < b)
        out = F.when(inside, f"[{x}, {y})") if out is None else out.when(inside, f"[{x}, {y})")
    return F.when(F.isnan(value.cast("double")), "nan").otherwise(F.coalesce(out, F.lit("nan")))


# Identifiers


def residue_id(number: Column, icode: Column, resname: Column) -> Column:
    return F.concat(number.cast("string"), F.trim(F.coalesce(icode, F.lit(""))), F.lit(":"), resname)


def pair_id(a: Column, b: Column, sep: str = "__") -> Column:
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def direction(peptide: Column, receptor: Column) -> Column:
    return F.concat(peptide, F.lit("_as_peptide__"), receptor, F.lit("_as_receptor"))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """The name-based UUID (SHA-1) of a string; the default namespace is the one for domain names."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def code_sum(text: Column) -> Column:
    """The sum of a string's code points."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.ascii(c))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def group_key(candidates: list[Column], target: Column, task: Column) -> Column:
    """``family:`` with the first usable candidate, else ``target:``, else ``task:``, else ``unknown``; blanks and ``nan`` are not usable."""
    usable = lambda c: F.when(~F.trim(c.cast("string")).isin("", "nan"), F.trim(c.cast("string")))
    families = [F.concat(F.lit("family:"), usable(c)) for c in candidates]
    return F.coalesce(*families, F.concat(F.lit("target:"), usable(target)), F.concat(F.lit("task:"), usable(task)), F.lit("unknown"))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitized(text: Column) -> Column:
    """A token for file names: runs of anything but letters, digits, ``.``, ``_`` and ``-`` become ``_``, and such marks at both ends
    go; ``unknown`` if nothing is left or the text is null."""
    marked = F.regexp_replace(stripped(text.cast("string")), r"[^A-Za-z0-9._-]+", "_")
    bare = F.regexp_replace(marked, r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def heading(text: Column) -> Column:
    """Lower case without a leading number that a dot or bracket ends; anything but letters, digits and CJK becomes one space."""
    low = stripped(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"^[0-9]+[.)]\s*", ""), "[^a-z0-9一-鿿]+", " "))


# Vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def clamped_scale(log_scale: Column, most: float = 100.0) -> Column:
    """The factor on similarities that a learnt logarithm stands for, at most ``most``."""
    return F.least(F.exp(log_scale), F.lit(most))


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def mean_pool(vectors: Column, mask: Column, width: int) -> Column:
    """The mean of the vectors where the mask is true; zeros if it nowhere is."""
    used = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"])
    n = F.size(used)
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.when(n > 0, F.aggregate(used, F.lit(0.0), lambda acc, x: acc + F.element_at(x["v"], i).cast("double")) / n).otherwise(F.lit(0.0)))


# Fixed-width structure text


def pdb_atom_line(serial: Column, atom: Column, resname: Column, chain: Column, number: Column, icode: Column, x: Column, y: Column, z: Column, occupancy: Column, b_factor: Column, element: Column) -> Column:
    """An ATOM record; names of fewer than four characters start one column further right."""
    name = F.when(F.char_length(atom) >= 4, F.substring(atom, 1, 4)).otherwise(F.rpad(F.concat(F.lit(" "), atom), 4, " "))
    blank = F.when(F.trim(F.coalesce(icode, F.lit(""))) == "", " ").otherwise(F.substring(icode, 1, 1))
    return F.format_string(
        "ATOM  %5d %s %3s %s%4d%s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        serial.cast("int"), name, F.substring(resname, 1, 3), F.substring(chain, 1, 1), number.cast("int"), blank, x, y, z, occupancy, b_factor, F.upper(F.substring(element, 1, 2)),
    )
