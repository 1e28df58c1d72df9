"""Column builders for strands: two bits a base, metrics, constraints, q-grams, similarity and hash ranks. All stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base of each pair of bits, most significant first.
BASES = "ACGT"
HEX_TO_DNA = {f"{v:x}": BASES[v >> 2] + BASES[v & 3] for v in range(16)}


def to_dna(data: Column) -> Column:
    """Strand of a binary column: four bases a byte. Each hex digit becomes the character whose own two hex digits stand for its two bases."""
    signs = "".join(chr(16 * (4 + (v >> 2)) + (v & 3)) for v in range(16))
    return F.translate(F.hex(F.translate(F.hex(data), "0123456789ABCDEF", signs)), "45670123", 2 * BASES)


def cleaned(strand: Column) -> Column:
    return F.upper(F.trim(strand))


def is_strand(strand: Column) -> Column:
    return strand.rlike("^[ACGT]*$")


def to_bytes(strand: Column) -> Column:
    """Bytes of a strand, stripped and in any case; null where its length isn't a multiple of four or a sign isn't a base."""
    s = cleaned(strand)
    pairs = F.create_map(*(F.lit(x) for h, d in HEX_TO_DNA.items() for x in (d, h)))
    n = F.length(s)
    digits = F.transform(F.regexp_extract_all(s, F.lit("[ACGT]{2}"), F.lit(0)), lambda x: F.element_at(pairs, x))
    return F.when((n % 4 == 0) & is_strand(s), F.when(n == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(digits, ""))))


def gc_fraction(strand: Column) -> Column:
    """Share of G and C; 0 for an empty strand."""
    return F.when(F.length(strand) == 0, 0.0).otherwise(F.length(F.translate(strand, "AT", "")) / F.length(strand))


def longest_run(strand: Column) -> Column:
    """Length of the longest run of one base; 0 for an empty strand."""
    runs = F.regexp_extract_all(strand, F.lit("AA+|CC+|GG+|TT+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.when(F.length(strand) > 0, 1).otherwise(0))


@dataclass(frozen=True)
class Constraints:
    """Bounds, both included, on GC share and runs."""

    min_gc: float = 0.35
    max_gc: float = 0.65
    max_run: int = 4

    def __post_init__(self) -> None:
        if not (0 <= self.min_gc <= self.max_gc <= 1) or self.max_run < 1:
            raise ValueError("GC bounds must be ordered within [0, 1], the run at least 1")


def accepts(strand: Column, c: Constraints = Constraints()) -> Column:
    return gc_fraction(strand).between(c.min_gc, c.max_gc) & ~strand.rlike("|".join(b * (c.max_run + 1) for b in BASES))


def violations(strand: Column, c: Constraints = Constraints()) -> Column:
    """The broken bounds as texts, in the order low GC, high GC, run."""
    return broken(gc_fraction(strand), longest_run(strand), c)


def broken(gc: Column, run: Column, c: Constraints = Constraints()) -> Column:
    """violations of a GC share and a longest run."""
    said = [
        F.when(gc < c.min_gc, F.format_string(f"gc %.4f below {c.min_gc:.4f}", gc)),
        F.when(gc > c.max_gc, F.format_string(f"gc %.4f above {c.max_gc:.4f}", gc)),
        F.when(run > c.max_run, F.format_string(f"run %d above {c.max_run}", run)),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def quality_penalty(strand: Column, target: float = 0.5, max_run: int = 4) -> Column:
    return penalty(gc_fraction(strand), longest_run(strand), target, max_run)


def penalty(gc: Column, run: Column, target: float = 0.5, max_run: int = 4) -> Column:
    """quality_penalty of a GC share and a longest run."""
    return F.abs(gc - target) + 0.05 * F.greatest(F.lit(0), run - max_run)


def reverse_complement(strand: Column) -> Column:
    return F.translate(F.reverse(strand), "ACGT", "TGCA")


def pieces(strand: Column, places: Column, size: int) -> Column:
    """The `size` signs of a strand from each of an array of places, counted from 0. Bytes are cut at once, where a text is counted off from its start for each piece; only strands with signs of several
    bytes are cut as texts."""
    cut = lambda whole: F.transform(places, lambda i: F.substring(whole, i + 1, F.lit(size)).cast("string"))
    return F.when(F.octet_length(strand) == F.length(strand), F.transform(F.array(strand.cast("binary")), cut)[0]).otherwise(cut(strand))


def qgrams(strand: Column, q: int) -> Column:
    """All q-grams in order, repeats included; a shorter strand is its own."""
    many = pieces(strand, F.sequence(F.lit(0), F.greatest(F.length(strand) - q, F.lit(0))), q)
    return F.when(F.length(strand) < q, F.array(strand)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strands of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance up to a limit, else null. Strands of one length give their Hamming distance, if that is within the limit."""
    same = F.length(a) == F.length(b)
    plain = F.levenshtein(a, b, limit)
    plain = F.when(plain >= 0, plain)
    within = F.transform(F.array(hamming(a, b)), lambda h: F.when(h <= limit, h).otherwise(plain))[0]  # counted once
    return F.when(a == b, 0).when(same, within).otherwise(plain)


def hash_rank(seed: object, *keys: Column) -> Column:
    """SHA-256 of seed:key..., by which a sample is ordered: the same on any cluster and for any order of rows."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def selector(mask: Column) -> Column:
    """The header byte that names a whitening mask 0..255; a bijection."""
    return F.when(mask < 16, mask + 0xB0).when(mask < 192, mask - 16).otherwise(mask)


def mask_of(selector_byte: Column) -> Column:
    return F.when(selector_byte < 176, selector_byte + 16).when(selector_byte < 192, selector_byte - 176).otherwise(selector_byte)
