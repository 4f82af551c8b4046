"""Column expressions on sequences: symbols are A, C, G, T; anything else is invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def revcomp(s: Column) -> Column:
    """Reverse complement (K5)."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The smaller of a k-mer and its reverse complement (K3)."""
    return F.least(s, revcomp(s))


def is_valid(s: Column) -> Column:
    return ~s.rlike("[^ACGT]")


def has_run(s: Column, n: int) -> Column:
    """Holds a run of n equal bases (F2); false for n = 0."""
    return s.rlike("|".join(f"{b}{{{n}}}" for b in BASES)) if n else F.lit(False)


def hamming(a: Column, b: Column) -> Column:
    """Number of positions where strings of equal length differ."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(differs, F.lit(0), lambda s, x: s + x)


def hamming_packed(a: Column, b: Column) -> Column:
    """The same of packed k-mers: a pair of bits that differs anywhere leaves one bit."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def pack(s: Column) -> Column:
    """Up to 31 bases, two bits each, as BIGINT (K6): the order of numbers is that of strings of one length."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(x: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def bin_of(s: Column, n: int) -> Column:
    """Hash partition of an anchor (D3)."""
    return F.pmod(F.xxhash64(s), F.lit(n)).cast("int")


def murmur_finaliser(h: int) -> int:
    """The public 64-bit MurmurHash3 finaliser, for bins written elsewhere (D3)."""
    mask = (1 << 64) - 1
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h


def entropy(weights: Column) -> Column:
    """Shannon entropy in bits of an array of positive counts; 0 for a single one."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    bits = F.aggregate(weights, F.lit(0.0), lambda s, x: s - (x / total) * F.log2(x / total))
    return F.when(F.size(weights) <= 1, F.lit(0.0)).otherwise(bits)


def seq_entropy(s: Column, m: int) -> Column:
    """Entropy of the m-mers of a sequence, all positions counted alike."""
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - (m - 1)), lambda i: F.substr(s, i, F.lit(m)))
    counts = F.transform(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g)).cast("double"))
    return F.when(F.length(s) < m, F.lit(0.0)).otherwise(entropy(counts)).cast("float")


def letters_to_bases(text: Column) -> Column:
    """The text bridge: letters a to z, in turn, as A, C, G, T; all else goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
