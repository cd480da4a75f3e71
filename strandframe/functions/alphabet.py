"""Nucleotide alphabets, codon tables and scoring rules."""

from __future__ import annotations

from itertools import product

#: Which bases each ambiguity symbol stands for.
IUPAC = {"R": "GA", "Y": "TC", "K": "GT", "M": "AC", "S": "GC", "W": "AT", "B": "GTC", "D": "GAT", "H": "ACT", "V": "GCA", "N": "AGCT"}
#: Complements as observed (V to G, S and W swapped), and by the standard.
COMPLEMENT_COMPAT = ("ACGTRYKMSWBVDHN-acgtrykmswbvdhn", "TGCAYRMKWSVGHDN-tgcayrmkwsvghdn")
COMPLEMENT_STANDARD = ("ACGTRYKMSWBVDHN-acgtrykmswbvdhn", "TGCAYRMKSWVBHDN-tgcayrmkswvbhdn")
#: Order of the symbols of a nucleotide profile, of an amino acid profile, and symbols that profiles ignore.
NA_SYMBOLS = "ATCG-RYKMSWBDHVN"
AA_SYMBOLS = "ACDEFGHIKLMNPQRSTVWYX-"
IGNORED = "_*~"
#: The universal code by first, second and third base in the order TCAG.
UNIVERSAL = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Families whose third base may be any ambiguity symbol, and single ambiguous codons.
FAMILIES = {"GC": "A", "GG": "G", "CT": "L", "CC": "P", "CG": "R", "TC": "T", "GT": "V"}
SINGLE = {
    "TGY": "C", "GAY": "D", "GAR": "E", "TTY": "F", "CAY": "H", "ATH": "I", "ATM": "I", "ATW": "I", "ATY": "I", "AAR": "K", "TTR": "L",
    "YTR": "L", "YTA": "L", "YTG": "L", "AAY": "N", "CAR": "Q", "AGR": "R", "MGR": "R", "TAY": "Y", "TAR": "*", "TRA": "*", "---": "-",
}
THIRD = "NMRWSYKVHDB"


def codons(table: str = "compat") -> dict[str, str]:
    """Codon to amino acid. 'compat' reads CCG as L and the ambiguous TC codons as T; 'standard' follows the universal code."""
    plain = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), UNIVERSAL, strict=True)}
    families = {p + t: a for p, a in FAMILIES.items() for t in THIRD}
    if table == "compat":
        return plain | {"CCG": "L"} | families | SINGLE
    if table != "standard":
        raise ValueError(f"no codon table {table!r}")
    ambiguous = {}
    for c in product("TCAGRYKMSWBDHVN", repeat=3):
        found = {plain["".join(x)] for x in product(*(IUPAC.get(b, b) for b in c))}
        if len(found) == 1:
            ambiguous["".join(c)] = found.pop()
    return ambiguous | {"---": "-"}


def union_symbols() -> dict[str, str]:
    """Sorted bases to the ambiguity symbol that stands for exactly these."""
    return {"".join(sorted(v)): k for k, v in IUPAC.items()} | {b: b for b in "ACGT"}


def nucleotide_scores(match: float = 5, mismatch: float = -4, *, read: bool = False) -> dict[tuple[str, str], float]:
    """Scores of nucleotide symbols: the mean over the bases that two symbols may stand for, rounded.

    Equal ambiguity symbols, and N with another one, score -1. With read=True plain bases score 3 and -7 and N with a base 0,
    as for base-called reads; U scores as T does under the plain rule.
    """
    sets = {b: b for b in "ATGC"} | {k: v for k, v in IUPAC.items()} | {"U": "T"}
    out = {}
    for a, x in sets.items():
        for b, y in sets.items():
            share = len(set(x) & set(y)) / (len(x) * len(y))
            raw = share * match + (1 - share) * mismatch
            score = float(int(raw + (0.5 if raw > 0 else -0.5)))
            if len(x) > 1 and len(y) > 1 and (a == b or "N" in (a, b)):
                score = -1.0
            if read and "U" not in (a, b):
                if len(x) == len(y) == 1:
                    score = 3.0 if a == b else -7.0
                elif "N" in (a, b) and (len(x) == 1 or len(y) == 1):
                    score = 0.0
            out[a, b] = score
    return out
