"""Pairwise alignment with affine gaps (Gotoh 1982) in Arrow UDFs, read mapping and recircularisation.

The recurrences run row by row over numpy arrays that hold many pairs; the row of the horizontal gap state is closed by a
running maximum, so no cell is a step of Python. Operators deal rows out to all cores first: the tables are small, the work on a row is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import IUPAC, nucleotide_scores, union_symbols

GAP_OPEN, GAP_EXTEND, GAP_DOUBLE = -7.0, -7.0, -7.0
METHODS = ("global", "local", "glocal", "global_cfe")
STOP, DIAG, UP, LEFT = range(4)
#: Pairs that are aligned together at most, and their pointers.
PAIRS, BATCH = 512, 1 << 23
#: Order in which a method prefers equal scores.
PREFERENCE = {"local": (DIAG, UP, LEFT), "glocal": (UP, DIAG, LEFT), "global": (UP, LEFT, DIAG), "global_cfe": (UP, LEFT, DIAG)}


def _table(matrix: dict[tuple[str, str], float]) -> np.ndarray:
    worst = min(matrix.values())
    out = np.full((256, 256), worst)
    for (a, b), v in matrix.items():
        out[ord(a), ord(b)] = v
    return out


def _fill(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, scores: np.ndarray, method: str, gaps: tuple[float, float, float]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Pointers (row, pair, column) of pairs of padded sequences, rows for a, and what their ends need: the score in the last row, the last column, and the best cell of all with its place.

    n and m are the true lengths. What lies beyond them is computed and never looked at, since no cell depends on one below it or to its right.
    """
    opening, extend, double = gaps
    pairs, rows, cols = len(a), a.shape[1], b.shape[1]
    every = np.arange(pairs)
    point = np.zeros((rows + 1, pairs, cols + 1), np.int8)
    low = -1e30
    up_state, left_state = np.full((2, pairs, cols + 1), low)
    score = np.zeros((pairs, cols + 1))
    edge = np.zeros(rows + 1)
    if method == "global":
        point[1:, :, 0], point[0, :, 1:] = UP, LEFT
        edge[1:] = opening + extend * np.arange(rows)
        score[:, 1:] = opening + extend * np.arange(cols)
    elif method == "glocal":
        point[0, :, 1:] = LEFT
        score[:, 1:] = opening + extend * np.arange(cols)
    elif method == "global_cfe":
        point[1:, :, 0], point[0, :, 1:] = UP, LEFT
    # A horizontal gap grows by this much a column: reopening it is as good as extending it where that costs less.
    step = max(opening, extend)
    slope = step * np.arange(cols)
    inside = np.arange(cols + 1)[None, :] <= m[:, None]
    last_row, last_col = np.full((pairs, cols + 1), -np.inf), np.full((pairs, rows + 1), -np.inf)
    best, best_i, best_j = score[:, 0].copy(), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)

    def ended(i: int) -> None:
        last_col[i <= n, i] = score[every, m][i <= n]
        at = i == n
        last_row[at] = np.where(inside[at], score[at], -np.inf)

    ended(0)
    for i in range(1, rows + 1):
        new_up = np.maximum(np.maximum(score + opening, up_state + extend), left_state + double)
        diag = np.full((pairs, cols + 1), low)
        diag[:, 1:] = score[:, :-1] + scores[a[:, i - 1][:, None], b]
        closed = np.maximum(diag, new_up)
        if method == "local":
            closed = np.maximum(closed, 0)
        closed[:, 0] = edge[i]
        # Where a gap may begin, and how good it is there; a vertical gap turns into it from the first column on.
        begin = closed[:, :-1] + opening
        begin[:, 1:] = np.maximum(begin[:, 1:], new_up[:, 1:-1] + double)
        new_left = np.full((pairs, cols + 1), low)
        new_left[:, 1:] = np.maximum.accumulate(begin - slope, axis=1) + slope
        score = np.maximum(closed, new_left)
        score[:, 0] = edge[i]
        cells = {DIAG: diag, UP: new_up, LEFT: new_left}
        most = np.maximum(np.maximum(diag, new_up), new_left)
        p = np.zeros((pairs, cols + 1), np.int8)
        for k in reversed(PREFERENCE[method]):
            p[cells[k] == most] = k
        if method == "local":
            p[score <= 0] = STOP
            own = np.where(inside, score, -np.inf)
            j = own.argmax(1)
            more = (own[every, j] > best) & (i <= n)
            best[more], best_i[more], best_j[more] = own[every, j][more], i, j[more]
        point[i, :, 1:] = p[:, 1:]
        up_state, left_state = new_up, new_left
        ended(i)
    return point, {"row": last_row, "col": last_col, "best": best, "i": best_i, "j": best_j}


def _padded(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in seqs])
    width = int(sizes.max(initial=0))
    flat = "".join(s.ljust(width, "\0") for s in seqs).encode("latin-1")
    return np.frombuffer(flat, np.uint8).reshape(len(seqs), width), sizes


def _align(xs: list[str], ys: list[str], method: str, scores: np.ndarray, gaps: tuple[float, float, float], compat_score: bool) -> list[dict]:
    """align_pair of a few pairs at once."""
    flip = [len(x) < len(y) for x, y in zip(xs, ys, strict=True)]
    longs = [y if f else x for f, x, y in zip(flip, xs, ys, strict=True)]
    shorts = [x if f else y for f, x, y in zip(flip, xs, ys, strict=True)]
    (a, n), (b, m) = _padded(longs), _padded(shorts)
    point, at = _fill(a, b, n, m, scores, method, gaps)
    every = np.arange(len(xs))
    i, j, corner = n.copy(), m.copy(), at["row"][every, m]
    best = corner.copy()
    tail_long, tail_short = np.zeros((2, len(xs)), np.int64)
    if method == "local":
        i, j, best = at["i"].copy(), at["j"].copy(), at["best"]
    elif method == "glocal":
        i = at["col"].argmax(1)
        best = at["col"][every, i]
    elif method == "global_cfe":
        col, row = at["row"].argmax(1), at["col"].argmax(1)
        along = at["row"][every, col] > at["col"][every, row]
        best = np.where(along, at["row"][every, col], at["col"][every, row])
        tail_short, tail_long = np.where(along, m - col, 0), np.where(along, 0, n - row)
        i, j = np.where(along, n, row), np.where(along, col, m)
    end_i, end_j = i.copy(), j.copy()
    # From the end to the start, all pairs a move at a time; written from the right.
    width = int((i + j).max(initial=0))
    al, ash, moves = np.full((3, len(xs), width), ord("-"), np.uint8)
    size, going = np.zeros(len(xs), np.int64), every
    for k in range(width - 1, -1, -1):
        p = point[i[going], going, j[going]]
        going, p = going[p != STOP], p[p != STOP]
        if not len(going):
            break
        i[going] -= p != LEFT
        j[going] -= p != UP
        size[going] += 1
        d, e = going[p != LEFT], going[p != UP]
        al[d, k], ash[e, k] = a[d, i[d]], b[e, j[e]]
        moves[going, k] = np.frombuffer(b"?MDI", np.uint8)[p]
    out = []
    for k in range(len(xs)):
        x, y, z = (v[k, width - size[k] :].tobytes().decode("latin-1") for v in (al, ash, moves))
        if tail_long[k]:
            x, y = x + longs[k][n[k] - tail_long[k] :], y + "-" * int(tail_long[k])
        elif tail_short[k]:
            x, y = x + "-" * int(tail_short[k]), y + shorts[k][m[k] - tail_short[k] :]
        got = {"score": float(corner[k] if compat_score else best[k]), "moves": z, "start_i": int(i[k]), "start_j": int(j[k]), "end_i": int(end_i[k]), "end_j": int(end_j[k])}
        out.append(got | ({"x": y, "y": x} if flip[k] else {"x": x, "y": y}))
    return out


def align_pairs(xs: list[str], ys: list[str], *, method: str = "global_cfe", matrix: dict[tuple[str, str], float] | None = None, gaps: tuple[float, float, float] = (GAP_OPEN, GAP_EXTEND, GAP_DOUBLE), compat_score: bool = False) -> list[dict]:
    """align_pair of each x and y. Pairs of like lengths are filled in together, as many as BATCH pointers hold."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}")
    scores = _table(matrix or nucleotide_scores())
    sizes = [(max(len(x), len(y)), min(len(x), len(y))) for x, y in zip(xs, ys, strict=True)]
    order = sorted(range(len(xs)), key=sizes.__getitem__)
    out: list[dict] = [{}] * len(xs)
    while order:
        # The largest pair comes last; as many as fit beside it go with it.
        n = sizes[order[-1]][0]
        m = max(sizes[k][1] for k in order[-PAIRS:])
        some = max(1, min(PAIRS, BATCH // ((n + 1) * (m + 1))))
        part, order = order[-some:], order[:-some]
        for k, r in zip(part, _align([xs[k] for k in part], [ys[k] for k in part], method, scores, gaps, compat_score), strict=True):
            out[k] = r
    return out


def align_pair(x: str, y: str, *, method: str = "global_cfe", matrix: dict[tuple[str, str], float] | None = None, gaps: tuple[float, float, float] = (GAP_OPEN, GAP_EXTEND, GAP_DOUBLE), compat_score: bool = False) -> dict:
    """Aligned x and y, score, and the places of the shorter one's columns in code form (moves, start and end of both).

    The longer sequence lies along the rows. The score is the optimum of the method; compat_score gives the last cell's.
    """
    return align_pairs([x], [y], method=method, matrix=matrix, gaps=gaps, compat_score=compat_score)[0]


def preserve_case(original: str, aligned: str) -> str:
    """The letters of the sequence before alignment around the gaps of the aligned one."""
    letters = iter(original)
    return "".join("-" if c == "-" else next(letters) for c in aligned)


def align_columns(df: DataFrame, x: str, y: str, *, method: str = "global_cfe", matrix: dict | None = None, gaps: tuple[float, float, float] = (GAP_OPEN, GAP_EXTEND, GAP_DOUBLE)) -> DataFrame:
    """Adds aligned_x, aligned_y, score and moves for two sequence columns, degapped and upper-cased first; case comes back after."""
    shared = matrix or nucleotide_scores()

    @F.pandas_udf("aligned_x string, aligned_y string, score double, moves string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        own = [[(s or "").replace("-", "") for s in side] for side in (a, b)]
        got = align_pairs(*[[s.upper() for s in side] for side in own], method=method, matrix=shared, gaps=gaps)
        cased = lambda s, r: r if s == s.upper() else preserve_case(s[s.upper().find(r.replace("-", "")) :], r)
        rows = [(cased(s, r["x"]), cased(t, r["y"]), r["score"], r["moves"]) for s, t, r in zip(*own, got, strict=True)]
        return pd.DataFrame(rows, columns=["aligned_x", "aligned_y", "score", "moves"])

    return dealt(df).withColumn("__a", run(F.col(x), F.col(y))).select(*df.columns, "__a.*")


def dealt(df: DataFrame) -> DataFrame:
    """Rows in as many parts as keep all cores at work, however few files they come from."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def score_alignment(x: Column, y: Column, *, match: float = 5, mismatch: float = -4, opening: float = GAP_OPEN, extend: float = GAP_EXTEND) -> Column:
    """Score of two gapped strings; a gap in either continues one gap state."""
    pairs = F.arrays_zip(F.split(x, "").alias("a"), F.split(y, "").alias("b"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(False).alias("g"))

    def step(acc: Column, p: Column) -> Column:
        gap = (p["a"] == "-") | (p["b"] == "-")
        add = F.when(gap, F.when(acc["g"], extend).otherwise(opening)).when(p["a"] == p["b"], match).otherwise(mismatch)
        return F.struct((acc["s"] + add).alias("s"), gap.alias("g"))

    return F.aggregate(pairs, start, step, lambda acc: acc["s"])


def pretty(x: str, y: str, width: int = 75) -> str:
    """Two aligned sequences in blocks, with bars at equal letters."""
    bars = "".join("|" if a == b else " " for a, b in zip(x, y, strict=True))
    return "\n\n".join("\n".join(s[i : i + width] for s in (x, bars, y)) for i in range(0, len(x), width))


def map_reads(reads: list[str], targets: list[str], *, max_mismatch: float = 0.2) -> list[dict | None]:
    """map_read of each read and target."""
    out: list[dict | None] = []
    for read, r in zip(reads, align_pairs(targets, reads, method="glocal"), strict=True):
        mism = sum(a != b and a != "-" and b != "-" for a, b in zip(r["x"], r["y"], strict=True))
        ins, dels = r["x"].count("-"), r["y"].count("-")
        fits = mism + ins + dels <= max_mismatch * max(1, len(read))
        out.append({"start": r["start_i"], "end": r["end_i"], "mismatches": mism, "inserts": ins, "dels": dels} if fits else None)
    return out


def map_read(read: str, target: str, *, max_mismatch: float = 0.2) -> dict | None:
    """Where a short sequence lies in a long one: start, end (not counted), mismatches, inserts, dels; None above the mismatch ratio."""
    return map_reads([read], [target], max_mismatch=max_mismatch)[0]


def _back(seq: str) -> str:
    return seq.upper().translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def map_all_strands(reads: list[str], targets: list[str]) -> list[tuple[str, dict]]:
    """map_both_strands of each read and target."""
    got = align_pairs([*targets, *targets], [*(r.upper() for r in reads), *map(_back, reads)], method="local")
    return [("-", b) if b["score"] > a["score"] else ("+", a) for a, b in zip(got[: len(reads)], got[len(reads) :], strict=True)]


def map_both_strands(read: str, target: str) -> tuple[str, dict]:
    """The alignment of the strand with the higher score, '+' or '-'."""
    return map_all_strands([read], [target])[0]


def recircularise_each(seqs: list[str], reference: str, *, head: int = 30, minlen: int = 0) -> list[dict]:
    """recircularise of each sequence."""
    out = [{"seq": s, "status": "short" if 0 < minlen >= len(s) else "no head"} for s in seqs]
    tried = [k for k, r in enumerate(out) if r["status"] != "short"]
    found = {k: at["start"] for k, at in zip(tried, map_reads([reference[:head]] * len(tried), [seqs[k] for k in tried]), strict=True) if at is not None}
    for k, start in found.items():
        out[k] = {"seq": seqs[k][start:] + seqs[k][:start], "status": "turned" if start else "same"}
    long = [k for k in found if len(out[k]["seq"]) > 2 * head]
    for k, second in zip(long, map_reads([reference[:head]] * len(long), [out[k]["seq"][head:] for k in long]), strict=True):
        turned = out[k]["seq"]
        if second is not None and turned.startswith(turned[head + second["start"] :]):
            out[k] = {"seq": turned[: head + second["start"]], "status": "overlap"}
    return out


def recircularise(seq: str, reference: str, *, head: int = 30, minlen: int = 0) -> dict:
    """Turns a circular sequence so that it starts where the reference's head lies; a repeated start at the end (a second head) is cut off."""
    return recircularise_each([seq], reference, head=head, minlen=minlen)[0]


def _union(a: str, b: str) -> str:
    """Column by column the symbol for the bases of both; a gap gives way to a base."""
    symbols, bases = union_symbols(), IUPAC
    return "".join(x if y in ("-", x) else y if x == "-" else symbols["".join(sorted({*bases.get(x, x), *bases.get(y, y)}))] for x, y in zip(a, b, strict=True))


def recircularise_each_by(seqs: list[str], references: list[str], *, least: int = 15) -> list[dict]:
    """recircularise_by of each sequence and reference."""
    got = align_pairs([*references, *references], [*(s.upper() for s in seqs), *map(_back, seqs)])
    out, over = [], []
    for k, (ahead, back) in enumerate(zip(got[: len(seqs)], got[len(seqs) :], strict=True)):
        strand, r = ("-", back) if back["score"] > ahead["score"] else ("+", ahead)
        x, y = r["x"], r["y"]
        lo, hi = len(x) - len(x.lstrip("-")), len(x.rstrip("-"))
        core, rest = y[lo:hi], [z for z in (y[:lo].replace("-", ""), y[hi:].replace("-", "")) if len(z) > least]
        if rest:
            core = "".join(b for a, b in zip(x[lo:hi], core, strict=True) if a != "-")
        over += [(k, z) for z in rest]
        out.append({"seq": core, "strand": strand, "merged": len(rest)})
    # What stands over at the columns of the reference's letters, gaps where it has none.
    for (k, _), r in zip(over, align_pairs([references[k] for k, _ in over], [z for _, z in over]), strict=True):
        out[k]["seq"] = _union(out[k]["seq"], "".join(b for a, b in zip(r["x"], r["y"], strict=True) if a != "-"))
    return [r | {"seq": r["seq"].replace("-", "")} for r in out]


def recircularise_by(seq: str, reference: str, *, least: int = 15) -> dict:
    """The circle of seq in the frame of the whole reference: the strand whose score is higher, cut at the reference's ends.

    What stands over before or after them, if it is longer than `least`, is the other end of the circle: it is aligned with
    the reference in its turn and merged in, base by base. Insertions into the reference stay where nothing is merged in.
    """
    return recircularise_each_by([seq], [reference], least=least)[0]


def recircularise_columns(df: DataFrame, seq: str, reference: str, *, least: int = 15) -> DataFrame:
    """recircularise_by for two columns: adds circle, strand and merged."""

    @F.pandas_udf("circle string, strand string, merged int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = recircularise_each_by(list(a), list(b), least=least)
        return pd.DataFrame([(g["seq"], g["strand"], g["merged"]) for g in got], columns=["circle", "strand", "merged"])

    return dealt(df).withColumn("__a", run(F.col(seq), F.col(reference))).select(*df.columns, "__a.*")


def map_columns(df: DataFrame, read: str, target: str, *, max_mismatch: float = 0.2) -> DataFrame:
    """map_read for two columns: adds start, end, mismatches, inserts and dels, null where nothing fits."""
    names = ["start", "end", "mismatches", "inserts", "dels"]

    @F.pandas_udf("start int, end int, mismatches int, inserts int, dels int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [r or {} for r in map_reads(list(a), list(b), max_mismatch=max_mismatch)]
        return pd.DataFrame({n: pd.array([g.get(n) for g in got], "Int32") for n in names})

    return dealt(df).withColumn("__a", run(F.col(read), F.col(target))).select(*df.columns, "__a.*")


def both_strands_columns(df: DataFrame, read: str, target: str) -> DataFrame:
    """map_both_strands for two columns: adds strand and score."""

    @F.pandas_udf("strand string, score double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = map_all_strands(list(a), list(b))
        return pd.DataFrame([(k, r["score"]) for k, r in got], columns=["strand", "score"])

    return dealt(df).withColumn("__a", run(F.col(read), F.col(target))).select(*df.columns, "__a.*")


def recircularise_all(df: DataFrame, reference: str, *, head: int = 30, minlen: int = 0) -> DataFrame:
    """recircularise for every row (label, seq): adds status and replaces seq."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = recircularise_each(list(b["seq"]), reference, head=head, minlen=minlen)
            yield pd.DataFrame({"label": b["label"], "seq": [g["seq"] for g in got], "status": [g["status"] for g in got]})

    return dealt(df.select("label", "seq")).mapInPandas(run, "label string, seq string, status string")
