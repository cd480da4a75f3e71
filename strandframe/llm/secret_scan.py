"""Operator 8: secret scan, with a random forest that removes false positives.

Patterns find candidates generously: known key formats, values assigned to telling names, and long strings that mix letters
and digits. The forest then judges each by its length, its character transitions, how much of it dictionary words cover, the
path it stands in and the words beside it. It is trained from labelled findings.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import small

#: Public key formats by their prefixes: fixed values.
FORMATS = {
    "aws_key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential|client[_-]?secret|private[_-]?key"
KNOWN = re.compile("|".join(rf"(?P<{k}>{v})" for k, v in FORMATS.items()))
#: What stands before a name and a "_" or "-" does not matter, so the name is looked for alone: no text is scanned twice.
ASSIGNED = re.compile(rf"(?i)(?<![a-z])(?:{NAMES})[\"']?\s*(?:=|:|:=|=>|\bis\b)\s*[\"']?(?P<value>[^\s\"',;<>]{{6,}})")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
TELLING = re.compile(rf"(?i){NAMES}|bearer|authorization|\bkey\b|\bauth\b")
BLAND = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your|todo|xxxx|\bsha\d*\b|\bmd5\b|checksum|digest|commit|hash|\brev\b|uuid|guid|version|etag|integrity")
PATHLIKE = re.compile(r"(?:^|[\s\"'(=])(?:[a-z]+://|\.{0,2}/)?[\w.-]+(?:/[\w.-]+)+$")
#: English words that show a candidate is prose or a name: fixed values.
WORDS = frozenset("""
the and for with this that from your have not are was all can will one use file name user test data value type list text code
password secret token example sample dummy change default config local server client public private access none null true false
main index page home data base table model class object string number admin root login email path image style script module
version release build source branch master origin commit update insert select where order group count total first last next
""".split())
FEATURES = ("length", "letters", "digits", "upper", "other", "switches", "switch_rate", "entropy", "distinct", "surprise", "words", "repeat", "hex", "known", "assigned", "telling", "bland", "path", "file")


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, value) of what may be a secret, left to right; an earlier kind wins where two overlap."""
    found: list[tuple[int, int, str]] = []
    for m in KNOWN.finditer(text):
        found.append((m.start(), m.end(), m.lastgroup))
    for m in ASSIGNED.finditer(text):
        found.append((m.start("value"), m.end("value"), "assigned"))
    for m in LOOSE.finditer(text):
        found.append((m.start(), m.end(), "loose"))
    rank = {"assigned": 1, "loose": 2}
    taken: list[tuple[int, int, str]] = []
    end = -1
    # Known formats stand before assigned values and these before loose strings that cover the same place.
    for s, e, k in sorted(found, key=lambda x: (rank.get(x[2], 0), x[0])):
        taken.append((s, e, k))
    taken.sort(key=lambda x: (x[0], rank.get(x[2], 0)))
    best: list[tuple[int, int, str]] = []
    for s, e, k in taken:
        if best and s < end:
            if rank.get(k, 0) < rank.get(best[-1][2], 0):
                best[-1] = (s, e, k)
                end = e
            continue
        best.append((s, e, k))
        end = e
    for s, e, k in best:
        yield s, e, k, text[s:e]


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class Surprise:
    """Mean surprise of a string's letter pairs under counts from ordinary words."""

    def __init__(self, words: list[str]):
        self.pairs = Counter(p for w in words for p in zip(f"^{w}", w, strict=False))
        self.first = Counter(c for w in words for c in f"^{w}"[:-1])

    def __call__(self, value: str) -> float:
        v = value.lower()
        return sum(-math.log((self.pairs[p] + 0.1) / (self.first[p[0]] + 4.0)) for p in zip(f"^{v}", v, strict=False)) / max(1, len(v))


def features(text: str, start: int, end: int, kind: str, path: str, surprise: Surprise) -> list[float]:
    """FEATURES of one candidate: its own characters, up to 48 characters on both sides, and the path of the text."""
    v = text[start:end]
    before, after = text[max(0, start - 48) : start], text[end : end + 48]
    n, classes = len(v), [_class(c) for c in v]
    counts = Counter(v)
    switches = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    covered = sum(len(w) for w in re.findall(r"[a-z]{3,}", v.lower()) if w in WORDS)
    near = f"{before} {after}"
    return [
        n, sum(c < 2 for c in classes) / n, classes.count(2) / n, classes.count(1) / n, classes.count(3) / n, switches, switches / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()), len(counts) / n, surprise(v), covered / n, max(counts.values()) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in v)), float(kind not in ("assigned", "loose")), float(kind == "assigned"),
        float(bool(TELLING.search(before[-24:]))), float(bool(BLAND.search(v)) or bool(BLAND.search(near))), float(bool(PATHLIKE.search(before + v)) and "/" in v),
        float(bool(re.search(r"(?i)\.(md|txt|lock|sum|rst|html|svg)$|(^|/)(test|docs?|examples?)/", path))),
    ]


class Forest:
    """Classification trees on resampled rows; each split takes the best of some random features and thresholds."""

    def __init__(self, trees: int = 40, depth: int = 9, seed: int = 11):
        self.trees, self.depth, self.seed, self.grown = trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.grown = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            self.grown.append(self._grow(x[rows], y[rows], self.depth, rng))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        share = float(y.mean())
        if depth == 0 or len(y) < 6 or share in (0.0, 1.0):
            return share
        best = (1e9, 0, 0.0)
        for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
            for t in np.unique(rng.choice(x[:, f], 8)):
                left = x[:, f] <= t
                k = int(left.sum())
                if 0 < k < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    impurity = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                    if impurity < best[0]:
                        best = (impurity, int(f), float(t))
        if best[0] == 1e9:
            return share
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng)

    def score(self, row: list[float]) -> float:
        total = 0.0
        for node in self.grown:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.grown)


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, bool]]:
    """Generated findings (text, path, value, is a secret): keys in code and prose; hashes, identifiers, placeholders and names as the rest."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, b62, up = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    vocabulary = sorted(WORDS)
    prose = lambda: " ".join("".join(rng.choice(["er", "on", "the", "an", "ti", "re", "in", "que", "sch", "a", "o"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 7)))
    out = []
    for i in range(n):
        path = rng.choice(["src/app.py", "config/prod.env", "README.md", "docs/guide.rst", "go.sum", "web/index.html", "", "src3", "test/fixtures.json"])
        if i % 2:
            value = rng.choice([lambda: "AKIA" + pick(up, 16), lambda: "ghp_" + pick(b62, 36), lambda: pick(hexa, rng.choice([18, 24, 32, 40, 64])), lambda: pick(b62, rng.randint(16, 48)), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(b62, 24), lambda: "sk_live_" + pick(b62, 24), lambda: pick(b62 + "!$%&*+-", rng.randint(8, 20))])()
            plain = value.startswith(("AKIA", "ghp_", "xoxb", "sk_live"))
            name = rng.choice(["password", "token", "secret", "api_key", "API_KEY", "client_secret", "passwd", "aws_secret_access_key"])
            join = rng.choice(["=", " = ", ": ", ' = "', '="', "='", ': "'])
            lead = rng.choice(["", "", "key ", "use "]) if plain and rng.random() < 0.6 else name + join
            close = join[-1] if lead.endswith(('"', "'")) else ""
            out.append((f"{prose()} {lead}{value}{close} {prose()}", path, value, True))
        else:
            word = "-".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 5)))
            what = rng.randint(0, 7)
            if what == 0:
                value, lead = pick(hexa, rng.choice([32, 40, 64])), rng.choice(["commit ", "sha256: ", "checksum ", "md5 = ", "hash ", "integrity sha512-", "rev "])
            elif what == 1:
                value, lead = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(["id ", "uuid: ", "guid=", ""])
            elif what == 2:
                value, lead = rng.choice(["changeme", "your-password-here", "example123", "xxxxxxxxxxxx", "<password>", "placeholder", "os.environ", "${TOKEN}", "None", "required", "process.env.TOKEN", "getpass()"]), rng.choice(["password=", "token = ", "secret: ", "api_key="])
            elif what == 3:
                value, lead = f"{word}-{rng.randint(1, 999)}", rng.choice(["see ", "class ", "id=", "file "])
            elif what == 4:
                value, lead = f"{word.replace('-', '/')}/{rng.randint(1, 99)}/{rng.choice(vocabulary)}", rng.choice(["at ", "src/", "from /"])
            elif what == 5:
                value, lead = "".join(w.capitalize() for w in word.split("-")) + str(rng.randint(1, 99)) + "Factory", rng.choice(["new ", "class ", ""])
            elif what == 6:
                value, lead = rng.choice(["policy", "reset", "strength", "field", "manager", "required."]) + rng.choice(["", "s", "-form"]), rng.choice(["password: ", "the token is ", "secret is ", "password is "])
            else:
                value, lead = f"{pick('0123456789', rng.randint(12, 20))}", rng.choice(["card ", "number ", "phone ", "token_count = "])
            out.append((f"{prose()} {lead}{value} {prose()}", path, value, False))
    return out


class Scanner:
    """A trained forest with the counts of ordinary words; small enough to send to every task."""

    def __init__(self, findings: list[tuple[str, str, str, bool]], threshold: float = 0.5):
        self.threshold, self.surprise = threshold, Surprise(sorted(WORDS))
        x, y = [], []
        for text, path, value, label in findings:
            at = text.index(value)
            known = next((k for s, e, k, _ in candidates(text) if s <= at < e), "loose")
            x.append(features(text, at, at + len(value), known, path, self.surprise))
            y.append(float(label))
        self.forest = Forest().fit(np.array(x), np.array(y))

    def scan(self, text: str | None, path: str | None) -> list[tuple[int, int, str, str, float]]:
        """(start, end, kind, value, score) of every candidate of the whole text, in code points."""
        return [(s, e, k, v, self.forest.score(features(text, s, e, k, path or "", self.surprise))) for s, e, k, v in candidates(text or "")]


def scan(docs: DataFrame, scanner: Scanner, *, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per finding that the forest keeps: key, start_at, end_at, kind, value, score. Also those it rejects, with keep = false.

    A null text has no findings, a null path is an empty one. Rows are scanned one by one, so rows that repeat give their
    findings again, and a null key is carried along. An empty table gives none. Time follows the length of a text, whatever it
    holds; where two candidates overlap, the known format goes before the assigned value and this before the loose string,
    and of two of a kind the first. Only the named columns are looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at, rows = [], []
            for i, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                got = shared.value.scan(t, p)
                at += [i] * len(got)
                rows += got
            if rows:
                s, e, k, v, score = zip(*rows, strict=True)
                keep = [x >= shared.value.threshold for x in score]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(k), pa.array(v), pa.array(score), pa.array(keep)], ["id", "start_at", "end_at", "kind", "value", "score", "keep"])

    found = docs.select(F.col(key), F.col(text), F.col(path)).mapInArrow(run, f"id {kind}, start_at long, end_at long, kind string, value string, score double, keep boolean")
    return found.withColumnRenamed("id", key)


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), Scanner(labelled_findings()))
    return found.filter("keep").select("doc_id", "start_at", "end_at", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))
