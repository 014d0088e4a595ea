"""Secret scans: fixed patterns, and a randomness test battery for what the patterns do not name.

Candidates are all runs of LEAST or more token characters outside the fixed spans. The encoding is inferred as the
smallest usual alphabet that holds the run. Three tests ask how far the run is from uniform random text of that encoding:
chi-squared uniformity over the alphabet (by its single characters, with the moments that the test has in short runs, and
by groups of characters, which short runs fill), Wald-Wolfowitz runs above and below the alphabet's middle, and lag-one
serial correlation. Fisher's method combines them: small is random, large is not.

A run is reported as a secret when the null hypothesis "natural text" is rejected. What the statistic is in natural text
is counted on the corpus itself: all words of all documents, dealt over the cells (length class, kind of alphabet) by
hash, are written in the cell's alphabet as natural names are (run together, capitalised, joined by marks), cut to the least length
of the class and tested; a small fixed prose stands beside them so that tiny tables have a null as well. A candidate's
p-value is the share of its cell's natural runs that look at least as random. Benjamini-Hochberg within each class of
length then holds the expected share of natural runs among the reported ones at RATE; no run with a p-value over LEVEL is
reported, however many secrets stand beside it. Where nothing natural was seen in a cell, nothing is reported there. All this works on a table of cells by steps of the statistic, bounded for any corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["assign", "access", "hex", "random"]
#: Characters of a candidate at least.
LEAST = 16
#: Natural runs among the reported ones, expected at most; share of natural runs that look as random as a reported one, at most.
RATE, LEVEL = 0.05, 0.005
#: Steps of the combined statistic a unit, and their number.
STEP, BINS = 4, 480
#: The length class of n characters is 4 log2 n rounded down, up to TOP; in a class the shortest run has least evidence.
BOTTOM, TOP = 16, 28

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}(?![A-Za-z0-9+/_-])")
#: Alphabets from the smallest on (fixed values); the last holds every run, so that none goes untested.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Kinds of alphabet: those of a kind differ in case or marks only, and natural text looks alike in them.
FAMILIES = ["decimal", "hex", "base32", "base36", "base62", "base64", "base64any"]
_FAMILY = {"decimal": 0, "hex": 1, "HEX": 1, "base32": 2, "base36": 3, "BASE36": 3, "base62": 4, "base64": 5, "base64url": 5, "base64any": 6}
_ENCODINGS = [(frozenset(a), len(a), _FAMILY[name], np.array([max(0, a.find(chr(c))) for c in range(128)], np.int64)) for name, a in ALPHABETS.items()]
#: Letters by how common they are in words of many languages (fixed values); with case, digits and marks the groups of the test.
_GROUPS = ("aeio", "tnrsl", "dcumhpg", "bfjkqvwxyz")


def _group(c: str) -> int:
    if not c.isalpha():
        return 8 if c.isdigit() else 9
    return 2 * next(i for i, letters in enumerate(_GROUPS) if c.lower() in letters) + c.isupper()


_GROUP_OF = {a: np.array([_group(c) for c in ALPHABETS[name]]) for name, a in ((n, len(x)) for n, x in ALPHABETS.items())}
_OF_FAMILY = {f: e for e in reversed(_ENCODINGS) for f in [e[2]]}
_CELLS = [(stratum, family) for stratum in range(BOTTOM, TOP + 1) for family in range(len(FAMILIES))]
#: Words in a row that go to one cell.
_DEAL = 64
#: Natural prose beside the corpus (fixed values).
_PROSE = """
The harbour was quiet when the first boats came back in the morning, and nobody on the quay had expected them before noon.
People who had waited through the night walked down to the water, counted the sails twice and began to talk all at once.
In 1987 the council sold 24 of the 130 houses along the river, 16 more followed in 1992, and by 2003 only 45 were left.
Please check the configuration file, restart the background service and compare the version number with the release notes.
Der alte Bahnhof steht seit vielen Jahren leer, doch im Sommer kommen Kinder aus den umliegenden Doerfern zum Spielen her.
Wer die Unterlagen rechtzeitig einreicht, bekommt innerhalb von 14 Tagen eine schriftliche Antwort der Verwaltung, Nummer 2750.
La maison au bord de la riviere appartenait autrefois a un medecin qui soignait gratuitement les familles du village voisin.
Les resultats de cette enquete montrent que 63 personnes sur 100 preferent le train, 21 la voiture et 16 le velo ou la marche.
Cuando terminaron las lluvias los agricultores volvieron a los campos y encontraron los caminos cubiertos de barro y de ramas.
El informe anual describe las actividades de la fundacion, los gastos de 2019 y 2020 y los proyectos previstos para 2021.
Software packages are built from source, tested on several platforms and published with a signature and a list of changes.
Our library opens at 8 30 on weekdays and at 10 15 on Saturdays, the reading room holds 340 seats and 12 study cabins.
"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def encoding(run: str) -> tuple:
    """The smallest alphabet that holds the run: (characters, size, family, values by character code)."""
    used = set(run)
    return next(e for e in _ENCODINGS if used <= e[0])


def chi_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), by the series or continued fraction of the incomplete gamma."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h


def _log_tails(z: np.ndarray, sides: int) -> np.ndarray:
    """-ln of the normal tail beyond z (of one side, or of both beyond |z|)."""
    beyond = z if sides == 1 else np.abs(z)
    return np.array([-math.log(max(1e-300, sides / 2 * math.erfc(x))) for x in (beyond / math.sqrt(2)).tolist()])


def statistic(x: np.ndarray, a: int) -> np.ndarray:
    """Fisher's combination of the tests for each row of values below a; about chi-squared if random."""
    m, n = x.shape
    counts = np.bincount((np.arange(m)[:, None] * a + x).ravel(), minlength=m * a).reshape(m, a)
    chi = a / n * (counts.astype(float) ** 2).sum(axis=1) - n
    unit = 2 * (n - 1) / n  # chi has mean a - 1 and variance (a - 1) * unit in runs of n: a gamma law, made normal by Wilson and Hilferty
    freedom = 2 * (a - 1) / unit
    z = ((np.maximum(chi, 0) / (a - 1)) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    out = _log_tails(z, 1)
    sizes = np.bincount(_GROUP_OF[a], minlength=10)
    if (sizes > 0).sum() > 3:  # decimal and hex have too few groups to tell anything
        grouped = np.zeros((m, 10))
        for g in np.flatnonzero(sizes):
            grouped[:, g] = counts[:, _GROUP_OF[a] == g].sum(axis=1)
        expected = n / a * sizes[sizes > 0]
        chi = ((grouped[:, sizes > 0] - expected) ** 2 / expected).sum(axis=1)
        k = len(expected) - 1
        out += _log_tails(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)), 1)
    up = 2 * x >= a
    n1 = up.sum(axis=1)
    n0 = n - n1
    runs = 1 + (up[:, 1:] != up[:, :-1]).sum(axis=1)
    mean = 1 + 2 * n0 * n1 / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    out += np.where(n0 * n1 > 0, _log_tails((runs - mean) / spread, 2), (n - 1) * math.log(2))
    mid, var = (a - 1) / 2, (a * a - 1) / 12
    out += _log_tails(((x[:, 1:] - mid) * (x[:, :-1] - mid)).sum(axis=1) / var / math.sqrt(n - 1), 2)
    return 2 * out


def battery(run: str) -> float:
    """Combined p-value of the run being uniform random text of its encoding."""
    _, a, _, values = encoding(run)
    tests = 3 + (len(np.unique(_GROUP_OF[a])) > 3)
    return chi_tail(float(statistic(values[np.frombuffer(run.encode(), np.uint8)][None, :], a)[0]), 2 * tests)


def _step(f: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, (f * STEP).astype(np.int64))


def _cell(n: int, family: int) -> int:
    return (min(TOP, int(4 * math.log2(n))) - BOTTOM) * len(FAMILIES) + family


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, run) of the runs to test: all that no fixed span overlaps."""
    out, at = [], 0
    for m in _RUN.finditer(text):
        while at < len(base) and base[at][2] <= m.start():  # spans by start; those of a kind do not overlap
            at += 1
        if not any(s < m.end() and m.start() < e for s, _, e in base[at : at + len(KINDS)]):
            out.append((m.start(), m.end(), m.group()))
    return out


def tested(runs: list[str]) -> list[tuple[int, int]]:
    """(cell, step of the statistic) of each run; runs of one encoding and length are tested together."""
    alike: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, run in enumerate(runs):
        alike[(next(k for k, e in enumerate(_ENCODINGS) if set(run) <= e[0]), len(run))].append(i)
    out: list[tuple[int, int]] = [(0, 0)] * len(runs)
    for (k, n), members in alike.items():
        _, a, family, values = _ENCODINGS[k]
        x = values[np.frombuffer("".join(runs[i] for i in members).encode(), np.uint8)].reshape(len(members), n)
        for i, step in zip(members, _step(statistic(x, a)).tolist(), strict=True):
            out[i] = (_cell(n, family), step)
    return out


_TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_WHITE = b" \t\n\x0b\x0c\r"
_OTHERS = bytes(c for c in range(256) if c not in _TOKEN + _WHITE)
_DROP = {f: bytes(c for c in range(256) if chr(c) not in e[0]) for f, e in _OF_FAMILY.items()}


def _written(words: list[bytes], family: int) -> bytes:
    """The words written in an alphabet the way natural names are."""
    if family <= 3:
        text = b"".join(words)
        text = text.upper() if family == 2 else text.lower()
    else:
        text = (b"", b"/", b"-")[family - 4].join(map(bytes.capitalize, words))
    return text.translate(None, _DROP[family])


def _steps(text: bytes, cell: int, shift: int | None = None) -> np.ndarray:
    """Steps of the statistic of the runs of a cell's length in text, end to end or, with a shift, overlapping."""
    family, n = _CELLS[cell][1], _least(cell)
    if len(text) < n:
        return np.zeros(0, np.int64)
    x = _OF_FAMILY[family][3][np.frombuffer(text, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(x, n)[:: shift or n]
    return _step(statistic(rows, _OF_FAMILY[family][1]))


def _least(cell: int) -> int:
    """Characters of a cell's shortest run."""
    return math.ceil(2 ** (_CELLS[cell][0] / 4))


@cache
def _prose() -> Counter:
    """(cell, step) counts of the fixed prose."""
    words = _PROSE.encode().translate(None, _OTHERS).split()
    return Counter((c, s) for c, (_, family) in enumerate(_CELLS) for s in _steps(_written(words, family), c, 5).tolist())


def natural(texts: list[str], ids: list[int | None] | None = None) -> Counter:
    """(cell, step) counts of natural runs from all words of the texts.

    Each _DEAL words in a row of a text go to the cell that their hash, seeded by the text's id, names, and make runs
    among themselves only. So the counts of a table are the same in whatever files and batches it comes.
    """
    parts: list[list[bytes]] = [[] for _ in _CELLS]
    for text, doc_id in zip(texts, ids or [0] * len(texts), strict=True):
        words = text.encode("utf-8", "surrogatepass").translate(None, _OTHERS).split()
        for i in range(0, len(words), _DEAL):
            some = words[i : i + _DEAL]
            cell = zlib.crc32(b" ".join(some), (doc_id or 0) & 0xFFFFFFFF) % len(_CELLS)
            run = _written(some, _CELLS[cell][1])
            parts[cell].append(run[: len(run) - len(run) % _least(cell)])
    return Counter((cell, s) for cell, runs in enumerate(parts) for s in _steps(b"".join(runs), cell).tolist())


def cuts(found: dict[tuple[int, int], int], seen: dict[tuple[int, int], int], rate: float = RATE, level: float = LEVEL) -> dict[int, int]:
    """By cell the largest step that is reported, by Benjamini-Hochberg within each class of length.

    found and seen are the (cell, step) counts of the candidates and of natural runs.
    """
    below: dict[int, np.ndarray] = {}
    for (cell, step), n in seen.items():
        below.setdefault(cell, np.zeros(BINS, np.int64))[step] += n
    p: dict[tuple[int, int], float] = {}
    for cell, counts in below.items():
        sums = np.cumsum(counts)
        p.update({(cell, b): (1 + sums[b]) / (1 + sums[-1]) for b in range(BINS)})
    out: dict[int, int] = {}
    for stratum in {_CELLS[c][0] for c, _ in found}:
        mine = sorted((p.get(key, 1.0), n, key) for key, n in found.items() if _CELLS[key[0]][0] == stratum)
        total, rank, limit = sum(n for _, n, _ in mine), 0, 0.0
        for value, n, _ in mine:
            rank += n
            if value <= min(level, rate * rank / total):
                limit = value
        for value, _, (cell, step) in mine:
            if value <= limit:
                out[cell] = max(out.get(cell, -1), step)
    return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATE = "array<struct<start:int,end:int,cell:int,step:int>>"
_COUNT = "array<struct<cell:int,step:int,n:long>>"
_SCANNED = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPAN}, found {_CANDIDATE}, natural {_COUNT}"


def _scan(batches):
    numbers = lambda *names: pa.list_(pa.struct([(c, pa.int64() if c == "n" else pa.int32()) for c in names]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), numbers("start", "kind", "end"), numbers("start", "end", "cell", "step"), numbers("cell", "step", "n")]
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            out: list[list] = [[] for _ in kinds]
            texts = [t or "" for t in part.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            runs = [candidates(t, b) for t, b in zip(texts, spans, strict=True)]
            results = iter(tested([r for mine in runs for _, _, r in mine]))
            for base, mine in zip(spans, runs, strict=True):
                n = Counter(k for _, k, _ in base)
                row = [n[0], n[1], n[2], hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()]
                row += [[dict(start=s, kind=k, end=e) for s, k, e in base], [dict(start=s, end=e, cell=c, step=b) for (s, e, _), (c, b) in zip(mine, results, strict=False)], []]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            out[-1][0] = [dict(cell=c, step=b, n=n) for (c, b), n in natural(texts, part.column(0).to_pylist()).items()]  # of the whole slice, at its first row
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found", "natural"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.lean(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def _cuts(rows: DataFrame) -> dict[int, int]:
    one = F.lit(1).cast("long")
    found = rows.select(F.explode("found").alias("f")).select("f.cell", "f.step", one.alias("n"), F.lit(True).alias("asked"))
    seen = rows.select(F.explode("natural").alias("f")).select("f.cell", "f.step", "f.n", F.lit(False).alias("asked"))
    table = found.unionByName(seen).groupBy("cell", "step", "asked").agg(F.sum("n").alias("n")).collect()  # at most two for each cell and step
    asked = {(r.cell, r.step): r.n for r in table if r.asked}
    return cuts(asked, _prose() + Counter({(r.cell, r.step): r.n for r in table if not r.asked}))


def _kept(cut: dict[int, int]) -> Column:
    """Reported candidates as spans of kind random."""
    limit = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]) if cut else F.create_map().cast("map<int,int>")
    keep = F.filter("found", lambda c: c["step"] <= F.coalesce(F.try_element_at(limit, c["cell"]), F.lit(-1)))
    return F.transform(keep, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind) of every row.

    A null text is empty; null ids and repeated rows are kept; texts are read whole, however long; other columns are not read;
    no rows give no rows. The result does not depend on how the table is laid out in files.
    """
    rows = common.durable(_texts(docs, id_col, text_col).mapInArrow(_scan, _SCANNED), "secrets")
    spans = F.array_sort(F.concat("base", _kept(_cuts(rows))))
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(one, ",").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col replaced by mark (overlapping spans by one), all other columns as they are.

    Texts stay where they are: a first pass returns only the counts of the statistic, a second pass rewrites. Rows
    without a secret keep their text, null texts included.
    """
    rows = _texts(docs, id_col, text_col).mapInArrow(_scan, _SCANNED)
    cut = _cuts(rows.select("found", "natural"))
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bases = [base_spans(t or "") for t in texts]
            runs = [candidates(t or "", b) for t, b in zip(texts, bases, strict=True)]
            results = iter(tested([r for mine in runs for _, _, r in mine]))
            for i, (base, mine) in enumerate(zip(bases, runs, strict=True)):
                spans = [(s, e) for s, _, e in base] + [(s, e) for (s, e, _), (c, b) in zip(mine, results, strict=False) if b <= cut.get(c, -1)]
                if spans:
                    texts[i] = _replace(texts[i], spans, mark)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names)

    return common.lean(docs).mapInArrow(run, docs.schema)


def _replace(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, done = [], 0
    for s, e in sorted(spans):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]])
