import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import secrets

SCHEMA = "doc_id long, text string, spans string, base int"


def brute(text):
    out = [("assign", *m.span()) for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def texts():
    rng = random.Random(5)
    bits = ["token", "TOKEN", "ſecret", "secret", "api_key", "ApiKey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123456789abcdef", "x.y-z", "K", "token=token=abcdefgh", "\n", "é", "passwd", "password"]
    return [None, "", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(2500)]


def test_base_like_the_patterns():
    for t in texts():
        got = [(secrets.KINDS[k], s, e) for s, k, e in secrets.base_spans(t or "")]
        assert got == brute(t or ""), t


NATURAL = ["the_quick_brown_fox_jumps_2024_edition", "internationalization20240101", "aaaaaaaaaaaaaaaaaaaaaaaa1", "2024010120240102202401032024", "src/main/java/org/example/util9", "build-artifact-20240112", "HttpRequestHandlerFactoryBean", "donaudampfschifffahrtsgesellschaft", "INTERNATIONALISIERUNGSBEHOERDE"]


def test_battery_tells_random_from_words():
    rng = random.Random(8)
    made = [base64.b64encode(rng.randbytes(30)).decode().strip("=") for _ in range(300)] + ["".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(40)) for _ in range(300)]
    p = sorted(secrets.battery(x) for x in made)
    assert sum(x < 0.05 for x in p) < 70 and sum(x < 1e-4 for x in p) <= 4
    for x in NATURAL:
        assert secrets.battery(x) < 1e-3, x


def test_statistic_in_rows_is_that_of_single_rows():
    rng = np.random.default_rng(4)
    for a in (10, 16, 32, 36, 62, 64, 66):
        x = rng.integers(0, a, (50, 33))
        assert np.allclose(secrets.statistic(x, a), [secrets.statistic(x[i : i + 1], a)[0] for i in range(50)])


def test_chi_squared_is_over_the_alphabet():
    # every letter group as often as expected, but two characters only in each: the single characters tell
    alphabet, rng = secrets.ALPHABETS["base62"], random.Random(2)
    groups = {}
    for c in alphabet:
        groups.setdefault(secrets._group(c), []).append(c)
    value = {c: i for i, c in enumerate(alphabet)}
    poor = [[value[rng.choice(groups[secrets._group(rng.choice(alphabet))][:2])] for _ in range(64)] for _ in range(200)]
    rich = [[rng.randrange(62) for _ in range(64)] for _ in range(200)]
    assert np.median(secrets.statistic(np.array(poor), 62)) > 3 * np.median(secrets.statistic(np.array(rich), 62))


def test_secrets_are_found_without_patterns_and_words_are_not():
    """Held-out: random keys of every usual encoding and length against names, in a corpus of prose."""
    rng = random.Random(12)
    words = secrets._PROSE.split()
    corpus = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(800)]
    seen = secrets._prose() + secrets.natural(corpus)
    made = [(k, n, "".join(rng.choice(secrets.ALPHABETS[k]) for _ in range(n))) for k, n in [("base62", 24), ("base62", 40), ("base64", 43), ("base64url", 43), ("base36", 32), ("BASE36", 25), ("base32", 32), ("base62", 20)] for _ in range(40)]
    names = NATURAL + ["".join(rng.choice(words).strip(".,").capitalize() for _ in range(4)) for _ in range(300)] + ["-".join(rng.choice(words).strip(".,") for _ in range(5)) for _ in range(300)]
    names = [x for x in names if len(x) >= secrets.LEAST and x.isascii()]
    cut = secrets.cuts(Counter(secrets.tested([r for *_, r in made] + names)), seen)
    hit = [b <= cut.get(c, -1) for c, b in secrets.tested([r for *_, r in made])]
    by = Counter()
    for (k, n, _), h in zip(made, hit, strict=True):
        by[(k, n)] += h
    # long keys are nearly all found; 20 to 32 characters of 32 to 62 kinds hold less evidence: 52 % to 85 % (README)
    assert all(by[(k, n)] >= (36 if n >= 40 else 18) for k, n, _ in made), by
    wrong = sum(b <= cut.get(c, -1) for c, b in secrets.tested(names))
    assert wrong <= 0.05 * sum(hit), wrong


def test_a_name_is_no_secret_among_many_keys():
    rng = random.Random(13)
    seen = secrets._prose() + secrets.natural([secrets._PROSE * 30])
    keys = ["".join(rng.choice(secrets.ALPHABETS["base64url"]) for _ in range(23)) + "-" for _ in range(20_000)]
    cut = secrets.cuts(Counter(secrets.tested([*keys, "build-artifact-20240112"])), seen)
    assert [b <= cut.get(c, -1) for c, b in secrets.tested(["build-artifact-20240112"])] == [False]


def test_nothing_is_reported_where_nothing_natural_was_seen():
    assert secrets.cuts({(7, 3): 5}, {}) == {}


PATHS = ["com/news/2024/some-article-title", "org/wiki/List_of_things-2024/part", "com/blog/2023/10/how-to-bake-bread"]


def test_every_run_has_an_encoding():
    assert set("+/-_") < secrets.encoding("a+/-_")[0]
    for x in PATHS:
        assert secrets.battery(x) < 1e-3, x
    rng = random.Random(6)
    made = ["".join(rng.choice(secrets.ALPHABETS["base62"] + "+/-_") for _ in range(40)) + "/-" for _ in range(300)]
    assert sum(secrets.battery(x) < 0.05 for x in made) < 45


def test_paths_are_no_secrets(spark):
    docs = [(i, f"see https://example.{p} for more", "x", 1) for i, p in enumerate(PATHS * 3)]
    assert [r.spans for r in secrets.scan(spark.createDataFrame(docs, SCHEMA)).collect()] == [""] * len(docs)
    assert {r.text for r in secrets.redact(spark.createDataFrame(docs, SCHEMA)).collect()} == {t for _, t, *_ in docs}


def test_chi_tail():
    for x, k, want in [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (30.0, 6, 3.94e-5), (0.5, 4, 0.9735)]:
        assert abs(secrets.chi_tail(x, k) - want) < 2e-4 * max(1, want)


def test_cuts_like_benjamini_hochberg():
    rng = random.Random(3)
    cells = [c for c, (stratum, _) in enumerate(secrets._CELLS) if stratum == 20]
    seen = Counter((rng.choice(cells), min(secrets.BINS - 1, int(rng.gauss(200, 60)))) for _ in range(9000))
    found = [(rng.choice(cells), min(secrets.BINS - 1, max(0, int(rng.choice([rng.gauss(200, 60), rng.gauss(25, 10)]))))) for _ in range(300)]
    cut = secrets.cuts(Counter(found), seen, 0.05, 1.0)
    n = Counter(c for c, _ in seen.elements())
    p = [(1 + sum(m for (d, s), m in seen.items() if d == c and s <= b)) / (1 + n[c]) for c, b in found]
    k = max((i + 1 for i, x in enumerate(sorted(p)) if x <= 0.05 * (i + 1) / len(p)), default=0)
    assert sum(b <= cut.get(c, -1) for c, b in found) == k > 50


def test_long_texts_take_linear_time():
    import time

    began = time.process_time()
    text = 'token = "abcdefghijkl" some_long_identifier_in_text ' * 20_000
    assert len(secrets.candidates(text, secrets.base_spans(text))) == 20_000
    assert time.process_time() - began < 10


def _docs():
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate(texts()[:300])]
    keys = {}
    for i in range(120):
        keys[5000 + i] = "".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(44))
        docs.append((5000 + i, f"some words {keys[5000 + i]} and more words internationalization20240101 end"))
    return docs + [(None, "nothing here"), (5000, docs[300][1])], keys


def test_query(spark):
    docs, keys = _docs()
    got = secrets.scan(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)).collect()
    want = Counter()
    for d, t in docs:
        spans = brute(t or "")
        n = Counter(k for k, _, _ in spans)
        want[(d, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    text = dict(docs)
    hits = 0
    for r in got:
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert set(f"{k}:{s}:{e}" for k, s, e in brute(text[r.doc_id] or "")) <= set(r.spans.split(","))
        if r.doc_id in keys:
            parts = [text[r.doc_id][int(s) : int(e)] for k, s, e in spans if k == "random"]
            hits += parts == [keys[r.doc_id]]
            assert "internationalization20240101" not in parts
    assert hits >= 110
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redact(spark):
    docs, keys = _docs()
    got = secrets.redact(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)).collect()
    assert len(got) == len(docs) and got[0].spans == "x"
    assert sum("[SECRET]" in r.text for r in got if r.doc_id in keys) >= 110
    assert any(r.text is None for r in got) and any(r.text == "nothing here" for r in got)
    clean = {r.doc_id: r.text for r in got}
    assert clean[2] == "[SECRET]\""


def test_layout_does_not_matter(spark):
    rng = random.Random(8)
    words = secrets._PROSE.split()
    texts_ = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    ids = list(range(300))
    parts = sum((secrets.natural(texts_[k : k + 37], ids[k : k + 37]) for k in range(0, 300, 37)), Counter())
    assert parts == secrets.natural(texts_, ids)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.union(spark.createDataFrame([(10**6 + i, f"{t} {''.join(rng.choice(secrets.ALPHABETS['base62']) for _ in range(24 + i % 9))} end") for i, t in enumerate(texts_)], docs.schema))
    one, seven = ({tuple(r) for r in secrets.scan(rows.repartition(n, "doc_id")).collect()} for n in (1, 7))
    assert one == seven and any("random" in r[-1] for r in one)
