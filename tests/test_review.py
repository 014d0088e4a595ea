"""Review windows, dataset edits, scopes, citations, segmented and table sources, PDF sections."""

import random
import re

import pytest

from lodestone.operators import chunking, datasets, prepare, review

ITEM = "item_id long, display_text string, query_text string, answer_text string, evidence_texts array<string>"


def brute_windows(display, query, answer, hints):
    """Sequential version of review.windows()."""
    toks = lambda t: set(re.findall(r"[A-Za-z0-9%$.,/一-鿿-]+", t.lower()))
    pack = lambda t: re.sub(r"[\s,.$()%/-]+", "", t.lower())
    display, query, answer = display or "", query or "", (answer or "").strip()
    hints = [h.strip() for h in hints or [] if h and h.strip()]
    signal = toks(" ".join(p for p in [query.strip(), answer, *hints] if p))
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", query)]
    grams = [" ".join(words[i : i + n]) for n in (6, 5, 4, 3) for i in range(len(words) - n + 1)]
    grams = [g for g in dict.fromkeys(grams) if g not in review.COMMON_PHRASES][:12]
    found, n, at = [], 0, 0
    for part in re.split(r"(\n{2,})", display):
        body = part.strip()[:1400]
        if body:
            n += 1
            seen = toks(body)
            score = len(seen & signal) / len(seen | signal) if seen and signal else 0.0
            score += 0.35 * (len(answer) >= 3 and pack(answer) in pack(body))
            score += 0.25 * any(pack(h) in pack(body) for h in hints if len(h) >= 3)
            score += 0.45 * any(g in body.lower() for g in grams)
            if score > 0:
                found.append((-round(score, 6), at, f"W{n}", body))
        at += len(part)
    out, begun = [], set()
    for s, a, w, body in sorted(found):
        if body[:240].strip() not in begun and len(out) < 12:
            begun.add(body[:240].strip())
            out.append((w, a, a + len(body), body, -s))
    return out or [("W1", 0, len(display[:1400]), display[:1400], 0.0)]


def test_windows_like_the_sequential_version(spark):
    rng = random.Random(3)
    words = "what is the total of 3.5% $12,000 in 2019 年 收入 net-income Yes no (loss) a/b".split()
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(1, None, None, None, None), (2, "", "q", "a", []), (3, "\n\n \n\n", "q", "a", [None]), (4, "x\n\n\n\ny\n", "total of", "zz", ["..."])]
    for i in range(5, 60):
        blocks = [line(rng.choice([0, 1, 3, 12])) for _ in range(rng.randint(1, 30))]
        text = "".join(b + "\n" * rng.randint(1, 4) for b in blocks + blocks[:2])
        rows.append((i, text, line(rng.randint(0, 9)), line(rng.randint(0, 2)), [line(rng.randint(0, 3)) for _ in range(rng.randint(0, 2))]))
    rows.append((60, "\n\n".join(f"{k} total of net-income " + "x" * 2000 for k in range(50)), "total of net-income", "net-income", None))
    got = {}
    for r in review.windows(spark.createDataFrame(rows, ITEM)).collect():
        got.setdefault(r.item_id, []).append((r.window_id, r.start_offset, r.end_offset, r.window_text, r.score))
    for i, *rest in rows:
        want = sorted(brute_windows(*rest))
        assert [x[:4] for x in sorted(got[i])] == [x[:4] for x in want], i
        assert [x[4] for x in sorted(got[i])] == pytest.approx([x[4] for x in want], abs=2e-6)
    assert review.windows(spark.createDataFrame([], ITEM)).count() == 0


def test_quotes(spark):
    shown = spark.createDataFrame([(1, "W1", 10, "ab cd ab"), (1, "W2", 30, "cd")], "item_id long, window_id string, start_offset int, window_text string")
    snippets = [(1, "W1", " cd "), (1, "W1", "cd"), (1, "W2", "cd"), (1, "W3", "cd"), (1, "W1", "  "), (1, "W1", "zz"), (1, "W1", None)]
    out = review.quoted_spans(shown, spark.createDataFrame(snippets, "item_id long, window_id string, quote string")).collect()
    assert sorted((r.start_offset, r.end_offset) for r in out) == [(13, 15), (30, 32)]


def test_span_edits(spark):
    docs = spark.createDataFrame([(1, "ready", "x" * 50), (2, "processing", "x" * 50), (3, "ready", None)], "document_id long, status string, display_text string")
    edits = [
        (1, 1, "add", 1, 0, 5, 1), (1, 2, "add", 1, 0, 5, 3), (1, 3, "add", 1, 6, 9, 2),  # the same offsets: the grade changes
        (2, 1, "add", 1, 0, 5, 1), (2, 2, "miss", None, 0, 0, None),  # a miss replaces spans
        (3, 1, "miss", None, 0, 0, None), (3, 2, "add", 1, 0, 5, 1),  # a span clears the miss
        (4, 1, "miss", None, 0, 0, None), (4, 2, "add", 1, 0, 51, 1), (4, 3, "add", 2, 0, 5, 1), (4, 4, "add", 3, 0, 0, 1),  # refused
        (5, 1, "add", 9, 0, 5, 1),
    ]
    schema = "item_id long, seq long, op string, document_id long, start_offset int, end_offset int, grade int"
    out = datasets.replayed_spans(spark.createDataFrame(edits, schema), docs).collect()
    assert sorted((r.item_id, r.start_offset, r.end_offset, r.grade or 0, r.is_miss) for r in out) == [(1, 0, 5, 3, False), (1, 6, 9, 2, False), (2, 0, 0, 0, True), (3, 0, 5, 1, False), (4, 0, 0, 0, True)]
    assert datasets.replayed_spans(spark.createDataFrame([], schema), docs).count() == 0


def test_scopes(spark):
    docs = spark.createDataFrame([(1, "ready", "a.md"), (2, "failed", "b.md")], "document_id long, status string, file_name string")
    items = [(1, "explicit", [1, 2], ["a.md", "c.md"]), (2, "routing", [9], []), (3, "explicit", [], []), (4, "explicit", [], ["a.md", "a.md"])]
    out = {r.item_id: (r.status, r.resolved, r.errors) for r in datasets.validated_scopes(spark.createDataFrame(items, "item_id long, mode string, document_ids array<long>, file_names array<string>"), docs).collect()}
    assert out[1] == ("invalid", [1], ["invalid_document_id:2", "invalid_document_file_name:c.md"])
    assert (out[2][0], out[3][0], out[4]) == ("routing", "validated", ("validated", [1], []))


def test_segmented_tokens(spark):
    def brute(tokens):
        latin = lambda t: re.fullmatch("[A-Za-z0-9][A-Za-z0-9._:/+%-]*", t)
        t = [x.strip() for x in tokens if x.strip()]
        return "".join((" " if i and latin(t[i - 1]) and latin(x) else "") + x for i, x in enumerate(t))

    rows = [["iPhone", "11", "多少", "钱", "?", "about", "1001", "$", "(", "http://a.b", ")"], ["1", "0", "1 ", "", "21"], [], ["a"]]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t array<string>").select(prepare.segmented_text("t")).collect()]
    assert got == [brute(r) for r in rows]


def test_marked_documents(spark):
    from pyspark.sql import functions as F

    doc = lambda n, m: (n, m)
    rows = [
        (1, [doc(0, None), doc(1, True), doc(2, False)], [0, 7]),
        (2, [doc(0, False), doc(1, None), None, doc(3, False)], None),
        (3, [], [0]),
    ]
    df = spark.createDataFrame(rows, "k int, d array<struct<n:int,is_selected:boolean>>, a array<int>")
    got = {r.k: r.n for r in df.select("k", F.transform(prepare.marked_documents(F.col("d"), F.col("a")), lambda x: x["n"]).alias("n")).collect()}
    assert got == {1: [0, 1], 2: [0, 1], 3: []}


def test_table_questions(spark):
    assert prepare.subset_names(" fin, tat ,") == ["fin", "tat"]
    for bad in ("", " , ", "fin,other"):
        with pytest.raises(ValueError):
            prepare.subset_names(bad)
    assert prepare.entry_texts({"question": {"text": " q "}, "answers": [{"answer": ""}, 3, {"answer": ["a", None, "b"]}], "evidence": {"pre_text": [" x  y ", "x y"], "table": [["1", 2]]}}) == ("q", "a\nb", "1\n2\nx y")
    assert prepare.entry_texts({"answers": {"answer": " ", "exe_answer": 4.5}, "evidence": [], "facts": "f"}) == ("", "4.5", "f")
    assert prepare.entry_texts({"short_answer": "s", "context": {"content": "c"}}) == ("", "s", "c")
    e = spark.createDataFrame([("fin", 1, "a.pdf", 0, '{"question": "q", "answer": "a"}')], "subset string, document_id long, source_file string, item_index int, entry string")
    assert [tuple(r) for r in prepare.table_question_rows(e).collect()] == [("fin", "1", "a.pdf", 0, "q", "a", "")]


def test_pdf_sections():
    s = lambda kind, text, heading="H": chunking.Section(kind, text, heading)
    shape = lambda rows: [(x.kind, len(x.text), x.heading, len(x.parts)) for x in chunking.consolidate(rows, 100)]
    assert shape([s("text", "a" * 50), s("table", "b" * 300), s("text", "c" * 50)]) == [("text", 404, "H", 3)]
    assert shape([s("text", "a" * 150), s("table", "b"), s("text", "c" * 50)]) == [("text", 150, "H", 0), ("table", 1, "H", 0), ("text", 50, "H", 0)]
    assert shape([s("text", "a" * 60), s("text", "b" * 60), s("text", "c" * 20)]) == [("text", 144, "H", 0)]  # the short rest joins
    assert shape([s("text", "a" * 60), s("text", "b" * 60, "G")]) == [("text", 60, "H", 0), ("text", 60, "G", 0)]
    assert shape([s("table", "a"), s("table", "b"), s("table", "c", "G")]) == [("table", 4, "H", 0), ("table", 1, "G", 0)]
    assert shape([]) == []


def test_packages(spark, tmp_path):
    from lodestone.operators import packages

    articles = spark.createDataFrame([(i, packages.INSTRUCTION + " 一。二！", "甲。乙？丙。") for i in range(12)] + [(99, "", "")], "k int, article string, summary string")
    a = packages.article_items(articles, ["k"]).orderBy("item_index").collect()
    assert len(a) == 10 and a[9].id == "lcsts-summary-10" and a[0].documents[0].content == "一。二！"
    assert (a[0].required_claims_or_axes, a[0].gold_span_refs[0].quote, a[0].expected_document_names) == (["甲", "乙"], "一", ["lcsts-article-01.md"])
    reports = spark.createDataFrame([(1, "A one. TwoNEWLINE_CHARx ||||| |||||B|||||C|||||D", " S one. S two! S three ")], "k int, source string, summary string")
    r = packages.report_items(reports, ["k"]).first()
    assert [d.content for d in r.documents] == ["A one. Two\nx", "B", "C"]
    assert ([q.quote for q in r.gold_span_refs], r.required_claims_or_axes) == (["A one.", "B", "C"], ["S one.", "S two!"])
    schema = "place int, turns array<struct<speaker:string,content:string>>, topics array<struct<topic:string,span:array<int>>>, queries array<struct<query:string,answer:string,span:array<int>>>"
    turns = [("X", "hello"), ("Y", "there"), ("Z", "end")]
    m = packages.meeting_items(spark.createDataFrame([(1, turns, None, [("q3", "c", [3, 3])]), (0, turns, [("T", [2, 3]), (None, [2, 3])], [("q1", "a.", None), ("q2", "b.", [2, 3])])], schema)).orderBy("item_index").collect()
    assert [(x.question, [q.quote for q in x.gold_span_refs], x.expected_section_headings) for x in m] == [("q1", ["hello"], []), ("q2", ["there", "end"], ["T", "meeting topic"]), ("q3", ["end", "end"], [])]
    assert m[2].expected_document_names == ["qmsum-meeting-02.md"] and m[0].documents[0].content.startswith("### X\nhello\n\n### Y")
    c = packages.comparison_items(spark.createDataFrame([(1, ["p", "q"], ["r"], ["s"])], "k int, a array<string>, b array<string>, common array<string>"), ["k"]).first()
    assert c.reference_answer == "Entity A: p Entity B: r Shared points: s" and c.documents[0].content == "# Entity A\n\np\n\nq"
    packages.write_package(packages.report_items(reports, ["k"]), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/questions").count() == 1 and spark.read.json(f"{tmp_path}/source_documents").count() == 3
    assert packages.report_items(reports.limit(0), ["k"]).count() == 0


def test_report_without_datasets(spark):
    from lodestone.operators import packages

    run = spark.createDataFrame([("p", "1", 0, 1, 0, 0, "scored", "scored", "{}")], "name string, version string, items int, workers int, judge_failed int, partial_items int, summary_score string, compare_score string, deltas string")
    none = spark.createDataFrame([], "dataset string, metric string, value double, status string, partial boolean")
    assert "## Per Dataset Scores\n\n- 無\n" in packages.run_report(run, none).first().report
