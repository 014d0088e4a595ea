"""Hand-computed cases of the operators."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text, vectorised
from lodestone.operators import assemble, chunking, curation, gates, mentions, metrics, parsing, recall, rerank, routing, selection
from lodestone.operators import documents as ops
from lodestone.operators import serving as serving_ops
from lodestone.sources import adapters, readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_and_language(spark):
    r = one(spark, text.query_tokens(F.lit("申請 ABC-1")), text.query_tokens(F.lit("申請書 ß Abc abc")), *[text.language(F.lit(x)) for x in ("摘要", "abc", "abc 摘要", "123")])
    assert r[0] == ["申請", "abc-1"]
    assert r[1] == ["申請書", "申請", "請書", "ss", "abc"]
    assert list(r[2:]) == ["zh-TW", "en", "mixed", "en"]


def test_text_functions(spark):
    r = one(
        spark,
        text.squeeze(F.lit("  a \n b　c ")),
        text.document_name(F.lit("My_Policy-Guide v2.pdf")),
        text.reference_query(F.lit("Summarize  the plan")),
        text.merge_tables(F.array(F.lit("| a |\n| --- |\n| 1 |"), F.lit("| a |\n| --- |\n| 2 |\n| 3 |"), F.lit("loose"))),
        text.merge_texts(F.array(F.lit(" a "), F.lit(" "), F.lit("b"))),
        text.truncated(F.lit("abcdefghij"), 6),
        text.from_handle(text.handle(F.lit("id-1?"))),
        text.from_handle(F.lit("nope")),
        text.clean_pdf_markdown(F.lit("page 1\na\n\n\n\n---\nb\nPage 2 of 3")),
        text.ordered_distinct(F.array(F.lit("b "), F.lit("a"), F.lit(""), F.lit("b"))),
        text.sentences(F.lit("One. Two! Three"), F.lit("en")),
        text.sentences(F.lit("甲。乙！"), F.lit("zh-TW")),
    )
    assert list(r[:3]) == ["a b c", "my policy guide", "the plan"]
    assert r[3] == "| a |\n| --- |\n| 1 |\n| 2 |\n| 3 |\nloose" and r[4] == "a\n\nb" and r[5] == "abc..."
    assert r[6] == "id-1?" and r[7] is None and r[8] == "a\n\nb" and r[9] == ["b", "a"]
    assert r[10] == ["One.", "Two!", "Three"] and r[11] == ["甲。", "乙！"]


def test_scores(spark):
    v = lambda *x: F.array(*[F.lit(float(a)) for a in x])
    r = one(spark, scoring.cosine_distance(v(1, 0), v(0, 2)), scoring.cosine_distance(v(1, 0), F.lit(None).cast("array<double>")), scoring.cosine_similarity(v(0, 0), v(1, 1)), scoring.rrf(F.lit(2), F.lit(1)), scoring.rrf(F.lit(None).cast("int"), F.lit(2)), scoring.padded(v(1), 3))
    assert r[0] == 1.0 and r[1] == 1.0 and r[2] == 0.0 and r[3] == pytest.approx(1 / 62 + 1 / 61) and r[4] == pytest.approx(1 / 62) and r[5] == [1.0, 0.0, 0.0]
    e = one(spark, scoring.deterministic_embedding(F.lit("x"), 24))[0]
    assert sum(x * x for x in e) == pytest.approx(1) and len(set(e)) == 24
    o = one(spark, scoring.ordered_coverage(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "acx"))), scoring.overlap_ratio(F.array(*map(F.lit, "ab")), F.array(*map(F.lit, "bcd"))))
    assert o[0] == pytest.approx(2 / 3) and o[1] == 0.5


def test_metrics(spark):
    rows = [("q", "s", i + 1, d, r) for i, (d, r) in enumerate([(1, 0), (1, 3), (2, 2), (9, 0)])]
    ranked = spark.createDataFrame(rows, "query_id string, stage string, rank int, document_id long, relevance int")
    gold = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "query_id string, document_id long")
    m = metrics.stage_metrics(ranked, gold, 4, ["query_id", "stage"]).first()
    assert m.recall == 1.0 and m.mrr == 0.5 and m.precision == 0.5 and m.first_hit_rank == 2 and m.max_relevance == 3 and m.doc_coverage == pytest.approx(2 / 3)
    ideal = metrics.stage_metrics(spark.createDataFrame([("q", "s", i + 1, 1, r) for i, r in enumerate([3, 2, 0])], ranked.schema), gold, 3, ["query_id", "stage"]).first()
    assert ideal.ndcg == pytest.approx(1.0)
    spans = spark.createDataFrame([("q", 1, 5027, 6545, 3), ("q", 1, 10, 20, 2)], "query_id string, document_id long, start_offset int, end_offset int, grade int")
    cand = spark.createDataFrame([("q", 1, 5027, 9730, 1), ("q", 1, 0, 10, 2)], "query_id string, document_id long, start_offset int, end_offset int, item int")
    assert {r.item: r.relevance for r in metrics.relevance(cand, spans, ["query_id", "item"]).collect()} == {1: 3, 2: 0}


def _groups(spark, docs):
    return spark.createDataFrame([(1, d, i, i) for i, d in enumerate(docs, 1)], "query_id long, document_id long, parent_id long, group_rank int")


def _picked(df):
    return [r.parent_id for r in df.orderBy("select_rank").collect()]


def test_selection(spark):
    g = _groups(spark, [1, 1, 1, 2])
    assert _picked(selection.select_compare(g, 3)) == [1, 4, 2]
    assert _picked(selection.select_ranked(g, 2)) == [1, 2]
    assert _picked(selection.select_summary(_groups(spark, [1, 1, 1, 2, 2]), 5)) == [1, 4, 2, 5, 3]
    two = _groups(spark, [1] * 5 + [2] * 5)
    chosen = selection.select_compare(two, 8)
    assert selection.dropped(two, chosen).count() == 2
    assert {r.parent_id for r in selection.dropped(two, chosen).collect()}.isdisjoint(_picked(chosen))


def test_summary_selection_is_the_greedy_loop(spark):
    rng = random.Random(8)

    def greedy(docs, most):
        order = list(range(len(docs)))
        chosen = [i for i in order if docs.index(docs[i]) == i][:most]
        left = [i for i in order if i not in chosen]
        while len(chosen) < most:
            taken = {d: sum(docs[c] == d for c in chosen) for d in docs}
            able = [i for i in left if taken[docs[i]] < 2 or not any(taken[docs[j]] < 2 for j in left if docs[j] != docs[i])]
            if not able:
                break
            chosen.append(able[0])
            left.remove(able[0])
        return [i + 1 for i in chosen + left[: most - len(chosen)]]

    rows, want = [], {}
    for q in range(150):
        docs = [rng.randint(1, rng.choice([1, 2, 4, 8])) for _ in range(rng.randint(0, 24))]
        rows += [(q, d, i, i) for i, d in enumerate(docs, 1)]
        want[q] = greedy(docs, 9)
    chosen = selection.select_summary(spark.createDataFrame(rows, "query_id long, document_id long, parent_id long, group_rank int"), 9).orderBy("query_id", "select_rank").collect()
    assert {q: [r.parent_id for r in chosen if r.query_id == q] for q in want} == want


def test_rerank(spark):
    r = one(spark, *[rerank.budget(2000, F.lit(n)) for n in (1, 2, 3)])
    assert list(r) == [2000, 4000, 5000]
    g = spark.createDataFrame([(1, 1, i, i, "q", "t") for i in range(1, 5)], "query_id long, document_id long, parent_id long, first_order int, query_text string, rerank_text string")
    score = F.when(F.col("parent_id") == 3, 5.0).when(F.col("parent_id") == 1, 1.0)
    out = rerank.apply_rerank(g, 3, score).orderBy("group_rank").collect()
    assert [x.parent_id for x in out] == [3, 1, 2, 4]
    assert [x.fallback_reason for x in out] == [None, None, "missing_score", None]


def test_growth():
    texts, kinds = ["a" * 10] * 5, ["text"] * 5
    assert assemble.grow(kinds, texts, [2], [], 1000) == [0, 1, 2, 3, 4]
    assert assemble.grow(kinds, texts, [2], [], 25) == [1, 2]
    assert assemble.grow(kinds, texts, [2], [1], 1000) == [2, 3, 4]
    assert assemble.grow(kinds, texts, [0, 3], [], 1000) == [0, 3, 4]  # outwards only: the gap stays open
    assert assemble.grow(["text", "table", "table", "text", "text"], texts, [1], [], 22) == [1, 2]
    assert assemble.grow(["table", "text", "text"], texts[:3], [1], [], 22) == [1, 2]
    assert assemble.grow(["table"] * 5, texts, [0], [2], 1000) == [0, 1, 3, 4]  # a blocked table is left out, the run goes on
    assert assemble.grow(["table"] * 3, texts[:3], [1], [], 5) == [0, 1, 2]  # a run that is too long stays
    table = ["| a |\n| --- |\n| 1 |", "| a |\n| --- |\n| 2 |"]
    assert assemble.merged(["table", "table", "text"], [*table, " t "]) == "| a |\n| --- |\n| 1 |\n| 2 |\n\nt"


def _rerank_text(heading, contents, kind, base=2000):
    """What the reference's rules give for one group, step by step."""
    kids = [c.strip() for c in contents if c and c.strip()]
    limit = base if len(kids) <= 1 else min(5000, max(base, int(base * (2.5 if len(kids) >= 3 else 2.0))))
    content = assemble.merged([kind] * len(contents), contents)
    prefix = f"Header: {(heading or '').strip()}".strip()
    room = limit - len(prefix) - len("\nContent:\n")
    whole = "\n\n".join(f"[Hit child {i}]\n{c}" for i, c in enumerate(kids, 1))
    cut = lambda v, n: "" if n <= 0 else v if len(v) <= n else v[:n] if n <= 3 else v[: n - 3] + "..."
    if room <= 0:
        body = ""
    elif len(content) <= room:
        body = content
    elif len(kids) <= 1:
        body = content[:room]
    elif len(whole) <= room:
        body = whole
    else:
        labels = [f"[Hit child {i}]\n" for i in range(1, len(kids) + 1)]
        left, parts = room - sum(map(len, labels)) - 2 * (len(kids) - 1), []
        for i, (label, kid) in enumerate(zip(labels, kids, strict=True)):
            part = cut(kid, max(1, left // (len(kids) - i)))
            parts.append(label + part)
            left -= len(part)
        body = cut("\n\n".join(parts), room)
    return f"{prefix}\nContent:\n{body}".strip()[:limit]


def test_rerank_text(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        kind = rng.choice(["text", "table"])
        make = lambda n: "| a |\n| --- |\n" + "| x y |\n" * n if kind == "table" else "w" * n + " \n"  # noqa: B023, E731
        rows.append((i, rng.choice([None, "", " ", "Head"]), [make(rng.choice([0, 3, 40, 900, 1500, 2600])) for _ in range(rng.randint(1, 5))], kind))
    df = spark.createDataFrame(rows, "i int, heading string, contents array<string>, kind string")
    got = {r.i: r.t for r in df.select("i", rerank.rerank_text(F.col("heading"), text.merge_contents(F.col("kind"), F.col("contents")), F.col("contents")).alias("t")).collect()}
    for i, heading, contents, kind in rows:
        assert got[i] == _rerank_text(heading, contents, kind), (i, heading, kind)


def test_vectorised_scores_are_the_column_expressions(spark):
    rng = random.Random(11)
    bits = ["Head", "the quick", "策略 文件", "\u2003", "ÄÖß", "x.y/z-1", "\x1c", "....", "." * 70, "| a |", "\n", "a", "", "\r\n", "Straße", "123"]
    make = lambda n: "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, n)))
    rows = [(i, rng.random(), make(6), rng.choice([None, make(4)]), make(30), [make(rng.choice([3, 60, 700])) for _ in range(rng.randint(1, 4))], rng.choice(["text", "table"])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, rrf double, q string, heading string, c string, contents array<string>, kind string")
    q, h, c = F.col("q"), F.col("heading"), F.col("c")
    left = scoring.policy_score(F.col("rrf"), q, text.query_tokens(q), h, c), rerank.rerank_text(h, text.merge_contents(F.col("kind"), F.col("contents")), F.col("contents")), scoring.deterministic_rerank(q, F.col("kind"), c)
    right = vectorised.policy_scores("rrf", "q", "heading", "c"), vectorised.rerank_texts(2000)("kind", "heading", "contents"), vectorised.rerank_scores("q", "kind", "c")
    for r in df.select(*[x.alias(f"l{i}") for i, x in enumerate(left)], *[x.alias(f"r{i}") for i, x in enumerate(right)]).collect():
        assert (r.l0, r.l1, r.l2) == (r.r0, r.r1, r.r2)


def test_merged_cells():
    c = lambda ref, v: f'<c r="{ref}" t="str"><v>{v}</v></c>'
    sheet = (
        "<worksheet><sheetData><row r='1'>" + c("A1", "Region") + c("B1", "Sales") + c("D1", "Note") + "</row><row r='2'>" + c("B2", "Q1") + c("C2", "Q2") + "</row>"
        "<row r='4'>" + c("A4", "North") + c("B4", "1") + c("C4", "2") + c("D4", "x") + "</row><row r='5'>" + c("B5", "3") + c("C5", "4") + '<c r="D5" t="b"><v>1</v></c>' + "</row></sheetData>"
        "<mergeCells><mergeCell ref='A1:A2'/><mergeCell ref='B1:C1'/><mergeCell ref='A4:A5'/></mergeCells></worksheet>"
    )
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="rId7"/></sheets></workbook>'
    xlsx = _zip({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/other.xml"/></Relationships>', "xl/worksheets/other.xml": sheet})
    assert [b.text for b in parsing.parse_xlsx(xlsx)] == ["| Region | Sales / Q1 | Sales / Q2 | Note |\n| --- | --- | --- | --- |\n| North | 1 | 2 | x |\n| North | 3 | 4 | TRUE |"]
    w = 'xmlns:w="w"'
    cell = lambda text, marks="": f"<w:tc><w:tcPr>{marks}</w:tcPr><w:p><w:t>{text}</w:t></w:p></w:tc>"
    table = "<w:tbl><w:tr>" + cell("a", '<w:gridSpan w:val="2"/>') + cell("b") + "</w:tr><w:tr>" + cell("c", '<w:vMerge w:val="restart"/>') + cell("d") + cell("e") + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("f") + cell("g") + "</w:tr></w:tbl>"
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body>{table}</w:body></w:document>"})
    assert [b.text for b in parsing.parse_docx(docx)] == ["| a | a | b |\n| --- | --- | --- |\n| c | d | e |\n| c | f | g |"]


def test_contexts_like_the_sequential_version(spark):
    """Whole parents, grown parents, dropped hits and tables against a version that walks one parent at a time."""
    rng = random.Random(5)
    children, parents = [], []
    for parent in range(40):
        at, kids = 0, []
        for k in range(rng.randint(1, 14)):
            kind = rng.choice(["text", "text", "table"])
            body = "| a |\n| --- |\n| 1 |" if kind == "table" else "w" * rng.choice([5, 200, 900])
            kids.append((7, parent, 100 * parent + k, k, at, at + len(body), kind, body))
            at += len(body) + 1
        children += kids
        whole = "\n".join(c[-1] for c in kids)
        parents.append((7, parent, 0, len(whole), "text", "H", whole, len(whole)))
    kids_of = {p: [c for c in children if c[1] == p] for p in range(40)}
    hit = "struct<chunk_id:long,child_index:int,content:string,heading:string,start_offset:int,end_offset:int,rrf_rank:int,vector_rank:int,fts_rank:int,source:string,structure_kind:string,rerank_rank:int>"
    selected, want = [], {}
    for rank, p in enumerate(rng.sample(range(40), 30), 1):
        hits = rng.sample(kids_of[p], rng.randint(1, len(kids_of[p])))
        rows = [(c[2], c[3], c[7], "H", c[4], c[5], i, i, None, rng.choice(["vector", "fts"]), c[6], 1) for i, c in enumerate(hits, 1)]
        selected.append((1, "nothing in common", 7, p, rank, rows))
        ids = [c[2] for c in kids_of[p]]
        kept, lost = [ids.index(r[0]) for r in rows[:3]], [ids.index(r[0]) for r in rows[3:]]
        if parents[p][-1] <= 3000:
            want[p] = (parents[p][6].strip(), 0, parents[p][3], len(ids), False)
        else:
            kinds, texts = [c[6] for c in kids_of[p]], [c[7] for c in kids_of[p]]
            chosen = set(kept)
            for a in kept:
                if kinds[a] == "table":
                    run = [a]
                    while run[0] > 0 and kinds[run[0] - 1] == "table":
                        run.insert(0, run[0] - 1)
                    while run[-1] + 1 < len(kinds) and kinds[run[-1] + 1] == "table":
                        run.append(run[-1] + 1)
                    chosen |= {r for r in run if r not in lost}
            fits = lambda s: len(assemble.merged([kinds[i] for i in sorted(s)], [texts[i] for i in sorted(s)])) <= 3000  # noqa: B023, E731
            left, right = min(chosen) - 1, max(chosen) + 1
            while fits(chosen):
                options = [x for x in (left, right) if 0 <= x < len(kinds) and x not in lost]
                options.sort(key=lambda x: 0 if kinds[x] == "text" else 1)  # noqa: B023
                pick = next((x for x in options if fits(chosen | {x})), None)
                if pick is None:
                    break
                chosen.add(pick)
                left, right = (left - 1, right) if pick == left else (left, right + 1)
            order = sorted(chosen)
            whole = assemble.merged([kinds[i] for i in order], [texts[i] for i in order])
            want[p] = (whole[:3000], kids_of[p][order[0]][4], kids_of[p][order[-1]][5], len(order), len(whole) > 3000)
    made = assemble.contexts(
        spark.createDataFrame(selected, f"query_id long, query_text string, document_id long, parent_id long, select_rank int, hits array<{hit}>"),
        spark.createDataFrame(parents, "document_id long, parent_id long, start_offset int, end_offset int, structure_kind string, heading string, content string, char_count int"),
        spark.createDataFrame(children, "document_id long, parent_id long, chunk_id long, child_index int, start_offset int, end_offset int, structure_kind string, content string"),
        max_children=3,
    )
    got = {r.parent_id: (r.context_text, r.start_offset, r.end_offset, len(r.child_ids), r.truncated) for r in made.collect()}
    assert got == want


def test_fusion_leaves_chunks_where_they_are(spark):
    from lodestone.plans import retrieval

    plan = retrieval._fused(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    joins = [x for x in plan.splitlines() if "SortMergeJoin" in x and "content" in x]
    assert "BroadcastHashJoin" in plan and not joins


def test_text_scores_count_repeats(spark):
    chunks = spark.createDataFrame([(1, "aaa ab ab"), (2, "zzz")], "chunk_id long, content string")
    queries = spark.createDataFrame([(7, "ab AB aa")], "query_id long, query_text string")
    assert [(r.chunk_id, r.score) for r in recall.text_scores(chunks, queries).collect()] == [(1, 5)]
    low = chunks.select("chunk_id", scoring.fts_score(text.white_tokens(F.lit("ab AB aa")), F.col("content")).alias("s"))
    assert {r.chunk_id: r.s for r in low.collect()} == {1: 5, 2: 0}


def test_exact_matches_overlap(spark):
    docs = spark.createDataFrame([(1, "abababa"), (2, None)], "id long, t string")
    got = adapters.exact_matches(docs, "id", "t", [(5, "aba"), (6, "aba"), (7, "x"), (8, "")])
    assert sorted((r.passage_id, r.start_offset, r.end_offset) for r in got.collect()) == sorted((p, s, s + 3) for p in (5, 6) for s in (0, 2, 4))


def test_roles_and_writes(spark):
    p = spark.createDataFrame([(1, "g"), (2, "h")], "principal long, group_path string")
    u = spark.createDataFrame([("a", 1, "reader")], "area_id string, principal long, role string")
    g = spark.createDataFrame([("a", "g", "admin")], "area_id string, group_path string, role string")
    roles = ops.effective_roles(p, u, g)
    assert [tuple(r) for r in roles.collect()] == [(1, "a", "admin")]
    asks = spark.createDataFrame([(1, "a"), (2, "a")], "principal long, area_id string")
    assert {r.principal: r.outcome for r in ops.access_outcome(asks, roles, "admin").collect()} == {1: "allow", 2: "not_found"}


def test_filter_order(spark):
    reason = curation.filter_reason(F.lit(" "), F.lit("fact_lookup"), F.lit("x" * 300), F.array().cast("array<string>"), F.lit("nq"))
    assert one(spark, reason)[0] == "missing_query"


def test_percentile(spark):
    assert spark.range(1, 21).agg(gates.percentile(F.col("id"), 0.95)).first()[0] == 19


def test_routing(spark):
    r = one(spark, *[routing.task_type(F.lit(q)) for q in ("Compare the vs list", "give an overview", "versatile", "比較差異 摘要")])
    assert [x.label for x in r] == ["cross_document_compare", "document_summary", None, "cross_document_compare"]
    assert [x.confidence for x in r] == [0.92, 0.84, 0.0, 0.92]
    none = F.lit(None).cast("string")
    d = one(spark, routing.decide(none, none, F.lit("e"), F.lit(0.8), F.lit(0.06), "f"), routing.decide(none, none, F.lit("e"), F.lit(0.8), F.lit(0.01), "f"), routing.decide(F.lit("x"), F.lit("r"), F.lit("e"), F.lit(0.9), F.lit(0.9), "f"))
    assert [(x.label, x.source) for x in d] == [("e", "embedding"), ("f", "fallback"), ("x", "explicit")]
    names = spark.createDataFrame([(1, "a", "travel expense rules.md"), (2, "a", "holiday rules.txt"), (3, "a", "security handbook.md")], "document_id long, area_id string, file_name string")
    asked = spark.createDataFrame([(1, "a", "summarize travel expense rules"), (2, "a", "nothing of that kind"), (3, "a", "compare travel expense rules and security handbook"), (4, "b", "holiday rules")], "query_id long, area_id string, query_text string")
    got = {r.query_id: r.resolved for r in mentions.resolve_mentions(mentions.mention_scores(asked, names)).collect()}
    assert got == {1: [1], 3: [3, 1]}  # equal scores by file name


MARKDOWN = "intro\n# H\ntext\n\n| a | b |\n|---|:---:|\n| 1 | x\\|y | 3 |\n\nafter | bar\n## G\nend"


def test_markdown():
    got = [(b.kind, b.heading, b.text) for b in parsing.parse_markdown(MARKDOWN)]
    table = "| a | b |  |\n| --- | :---: | --- |\n| 1 | x\\|y | 3 |"
    assert got == [("text", None, "intro"), ("text", "H", "text"), ("table", "H", table), ("text", "H", "after | bar"), ("text", "G", "end")]
    assert [b.kind for b in parsing.parse_markdown("a|b\n-|-\n1|2", short_rules=True)] == ["table"]
    assert [b.kind for b in parsing.parse_markdown("a|b\n-|-\n1|2")] == ["text"]


def test_html():
    page = "<h1>T</h1>loose<p>one <b>two</b></p><ul><li>x</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>open"
    got = [(b.kind, b.heading, b.text) for b in parsing.parse_html(page)]
    assert got == [("text", "T", "one two"), ("text", "T", "x"), ("table", "T", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("text", "T", "open")]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office():
    w = 'xmlns:w="w"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(b.kind, b.heading, b.text) for b in parsing.parse_docx(docx)] == [("text", "Title", "Title"), ("text", "Title", "body"), ("table", "Title", "| a |\n| --- |\n| 1 |")]
    xlsx = _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2"><v>7</v></c></row></worksheet>'})
    assert [(b.kind, b.heading, b.text) for b in parsing.parse_xlsx(xlsx)] == [("table", "S1", "| h |  | 5 |\n| --- | --- | --- |\n|  | 7 |  |")]
    pptx = _zip({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:t>Head</a:t></a:p></p:sp><p:sp><a:p><a:t>x</a:t></a:p><a:p><a:t>y</a:t></a:p></p:sp></p:sld>'})
    assert [(b.heading, b.text) for b in parsing.parse_pptx(pptx)] == [("Head", "Head"), ("Head", "x\ny")]


def test_split_text():
    body = "\n\n".join(" ".join(f"w{i}{j}" for j in range(40)) for i in range(30))
    spans = chunking.split_text(body)
    assert all(b - a <= 800 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(s[0] <= e[1] + 2 for s, e in zip(spans[1:], spans, strict=False))
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert all(body[i].isspace() for i in range(len(body)) if i not in covered)
    assert all(b - a <= 800 for a, b in chunking.split_text("x" * 5000))


def test_split_table():
    rows = "\n".join(f"| {i} | {'v' * 90} |" for i in range(45))
    table = f"| a | b |\n| --- | --- |\n{rows}"
    got = chunking.split_table(table)
    assert [len(c.split("\n")) - 2 for _, _, c in got] == [20, 20, 5]
    assert all(c.startswith("| a | b |\n| --- | --- |\n") and c.endswith(table[s:e]) for s, e, c in got)
    assert chunking.split_table("| a |\n| --- |\n| 1 |") == [(0, 19, "| a |\n| --- |\n| 1 |")]


def test_normalise():
    s = lambda kind, n, heading=None: chunking.Section(kind, "x" * n, heading, heading)
    assert [len(x.text) for x in chunking.normalise([s("text", 500), s("text", 500), s("text", 100)])] == [1104]
    mixed = chunking.normalise([s("text", 900, "A"), s("table", 50, "A"), s("text", 900, "A")])
    assert [(x.kind, len(x.parts)) for x in mixed] == [("text", 3)]
    apart = chunking.normalise([s("text", 900, "A"), s("table", 50, "B"), s("text", 900, "C")])
    assert [x.kind for x in apart] == ["text", "table", "text"]
    assert chunking.merge([chunking.Section("text", "a", "A / B", "A / B"), chunking.Section("text", "b", "A", "A")], False) == chunking.Section("text", "a\n\nb", "A", "A / B")


def test_chunk_offsets(spark):
    files = spark.createDataFrame([(1, "a.md", (MARKDOWN * 30).encode()), (2, "b.txt", ("p one\n\n" * 300).encode()), (3, "c.bin", b"x"), (4, "d.txt", b" ")], "document_id long, file_name string, content binary")
    rows = chunking.chunk_files(files).orderBy("document_id", "position").collect()
    assert {r.document_id for r in rows} == {1, 2}
    display = {r.document_id: r.display_text for r in rows if r.display_text}
    for r in rows:
        shown = display[r.document_id][r.start_offset : r.end_offset]
        if r.chunk_type == "parent":
            assert shown.endswith(r.content) and (shown == r.content or shown == f"## {r.heading}\n\n{r.content}")
        elif r.structure_kind == "text":
            assert shown == r.content
        else:
            assert r.content.endswith(shown)
    errors = parsing.parse_files(files).where("error is not null").select("document_id").collect()
    assert {r.document_id for r in errors} == {3, 4}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,two\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\ttwo\n")
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"x": 1}, {"x": 2}]}))
    assert [tuple(r) for r in readers.read_rows(spark, f"{tmp_path}/a.csv").collect()] == [("1", "two")]
    assert [tuple(r) for r in readers.read_rows(spark, f"{tmp_path}/b.tsv").collect()] == [("1", "two")]
    assert readers.read_rows(spark, f"{tmp_path}/c.jsonl").count() == 2
    assert sorted(r.x for r in readers.read_rows(spark, f"{tmp_path}/d.json").collect()) == [1, 2]
    spark.dataSource.register(readers.PagedRows)
    paged = spark.read.format("paged_rows").options(file=str(tmp_path / "c.jsonl"), pages="3", length="1").load()
    assert sorted((r.page, r.row) for r in paged.collect()) == [(0, '{"x": 1}'), (1, '{"x": 2}')]
    (tmp_path / "many.jsonl").write_text("".join(f'{{"x": {i}}}\n' for i in range(1234)))
    for length, n in (("100", "3"), ("1234", "2"), ("617", "4"), ("5000", "1")):
        whole = spark.read.format("paged_rows").options(file=str(tmp_path / "many.jsonl"), length=length, readers=n).load()
        assert sorted(json.loads(r.row)["x"] for r in whole.collect()) == list(range(1234))
    assert readers.hub_reference("hf://a/b/c/d") == ("a/b", "c", "d") and readers.hub_reference("x.csv") is None
    readers.write_jsonl(readers.read_rows(spark, f"{tmp_path}/c.jsonl"), f"{tmp_path}/out.jsonl")
    assert readers.read_rows(spark, f"{tmp_path}/out.jsonl").count() == 2
    files = readers.read_files(spark, str(tmp_path / "a.csv"))
    assert files.first().file_name == "a.csv"


def test_artifacts_of_other_documents_stay(spark, tmp_path):
    path = f"{tmp_path}/artifacts"
    rows = lambda ids, mark: spark.createDataFrame([(i, k, f"{mark}{i}") for i in ids for k in range(2)], "document_id long, block int, text string")
    readers.write_artifacts(rows(range(1000), "a"), path)
    readers.write_artifacts(rows(range(5, 15), "b").unionByName(rows(range(2000, 2003), "b")), path)
    got = {(r.document_id, r.block): r.text for r in spark.read.parquet(path).collect()}
    assert len(got) == 2006 and all(t == ("b" if 5 <= i < 15 or i >= 2000 else "a") + str(i) for (i, _), t in got.items())
    files, held = rows(range(998, 1002), "x"), spark.read.parquet(path)
    todo, reuse = readers.reusable(files.select("document_id").distinct(), held)
    assert sorted(r.document_id for r in todo.collect()) == [1000, 1001] and reuse.count() == 4


def test_upserts_survive_a_crash(spark, tmp_path):
    from lodestone.streaming import ingest

    target = f"{tmp_path}/state"
    rows = lambda ids, mark: spark.createDataFrame([(i, mark) for i in ids], "document_id long, status string")
    write = ingest.upsert_batches(target)
    want = {}
    for epoch, (ids, mark) in enumerate([(range(300), "a"), (range(20, 30), "b"), (range(25, 400, 5), "c"), ([7], "d"), ([7], "e")]):
        write(rows(ids, mark), epoch)
        want |= dict.fromkeys(ids, mark)
        assert {r.document_id: r.status for r in ingest.current(spark, target).collect()} == want
    write(rows([7], "e"), 4)  # the same epoch again
    rows([1, 2], "half").write.parquet(f"{target}/v=5/bucket=3")  # a version that was never committed
    (tmp_path / "state" / "v=5" / "bucket=3" / "_SUCCESS").unlink(missing_ok=True)
    assert {r.document_id: r.status for r in ingest.current(spark, target).collect()} == want
    write(rows([9], "f"), 5)
    assert {r.document_id: r.status for r in ingest.current(spark, target).collect()} == want | {9: "f"}
    kept = [p.parent.name for p in (tmp_path / "state").glob("v=*/bucket=*")]
    assert len(kept) <= 2 * ingest.BUCKETS


def test_fact_heavy_windows():
    body = "We use 3 sets. 他們。都在! Version 1.5 is kept.\n\nNext part " + "x" * 240 + "? End"
    spans = chunking.sentence_windows(body)
    assert [body[a:b] for a, b in spans][:4] == ["We use 3 sets.", "他們。都在!", "Version 1.5 is kept.", "Next part " + "x" * 240 + "?"]
    fine = chunking.with_settings(fact_heavy_refinement=True)
    assert chunking.text_spans(body, "4.1 Experimental Setup", fine) == spans
    assert chunking.text_spans(body, "Introduction", fine) == chunking.split_text(body) == chunking.text_spans(body, "Setup")
    assert chunking.text_spans("Short. Text.", "Metrics", fine) == [(0, 12)]


def test_document_selection(spark):
    found = spark.createDataFrame([(q, d, r) for q in (1, 2, 3) for r, d in enumerate([10, 11, 12, 13], 1)], "query_id long, document_id long, rrf_rank int")
    asked = spark.createDataFrame([(1, "fact_lookup", None, [10]), (2, "document_summary", "single_document", [12]), (3, "cross_document_compare", None, [12, 10])], "query_id long, query_type string, summary_scope string, resolved array<long>")
    got = {}
    for r in recall.select_documents(found, asked, 3).orderBy("query_id", "select_rank").collect():
        got.setdefault(r.query_id, []).append(r.document_id)
    assert got == {2: [12], 3: [12, 10, 11]}
    assert sorted(r.document_id for r in recall.select_documents(found, asked.where("query_id = 3"), 1).collect()) == [10, 11, 12]


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}).returncode == 0
    (tmp_path / "lodestone" / "llm").mkdir()
    (tmp_path / "lodestone" / "llm" / "__init__.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True).returncode != 0


def test_stream_equals_batch(spark, tmp_path):
    from lodestone.streaming import ingest

    rows = [(i, f"2024-01-0{1 + i % 5} 00:00:00", i % 7, ["click", "purchase", "error", "view"][i % 4]) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.job_states(stream).writeStream.outputMode("update").foreachBatch(ingest.upsert_batches(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.document_id: (r.status, r.events) for r in ingest.current(spark, f"{tmp_path}/out").collect()}
    batch = events.groupBy("user_id").agg(ingest.job_status(F.max_by("event_type", F.struct("ts", "event_id"))).alias("s"), F.count("*").alias("n"))
    assert got == {r.user_id: (r.s, r.n) for r in batch.collect()}


def test_serving(spark):
    import uuid

    from lodestone.operators import serving

    r = one(
        spark,
        serving.stable_uuid(F.lit("https://example.org/ä")),
        serving.slug(F.lit(" a b/ü "), ".md"),
        serving.slug(F.lit("//"), ".md"),
        serving.resolve_span(F.lit("hello world"), F.lit("world"), F.lit(None).cast("int"), F.lit(None).cast("int")),
        serving.resolve_span(F.lit("hello"), F.lit("x"), F.lit(2), F.lit(9)),
        serving.answer(F.lit("q"), F.array().cast("array<string>"), F.array().cast("array<string>")),
        serving.synopsis(F.lit("a.md"), F.lit("Heading: H1\nHeading: H2\nExcerpt: body")),
        serving.group_source(F.array(F.lit("vector"), F.lit("fts"))),
        serving.group_source(F.array().cast("array<string>")),
    )
    assert r[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/ä"))
    assert r[1] == "a-b.md" and r[2] == "document.md"
    assert tuple(r[3]) == (6, 11, None) and tuple(r[4]) == (None, None, "unresolved")
    assert r[5].startswith("目前") and r[6].split("\n")[1] == "Key sections: H1; H2" and r[7] == "hybrid" and r[8] == "fts"


def test_alignment(spark):
    from lodestone.operators import align

    assert align.normalised("Ａ  b­c\nexam-\nple ") == ("a bc example", [0, 1, 3, 5, 6, 7, 8, 9, 10, 13, 14, 15])
    text = "The exam-\nple  Ｔext stands here. An example text."
    spans = align.exact_spans(text, "Example  text")
    assert [text[a:b] for a, b in spans] == ["exam-\nple  Ｔext", "example text"]
    assert align.exact_spans("aXaXa", "axa") == [(0, 3), (2, 5)]
    far = "apple pie " + "x " * 200 + "target words near " + "y " * 200 + "apple pie"
    assert align.choose(far.replace("target", "apple pie target"), align.exact_spans(far.replace("target", "apple pie target"), "apple pie"), "target words near")[0] > 100
    assert align.choose("a b a b", [(0, 1), (4, 5)], "zzz") is None
    lines = "one line of text here\nthe quick brown fox jumps over it\nother"
    assert align.fuzzy_line(lines, "the quick brown fox jumps over it", "quick brown fox jumps over it the")[:2] == (22, 55)
    assert align.fuzzy_line(lines, "nothing alike", "no") is None
    pairs = spark.createDataFrame([(1, 5, lines, "Quick brown", "s"), (2, 5, lines, "zzz", "s"), (3, 5, "ab ab", "ab", ""), (4, 5, None, None, None)], "item_id long, document_id long, display_text string, evidence string, signal string")
    assert {r.item_id: r.status for r in align.align(pairs).collect()} == {1: "auto_matched", 2: "rejected", 3: "needs_review", 4: "rejected"}


def test_providers(spark):
    from lodestone.operators import providers

    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.TransientError(429, 1.0)
        return x

    assert providers.retried(flaky, 7, sleep=waits.append) == 7 and len(waits) == 2 and all(0.75 <= w <= 1.25 for w in waits)
    with pytest.raises(providers.TransientError):
        providers.retried(lambda: (_ for _ in ()).throw(providers.TransientError(401)), sleep=waits.append)

    def small(part):
        if len(part) > 2:
            raise providers.TooLarge
        return [len(t) for t in part]

    assert providers.in_batches(small, ["a", "bb", "ccc", "", "eeeee"], 5) == [1, 2, 3, 0, 5]
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    embed = providers.embedding_udf(lambda: lambda texts: [[float(len(t))] for t in texts], 3)
    assert sorted(r[0] for r in df.select(embed("t")).collect()) == [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0]]
    score = providers.score_udf(lambda: lambda pairs: [len(a or "") + len(b or "") for a, b in pairs])
    assert sorted(r[0] for r in df.select(score("t", F.lit("x"))).collect()) == [1.0, 3.0]


def test_preparation(spark):
    from lodestone.operators import prepare

    tokens = [("<P>", True), ("It", False), ("is", False), ("(", False), ("a", False), (")", False), ("dog", False), ("'s", False), (".", False), ("</P>", True), ("<B>", True), ("Two", False)]
    df = spark.createDataFrame([(tokens, [(True, None, [], [], ""), (None, "yes", ["x"], [], ""), (None, None, [" "], ["e1"], "t"), (None, None, ["s"], [], "u")])], "t array<struct<token:string,is_html:boolean>>, a array<struct<unanswerable:boolean,yes_no:string,spans:array<string>,evidence:array<string>,text:string>>")
    r = df.select(
        prepare.rendered_tokens(F.col("t")).alias("text"),
        prepare.first_acceptable(F.col("a")).alias("answer"),
        F.size(prepare.token_window(F.col("t"), F.lit(2), F.lit(3), 1)).alias("n"),
        prepare.paper_markdown(F.lit("T"), F.lit(""), F.array(F.struct(F.lit("").alias("name"), F.lit("body\r\n").alias("text")), F.struct(F.lit("x").alias("name"), F.lit(" ").alias("text")))).alias("md"),
        prepare.newlines(F.lit("a  \r\nb\n\n\n\nc ")).alias("nl"),
        prepare.evidence_window(F.lit("0123456789"), F.lit("45"), F.lit(4), 2).alias("w"),
    ).first()
    assert r.text == "It is (a) dog's.\n\nTwo" and tuple(r.answer) == ("t", ["e1"], "evidence_only") and r.n == 3
    assert r.md == "# T\n\n## Section\n\nbody\n" and r.nl == "a\nb\n\nc" and r.w == "234567"


def test_evaluation_profiles():
    gate, deterministic = routing.evaluation_settings("deterministic_gate_v1")
    assert deterministic and (gate.rerank_top_n, gate.vector_top_k, gate.fts_top_k, gate.max_candidates, gate.assembler_max_contexts, gate.assembler_max_children) == (4, 6, 6, 8, 4, 2)
    v2, gated = routing.evaluation_settings("generic_guarded_assembler_v2_gate")
    assert gated and (v2.rerank_top_n, v2.assembler_max_contexts, v2.assembler_max_chars, v2.assembler_max_children) == (30, 10, 3600, 7)
    with pytest.raises(ValueError):
        routing.evaluation_settings("x")


def test_layout(spark):
    from lodestone.operators import layout

    payload = json.dumps({"kids": [
        {"type": "heading", "content": "Title", "page number": 1, "heading level": 1, "bbox": [0, 1, 2, 3]},
        {"type": "table", "content": "a b", "page": 2, "boxes": [{"x0": 1, "y0": 2, "x1": 3, "y1": 4}, {"x0": 1}]},
        {"type": "paragraph", "text": "first half", "page": 3},
        {"type": "paragraph", "text": "second half", "page": 4},
    ]})
    found = layout.elements(payload)
    assert [e["text"] for e in found] == ["Title", "a b", "first half", "second half"] and len(found[1]["boxes"]) == 1
    own = layout.match([("text", "Title"), ("table", "| a b |"), ("text", "first half second half"), ("text", "second half")], found)
    assert [[e["text"] for e in x] for x in own] == [["Title"], ["a b"], ["first half"], ["second half"]]
    assert layout.elements("not json") == [] and layout.match([("text", "x")], []) == [[]]
    df = spark.createDataFrame([(1, [("text", "Title"), ("table", "| a b |")], payload), (2, None, None)], "document_id long, blocks array<struct<block_kind:string,content:string>>, payload string")
    got = layout.enrich(df).orderBy("block_index").collect()
    assert [(r.page_start, r.page_end, r.heading_level, len(r.regions)) for r in got] == [(1, 1, 1, 1), (2, 2, None, 1)]


@pytest.mark.parametrize("n", [3, 700])
def test_every_vector_is_used(spark, tmp_path, n):
    from lodestone.sources import adapters

    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "some words") for i in range(1500)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, "a", "ready", "h", "x\n" * 40) for d in range(30)], "document_id long, area_id string, status string, heading string, display_text string")
    asked = adapters.with_vectors(adapters.questions(spark, str(tmp_path)), spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.embedding[0]) for r in asked) == [(i, i % n) for i in range(1500)]
    kids = adapters.with_vectors(adapters.children(docs), spark, str(tmp_path)).collect()
    assert sorted((r.document_id, r.position, r.embedding[0]) for r in kids) == [(d, p, (d * 31 + p) % n) for d in range(30) for p in range(40)]


def test_alignment_candidates_need_no_literal_beginning(spark, tmp_path):
    from lodestone.plans import catalog

    evidence = "The quick brown fox jumps over the lazy dog near home"
    held = {
        1: "x\nTHE QUICK BROWN fox jumps over the lazy dog near home",
        2: "x\nthe  quick br\u00adown fox jumps over the lazy dog near home",
        3: "x\nThe quick bro-\nwn fox jumps over the lazy dog near home",
        4: "x\nThe quack brown fox jumps over the lazy dog near home",
        5: "x\nnothing of the kind",
    }
    spark.createDataFrame([(d, "src", "en", t) for d, t in held.items()], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, evidence)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.document_id: (r.status, r.match_type) for r in catalog.QUERIES["evidence_alignment"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == got[3] == ("auto_matched", "exact")
    assert got[4][1] in ("fuzzy", None) and 5 not in got


def test_every_name_is_resolved(spark, tmp_path):
    from lodestone.plans import catalog

    spark.createDataFrame([(d, "src", "en", "some text") for d in range(60)], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.query_id, list(r.resolved)) for r in catalog.QUERIES["mention_resolution"](spark, str(tmp_path)).collect())
    want = [d for d in range(60) if d % 17]
    assert [q for q, _ in got] == want and all(q in found for q, found in got)


def test_numbers_across_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-40, 300)]), f"f{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "area_id string, document_id long, file_name string")
    want = recall.ranked(df, ["area_id"], ["document_id", "file_name"], "place")
    assert sorted(map(str, recall.numbered(df, ["area_id"], "document_id", ["file_name"], "place", 16).collect())) == sorted(map(str, want.collect()))
    assert recall.numbered(df.limit(0), ["area_id"], "document_id", ["file_name"], "place").count() == 0


def test_planned_documents(spark):
    ready = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 10 + i) for i in range(9)] + [(None, 30)], "area_id string, document_id long")
    hits = spark.createDataFrame([(3,), (3,), (99,)], "document_id long")
    got = sorted((r.area_id or "", r.document_id) for r in serving_ops.planned(ready, hits).collect())
    assert got == [("", 30), ("a", 3), *[("b", 10 + i) for i in range(5)]]


def test_parsed_batches_are_bounded(spark):
    from lodestone.config import BATCH
    from lodestone.operators import parsing

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        files = spark.createDataFrame([(1, "a.txt", bytearray(b" some text "))], "document_id long, file_name string, content binary")
        assert [r.content for r in parsing.parse_files(files).collect()] == ["some text"]
        assert spark.conf.get(key) == f"{BATCH}b"
    finally:
        spark.conf.set(key, held)
