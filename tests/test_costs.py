"""What keeps large inputs within their limits: steps that run once, tasks that share the work, joins that go by real sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexkeel.functions import latex as L
from lexkeel.functions import redaction as R
from lexkeel.functions.text import keep_only
from lexkeel.operators import windows as W
from lexkeel.operators.joins import last_wins
from lexkeel.plans import advisory as A
from lexkeel.plans import catalog_sources as C
from lexkeel.plans import catalog_synthetic as S
from lexkeel.plans import thesis as T
from lexkeel.sources import pdf_bundle as B
from lexkeel.sources import projects as P
from lexkeel.storage import keep


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_not_broadcast_by_their_files(spark):
    """50 MB of equal text are a file of some KB."""
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = keep(spark.range(1_000).select("id", F.repeat(F.lit("x"), 50_000).alias("text")), "texts")
    assert "BroadcastHashJoin" not in plan_of(spark.range(2_000).join(texts, "id"))


def test_projects_are_dealt_to_all_tasks(spark):
    """adaptive execution put projects of few bytes into one task."""
    files = spark.range(40).select(F.col("id").cast("string").alias("doc_id"), F.lit("main.tex").alias("path"), F.lit(b"\\section{A}").alias("content"))
    got = P.projects(files.withColumn("sha256", F.sha2("content", 256))).withColumn("task", F.spark_partition_id())
    assert {r["task"] for r in got.select("task", "text").collect()} == set(range(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def test_spans_are_made_once(spark, tmp_path):
    """every reader split the texts again."""
    spark.createDataFrame([(1, "a\nb", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spans, pages = S.spans(spark, str(tmp_path))
    assert "Window" not in plan_of(spans) and "Window" not in plan_of(pages)
    assert [r["text"] for r in spans.orderBy("span_idx").collect()] == ["a", "b"]


def test_fragments_are_cut_in_one_pass(spark):
    """words were taken out, dealt and joined again; the fragments stay the same."""
    texts = ["a b c d e", "  a\tb  c d\t e. f\n\n g ", "", " \n ", "x.y z; ü\u00a0v w! " * 7, "a\tb\tc\td\te", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(F.regexp_extract_all(p, F.lit(r"\S+\s*"), F.lit(0))) / 4).cast("int"), F.lit(1)) - 1), lambda i: F.rtrim(F.array_join(F.slice(F.regexp_extract_all(p, F.lit(r"\S+\s*"), F.lit(0)), i * 4 + 1, F.lit(4)), "")))
    was = F.filter(F.flatten(F.transform(F.split("text", r"(?<=[.!?;])\s+|\s*\n\s*"), old)), lambda s: s != "")
    got = df.select(W.quote_spans(F.col("text")).alias("new"), was.alias("old"))
    assert "sequence(" not in plan_of(df.select(W.quote_spans(F.col("text"))))
    assert [r["new"] for r in got.collect()] == [r["old"] for r in got.collect()]


def test_redaction_looks_before_it_matches(spark):
    """F12 to F15: patterns ran over texts that can't match; what they need is looked for first, and nothing that matches is missed."""
    texts = ["plain words", "API_KEY: x1", "aTokEn token=abc", "sk-abcdefghij AQVNabcdefghi", "BEARER abcdefghijk", "a@b.example", r"C:\a\b D:/x \\h\s", "see /usr/lib ~/x", "raw_prompt='x y' z", "a\n Traceback (most recent call last): x", "\x01pass\x02word: q", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.regexp_replace("t", R.CONTROL, "")
    for pattern, shown in [(R.ASSIGN, "$1" + R.MARK), (R.API_KEY, R.MARK), (R.BEARER, f"Bearer {R.MARK}"), (R.EMAIL, R.MARK), (R.WINDOWS_PATH, R.PATH_MARK), (R.POSIX_PATH, R.PATH_MARK), (R.HOME_PATH, R.PATH_MARK), (R.PROMPT, "$1" + R.MARK), (R.TRACEBACK, f" {R.TRACE_MARK}")]:
        want = F.regexp_replace(want, pattern, shown)
    want = F.regexp_replace(want, rf"^\s+(?=\{R.TRACE_MARK[:-1]}\]$)", "")
    assert all(r[0] == r[1] for r in df.select(R.redact_text(F.col("t")), want).collect())
    assert plan_of(df.select(R.public_text(F.col("t")).alias("x"))).count("AQVN[") == 1
    assert [r[0] for r in df.select(keep_only(F.col("t"), "[^a-z]")).limit(1).collect()] == [10]


def printed(spark, tmp_path, *texts):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return C.printed(spark, str(tmp_path))


def test_long_documents_are_printed_and_ranged_in_one_pass(spark, tmp_path):
    """F8: pieces were counted from a text's start, page ranges looked ahead to a document's end for every span, headings hashed their text each."""
    texts = ["a\n\U0001f600\r\u2028" * 700, "", None, "x" * 1600, "x" * 1601]
    spans, pages = printed(spark, tmp_path, *texts)
    assert "substring(" not in plan_of(spans)
    got = {}
    for r in spans.where("font_size = 10.0").orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: [t[k : k + 80] for k in range(0, max(len(t), 1), 80)] for i, t in enumerate(t or "" for t in texts)}
    assert {r["doc_id"]: r["count"] for r in pages.groupBy("doc_id").count().collect()} == {0: 3, 1: 1, 2: 1, 3: 1, 4: 2}
    placed = B.with_offsets(spans)
    intervals = placed.select("doc_id", F.col("place").alias("name"), "char_start", "char_end")
    assert "unboundedfollowing" not in plan_of(B.page_ranges(intervals, placed, ["name"])).lower()
    # What a heading's row carries besides the heading.
    heads = plan_of(P.sections(spark, keep(B.documents(placed, pages), "documents"), collapse=False))
    carried = [line[line.rindex("], [") :] if "], [" in line else line for line in heads.splitlines() if "Generate explode(" in line]
    assert carried and not any("text#" in c for c in carried)


def test_headings_are_found_among_spans_shuffled_once(spark, tmp_path):
    """F8: all spans went through four shuffles, for pages, medians, repetitions and back."""
    spans, pages = printed(spark, tmp_path, "word " * 1000)
    found = B.font_headings(keep(B.with_offsets(spans), "spans"), pages)
    assert [r["title"] for r in found.orderBy("char_start").collect()] == ["Kapitel 1", "Kapitel 2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "median(" not in plan


def test_advisory_rules_pick_from_one_row_a_document(spark):
    """every chunk's text was joined, sorted and shuffled for every rule, and once more where no quote could be checked."""
    titles, sizes = ["введение", "постановка задачи", "анализ результатов"], [7, 3, 1]
    sections = spark.createDataFrame([("d", f"s{n}", t, "other", 2, 100 * n) for n, t in enumerate(titles)], "doc_id string, section_id string, norm string, kind string, level int, char_start int")
    pieces = [("d", f"s{n}", f"s{n}:{i}", f"text {n} {i}", 100 * n + i) for n, size in enumerate(sizes) for i in range(size)]
    chunks = spark.createDataFrame(pieces, "doc_id string, section_id string, chunk_id string, text string, char_start int")
    roles = [{"introduction", "content", "subsection_headings"}, {"task", "content", "subsection_headings"}, {"results", "content", "subsection_headings"}]
    want = {}
    for rule, wanted, _, each, most, _ in (line.split() for line in A.SPECS.strip().splitlines()):
        each = int(each)
        shown = [f"s{n}:{i}" for n, size in enumerate(sizes) if roles[n] & set(wanted.split(",")) for i in range(size) if i < (each + 1) // 2 or i >= size - each // 2]
        want[rule] = shown[: int(most)]
    planned = A.plan(spark, sections, chunks)
    assert {r["rule_id"]: [c["chunk_id"] for c in r["chunks"] or []] for r in planned.collect()} == want
    assert len(want["RES-01"]) == 4 and want["INT-01"] == ["s0:0", "s0:6"]
    logical = lambda df: df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in logical(planned) if "rule_id" in line and ("Window" in line or "Sort" in line or "Aggregate" in line)]
    digests = spark.createDataFrame([("d", "0" * 64)], "doc_id string, digest string")
    off = A.conclude(planned, A.disabled(planned), digests)
    assert not [line for line in logical(off) if "locate(" in line or "explode(chunks" in line]
    assert {r["status"] for r in off.collect()} == {"unverifiable", "not_applicable"}


def theses(spark, *sources):
    rows = [(str(i), path, text.encode()) for i, texts in enumerate(sources) for path, text in texts.items()]
    return spark.createDataFrame(rows, "doc_id string, path string, content binary").withColumn("sha256", F.sha2("content", 256))


def test_headings_are_read_once_and_rules_where_facts_are_made(spark):
    """headings were read four times and joined by title, facts were written, read three times and joined again, every rule searched the whole source for its section."""
    files = theses(spark, {"main.tex": "\\begin{document}lead in\n\\section{Document preamble}\na\n\\section{Vvedenie}\nb\n\\section{Введениее}\nc\n\\section{Приложение А}\nd\n\\section{x}\ne\n\\section{y}\nf\n\\section{x}\ng\\end{document}"}, {"main.tex": "no heading"})
    projects = keep(P.projects(files), "projects")
    sections = P.sections(spark, projects)
    assert "Join" not in plan_of(sections) and plan_of(sections).count("FileScan") == 1
    got = {}
    for r in sections.orderBy("doc_id", "char_start").collect():
        got.setdefault(r["doc_id"], []).append((r["section_id"], r["kind"], r["char_start"], r["char_end"]))
    ends = [(a, b) for _, _, a, b in got["0"]]
    assert [k[:2] for k in got["0"]] == [("document-preamble", "document"), ("document-preamble", "other"), ("vvedenie", "other"), ("introduction", "introduction"), ("appendix-а", "appendix"), ("x", "other"), ("y", "other"), ("x-2", "other")]
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and got["1"] == [("document", "document", 0, 10)]
    facts = T.facts(spark, projects, sections, files, P.bib_entries(files, projects))
    plan = T.evaluate(spark, facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "(?=\\\\section" in plan and "\\Q" in plan


def test_sections_are_found_by_title_as_in_the_whole_source(spark):
    """the search among the arguments alone finds what the search in the source found."""
    body = "\\section{1 Обзор 2}a\\section*{ОБЗОР}b\n\\SECTION{\\emph{x}}c\\section{\\{b}d\\section{}e\\section{12}f\\section{x\\E y}g\\section{.*}"
    titles = ["обзор", "Обзор 2", "x", "{b", "{", "}", "", "1", "12", "3", "\\E", "x\\E y", ".*", "нет", None, "\\", "2}"]
    df = spark.createDataFrame([(b, t) for t in titles for b in (body, "", None, "x\\section{", "\\section{\n1}\n")], "b string, t string")
    names, bodies = L.section_list(F.col("b"))
    for r in df.select("b", "t", L.section_body(F.col("b"), F.col("t")).alias("old"), L.section_of(names, bodies, F.col("b"), F.col("t")).alias("new")).collect():
        assert r["old"] == r["new"], r


def test_a_bibliography_is_read_with_its_project(spark):
    """bibliographies were shuffled and read a second time, their entries numbered and gathered again one by one."""
    bib = "@book{a, title={B}, x={1}}\n@article{b, title={u\u0308}}\n@book{a, title={C}}\n@misc{, x={1}}"
    files = theses(spark, {"main.tex": "\\addbibresource{z.bib}\\addbibresource{y.bib}", "y.bib": bib, "z.bib": "@book{b, title={Z}}@book{c"}, {"main.tex": "x", "q.bib": bib}, {"main.tex": "x"})
    want = last_wins(P.bib_entries(files, P.projects(files)), ["doc_id", "key"], "pos")
    got = P.projects(files, ["doc_id", "bib"]).select("doc_id", F.explode("bib").alias("e")).select("doc_id", "e.*")
    rows = lambda df: sorted((r["doc_id"], r["key"], r["pos"], r["entry_type"], sorted(r["fields"].items())) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 4


def test_origins_take_few_steps(spark, tmp_path, monkeypatch):
    """every span was searched for and written step by step in three maps and went through pandas; the files were made twice, and columns that nobody reads were kept."""
    text = "word  " * 300
    asked, whole = [], T.P.texscan.parts
    monkeypatch.setattr(T.P.texscan, "parts", lambda *a: asked.append(a) or whole(*a))
    got = P._assembled({"main.tex": f"\\begin{{document}}\n{text}\\section{{A}}".encode()}, "main.tex")
    assert len(got["source_map"]) > 500 and len(asked) < 5
    spark.createDataFrame([(1, text, "en", "s", 0), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = C.source_origins(spark, str(tmp_path))
    assert "regexp_replace" not in plan_of(out) and out.count() == 8
