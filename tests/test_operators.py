import json

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import catalog, parses, retrieval, scoring
from tomeflow.plans import answering, datasets, preprocess
from tomeflow.schemas import DOMAINS
from tomeflow.sources import readers, runners, writers
from tomeflow.streaming import incremental

PARSES = "doc_id string, model string, text string"


def test_best_parse_by_preference(spark):
    rows = spark.createDataFrame([("1", "mineru2.5-pro", "m"), ("1", "glm-ocr", "g"), ("2", "mineru2.5-pro", "  \n "), ("2", "pypdf", "p"), ("3", "other", "o"), ("4", "pypdf", None)], PARSES)
    assert {r.doc_id: (r.model, r.text) for r in parses.best_parse(rows).collect()} == {"1": ("glm-ocr", "g"), "2": ("pypdf", "p")}
    assert {r.doc_id: r.text for r in parses.best_parse(rows, "other").collect()} == {"3": "o"}
    assert {r.doc_id: r.models for r in parses.available_models(rows).collect()} == {"1": ["glm-ocr", "mineru2.5-pro"], "2": ["pypdf"]}
    with pytest.raises(Exception, match="no parse for 4"):
        parses.require_parses(rows.select("doc_id").distinct().where("doc_id = '4'"), parses.best_parse(rows)).collect()


def test_pages(spark):
    rows = spark.createDataFrame([("d", "8_10.md", 3, "c"), ("d", "8_2.md", 2, " b \n"), ("d", "8_0.md", 1, " ")], "doc_id string, path string, page int, text string")
    assert parses.concat_pages(rows).first().text == "b\n\nc"
    assert parses.mark_pages(rows).first().text == "<!-- page:1 -->\n\nb\n\n<!-- page:2 -->\n\nc"
    assert parses.mark_pages(rows, physical=True).first().text == "<!-- page:2 -->\n\nb\n\n<!-- page:3 -->\n\nc"
    report = parses.page_report(rows).first()
    assert (report.page_count, report.result_count, report.blank_pages) == (3, 2, [1])
    files = spark.createDataFrame([("d", "2.json", '{"md": "x"}'), ("e", "10.json", '{"markdown": "z"}'), ("e", "9.json", '[{"md": "```\\ny\\n```"}]'), ("e", "1.json", "{")], "doc_id string, path string, json string")
    both = {r.doc_id: r.text for r in parses.pages_or_json(rows, files).collect()}
    assert both == {"d": "b\n\nc", "e": "y\n\nz"}


def test_todo_and_latest(spark):
    pdfs = spark.createDataFrame([("1",), ("2",)], "doc_id string")
    done = spark.createDataFrame([("1", "pypdf")], "doc_id string, model string")
    assert parses.todo(pdfs, done).count() == 7
    assert parses.todo(pdfs, done, overwrite=True).count() == 8
    results = spark.createDataFrame([("m", "1", 1, False), ("m", "1", 2, True)], "model string, doc_id string, at int, ok boolean")
    assert [r.ok for r in parses.latest_results(results).collect()] == [True]


def test_retrieval_ranks_matching_terms_first(spark):
    chunks = spark.createDataFrame([("h::1", "h", "harbour", "x", "cranes lift 货箱 from the quay", 0, 20), ("l::1", "l", "lamps", "y", "the 灯塔 高度 is forty fathoms", 0, 20)], "chunk_id string, doc_id string, title string, domain string, text string, start int, end int")
    asked = spark.createDataFrame([("q1", "灯塔高度多少 fathoms?", {"A": "ten", "B": "forty"}, "mcq", [])], "qid string, question string, options map<string,string>, answer_format string, doc_ids array<string>")
    hits = retrieval.search(asked, chunks, 1)
    assert [r.doc_id for r in hits.collect()] == ["l"]
    assert retrieval.search(asked, chunks, 8, spark.createDataFrame([("q1", "h")], "qid string, doc_id string")).count() == 0
    assert [r.doc_id for r in retrieval.candidate_docs(hits).collect()] == ["l"]
    assert retrieval.evidence(hits, 3).count() == 0
    client = lambda: lambda system, prompt: {"content": 'So {"answer": "A"}', "prompt_tokens": len(prompt), "completion_tokens": 2}
    answers, kept = answering.answer(asked, chunks, client)
    got = answers.orderBy("ord").collect()
    assert [(r.qid, r.answer) for r in got] == [("summary", ""), ("q1", "A")]
    assert got[0].total_tokens == got[1].total_tokens > 0
    assert kept.count() == 1


def test_a_failing_model_gives_an_empty_answer(spark):
    def client():
        def call(system, prompt):
            raise OSError("down")

        return call

    rows = runners.chat(spark.createDataFrame([("q", "mcq", "p")], "qid string, answer_format string, prompt string"), client, "s").collect()
    assert (rows[0].raw, rows[0].error) == ("", "OSError: down")


def test_scores(spark):
    gold = spark.createDataFrame([("1", "a", "mcq", "A"), ("2", "a", "tf", "B"), ("3", "b", "tf", "A")], "qid string, domain string, answer_format string, answer string")
    raw = spark.createDataFrame([("1", "mcq", "A", 3, 1), ("2", "tf", "no", 5, 1)], "qid string, answer_format string, raw string, prompt_tokens int, completion_tokens int")
    answers = scoring.answer_rows(raw)
    grades = scoring.graded(answers, gold)
    total = {(r.domain, r.answer_format): (r.n, round(r.accuracy, 3)) for r in scoring.accuracy(grades).collect()}
    assert total[(None, None)] == (3, 0.333)
    assert total[("a", None)] == (2, 0.5)
    assert scoring.score(grades, answers).first().tokens == 10
    assert scoring.with_summary(answers.limit(0)).first().total_tokens == 0


# --- catalogue, readers and writers ---


def _questions(folder, domain, rows):
    path = folder / f"{domain}.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return str(path)


def _question(qid, domain, ids, **more):
    return {"qid": qid, "domain": domain, "question": "?", "options": {"A": "正确", "B": "错误"}, "answer_format": "tf", "type": "t", "doc_ids": ids} | more


def test_build_datasets(spark, tmp_path):
    for name in ("insurance/1.pdf", "regulatory/【7】港务(b).PDF", "insurance/.hidden.pdf"):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    files = {"regulatory": _questions(tmp_path, "regulatory", [_question("r1", "regulatory", ["【7】港务(b)"])]), "insurance": _questions(tmp_path, "insurance", [_question("i1", "insurance", ["1", "1"]), _question("i2", "insurance", [])])}
    report = datasets.run(spark, files, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert {(r.domain, r.answer_format): r.n for r in report["questions"]} == {("insurance", None): 2, ("regulatory", None): 1, (None, "tf"): 3}
    assert [r.n for r in report["documents"]] == [1, 1, 0, 0, 0]
    asked = readers.read_questions(spark, str(tmp_path / "out/questions.jsonl")).collect()
    assert [r.qid for r in asked] == ["i1", "i2", "r1"]
    assert asked[0].options == {"A": "正确", "B": "错误"}
    assert (asked[0].split, asked[0].qtype) == ("A", "t")
    docs = readers.read_documents(spark, str(tmp_path / "out/documents.jsonl")).collect()
    assert [r.path for r in docs] == ["raw/1.pdf", "raw/【7】港务(b).PDF"]
    bad = {"insurance": _questions(tmp_path, "insurance", [_question("i1", "research", ["none"], answer_format="essay"), _question("i1", "insurance", [])])}
    with pytest.raises(catalog.InvalidCatalog, match="duplicate qid.*unknown answer_format") as e:
        catalog.validated_questions(readers.read_question_files(spark, bad))
    assert "domain differs" in str(e.value)
    lost = {"insurance": _questions(tmp_path, "insurance", [_question("i1", "insurance", ["none"])])}
    with pytest.raises(catalog.InvalidCatalog, match="missing: insurance/none"):
        datasets.build(readers.read_question_files(spark, lost), readers.raw_files(spark, str(tmp_path / "raw")))
    (tmp_path / "research.json").write_text('{"qid": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_question_files(spark, {"research": str(tmp_path / "research.json")}).collect()


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, 2), ("a", "文", 1)], "k string, v string, n int")
    writers.write_jsonl(rows, str(tmp_path / "x"), ["n"], single=True)
    lines = next((tmp_path / "x").glob("*.txt")).read_text(encoding="utf-8").split("\n")
    assert lines == ['{"k":"a","v":"文","n":1}', '{"k":"b","v":null,"n":2}', ""]
    (tmp_path / "y.jsonl").write_text('{"k":"a"}\n\n{"k":"b"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "y.jsonl"), rows.schema).count() == 2
    (tmp_path / "z.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, str(tmp_path / "z.jsonl"), rows.schema).collect()


def test_answer_csv_and_evidence(spark, tmp_path):
    answers = spark.createDataFrame([(1, "q1", "AB", 1, 2, 3), (0, "summary", "", 1, 2, 3)], "ord int, qid string, answer string, prompt_tokens long, completion_tokens long, total_tokens long")
    writers.write_answer_csv(answers, str(tmp_path / "a"))
    assert next((tmp_path / "a").glob("*.csv")).read_text() == "qid,answer,prompt_tokens,completion_tokens,total_tokens\nsummary,,1,2,3\nq1,AB,1,2,3\n"
    kept = spark.createDataFrame([("q1", 1, "d", "clause", 2.5)], "qid string, rank int, doc_id string, text string, score double")
    writers.write_evidence(kept, str(tmp_path / "e"))
    found = json.loads(next((tmp_path / "e").glob("*.txt")).read_text())
    assert found == {"qid": "q1", "evidence": [{"doc_id": "d", "quoted_clause": "clause", "reasoning": "rank 1, score 2.5"}]}


def test_preprocess(spark, tmp_path):
    raw = tmp_path / "data" / "raw"
    raw.mkdir(parents=True)
    (raw / "a b.txt").write_bytes("﻿# 标题\r\n内容\x07 \r\n".encode())
    (raw / "c.html").write_text("<title>T_s</title><p>x</p>")
    (raw / "9.PDF").write_bytes(b"%PDF")
    for model, text in (("glm-ocr", " "), ("pypdf", "## H\nbody")):
        (tmp_path / "parsed" / model).mkdir(parents=True)
        (tmp_path / "parsed" / model / "9.md").write_text(text)
    meta = [{"doc_id": "1", "path": "raw/a b.txt"}, {"doc_id": "2", "path": "raw/c.html", "title": "given"}, {"doc_id": "9", "path": "raw/9.PDF", "title": "given"}]
    (tmp_path / "data" / "documents.jsonl").write_text("\n".join(json.dumps(m) for m in meta))
    counts = preprocess.run(spark, str(tmp_path / "data"), str(tmp_path / "parsed"), str(tmp_path / "out"), 1800, 240)
    assert counts == {"documents": 3, "chunks": 3}
    got = {r.doc_id: (r.title, r.text) for r in spark.read.parquet(str(tmp_path / "out/parsed_documents")).collect()}
    assert got == {"1": ("标题", "# 标题\n内容"), "2": ("T", "x"), "9": ("H", "## H\nbody")}
    assert readers.read_chunks(spark, str(tmp_path / "out/chunks.jsonl")).count() == 3
    assert [r.doc_id for r in readers.discover_pdfs(spark, [str(raw)]).collect()] == ["9"]
    for folder in ("m", "n"):  # equal names in two folders
        (raw / folder).mkdir()
        (raw / folder / "1.txt").write_text(f"of {folder}")
    two = spark.createDataFrame([(f, f"raw/{f}/1.txt", "", "") for f in ("m", "n")], "doc_id string, path string, title string, domain string")
    data = str(tmp_path / "data")
    parsed = preprocess.parse_documents(two, readers.read_plain(spark, f"{data}/raw"), readers.read_html(spark, f"{data}/raw"), readers.read_parses(spark, str(tmp_path / "parsed")), preprocess.qualified(spark, data))
    assert sorted((r.doc_id, r.text) for r in parsed.collect()) == [("m", "of m"), ("n", "of n")]
    with pytest.raises(Exception, match="unsupported file type"):
        spark.createDataFrame([("x.doc",)], "path string").select(catalog.source_kind(F.col("path"))).collect()


def test_runner_errors_are_rows(spark):
    class Runner:
        def parse(self, content):
            if content == b"bad":
                raise ValueError("no")
            if content == b"slow":
                import time

                time.sleep(1)
            return content.decode()

    runners.register("test", Runner)
    files = spark.createDataFrame([("1", "1.pdf", bytearray(b"text")), ("2", "2.pdf", bytearray(b"bad")), ("3", "3.pdf", bytearray(b" ")), ("4", "4.pdf", bytearray(b"slow"))], "doc_id string, path string, content binary")
    got = {r.doc_id: (r.ok, r.error) for r in runners.parse_files(files, "test", timeout=0.3).collect()}
    assert got["1"] == (True, None)
    assert got["2"] == (False, "ValueError: no")
    assert got["3"] == (False, "ValueError: no text")
    assert got["4"][1].startswith("TimeoutError")
    with pytest.raises(ValueError, match="unknown model"):
        runners.parse_files(files, "nothing")


class Pages:
    def parse(self, content):
        return ["", "tide\n\nrose", "  ", "h\na\nr\nb\no\nu\nr"] if content == b"full" else ["", " "]


def test_pages_of_a_text_layer(spark):
    runners.register("paged", Pages)
    files = spark.createDataFrame([("1", "1.pdf", bytearray(b"full")), ("2", "2.pdf", bytearray(b"none"))], "doc_id string, path string, content binary")
    got = {r.doc_id: r for r in runners.parse_files(files, "paged").collect()}
    assert got["1"].text == "<!-- page:1 -->\n\ntide\nrose\n\n<!-- page:2 -->\n\nharbour"
    assert (got["1"].page_count, got["1"].blank_pages) == (4, [1, 3])
    assert (got["2"].ok, got["2"].error, got["2"].blank_pages) == (False, "ValueError: no text", [1, 2])


def test_split_pages(spark):
    files = spark.createDataFrame([("1", "1.pdf", bytearray(b"ab")), ("2", "2.pdf", bytearray(b""))], "doc_id string, path string, content binary")
    made = runners.split_pages(files, lambda: lambda content: [content[i : i + 1] for i in range(len(content))] if content else 1 / 0).collect()
    assert [(r.doc_id, r.page, r.content) for r in made] == [("1", 1, bytearray(b"a")), ("1", 2, bytearray(b"b")), ("2", 0, None)]
    assert made[2].error.startswith("ZeroDivisionError")


def test_parses_as_files(spark, tmp_path):
    runners.register("paged", Pages)
    made = spark.createDataFrame([("1", "1.pdf", bytearray(b"none"))], "doc_id string, path string, content binary")
    root = str(tmp_path / "p")
    writers.write_parses(runners.parse_files(made, "paged"), root).collect()
    folder = tmp_path / "p" / "paged"
    assert (folder / "1.error.txt").read_text() == "ValueError: no text\n"
    assert json.loads((folder / "1.meta.json").read_text())["ok"] is False
    good = made.withColumn("content", F.lit(b"full"))
    written = writers.write_parses(runners.parse_files(good, "paged"), root).collect()
    assert [(r.ok, r.markdown_path) for r in written] == [(True, str(folder / "1.md"))]
    assert sorted(p.name for p in folder.iterdir()) == ["1.md", "1.meta.json"]
    meta = json.loads((folder / "1.meta.json").read_text())
    assert (meta["pages"], meta["blank_pages"]) == (4, [1, 3])
    assert readers.read_parses(spark, root).first().text.endswith("harbour\n")
    page = spark.createDataFrame([("1", 7, "x")], "doc_id string, page int, text string")
    assert (writers.write_page_texts(page, root).first().path, (tmp_path / "p/1/pages_text/page_0007.txt").read_text()) == (f"{root}/1/pages_text/page_0007.txt", "x\n")


def test_staging_copies_what_differs_in_size(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    rows = spark.createDataFrame([("a", "raw/a.pdf", str(tmp_path / "a.pdf"))], "doc_id string, path string, source string")
    assert [writers.stage_files(rows, str(tmp_path / "out")).first().copied for _ in range(2)] == [True, False]
    (tmp_path / "out/raw/a.pdf").write_bytes(b"longer")
    assert writers.stage_files(rows, str(tmp_path / "out")).first().copied
    assert (tmp_path / "out/raw/a.pdf").read_bytes() == b"abc"


def test_commands(tmp_path):
    made = runners.CommandRunner(["sh", "-c", "cp {input} {output}/8_10.md; echo first > {output}/8_2.md"])
    assert made.parse(b"second") == "first\n\nsecond"
    walked = runners.CommandRunner(["sh", "-c", "printf '{{\"a\": [{{\"md\": \"x\"}}]}}' > {output}/1.json"])
    assert walked.parse(b"") == "x"
    with pytest.raises(RuntimeError, match="exit 3: bad"):
        runners.CommandRunner(["sh", "-c", "echo bad >&2; exit 3"]).parse(b"")
    assert runners.settings(["a=b=c"]) == {"a": "b=c"}
    for wrong in ("a", "=b", "a="):
        with pytest.raises(ValueError, match="KEY=VALUE"):
            runners.settings([wrong])


def test_jobs_from_a_shell(spark, tmp_path, capsys):
    from tomeflow import __main__ as jobs

    for domain in DOMAINS:
        (tmp_path / "raw" / domain).mkdir(parents=True)
        _questions(tmp_path, domain, [_question(f"{domain}1", domain, ["only"])] if domain == "insurance" else [])
    (tmp_path / "raw/insurance/only.txt").write_text("Piers close at noon.")
    data, done = str(tmp_path / "data"), str(tmp_path / "processed")
    (tmp_path / "parsed/pypdf").mkdir(parents=True)
    (tmp_path / "parsed/pypdf/x.md").write_text("x")
    assert jobs.main(["build-datasets", "--questions-dir", str(tmp_path), "--raw-root", str(tmp_path / "raw"), "--out-dir", data]) == 0
    assert (tmp_path / "data/raw/only.txt").read_text() == "Piers close at noon."
    assert jobs.main(["preprocess", "--data-dir", data, "--parsed-dir", str(tmp_path / "parsed"), "--processed-dir", done]) == 0
    (tmp_path / "config.json").write_text(json.dumps({"data_dir": data, "processed_dir": done, "submission_dir": str(tmp_path / "sub")}))
    (tmp_path / "raw/insurance/9.pdf").write_bytes(b"%PDF nine")
    parse = ["parse", str(tmp_path / "raw"), "--models", "glm-ocr", "--out-root", str(tmp_path / "parsed"), "--command", "cp {input} {output}/1.md"]
    assert [jobs.main(parse) for _ in range(2)] == [0, 0]
    assert (tmp_path / "parsed/glm-ocr/9.md").read_text() == "%PDF nine\n"
    said = capsys.readouterr().out
    assert "'documents': 1" in said
    assert "glm-ocr {'ok': 1}\nglm-ocr {}" in said
    assert jobs.main(["preview", "--root", str(tmp_path)]) == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"top_k": 3, "data_dir": "d"}')
    made = readers.Config.load(tmp_path, tmp_path / "c.json")
    assert (made.top_k, made.candidate_docs, made.data_dir) == (3, 5, str(tmp_path / "d"))
    (tmp_path / "c.json").write_text('{"topk": 3}')
    with pytest.raises(ValueError, match="topk"):
        readers.Config.load(tmp_path, tmp_path / "c.json")


def test_incremental_chunks(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(2):
        spark.createDataFrame([(f"d{i}", "", "", "text")], "doc_id string, title string, domain string, text string").write.mode("append").parquet(source)
        incremental.chunk_new_documents(spark, source, target, state).awaitTermination()
        assert spark.read.parquet(target).count() == i + 1
