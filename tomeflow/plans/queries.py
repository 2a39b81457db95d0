"""The engine's operators as queries over the driver's tables, with the same results as DuckDB SQL.

The tables hold no files, questions or parses, so these are derived from
documents, pages, conversations, benchmark and labels by expressions that both
engines have; every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.functions.answers import is_valid_answer, json_object, normalize_answer
from tomeflow.functions.text import first_heading, first_line, natural_key, nonempty_lines, normalize_markdown, normalize_text, normalize_text_layer, plain_text, stem, suffix
from tomeflow.functions.tokens import tokenize, user_prompt
from tomeflow.functions.trees import html_paragraphs, html_title
from tomeflow.operators import catalog, chunking, parses, retrieval, scoring
from tomeflow.plans import answering, preprocess
from tomeflow.schemas import DOMAINS, PARSE_MODELS
from tomeflow.sources import readers, runners, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOISE = " \x07\t\r\n\r\n\n \r\n\r"
WHITE = r"[\s\p{Z}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _q(text: str) -> str:
    """A DuckDB literal with escapes."""
    return "E'" + text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\x07", "\\x07") + "'"


# --- text ---

_NORMAL = f"""regexp_replace({_sql_strip(f"regexp_replace(regexp_replace(replace(replace(x, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t\\f\\v\\p{{Z}}]+\\n', E'\\n', 'g')")}, '\\n{{4,}}', E'\\n\\n\\n', 'g')"""


@query(f"SELECT doc_id, {_NORMAL} AS text FROM (SELECT doc_id, '  ' || replace(text, E'\\n', {_q(NOISE)}) || E'\\t\\r' AS x FROM documents)")
def text_normalize(spark, sf_dir):
    noisy = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(NOISE)), F.lit("\t\r"))
    return _table(spark, sf_dir, "documents").select("doc_id", normalize_text(noisy).alias("text"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN 'x' || chr(10) || chr(10) || chr(10) || text ELSE '```' || 'python' || chr(10) || text END AS text FROM documents""")
def text_markdown(spark, sf_dir):
    """Fences of each kind, runs of line feeds, and a fence that isn't closed."""
    fence, n = F.lit("```"), F.col("doc_id") % 4
    made = F.when(n == 0, F.concat(F.lit(" ```markdown\r\n"), F.col("text"), F.lit("\r``` "))).when(n == 1, F.concat(F.lit("```md\n"), F.col("text"), fence)).when(n == 2, F.concat(F.lit("x\n\n\n\n\n\n"), F.col("text"))).otherwise(F.concat(fence, F.lit("python\n"), F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", normalize_markdown(made).alias("text"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '{WHITE}+', '', 'g')
  ELSE array_to_string(list_filter([{_sql_strip("l")} for l in string_split(text, chr(10))], lambda l: l <> ''), chr(10)) END AS text FROM documents""")
def text_layer(spark, sf_dir):
    """Texts with even ids are set one character a line first."""
    upright = F.regexp_replace("text", r"(?s)([^\n])", "$1\n")
    return _table(spark, sf_dir, "documents").select("doc_id", normalize_text_layer(F.when(F.col("doc_id") % 2 == 0, upright).otherwise(F.col("text"))).alias("text"))


_LINES = f"list_filter([{_sql_strip('l')} for l in string_split(text, chr(10))], lambda l: l <> '')"


@query(f"SELECT doc_id, {_LINES}[1] AS first_line, CASE WHEN doc_id % 3 > 0 THEN {_LINES}[-1] END AS heading FROM documents")
def text_titles(spark, sf_dir):
    """First lines below an empty heading, and the last line again as the only heading with text."""
    last = F.element_at(nonempty_lines(F.col("text")), -1)
    at = F.when(F.col("doc_id") % 3 > 0, F.concat("text", F.lit("\n##\n##  "), last)).otherwise(F.col("text"))
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", first_line(F.concat(F.lit("##\n # "), F.col("text"))).alias("first_line"), first_heading(at).alias("heading"))


@query("""SELECT doc_id, len(t)::INT AS n_terms, len(list_distinct(t))::INT AS n_distinct, array_to_string(t[1:5], ' ') AS first_terms
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)""")
def terms(spark, sf_dir):
    t = tokenize(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(F.slice(t, 1, 5), " ").alias("first_terms"))


@query("""SELECT conv_id, turn, 'page_' || turn AS stem, '.md' AS suffix, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM conversations""")
def page_order(spark, sf_dir):
    """Natural order of page files."""
    path = F.concat(F.lit("out/"), F.col("conv_id").cast("string"), F.lit("/page_"), F.col("turn").cast("string"), F.lit(".MD"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(natural_key(path)))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", stem(path).alias("stem"), suffix(path).alias("suffix"), place.alias("place"))


# --- chunks ---


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are paragraphs."""
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.lit("").alias("title"), F.col("lang").alias("domain"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


_BLOCKS = """parts AS MATERIALIZED (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents),
b AS MATERIALIZED (SELECT doc_id, i, p[i] AS part, (list_sum([0] || [length(x) + 2 for x in p[1:i - 1]]))::INT AS start
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts))"""


@query(f"WITH {_BLOCKS} SELECT doc_id, i::INT AS block_no, start, part AS block FROM b")
def blocks(spark, sf_dir):
    return chunking.blocks(_paragraphs(spark, sf_dir))


def _sql_windows(text: str, start: str, size: int = 1800, overlap: int = 240) -> str:
    last = f"CASE WHEN length({text}) <= {size} THEN 0 ELSE ceil((length({text}) - {size}) / {size - overlap}.0)::INT END"
    return f"""list_filter([{{'start': ({start} + i * {size - overlap})::INT, 'text': {_sql_strip(f"substr({text}, (i * {size - overlap})::BIGINT + 1, {size})")}}} for i in range(0, {last} + 1)], lambda w: w.text <> '')"""


@query(f"SELECT doc_id, n::INT AS window_no, w[n].start AS start, w[n].text AS text FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS n FROM (SELECT doc_id, {_sql_windows('text', '0')} AS w FROM documents))")
def windows(spark, sf_dir):
    return chunking.window_rows(_table(spark, sf_dir, "documents"))


_TAIL = f"CASE WHEN instr(t, chr(10)) > 1 THEN {_sql_strip('substr(t, instr(t, chr(10)) + 1)')} ELSE t END"
_CHUNKS = f"""{_BLOCKS},
fold(doc_id, i, cur, cur_start, out) AS (
  SELECT doc_id, 0::BIGINT, '', 0, []::STRUCT("start" INT, "text" VARCHAR)[] FROM parts
  UNION ALL
  SELECT doc_id, i, CASE WHEN is_long THEN '' WHEN is_full AND tail <> '' THEN tail || chr(10) || chr(10) || part WHEN is_full OR cur = '' THEN part ELSE cur || chr(10) || chr(10) || part END,
    CASE WHEN is_long THEN 0 WHEN is_full AND tail <> '' THEN greatest(start - length(tail) - 2, 0)::INT WHEN is_full OR cur = '' THEN start ELSE cur_start END,
    CASE WHEN (is_long OR is_full) AND cur <> '' THEN [{{'start': cur_start, 'text': cur}}] ELSE [] END || CASE WHEN is_long THEN {_sql_windows('part', 'start')} ELSE [] END
  FROM (SELECT *, length(part) > 1800 AS is_long, cur <> '' AND length(cur) + 2 + length(part) > 1800 AS is_full, {_TAIL} AS tail
    FROM (SELECT f.doc_id, b.i, b.part, b.start, f.cur, f.cur_start, {_sql_strip('right(f.cur, 240)')} AS t FROM fold f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1))),
emitted AS (
  SELECT doc_id, i, unnest(range(1, len(out) + 1)) AS k, out FROM fold WHERE len(out) > 0
  UNION ALL SELECT f.doc_id, f.i + 1, 1, [{{'start': cur_start, 'text': cur}}] FROM fold f JOIN parts p ON f.doc_id = p.doc_id AND f.i = len(p.p) WHERE cur <> ''),
chunks AS MATERIALIZED (
  SELECT printf('%s::%04d', e.doc_id::VARCHAR, row_number() OVER (PARTITION BY e.doc_id ORDER BY i, k)) AS chunk_id, e.doc_id::VARCHAR AS doc_id, '' AS title, lang AS domain,
    {_sql_strip('out[k].text')} AS text, out[k].start AS start FROM emitted e JOIN parts p ON p.doc_id = e.doc_id)"""


@query(f'WITH RECURSIVE {_CHUNKS} SELECT *, (start + length(text))::INT AS "end" FROM chunks')
def chunks(spark, sf_dir):
    return chunking.make_chunks(_paragraphs(spark, sf_dir))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT domain, count(*) AS n, count(DISTINCT doc_id) AS documents, sum(length(text))::BIGINT AS chars, max(length(text))::INT AS longest FROM chunks GROUP BY domain")
def chunk_stats(spark, sf_dir):
    made = chunks(spark, sf_dir)
    return made.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


# --- pages ---


def _sql_unescape(text: str) -> str:
    for name, value in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?|&apos;", "''"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{name}', '{value}', 'g')"
    return text


@query(f"SELECT page_id, nullif({_sql_strip(f"split_part({_sql_unescape('t')}, '_', 1)")}, '') AS title FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title', 1) AS t FROM pages)")
def page_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"))


@query()
def page_texts(spark, sf_dir):
    """Paragraphs of every page; parsed as HTML, which SQL can't."""
    return _table(spark, sf_dir, "pages").select("page_id", html_paragraphs("html").alias("text"))


def _parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as parsed by each model, some blank."""
    rows = _table(spark, sf_dir, "documents")
    models = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(m).alias("model")) for i, m in enumerate(PARSE_MODELS)])
    made = rows.select("doc_id", "text", F.explode(models).alias("m")).select("doc_id", "m.model", "m.k", "text")
    text = F.when((F.col("doc_id") + F.col("k")) % 3 == 0, F.lit(" \n\t")).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("# "), "model", F.lit("\n"), F.substring("text", 1, 200)))
    return made.select("doc_id", "model", text.alias("text"))


_PARSES = f"""parses AS (SELECT doc_id, k, model, CASE WHEN (doc_id + k) % 3 = 0 OR doc_id % 11 = 0 THEN '' ELSE {_sql_strip("'# ' || model || chr(10) || substr(text, 1, 200)")} END AS text
  FROM documents, (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(PARSE_MODELS))}) AS m(k, model))"""


@query(f"WITH {_PARSES} SELECT doc_id, arg_min(model, k) AS model, arg_min(text, k) AS text FROM parses WHERE text <> '' GROUP BY doc_id")
def best_parse(spark, sf_dir):
    return parses.best_parse(_parses(spark, sf_dir))


@query(f"WITH {_PARSES} SELECT doc_id, string_agg(model, ',' ORDER BY k) AS models FROM parses WHERE text <> '' GROUP BY doc_id")
def available_models(spark, sf_dir):
    return parses.available_models(_parses(spark, sf_dir)).withColumn("models", F.array_join("models", ","))


@query(f"WITH {_PARSES} SELECT doc_id, arg_min(model, k) AS title FROM parses WHERE text <> '' GROUP BY doc_id")
def parse_titles(spark, sf_dir):
    return parses.parse_titles(_parses(spark, sf_dir))


@query(f"WITH {_PARSES} SELECT doc_id, model FROM parses p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND l.quality = p.k % 2)")
def todo_parses(spark, sf_dir):
    """Documents by models, without those that labels call done."""
    labels = _table(spark, sf_dir, "labels")
    done = labels.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i % 2).alias("q"), F.lit(m).alias("model")) for i, m in enumerate(PARSE_MODELS)])).alias("m"), "quality").where("m.q = quality").select("doc_id", "m.model")
    return parses.todo(_table(spark, sf_dir, "documents").select("doc_id"), done)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as page files; every third turn is blank."""
    rows = _table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 2, F.lit(" \n ")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n\n")))
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("p/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.col("turn").alias("page"), text.alias("text"))


_PAGES = f"pages1 AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 3 = 2 THEN '' ELSE {_sql_strip('text')} END AS text FROM conversations)"


@query(f"WITH {_PAGES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pages1 WHERE text <> '' GROUP BY doc_id")
def page_concat(spark, sf_dir):
    return parses.concat_pages(_pages(spark, sf_dir))


def _marked(no: str) -> str:
    return f"string_agg('<!-- page:' || {no} || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page)"


@query(f"WITH {_PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM pages1 WHERE text <> '') SELECT doc_id, {_marked('n')} AS by_rank, {_marked('page')} AS by_page FROM r GROUP BY doc_id")
def page_marks(spark, sf_dir):
    """Pages under markers, by rank among those with text and by page number."""
    rows = _pages(spark, sf_dir)
    return parses.mark_pages(rows).withColumnRenamed("text", "by_rank").join(parses.mark_pages(rows, physical=True).withColumnRenamed("text", "by_page"), "doc_id")


@query(f"WITH {_PAGES} SELECT doc_id, count(*) AS page_count, count(*) FILTER (text <> '') AS result_count, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (text = ''), '') AS blank_pages FROM pages1 GROUP BY doc_id")
def page_report(spark, sf_dir):
    return parses.page_report(_pages(spark, sf_dir)).withColumn("blank_pages", F.array_join("blank_pages", ","))


@query(f"WITH {_PAGES} SELECT doc_id, string_agg(text || chr(10) || chr(10) || 'z' || page, chr(10) || chr(10) ORDER BY page) AS text FROM pages1 WHERE text <> '' GROUP BY doc_id")
def json_walk(spark, sf_dir):
    """Markdown strings of JSON files in their key order; blank pages are files that are no JSON."""
    rows = _pages(spark, sf_dir)
    tree = F.struct(F.struct(F.array(F.struct(F.col("text").alias("MD"), F.lit("skipped").alias("other"))).alias("zz")).alias("z"), F.struct(F.concat(F.lit("z"), F.col("page").cast("string")).alias("markdown")).alias("a"))
    return parses.json_pages(rows.select("doc_id", "path", F.when(F.col("page") % 3 == 2, F.lit("{broken")).otherwise(F.to_json(tree)).alias("json")))


# --- catalogue ---


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions that name two documents, or none."""
    rows = _table(spark, sf_dir, "documents")
    ids = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("doc_id") % 97).cast("string"), (F.col("doc_id") % 31).cast("string")))
    formats = F.element_at(F.array(F.lit("multi"), F.lit("tf"), F.lit("mcq")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select(F.col("doc_id").alias("ord"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), F.col("lang").alias("domain"), formats.alias("answer_format"), ids.alias("doc_ids"))


@query("""WITH q AS (SELECT doc_id AS ord, lang AS domain, [doc_id % 97, doc_id % 31] AS ids FROM documents WHERE doc_id % 5 <> 0),
n AS (SELECT domain, ord, i - 1 AS pos, ids[i]::VARCHAR AS doc_id FROM (SELECT *, unnest([1, 2]) AS i FROM q)),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, doc_id ORDER BY ord, pos) AS k FROM n)
SELECT domain, doc_id, ord AS first_question, pos::INT AS first_pos FROM r WHERE k = 1""")
def referenced_docs(spark, sf_dir):
    return catalog.referenced_docs(_questions(spark, sf_dir))


@query("""WITH refs AS (SELECT source AS domain, doc_id::VARCHAR AS doc_id FROM documents UNION ALL SELECT DISTINCT source, 'none_' || source FROM documents),
files AS (SELECT d.source AS domain, d.doc_id::VARCHAR AS stem, 'raw/' || d.source || '/' || d.doc_id || '.pdf' AS path FROM labels JOIN documents d USING (doc_id)
  UNION ALL SELECT source, doc_id::VARCHAR, 'raw/' || source || '/x/' || doc_id || '.TXT' FROM documents WHERE doc_id % 10 = 0),
idx AS (SELECT domain, stem, string_agg(path, ' ' ORDER BY path) AS paths, count(*) AS n FROM files GROUP BY ALL)
SELECT r.domain, r.doc_id, coalesce(paths, '') AS paths, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM refs r LEFT JOIN idx ON idx.domain = r.domain AND idx.stem = r.doc_id""")
def resolve_docs(spark, sf_dir):
    """Documents looked up among raw files made of labels and of every tenth document, and one missing a source."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"))
    labelled = rows.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    path = lambda middle, ending: F.concat(F.lit("raw/"), "domain", F.lit(middle), F.col("doc_id").cast("string"), F.lit(ending)).alias("path")
    files = labelled.select("domain", path("/", ".pdf")).unionByName(rows.where("doc_id % 10 = 0").select("domain", path("/x/", ".TXT")))
    hidden = rows.select("domain", path("/.", ".pdf"))
    refs = rows.select("domain", F.col("doc_id").cast("string").alias("doc_id")).unionByName(rows.select("domain").distinct().withColumn("doc_id", F.concat(F.lit("none_"), "domain")))
    found = catalog.resolve_docs(refs, catalog.stem_index(files.unionByName(hidden)))
    return found.select("domain", "doc_id", F.coalesce(F.array_join("paths", " "), F.lit("")).alias("paths"), "status")


_DOMAIN = "CASE lang WHEN 'en' THEN 'insurance' WHEN 'de' THEN 'regulatory' WHEN 'fr' THEN 'research' ELSE 'financial_reports' END"


def _domain(lang: str = "lang"):
    return F.when(F.col(lang) == "en", "insurance").when(F.col(lang) == "de", "regulatory").when(F.col(lang) == "fr", "research").otherwise("financial_reports")


@query(f"""SELECT coalesce(domain, '') AS domain, coalesce(answer_format, '') AS answer_format, count(*) AS n
FROM (SELECT {_DOMAIN} AS domain, ['multi', 'tf', 'mcq'][doc_id % 3 + 1] AS answer_format FROM documents) GROUP BY GROUPING SETS ((domain), (answer_format))""")
def question_counts(spark, sf_dir):
    made = _questions(spark, sf_dir).withColumn("domain", _domain("domain"))
    return catalog.counts_by(made).fillna("", ["domain", "answer_format"])


@query(f"SELECT d.domain, count(doc_id) AS n FROM (VALUES {', '.join(f"('{d}')" for d in DOMAINS)}) AS d(domain) LEFT JOIN (SELECT doc_id, {_DOMAIN} AS domain FROM documents) USING (domain) GROUP BY d.domain")
def documents_by_domain(spark, sf_dir):
    return catalog.documents_by_domain(_table(spark, sf_dir, "documents").select(_domain().alias("domain")))


@query("""WITH q AS (SELECT 'q' || (doc_id // 2) AS qid, doc_id FROM documents)
SELECT qid, 'duplicate qid' AS error FROM q GROUP BY qid HAVING count(*) > 1
UNION ALL SELECT qid, 'unknown answer_format' FROM q WHERE doc_id % 7 = 0
UNION ALL SELECT qid, 'domain differs from its file''s' FROM q WHERE doc_id % 6 = 0
UNION ALL SELECT qid, 'options is not an object' FROM q WHERE doc_id % 9 = 0""")
def question_errors(spark, sf_dir):
    n = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select(F.concat(F.lit("q"), F.floor(n / 2).cast("string")).alias("qid"), F.when(n % 7 == 0, F.when(n % 2 == 0, "essay")).otherwise("tf").alias("answer_format"), F.when(n % 6 == 0, "x").otherwise("research").alias("domain"), F.lit("research").alias("file_domain"), F.when(n % 9 != 0, F.create_map(F.lit("A"), F.lit("a"))).alias("options"))
    return catalog.question_errors(rows)


# --- retrieval ---


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions with two options, naming no document."""
    rows = _table(spark, sf_dir, "benchmark")
    options = F.create_map(F.lit("A"), F.substring("text", 1, 20), F.lit("B"), F.lit("none"))
    return rows.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"), options.alias("options"), F.lit("mcq").alias("answer_format"), F.array().cast("array<string>").alias("doc_ids"))


_HITS = f"""WITH RECURSIVE {_CHUNKS},
q AS MATERIALIZED (SELECT DISTINCT item_id::VARCHAR AS qid, unnest(regexp_extract_all(lower(text || ' ' || substr(text, 1, 20) || ' none'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
w AS MATERIALIZED (SELECT chunk_id, len(t) AS size, unnest(t) AS term FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM chunks)),
tf AS MATERIALIZED (SELECT term, chunk_id, size, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT (SELECT count(*) FROM chunks)::DOUBLE AS n, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM chunks) AS mean),
scored AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored),
hits AS MATERIALIZED (SELECT qid, rank::INT AS rank, score, chunk_id, c.doc_id, c.text, c.start FROM ranked JOIN chunks c USING (chunk_id) WHERE rank <= 8)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(_benchmark(spark, sf_dir), chunks(spark, sf_dir))


@query(f"{_HITS} SELECT qid, rank, score, chunk_id, doc_id, start FROM hits")
def bm25(spark, sf_dir):
    """The best chunks for every benchmark item (a top-k report)."""
    return _hits(spark, sf_dir).select("qid", "rank", "score", "chunk_id", "doc_id", "start")


@query(f"{_HITS}, d AS (SELECT qid, doc_id, max(score) AS score FROM hits GROUP BY ALL) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM d QUALIFY rank <= 5")
def candidate_docs(spark, sf_dir):
    return retrieval.candidate_docs(_hits(spark, sf_dir))


@query(f"{_HITS} SELECT qid, rank, chunk_id, used FROM (SELECT qid, rank, chunk_id, (sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM hits) WHERE used <= 6000")
def evidence(spark, sf_dir):
    """Evidence within 6000 characters a question."""
    return retrieval.evidence(_hits(spark, sf_dir), 6000).select("qid", "rank", "chunk_id", "used")


_TARGETS = "targets AS (SELECT DISTINCT b.item_id::VARCHAR AS qid, d.doc_id::VARCHAR AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"{_HITS}, {_TARGETS} SELECT qid, avg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.qid = t.qid AND h.doc_id = t.doc_id) THEN 1.0 ELSE 0.0 END) AS recall FROM targets t GROUP BY qid")
def recall(spark, sf_dir):
    """Recall of the documents that hold an item word for word."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("item"))
    docs = _table(spark, sf_dir, "documents")
    # a document with an item has the item's longest inner word; its whole text decides
    inner = F.slice(F.split("item", " "), 2, F.greatest(F.size(F.split("item", " ")) - 2, F.lit(1)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    near = words.join(items.withColumn("word", longest), "word").select("doc_id", "qid", "item")
    found = docs.select("doc_id", "text").join(near, "doc_id").where(F.contains("text", "item")).select("qid", "doc_id").distinct()
    return retrieval.recall_at_k(_hits(spark, sf_dir), found)


@query("""SELECT item_id::VARCHAR AS qid, E'Evidence:\\n[d1]\\n' || substr(text, 1, 40) || E'\\n\\n[d2]\\nx\\n\\nQuestion (mcq): ' || text || E'\\nA. ' || substr(text, 1, 20) || E'\\nB. none' AS prompt FROM benchmark""")
def prompts(spark, sf_dir):
    rows = _benchmark(spark, sf_dir).withColumn("blocks", F.array(F.concat(F.lit("[d1]\n"), F.substring("question", 1, 40)), F.lit("[d2]\nx")))
    return rows.select("qid", user_prompt(F.col("question"), F.col("options"), F.col("answer_format"), F.col("blocks")).alias("prompt"))


@query()
def answer_run(spark, sf_dir):
    """Every benchmark item through retrieval, prompt, a stand-in model and normalization; an external call, so without SQL."""

    def client():
        return lambda system, prompt: {"content": f'{{"answer": "{"ABCD"[len(prompt) % 4]}"}}', "prompt_tokens": len(prompt), "completion_tokens": len(system) % 7}

    return answering.answer(_benchmark(spark, sf_dir), chunks(spark, sf_dir), client)[0]


# --- answers and scores ---

_LETTERS = "list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: regexp_matches(w, '^[A-D]+$'))"


@query(f"""WITH t AS (SELECT conv_id, turn, ['multi', 'tf', 'mcq'][turn % 3 + 1] AS answer_format, {_LETTERS} AS w FROM conversations),
a AS (SELECT conv_id, turn, answer_format, CASE answer_format WHEN 'multi' THEN array_to_string(list_sort(list_distinct(string_split(array_to_string(w, ''), ''))), '')
  WHEN 'tf' THEN coalesce(list_filter(w, lambda x: x IN ('A', 'B'))[1], '') ELSE coalesce(list_filter(w, lambda x: length(x) = 1)[1], '') END AS answer FROM t)
SELECT *, answer <> '' AS valid FROM a""")
def answer_letters(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(F.lit("multi"), F.lit("tf"), F.lit("mcq")), (F.col("turn") % 3 + 1).cast("int")).alias("answer_format"), "text")
    answer = normalize_answer(F.col("text"), F.col("answer_format"))
    return rows.select("conv_id", "turn", "answer_format", answer.alias("answer"), is_valid_answer(answer, F.col("answer_format")).alias("valid"))


_GRADED = """graded AS (SELECT d.doc_id, lang AS domain, ['multi', 'tf', 'mcq'][d.doc_id % 3 + 1] AS answer_format, coalesce(['A', 'B'][l.quality + 1] = ['A', 'B'][l.toxic + 1], false) AS correct
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.doc_id % 4 <> 0)"""


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as answers (quality) to gold (toxicity); documents without a label are unanswered."""
    labels = _table(spark, sf_dir, "labels")
    letter = lambda c: F.when(F.col(c) == 0, "A").otherwise("B")
    tokens = F.length(F.col("doc_id").cast("string")).cast("long")
    raw = labels.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("qid"), F.lit("tf").alias("answer_format"), letter("quality").alias("raw"), (tokens * 1000).alias("prompt_tokens"), tokens.alias("completion_tokens"))
    answers = scoring.answer_rows(raw)
    gold = _questions(spark, sf_dir).select(F.col("ord").cast("string").alias("qid"), "domain", "answer_format").join(labels.select(F.col("doc_id").cast("string").alias("qid"), letter("toxic").alias("answer")), "qid", "left")
    return scoring.graded(answers, gold), answers


@query(f"WITH {_GRADED} SELECT coalesce(domain, '') AS domain, coalesce(answer_format, '') AS answer_format, count(*) AS n, round(avg(correct::INT), 9) AS accuracy FROM graded GROUP BY CUBE (domain, answer_format)")
def accuracy(spark, sf_dir):
    return scoring.accuracy(_graded(spark, sf_dir)[0]).fillna("", ["domain", "answer_format"]).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {_GRADED}, t AS (SELECT sum(length(doc_id::VARCHAR) * 1001)::BIGINT AS tokens FROM labels WHERE doc_id % 4 <> 0), a AS (SELECT avg(correct::INT) AS accuracy FROM graded),
s AS (SELECT accuracy, tokens, greatest(0.0, least(1.0, (5000000 - tokens) / 5000000.0)) AS ts FROM a, t)
SELECT round(accuracy, 9) AS accuracy, tokens::INT AS tokens, round(ts, 9) AS token_score, round(100 * accuracy * (0.7 + 0.3 * ts), 9) AS final_score FROM s""")
def final_score(spark, sf_dir):
    return scoring.score(*_graded(spark, sf_dir)).select("tokens", *[F.round(c, 9).alias(c) for c in ("accuracy", "token_score", "final_score")])


@query("""SELECT 1 AS ord, doc_id::VARCHAR AS qid, ['A', 'B'][quality + 1] AS answer, length(doc_id::VARCHAR) * 1000 AS prompt_tokens, length(doc_id::VARCHAR) AS completion_tokens, length(doc_id::VARCHAR) * 1001 AS total_tokens FROM labels WHERE doc_id % 4 <> 0
UNION ALL SELECT 0, 'summary', '', sum(length(doc_id::VARCHAR) * 1000)::BIGINT, sum(length(doc_id::VARCHAR))::BIGINT, sum(length(doc_id::VARCHAR) * 1001)::BIGINT FROM labels WHERE doc_id % 4 <> 0""")
def token_summary(spark, sf_dir):
    return scoring.with_summary(_graded(spark, sf_dir)[1])


# --- records, files and whole jobs ---


def _shared(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder in the warehouse for a query that writes and reads back."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tomeflow_queries/{sf_dir.rstrip('/').rsplit('/', 1)[-1]}/{name}"


@query(f"SELECT doc_id, {_sql_strip("regexp_replace(replace(replace(x, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), '[ \\t\\f\\v\\p{Z}]+\\n', E'\\n', 'g')")} AS text FROM (SELECT doc_id, '  ' || replace(text, E'\\n', E'　\\t\\r\\n\\r\\n \\r') || E'\\t\\r' AS x FROM documents)")
def text_plain(spark, sf_dir):
    """Plain files with a byte order mark and all three line ends."""
    noisy = F.concat(F.lit("﻿  "), F.replace("text", F.lit("\n"), F.lit("　\t\r\n\r\n \r")), F.lit("\t\r"))
    return _table(spark, sf_dir, "documents").select("doc_id", plain_text(noisy).alias("text"))


_META = "doc_id::VARCHAR AS doc_id, 'raw/' || source || '/' || doc_id % 7 || ['.txt', '.HTML', '.htm', '.pdf'][doc_id % 4 + 1] AS path, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'T' || doc_id END AS title, CASE WHEN doc_id % 5 > 0 THEN lang END AS domain"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue records; paths repeat their file names in other folders, titles and domains are partly missing."""
    n = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".HTML", ".htm", ".pdf")]), (n % 4 + 1).cast("int"))
    title = F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, "").otherwise(F.concat(F.lit("T"), n.cast("string")))
    rows = _table(spark, sf_dir, "documents")
    return rows.select(n.cast("string").alias("doc_id"), F.concat(F.lit("raw/"), "source", F.lit("/"), (n % 7).cast("string"), ending).alias("path"), title.alias("title"), F.when(n % 5 > 0, F.col("lang")).alias("domain"), "text")


@query(f"SELECT doc_id, path, coalesce(title, '') AS title, coalesce(domain, '') AS domain, CASE regexp_extract(lower(path), '[.][a-z]+$') WHEN '.txt' THEN 'txt' WHEN '.pdf' THEN 'pdf' ELSE 'html' END AS kind FROM (SELECT {_META} FROM documents)")
def document_records(spark, sf_dir):
    """Catalogue records read back from JSON lines, and how their files are parsed."""
    path = _shared(spark, sf_dir, "documents.jsonl")
    writers.write_jsonl(_meta(spark, sf_dir).drop("text"), path, ["doc_id"])
    return readers.read_documents(spark, path).withColumn("kind", catalog.source_kind(F.col("path")))


def _raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw question records, with what may be missing missing."""
    n = F.col("doc_id")
    some = lambda k, value: F.when(n % k > 0, value)
    rows = _table(spark, sf_dir, "documents")
    return rows.select(
        n.alias("pos"), F.concat(F.lit("q"), n.cast("string")).alias("qid"), _domain().alias("domain"), some(2, F.lit("B")).alias("split"), F.concat(F.lit("about "), "source").alias("question"), F.create_map(F.lit("A"), F.col("lang")).alias("options"),
        F.lit("mcq").alias("answer_format"), F.when(n % 6 == 0, "").otherwise(some(3, F.lit("raw"))).alias("raw_type"), some(4, F.lit("kind")).alias("type"), F.lit("q").alias("qtype"), some(5, F.array(n.cast("string"))).alias("doc_ids"),
    )


@query(f"""SELECT 'q' || doc_id AS qid, {_DOMAIN} AS domain, CASE WHEN doc_id % 2 > 0 THEN 'B' ELSE '' END AS split, 'about ' || source AS question, lang AS option_a, 'mcq' AS answer_format,
CASE WHEN doc_id % 3 > 0 THEN 'raw' WHEN doc_id % 4 > 0 THEN 'kind' ELSE 'q' END AS qtype, CASE WHEN doc_id % 5 > 0 THEN doc_id::VARCHAR ELSE '' END AS ids FROM documents""")
def question_records(spark, sf_dir):
    """Question records read back from JSON lines."""
    path = _shared(spark, sf_dir, "questions.jsonl")
    writers.write_jsonl(_raw_questions(spark, sf_dir).drop("pos"), path, ["qid"])
    read = readers.read_questions(spark, path)
    return read.select("qid", "domain", "split", "question", read["options"]["A"].alias("option_a"), "answer_format", "qtype", F.array_join("doc_ids", ",").alias("ids"))


@query(f"""SELECT *, (list_position([{", ".join(f"'{d}'" for d in DOMAINS)}], domain) - 1)::INT AS domain_no FROM (
SELECT {_DOMAIN} AS domain, doc_id AS pos, 'q' || doc_id AS qid, CASE WHEN doc_id % 2 > 0 THEN 'B' ELSE 'A' END AS split, CASE WHEN doc_id % 4 > 0 THEN 'kind' ELSE '' END AS raw_type, (doc_id % 5 > 0)::INT AS n_ids FROM documents)""")
def question_files(spark, sf_dir):
    """All domains' question files as one table, with what sorts them."""
    rows = _raw_questions(spark, sf_dir)
    joined = catalog.question_rows({d: rows.where(F.col("domain") == d) for d in DOMAINS})
    return joined.select("domain", "domain_no", "pos", "qid", "split", "raw_type", F.size("doc_ids").alias("n_ids"))


@query("""SELECT d.doc_id::VARCHAR AS doc_id, 'raw/' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN '.PDF' ELSE '.txt' END AS path, d.doc_id::VARCHAR AS title, source AS domain,
'raw/' || source || '/' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN '.PDF' ELSE '.txt' END AS source FROM documents d""")
def catalogue_rows(spark, sf_dir):
    """Document records of references that all resolve; suffixes keep their case."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("domain"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".txt").alias("ending"))
    files = rows.select("domain", F.concat(F.lit("raw/"), "domain", F.lit("/"), "doc_id", "ending").alias("path"))
    refs = rows.select("domain", "doc_id", F.lit(1).alias("first_question"), F.lit(0).alias("first_pos"))
    return catalog.document_rows(catalog.resolve_docs(refs, catalog.stem_index(files))).select("doc_id", "path", "title", "domain", "source")


@query(f"""WITH m AS (SELECT doc_id AS n, {_META}, text FROM documents),
p AS (SELECT n, doc_id, coalesce(domain, '') AS domain, coalesce(title, '') AS given, n % 4 AS kind, {_sql_strip("CASE WHEN n % 4 = 3 THEN '# H' || n || chr(10) || text ELSE text END")} AS text FROM m)
SELECT doc_id, domain, text, CASE WHEN kind = 3 THEN 'H' || n WHEN kind = 0 THEN coalesce(nullif(given, ''), nullif({_LINES}[1], ''), doc_id) WHEN n % 8 > 3 THEN 'page ' || n ELSE coalesce(nullif(given, ''), doc_id) END AS title FROM p""")
def parsed_documents(spark, sf_dir):
    """Documents parsed by the kind of their file, which is found by its whole path; titles by each kind's precedence."""
    meta = _meta(spark, sf_dir)
    n = F.col("doc_id").cast("long")
    path = F.concat(F.lit("file:///data/raw/"), "doc_id", F.lit("/"), F.regexp_extract("path", "[^/]+$", 0))
    own = meta.withColumn("path", F.regexp_replace(path, "^file:///data/", ""))
    files = meta.select(F.col("doc_id"), path.alias("path"), "text")
    kind = n % 4
    html = files.where(kind.isin(1, 2)).withColumn("title", F.when(n % 8 > 3, F.concat(F.lit("page "), "doc_id")))
    made = files.where(kind == 3).select("doc_id", F.lit("pypdf").alias("model"), F.concat(F.lit("# H"), "doc_id", F.lit("\n"), "text").alias("text"))
    return preprocess.parse_documents(catalog.document_meta(own), files.where(kind == 0), html, made, "file:/data").select("doc_id", "title", "domain", "text")


@query(f"""{_HITS}, free AS (SELECT qid, rank, score, h.chunk_id FROM ranked r JOIN chunks h USING (chunk_id) WHERE qid::INT % 3 = 0 AND rank <= 8),
bound AS (SELECT qid, score, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ranked JOIN chunks c USING (chunk_id) WHERE qid::INT % 3 > 0 AND c.doc_id::BIGINT % 10 = qid::INT % 10)
SELECT qid, rank::INT AS rank, score, chunk_id FROM free UNION ALL SELECT qid, rank::INT, score, chunk_id FROM bound WHERE rank <= 8""")
def allowed_hits(spark, sf_dir):
    """The best chunks within the documents that a question may use (a top-k report); every third question may use all."""
    asked = _benchmark(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).cast("int").alias("part"))
    may = asked.where("cast(qid as int) % 3 > 0").select("qid", (F.col("qid").cast("int") % 10).alias("part")).join(docs, "part").select("qid", "doc_id")
    return retrieval.search(asked, chunks(spark, sf_dir), allowed=may).select("qid", "rank", "score", "chunk_id")


@query(f"""WITH pages1 AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, CASE WHEN turn % 3 = 2 THEN '' ELSE array_to_string({_LINES}, chr(10)) END AS md FROM conversations),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS n FROM pages1 WHERE md <> ''),
marked AS (SELECT conv_id, string_agg('<!-- page:' || n || ' -->' || chr(10) || chr(10) || md, chr(10) || chr(10) ORDER BY n) AS text FROM kept GROUP BY conv_id)
SELECT p.conv_id::VARCHAR AS doc_id, any_value(m.text) IS NOT NULL AS ok, any_value(m.text) AS text, count(*)::INT AS page_count, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (md = ''), '') AS blank_pages,
CASE WHEN any_value(m.text) IS NULL THEN 'ValueError: no text' END AS error FROM pages1 p LEFT JOIN marked m USING (conv_id) GROUP BY p.conv_id""")
def layer_pages(spark, sf_dir):
    """Conversations as files of pages, read page by page through a runner; every third turn is blank."""

    class Runner:
        def parse(self, content):
            return content.decode().split("\f")

    runners.register("form-feed", Runner)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit(" \n")).otherwise(F.concat(F.lit("\n "), "text", F.lit("\n\n"))).alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    files = rows.groupBy("conv_id").agg(F.array_join(listed, "\f").cast("binary").alias("content")).select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("x.pdf").alias("path"), "content")
    return runners.parse_files(files, "form-feed").select("doc_id", "ok", "text", "page_count", F.array_join("blank_pages", ",").alias("blank_pages"), "error")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL ELSE ['A', 'B', 'C', 'D'][turn % 4 + 1] END AS answer, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'c' || turn END AS clause FROM conversations""")
def answer_objects(spark, sf_dir):
    """The objects in what a model says; every fourth says none."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("turn") % 4 + 1).cast("int"))
    said = F.concat(F.lit("Well:\n"), F.to_json(F.struct(letter.alias("answer"), F.array(F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("quoted_clause"))).alias("evidence"))), F.lit("\nThat is all."))
    got = json_object(F.when(F.col("turn") % 4 == 0, F.lit("I can't say.")).otherwise(said), "answer string, evidence array<struct<doc_id:string,quoted_clause:string,reasoning:string>>")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", got.alias("o")).select("conv_id", "turn", F.col("o.answer").alias("answer"), F.get("o.evidence", 0)["quoted_clause"].alias("clause"))


@query("""SELECT doc_id::VARCHAR AS qid, ['A', 'B'][quality + 1] AS answer, length(doc_id::VARCHAR) * 1001 AS total_tokens FROM labels WHERE doc_id % 4 <> 0
UNION ALL SELECT 'summary', NULL, sum(length(doc_id::VARCHAR) * 1001)::BIGINT FROM labels WHERE doc_id % 4 <> 0""")
def answer_file(spark, sf_dir):
    """The answer file, read back; an empty answer reads as null."""
    path = _shared(spark, sf_dir, "answers")
    writers.write_answer_csv(token_summary(spark, sf_dir), path)
    return spark.read.option("header", "true").schema("qid string, answer string, prompt_tokens long, completion_tokens long, total_tokens long").csv(path).select("qid", "answer", "total_tokens")


@query(f"{_HITS} SELECT qid, string_agg(doc_id || ':' || length(text), ',' ORDER BY rank) AS clauses FROM hits GROUP BY qid")
def evidence_file(spark, sf_dir):
    """The evidence file of the best chunks, read back."""
    path = _shared(spark, sf_dir, "evidence")
    writers.write_evidence(_hits(spark, sf_dir), path)
    read = spark.read.schema("qid string, evidence array<struct<doc_id:string,quoted_clause:string,reasoning:string>>").json(path)
    return read.select("qid", F.array_join(F.transform("evidence", lambda e: F.concat(e["doc_id"], F.lit(":"), F.length(e["quoted_clause"]).cast("string"))), ",").alias("clauses"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, sum(start)::BIGINT AS starts, sum(length(text))::BIGINT AS chars FROM chunks")
def chunk_files(spark, sf_dir):
    """Documents and chunks written as tables and JSON lines, read back and counted."""
    docs, made = _shared(spark, sf_dir, "parsed"), _shared(spark, sf_dir, "chunks.jsonl")
    writers.write_table(_paragraphs(spark, sf_dir), docs)
    writers.write_jsonl(chunking.make_chunks(spark.read.parquet(docs)), made, ["doc_id", "chunk_id"])
    counted = readers.read_chunks(spark, made).agg(F.count("*").alias("chunks"), F.sum("start").alias("starts"), F.sum(F.length("text")).alias("chars"))
    return counted.withColumn("documents", F.lit(spark.read.parquet(docs).count()))
