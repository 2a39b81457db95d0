"""Question and document catalogues: validation, reference resolution, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.functions.text import nonempty, stem, suffix
from tomeflow.schemas import ANSWER_FORMATS, DOMAINS


class InvalidCatalog(ValueError):
    """Rows that break the contract, listed."""


def domain_rank(domain: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), domain)


def require(column: str) -> Column:
    """The column as text; an error where it is null."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"missing {column}"))).otherwise(F.col(column).cast("string"))


def document_meta(rows: DataFrame) -> DataFrame:
    return rows.select(require("doc_id").alias("doc_id"), require("path").alias("path"), nonempty(F.col("title")).alias("title"), nonempty(F.col("domain")).alias("domain"))


def questions(rows: DataFrame) -> DataFrame:
    """Question records; the type is the first given of ``raw_type``, ``type``, ``qtype``."""
    ids = F.coalesce(F.col("doc_ids"), F.array().cast("array<string>"))
    return rows.select(require("qid").alias("qid"), require("domain").alias("domain"), nonempty(F.col("split")).alias("split"), require("question").alias("question"), "options", require("answer_format").alias("answer_format"), nonempty(F.col("raw_type"), F.col("type"), F.col("qtype")).alias("qtype"), ids.alias("doc_ids"))


def question_rows(files: dict[str, DataFrame]) -> DataFrame:
    """All domains' questions in the domains' order, with ``domain_no`` and ``pos`` to sort by; ``files`` maps a domain to its rows with ``pos``."""
    parts = []
    for n, domain in enumerate(d for d in DOMAINS if d in files):
        rows = files[domain]
        split = F.coalesce(F.col("split"), F.lit("A"))
        ids = F.coalesce(F.col("doc_ids"), F.array().cast("array<string>"))
        parts.append(rows.select(F.lit(n).alias("domain_no"), "pos", F.lit(domain).alias("file_domain"), "qid", "domain", split.alias("split"), "question", "options", "answer_format", F.coalesce(F.col("type"), F.lit("")).alias("raw_type"), ids.alias("doc_ids")))
    return reduce(DataFrame.unionByName, parts)


def question_errors(rows: DataFrame) -> DataFrame:
    """``(qid, error)``: repeated ids, unknown formats, wrong domains, options that are no map."""
    repeated = rows.groupBy("qid").count().where("count > 1").select("qid", F.lit("duplicate qid").alias("error"))
    checks = [
        (~F.coalesce(F.col("answer_format").isin(*ANSWER_FORMATS), F.lit(False)), "unknown answer_format"),
        (~F.col("domain").eqNullSafe(F.col("file_domain")), "domain differs from its file's"),
        (F.col("options").isNull(), "options is not an object"),
    ]
    found = F.array(*[F.when(bad, F.lit(error)) for bad, error in checks])
    return repeated.unionByName(rows.select("qid", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error")))


def validated_questions(rows: DataFrame, show: int = 20) -> DataFrame:
    """``rows``, or an error listing up to ``show`` of what is wrong."""
    if wrong := question_errors(rows).orderBy("qid", "error").limit(show).collect():
        raise InvalidCatalog("; ".join(f"{r.qid}: {r.error}" for r in wrong))
    return rows


def referenced_docs(questions: DataFrame) -> DataFrame:
    """``(domain, doc_id, first_question, first_pos)``: documents that questions name, once a domain, with where they first do."""
    named = questions.select("domain", "ord", F.posexplode("doc_ids").alias("pos", "doc_id"))
    return named.groupBy("domain", "doc_id").agg(F.min(F.struct("ord", "pos")).alias("first")).select("domain", "doc_id", F.col("first.ord").alias("first_question"), F.col("first.pos").alias("first_pos"))


def stem_index(files: DataFrame) -> DataFrame:
    """``(domain, stem, paths)`` of raw files ``(domain, path)``; names that start with a dot are skipped."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    return files.where(~name.startswith(".")).groupBy("domain", stem(F.col("path")).alias("stem")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def resolve_docs(references: DataFrame, index: DataFrame) -> DataFrame:
    """``(domain, doc_id, paths, status)``: ``ok``, ``missing`` or ``ambiguous``."""
    joined = references.join(index.withColumnRenamed("stem", "doc_id"), ["domain", "doc_id"], "left")
    status = F.when(F.col("paths").isNull(), "missing").when(F.size("paths") > 1, "ambiguous").otherwise("ok")
    return joined.withColumn("status", status)


def document_rows(resolved: DataFrame, show: int = 20) -> DataFrame:
    """Document records of resolved references; an error lists missing and ambiguous ones."""
    bad = resolved.where("status <> 'ok'").orderBy("status", "domain", "doc_id").limit(show).collect()
    if bad:
        raise InvalidCatalog("; ".join(f"{r.status}: {r.domain}/{r.doc_id}" for r in bad))
    ending = F.regexp_extract(F.col("paths")[0], r"(\.[^./]+)$", 1)
    return resolved.select("doc_id", F.concat(F.lit("raw/"), F.col("doc_id"), ending).alias("path"), F.col("doc_id").alias("title"), "domain", F.col("paths")[0].alias("source"), "first_question", "first_pos")


def counts_by(questions: DataFrame) -> DataFrame:
    """``(domain, answer_format, n)``: counts by domain and by format in one pass; the other column is null."""
    return questions.groupingSets([[F.col("domain")], [F.col("answer_format")]], "domain", "answer_format").agg(F.count("*").alias("n"))


def documents_by_domain(documents: DataFrame) -> DataFrame:
    """``(domain, n)`` in the domains' order, 0 for domains without documents."""
    spark = documents.sparkSession
    dim = spark.createDataFrame([(i, d) for i, d in enumerate(DOMAINS)], "ord int, domain string")
    return dim.join(documents.groupBy("domain").agg(F.count("*").alias("n")), "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), "ord").orderBy("ord").drop("ord")


def source_kind(path: Column) -> Column:
    """How a file is parsed, by its suffix: ``txt``, ``html``, ``pdf``; an error for others."""
    ending = suffix(path)
    unknown = F.raise_error(F.concat(F.lit("unsupported file type: "), path))
    return F.when(ending == ".txt", "txt").when(ending.isin(".html", ".htm"), "html").when(ending == ".pdf", "pdf").otherwise(unknown)
