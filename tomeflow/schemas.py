"""Record schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT_META = _struct(doc_id=_S, path=_S, title=_S, domain=_S)
QUESTION_ROW = _struct(qid=_S, domain=_S, split=_S, question=_S, options=T.MapType(_S, _S), answer_format=_S, raw_type=_S, type=_S, qtype=_S, doc_ids=T.ArrayType(_S))
PARSED_DOCUMENT = _struct(doc_id=_S, title=_S, domain=_S, text=_S)
CHUNK = _struct(chunk_id=_S, doc_id=_S, title=_S, domain=_S, text=_S, start=_I, end=_I)
PARSE_STATUS = _struct(ok=_B, model=_S, doc_id=_S, pdf_path=_S, markdown_path=_S, error=_S, seconds=_D)
ANSWER_ROW = _struct(qid=_S, answer=_S, prompt_tokens=_L, completion_tokens=_L, total_tokens=_L)

# Domain order, answer formats, and parser models from most to least preferred.
DOMAINS = ("insurance", "regulatory", "financial_contracts", "financial_reports", "research")
ANSWER_FORMATS = ("multi", "tf", "mcq")
PARSE_MODELS = ("glm-ocr", "mineru2.5-pro", "paddleocr-vl-1.6", "pypdf")
