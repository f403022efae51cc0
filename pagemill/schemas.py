"""Explicit schemas of the entities; CSV is read as strings and typed by projection."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OPTIONS = ("A", "B", "C", "D", "E", "F")
QUESTION = _struct(Question_ID=_S, Domain=_S, N_Pages=_S, Question=_S, **{o: _S for o in OPTIONS}, Correct_Answer=_S, Doc_ID=_S, Page_Num=_S)
PREDICTION = _struct(Question_ID=_S, Correct_Answer=_S, Doc_ID=_S, Page_Num=_S)
PAGE = _struct(doc_id=_S, page_num=_I, text=_S)
DOC_META = _struct(doc_id=_S, n_pages=_I, domain=_S)
RANKED_PAGE = _struct(doc_id=_S, page_num=_I, score=_D)
RANKING = _struct(qid=_S, doc_id=_S, page_num=_I, score=_D, rank=_I)
RANKING_DETAIL = _struct(Question_ID=_S, Domain=_S, true_doc=_S, true_page=_I, n_pages=_I, **{k: T.ArrayType(RANKED_PAGE) for k in ("dense_pages", "reranked_pages", "final_pages", "dense_docs", "final_docs")})
