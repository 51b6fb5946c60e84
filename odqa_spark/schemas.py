"""Table schemas and the limits of the vector table."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


ARTICLE = _struct(id=_S, title=_S, url=_S, text=_S)
PASSAGE = ARTICLE
TOKEN_STATS = _struct(id=_S, title=_S, text=_S, token_length=_L, text_length=_L)
VECTOR_PASSAGE = _struct(id=_S, vec=T.ArrayType(T.FloatType()), title=_S, text=_S)
QA_PAIR = _struct(question=_S, answer=T.ArrayType(_S))
QA_RUN = _struct(
    row_idx=_L, config=_S, question=_S, answer=T.ArrayType(_S),
    retrieved=_S, summary=_S, predicted=_S, score=_D,
)
ANSWER_INFO = _struct(score=_D, start=_I, end=_I, answer=_S)
SPAN_PREDICTION = _struct(
    prediction_text=_S, span_score=_D, relevance_score=_D, passage_index=_I,
    passage_token_ids=T.ArrayType(_I),
)
_TOKEN_SPAN = _struct(start_token=_I, end_token=_I)
NQ_RAW = _struct(
    example_id=_S, document_text=_S, question_text=_S,
    annotations=T.ArrayType(_struct(long_answer=_TOKEN_SPAN, short_answers=T.ArrayType(_TOKEN_SPAN))),
)
NQ_SPLIT = T.StructType(
    NQ_RAW.fields
    + _struct(long_answer_text=_S, short_answer_text=_S, split_id=_S, answer_exist_chunk=_B).fields
)
NQ_SUMMARY = T.StructType(NQ_SPLIT.fields + _struct(summarization_text=_S).fields)
SQUAD_REFERENCE = _struct(
    id=_S, answers=_struct(answer_start=T.ArrayType(_I), text=T.ArrayType(_S))
)

# Field limits of the vector table.
ID_MAX = 16
TITLE_MAX = 1024
TEXT_MAX = 16384
VECTOR_DIM = 768
